"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exact_dedup, kdtree, language_id, mixing, packing, quality, secrets, simhash, warc

QUERIES = {
    "op1_language_id": language_id.op1_language_id,
    "op2_secret_scan": secrets.op2_secret_scan,
    "op3_exact_topk": kdtree.op3_exact_topk,
    "op4_chat_formatting": chat.op4_chat_formatting,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_warc": warc.op6_warc,
    "op7_simhash_dedup": simhash.op7_simhash_dedup,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_quality_mil": quality.op9_quality_mil,
    "op10_best_fit_packing": packing.op10_best_fit_packing,
}

ORACLES = {
    "op2_secret_scan": secrets.ORACLE,
    "op3_exact_topk": kdtree.ORACLE,
    "op4_chat_formatting": chat.ORACLE,
    "op5_source_mixing": mixing.ORACLE,
    "op6_warc": warc.ORACLE,
    "op8_exact_dedup": exact_dedup.ORACLE,
}
