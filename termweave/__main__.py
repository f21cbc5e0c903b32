"""Command line: `index build`, `infer bulk`, `infer query`."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from . import __version__


def parser() -> argparse.ArgumentParser:
    """The names and defaults of the flags are fixed values."""
    p = argparse.ArgumentParser(prog="termweave")
    p.add_argument("--version", action="version", version=__version__)
    top = p.add_subparsers(dest="group", required=True)
    index = top.add_parser("index").add_subparsers(dest="action", required=True)
    b = index.add_parser("build", help="build a vector index from concept tables")
    given = b.add_mutually_exclusive_group(required=True)
    given.add_argument("--source", help="folder with concept.parquet and, if there are any, concept_profiles, concept_synonym")
    given.add_argument("--duckdb", help="DuckDB file with those tables")
    b.add_argument("--out-db", required=True)
    b.add_argument("--table", required=True)
    b.add_argument("--profiles-table", default="concept_profiles")
    b.add_argument("--concepts-table", default="concept")
    for flag in ("domain-id", "concept-class-id", "exclude-concept-class-id", "extra-column"):
        b.add_argument(f"--{flag}", action="append", default=[])
    b.add_argument("--max-synonyms", type=int, default=3)
    b.add_argument("--include-codes-in-text", action=argparse.BooleanOptionalAction, default=False)
    b.add_argument("--batch-size", type=int, default=256)
    infer = top.add_parser("infer").add_subparsers(dest="action", required=True)
    k = infer.add_parser("bulk", help="map a sheet of terms")
    k.add_argument("--input", required=True)
    k.add_argument("--out", required=True)
    q = infer.add_parser("query", help="look terms up; without --text, one a line")
    q.add_argument("--query", "--text", dest="text")
    q.add_argument("--show-topk", type=int, default=20)
    q.add_argument("--expect-name", help="exit 1 unless the first candidate has this name")
    q.add_argument("--debug", action="store_true", help="show the features of each candidate")
    for x in (k, q):
        x.add_argument("--db", required=True)
        x.add_argument("--table", required=True)
        x.add_argument("--candidate-topk", type=int, default=100)
        x.add_argument("--retrieval-topk", type=int, default=400 if x is k else 200)
        x.add_argument("--where")
        x.add_argument("--post-mode", choices=("blend", "lex", "tiebreak"), default="tiebreak")
        x.add_argument("--post-weight", type=float, default=0.05)
        x.add_argument("--post-strength-weight", type=float, default=0.6)
        x.add_argument("--post-jaccard-weight", type=float, default=0.4)
        x.add_argument("--post-brand-penalty", type=float, default=0.3)
        x.add_argument("--post-minmax", action=argparse.BooleanOptionalAction, default=True)
        x.add_argument("--tiebreak-eps", type=float, default=0.01)
        x.add_argument("--tiebreak-topn", type=int, default=50)
        x.add_argument("--brand-strict", action="store_true")
        x.add_argument("--exclude-concept-class-id", action="append", default=[])
        x.add_argument("--strip-non-latin", action="store_true")
        x.add_argument("--strip-chars", default="")
        x.add_argument("--inn2usan", "--convert-inn-to-usan", action=argparse.BooleanOptionalAction, default=True)
        x.add_argument("--inn2usan-extra", action="store_true")
        x.add_argument("--encoder-model-id")
        x.add_argument("--encoder-pooling", choices=("cls", "mean"))
        x.add_argument("--encoder-max-length", type=int)
        x.add_argument("--encoder-trust-remote-code", action=argparse.BooleanOptionalAction, default=None)
        x.add_argument("--device", default="cpu", help="cpu, cuda, mps, or auto")
        x.add_argument("--reranker-id", help="a model whose token vectors rerank candidates; without one, hashed words do")
        x.add_argument("--no-rerank", action="store_true", help="keep the order of the vector search")
        x.add_argument("--cosine-relevance", action="store_true", help="without reranking, take the cosine as relevance")
        x.add_argument("--batch-size", type=int, default=64)
    for x in (b,):
        x.add_argument("--model-id")
        x.add_argument("--pooling", choices=("cls", "mean"), default="cls")
        x.add_argument("--max-length", type=int, default=128)
        x.add_argument("--trust-remote-code", action="store_true")
        x.add_argument("--device", default="cpu", help="cpu, cuda, mps, or auto")
    k.add_argument("--n-limit", type=int, default=0)
    k.add_argument("--topk", type=int, default=20)
    k.add_argument("--source-name-column", default="sourceName")
    k.add_argument("--source-code-column", default="sourceCode")
    k.add_argument("--label-column", default="conceptId")
    k.add_argument("--status-column", default="mappingStatus")
    k.add_argument("--approved-value", default="APPROVED")
    k.add_argument("--vocab", help="folder with concept and concept_ancestor, for scopes and class exclusion")
    k.add_argument("--atc-scope", action=argparse.BooleanOptionalAction, default=True, help="move candidates below a row's atc_ids or atc_codes up (needs --vocab)")
    k.add_argument("--allowlist-max-ids", type=int, default=1000)
    k.add_argument("--rag-provider")
    k.add_argument("--rag-model", "--ollama-model", dest="rag_model")
    k.add_argument("--rag-base-url", "--cloudflare-base-url", "--openrouter-base-url", "--ollama-base-url", "--llamacpp-base-url", dest="rag_base_url", help="of the provider that is used")
    k.add_argument("--rag-candidate-limit", type=int, default=50)
    k.add_argument("--rag-extra-context-column")
    k.add_argument("--rag-stop-sequence", action="append", default=[])
    k.add_argument("--rag-template", help="a file with {source}, {candidates}, {format_instructions}, {extra_context}")
    k.add_argument("--rag-template-field", default="profile_text")
    k.add_argument("--rag-profile-char-limit", type=int, default=512)
    k.add_argument("--rag-include-retrieval-score", action=argparse.BooleanOptionalAction, default=False)
    k.add_argument("--rag-include-final-score", action=argparse.BooleanOptionalAction, default=False)
    k.add_argument("--rag-use-normalized-query", action=argparse.BooleanOptionalAction, default=True)
    k.add_argument("--cloudflare-use-responses-api", action=argparse.BooleanOptionalAction, default=None)
    k.add_argument("--gpt-reasoning-effort", choices=("low", "medium", "high"))
    k.add_argument("--cf-reasoning-summary", choices=("auto", "concise", "detailed"))
    k.add_argument("--ollama-timeout", "--llamacpp-timeout", dest="timeout", type=float)
    k.add_argument("--ollama-keep-alive")
    k.add_argument("--llamacpp-model-path")
    k.add_argument("--llamacpp-n-ctx", type=int)
    k.add_argument("--llamacpp-n-gpu-layers", type=int)
    k.add_argument("--llamacpp-n-threads", type=int)
    k.add_argument("--llamacpp-chat-format")
    k.add_argument("--llamacpp-system-prompt")
    return p


def prompt_builder(a: argparse.Namespace):
    from functools import partial

    from .functions.prompts import FORMAT, prompt, template_prompt

    if a.rag_template:
        # executors need not see the file
        return partial(template_prompt, Path(a.rag_template).read_text(encoding="utf-8"), field=a.rag_template_field, limit=a.rag_profile_char_limit, instructions=FORMAT)
    scores = ("retrieval_score",) * a.rag_include_retrieval_score + ("final_score",) * a.rag_include_final_score
    return partial(prompt, scores=scores)


def model_client(a: argparse.Namespace):
    """The client of a run's flags; None without a provider. llamacpp is a server, or a model file if one is given."""
    from .sources.clients import client

    if not a.rag_provider:
        return None
    if a.rag_candidate_limit <= 0:
        raise ValueError("--rag-candidate-limit must be above 0")
    options = {"stop": tuple(a.rag_stop_sequence)}
    name = "llamacpp-local" if a.rag_provider == "llamacpp" and a.llamacpp_model_path else a.rag_provider
    if name == "llamacpp-local":
        options |= {"model_path": a.llamacpp_model_path, "n_ctx": a.llamacpp_n_ctx, "n_gpu_layers": a.llamacpp_n_gpu_layers, "n_threads": a.llamacpp_n_threads, "chat_format": a.llamacpp_chat_format, "system": a.llamacpp_system_prompt}
    else:
        options["base_url"] = a.rag_base_url
        if name != "llamacpp":
            options["model"] = a.rag_model
        if name in ("ollama", "llamacpp"):
            options["timeout"] = a.timeout
        if name == "ollama":
            options["keep_alive"] = a.ollama_keep_alive
        if name == "cloudflare":
            reasoning = {"effort": a.gpt_reasoning_effort, "summary": a.cf_reasoning_summary}
            options |= {"use_responses": a.cloudflare_use_responses_api, "reasoning": {k: v for k, v in reasoning.items() if v} or None}
    return client(name, **options)


FEATURES = ("strength_sim", "jaccard_text", "brand_score", "release_score", "form_release_score", "form_route_score", "post_score", "_relevance_score")


def main(argv: list[str] | None = None) -> int:
    from .operators.profiles import values
    from .plans.build import build_index
    from .plans.mapping import Options, WordVectors, look_up, run_bulk
    from .sources.encoders import LateInteraction, encoder
    from .sources.files import duckdb_tables, encoder_settings, read_index, read_manifest, table_or_none

    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("termweave").getOrCreate()
    if a.group == "index":
        source = a.source or duckdb_tables(spark, a.duckdb, [a.concepts_table, a.profiles_table, "concept_synonym"])
        done = build_index(spark, source, a.out_db, a.table, profiles_table=a.profiles_table, concepts_table=a.concepts_table, domains=a.domain_id, classes=a.concept_class_id, without_classes=a.exclude_concept_class_id, extra=a.extra_column, max_synonyms=a.max_synonyms, with_code=a.include_codes_in_text, model_id=a.model_id, pooling=a.pooling, max_length=a.max_length, trust_remote_code=a.trust_remote_code, batch_size=a.batch_size, device=a.device)
        print(done)
        return 0
    o = Options(candidate_topk=a.candidate_topk, retrieval_topk=a.retrieval_topk, where=a.where, ascii_only=a.strip_non_latin, drop_chars=a.strip_chars, usan=a.inn2usan, optional_usan=a.inn2usan_extra, without_classes=tuple(values(a.exclude_concept_class_id)), post_mode=a.post_mode, post_weight=a.post_weight, w_strength=a.post_strength_weight, w_text=a.post_jaccard_weight, w_brand=a.post_brand_penalty, minmax=a.post_minmax, tiebreak_eps=a.tiebreak_eps, tiebreak_topn=a.tiebreak_topn, brand_strict=a.brand_strict)
    encode = encoder(**encoder_settings(read_manifest(spark, a.db, a.table), a.encoder_model_id, a.encoder_pooling, a.encoder_max_length, a.encoder_trust_remote_code), device=a.device)
    o.cosine_relevance = a.cosine_relevance
    rerank = None if a.no_rerank else LateInteraction(a.reranker_id, device=a.device) if a.reranker_id else WordVectors()
    if a.action == "bulk":
        o.first_rows, o.name_column, o.code_column, o.label_column, o.status_column, o.approved = a.n_limit, a.source_name_column, a.source_code_column, a.label_column, a.status_column, a.approved_value
        o.scope_most, o.model_limit, o.model_context = a.allowlist_max_ids, a.rag_candidate_limit, a.rag_extra_context_column
        tables = {n: table_or_none(spark, a.vocab, n) if a.vocab else None for n in ("concept", "concept_ancestor")}
        o.model_reads = "query_norm" if a.rag_use_normalized_query else "query_text"
        o.model_prompt = prompt_builder(a)
        print(run_bulk(spark, a.db, a.table, a.input, a.out, o, encode, rerank, tables["concept"], tables["concept_ancestor"] if a.atc_scope else None, model_client(a), a.topk))
        return 0
    index, vector = read_index(spark, a.db, a.table)
    index, met = index.cache(), True
    for line in [a.text] if a.text else sys.stdin:
        if line.strip() in (":q", ":quit", ":exit"):
            break
        if line.strip():
            for r in look_up(spark, line.strip(), index, vector, encode, o, rerank, a.show_topk):
                print(f"{r['rank']:>3}  {r['concept_id']:>10}  {r.get('final_score') or 0:.3f}  {r.get('concept_name') or r.get('profile_text')}")
                if a.debug:
                    print("     " + "  ".join(f"{k}={r[k]:.3f}" for k in FEATURES if r.get(k) is not None))
                if a.expect_name and r["rank"] == 1:
                    met = met and (r.get("concept_name") or r.get("profile_text") or "").strip().lower() == a.expect_name.strip().lower()
    return 0 if met else 1


if __name__ == "__main__":
    sys.exit(main())
