"""Measures of a ranking against known answers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_id

CUTS = (1, 2, 5, 10, 20, 50, 100)


def gold_ranks(rows: DataFrame, candidates: DataFrame, topk: int, query_id: str = "query_id", gold: str = "gold_concept_id", rank: str = "rank") -> DataFrame:
    """rows with gold_rank (the first place of the answer within topk, else null) and n_candidates."""
    found = candidates.select(F.col(query_id).alias("_q"), as_id(F.col("concept_id")).alias("_id"), F.col(rank).alias("_rank"))
    pairs = rows.select(query_id, as_id(F.trim(F.col(gold).cast("string"))).alias("_gold")).join(found, F.col(query_id) == F.col("_q"), "left")
    hit = (F.col("_id") == F.col("_gold")) & (F.col("_rank") <= topk)
    ranks = pairs.groupBy(query_id).agg(F.min(F.when(hit, F.col("_rank"))).alias("gold_rank"), F.count("_q").alias("n_candidates"))
    return rows.join(ranks, query_id, "left")


def evaluate(rows: DataFrame, candidates: DataFrame, topk: int = 100, query_id: str = "query_id", gold: str = "gold_concept_id", rank: str = "rank") -> DataFrame:
    """One row: n_rows, coverage, n_labeled, hit@k, mrr@100. Answers that are no integer count as labelled and never hit."""
    df = gold_ranks(rows, candidates, topk, query_id, gold, rank)
    text = F.trim(F.col(gold).cast("string"))
    labeled = text.isNotNull() & (text != "") & (F.lower(text) != "nan")
    n = F.count_if(labeled)
    at = lambda k: F.when(n > 0, F.count_if(labeled & (F.col("gold_rank") <= k)) / n)
    return df.agg(
        F.count("*").cast("double").alias("n_rows"),
        (F.count_if(F.col("n_candidates") > 0) / F.greatest(F.count("*"), F.lit(1))).alias("coverage"),
        n.cast("double").alias("n_labeled"),
        *[at(k).alias(f"hit@{k}") for k in CUTS],
        F.when(n > 0, F.sum(F.when(labeled & (F.col("gold_rank") <= 100), 1.0 / F.col("gold_rank")).otherwise(0.0)) / n).alias("mrr@100"),
    )
