"""Candidates ordered by a language model: prompts per query, answers merged back by joins."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prompts import answered_ids, prompt

_FIELDS = ("concept_id", "concept_name", "profile_text", "retrieval_score", "final_score")


def ask(candidates: DataFrame, queries: DataFrame, generate: Callable[[str], str], limit: int = 50, query_id: str = "query_id", text: str = "query_norm", context: str | None = None, rank: str = "rank", build: Callable[..., str] = prompt) -> DataFrame:
    """(query_id, prompt, response, ids, error): one call a query over its first `limit` candidates, made on the executors.

    generate must be picklable. An answer that cannot be read gives an error row and no ids.
    """
    if "retrieval_score" not in candidates.columns and "_relevance_score" in candidates.columns:
        candidates = candidates.withColumn("retrieval_score", F.col("_relevance_score").cast("double"))
    have = [F.col(c) for c in _FIELDS if c in candidates.columns]
    some = candidates.filter(F.col(rank) <= limit).groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct(F.col(rank).alias("_rank"), *have))).alias("cands"))
    told = queries.select(query_id, F.col(text).alias("_text"), (F.col(context).cast("string") if context else F.lit(None).cast("string")).alias("_context")).join(some, query_id)

    @F.pandas_udf("struct<prompt: string, response: string, ids: array<long>, error: string>")
    def run(texts: pd.Series, contexts: pd.Series, cands: pd.Series) -> pd.DataFrame:
        rows = []
        for t, c, own in zip(texts, contexts, cands, strict=True):
            asked = response = ids = error = None
            try:
                asked = build(t, [dict(x) for x in own], context=c)
                response = generate(asked)
                ids = answered_ids(response)
            except Exception as e:  # noqa: BLE001  one failed call is a row of the error table
                error = str(e)
            rows.append((asked, response, ids, error))
        return pd.DataFrame(rows, columns=["prompt", "response", "ids", "error"])

    return told.select(query_id, run("_text", "_context", "cands").alias("a")).select(query_id, "a.*")


def merge(candidates: DataFrame, answers: DataFrame, limit: int = 50, query_id: str = "query_id", rank: str = "rank") -> DataFrame:
    """candidates in the order of answers (query_id, ids): known ids first, each once, then the rest as they stood.

    rag_rank and rag_score are those of the first `limit` candidates; queries whose answer names none keep their order.
    """
    asked = candidates.filter(F.col(rank) <= limit).select(query_id, F.col("concept_id").cast("long").alias("_id"), F.col(rank).alias("_at"))
    said = answers.filter(F.col("ids").isNotNull()).select(query_id, F.posexplode("ids").alias("_pos", "_id")).groupBy(query_id, "_id").agg(F.min("_pos").alias("_pos"))
    own = Window.partitionBy(query_id)
    both = asked.join(said, [query_id, "_id"], "left").withColumn("_some", F.count("_pos").over(own)).filter("_some > 0")
    n = F.count("*").over(own)
    both = both.withColumn("rag_rank", F.row_number().over(own.orderBy(F.col("_pos").asc_nulls_last(), "_at"))).withColumn("rag_score", (n - F.col("rag_rank") + 1) / n)
    both = both.select(F.col(query_id).alias("_q"), "_at", "rag_rank", "rag_score")
    df = candidates.join(both, (candidates[query_id] == F.col("_q")) & (candidates[rank] == F.col("_at")), "left").drop("_q", "_at")
    return df.withColumn(rank, F.row_number().over(own.orderBy(F.coalesce(F.col("rag_rank"), F.col(rank) + limit), rank)))
