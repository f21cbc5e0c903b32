"""Mapping of source terms: one set-oriented plan from a sheet of terms to ranked candidates, measures and exports."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions import prompts
from ..functions.text import prepared_query, query_text
from ..operators import metrics, model_rank, ranking, scope, search
from ..sources import exports, usagi
from ..sources.encoders import HashedNgrams, encoded, encoder
from ..sources.files import encoder_settings, numbered, read_index, read_manifest, read_sheet

#: Candidate columns that go on to ranking.
KEPT = ("concept_id", "concept_name", "domain_id", "concept_class_id", "vocabulary_id", "profile_text", "profile_text_norm", "_relevance_score")


@dataclass
class Options:
    """What a run can be told; defaults are those of the command line."""

    candidate_topk: int = 100
    retrieval_topk: int = 400
    where: str | None = None
    first_rows: int = 0
    name_column: str = "sourceName"
    code_column: str | None = "sourceCode"
    label_column: str = "conceptId"
    status_column: str = "mappingStatus"
    approved: str = "APPROVED"
    ascii_only: bool = False
    drop_chars: str = ""
    usan: bool = True
    optional_usan: bool = False
    without_classes: tuple[str, ...] = ()
    post_mode: str = "tiebreak"
    post_weight: float = 0.05
    w_strength: float = 0.6
    w_text: float = 0.4
    w_brand: float = 0.3
    minmax: bool = True
    tiebreak_eps: float = 0.01
    tiebreak_topn: int = 50
    brand_strict: bool = False
    scope_most: int = 1000
    model_limit: int = 50
    model_context: str | None = None
    model_reads: str = "query_norm"
    model_prompt: Callable[..., str] = prompts.prompt
    #: Without a reranker, take the cosine as relevance; else there is none, and features alone are added.
    cosine_relevance: bool = False


@dataclass
class Result:
    queries: DataFrame
    candidates: DataFrame
    answers: DataFrame | None = None
    errors: DataFrame | None = None
    notes: list[str] = field(default_factory=list)


def queries_of(sheet: DataFrame, o: Options) -> DataFrame:
    """sheet with query_id, query_text, query_norm, source_name, source_code, gold_concept_id."""
    df = numbered(sheet, "query_id", o.first_rows)
    has = lambda c: F.col(c) if c and c in df.columns else F.lit(None).cast("string")
    code = F.nullif(F.trim(has(o.code_column).cast("string")), F.lit(""))
    text = query_text(has(o.name_column), has(o.code_column) if o.code_column in df.columns else None)
    label = F.nullif(F.trim(has(o.label_column).cast("string")), F.lit(""))
    approved = F.upper(F.trim(has(o.status_column).cast("string"))) == o.approved.upper()
    gold = F.coalesce(label, F.when(approved, has("conceptId").cast("string")))
    return df.withColumns({"query_text": text, "query_norm": prepared_query(text, o.ascii_only, o.drop_chars, o.usan, o.optional_usan), "source_name": has(o.name_column).cast("string"), "source_code": code, "gold_concept_id": gold})


def candidate_column(columns: list[str]) -> str:
    """The column by which a reranker reads candidates."""
    found = next((c for c in ("profile_text", "profile_text_norm") if c in columns), None)
    if found is None:
        raise ValueError("a reranker needs profile_text or profile_text_norm")
    return found


def relevance(pairs: DataFrame, encode_tokens: Callable[[list[str]], list[np.ndarray]]) -> DataFrame:
    """pairs (query_norm, profile_text or profile_text_norm) with _relevance_score float: late interaction of their tokens."""
    text = candidate_column(pairs.columns)

    @F.pandas_udf("float")
    def run(q: pd.Series, d: pd.Series) -> pd.Series:
        known = dict(zip(texts := list(dict.fromkeys(x or "" for x in (*q, *d))), encode_tokens(texts), strict=True))
        return pd.Series([search.max_similarity(known[a or ""], known[b or ""]) for a, b in zip(q, d, strict=True)], dtype="float32")

    return pairs.withColumn("_relevance_score", run("query_norm", text))


def retrieve(queries: DataFrame, index: DataFrame, vector_col: str, o: Options, rerank: Callable | None, notes: list[str]) -> DataFrame:
    """(query_id, candidate columns, retrieval_rank): nearest vectors, reranked if there is a reranker."""
    where: Column | None = None
    if o.where:
        try:
            index.filter(o.where).schema  # noqa: B018  a predicate that cannot be analysed is left out
            where = F.expr(o.where)
        except AnalysisException as e:
            notes.append(f"--where is left out: {e}")
    asked = queries.filter(F.col("query_norm") != "") if rerank else queries
    near = search.nearest(asked, index, max(o.candidate_topk, o.retrieval_topk) if rerank else o.candidate_topk, vector_col=vector_col, where=where)
    about = [c for c in KEPT if c in index.columns]
    # an index that is small as a file need not be small as rows: it is never broadcast
    df = near.join(index.select(*about).hint("merge"), "concept_id")
    if rerank is None:
        return (df.withColumn("_relevance_score", (1.0 - F.col("distance")).cast("float")) if o.cosine_relevance else df).drop("distance")
    df = relevance(df.join(queries.select("query_id", "query_norm"), "query_id"), rerank)
    df = ranking.by_relevance(df, "query_id", "retrieval_rank")
    return df.filter(F.col("rank") <= o.candidate_topk).withColumn("retrieval_rank", F.col("rank")).drop("rank", "distance", "query_norm")


@dataclass
class WordVectors:
    """Tokens of a text for late interaction, without a model: the hashed n-grams of each word."""

    dim: int = 128

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        words = [t.split() or [""] for t in texts]
        flat = HashedNgrams(self.dim)([w for own in words for w in own])
        return np.split(flat, np.cumsum([len(w) for w in words])[:-1])


def map_terms(spark: SparkSession, sheet: DataFrame, index: DataFrame, vector_col: str, o: Options, encode: Callable, rerank: Callable | None = None, concepts: DataFrame | None = None, ancestors: DataFrame | None = None, generate: Callable[[str], str] | None = None) -> Result:
    notes: list[str] = []
    queries = encoded(queries_of(sheet, o), "query_norm", encode)
    # rows that ask the same text have the same candidates in the same order: found once, for the first of them
    asked = queries.groupBy("query_norm").agg(F.min("query_id").alias("query_id"))
    own = queries.select("query_id", "query_norm").join(asked.select(F.col("query_id").alias("_asked"), F.col("query_norm").alias("_norm")), F.col("query_norm").eqNullSafe(F.col("_norm"))).select("query_id", "_asked")
    asked = encoded(asked, "query_norm", encode)
    df = retrieve(asked, index, vector_col, o, rerank, notes)
    df = scope.drop_classes(df, o.without_classes, concepts)
    if ranking.applies(o.post_mode, o.post_weight):
        df = ranking.enriched(df, asked, mode=o.post_mode, weight=o.post_weight, w_strength=o.w_strength, w_text=o.w_text, w_brand=o.w_brand, minmax_within_query=o.minmax, eps=o.tiebreak_eps, topn=o.tiebreak_topn, brand_strict=o.brand_strict)
    else:
        df = ranking.plain(df)
    df = own.join(df.withColumnRenamed("query_id", "_asked"), "_asked").select(*df.columns)
    if "final_score" not in df.columns:  # features without a relevance to blend with
        df = df.withColumn("final_score", F.lit(None).cast("double"))
    if ancestors is not None and concepts is not None and {"atc_ids", "atc_codes"} & set(sheet.columns):
        scopes = scope.scope_ids(queries, concepts)
        df = scope.scoped_first(df, scope.allowlist(scopes, ancestors, concepts, most=o.scope_most))
    answers = None
    empty = queries.filter(F.col("query_norm") == "").select(F.col("query_id").alias("index"), F.lit("search").alias("type"), "source_name", "source_code", F.lit("a text query is required").alias("message"))
    errors = empty if rerank else empty.limit(0)
    if generate is not None:
        answers = model_rank.ask(df, queries, generate, min(o.model_limit, o.candidate_topk), text=o.model_reads, context=o.model_context, build=o.model_prompt)
        df = model_rank.merge(df, answers, min(o.model_limit, o.candidate_topk))
        failed = answers.filter("error IS NOT NULL").join(queries.select("query_id", "source_name", "source_code"), "query_id")
        errors = errors.unionByName(failed.select(F.col("query_id").alias("index"), F.lit("rag").alias("type"), "source_name", "source_code", F.col("error").alias("message")))
    return Result(queries, df.filter(F.col("rank") <= o.candidate_topk), answers, errors, notes)


def run_bulk(spark: SparkSession, index_folder: str, table: str, input_path: str, out: str, o: Options | None = None, encode: Callable | None = None, rerank: Callable | None = None, concepts: DataFrame | None = None, ancestors: DataFrame | None = None, generate: Callable[[str], str] | None = None, topk: int = 20) -> dict[str, str]:
    """A sheet of terms against an index, exported in all layouts."""
    o = o or Options()
    sheet = read_sheet(spark, input_path)
    index, vector_col = read_index(spark, index_folder, table)
    settings = encoder_settings(read_manifest(spark, index_folder, table))
    if usagi.is_review_sheet(sheet.columns) and (bad := usagi.invalid_rows(numbered(sheet, "_row", 50)).select("reason", "_row").first()):
        raise ValueError(f"the review sheet has an invalid row {bad['_row']}: {bad['reason']}")
    got = map_terms(spark, sheet, index, vector_col, o, encode or encoder(**settings), rerank, concepts, ancestors, generate)
    got.candidates.persist()
    try:
        measured = metrics.evaluate(got.queries, got.candidates, topk)
        review = usagi.review_rows(got.queries.select("query_id", *sheet.columns), name_col=o.name_column, code_col=o.code_column)
        return exports.write_all(out, got.queries, got.candidates, review, measured, got.answers, got.errors, topk, input_columns=sheet.columns)
    finally:
        got.candidates.unpersist()


def look_up(spark: SparkSession, term: str, index: DataFrame, vector_col: str, encode: Callable, o: Options | None = None, rerank: Callable | None = None, show: int = 10) -> list[dict]:
    """The best candidates of one term."""
    o = o or Options(candidate_topk=100, retrieval_topk=200)
    sheet = spark.createDataFrame([(term,)], "sourceName string")
    got = map_terms(spark, sheet, index, vector_col, o, encode, rerank)
    return [r.asDict() for r in got.candidates.filter(F.col("rank") <= show).orderBy("rank").collect()]

