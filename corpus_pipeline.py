"""From raw documents to packed training sequences: five stages, each one operator of termweave.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the docs of
the next. All but the last return the columns of documents. The stages see whatever the stage before kept, whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from termweave.llm import exact_dedup, language_id, mixing, packing, simhash
from termweave.llm.common import spread, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or whose language stays open, go."""
    return language_id.drop_unidentified(spread(docs))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space, one stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose shingles of five words are 0.8 alike, the smallest id of each group stays."""
    return simhash.drop_near_duplicates(docs, words=simhash.SIMILAR_WORDS, radius=simhash.SIMILAR_RADIUS, similarity=simhash.SIMILARITY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target asks for."""
    return mixing.mix(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids in sequences of at most 4,096."""
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("simhash_dedup", drop_near_copies),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Language models, XXH64 fingerprints and tokenisers are beyond SQL; tests/llm/test_pipeline.py checks by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
