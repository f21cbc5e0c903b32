"""Exact duplicates by progressive refinement: length, then prefix hash, then full hash.

Texts are equal when they are identical after all ASCII white space is deleted; null counts as empty. A row whose
length, or whose length and prefix hash, no other row shares has no duplicate and its content is never hashed in full.
The keys that are left go into a bitmap of a bounded size, so that the second pass over the texts decides on the map side
which rows to hash: texts are not shuffled to be hashed, and a false positive of the bitmap costs a hash, never a result.
Equality ends at SHA-256 of the whole normalised text.

Of equal texts the row with the most code points in its original text stays, then the smallest id (null last). Repeated
rows (same id and text) are members of the group like others, and one of them stays. An empty table gives an empty one;
extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .common import filter_bits, join_groups, key_bitmap, shielded, table, with_hit, written

PREFIX_CHARS = 256


def normalised(text: str):
    return F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"[\x20\x09-\x0D]+", "")


def _keyed(docs: DataFrame, text: str, prefix_chars: int) -> DataFrame:
    df = docs.withColumn("__norm", normalised(text))
    df = df.withColumn("__len", F.length("__norm"))
    df = df.withColumn("__prefix", F.xxhash64(F.substring("__norm", 1, prefix_chars)))
    return df


def _candidates(docs: DataFrame, text: str, prefix_chars: int, bits: int | None) -> DataFrame:
    """docs with __norm, __full (SHA-256, null where refinement already shows the row to be alone)."""
    # round 1 and 2 work on one row for each (length, prefix hash): a skinny table, made by a map-side aggregate
    keys = written(_keyed(docs.select(text), text, prefix_chars).groupBy("__len", "__prefix").agg(F.count("*").alias("n")), "dedup-keys")
    lengths = keys.groupBy("__len").agg(F.sum("n").alias("n_len")).filter("n_len > 1").select("__len")
    left = written(keys.filter("n > 1").join(lengths, "__len", "left_semi"), "dedup-open-keys")
    key = F.xxhash64("__len", "__prefix")
    bits = bits or filter_bits(left.count())
    # round 3: the full hash, only where the bitmap has the row's key
    df = with_hit(_keyed(docs, text, prefix_chars), key, key_bitmap(left, key, bits), bits)
    return df.withColumn("__full", F.when(F.col("__hit"), F.sha2("__norm", 256))).drop("__hit", "__len", "__prefix")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix_chars: int = PREFIX_CHARS, bits: int | None = None) -> DataFrame:
    """One row per row of docs: id_col, carry, keep_id, group_size, kept.

    carry: columns of docs to return as well. The join that brings a group's decision back to its rows is on the hash;
    hot groups, whose number is bounded, are broadcast instead.
    """
    rows = _candidates(docs, text_col, prefix_chars, bits)
    rows = rows.select(
        F.col(id_col).alias("__id"), *carry, "__full",
        F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("__chars"),
        F.monotonically_increasing_id().alias("__row"),
    )
    rows = written(rows, "dedup-rows")  # __row must not change between the two uses
    order = F.struct((-F.col("__chars")).alias("c"), F.col("__id").isNull().alias("n"), F.col("__id").alias("i"), F.col("__row").alias("r"))
    groups = rows.filter("__full is not null").groupBy("__full").agg(F.min(order).alias("__best"), F.count("*").alias("__size"))
    groups = groups.filter("__size > 1")
    # rows known to be alone have no key; they stay out of the join, where they would all meet in one task
    out = join_groups(rows.filter("__full is not null"), groups, "__full", "__size", rows.count())
    none = {"__best": F.lit(None).cast(groups.schema["__best"].dataType), "__size": F.lit(None).cast("long")}
    out = out.unionByName(rows.filter("__full is null").withColumns(none))
    return out.select(
        F.col("__id").alias(id_col), *carry,
        F.when(F.col("__best").isNull(), F.col("__id")).otherwise(F.col("__best.i")).alias("keep_id"),
        F.coalesce("__size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("__best.r") == F.col("__row"), F.lit(True)).alias("kept"),
    )


def _descending(c, kind):
    """Numbers by size, other ids as they are."""
    return -c if isinstance(kind, NumericType) else c


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = PREFIX_CHARS, bits: int | None = None) -> DataFrame:
    """docs, with the row that stays of each group, all columns as they were.

    Rows that refinement shows to be alone pass without a shuffle; of the others, a map-side aggregate sends on the best
    row of each group and task, so that a group of any size shuffles one row a task.
    """
    docs, (id_col, text_col), back = shielded(docs, id_col, text_col)
    rows = _candidates(docs, text_col, prefix_chars, bits)
    whole = F.struct(*[F.col(c) for c in docs.columns])
    order = F.struct(F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("c"), F.col(id_col).isNotNull().alias("n"), _descending(F.col(id_col), docs.schema[id_col].dataType).alias("i"))
    alone = rows.filter("__full is null").select(*docs.columns)
    rest = rows.filter("__full is not null").groupBy("__full").agg(F.max_by(whole, order).alias("__best")).select("__best.*")
    return back(alone.unionByName(rest))


# ---- query -------------------------------------------------------------------------------------------------------


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_sha256", F.sha2(normalised("text"), 256))
    return exact_groups(docs, carry=("text_sha256",))


ORACLE = r"""
WITH n AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), g AS (
  SELECT doc_id, norm,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id,
    count(*) OVER (PARTITION BY norm) AS group_size
  FROM n
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
