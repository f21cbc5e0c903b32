"""Exact nearest neighbours by cosine, blocks of queries against blocks of vectors.

Both sides are packed into blocks of rows; a pair of blocks is one matrix product whose result is at most k rows a query, so
neither side is broadcast whole and no pair of rows is ever a row of a table. Blocks of queries meet blocks of vectors by an
equi-join on the dimension and a salt. Ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLOCK_ROWS, QUERY_ROWS = 8192, 1024


def vector_column(df: DataFrame) -> str:
    """The first column of floating-point arrays."""
    for f in df.schema.fields:
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.FloatType):
            return f.name
    raise ValueError("no vector column")


def _packed(df: DataFrame, id_col: str, vector_col: str, rows: int, block: str) -> DataFrame:
    kept = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    # a task's rows in runs: no shuffle, no count
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        n = TaskContext.get().partitionId() << 32
        ids, vs = [], []
        held = 0
        for b in batches:
            ids.append(b.column("id").to_numpy())
            vs.append(np.stack(b.column("v").to_numpy(zero_copy_only=False)).astype(np.float32) if b.num_rows else np.zeros((0, 0), np.float32))
            held += b.num_rows
            if held >= rows:
                yield from out(np.concatenate(ids), np.concatenate(vs), n)
                n += held // rows + 1
                ids, vs, held = [], [], 0
        if held:
            yield from out(np.concatenate(ids), np.concatenate([v for v in vs if len(v)]), n)

    def out(ids: np.ndarray, v: np.ndarray, n: int) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(ids), rows):
            # by id, so that ties are settled once for all that meet the block
            by = i + np.argsort(ids[i : i + rows], kind="stable")
            yield pa.RecordBatch.from_arrays([pa.array([n + i // rows]), pa.array([v.shape[1]]), pa.array([ids[by].tobytes()]), pa.array([v[by].tobytes()])], names=[block, "dim", "ids", "v"])

    return kept.mapInArrow(pack, f"{block} long, dim long, ids binary, v binary")


def _units(raw: bytes, dim: int) -> np.ndarray:
    x = np.frombuffer(raw, np.float32).reshape(-1, dim).astype(np.float64)
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _top(near: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest of each row, to 12 digits, ties to the smaller column; what is no number is least.

    The kth greatest of the maxima of runs of columns is no greater than the kth greatest of all: whatever lies below it
    is never sorted.
    """
    n = near.shape[1]
    if np.isnan(near).any():
        near = np.where(np.isnan(near), -2.0, near)
    if n > 8 * k:
        most = np.maximum.reduceat(near, np.arange(0, n, n // (4 * k)), axis=1)
        floor = np.partition(most, most.shape[1] - k, axis=1)[:, most.shape[1] - k]
        # what rounds to the same as the floor is no less
        row, col = np.nonzero(near >= (floor - 1e-11)[:, None])
    else:
        row, col = (x.ravel() for x in np.indices(near.shape))
    by = np.lexsort((col, -np.round(near[row, col], 12), row))
    row, col = row[by], col[by]
    first = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[first], col[first]


def nearest(queries: DataFrame, vectors: DataFrame, k: int, query_id: str = "query_id", query_vector: str = "vector", id_col: str = "concept_id", vector_col: str | None = None, where: str | Column | None = None) -> DataFrame:
    """(query_id, id_col, distance, retrieval_rank): the k nearest vectors of each query, after `where`."""
    vectors = vectors if where is None else vectors.filter(where)
    vector_col = vector_col or vector_column(vectors)
    q = _packed(queries, query_id, query_vector, QUERY_ROWS, "q_block").withColumnsRenamed({"ids": "q_ids", "v": "q"})
    x = _packed(vectors, id_col, vector_col, BLOCK_ROWS, "x_block")
    # every vector block meets every query block of its dimension; the salt deals the pairs over all cores
    salt = F.lit(max(64, 2 * vectors.sparkSession.sparkContext.defaultParallelism))
    x = x.withColumn("salt", F.pmod(F.xxhash64("x_block"), salt))
    q = q.withColumnRenamed("dim", "q_dim").withColumn("q_salt", F.explode(F.sequence(F.lit(0), salt - 1)))
    pairs = x.join(q, (F.col("dim") == F.col("q_dim")) & (F.col("salt") == F.col("q_salt")))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, ids, x = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                r = {c: b.column(c)[i].as_py() for c in ("x_block", "dim", "q_ids", "q")}
                if held != r["x_block"]:
                    held, ids, x = r["x_block"], np.frombuffer(b.column("ids")[i].as_py(), np.int64), _units(b.column("v")[i].as_py(), r["dim"])
                # rounding so that equal vectors tie whatever the block's shape
                near = _units(r["q"], r["dim"]) @ x.T
                row, col = _top(near, k)
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(r["q_ids"], np.int64)[row]), pa.array(ids[col]), pa.array(1.0 - np.round(near[row, col], 12))], names=["query_id", "id", "distance"])

    found = pairs.select("x_block", "dim", "ids", "v", "q_ids", "q").mapInArrow(probe, "query_id long, id long, distance double")
    w = Window.partitionBy("query_id").orderBy("distance", "id")
    ranked = found.withColumn("retrieval_rank", F.row_number().over(w)).filter(F.col("retrieval_rank") <= k)
    return ranked.select(F.col("query_id").alias(query_id), F.col("id").alias(id_col), "distance", "retrieval_rank")


def mean_pooled(tokens: Column, mask: Column) -> Column:
    """The mean of the token vectors whose mask is set (of none: zeros)."""
    n = F.greatest(F.size(F.filter(mask, lambda m: m)), F.lit(1))
    kept = F.transform(F.filter(F.arrays_zip(tokens.alias("t"), mask.alias("m")), lambda x: x["m"]), lambda x: x["t"])
    zero = F.transform(F.element_at(tokens, 1), lambda _: F.lit(0.0).cast("double"))
    total = F.aggregate(kept, zero, lambda acc, t: F.zip_with(acc, t, lambda a, b: a + b.cast("double")))
    return F.transform(total, lambda v: v / n)


def first_token(tokens: Column) -> Column:
    return F.element_at(tokens, 1)


def unit(vector: Column) -> Column:
    norm = F.greatest(F.sqrt(F.aggregate(vector, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x)), F.lit(1e-12))
    return F.transform(vector, lambda x: x / norm)


def max_similarity(q: np.ndarray, d: np.ndarray, q_mask: np.ndarray | None = None, d_mask: np.ndarray | None = None) -> float:
    """Bidirectional max-sim of two token matrices: each side's mean of its tokens' best cosine, averaged; -1 if a side is masked whole."""
    q = q[q_mask] if q_mask is not None else q
    d = d[d_mask] if d_mask is not None else d
    if not len(q) or not len(d):
        # a masked document has no token to average; what is left counts as the floor
        return 0.5 * (-1.0 * bool(len(q)) + -1.0 * bool(len(d)))
    unit_ = lambda x: x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)
    sim = unit_(q.astype(np.float64)) @ unit_(d.astype(np.float64)).T
    return float(0.5 * (sim.max(axis=1).mean() + sim.max(axis=0).mean()))


def max_similarity_column(q: Column, d: Column) -> Column:
    """As max_similarity, of columns array<array<float>>; pairs go through numpy in batches."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([max_similarity(np.stack(x), np.stack(y)) if len(x) and len(y) else None for x, y in zip(a, b, strict=True)], dtype=float)

    return run(q, d)
