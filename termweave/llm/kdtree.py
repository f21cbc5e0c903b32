"""Exact top-k inner products with a KD-tree per shard.

Vectors become integers, floor(scale * x). Median splits learnt on a bounded sample deal them into at most `MAX_SHARDS` shards
of neighbouring vectors; a shard is held in blocks of at most some `BLOCK_ROWS` rows, each with a KD-tree of its own: median splits
along the widest dimension down to leaves, every node with its tight bounding box. The sample decides only where a vector
lies, never whether it is found.

A search goes over a tree best first: nodes are taken in order of the largest inner product that any point of their box
could have with the query, and the search ends where that bound is below the query's kth score so far. Queries are packed into blocks
by the shard that they lie in and search that shard first; the kth score that they find there is propagated to the
other shards. A query goes on to a shard only if the shard's bounding box, of which there are at most `MAX_SHARDS`, can
still hold something as good.

Every row is a candidate; scores and ties (to the smaller id) are exact. Queries meet candidates block by block: a block
travels once for every `ASKS` blocks of queries that ask it, which then stream past its tree. The result of a pair of
blocks is k rows a query at most, and no task holds more than two blocks at once.

Vectors that are null, empty or hold a null or non-finite component take no part, nor do rows without an id. Shorter vectors count as
followed by zeros. Integers and scores end at those of 64 bits. Candidates are the rows with another id than the query's. Repeated rows are candidates each, and as queries give
a result each. An empty table gives an empty one; extra columns are not read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, tidy, written

SCALE = 256
K = 5
BLOCK_ROWS = 16_384
QUERY_ROWS = 512
MAX_SHARDS = 1024
SAMPLE_ROWS = 8192
LEAF_ROWS = 128
#: Query blocks that are searched in one copy of a block.
ASKS = 64


# ---- tree ----------------------------------------------------------------------------------------------------------


class Tree:
    """Rows of x in an order in which each node is a slice; nodes in arrays, the root first."""

    def __init__(self, x: np.ndarray, leaf_rows: int = LEAF_ROWS):
        self.order = np.arange(len(x))
        start, end, left, lo, hi = [], [], [], [], []
        todo = [(0, len(x), -1)]
        while todo:
            a, b, parent = todo.pop()
            own = x[self.order[a:b]]
            n = len(start)
            start.append(a)
            end.append(b)
            left.append(-1)
            lo.append(own.min(axis=0))
            hi.append(own.max(axis=0))
            if parent >= 0 and left[parent] < 0:
                left[parent] = n
            spread = hi[-1] - lo[-1]
            # a box without extent holds equal points only: no split tells them apart
            if b - a > leaf_rows and spread.max() > 0:
                mid = (a + b) // 2
                by = np.argpartition(own[:, int(spread.argmax())], mid - a)
                self.order[a:b] = self.order[a:b][by]
                todo.append((mid, b, n))
                todo.append((a, mid, n))
        self.start, self.end, self.left = np.array(start), np.array(end), np.array(left)
        self.lo, self.hi = np.array(lo), np.array(hi)
        self.right = self._right()
        self.x = x[self.order]

    def _right(self) -> np.ndarray:
        """The right child starts where the left one ends and ends with its parent: nodes are in depth-first order."""
        at = {(a, b): n for n, (a, b) in reversed(list(enumerate(zip(self.start.tolist(), self.end.tolist(), strict=True))))}
        return np.array([at[self.end[c], self.end[n]] if (c := self.left[n]) >= 0 else -1 for n in range(len(self.start))])


def bounds(q: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(queries, boxes): the largest inner product of each query with any point of each box."""
    return np.maximum(q, 0) @ hi.T + np.minimum(q, 0) @ lo.T


def search(tree: Tree, ids: np.ndarray, q: np.ndarray, q_ids: np.ndarray, kth: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, ids, scores): up to k of the best rows with a score of at least kth, best first."""
    above = bounds(q, tree.lo, tree.hi)
    ids = ids[tree.order]
    for i in range(len(q)):
        best = above[i]
        floor, top_s, top_i = kth[i], np.zeros(0, q.dtype), np.zeros(0, np.int64)
        todo = [(-best[0], 0)]
        while todo and -todo[0][0] >= floor:
            _, n = heapq.heappop(todo)
            if (c := tree.left[n]) >= 0:
                for child in (c, tree.right[n]):
                    if best[child] >= floor:
                        heapq.heappush(todo, (-best[child], child))
                continue
            a, b = tree.start[n], tree.end[n]
            s = tree.x[a:b] @ q[i]
            keep = np.flatnonzero((s >= floor) & (ids[a:b] != q_ids[i]))
            if len(keep):
                top_s, top_i = np.concatenate((top_s, s[keep])), np.concatenate((top_i, ids[a:b][keep]))
                by = np.lexsort((top_i, -top_s))[:k]
                top_s, top_i = top_s[by], top_i[by]
                if len(top_s) == k:
                    floor = max(floor, top_s[-1])
        if len(top_s):
            yield i, top_i, top_s


# ---- shards --------------------------------------------------------------------------------------------------------


class Splits:
    """Median splits of a sample, as a heap of (dimension, value); leaf numbers are shards."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        self.dim, self.at = np.zeros(1 << depth, np.int64), np.zeros(1 << depth, sample.dtype if len(sample) else np.int64)
        groups = {1: sample}
        for n in range(1, 1 << depth):
            own = groups.pop(n, sample[:0])
            if len(own):
                d = int(np.argmax(own.max(axis=0) - own.min(axis=0)))
                self.dim[n], self.at[n] = d, np.sort(own[:, d])[len(own) // 2]
                right = own[:, d] >= self.at[n]
                groups[2 * n], groups[2 * n + 1] = own[~right], own[right]

    def shard(self, x: np.ndarray) -> np.ndarray:
        n = np.ones(len(x), np.int64)
        rows = np.arange(len(x))
        for _ in range(self.depth):
            n = 2 * n + (x[rows, self.dim[n]] >= self.at[n])
        return n - (1 << self.depth)


def integers(vectors: DataFrame, id_col: str, vector_col: str, scale: int = SCALE) -> DataFrame:
    """(id, v array<long>) of the rows that take part."""
    df = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != F.lit(math.inf))
    df = df.filter(F.col("id").isNotNull() & F.col("x").isNotNull() & (F.size("x") > 0) & F.forall("x", finite))
    return df.select("id", F.transform("x", lambda e: F.floor(e * scale)).alias("v"))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Exact in float64 as long as all sums stay below 2^53; else in Python's integers, slower."""
    values, offsets = lists.flatten().to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
    size = np.diff(offsets)
    out = np.zeros((len(size), width), np.int64)
    if len(size) and (size == width).all():
        out[:] = values.reshape(-1, width)
    else:
        out[np.arange(width)[None, :] < size[:, None]] = values
    return out


def _long(scores: np.ndarray) -> np.ndarray:
    return scores.astype(np.int64) if scores.dtype != object else np.array([max(-(2**63), min(2**63 - 1, int(s))) for s in scores], np.int64)


def _exact(x: np.ndarray, largest: int) -> np.ndarray:
    return x.astype(np.float64) if largest * largest * max(1, x.shape[1]) < 2**53 else x.astype(object)


def top_k(vectors: DataFrame, id_col: str, vector_col: str, query: Column, k: int = K, scale: int = SCALE, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, max_shards: int = MAX_SHARDS) -> DataFrame:
    """(query_id, rank int, id, score long): for the rows where query (over the column `id`) holds, the k best others."""
    bounded_batches(vectors.sparkSession)
    rows = written(integers(vectors, id_col, vector_col, scale), "vectors")
    n, width, high, low = rows.agg(F.count("*"), F.coalesce(F.max(F.size("v")), F.lit(1)), F.coalesce(F.max(F.array_max("v")), F.lit(0)), F.coalesce(F.min(F.array_min("v")), F.lit(0))).first()
    largest = max(high, -low)
    depth = max(0, min(int(math.log2(max_shards)), math.ceil(math.log2(max(1, n / block_rows)))))
    share = min(1.0, SAMPLE_ROWS / max(1, n))
    sample = rows.filter(F.pmod(F.xxhash64("id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)) + 1).limit(2 * SAMPLE_ROWS).toArrow() if depth else None
    splits = Splits(_matrix(sample.column("v").combine_chunks(), width) if sample is not None else np.zeros((0, width), np.int64), depth)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(splits.shard(_matrix(b.column("v"), width)))], names=["id", "v", "shard"])

    dealt = written(rows.mapInArrow(deal, "id long, v array<long>, shard long"), "dealt-vectors")
    sizes = {r["shard"]: (r["n"], r["q"]) for r in dealt.groupBy("shard").agg(F.count("*").alias("n"), F.count_if(query).alias("q")).collect()}  # max_shards rows
    cut = lambda i, each: F.create_map(*[x for s, c in sizes.items() for x in (F.lit(s), F.lit(max(1, -(-c[i] // each))))]) if sizes else F.create_map(F.lit(0).cast("long"), F.lit(1))
    part = lambda i, each: F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.element_at(cut(i, each), F.col("shard"))).cast("int")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _matrix(pa.array(pdf["v"], pa.list_(pa.int64())), width)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "part": [int(pdf["part"].iloc[0])], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "x": [x.tobytes()], "lo": [x.min(axis=0).tobytes()], "hi": [x.max(axis=0).tobytes()]})

    pack = lambda df, name: written(df.groupBy("shard", "part").applyInPandas(packed, "shard long, part int, ids binary, x binary, lo binary, hi binary"), name)
    blocks = pack(dealt.withColumn("part", part(0, block_rows)), "vector-blocks")
    queries = pack(dealt.filter(query).withColumn("part", part(1, query_rows)), "query-blocks").withColumn("block", F.monotonically_increasing_id()).select("block", "shard", F.col("ids").alias("q_ids"), F.col("x").alias("q"))
    queries = written(queries, "query-blocks")
    array = lambda b: np.frombuffer(b, np.int64).reshape(-1, width)
    least = float("-inf")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tree, ids = None, None, None
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in asked}
                if row["block"] is None:
                    held, tree, ids = (row["shard"], row["part"]), Tree(_exact(array(row["q"]), largest)), np.frombuffer(row["q_ids"], np.int64)
                    continue
                if held != (row["shard"], row["part"]):
                    raise ValueError("queries without their block")
                nth = np.frombuffer(row["rows"], np.int64)
                q, q_ids = _exact(array(row["q"]), largest), np.frombuffer(row["q_ids"], np.int64)
                found = list(search(tree, ids, q, q_ids, np.frombuffer(row["kth"], np.float64), k))
                if found:
                    times = [len(s) for _, _, s in found]
                    at = np.repeat([f[0] for f in found], times)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row["block"])), pa.array(nth[at]), pa.array(q_ids[at]), pa.array(np.concatenate([f[1] for f in found])), pa.array(_long(np.concatenate([f[2] for f in found])))], names=["block", "nth", "query_id", "id", "score"])

    found_schema = "block long, nth long, query_id long, id long, score long"
    asked = ("block", "rows", "q_ids", "q", "kth", "shard", "part")

    def searched(asks: DataFrame) -> DataFrame:
        """asks (block, shard, rows, q_ids, q, kth), written, against all blocks of their shards."""
        ways = F.broadcast(asks.groupBy("shard").agg(F.ceil(F.count("*") / ASKS).cast("int").alias("ways")))  # max_shards rows
        way = F.pmod(F.xxhash64("block"), F.col("ways")).cast("int").alias("way")
        dealt_asks = asks.join(ways, "shard").join(blocks.select("shard", "part"), "shard").select("block", "rows", "q_ids", "q", "kth", "shard", "part", way)
        none = [F.lit(None).cast(t).alias(c) for c, t in (("block", "long"), ("rows", "binary"), ("kth", "binary"))]
        copies = blocks.join(ways, "shard").select(*none, F.col("ids").alias("q_ids"), F.col("x").alias("q"), "shard", "part", F.explode(F.sequence(F.lit(0), F.col("ways") - 1)).alias("way"))
        rows = dealt_asks.unionByName(copies).repartition("shard", "part", "way")
        # a block stands before the queries that ask it, and goes when the next one comes
        rows = rows.sortWithinPartitions("shard", "part", "way", F.col("block").asc_nulls_first()).select(*asked)
        return rows.mapInArrow(tidy(probe), found_schema)

    best = Window.partitionBy("block", "nth").orderBy(F.desc("score"), "id")
    top = lambda df: df.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n_own = len(b.column("q_ids")[i].as_py()) // 8
                yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), b.column("shard").slice(i, 1), pa.array([np.arange(n_own).tobytes()], pa.binary()), b.column("q_ids").slice(i, 1), b.column("q").slice(i, 1), pa.array([np.full(n_own, least).tobytes()], pa.binary())], names=["block", "shard", "rows", "q_ids", "q", "kth"])

    ask_schema = "block long, shard long, rows binary, q_ids binary, q binary, kth binary"
    own = written(top(searched(written(queries.mapInArrow(first, ask_schema), "first-queries"))), "own-shard")
    if depth == 0:
        return _result(own, k)

    # the bounding box of each shard: max_shards of them
    def around(pdf: pd.DataFrame) -> pd.DataFrame:
        ends = {c: np.stack([np.frombuffer(v, np.int64) for v in pdf[c]]) for c in ("lo", "hi")}
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "lo": [ends["lo"].min(axis=0).tobytes()], "hi": [ends["hi"].max(axis=0).tobytes()]})

    boxes = blocks.select("shard", "lo", "hi").groupBy("shard").applyInPandas(around, "shard long, lo binary, hi binary").collect()
    names = [r["shard"] for r in boxes]
    box_lo, box_hi = (_exact(np.array([np.frombuffer(r[c], np.int64) for r in boxes]), largest) for c in ("lo", "hi"))

    def further(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                q, q_ids, home = array(b.column("q")[i].as_py()), np.frombuffer(b.column("q_ids")[i].as_py(), np.int64), b.column("shard")[i].as_py()
                kth = np.full(len(q), least)
                for t in b.column("kths")[i].as_py() or []:
                    kth[t["nth"]] = t["kth"]
                may = bounds(_exact(q, largest), box_lo, box_hi) >= kth[:, None]
                for s, name in enumerate(names):
                    rows_ = np.flatnonzero(may[:, s])
                    if name != home and len(rows_):
                        yield pa.RecordBatch.from_arrays([b.column("block").slice(i, 1), pa.array([name]), pa.array([rows_.tobytes()], pa.binary()), pa.array([q_ids[rows_].tobytes()], pa.binary()), pa.array([q[rows_].tobytes()], pa.binary()), pa.array([kth[rows_].tobytes()], pa.binary())], names=["block", "shard", "rows", "q_ids", "q", "kth"])

    # at most query_rows entries for each block
    kths = own.filter(F.col("rank") == k).groupBy("block").agg(F.collect_list(F.struct("nth", F.col("score").cast("double").alias("kth"))).alias("kths"))
    asks = queries.join(kths, "block", "left").mapInArrow(further, ask_schema)
    rest = searched(written(asks, "further-queries"))
    return _result(top(own.drop("rank").unionByName(rest)), k)


def _result(top: DataFrame, k: int) -> DataFrame:
    return top.select("query_id", F.col("rank").cast("int").alias("rank"), "id", "score")


# ---- query -------------------------------------------------------------------------------------------------------


def op3_exact_topk(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return top_k(vectors, "vec_id", "embedding", F.col("id") % 50 == 0).withColumnRenamed("id", "vec_id")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id
), r AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
