"""SimHash near-duplicates, found by the generalised pigeonhole principle.

Fingerprint: lower-case A-Z, words between ASCII white space, shingles of `words` words with repeats (fewer words: the
whole sequence; none: fingerprint zero), XXH64 with seed 42 of each; a bit is 1 if it is set in over half the hashes.

Search, over distinct fingerprints only:

1. Over all fingerprints, count how often two bits agree and put bits that correlate into the same byte (8 bytes of 8
   bits), then histogram each byte. Both statistics have a fixed size.
2. A plan divides the bytes into m partitions. If thresholds t_1..t_m, each at least -1, sum to radius - m + 1, every
   fingerprint within the radius is within t_i of the query on some partition i. Each fingerprint gets thresholds of its
   own: a dynamic programme takes those with the least estimated cost (keys probed plus candidates expected, from the
   convolved byte histograms). m is the one with the least total over all fingerprints.
3. A fingerprint is indexed under its exact value in each partition, and probes every value within t_i. Rows are dealt by
   (partition, value); buckets over `bucket_rows` are cut into blocks that are compared pair by pair, so that no task
   holds a bucket whole. In a block, links are verified on all 64 bits; of dense blocks a spanning set of links is sent
   on, which loses no component.
4. Components of the links, then back to documents through the fingerprint.

Similar texts (`similarity`): the same search over SimHashes of the distinct words proposes pairs, which are verified by
the Jaccard similarity of their sets of shingles. What fingerprints do not bring together is completed exactly: of two
sets that are similar, each has one of the other's first shingles in a common order (prefix filter), so pairs that share
one and are not of one component yet are verified as well. A sketch of each set bounds from below in how many shingles
two sets differ; pairs that differ in too many by it are not similar, and never become rows.

Null and blank texts have fingerprint zero, which links like any other. Texts of any length are read whole, hashes in
blocks. Repeated rows give repeated results. An empty table gives an empty one. A null id takes part in links; a
component's id is its smallest id that is not null. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import combinations
from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, filter_bits, join_groups, key_bitmap, map_batches, released, shielded, table, tidy, with_hit, written
from .components import components

SEED = 42
RADIUS = 4
SHINGLE_WORDS = 4
#: Texts as similar as this (Jaccard of shingles of so many words) are near copies for the pipeline.
SIMILARITY, SIMILAR_WORDS = 0.8, 5
#: Within so many bits of their word fingerprints texts are proposed as similar.
SIMILAR_RADIUS = 5
#: Pairs that one text is verified in at once, in one task.
SIDE_PAIRS = 256
#: log2 of the counters by which shingles are put in order: 4 MB, whatever the input's size.
COUNT_BITS, COUNT_CHUNK = 20, 1 << 14
#: Rounds that compare the rows of a shingle with one of them, before all that are still apart are compared, and rows of
#: one side of a block in that.
STAR_ROUNDS, PAIR_ROWS = 6, 2048
#: Longs of a set's parity sketch.
PARITY_LONGS = 16
#: Pairs that are still apart, for each row of a shingle that is open, up to which they are compared at once.
FEW_PAIRS = 16
#: Shingles whose hashes are held at once.
HASH_BLOCK = 1 << 16
#: Rows of one side of a block; a bucket with more is cut.
BUCKET_ROWS = 4096
#: Bytes a partition, for each m that is considered.
LAYOUTS = {1: [8], 2: [4, 4], 3: [3, 3, 2], 4: [2, 2, 2, 2], 5: [2, 2, 2, 1, 1]}
#: A candidate's cost, where a probed key costs 1.
CANDIDATE_COST = 0.2


# ---- fingerprints --------------------------------------------------------------------------------------------------


def shingle_hashes(text: bytes | None, words: int) -> Iterator[np.ndarray]:
    """The hashes of the shingles in order, repeats included, in blocks."""
    parts = (text or b"").lower().split()
    if not parts:
        return
    h = xxhash.xxh64_intdigest
    n = max(1, len(parts) - words + 1)
    joined = b" ".join(parts)
    if n == 1:
        yield np.array([h(joined, SEED)], np.uint64)
        return
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1)
    first = np.concatenate(([0], ends[: n - 1])).tolist()
    last = (ends[words - 1 :] - 1).tolist()
    for at in range(0, n, HASH_BLOCK):
        yield np.array([h(joined[a:b], SEED) for a, b in zip(first[at : at + HASH_BLOCK], last[at : at + HASH_BLOCK])], np.uint64)


def simhash(hashes: Iterator[np.ndarray]) -> int:
    """A bit is 1 if it is set in over half the hashes; zero if there are none."""
    ones, n = np.zeros(64, np.int64), 0
    for got in hashes:
        ones += np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(got)
    return int(np.packbits(ones * 2 > n, bitorder="little").view(np.uint64)[0]) if n else 0


def fingerprint(text: bytes | None, words: int = SHINGLE_WORDS) -> int:
    return simhash(shingle_hashes(text, words))


def word_fingerprint(text: bytes | None) -> int:
    """SimHash of the distinct words.

    An edit of one word changes five shingles of five words, but one of these features, so that texts whose shingles are
    0.8 alike mostly lie within 5 bits, where their shingle fingerprints would be some 10 apart.
    """
    some = list(set((text or b"").lower().split()))
    return simhash(np.array([xxhash.xxh64_intdigest(w, SEED) for w in some[at : at + HASH_BLOCK]], np.uint64) for at in range(0, len(some), HASH_BLOCK))


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *shingle_hashes(text, words)]))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id_col, carry, fp long), one row per row."""
    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, *carry))
    bounded_batches(docs.sparkSession)
    src = docs.select(id_col, *carry, F.col(text_col).cast("binary").alias("__text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.array([fingerprint(t.as_py(), words) for t in batch.column("__text")], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in (id_col, *carry)), pa.array(fps)], names=[id_col, *carry, "fp"])

    return map_batches(src, run, f"{kept}fp long")


# ---- plan ----------------------------------------------------------------------------------------------------------


def _popcount(x: np.ndarray) -> np.ndarray:
    """Bits set; of signed numbers numpy would count those of the absolute value."""
    return np.bitwise_count(x.view(np.uint64) if x.dtype == np.int64 else x)


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype(np.int64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _permuted(fps: np.ndarray, order: list[int]) -> np.ndarray:
    """Bytes (n, 8) of fps after bit order[k] moved to place k."""
    return np.packbits(_bits(fps)[:, order], axis=1, bitorder="little")


def bit_agreement(fps: DataFrame) -> np.ndarray:
    """64 x 64: in how many fingerprints both bits are set. A fixed size, summed over all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for b in batches:
            x = _bits(b.column("fp").to_numpy(zero_copy_only=False)).astype(np.float32)
            for at in range(0, len(x), HASH_BLOCK):
                total += x[at : at + HASH_BLOCK].T @ x[at : at + HASH_BLOCK]
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j].astype(np.int64))], names=["k", "n"])

    out = np.zeros(4096)
    for k, n in fps.select("fp").mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[k] = n
    return out.reshape(64, 64)


def bit_order(both: np.ndarray, n: int) -> list[int]:
    """The 64 bits, each 8 a byte: from a bit that is left, add the one that correlates most with the byte so far."""
    p = np.diag(both) / max(n, 1)
    cov = both / max(n, 1) - np.outer(p, p)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(cov / np.outer(sd, sd))
    left, order = list(range(64)), []
    while left:
        group = [left.pop(0)]
        while len(group) < 8:
            best = max(left, key=lambda b: (corr[b, group].sum(), -b))
            left.remove(best)
            group.append(best)
        order += group
    return order


def byte_counts(fps: DataFrame, order: list[int]) -> np.ndarray:
    """8 x 256 histogram of the bytes over all fingerprints."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(2048, np.int64)
        for b in batches:
            x = _permuted(b.column("fp").to_numpy(zero_copy_only=False), order)
            total += np.bincount((x + np.arange(8) * 256).ravel(), minlength=2048)
        k = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    out = np.zeros(2048)
    for k, n in fps.select("fp").mapInArrow(tidy(run), "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        out[k] = n
    return out.reshape(8, 256)


class Plan:
    """Partitions of the bytes, and the cheapest thresholds of a fingerprint in them."""

    def __init__(self, order: list[int], counts: np.ndarray, m: int, radius: int):
        self.order, self.m, self.radius, self.sizes = order, m, radius, LAYOUTS[m]
        self.total = max(1.0, counts[0].sum())
        apart = _popcount(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :])
        #: near[j][v][d]: the share of fingerprints whose byte j is d bits from v
        self.near = np.stack([np.stack([((apart == d) * (counts[j] / self.total)).sum(axis=1) for d in range(radius + 1)], axis=1) for j in range(8)])
        self.starts = np.concatenate(([0], np.cumsum(self.sizes)))

    def costs(self, b: np.ndarray) -> np.ndarray:
        """(n, m, radius + 2): the cost of threshold t - 1 in each partition."""
        out = np.zeros((len(b), self.m, self.radius + 2))
        for i, (lo, hi) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            dist = self.near[lo][b[:, lo]]
            for j in range(lo + 1, hi):
                more, new = self.near[j][b[:, j]], np.zeros_like(dist)
                for d in range(self.radius + 1):
                    for e in range(d + 1):
                        new[:, d] += dist[:, d - e] * more[:, e]
                dist = new
            keys = np.cumsum([_choose(8 * (hi - lo), d) for d in range(self.radius + 1)])
            out[:, i, 1:] = keys + CANDIDATE_COST * self.total * np.cumsum(dist, axis=1)
        return out

    def thresholds(self, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(n, m) thresholds with the least cost that sum to radius - m + 1, and that cost.

        State of the dynamic programme: the partitions so far and the sum of (threshold + 1) so far; the sum in all is
        radius + 1.
        """
        cost, want = self.costs(b), self.radius + 1
        best = np.full((len(b), want + 1), np.inf)
        best[:, 0] = 0
        took = []
        for i in range(self.m):
            new, pick = np.full_like(best, np.inf), np.zeros(best.shape, np.int8)
            for s in range(want + 1):
                for t in range(s + 1):
                    if t - 1 > 8 * self.sizes[i]:
                        continue
                    c = best[:, s - t] + cost[:, i, t]
                    better = c < new[:, s]
                    new[better, s], pick[better, s] = c[better], t
            best = new
            took.append(pick)
        out, s, rows = np.zeros((len(b), self.m), np.int8), np.full(len(b), want), np.arange(len(b))
        for i in reversed(range(self.m)):
            t = took[i][rows, s]
            out[:, i] = t - 1
            s = s - t
        return out, best[:, want]

    def values(self, b: np.ndarray) -> np.ndarray:
        """(n, m) values of the partitions as unsigned integers."""
        out = np.zeros((len(b), self.m), np.uint64)
        for i, (lo, hi) in enumerate(zip(self.starts[:-1], self.starts[1:], strict=True)):
            for j in range(lo, hi):
                out[:, i] |= b[:, j].astype(np.uint64) << np.uint64(8 * (j - lo))
        return out


def _choose(n: int, k: int) -> int:
    out = 1
    for i in range(k):
        out = out * (n - i) // (i + 1)
    return out


def _masks(bits: int, t: int) -> np.ndarray:
    """The masks with at most t of so many bits set."""
    return np.array([sum(1 << x for x in c) for d in range(t + 1) for c in combinations(range(bits), d)], np.uint64)


def best_plan(fps: DataFrame, radius: int = RADIUS) -> Plan:
    both = bit_agreement(fps)
    n = int(fps.count())
    order = bit_order(both, n)
    counts = byte_counts(fps, order)
    plans = {m: Plan(order, counts, m, radius) for m in LAYOUTS if 1 < m <= radius + 1}  # m = 1 would probe every mask of all 64 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(plans, 0.0)
        for b in batches:
            x = _permuted(b.column("fp").to_numpy(zero_copy_only=False), order)
            for m, plan in plans.items():
                total[m] += float(plan.thresholds(x)[1].sum())
        yield pa.RecordBatch.from_arrays([pa.array(list(total)), pa.array(list(total.values()))], names=["m", "cost"])

    sums = {m: c for m, c in fps.select("fp").mapInArrow(tidy(run), "m long, cost double").groupBy("m").agg(F.sum("cost")).collect()}
    return min(plans.values(), key=lambda p: (sums.get(p.m, 0.0), p.m))


# ---- probe and verify ----------------------------------------------------------------------------------------------


def probes(fps: DataFrame, plan: Plan) -> DataFrame:
    """(part, value, fp, probe): each fingerprint under its own values (probe false), and under those that it asks for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(every), 2048):
                fp = every[at : at + 2048]
                b = _permuted(fp, plan.order)
                t, v = plan.thresholds(b)[0], plan.values(b)
                for i in range(plan.m):
                    yield rows(i, v[:, i], fp, False)
                    for k in np.unique(t[:, i]):
                        if k >= 0:
                            own, masks = t[:, i] == k, _masks(8 * plan.sizes[i], int(k))
                            step = max(1, 500_000 // len(masks))
                            for a in range(0, int(own.sum()), step):
                                some = v[own, i][a : a + step]
                                yield rows(i, (some[:, None] ^ masks[None, :]).ravel(), np.repeat(fp[own][a : a + step], len(masks)), True)

    def rows(i: int, value: np.ndarray, fp: np.ndarray, probe: bool) -> pa.RecordBatch:
        n = len(fp)
        return pa.RecordBatch.from_arrays([pa.array(np.full(n, i, np.int32)), pa.array(value.view(np.int64)), pa.array(fp), pa.array(np.full(n, probe))], names=["part", "value", "fp", "probe"])

    return fps.select("fp").mapInArrow(tidy(run), "part int, value long, fp long, probe boolean")


def _spanning(q: np.ndarray, x: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between q and x within the radius, but at most one to each set of x that is already linked."""
    label = np.arange(len(x))
    a, b = [], []
    for f in q:
        hit = np.nonzero(_popcount(x ^ f) <= radius)[0]
        if len(hit):
            _, first = np.unique(label[hit], return_index=True)
            hit = hit[first]
            a.append(np.full(len(hit), f))
            b.append(x[hit])
            if len(hit) > 1:
                label[np.isin(label, label[hit])] = label[hit[0]]
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, q.dtype), np.zeros(0, q.dtype))


#: Pairs of a group up to which all its links are sent on.
DENSE_PAIRS = 4096


def _verify(radius: int):
    """Over rows sorted by group, with group (long) and probe: links as (a, b)."""

    def settle(g: np.ndarray, fp: np.ndarray, probe: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        starts = np.flatnonzero(np.concatenate(([True], np.any(g[1:] != g[:-1], axis=1))))
        size = np.diff(np.concatenate((starts, [len(g)])))
        nq = np.add.reduceat(probe.astype(np.int64), starts)
        nx = size - nq
        out = []
        for s, n, k in zip(*(v[(nq * nx > DENSE_PAIRS)] for v in (starts, size, nq)), strict=True):
            own, p = fp[s : s + n], probe[s : s + n]
            out.append(_spanning(own[p], own[~p], radius))
        small = (nq > 0) & (nx > 0) & (nq * nx <= DENSE_PAIRS)
        s, n, k = starts[small], nx[small], nq[small]
        # index rows stand first in a group: pairs of row s + j (j < nx) and s + nx + i (i < nq), a few groups at a time
        ends = np.cumsum(n * k)
        for lo in range(0, len(s), 20_000):
            sl = slice(lo, lo + 20_000)
            pairs = n[sl] * k[sl]
            if not len(pairs):
                continue
            which = np.repeat(np.arange(len(pairs)), pairs)
            inside = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            j, i = inside % n[sl][which], inside // n[sl][which]
            a, b = fp[s[sl][which] + n[sl][which] + i], fp[s[sl][which] + j]
            ok = (a != b) & (_popcount(a ^ b) <= radius)
            out.append((a[ok], b[ok]))
        del ends
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] | None = None
        for batch in batches:
            new = [np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in ("part", "value", "qb", "xb")], axis=1), batch.column("fp").to_numpy(zero_copy_only=False), batch.column("probe").to_numpy(zero_copy_only=False).astype(bool)]
            if not len(new[1]):
                continue
            held = new if held is None else [np.concatenate((a, b)) for a, b in zip(held, new, strict=True)]
            cut = np.flatnonzero(np.any(held[0] != held[0][-1], axis=1))
            if len(cut):
                at = cut[-1] + 1
                yield links(settle(*(v[:at] for v in held)))
                held = [v[at:] for v in held]
        if held is not None:
            yield links(settle(*held))

    def links(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        a = np.concatenate([x for x, _ in found]) if found else np.zeros(0, np.int64)
        b = np.concatenate([x for _, x in found]) if found else np.zeros(0, np.int64)
        keep = a != b
        both = np.unique(np.stack([np.minimum(a, b)[keep], np.maximum(a, b)[keep]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["a", "b"])

    return run


def links(fps: DataFrame, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS, plan: Plan | None = None) -> DataFrame:
    """fps (fp, distinct) to links (a, b) whose components are those of all pairs within the radius. They read scratch tables of their own only."""
    plan = plan or best_plan(fps, radius)
    # values have 32 bits at most
    rows = written(probes(fps, plan).withColumn("key", F.shiftleft(F.col("part").cast("long"), 32) + F.col("value")), "probes")
    size = rows.groupBy("key").agg(F.count_if("probe").alias("nq"), F.count_if(~F.col("probe")).alias("nx")).withColumn("n", F.col("nq") + F.col("nx"))
    # only buckets that are cut need their size beside each row: a bitmap tells them on the map side
    large = written(size.filter(F.greatest("nq", "nx") > bucket_rows).select("key", "n", F.ceil(F.col("nq") / bucket_rows).cast("int").alias("kq"), F.ceil(F.col("nx") / bucket_rows).cast("int").alias("kx")), "large-buckets")
    if n := large.count():
        bits = filter_bits(n)
        told = with_hit(rows, F.xxhash64("key"), key_bitmap(large, F.xxhash64("key"), bits), bits)
        cut = join_groups(told.filter("__hit").drop("__hit"), large, "key", "n", rows.count()).drop("n")
        rows = cut.unionByName(told.filter("not __hit").drop("__hit").withColumns({"kq": F.lit(1), "kx": F.lit(1)})).fillna(1, ["kq", "kx"]).filter("kq > 0 and kx > 0")
    else:
        rows = rows.withColumns({"kq": F.lit(1), "kx": F.lit(1)})
    slot = lambda k, seed: F.pmod(F.xxhash64("fp", F.lit(seed)), F.col(k)).cast("int")
    every = lambda k: F.sequence(F.lit(0), F.col(k) - 1)
    rows = rows.select(
        "part", "value", "fp", "probe",
        F.explode(F.when(F.col("probe"), F.transform(every("kx"), lambda x: F.struct(slot("kq", 1).alias("qb"), x.alias("xb")))).otherwise(F.transform(every("kq"), lambda x: F.struct(x.alias("qb"), slot("kx", 2).alias("xb"))))).alias("at"),
    ).select("part", "value", "at.qb", "at.xb", "fp", "probe")
    rows = rows.repartition("part", "value", "qb", "xb").sortWithinPartitions("part", "value", "qb", "xb", "probe")
    return rows.mapInArrow(tidy(_verify(radius)), "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(id_col, fp, component_id): one row per row of docs."""
    own = written(fingerprints(docs, id_col, text_col, words), "fingerprints")
    return classes(own, id_col, radius, bucket_rows)


def classes(own: DataFrame, id_col: str, radius: int = RADIUS, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """own (id_col, fp, ...) with component_id, the smallest id of the component."""
    reps = written(own.groupBy("fp").agg(F.min(id_col).alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    roots = components(links(reps, radius, bucket_rows)).withColumnRenamed("node", "fp")
    by_fp = _lowest(reps.join(written(roots, "roots"), "fp", "left"), "low", reps.count())
    return join_groups(own, by_fp.drop("root", "low"), "fp", "n", own.count(), "inner").drop("n")


def _lowest(rows: DataFrame, low: str, total: int) -> DataFrame:
    """rows (low, root or null, ...) with component_id: the smallest `low` of the rows of a root, a rootless row's own."""
    rows = written(rows, "rooted")
    lows = rows.filter("root is not null").groupBy("root").agg(F.min(low).alias("component_id"), F.count("*").alias("__k"))
    linked = join_groups(rows.filter("root is not null"), written(lows, "root-lows"), "root", "__k", total, "inner").drop("__k")
    return linked.select(*rows.columns, "component_id").unionByName(rows.filter("root is null").withColumn("component_id", F.col(low)))


# ---- similar texts -------------------------------------------------------------------------------------------------


def shingle_counts(docs: DataFrame, text_col: str, words: int) -> np.ndarray:
    """2^COUNT_BITS counters of shingles by their upper bits, summed over all rows: a fixed size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << COUNT_BITS, np.int64)
        for b in batches:
            for t in b.column(0):
                np.add.at(total, (shingle_set(t.as_py(), words) >> np.uint64(64 - COUNT_BITS)).astype(np.int64), 1)
        at = range(0, 1 << COUNT_BITS, COUNT_CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array(list(at), pa.int32()), pa.array([narrow(total[i : i + COUNT_CHUNK]) for i in at])], names=["at", "n"])

    def narrow(n: np.ndarray) -> bytes:
        """In as few bytes a counter as its largest needs."""
        n = np.minimum(n, 2**32 - 1)
        return n.astype(np.min_scalar_type(int(n.max()))).tobytes()

    def wide(n: bytes) -> np.ndarray:
        return np.frombuffer(n, f"u{len(n) // COUNT_CHUNK}")

    def added(chunks: pa.Table) -> pa.Table:
        total = np.zeros(COUNT_CHUNK, np.int64)
        for n in chunks.column("n"):
            total += wide(n.as_py())
        return pa.table({"at": chunks.column("at")[:1], "n": [narrow(total)]})

    out = np.zeros(1 << COUNT_BITS, np.uint32)
    for at, n in docs.select(F.col(text_col).cast("binary")).mapInArrow(tidy(run), "at int, n binary").groupBy("at").applyInArrow(added, "at int, n binary").collect():
        out[at : at + COUNT_CHUNK] = wide(n)
    return out


def prefix(hashes: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles of a set, rare ones before common ones.

    In one order of all shingles, two sets of a Jaccard similarity t share one of their first n - ceil(t n) + 1. Any order
    does; the counters only keep common shingles out. Sets without a shingle share shingle zero.
    """
    n = len(hashes)
    if not n:
        return np.zeros(1, np.uint64)
    return hashes[np.lexsort((hashes, counts[(hashes >> np.uint64(64 - COUNT_BITS)).astype(np.int64)]))[: n - ceil(similarity * n - 1e-9) + 1]]


def parity(hashes: np.ndarray) -> np.ndarray:
    """1,024 bits, each flipped by every shingle of a set that falls on it.

    Shingles that two sets share flip the same bits, so that the sketches of two sets differ in at most as many bits as the
    sets differ in shingles.
    """
    odd = np.bincount((hashes & np.uint64(64 * PARITY_LONGS - 1)).astype(np.int64), minlength=64 * PARITY_LONGS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def sketches(docs: DataFrame, id_col: str, text_col: str, carry: str, counts: np.ndarray, similarity: float, words: int) -> DataFrame:
    """(id_col, carry, fp long, size int, prefix array<long>, parity array<long>), one row per row: word fingerprint, shingles, the first of them, parity sketch."""
    sent = docs.sparkSession.sparkContext.broadcast(counts)  # 4 MB

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps, sizes, firsts, odd = [], [], [], []
        for t in batch.column("__text"):
            t = t.as_py()
            own = shingle_set(t, words)
            fps.append(word_fingerprint(t))
            sizes.append(len(own))
            firsts.append(prefix(own, sent.value, similarity).view(np.int64))
            odd.append(parity(own))
        ends = np.cumsum([0, *map(len, firsts)]).astype(np.int32)
        held = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(firsts)))
        return pa.RecordBatch.from_arrays([batch.column(id_col), batch.column(carry), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), held, pa.ListArray.from_arrays(pa.array(np.arange(len(odd) + 1, dtype=np.int32) * PARITY_LONGS), pa.array(np.concatenate(odd)))], names=[id_col, carry, "fp", "size", "prefix", "parity"])

    kept = "".join(f"`{c}` {docs.schema[c].dataType.simpleString()}, " for c in (id_col, carry))
    return map_batches(docs.select(id_col, carry, F.col(text_col).cast("binary").alias("__text")), run, f"{kept}fp long, size int, prefix array<long>, parity array<long>")


def _may_be(similarity: float, a: str, b: str) -> Column:
    """Whether sets that share a shingle at pos, and none before, can be that similar."""
    left = lambda c: F.col(f"{c}.size") - F.col(f"{c}.pos")
    # sets without a shingle have no place left, and are alike
    return F.least(left(a), left(b)) + 1e-6 >= F.lit(similarity / (1 + similarity)) * (F.col(f"{a}.size") + F.col(f"{b}.size"))


def _may_differ_so(similarity: float, a: str, b: str) -> Column:
    """Whether sets with such parity sketches can be that similar: of J(x, y) >= t, x and y differ in (1 - t) / (1 + t) (|x| + |y|) at most."""
    apart = reduce(Column.__add__, (F.bit_count(F.col(f"{a}.parity")[i].bitwiseXOR(F.col(f"{b}.parity")[i])) for i in range(PARITY_LONGS)))
    return apart <= F.lit((1 - similarity) / (1 + similarity)) * (F.col(f"{a}.size") + F.col(f"{b}.size")) + 1e-6


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()


def _star_pairs(live: DataFrame, similarity: float, turn: int, rows: int) -> DataFrame:
    """Each row of a token with one of them, of the largest component there is; another one each turn."""
    best = live.groupBy("token").agg(F.min(F.struct(-F.col("together"), F.xxhash64("node", F.lit(turn)).alias("h"), "node", "size", "pos", "root")).alias("b"), F.count("*").alias("k"))
    pairs = join_groups(live.select("token", F.struct("node", "size", "pos", "root").alias("a")), written(best, "centres"), "token", "k", rows, "inner")
    return _ordered(pairs.filter("a.root <> b.root").filter(_may_be(similarity, "a", "b")))


def _all_pairs(live: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """All rows of a token that are not of one component yet, in blocks; parities (node, parity) keep pairs out that differ too much."""
    live = live.join(parities, "node")
    blocks = F.ceil(F.col("k") / PAIR_ROWS).cast("int")
    row = F.struct("node", "size", "pos", "root", "parity")
    a = live.select("token", F.pmod(F.xxhash64("node"), blocks).cast("int").alias("block"), row.alias("a"))
    b = live.select("token", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), row.alias("b"))
    return _ordered(a.join(b, ["token", "block"]).filter("a.node < b.node and a.root <> b.root").filter(_may_be(similarity, "a", "b")).filter(_may_differ_so(similarity, "a", "b")))


def _first_tokens(rows: DataFrame) -> DataFrame:
    """(token, k): the tokens of rows (token, node, pos, ...) that several rows have; of those that the same rows have, the first in order.

    A passage that texts share gives many such tokens. Two sets first meet at a token that is first of those of its rows, so
    that the others tell nothing more. Rows are compared by 128 bits.
    """
    held = rows.groupBy("token").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y"), F.sum("pos").alias("at")).filter("k > 1")
    # one order of all shingles: the first has the least place in every row, and so the least sum
    return held.groupBy("k", "x", "y").agg(F.min(F.struct("at", "token")).alias("first")).select("first.token", "k")


def _still_apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs (a, b) whose rows are not of one component yet; a row without a root (node, root) is alone."""
    for side in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(side), F.col("root").alias(f"{side}_root")), side, "left")
    return pairs.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _near_enough(pairs: DataFrame, parities: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b), written, without those that differ too much by their sketches (node, size, parity); only those of rows in pairs are shuffled."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node"))
    bits = filter_bits(2 * pairs.count())
    some = with_hit(parities, F.xxhash64("node"), key_bitmap(nodes, F.xxhash64("node"), bits), bits).filter("__hit")
    for side in ("a", "b"):
        pairs = pairs.join(some.select(F.col("node").alias(side), F.struct("size", "parity").alias(f"{side}_of")), side)
    return pairs.filter(_may_differ_so(similarity, "a_of", "b_of")).select("a", "b")


class Verifier:
    """Pairs (a, b) of rows, by the numbers of own (__node, id_col, __mark), to those that are similar.

    Shingle sets are made once, of rows that are in some pair, from texts that a bitmap tells on the map side. A row with
    many pairs meets them in blocks.
    """

    def __init__(self, docs: DataFrame, own: DataFrame, id_col: str, text_col: str, similarity: float, words: int):
        self.docs, self.own, self.id_col, self.text_col, self.similarity, self.words = docs, own, id_col, text_col, similarity, words
        self.sets: DataFrame | None = None
        self.scratch: list[DataFrame] = []

    def _made(self, nodes: DataFrame) -> DataFrame:
        keys = written(self.own.join(nodes, "__node", "left_semi").select("__node", F.col(self.id_col).alias("__id"), F.col("__mark").alias("__of")), "paired-rows")
        bits = filter_bits(keys.count())
        texts = with_hit(self.docs, _row_key(F.col(self.id_col), F.col("__mark")), key_bitmap(keys, _row_key(F.col("__id"), F.col("__of")), bits), bits).filter("__hit")
        texts = texts.select(self.id_col, "__mark", F.col(self.text_col).cast("binary").alias("__text"))
        # a set is that of its text, whatever the id; ids only deal the rows of a text that is frequent
        dealt = lambda i: F.pmod(F.xxhash64(i), F.lit(16))
        texts = texts.withColumn("__slot", dealt(self.id_col)).drop(self.id_col).dropDuplicates(["__mark", "__slot"])
        texts = texts.join(keys.select(F.col("__of").alias("__mark"), dealt("__id").alias("__slot"), "__node"), ["__mark", "__slot"]).select("__node", "__text")
        words = self.words

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = pa.array([shingle_set(t.as_py(), words).tobytes() for t in batch.column("__text")], pa.binary())
            return pa.RecordBatch.from_arrays([batch.column("__node"), found], names=["__node", "__set"])

        return written(map_batches(texts, run, "__node long, __set binary"), "shingle-sets")

    def __call__(self, pairs: DataFrame) -> DataFrame:
        """pairs should be written: they are read more than once."""
        nodes = written(pairs.select(F.explode(F.array("a", "b")).alias("__node")).distinct(), "paired-nodes")
        n = nodes.count()
        if not n:
            return pairs
        new = self._made(nodes if self.sets is None else nodes.join(self.sets.select("__node"), "__node", "left_anti"))
        self.sets = new if self.sets is None else self.sets.unionByName(new)
        self.scratch.append(new)
        # only sets of these pairs are shuffled
        bits = filter_bits(n)
        sets = with_hit(self.sets, F.xxhash64("__node"), key_bitmap(nodes, F.xxhash64("__node"), bits), bits).filter("__hit").drop("__hit")
        few = pairs.count() <= SIDE_PAIRS
        found = self._beside(self._beside(pairs, sets, "a", few), sets, "b", few)
        similarity = self.similarity

        def alike(batch: pa.RecordBatch) -> pa.RecordBatch:
            ok = []
            for x, y in zip(batch.column("a_set"), batch.column("b_set"), strict=True):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                # two texts without a word are alike
                ok.append(both >= similarity * (len(p) + len(q) - both))
            return batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

        return written(map_batches(found.select("a", "b", "a_set", "b_set"), alike, "a long, b long"), "similar-pairs")

    def _beside(self, pairs: DataFrame, sets: DataFrame, side: str, few: bool) -> DataFrame:
        """pairs with the set of one side. A row's set goes once to each block of its pairs; few: there is but one block."""
        sets = sets.select(F.col("__node").alias(side), F.col("__set").alias(f"{side}_set"))
        if few:
            return pairs.join(sets, side)
        often = pairs.groupBy(side).agg(F.count("*").alias("__n")).filter(F.col("__n") > SIDE_PAIRS).withColumn("__k", F.ceil(F.col("__n") / SIDE_PAIRS).cast("int"))
        often = written(often, "frequent-rows")
        total = often.agg(F.sum("__n")).first()[0]
        if not total:
            return pairs.join(sets, side)
        # at most a block's worth of rows in SIDE_PAIRS, joined to the pairs hot ones apart
        dealt = join_groups(pairs, often, side, "__n", total).withColumn("__block", F.pmod(F.xxhash64("a", "b"), F.coalesce("__k", F.lit(1))).cast("int")).drop("__n", "__k")
        copies = sets.join(often, side, "left").withColumn("__block", F.explode(F.sequence(F.lit(0), F.coalesce("__k", F.lit(1)) - 1))).drop("__n", "__k")
        return dealt.join(copies, [side, "__block"]).drop("__block")


def similar_classes(docs: DataFrame, id_col: str, text_col: str, similarity: float = SIMILARITY, words: int = SIMILAR_WORDS, radius: int = SIMILAR_RADIUS) -> DataFrame:
    """docs (id_col, __mark, text_col) to (id_col, __mark, component_id): components of all pairs that are similar.

    1. Word fingerprints within the radius, found by the generalised pigeonhole search, propose pairs: one row of each
       fingerprint with one of the other, and with the rows of its own.
    2. What is similar and lies farther apart, or was not proposed, is found by the prefix filter, among rows that are not
       of one component yet. So that a large group is not compared pair by pair, rows of a shingle are first compared with
       one of them, in a few rounds, and then all with all that are still apart.

    All proposals are verified on whole sets, and only verified pairs make components.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    own = sketches(docs, id_col, text_col, "__mark", shingle_counts(docs, text_col, words), similarity, words)
    own = written(own.withColumn("__node", F.monotonically_increasing_id()), "sketches")
    verified, total = Verifier(docs, own, id_col, text_col, similarity, words), own.count()

    reps = written(own.groupBy("fp").agg(F.min("__node").alias("low"), F.count("*").alias("n")), "distinct-fingerprints")
    of = lambda c: reps.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low"))
    linked = links(reps, radius)
    across = linked.join(of("a"), "a").join(of("b"), "b").select(F.least("a_low", "b_low").alias("a"), F.greatest("a_low", "b_low").alias("b"))
    within = join_groups(own.select("__node", "fp"), reps.filter("n > 1"), "fp", "n", total, "inner").filter("__node <> low").select(F.col("low").alias("a"), F.col("__node").alias("b"))
    proposed = written(across.unionByName(within).distinct(), "proposals")
    released(spark, linked)
    del linked, across, within
    # one pair of each row first: most others are of one component then
    parities = own.select(F.col("__node").alias("node"), "size", "parity")
    likely = written(_near_enough(proposed, parities, similarity), "proposals")
    seen = [written(likely.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"), "proposals")]
    similar = [verified(seen[0])]
    roots = written(components(similar[0]), "roots")
    rest = written(_still_apart(likely, roots).join(seen[0], ["a", "b"], "left_anti"), "proposals")
    seen.append(rest)
    similar.append(verified(rest))
    if not similar[-1].isEmpty():
        roots = written(components(reduce(DataFrame.unionByName, similar)), "roots")
    released(spark, proposed, likely)

    firsts = own.select(F.col("__node").alias("node"), "size", F.posexplode("prefix").alias("pos", "token"))
    shared = written(firsts.groupBy("token").agg(F.count("*").alias("k")).filter("k > 1").select("token"), "shared-shingles")
    bits = filter_bits(shared.count())
    some = written(with_hit(firsts, F.xxhash64("token"), key_bitmap(shared, F.xxhash64("token"), bits), bits).filter("__hit").drop("__hit"), "shared-prefixes")
    tokens = written(_first_tokens(some), "first-shingles")
    bits = filter_bits(tokens.count())
    live = with_hit(some, F.xxhash64("token"), key_bitmap(tokens, F.xxhash64("token"), bits), bits).filter("__hit").drop("__hit")
    live = written(join_groups(live, tokens, "token", "k", tokens.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0], "inner").drop("k"), "first-prefixes")
    whole, own = own, written(own.select(id_col, "__mark", "__node", "size", "parity"), "parities")
    verified.own, parities = own, own.select(F.col("__node").alias("node"), "size", "parity")
    del firsts
    released(spark, whole, shared, some, tokens)

    idle = False
    for turn in range(STAR_ROUNDS + 1):
        sizes = roots.groupBy("root").agg(F.count("*").alias("together"))
        sizes = join_groups(roots, written(sizes, "root-sizes"), "root", "together", total, "inner")
        before, live = live, live.drop("root", "together", "k").join(sizes, "node", "left").withColumns({"root": F.coalesce("root", "node"), "together": F.coalesce("together", F.lit(1).cast("long"))})
        # tokens whose rows are of one component have nothing left to tell
        held = live.groupBy("token", "root").agg(F.count("*").alias("n")).groupBy("token").agg(F.sum("n").alias("k"), F.sum(F.col("n") * F.col("n")).alias("within"), F.count("*").alias("roots"))
        held = written(held.filter("roots > 1"), "open-shingles")
        rows, apart = held.agg(F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.sum((F.col("k") * F.col("k") - F.col("within")) / 2), F.lit(0))).first()
        if not rows:
            live = before
            break
        live = written(join_groups(live, held.select("token", "k"), "token", "k", rows, "inner"), "open-prefixes")
        released(spark, before)
        # a round that linked nothing will hardly be followed by one that does
        last = idle or turn == STAR_ROUNDS or apart <= FEW_PAIRS * rows
        pairs = _all_pairs(live, parities.drop("size"), similarity) if last else _near_enough(written(_star_pairs(live, similarity, turn, rows), "star-pairs"), parities, similarity)
        for s in seen:
            pairs = pairs.join(s, ["a", "b"], "left_anti")
        pairs = written(pairs, "proposals")
        seen.append(pairs)
        similar.append(verified(pairs))
        idle = similar[-1].isEmpty()
        if not idle:
            roots = written(components(reduce(DataFrame.unionByName, similar)), "roots")
        if last:
            break
    released(spark, live, *verified.scratch)
    rows = own.select(id_col, "__mark", "__node").join(roots.select(F.col("node").alias("__node"), "root"), "__node", "left")
    return _lowest(rows.select(id_col, "__mark", "root"), id_col, total).select(id_col, "__mark", "component_id")


def _row_key(i: Column, mark: Column) -> Column:
    return F.xxhash64(F.coalesce(i.cast("string"), F.lit("null")), mark)


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, radius: int = RADIUS, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: that with the smallest id; of repeated rows (same id and text), one.

    Components are those of fingerprints within the radius; with a similarity, those of pairs whose shingles of `words`
    words are that similar (Jaccard), all of them; the radius is then that of word fingerprints which propose pairs, and
    changes the work, not the result. Rows without an id stay if no row of their component has one.
    """
    docs, (id_col, text_col), back = shielded(docs, id_col, text_col)
    mark = F.xxhash64(text_col)
    if similarity is None:
        own = written(fingerprints(docs.withColumn("__mark", mark), id_col, text_col, words, ("__mark",)), "fingerprints")
        found = classes(own, id_col, radius)
    else:
        found = similar_classes(docs.select(id_col, text_col).withColumn("__mark", mark), id_col, text_col, similarity, words, radius)
    keys = found.groupBy(F.col(id_col).alias("__id"), F.col("__mark").alias("__of")).agg(F.count("*").alias("__n"), F.first("component_id").alias("__root"))
    keys = written(keys.withColumn("__stays", F.col("__id").eqNullSafe(F.col("__root"))), "near-duplicate-keys")
    # rows that surely stay are told by a bitmap of bounded size; only the rest are shuffled
    unsure = keys.filter("not __stays or __n > 1")
    bits = filter_bits(unsure.count())
    bitmap = key_bitmap(unsure, _row_key(F.col("__id"), F.col("__of")), bits)
    rows = with_hit(docs.withColumn("__mark", mark), _row_key(F.col(id_col), F.col("__mark")), bitmap, bits)
    stays = keys.filter("__stays").select("__id", "__of")
    rest = rows.filter("__hit").join(stays, (F.col("__mark") == F.col("__of")) & F.col(id_col).eqNullSafe(F.col("__id")), "left_semi").dropDuplicates([id_col, "__mark"])
    return back(rows.filter("not __hit").unionByName(rest))


# ---- query -------------------------------------------------------------------------------------------------------


def op7_simhash_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
