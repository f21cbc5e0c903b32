"""Exact and near duplicates, against brute force."""

import re
from itertools import combinations
from pathlib import Path

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.llm import common, components, exact_dedup, simhash


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", "", t or "")


def test_exact_groups(odd):
    rows = odd.select("doc_id", "text").collect()
    got = exact_dedup.exact_groups(odd, carry=("text",)).collect()
    assert len(got) == len(rows)
    for key in {norm(r["text"]) for r in rows}:
        own = [r for r in rows if norm(r["text"]) == key]
        best = min(own, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))
        mine = [r for r in got if norm(r["text"]) == key]
        assert {r["group_size"] for r in mine} == {len(own)}
        assert {r["keep_id"] for r in mine} == {best["doc_id"]}
        assert sum(r["kept"] for r in mine) == 1


def test_exact_drop(odd):
    got = exact_dedup.drop_exact_duplicates(odd)
    assert got.columns == odd.columns
    texts = [norm(r["text"]) for r in got.collect()]
    assert sorted(texts) == sorted({norm(r["text"]) for r in odd.collect()})


def test_small_bitmap_changes_nothing(odd):
    one = exact_dedup.exact_groups(odd, bits=6).select("doc_id", "keep_id", "group_size", "kept")
    two = exact_dedup.exact_groups(odd).select("doc_id", "keep_id", "group_size", "kept")
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(key, one.collect())) == sorted(map(key, two.collect()))


def test_empty(empty):
    assert exact_dedup.exact_groups(empty).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.drop_near_duplicates(empty).count() == 0


def slow_fingerprint(text, words=4):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    if not w:
        return 0
    shingles = [" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=50, deadline=None)
@given(st.text(alphabet="aB é\t\n\x0b\x1c𝄞", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def slow_components(ids, fps, radius=4):
    root = list(range(len(fps)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and find(i) != find(j):
                root[find(i)] = find(j)
    low = {}
    for i, d in enumerate(ids):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [low.get(find(i)) for i in range(len(ids))]


def test_near_duplicates_of_odd_rows(odd):
    got = simhash.near_duplicates(odd).collect()
    rows = odd.select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    expect = sorted(zip((str(r["doc_id"]) for r in rows), (f"{f:016x}" for f in fps), map(str, slow_components([r["doc_id"] for r in rows], fps)), strict=True))
    assert sorted((str(r["doc_id"]), f"{r['fp'] & (2**64 - 1):016x}", str(r["component_id"])) for r in got) == expect


def test_simhash_query(spark, sf):
    """Fingerprints and components of whole documents, against all pairs."""
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    fps = [slow_fingerprint(r["text"]) for r in rows]
    slow = slow_components([r["doc_id"] for r in rows], fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in simhash.op7_simhash_dedup(spark, sf).collect()}
    assert got == {r["doc_id"]: (f"{f:016x}", c) for r, f, c in zip(rows, fps, slow, strict=True)}


@pytest.mark.parametrize("bucket_rows", [3, 4096])
@pytest.mark.parametrize("m", [2, 3, 4, 5])
def test_links_of_dense_and_spread_fingerprints(spark, m, bucket_rows):
    """Clusters within few bits (dense buckets, cut into blocks) among noise, for each number of partitions."""
    r = np.random.default_rng(m)
    centres = r.integers(0, 2**63, 6, dtype=np.uint64)
    fps = list(r.integers(0, 2**63, 150, dtype=np.uint64))
    for c in centres:
        for _ in range(25):
            f = int(c)
            for b in r.choice(64, r.integers(0, 5), replace=False):
                f ^= 1 << int(b)
            fps.append(f)
    fps = sorted({int(f) for f in fps})
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(i, f, i) for i, f in enumerate(signed)], "doc_id long, fp long, low long")
    order = simhash.bit_order(simhash.bit_agreement(df), len(fps))
    plan = simhash.Plan(order, simhash.byte_counts(df, order), m, 4)
    edges = simhash.links(df, 4, bucket_rows, plan)
    roots = {x["node"]: x["root"] for x in components.components(edges).collect()}
    slow = slow_components(list(range(len(fps))), fps)
    mine = [min(i for i, f in enumerate(signed) if roots.get(f, f) == roots.get(s, s)) for s in signed]
    assert mine == slow


def test_thresholds_cover_the_radius():
    """Every allocation sums to radius - m + 1, the condition of the generalised pigeonhole principle."""
    r = np.random.default_rng(0)
    counts = r.integers(1, 100, (8, 256)).astype(float)
    for m in (2, 3, 4, 5):
        plan = simhash.Plan(list(range(64)), counts, m, 4)
        t, cost = plan.thresholds(r.integers(0, 256, (50, 8)).astype(np.uint8))
        assert (t.sum(axis=1) == 4 - m + 1).all() and np.isfinite(cost).all()


def slow_similar(texts, words=5, similarity=0.8):
    """The smallest id of each component of pairs with that Jaccard similarity."""
    split = {d: (t or "").lower().split() for d, t in texts.items()}
    sets = {d: {" ".join(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set() for d, w in split.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            both = len(sets[a] & sets[b])
            if both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                lo, hi = sorted((find(a), find(b)))
                root[hi] = lo
    return {find(d) for d in ids}


def test_similar_drop(spark):
    """Copies with edits go, a large group of them included; others stay."""
    r = np.random.default_rng(3)
    vocabulary = [f"w{i}" for i in range(5000)]
    texts = {}
    for g in range(12):
        base = [vocabulary[i] for i in r.integers(0, 5000, 150 + 20 * g)]
        for k in range(60 if g == 0 else 6):
            own = list(base)
            for at in r.integers(0, len(own), k % 5):
                own[at] = "edit"
            texts[len(texts)] = " ".join(own) + ("" if k % 2 else " ")
    texts[len(texts)] = ""
    texts[len(texts)] = None
    texts[len(texts)] = "one two"
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {x["doc_id"] for x in simhash.drop_near_duplicates(df, words=5, radius=7, similarity=0.8).collect()}
    assert kept == slow_similar(texts)


def similar_kept(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return {x["doc_id"] for x in simhash.drop_near_duplicates(df, words=5, radius=7, similarity=0.8).collect()}


def test_similar_drop_of_stars(spark):
    """Each copy is similar to the base alone: none is missed, wherever the base stands."""
    r = np.random.default_rng(5)
    base = [f"w{i}" for i in r.integers(0, 5000, 300)]
    texts = {}
    for k in range(120):
        own = list(base)
        for at in r.choice(56, 6 if k != 77 else 0, replace=False) * 5 + 7:
            own[at] = f"e{k}"
        texts[k] = " ".join(own)
    stays = slow_similar(texts)
    assert len(slow_similar({k: v for k, v in texts.items() if k != 77})) > 60 and len(stays) == 1
    assert similar_kept(spark, texts) == stays


def test_similar_drop_of_reordered_words(spark):
    """Texts of the same words in other orders, each with near copies of its own: copies go, whatever comes first."""
    r = np.random.default_rng(6)
    words = [f"w{i}" for i in range(200)]
    orders = [list(r.permutation(words)) for _ in range(4)]
    texts = {0: " ".join(words)}
    for o in orders:
        for k in range(4):
            own = list(o)
            own[10 * k], own[10 * k + 1] = own[10 * k + 1], own[10 * k]
            texts[len(texts)] = " ".join(own)
    stays = slow_similar(texts)
    assert len(stays) == 5 and similar_kept(spark, texts) == stays


def test_similar_drop_of_a_dense_group(spark):
    """One text, and eight with its words in another order that are alike among themselves: two stay."""
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(200)]
    other = list(r.permutation(words))
    texts = {0: " ".join(words)} | {k: " ".join([*other[: 20 * k], other[20 * k], *other[20 * k :]]) for k in range(1, 9)}
    assert similar_kept(spark, texts) == slow_similar(texts) == {0, 1}


def test_similar_drop_of_a_hot_group(spark):
    """A thousand copies in two clusters of the same words, met in blocks of a few pairs."""
    r = np.random.default_rng(9)
    orders = [[f"w{i}" for i in r.permutation(120)] for _ in range(2)]
    texts = {}
    for k in range(1000):
        own = list(orders[k % 2])
        own[k % 97] = f"e{k}"
        texts[k] = " ".join(own)
    stays = slow_similar({k: t for k, t in texts.items() if k < 60})
    assert stays == {0, 1} and similar_kept(spark, texts) == stays


def test_verifier_meets_frequent_rows_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SIDE_PAIRS", 7)
    texts = {k: "a b c d e f g h " * 9 + f"x{k % 3}" for k in range(60)}
    assert similar_kept(spark, texts) == slow_similar(texts)


def test_similar_drop_of_block_edits(spark):
    """Sections that were added, before or after, or cut."""
    r = np.random.default_rng(7)
    texts = {}
    for g in range(40):
        base = [f"w{i}" for i in r.integers(0, 5000, 200)]
        block = [f"b{g}x{i}" for i in range(10 + g)]
        for own in (base, [base + block, block + base, base[: 190 - g // 2]][g % 3]):
            texts[len(texts)] = " ".join(own)
    stays = slow_similar(texts)
    assert len(stays) == 40 and similar_kept(spark, texts) == stays


def test_similar_drop_of_odd_rows(odd, empty):
    got = simhash.drop_near_duplicates(odd, words=5, radius=7, similarity=0.8)
    assert got.columns == odd.columns
    ids = [r["doc_id"] for r in got.collect()]
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids and ids.count(8) == 1 and 10 not in ids and ids.count(None) == 1
    assert simhash.drop_near_duplicates(empty, words=5, radius=7, similarity=0.8).count() == 0


def test_near_drop(odd):
    got = simhash.drop_near_duplicates(odd)
    assert got.columns == odd.columns
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    # 2 and 1 hash alike; 3, 4, 5 have no words; 10 equals 9; 8 stands once; rows without an id stay, once
    ids = [d for d, _ in rows]
    assert 1 in ids and 2 not in ids and 3 in ids and 4 not in ids and 5 not in ids and ids.count(8) == 1 and 9 in ids and 10 not in ids
    assert ids.count(None) == 1


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r["node"]: r["root"] for r in components.components(df).collect()}
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    assert got == {x: find(x) for x in root}


def test_hub(spark, monkeypatch):
    """One node with 10^5 edges, joined apart from the others."""
    monkeypatch.setattr(components, "FEW_EDGES", 1000)
    hub = spark.range(1, 100_001).select(F.lit(50_000).cast("long").alias("a"), F.col("id").alias("b"))
    more = spark.range(200_000, 200_100).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components.components(hub.unionByName(more)).groupBy("root").agg(F.count("*").alias("n")).collect()
    assert sorted(tuple(r) for r in got) == [(1, 100_000), (200_000, 101)]


def test_long_chain(spark):
    df = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r["root"] for r in components.components(df).collect()} == {0}


def test_spread(spark, tmp_path):
    """One row group is dealt over all cores; many files stay as they are."""
    from termweave.llm.common import spread

    spark.range(1000).coalesce(1).write.parquet(f"{tmp_path}/one")
    spark.range(1000).repartition(40).write.parquet(f"{tmp_path}/many")
    busy = lambda df: df.select(F.spark_partition_id().alias("p")).distinct().count()
    one, many = (spread(spark.read.parquet(f"{tmp_path}/{n}")) for n in ("one", "many"))
    assert busy(one) == 8 and one.count() == 1000 and "Exchange" not in many._jdf.queryExecution().toString()


def test_parities_differ_in_no_more_bits_than_sets_in_shingles():
    r = np.random.default_rng(0)
    for n, own in ((0, 3), (5, 0), (300, 40), (5000, 900)):
        x, y, both = (np.unique(r.integers(0, 2**64, k, dtype=np.uint64)) for k in (own, own, n))
        a, b = (simhash.parity(np.concatenate([both, v])) for v in (x, y))
        assert simhash._popcount(a ^ b).sum() <= len(np.setxor1d(x, y))
    assert not simhash.parity(np.zeros(0, np.uint64)).any()


def test_a_group_of_half_similar_texts_does_not_become_pairs(spark, monkeypatch):
    """120 texts of a common part and four of twelve blocks share first shingles, but few are alike."""
    listed, real = [], simhash._all_pairs
    monkeypatch.setattr(simhash, "_all_pairs", lambda *a: listed.append((df := real(*a)).count()) or df)
    monkeypatch.setattr(simhash, "STAR_ROUNDS", 0)
    monkeypatch.setattr(simhash, "links", lambda reps, radius: reps.sparkSession.createDataFrame([], "a long, b long"))
    common = " ".join(f"common{i}" for i in range(100))
    picks = list(combinations(range(12), 4))[::4][:120]
    texts = {d: f"{common} " + " ".join(f"b{b}x{i}" for b in own for i in range(25)) for d, own in enumerate(picks)}
    texts[120] = texts[7].replace("common50", "another")
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("__mark", F.xxhash64("text"))
    got = {r["component_id"] for r in simhash.similar_classes(docs, "doc_id", "text").collect()}
    assert got == slow_similar(texts) and 120 not in got
    assert len(listed) == 1 and listed[0] < 500


def test_a_passage_that_texts_share_is_told_once(spark, monkeypatch):
    """Two texts of a common passage share many first shingles, which tell the same; the first is enough."""
    counted = []
    monkeypatch.setattr(simhash, "_all_pairs", lambda live, *a, f=simhash._all_pairs: counted.append(live.count()) or f(live, *a))
    words = lambda c, n: " ".join(f"{c}{i}" for i in range(n))
    texts = {0: f"{words('a', 16)} {words('p', 100)}", 1: f"{words('b', 16)} {words('p', 100)}", 2: words("c", 60)}
    assert similar_kept(spark, texts) == slow_similar(texts) == {0, 1, 2}
    assert counted == [2]


def test_similar_drop_removes_scratch_tables(spark):
    """Large tables go as soon as nothing reads them any more."""
    listed = lambda: {p.name for p in Path(common._own_scratch(spark).removeprefix("file://")).glob("*")}
    texts = {k: "a b c d e f g h " * 9 + f"x{k % 3}" for k in range(20)}
    common.scratch_path(spark, "any")
    before = listed()
    assert similar_kept(spark, texts) == slow_similar(texts)
    left = {n.rpartition("-")[0] for n in listed() - before}
    assert left and not left & {"probes", "sketches", "shared-shingles", "shared-prefixes", "shingle-sets"}
