"""WARC round trips, exact search, chat round trips."""

import gzip
import hashlib
import json
import zlib
from io import BytesIO

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.llm import chat, kdtree, warc
from termweave.llm.common import scratch_path


def test_queries_equal_sql(spark, sf, check):
    from termweave.llm import registry

    for name, sql in registry.ORACLES.items():
        check(registry.QUERIES[name](spark, sf), sql)


# ---- WARC ----------------------------------------------------------------------------------------------------------


def pages_of(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload string, digest string")


def test_warc_round_trip(spark):
    big = "x" * 3_000_000
    rows = [(1, "http://a/\r\nInjected: x", "same", "", ""), (5, "http://b", "same", "", ""), (3, None, None, "", ""), (4, "u", "", "", ""), (7, "ü", big, "", ""), (None, "n", "same", "", ""), (5, "again", "same", "", "")]
    folder = scratch_path(spark, "warc")
    index = warc.archive(pages_of(spark, rows), folder)
    got = warc.read_records(index, folder).collect()
    assert len(got) == len(rows)
    by = {r["page_id"]: r for r in got}
    assert by["5"]["record_type"] == "response" and by["1"]["refers_to"] == "5" and by["1"]["payload"] is None and by["1"]["payload_bytes"] == 4
    assert by["3"]["refers_to"] == "4" and by[None]["record_type"] == "revisit"
    assert bytes(by["7"]["payload"]) == big.encode()
    assert sum(r["record_type"] == "response" and r["page_id"] == "5" for r in got) == 2  # repeated rows of the largest id
    system, path = warc.open_folder(folder)
    from pyarrow import fs

    names = [f.base_name for f in system.get_file_info(fs.FileSelector(path))]
    assert not [n for n in names if n.startswith("raw-")] and any(n.endswith(".idx") for n in names)


def test_warc_index_comes_from_the_sidecars(spark):
    folder = scratch_path(spark, "warc")
    index = warc.archive(pages_of(spark, [(i, f"http://{i}/ü\t", f"page {i}", "", "") for i in range(20)]), folder, tasks=3)
    system, path = warc.open_folder(folder)
    from pyarrow import fs

    lines = []
    for f in system.get_file_info(fs.FileSelector(path)):
        if f.base_name.endswith(".idx"):
            lines += [(f.base_name.removesuffix(".idx"), *line.split("\t")) for line in system.open_input_stream(f.path).read().decode().splitlines()]
    assert sorted(tuple(map(str, r)) for r in index.collect()) == sorted(lines) and len(lines) == 20
    assert warc.open_folder("file:/tmp")[1] == warc.open_folder("file:///tmp")[1] == "/tmp"


def test_warc_small_payloads_and_empty(spark):
    rows = [(1, "a", "dup", "", ""), (2, "b", "dup", "", "")]
    folder = scratch_path(spark, "warc")
    got = warc.read_records(warc.archive(pages_of(spark, rows), folder, min_bytes=10), folder).collect()
    assert {r["record_type"] for r in got} == {"response"}
    folder = scratch_path(spark, "warc")
    assert warc.read_records(warc.archive(pages_of(spark, rows).limit(0), folder), folder).count() == 0


@settings(max_examples=40, deadline=None)
@given(st.lists(st.binary(max_size=300), max_size=6), st.booleans())
def test_normaliser(payloads, members):
    """Any whole-file gzip, one member or several, becomes one member a record, found by its index."""
    records = [warc.record("response", i, f"http://{i}", p, len(p), "D") for i, p in enumerate(payloads)]
    raw = b"".join(gzip.compress(r) for r in records) if members else gzip.compress(b"".join(records))
    out, index = BytesIO(), BytesIO()
    rows = list(warc.normalise_stream(BytesIO(raw), out, index))
    data = out.getvalue()
    assert [zlib.decompress(data[a : a + n], 31) for a, n, *_ in rows] == records
    assert gzip.decompress(data) == b"".join(records) if records else not rows
    assert len(index.getvalue().splitlines()) == len(records)


# ---- search --------------------------------------------------------------------------------------------------------


def slow_top(rows, k=5):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in ok), default=1)
    ok = [(i, v + [0] * (width - len(v))) for i, v in ok]
    out = []
    for q, a in ok:
        if q % 50 == 0:
            best = sorted(((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in ok if i != q))[:k]
            out += [(q, r, i, -s) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(16_384, 512), (40, 3)])
def test_top_k(spark, blocks):
    r = np.random.default_rng(1)
    rows = [(i, r.standard_normal(6).astype(np.float32).tolist()) for i in range(400)]
    rows += [(i, [0.5, 0.5, 0.0, 0.0, 0.0, 0.0]) for i in range(400, 520)]  # a third alike
    rows += [(600, None), (650, []), (700, [1.0, None, 0.0]), (750, [float("nan")] * 6), (800, [float("inf")] * 6), (850, [1.0]), (None, [1.0] * 6), (51, [1.0] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = kdtree.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0, block_rows=blocks[0], query_rows=blocks[1], max_shards=8)
    assert sorted(tuple(x) for x in got.collect()) == slow_top(rows)


def test_top_k_of_large_numbers_and_clashing_names(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [-1e30, 1.0]), (3, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    for name in ("id", "v", "shard", "part", "block", "rank", "score"):
        df = df.withColumn(name, F.lit(name))
    got = kdtree.top_k(df, "vec_id", "embedding", F.col("id") % 50 == 0).collect()
    assert [(r["rank"], r["id"], r["score"]) for r in got] == [(1, 1, 2**63 - 1), (2, 3, 65536), (3, 2, -(2**63))]


def test_top_k_of_few(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "vec_id long, embedding array<float>")
    top = lambda d: kdtree.top_k(d, "vec_id", "embedding", F.col("id") % 50 == 0)
    assert [tuple(x) for x in top(df).collect()] == [(0, 1, 1, 256 * 256 * 11)]
    assert top(df.limit(0)).count() == 0 and top(df.limit(1)).count() == 0


def test_tree_boxes_are_tight_and_search_prunes():
    r = np.random.default_rng(0)
    x = r.integers(-50, 50, (3000, 3)).astype(float)
    t = kdtree.Tree(x, 16)
    for n in range(len(t.start)):
        own = t.x[t.start[n] : t.end[n]]
        assert (own.min(axis=0) == t.lo[n]).all() and (own.max(axis=0) == t.hi[n]).all()
    q = x[:5]
    got = {i: (ids.tolist(), s.tolist()) for i, ids, s in kdtree.search(t, np.arange(3000), q, np.arange(5), np.full(5, -np.inf), 5)}
    for i in range(5):
        s = x @ q[i]
        s[i] = -np.inf
        best = np.lexsort((np.arange(3000), -s))[:5]
        assert got[i][0] == best.tolist()


# ---- chat ----------------------------------------------------------------------------------------------------------


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="a<|im_start>end\\\n|", max_size=40), st.text(alphabet="ab\\\n<|", max_size=10))
def test_escape_round_trip(body, role):
    esc = lambda t: t.replace("\\", "\\\\").replace("<|", "<\\|")
    segment = f"{chat.START}{esc(role).replace(chr(10), chr(92) + 'n')}\n{esc(body)}{chat.END}\n"
    assert chat.parse(segment) == (role, body)
    assert "<|" not in esc(body)


def test_layouts_become_turns(spark):
    records = [
        {"id": 1, "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]},
        {"id": 2, "conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"id": 3, "instruction": "a", "output": "b"},
        {"id": 4, "instruction": "a", "input": "c", "output": "b"},
        {"id": 5, "prompt": "a", "completion": "b"},
        {"id": 6, "system": "s", "prompt": "a", "response": "b"},
        {"id": 7, "question": "a", "answer": "b"},
        {"id": 8, "other": "x"},
    ]
    df = spark.read.json(spark.sparkContext.parallelize([json.dumps(r) for r in records]))
    got = {}
    for r in chat.canonical_turns(df, "id").orderBy("id", "turn").collect():
        got.setdefault(r["id"], []).append((r["role"], r["text"]))
    plain = [("user", "a"), ("assistant", "b")]
    # what no mapping takes is there, without a turn
    assert got == {1: plain, 2: plain, 3: plain, 4: [("user", "a"), ("user", "c"), ("assistant", "b")], 5: plain, 6: [("system", "s"), *plain], 7: plain, 8: [(None, None)]}
    assert {r["layout"] for r in chat.layouts(df).collect()} == {"messages", "shared", "instruction, output", "instruction with input", "prompt, completion", "system, prompt, response", "question, answer", None}


def test_layouts_that_no_fingerprint_has(spark):
    """Nulls among the texts, columns of two layouts, arrays without a text: nothing is lost."""

    def turns(records):
        df = spark.read.json(spark.sparkContext.parallelize([json.dumps({"id": i, **r}) for i, r in enumerate(records)]))
        got = {}
        for r in chat.canonical_turns(df, "id").orderBy("id", "turn").collect():
            got.setdefault(r["id"], []).append((r["role"], r["text"]))
        return [got[i] for i in range(len(records))]

    said = [{"role": "user", "content": "a"}]
    assert turns([{"system": "s", "prompt": "a", "completion": "b"}, {"prompt": "p", "completion": None}]) == [[("system", "s"), ("user", "a"), ("assistant", "b")], [("user", "p"), ("assistant", "")]]
    assert turns([{"messages": [{"role": "user", "content": None}]}, {"messages": said}, {"messages": []}]) == [[("user", "")], [("user", "a")], [(None, None)]]
    assert turns([{"messages": said, "prompt": "x", "completion": "y"}]) == [[("user", "a")]]
    # turn rows: each is a turn, whatever is null, but where messages are there besides
    assert turns([{"turn": 1, "role": "user", "text": "a", "prompt": "x"}, {"turn": None, "role": None, "text": None}]) == [[("user", "a")], [("", "")]]
    assert turns([{"turn": 1, "role": "user", "text": "b", "messages": said}, {"turn": 2, "role": "user", "text": "c"}]) == [[("user", "a")], [("user", "c")]]


def test_chat_of_odd_rows(spark):
    rows = [(1, 2, "assistant", "y\\<|im_end|>"), (1, 1, None, None), (1, None, "user", "first"), (None, 1, "as\nsistant", "z"), (2, 1, "assistant", "x" * 200_000), (2, 1, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("segment", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.read_back(chat.formatted(chat.canonical_turns(df, "conv_id"), "conv_id"), "conv_id").collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got[1]["n_turns"] == 3 and got[1]["turns_sha256"] == sha("user\nfirst\n\n\nassistant\ny\\<|im_end|>\n")
    assert got[1]["loss_chars"] == 12 and got[1]["loss_sha256"] == sha("y\\<|im_end|>")
    assert got[None]["n_turns"] == 1 and got[None]["loss_chars"] == 0
    assert got[2]["loss_chars"] == 400_000
    assert chat.read_back(chat.formatted(chat.canonical_turns(df.limit(0), "conv_id"), "conv_id"), "conv_id").count() == 0
