"""The pipeline against a plain version of each stage."""

import re

from test_dedup import norm, slow_similar

import corpus_pipeline as pipeline


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    assert names == ["language_id", "exact_dedup", "simhash_dedup", "source_mixing", "best_fit_packing"]
    seen = [docs]
    for _, stage in pipeline.STAGES[:-1]:
        out = stage(spark, seen[-1], sf)
        assert out.columns == docs.columns
        from termweave.llm.common import written

        seen.append(written(out, "test-stage"))
    rows = [d.collect() for d in seen]
    # language: what goes has no letter, or no language that stands out; nearly all stays
    assert len(rows[1]) >= 0.97 * len([r for r in rows[0] if re.search(r"[^\W\d_]", r["text"] or "")])
    # exact: one of each, the one with the most code points, then the smallest id
    best = {}
    for r in rows[1]:
        k = norm(r["text"])
        best[k] = min(best.get(k, r), r, key=lambda x: (-len(x["text"]), x["doc_id"]))
    assert sorted(r["doc_id"] for r in rows[2]) == sorted(r["doc_id"] for r in best.values())
    # near: of each component of similar texts the smallest id stays
    stays = slow_similar({r["doc_id"]: r["text"] for r in rows[2]})
    kept = {r["doc_id"] for r in rows[3]}
    assert kept == stays
    # mix: each source near its target, nothing more than twice
    count = {}
    for r in rows[4]:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    assert max(count.values()) <= 2 and set(count) <= {r["doc_id"] for r in rows[3]}
    total = lambda rs: sum(len(r["text"].split()) for r in rs)
    assert 1.3 * total(rows[3]) < total(rows[4]) < 1.6 * total(rows[3])
    # pack: each row once, whole
    packed = pipeline.STAGES[-1][1](spark, seen[-1], sf)
    assert packed.filter("piece = 0").count() == len(rows[4])
    assert packed.filter("length * 4 <> length(ids) OR offset + length > 4096").count() == 0


def test_run(spark, sf):
    assert pipeline.run(spark, sf).count() > 0


def test_run_of_odd_and_empty_rows(spark, odd, empty, tmp_path):
    """All stages in a row, on nulls, repeated rows, long texts, and on nothing."""
    for name, docs in (("odd", odd), ("empty", empty)):
        docs.drop("score", "lang_pred", "fp", "kept", "__norm", "__key", "__mark", "id").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        out = pipeline.run(spark, f"file://{tmp_path}/{name}")
        ids = {r["doc_id"] for r in out.select("doc_id").collect()}
        assert out.filter("length * 4 <> length(ids) OR offset + length > 4096").count() == 0
        assert not ids & {3, 4, 5, 7} and (not ids if name == "empty" else ids)
