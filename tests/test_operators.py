import numpy as np
import pytest
from pyspark.sql import functions as F

from termweave.operators import metrics, model_rank, profiles, ranking, scope, search


def test_profile_filters(spark):
    c = spark.createDataFrame([(1, "a", "1", "Drug", "X", "V", "S", None), (2, "b", "2", "Drug", None, "V", "S", None), (3, "c", "3", "Drug", "X", "V", None, None), (4, "d", "4", "Drug", "X", "V", "S", "D"), (5, " ", None, "Drug", "X", "V", "S", None)], "concept_id long, concept_name string, concept_code string, domain_id string, concept_class_id string, vocabulary_id string, standard_concept string, invalid_reason string")
    p = spark.createDataFrame([(i, f"p{i}") for i in range(1, 6)], "concept_id int, profile_text string")
    assert {r[0] for r in profiles.scan_profiles(p, c, ["Drug"]).select("concept_id").collect()} == {1, 2, 5}
    with pytest.raises(ValueError):
        profiles.scan_profiles(p, c, extra=["absent"])
    s = spark.createDataFrame([(1, "A"), (1, "  Alt "), (1, None), (1, "alt")], "concept_id long, concept_synonym_name string")
    got = {r["concept_id"]: r["profile_text"] for r in profiles.compose_profiles(c, s, with_code=True).collect()}
    # a null class does not pass the built-in exclusions; an empty profile is dropped
    assert got == {1: "a | alt | 1"}
    assert profiles.values(["a, b", None, " ,c"]) == ["a", "b", "c"]


def test_near_ties(spark):
    df = spark.createDataFrame([(1, 1, 1.0, 0.1), (1, 2, 0.995, 0.9), (1, 3, 0.98, 5.0), (1, 4, float("nan"), 9.0)], "query_id long, retrieval_rank int, _relevance_score double, strength_sim double")
    got = ranking.by_near_ties(df).orderBy("rank").collect()
    assert [r["retrieval_rank"] for r in got] == [2, 1, 4, 3]  # a score that is no number opens no group
    got = ranking.by_near_ties(df, topn=1).orderBy("rank").collect()
    assert [r["retrieval_rank"] for r in got] == [1, 2, 3, 4]


def _enriched(spark, query, rows, **how):
    c = spark.createDataFrame([(1, i, n, "", s) for i, (n, s) in enumerate(rows, 1)], "query_id long, retrieval_rank int, concept_name string, profile_text string, _relevance_score double").withColumn("concept_id", F.col("retrieval_rank").cast("long"))
    q = spark.createDataFrame([(1, query)], "query_id long, query_norm string")
    return ranking.enriched(c, q, **how).orderBy("rank").collect()


def test_exact_strength_softens_form(spark):
    got = _enriched(spark, "drug injection 10 mg", [("drug 10 mg oral solution", 0.9)])
    assert got[0]["strength_exact"] == 1 and got[0]["form_route_score"] == -0.5


def test_brand_strict_keeps_something(spark):
    rows = [("drug [Other] 5 mg", 0.9)]
    assert len(_enriched(spark, "drug [brand] 5 mg", rows, brand_strict=True)) == 1
    assert [r["concept_name"] for r in _enriched(spark, "drug [brand] 5 mg", [*rows, ("drug 5 mg [brand]", 0.5)], brand_strict=True)] == ["drug 5 mg [brand]"]


@pytest.mark.parametrize("mode", ["tiebreak", "lex", "blend"])
def test_modes_give_each_candidate_a_rank(spark, mode):
    got = _enriched(spark, "drug 5 mg", [("drug 5 mg", 0.5), ("drug 6 mg", 0.505), (None, None)], mode=mode)
    assert [r["rank"] for r in got] == [1, 2, 3]
    assert got[0]["concept_name"] == "drug 5 mg" or mode == "lex"


def test_gate(spark):
    df = spark.createDataFrame([("x 500 mg", "x 5 mg")], "a string, b string")
    df = ranking.gated_score(ranking.pair_features(ranking.side(ranking.side(df, "a", "q", False), "b", "c", True)))
    assert df.first()["post_score"] == 0.0


def test_bracketed_brand_does_not_change_words(spark):
    df = spark.createDataFrame([("drug 5 mg tablet", "drug 5 mg tablet"), ("drug 5 mg tablet", "drug 5 mg tablet [Brand]")], "a string, b string")
    got = ranking.pair_features(ranking.side(ranking.side(df, "a", "q", False), "b", "c", True)).collect()
    assert abs(got[0]["jaccard_text"] - got[1]["jaccard_text"]) < 1e-6


def test_scope(spark):
    concepts = spark.createDataFrame([(10, "A01", "ATC", None, "Drug", "S", "c"), (111, "x", "R", None, "Drug", "S", "c"), (222, "y", "R", None, "Drug", "S", "c")], "concept_id long, concept_code string, vocabulary_id string, invalid_reason string, domain_id string, standard_concept string, concept_class_id string")
    ancestors = spark.createDataFrame([(10, 111), (10, 222)], "ancestor_concept_id long, descendant_concept_id long")
    rows = spark.createDataFrame([(0, "a01", None)], "query_id long, atc_codes string, atc_ids string")
    scopes = scope.scope_ids(rows, concepts)
    assert {r["concept_id"] for r in scope.allowlist(scopes, ancestors, concepts).collect()} == {111, 222}
    assert scope.allowlist(scopes, ancestors, concepts, most=1).count() == 0
    c = spark.createDataFrame([(0, 222, 1), (0, 333, 2), (0, 111, 3)], "query_id long, concept_id long, rank int")
    got = scope.scoped_first(c, scope.allowlist(scopes, ancestors, concepts)).orderBy("rank").collect()
    assert [r["concept_id"] for r in got] == [222, 111, 333]
    assert scope.drop_classes(c, ["c"], concepts).count() == 1


def test_measures(spark):
    rows = spark.createDataFrame([(0, "1"), (1, "2"), (2, "3"), (3, None)], "query_id long, gold_concept_id string")
    c = spark.createDataFrame([(0, 1, 1), (1, 9, 1), (1, 8, 2), (1, 2, 3), (3, 5, 1)], "query_id long, concept_id long, rank int")
    m = metrics.evaluate(rows, c, 5).first()
    assert m["hit@1"] == pytest.approx(1 / 3) and m["hit@5"] == pytest.approx(2 / 3)
    assert m["mrr@100"] == pytest.approx((1 + 1 / 3) / 3) and m["coverage"] == 0.75 and m["n_labeled"] == 3


def test_model_order(spark):
    c = spark.createDataFrame([(0, 1, 1, "a"), (0, 2, 2, "b"), (0, 3, 3, "c")], "query_id long, concept_id long, rank int, concept_name string")
    q = spark.createDataFrame([(0, "x")], "query_id long, query_norm string")
    answers = model_rank.ask(c, q, lambda p: '{"concept_ids": [2, 9, 2]}', 3)
    assert [r["concept_id"] for r in model_rank.merge(c, answers, 3).orderBy("rank").collect()] == [2, 1, 3]
    bad = model_rank.ask(c, q, lambda p: "no", 3)
    assert bad.first()["error"] and [r["concept_id"] for r in model_rank.merge(c, bad, 3).orderBy("rank").collect()] == [1, 2, 3]


def test_late_interaction_masks():
    r = np.random.default_rng(0)
    q, d = r.standard_normal((4, 8)), r.standard_normal((5, 8))
    assert search.max_similarity(q, q) == pytest.approx(1.0)
    keep = np.array([True, True, False, True])
    assert search.max_similarity(q, d, keep) == pytest.approx(search.max_similarity(q[keep], d))
    none = np.zeros(5, bool)
    assert search.max_similarity(q, d, None, none) == pytest.approx(-0.5)


def test_nearest_with_empty_sides(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None)], "concept_id long, vector array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.1])], "query_id long, vector array<float>")
    assert [r["concept_id"] for r in search.nearest(q, v, 5).orderBy("retrieval_rank").collect()] == [1, 2]
    assert search.nearest(q.limit(0), v, 5).count() == 0
    assert search.nearest(q, v.limit(0), 5).count() == 0


def test_allowlist_does_not_list_scopes_that_are_too_wide(spark):
    """A scope of 3,000 concepts named by 400 rows would be 1,200,000 rows, all of which the cap drops."""
    ids = spark.range(1, 3001).selectExpr("id AS concept_id", "'Drug' AS domain_id", "'S' AS standard_concept", "CAST(NULL AS STRING) AS invalid_reason")
    # the same edge may stand there twice, and scope 8 has just as many as may be
    edges = ids.selectExpr("7L AS ancestor_concept_id", "concept_id AS descendant_concept_id").unionByName(spark.range(2000).selectExpr("8L AS ancestor_concept_id", "id % 1000 + 1 AS descendant_concept_id"))
    scopes = spark.range(401).selectExpr("id AS query_id", "explode(CASE WHEN id = 400 THEN array(8L) ELSE array(7L, 8L) END) AS ancestor")
    found = scope.allowlist(scopes, edges, ids)
    assert {tuple(r) for r in found.collect()} == {(400, i) for i in range(1, 1001)}
    # what the joins of scopes and edges made
    assert _most_rows(found) < 10_000


def test_scoped_first_does_not_list_what_a_query_may_have(spark):
    """300 queries of two scopes, of 3,000 and of 1,000 concepts: 900,000 pairs would be listed for 1,201 candidates."""
    edges = spark.range(1, 3001).selectExpr("7L AS ancestor", "id AS concept_id").unionByName(spark.range(1, 1001).selectExpr("8L AS ancestor", "id AS concept_id"))
    scopes = spark.range(300).selectExpr("id AS query_id", "explode(array(7L, 8L, 8L)) AS ancestor")
    c = spark.range(301).selectExpr("id AS query_id", "explode(array(named_struct('concept_id', 9000L, 'rank', 1), named_struct('concept_id', 5L, 'rank', 2), named_struct('concept_id', NULL, 'rank', 3), named_struct('concept_id', 2000L, 'rank', 4))) AS c").select("query_id", "c.*")
    df = scope.scoped_first(c, scopes, edges=edges)
    got = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["concept_id"], r["atc_match"]))
    assert all(got[q] == [(5, True), (2000, True), (9000, False), (None, False)] for q in range(300))
    assert got[300] == [(9000, False), (5, False), (None, False), (2000, False)]
    listed = scopes.join(edges, "ancestor").select("query_id", "concept_id").distinct()
    assert {tuple(r) for r in scope.scoped_first(c, listed).collect()} == {tuple(r) for r in df.collect()}
    assert _most_rows(df) < 10_000


def test_scoped_first_query_stays_small(spark, sf, tmp_path):
    """With twenty times the parts, the query listed twenty times the pairs, though there are no more candidates."""
    from termweave.queries import QUERIES

    for name in ("orders", "lineitem"):
        (tmp_path / f"{name}.parquet").symlink_to(f"{sf}/{name}.parquet")
    part = spark.read.parquet(f"{sf}/part.parquet")
    more = part.crossJoin(spark.range(20).withColumnRenamed("id", "i")).withColumn("p_partkey", F.col("p_partkey") + 1000 * F.col("i")).drop("i")
    more.write.parquet(f"{tmp_path}/part.parquet")
    df = QUERIES["scoped_first"](spark, str(tmp_path))
    n = len(df.collect())
    assert _most_rows(df) <= n


def _most_rows(df) -> int:
    """The most rows that a join or generator of df's plan made, once it has run."""
    plan = df._jdf.queryExecution().executedPlan()
    seen, todo = 0, [plan]
    while todo:
        node = todo.pop()
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
            continue
        if name.endswith("QueryStage"):
            todo.append(node.plan())
            continue
        if "Join" in name or "Generate" in name:
            m = node.metrics().get("numOutputRows")
            seen = max(seen, m.get().value() if m.isDefined() else 0)
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return seen


@pytest.mark.parametrize("n", [3, 40, 500])
def test_top_is_that_of_a_full_sort(n):
    r = np.random.default_rng(n)
    for near in (r.standard_normal((20, n)), r.integers(0, 3, (20, n)) / 3.0, np.zeros((20, n)), np.where(r.random((20, n)) < 0.99, np.nan, 0.5)):
        row, col = search._top(near, 5)
        full = np.argsort(-np.round(near, 12), axis=1, kind="stable")[:, :5]
        assert np.array_equal(col, full.ravel()) and np.array_equal(row, np.repeat(np.arange(20), full.shape[1]))


def test_pairs_of_read_texts_are_not_broadcast(spark, sf):
    """sf0.1 60 times over is 5 MB of parts as a file, but gigabytes of rows as structs: no side may go to the driver."""
    from termweave.queries import QUERIES

    plan = QUERIES["pair_features"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_allowlist_without_cap_lists_each_pair_once(spark, monkeypatch):
    """Scopes overlap, edges and scopes repeat, and sets of rows and of concepts take several blocks."""
    monkeypatch.setattr(scope, "BLOCK", 4)
    ids = spark.range(100).selectExpr("id AS concept_id", "CASE WHEN id = 50 THEN 'Device' ELSE 'Drug' END AS domain_id", "'S' AS standard_concept", "CAST(NULL AS STRING) AS invalid_reason")
    above = {i: {7, 8} if i < 40 else {8} if i < 70 else {9, 10, 7} if i < 90 else {11} for i in range(100)}
    edges = spark.createDataFrame([(a, i) for i, s in above.items() for a in s] * 2 + [(None, 1), (7, None), (7, 1000)], "ancestor_concept_id long, descendant_concept_id long")
    asked = {q: {7, 8} if q < 30 else {8, 9, 10} if q < 33 else {12} if q < 35 else {7} for q in range(40)} | {None: {11}}
    scopes = spark.createDataFrame([(q, a) for q, s in asked.items() for a in s] + [(3, 7), (4, None)], "query_id long, ancestor long")
    want = {(q, i) for q, s in asked.items() for i, a in above.items() if s & a and i != 50}
    found = [tuple(r) for r in scope.allowlist(scopes, edges, ids, most=0).collect()]
    assert len(found) == len(want) and set(found) == want
