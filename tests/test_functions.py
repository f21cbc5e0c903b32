import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termweave.functions import forms, prompts, strength, text


def sim(q, c):
    read = lambda t, b: strength.parsed(strength.strengths(t, b)[0])
    return strength.similarity(read(q, False), read(c, True))


def column(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first()["x"]


def test_ratio_and_volume():
    found, spans = strength.strengths("Insulin 100 units/mL (10 mL)")
    assert any(s.kind == "ratio" and s.amount == 100 for s in found)
    assert spans


@pytest.mark.parametrize(
    "q, c, low, high",
    [
        ("albuterol 90 mcg per actuation", "90 mcg/actuation albuterol HFA", 0.95, 1.01),
        ("Linagliptin+Metformin 2.5/500", "Metformin 500 mg / Linagliptin 2.5 mg oral tablet", 0.95, 1.01),
        ("hydrocortisone 2.5% cream", "hydrocortisone 25 mg/ml cream", 0.99, 1.01),
        ("x 1 g", "x 1000 mg", 0.99, 1.01),
        ("x 1,000 mg", "x 1 g", 0.99, 1.01),
        ("x 500 mg", "x 5 mg", -1.0, -1.0),
        ("x", "x 5 mg", 0.0, 0.0),
        ("x 5 mg", "x 5 ml", -1.0, -1.0),
    ],
)
def test_similarity(q, c, low, high):
    assert low <= sim(q, c) <= high


def test_further_ingredient_is_no_gain():
    assert sim("a 5 mg", "a 5 mg / b 10 mg") <= sim("a 5 mg", "a 5 mg")


def test_ranges_counts_and_percent():
    assert [s.value for s in strength.strengths("5-10 mg")[0]] == [5, 10]
    assert [(s.value, s.unit) for s in strength.strengths("20 tablets")[0]] == [(20, "tablet")]
    assert {s.kind for s in strength.strengths("2 % w/w")[0]} == {"percent", "ratio"}
    assert strength.strengths("tablet")[0] == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(0.01, 1000), min_size=1, max_size=4), st.lists(st.floats(0.01, 1000), min_size=1, max_size=4))
def test_matching_is_cheapest(q, d):
    """Against all pairings."""
    from itertools import permutations

    a, b = sorted((q, d), key=len)
    best = min(sum(abs(math.log(x / y)) for x, y in zip(a, p)) for p in permutations(b, len(a)))
    cost, real = strength.matched(sorted(q), sorted(d))
    assert abs(cost + (len(a) - real) * strength.DUMMY - best) < 1e-6


@pytest.mark.parametrize(
    "t, r, f",
    [
        ("x ER tab", "extended_release", "oral_tablet"),
        ("gastro-resistant capsule", "gastro_resistant", "oral_capsule"),
        ("EC tablet", "gastro_resistant", "oral_tablet"),
        ("delayed release oral solution", "delayed_release", "oral_solution"),
        ("solution for injection", None, "injectable_solution"),
        ("eye drops", None, "ophthalmic_solution"),
        ("nothing", None, None),
    ],
)
def test_release_and_form(spark, t, r, f):
    got = spark.createDataFrame([(t,)], "t string").select(forms.release(F.col("t")).alias("r"), forms.dosage_form(F.col("t")).alias("f")).first()
    assert (got["r"], got["f"]) == (r, f)


def test_us_style(spark):
    got = column(spark, "enteric coated tablet", forms.us_style)
    assert got["us_release_abbr"] == "DR" and got["enteric_or_gastro_resistant"] and got["modified_release"]


def test_brands(spark):
    df = spark.createDataFrame([("take amo xil now", "a [Amo-Xil]"), ("take b", "a [Amoxil]"), ("x", "a"), ("(x+)", "a [(x+)]")], "q string, c string")
    got = df.select(text.brand_score(F.col("q"), text.brands(F.col("c")), text.brand_patterns(F.col("c"))).alias("s")).collect()
    assert [r["s"] for r in got] == [1.0, -1.0, 0.0, 1.0]


def test_texts(spark):
    assert column(spark, "  MixED\tCase  Text  ", text.normalized) == "mixed case text"
    assert column(spark, None, text.normalized) is None
    assert column(spark, "Paracetamol 500mg and glucose", lambda c: text.prepared_query(c)) == "acetaminophen 500 mg and glucose"
    assert column(spark, "glucose", lambda c: text.prepared_query(c, optional_usan=True)) == "dextrose"
    assert column(spark, "a b", lambda c: text.usan_names(c, {"a": "b", "b": "c"})) == "b c"
    assert column(spark, "11.0", text.as_id) is None
    assert column(spark, "a01, 10;10.0|x", text.id_list) == [10]


def test_query_text(spark):
    df = spark.createDataFrame([("Drug A", "123"), ("", "456"), ("Drug C", None)], "n string, c string")
    assert [r["q"] for r in df.select(text.query_text(F.col("n"), F.col("c")).alias("q")).collect()] == ["Drug A (123)", "", "Drug C"]


def test_answers():
    assert prompts.merged(prompts.answered_ids('{"concept_ids": [2, 1]}'), [1, 2, 3]) == [2, 1, 3]
    assert prompts.answered_ids("```json\n[3, 3]\n```") == [3, 3]
    for bad in ("", "no", "{}", "[true]", '{"concept_ids": ["x"]}'):
        with pytest.raises(ValueError):
            prompts.answered_ids(bad)
    with pytest.raises(ValueError):
        prompts.merged([9], [1, 2])
    p = prompts.prompt("q", [{"concept_id": 1, "concept_name": "a", "final_score": 0.5}], "Sort.", "ctx", scores=("final_score",))
    assert "a (1) | final_score=0.5000" in p and "Additional context: ctx" in p
