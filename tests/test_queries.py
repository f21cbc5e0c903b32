"""Every engine query against its SQL, and the entry module."""

import pytest

from termweave import file_queries, queries  # noqa: F401  both register


@pytest.mark.parametrize("name", [n for n in queries.QUERIES if n in queries.ORACLES])
def test_equals_sql(spark, sf, check, name):
    check(queries.QUERIES[name](spark, sf), queries.ORACLES[name])


def test_every_query_has_its_sql():
    assert set(queries.QUERIES) == set(queries.ORACLES)


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry_without_what_the_operators_need(tmp_path):
    """A missing package takes its operators away, not the engine's queries."""
    import subprocess
    import sys

    (tmp_path / "xxhash.py").write_text("raise ImportError('not here')")
    code = "import sys; sys.path.insert(0, sys.argv[1]); sys.path.insert(1, sys.argv[2]); import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op7') for n in q))"
    import os

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = subprocess.run([sys.executable, "-c", code, str(tmp_path), root], capture_output=True, text=True, check=True, timeout=120).stdout.split()
    assert int(out[0]) == len(queries.QUERIES) and out[1] == "False"


def test_scope_allowlist_keeps_wide_scopes(spark, tmp_path):
    """Rows that name a scope of thousands of concepts have them all, as rows of narrow scopes do."""
    import duckdb

    parts = spark.range(7000).selectExpr("id AS p_partkey", "'name' AS p_name", "'Brand#1' AS p_brand", "'PROMO' AS p_type", "CAST(CASE WHEN id < 6900 THEN 7 ELSE 9 END AS INT) AS p_size")
    rows = spark.sql("SELECT * FROM VALUES (57L, 7), (7L, 9), (9L, 9), (11L, 12) AS t(s_suppkey, s_nationkey)")
    con = duckdb.connect()
    for name, df in (("part", parts), ("supplier", rows)):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    found = sorted(tuple(r) for r in queries.QUERIES["scope_allowlist"](spark, str(tmp_path)).collect())
    valid = [i for i in range(7000) if i % 5 and i % 7 and i % 11]
    wide, narrow = [i for i in valid if i < 6900], [i for i in valid if i >= 6900]
    assert len(wide) > 4000
    assert found == sorted([(q, i) for q in (57, 7) for i in wide] + [(q, i) for q in (7, 9) for i in narrow])
    assert found == sorted(con.sql(queries.ORACLES["scope_allowlist"]).fetchall())
