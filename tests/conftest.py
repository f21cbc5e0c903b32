import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('shared')}")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def check(sf):
    """Compares a DataFrame with SQL over the same tables, order aside."""
    import duckdb

    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf}/{name}.parquet'")

    def shown(v):
        return "null" if v is None or v != v else f"{v:.9g}" if isinstance(v, float) else str(v)

    def run(df, sql):
        cols = sorted(df.columns)
        ours = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
        rel = con.sql(sql)
        assert sorted(rel.columns) == cols
        at = [rel.columns.index(c) for c in cols]
        # numbers without a fraction look alike, whatever their type
        theirs = sorted(tuple(shown(r[i]) for i in at) for r in rel.fetchall())
        plain = lambda rows: sorted(tuple(x[:-2] if x.endswith(".0") else x for x in r) for r in rows)
        assert plain(ours) == plain(theirs)

    return run
