"""Every registered query against its SQL."""

import duckdb
import pytest

from millrace.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_query_matches_sql(spark, data, duck, name):
    got = catalog.QUERIES[name](spark, data)
    columns = sorted(got.columns)
    want = duck.sql(catalog.SQL[name])
    assert sorted(want.columns) == columns
    rows = want.select(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert sorted(map(repr, map(tuple, got.select(*columns).collect()))) == sorted(map(repr, rows))


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["part", "user_id", "event_id", "value"]
    assert set(e.oracle_sql()) <= set(e.queries())


def test_hot_paths_stay_in_the_jvm(spark, data):
    for name in ("store_final", "compaction", "watermark", "txn", "route"):
        plan = catalog.QUERIES[name](spark, data)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Pandas" not in plan
    plan = catalog.QUERIES["scan"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(user_id,5)" in plan
