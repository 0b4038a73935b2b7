import os

import pytest

import __spark_entry__ as entry
from waymark.plans import registry

SF = "/root/testdata/sf0.001"


def test_entry_and_registry():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns == ["dim", "key", "micros", "saved", "calls", "share"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", ["a03_rollup_by_user", "x05_segments", "j20_as_of", "r12_greedy", "e11_sequential", "w10_interleave"])
def test_queries_are_repeatable(spark, name):
    one, two = (sorted(map(str, registry.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert one == two and one


def test_shared_id_pairs_read_every_lineitem(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rows = [
        (1, 10, 5, "1994-01-01"), (2, 10, 6, "1998-01-01"), (2, 10, 6, "1998-02-01"), (3, 10, 5, "1999-01-01"), (1, 11, 5, "1999-01-01"), (2, 11, 7, "1999-01-01"),
        (None, 10, 9, "1999-01-01"), (4, None, 9, "1999-01-01"), (5, 12, None, "1999-01-01"), (6, 12, 3, None), (7, 12, 4, None),
    ]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long, day string").selectExpr("l_orderkey", "l_partkey", "l_suppkey", "CAST(day AS timestamp) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(1, 1, "1-URGENT"), (2, 1, "5-LOW")], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    found = registry.QUERIES["j16_shared_id_pairs"](spark, str(tmp_path))
    assert found.columns == ["a", "b", "shared"]
    assert sorted(map(tuple, found.collect())) == [(1, 2, 2), (2, 3, 1), (6, 7, 1)]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert sorted(con.execute(registry.ORACLES["j16_shared_id_pairs"]).fetchall()) == [(1, 2, 2), (2, 3, 1), (6, 7, 1)]


def test_shared_id_pairs_travel_as_lists(spark, tmp_path):
    """What is shuffled to the counting tasks is a list an order and part, not a row a pair."""
    rows = [(o, o % 4, o % 7) for o in range(400)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_suppkey long").selectExpr("*", "CAST('1999-01-01' AS timestamp) AS l_shipdate").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = registry.QUERIES["j16_shared_id_pairs"](spark, str(tmp_path))
    plain = {(a[0], b[0], 1) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and a[2] != b[2]}
    assert set(map(tuple, found.collect())) == plain
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode") < plan.index("RepartitionByExpression [a")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_rollup_joins_its_facts_once(spark):
    plan = registry.QUERIES["a03_rollup_by_user"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "RepartitionByExpression [day" in plan
