from __future__ import annotations

import pytest

from brindle.queries import QUERIES, SQL
from tests.compare import assert_same


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    assert_same(QUERIES[name](spark, sf_dir), duck, SQL[name])


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_scan_reads_only_named_columns_and_pushes_filters(spark, sf_dir):
    plan = QUERIES["pushdown_count"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_quantity:double>" in plan
    assert "GreaterThan(l_quantity,45.0)" in plan


def test_cross_math_makes_no_pairs(spark, sf_dir):
    plan = QUERIES["cross_math"](spark, sf_dir)._jdf.queryExecution().optimizedPlan()
    todo, joins = [plan], 0
    while todo:
        node = todo.pop()
        joins += node.nodeName() == "Join"
        sides = [node.children().apply(i) for i in range(node.children().size())]
        assert node.nodeName() != "Join" or all(s.maxRows().isDefined() and s.maxRows().get() <= 1 for s in sides)
        todo += sides
    assert joins == 1


@pytest.mark.parametrize(
    "balances, prices",
    [
        ([1.0, 1.0, -2.5, 700.25], [0.0, 3.0, 3.0]),
        ([None, 1.0, 4.0], [None, 2.0]),
        ([None, None], [2.0, 3.0]),
        ([], [2.0]),
        ([], []),
        ([float("nan"), 1.0, 5.0], [2.0, 3.0]),
        ([float("nan")], [2.0, None]),
        ([float("nan"), 1.0], [None]),
    ],
)
def test_cross_math_on_odd_rows(spark, tmp_path, balances, prices):
    import duckdb

    con = duckdb.connect()
    for table, column, values in (("supplier", "s_acctbal", balances), ("part", "p_retailprice", prices)):
        spark.createDataFrame([(v,) for v in values], f"{column} double").coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    assert_same(QUERIES["cross_math"](spark, str(tmp_path)), con, SQL["cross_math"])
