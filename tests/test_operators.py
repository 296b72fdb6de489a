from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.operators import aggregate, cross_product, filter_rows, grouping_sets, hash_join, project, relational, running_sum, top_k


def test_null_predicate_drops_row(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 50)], "a int, b int")
    assert [r.a for r in filter_rows(df, F.col("b") > 10).collect()] == [3]
    assert filter_rows(df).count() == 3


def test_join_many_to_many_and_null_keys(spark):
    left = spark.createDataFrame([(i % 50, i) for i in range(150)] + [(None, -1)], "k int, v int")
    right = spark.createDataFrame([(i % 50, i) for i in range(200)] + [(None, -1)], "j int, w int")
    assert hash_join(left, right, [("k", "j")]).count() == 50 * 3 * 4
    assert hash_join(left, right, [("k", "j")], "left_anti").count() == 1


def test_large_side_is_not_broadcast(spark):
    a, b = spark.range(100).toDF("a"), spark.range(100).toDF("b")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan(hash_join(a, b, [("a", "b")]))
    assert "broadcast" not in plan(hash_join(a, b, [("a", "b")], broadcast_limit=1))


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], "k int, v double")
    assert aggregate(empty, ["k"], s=F.sum("v")).count() == 0
    assert aggregate(empty, s=F.sum("v"), n=F.count(F.lit(1))).collect() == [(None, 0)]
    assert cross_product(empty, spark.range(5)).count() == 0
    assert running_sum(empty, "v", ["k"]).count() == 0


def test_cross_product_limit(spark):
    with pytest.raises(ValueError, match="exceeds"):
        cross_product(spark.range(70), spark.range(70).toDF("b"), max_rows=100)
    assert cross_product(spark.range(3), spark.range(4).toDF("b"), max_rows=12).count() == 12


@pytest.mark.parametrize("ranges", [1, 3, 8])
def test_running_sum_over_ranges(spark, ranges):
    rows = [(i, None if i % 7 == 0 else float(i % 5)) for i in range(200)] + [(None, 4.0)]
    df = spark.createDataFrame(rows, "k int, v double").repartition(5)
    got = {r.k: r.running_sum for r in running_sum(df, "v", ["k"], ranges=ranges).collect()}
    total, want = 4.0, {None: 4.0}
    for k, v in rows[:-1]:
        total += v or 0.0
        want[k] = total
    assert got == want


def test_running_sum_starts_null(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, 2.0)], "k int, v double")
    assert [r.running_sum for r in running_sum(df, "v", ["k"]).orderBy("k").collect()] == [None, None, 2.0]


def test_running_sum_by_text_key(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "k string, v int")
    assert [r.running_sum for r in running_sum(df, "v", ["k"]).orderBy("k").collect()] == [1, 3, 6]


def test_top_k_and_projection(spark):
    df = spark.range(20)
    assert [r.id for r in top_k(df, [F.desc("id")], 3, offset=2).collect()] == [17, 16, 15]
    assert project(df, {"x y": F.col("id") + 1}, z="id").columns == ["x y", "z"]


def test_grouping_sets_counts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "a")], "k int, s string")
    out = grouping_sets(df, [["k"], []], ["k", "s"], n=F.count(F.lit(1)))
    assert sorted(r.n for r in out.collect()) == [1, 2, 3]


def test_ranges_are_found_in_two_steps(spark):
    import bisect

    for n in (0, 1, 2, 3, 10, 50):
        bounds = [float(3 * k) for k in range(n)]
        got = spark.range(160).select(relational._range_of((F.col("id") - 3).cast("double"), bounds).alias("r")).collect()
        assert [r.r for r in got] == [bisect.bisect_right(bounds, i - 3.0) for i in range(160)]


def test_single_join_refuses_two_rows(spark):
    left, right = spark.range(3).toDF("a"), spark.createDataFrame([(1, "x"), (1, "y")], "b long, v string")
    with pytest.raises(Exception, match="more than one row"):
        relational.single_join(left, right, "a", "b", "v", "v").collect()


def test_mark_join_knows_nulls(spark):
    left = spark.createDataFrame([(1,), (2,), (None,)], "a int")
    for rows, want in (([], [False, False, False]), ([(1,)], [True, False, None]), ([(1,), (None,)], [True, None, None])):
        right = spark.createDataFrame(rows, "b int")
        assert sorted([r.mark for r in relational.mark_join(left, right, "a", "b").collect()], key=str) == sorted(want, key=str)


def test_range_join_equals_all_pairs(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 30").select("event_id", "user_id", "ts")
    before = e.select(F.col("event_id").alias("f"), F.col("user_id").alias("u"), F.col("ts").alias("t"))
    for seconds in (1, 3600, 100_000):
        got = relational.range_join(e, before, [("user_id", "u")], "ts", "t", seconds)
        want = e.join(before, (F.col("user_id") == F.col("u")) & F.col("t").between(F.col("ts") - F.expr(f"INTERVAL {seconds} SECONDS"), F.col("ts")))
        assert got.columns == want.columns and sorted((r.event_id, r.f) for r in got.collect()) == sorted((r.event_id, r.f) for r in want.collect())
