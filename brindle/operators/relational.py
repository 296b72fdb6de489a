"""The operator algebra.  Each function declares a plan; Catalyst chooses how to run it."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only if Spark's own estimate is at most this many bytes.
BROADCAST_BYTES = 32 << 20


def project(df: DataFrame, columns: Mapping[str, Column | str] | None = None, **named: Column | str) -> DataFrame:
    """Only the named outputs; later projections over them are merged by the optimizer."""
    items = {**(columns or {}), **named}
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in items.items()])


def filter_rows(df: DataFrame, *predicates: Column) -> DataFrame:
    """Rows for which all predicates hold; a null predicate drops the row."""
    return df.filter(reduce(lambda a, b: a & b, predicates)) if predicates else df


def estimated_bytes(df: DataFrame) -> int:
    """Catalyst's estimate of a plan's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hash_join(left: DataFrame, right: DataFrame, on: Sequence[tuple[str, str]] | Column, how: str = "inner", broadcast_limit: int = BROADCAST_BYTES) -> DataFrame:
    """Equi-join on pairs of columns, or on any condition.

    The right side is broadcast if its estimated size is within the limit and the join
    kind allows it; otherwise both sides are shuffled, and adaptive execution splits
    partitions of hot keys.
    """
    cond = on if isinstance(on, Column) else reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in on])
    if how in {"inner", "left", "left_outer", "left_semi", "left_anti"} and estimated_bytes(right) <= broadcast_limit:
        right = F.broadcast(right)
    return left.join(right, cond, how)


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if its estimated size is within the limit."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df


def cross_product(left: DataFrame, right: DataFrame, max_rows: int | None = None) -> DataFrame:
    """All pairs; the right side is broadcast if it is small.  ``max_rows`` refuses larger products before any work is done."""
    if max_rows is not None:
        n = left.count() * right.count()
        if n > max_rows:
            raise ValueError(f"cross product of {n} rows exceeds {max_rows}")
    return left.crossJoin(small(right))


def range_join(left: DataFrame, right: DataFrame, keys: Sequence[tuple[str, str]], left_time: str, right_time: str, seconds: int) -> DataFrame:
    """Pairs of equal keys whose right time lies at most ``seconds`` before the left one, or at it.

    Time is cut in spans of that length, so such a pair meets in the left row's span or the
    one before it: an equality join that spreads a busy key over its spans.
    """
    span = lambda df, c: F.floor(F.unix_micros(df[c].cast("timestamp")) / F.lit(seconds * 1_000_000)).cast("long")
    here = span(left, left_time)
    left = left.withColumn("__span", F.explode(F.array(here, here - 1)))
    right = right.withColumn("__at", span(right, right_time))
    ago = F.unix_micros(left[left_time].cast("timestamp")) - F.unix_micros(right[right_time].cast("timestamp"))
    cond = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in keys]) & (left["__span"] == right["__at"]) & ago.between(0, seconds * 1_000_000)
    return left.join(right, cond).drop("__span", "__at")


def mark_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, name: str = "mark") -> DataFrame:
    """``left`` with what ``left_key IN (right_key of right)`` says, nulls and all: true, false or unknown.

    A hash join on the distinct keys; what SQL says about nulls needs only their number.
    """
    found = right.where(F.col(right_key).isNotNull()).select(F.col(right_key).alias("__key")).distinct().withColumn("__hit", F.lit(True))
    sizes = right.agg(F.count(F.lit(1)).alias("__n"), F.count(right_key).alias("__known"))
    j = hash_join(left, found, left[left_key] == found["__key"], "left").crossJoin(F.broadcast(sizes))  # one row
    said = F.when(F.col("__n") == 0, False).when(F.col("__hit"), True).when(F.col(left_key).isNull() | (F.col("__known") < F.col("__n")), F.lit(None).cast("boolean")).otherwise(False)
    return j.withColumn(name, said).drop("__key", "__hit", "__n", "__known")


def single_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, value: str, name: str) -> DataFrame:
    """``left`` with the one ``value`` of ``right`` for its key, or null; more than one row of a key is an error."""
    one = right.groupBy(F.col(right_key).alias("__key")).agg(F.count(F.lit(1)).alias("__n"), F.first(value).alias(name))
    one = one.withColumn(name, F.when(F.col("__n") > 1, F.raise_error(F.lit("more than one row for a key"))).otherwise(F.col(name)))
    return hash_join(left, one, left[left_key] == one["__key"], "left").drop("__key", "__n")


def sample_rows(df: DataFrame, key: str, share: float) -> DataFrame:
    """The rows whose key's MD5 lies in the lowest ``share`` of its range: the same rows at every run and size."""
    if not 0 <= share <= 1:
        raise ValueError("share lies in [0, 1]")
    if share == 1:
        return df
    return df.where(F.md5(F.col(key).cast("string").cast("binary")) < F.lit(f"{int(share * (1 << 32)):08x}"))


def aggregate(df: DataFrame, keys: Sequence[Column | str] = (), **aggregates: Column) -> DataFrame:
    """Grouped aggregation, or one row without keys; partial sums are made before the shuffle."""
    aggs = [c.alias(n) for n, c in aggregates.items()]
    if not aggs:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggs) if keys else df.agg(*aggs)


def grouping_sets(df: DataFrame, sets: Sequence[Sequence[str]], keys: Sequence[str], **aggregates: Column) -> DataFrame:
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def window(partition: Sequence[str] = (), order: Sequence[Column | str] = (), rows: tuple[int, int] | None = None, value_range: tuple[int, int] | None = None) -> WindowSpec:
    spec = Window.partitionBy(*partition).orderBy(*order)
    if rows:
        spec = spec.rowsBetween(*rows)
    return spec.rangeBetween(*value_range) if value_range else spec


def running_sum(df: DataFrame, value: str, order: Sequence[str], partition: Sequence[str] = (), name: str = "running_sum", ranges: int | None = None) -> DataFrame:
    """Inclusive running sum of ``value`` in a unique order.

    With partition columns this is one window.  Without them a single window would draw
    all rows into one task, so rows are dealt to ranges of the first order column (its
    approximate quantiles), each range is summed by itself, and the totals of earlier
    ranges, one row a range, are added.  A first order column that is neither a number nor
    a time has no quantiles; then one window does it all.
    """
    up_to = (Window.unboundedPreceding, 0)
    kind = df.schema[order[0]].dataType
    number = {"timestamp": F.unix_micros, "date": F.unix_date}.get(kind.typeName(), lambda x: x)(F.col(order[0])).cast("double")
    if partition or not isinstance(kind, T.NumericType | T.TimestampType | T.DateType):
        return df.withColumn(name, F.sum(value).over(window(partition, order, rows=up_to)))
    n = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = [k / n for k in range(1, n)]
    bounds = sorted(set(df.select(number.alias("__x")).approxQuantile("__x", cuts, 0.2 / n))) if cuts else []
    part = _range_of(number, bounds)
    dealt = df.withColumn("__part", F.when(number.isNull(), -1).otherwise(part))
    inside = dealt.withColumn(name, F.sum(value).over(window(["__part"], order, rows=up_to)))
    totals = dealt.groupBy("__part").agg(F.sum(value).alias("__total"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(F.col("__part").alias("__p"), F.sum("__total").over(earlier).alias("__before"))
    joined = inside.join(F.broadcast(before), F.col("__part") == F.col("__p"))
    own, earlier_sum = F.col(name), F.col("__before")
    # Null only where no value came yet, as in one window.
    total = F.when(own.isNull(), earlier_sum).when(earlier_sum.isNull(), own).otherwise(own + earlier_sum)
    return joined.withColumn(name, total).drop("__part", "__p", "__before")


def _range_of(x: Column, bounds: list[float]) -> Column:
    """How many bounds are at most ``x``: first among every so many bounds, then between two of those."""
    if not bounds:
        return F.lit(0)
    step = max(1, math.isqrt(len(bounds)))
    below = lambda b: b <= x
    coarse = F.size(F.filter(F.array(*[F.lit(b) for b in bounds[step - 1 :: step]]), below)) if len(bounds) >= step else F.lit(0)
    every = F.array(*map(F.lit, bounds))
    return F.transform(F.array(coarse), lambda k: k * step + F.size(F.filter(F.slice(every, k * step + 1, F.lit(step)), below)))[0]


def top_k(df: DataFrame, order: Sequence[Column | str], k: int, offset: int = 0) -> DataFrame:
    """First ``k`` rows in order; every task keeps ``offset + k`` rows at most."""
    out = df.orderBy(*order)
    return (out.offset(offset) if offset else out).limit(k)


def union_rows(first: DataFrame, *more: DataFrame, distinct: bool = False) -> DataFrame:
    out = reduce(DataFrame.union, more, first)
    return out.distinct() if distinct else out


def intersect_rows(left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    return left.intersectAll(right) if keep_all else left.intersect(right)


def except_rows(left: DataFrame, right: DataFrame, keep_all: bool = False) -> DataFrame:
    return left.exceptAll(right) if keep_all else left.subtract(right)
