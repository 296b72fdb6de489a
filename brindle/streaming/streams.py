"""Streams over growing folders: windowed counts with watermarks, and sums carried across batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, files_per_batch: int | None = None) -> DataFrame:
    """New Parquet files of a folder, ``files_per_batch`` at a time."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def _timed(events: DataFrame, time: str, late: str) -> DataFrame:
    """Watermarks need an instant; a time without zone is taken in the session's zone."""
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def tumbling_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts", key: str = "event_type", value: str = "value") -> DataFrame:
    """Count and sum by key in windows; rows later than ``late`` are left out."""
    return (
        _timed(events, time, late)
        .groupBy(F.window(time, width), key)
        .agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
        .select(F.col("window.start").alias("start"), key, "n", "total")
    )


def sliding_counts(events: DataFrame, width: str = "1 hour", slide: str = "15 minutes", late: str = "10 minutes", time: str = "ts", key: str = "event_type") -> DataFrame:
    """Count by key in windows of ``width`` that begin every ``slide``."""
    return (
        _timed(events, time, late)
        .groupBy(F.window(time, width, slide), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(F.col("window.start").alias("start"), key, "n")
    )


def interval_join(left: DataFrame, right: DataFrame, key: str, within: str = "10 minutes", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """Pairs of two streams with one key whose right time lies at most ``within`` after the left one.

    Both watermarks and the interval bound the state: a row is dropped once no partner can come.
    """
    a = _timed(left, time, late).select([F.col(c).alias(f"left_{c}") for c in left.columns])
    b = _timed(right, time, late).select([F.col(c).alias(f"right_{c}") for c in right.columns])
    after = F.expr(f"right_{time} >= left_{time} AND right_{time} <= left_{time} + INTERVAL {within}")
    return a.join(b, (F.col(f"left_{key}") == F.col(f"right_{key}")) & after)


def session_counts(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", time: str = "ts", key: str = "user_id") -> DataFrame:
    """Events of each session: a session ends after ``gap`` without one."""
    return (
        _timed(events, time, late)
        .groupBy(F.session_window(time, gap), key)
        .agg(F.count(F.lit(1)).alias("n"))
        .select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
    )


def running_sum_stream(events: DataFrame, key: str = "user_id", order: str = "event_id", value: str = "value") -> DataFrame:
    """Inclusive running sum of each key, carried from batch to batch in arrival order of batches."""
    schema = events.schema
    out = T.StructType([schema[key], schema[order], T.StructField("running_sum", T.DoubleType())])

    def step(_: tuple[Any, ...], parts: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total = state.get[0] if state.exists else 0.0
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        sums = total + rows[value].fillna(0.0).cumsum()
        state.update((float(sums.iloc[-1]),))
        yield pd.DataFrame({key: rows[key], order: rows[order], "running_sum": sums})

    return events.groupBy(key).applyInPandasWithState(step, out, "total double", "append", GroupStateTimeout.NoTimeout)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process all input there is into Parquet files, exactly once across restarts, and stop."""
    query = df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
