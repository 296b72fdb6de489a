"""Headline queries, best of several runs each: one JSON line.  ``--compare`` adds DuckDB on the same tables."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

from brindle.queries import QUERIES, SQL

HEADLINE = [
    "scan_project", "proj_chain", "proj_heavy_math", "proj_wide", "filter_conj", "agg_global", "groupby_int_key", "groupby_multi_key", "groupby_high_cardinality", "pricing_summary",
    "join_1_1", "join_m_n", "join_3way", "join_star", "local_supplier_volume", "cross_math", "cross_agg", "running_sum", "window_rank", "topk_per_group", "distinct_agg", "rollup",
]
RUNS = 3


def session() -> SparkSession:
    cpus = os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("brindle-bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def timed(run) -> float:
    best = float("inf")
    for _ in range(RUNS):
        start = time.perf_counter()
        run()
        best = min(best, time.perf_counter() - start)
    return round(best, 4)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        # The noop sink computes every row and column, and writes nothing.
        seconds[name] = timed(lambda name=name: QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save())
    out = {"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1].rstrip("/")}
    if "--compare" in sys.argv:
        import duckdb

        from brindle.sources import TABLES

        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
        out["duckdb"] = {name: timed(lambda name=name: con.execute(SQL[name]).to_arrow_table()) for name in HEADLINE}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
