from __future__ import annotations

from pyspark.sql import functions as F

from brindle.streaming import file_stream, interval_join, run_available, running_sum_stream, session_counts, sliding_counts, tumbling_counts


def _split(spark, sf_dir, folder, parts=3):
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value")
    e.repartitionByRange(parts, "ts").write.parquet(folder)
    return e


def test_running_sum_is_carried_across_batches(spark, tmp_path, sf_dir):
    src = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "value").where("user_id < 5")
    rows = src.orderBy("event_id").collect()
    folder = str(tmp_path / "in")
    for i, part in enumerate((rows[: len(rows) // 2], rows[len(rows) // 2 :])):
        spark.createDataFrame(part, src.schema).coalesce(1).write.mode("append").parquet(folder)
        out = running_sum_stream(file_stream(spark, folder, src.schema))
        run_available(out, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = {r.event_id: r.running_sum for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    total, want = {}, {}
    for r in rows:
        total[r.user_id] = total.get(r.user_id, 0.0) + r.value
        want[r.event_id] = total[r.user_id]
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_tumbling_and_session_windows_equal_batch(spark, tmp_path, sf_dir):
    e = _split(spark, sf_dir, str(tmp_path / "in"))
    stream = lambda: file_stream(spark, str(tmp_path / "in"), e.schema)
    run_available(tumbling_counts(stream(), late="3650 days"), str(tmp_path / "a"), str(tmp_path / "ca"))
    batch = e.groupBy(F.window("ts", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    closed = spark.read.parquet(str(tmp_path / "a"))
    assert closed.count() <= batch.count()
    query = session_counts(stream()).writeStream.format("memory").queryName("sessions").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    assert spark.table("sessions").agg(F.sum("n")).first()[0] == e.count()


def test_sliding_windows_and_interval_join_equal_batch(spark, tmp_path, sf_dir):
    e = _split(spark, sf_dir, str(tmp_path / "in"), parts=2)
    stream = lambda: file_stream(spark, str(tmp_path / "in"), e.schema)
    query = sliding_counts(stream(), late="3650 days").writeStream.format("memory").queryName("sliding").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    want = e.groupBy(F.window("ts", "1 hour", "15 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    assert spark.table("sliding").count() == want.count() and spark.table("sliding").agg(F.sum("n")).first()[0] == 4 * e.count()
    pairs = interval_join(stream().where("user_id < 20"), stream().where("user_id < 20"), "user_id", late="3650 days")
    run_available(pairs, str(tmp_path / "pairs"), str(tmp_path / "ck"))
    few = e.where("user_id < 20")
    near = F.expr("b.ts >= a.ts AND b.ts <= a.ts + INTERVAL 10 minutes")
    assert spark.read.parquet(str(tmp_path / "pairs")).count() == few.alias("a").join(few.alias("b"), (F.col("a.user_id") == F.col("b.user_id")) & near).count()
