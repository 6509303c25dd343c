from pyspark.sql import functions as F

from feedforge.streaming import jobs

SCHEMA = "event_id long, ts timestamp, event_type string, repo string, bit int, seq long"


def write(spark, path, rows):
    spark.createDataFrame(rows, "event_id long, ts string, event_type string, repo string, bit int, seq long").withColumn("ts", F.col("ts").cast("timestamp")).write.mode("append").parquet(path)


def test_hourly_and_dedup(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(1, "2024-01-01 00:10:00", "a", "r", 1, 1), (1, "2024-01-01 00:40:00", "a", "r", 1, 2), (2, "2024-01-01 01:10:00", "b", "r", 0, 3)])
    stream = jobs.source(spark, src, spark.read.parquet(src).schema)
    jobs.run_available(jobs.hourly_counts(stream), str(tmp_path / "out"), str(tmp_path / "c1"), "complete")
    assert sorted((r.hour.hour, r.event_type, r.events) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, "a", 2), (1, "b", 1)]
    jobs.run_available(jobs.deduplicated(stream), str(tmp_path / "out2"), str(tmp_path / "c2"))
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 2


def test_dgim_state_survives_batches(spark, tmp_path):
    src = str(tmp_path / "in")
    write(spark, src, [(i, "2024-01-01 00:10:00", "a", "r", 1, i) for i in range(6)])
    stream = jobs.source(spark, src, spark.read.parquet(src).schema)
    seen = []

    def run():
        q = jobs.dgim_counts(stream, "repo", 10).writeStream.outputMode("update").foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()

    run()
    write(spark, src, [(i, "2024-01-01 00:10:00", "a", "r", 1, i) for i in range(6, 12)])
    run()
    assert [(r.arrivals, r.estimate) for r in seen] == [(6, 5), (12, 10)]


def test_incremental_load_is_idempotent(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "lake")
    write(spark, src, [(1, "2024-01-01 00:10:00", "a", "r", 1, 1), (2, "2024-01-01 01:10:00", "a", "r", 1, 2)])
    build = lambda df: df.withColumn("dt", F.date_format("ts", "yyyy-MM-dd")).withColumn("hr", F.hour("ts"))
    for i in range(2):
        jobs.load_silver(jobs.source(spark, src, spark.read.parquet(src).schema), build, out, str(tmp_path / f"c{i}"))
    assert spark.read.parquet(out).count() == 2
