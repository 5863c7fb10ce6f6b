from pyspark.sql import functions as F

from plait.streaming import ingest


def test_ingest_resumes_and_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.where("event_id % 2 = 0").repartition(3).write.parquet(f"{tmp_path}/chunks")
    go = lambda: ingest.ingest(spark, f"{tmp_path}/chunks", events.schema, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    go()
    events.where("event_id % 2 = 1").write.mode("append").parquet(f"{tmp_path}/chunks")
    go()
    go()
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(r.event_id for r in events.collect())


def test_windows_of_a_stream_equal_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/chunks")
    stream = ingest.windowed_counts(ingest.chunk_stream(spark, f"{tmp_path}/chunks", events.schema), "ts", "event_type", "1 day", "40 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("daily").start()
    q.processAllAvailable()
    q.stop()
    got = {(r.window_start, r.event_type): r.n for r in spark.table("daily").collect()}
    want = events.groupBy(F.date_trunc("day", F.col("ts").cast("timestamp")).alias("d"), "event_type").count().collect()
    assert got == {(r.d, r.event_type): r["count"] for r in want}
