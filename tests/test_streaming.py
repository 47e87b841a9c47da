from sightline.streaming import events

SF = "/root/testdata/sf0.001"


def test_stream_of_windows_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet").cache()
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    running = events.windows(stream, "1 hour", late="3650 days").writeStream.outputMode("complete").format("memory").queryName("windows").start()
    running.processAllAvailable()
    running.stop()
    as_rows = lambda df: {(r["event_type"], str(r["starts"]), r["n"], r["total"]) for r in df.selectExpr("event_type", "cast(starts as string) as starts", "n", "total").collect()}
    want = as_rows(events.windows(batch, "1 hour"))
    assert as_rows(spark.table("windows")) == want and want


def test_once_keeps_one_write_of_each_request(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3), (None, 4), (None, 5)], "request string, n int")
    assert events.once(rows, "request").count() == 3
    assert events.sessions(spark.read.parquet(f"{SF}/events.parquet").limit(0), "30 minutes").count() == 0
