from pagelens.streaming.captures import first_seen, hourly


def test_windows_and_first_seen(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(1, "2024-01-01 00:10:00", "a", 1.0), (2, "2024-01-01 00:50:00", "a", 2.0), (3, "2024-01-01 03:00:00", "b", 5.0), (1, "2024-01-01 00:10:00", "a", 1.0)]
    df = spark.createDataFrame(rows, "event_id long, ts string, event_type string, value double").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    df.coalesce(1).write.parquet(src)
    stream = spark.readStream.schema(df.schema).parquet(src)
    for name, out in (("w", hourly(stream, "1 hour")), ("f", first_seen(stream, "event_id"))):
        out.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("w").count() >= 1 and spark.table("w").filter("event_type = 'a'").first()["total"] == 4.0
    assert spark.table("f").count() == 3
