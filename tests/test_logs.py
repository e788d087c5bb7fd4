"""Log lines, events and their summaries; a stream gives what the batch gives."""

from pyspark.sql import functions as F

from quadloom.streaming import logs


def frame(spark, *lines):
    return spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "i int, line string")


def test_clean_lines(spark):
    got = logs.clean_lines(frame(spark, "a\r\n", "b\n", "\r\n", "", "c\n\r\n", "d\r\r", " e ")).orderBy("i")
    assert [r["line"] for r in got.collect()] == ["a", "b", "c\n", "d", " e "]


def test_decode_lossily(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xff!"),)], "raw binary")
    assert logs.decode_lines(df).first()["line"] == "ok�!"


EVENTS = [
    "2024-05-01T10:00:00Z [supervisor] service=api event=spawn pid=7 restarts=0",
    "2024-05-01T10:00:05Z [supervisor] service=api event=exit code=2 runtime_ms=1200 restart_in_ms=1000",
    "2024-05-01T10:00:06Z [api] plain text with event words",
    "2024-05-01T10:00:09Z [supervisor] service=api event=exit signal=unknown runtime_ms=4000 restart_in_ms=1000",
    "2024-05-01T10:00:10Z [supervisor] service=web event=poll-failed error=no such file restart_in_ms=1000",
    "broken line",
]


def test_events(spark):
    parsed = logs.parse_log(spark.createDataFrame([(l,) for l in EVENTS], "value string"))
    assert parsed.count() == 5
    events = logs.parse_events(parsed).cache()
    rows = {(r["service"], r["event"], r["code"], r["runtime_ms"], r["error"]) for r in events.collect()}
    assert rows == {("api", "spawn", None, None, None), ("api", "exit", 2, 1200, None), ("api", "exit", None, 4000, None),
                    ("web", "poll-failed", None, None, "no such file")}
    stats = {r["service"]: r for r in logs.restart_stats(events).collect()}
    assert (stats["api"]["exits"], stats["api"]["fast_failures"], stats["api"]["total_runtime_ms"]) == (2, 1, 5200)
    assert stats["api"]["last_code"] is None and stats["web"]["exits"] == 0
    last = {r["service"]: r["event"] for r in logs.latest_status(events).collect()}
    assert last == {"api": "exit", "web": "poll-failed"}


def test_backoff(spark):
    cases = [(100, 0, 1000), (100, 1, 1000), (100, 2, 2000), (100, 3, 3000), (100, 9, 5000), (3000, 9, 1000), (2999, 4, 5000)]
    df = spark.createDataFrame(cases, "ms int, n int, want int")
    assert df.filter(logs.backoff(F.col("ms"), F.col("n")) != F.col("want")).isEmpty()


def test_tail_survives_new_batches(spark, tmp_path):
    inbox = tmp_path / "in"
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    schema = "at timestamp, seq int"
    for first in (0, 100):
        rows = spark.range(first, first + 50).select(
            F.timestamp_seconds(F.col("id") * 60).alias("at"), F.col("id").cast("int").alias("seq"))
        rows.write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(schema).parquet(str(inbox))
        kept = logs.run_tail(stream, out, checkpoint, 20, ("at", "seq"))
    assert sorted(r["seq"] for r in kept.collect()) == list(range(130, 150))


def test_event_rates_are_bounded_by_a_watermark(spark, tmp_path):
    rows = spark.range(100).select(F.timestamp_seconds(F.col("id") * 3600).alias("at"), F.lit("a").alias("service"),
                                   F.lit("x").alias("event"))
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    rates = logs.event_rates(stream, "1 day", "1 hour")
    query = (rates.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).outputMode("append")
             .trigger(availableNow=True).start(str(tmp_path / "out")))
    query.awaitTermination()
    # the last, still open day is held back by the watermark
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("events")).first()[0] == 96
    assert logs.event_rates(rows).agg(F.sum("events")).first()[0] == 100
