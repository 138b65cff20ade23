"""Streams give what the batch operators give."""

from pyspark.sql import functions as F

from tessera.operators import serving
from tessera.streaming import limits


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, data, tmp_path):
    events = spark.read.parquet(f"{data}/events.parquet").orderBy("event_id")
    events.coalesce(1).write.parquet(str(tmp_path / "events"))
    return events, spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))


def test_rate_limit(spark, data, tmp_path):
    events, stream = source(spark, data, tmp_path)
    got = run(spark, limits.rate_limited(stream, capacity=2.0, refill=1 / 86400), "limited")
    want = serving.token_bucket(events, capacity=2.0, refill=1 / 86400)
    assert {(r.event_id, r.allowed) for r in got.collect()} == {(r.event_id, r.allowed) for r in want.collect()}


def test_daily_and_windows(spark, data, tmp_path):
    events, stream = source(spark, data, tmp_path)
    got = {str(r.day): r.n for r in run(spark, limits.daily_calls(stream), "daily", "complete").collect()}
    want = {str(r.day): r.n for r in events.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n")).collect()}
    assert got == want
    assert run(spark, limits.windowed(stream, width="1 day"), "windows", "complete").agg(F.sum("n")).first()[0] == events.count()
