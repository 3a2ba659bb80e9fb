"""Sessions of the stream against those of the batch."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from loomdoc.operators import logs
from loomdoc.plans import service
from loomdoc.streaming import live


def batch(events):
    rows = logs.sessionize(events, "user_id", "ts").select("user_id", F.unix_micros(F.col("session_start").cast("timestamp")), F.unix_micros(F.col("session_end").cast("timestamp")), "events")
    return sorted(map(tuple, rows.collect()))


def streamed(df):
    return sorted(map(tuple, df.select("user_id", "started", "ended", "events").collect()))


def test_closed_and_open_sessions_equal_the_batch(spark, sf):
    assert streamed(service.live_sessions(spark, sf)) == batch(spark.read.parquet(f"{sf}/events.parquet"))


def test_gaps_open_and_late_sessions(spark, tmp_path):
    t = datetime(2024, 1, 1)
    at = [(1, 0), (1, 3600), (1, 7201), (2, 5 * 86400), (3, 60), (None, 5), (4, None)]
    events = spark.createDataFrame([(u, None if s is None else t + timedelta(seconds=s)) for u, s in at], "user_id long, ts timestamp")
    events.write.parquet(str(tmp_path / "events.parquet"))
    got = streamed(live.sessions(spark, str(tmp_path)))
    assert [(u, n) for u, _, _, n in got] == [(1, 2), (1, 1), (2, 1), (3, 1)]
    assert got == batch(events)
