"""Spans of requests: tables against pairs by hand, streams against tables, late rows."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from pagemill.operators import state as S
from pagemill.streaming import stateful

DAY = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long"


def written(spark, folder, files):
    """Files of an event table, each newer than the one before."""
    path = f"{folder}/events.parquet"
    for n, rows in enumerate(files):
        part = f"{folder}/part{n}"
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(part)
        os.makedirs(path, exist_ok=True)
        name = next(x for x in os.listdir(part) if x.endswith(".parquet"))
        os.rename(f"{part}/{name}", f"{path}/{n}.parquet")
        os.utime(f"{path}/{n}.parquet", (1_700_000_000 + n, 1_700_000_000 + n))
    return path


def told(spans):
    return sorted((r["request_id"], r["ms"], r["slow"]) for r in spans.collect())


def test_spans_by_hand(spark):
    at = lambda s: DAY + dt.timedelta(seconds=s)
    starts = [(1, at(0), "x"), (2, at(0), "x"), (3, at(0), "x"), (4, at(9), "x"), (None, at(0), "x"), (5, None, "x"), (6, at(0), "x"), (7, at(0), "x"), (7, at(2), "x")]
    ends = [(1, at(2), 200), (2, at(5.001), 200), (3, at(3600), 200), (4, at(8), 200), (None, at(1), 200), (5, at(1), 200), (7, at(3), 200), (7, at(3601), 500)]
    a = spark.createDataFrame(starts, "request_id long, started timestamp, ended string")
    b = spark.createDataFrame(ends, "request_id long, ended timestamp, started int")
    want = sorted((i, round((e - s).total_seconds() * 1000), (e - s).total_seconds() > 5) for i, s, _ in starts for j, e, _ in ends if i == j and None not in (i, s, e) and s <= e <= s + dt.timedelta(hours=1))
    assert told(S.request_spans(a, b)) == want and len(want) == 6
    assert S.request_spans(a.limit(0), b).count() == S.request_spans(a, b.limit(0)).count() == 0


def test_stream_equals_table(spark, tmp_path):
    rng = random.Random(5)
    rows = []
    for n in range(600):
        start = DAY + dt.timedelta(minutes=rng.randint(0, 20 * 24 * 60))
        rows += [(2 * n, start, n % 5), (2 * n + 1, start + dt.timedelta(seconds=rng.randint(-60, 5000)), n % 5)]
    rng.shuffle(rows)
    path = written(spark, tmp_path, [rows[:500], rows[500:501], rows[501:]])
    starts, ends = stateful.requests_of(spark.read.parquet(path).withColumn("at", F.col("ts").cast("timestamp")))
    want = told(S.request_spans(starts, ends))
    assert told(stateful.request_spans_stream(spark, path)) == want and 200 < len(want) < 600


def test_late_rows_meet_nothing(spark, tmp_path):
    """A start that waits is met by an end in a later file; rows behind the watermark are left out, though a table would pair them."""
    late = DAY + dt.timedelta(days=100)
    # the watermark is that of the slower stream: 99 is an end, so that both have come this far
    first = [(0, late, 1), (2, late - dt.timedelta(days=30), 1), (99, late, 1)]
    second = [(1, late + dt.timedelta(seconds=7), 1), (3, late - dt.timedelta(days=30) + dt.timedelta(seconds=1), 1)]
    # the pair 4, 5 lies more than 31 days behind what has been seen; a batch leaves out what is behind the watermark of the batch before it
    third = [(4, DAY, 1), (5, DAY + dt.timedelta(seconds=1), 1)]
    path = written(spark, tmp_path, [first, second, third])
    assert told(stateful.request_spans_stream(spark, path)) == [(0, 7000, True), (2, 1000, False)]
    starts, ends = stateful.requests_of(spark.read.parquet(path).withColumn("at", F.col("ts").cast("timestamp")))
    assert told(S.request_spans(starts, ends)) == [(0, 7000, True), (2, 1000, False), (4, 1000, False)]


def test_streamed_times_are_the_nearest_milliseconds(spark, tmp_path):
    at = lambda us: DAY + dt.timedelta(microseconds=us)
    path = written(spark, tmp_path, [[(0, at(0), 1), (1, at(500), 1), (2, at(0), 2), (3, at(499), 2)]])
    got = stateful.rate_limit_stream(spark, path, limit=1, window_ms=60_001)
    assert {r["event_id"]: r["retry_after"] for r in got.collect()} == {0: None, 1: 60, 2: None, 3: 61}
