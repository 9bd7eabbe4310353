"""Structured Streaming forms of the event operators. Each runs over what its source holds and stops."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from pagemill.operators import state as S

WATERMARK = "31 days"


def _folder(spark: SparkSession, name: str) -> str:
    """A folder of its own under spark.checkpoint.dir, which driver and executors share; a temporary one only where that is unset, in local mode."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="pagemill-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/pagemill-stream/{name}-{uuid.uuid4().hex}"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event files under ``path`` as a stream with event time ``at``."""
    schema = spark.read.parquet(path).schema
    folder, name = path.rsplit("/", 1)  # the source lists a folder; the table may be one file or a folder of its own
    rows = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{folder}/{name[0]}[{name[1]}]{name[2:]}")
    return rows.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", WATERMARK)


def drained(stream: DataFrame, name: str, mode: str) -> DataFrame:
    """The rows that the stream has written when all available input is worked."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession, name)
    out = f"{folder}/out"
    batches: list[int] = []
    if mode == "complete":  # a file sink has no complete mode: each batch has a folder of its own, and the last one is the result

        def keep(df: DataFrame, number: int) -> None:
            df.write.mode("overwrite").parquet(f"{out}/{number}")
            batches.append(number)

        writer = stream.writeStream.outputMode(mode).foreachBatch(keep)
    else:
        writer = stream.writeStream.outputMode(mode).format("parquet").option("path", out)
    query = writer.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    if mode == "complete" and not batches:
        return spark.createDataFrame([], stream.schema)
    return spark.read.schema(stream.schema).parquet(f"{out}/{max(batches)}" if batches else out)


def hourly_counts(spark: SparkSession, path: str) -> DataFrame:
    """(hour, event_type, n, v) by tumbling windows of event time."""
    counts = event_stream(spark, path).groupBy(F.window("at", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return drained(counts.select(F.unix_seconds("w.start").alias("hour"), "event_type", "n", "v"), "hourly", "complete")


def requests_of(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``starts`` and ``ends`` of ``events(event_id, at)``: an even event starts a request, which the next one ends."""
    starts = events.where("event_id % 2 = 0").select(F.col("event_id").alias("request_id"), F.col("at").alias("started"))
    return starts, events.where("event_id % 2 = 1").select((F.col("event_id") - 1).alias("request_id"), F.col("at").alias("ended"))


def request_spans_stream(spark: SparkSession, path: str, within: str = "1 hour", slow_ms: int = S.SLOW_REQUEST_MS) -> DataFrame:
    """``state.request_spans`` as a join of two streams: starts and ends come in any order within the watermark, and each pair is told once both are there."""
    starts, ends = requests_of(event_stream(spark, path))[0], requests_of(event_stream(spark, path))[1]
    return drained(S.request_spans(starts, ends, within=within, slow_ms=slow_ms), "requests", "append")


def rate_limit_stream(spark: SparkSession, path: str, limit: int = 100, window_ms: int = 60_000) -> DataFrame:
    """(user_id, event_id, allowed, retry_after): the rate limit with a user's window kept as state; idle users are dropped after two windows."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        end, count = state.get if state.exists else (-1, 0)
        # one file of events a batch bounds what a key can have here; rows come unordered
        rows = pd.concat(list(frames)).sort_values(["ms", "event_id"], ignore_index=True)
        out = []
        for now, event in zip(rows["ms"].tolist(), rows["event_id"].tolist()):
            if now > end:
                end, count = now + window_ms, 0
            count += 1
            out.append((key[0], event, count <= limit, None if count <= limit else max(1, -(-(end - now) // 1000))))
        state.update((end, count))
        state.setTimeoutTimestamp(max(end + window_ms, state.getCurrentWatermarkMs() + 1))
        frame = pd.DataFrame(out, columns=["user_id", "event_id", "allowed", "retry_after"])
        frame["retry_after"] = frame["retry_after"].astype("Int64")
        yield frame

    rows = event_stream(spark, path).where("user_id IS NOT NULL").select("user_id", "event_id", "at", S.whole_millis(F.col("at")).alias("ms"))
    schema = "user_id long, event_id long, allowed boolean, retry_after long"
    return drained(rows.groupBy("user_id").applyInPandasWithState(fold, schema, "until long, n int", "append", GroupStateTimeout.EventTimeTimeout), "rate", "append")
