"""Keyed-state operators over event tables: rate limits, token buckets, sessions, task life cycles, paging.

What needs a fold is dealt by key and ordered by Spark, and folded batch by batch with the open key's few numbers carried along,
so a key may hold any number of rows. All else is aggregates, windows and joins.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

# Life-cycle states, and those that are final.
TASK_STATES = ("working", "input_required", "completed", "failed", "cancelled")
FINAL_STATES = ("completed", "failed", "cancelled")
DEFAULT_TTL_MS, LEAST_TTL_MS, MOST_TTL_MS = 60_000, 1_000, 86_400_000


def whole_millis(ts: Column) -> Column:
    """Milliseconds of a time, the nearest whole number, halves away from zero, as ``epoch_ms`` of SQL."""
    return (F.round(F.unix_micros(ts.cast("timestamp")), -3) / 1000).cast("long")


def _folded(rows: DataFrame, key: str, tie: str, start, step, schema: str, columns: list[str]) -> DataFrame:
    """``step(state, ms)`` over each key's rows in order of (ms, tie); ``start()`` is a key's first state. ``step`` gives the next state and the row's values."""

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_, state = None, None
        for f in frames:
            out = []
            for k, now in zip(f[key].tolist(), f["ms"].tolist()):
                if k != open_:
                    open_, state = k, start()
                state, values = step(state, now)
                out.append(values)
            done = f[[key, tie]].reset_index(drop=True)
            for i, c in enumerate(columns):
                done[c] = pd.array([x[i] for x in out], "Int64") if c != "allowed" else [x[i] for x in out]
            yield done

    dealt = rows.repartition(key).sortWithinPartitions(key, "ms", tie)
    return dealt.mapInPandas(fold, schema)


def _stamped(events: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    return events.select(key, tie, whole_millis(F.col(ts)).alias("ms")).where(F.col(key).isNotNull() & F.col("ms").isNotNull())


def rate_limited(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", limit: int = 100, window_ms: int = 60_000) -> DataFrame:
    """(key, tie, allowed, retry_after): a window opens at a key's first row, and anew at the first row later than its end.

    Rows beyond ``limit`` in a window are refused until it ends; ``retry_after`` is in seconds. A key's state is the end and the count of its window.
    """

    def step(state, now):
        end, count = state
        if end is None or now > end:
            end, count = now + window_ms, 0
        count += 1
        return (end, count), (count <= limit, None if count <= limit else max(1, -(-(end - now) // 1000)))

    return _folded(_stamped(events, key, ts, tie), key, tie, lambda: (None, 0), step, f"{key} long, {tie} long, allowed boolean, retry_after long", ["allowed", "retry_after"])


def token_bucket(events: DataFrame, key: str = "user_id", ts: str = "ts", tie: str = "event_id", capacity: int = 200, per_second: float = 50.0) -> DataFrame:
    """(key, tie, allowed, dropped_before): a bucket refills in whole tokens once a second or more has passed since it last did.

    ``dropped_before`` is the number of refused rows right before an allowed one. A key's state is its tokens, its last refill and that number.
    """

    def step(state, now):
        tokens, last, dropped = state
        last = now if last is None else last
        if now - last >= 1000:
            tokens, last = min(capacity, tokens + int((now - last) / 1000 * per_second)), now
        if tokens > 0:
            return (tokens - 1, last, 0), (True, dropped)
        return (tokens, last, dropped + 1), (False, 0)

    return _folded(_stamped(events, key, ts, tie), key, tie, lambda: (capacity, None, 0), step, f"{key} long, {tie} long, allowed boolean, dropped_before long", ["allowed", "dropped_before"])


def sessions(events: DataFrame, key: str = "user_id", ts: str = "ts", idle: str = "30 minutes") -> DataFrame:
    """(key, started, ended, n): runs of a key's rows no further apart than ``idle``; ``ended`` is the last row plus ``idle``."""
    stamped = events.select(key, F.col(ts).cast("timestamp").alias("ts"))
    grouped = stamped.groupBy(key, F.session_window("ts", idle).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return grouped.select(key, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n")


def last_seen(events: DataFrame, most: int, key: str = "user_id", ts: str = "ts") -> DataFrame:
    """The ``most`` keys seen last; what a bounded session table would still hold."""
    return events.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(ts).alias("last_seen")).orderBy(F.desc("last_seen"), key).limit(most)


def task_states(events: DataFrame, task: str = "task_id", order: tuple[str, ...] = ("ts", "event_id"), status: str = "status") -> DataFrame:
    """(task, status, n_ignored): the first final status stands; before one, the last known status does. Unknown states are ignored.

    Aggregates only, so a busy task is combined before the shuffle.
    """
    known = events.where(F.col(status).isin(*TASK_STATES))
    at = F.struct(*order)
    final = F.min(F.when(F.col(status).isin(*FINAL_STATES), F.struct(at.alias("at"), F.col(status).alias("s"))))
    latest = F.max(F.when(~F.col(status).isin(*FINAL_STATES), F.struct(at.alias("at"), F.col(status).alias("s"))))
    found = known.groupBy(task).agg(final.alias("f"), latest.alias("l"), F.max(at).alias("end"))
    late = known.join(found.where("f IS NOT NULL").select(task, F.col("f.at").alias("at")), task).where(F.struct(*order) > F.col("at")).groupBy(task).agg(F.count(F.lit(1)).alias("n"))
    return found.join(late, task, "left").select(task, F.coalesce("f.s", "l.s").alias("status"), F.coalesce("n", F.lit(0)).alias("n_ignored"))


def ttl(value: Column) -> Column:
    """Milliseconds to live: whole, within bounds, by default a minute."""
    fine = value.isNotNull() & ~F.isnan(value.cast("double")) & (F.abs(value.cast("double")) != float("inf"))
    return F.when(fine, F.least(F.greatest(F.floor(F.abs(value)) * F.signum(value), F.lit(LEAST_TTL_MS)), F.lit(MOST_TTL_MS))).otherwise(F.lit(DEFAULT_TTL_MS)).cast("long")


def page(table: DataFrame, order: str, after, size: int) -> DataFrame:
    """One keyset page: rows beyond ``after`` in order, one more than ``size`` so that a next page shows."""
    rest = table if after is None else table.where(F.col(order) > F.lit(after))
    return rest.orderBy(order).limit(size + 1)


def _unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores until no column is called so."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def progress(events: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Only the rows on which a key's value exceeds all before."""
    before = F.max(value).over(Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    name = _unused(events, "_before")
    return events.withColumn(name, before).where(F.col(name).isNull() | (F.col(value) > F.col(name))).drop(name)


def spans(events: DataFrame, key: str, kind: str, start: str, end: str, ts: str = "ts", tie: str = "event_id", within: str = "1 day") -> DataFrame:
    """(key, tie, started, ended): each start row with the first end row of its key after it and before the next start, within a time."""
    rows = events.where(F.col(kind).isin(start, end))
    w = Window.partitionBy(key).orderBy(ts, tie)
    following = rows.withColumn("_next", F.lead(kind).over(w)).withColumn("_at", F.lead(ts).over(w))
    fits = (F.col(kind) == start) & (F.col("_next") == end) & (F.col("_at") <= F.col(ts) + F.expr(f"INTERVAL {within}"))
    return following.where(fits).select(key, tie, F.col(ts).alias("started"), F.col("_at").alias("ended"))


# Fixed value: milliseconds beyond which a request is slow.
SLOW_REQUEST_MS = 5_000


def request_spans(starts: DataFrame, ends: DataFrame, request: str = "request_id", within: str = "1 hour", slow_ms: int = SLOW_REQUEST_MS) -> DataFrame:
    """(request, started, ended, ms, slow) of ``starts(request, started)`` and ``ends(request, ended)``, timestamps: each request that ends within a time.

    Tables or streams. Streams need watermarks on both times: the bound on the time between them then lets either side forget what can no longer
    meet its partner, rows within the watermark are never lost, and a batch leaves out those behind the watermark of the batch
    before it, which is that of the slower stream. Rows without request or time meet nothing; a request that starts or ends more than once
    has a row for each start and end that lie within the time.
    """
    a, b = starts.select(F.col(request).alias(request), "started"), ends.select(F.col(request).alias("_ended_request"), "ended")
    met = a.join(b, (F.col(request) == F.col("_ended_request")) & (F.col("ended") >= F.col("started")) & (F.col("ended") <= F.col("started") + F.expr(f"INTERVAL {within}")))
    ms = F.floor((F.unix_micros("ended") - F.unix_micros("started")) / 1000)
    return met.select(request, "started", "ended", ms.alias("ms"), (ms > slow_ms).alias("slow"))


# Fixed value: milliseconds that a delivered result is still kept.
DELIVERY_GRACE_MS = 10_000


def is_expired(now: Column, created: Column, ended: Column, ttl_ms: Column, delivered: Column) -> Column:
    """Whether a task is past its time, all in milliseconds: counted from its end, shorter once delivered; one that never ends lives a day; without a time to live none expires."""
    left = F.when(delivered, F.least(ttl_ms, F.lit(DELIVERY_GRACE_MS))).otherwise(ttl_ms)
    return F.coalesce(ttl_ms.isNotNull() & F.when(ended.isNotNull(), now - ended > left).otherwise(now - created > MOST_TTL_MS), F.lit(False))


def cancelled(tasks: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, outcome, status) of ``requests(request_id, task_id, owner)`` on ``tasks(task_id, owner, status)``: only an owner's own unfinished task is cancelled."""
    found = requests.join(tasks, ["task_id", "owner"], "left")
    final = F.col("status").isin(*FINAL_STATES)
    outcome = F.when(F.col("status").isNull(), "not-found").when(final, F.concat(F.lit("already "), F.col("status"))).otherwise("cancelled")
    return found.select("request_id", outcome.alias("outcome"), F.when(final, F.col("status")).when(F.col("status").isNotNull(), "cancelled").alias("status"))


def status_changes(events: DataFrame, task: str, order: list[str], status: str) -> DataFrame:
    """The rows on which a task's status differs from the one before, and the first."""
    before = F.lag(status).over(Window.partitionBy(task).orderBy(*order))
    name = _unused(events, "_before")
    return events.withColumn(name, before).where(~F.col(name).eqNullSafe(F.col(status))).withColumnRenamed(name, "previous")


def stage_times(events: DataFrame, key: str, stage: str, ts: str = "ts", tie: str = "event_id", budget_s: float = 30.0, warn: float = 0.5) -> DataFrame:
    """(stage, n, seconds, n_over): a stage lasts until the key's next row; ``n_over`` took more than the ``warn`` share of the budget."""
    w = Window.partitionBy(key).orderBy(ts, tie)
    lasted = (F.unix_micros(F.lead(F.col(ts).cast("timestamp")).over(w)) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    rows = events.select(F.col(stage).alias("stage"), lasted.alias("s")).where("s IS NOT NULL")
    return rows.groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("s"), 3).alias("seconds"), F.count_if(F.col("s") > warn * budget_s).alias("n_over"))


# The stages of a request, in order; a progress report names the step.
STAGES = ("preparing", "resolve_url", "fetch_remote", "response_ready", "transform_start", "prepare_output", "finalize")


def progress_step(stage: Column) -> Column:
    """The step, from 1, of a stage; null for unknown ones."""
    return F.nullif(F.array_position(F.array(*[F.lit(s) for s in STAGES]), stage), F.lit(0)).cast("int")
