"""Keyed-state and streaming queries over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pagemill.operators import state as S
from pagemill.sources.tables import table
from pagemill.streaming import stateful


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most three rows a day for each user."""
    return S.rate_limited(_events(spark, sf_dir), limit=3, window_ms=86_400_000)


def token_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bucket of two tokens that refills by one in five hours."""
    return S.token_bucket(_events(spark, sf_dir), capacity=2, per_second=1 / 18_000)


def event_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.sessions(_events(spark, sf_dir)).select("user_id", F.to_timestamp_ntz(F.date_format("started", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("started"), "n")


def last_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 users that a table of 20 sessions would still hold."""
    return S.last_seen(_events(spark, sf_dir), 20)


def owner_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows for each owner, and owners over a capacity of 60."""
    counts = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("over_capacity", F.col("n") > 60)


def value_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact gauges of a value by kind, as of a delay histogram."""
    return _events(spark, sf_dir).groupBy("event_type").agg(
        F.min("value").alias("least"), F.max("value").alias("most"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("deviation"),
        *[F.round(F.percentile("value", q), 6).alias(f"p{round(100 * q)}") for q in (0.5, 0.95, 0.99)],
    )


_STATUS = "CASE event_id % 5 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' WHEN 2 THEN 'cancelled' WHEN 3 THEN 'input_required' ELSE 'bogus' END"


def task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's rows as updates of one task: the first final state stands."""
    rows = _events(spark, sf_dir).select(F.col("user_id").alias("task_id"), "ts", "event_id", F.expr(_STATUS).alias("status"))
    return S.task_states(rows)


def task_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One page of 50 tasks after an anchor, and one more."""
    return S.page(_events(spark, sf_dir).select("event_id", "user_id"), "event_id", 1000, 50)


def ttl_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_id") % 10 == 0, F.lit(None).cast("double")).otherwise((F.col("event_id") - 500) * 97.5)
    return _events(spark, sf_dir).select("event_id", S.ttl(value).alias("ttl"))


def progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rising values of each user."""
    return S.progress(_events(spark, sf_dir), "user_id", ["ts", "event_id"], "value").select("user_id", "event_id", "value")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks with the purchase that follows within a day."""
    return S.spans(_events(spark, sf_dir), "user_id", "event_type", "click", "purchase")


def request_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of events as starts and ends of requests: those that took an hour at most, and which took more than half of it."""
    starts, ends = stateful.requests_of(_events(spark, sf_dir).withColumn("at", F.col("ts").cast("timestamp")))
    return _told(S.request_spans(starts, ends, within="1 hour", slow_ms=1_800_000))


def stream_request_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a join of two streams."""
    return _told(stateful.request_spans_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", within="1 hour", slow_ms=1_800_000))


def _told(spans: DataFrame) -> DataFrame:
    return spans.select("request_id", F.unix_micros("started").alias("started_us"), F.unix_micros("ended").alias("ended_us"), "ms", "slow")


def task_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of the events, as tasks that began at their time and some of which ended or were delivered, have expired at the end of the month."""
    ms = S.whole_millis(F.col("ts"))
    third = F.col("event_id") % 3
    ended, ttl_ms = F.when(third == 1, ms + 1000), F.when(F.col("event_id") % 5 > 0, F.col("event_id") % 5 * 10_000_000)
    expired = S.is_expired(F.lit(1_706_659_200_000), ms, ended, ttl_ms, F.col("event_id") % 2 == 0)
    return _events(spark, sf_dir).select("event_id", expired.alias("expired"))


def task_cancel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event asks to cancel the task of the event before, half of them for another owner."""
    e = _events(spark, sf_dir)
    tasks = e.select(F.col("event_id").alias("task_id"), F.col("user_id").alias("owner"), F.expr("CASE event_id % 4 WHEN 0 THEN 'completed' WHEN 1 THEN 'failed' ELSE 'working' END").alias("status"))
    own = e.select((F.col("event_id") + 1).alias("request_id"), F.col("event_id").alias("task_id"), (F.col("user_id") + F.col("event_id") % 2).alias("owner"))
    return S.cancelled(tasks, own)


def task_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes of each user's kind of event."""
    return S.status_changes(_events(spark, sf_dir).select("user_id", "event_id", "ts", "event_type"), "user_id", ["ts", "event_id"], "event_type").select("user_id", "event_id", "event_type", "previous")


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How long kinds of events last, and how often more than half a day."""
    return S.stage_times(_events(spark, sf_dir), "user_id", "event_type", budget_s=86_400.0)


def progress_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    stage = F.element_at(F.array(*[F.lit(x) for x in (*S.STAGES, "other")]), (F.col("event_id") % 8 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", S.progress_step(stage).alias("step"))


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and values by kind and hour."""
    return _events(spark, sf_dir).groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v")).select(F.unix_seconds("h").alias("hour"), "event_type", "n", "v")


def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as a stream with a watermark, run over the table and stopped."""
    return stateful.hourly_counts(spark, f"{sf_dir.rstrip('/')}/events.parquet")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rate limit with state kept between batches."""
    return stateful.rate_limit_stream(spark, f"{sf_dir.rstrip('/')}/events.parquet", limit=3, window_ms=86_400_000)


QUERIES = {f.__name__: f for f in (rate_limit, token_bucket, event_sessions, last_seen, owner_counts, value_percentiles, task_states, task_page, ttl_values, progress, event_spans, request_spans, stream_request_spans, task_expiry, task_cancel, task_feed, stage_times, progress_steps, windows, stream_windows, stream_rate_limit)}

_LIMIT = """
WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events),
r AS (SELECT user_id, event_id, ms, rn, ms + 86400000 AS until, 1 AS n FROM e WHERE rn = 1
      UNION ALL SELECT e.user_id, e.event_id, e.ms, e.rn, CASE WHEN e.ms > r.until THEN e.ms + 86400000 ELSE r.until END, CASE WHEN e.ms > r.until THEN 1 ELSE r.n + 1 END FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT user_id, event_id, n <= 3 AS allowed, CASE WHEN n > 3 THEN greatest(1, ceil((until - ms) / 1000.0))::BIGINT END AS retry_after FROM r
"""

SQL = {
    "rate_limit": _LIMIT,
    "stream_rate_limit": _LIMIT,
    "event_sessions": "WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS s FROM o) SELECT user_id, min(ts) AS started, count(*) AS n FROM s GROUP BY user_id, s",
    "last_seen": "SELECT user_id, max(ts) AS last_seen FROM events GROUP BY user_id ORDER BY 2 DESC, 1 LIMIT 20",
    "owner_counts": "SELECT user_id, count(*) AS n, count(*) > 60 AS over_capacity FROM events GROUP BY user_id",
    "value_percentiles": "SELECT event_type, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type",
    "task_states": f"""WITH e AS (SELECT user_id AS task_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, {_STATUS} AS s FROM events),
        f AS (SELECT task_id, min(k) FILTER (WHERE s IN ('completed', 'failed', 'cancelled')) AS k, max(k) FILTER (WHERE s = 'input_required') AS l FROM e WHERE s <> 'bogus' GROUP BY task_id)
        SELECT f.task_id, coalesce(max(e.s) FILTER (WHERE e.k = f.k), max(e.s) FILTER (WHERE e.k = f.l)) AS status, count(*) FILTER (WHERE e.k > f.k) AS n_ignored FROM f JOIN e ON e.task_id = f.task_id AND e.s <> 'bogus' GROUP BY f.task_id""",
    "task_page": "SELECT event_id, user_id FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 51",
    "ttl_values": "WITH v AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE (event_id - 500) * 97.5 END AS v FROM events) SELECT event_id, CASE WHEN v IS NULL THEN 60000 ELSE least(greatest(trunc(v), 1000), 86400000) END::BIGINT AS ttl FROM v",
    "progress": "WITH p AS (SELECT user_id, event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) SELECT user_id, event_id, value FROM p WHERE b IS NULL OR value > b",
    "event_spans": """WITH r AS (SELECT user_id, event_id, ts, event_type FROM events WHERE event_type IN ('click', 'purchase')),
        n AS (SELECT *, lead(event_type) OVER w AS nt, lead(ts) OVER w AS nts FROM r WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
        SELECT user_id, event_id, ts AS started, nts AS ended FROM n WHERE event_type = 'click' AND nt = 'purchase' AND nts <= ts + INTERVAL 1 DAY""",
    "token_bucket": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts), event_id) AS rn FROM events),
        r AS (SELECT user_id, event_id, ms, rn, 1 AS tokens, ms AS last, true AS allowed, 0 AS dropped, 0 AS before FROM e WHERE rn = 1
          UNION ALL SELECT user_id, event_id, ms, rn, t - CASE WHEN t > 0 THEN 1 ELSE 0 END, l, t > 0, CASE WHEN t > 0 THEN 0 ELSE dropped + 1 END, CASE WHEN t > 0 THEN dropped ELSE 0 END
          FROM (SELECT e.user_id, e.event_id, e.ms, e.rn, r.dropped, CASE WHEN e.ms - r.last >= 1000 THEN e.ms ELSE r.last END AS l,
                  CASE WHEN e.ms - r.last >= 1000 THEN least(2, r.tokens + floor((e.ms - r.last)::DOUBLE / 1000::DOUBLE * (1::DOUBLE / 18000::DOUBLE))::INTEGER) ELSE r.tokens END AS t
                FROM r JOIN e ON e.user_id = r.user_id AND e.rn = r.rn + 1))
        SELECT user_id, event_id, allowed, before::BIGINT AS dropped_before FROM r""",
    "task_expiry": """WITH t AS (SELECT event_id, epoch_ms(ts) AS ms, CASE WHEN event_id % 5 > 0 THEN event_id % 5 * 10000000 END AS ttl FROM events)
        SELECT event_id, ttl IS NOT NULL AND CASE WHEN event_id % 3 = 1 THEN 1706659200000 - ms - 1000 > CASE WHEN event_id % 2 = 0 THEN 10000 ELSE ttl END ELSE 1706659200000 - ms > 86400000 END AS expired FROM t""",
    "task_cancel": """SELECT event_id + 1 AS request_id, CASE WHEN event_id % 2 = 1 THEN 'not-found' WHEN event_id % 4 = 0 THEN 'already completed' ELSE 'cancelled' END AS outcome,
        CASE WHEN event_id % 2 = 1 THEN NULL WHEN event_id % 4 = 0 THEN 'completed' ELSE 'cancelled' END AS status FROM events""",
    "task_feed": "WITH p AS (SELECT user_id, event_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous FROM events) SELECT * FROM p WHERE previous IS DISTINCT FROM event_type",
    "stage_times": """WITH d AS (SELECT event_type AS stage, (epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) - epoch_us(ts))::DOUBLE / 1000000::DOUBLE AS s FROM events)
        SELECT stage, count(*) AS n, round(sum(s), 3) AS seconds, count(*) FILTER (WHERE s > 43200) AS n_over FROM d WHERE s IS NOT NULL GROUP BY stage""",
    "progress_steps": "SELECT event_id, CASE WHEN event_id % 8 < 7 THEN event_id % 8 + 1 END::INTEGER AS step FROM events",
    "windows": "SELECT epoch(date_trunc('hour', ts))::BIGINT AS hour, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY 1, 2",
}
SQL["stream_windows"] = SQL["windows"]
SQL["request_spans"] = SQL["stream_request_spans"] = """SELECT s.event_id AS request_id, epoch_us(s.ts) AS started_us, epoch_us(e.ts) AS ended_us, (epoch_us(e.ts) - epoch_us(s.ts)) // 1000 AS ms, (epoch_us(e.ts) - epoch_us(s.ts)) // 1000 > 1800000 AS slow
    FROM events s JOIN events e ON s.event_id % 2 = 0 AND e.event_id = s.event_id + 1 AND e.ts >= s.ts AND e.ts <= s.ts + INTERVAL 1 HOUR"""
