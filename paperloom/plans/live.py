"""Streams over the event log and the conversation table, drained with availableNow."""

from __future__ import annotations

from pyspark.sql import functions as F

from paperloom.functions import fixed
from paperloom.operators import risks as R
from paperloom.plans.records import JOBS_SQL, STATES, choose, choose_sql
from paperloom.plans.registry import query
from paperloom.plans.search_risk import INJECTION_SQL, PHRASES, SPOOF
from paperloom.sources.tables import load
from paperloom.streaming import streams as ST


def event_stream(spark, folder):
    return ST.read_stream(spark, folder, "events", load(spark, folder, "events").schema)


@query("SELECT DISTINCT user_id, event_type, k FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS k FROM events)")
def deduplicated_intake(spark, folder):
    keyed = event_stream(spark, folder).withColumn("k", F.get_json_object("props", "$.k").cast("long") % 5)
    return ST.drain(ST.intake(keyed, ["user_id", "event_type", "k"], delay="40 days").select("user_id", "event_type", "k"), "intake")


@query("""
SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, event_type, sum(CAST(round(value * 100) AS BIGINT)) AS units, count(*) AS records
FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY ALL""")
def metered_windows(spark, folder):
    """Windows that the watermark has closed."""
    windows = ST.usage_windows(event_stream(spark, folder), ["event_type"], F.round(F.col("value") * 100).cast("long"))
    return ST.drain(windows, "usage").select(F.date_format("window_start", "yyyy-MM-dd HH:mm").alias("window_start"), "event_type", "units", "records")


@query("WITH " + INJECTION_SQL + " SELECT conv_id, turn, position, category FROM kept")
def live_scan(spark, folder):
    talk = ST.read_stream(spark, folder, "conversations", load(spark, folder, "conversations").schema)
    phrase = choose(PHRASES, F.col("conv_id") * 3 + F.col("turn"))
    many = F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 0), F.repeat(F.lit("do not report x. "), F.lit(30))).otherwise("")
    spoof = F.when((F.col("conv_id") + F.col("turn")) % 4 == 0, "\n" + SPOOF).otherwise("")
    suspect = talk.select("conv_id", "turn", F.concat("text", F.lit("\n"), many, F.lit("\n"), phrase, spoof).alias("text"))
    return ST.scan_stream(suspect, lambda rows: R.scan_injection(rows, "conv_id", "turn").select("conv_id", "turn", "position", "category"), "conv_id", "scan")


# The twins below apply the rules by recursion over each key's events in order.
ORDERED_SQL = "WITH RECURSIVE e AS (SELECT user_id AS key, event_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@query(ORDERED_SQL + """,
s AS (SELECT key, event_id, k, [t] AS times, true AS accepted, 0 AS retry_after FROM e WHERE k = 1
  UNION ALL SELECT key, event_id, k, CASE WHEN len(live) < 3 THEN list_append(live, t) ELSE live END, len(live) < 3, CASE WHEN len(live) < 3 THEN 0 ELSE (live[1] + 7200000000 - t) // 1000000 END
  FROM (SELECT e.key, e.event_id, e.k, e.t, list_filter(s.times, lambda x: x > e.t - 7200000000) AS live FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1))
SELECT key, event_id, accepted, CAST(retry_after AS BIGINT) AS retry_after FROM s""")
def rolling_admission(spark, folder):
    """At most three events per user and two hours."""
    return ST.drain(ST.admit(event_stream(spark, folder), "user_id", 3, 7200), "admission")


MOVES = ", ".join(f"'{a}>{b}'" for a, nexts in fixed.ALLOWED_TRANSITIONS.items() for b in nexts)
EXPIRING = ", ".join(f"'{a}'" for a, nexts in fixed.ALLOWED_TRANSITIONS.items() if "expired" in nexts)
CLOSED = ", ".join(f"'{a}'" for a, nexts in fixed.ALLOWED_TRANSITIONS.items() if not nexts)


@query(f"""
WITH RECURSIVE e AS (SELECT user_id * 100 + event_id % 100 AS key, event_id, epoch_us(ts) AS t, {choose_sql(STATES, 'event_id // 100 + event_id % 3')} AS wanted,
  row_number() OVER (PARTITION BY user_id * 100 + event_id % 100 ORDER BY ts, event_id) AS k FROM events),
s AS (SELECT DISTINCT key, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS event_id, 'draft' AS state, CAST(NULL AS BIGINT) AS deadline, CAST(NULL AS BIGINT) AS closed,
    CAST(NULL AS VARCHAR) AS expired_from, CAST(NULL AS VARCHAR) AS before, CAST(NULL AS VARCHAR) AS wanted, CAST(NULL AS BOOLEAN) AS ok FROM e
  UNION ALL SELECT key, k, event_id, CASE WHEN ok THEN wanted ELSE now_state END, CASE WHEN ok THEN CASE WHEN wanted IN ({EXPIRING}) THEN t + 604800000000 END ELSE now_deadline END,
    CASE WHEN ok THEN CASE WHEN wanted IN ({CLOSED}) THEN t END ELSE now_closed END, expired_from, CASE WHEN wanted <> now_state THEN now_state END, wanted, ok
  FROM (SELECT *, now_state || '>' || wanted IN ({MOVES}) AS ok FROM (
    SELECT *, CASE WHEN shut IS NOT NULL AND t >= shut + 2592000000000 THEN 'draft' WHEN late THEN 'expired' ELSE state END AS now_state,
      CASE WHEN shut IS NOT NULL AND t >= shut + 2592000000000 THEN NULL ELSE shut END AS now_closed, CASE WHEN NOT late THEN deadline END AS now_deadline, CASE WHEN late THEN state END AS expired_from
    FROM (SELECT e.key, e.k, e.event_id, e.t, e.wanted, s.state, s.deadline, coalesce(e.t >= s.deadline, false) AS late, CASE WHEN e.t >= s.deadline THEN s.deadline ELSE s.closed END AS shut
      FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)))),
last AS (SELECT key, arg_max(state, k) AS state, arg_max(coalesce(deadline, -1), k) AS deadline FROM s GROUP BY key)
SELECT key, CAST(NULL AS BIGINT) AS event_id, expired_from AS before, 'expired' AS state, true AS allowed FROM s WHERE expired_from IS NOT NULL
UNION ALL SELECT key, event_id, before, wanted, ok FROM s WHERE before IS NOT NULL
UNION ALL SELECT key, NULL, state, 'expired', true FROM last WHERE deadline >= 0 AND deadline <= (SELECT max(epoch_us(ts)) FROM events) - 3600000000""")
def request_lifecycle(spark, folder):
    e = F.col("event_id")
    steps = event_stream(spark, folder).select((F.col("user_id") * 100 + e % 100).alias("request"), "ts", "event_id", choose(STATES, F.floor(e / 100) + e % 3).alias("state"))
    return ST.drain(ST.lifecycle(steps, "request"), "lifecycle")


@query(ORDERED_SQL + """,
s AS (SELECT key, event_id, k, t AS created, false AS hit FROM e WHERE k = 1
  UNION ALL SELECT e.key, e.event_id, e.k, CASE WHEN e.t <= s.created + 86400000000 THEN s.created ELSE e.t END, e.t <= s.created + 86400000000 FROM s JOIN e ON e.key = s.key AND e.k = s.k + 1)
SELECT key, event_id, hit FROM s""")
def cache_lookups(spark, folder):
    return ST.drain(ST.cache_lookups(event_stream(spark, folder), "user_id"), "lookups")


@query("WITH " + JOBS_SQL + """
SELECT job_id AS key, attempts, CASE WHEN attempts < max_attempts THEN 'queued' ELSE 'failed' END AS next_state FROM jobs
WHERE state = 'processing' AND epoch_ms(locked_at) + 900000 <= epoch_ms((SELECT max(ts) FROM events) - INTERVAL 10 MINUTE)""")
def stalled_watch(spark, folder):
    kind = F.col("event_type")
    status = event_stream(spark, folder).select(
        F.col("event_id").alias("job_id"), "ts", "event_id", F.when(kind == "click", "processing").otherwise("queued").alias("state"),
        (F.col("event_id") % 5).cast("int").alias("attempts"), F.lit(3).alias("max_attempts"))
    return ST.drain(ST.stall_watch(status, "job_id"), "stalls")
