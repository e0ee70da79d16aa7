"""Queries over the stream of events; the same plans run over tables here."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import jobs
from ..streaming import events as stream
from .catalogue import Tables, query


def _events(t: Tables) -> DataFrame:
    return t.events.withColumn("ts", F.col("ts").cast("timestamp"))


def _shown(df: DataFrame) -> DataFrame:
    return df.withColumns({"window_start": F.date_format("window_start", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "window_end": F.date_format("window_end", "yyyy-MM-dd HH:mm:ss.SSSSSS"), "total": F.round("total", 4)})


TIME = "'%Y-%m-%d %H:%M:%S.%f'"


@query(f"SELECT strftime(time_bucket(INTERVAL 1 HOUR, ts), {TIME}) AS window_start, strftime(time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR, {TIME}) AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def events_tumbling(t: Tables) -> DataFrame:
    return _shown(stream.tumbling(_events(t)))


@query(f"""WITH w AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(unnest([0, 1])) AS s, event_type, value FROM events)
SELECT strftime(s, {TIME}) AS window_start, strftime(s + INTERVAL 2 HOUR, {TIME}) AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM w GROUP BY ALL""")
def events_sliding(t: Tables) -> DataFrame:
    return _shown(stream.sliding(_events(t)))


@query(f"""WITH o AS (SELECT user_id, ts, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS opens FROM events),
s AS (SELECT *, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS session FROM o)
SELECT strftime(min(ts), {TIME}) AS window_start, strftime(max(ts) + INTERVAL 30 MINUTE, {TIME}) AS window_end, user_id, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY user_id, session""")
def events_sessions(t: Tables) -> DataFrame:
    return _shown(stream.sessions(_events(t)))


@query("""
WITH RECURSIVE t AS (SELECT DISTINCT user_id, ts FROM events),
n AS (
    SELECT user_id, ts, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 MINUTE FOLLOWING AND UNBOUNDED FOLLOWING) AS following
    FROM t),
w AS (
    SELECT user_id, min(ts) AS start FROM t GROUP BY user_id
    UNION ALL
    SELECT w.user_id, n.following FROM w JOIN n ON w.user_id = n.user_id AND w.start = n.ts WHERE n.following IS NOT NULL),
s AS (SELECT user_id, start, coalesce(lead(start) OVER (PARTITION BY user_id ORDER BY start), TIMESTAMP 'infinity') AS ends FROM w),
p AS (
    SELECT e.event_id, e.user_id, row_number() OVER (PARTITION BY e.user_id, s.start ORDER BY e.ts, e.event_id) AS place
    FROM events e JOIN s ON e.user_id = s.user_id AND e.ts >= s.start AND e.ts < s.ends)
SELECT event_id, user_id, place, place <= 10 AS allowed FROM p""")
def rate_limit(t: Tables) -> DataFrame:
    """Windows of a minute anchored at a user's first event, ten events each."""
    return stream.rate_limited(_events(t), limit=10)


@query("""
WITH e AS (SELECT user_id AS job_id, ts AS tm, event_id AS seq, event_id % 11 AS done,
                  CASE event_id % 13 WHEN 0 THEN 'queued' WHEN 1 THEN 'queued' WHEN 2 THEN 'cloning' WHEN 3 THEN 'cloning' WHEN 4 THEN 'parsing' WHEN 5 THEN 'parsing' WHEN 6 THEN 'linking'
                       WHEN 7 THEN 'embedding' WHEN 8 THEN 'embedding' WHEN 9 THEN 'summarizing' WHEN 10 THEN 'succeeded' WHEN 11 THEN 'failed' ELSE 'other' END AS event FROM events),
b AS (SELECT * FROM (VALUES ('queued', 0, 0.0, 0.0), ('cloning', 1, 0.0, 0.15), ('parsing', 2, 0.15, 0.5), ('linking', 3, 0.5, 0.55), ('embedding', 4, 0.55, 0.9), ('summarizing', 5, 0.9, 0.98), ('succeeded', 6, 1.0, 1.0), ('failed', 6, NULL, NULL)) b(event, rank, low, high)),
r AS (SELECT e.*, b.rank, CAST(b.low + (b.high - b.low) * least(e.done / 10.0, 1.0) AS DOUBLE) AS share FROM e LEFT JOIN b ON e.event = b.event),
q AS (SELECT *, coalesce(max(CASE WHEN rank = 0 THEN 1 END) OVER w, 0) AS queued FROM r WINDOW w AS (PARTITION BY job_id ORDER BY tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
m AS (SELECT *, max(CASE WHEN queued = 1 OR rank = 0 THEN rank END) OVER w AS reached FROM q WINDOW w AS (PARTITION BY job_id ORDER BY tm, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT *, coalesce(CASE WHEN reached IS NULL THEN rank = 0 ELSE reached < 6 AND rank > 0 AND rank >= reached END, false) AS legal FROM m),
j AS (SELECT job_id, arg_max(event, (tm, seq)) FILTER (legal) AS now, coalesce(max(share) FILTER (legal), 0) AS progress, max(tm) FILTER (legal) AS updated_at, count(*) AS n_events, count(*) FILTER (NOT legal) AS n_illegal FROM l GROUP BY job_id)
SELECT job_id, CASE WHEN now IN ('queued', 'succeeded', 'failed') THEN now WHEN now IS NOT NULL THEN 'running' END AS state,
       CASE WHEN now = 'queued' THEN NULL WHEN now = 'succeeded' THEN 'ready' ELSE now END AS stage, round(progress, 6) AS progress, CAST(updated_at AS VARCHAR) AS updated_at, n_events, n_illegal FROM j""")
def job_states(t: Tables) -> DataFrame:
    """Every user's events read as those of a job, many of them out of order."""
    names = ["queued", "queued", "cloning", "cloning", "parsing", "parsing", "linking", "embedding", "embedding", "summarizing", "succeeded", "failed", "other"]
    event = F.element_at(F.array(*map(F.lit, names)), (F.col("event_id") % 13 + 1).cast("int"))
    rows = t.events.select(F.col("user_id").alias("job_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), event.alias("event"), (F.col("event_id") % 11).alias("done"), F.lit(10).alias("total"))
    found = jobs.job_states(rows)
    return found.withColumns({"progress": F.round("progress", 6), "updated_at": F.col("updated_at").cast("string")})
