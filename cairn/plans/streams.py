"""Queries: streams, run once over what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..streaming import stateful
from .registry import query


def _log(t, name: str):
    """A base table as a stream, be it one file or a folder of files. A stream's path that is no pattern has to be a folder, hence
    the brackets, which match one letter."""
    return t._spark.readStream.schema(getattr(t, name).schema).parquet(f"{t._dir}/{name}.parque[t]")


def _events(t):
    return _log(t, "events")


@query("s_touch_stream", """WITH RECURSIVE log AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  acc(user_id, n, last, k) AS (SELECT user_id, n, ts, CAST(1 AS BIGINT) FROM log WHERE n = 1
   UNION ALL SELECT l.user_id, l.n, CASE WHEN l.ts - INTERVAL 300 SECOND > a.last THEN l.ts ELSE a.last END, a.k + CASE WHEN l.ts - INTERVAL 300 SECOND > a.last THEN 1 ELSE 0 END
   FROM acc a JOIN log l ON l.user_id = a.user_id AND l.n = a.n + 1)
  SELECT user_id, max(k) AS accepted, max(last) AS last FROM acc GROUP BY user_id""")
def _(t):
    out = stateful.run_once(stateful.touches(_events(t), "user_id", "ts"), "touches", "update")
    return out.groupBy("user_id").agg(F.max("accepted").alias("accepted"), F.max("last").alias("last"))


@query("s_staging_stream", "SELECT hash, CASE max(CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 ELSE 2 END) WHEN 0 THEN 'requested' WHEN 1 THEN 'staging' ELSE 'complete' END AS status FROM (SELECT CAST(user_id AS VARCHAR) || '-' || CAST(event_id % 40 AS VARCHAR) AS hash, event_type FROM events) x GROUP BY hash")
def _(t):
    status = F.when(F.col("event_type") == "view", "requested").when(F.col("event_type") == "click", "staging").otherwise("complete")
    events = _events(t).select(F.concat(F.col("user_id").cast("string"), F.lit("-"), (F.col("event_id") % 40).cast("string")).alias("hash"), status.alias("status"), "ts")
    out = stateful.run_once(stateful.staging(events, "hash", "status", "ts"), "staging", "update")
    rank = F.array_position(F.array(F.lit("requested"), F.lit("staging"), F.lit("complete")), F.col("status"))
    return out.groupBy("hash").agg(F.max_by("status", rank).alias("status"))


@query("s_breaker_stream", """SELECT user_id, CAST(max_by(n, (ts, event_id)) AS BIGINT) AS failures, max_by(n, (ts, event_id)) >= 2 AS open
  FROM (SELECT user_id, ts, event_id, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n
    FROM (SELECT *, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM events) x) y GROUP BY user_id""")
def _(t):
    log = _events(t).withColumn("failed", F.col("event_type") == "error")
    return stateful.run_once(stateful.breakers(log, "user_id", "ts", "failed", 2, then="event_id"), "breakers", "update")


@query("s_progressive_stream", """SELECT conv_id AS nar_file_id, count(*) FILTER (WHERE turn = rn) AS ready FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS rn
  FROM conversations WHERE NOT (turn = 1 AND conv_id % 2 = 1)) x GROUP BY conv_id""")
def _(t):
    parts = _log(t, "conversations").where("not (turn = 1 and conv_id % 2 = 1)").select(F.col("conv_id").alias("nar_file_id"), F.col("turn").alias("chunk_index"))
    out = stateful.run_once(stateful.progressive(parts), "progressive", "update")
    return out.groupBy("nar_file_id").agg(F.max("ready").alias("ready"))


@query("x_windowed_stream", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    out = stateful.run_once(stateful.windowed(_events(t), "ts", "1 hour", "10 minutes", "event_type"), "windows", "complete")
    return out.groupBy("event_type").agg(F.sum("n").alias("n"))
