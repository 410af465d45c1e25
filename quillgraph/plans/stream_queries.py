"""Queries of the event log: drained streams, and windows as plain aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillgraph.plans.registry import query
from quillgraph.streaming import events as ev


def _log(spark, sf_dir):
    return ev.read_log(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _batch(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))


def _text(c: str):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(c)


@query("SELECT event_id, user_id, event_type FROM events")
def t01_idempotent_log(spark, sf_dir):
    log = _log(spark, sf_dir)
    return ev.drain(ev.deduplicated(log.union(log), ["event_id"], "ts", "60 days")).select("event_id", "user_id", "event_type")


@query("""SELECT user_id, CASE WHEN count(DISTINCT value) = 1 THEN min(value) END AS value, count(DISTINCT value) > 1 AS disputed
FROM events JOIN (SELECT user_id, max(date_trunc('hour', ts)) AS h FROM events GROUP BY user_id) USING (user_id) WHERE date_trunc('hour', ts) = h GROUP BY user_id""")
def t02_latest_value(spark, sf_dir):
    hourly = _log(spark, sf_dir).withColumn("ts", F.date_trunc("hour", "ts"))
    out = ev.drain(ev.latest_values(hourly, "user_id", "ts", "value"), "update")
    last = out.groupBy("user_id").agg(F.max_by(F.struct("value", "disputed"), "batch").alias("x"))
    return last.select("user_id", "x.value", "x.disputed")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def t05_sessions(spark, sf_dir):
    return ev.sessions(_batch(spark, sf_dir), "user_id", "ts", "30 minutes").select("user_id", _text("start"), "n")


@query()
def t05_session_stream(spark, sf_dir):
    return ev.drain(ev.sessions(_log(spark, sf_dir), "user_id", "ts", "30 minutes", "1 hour"))


@query("""SELECT user_id, arg_max(event_type, CASE WHEN event_type = 'purchase' THEN (1, -epoch_us(ts)) ELSE (0, epoch_us(ts)) END) AS event_type FROM events GROUP BY user_id""")
def t06_job_states(spark, sf_dir):
    out = ev.drain(ev.job_states(_log(spark, sf_dir), "user_id", "ts", "event_type", ["purchase"]), "complete")
    return out.where(F.col("batch") == out.agg(F.max("batch")).first()[0]).drop("batch")


@query()
def t07_lockouts(spark, sf_dir):
    """Users locked by three errors within two days of a run's first."""
    return ev.drain(ev.lockouts(_log(spark, sf_dir).where("event_type = 'error'"), "user_id", "ts", 3, 172_800, 86_400))


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def t_tumbling_days(spark, sf_dir):
    return ev.windows(_batch(spark, sf_dir), "ts", "1 day").select(_text("start"), "n", F.round("total", 4).alias("total"))


@query("""SELECT strftime(s, '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT value, unnest([date_trunc('hour', ts), date_trunc('hour', ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1""")
def t_sliding_hours(spark, sf_dir):
    return ev.windows(_batch(spark, sf_dir), "ts", "2 hours", "1 hour").select(_text("start"), "n", F.round("total", 4).alias("total"))
