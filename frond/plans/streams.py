"""Queries of event windows, in their batch form."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.plans.registry import query
from frond.sources.tables import load
from frond.streaming import events


def _events(spark, sf_dir):
    return load(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


@query(
    "stream_tumbling",
    """SELECT epoch(time_bucket(INTERVAL 30 MINUTE, ts))::BIGINT AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""",
)
def stream_tumbling(spark, sf_dir):
    t = events.tumbling(_events(spark, sf_dir), "30 minutes")
    return t.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(
    "stream_sliding",
    """SELECT epoch(s)::BIGINT AS start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 15 MINUTE, ts) - to_minutes(15 * k) AS s, ts FROM events, (SELECT unnest([0, 1, 2, 3]) AS k)) GROUP BY 1""",
)
def stream_sliding(spark, sf_dir):
    return events.sliding(_events(spark, sf_dir), "1 hour", "15 minutes").select(F.unix_seconds("start").alias("start"), "n")


@query(
    "session",
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g)
SELECT user_id, epoch_us(min(ts)) AS start, count(*) AS n FROM s GROUP BY user_id, s""",
)
def session(spark, sf_dir):
    return events.sessions(_events(spark, sf_dir), "30 minutes").select("user_id", F.unix_micros("start").alias("start"), "n")
