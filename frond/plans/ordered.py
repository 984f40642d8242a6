"""Queries of ordered analytics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from frond.operators import windows
from frond.plans.registry import query
from frond.sources.tables import load


@query(
    "pct_rank_group",
    """SELECT o_orderkey, round_even(100.0 * (rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_orderstatus, o_totalprice) - 1) / 2.0) / count(*) OVER (PARTITION BY o_orderstatus), 1)::DOUBLE AS pct FROM orders""",
)
def pct_rank_group(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return windows.percent_rank(o, ["o_orderstatus"], "o_totalprice").select("o_orderkey", F.bround("pct", 1).alias("pct"))


@query(
    "last3_by_time",
    "SELECT user_id, event_id, place FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 3",
)
def last3_by_time(spark, sf_dir):
    """The last three events of every user."""
    e = load(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    return windows.top_n(e, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3).select("user_id", "event_id", F.col("place").cast("long").alias("place"))


@query(
    "renumber_offset",
    """WITH o AS (SELECT user_id, max(event_id % 100) AS m FROM events WHERE event_type = 'view' GROUP BY 1)
SELECT user_id, event_id, coalesce(m, 0) + row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx FROM events LEFT JOIN o USING (user_id) WHERE event_type = 'click'""",
)
def renumber_offset(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    old = e.filter("event_type = 'view'").select("user_id", (F.col("event_id") % 100).alias("idx"))
    new = e.filter("event_type = 'click'").select("user_id", "event_id", "ts")
    return windows.renumbered(new, old, "user_id", [F.col("ts"), F.col("event_id")], "idx").select("user_id", "event_id", "idx")


_DAILY = "WITH d AS (SELECT event_type, (hour(ts) * 1)::BIGINT AS h, count(*)::DOUBLE AS n FROM events GROUP BY 1, 2)"


def _hourly(spark, sf_dir):
    return load(spark, sf_dir, "events").groupBy("event_type", F.hour("ts").cast("long").alias("h")).agg(F.count("*").cast("double").alias("n"))


@query(
    "moving_avg_circular",
    _DAILY + """ SELECT a.event_type, a.h, round(avg(b.n), 6) AS smooth FROM d a JOIN d b ON a.event_type = b.event_type AND ((b.h - a.h + 26) % 24) <= 4 GROUP BY 1, 2""",
)
def moving_avg_circular(spark, sf_dir):
    s = windows.circular_mean(_hourly(spark, sf_dir), ["event_type"], "h", "n", 2)
    return s.select("event_type", "h", F.round("smooth", 6).alias("smooth"))


@query(
    "peaks",
    _DAILY + """ SELECT event_type, h, n FROM (SELECT *, lag(n) OVER w AS a, lead(n) OVER w AS b FROM d WINDOW w AS (PARTITION BY event_type ORDER BY h)) WHERE n > a AND n > b AND n >= 5""",
)
def peaks(spark, sf_dir):
    return windows.peaks(_hourly(spark, sf_dir), ["event_type"], "h", "n", 5.0).select("event_type", "h", "n")


@query(
    "roughness",
    _DAILY + """, s AS (SELECT event_type, n, abs(lead(n) OVER w - 2 * n + lag(n) OVER w) AS s FROM d WINDOW w AS (PARTITION BY event_type ORDER BY h))
SELECT event_type, round(avg(s) / quantile_cont(n, 0.5), 6) AS roughness FROM s GROUP BY 1""",
)
def roughness(spark, sf_dir):
    return windows.roughness(_hourly(spark, sf_dir), ["event_type"], "h", "n").select("event_type", F.round("roughness", 6).alias("roughness"))


@query(
    "angular_gaps",
    """WITH a AS (SELECT DISTINCT p_type, p_size * 7 AS angle FROM part)
SELECT p_type, angle, coalesce(lead(angle) OVER (PARTITION BY p_type ORDER BY angle), min(angle) OVER (PARTITION BY p_type) + 360) - angle AS gap FROM a""",
)
def angular_gaps(spark, sf_dir):
    return _gaps(load(spark, sf_dir, "part"))


def _gaps(part):
    a = part.select("p_type", (F.col("p_size") * 7).alias("angle")).distinct()
    return windows.circular_gaps(a, ["p_type"], "angle", 360).select("p_type", "angle", F.col("gap").cast("int").alias("gap"))


@query(
    "turning_angles",
    """WITH e AS (SELECT event_id, user_id, epoch(ts)::DOUBLE / 1000 AS x, value AS y, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT event_id, x - lag(x, 2) OVER w AS ax, y - lag(y, 2) OVER w AS ay, lead(x, 2) OVER w - x AS bx, lead(y, 2) OVER w - y AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY i))
SELECT event_id, round(atan2(ax * b - ay * bx, ax * bx + ay * b), 5) AS turn FROM s""",
)
def turning_angles(spark, sf_dir):
    return _turns(load(spark, sf_dir, "events"))


def _turns(e):
    e = e.select("event_id", "user_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6 / 1000).alias("x"), F.col("value").alias("y"), F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("i"))
    return windows.turning_angles(e, ["user_id"], "i", "x", "y", 2).select("event_id", F.round("turn", 5).alias("turn"))


@query(
    "autocorrelation",
    _DAILY + """, c AS (SELECT event_type, h, n - avg(n) OVER (PARTITION BY event_type) AS v FROM d), l AS (SELECT unnest([1, 2, 3, 4]) AS lag)
SELECT a.event_type, lag, round(sum(a.v * b.v) / (SELECT sum(v * v) FROM c z WHERE z.event_type = a.event_type), 6) AS r FROM l, c a JOIN c b ON a.event_type = b.event_type WHERE b.h = a.h + lag GROUP BY 1, 2""",
)
def autocorrelation(spark, sf_dir):
    return windows.autocorrelation(_hourly(spark, sf_dir), ["event_type"], "h", "n", 4).select("event_type", "lag", F.round("r", 6).alias("r"))


@query(
    "cumulative_share",
    """SELECT p_type, p_size, sum(n) OVER (PARTITION BY p_type ORDER BY p_size) / sum(n) OVER (PARTITION BY p_type) AS share FROM (SELECT p_type, p_size, count(*) AS n FROM part GROUP BY 1, 2)""",
)
def cumulative_share(spark, sf_dir):
    p = load(spark, sf_dir, "part").groupBy("p_type", "p_size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("p_type")
    return p.select("p_type", "p_size", (F.sum("n").over(w.orderBy("p_size")) / F.sum("n").over(w)).alias("share"))


@query(
    "path_resample",
    _DAILY
    + """, s AS (SELECT event_type, h, h::DOUBLE AS x, n AS y FROM d),
g AS (SELECT *, coalesce(sqrt((x - lag(x) OVER w) ** 2 + (y - lag(y) OVER w) ** 2), 0) AS st FROM s WINDOW w AS (PARTITION BY event_type ORDER BY h)),
c AS (SELECT *, sum(st) OVER (PARTITION BY event_type ORDER BY h) AS a FROM g),
l AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2, lead(a) OVER w AS b, max(a) OVER (PARTITION BY event_type) AS whole FROM c WINDOW w AS (PARTITION BY event_type ORDER BY h)),
i AS (SELECT unnest(range(0, 50)) AS i)
SELECT event_type, i::INT AS i, round(x + (x2 - x) * (i * whole / 49 - a) / (b - a), 6) + 0 AS x, round(y + (y2 - y) * (i * whole / 49 - a) / (b - a), 6) + 0 AS y FROM l, i
WHERE b > a AND i >= ceil(a / (whole / 49) - 1e-9) AND i <= CASE WHEN b >= whole THEN 49 ELSE ceil(b / (whole / 49) - 1e-9) - 1 END""",
)
def path_resample(spark, sf_dir):
    """Fifty points at even distances along each event type's hourly curve."""
    curve = _hourly(spark, sf_dir).select("event_type", F.col("h").alias("place"), F.col("h").cast("double").alias("x"), F.col("n").alias("y"))
    found = windows.resampled(curve, ["event_type"], "place", "x", "y", 50)
    return found.select("event_type", "i", *[(F.round(c, 6) + 0.0).alias(c) for c in ("x", "y")])


@query(
    "worst_in_group",
    """SELECT p_type, (array_agg(p_partkey ORDER BY p_retailprice DESC, p_partkey))[1] AS worst FROM part WHERE p_size > 10 GROUP BY 1""",
)
def worst_in_group(spark, sf_dir):
    return load(spark, sf_dir, "part").filter("p_size > 10").groupBy("p_type").agg(F.min_by("p_partkey", F.struct(-F.col("p_retailprice"), F.col("p_partkey"))).alias("worst"))


@query("grouped_folds", None)
def grouped_folds(spark, sf_dir):
    """Documents by fold; no source is in two folds."""
    return windows.hashed_folds(load(spark, sf_dir, "documents").select("source"), "source", 5).groupBy("fold", "source").agg(F.count("*").alias("n"))
