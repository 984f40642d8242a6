"""Queries of sketches, grouping sets, tiles and range frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.operators import sketches
from frond.plans.registry import query
from frond.sources.tables import load


@query(
    "approx_distinct",
    """SELECT o_orderstatus, count(DISTINCT o_custkey) AS customers, true AS close FROM orders GROUP BY 1
UNION ALL SELECT 'all', count(DISTINCT o_custkey), true FROM orders""",
)
def approx_distinct(spark, sf_dir):
    """Exact distinct customers by status and over all, and whether the merged sketches are within five standard errors."""
    o = load(spark, sf_dir, "orders")
    own = sketches.distinct_sketches(o, ["o_orderstatus"], "o_custkey")
    every = sketches.merged(own, []).select(F.lit("all").alias("o_orderstatus"), "sketch")
    about = sketches.estimates(own.unionByName(every))
    exact = o.groupBy("o_orderstatus").agg(F.countDistinct("o_custkey").alias("customers")).unionByName(o.agg(F.countDistinct("o_custkey").alias("customers")).withColumn("o_orderstatus", F.lit("all")))
    return exact.join(about, "o_orderstatus").select("o_orderstatus", "customers", (F.abs(F.col("distinct") / F.col("customers") - 1) < 0.08).alias("close"))


@query(
    "grouping_sets",
    """SELECT l_returnflag, l_linestatus, l_linenumber, GROUPING_ID(l_returnflag, l_linestatus, l_linenumber)::BIGINT AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag, l_linestatus), (l_returnflag, l_linenumber), (l_linenumber), ())""",
)
def grouping_sets(spark, sf_dir):
    columns = ["l_returnflag", "l_linestatus", "l_linenumber"]
    sets = [["l_returnflag", "l_linestatus"], ["l_returnflag", "l_linenumber"], ["l_linenumber"], []]
    return sketches.grouping_sets(load(spark, sf_dir, "lineitem"), columns, sets, {"n": F.count("*"), "quantity": F.round(F.sum("l_quantity"), 2)})


@query("value_tiles", "SELECT p_type, p_partkey, ntile(7) OVER (PARTITION BY p_type ORDER BY p_size, p_partkey)::INT AS tile FROM part")
def value_tiles(spark, sf_dir):
    """Seven equal parts of each type's parts by size."""
    p = load(spark, sf_dir, "part").select("p_type", "p_size", "p_partkey")
    return sketches.tiles(p, ["p_type"], "p_size", "p_partkey", 7).select("p_type", "p_partkey", "tile")


@query(
    "trailing_day",
    """SELECT event_id, count(*) OVER w AS n, round(sum(value) OVER w, 6) AS total FROM events
WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 86400000000 PRECEDING AND CURRENT ROW)""",
)
def trailing_day(spark, sf_dir):
    """Events of the same user within a day before each event."""
    e = load(spark, sf_dir, "events").select("event_id", "user_id", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return sketches.trailing(e, ["user_id"], "us", 86_400_000_000, {"n": F.count("*"), "total": F.sum("value")}).select("event_id", "n", F.round("total", 6).alias("total"))
