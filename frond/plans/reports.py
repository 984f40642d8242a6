"""Queries of reports on feature tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.operators import project, reports, stats
from frond.plans.images import _PX, _px
from frond.plans.inference import _rank, _t2
from frond.plans.registry import query
from frond.plans.relational import MEASURES
from frond.sources.tables import load

LEVELS = ["healthy", "low", "mid", "high"]
_LEVEL = "CASE l_linenumber WHEN 1 THEN 'healthy' WHEN 2 THEN 'low' WHEN 3 THEN 'mid' WHEN 4 THEN 'high' ELSE 'other' END"
_LONG = f"l AS (SELECT l_returnflag, {_LEVEL} AS level, feature, value FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value))"


def _long(spark, sf_dir):
    k = F.col("l_linenumber")
    level = F.when(k == 1, "healthy").when(k == 2, "low").when(k == 3, "mid").when(k == 4, "high").otherwise("other")
    return project.long_form(load(spark, sf_dir, "lineitem").select("l_returnflag", level.alias("level"), *MEASURES), ["l_returnflag", "level"], MEASURES)


_MEDIANS = ", ".join(f"round(quantile_cont(value, 0.5) FILTER (level = '{k}'), 3) AS median_{k}" for k in LEVELS)
_GAPS = f"""WITH {_LONG}, q AS (SELECT l_returnflag, feature, count(*) FILTER (level = 'healthy') AS n_healthy, count(*) FILTER (level = 'high') AS n_high, {_MEDIANS},
  quantile_cont(value, 0.5) FILTER (level = 'high') - quantile_cont(value, 0.5) FILTER (level = 'healthy') AS gap,
  CASE WHEN count(*) FILTER (level = 'healthy') < 3 THEN quantile_cont(value, 0.75) - quantile_cont(value, 0.25) ELSE quantile_cont(value, 0.75) FILTER (level = 'healthy') - quantile_cont(value, 0.25) FILTER (level = 'healthy') END AS s FROM l GROUP BY 1, 2),
g AS (SELECT l_returnflag, feature, n_healthy, n_high, median_healthy, median_low, median_mid, median_high, round(CASE WHEN s > 1e-6 THEN gap / s END, 2) AS effect FROM q)"""


@query("gap_report_levels", _GAPS + " SELECT * FROM g")
def gap_report_levels(spark, sf_dir):
    """Medians of four levels and the effect of the last against the first, for each flag and measure."""
    return reports.gap_report(_long(spark, sf_dir), "l_returnflag", "level", LEVELS)


@query("weak_features", _GAPS + " SELECT l_returnflag, n_weak, row_number() OVER (ORDER BY n_weak DESC, l_returnflag)::INT AS place FROM (SELECT l_returnflag, count(*) AS n_weak FROM g WHERE abs(effect) < 0.5 GROUP BY 1)")
def weak_features(spark, sf_dir):
    return reports.weak_features(reports.gap_report(_long(spark, sf_dir), "l_returnflag", "level", LEVELS), "l_returnflag")


@query(
    "column_audit_flags",
    f"""WITH t AS (SELECT o_orderstatus, o_orderpriority, o_totalprice AS price, CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey::DOUBLE END AS holes, CASE WHEN o_custkey % 4 > 0 THEN -1.0 ELSE o_totalprice END AS mostly, 7.0::DOUBLE AS same, (o_orderpriority[1:1]::INT * 10 + o_custkey % 13)::DOUBLE AS trend FROM orders),
l AS (FROM t UNPIVOT INCLUDE NULLS (v FOR feature IN (price, holes, mostly, same, trend))),
s AS (SELECT feature, count(*) AS n, 100 * count(*) FILTER (v IS NULL) / count(*) AS null_pct, 100 * count(*) FILTER (v = -1.0) / count(*) AS sentinel_pct, count(DISTINCT v) AS n_distinct, count(*) FILTER (v <> -1.0) AS m FROM l GROUP BY 1),
u AS (SELECT feature, o_orderpriority[1:1]::INT - 1 AS o, v FROM l WHERE v <> -1.0), r AS (SELECT feature, {_rank("o", "feature")} AS ro, {_rank("v", "feature")} AS rv FROM u),
c AS (SELECT feature, corr(ro, rv) AS rho FROM r GROUP BY 1),
k AS (SELECT s.*, CASE WHEN m > 5 AND n_distinct > 1 THEN rho END AS rho FROM s LEFT JOIN c USING (feature))
SELECT feature, n, round(null_pct, 6) AS null_pct, round(sentinel_pct, 6) AS sentinel_pct, n_distinct, round(rho, 6) AS rho, CASE WHEN rho IS NOT NULL THEN round({_t2("(rho * rho * (m - 2) / (1 - rho * rho))", "(m - 2)")}, 6) END AS p,
  CASE WHEN f = '' THEN 'ok' ELSE f END AS flags FROM (SELECT *, concat_ws(',', CASE WHEN n_distinct <= 1 THEN 'CONSTANT' END, CASE WHEN sentinel_pct > 50 THEN 'MOSTLY-SENTINEL' END, CASE WHEN null_pct > 20 THEN 'HIGH-NAN' END, CASE WHEN abs(rho) < 0.05 THEN 'NO-TREND-WITH-LEVEL' END) AS f FROM k)""",
)
def column_audit_flags(spark, sf_dir):
    customer, price, priority = F.col("o_custkey"), F.col("o_totalprice"), F.col("o_orderpriority")
    t = load(spark, sf_dir, "orders").select(
        priority.alias("level"), price.alias("price"), F.when(customer % 3 != 0, customer.cast("double")).alias("holes"), F.when(customer % 4 > 0, -1.0).otherwise(price).alias("mostly"),
        F.lit(7.0).alias("same"), (F.substring(priority, 1, 1).cast("int") * 10 + customer % 13).cast("double").alias("trend"),
    )
    a = reports.column_audit(project.long_form(t, ["level"], ["price", "holes", "mostly", "same", "trend"]), "level", ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"])
    return a.select("feature", "n", F.round("null_pct", 6).alias("null_pct"), F.round("sentinel_pct", 6).alias("sentinel_pct"), "n_distinct", F.round("rho", 6).alias("rho"), F.round("p", 6).alias("p"), "flags")


@query(
    "feature_ranking",
    f"""WITH {_LONG}, s AS (SELECT feature, count(*) FILTER (level = 'healthy') AS na, count(*) FILTER (level = 'high') AS nb, avg(value) FILTER (level = 'healthy') - avg(value) FILTER (level = 'high') AS gap,
  var_samp(value) FILTER (level = 'healthy') AS va, var_samp(value) FILTER (level = 'high') AS vb FROM l GROUP BY 1),
d AS (SELECT feature, gap / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)) AS d FROM s)
SELECT feature, round(d, 9) AS d, row_number() OVER (ORDER BY abs(d) DESC, feature)::INT AS place FROM d ORDER BY place LIMIT 3""",
)
def feature_ranking(spark, sf_dir):
    """A top-n report: the three measures that tell the first line of an order from the fourth best."""
    return reports.ranked_features(_long(spark, sf_dir), "level", "healthy", "high", 3).select("feature", F.round("d", 9).alias("d"), "place")


@query(
    "vote_impact",
    """WITH p AS (SELECT quality::VARCHAR AS t, (doc_id % 3) / 4.0 AS a, (doc_id % 7) / 8.0 AS b, (doc_id % 5) / 8.0 AS c FROM labels),
v AS (SELECT t, CASE WHEN a + b + c > (1 - a) + (1 - b) + (1 - c) THEN '1' ELSE '0' END AS w, CASE WHEN a + c > (1 - a) + (1 - c) THEN '1' ELSE '0' END AS o FROM p),
k AS (SELECT unnest(['0', '1']) AS k), f AS (SELECT k, 2 * count(*) FILTER (t = k AND w = k) / greatest(count(*) FILTER (t = k) + count(*) FILTER (w = k), 1) AS fw, 2 * count(*) FILTER (t = k AND o = k) / greatest(count(*) FILTER (t = k) + count(*) FILTER (o = k), 1) AS fo FROM v, k GROUP BY 1)
SELECT (SELECT count(*) FROM v) AS n, (SELECT count(*) FILTER (w <> o) FROM v) AS n_flipped, round(avg(fw), 9) AS f1_with, round(avg(fo), 9) AS f1_without FROM f""",
)
def vote_impact(spark, sf_dir):
    """What the second of three rules changes in their vote."""
    k, two = F.col("doc_id"), lambda p: F.array(1 - p, p)
    p = load(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("t"), two(k % 3 / 4).alias("a"), two(k % 7 / 8).alias("b"), two(k % 5 / 8).alias("c"))
    v = reports.vote_impact(p, ["a", "b", "c"], "b", ["0", "1"], "t")
    return v.select("n", "n_flipped", F.round("f1_with", 9).alias("f1_with"), F.round("f1_without", 9).alias("f1_without"))


@query(
    "health_report",
    """WITH p AS (SELECT l_orderkey AS leaf_id, CASE WHEN sum(l_quantity) > 100 THEN 'unhealthy' ELSE 'healthy' END AS stage1_pred, round(max(l_discount), 3) AS stage1_p_unhealthy FROM lineitem GROUP BY 1),
r AS (SELECT o_orderkey AS leaf_id, o_orderstatus AS species, CASE WHEN o_orderpriority < '3' THEN 'healthy' ELSE o_orderpriority END AS level, o_totalprice AS severity_score_raw, floor(o_totalprice / 1000) AS health_value, stage1_pred, stage1_p_unhealthy FROM orders LEFT JOIN p ON leaf_id = o_orderkey),
y AS (SELECT *, CASE WHEN level = 'healthy' THEN 'healthy' ELSE 'unhealthy' END AS y_true FROM r)
SELECT leaf_id, species, level, y_true, health_value, CASE WHEN stage1_pred IS NOT NULL THEN round_even(100.0 * (rank() OVER (PARTITION BY stage1_pred ORDER BY health_value) + (count(*) OVER (PARTITION BY stage1_pred, health_value) - 1) / 2.0) / count(*) OVER (PARTITION BY stage1_pred), 1)::DOUBLE END AS health_percentile_in_group,
  severity_score_raw, stage1_pred, stage1_p_unhealthy, coalesce(y_true = stage1_pred, false) AS stage1_correct FROM y""",
)
def health_report(spark, sf_dir):
    """Orders as scores, and what their lines predict beside them."""
    price, priority = F.col("o_totalprice"), F.col("o_orderpriority")
    scores = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("leaf_id"), F.col("o_orderstatus").alias("species"), F.when(priority < "3", "healthy").otherwise(priority).alias("level"), price.alias("severity_score_raw"), F.floor(price / 1000).cast("double").alias("health_value"))
    lines = load(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("leaf_id")).agg(F.when(F.sum("l_quantity") > 100, "unhealthy").otherwise("healthy").alias("stage1_pred"), F.round(F.max("l_discount"), 3).alias("stage1_p_unhealthy"))
    return reports.health_report(scores, lines)


@query(
    "histogram_density",
    """WITH b AS (SELECT event_type, least(floor(value / 2.5) + 1, 40)::INT AS bin FROM events WHERE value >= 0 AND value <= 100), c AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY 1, 2),
e AS (SELECT event_type, unnest(range(1, 41))::INT AS bin FROM (SELECT DISTINCT event_type FROM c)), f AS (SELECT e.*, coalesce(n, 0) / sum(coalesce(n, 0)) OVER (PARTITION BY event_type) AS share FROM e LEFT JOIN c USING (event_type, bin))
SELECT event_type, round(max(share / 2.5), 9) AS top_density, round(-sum(share * ln(share + 1e-8)), 6) AS nats FROM f GROUP BY 1""",
)
def histogram_density(spark, sf_dir):
    """The highest density, and the entropy in nats, of each event type's values."""
    h = reports.density(stats.histogram(load(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 100.0, 40), 0.0, 100.0, 40)
    top = h.groupBy("event_type").agg(F.round(F.max("density"), 9).alias("top_density"))
    return top.join(reports.natural_entropy(h, ["event_type"]), "event_type").select("event_type", "top_density", F.round("entropy", 6).alias("nats"))


@query(
    "zone_means",
    f"""WITH {_PX}, m AS (SELECT vec_id, avg(y) AS cy, avg(x) AS cx FROM px WHERE v > 0 GROUP BY 1), d AS (SELECT vec_id, v, sqrt((y - cy) ** 2 + (x - cx) ** 2) AS d FROM px JOIN m USING (vec_id) WHERE v > 0),
r AS (SELECT vec_id, v, d / (max(d) OVER (PARTITION BY vec_id) + 1e-6) AS r FROM d)
SELECT vec_id, round(coalesce(avg(v) FILTER (r < 0.4), 0), 6) AS "inner", round(coalesce(avg(v) FILTER (r >= 0.6), 0), 6) AS "outer" FROM r GROUP BY 1""",
)
def zone_means(spark, sf_dir):
    z = reports.zones(_px(spark, sf_dir).filter("v > 0"), "vec_id", "v")
    return z.select("vec_id", F.round("inner", 6).alias("inner"), F.round("outer", 6).alias("outer"))


@query(
    "wax_index",
    "SELECT p_partkey, round(((1 - p_size * 5 / 255) + (1 - (p_partkey % 256) / 255) + least(greatest((p_retailprice / 900 - 1) / 1.5, 0), 1)) / 3, 9) AS wax FROM part",
)
def wax_index(spark, sf_dir):
    p = load(spark, sf_dir, "part")
    return p.select("p_partkey", F.round(reports.wax_index(F.col("p_size") * 5, F.col("p_partkey") % 256, F.col("p_retailprice") / 900), 9).alias("wax"))


@query(
    "composite_keys",
    r"""SELECT page_id, page_id || '__v' || (page_id % 7) AS sample, 'p' || (page_id % 5) || '_top_' || regexp_extract(url, '([^/\\]*)$', 1) AS image, 'p' || (page_id % 5) || '__low__' || regexp_extract(url, '([^/\\]+?)(\.[^./\\]*)?$', 1) AS leaf FROM pages""",
)
def composite_keys(spark, sf_dir):
    """Keys of pages made as those of leaves and images are."""
    k, species = F.col("page_id"), F.concat(F.lit("p"), (F.col("page_id") % 5).cast("string"))
    return load(spark, sf_dir, "pages").select(
        "page_id", project.sample_id(k, k % 7).alias("sample"), project.image_key(species, F.lit("top"), F.col("url")).alias("image"), project.leaf_key(species, F.lit("low"), F.col("url")).alias("leaf")
    )
