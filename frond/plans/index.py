"""Queries of composite indices, and the flagship report."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.functions import scalars
from frond.operators import index, joins, project, stats, windows
from frond.plans.registry import query
from frond.sources.tables import load

_FEATURES = ["quantity", "price", "discount"]
_WEIGHTS = {"worst_quantity": 0.5, "worst_price": 0.3, "worst_discount": 0.2}
_FUSED_SQL = """WITH v AS (SELECT l_partkey, l_linestatus, avg(l_quantity) AS quantity, max(l_extendedprice) AS price, avg(l_discount) AS discount FROM lineitem GROUP BY 1, 2),
f AS (SELECT p_type, t.l_partkey, p_size <= 10 AS healthy, greatest(t.quantity, b.quantity) AS worst_quantity, greatest(t.price, b.price) AS worst_price, greatest(t.discount, b.discount) AS worst_discount
  FROM v t JOIN v b ON t.l_partkey = b.l_partkey AND t.l_linestatus = 'O' AND b.l_linestatus = 'F' JOIN part ON p_partkey = t.l_partkey),
"""


def _fused(spark, sf_dir):
    """One row a part with both views: the worse side of each feature, its type, and whether it belongs to the baseline."""
    li = load(spark, sf_dir, "lineitem")
    views = li.groupBy("l_partkey", "l_linestatus").agg(F.avg("l_quantity").alias("quantity"), F.max("l_extendedprice").alias("price"), F.avg("l_discount").alias("discount"))
    fused = joins.fused_views(views.filter("l_linestatus = 'O'"), views.filter("l_linestatus = 'F'"), "l_partkey", _FEATURES)
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type", (F.col("p_size") <= 10).alias("healthy"))
    return fused.join(part, "l_partkey").select("p_type", "l_partkey", "healthy", *_WEIGHTS)


def _with_z(fused, bound=5.0):
    """robust z of every worst_ feature against the healthy rows of its type."""
    x = {f: F.when(F.col("healthy"), F.col(f)) for f in _WEIGHTS}
    aggs = []
    for f, v in x.items():
        q1, q2, q3 = stats.quartiles(v)
        aggs += [q2.alias(f"m_{f}"), (q3 - q1).alias(f"s_{f}")]
    base = fused.groupBy("p_type").agg(*aggs)
    z = {f: scalars.clip((F.col(f) - F.col(f"m_{f}")) / F.col(f"s_{f}"), -bound, bound).alias(f"z_{f}") for f in _WEIGHTS}
    return fused.join(joins.bounded_broadcast(base), "p_type").select("p_type", "l_partkey", *z.values())


_Z_SQL = (
    _FUSED_SQL
    + "b AS (SELECT p_type, "
    + ", ".join(f"quantile_cont({f}, 0.5) FILTER (healthy) AS m_{f}, quantile_cont({f}, 0.75) FILTER (healthy) - quantile_cont({f}, 0.25) FILTER (healthy) AS s_{f}" for f in _WEIGHTS)
    + " FROM f GROUP BY 1),\nz AS (SELECT p_type, l_partkey, "
    + ", ".join(f"least(greatest(coalesce(({f} - m_{f}) / s_{f}, 0), -5), 5) AS z_{f}" for f in _WEIGHTS)
    + " FROM f JOIN b USING (p_type))\n"
)


@query(
    "fused_index_report",
    _Z_SQL
    + """, s AS (SELECT p_type, l_partkey, 0.5 * z_worst_quantity + 0.3 * z_worst_price + 0.2 * z_worst_discount AS s FROM z), m AS (SELECT p_type, min(s) AS lo, max(s) AS hi FROM s GROUP BY 1),
i AS (SELECT p_type, l_partkey, round(least(greatest(100 * (s - lo) / greatest(hi - lo, 1e-6), 0), 100), 4) AS health_index FROM s JOIN m USING (p_type))
SELECT p_type, l_partkey, health_index, round_even(100.0 * (rank() OVER (PARTITION BY p_type ORDER BY health_index) + (count(*) OVER (PARTITION BY p_type, health_index) - 1) / 2.0) / count(*) OVER (PARTITION BY p_type), 1)::DOUBLE AS percentile,
CASE WHEN health_index < 8 THEN 'healthy' WHEN health_index < 25 THEN 'low' WHEN health_index < 50 THEN 'mid' ELSE 'high' END AS level FROM i""",
)
def fused_index_report(spark, sf_dir):
    """Two views joined, robust z against each type's baseline, a weighted index, and every part's percentile in its type."""
    z = _with_z(_fused(spark, sf_dir))
    score = sum((F.col(f"z_{f}") * w for f, w in _WEIGHTS.items()), F.lit(0.0))
    s = z.select("p_type", "l_partkey", score.alias("s"))
    bounds = s.groupBy("p_type").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    scaled = index.weighted_index({"s": F.col("s")}, {"s": 1.0}, F.col("lo"), F.col("hi"))
    i = s.join(joins.bounded_broadcast(bounds), "p_type").select("p_type", "l_partkey", F.round(scaled, 4).alias("health_index"))
    ranked = windows.percent_rank(i, ["p_type"], "health_index", "percentile")
    return ranked.select("p_type", "l_partkey", "health_index", F.bround("percentile", 1).alias("percentile"), scalars.levels(F.col("health_index")).alias("level"))


@query(
    "index_breakdown",
    _Z_SQL
    + """, l AS (UNPIVOT (SELECT l_partkey, 0.5 * z_worst_quantity AS z_worst_quantity, 0.3 * z_worst_price AS z_worst_price, 0.2 * z_worst_discount AS z_worst_discount FROM z) ON z_worst_quantity, z_worst_price, z_worst_discount INTO NAME feature VALUE v),
p AS (SELECT l_partkey, feature, greatest(v, 0) AS p, sum(greatest(v, 0)) OVER (PARTITION BY l_partkey) AS t FROM l)
SELECT l_partkey, feature, round(CASE WHEN t < 1e-6 THEN 0 ELSE 100 * p / t END, 4) AS percentage FROM p""",
)
def index_breakdown(spark, sf_dir):
    z = _with_z(_fused(spark, sf_dir))
    long = project.long_form(z, ["l_partkey"], [f"z_{f}" for f in _WEIGHTS])
    weight = project.lookup(F.col("feature"), {f"z_{f}": w for f, w in _WEIGHTS.items()})
    return index.breakdown(long, "l_partkey", weight, 12).select("l_partkey", "feature", F.round("percentage", 4).alias("percentage"))


@query("symptoms", None)
def symptoms(spark, sf_dir):
    """Each part's symptoms as a sorted array of structs."""
    z = _with_z(_fused(spark, sf_dir))
    long = project.long_form(z, ["l_partkey"], [f"z_{f}" for f in _WEIGHTS])
    weight = project.lookup(F.col("feature"), {f"z_{f}": w for f, w in _WEIGHTS.items()})
    labels = spark.createDataFrame([(f"z_{f}", project_name, "trade") for f, project_name in zip(_WEIGHTS, ("Quantity", "Price", "Discount"))], "feature string, label string, group string")
    return index.symptoms(index.breakdown(long, "l_partkey", weight), "l_partkey", labels)


@query(
    "category_contrib_top5",
    """WITH t AS (UNPIVOT (SELECT l_quantity * 2.0 AS l_quantity, l_extendedprice * -0.01 AS l_extendedprice, l_discount * 300 AS l_discount, l_tax * -200 AS l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE v),
s AS (SELECT CASE WHEN feature = 'l_quantity' THEN 'size' WHEN feature = 'l_extendedprice' THEN 'price' ELSE 'rates' END AS category, sum(v) AS total FROM t GROUP BY 1)
SELECT category, round(abs(100 * total / (SELECT sum(abs(total)) FROM s)), 3) AS percentage FROM s ORDER BY abs(total) DESC LIMIT 5""",
)
def category_contrib_top5(spark, sf_dir):
    """A top-k report: the five categories with the largest contributions."""
    coef = {"l_quantity": 2.0, "l_extendedprice": -0.01, "l_discount": 300.0, "l_tax": -200.0}
    long = project.long_form(load(spark, sf_dir, "lineitem").select(*[(F.col(c) * w).alias(c) for c, w in coef.items()]), [], list(coef))
    c = index.contributions(long, project.lookup(F.col("feature"), {"l_quantity": "size", "l_extendedprice": "price"}, "rates"), 9)
    return c.orderBy(F.abs("total").desc()).limit(5).select("category", F.round(F.abs("percentage"), 3).alias("percentage"))


@query(
    "ldsi_score",
    """WITH s AS (SELECT l_partkey, avg(l_quantity) AS a, CASE WHEN l_partkey % 5 = 0 THEN -1.0 ELSE avg(l_discount) * 1000 END AS b, max(l_tax) * 500 AS c, (l_partkey % 3) / 200.0 AS h FROM lineitem GROUP BY 1),
g AS (SELECT l_partkey, h, least(greatest(CASE WHEN b = -1 THEN a ELSE (a + b) / 2 END, 0), 100) AS g1, least(greatest(c, 0), 100) AS g2 FROM s)
SELECT l_partkey, round(CASE WHEN h > 0 THEN greatest((g1 + g2) / 2, 8 + least(h / 0.015, 1) * 22) ELSE (g1 + g2) / 2 END, 5) AS ldsi FROM g""",
)
def ldsi_score(spark, sf_dir):
    s = load(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.avg("l_quantity").alias("a"), F.avg("l_discount").alias("d"), F.max("l_tax").alias("t"))
    b = F.when(F.col("l_partkey") % 5 == 0, F.lit(-1.0)).otherwise(F.col("d") * 1000)
    groups = [index.sub_score(F.col("a"), b), index.sub_score(F.col("t") * 500)]
    return s.select("l_partkey", F.round(index.severity(groups, (F.col("l_partkey") % 3) / 200.0), 5).alias("ldsi"))


@query(
    "worst_side_mismatch",
    """WITH v AS (SELECT conv_id, count(*) FILTER (role = 'user') AS t, count(*) FILTER (role = 'assistant') AS b FROM conversations GROUP BY 1)
SELECT count(*) FILTER (t >= b) AS top_worst, count(*) FILTER (t < b) AS bottom_worst, count(*) FILTER (abs(t - b) > 1) AS mismatch, round(100.0 * count(*) FILTER (abs(t - b) > 1) / count(*), 6) AS mismatch_pct FROM v""",
)
def worst_side_mismatch(spark, sf_dir):
    v = load(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count_if(F.col("role") == "user").alias("t"), F.count_if(F.col("role") == "assistant").alias("b"))
    far = F.count_if(F.abs(F.col("t") - F.col("b")) > 1)
    return v.agg(F.count_if(F.col("t") >= F.col("b")).alias("top_worst"), F.count_if(F.col("t") < F.col("b")).alias("bottom_worst"), far.alias("mismatch"), F.round(100.0 * far / F.count("*"), 6).alias("mismatch_pct"))


@query("ridge_weights", None)
def ridge_weights(spark, sf_dir):
    """Weights of a non-negative ridge from three features to the retail price, as rows."""
    part = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), ((F.col("p_retailprice") - 900) / 100).alias("y"))
    z = _with_z(_fused(spark, sf_dir)).join(part, "l_partkey")
    w = index.non_negative_ridge(z, [f"z_{f}" for f in _WEIGHTS], "y")
    return spark.createDataFrame(sorted(w.items()), "feature string, weight double")
