"""Queries of leaf colour: three values of an embedding are a pixel, and all pixels of one label an image."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.operators import tissue
from frond.plans.registry import query
from frond.sources.tables import load

_BYTE = "least(greatest(round((v + 0.4) / 0.8 * 255), 0), 255)"
_LINEAR = "CASE WHEN {c} / 255 <= 0.04045 THEN {c} / 255 / 12.92 ELSE ((({c} / 255) + 0.055) / 1.055) ** 2.4 END"
_ROOT = "CASE WHEN {t} > 0.008856 THEN cbrt({t}) ELSE 7.787 * {t} + 16 / 116 END"
_8BIT = "least(greatest(round({x}), 0), 255)"
_PIXELS = f"""e AS (SELECT label, vec_id AS y, (i - 1) // 3 AS x, (i - 1) % 3 AS k, {_BYTE} AS v FROM (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) WHERE i <= 63),
rgb AS (SELECT label, y, x, max(v) FILTER (k = 0) AS r, max(v) FILTER (k = 1) AS g, max(v) FILTER (k = 2) AS u FROM e GROUP BY 1, 2, 3),
lin AS (SELECT *, {_LINEAR.format(c="r")} AS lr, {_LINEAR.format(c="g")} AS lg, {_LINEAR.format(c="u")} AS lu FROM rgb),
xyz AS (SELECT *, (0.412453 * lr + 0.357580 * lg + 0.180423 * lu) / 0.950456 AS tx, 0.212671 * lr + 0.715160 * lg + 0.072169 * lu AS ty, (0.019334 * lr + 0.119193 * lg + 0.950227 * lu) / 1.088754 AS tz FROM lin),
px AS (SELECT label, y, x, {_8BIT.format(x="2.55 * CASE WHEN ty > 0.008856 THEN 116 * cbrt(ty) - 16 ELSE 903.3 * ty END")} AS l,
  {_8BIT.format(x=f"500 * (({_ROOT.format(t='tx')}) - ({_ROOT.format(t='ty')})) + 128")} AS a, {_8BIT.format(x=f"200 * (({_ROOT.format(t='ty')}) - ({_ROOT.format(t='tz')})) + 128")} AS b,
  CASE WHEN greatest(r, g, u) > 0 THEN {_8BIT.format(x="(greatest(r, g, u) - least(r, g, u)) / greatest(r, g, u) * 255")} ELSE 0 END AS s, 2 * g - r - u AS ex FROM xyz)"""
_SEED = """s1 AS (SELECT label, y, x FROM px WHERE ex > 20 AND s > 25 AND l < 130), n AS (SELECT label, count(*) AS area FROM px GROUP BY 1),
weak AS (SELECT label FROM n LEFT JOIN (SELECT label, count(*) AS k FROM s1 GROUP BY 1) USING (label) WHERE 100 * coalesce(k, 0) / area < 1),
seed AS (SELECT label, y, x, false AS relaxed FROM s1 WHERE label NOT IN (FROM weak) UNION ALL SELECT label, y, x, true FROM px WHERE label IN (FROM weak) AND ex > 8 AND s > 15 AND l < 150),
st AS (SELECT label, count(*) AS n, avg(l) AS ml, avg(a) AS ma, avg(b) AS mb, greatest(stddev_pop(l), 8) AS sl, greatest(stddev_pop(a), 8) AS sa, greatest(stddev_pop(b), 8) AS sb FROM px JOIN seed USING (label, y, x) GROUP BY 1),
model AS (SELECT label, coalesce(n, 0) AS n, CASE WHEN n >= 50 THEN ml ELSE 100 END AS ml, CASE WHEN n >= 50 THEN ma ELSE 115 END AS ma, CASE WHEN n >= 50 THEN mb ELSE 130 END AS mb,
  CASE WHEN n >= 50 THEN sl ELSE 20 END AS sl, CASE WHEN n >= 50 THEN sa ELSE 10 END AS sa, CASE WHEN n >= 50 THEN sb ELSE 10 END AS sb FROM (SELECT DISTINCT label FROM px) LEFT JOIN st USING (label))"""


def pixels(spark, sf_dir):
    """(label, y, x, r, g, b_) with bytes from the values of -0.4 to 0.4."""
    e = load(spark, sf_dir, "embeddings").select("label", F.col("vec_id").alias("y"), F.col("embedding").cast("array<double>").alias("e"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("x"))
    byte = lambda k: F.least(F.greatest(F.round((F.get("e", F.col("x") * 3 + k) + 0.4) / 0.8 * 255), F.lit(0.0)), F.lit(255.0))
    return tissue.coloured(e.select("label", "y", "x", byte(0).alias("r"), byte(1).alias("g"), byte(2).alias("b_")))


@query("tissue_seed", f"WITH {_PIXELS}, {_SEED} SELECT label, relaxed, count(*) AS n, sum(y * 100 + x)::BIGINT AS places FROM seed GROUP BY 1, 2")
def tissue_seed(spark, sf_dir):
    """How many sure pixels each image has, and by which rule."""
    found = tissue.seed(pixels(spark, sf_dir), "label", opening=False)
    return found.groupBy("label", "relaxed").agg(F.count("*").alias("n"), F.sum(F.col("y") * 100 + F.col("x")).alias("places"))


@query(
    "tissue_candidates",
    f"""WITH {_PIXELS}, {_SEED}
SELECT label, model.n AS n_seed, round(any_value(ml), 6) AS mean_l, round(any_value(sb), 6) AS std_b, count(*) AS n, round(avg(l), 6) AS lightness FROM px JOIN model USING (label)
WHERE greatest(abs(l - ml) / sl, abs(a - ma) / sa, abs(b - mb) / sb) < 2.5 AND s >= 25 AND NOT (s < 30 AND l > 160) GROUP BY 1, 2""",
)
def tissue_candidates(spark, sf_dir):
    """The learned colour of each image's seed, and the pixels near it."""
    px = pixels(spark, sf_dir)
    model = tissue.colour_model(px, "label", tissue.seed(px, "label", opening=False, keep=tissue.CHANNELS))
    found = tissue.candidates(px, "label", model).groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("lightness"), 6).alias("lightness"))
    return found.join(model.select("label", F.col("n").alias("n_seed"), F.round("mean_lightness", 6).alias("mean_l"), F.round("std_b", 6).alias("std_b")), "label")


@query(
    "px_damage_rules",
    f"""WITH {_PIXELS}, g AS (SELECT label, count(*) AS n, quantile_cont(l, 0.5) AS al, quantile_cont(b, 0.5) AS ab FROM px WHERE s > 60 AND a < 118 AND l > 40 AND l < 170 GROUP BY 1),
c AS (SELECT px.*, CASE WHEN l < 90 AND s < 90 THEN 'necrotic' WHEN b > 150 AND a > 118 AND (n IS NULL OR n < 200 OR b > ab + 12) THEN 'chlorotic' WHEN l > 225 AND s < 40 THEN 'specular'
  WHEN l > 170 AND s < 60 AND (n IS NULL OR n < 200 OR l > al + 15) THEN 'pale' ELSE 'healthy' END AS t FROM px LEFT JOIN g USING (label))
SELECT label, round(avg((t = 'necrotic')::INT) * 100, 6) AS pct_necrotic, round(avg((t = 'chlorotic')::INT) * 100, 6) AS pct_chlorotic, round(avg((t = 'pale')::INT) * 100, 6) AS pct_pale, round(avg((t IN ('healthy', 'specular'))::INT) * 100, 6) AS pct_healthy,
  quantile_cont(a, 0.5) AS a_median, quantile_cont(a, 0.75) - quantile_cont(a, 0.25) AS a_iqr, quantile_cont(b, 0.5) AS b_median, quantile_cont(b, 0.75) - quantile_cont(b, 0.25) AS b_iqr FROM c GROUP BY 1""",
)
def px_damage_rules(spark, sf_dir):
    """Shares of damaged tissue, and the spread of colour, of each image."""
    px = pixels(spark, sf_dir)
    found = tissue.colour_health(px, "label", px)
    return found.select("label", *[F.round(c, 6).alias(c) for c in found.columns if c.startswith("pct")], "a_median", "a_iqr", "b_median", "b_iqr")
