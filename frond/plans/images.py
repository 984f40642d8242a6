"""Queries over small images: the 64 values of an embedding are an 8 x 8 image."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.operators import joins, kernels, pixels
from frond.plans.registry import query
from frond.sources.tables import load

LOW, HIGH, LEVELS = -0.4, 0.4, 8
_PX = "px AS (SELECT vec_id, ((i - 1) // 8)::INT AS y, ((i - 1) % 8)::INT AS x, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"
_LEVEL = "least(greatest(floor((v - -0.4) / (0.4 - -0.4) * 8), 0), 7)::INT"


def _px(spark, sf_dir):
    return pixels.pixel_table(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


def _levels(spark, sf_dir):
    return _px(spark, sf_dir).withColumn("level", pixels.grey_level(F.col("v"), LOW, HIGH, LEVELS))


@query("px_coverage", f"WITH {_PX} SELECT vec_id, count(*) FILTER (v > 0) AS n, avg((v > 0)::INT)::DOUBLE AS coverage FROM px GROUP BY 1")
def px_coverage(spark, sf_dir):
    return pixels.coverage(_px(spark, sf_dir), "vec_id", F.col("v") > 0)


@query(
    "px_otsu",
    f"""WITH {_PX}, h AS (SELECT vec_id, {_LEVEL} AS level, count(*)::DOUBLE AS n FROM px GROUP BY 1, 2),
c AS (SELECT vec_id, level, sum(n) OVER u AS w0, sum(n * level) OVER u AS s0, sum(n) OVER w AS wt, sum(n * level) OVER w AS st FROM h WINDOW w AS (PARTITION BY vec_id), u AS (PARTITION BY vec_id ORDER BY level)),
b AS (SELECT vec_id, level, round(CASE WHEN wt > w0 THEN w0 * (wt - w0) * (s0 / w0 - (st - s0) / (wt - w0)) * (s0 / w0 - (st - s0) / (wt - w0)) ELSE 0 END, 6) AS v FROM c)
SELECT vec_id, (array_agg(level ORDER BY v DESC, level))[1] AS threshold FROM b GROUP BY 1""",
)
def px_otsu(spark, sf_dir):
    return pixels.otsu(_px(spark, sf_dir), "vec_id", pixels.grey_level(F.col("v"), LOW, HIGH, LEVELS), LEVELS)


@query(
    "px_glcm",
    f"""WITH {_PX}, l AS (SELECT vec_id, y, x, {_LEVEL} AS level FROM px), p AS (SELECT a.vec_id, a.level AS i, b.level AS j FROM l a JOIN l b ON a.vec_id = b.vec_id AND a.y = b.y AND b.x = a.x + 1),
e AS (SELECT vec_id, i, j FROM p UNION ALL SELECT vec_id, j, i FROM p), g AS (SELECT vec_id, i, j, count(*) / sum(count(*)) OVER (PARTITION BY vec_id) AS p FROM e GROUP BY 1, 2, 3),
s AS (SELECT vec_id, sum(p * (i - j) * (i - j)) AS contrast, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sqrt(sum(p * p)) AS energy, sum(p * i) AS m, sum(p * i * i) AS q, sum(p * i * j) AS c FROM g GROUP BY 1)
SELECT vec_id, round(contrast, 6) AS contrast, round(homogeneity, 6) AS homogeneity, round(energy, 6) AS energy, round(CASE WHEN q - m * m > 1e-12 THEN (c - m * m) / (q - m * m) ELSE 1 END, 6) + 0::DOUBLE AS correlation FROM s""",
)
def px_glcm(spark, sf_dir):
    g = pixels.cooccurrence(_levels(spark, sf_dir), "vec_id", "level", 0, 1)
    t = pixels.texture(g, "vec_id")
    return t.select("vec_id", *[(F.round(c, 6) + 0.0).alias(c) for c in ("contrast", "homogeneity", "energy", "correlation")])  # no negative zero


@query(
    "px_mirror_iou",
    f"""WITH {_PX}, p AS (SELECT vec_id, y, x FROM px WHERE v > 0), b AS (SELECT a.vec_id, count(*) AS both_n FROM p a JOIN p b ON a.vec_id = b.vec_id AND a.y = b.y AND a.x = 7 - b.x GROUP BY 1)
SELECT vec_id, round(coalesce(max(both_n), 0) / (2 * count(*) - coalesce(max(both_n), 0)), 9) AS iou FROM p LEFT JOIN b USING (vec_id) GROUP BY 1""",
)
def px_mirror_iou(spark, sf_dir):
    return pixels.mirror_iou(_px(spark, sf_dir), "vec_id", F.col("v") > 0, 8).select("vec_id", F.round("iou", 9).alias("iou"))


@query("px_projection", f"WITH {_PX} SELECT vec_id, y, round(avg(v), 7) AS mean FROM px GROUP BY 1, 2")
def px_projection(spark, sf_dir):
    return pixels.projection(_px(spark, sf_dir), "vec_id", "y").select("vec_id", "y", F.round("mean", 7).alias("mean"))


@query(
    "px_centroid",
    f"""WITH {_PX} SELECT vec_id, count(*) AS area, round(avg(y), 7) AS cy, round(avg(x), 7) AS cx, min(y) AS "top", max(y) AS bottom, min(x) AS "left", max(x) AS "right" FROM px WHERE v > 0 GROUP BY 1""",
)
def px_centroid(spark, sf_dir):
    c = pixels.centroid(_px(spark, sf_dir), "vec_id", F.col("v") > 0)
    return c.select("vec_id", "area", F.round("cy", 7).alias("cy"), F.round("cx", 7).alias("cx"), "top", "bottom", "left", "right")


@query(
    "px_local_contrast",
    f"""WITH {_PX}, o AS (SELECT i, j FROM (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j)), l AS (SELECT px.vec_id, px.y, px.x, stddev_pop(n.v) AS s FROM px, o, px n WHERE n.vec_id = px.vec_id AND n.y = px.y + i AND n.x = px.x + j GROUP BY 1, 2, 3)
SELECT vec_id, round(var_pop(s), 8) AS contrast_variance FROM l GROUP BY 1""",
)
def px_local_contrast(spark, sf_dir):
    return pixels.local_spread(_px(spark, sf_dir), "vec_id", 1).select("vec_id", F.round("contrast_variance", 8).alias("contrast_variance"))


@query(
    "px_illumination",
    f"""WITH {_PX}, t AS (SELECT vec_id, y // 4 AS ty, x // 4 AS tx, quantile_cont(v + 0.5, 0.9) AS light FROM px GROUP BY 1, 2, 3)
SELECT px.vec_id, round(avg((v + 0.5) * least(greatest(0.7 / greatest(light, 1e-6), 0.6), 1.8)), 6) AS mean FROM px JOIN t ON px.vec_id = t.vec_id AND y // 4 = ty AND x // 4 = tx GROUP BY 1""",
)
def px_illumination(spark, sf_dir):
    px = _px(spark, sf_dir).withColumn("v", F.col("v") + 0.5)
    return pixels.flattened(px, "vec_id", 4, 0.7).groupBy("vec_id").agg(F.round(F.avg("v"), 6).alias("mean"))


@query(
    "px_vote",
    f"WITH {_PX} SELECT vec_id, count(*) FILTER ((v > 0)::INT + (y < 4)::INT + ((x + y) % 2 = 0)::INT >= 2) AS n FROM px GROUP BY 1",
)
def px_vote(spark, sf_dir):
    mask = pixels.vote(F.col("v") > 0, F.col("y") < 4, (F.col("x") + F.col("y")) % 2 == 0)
    return _px(spark, sf_dir).groupBy("vec_id").agg(F.count_if(mask).alias("n"))


@query(
    "px_near_marks",
    f"""WITH {_PX} SELECT vec_id, count(*) AS n FROM px a WHERE v > 0.05 AND EXISTS (SELECT 1 FROM px b WHERE b.vec_id = a.vec_id AND b.v < -0.2 AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2) GROUP BY 1""",
)
def px_near_marks(spark, sf_dir):
    px = _px(spark, sf_dir)
    return joins.within(px.filter("v > 0.05"), px.filter("v < -0.2"), "vec_id", 2).groupBy("vec_id").agg(F.count("*").alias("n"))


@query(
    "px_graph_edges",
    f"""WITH {_PX}, p AS (SELECT vec_id, y, x FROM px WHERE v > 0.1) SELECT a.vec_id, count(*) AS edges, round(sum(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)), 6) AS length FROM p a JOIN p b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y, a.x) < (b.y, b.x) GROUP BY 1""",
)
def px_graph_edges(spark, sf_dir):
    e = joins.neighbour_edges(_px(spark, sf_dir).filter("v > 0.1").select("vec_id", "y", "x"), "vec_id")
    return e.groupBy("vec_id").agg(F.count("*").alias("edges"), F.round(F.sum("w"), 6).alias("length"))


@query(
    "px_mask_membership",
    f"WITH {_PX} SELECT a.vec_id, count(*) AS n FROM px a WHERE v > 0.1 AND NOT EXISTS (SELECT 1 FROM px b WHERE b.vec_id = a.vec_id AND b.y = a.y AND b.x = a.x AND (b.y + b.x) % 3 = 0) GROUP BY 1",
)
def px_mask_membership(spark, sf_dir):
    px = _px(spark, sf_dir)
    mask = px.filter("(y + x) % 3 = 0").select("vec_id", "y", "x")
    return px.filter("v > 0.1").join(mask, ["vec_id", "y", "x"], "left_anti").groupBy("vec_id").agg(F.count("*").alias("n"))


@query("px_shape", None)
def px_shape(spark, sf_dir):
    """Area, perimeter, solidity and the seven moment invariants of each image's foreground."""
    return kernels.apply(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, kernels.shape_stats, kernels.SHAPE)


@query("px_lbp", None)
def px_lbp(spark, sf_dir):
    """Histogram of uniform local binary patterns."""
    return kernels.apply(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, kernels.lbp_stats, "lbp array<double>, entropy double")


@query("augmented_variants", None)
def augmented_variants(spark, sf_dir):
    """Seven rows an image: itself and six variants, drawn from a seed of the image's id and the variant's number."""
    return kernels.augmented(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8)


@query("px_gradients", None)
def px_gradients(spark, sf_dir):
    """Gradient directions, their entropy, and the Laplacian's variance."""
    return kernels.apply(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, kernels.gradient_stats, "directions array<double>, mean double, std double, entropy double, laplacian double")


@query("px_gabor", None)
def px_gabor(spark, sf_dir):
    """Responses to a bank of oriented waves."""
    return kernels.apply(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, kernels.gabor_bank, "responses array<double>")


@query("px_skeleton", None)
def px_skeleton(spark, sf_dir):
    """Skeleton of each image's largest component."""
    return kernels.apply(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, kernels.skeleton_stats, "length long, ends long, branches long, density double")


@query("px_equalised", None)
def px_equalised(spark, sf_dir):
    """Mean and deviation after local contrast equalisation."""
    return kernels.apply(load(spark, sf_dir, "embeddings"), "vec_id", "embedding", 8, kernels.equalised_stats, "mean double, std double")
