"""Images as pixel tables (img, y, x, v or r, g, b): masks, histograms and textures by joins and aggregates.

A pixel's neighbours are found by equality of coordinates, so a table of any number of images is one shuffle by image and
place; nothing compares all pixels of an image with each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pixel_table(df: DataFrame, key: str, array: str, width: int) -> DataFrame:
    """A flat array of values as rows (key, y, x, v)."""
    at = F.posexplode(F.col(array).cast("array<double>")).alias("i", "v")
    return df.select(key, at).select(key, F.floor(F.col("i") / width).cast("int").alias("y"), (F.col("i") % width).cast("int").alias("x"), "v")


def grey_level(v: Column, low: float, high: float, levels: int) -> Column:
    return F.least(F.greatest(F.floor((v - low) / (high - low) * levels), F.lit(0)), F.lit(levels - 1)).cast("int")


def coverage(px: DataFrame, key: str, inside: Column) -> DataFrame:
    return px.groupBy(key).agg(F.count_if(inside).alias("n"), F.avg(inside.cast("double")).alias("coverage"))


def otsu(px: DataFrame, key: str, level: Column, levels: int) -> DataFrame:
    """The threshold with the largest between-class variance of each image, the first on ties, from its histogram."""
    hist = px.groupBy(key, level.alias("level")).agg(F.count("*").cast("double").alias("n"))
    w = Window.partitionBy(key)
    up = w.orderBy("level")
    h = hist.withColumns({"w0": F.sum("n").over(up), "s0": F.sum(F.col("n") * F.col("level")).over(up), "wt": F.sum("n").over(w), "st": F.sum(F.col("n") * F.col("level")).over(w)})
    w1 = F.col("wt") - F.col("w0")
    gap = F.col("s0") / F.col("w0") - (F.col("st") - F.col("s0")) / w1
    between = F.when(w1 > 0, F.col("w0") * w1 * gap * gap).otherwise(F.lit(0.0))
    return h.withColumn("between", F.round(between, 6)).groupBy(key).agg(F.min_by("level", F.struct(-F.col("between"), F.col("level"))).alias("threshold"))


def cooccurrence(px: DataFrame, key: str, level: str, dy: int, dx: int) -> DataFrame:
    """The normalised, symmetric co-occurrence of grey levels at an offset: (key, i, j, p)."""
    there = px.select(key, (F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.col(level).alias("j"))
    pairs = px.select(key, "y", "x", F.col(level).alias("i")).join(there, [key, "y", "x"])
    both = pairs.select(key, F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("e")).select(key, "e.*")
    counts = both.groupBy(key, "i", "j").agg(F.count("*").alias("n"))
    return counts.select(key, "i", "j", (F.col("n") / F.sum("n").over(Window.partitionBy(key))).alias("p"))


def texture(glcm: DataFrame, key: str) -> DataFrame:
    """Contrast, homogeneity, energy and correlation of a co-occurrence table."""
    d, p = (F.col("i") - F.col("j")).cast("double"), F.col("p")
    s = glcm.groupBy(key).agg(
        F.sum(p * d * d).alias("contrast"), F.sum(p / (1 + d * d)).alias("homogeneity"), F.sqrt(F.sum(p * p)).alias("energy"), F.sum(p * F.col("i")).alias("m"), F.sum(p * F.col("i") * F.col("i")).alias("q"), F.sum(p * F.col("i") * F.col("j")).alias("c")
    )
    var = F.col("q") - F.col("m") * F.col("m")
    return s.select(key, "contrast", "homogeneity", "energy", F.when(var > 1e-12, (F.col("c") - F.col("m") * F.col("m")) / var).otherwise(F.lit(1.0)).alias("correlation"))


def projection(px: DataFrame, key: str, axis: str) -> DataFrame:
    return px.groupBy(key, axis).agg(F.avg("v").alias("mean"))


def centroid(px: DataFrame, key: str, inside: Column) -> DataFrame:
    """Centre, box and area of each image's foreground, and the orientation of its principal axis in degrees."""
    p = px.filter(inside)
    s = p.groupBy(key).agg(F.count("*").alias("area"), F.avg("y").alias("cy"), F.avg("x").alias("cx"), F.min("y").alias("top"), F.max("y").alias("bottom"), F.min("x").alias("left"), F.max("x").alias("right"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"), F.covar_pop("x", "y").alias("vxy"))
    return s.select(key, "area", "cy", "cx", "top", "bottom", "left", "right", F.degrees(F.atan2(2 * F.col("vxy"), F.col("vx") - F.col("vy")) / 2).alias("axis"))


def mirror_iou(px: DataFrame, key: str, inside: Column, width: int) -> DataFrame:
    """How far the foreground overlaps its mirror image across the vertical middle: intersection over union."""
    p = px.filter(inside).select(key, "y", "x")
    m = p.select(key, "y", (F.lit(width - 1) - F.col("x")).alias("x"))
    both = p.join(m, [key, "y", "x"]).groupBy(key).agg(F.count("*").alias("both"))
    return p.groupBy(key).agg(F.count("*").alias("n")).join(both, key, "left").select(key, (F.coalesce("both", F.lit(0)) / (2 * F.col("n") - F.coalesce("both", F.lit(0)))).alias("iou"))


def local_spread(px: DataFrame, key: str, reach: int) -> DataFrame:
    """The variance over an image of the standard deviations of every pixel's neighbourhood."""
    offsets = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]))
    spread = px.select(key, "y", "x", "v", offsets.alias("o")).select(key, (F.col("y") + F.col("o.i")).alias("y"), (F.col("x") + F.col("o.j")).alias("x"), "v")
    local = spread.groupBy(key, "y", "x").agg(F.stddev_pop("v").alias("s")).join(px.select(key, "y", "x"), [key, "y", "x"], "left_semi")
    return local.groupBy(key).agg(F.var_pop("s").alias("contrast_variance"))


def tile_illumination(px: DataFrame, key: str, tile: int) -> DataFrame:
    """The 90th percentile of every tile."""
    return px.groupBy(key, F.floor(F.col("y") / tile).cast("int").alias("ty"), F.floor(F.col("x") / tile).cast("int").alias("tx")).agg(F.percentile("v", 0.9).alias("light"))


def flattened(px: DataFrame, key: str, tile: int, target: float, low: float = 0.6, high: float = 1.8) -> DataFrame:
    """Values divided by their tile's light, the gain within bounds."""
    t = tile_illumination(px, key, tile)
    gain = F.least(F.greatest(target / F.greatest("light", F.lit(1e-6)), F.lit(low)), F.lit(high))
    here = px.withColumns({"ty": F.floor(F.col("y") / tile).cast("int"), "tx": F.floor(F.col("x") / tile).cast("int")})
    return here.join(t, [key, "ty", "tx"]).select(key, "y", "x", (F.col("v") * gain).alias("v"))


def vote(*masks: Column, least: int = 2) -> Column:
    return sum((m.cast("int") for m in masks[1:]), masks[0].cast("int")) >= least
