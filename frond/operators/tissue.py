"""Leaf tissue on pixel tables: a seed of sure pixels, the colour model learned from it, candidates near that model, and what
colour says about health.

Each image's own statistics go back to its pixels as thresholds, by a join on the image; rules are tried in a fixed order and
a pixel has the first that it meets. Tables hold any number of images.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.functions.colour import lab, saturation
from frond.operators import components
from frond.operators.joins import bounded_broadcast
from frond.operators.state import Tables

SENTINEL = -1.0

# Fixed values of the seed: (excess green, saturation, lightness below), and the coverage in percent under which the second row holds.
SEED, SEED_RELAXED, SEED_COVERAGE = (20, 25, 130), (8, 15, 150), 1.0
# Fixed values of the colour model: least pixels, its default means and deviations, least deviation.
MODEL_LEAST, MODEL_MEAN, MODEL_STD, MODEL_FLOOR = 50, (100.0, 115.0, 130.0), (20.0, 10.0, 10.0), 8.0
# Fixed values of candidates: largest z, least saturation, and (saturation below, lightness above) of paper.
CANDIDATE_Z, CANDIDATE_S, PAPER = 2.5, 25, (30, 160)
# Fixed values of health: the anchor's pixels (s above, a below, lightness between), how many of them, and how far from it.
ANCHOR, ANCHOR_LEAST, CHLOROTIC_FROM_ANCHOR, PALE_FROM_ANCHOR = (60, 118, 40, 170), 200, 12.0, 15.0
NECROTIC, CHLOROTIC, SPECULAR, PALE = (90, 90), (150, 118), (225, 40), (170, 60)

CHANNELS = ("lightness", "a", "b")


def coloured(px: DataFrame) -> DataFrame:
    """Adds lightness, a, b, saturation and excess (green) to pixels with bytes r, g, b_ (blue).

    Written as a table: every rule filters by these columns, and a filter that is pushed below a computed column computes it
    anew, with each of its parts as often as the expression names them.
    """
    r, g, b = (F.col(c).cast("double") for c in ("r", "g", "b_"))
    return Tables(px.sparkSession).put(px.withColumns(lab(r, g, b) | {"saturation": saturation(r, g, b), "excess": 2 * g - r - b}), "coloured")


def opened(px: DataFrame, key: str, inside: Column) -> DataFrame:
    """The places (key, y, x) of a mask after a morphological opening by a 3 x 3 square; beyond the image counts as inside."""
    flat = px.select(key, "y", "x", F.coalesce(inside, F.lit(False)).alias("_in"))
    square = components.square(1)
    core = flat.filter("_in").join(components.dilated(flat.filter("not _in"), key, square), [key, "y", "x"], "left_anti")
    return components.dilated(core, key, square).join(flat.filter("_in").select(key, "y", "x"), [key, "y", "x"], "left_semi")


def _cleaned(px: DataFrame, key: str, inside: Column, opening: bool, least: int) -> DataFrame:
    mask = opened(px, key, inside) if opening else px.filter(F.coalesce(inside, F.lit(False))).select(key, "y", "x")
    if least > 1:
        parts = components.labelled(mask, key)
        large = components.blobs(parts, key).filter(F.col("area") >= least).select(key, "component")
        mask = parts.join(large, [key, "component"], "left_semi").select(key, "y", "x")
    return mask


def seed(px: DataFrame, key: str, opening: bool = True, least: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sure tissue of ``coloured`` pixels: (key, y, x, relaxed) and ``keep`` of their columns. Where it covers less than SEED_COVERAGE
    percent of an image, the relaxed rule decides that image. ``opening`` and ``least`` (pixels of a component) clean either mask
    first; without them a pixel is decided where it is read, and only the images' shares are joined."""
    rule = lambda t: (F.col("excess") > t[0]) & (F.col("saturation") > t[1]) & (F.col("lightness") < t[2])
    low = lambda n, area: 100 * F.coalesce(n, F.lit(0)) / area < SEED_COVERAGE
    if not opening and least <= 1:
        relaxed = px.groupBy(key).agg(low(F.count_if(rule(SEED)), F.count("*")).alias("relaxed"))
        told = px.join(bounded_broadcast(relaxed), key, "left").withColumn("relaxed", F.coalesce("relaxed", F.lit(False)))
        return told.filter(F.when(F.col("relaxed"), rule(SEED_RELAXED)).otherwise(rule(SEED))).select(key, "y", "x", "relaxed", *keep)
    strict = _cleaned(px, key, rule(SEED), opening, least)
    area = px.groupBy(key).agg(F.count("*").alias("_area"))
    covered = area.join(strict.groupBy(key).agg(F.count("*").alias("_n")), key, "left")
    weak = bounded_broadcast(covered.filter(low(F.col("_n"), F.col("_area"))).select(key))
    loose = _cleaned(px.join(weak, key, "left_semi"), key, rule(SEED_RELAXED), opening, least)
    mask = strict.join(weak, key, "left_anti").withColumn("relaxed", F.lit(False)).unionByName(loose.withColumn("relaxed", F.lit(True)))
    return mask.join(px.select(key, "y", "x", *keep), [key, "y", "x"]) if keep else mask


def colour_model(px: DataFrame, key: str, mask: DataFrame) -> DataFrame:
    """For each image: n (pixels of ``mask``) and mean_ and std_ of each channel over them, the deviations MODEL_FLOOR at least;
    fixed means and deviations where n is below MODEL_LEAST. A mask that kept the channels isn't joined with the pixels."""
    inside = mask if set(CHANNELS) <= set(mask.columns) else px.join(mask.select(key, "y", "x"), [key, "y", "x"], "left_semi")
    stats = inside.groupBy(key).agg(F.count("*").alias("n"), *[f(c).alias(f"{k}_{c}") for c in CHANNELS for k, f in (("mean", F.avg), ("std", F.stddev_pop))])
    every = px.select(key).distinct().join(stats, key, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = F.col("n") >= MODEL_LEAST
    made = {f"mean_{c}": F.when(enough, F.col(f"mean_{c}")).otherwise(m) for c, m in zip(CHANNELS, MODEL_MEAN)}
    made |= {f"std_{c}": F.when(enough, F.greatest(F.col(f"std_{c}"), F.lit(MODEL_FLOOR))).otherwise(s) for c, s in zip(CHANNELS, MODEL_STD)}
    return every.withColumns(made)


def candidates(px: DataFrame, key: str, model: DataFrame) -> DataFrame:
    """Pixels within CANDIDATE_Z deviations of their image's model in every channel that are neither without colour nor paper."""
    met = px.join(bounded_broadcast(model), key)
    z = F.greatest(*[F.abs(F.col(c) - F.col(f"mean_{c}")) / F.col(f"std_{c}") for c in CHANNELS])
    paper = (F.col("saturation") < PAPER[0]) & (F.col("lightness") > PAPER[1])
    return met.filter((z < CANDIDATE_Z) & (F.col("saturation") >= CANDIDATE_S) & ~paper).select(*px.columns)


def anchors(px: DataFrame, key: str) -> DataFrame:
    """Median lightness and b of each image's clearly green pixels; null below ANCHOR_LEAST of them."""
    s, a, low, high = ANCHOR
    green = (F.col("saturation") > s) & (F.col("a") < a) & (F.col("lightness") > low) & (F.col("lightness") < high)
    at = lambda c: F.percentile(F.when(green, F.col(c)), 0.5)  # noqa: E731  at most 256 values
    out = px.groupBy(key).agg(F.count_if(green).alias("n_green"), at("lightness").alias("anchor_l"), at("b").alias("anchor_b"))
    return out.select(key, "n_green", *[F.when(F.col("n_green") >= ANCHOR_LEAST, F.col(c)).alias(c) for c in ("anchor_l", "anchor_b")])


def damage(px: DataFrame, key: str) -> DataFrame:
    """``coloured`` leaf pixels with ``tissue``: the first of necrotic, chlorotic, specular, pale that a pixel meets, else
    healthy. Yellow and pale pixels must also differ from their image's own green, where it has enough of that."""
    met = px.join(bounded_broadcast(anchors(px, key)), key)
    light, a, b, s = (F.col(c) for c in ("lightness", "a", "b", "saturation"))
    far = lambda x, anchor, d: F.coalesce(x > F.col(anchor) + d, F.lit(True))
    tissue = (
        F.when((light < NECROTIC[0]) & (s < NECROTIC[1]), "necrotic")
        .when((b > CHLOROTIC[0]) & (a > CHLOROTIC[1]) & far(b, "anchor_b", CHLOROTIC_FROM_ANCHOR), "chlorotic")
        .when((light > SPECULAR[0]) & (s < SPECULAR[1]), "specular")
        .when((light > PALE[0]) & (s < PALE[1]) & far(light, "anchor_l", PALE_FROM_ANCHOR), "pale")
        .otherwise("healthy")
    )
    return met.withColumn("tissue", tissue).drop("n_green", "anchor_l", "anchor_b")


def colour_health(px: DataFrame, key: str, images: DataFrame) -> DataFrame:
    """One row for each of ``images`` (key): percentages of necrotic, chlorotic, pale and healthy leaf pixels (specular ones are
    healthy), and medians and IQRs of a and b; all -1 for an image without leaf pixels."""
    share = lambda *names: F.avg(F.col("tissue").isin(*names).cast("double")) * 100
    q = {c: F.percentile(F.col(c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for c in ("a", "b")}  # at most 256 values
    found = damage(px, key).groupBy(key).agg(
        share("necrotic").alias("pct_necrotic"), share("chlorotic").alias("pct_chlorotic"), share("pale").alias("pct_pale"), share("healthy", "specular").alias("pct_healthy"),
        *[x.alias(n) for c in ("a", "b") for n, x in ((f"{c}_median", q[c][1]), (f"{c}_iqr", q[c][2] - q[c][0]))],
    )
    names = [c for c in found.columns if c != key]
    return images.select(key).distinct().join(found, key, "left").select(key, *[F.coalesce(c, F.lit(SENTINEL)).alias(c) for c in names])
