"""Reports on feature tables: gaps between levels, audits of columns, rankings, what a vote's member changes, joined reports.

Quantiles are exact and spread: values are counted first and ranked in ranges, so neither a group nor a feature meets in one
task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frond.operators import inference, stats, windows
from frond.operators.ranks import quantiles, ranked, value_counts

# Fixed values of reports: least healthy rows, least spread, and below what size an effect is weak.
HEALTHY_LEAST, SPREAD, WEAK = 3, 1e-6, 0.5
# Fixed values of an audit: from where on a column is flagged, in percent, and the least size of a trend.
MOSTLY_SENTINEL, HIGH_NULL, NO_TREND, RHO_LEAST = 50, 20, 0.05, 5


def _quantiles(long: DataFrame, groups: list[str]) -> DataFrame:
    return quantiles(ranked(value_counts(long, groups, "value"), groups, "value"), groups, "value", {"q1": 0.25, "q2": 0.5, "q3": 0.75})


def gap_report(long: DataFrame, group: str, level: str, order: list[str], least: int = HEALTHY_LEAST) -> DataFrame:
    """For each (group, feature) of a long table (group, level, feature, value) with any number in it: n of the first and last
    level of ``order``, every level's median (3 places), and the effect (2 places): the last median less the first over the
    first level's IQR.

    Below ``least`` rows in the first level the IQR is that of all levels; without a spread the effect is null. Nulls and NaN
    don't count; a level without rows has a null median.
    """
    known = long.filter(F.col("value").isNotNull() & ~F.isnan(F.col("value").cast("double")))
    keys = [group, "feature"]
    every = _quantiles(known, keys).select(*keys, (F.col("q3") - F.col("q1")).alias("_all"))
    each = _quantiles(known.filter(F.col(level).isin(order)), [*keys, level])
    at = lambda name, c: F.max(F.when(F.col(level) == name, F.col(c)))  # noqa: E731  one row for each level
    first, last = order[0], order[-1]
    wide = each.groupBy(*keys).agg(
        F.coalesce(at(first, "n"), F.lit(0)).alias(f"n_{first}"), F.coalesce(at(last, "n"), F.lit(0)).alias(f"n_{last}"),
        *[at(k, "q2").alias(f"_m_{k}") for k in order], at(first, "q3").alias("_q3"), at(first, "q1").alias("_q1"),
    )
    told = every.join(wide, keys, "left")
    counts = [F.coalesce(f"n_{k}", F.lit(0)).alias(f"n_{k}") for k in (first, last)]
    spread = F.when(F.coalesce(F.col(f"n_{first}"), F.lit(0)) < least, F.col("_all")).otherwise(F.col("_q3") - F.col("_q1"))
    effect = F.when(spread > SPREAD, (F.col(f"_m_{last}") - F.col(f"_m_{first}")) / spread)
    return told.select(*keys, *counts, *[F.round(f"_m_{k}", 3).alias(f"median_{k}") for k in order], F.round(effect, 2).alias("effect"))


def weak_features(report: DataFrame, group: str, below: float = WEAK) -> DataFrame:
    """How many features of each group have an effect smaller than ``below``, most first; groups without one are left out."""
    weak = report.filter(F.abs("effect") < below).groupBy(group).agg(F.count("*").alias("n_weak"))
    return weak.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_weak"), group)))  # a row a group


def column_audit(long: DataFrame, level: str, order: list[str], sentinel: float = -1.0) -> DataFrame:
    """For each feature of a long table (level, feature, value): n, null_pct (null or NaN), sentinel_pct, n_distinct (the sentinel
    counts), rho and p of its other values against the place of their level in ``order``, and flags.

    Flags, joined by commas, else ok: CONSTANT (one value or none), MOSTLY-SENTINEL, HIGH-NAN, NO-TREND-WITH-LEVEL. rho needs more
    than RHO_LEAST values and two different ones.
    """
    place = F.try_element_at(F.create_map(*[F.lit(x) for k, v in enumerate(order) for x in (v, float(k))]), F.col(level))
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    rows = long.select("feature", place.alias("_place"), value.alias("value"))
    n = F.count("*")
    sizes = rows.groupBy("feature").agg(
        n.alias("n"), (100 * F.count_if(F.col("value").isNull()) / n).alias("null_pct"), (100 * F.count_if(F.col("value") == sentinel) / n).alias("sentinel_pct"),
        F.countDistinct("value").alias("n_distinct"), F.count_if(F.col("value") != sentinel).alias("_usable"),
    )
    trend = inference.spearman_test(rows.filter(F.col("value") != sentinel), ["feature"], "_place", "value").select("feature", "rho", "p")
    told = sizes.join(trend, "feature", "left")
    enough = (F.col("_usable") > RHO_LEAST) & (F.col("n_distinct") > 1)
    told = told.withColumns({c: F.when(enough, F.col(c)) for c in ("rho", "p")})
    marks = [
        F.when(F.col("n_distinct") <= 1, "CONSTANT"),
        F.when(F.col("sentinel_pct") > MOSTLY_SENTINEL, "MOSTLY-SENTINEL"),
        F.when(F.col("null_pct") > HIGH_NULL, "HIGH-NAN"),
        F.when(F.abs("rho") < NO_TREND, "NO-TREND-WITH-LEVEL"),
    ]
    flags = F.concat_ws(",", *marks)
    return told.withColumn("flags", F.when(flags == "", "ok").otherwise(flags)).drop("_usable")


def ranked_features(long: DataFrame, label: str, a: str, b: str, n: int) -> DataFrame:
    """The ``n`` features with the largest size of Cohen's d between two labels, with their place; a top-n report."""
    d = stats.cohens_d(long, label, a, b).filter("d is not null")
    return d.orderBy(F.desc(F.abs("d")), "feature").limit(n).withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.abs("d")), "feature")))


def vote_impact(df: DataFrame, names: list[str], without: str, labels: list[str], truth: str) -> DataFrame:
    """One row: n, how many votes change when one model's probabilities are left out of the mean, and macro F1 with and without
    it. The first of equal probabilities wins."""
    choice = F.array(*[F.lit(x) for x in labels])

    def vote(parts: list[str]) -> Column:
        mean = F.transform(F.arrays_zip(*parts), lambda z: sum((z[p] for p in parts), F.lit(0.0)) / len(parts))
        return F.element_at(choice, F.array_position(mean, F.array_max(mean)).cast("int"))

    rest = [x for x in names if x != without]
    rows = df.select(F.col(truth).alias("_t"), vote(names).alias("_with"), vote(rest).alias("_without"))
    cells = rows.groupBy("_t", "_with", "_without").agg(F.count("*").alias("_n"))  # labels cubed at most
    each = cells.select("_n", "_t", F.explode(F.array(F.struct(F.lit("with").alias("kind"), F.col("_with").alias("v")), F.struct(F.lit("without").alias("kind"), F.col("_without").alias("v")))).alias("e"))
    sides = each.select("_n", "e.kind", F.explode(F.array(F.struct(F.col("_t").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("p"), (F.col("_t") == F.col("e.v")).cast("int").alias("hit")), F.struct(F.col("e.v").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("p"), F.lit(0).alias("hit")))).alias("s"))
    by = sides.groupBy("kind", "s.label").agg(*[F.sum(F.col("_n") * F.col(f"s.{c}")).alias(c) for c in ("t", "p", "hit")])
    f1 = by.groupBy().agg(*[F.avg(F.when(F.col("kind") == k, 2 * F.col("hit") / F.greatest(F.col("t") + F.col("p"), F.lit(1)))).alias(f"f1_{k}") for k in ("with", "without")])
    return cells.agg(F.sum("_n").alias("n"), F.sum(F.when(F.col("_with") != F.col("_without"), F.col("_n")).otherwise(0)).alias("n_flipped")).crossJoin(F.broadcast(f1))  # one row each


def health_report(scores: DataFrame, predictions: DataFrame, key: str = "leaf_id", healthy: str = "healthy") -> DataFrame:
    """Index scores (key, species, level, severity_score_raw, health_value) with the first stage's predictions (key, stage1_pred,
    stage1_p_unhealthy) beside them: y_true, stage1_correct, and the percentile of the health value among rows of the same
    prediction (1 place). Scores without a prediction stay, without a percentile; a key that repeats fans out."""
    told = scores.join(predictions, key, "left").withColumn("y_true", F.when(F.col("level") == healthy, "healthy").otherwise("unhealthy"))
    told = told.withColumn("stage1_correct", F.coalesce(F.col("y_true") == F.col("stage1_pred"), F.lit(False)))
    seen = windows.percent_rank(told.filter("stage1_pred is not null and health_value is not null"), ["stage1_pred"], "health_value", "_pct").withColumn("health_percentile_in_group", F.bround("_pct", 1)).drop("_pct")
    rest = told.filter("stage1_pred is null or health_value is null").withColumn("health_percentile_in_group", F.lit(None).cast("double"))
    names = [key, "species", "level", "y_true", "health_value", "health_percentile_in_group", "severity_score_raw", "stage1_pred", "stage1_p_unhealthy", "stage1_correct"]
    return seen.unionByName(rest).select(*names)


def density(hist: DataFrame, low: float, high: float, bins: int) -> DataFrame:
    """``stats.histogram`` with the density of each bin, whose areas sum to one."""
    return hist.withColumn("density", F.col("share") / ((high - low) / bins))


def natural_entropy(hist: DataFrame, groups: list[str], guard: float = 1e-8) -> DataFrame:
    """Entropy in nats over all bins of a histogram, with a small number added inside the logarithm."""
    return hist.groupBy(*groups).agg((-F.sum(F.col("share") * F.log(F.col("share") + guard))).alias("entropy"))


def zones(px: DataFrame, key: str, value: str, inner: float = 0.4, outer: float = 0.6) -> DataFrame:
    """For each image of a pixel table: the mean of a value near its centre of mass and far from it (0 where no pixel is), by the
    distance over the largest one; the middle belongs to neither."""
    mid = px.groupBy(key).agg(F.avg("y").alias("_cy"), F.avg("x").alias("_cx"))
    far = px.join(mid, key).withColumn("_d", F.hypot(F.col("y") - F.col("_cy"), F.col("x") - F.col("_cx")))
    reach = far.groupBy(key).agg(F.max("_d").alias("_top"))
    r = F.col("_d") / (F.col("_top") + 1e-6)
    mean = lambda zone: F.coalesce(F.avg(F.when(zone, F.col(value))), F.lit(0.0))
    return far.join(reach, key).groupBy(key).agg(mean(r < inner).alias("inner"), mean(r >= outer).alias("outer"))


def gradual(x: Column, low: float = 1.0, width: float = 1.5) -> Column:
    """How far x is from ``low`` on the way of ``width``, within 0 and 1; null stays."""
    part = (x - low) / width
    return F.when(part.isNotNull(), F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0)))


def wax_index(b_median: Column, s_median: Column, gloss: Column) -> Column:
    """The mean of how dark, how colourless and how glossy a leaf is, from byte medians and the ratio of its highlights."""
    return ((1 - b_median / 255) + (1 - s_median / 255) + gradual(gloss)) / 3
