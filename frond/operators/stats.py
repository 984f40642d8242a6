"""Robust statistics, effect sizes and rank statistics of feature tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.operators.ranks import ranked, value_counts

#: Least group sizes and spreads of the different baselines.
BASELINE_LEAST, BASELINE_SPREAD = 3, 1e-6
NORM_LEAST, NORM_FLOOR = 5, 0.25


def quartiles(value: Column) -> tuple[Column, Column, Column]:
    """Exact quartiles with linear interpolation, as an aggregate. Memory grows with a group's distinct values, not its
    rows; for groups with very many distinct values use ranks.quantiles, which spreads a group over tasks."""
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return q[0], q[1], q[2]


def baseline(df: DataFrame, group: str, feature: str, healthy: Column) -> DataFrame:
    """Median and IQR of a feature over each group's healthy rows; both null below three rows, the IQR where it is 0."""
    x = F.when(healthy, F.col(feature))
    q1, q2, q3 = quartiles(x)
    out = df.groupBy(group).agg(F.count(x).alias("n"), q2.alias("median"), (q3 - q1).alias("iqr"))
    enough = F.col("n") >= BASELINE_LEAST
    return out.select(group, "n", F.when(enough, F.col("median")).alias("median"), F.when(enough & (F.col("iqr") > BASELINE_SPREAD), F.col("iqr")).alias("iqr"))


def norm_stats(df: DataFrame, group: str, feature: str) -> DataFrame:
    """Median and IQR for each group; small groups take the global ones, and no IQR is below a quarter of the global."""
    q1, q2, q3 = quartiles(F.col(feature))
    by = df.groupBy(group).agg(F.count(feature).alias("n"), q2.alias("m"), (q3 - q1).alias("s"))
    overall = df.agg(q2.alias("gm"), (q3 - q1).alias("gs"))
    small = F.col("n") < NORM_LEAST
    return by.crossJoin(F.broadcast(overall)).select(
        group, "n", F.when(small, F.col("gm")).otherwise(F.col("m")).alias("median"), F.greatest(F.when(small, F.col("gs")).otherwise(F.col("s")), F.col("gs") * NORM_FLOOR).alias("iqr")
    )


def gap_report(long: DataFrame, group: str, level: str, low: str, high: str) -> DataFrame:
    """For each (group, feature): sizes, medians and the effect (median high - median low) / IQR low; null without a spread."""
    at = lambda name: F.when(F.col(level) == name, F.col("value"))
    q1, q2, q3 = quartiles(at(low))
    out = long.groupBy(group, "feature").agg(
        F.count(at(low)).alias("n_low"), F.count(at(high)).alias("n_high"), q2.alias("median_low"), F.percentile(at(high), 0.5).alias("median_high"), (q3 - q1).alias("iqr")
    )
    return out.withColumn("effect", F.when(F.col("iqr") > BASELINE_SPREAD, (F.col("median_high") - F.col("median_low")) / F.col("iqr"))).drop("iqr")


def describe(df: DataFrame, group: str | None, value: str) -> DataFrame:
    q1, q2, q3 = quartiles(F.col(value))
    aggs = [F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), q1.alias("q25"), q2.alias("q50"), q3.alias("q75"), F.max(value).alias("max")]
    return df.groupBy(group).agg(*aggs) if group else df.agg(*aggs)


def column_audit(long: DataFrame, sentinel: float = -1.0) -> DataFrame:
    """For each feature of a long table: rows, shares of null and sentinel, distinct values, and flags."""
    n = F.count("*")
    nulls, marks = F.count_if(F.col("value").isNull()), F.count_if(F.col("value") == sentinel)
    distinct = F.countDistinct(F.when(F.col("value") != sentinel, F.col("value")))
    return long.groupBy("feature").agg(n.alias("n"), (nulls / n).alias("null_share"), (marks / n).alias("sentinel_share"), distinct.alias("n_distinct"))


def cohens_d(long: DataFrame, label: str, a: str, b: str) -> DataFrame:
    """(mean a - mean b) / pooled standard deviation for each feature; null below two rows or without a spread."""
    x, y = (F.when(F.col(label) == v, F.col("value")) for v in (a, b))
    out = long.groupBy("feature").agg(*[f(v).alias(f"{k}_{s}") for s, v in (("a", x), ("b", y)) for k, f in (("n", F.count), ("mean", F.avg), ("var", F.var_samp))])
    pooled = F.sqrt(((F.col("n_a") - 1) * F.col("var_a") + (F.col("n_b") - 1) * F.col("var_b")) / (F.col("n_a") + F.col("n_b") - 2))
    ok = (F.col("n_a") >= 2) & (F.col("n_b") >= 2) & (pooled > 0)
    return out.select("feature", "n_a", "n_b", F.when(ok, (F.col("mean_a") - F.col("mean_b")) / pooled).alias("d"))


def rank_sums(df: DataFrame, groups: list[str], value: str, positive: Column) -> DataFrame:
    """n1, n0 and the Mann-Whitney U of the positive rows, with ties at half, for each group."""
    counts = value_counts(df.filter(F.col(value).isNotNull()), groups, value, n1=F.count_if(positive))
    r = ranked(counts, groups, value)
    out = r.groupBy(*groups) if groups else r
    u = F.sum(F.col("n1") * F.col("rank")) - F.sum("n1") * (F.sum("n1") + 1) / 2
    return out.agg(F.sum("n1").alias("n1"), (F.sum("n") - F.sum("n1")).alias("n0"), u.alias("u"))


def auc(df: DataFrame, groups: list[str], value: str, positive: Column) -> DataFrame:
    """Area under the ROC curve and Cliff's delta of each group; null where one side is empty."""
    r = rank_sums(df, groups, value, positive)
    area = F.try_divide(F.col("u"), F.col("n1") * F.col("n0"))
    return r.select(*groups, "n1", "n0", area.alias("auc"), (2 * area - 1).alias("cliffs_delta"))


def spearman(df: DataFrame, groups: list[str], x: str, y: str) -> DataFrame:
    """Spearman's rho of each group: Pearson's r of average ranks, over counted pairs of values."""
    pairs = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*groups, x, y).agg(F.count("*").alias("m"))
    rx, ry = (ranked(pairs.groupBy(*groups, c).agg(F.sum("m").alias("n")), groups, c).select(*groups, c, F.col("rank").alias(f"r{i}")) for i, c in enumerate((x, y)))
    joined = pairs.join(rx, [*groups, x]).join(ry, [*groups, y])
    w, a, b = F.col("m").cast("double"), F.col("r0"), F.col("r1")
    sums = (joined.groupBy(*groups) if groups else joined).agg(*[F.sum(w * e).alias(k) for k, e in (("n", F.lit(1)), ("sa", a), ("sb", b), ("saa", a * a), ("sbb", b * b), ("sab", a * b))])
    cov = F.col("sab") - F.col("sa") * F.col("sb") / F.col("n")
    va, vb = F.col("saa") - F.col("sa") ** 2 / F.col("n"), F.col("sbb") - F.col("sb") ** 2 / F.col("n")
    return sums.select(*groups, F.col("n").cast("long").alias("n"), F.try_divide(cov, F.sqrt(va * vb)).alias("rho"))


def kruskal(df: DataFrame, value: str, label: str) -> DataFrame:
    """Kruskal-Wallis H over all groups of ``label``, corrected for ties."""
    rows = df.filter(F.col(value).isNotNull() & F.col(label).isNotNull())
    r = ranked(value_counts(rows, [], value), [], value)
    by = rows.groupBy(label, value).agg(F.count("*").alias("m")).join(r.select(value, "rank"), value)
    groups = by.groupBy(label).agg(F.sum("m").alias("m"), F.sum(F.col("m") * F.col("rank")).alias("s"))
    ties = r.agg(F.sum(F.col("n") ** 3 - F.col("n")).alias("ties"), F.max("total").alias("total"))
    one = groups.agg(F.count("*").alias("k"), F.sum(F.col("s") ** 2 / F.col("m")).alias("q")).crossJoin(F.broadcast(ties))
    n = F.col("total").cast("double")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return one.select("k", F.col("total").alias("n"), F.try_divide(h, 1 - F.col("ties") / (n**3 - n)).alias("h"))


def histogram(df: DataFrame, groups: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts and shares of all bins of every group, empty ones too; the last bin holds its right edge."""
    from frond.functions.scalars import histogram_bin

    counted = df.withColumn("bin", histogram_bin(F.col(value), low, high, bins)).filter("bin is not null").groupBy(*groups, "bin").agg(F.count("*").alias("n"))
    every = counted.select(*groups).distinct().withColumn("bin", F.explode(F.sequence(F.lit(1), F.lit(bins)))) if groups else df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    totals = counted.groupBy(*groups).agg(F.sum("n").alias("total")) if groups else counted.agg(F.sum("n").alias("total"))
    out = every.join(counted, [*groups, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    out = out.join(totals, groups) if groups else out.crossJoin(F.broadcast(totals))
    return out.select(*groups, "bin", "n", (F.col("n") / F.col("total")).alias("share"))


def entropy(hist: DataFrame, groups: list[str]) -> DataFrame:
    """Shannon entropy in bits and the first fullest bin of each group's histogram."""
    p = F.col("share")
    return hist.groupBy(*groups).agg(
        (-F.sum(F.when(p > 0, p * F.log2(p)).otherwise(0.0))).alias("entropy"), F.min_by("bin", F.struct(-F.col("n"), F.col("bin"))).alias("mode_bin")
    )


def moments(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """Median, IQR, population skewness and excess kurtosis, and the coefficient of variation (0 where the mean is 0)."""
    q1, q2, q3 = quartiles(F.col(value))
    cv = F.when(F.avg(value) > 1e-6, F.stddev_pop(value) / F.avg(value)).otherwise(0.0)
    return df.groupBy(*groups).agg(F.count(value).alias("n"), q2.alias("median"), (q3 - q1).alias("iqr"), F.skewness(value).alias("skew"), F.kurtosis(value).alias("kurt"), cv.alias("cv"))


def trimmed_mean(df: DataFrame, groups: list[str], value: str, share: float = 0.1) -> DataFrame:
    """The mean without floor(share * n) rows at either end, from counted values and their ranks."""
    r = ranked(value_counts(df.filter(F.col(value).isNotNull()), groups, value), groups, value)
    cut = F.floor(F.lit(share) * F.col("total"))
    kept = F.greatest(F.lit(0), F.least(F.col("below") + F.col("n"), F.col("total") - cut) - F.greatest(F.col("below"), cut))
    return r.withColumn("k", kept).groupBy(*groups).agg((F.sum(F.col("k") * F.col(value)) / F.sum("k")).alias("trimmed_mean"))


#: A group's own association counts from this p, rho and number of rows on.
SIGN_P, SIGN_RHO, SIGN_ROWS = 0.05, 0.3, 15


def signs(rho: Column, p: Column, overall: Column, n: Column) -> Column:
    """-1 where a group's own association is firm, opposed to the overall one and stronger, else 1."""
    flip = (p < SIGN_P) & (F.abs(rho) >= SIGN_RHO) & (F.signum(rho) != F.signum(overall)) & (F.abs(rho) > F.abs(overall)) & (n >= SIGN_ROWS)
    return F.when(flip, F.lit(-1)).otherwise(F.lit(1))


def level_thresholds(df: DataFrame, level: str, score: str, order: list[str], defaults: list[float], least: int = 3) -> DataFrame:
    """One row of thresholds: midpoints of neighbouring levels' medians, or the defaults if these don't rise."""
    at = {v: F.percentile(F.when(F.col(level) == v, F.col(score)), 0.5) for v in order}
    n = {v: F.count(F.when(F.col(level) == v, F.col(score))) for v in order}
    row = df.agg(*[F.when(n[v] >= least, at[v]).alias(f"m{i}") for i, v in enumerate(order)])
    mids = [(F.col(f"m{i}") + F.col(f"m{i + 1}")) / 2 for i in range(len(order) - 1)]
    rising = F.lit(True)
    for i in range(len(order) - 1):
        rising = rising & F.coalesce(F.col(f"m{i}") < F.col(f"m{i + 1}"), F.lit(False))
    return row.select(*[F.when(rising, m).otherwise(F.lit(d)).alias(f"t{i + 1}") for i, (m, d) in enumerate(zip(mids, defaults))])
