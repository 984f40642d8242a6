"""Ordered analytics: ranks in groups, last rows, renumbering, circular averages, peaks, gaps, resampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frond.operators.ranks import ranked, value_counts


def percent_rank(df: DataFrame, groups: list[str], value: str, name: str = "pct") -> DataFrame:
    """100 * average rank / size of the group, for every row; large groups are ranked in ranges."""
    r = ranked(value_counts(df, groups, value), groups, value)
    pct = r.select(*groups, value, (100.0 * F.col("rank") / F.col("total")).alias(name))
    return df.join(pct, [*groups, value])


def top_n(df: DataFrame, groups: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group. Spark keeps n rows of a group on each task before the shuffle (a limit per group)."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def renumbered(new: DataFrame, old: DataFrame, group: str, order: list[Column], index: str) -> DataFrame:
    """New rows numbered on from the largest number that their group has."""
    last = old.groupBy(group).agg(F.max(index).alias("_last"))
    numbered = new.withColumn("_n", F.row_number().over(Window.partitionBy(group).orderBy(*order)))
    return numbered.join(last, group, "left").withColumn(index, F.coalesce("_last", F.lit(0)) + F.col("_n")).drop("_last", "_n")


def circular_mean(df: DataFrame, groups: list[str], place: str, value: str, reach: int) -> DataFrame:
    """The mean over ``reach`` places on either side, the ends joined; places run from 0 without gaps."""
    n = F.count("*").over(Window.partitionBy(*groups))
    sized = df.withColumn("_n", n)
    ends = sized.filter(F.col(place) < reach).withColumn(place, F.col(place) + F.col("_n")).unionByName(sized.filter(F.col(place) >= F.col("_n") - reach).withColumn(place, F.col(place) - F.col("_n")))
    w = Window.partitionBy(*groups).orderBy(place).rowsBetween(-reach, reach)
    return sized.unionByName(ends).withColumn("smooth", F.avg(value).over(w)).filter((F.col(place) >= 0) & (F.col(place) < F.col("_n"))).drop("_n")


def peaks(df: DataFrame, groups: list[str], place: str, value: str, least: float = float("-inf")) -> DataFrame:
    """Rows above both neighbours and of at least a height."""
    w = Window.partitionBy(*groups).orderBy(place)
    return df.withColumns({"_a": F.lag(value).over(w), "_b": F.lead(value).over(w)}).filter((F.col(value) > F.col("_a")) & (F.col(value) > F.col("_b")) & (F.col(value) >= least)).drop("_a", "_b")


def roughness(df: DataFrame, groups: list[str], place: str, value: str) -> DataFrame:
    """The mean size of second differences over the median value."""
    w = Window.partitionBy(*groups).orderBy(place)
    second = F.abs(F.lead(value).over(w) - 2 * F.col(value) + F.lag(value).over(w))
    return df.withColumn("_d", second).groupBy(*groups).agg((F.avg("_d") / F.percentile(value, 0.5)).alias("roughness"))


def circular_gaps(df: DataFrame, groups: list[str], angle: str, turn: float) -> DataFrame:
    """The gap from every angle to the next one around."""
    w = Window.partitionBy(*groups)
    ahead = F.lead(angle).over(w.orderBy(angle))
    return df.withColumn("gap", F.coalesce(ahead, F.min(angle).over(w) + turn) - F.col(angle))


def turning_angles(df: DataFrame, groups: list[str], place: str, x: str, y: str, step: int) -> DataFrame:
    """The signed angle in radians between the way to a point and the way on from it."""
    w = Window.partitionBy(*groups).orderBy(place)
    ax, ay = F.col(x) - F.lag(x, step).over(w), F.col(y) - F.lag(y, step).over(w)
    bx, by = F.lead(x, step).over(w) - F.col(x), F.lead(y, step).over(w) - F.col(y)
    return df.withColumn("turn", F.atan2(ax * by - ay * bx, ax * bx + ay * by))


def resampled(df: DataFrame, groups: list[str], place: str, x: str, y: str, points: int) -> DataFrame:
    """``points`` points at even distances along a path, by linear interpolation."""
    w = Window.partitionBy(*groups).orderBy(place)
    step = F.coalesce(F.hypot(F.col(x) - F.lag(x).over(w), F.col(y) - F.lag(y).over(w)), F.lit(0.0))
    way = df.withColumn("_step", step).withColumn("_at", F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    total = F.max("_at").over(Window.partitionBy(*groups))
    legs = way.withColumns({"_whole": total, "_x": F.lead(x).over(w), "_y": F.lead(y).over(w), "_to": F.lead("_at").over(w)}).filter("_to > _at or (_to is null and _whole = 0)")
    unit = F.col("_whole") / (points - 1)
    first, last = F.ceil(F.col("_at") / unit - 1e-9), F.when(F.col("_to") >= F.col("_whole"), F.lit(points - 1)).otherwise(F.ceil(F.col("_to") / unit - 1e-9) - 1)
    out = legs.withColumn("i", F.explode(F.when(first <= last, F.sequence(first.cast("int"), last.cast("int")))))
    part = (F.col("i") * unit - F.col("_at")) / (F.col("_to") - F.col("_at"))
    return out.select(*groups, "i", (F.col(x) + (F.col("_x") - F.col(x)) * part).alias(x), (F.col(y) + (F.col("_y") - F.col(y)) * part).alias(y))


def autocorrelation(df: DataFrame, groups: list[str], place: str, value: str, lags: int) -> DataFrame:
    """The autocorrelation at lags 1 to ``lags`` of each group's centred values."""
    w = Window.partitionBy(*groups)
    centred = df.withColumn("_v", F.col(value) - F.avg(value).over(w))
    over = w.orderBy(place)
    sums = centred.select(*groups, "_v", *[(F.col("_v") * F.lead("_v", k).over(over)).alias(f"_{k}") for k in range(1, lags + 1)])
    one = sums.groupBy(*groups).agg(F.sum(F.col("_v") ** 2).alias("_0"), *[F.sum(f"_{k}").alias(f"_{k}") for k in range(1, lags + 1)])
    return one.select(*groups, F.posexplode(F.array(*[F.try_divide(F.col(f"_{k}"), F.col("_0")) for k in range(1, lags + 1)])).alias("lag", "r")).withColumn("lag", F.col("lag") + 1)


def hashed_folds(df: DataFrame, group: str, folds: int, seed: int = 42) -> DataFrame:
    """A fold for each group's rows by a seeded hash of the group, so that no group is in two folds; classes are not looked at
    (``folds.stratified`` does)."""
    return df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), F.col(group)), F.lit(folds)).cast("int"))
