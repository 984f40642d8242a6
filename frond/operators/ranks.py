"""Ranks over whole tables or large groups without bringing a group into one task.

Equal values are counted first (with partial sums on every task), values are cut into ranges at approximate quantiles,
and a value's rank is what stands in the ranges before it, plus what stands before it in its own range. A window then
holds one range of one group, or one row for each range.
"""

from __future__ import annotations

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RANGES = 64


def value_counts(df: DataFrame, groups: list[str], value: str, **more) -> DataFrame:
    """One row for each group and distinct value: n, and further aggregates."""
    return df.groupBy(*groups, value).agg(F.count("*").alias("n"), *[a.alias(k) for k, a in more.items()])


def ranked(counts: DataFrame, groups: list[str], value: str, ranges: int = RANGES) -> DataFrame:
    """value_counts with ``below`` (rows with a smaller value), ``total`` (rows of the group) and ``rank`` (average rank from 1)."""
    cuts = counts.select(F.percentile_approx(F.col(value).cast("double"), [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    bounds = [-float("inf"), *sorted(set(cuts)), float("inf")]
    cut = Bucketizer(splits=bounds, inputCol="_v", outputCol="_range").transform(counts.withColumn("_v", F.col(value).cast("double"))) if len(bounds) > 2 else counts.withColumns({"_range": F.lit(0.0), "_v": F.lit(0.0)})
    by = [*groups, "_range"]
    sums = cut.groupBy(*by).agg(F.sum("n").alias("_n"))
    order = Window.partitionBy(*groups).orderBy("_range") if groups else Window.orderBy("_range")
    before = F.sum("_n").over(order) - F.col("_n")
    total = F.sum("_n").over(Window.partitionBy(*groups) if groups else Window.partitionBy())
    sums = sums.withColumns({"_before": before, "total": total}).drop("_n")
    inside = Window.partitionBy(*by).orderBy(value)
    local = cut.withColumn("_local", F.sum("n").over(inside) - F.col("n"))
    same = F.lit(True)
    for c in by:
        same = same & local[c].eqNullSafe(sums[c])  # a null group is a group
    out = local.join(sums, same, "left").select(*[local[c] for c in local.columns], "_before", "total")
    below = F.col("_before") + F.col("_local")
    return out.withColumns({"below": below, "rank": below + (F.col("n") + 1) / 2}).drop("_range", "_v", "_local", "_before")


def quantiles(ranks: DataFrame, groups: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact quantiles (linear interpolation) of every group from ``ranked``: one row a group."""

    def at(place):
        return F.max(F.when((F.col("below") <= place) & (place < F.col("below") + F.col("n")), F.col(value)))

    out = []
    for name, q in shares.items():
        place = F.lit(q) * (F.col("total") - 1)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        out.append((low + (high - low) * part).alias(name))
    return ranks.groupBy(*groups).agg(F.max("total").alias("n"), *out) if groups else ranks.agg(F.max("total").alias("n"), *out)
