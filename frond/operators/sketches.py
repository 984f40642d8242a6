"""Approximate distinct counts that merge, grouping sets, tiles without one-task windows, and frames over a range of values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frond.operators.ranks import ranked, value_counts

#: 2^12 registers: a relative standard error of about 1.6 percent; sketches are 4 KB at most.
LOG_REGISTERS = 12


def distinct_sketches(df: DataFrame, groups: list[str], value: str, bits: int = LOG_REGISTERS) -> DataFrame:
    """One sketch of the distinct values of each group, made on every task and merged after the shuffle; null is no value."""
    return df.groupBy(*groups).agg(F.hll_sketch_agg(F.col(value), bits).alias("sketch"))


def merged(sketches: DataFrame, groups: list[str]) -> DataFrame:
    """Sketches of finer groups merged into coarser ones (or into one) without the rows they were made of."""
    return (sketches.groupBy(*groups) if groups else sketches).agg(F.hll_union_agg("sketch").alias("sketch"))


def estimates(sketches: DataFrame, name: str = "distinct") -> DataFrame:
    return sketches.withColumn(name, F.hll_sketch_estimate("sketch")).drop("sketch")


def grouping_sets(df: DataFrame, columns: list[str], sets: list[list[str]], aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over each of ``sets`` of columns in one pass: columns, ``level`` (the bits of columns that a row sums over, the
    last column lowest) and the aggregates. Each row is expanded once for each set before partial sums."""
    grouped = df.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns])
    return grouped.agg(F.grouping_id().cast("long").alias("level"), *[a.alias(k) for k, a in aggregates.items()])


def tiles(df: DataFrame, groups: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The rows with ``tile`` 1 to ``n``: equal parts of each group in order of value and, among equals, of ``tie`` (a number that
    tells a group's rows apart); the first parts have one more where a group doesn't divide. Rows without a value have none.

    Places come from counted values and from ranks among equals, both in ranges, so that neither a group nor a value that many
    rows share is ordered in one task.
    """
    rows = df.filter(F.col(value).isNotNull())
    by_value = ranked(value_counts(rows, groups, value), groups, value).select(*groups, value, F.col("below").alias("_before"), F.col("total").alias("_all"))
    among = ranked(value_counts(rows, [*groups, value], tie), [*groups, value], tie).select(*groups, value, tie, F.col("below").alias("_among"))
    whole, extra = F.floor(F.col("_all") / n), F.col("_all") % n
    place = F.col("_before") + F.col("_among")
    wide = extra * (whole + 1)
    tile = F.when(place < wide, F.floor(place / (whole + 1))).otherwise(extra + F.floor((place - wide) / F.greatest(whole, F.lit(1)))) + 1
    spots = among.join(by_value, [*groups, value]).select(*groups, value, tie, tile.cast("int").alias("tile"))
    return df.join(spots, [*groups, value, tie], "left").select(*df.columns, "tile")


def trailing(df: DataFrame, groups: list[str], at: str, span: float, aggregates: dict[str, Column]) -> DataFrame:
    """Aggregates over the rows of a group whose ``at`` is at most ``span`` smaller, the row and its equals included."""
    frame = Window.partitionBy(*groups).orderBy(at).rangeBetween(-span, Window.currentRow)
    return df.withColumns({k: a.over(frame) for k, a in aggregates.items()})
