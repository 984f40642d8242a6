"""Stratified folds that keep groups together: no group is in two folds, and every fold has nearly the classes of all rows.

The greedy rule deals groups one at a time, those with the most uneven classes first, each to the fold where it raises the
spread of class shares between folds least. A group matters only by its histogram of classes, so equal histograms are dealt
together: of m groups with one histogram, whole rounds go to all folds alike, which changes no comparison between folds, and the
at most ``folds`` - 1 left over are dealt greedily.

Every histogram is dealt as it is, however many there are. They are sorted by ranges into parts of about MOST_PATTERNS, and a task
deals one part from what the parts before it gave to each fold; only those sums, a number for each fold and class, come to
the driver. The rule has an order, so parts wait for each other: its time grows with the number of histograms, its memory doesn't.

A group's place among those of its histogram comes from a digest of its key and the seed, ranked in ranges, so a histogram
that most groups share is never sorted in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.operators.joins import bounded_broadcast
from frond.operators.ranks import ranked
from frond.operators.state import Tables

#: Histograms that a task deals, and classes beyond which there is an error.
MOST_PATTERNS, MOST_CLASSES = 20_000, 1_000
#: Class weights are whole numbers of this fineness, so that every sum is exact and ties are true ties.
FINENESS = 1000
LEFT = "pattern array<bigint>, at bigint, fold int, held array<bigint>"
_LEFT_SCHEMA = pa.schema([("pattern", pa.list_(pa.int64())), ("at", pa.int64()), ("fold", pa.int32()), ("held", pa.list_(pa.int64()))])


def digest(group: Column, seed: int) -> Column:
    """A number of 52 bits from a group's key and the seed."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(group.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def class_weights(totals: list[int]) -> list[int]:
    """A weight for each class from its rows; halves are rounded up."""
    rows = sum(totals)
    exact = [(rows / t) ** 2 * FINENESS if t else 0.0 for t in totals]
    return [math.floor(x) + (x - math.floor(x) >= 0.5) for x in exact]


def dealt(patterns: list[tuple[tuple[int, ...], int, tuple[int, ...] | None]], folds: int, weight: list[int] | None = None, held: list[list[int]] | None = None) -> list[list[int]]:
    """For each pattern (its histogram, its number of groups, the sum of its groups' rows by class) the folds of the groups left
    over after whole rounds, in order. Patterns are dealt by falling variance of their histogram, then by the histogram.

    Without ``weight`` the patterns are all there are, and their sums give the classes' weights. ``held`` has for each fold the
    rows by class of groups left over before, and these are added to it.
    """
    classes = len(patterns[0][0]) if patterns else 0
    if weight is None:
        weight = class_weights([sum(p[2][k] for p in patterns) for k in range(classes)])
    if held is None:
        held = [[0] * classes for _ in range(folds)]
    size = [sum(h) for h in held]
    out: list[list[int]] = [[] for _ in patterns]
    uneven = lambda h: len(h) * sum(x * x for x in h) - sum(h) ** 2
    for at in sorted(range(len(patterns)), key=lambda k: (-uneven(patterns[k][0]), patterns[k][0])):
        histogram, groups, _ = patterns[at]
        own = [(k, x, x * weight[k]) for k, x in enumerate(histogram) if x]
        for _ in range(groups % folds):
            # what the squared shares of the classes grow by differs between folds by twice this
            fold = min(range(folds), key=lambda f: (sum(held[f][k] * xw for k, _, xw in own), size[f], f))
            for k, x, _ in own:
                held[fold][k] += x
                size[fold] += x
            out[at].append(fold)
    return out


def _dealing(folds: int, weight: list[int], held: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Deals sorted rows (pattern, groups) on from ``held``: a row for each group left over, then one with what folds hold now."""

    def run(batches):
        now = [list(held[f * len(weight) : (f + 1) * len(weight)]) for f in range(folds)]
        for batch in batches:
            patterns = [tuple(h) for h in batch["pattern"].to_pylist()]
            left = dealt([(h, n, None) for h, n in zip(patterns, batch["groups"].to_pylist())], folds, weight, now)
            rows = [(h, k, fold) for h, own in zip(patterns, left) for k, fold in enumerate(own)]
            columns = zip(*rows) if rows else ([], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip([*columns, [None] * len(rows)], _LEFT_SCHEMA)], schema=_LEFT_SCHEMA)
        yield pa.RecordBatch.from_pylist([{"held": [x for f in now for x in f]}], schema=_LEFT_SCHEMA)

    return run


def _left_over(groups: DataFrame, totals: list[int], folds: int, most: int, tables: Tables) -> DataFrame:
    """(pattern, at, fold) for the groups of each pattern that whole rounds leave over, numbered from 0."""
    total = lambda of: F.aggregate("pattern", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + of(x.cast("decimal(19,0)"))).cast("decimal(38,0)"))
    size = total(lambda x: x)
    uneven = len(totals) * total(lambda x: x * x) - size * size
    odd = groups.groupBy("pattern").agg(F.count("*").alias("groups")).filter(F.col("groups") % folds > 0)
    odd = tables.put(odd.withColumn("uneven", uneven), "patterns")
    order = [F.desc("uneven"), F.asc("pattern")]
    parted = odd.repartitionByRange(max(1, math.ceil(odd.count() / most)), *order).withColumn("part", F.spark_partition_id())
    parted = tables.put(parted, "parted", by=["part"])
    tables.drop("patterns")
    weight, held = class_weights(totals), [0] * (folds * len(totals))
    parts = sorted(r[0] for r in parted.select("part").distinct().collect())
    for part in parts:
        rows = parted.filter(F.col("part") == part).coalesce(1).sortWithinPartitions(*order).select("pattern", "groups")
        found = tables.put(rows.mapInArrow(_dealing(folds, weight, held), LEFT), f"left/part={part}")
        held = found.filter("held is not null").first()["held"]
    tables.drop("parted")
    if not parts:
        return groups.sparkSession.createDataFrame([], LEFT).drop("held")
    return groups.sparkSession.read.schema(LEFT).parquet(f"{tables.at}/left").filter("held is null").select("pattern", "at", "fold")


def assignments(df: DataFrame, group: str, label: str, folds: int, seed: int = 42, most: int = MOST_PATTERNS) -> DataFrame:
    """One row for each group: the group and its fold (0 to folds - 1).

    Null labels are a class of their own; all rows with a null group are one group. More than MOST_CLASSES classes are an
    error. An empty table gives an empty result. ``most`` says how many histograms a task deals and changes no fold.
    """
    if folds < 2:
        raise ValueError("two folds at least")
    tables = Tables(df.sparkSession)
    cells = df.groupBy(F.col(group).alias("group"), F.coalesce(F.concat(F.lit("="), F.col(label).cast("string")), F.lit("")).alias("class")).agg(F.count("*").alias("n"))
    cells = tables.put(cells, "cells")
    totals = dict(sorted((r["class"], r["n"]) for r in cells.groupBy("class").agg(F.sum("n").alias("n")).limit(MOST_CLASSES + 1).collect()))
    if len(totals) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    count = F.map_from_entries(F.collect_list(F.struct("class", "n")))  # a group's classes
    histogram = F.array(*[F.coalesce(F.try_element_at("of", F.lit(c)), F.lit(0)).cast("long") for c in totals]).cast("array<bigint>")
    groups = cells.groupBy("group").agg(count.alias("of")).select("group", histogram.alias("pattern"), digest(F.col("group"), seed).alias("place"))
    groups = tables.put(groups, "groups")
    tables.drop("cells")
    left = _left_over(groups, list(totals.values()), folds, most, tables)
    at = F.col("below") - (F.col("total") - F.col("total") % folds)
    numbered = ranked(groups.withColumn("n", F.lit(1).cast("long")), ["pattern"], "place").select("group", "pattern", "below", at.alias("at"))
    # a group left over meets one row; joined by a number too, groups of one histogram are spread
    met = numbered.hint("merge").join(bounded_broadcast(left), ["pattern", "at"], "left")
    return met.select(F.col("group").alias(group), F.when(F.col("at") < 0, F.col("below") % folds).otherwise(F.col("fold")).cast("int").alias("fold"))


def stratified(df: DataFrame, group: str, label: str, folds: int, seed: int = 42, name: str = "fold") -> DataFrame:
    """All rows with their fold."""
    told = Tables(df.sparkSession).put(assignments(df, group, label, folds, seed).select(F.col(group).alias("_group"), F.col("fold").alias(name)), "folds")
    return df.hint("merge").join(bounded_broadcast(told), F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def balance(df: DataFrame, label: str, folds: int) -> DataFrame:
    """For each class and fold of rows with a ``fold``: n and its share of the class's rows, zeros too."""
    counts = df.groupBy(label).agg(*[F.count_if(F.col("fold") == k).alias(f"n{k}") for k in range(folds)], F.count("*").alias("total"))
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("fold"), F.col(f"n{k}").alias("n")) for k in range(folds)]))
    return counts.select(label, "total", each.alias("x")).select(label, "x.fold", "x.n", (F.col("x.n") / F.col("total")).alias("share"))
