"""Mixing sources to target weights by capped water-filling.

A budget of words is poured over the sources in proportion to their weights; a source's level stops at its cap (a
number of epochs), and what it can't take is shared again by weight until no source is above its cap. A source's level
is reached by whole repetitions of all its documents and, for the rest, a seeded sample: its documents in the order of a
seeded hash, up to the last one, of which only the words still owed are taken (or the whole document, if that is nearer).

The place in the hash order where a source's sample ends is found by summing sizes by 8 bits of the hash at a time, so
no source's documents are ever sorted in one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frond.llm.common import WORD, left_join_hot, saved, small

LEVELS, BITS = 3, 8


@dataclass(frozen=True)
class Mix:
    """share: of all words, how many the mix has; epochs: the cap; weights: given to the sources in turn, by code point."""

    share: float = 1.5
    epochs: float = 2.0
    weights: tuple[float, ...] = (3, 1, 2)
    seed: int = 20240601


def sized(docs: DataFrame, mix: Mix, text: str = "text") -> DataFrame:
    """Add _key (the source, null told apart), size (words) and _hash (the document's place in the seeded order)."""
    text_ = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns(
        {
            "_key": F.when(F.isnull("source"), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("source"))),
            "size": F.regexp_count(text_, F.lit(WORD)).cast("long"),
            "_hash": F.xxhash64(F.lit(mix.seed), F.col("doc_id"), text_),
        }
    )


def ranked(table: DataFrame, order: Column, name: str) -> DataFrame:
    """Number the rows of a table from 0 in a total order, without bringing them into one task."""
    parts = saved(
        table.repartitionByRange(table.sparkSession.sparkContext.defaultParallelism, order)
        .sortWithinPartitions(order)
        .withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    )
    counts = dict(parts.groupBy("_part").count().collect())  # one row a partition
    starts, total = [], 0
    for part, n in sorted(counts.items()):
        starts.append((part, total))
        total += n
    offsets = table.sparkSession.createDataFrame(starts or [(0, 0)], "_part int, _start long")
    return parts.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_at", "_start")


def targets(rows: DataFrame, mix: Mix) -> DataFrame:
    """One row a source: _key, source_size, n (documents), target. ``rows`` has _key, source and size."""
    sums = rows.groupBy("_key", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    places = ranked(sums, F.col("source").asc_nulls_last(), "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), (F.col("_place") % len(mix.weights) + 1).cast("int"))
    sources = saved(places.withColumns({"_weight": weight, "_cap": F.col("source_size") * mix.epochs}))
    budget = mix.share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:  # each turn raises the level; it ends when no more sources are above their caps
        above = F.col("_cap") < F.col("_weight") * F.lit(level)
        full, caps, open_weight = sources.agg(
            F.count_if(above), F.coalesce(F.sum(F.when(above, F.col("_cap"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~above, F.col("_weight"))), F.lit(0.0))
        ).first()
        if full == before or not open_weight:
            break
        level, before = (budget - caps) / open_weight, full
    target = F.least(F.col("_cap"), F.col("_weight") * F.lit(level)) if open_weight else F.col("_cap")
    return sources.withColumn("target", target).select("_key", "source_size", "n", "target")


def _prefix(level: int) -> Column:
    """The first bits of the hash, as an unsigned number."""
    return F.shiftrightunsigned("_hash", 64 - BITS * level)


def cuts(rows: DataFrame, mix: Mix, total: int) -> DataFrame:
    """One row a source, saved: with _whole (repetitions of every document), _cut (the prefix in which its sample ends, -1 for
    none) and _owed (words that the documents with this prefix must give)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    info = targets(rows, mix).withColumn("_whole", whole)
    owed = F.round(F.col("target") - F.col("_whole") * F.col("source_size")).cast("long")
    info = saved(info.withColumn("_owed", owed).withColumn("_cut", F.when(F.col("_owed") > 0, F.lit(0)).otherwise(F.lit(-1)).cast("long")))
    for level in range(1, LEVELS + 1):
        # source_size > 0 and _cut >= 0 wherever words are owed, so the first prefix that reaches them is always found
        inside = left_join_hot(rows.select("_key", "size", "_hash"), info.select("_key", "n", "_cut", "_owed"), "_key", "n", total).filter(
            (F.col("_cut") >= 0) & ((_prefix(level - 1) == F.col("_cut")) if level > 1 else F.lit(True))
        )
        sums = inside.groupBy("_key", _prefix(level).alias("_next"), "_owed").agg(F.sum("size").alias("_size"))
        so_far = F.sum("_size").over(Window.partitionBy("_key").orderBy("_next"))
        reached = (
            sums.withColumn("_so_far", so_far)
            .filter(F.col("_so_far") >= F.col("_owed"))
            .groupBy("_key")
            .agg(F.min_by(F.struct("_next", (F.col("_owed") - F.col("_so_far") + F.col("_size")).alias("_left")), "_next").alias("_found"))
        )
        info = saved(
            info.join(reached, "_key", "left").select(
                "_key", "source_size", "n", "target", "_whole", F.coalesce("_found._next", "_cut").alias("_cut"), F.coalesce("_found._left", "_owed").alias("_owed")
            )
        )
    return info


def allocate(rows: DataFrame, info: DataFrame, total: int, parts: bool) -> DataFrame:
    """Add source_size, target and taken (words) to sized rows, all of whose columns stay."""
    known = rows.join(F.broadcast(info.drop("n")), "_key", "left") if small(info) else left_join_hot(rows, info, "_key", "n", total).drop("n")
    here = _prefix(LEVELS)
    ends = (F.col("_cut") >= 0) & (here == F.col("_cut"))
    sure = known.filter(~ends).withColumn("_more", F.when((F.col("_cut") >= 0) & (here < F.col("_cut")), F.col("size")).otherwise(F.lit(0)))
    before = F.sum("size").over(Window.partitionBy("_key").orderBy("_hash", "size").rowsBetween(Window.unboundedPreceding, -1))
    still = F.col("_owed") - F.coalesce(before, F.lit(0))
    last = still if parts else F.when(still * 2 >= F.col("size"), F.col("size")).otherwise(F.lit(0))
    more = F.when(still <= 0, F.lit(0)).when(still >= F.col("size"), F.col("size")).otherwise(last)
    edge = known.filter(ends).withColumn("_more", more)
    taken = (F.col("_whole") * F.col("size") + F.col("_more")).cast("long")
    return sure.unionByName(edge).withColumn("taken", taken).drop("_key", "_hash", "_cut", "_owed", "_more")


def shares(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """doc_id, size, source_size, target and taken for every row of ``docs`` (doc_id, text, source).

    A null text has no words; null sources form one source, which comes last; null ids and repeated rows are rows like
    any other. A source without words has target 0. An empty table gives an empty result. Other columns are ignored.
    """
    rows = saved(sized(docs.select("doc_id", "text", "source"), mix).drop("text"))
    total = rows.count()
    return allocate(rows, cuts(rows, mix, total), total, parts=True).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as it is taken (here in whole documents)."""
    names = docs.columns
    rows = saved(sized(docs.select("doc_id", "text", "source"), mix).drop("text"))
    total = rows.count()
    kept = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), "doc_id", "text", "source")
    taken = allocate(sized(kept, mix), cuts(rows, mix, total), total, parts=False)
    # a document without words goes along as often as its source's documents are repeated whole
    copies = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.col("_whole")).cast("int")
    return taken.withColumn("_copies", copies).filter("_copies > 0").withColumn("_copy", F.explode(F.array_repeat(F.lit(True), F.col("_copies")))).select("_doc.*")
