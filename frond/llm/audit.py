"""How filters act on each other: every order of them is replayed over all documents.

A document's failing filters are the bits of one number. Documents meet a broadcast table of all orders (120 for five
filters), the first failure of each document in each order is computed, the steps of the order are exploded, and sums by
part, order and step are combined on the map side before anything is shuffled: what leaves a task is one row for each
part, order and step, however many documents it has read.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.llm.common import WORD, join_small_or_shuffled, left_join_hot, saved, small

FILTERS = "ABCDE"
MIN_WORDS, MIN_DISTINCT_PERCENT, MAX_CAPITAL_PERCENT, SYMBOLS = 200, 50, 3, "[#$%&*|]"


def _bits(failing: list[Column]) -> Column:
    total = F.lit(0)
    for k, fails in enumerate(failing):
        total = total + F.when(fails, 1 << k).otherwise(0)
    return total


def flags(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text, lang): part (lang, null: empty), fails (the bits of the filters A to E that it
    fails, A lowest), good and toxic (what ``labels`` says).

    A: fewer than MIN_WORDS words. B: distinct words are less than MIN_DISTINCT_PERCENT of all. C: more than
    MAX_CAPITAL_PERCENT of the code points are A-Z. D: one of SYMBOLS. E: the text is also that of a smaller doc_id. A null
    text is empty. Texts are the same if their SHA-256 is. A null doc_id is no copy, no original, and has no labels;
    repeated rows of one id are not each other's copies. If an id has several labels, one that is 1 suffices. Other
    columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    read = docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("part"), text.alias("text"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("words"))
    words, capitals = F.size("words"), F.length(F.regexp_replace("text", "[^A-Z]+", ""))
    own = _bits([
        words < MIN_WORDS,
        100 * F.size(F.array_distinct("words")) < MIN_DISTINCT_PERCENT * words,
        100 * capitals.cast("long") > MAX_CAPITAL_PERCENT * F.length("text").cast("long"),
        F.col("text").rlike(SYMBOLS),
    ])
    rows = saved(read.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2("text", 256)).alias("digest")))
    copied = saved(rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first")).filter("copies > 1"))
    if small(copied):
        told = rows.join(F.broadcast(copied), "digest", "left")
    else:
        told = left_join_hot(rows, copied, "digest", "copies", rows.count())
    fails = F.col("own") + F.when(F.col("doc_id") > F.col("first"), 1 << 4).otherwise(0)
    told = told.select("doc_id", "part", fails.cast("int").alias("fails"))
    one = lambda c: F.max(F.coalesce(F.col(c) == 1, F.lit(False))).alias(c)
    known = saved(labels.filter("doc_id is not null").groupBy("doc_id").agg(one("quality"), one("toxic")))
    labelled = join_small_or_shuffled(told.filter("doc_id is not null"), known, ["doc_id"], "left").unionByName(told.filter("doc_id is null"), allowMissingColumns=True)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    return labelled.select("part", "fails", yes("quality").alias("good"), yes("toxic").alias("toxic"))


def replay(flagged: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row for each part of ``flagged`` (part, fails, good, toxic), order of ``filters`` and step: part, filter_order, step,
    kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Bit k of ``fails`` stands for filter k. All parts have all orders and steps, with zeros where nothing happens; an empty
    table gives an empty result.
    """
    n = len(filters)
    orders = [("".join(filters[k] for k in order), number, *(1 << k for k in order)) for number, order in enumerate(permutations(range(n)))]
    steps = [f"bit{k}" for k in range(1, n + 1)]
    table = flagged.sparkSession.createDataFrame(orders, ", ".join(["filter_order string", "number int", *(f"{x} int" for x in steps)]))
    first = F.lit(n + 1)  # none of them
    for k in range(n, 0, -1):
        first = F.when(F.col("fails").bitwiseAND(F.col(f"bit{k}")) != 0, k).otherwise(first)
    met = flagged.crossJoin(F.broadcast(table.drop("filter_order"))).select("part", "fails", "good", "toxic", "number", *steps, first.alias("first"))
    stack = ", ".join(f"{k}, bit{k}" for k in range(1, n + 1))
    each = met.select("part", "fails", "good", "toxic", "number", "first", F.expr(f"stack({n}, {stack})").alias("step", "bit"))
    here = F.col("first") == F.col("step")
    summed = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    counts = each.groupBy("part", "number", "step").agg(
        summed(F.col("first") > F.col("step"), "kept"),
        summed(here, "removed"),
        summed((F.col("fails").bitwiseAND(F.col("bit")) != 0) & (F.col("first") < F.col("step")), "redundant"),
        summed(F.col("fails") == F.col("bit"), "unique_fails"),
        summed(here & F.col("good"), "good_lost"),
        summed(here & F.col("toxic"), "toxic_lost"),
    )
    named = saved(counts.join(F.broadcast(table.select("number", "filter_order")), "number").withColumn("filter", F.substring("filter_order", F.col("step"), F.lit(1))))
    shapley = named.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return named.join(shapley, ["part", "filter"]).select(
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    )
