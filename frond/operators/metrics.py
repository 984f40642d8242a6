"""Evaluation of predictions: confusion, precision and recall, agreement of two models, thresholds."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Counts of all pairs of labels that occur on either side, zeros too; as many rows as labels squared."""
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    labels = counts.select(F.col(truth).alias("label")).union(counts.select(predicted)).distinct()
    grid = labels.select(F.col("label").alias(truth)).crossJoin(labels.select(F.col("label").alias(predicted)))
    return grid.join(counts, [truth, predicted], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def by_class(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """support, precision, recall and f1 of every label; a ratio with an empty denominator is 0."""
    counts = df.groupBy(truth, predicted).agg(F.count("*").alias("n"))
    hit = F.when(F.col(truth) == F.col(predicted), F.col("n")).otherwise(0)
    sides = counts.select(F.col(truth).alias("label"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p")).unionAll(counts.select(F.col(predicted).alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("p")))
    s = sides.groupBy("label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("support"), F.sum("p").alias("p"))
    part = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return s.select("label", "support", part(F.col("tp"), F.col("p")).alias("precision"), part(F.col("tp"), F.col("support")).alias("recall"), part(2 * F.col("tp"), F.col("p") + F.col("support")).alias("f1"), "tp")


def scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy, macro and weighted F1."""
    c = by_class(df, truth, predicted)
    n = F.sum("support")
    return c.agg(n.alias("n"), (F.sum("tp") / n).alias("accuracy"), F.avg("f1").alias("f1_macro"), (F.sum(F.col("f1") * F.col("support")) / n).alias("f1_weighted"))


def accuracy_by(df: DataFrame, group: str, correct: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count_if(correct).alias("hits"), F.count("*").alias("n"), F.avg(correct.cast("double")).alias("accuracy"))


def agreement(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """Of two models' correctness: the four counts, Yule's Q, the disagreement, and McNemar's two counts."""
    cells = {"n11": a & b, "n10": a & ~b, "n01": ~a & b, "n00": ~a & ~b}
    out = df.agg(*[F.count_if(c).alias(k) for k, c in cells.items()])
    same, differ = F.col("n11") * F.col("n00"), F.col("n10") * F.col("n01")
    total = F.col("n11") + F.col("n10") + F.col("n01") + F.col("n00")
    return out.select(*cells, F.try_divide((same - differ).cast("double"), (same + differ).cast("double")).alias("q"), F.try_divide((F.col("n10") + F.col("n01")).cast("double"), total.cast("double")).alias("disagreement"))


def mcnemar_p(n10: int, n01: int) -> float:
    """The exact two-sided p-value of McNemar's test, from its two counts."""
    n, k = n10 + n01, min(n10, n01)
    if n == 0:
        return 1.0
    logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) - n * math.log(2) for i in range(k + 1)]
    return min(1.0, 2 * sum(map(math.exp, logs)))


def threshold_sweep(df: DataFrame, p: str, positive: Column, thresholds: list[float]) -> DataFrame:
    """Macro F1 at each threshold, all in one aggregate over the rows; the best is the first with the largest F1."""
    sums = []
    for i, t in enumerate(thresholds):
        yes = F.col(p) >= t
        sums += [F.count_if(yes & positive).alias(f"tp{i}"), F.count_if(yes & ~positive).alias(f"fp{i}"), F.count_if(~yes & positive).alias(f"fn{i}"), F.count_if(~yes & ~positive).alias(f"tn{i}")]
    one = df.agg(*sums)
    rows = F.explode(F.array(*[F.struct(F.lit(t).alias("t"), *[F.col(f"{k}{i}").alias(k) for k in ("tp", "fp", "fn", "tn")]) for i, t in enumerate(thresholds)]))
    out = one.select(rows.alias("r")).select("r.*")
    part = lambda hit, miss: F.when(2 * hit + miss > 0, 2 * hit / (2 * hit + miss)).otherwise(0.0)
    miss = F.col("fp") + F.col("fn")
    return out.select("t", ((part(F.col("tp"), miss) + part(F.col("tn"), miss)) / 2).alias("f1_macro"))


def best_threshold(sweep: DataFrame) -> DataFrame:
    return sweep.agg(F.min_by("t", F.struct(-F.col("f1_macro"), F.col("t"))).alias("t"), F.max("f1_macro").alias("f1_macro"))


def flips(df: DataFrame, two: Column, three: Column, truth: str) -> DataFrame:
    """How often the vote of three models differs from that of two, and how each does."""
    return df.agg(F.count("*").alias("n"), F.count_if(two != three).alias("flips"), F.avg((two == F.col(truth)).cast("double")).alias("acc_two"), F.avg((three == F.col(truth)).cast("double")).alias("acc_three"))
