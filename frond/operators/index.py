"""Composite indices: weighted sums of robust z-scores, their breakdown, damage sub-scores, non-negative weights."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frond.functions.scalars import mean_of_valid


def weighted_index(z: dict[str, Column], weights: dict[str, float], low: Column, high: Column) -> Column:
    """100 * (z . w - low) / (high - low) within 0 and 100."""
    score = sum((z[f] * F.lit(float(w)) for f, w in weights.items()), F.lit(0.0))
    return F.least(F.greatest(100 * (score - low) / F.greatest(high - low, F.lit(1e-6)), F.lit(0.0)), F.lit(100.0))


def breakdown(long: DataFrame, key: str, weight: Column, places: int = 1) -> DataFrame:
    """For every (key, feature) of a long table of z-scores: its share in percent of the key's positive contributions; all 0
    if these come to nothing."""
    part = long.withColumn("part", F.greatest(F.col("value") * weight, F.lit(0.0)))
    total = F.sum("part").over(Window.partitionBy(key))
    return part.select(key, "feature", F.when(total < 1e-6, F.lit(0.0)).otherwise(F.bround(100 * F.col("part") / total, places)).alias("percentage"))


def symptoms(shares: DataFrame, key: str, labels: DataFrame) -> DataFrame:
    """One row a key: its features with a share, labelled, largest first (ties by name)."""
    told = shares.filter("percentage > 0").join(F.broadcast(labels), "feature")
    entry = F.struct((-F.col("percentage")).alias("order"), F.col("label").alias("name"), F.col("group").alias("group"), F.col("percentage").alias("percentage"))
    return told.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: F.struct(e["name"].alias("name"), e["group"].alias("group"), e["percentage"].alias("percentage"))).alias("symptoms"))


def contributions(long: DataFrame, category: Column, places: int = 1) -> DataFrame:
    """For every category of a long table of contributions: the signed sum and its share of all sizes."""
    sums = long.groupBy(category.alias("category")).agg(F.sum("value").alias("total"))
    whole = F.sum(F.abs("total")).over(Window.partitionBy())  # one row a category
    return sums.withColumn("percentage", F.when(whole > 0, F.bround(100 * F.col("total") / whole, places)).otherwise(0.0))


def sub_score(*values: Column) -> Column:
    """The mean of the valid values (neither null nor -1) within 0 and 100."""
    return F.least(F.greatest(mean_of_valid(F.array(*values)), F.lit(0.0)), F.lit(100.0))


def severity(groups: list[Column], holes: Column | None = None) -> Column:
    """The mean of sub-scores, raised to a floor where there are holes."""
    from frond.functions.scalars import hole_floor

    score = sum(groups[1:], groups[0]) / F.lit(float(len(groups)))
    return score if holes is None else hole_floor(score, holes)


def gram(df: DataFrame, columns: list[str], target: str) -> tuple[np.ndarray, np.ndarray]:
    """X'X and X'y of a table in one aggregate; only their entries leave the cluster."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    row = df.agg(*[F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs], *[F.sum(F.col(c) * F.col(target)).alias(f"t{i}") for i, c in enumerate(columns)]).first()
    g, t = np.zeros((len(columns), len(columns))), np.zeros(len(columns))
    for i, j in pairs:
        g[i, j] = g[j, i] = row[f"g{i}_{j}"] or 0.0
    for i in range(len(columns)):
        t[i] = row[f"t{i}"] or 0.0
    return g, t


def non_negative_ridge(df: DataFrame, columns: list[str], target: str, alpha: float = 1.0, turns: int = 5000) -> dict[str, float]:
    """Weights of a ridge regression without intercept and below no zero, that sum to one; equal weights if all are 0."""
    return dict(zip(columns, ridge_weights(*gram(df, columns, target), alpha, turns).tolist()))


def ridge_weights(g: np.ndarray, t: np.ndarray, alpha: float = 1.0, turns: int = 5000) -> np.ndarray:
    """The same from X'X and X'y: coordinate descent on the Gram matrix, whose size is the number of columns squared."""
    g = g + alpha * np.eye(len(t))
    w = np.zeros(len(t))
    for _ in range(turns):
        before = w.copy()
        for i in range(len(w)):
            w[i] = max(0.0, (t[i] - g[i] @ w + g[i, i] * w[i]) / g[i, i])
        if np.abs(w - before).max() < 1e-12:
            break
    return w / w.sum() if w.sum() > 0 else np.full(len(w), 1 / len(w))
