"""Classifiers on feature tables: feature selection, a soft vote of three models, grouped folds, overrides of close pairs.

Spark ML fits on partitioned data. Where the wanted model has no Spark form, a stand-in is used and named: a radial-basis
support vector machine is a linear one on random Fourier features, histogram boosting is Spark's gradient-boosted trees.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LinearSVC, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.feature import StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frond.operators.folds import stratified

#: Classes that one-against-rest models fit side by side: their jobs are short, and one after another they leave the cluster idle.
AT_ONCE = 5


def assembled(df: DataFrame, columns: list[str], label: str, labels: list[str] | None = None) -> tuple[DataFrame, list[str]]:
    """features (a scaled vector) and y (the label's place in alphabetical order), and the labels in that order."""
    if labels is None:
        labels = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(df).labels
    y = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col(label).cast("string")) - 1
    made = VectorAssembler(inputCols=columns, outputCol="_raw", handleInvalid="keep").transform(df.withColumn("y", y.cast("double")))
    return made, list(labels)


def scaler() -> StandardScaler:
    return StandardScaler(inputCol="_raw", outputCol="features", withMean=True, withStd=True)


def fourier(df: DataFrame, columns: list[str], gamma: float, size: int, seed: int = 7) -> tuple[DataFrame, list[str]]:
    """Random Fourier features of a radial-basis kernel, as columns; a linear model on them stands in for a kernel machine."""
    rng = np.random.default_rng(seed)
    w = rng.normal(0, np.sqrt(2 * gamma), (len(columns), size))
    b = rng.uniform(0, 2 * np.pi, size)
    x = F.array(*[F.col(c).cast("double") for c in columns])

    def run(rows: pd.Series) -> pd.Series:
        m = np.array(rows.to_list(), dtype=float).reshape(len(rows), len(columns))
        s = np.tile(b, (len(rows), 1))
        for k in range(len(columns)):  # one column after another, so that sums are rounded as if made row by row
            s += m[:, k : k + 1] * w[k]
        return pd.Series(list(s), index=rows.index)

    names = [f"rff_{j}" for j in range(size)]
    told = df.withColumn("_x", x).withColumn("_s", F.when(~F.exists("_x", lambda v: v.isNull()), F.pandas_udf(run, "array<double>")("_x")))
    return told.select(*df.columns, *[(F.cos(F.get("_s", F.lit(j))) * F.lit(float(np.sqrt(2 / size)))).alias(n) for j, n in enumerate(names)]), names


def mutual_information(df: DataFrame, columns: list[str], label: str, bins: int = 10) -> DataFrame:
    """(feature, mi): mutual information in nats of each feature, cut into equal-width bins, with the label; two aggregates."""
    ends = df.agg(*[f(c).alias(f"{k}_{c}") for c in columns for k, f in (("lo", F.min), ("hi", F.max))])
    bounded = df.crossJoin(F.broadcast(ends))  # one row
    width = lambda c: F.greatest(F.col(f"hi_{c}") - F.col(f"lo_{c}"), F.lit(1e-12))
    cut = bounded.select(F.col(label).alias("_label"), *[F.least(F.floor((F.col(c) - F.col(f"lo_{c}")) / width(c) * bins), F.lit(bins - 1)).alias(c) for c in columns])
    n = cut.unpivot(["_label"], columns, "feature", "bin").groupBy("feature", "bin", "_label").agg(F.count("*").cast("double").alias("n"))
    whole = F.sum("n").over(Window.partitionBy("feature"))
    joint = n.withColumns({"p": F.col("n") / whole, "px": F.sum("n").over(Window.partitionBy("feature", "bin")) / whole, "py": F.sum("n").over(Window.partitionBy("feature", "_label")) / whole})
    return joint.groupBy("feature").agg(F.sum(F.col("p") * F.log(F.col("p") / (F.col("px") * F.col("py")))).alias("mi"))


def pair_aware_information(df: DataFrame, columns: list[str], label: str, pairs: list[tuple[str, str]], least: int = 20) -> DataFrame:
    """(feature, score): the larger of a feature's share of the best overall information and of the best within any pair."""
    norm = lambda d: d.select("feature", (F.col("mi") / F.greatest(F.max("mi").over(Window.partitionBy()), F.lit(1e-12))).alias("score"))  # noqa: E731  one row a feature
    sizes = dict(df.groupBy(label).count().collect())  # one row a class
    parts = [norm(mutual_information(df, columns, label))]
    parts += [norm(mutual_information(df.filter(F.col(label).isin(a, b)), columns, label)) for a, b in pairs if sizes.get(a, 0) + sizes.get(b, 0) >= least]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("feature").agg(F.max("score").alias("score"))


def selected(scores: DataFrame, k: int, always: tuple[str, ...] = ()) -> list[str]:
    """The names of ``always`` and of the k best others."""
    return [*always, *[r.feature for r in scores.filter(~F.col("feature").isin(*always)).orderBy(F.desc("score"), "feature").limit(k).collect()]]


def forest(trees: int = 60, depth: int = 8, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[scaler(), RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="sqrt")])


def boosted(rounds: int = 10, depth: int = 3, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[scaler(), OneVsRest(labelCol="y", parallelism=AT_ONCE, classifier=GBTClassifier(maxIter=rounds, maxDepth=depth, seed=seed))])


def margins(regularisation: float = 0.01, rounds: int = 50) -> Pipeline:
    return Pipeline(stages=[scaler(), OneVsRest(labelCol="y", parallelism=AT_ONCE, classifier=LinearSVC(maxIter=rounds, regParam=regularisation))])


def linear(regularisation: float = 0.01, rounds: int = 60) -> Pipeline:
    return Pipeline(stages=[scaler(), LogisticRegression(labelCol="y", regParam=regularisation, maxIter=rounds)])


def probabilities(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """The model's class probabilities as an array column; margins of one-against-rest models go through a softmax."""
    from frond.functions.scalars import softmax

    out = model.transform(df)
    if "probability" in out.columns:
        return out.withColumn(name, vector_to_array("probability")).drop("probability", "rawPrediction", "prediction", "features")
    return out.withColumn(name, softmax(vector_to_array("rawPrediction"), 1.0)).drop("rawPrediction", "prediction", "features")


def voted(df: DataFrame, names: list[str], weights: list[float], labels: list[str]) -> DataFrame:
    """The weighted mean of several models' probabilities, and the first label with the largest."""
    total = sum(weights)
    mean = F.transform(F.arrays_zip(*names), lambda z: sum((z[n] * (w / total) for n, w in zip(names, weights)), F.lit(0.0)))
    out = df.withColumn("vote", mean)
    return out.withColumn("label_vote", F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position("vote", F.array_max("vote")).cast("int")))


def overridden(df: DataFrame, pair: tuple[str, str], labels: list[str], specialist: Column) -> DataFrame:
    """Where the two likeliest labels are the pair, the specialist decides; the base probabilities stay as they are."""
    from frond.functions.scalars import top_two

    two = F.array_sort(top_two(F.col("vote"), F.array(*[F.lit(x) for x in labels])))
    close = two == F.array(*[F.lit(x) for x in sorted(pair)])
    return df.withColumns({"overridden": close, "label_final": F.when(close, specialist).otherwise(F.col("label_vote"))})


def pair_specialist(train: DataFrame, columns: list[str], label: str, pair: tuple[str, str], k: int = 15, trees: int = 40, depth: int = 5) -> Callable[[DataFrame], DataFrame]:
    """A forest and a linear model fitted on the rows of one pair of labels, on the ``k`` columns that tell most about it. What it
    returns adds ``specialist`` (the label with the larger mean probability) and ``specialist_p`` to a table with the columns."""
    rows = train.filter(F.col(label).isin(*pair))
    names = selected(mutual_information(rows, columns, label).withColumnRenamed("mi", "score"), k)
    labels = sorted(pair)
    made, _ = assembled(rows, names, label, labels)
    models = [forest(trees, depth).fit(made), linear().fit(made)]

    def decide(df: DataFrame) -> DataFrame:
        out, _ = assembled(df.drop("_raw", "y"), names, label, labels)
        for i, m in enumerate(models):
            out = probabilities(m, out, f"_s{i}")
        out = voted(out, ["_s0", "_s1"], [1.0, 1.0], labels)
        return out.select(*df.drop("_raw", "y").columns, F.col("label_vote").alias("specialist"), F.array_max("vote").alias("specialist_p"))

    return decide


def out_of_fold(df: DataFrame, columns: list[str], label: str, group: str, estimator, folds: int = 3) -> DataFrame:
    """Predictions for every row by a model that saw no row of its group; the folds are stratified by label."""
    made, labels = assembled(stratified(df, group, label, folds), columns, label)
    parts = []
    for k in range(folds):
        train, test = made.filter(F.col("fold") != k), made.filter(F.col("fold") == k)
        predicted = estimator().fit(train).transform(test)
        name = F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("prediction") + 1).cast("int"))
        parts.append(predicted.select(*df.columns, "fold", name.alias("predicted")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def two_stage(df: DataFrame, first: Column, second: Column, passed: str = "healthy") -> DataFrame:
    """The second stage's label for rows that the first flags."""
    return df.withColumn("label_final", F.when(first == passed, F.lit(passed)).otherwise(second))
