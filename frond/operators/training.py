"""Trainers: a first stage with baselines per fold and a tuned threshold, an anchored index with an accept-if-better guard, and
searches over settings.

Statistics of all folds are made in one pass: a row goes to every fold that it trains, and the fold is one more key of the
groups. Models are fitted by Spark ML on partitioned tables; only their coefficients, thresholds and scores reach the driver.
What is read again and again is written as a table in the shared folder first, which also keeps plans short.
"""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from itertools import product

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from frond.functions.scalars import robust_z
from frond.operators import folds, index, inference, metrics, ml
from frond.operators.joins import bounded_broadcast
from frond.operators.ranks import quantiles, ranked, value_counts
from frond.operators.state import Tables
from frond.operators.stats import BASELINE_LEAST, BASELINE_SPREAD

# Fixed values of the first stage and of the index.
ELEVATED = (1.0, 1.5, 2.0)
Z_BOUND, INDEX_Z_BOUND = 6.0, 5.0
THRESHOLDS = [(30 + 2 * i) / 100 for i in range(21)]
MISSING = -1.0
NORM_LEAST, NORM_FLOOR, ANCHOR_LEAST = 5, 0.25, 15

QUARTERS = {"q1": 0.25, "q2": 0.5, "q3": 0.75}


def _quartiles(long: DataFrame, groups: list[str]) -> DataFrame:
    """n, q1, q2, q3 of ``value`` for each group, exact, with large groups spread over tasks. The counts are read three times, so
    they are written."""
    counts = Tables(long.sparkSession).put(value_counts(long, groups, "value"), "counts")
    return quantiles(ranked(counts, groups, "value"), groups, "value", QUARTERS)


def long_values(df: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(keys, feature, value) of all numbers in ``columns``: neither null nor NaN."""
    long = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot(keys, columns, "feature", "value")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def baselines(long: DataFrame, group: str, healthy: Column, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, group, feature, n, median, iqr) over the healthy rows of a long table: both null below three rows or without spread."""
    keys = [*by, group, "feature"]
    return _usable(_quartiles(long.filter(healthy), keys), keys)


def _usable(q: DataFrame, keys: list[str]) -> DataFrame:
    ok = (F.col("n") >= BASELINE_LEAST) & (F.col("q3") - F.col("q1") > BASELINE_SPREAD)
    return q.select(*keys, "n", F.when(ok, F.col("q2")).alias("median"), F.when(ok, F.col("q3") - F.col("q1")).alias("iqr"))


def fold_baselines(long: DataFrame, group: str, healthy: Column, n_folds: int) -> DataFrame:
    """``baselines`` for every held-out fold, of the rows in all other folds: (test_fold, group, feature, n, median, iqr).

    ``long`` has a column ``fold``; a row is counted for each fold but its own, so no fold's rows touch their own baseline.
    """
    others = F.filter(F.sequence(F.lit(0), F.lit(n_folds - 1)), lambda k: k != F.col("fold"))
    keys = ["test_fold", group, "feature"]
    # equal values of one fold are counted before the folds that they train multiply them
    own = value_counts(long.filter(healthy), [group, "feature", "fold"], "value").withColumn("test_fold", F.explode(others))
    counts = Tables(long.sparkSession).put(own.groupBy(*keys, "value").agg(F.sum("n").alias("n")), "counts")
    return _usable(quantiles(ranked(counts, keys, "value"), keys, "value", QUARTERS), keys)


def relative(df: DataFrame, columns: list[str], group: str, base: DataFrame, on: list[str]) -> DataFrame:
    """Adds z_<column>, the robust z within ±Z_BOUND of each column by its group's baseline (null where there is none), and
    n_elevated_<threshold>, how many of them are at least that far out. ``base`` is keyed by ``on`` and feature."""
    one = base.filter("median is not null").groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "iqr")))).alias("_base"))
    met = df.join(bounded_broadcast(one), on, "left")
    z = {}
    for c in columns:
        b = F.try_element_at("_base", F.lit(c))
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        z[c] = robust_z(x, b["median"], b["iqr"], Z_BOUND)
    out = met.select(*df.columns, *[v.alias(f"z_{c}") for c, v in z.items()])
    far = lambda t: sum((F.when(F.abs(F.col(f"z_{c}")) >= t, 1).otherwise(0) for c in columns), F.lit(0))
    return out.withColumns({f"n_elevated_{str(t).replace('.', '_')}": far(t) for t in ELEVATED})


def matrix(df: DataFrame, columns: list[str], group: str, groups: list[str]) -> tuple[DataFrame, list[str]]:
    """The model's columns: raw ones, z, elevated counts and a 0/1 column for each of ``groups``; what is missing is -1."""
    wide = [*columns, *[f"z_{c}" for c in columns], *[f"n_elevated_{str(t).replace('.', '_')}" for t in ELEVATED]]
    names = [*wide, *[f"is_{k}" for k in range(len(groups))]]
    filled = {c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")), F.lit(MISSING)) for c in wide}
    return df.withColumns(filled | {f"is_{k}": (F.coalesce(F.col(group).cast("string"), F.lit("")) == g).cast("double") for k, g in enumerate(groups)}), names


def balanced(df: DataFrame, y: str = "y", name: str = "w") -> DataFrame:
    """A weight for each row that gives both classes of ``y`` (0 or 1) the same total."""
    one = df.agg(F.count("*").alias("_n"), F.sum(y).alias("_pos"))  # one row
    n, pos = F.col("_n"), F.col("_pos")
    weight = F.when(F.col(y) == 1, n / (2 * F.greatest(pos, F.lit(1)))).otherwise(n / (2 * F.greatest(n - pos, F.lit(1))))
    return df.crossJoin(F.broadcast(one)).withColumn(name, weight).drop("_n", "_pos")


def _vector(df: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="_raw").transform(df)


def _scored(model: PipelineModel, df: DataFrame, names: list[str]) -> DataFrame:
    out = model.transform(_vector(df, names))
    return out.withColumn("p", vector_to_array("probability")[1]).drop("_raw", "features", "rawPrediction", "probability", "prediction")


def logistic() -> Pipeline:
    from pyspark.ml.classification import LogisticRegression

    return Pipeline(stages=[ml.scaler(), LogisticRegression(labelCol="y", weightCol="w", regParam=0.01, maxIter=25)])


def out_of_fold(df: DataFrame, names: list[str], group: str, estimator: Callable[[], Pipeline], n_folds: int) -> DataFrame:
    """Every row of ``df`` (with y) with the probability ``p`` by a model that saw no row of its group."""
    dealt = Tables(df.sparkSession).put(folds.stratified(df, group, "y", n_folds, name="_inner"), "dealt")
    parts = []
    for k in range(n_folds):
        train = balanced(dealt.filter(F.col("_inner") != k))
        parts.append(_scored(estimator().fit(_vector(train, names)), dealt.filter(F.col("_inner") == k), names))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def by_fold(rows: DataFrame) -> DataFrame:
    """For each fold of ``cross_validated``: n, threshold, accuracy and macro F1 over the two classes, in one aggregate."""
    y, p = F.col("y") == 1, F.col("predicted") == 1
    c = rows.groupBy("fold").agg(F.count("*").alias("n"), F.first("threshold").alias("threshold"), F.count_if(y & p).alias("tp"), F.count_if(~y & ~p).alias("tn"), F.count_if(y != p).alias("miss"))
    f1 = lambda hit: F.when(2 * F.col(hit) + F.col("miss") > 0, 2 * F.col(hit) / (2 * F.col(hit) + F.col("miss"))).otherwise(0.0)
    return c.select("fold", "n", "threshold", ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), ((f1("tp") + f1("tn")) / 2).alias("f1_macro"))


def tuned_threshold(oof: DataFrame) -> float:
    """The first of THRESHOLDS with the largest macro F1 of ``p`` against y."""
    return metrics.best_threshold(metrics.threshold_sweep(oof, "p", F.col("y") == 1, THRESHOLDS)).first()["t"]


@dataclass
class Stage1:
    """A fitted first stage; ``score`` gives new rows p and predicted."""

    model: PipelineModel
    threshold: float
    base: DataFrame
    columns: list[str]
    group: str
    groups: list[str]

    def score(self, df: DataFrame) -> DataFrame:
        made, names = matrix(relative(df, self.columns, self.group, self.base, [self.group]), self.columns, self.group, self.groups)
        p = _scored(self.model, made, names)
        added = [n for n in p.columns if n not in df.columns and n != "p"]
        return p.drop(*added).withColumn("predicted", (F.col("p") >= self.threshold).cast("int"))

    def importances(self, names_only: int) -> list[tuple[str, float, bool]]:
        """The ``names_only`` columns with the largest weight (coefficients' size, or a forest's importance), and whether each is
        relative to its group."""
        fitted = self.model.stages[-1]
        size = fitted.featureImportances.toArray() if hasattr(fitted, "featureImportances") else np.abs(fitted.coefficients.toArray())
        names = [*self.columns, *[f"z_{c}" for c in self.columns], *[f"n_elevated_{str(t).replace('.', '_')}" for t in ELEVATED], *[f"is_{g}" for g in self.groups]]
        ranked_names = sorted(zip(names, size.tolist()), key=lambda x: (-x[1], x[0]))[:names_only]
        return [(n, s, n.startswith(("z_", "n_elevated"))) for n, s in ranked_names]


def known_groups(df: DataFrame, group: str, most: int = 1000) -> list[str]:
    found = sorted(r[0] for r in df.select(F.coalesce(F.col(group).cast("string"), F.lit(""))).distinct().limit(most + 1).collect())
    if len(found) > most:
        raise ValueError(f"more than {most} groups")
    return found


def fit_stage1(df: DataFrame, columns: list[str], group: str, level: str, healthy: str, leaf: str, inner: int = 3, estimator: Callable[[], Pipeline] = logistic) -> Stage1:
    """The first stage on all rows: baselines from their healthy ones, the threshold from out-of-fold probabilities."""
    groups = known_groups(df, group)
    base = baselines(long_values(df, [group, level], columns), group, F.col(level) == healthy)
    made, names = matrix(relative(df, columns, group, base, [group]), columns, group, groups)
    made = Tables(df.sparkSession).put(made.withColumn("y", (F.col(level) != healthy).cast("int")), "made")
    threshold = tuned_threshold(out_of_fold(made, names, leaf, estimator, inner))
    return Stage1(estimator().fit(_vector(balanced(made), names)), threshold, base, columns, group, groups)


def cross_validated(
    df: DataFrame, columns: list[str], group: str, level: str, healthy: str, leaf: str, n_folds: int = 5, inner: int = 3, estimator: Callable[[], Pipeline] = logistic
) -> DataFrame:
    """Every row with fold, p, threshold and predicted (1: not healthy) of a first stage that saw no row of its fold: neither its
    model, nor its threshold, nor the baselines of its groups. Rows of one ``leaf`` are in one fold."""
    groups = known_groups(df, group)
    tables = Tables(df.sparkSession)
    dealt = tables.put(folds.stratified(df.withColumn("y", (F.col(level) != healthy).cast("int")), leaf, "y", n_folds), "dealt")
    base = tables.put(fold_baselines(long_values(dealt, [group, level, "fold"], columns), group, F.col(level) == healthy, n_folds), "base")
    parts = []
    for k in range(n_folds):
        own = base.filter(F.col("test_fold") == k).drop("test_fold")
        made, names = matrix(relative(dealt, columns, group, own, [group]), columns, group, groups)
        made = tables.put(made, f"made-{k}")
        train = made.filter(F.col("fold") != k)
        threshold = tuned_threshold(out_of_fold(train, names, leaf, estimator, inner))
        model = estimator().fit(_vector(balanced(train), names))
        p = _scored(model, made.filter(F.col("fold") == k), names)
        parts.append(p.select(*df.columns, "fold", "y", "p", F.lit(threshold).alias("threshold"), (F.col("p") >= threshold).cast("int").alias("predicted")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# The anchored index.


@dataclass
class Index:
    """Weights of robust, sign-corrected z-scores, and the bounds of the 0 to 100 scale by group; ``score`` adds raw and value."""

    columns: list[str]
    weights: dict[str, float]
    norms: DataFrame
    overall: dict[str, tuple[float, float]]
    anchors: DataFrame
    low: float
    high: float
    group: str

    def normed(self, df: DataFrame) -> DataFrame:
        return _normed(df, self.columns, self.group, self.norms, self.overall)

    def score(self, df: DataFrame) -> DataFrame:
        z = self.normed(df)
        raw = sum((F.col(f"_z_{c}") * w for c, w in self.weights.items()), F.lit(0.0))
        out = z.withColumn("raw", raw).join(bounded_broadcast(self.anchors), self.group, "left").select(*df.columns, "raw", "_low", "_high")
        low, high = F.coalesce("_low", F.lit(self.low)), F.coalesce("_high", F.lit(self.high))
        return out.withColumn("value", F.least(F.greatest(100 * (F.col("raw") - low) / F.greatest(high - low, F.lit(1e-6)), F.lit(0.0)), F.lit(100.0))).drop("_low", "_high")


def _normed(df: DataFrame, columns: list[str], group: str, norms: DataFrame, overall: dict[str, tuple[float, float]]) -> DataFrame:
    one = norms.groupBy(group).agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("median", "iqr", "sign")))).alias("_norm"))
    met = df.join(bounded_broadcast(one), group, "left")
    z = {}
    for c in columns:
        b, (m, s) = F.try_element_at("_norm", F.lit(c)), overall[c]
        x = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        value = (x - F.coalesce(b["median"], F.lit(m))) / F.coalesce(b["iqr"], F.lit(s)) * F.coalesce(b["sign"], F.lit(1))
        z[f"_z_{c}"] = F.least(F.greatest(F.coalesce(value, F.lit(0.0)), F.lit(-INDEX_Z_BOUND)), F.lit(INDEX_Z_BOUND))
    return met.withColumns(z).drop("_norm")


@dataclass
class _Normed:
    """What indices of some of ``columns`` share: norms, the rows (group, _healthy, _z_<column>), and X'X and X'y of their z-scores."""

    columns: list[str]
    norms: DataFrame
    overall: dict[str, tuple[float, float]]
    rows: DataFrame
    gram: np.ndarray
    target: np.ndarray
    group: str
    tables: Tables

    def weights(self, columns: list[str]) -> dict[str, float]:
        """The weights of an index of ``columns``: a column's norms and products are the same whatever others there are."""
        at = [self.columns.index(c) for c in columns]
        return dict(zip(columns, index.ridge_weights(self.gram[np.ix_(at, at)], self.target[at]).tolist()))

    def anchored(self, weights: dict[str, float]) -> Index:
        """The index of these weights with its scales."""
        raw = self.rows.select(self.group, "_healthy", _raw(weights).alias("_raw"))
        low, high = raw.agg(F.min("_raw"), F.max("_raw")).first()
        middle = _quartiles(raw.filter("_healthy").select(self.group, F.col("_raw").alias("value")), [self.group]).select(self.group, F.col("q2").alias("_low"))
        tops = raw.groupBy(self.group).agg(F.count("*").alias("_n"), F.max("_raw").alias("_high")).filter(F.col("_n") >= ANCHOR_LEAST).drop("_n")
        norms = self.norms.filter(F.col("feature").isin([*weights]))
        return Index([*weights], weights, norms, self.overall, self.tables.put(tops.join(middle, self.group), "anchors"), low, high, self.group)


def _raw(weights: dict[str, float]) -> Column:
    return sum((F.col(f"_z_{c}") * w for c, w in weights.items()), F.lit(0.0))


def _norms(df: DataFrame, columns: list[str], group: str, level: str, order: list[str], signs: bool) -> _Normed:
    healthy = F.col(level) == order[0]
    if not df.filter(~F.coalesce(F.col(level).isin(order), F.lit(False))).isEmpty():
        raise ValueError(f"levels other than {', '.join(order)}")
    tables = Tables(df.sparkSession)
    place = F.element_at(F.create_map(*[F.lit(x) for k, v in enumerate(order) for x in (v, float(k))]), F.col(level))
    long = tables.put(long_values(df, [group, level], columns).withColumn("_place", place), "long")
    overall = {r.feature: (r.q2, max(r.q3 - r.q1, 1e-6)) for r in _quartiles(long.filter(healthy), ["feature"]).collect()}  # a row a feature
    overall = {c: overall.get(c, (0.0, 1e-6)) for c in columns}
    of = lambda k: F.element_at(F.create_map(*[F.lit(x) for c in columns for x in (c, overall[c][k])]), F.col("feature"))
    own, few = _quartiles(long.filter(healthy), [group, "feature"]), F.col("n") < NORM_LEAST
    norms = own.select(group, "feature", F.when(few, of(0)).otherwise(F.col("q2")).alias("median"), F.when(few, of(1)).otherwise(F.greatest(F.col("q3") - F.col("q1"), NORM_FLOOR * of(1), F.lit(1e-6))).alias("iqr"))
    if signs:
        turned = inference.sign_corrections(long, group, "feature", "_place", "value").select(group, "feature", "sign")
        norms = norms.join(turned, [group, "feature"], "left")
    else:
        norms = norms.withColumn("sign", F.lit(1))
    norms = tables.put(norms, "norms")
    z = _normed(df, columns, group, norms, overall).select(group, healthy.alias("_healthy"), (~healthy).cast("double").alias("_y"), *[f"_z_{c}" for c in columns])
    z = tables.put(z, "z")
    return _Normed(columns, norms, overall, z, *index.gram(z, [f"_z_{c}" for c in columns], "_y"), group, tables)


def fit_index(df: DataFrame, columns: list[str], group: str, level: str, order: list[str], signs: bool = True) -> Index:
    """Non-negative ridge weights of healthy (the first of ``order``) against all other levels.

    Values are normed by their group's healthy median and IQR: those of all groups where a group has fewer than NORM_LEAST
    healthy rows, and an IQR of NORM_FLOOR of the overall one at least. A group's sign for a feature may turn. Groups with
    ANCHOR_LEAST rows and a healthy one have a scale of their own: from the healthy rows' median to the largest score.
    Rows of other levels are an error.
    """
    normed = _norms(df, columns, group, level, order, signs)
    return normed.anchored(normed.weights(columns))


def better_index(train: DataFrame, test: DataFrame, columns: list[str], group: str, level: str, order: list[str], trials: int = 3, least_weight: float = 1e-6) -> tuple[Index, list[tuple[int, str, float, bool]]]:
    """An index, and what was tried: (trial, columns left out, test AUC, accepted).

    Trial 0 has all columns. Each further one leaves out the columns without weight, or else the one with the smallest; it is
    accepted only if it separates the test rows strictly better than the best so far, and the search ends with the first that
    doesn't, after ``trials`` trials, or with one column. All trials share the norms and the normed rows, which are made once;
    a trial is a fit of weights and one AUC, and only the accepted index gets its scales.
    """
    normed = _norms(train, columns, group, level, order, True)
    tested = _normed(test, columns, group, normed.norms, normed.overall).select((F.col(level) != order[0]).alias("_bad"), *[f"_z_{c}" for c in columns])
    tested = normed.tables.put(tested, "tested")

    def area(weights: dict[str, float]) -> float:
        return inference.mann_whitney(tested.select("_bad", _raw(weights).alias("raw")), [], "raw", F.col("_bad")).first()["auc"] or 0.0

    best = normed.weights(columns)
    top = area(best)
    told = [(0, "", top, True)]
    for trial in range(1, trials + 1):
        empty = [c for c, w in best.items() if w <= least_weight]
        out = empty if empty and len(empty) < len(best) else [min(best, key=lambda c: (best[c], c))]
        kept = [c for c in best if c not in out]
        if not kept:
            break
        weights = normed.weights(kept)
        auc = area(weights)
        told.append((trial, ",".join(out), auc, auc > top))
        if auc <= top:
            break
        best, top = weights, auc
    return normed.anchored(best), told


# Searches.


def grid(**settings: list) -> list[dict]:
    """All combinations of the settings' values."""
    return [dict(zip(settings, values)) for values in product(*settings.values())]


def drawn(n: int, seed: int, /, **settings) -> list[dict]:
    """``n`` seeded draws: a list is drawn from evenly, (low, high) of whole numbers as one of them (high left out), of other
    numbers evenly between their logarithms."""
    rng = np.random.default_rng(seed)

    def one(of):
        if isinstance(of, list):
            return of[int(rng.integers(len(of)))]
        low, high = of
        if isinstance(low, int) and isinstance(high, int):
            return int(rng.integers(low, high))
        return float(np.exp(rng.uniform(np.log(low), np.log(high))))

    return [{k: one(v) for k, v in settings.items()} for _ in range(n)]


def searched(df: DataFrame, columns: list[str], label: str, group: str, build: Callable[..., Pipeline], trials: list[dict], n_folds: int = 3, at_once: int = 4) -> list[tuple[int, dict, list[float], float]]:
    """(trial, settings, macro F1 of each fold, mean) for every trial, in order.

    The folds are dealt once and written; trials and folds are jobs of their own, ``at_once`` at a time, which Spark runs side by
    side. ``build`` makes the estimator from a trial's settings.
    """
    made, _ = ml.assembled(folds.stratified(df, group, label, n_folds), columns, label)
    tables = Tables(df.sparkSession)
    made = tables.put(made, "made")

    def score(task: tuple[int, int]) -> float:
        trial, k = task
        model = build(**trials[trial]).fit(made.filter(F.col("fold") != k))
        out = model.transform(made.filter(F.col("fold") == k)).select("y", F.col("prediction").alias("predicted"))
        return metrics.scores(out, "y", "predicted").first()["f1_macro"]

    tasks = [(t, k) for t in range(len(trials)) for k in range(n_folds)]
    with ThreadPoolExecutor(at_once) as pool:
        found = dict(zip(tasks, pool.map(score, tasks)))
    tables.drop("made")
    return [(t, trials[t], fs := [found[t, k] for k in range(n_folds)], float(np.mean(fs))) for t in range(len(trials))]


def best_trial(results: list[tuple[int, dict, list[float], float]]) -> tuple[int, dict, list[float], float]:
    """The first trial with the largest mean."""
    return min(results, key=lambda r: (-round(r[3], 12), r[0]))


def vote_weights(df: DataFrame, names: list[str], labels: list[str], truth: str, weights: list[list[float]]) -> DataFrame:
    """(weights, n, accuracy, f1_macro) of a soft vote for each list of weights, all in one pass over the rows' probabilities."""
    each = []
    weighted = lambda w: lambda z: sum((z[n] * x for n, x in zip(names, w)), F.lit(0.0))
    for w in weights:
        mean = F.transform(F.arrays_zip(*names), weighted(w))
        each.append(F.struct(F.lit(":".join(f"{x:g}" for x in w)).alias("weights"), F.element_at(F.array(*[F.lit(x) for x in labels]), F.array_position(mean, F.array_max(mean)).cast("int")).alias("vote")))
    rows = df.select(F.col(truth).alias("truth"), F.explode(F.array(*each)).alias("e")).select("truth", "e.weights", "e.vote")
    counts = rows.groupBy("weights", "truth", "vote").agg(F.count("*").alias("n"))
    hit = F.when(F.col("truth") == F.col("vote"), F.col("n")).otherwise(0)
    sides = counts.select("weights", F.col("truth").alias("label"), hit.alias("tp"), F.col("n").alias("t"), F.lit(0).alias("p")).unionAll(counts.select("weights", F.col("vote").alias("label"), F.lit(0).alias("tp"), F.lit(0).alias("t"), F.col("n").alias("p")))
    by = sides.groupBy("weights", "label").agg(F.sum("tp").alias("tp"), F.sum("t").alias("t"), F.sum("p").alias("p"))
    f1 = F.when(F.col("t") + F.col("p") > 0, 2 * F.col("tp") / (F.col("t") + F.col("p"))).otherwise(0.0)
    out = by.groupBy("weights").agg(F.sum("t").alias("n"), (F.sum("tp") / F.sum("t")).alias("accuracy"), F.avg(f1).alias("f1_macro"))
    return out.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("f1_macro", 12)), "weights")))  # a row for each list of weights
