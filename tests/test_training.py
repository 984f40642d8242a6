"""Trainers and searches against plain versions on a small table of leaves."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frond.operators import training

COLUMNS = ["a", "b", "noise"]
ORDER = ["healthy", "low", "high"]


def leaves(n=240, seed=3):
    deal = random.Random(seed)
    rows = []
    for i in range(n):
        species, k = deal.choice("pqr"), deal.choice([0, 0, 1, 2])
        base = {"p": 0.0, "q": 5.0, "r": -3.0}[species]
        a = base + 1.5 * k + deal.gauss(0, 0.5)
        b = None if i % 40 == 7 else float("nan") if i % 40 == 9 else (-k if species == "r" else k) * 2.0 + deal.gauss(0, 0.6)
        rows.append((i, i // 3, species, ORDER[k], a, b, deal.random()))
    return rows


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(leaves(), "id long, leaf long, species string, level string, a double, b double, noise double").repartition(2).cache()


def quarters(values):
    q1, q2, q3 = np.percentile(values, [25, 50, 75])
    return (pytest.approx(q2), pytest.approx(q3 - q1)) if len(values) >= 3 and q3 - q1 > 1e-6 else (None, None)


def test_no_fold_touches_its_own_baseline(spark, df):
    dealt = df.withColumn("fold", (F.col("leaf") % 3).cast("int"))
    long = training.long_values(dealt, ["species", "level", "fold"], COLUMNS)
    told = lambda d: {(r.test_fold, r.species, r.feature): (r.n, r.median, r.iqr) for r in training.fold_baselines(d, "species", F.col("level") == "healthy", 3).collect()}
    got = told(long)
    for k in range(3):
        for s in "pqr":
            for at, c in enumerate(COLUMNS, 4):
                values = [r[at] for r in leaves() if r[2] == s and r[3] == "healthy" and r[1] % 3 != k and r[at] is not None and r[at] == r[at]]
                assert got[k, s, c] == (len(values), *quarters(values))
    poisoned = told(long.withColumn("value", F.when(F.col("fold") == 1, 1e6).otherwise(F.col("value"))))
    assert {k: v for k, v in poisoned.items() if k[0] == 1} == {k: v for k, v in got.items() if k[0] == 1}
    assert poisoned[0, "p", "a"] != got[0, "p", "a"]


def test_relative_features(spark, df):
    base = spark.createDataFrame([("p", "a", 5, 1.0, 0.5), ("p", "b", 2, None, None), ("q", "a", 9, 5.0, 0.1)], "species string, feature string, n long, median double, iqr double")
    got = {r.id: r for r in training.relative(df, ["a", "b"], "species", base, ["species"]).collect()}
    assert len(got) == 240
    for i, _, s, _, a, _, _ in leaves():
        m = {"p": (1.0, 0.5), "q": (5.0, 0.1)}.get(s)
        z = None if m is None else max(-6.0, min(6.0, (a - m[0]) / m[1]))
        assert got[i].z_a == (None if z is None else pytest.approx(z)) and got[i].z_b is None
        assert [got[i][f"n_elevated_{t}"] for t in ("1_0", "1_5", "2_0")] == [int(z is not None and abs(z) >= t) for t in (1.0, 1.5, 2.0)]
    made, names = training.matrix(training.relative(df, COLUMNS, "species", base, ["species"]), COLUMNS, "species", ["p", "q", "r"])
    row = made.filter("id = 7").first()
    assert row.b == row.z_b == -1.0 and [row[f"is_{k}"] for k in range(3)].count(1.0) == 1 and len(names) == 3 + 3 + 3 + 3


def f1_macro(pairs):
    out = []
    for k in (0, 1):
        tp, t, p = sum(a == b == k for a, b in pairs), sum(a == k for a, _ in pairs), sum(b == k for _, b in pairs)
        out.append(2 * tp / (t + p) if t + p else 0.0)
    return sum(out) / 2


def test_the_threshold_is_that_of_a_plain_sweep(spark):
    deal = random.Random(1)
    rows = [(int(deal.random() < 0.4), deal.random()) for _ in range(200)]
    rows = [(y, min(1.0, p * 0.7 + 0.3 * y)) for y, p in rows]
    got = training.tuned_threshold(spark.createDataFrame(rows, "y int, p double"))
    each = [(-round(f1_macro([(y, int(p >= t)) for y, p in rows]), 12), t) for t in training.THRESHOLDS]
    assert got == min(each)[1]


def test_first_stage_end_to_end(df):
    rows = training.cross_validated(df, COLUMNS, "species", "level", "healthy", "leaf", 3, 2).cache()
    got = rows.collect()
    assert sorted(r.id for r in got) == list(range(240))
    assert all(len({r.fold for r in got if r.leaf == k}) == 1 for k in range(80))
    assert all(r.predicted == int(r.p >= r.threshold) and r.y == int(r.level != "healthy") for r in got)
    assert f1_macro([(r.y, r.predicted) for r in got]) > 0.85
    for r in training.by_fold(rows).collect():
        own = [(x.y, x.predicted) for x in got if x.fold == r.fold]
        assert r.n == len(own) and r.f1_macro == pytest.approx(f1_macro(own)) and r.accuracy == pytest.approx(sum(a == b for a, b in own) / len(own))
    model = training.fit_stage1(df, COLUMNS, "species", "level", "healthy", "leaf", 2)
    scored = model.score(df.drop("level"))
    assert scored.columns == ["id", "leaf", "species", "a", "b", "noise", "p", "predicted"] and scored.count() == 240
    top = model.importances(4)
    assert len(top) == 4 and [s for _, s, _ in top] == sorted((s for _, s, _ in top), reverse=True) and "noise" not in {n for n, _, _ in top[:2]}


def area(scores, bad):
    pos, neg = [s for s, b in zip(scores, bad) if b], [s for s, b in zip(scores, bad) if not b]
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)


def test_the_index_is_anchored_and_signs_turn(spark, df):
    model = training.fit_index(df, COLUMNS, "species", "level", ORDER)
    signs = {(r.species, r.feature): r.sign for r in model.norms.collect()}
    assert signs["r", "b"] == -1 and signs["p", "a"] == 1  # b falls with damage in r alone
    assert sum(model.weights.values()) == pytest.approx(1) and min(model.weights.values()) >= 0 and model.weights["noise"] < 0.2
    rows = model.score(df).collect()
    assert len(rows) == 240 and all(0 <= r.value <= 100 for r in rows)
    for s in "pqr":
        own = [r for r in rows if r.species == s]
        low, high = float(np.median([r.raw for r in own if r.level == "healthy"])), max(r.raw for r in own)
        assert [r.value for r in own] == pytest.approx([min(100.0, max(0.0, 100 * (r.raw - low) / (high - low))) for r in own])
    new = spark.createDataFrame([(1, "unknown", 2.0, None, 0.5)], "id long, species string, a double, b double, noise double")
    r = model.score(new).first()
    m = {c: model.overall[c] for c in COLUMNS}
    raw = sum(w * (0.0 if c == "b" else max(-5.0, min(5.0, (x - m[c][0]) / m[c][1]))) for (c, w), x in zip(model.weights.items(), (2.0, None, 0.5)))
    assert r.raw == pytest.approx(raw) and r.value == pytest.approx(min(100.0, max(0.0, 100 * (raw - model.low) / (model.high - model.low))))
    with pytest.raises(ValueError, match="levels other than"):
        training.fit_index(df, COLUMNS, "species", "level", ["healthy", "low"])


def test_a_smaller_index_is_taken_only_if_it_separates_better(df):
    train, test = df.filter("leaf % 4 > 0"), df.filter("leaf % 4 = 0")
    model, told = training.better_index(train, test, COLUMNS, "species", "level", ORDER, 2)
    assert told[0][:2] == (0, "") and told[0][3] and 2 <= len(told) <= 3
    best = max(a for _, _, a, ok in told if ok)
    for (_, _, a, _), (_, _, b, ok) in zip(told, told[1:]):
        assert ok == (b > a)
    rows = model.score(test).collect()
    assert area([r.raw for r in rows], [r.level != "healthy" for r in rows]) == pytest.approx(best)


def test_draws_and_grids():
    assert training.grid(a=[1, 2], b=["x"]) == [{"a": 1, "b": "x"}, {"a": 2, "b": "x"}]
    draws = training.drawn(50, 7, c=(1e-3, 10.0), n=(2, 9), k=[None, 3])
    assert draws == training.drawn(50, 7, c=(1e-3, 10.0), n=(2, 9), k=[None, 3]) != training.drawn(50, 8, c=(1e-3, 10.0), n=(2, 9), k=[None, 3])
    assert all(1e-3 <= d["c"] <= 10 and 2 <= d["n"] < 9 and d["k"] in (None, 3) for d in draws)
    assert training.best_trial([(0, {}, [], 0.5), (1, {}, [], 0.7), (2, {}, [], 0.7 + 1e-15)])[0] == 1


def test_searches_agree_with_each_other(df):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression

    from frond.operators import ml

    build = lambda rate: Pipeline(stages=[ml.scaler(), LogisticRegression(labelCol="y", regParam=rate, maxIter=8)])
    trials = training.grid(rate=[0.01, 50.0])
    once = training.searched(df.fillna(0.0), ["a", "b"], "species", "leaf", build, trials, 2)
    again = training.searched(df.fillna(0.0), ["a", "b"], "species", "leaf", build, trials, 2, at_once=1)
    assert [(t, s) for t, s, _, _ in once] == list(enumerate(trials)) and all(len(f) == 2 for _, _, f, _ in once)
    assert [x[3] for x in once] == pytest.approx([x[3] for x in again]) and training.best_trial(once)[0] == 0


def test_vote_weights(spark):
    deal = random.Random(5)
    rows = [(deal.choice("xy"), [p := deal.random(), 1 - p], [q := deal.random(), 1 - q]) for _ in range(100)]
    weights = [[1, 1], [3, 1], [0, 1]]
    got = {r.weights: r for r in training.vote_weights(spark.createDataFrame(rows, "t string, a array<double>, b array<double>"), ["a", "b"], ["x", "y"], "t", weights).collect()}
    for w in weights:
        votes = [("xy"[int(a[1] * w[0] + b[1] * w[1] > a[0] * w[0] + b[0] * w[1])], t) for t, a, b in rows]
        r = got[":".join(map(str, w))]
        assert r.n == 100 and r.accuracy == pytest.approx(sum(v == t for v, t in votes) / 100)
        assert r.f1_macro == pytest.approx(f1_macro([("xy".index(t), "xy".index(v)) for v, t in votes]))
    assert sorted(r.place for r in got.values()) == [1, 2, 3]
