"""Trials of a smaller index share one set of norms, and each is what a fit of its own columns gives."""

import random

import pytest
from pyspark.sql import functions as F

from frond.operators import inference, training

COLUMNS, ORDER = ["a", "b", "c"], ["healthy", "low", "high"]


def test_norms_are_made_once_for_all_trials(spark, monkeypatch):
    deal = random.Random(11)
    rows = []
    for i in range(160):
        k = deal.choice([0, 0, 1, 2])
        rows.append((i, deal.choice("pq"), ORDER[k], k + deal.gauss(0, 0.8), -k + deal.gauss(0, 2), k / 2 + deal.gauss(0, 1)))
    df = spark.createDataFrame(rows, "id long, species string, level string, a double, b double, c double").repartition(2).cache()
    train, test = df.filter("id % 4 > 0"), df.filter("id % 4 = 0")
    made = []
    signs = inference.sign_corrections
    monkeypatch.setattr(inference, "sign_corrections", lambda *a: made.append(1) or signs(*a))
    _, told = training.better_index(train, test, COLUMNS, "species", "level", ORDER)
    assert len(told) >= 2 and len(made) == 1
    kept, left = list(COLUMNS), []
    for _, out, auc, ok in told:
        left = [c for c in kept if c not in out.split(",")]
        model = training.fit_index(train, left, "species", "level", ORDER)
        assert auc == pytest.approx(inference.mann_whitney(model.score(test), [], "raw", F.col("level") != "healthy").first()["auc"])
        assert {r.feature for r in model.norms.collect()} == set(left)
        kept = left if ok else kept
