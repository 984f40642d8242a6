"""Ranks of the trainers read written counts, not the plan that made them, and folds multiply counts, not rows."""

from frond.operators import training
from pyspark.sql import functions as F


def test_counts_are_written_before_they_are_ranked(spark, monkeypatch):
    seen, plain = [], training.ranked

    def spy(counts, groups, value):
        seen.append(counts._jdf.queryExecution().optimizedPlan().toString())
        return plain(counts, groups, value)

    monkeypatch.setattr(training, "ranked", spy)
    long = spark.createDataFrame([(g, k % 3, "f", float(k % 4)) for g in "ab" for k in range(24)], "species string, fold int, feature string, value double")
    base = {(r.test_fold, r.species): (r.n, r.median, r.iqr) for r in training.fold_baselines(long, "species", F.lit(True), 3).collect()}
    one = {r.species: (r.n, r.median, r.iqr) for r in training.baselines(long.filter("fold <> 1"), "species", F.lit(True)).collect()}
    assert {k: v for (fold, k), v in base.items() if fold == 1} == one and len(base) == 6
    assert len(seen) == 2 and not any(x in plan for plan in seen for x in ("Aggregate", "Generate", "explode"))
