"""The pair specialist learns its pair alone, and overrides only where the two likeliest labels are that pair."""

import random

from pyspark.sql import functions as F

from frond.operators import ml


def test_specialist_and_override(spark):
    deal = random.Random(4)
    rows = [(i, c := deal.choice("abc"), (c == "b") * 3.0 + deal.gauss(0, 0.5), deal.random(), (c == "c") * 5.0 + deal.gauss(0, 0.5)) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, label string, u double, noise double, w double")
    out = ml.pair_specialist(df, ["u", "noise", "w"], "label", ("b", "a"), 2, 5, 3)(df.withColumn("y", F.lit("mine")))
    got = {r.id: r for r in out.collect()}
    assert len(got) == 200 and out.columns[:5] == df.columns
    pair = [r for r in got.values() if r.label in "ab"]
    assert sum(r.specialist == r.label for r in pair) / len(pair) > 0.95 and all(0.5 <= r.specialist_p <= 1 and r.specialist in "ab" for r in got.values())
    votes = spark.createDataFrame([(1, [0.5, 0.4, 0.1], "a"), (2, [0.1, 0.5, 0.4], "b"), (3, [0.4, 0.5, 0.1], "b")], "id long, vote array<double>, label_vote string")
    told = {r.id: (r.overridden, r.label_final) for r in ml.overridden(votes, ("a", "b"), ["a", "b", "c"], F.lit("b")).collect()}
    assert told == {1: (True, "b"), 2: (False, "b"), 3: (True, "b")}
