"""Queries that fit models; ten classes of 64 values each."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.operators import metrics, ml
from frond.operators.state import Tables
from frond.plans.registry import query
from frond.sources.tables import load

COLUMNS = [f"v{i}" for i in range(64)]


def _features(spark, sf_dir):
    e = load(spark, sf_dir, "embeddings")
    return e.select("vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(COLUMNS)])


@query(
    "mutual_information",
    """WITH t AS (SELECT label, 'v' || (i - 1) AS feature, v FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings)),
b AS (SELECT label, feature, least(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 10), 9) AS bin FROM t WINDOW w AS (PARTITION BY feature)),
n AS (SELECT feature, bin, label, count(*)::DOUBLE AS n FROM b GROUP BY 1, 2, 3),
p AS (SELECT feature, n / sum(n) OVER (PARTITION BY feature) AS p, sum(n) OVER (PARTITION BY feature, bin) / sum(n) OVER (PARTITION BY feature) AS px, sum(n) OVER (PARTITION BY feature, label) / sum(n) OVER (PARTITION BY feature) AS py FROM n)
SELECT feature, round(sum(p * ln(p / (px * py))), 6) AS mi FROM p GROUP BY 1""",
)
def mutual_information(spark, sf_dir):
    mi = ml.mutual_information(_features(spark, sf_dir), COLUMNS, "label")
    return mi.select("feature", F.round("mi", 6).alias("mi"))


PAIR = ("0", "1")


@query("species_vote", None)
def species_vote(spark, sf_dir):
    """A soft vote of a forest, a kernel machine's stand-in on selected columns and boosted trees, with a specialist for one pair;
    trained on four fifths and scored on the rest."""
    tables = Tables(spark)
    df = _features(spark, sf_dir)
    is_train = F.col("vec_id") % 5 > 0
    names = ml.selected(ml.pair_aware_information(df.filter(is_train), COLUMNS, "label", [PAIR]), 24)
    df, waves = ml.fourier(df, names, 0.5, 32)
    df = tables.put(df, "features")
    train, test = df.filter(is_train), df.filter(~is_train)
    parts = {"p_forest": (ml.forest(20, 5), COLUMNS), "p_kernel": (ml.margins(rounds=10), waves), "p_boosted": (ml.boosted(2, 2), names)}
    out = test
    for name, (model, columns) in parts.items():
        made, labels = ml.assembled(train, columns, "label")
        seen, _ = ml.assembled(out.drop("_raw", "y"), columns, "label", labels)
        out = tables.put(ml.probabilities(model.fit(made), seen, name).drop("_raw", "y"), name)
    out = ml.voted(out, list(parts), [1.0, 1.0, 1.0], labels)
    out = ml.pair_specialist(train, COLUMNS, "label", PAIR, trees=15, depth=4)(tables.put(out, "voted"))
    final = ml.overridden(out, PAIR, labels, F.col("specialist"))
    return final.select("vec_id", "label", "label_vote", "label_final", "overridden", F.array_max("vote").alias("confidence"))


@query("grouped_cv", None)
def grouped_cv(spark, sf_dir):
    """Macro F1 of out-of-fold predictions; rows with the same vec_id modulo 50 are one group."""
    df = _features(spark, sf_dir).withColumn("leaf", F.col("vec_id") % 50)
    oof = ml.out_of_fold(df, COLUMNS, "label", "leaf", lambda: ml.forest(10, 4))
    return metrics.scores(oof.select("label", "predicted"), "label", "predicted")


@query("kernel_margins", None)
def kernel_margins(spark, sf_dir):
    """One linear machine for each class on random Fourier features; a fifth of the rows, which none of them saw, is scored."""
    df, names = ml.fourier(_features(spark, sf_dir), COLUMNS, 0.5, 32)
    df = Tables(spark).put(df, "features")
    made, labels = ml.assembled(df, names, "label")
    out = ml.margins(rounds=20).fit(made.filter("vec_id % 5 > 0")).transform(made.filter("vec_id % 5 = 0"))
    return out.select("vec_id", "label", F.element_at(F.array(*[F.lit(x) for x in labels]), (F.col("prediction") + 1).cast("int")).alias("predicted"))
