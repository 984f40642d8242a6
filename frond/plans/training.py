"""Queries of trainers and searches: documents with labels stand in for leaves, languages for species, sources for plants."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from frond.operators import folds, ml, training
from frond.plans.registry import query
from frond.plans.series import _FOLDS, FOLDS
from frond.sources.tables import load

FEATURES = ["words", "chars", "distinct_share", "capital_share", "symbol_share", "line_share"]
ORDER = ["healthy", "low", "high"]


def labelled_documents(spark, sf_dir):
    """Features of every labelled document, its language, source and level."""
    text, level = F.coalesce("text", F.lit("")), F.when(F.col("quality") == 1, "healthy").when(F.col("toxic") == 1, "high").otherwise("low")
    docs = load(spark, sf_dir, "documents").join(load(spark, sf_dir, "labels"), "doc_id").withColumns({"t": text, "w": F.split(text, r"\s+"), "level": level})
    n = F.greatest(F.length("t"), F.lit(1))
    share = lambda drop: (F.length("t") - F.length(F.regexp_replace("t", drop, ""))) / n
    return docs.select(
        "doc_id", "lang", "source", "level", F.size("w").cast("double").alias("words"), F.length("t").cast("double").alias("chars"),
        (F.size(F.array_distinct("w")) / F.size("w")).alias("distinct_share"), share("[A-Z]").alias("capital_share"), share("[#$%&*|<>]").alias("symbol_share"), share("\\n").alias("line_share"),
    )


@query(
    "fold_baselines",
    f"""WITH RECURSIVE {_FOLDS}, o AS (SELECT o_orderstatus, o_totalprice AS price, (o_custkey % 31)::DOUBLE AS customer, fold FROM orders JOIN a ON g = o_custkey WHERE o_orderpriority < '4'),
l AS (UNPIVOT o ON price, customer INTO NAME feature VALUE v), k AS (SELECT unnest(range(0, 5))::INT AS test_fold),
q AS (SELECT test_fold, o_orderstatus, feature, count(*) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) AS q3 FROM l, k WHERE fold <> test_fold GROUP BY 1, 2, 3)
SELECT test_fold, o_orderstatus, feature, n, round(CASE WHEN n >= 3 AND q3 - q1 > 1e-6 THEN q2 END, 6) AS median, round(CASE WHEN n >= 3 AND q3 - q1 > 1e-6 THEN q3 - q1 END, 6) AS iqr FROM q""",
)
def fold_baselines(spark, sf_dir):
    """For every fold of customers, medians and IQRs of the urgent orders of all others."""
    o = folds.stratified(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", FOLDS)
    o = o.select("o_orderstatus", "o_orderpriority", "fold", F.col("o_totalprice").alias("price"), (F.col("o_custkey") % 31).alias("customer"))
    long = training.long_values(o, ["o_orderstatus", "o_orderpriority", "fold"], ["price", "customer"])
    found = training.fold_baselines(long, "o_orderstatus", F.col("o_orderpriority") < "4", FOLDS)
    return found.select("test_fold", "o_orderstatus", "feature", "n", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


@query("stage1_cv", None)
def stage1_cv(spark, sf_dir):
    """Macro F1 and threshold of a first stage in each of three folds of sources."""
    rows = training.cross_validated(labelled_documents(spark, sf_dir), FEATURES, "lang", "level", "healthy", "source", 3, 2)
    return training.by_fold(rows)


@query("index_trainer", None)
def index_trainer(spark, sf_dir):
    """What the search for a smaller index tried; a fifth of the sources are the test rows."""
    docs = labelled_documents(spark, sf_dir).withColumn("test", F.pmod(F.xxhash64("source"), F.lit(5)) == 0).cache()
    _, told = training.better_index(docs.filter("not test"), docs.filter("test"), FEATURES, "lang", "level", ORDER)
    return spark.createDataFrame(told, "trial int, left_out string, auc double, accepted boolean")


def _regression(regularisation: float, rounds: int) -> Pipeline:
    return Pipeline(stages=[ml.scaler(), LogisticRegression(labelCol="y", regParam=regularisation, maxIter=rounds)])


@query("random_search", None)
def random_search(spark, sf_dir):
    """Four drawn settings of a classifier of all 64 values, each over three folds."""
    e = load(spark, sf_dir, "embeddings")
    names = [f"v{i}" for i in range(64)]
    df = e.select("vec_id", F.col("label").cast("string").alias("label"), (F.col("vec_id") % 50).alias("leaf"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(names)])
    results = training.searched(df, names, "label", "leaf", _regression, training.drawn(4, 42, regularisation=(1e-3, 1.0), rounds=[10, 20, 40]))
    best = training.best_trial(results)[0]
    return spark.createDataFrame([(t, s["regularisation"], s["rounds"], f1, t == best) for t, s, _, f1 in results], "trial int, regularisation double, rounds int, f1_macro double, best boolean")


@query(
    "vote_weight_sweep",
    """WITH p AS (SELECT l.quality::VARCHAR AS y, (l.doc_id % 3) / 4.0 AS a, (l.doc_id % 7) / 8.0 AS b, (l.doc_id % 5) / 8.0 AS c FROM labels l),
w(w, x, y2, z) AS (VALUES ('1:1:1', 1.0, 1.0, 1.0), ('2:1:1', 2.0, 1.0, 1.0), ('1:2:1', 1.0, 2.0, 1.0), ('1:0:1', 1.0, 0.0, 1.0)),
v AS (SELECT w, y, CASE WHEN a * x + b * y2 + c * z <= (1 - a) * x + (1 - b) * y2 + (1 - c) * z THEN '0' ELSE '1' END AS v FROM p, w),
c AS (SELECT w, k, count(*) FILTER (y = k AND v = k) AS tp, count(*) FILTER (y = k) AS t, count(*) FILTER (v = k) AS p FROM v, (SELECT unnest(['0', '1']) AS k) GROUP BY 1, 2),
f AS (SELECT w AS weights, sum(t)::BIGINT AS n, sum(tp) / sum(t) AS accuracy, avg(CASE WHEN t + p > 0 THEN 2 * tp / (t + p) ELSE 0 END) AS f1_macro FROM c WHERE t + p > 0 GROUP BY 1)
SELECT weights, n, round(accuracy, 9) AS accuracy, round(f1_macro, 9) AS f1_macro, row_number() OVER (ORDER BY round(f1_macro, 12) DESC, weights)::INT AS place FROM f""",
)
def vote_weight_sweep(spark, sf_dir):
    """A vote of three rules under four sets of weights, best first."""
    k = F.col("doc_id")
    two = lambda p: F.array(1 - p, p)
    p = load(spark, sf_dir, "labels").select(F.col("quality").cast("string").alias("y"), two(k % 3 / 4).alias("a"), two(k % 7 / 8).alias("b"), two(k % 5 / 8).alias("c"))
    s = training.vote_weights(p, ["a", "b", "c"], ["0", "1"], "y", [[1, 1, 1], [2, 1, 1], [1, 2, 1], [1, 0, 1]])
    return s.select("weights", "n", F.round("accuracy", 9).alias("accuracy"), F.round("f1_macro", 9).alias("f1_macro"), "place")
