"""Queries that evaluate predictions; labels.quality is the truth and labels.toxic the prediction."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.operators import metrics, project
from frond.plans.registry import query
from frond.sources.tables import load

_CLASSES = "SELECT x::VARCHAR AS label, count(*) FILTER (t = x AND p = x) AS tp, count(*) FILTER (t = x) AS support, count(*) FILTER (p = x) AS n_pred FROM (SELECT source AS t, CASE WHEN doc_id % 5 < 3 THEN source ELSE 'src' || (doc_id % 20) END AS p FROM documents), (SELECT DISTINCT source AS x FROM documents) GROUP BY x"


def _predicted(spark, sf_dir):
    d = load(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("t"))
    return d.withColumn("p", F.when(F.col("doc_id") % 5 < 3, F.col("t")).otherwise(F.concat(F.lit("src"), (F.col("doc_id") % 20).cast("string"))))


@query("confusion", "SELECT t.v AS quality, p.v AS toxic, (SELECT count(*) FROM labels WHERE quality = t.v AND toxic = p.v) AS n FROM (VALUES (0), (1)) t(v), (VALUES (0), (1)) p(v)")
def confusion(spark, sf_dir):
    return metrics.confusion(load(spark, sf_dir, "labels").select("quality", "toxic"), "quality", "toxic")


@query(
    "class_scores",
    f"""SELECT label, support, round(CASE WHEN n_pred > 0 THEN tp / n_pred ELSE 0 END, 9) AS precision, round(CASE WHEN support > 0 THEN tp / support ELSE 0 END, 9) AS recall, round(CASE WHEN n_pred + support > 0 THEN 2 * tp / (n_pred + support) ELSE 0 END, 9) AS f1 FROM ({_CLASSES})""",
)
def class_scores(spark, sf_dir):
    c = metrics.by_class(_predicted(spark, sf_dir), "t", "p")
    return c.select("label", "support", *[F.round(x, 9).alias(x) for x in ("precision", "recall", "f1")])


@query(
    "f1_summary",
    f"""SELECT sum(support)::BIGINT AS n, round(sum(tp) / sum(support), 9) AS accuracy, round(avg(2 * tp / (n_pred + support)), 9) AS f1_macro, round(sum(support * 2 * tp / (n_pred + support)) / sum(support), 9) AS f1_weighted FROM ({_CLASSES})""",
)
def f1_summary(spark, sf_dir):
    s = metrics.scores(_predicted(spark, sf_dir), "t", "p")
    return s.select("n", *[F.round(c, 9).alias(c) for c in ("accuracy", "f1_macro", "f1_weighted")])


@query(
    "pair_accuracy",
    """WITH m(pair, t) AS (VALUES ('a', 'src0'), ('a', 'src1'), ('b', 'src1'), ('b', 'src7'))
SELECT pair, count(*) FILTER (doc_id % 5 < 3 OR source = 'src' || (doc_id % 20)) AS hits, count(*) AS n, round(avg((doc_id % 5 < 3 OR source = 'src' || (doc_id % 20))::INT), 9) AS accuracy FROM documents JOIN m ON source = t GROUP BY 1""",
)
def pair_accuracy(spark, sf_dir):
    from frond.operators.joins import in_pairs

    rows = in_pairs(_predicted(spark, sf_dir), "t", [("src0", "src1"), ("src1", "src7")])
    a = metrics.accuracy_by(rows, "pair", F.col("t") == F.col("p"))
    return a.select(project.lookup(F.col("pair"), {"src0|src1": "a", "src1|src7": "b"}).alias("pair"), "hits", "n", F.round("accuracy", 9).alias("accuracy"))


@query(
    "mcnemar_q",
    """WITH c AS (SELECT quality = (doc_id % 3 > 0)::INT AS a, quality = (doc_id % 5 > 0)::INT AS b FROM labels),
n AS (SELECT count(*) FILTER (a AND b) AS n11, count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (b AND NOT a) AS n01, count(*) FILTER (NOT a AND NOT b) AS n00 FROM c)
SELECT n11, n10, n01, n00, round((n11 * n00 - n10 * n01) / (n11 * n00 + n10 * n01), 9) AS q, round((n10 + n01) / (n11 + n10 + n01 + n00), 9) AS disagreement FROM n""",
)
def mcnemar_q(spark, sf_dir):
    guess = lambda k: F.col("quality") == (F.col("doc_id") % k > 0).cast("int")
    a = metrics.agreement(load(spark, sf_dir, "labels"), guess(3), guess(5))
    return a.select("n11", "n10", "n01", "n00", F.round("q", 9).alias("q"), F.round("disagreement", 9).alias("disagreement"))


_SWEEP = """WITH p AS (SELECT p_size / 50.0 AS p, p_retailprice > 950 OR p_size > 40 AS y FROM part), t AS (SELECT (30 + 2 * i) / 100.0 AS t FROM range(0, 21) r(i)),
c AS (SELECT t, count(*) FILTER (p >= t AND y) AS tp, count(*) FILTER (p >= t AND NOT y) AS fp, count(*) FILTER (p < t AND y) AS fn, count(*) FILTER (p < t AND NOT y) AS tn FROM p, t GROUP BY 1),
f AS (SELECT t::DOUBLE AS t, round((CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END + CASE WHEN tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END) / 2, 9) AS f1_macro FROM c)
"""


def _sweep(spark, sf_dir):
    p = load(spark, sf_dir, "part").select((F.col("p_size") / 50.0).alias("p"), ((F.col("p_retailprice") > 950) | (F.col("p_size") > 40)).alias("y"))
    s = metrics.threshold_sweep(p, "p", F.col("y"), [(30 + 2 * i) / 100 for i in range(21)])
    return s.select("t", F.round("f1_macro", 9).alias("f1_macro"))


@query("threshold_sweep", _SWEEP + "SELECT t, f1_macro FROM f")
def threshold_sweep(spark, sf_dir):
    return _sweep(spark, sf_dir)


@query("best_threshold", _SWEEP + "SELECT t, f1_macro FROM f ORDER BY f1_macro DESC, t LIMIT 1")
def best_threshold(spark, sf_dir):
    return metrics.best_threshold(_sweep(spark, sf_dir))


@query(
    "vote_flips",
    """WITH v AS (SELECT o_custkey % 2 AS y, o_custkey % 4 // 2 AS two, (o_custkey % 3 > 0)::INT AS three FROM orders)
SELECT count(*) AS n, count(*) FILTER (two <> three) AS flips, round(avg((two = y)::INT), 9) AS acc_two, round(avg((three = y)::INT), 9) AS acc_three FROM v""",
)
def vote_flips(spark, sf_dir):
    k = F.col("o_custkey")
    v = load(spark, sf_dir, "orders").select((k % 2).alias("y"), F.floor(k % 4 / 2).alias("two"), (k % 3 > 0).cast("long").alias("three"))
    f = metrics.flips(v, F.col("two"), F.col("three"), "y")
    return f.select("n", "flips", F.round("acc_two", 9).alias("acc_two"), F.round("acc_three", 9).alias("acc_three"))


@query(
    "wrong_crosstab",
    """SELECT lang, count(*) FILTER (quality = 0) AS q0, count(*) FILTER (quality = 1) AS q1 FROM documents JOIN labels USING (doc_id) WHERE quality <> toxic GROUP BY 1""",
)
def wrong_crosstab(spark, sf_dir):
    wrong = load(spark, sf_dir, "documents").select("doc_id", "lang").join(load(spark, sf_dir, "labels").filter("quality <> toxic"), "doc_id")
    return wrong.groupBy("lang").pivot("quality", [0, 1]).count().fillna(0).select("lang", F.col("0").alias("q0"), F.col("1").alias("q1"))
