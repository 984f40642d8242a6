"""Queries of robust statistics, effect sizes and rank statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.functions import scalars
from frond.operators import joins, project, ranks, stats
from frond.plans.registry import query
from frond.plans.relational import MEASURES
from frond.sources.tables import load

_QUART = "quantile_cont({x}, 0.25) AS q1, quantile_cont({x}, 0.5) AS q2, quantile_cont({x}, 0.75) AS q3"
_LONG_SQL = "UNPIVOT (SELECT l_orderkey, l_returnflag, l_linestatus, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value"


def _long(spark, sf_dir, keys=("l_returnflag",)):
    return project.long_form(load(spark, sf_dir, "lineitem"), list(keys), MEASURES)


@query(
    "species_baseline",
    """WITH t AS (SELECT p_type, CASE WHEN p_size <= 10 THEN p_retailprice END AS x FROM part),
b AS (SELECT p_type, count(x) AS n, quantile_cont(x, 0.5) AS m, quantile_cont(x, 0.75) - quantile_cont(x, 0.25) AS s FROM t GROUP BY 1)
SELECT p_type, n, round(CASE WHEN n >= 3 THEN m END, 6) AS median, round(CASE WHEN n >= 3 AND s > 1e-6 THEN s END, 6) AS iqr FROM b""",
)
def species_baseline(spark, sf_dir):
    b = stats.baseline(load(spark, sf_dir, "part"), "p_type", "p_retailprice", F.col("p_size") <= 10)
    return b.select("p_type", "n", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


@query(
    "norm_stats_fallback",
    f"""WITH b AS (SELECT c_nationkey, count(*) AS n, {_QUART.format(x="c_acctbal")} FROM customer GROUP BY 1), o AS (SELECT {_QUART.format(x="c_acctbal")} FROM customer)
SELECT c_nationkey, n, round(CASE WHEN n < 5 THEN o.q2 ELSE b.q2 END, 6) AS median, round(greatest(CASE WHEN n < 5 THEN o.q3 - o.q1 ELSE b.q3 - b.q1 END, (o.q3 - o.q1) * 0.25), 6) AS iqr FROM b, o""",
)
def norm_stats_fallback(spark, sf_dir):
    return _norm_stats(load(spark, sf_dir, "customer"))


def _norm_stats(c):
    return stats.norm_stats(c, "c_nationkey", "c_acctbal").select("c_nationkey", "n", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"))


@query(
    "robust_z_clip",
    """WITH b AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.5) AS m, quantile_cont(l_extendedprice, 0.75) - quantile_cont(l_extendedprice, 0.25) AS s FROM lineitem GROUP BY 1),
z AS (SELECT l_linestatus, least(greatest((l_extendedprice - m) / s, -6), 6) AS z FROM lineitem JOIN b USING (l_returnflag))
SELECT l_linestatus, count(*) AS n, count(*) FILTER (abs(z) >= 1.0) AS n_10, count(*) FILTER (abs(z) >= 1.5) AS n_15, count(*) FILTER (abs(z) >= 2.0) AS n_20, round(max(z), 6) AS top FROM z GROUP BY 1""",
)
def robust_z_clip(spark, sf_dir):
    li = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_extendedprice")
    q1, q2, q3 = stats.quartiles(F.col("l_extendedprice"))
    b = li.groupBy("l_returnflag").agg(q2.alias("m"), (q3 - q1).alias("s"))
    z = li.join(joins.bounded_broadcast(b), "l_returnflag").select("l_linestatus", scalars.robust_z(F.col("l_extendedprice"), F.col("m"), F.col("s"), 6.0).alias("z"))
    n = {"n_10": 1.0, "n_15": 1.5, "n_20": 2.0}
    return z.groupBy("l_linestatus").agg(F.count("*").alias("n"), *[F.count_if(F.abs("z") >= t).alias(k) for k, t in n.items()], F.round(F.max("z"), 6).alias("top"))


@query(
    "n_elevated",
    """WITH z AS (SELECT l_partkey, (l_quantity - 25) / 12 AS a, (l_discount - 0.05) / 0.03 AS b, (l_tax - 0.04) / 0.03 AS c FROM lineitem)
SELECT l_partkey % 50 AS bucket, sum((abs(a) >= 1.5)::INT + (abs(b) >= 1.5)::INT + (abs(c) >= 1.5)::INT)::BIGINT AS elevated FROM z GROUP BY 1""",
)
def n_elevated(spark, sf_dir):
    z = [(F.col("l_quantity") - 25) / 12, (F.col("l_discount") - 0.05) / 0.03, (F.col("l_tax") - 0.04) / 0.03]
    count = sum((F.when(F.abs(x) >= 1.5, 1).otherwise(0) for x in z), F.lit(0))
    return load(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 50).alias("bucket")).agg(F.sum(count).alias("elevated"))


@query(
    "gap_report",
    f"""WITH t AS ({_LONG_SQL}), g AS (SELECT l_returnflag, feature, count(value) FILTER (l_linestatus = 'F') AS n_low, count(value) FILTER (l_linestatus = 'O') AS n_high,
  quantile_cont(value, 0.5) FILTER (l_linestatus = 'F') AS ml, quantile_cont(value, 0.5) FILTER (l_linestatus = 'O') AS mh, quantile_cont(value, 0.75) FILTER (l_linestatus = 'F') - quantile_cont(value, 0.25) FILTER (l_linestatus = 'F') AS s FROM t GROUP BY 1, 2)
SELECT l_returnflag, feature, n_low, n_high, round(ml, 6) AS median_low, round(mh, 6) AS median_high, round(CASE WHEN s > 1e-6 THEN (mh - ml) / s END, 6) AS effect FROM g""",
)
def gap_report(spark, sf_dir):
    g = stats.gap_report(_long(spark, sf_dir, ("l_returnflag", "l_linestatus")), "l_returnflag", "l_linestatus", "F", "O")
    return g.select("l_returnflag", "feature", "n_low", "n_high", *[F.round(c, 6).alias(c) for c in ("median_low", "median_high", "effect")])


@query(
    "describe_by_level",
    f"""SELECT o_orderpriority, n, round(mean, 4) AS mean, round(std, 4) AS std, lo AS min, round(q1, 6) AS q25, round(q2, 6) AS q50, round(q3, 6) AS q75, hi AS max FROM (
SELECT o_orderpriority, count(o_totalprice) AS n, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS lo, max(o_totalprice) AS hi, {_QUART.format(x="o_totalprice")} FROM orders GROUP BY 1)""",
)
def describe_by_level(spark, sf_dir):
    d = stats.describe(load(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice")
    return d.select("o_orderpriority", "n", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"), "min", *[F.round(c, 6).alias(c) for c in ("q25", "q50", "q75")], "max")


@query(
    "quantiles_in_ranges",
    """SELECT l_returnflag, count(*) AS n, round(quantile_cont(l_extendedprice, 0.1), 6) AS p10, round(quantile_cont(l_extendedprice, 0.5), 6) AS p50, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY 1""",
)
def quantiles_in_ranges(spark, sf_dir):
    """Exact quantiles without holding a group's values in one task."""
    li = load(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    r = ranks.ranked(ranks.value_counts(li, ["l_returnflag"], "l_extendedprice"), ["l_returnflag"], "l_extendedprice")
    q = ranks.quantiles(r, ["l_returnflag"], "l_extendedprice", {"p10": 0.1, "p50": 0.5, "p90": 0.9})
    return q.select("l_returnflag", "n", *[F.round(c, 6).alias(c) for c in ("p10", "p50", "p90")])


@query(
    "column_audit",
    f"""WITH t AS (SELECT feature, CASE WHEN l_orderkey % 9 = 0 THEN NULL WHEN l_orderkey % 9 = 1 THEN -1.0 ELSE value END AS value FROM ({_LONG_SQL}))
SELECT feature, count(*) AS n, round(count(*) FILTER (value IS NULL) / count(*), 9) AS null_share, round(count(*) FILTER (value = -1.0) / count(*), 9) AS sentinel_share, count(DISTINCT CASE WHEN value <> -1.0 THEN value END) AS n_distinct FROM t GROUP BY 1""",
)
def column_audit(spark, sf_dir):
    key = F.col("l_orderkey") % 9
    spoilt = {c: F.when(key == 0, None).when(key == 1, F.lit(-1.0)).otherwise(F.col(c)) for c in MEASURES}
    long = project.long_form(load(spark, sf_dir, "lineitem").select("l_orderkey", *MEASURES).withColumns(spoilt), ["l_orderkey"], MEASURES)
    a = stats.column_audit(long)
    return a.select("feature", "n", F.round("null_share", 9).alias("null_share"), F.round("sentinel_share", 9).alias("sentinel_share"), "n_distinct")


@query(
    "top_offenders",
    f"""SELECT feature, l_orderkey, value, place FROM (SELECT feature, l_orderkey, value, row_number() OVER (PARTITION BY feature ORDER BY value DESC, l_orderkey) AS place FROM (
  SELECT feature, l_orderkey, max(value) AS value FROM ({_LONG_SQL}) GROUP BY 1, 2)) WHERE place <= 5""",
)
def top_offenders(spark, sf_dir):
    """A top-k report: five rows for each feature."""
    from frond.operators.windows import top_n

    m = _long(spark, sf_dir, ("l_orderkey",)).groupBy("feature", "l_orderkey").agg(F.max("value").alias("value"))
    return top_n(m, ["feature"], [F.desc("value"), F.col("l_orderkey")], 5).withColumn("place", F.col("place").cast("long"))


@query(
    "cohens_d",
    f"""WITH t AS ({_LONG_SQL}), s AS (SELECT feature, count(value) FILTER (l_returnflag = 'A') AS n_a, count(value) FILTER (l_returnflag = 'R') AS n_b, avg(value) FILTER (l_returnflag = 'A') AS ma, avg(value) FILTER (l_returnflag = 'R') AS mb,
  var_samp(value) FILTER (l_returnflag = 'A') AS va, var_samp(value) FILTER (l_returnflag = 'R') AS vb FROM t GROUP BY 1)
SELECT feature, n_a, n_b, round((ma - mb) / sqrt(((n_a - 1) * va + (n_b - 1) * vb) / (n_a + n_b - 2)), 6) AS d FROM s""",
)
def cohens_d(spark, sf_dir):
    d = stats.cohens_d(_long(spark, sf_dir), "l_returnflag", "A", "R")
    return d.select("feature", "n_a", "n_b", F.round("d", 6).alias("d"))


@query(
    "auc_rank",
    f"""WITH t AS (SELECT feature, value, l_returnflag FROM ({_LONG_SQL}) WHERE l_returnflag IN ('A', 'R')),
r AS (SELECT feature, l_returnflag, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM t),
u AS (SELECT feature, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n0, sum(r) FILTER (l_returnflag = 'A') AS s FROM r GROUP BY 1)
SELECT feature, n1, n0, round((s - n1 * (n1 + 1) / 2) / (n1 * n0), 9) AS auc, round(2 * (s - n1 * (n1 + 1) / 2) / (n1 * n0) - 1, 9) AS cliffs_delta FROM u""",
)
def auc_rank(spark, sf_dir):
    a = stats.auc(_long(spark, sf_dir).filter("l_returnflag in ('A', 'R')"), ["feature"], "value", F.col("l_returnflag") == "A")
    return a.select("feature", "n1", "n0", F.round("auc", 9).alias("auc"), F.round("cliffs_delta", 9).alias("cliffs_delta"))


@query(
    "pair_audit",
    f"""WITH t AS (SELECT feature, CASE WHEN l_orderkey % 9 = 1 THEN -1.0 ELSE value END AS value, l_returnflag FROM ({_LONG_SQL}) WHERE l_returnflag IN ('A', 'R')),
r AS (SELECT feature, l_returnflag, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS r FROM t WHERE value <> -1.0),
u AS (SELECT feature, count(*) FILTER (l_returnflag = 'A') AS n1, count(*) FILTER (l_returnflag = 'R') AS n0, sum(r) FILTER (l_returnflag = 'A') AS s FROM r GROUP BY 1),
m AS (SELECT feature, avg((value = -1.0)::INT) AS missing FROM t GROUP BY 1)
SELECT feature, round(missing, 9) AS missing, round(abs((s - n1 * (n1 + 1) / 2) / (n1 * n0) - 0.5) + 0.5, 9) AS power FROM u JOIN m USING (feature)""",
)
def pair_audit(spark, sf_dir):
    """Separating power of each feature for two classes, and how often it is missing."""
    spoilt = {c: F.when(F.col("l_orderkey") % 9 == 1, F.lit(-1.0)).otherwise(F.col(c)) for c in MEASURES}
    rows = load(spark, sf_dir, "lineitem").filter("l_returnflag in ('A', 'R')").withColumns(spoilt)
    long = project.long_form(rows, ["l_returnflag"], MEASURES)
    missing = long.groupBy("feature").agg(F.avg((F.col("value") == -1.0).cast("double")).alias("missing"))
    a = stats.auc(long.filter("value <> -1.0"), ["feature"], "value", F.col("l_returnflag") == "A")
    return a.join(missing, "feature").select("feature", F.round("missing", 9).alias("missing"), F.round(F.abs(F.col("auc") - 0.5) + 0.5, 9).alias("power"))


@query(
    "spearman",
    """WITH t AS (SELECT o_orderstatus, CAST(o_orderpriority[1] AS INT) AS level, floor(o_totalprice / 500) AS price FROM orders),
r AS (SELECT o_orderstatus, rank() OVER (PARTITION BY o_orderstatus ORDER BY level) + (count(*) OVER (PARTITION BY o_orderstatus, level) - 1) / 2.0 AS a, rank() OVER (PARTITION BY o_orderstatus ORDER BY price) + (count(*) OVER (PARTITION BY o_orderstatus, price) - 1) / 2.0 AS b FROM t)
SELECT o_orderstatus, count(*) AS n, round(corr(a, b), 6) AS rho FROM r GROUP BY 1""",
)
def spearman(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderstatus", F.substring("o_orderpriority", 1, 1).cast("int").alias("level"), F.floor(F.col("o_totalprice") / 500).alias("price"))
    return stats.spearman(o, ["o_orderstatus"], "level", "price").select("o_orderstatus", "n", F.round("rho", 6).alias("rho"))


@query(
    "kruskal",
    """WITH t AS (SELECT o_orderpriority AS g, floor(o_totalprice / 100) AS v FROM orders),
r AS (SELECT g, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM t),
s AS (SELECT g, count(*) AS m, sum(r) AS s FROM r GROUP BY 1), ties AS (SELECT sum(n * n * n - n)::DOUBLE AS t FROM (SELECT count(*)::DOUBLE AS n FROM t GROUP BY v)),
one AS (SELECT count(*) AS k, sum(m)::DOUBLE AS n, sum(s * s / m) AS q FROM s)
SELECT k, n::BIGINT AS n, round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 5) AS h FROM one, ties""",
)
def kruskal(spark, sf_dir):
    o = load(spark, sf_dir, "orders").select("o_orderpriority", F.floor(F.col("o_totalprice") / 100).alias("v"))
    return stats.kruskal(o, "v", "o_orderpriority").select("k", "n", F.round("h", 5).alias("h"))


@query(
    "histogram_entropy",
    """WITH b AS (SELECT event_type, least(floor((value - 0) / (100.0 / 36)) + 1, 36)::INT AS bin FROM events WHERE value >= 0 AND value <= 100),
c AS (SELECT event_type, bin, count(*) AS n FROM b GROUP BY 1, 2), s AS (SELECT event_type, bin, n, n / sum(n) OVER (PARTITION BY event_type) AS p FROM c)
SELECT event_type, round(-sum(p * log2(p)), 6) AS entropy, (array_agg(bin ORDER BY n DESC, bin))[1] AS mode_bin FROM s GROUP BY 1""",
)
def histogram_entropy(spark, sf_dir):
    h = stats.histogram(load(spark, sf_dir, "events"), ["event_type"], "value", 0.0, 100.0, 36)
    e = stats.entropy(h, ["event_type"])
    return e.select("event_type", F.round("entropy", 6).alias("entropy"), F.col("mode_bin").cast("int").alias("mode_bin"))


@query(
    "histogram_dense",
    """WITH b AS (SELECT least(floor(p_size / 5.0) + 1, 10)::INT AS bin FROM part WHERE p_size >= 0 AND p_size <= 50)
SELECT g.bin::INT AS bin, count(b.bin) AS n, round(count(b.bin) / (SELECT count(*) FROM b), 9) AS share FROM (SELECT unnest(range(1, 11)) AS bin) g LEFT JOIN b USING (bin) GROUP BY 1""",
)
def histogram_dense(spark, sf_dir):
    h = stats.histogram(load(spark, sf_dir, "part"), [], "p_size", 0.0, 50.0, 10)
    return h.select("bin", F.col("n").cast("long").alias("n"), F.round("share", 9).alias("share"))


_PIXELS = "(SELECT vec_id, label, unnest(embedding)::DOUBLE AS v FROM embeddings)"


@query(
    "moments",
    f"""WITH t AS {_PIXELS}, m AS (SELECT vec_id, avg(v) AS a, count(*) AS n FROM t GROUP BY 1),
s AS (SELECT vec_id, avg((v - a) ** 2) AS m2, avg((v - a) ** 3) AS m3, avg((v - a) ** 4) AS m4 FROM t JOIN m USING (vec_id) GROUP BY 1)
SELECT vec_id, n, round(q2, 6) AS median, round(q3 - q1, 6) AS iqr, round(m3 / m2 ** 1.5, 5) AS skew, round(m4 / m2 ** 2 - 3, 5) AS kurt FROM s JOIN m USING (vec_id) JOIN (SELECT vec_id, {_QUART.format(x="v")} FROM t GROUP BY 1) USING (vec_id)""",
)
def moments(spark, sf_dir):
    t = load(spark, sf_dir, "embeddings").select("vec_id", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    return stats.moments(t, ["vec_id"], "v").select("vec_id", "n", F.round("median", 6).alias("median"), F.round("iqr", 6).alias("iqr"), F.round("skew", 5).alias("skew"), F.round("kurt", 5).alias("kurt"))


@query(
    "trimmed_mean",
    f"""WITH t AS {_PIXELS}, r AS (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) AS r, count(*) OVER (PARTITION BY label) AS n FROM t)
SELECT label, round(avg(v), 6) AS trimmed_mean FROM r WHERE r > floor(0.1 * n) AND r <= n - floor(0.1 * n) GROUP BY 1""",
)
def trimmed_mean(spark, sf_dir):
    t = load(spark, sf_dir, "embeddings").select("label", F.explode(F.col("embedding").cast("array<double>")).alias("v"))
    return stats.trimmed_mean(t, ["label"], "v").select("label", F.round("trimmed_mean", 6).alias("trimmed_mean"))


@query(
    "level_thresholds",
    """WITH t AS (SELECT CASE WHEN p_size <= 10 THEN 'healthy' WHEN p_size <= 25 THEN 'low' WHEN p_size <= 40 THEN 'mid' ELSE 'high' END AS level, p_size * 2.0 + p_retailprice / 1000 AS s FROM part),
m AS (SELECT level, quantile_cont(s, 0.5) AS m FROM t GROUP BY 1), w AS (SELECT max(m) FILTER (level = 'healthy') AS a, max(m) FILTER (level = 'low') AS b, max(m) FILTER (level = 'mid') AS c, max(m) FILTER (level = 'high') AS d FROM m)
SELECT round((a + b) / 2, 6) AS t1, round((b + c) / 2, 6) AS t2, round((c + d) / 2, 6) AS t3 FROM w""",
)
def level_thresholds(spark, sf_dir):
    level = F.when(F.col("p_size") <= 10, "healthy").when(F.col("p_size") <= 25, "low").when(F.col("p_size") <= 40, "mid").otherwise("high")
    p = load(spark, sf_dir, "part").select(level.alias("level"), (F.col("p_size") * 2.0 + F.col("p_retailprice") / 1000).alias("s"))
    t = stats.level_thresholds(p, "level", "s", ["healthy", "low", "mid", "high"], [8.0, 25.0, 50.0])
    return t.select(*[F.round(c, 6).alias(c) for c in t.columns])


@query("cube_distinct", "SELECT lang, source, count(*) AS n, count(DISTINCT n_chars) AS sizes FROM documents GROUP BY CUBE (lang, source)")
def cube_distinct(spark, sf_dir):
    return load(spark, sf_dir, "documents").cube("lang", "source").agg(F.count("*").alias("n"), F.countDistinct("n_chars").alias("sizes"))


@query("rollup_totals", "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup_totals(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
