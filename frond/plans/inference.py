"""Queries of significance tests, each with SQL that sums the distributions' own series."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.operators import inference, project
from frond.plans.registry import query
from frond.sources.tables import load


def _norm2(z: str) -> str:
    """The normal share beyond ±z, by the series of the error function with positive terms."""
    x2 = f"(({z}) * ({z}) / 2)"
    term = f"exp(-{x2} + kk * ln(2 * {x2}) - lgamma(2 * kk + 2) + kk * ln(2.0) + lgamma(kk + 1))"
    return f"(CASE WHEN {x2} = 0 THEN 1.0 WHEN {x2} > 300 THEN 0.0 ELSE greatest(0.0, 1 - 2 / sqrt(pi()) * sqrt({x2}) * list_sum(list_transform(range(0, 900), lambda kk: {term}))) END)"


def _chi2(x: str, df: str) -> str:
    a, y = f"(({df}) / 2.0)", f"(({x}) / 2.0)"
    return f"(CASE WHEN {y} <= 0 THEN 1.0 WHEN {y} > 200 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 900), lambda kk: exp(({a} + kk) * ln({y}) - {y} - lgamma({a} + kk + 1))))) END)"


def _t2(t2: str, df: str) -> str:
    """Student's share beyond ±t, from t squared."""
    y, b = f"(({t2}) / (({df}) + ({t2})))", f"(({df}) / 2.0)"
    head = f"0.5 * ln({y}) + {b} * ln(1 - {y}) - ln(0.5) - lgamma(0.5) - lgamma({b}) + lgamma(1.5)"
    return f"(CASE WHEN {t2} = 0 THEN 1.0 WHEN {b} * ln(1 - {y}) < -60 THEN 0.0 ELSE greatest(0.0, 1 - list_sum(list_transform(range(0, 900), lambda kk: exp({head} + lgamma(0.5 + {b} + kk) - lgamma(1.5 + kk) + kk * ln({y}))))) END)"


def _rank(value: str, groups: str = "") -> str:
    by = f"PARTITION BY {groups} " if groups else ""
    same = f"PARTITION BY {groups + ', ' if groups else ''}{value}"
    return f"(rank() OVER ({by}ORDER BY {value}) + (count(*) OVER ({same}) - 1) / 2.0)"


@query(
    "mcnemar_exact",
    """WITH c AS (SELECT quality = (doc_id % 3 > 0)::INT AS a, quality = (doc_id % 5 > 0)::INT AS b FROM labels),
n AS (SELECT count(*) FILTER (a AND NOT b) AS n10, count(*) FILTER (b AND NOT a) AS n01 FROM c)
SELECT n10, n01, round(least(1.0, 2 * list_sum(list_transform(range(0, least(n10, n01) + 1), lambda i: exp(lgamma(n10 + n01 + 1) - lgamma(i + 1) - lgamma(n10 + n01 - i + 1) - (n10 + n01) * ln(2.0))))), 9) AS p FROM n""",
)
def mcnemar_exact(spark, sf_dir):
    guess = lambda k: F.col("quality") == (F.col("doc_id") % k > 0).cast("int")
    return inference.mcnemar(load(spark, sf_dir, "labels"), guess(3), guess(5)).select("n10", "n01", F.round("p", 9).alias("p"))


@query(
    "mann_whitney",
    f"""WITH t AS (SELECT o_orderstatus AS g, o_orderpriority < '2' AS y, floor(o_totalprice / 1000) AS v FROM orders), r AS (SELECT g, y, v, {_rank("v", "g")} AS r FROM t),
s AS (SELECT g, count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0, sum(r) FILTER (y) AS rs FROM r GROUP BY 1),
k AS (SELECT g, sum(c ** 3 - c) AS tied FROM (SELECT g, v, count(*)::DOUBLE AS c FROM t GROUP BY 1, 2) GROUP BY 1),
u AS (SELECT g, n1, n0, rs - n1 * (n1 + 1) / 2.0 AS u, n1::DOUBLE * n0 AS pairs, n1 + n0 AS n, tied FROM s JOIN k USING (g)),
z AS (SELECT *, (abs(u - pairs / 2) - 0.5) / sqrt(pairs / 12 * (n + 1 - tied / (n * (n - 1.0)))) AS z FROM u)
SELECT g, n1, n0, round(u, 3) AS u, round(u / pairs, 9) AS auc, round(2 * u / pairs - 1, 9) AS cliffs_delta, round({_norm2("greatest(z, 0)")}, 9) AS p FROM z""",
)
def mann_whitney(spark, sf_dir):
    """Do urgent orders cost more? By status, with ties."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("g"), (F.col("o_orderpriority") < "2").alias("y"), F.floor(F.col("o_totalprice") / 1000).alias("v"))
    m = inference.mann_whitney(o, ["g"], "v", F.col("y"))
    return m.select("g", "n1", "n0", F.round("u", 3).alias("u"), *[F.round(c, 9).alias(c) for c in ("auc", "cliffs_delta", "p")])


LEVELS = ["healthy", "low", "mid", "high"]
_LEVEL_SQL = "SELECT CASE WHEN p_size <= 10 THEN 'healthy' WHEN p_size <= 25 THEN 'low' WHEN p_size <= 40 THEN 'mid' ELSE 'high' END AS level, floor(p_retailprice / 20) + p_size AS v FROM part"


def _levels(spark, sf_dir):
    size = F.col("p_size")
    level = F.when(size <= 10, "healthy").when(size <= 25, "low").when(size <= 40, "mid").otherwise("high")
    return load(spark, sf_dir, "part").select(level.alias("level"), (F.floor(F.col("p_retailprice") / 20) + size).cast("double").alias("v"))


_MEDIANS = ", ".join(f"(SELECT round(quantile_cont(v, 0.5), 6) FROM t WHERE level = '{k}') AS median_{k}" for k in LEVELS)


@query(
    "level_separation",
    f"""WITH t AS ({_LEVEL_SQL}), r AS (SELECT level <> 'healthy' AS y, v, {_rank("v")} AS r FROM t),
u AS (SELECT count(*) FILTER (y) AS n1, count(*) FILTER (NOT y) AS n0, sum(r) FILTER (y) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0 AS u, count(*) AS n FROM r),
k AS (SELECT sum(c ** 3 - c) AS tied FROM (SELECT v, count(*)::DOUBLE AS c FROM t GROUP BY 1)),
z AS (SELECT *, n1::DOUBLE * n0 AS pairs, (abs(u - n1::DOUBLE * n0 / 2) - 0.5) / sqrt(n1::DOUBLE * n0 / 12 * (n + 1 - tied / (n * (n - 1.0)))) AS z FROM u, k)
SELECT n1, n0, round(u / pairs, 9) AS auc, round(2 * u / pairs - 1, 9) AS cliffs_delta, round({_norm2("greatest(z, 0)")}, 9) AS p, {_MEDIANS},
       {", ".join(f"(SELECT round(quantile_cont(v, 0.75) - quantile_cont(v, 0.25), 6) FROM t WHERE level = '{k}') AS iqr_{k}" for k in LEVELS)} FROM z""",
)
def level_separation(spark, sf_dir):
    s = inference.separation(_levels(spark, sf_dir), "v", "level", "healthy", LEVELS)
    spread = [F.round(F.col(f"{a}s")[k], 6).alias(f"{a}_{name}") for a in ("median", "iqr") for k, name in enumerate(LEVELS)]
    return s.select("n1", "n0", *[F.round(c, 9).alias(c) for c in ("auc", "cliffs_delta", "p")], *spread)


@query(
    "level_monotony",
    f"""WITH t AS ({_LEVEL_SQL}), r AS (SELECT level, v, CASE level WHEN 'healthy' THEN 0 WHEN 'low' THEN 1 WHEN 'mid' THEN 2 ELSE 3 END AS o FROM t),
q AS (SELECT level, v, {_rank("v")} AS rv, {_rank("o")} AS ro FROM r), c AS (SELECT count(*) AS n, corr(rv, ro) AS rho FROM q),
g AS (SELECT count(*)::DOUBLE AS k, sum(s * s / m) AS q FROM (SELECT level, sum(rv) AS s, count(*) AS m FROM q GROUP BY 1)),
d AS (SELECT sum(c ** 3 - c) AS tied FROM (SELECT v, count(*)::DOUBLE AS c FROM t GROUP BY 1)),
h AS (SELECT n, rho, k, (12.0 / (n * (n + 1.0)) * q - 3 * (n + 1)) / (1 - tied / (n::DOUBLE ** 3 - n)) AS h FROM c, g, d),
m AS (SELECT {_MEDIANS})
SELECT n, round(rho, 9) AS rho, round({_t2("(rho * rho * (n - 2) / (1 - rho * rho))", "(n - 2)")}, 9) AS rho_p, round(h, 5) AS h, round({_chi2("h", "(k - 1)")}, 9) AS h_p, m.*,
       median_healthy < median_low AND median_low < median_mid AND median_mid < median_high AS rising FROM h, m""",
)
def level_monotony(spark, sf_dir):
    m = inference.monotony(_levels(spark, sf_dir), "v", "level", LEVELS)
    medians = [F.round(F.col("medians")[k], 6).alias(f"median_{name}") for k, name in enumerate(LEVELS)]
    return m.select("n", F.round("rho", 9).alias("rho"), F.round("rho_p", 9).alias("rho_p"), F.round("h", 5).alias("h"), F.round("h_p", 9).alias("h_p"), *medians, "rising")


_SIGNS = """WITH t AS (SELECT o_orderpriority AS g, floor(o_totalprice / 20000) AS o, CASE WHEN o_orderpriority < '2' THEN -o_totalprice ELSE o_totalprice END AS price, (o_custkey % 97)::DOUBLE AS customer, floor(o_totalprice / 50000) - (o_custkey % 5) AS mixed FROM orders),
l AS (UNPIVOT t ON price, customer, mixed INTO NAME feature VALUE v)"""


@query(
    "sign_correction",
    f"""{_SIGNS}, r AS (SELECT g, feature, {_rank("o", "g, feature")} AS ro, {_rank("v", "g, feature")} AS rv, {_rank("o", "feature")} AS ao, {_rank("v", "feature")} AS av FROM l),
a AS (SELECT feature, corr(ao, av) AS overall FROM r GROUP BY 1), s AS (SELECT g, feature, count(*) AS n, corr(ro, rv) AS rho FROM r GROUP BY 1, 2),
p AS (SELECT *, CASE WHEN 1 - rho * rho < 1e-15 THEN 0 ELSE {_t2("(rho * rho * (n - 2) / (1 - rho * rho))", "(n - 2)")} END AS p FROM s JOIN a USING (feature))
SELECT g, feature, n, round(rho, 6) AS rho, round(p, 6) AS p, round(overall, 6) AS overall,
       (CASE WHEN n >= 15 AND p < 0.05 AND abs(rho) >= 0.3 AND sign(rho) <> sign(overall) AND abs(rho) > abs(overall) THEN -1 ELSE 1 END)::INT AS sign FROM p""",
)
def sign_correction(spark, sf_dir):
    """Features of orders against their price class, by priority; the most urgent orders have one feature turned."""
    price, customer = F.col("o_totalprice"), F.col("o_custkey")
    t = load(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("g"),
        F.floor(price / 20000).cast("double").alias("o"),
        F.when(F.col("o_orderpriority") < "2", -price).otherwise(price).alias("price"),
        (customer % 97).cast("double").alias("customer"),
        (F.floor(price / 50000) - customer % 5).cast("double").alias("mixed"),
    )
    s = inference.sign_corrections(project.long_form(t, ["g", "o"], ["price", "customer", "mixed"]), "g", "feature", "o", "value")
    return s.select("g", "feature", "n", *[F.round(c, 6).alias(c) for c in ("rho", "p", "overall")], "sign")
