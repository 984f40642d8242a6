"""Queries of series, and of stratified folds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from frond.functions import series
from frond.operators import folds
from frond.plans.registry import query
from frond.sources.tables import load

# An embedding is a curve of 64 samples; in steps of 1/20, so that plateaus and ties occur.
_CURVE = "t AS (SELECT vec_id, i - 1 AS i, floor(v * 20) AS v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings))"


def _curves(spark, sf_dir):
    return load(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.col("embedding").cast("array<double>"), lambda x: F.floor(x * 20).cast("double")).alias("s"))


def _peaks_sql(of: str) -> str:
    """CTEs that end in ``w``: place, height, prominence, left and right of every peak of the table ``of`` (vec_id, i, v)."""
    return f"""s AS (SELECT *, sum(new) OVER (PARTITION BY vec_id ORDER BY i) AS run FROM (SELECT *, coalesce(v <> lag(v) OVER (PARTITION BY vec_id ORDER BY i), true)::INT AS new FROM {of})),
r AS (SELECT vec_id, run, min(i) AS a, max(i) AS b, any_value(v) AS v FROM s GROUP BY 1, 2),
p AS (SELECT vec_id, (a + b) // 2 AS place, v AS height FROM (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY run)) WHERE v > before AND v > after),
e AS (SELECT p.*, coalesce((SELECT max(i) FROM {of} x WHERE x.vec_id = p.vec_id AND x.i < place AND x.v > height), -1) AS l, coalesce((SELECT min(i) FROM {of} x WHERE x.vec_id = p.vec_id AND x.i > place AND x.v > height), 1000) AS r FROM p),
q AS (SELECT vec_id, place, height, height - greatest((SELECT min(v) FROM {of} x WHERE x.vec_id = e.vec_id AND x.i > l AND x.i <= place), (SELECT min(v) FROM {of} x WHERE x.vec_id = e.vec_id AND x.i < r AND x.i >= place)) AS prominence FROM e),
c AS (SELECT *, height - prominence / 2 AS mid, (SELECT max(i) FROM {of} x WHERE x.vec_id = q.vec_id AND x.i < place AND x.v <= height - prominence / 2) AS lo, (SELECT min(i) FROM {of} x WHERE x.vec_id = q.vec_id AND x.i > place AND x.v <= height - prominence / 2) AS hi FROM q),
w AS (SELECT c.vec_id, place, height, prominence, lo + (mid - a.v) / (b.v - a.v) AS "left", hi - (mid - d.v) / (f.v - d.v) AS "right" FROM c JOIN {of} a ON a.vec_id = c.vec_id AND a.i = lo JOIN {of} b ON b.vec_id = c.vec_id AND b.i = lo + 1
  JOIN {of} d ON d.vec_id = c.vec_id AND d.i = hi JOIN {of} f ON f.vec_id = c.vec_id AND f.i = hi - 1)"""


@query(
    "peak_prominence",
    f"""WITH {_CURVE}, {_peaks_sql("t")} SELECT vec_id, place, height, prominence, round("left", 6) AS "left", round("right", 6) AS "right" FROM w WHERE height >= -2 AND prominence >= 3""",
)
def peak_prominence(spark, sf_dir):
    """Peaks of every embedding of a height of -2 and a prominence of 3 at least, with their half-height crossings."""
    found = _curves(spark, sf_dir).select("vec_id", F.explode(series.peaks(F.col("s"), height=F.lit(-2.0), prominence=F.lit(3.0))).alias("p"))
    return found.select("vec_id", F.col("p.place").cast("long").alias("place"), "p.height", "p.prominence", F.round("p.left", 6).alias("left"), F.round("p.right", 6).alias("right"))


@query("spaced_peaks", None)
def spaced_peaks(spark, sf_dir):
    """Peaks that are no nearer than five samples to a higher one; held against brute force."""
    found = _curves(spark, sf_dir).select("vec_id", F.explode(series.peaks(F.col("s"), distance=5)).alias("p"))
    return found.select("vec_id", "p.place", "p.height", "p.prominence", F.round("p.width", 6).alias("width"))


@query(
    "peak_sharpness",
    f"""WITH {_CURVE}, a AS (SELECT vec_id, i, abs(v) AS v FROM t), {_peaks_sql("a")},
k AS (SELECT w.* FROM w JOIN (SELECT vec_id, max(v) AS m FROM a GROUP BY 1) USING (vec_id) WHERE prominence >= 0.05 * m),
g AS (SELECT vec_id, quantile_cont(gap, 0.5) AS gap FROM (SELECT vec_id, place - lag(place) OVER (PARTITION BY vec_id ORDER BY place) AS gap FROM k) WHERE gap IS NOT NULL GROUP BY 1 HAVING count(*) >= 2)
SELECT vec_id, count(*) AS n, round(avg(prominence) + 1e-9, 6) AS prominence, round(avg(("right" - "left") / gap) + 1e-9, 6) AS width FROM k JOIN g USING (vec_id) GROUP BY 1""",
)
def peak_sharpness(spark, sf_dir):
    """Mean prominence and relative width of the peaks of every embedding's absolute curve."""
    found = _curves(spark, sf_dir).select("vec_id", F.explode(series.sharpness(F.col("s"))).alias("p"))
    return found.groupBy("vec_id").agg(F.count("*").alias("n"), F.round(F.avg("p.prominence") + 1e-9, 6).alias("prominence"), F.round(F.avg("p.width") + 1e-9, 6).alias("width"))


def _fits(window: int, order: int) -> str:
    """Rows of weights of a window's fitted polynomial, by fitting it to each unit vector."""
    x = np.arange(window)
    rows = np.stack([np.polyval(np.polyfit(x, np.eye(window)[k], order), x) for k in range(window)], axis=1)
    return "[" + ", ".join("[" + ", ".join(f"{w:.17g}::DOUBLE" for w in row) + "]" for row in rows) + "]"


@query(
    "savgol_smooth",
    f"""WITH {_CURVE}, k AS (SELECT {_fits(7, 2)} AS w), p AS (SELECT vec_id, i, greatest(0, least(i - 3, 57)) AS a FROM t)
SELECT p.vec_id, p.i::INT AS i, round(sum(t.v * w[p.i - a + 1][t.i - a + 1]), 6) + 0 AS v FROM p JOIN t ON t.vec_id = p.vec_id AND t.i BETWEEN a AND a + 6, k GROUP BY 1, 2""",
)
def savgol_smooth(spark, sf_dir):
    found = _curves(spark, sf_dir).select("vec_id", F.posexplode(series.savgol(F.col("s"), 7, 2)).alias("i", "v"))
    return found.select("vec_id", "i", (F.round("v", 6) + 0.0).alias("v"))


@query(
    "series_period",
    f"""WITH {_CURVE}, c AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY vec_id) AS v FROM t),
a AS (SELECT x.vec_id, y.i - x.i AS lag, round(sum(x.v * y.v), 6) AS r FROM c x JOIN c y ON x.vec_id = y.vec_id AND y.i >= x.i GROUP BY 1, 2),
d AS (SELECT *, lead(r) OVER w AS r1, lead(r, 2) OVER w AS r2 FROM a WINDOW w AS (PARTITION BY vec_id ORDER BY lag)),
f AS (SELECT vec_id, min(lag) + 1 AS first FROM d WHERE r1 < r AND r2 >= r1 GROUP BY 1)
SELECT vec_id, (array_agg(lag ORDER BY r DESC, lag))[1]::INT AS period FROM a JOIN f USING (vec_id) WHERE lag >= first AND lag < first + 32 GROUP BY 1""",
)
def series_period(spark, sf_dir):
    rounded = lambda a: F.transform(a, lambda x: F.round(x, 6))
    found = _curves(spark, sf_dir).select("vec_id", series.period(F.col("s"), rounded).alias("period"))
    return found.filter("period is not null")


FOLDS = 5
_FOLDS = f"""h AS (SELECT o_custkey AS g, [{", ".join(f"count(*) FILTER (o_orderpriority LIKE '{k}%')" for k in range(1, 6))}] AS h FROM orders GROUP BY 1),
y AS (SELECT [{", ".join(f"count(*) FILTER (o_orderpriority LIKE '{k}%')" for k in range(1, 6))}] AS total, count(*) AS n FROM orders),
w AS (SELECT list_transform(total, lambda x: round((n / x) ** 2 * 1000)::HUGEINT) AS w FROM y),
p AS (SELECT h, count(*) AS m, row_number() OVER (ORDER BY list_sum(h) ** 2 - 5 * list_sum(list_transform(h, lambda x: x * x)), h) AS rn FROM h GROUP BY h),
u AS (SELECT h, rn, s, m // 5 AS rounds, row_number() OVER (ORDER BY rn, s) AS u FROM (SELECT h, rn, m, unnest(range(-1, m % 5)) AS s FROM p)),
z AS (SELECT 0::BIGINT AS u, 0::BIGINT AS rn, -1::BIGINT AS s, list_transform(range(0, 25), lambda i: 0::HUGEINT) AS held, -1::BIGINT AS fold
  UNION ALL
  SELECT u, rn, s, list_transform(range(0, 25), lambda i: held[i + 1] + CASE WHEN s < 0 THEN rounds * h[i % 5 + 1] WHEN i // 5 = fold THEN h[i % 5 + 1] ELSE 0 END) AS held, fold
  FROM (SELECT u.u, u.rn, u.s, u.h, u.rounds, z.held, CASE WHEN u.s < 0 THEN -1 ELSE
    list_sort(list_transform(range(0, 5), lambda f: [list_sum(list_transform(range(1, 6), lambda k: z.held[f * 5 + k] * u.h[k] * w.w[k])), list_sum(z.held[f * 5 + 1:f * 5 + 5]), f::HUGEINT]))[1][3] END::BIGINT AS fold
    FROM z JOIN u ON u.u = z.u + 1, w)),
j AS (SELECT g, p.rn, p.m, row_number() OVER (PARTITION BY p.rn ORDER BY ('0x' || substr(md5('42:' || g), 1, 13))::UBIGINT) - 1 AS i FROM h JOIN p USING (h)),
a AS (SELECT g, CASE WHEN i < m - m % 5 THEN i % 5 ELSE z.fold END::INT AS fold FROM j LEFT JOIN z ON z.rn = j.rn AND z.s = i - (m - m % 5))"""

@query("stratified_folds", f"WITH RECURSIVE {_FOLDS} SELECT g AS o_custkey, fold FROM a")
def stratified_folds(spark, sf_dir):
    """A fold for every customer, so that each fold has its share of every order priority."""
    return folds.assignments(load(spark, sf_dir, "orders"), "o_custkey", "o_orderpriority", FOLDS)


@query(
    "fold_balance",
    f"""WITH RECURSIVE {_FOLDS}, o AS (SELECT o_orderpriority, fold FROM orders JOIN a ON g = o_custkey)
SELECT o_orderpriority, fold, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY o_orderpriority) AS share FROM o GROUP BY 1, 2""",
)
def fold_balance(spark, sf_dir):
    """Orders of each priority in each fold."""
    rows = folds.stratified(load(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority"), "o_custkey", "o_orderpriority", FOLDS)
    return folds.balance(rows, "o_orderpriority", FOLDS).select("o_orderpriority", "fold", F.col("n").cast("long").alias("n"), "share")
