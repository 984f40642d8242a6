"""Queries of components of pixels: the 64 values of an embedding are an 8 x 8 image."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.operators import components
from frond.plans.images import _PX, _px
from frond.plans.registry import query


def _reach(where: str) -> str:
    """CTEs that end in ``c`` (vec_id, y, x, v, component): pixels that meet ``where`` and the first pixel they can reach."""
    return f"""{_PX}, f AS (SELECT vec_id, y, x, v, y * 8 + x AS p FROM px WHERE {where}),
e AS (SELECT a.vec_id, a.p AS a, b.p AS b FROM f a JOIN f b ON a.vec_id = b.vec_id AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
r AS (SELECT vec_id, a, b FROM e UNION SELECT r.vec_id, r.a, e.b FROM r JOIN e ON e.vec_id = r.vec_id AND e.a = r.b),
c AS (SELECT f.vec_id, f.y, f.x, f.v, m AS component FROM f JOIN (SELECT vec_id, a, min(b) AS m FROM r GROUP BY 1, 2) k ON k.vec_id = f.vec_id AND k.a = f.p)"""


def _foreground(spark, sf_dir):
    return _px(spark, sf_dir).filter("v > 0.1")


@query(
    "px_components",
    f"""WITH RECURSIVE {_reach("v > 0.1")}, b AS (SELECT vec_id, component, count(*) AS area FROM c GROUP BY 1, 2)
SELECT vec_id, count(*) AS n, max(area) AS largest, round(avg(area), 6) AS mean FROM b GROUP BY 1""",
)
def px_components(spark, sf_dir):
    """Number, largest and mean size of each image's 8-connected components."""
    found = components.blob_stats(components.labelled(_foreground(spark, sf_dir), "vec_id"), "vec_id")
    return found.select("vec_id", "n", "largest", F.round("mean", 6).alias("mean"))


@query(
    "px_enclosed_lamina",
    f"""WITH RECURSIVE {_reach("v > -0.1 AND v <= 0.08")}, t AS (SELECT DISTINCT c.vec_id, component FROM c JOIN px ON px.vec_id = c.vec_id AND abs(px.y - c.y) <= 1 AND abs(px.x - c.x) <= 1 WHERE px.v <= -0.1),
i AS (SELECT vec_id, count(*) AS n FROM c WHERE (vec_id, component) NOT IN (SELECT (vec_id, component) FROM t) GROUP BY 1),
s AS (SELECT vec_id, count(*) FILTER (v > -0.1) AS area, count(*) FILTER (v > -0.1 AND v <= 0.08) AS lamina FROM px GROUP BY 1)
SELECT vec_id, lamina, coalesce(n, 0) AS enclosed, round(CASE WHEN area < 20 OR lamina = 0 THEN -1 ELSE coalesce(n, 0) / lamina END, 9) AS fraction FROM s LEFT JOIN i USING (vec_id)""",
)
def px_enclosed_lamina(spark, sf_dir):
    found = components.enclosed_fraction(_px(spark, sf_dir), "vec_id", F.col("v") > -0.1, F.col("v") > 0.08, 20)
    return found.select("vec_id", "lamina", "enclosed", F.round("fraction", 9).alias("fraction"))


@query(
    "px_shadow_regions",
    f"""WITH RECURSIVE {_reach("v < -0.08")}, b AS (SELECT vec_id, component, count(*) AS area, quantile_cont(v, 0.5) AS median FROM c GROUP BY 1, 2),
d AS (SELECT *, area >= 3 AND median < -0.15 AS dark FROM b),
n AS (SELECT DISTINCT a.vec_id, a.component FROM c a JOIN c k ON k.vec_id = a.vec_id JOIN d ON d.vec_id = k.vec_id AND d.component = k.component WHERE dark AND (a.y - k.y) ** 2 + (a.x - k.x) ** 2 <= 5)
SELECT d.vec_id, CASE WHEN dark THEN 'dark' WHEN area < 4 AND n.component IS NOT NULL THEN 'promoted' ELSE 'kept' END AS state, count(*) AS n, sum(area)::BIGINT AS area, round(sum(median), 6) AS medians
FROM d LEFT JOIN n ON n.vec_id = d.vec_id AND n.component = d.component GROUP BY 1, 2""",
)
def px_shadow_regions(spark, sf_dir):
    """Dark regions of every image, and the small ones beside them that count as dark too."""
    near = [(i, j) for i, j in components.square(2) if i * i + j * j <= 5]
    found = components.shadow_regions(_px(spark, sf_dir).filter("v < -0.08"), "vec_id", "v", 3, -0.15, 4, near)
    return found.groupBy("vec_id", "state").agg(F.count("*").alias("n"), F.sum("area").alias("area"), F.round(F.sum("median"), 6).alias("medians"))


@query(
    "px_blob_spans",
    f"""WITH RECURSIVE {_reach("v > 0.1")}, s AS (SELECT a.vec_id, a.component, max(sqrt((a.y - b.y) ** 2 + (a.x - b.x) ** 2)) AS span FROM c a JOIN c b ON a.vec_id = b.vec_id AND a.component = b.component GROUP BY 1, 2),
n AS (SELECT vec_id, component, count(*) AS n FROM c GROUP BY 1, 2)
SELECT vec_id, (component // 8 * 1048576 + component % 8)::BIGINT AS component, n, round(span, 6) AS span FROM n JOIN s USING (vec_id, component)""",
)
def px_blob_spans(spark, sf_dir):
    """The greatest distance between two pixels of every component."""
    found = components.spans(components.labelled(_foreground(spark, sf_dir), "vec_id"), ["vec_id", "component"])
    return found.select("vec_id", "component", "n", F.round("span", 6).alias("span"))


@query(
    "px_left_right",
    f"""WITH RECURSIVE {_reach("v > 0.1")}, b AS (SELECT vec_id, component, count(*) AS area, min(x) + (max(x) - min(x) + 1) / 2 AS cx FROM c GROUP BY 1, 2),
m AS (SELECT vec_id, count(*) FILTER (area > 1) AS n, quantile_cont(cx, 0.5) FILTER (area > 1) AS mid FROM b GROUP BY 1),
s AS (SELECT vec_id, n, CASE WHEN n < 2 THEN 0.5 ELSE sum(area) FILTER (area > 1 AND cx < mid) / sum(area) FILTER (area > 1) END AS share FROM b JOIN m USING (vec_id) GROUP BY 1, 2)
SELECT vec_id, n, round(coalesce(share, 0), 9) AS share, round(1 - 2 * abs(coalesce(share, 0) - 0.5), 9) AS balance FROM s""",
)
def px_left_right(spark, sf_dir):
    found = components.left_right(components.labelled(_foreground(spark, sf_dir), "vec_id"), "vec_id", 1)
    return found.select("vec_id", "n", F.round("share", 9).alias("share"), F.round("balance", 9).alias("balance"))


@query(
    "px_axis_roughness",
    f"""WITH {_PX}, f AS (SELECT vec_id, x::DOUBLE AS x, y::DOUBLE AS y FROM px WHERE v > 0),
m AS (SELECT vec_id, count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) AS a, covar_pop(x, y) AS b, var_pop(y) AS c FROM f GROUP BY 1),
u AS (SELECT *, CASE WHEN abs(b) > 1e-9 THEN b WHEN a >= c THEN 1.0 ELSE 0.0 END AS ux, CASE WHEN abs(b) > 1e-9 THEN (a + c) / 2 + sqrt(((a - c) / 2) ** 2 + b ** 2) - a WHEN a >= c THEN 0.0 ELSE 1.0 END AS uy FROM m),
k AS (SELECT *, sqrt(ux ** 2 + uy ** 2) * CASE WHEN ux < 0 THEN -1 ELSE 1 END AS len FROM u),
t AS (SELECT vec_id, n, round((x - mx) * ux / len + (y - my) * uy / len, 9) AS t, round((y - my) * ux / len - (x - mx) * uy / len, 9) AS s FROM f JOIN k USING (vec_id)),
e AS (SELECT vec_id, min(t) AS lo, max(t) AS hi FROM t GROUP BY 1),
w AS (SELECT vec_id, least(floor((t - lo) / (hi - lo) * 6 + 1e-9), 5) AS bin, max(s) - min(s) AS w FROM t JOIN e USING (vec_id) GROUP BY 1, 2 HAVING count(*) >= 2),
q AS (SELECT vec_id, abs(w - 2 * lead(w) OVER o + lead(w, 2) OVER o) AS d, w FROM w WINDOW o AS (PARTITION BY vec_id ORDER BY bin)),
r AS (SELECT vec_id, count(*) AS bins, avg(d) / quantile_cont(w, 0.5) AS r FROM q GROUP BY 1)
SELECT vec_id, n, round(CASE WHEN n >= 10 AND bins >= 4 THEN r ELSE -1 END, 6) AS roughness FROM m LEFT JOIN r USING (vec_id)""",
)
def px_axis_roughness(spark, sf_dir):
    found = components.axis_roughness(_px(spark, sf_dir).filter("v > 0"), "vec_id", bins=6, least=10, points=2, filled=4)
    return found.select("vec_id", "n", F.round("roughness", 6).alias("roughness"))
