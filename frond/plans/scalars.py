"""Queries of scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from frond.functions import scalars
from frond.operators import project
from frond.plans.images import _PX, _px
from frond.plans.registry import query
from frond.sources import images
from frond.sources.tables import load


@query(
    "threshold_decision",
    "SELECT event_id, CASE WHEN value / 100 >= 0.46 THEN 'unhealthy' ELSE 'healthy' END AS label, round(CASE WHEN value / 100 >= 0.46 THEN value / 100 ELSE 1 - value / 100 END, 9) AS confidence FROM events",
)
def threshold_decision(spark, sf_dir):
    label, confidence = project.decision(F.col("value") / 100, 0.46)
    return load(spark, sf_dir, "events").select("event_id", label.alias("label"), F.round(confidence, 9).alias("confidence"))


@query(
    "top_two_classes",
    """WITH a AS (SELECT vec_id, unnest(embedding[1:10])::DOUBLE AS v, generate_subscripts(embedding[1:10], 1) AS i FROM embeddings), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY floor(v * 20) DESC, i) AS k FROM a)
SELECT vec_id, max('class ' || i) FILTER (k = 1) AS label, max(floor(v * 20)) FILTER (k = 1) AS p, max('class ' || i) FILTER (k = 2) AS label_2, max(floor(v * 20)) FILTER (k = 2) AS p_2 FROM r GROUP BY 1""",
)
def top_two_classes(spark, sf_dir):
    """The two largest of ten values of each embedding, in steps so that ties occur."""
    e = load(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.slice(F.col("embedding").cast("array<double>"), 1, 10), lambda v: F.floor(v * 20).cast("double")).alias("v"))
    names = F.array(*[F.lit(f"class {i}") for i in range(1, 11)])
    return e.select("vec_id", scalars.top_two_with(F.col("v"), names).alias("t")).select("vec_id", "t.*")


@query(
    "array_algebra",
    """WITH a AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS a, embedding[33:64]::DOUBLE[] AS b FROM embeddings)
SELECT vec_id, round(list_dot_product(a, b), 6) + 0 AS dot, round(sqrt(list_dot_product(a, a)), 6) AS norm, round(list_sum(list_transform(range(0, 9), lambda i: CASE WHEN i = 8 THEN b[1] ELSE a[1] + i * ((b[1] - a[1]) / 8) END)), 6) + 0 AS line FROM a""",
)
def array_algebra(spark, sf_dir):
    """Products, norms and even steps of each embedding's halves."""
    e = F.col("embedding").cast("array<double>")
    h = load(spark, sf_dir, "embeddings").select("vec_id", F.slice(e, 1, 32).alias("a"), F.slice(e, 33, 32).alias("b"))
    total = F.aggregate(scalars.linspace(F.col("a")[0], F.col("b")[0], 9), F.lit(0.0), lambda t, x: t + x)
    return h.select("vec_id", (F.round(scalars.dot(F.col("a"), F.col("b")), 6) + 0.0).alias("dot"), F.round(scalars.norm(F.col("a")), 6).alias("norm"), (F.round(total, 6) + 0.0).alias("line"))


@query(
    "polar_places",
    f"""WITH {_PX}, m AS (SELECT vec_id, avg(y) AS cy, avg(x) AS cx FROM px WHERE v > 0 GROUP BY 1), d AS (SELECT vec_id, y, x, cy, cx, sqrt((y - cy) ** 2 + (x - cx) ** 2) AS d FROM px JOIN m USING (vec_id) WHERE v > 0)
SELECT vec_id, y, x, round(d / (max(d) OVER (PARTITION BY vec_id) + 1e-6), 6) AS radius, round(atan2(y - cy, x - cx), 6) + 0 AS angle FROM d""",
)
def polar_places(spark, sf_dir):
    """Each foreground pixel's place around its image's centre of mass."""
    px = _px(spark, sf_dir).filter("v > 0")
    mid = px.groupBy("vec_id").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    far = px.join(mid, "vec_id").withColumn("d", F.hypot(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")))
    reach = far.groupBy("vec_id").agg(F.max("d").alias("reach"))
    p = far.join(reach, "vec_id").select("vec_id", "y", "x", scalars.polar(F.col("y"), F.col("x"), F.col("cy"), F.col("cx"), F.col("reach")).alias("p"))
    return p.select("vec_id", "y", "x", F.round("p.radius", 6).alias("radius"), (F.round("p.angle", 6) + 0.0).alias("angle"))


@query(
    "colour_scalars",
    """SELECT p_partkey, 2 * (p_size * 5) - (p_partkey % 256) - (p_size * 3) AS excess, round(sqrt((p_size * 5 - 128) ** 2 + ((p_partkey % 256) - 128) ** 2), 6) AS chroma,
round(CASE WHEN sqrt((p_size * 1.0) ** 2 + 9) * sqrt((p_partkey % 7)::DOUBLE ** 2 + 4) > 0 THEN degrees(acos(least(greatest((p_size * (p_partkey % 7) - 6) / (sqrt((p_size * 1.0) ** 2 + 9) * sqrt((p_partkey % 7)::DOUBLE ** 2 + 4)), -1), 1))) ELSE 0 END, 5) AS angle FROM part""",
)
def colour_scalars(spark, sf_dir):
    """Excess green, chroma, and the angle between two vectors, from a part's numbers."""
    size, k = F.col("p_size"), F.col("p_partkey")
    return load(spark, sf_dir, "part").select(
        "p_partkey", scalars.excess_green(k % 256, size * 5, size * 3).alias("excess"), F.round(scalars.chroma(size * 5, k % 256), 6).alias("chroma"),
        F.round(scalars.angle(size.cast("double"), F.lit(3.0), (k % 7).cast("double"), F.lit(-2.0)), 5).alias("angle"),
    )


@query(
    "percent_texts",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN round(n_chars % 101 / 100, 9) WHEN doc_id % 3 = 1 THEN CASE WHEN n_chars % 150 / 100.0 > 1 THEN round(n_chars % 150 / 100.0 / 100, 9) ELSE round(n_chars % 150 / 100.0, 9) END END AS share FROM documents""",
)
def percent_texts(spark, sf_dir):
    """Shares read from texts such as 87%, 0.87 and n/a, made of documents' sizes."""
    n, k = F.col("n_chars"), F.col("doc_id") % 3
    text = F.when(k == 0, F.concat((n % 101).cast("string"), F.lit(" %"))).when(k == 1, (n % 150 / 100).cast("string")).otherwise("n/a")
    return load(spark, sf_dir, "documents").select("doc_id", F.round(scalars.percent_text(text), 9).alias("share"))


@query(
    "media_types",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'image/png' ELSE 'image/jpeg' END AS media, page_id % 3 = 0 AS any_case, page_id % 6 = 0 AS lower_only FROM pages""",
)
def media_types(spark, sf_dir):
    """Media types and test marks of file names made of pages' numbers."""
    k = F.col("page_id")
    name = F.concat(F.when(k % 6 == 0, "test_").when(k % 3 == 0, "Test_").otherwise("leaf_"), k.cast("string"), F.when(k % 4 == 0, ".PNG").when(k % 4 == 1, ".jpg").when(k % 4 == 2, ".jpeg").otherwise(".tif"))
    path = F.concat(F.lit("/data/Test_set/"), name)
    return load(spark, sf_dir, "pages").select("page_id", images.mime(path).alias("media"), images.is_test(path, True).alias("any_case"), images.is_test(path, False).alias("lower_only"))
