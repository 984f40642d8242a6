"""Queries that write files to the shared folder and read them back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from frond.operators.state import shared_folder
from frond.plans.images import _PX, _px
from frond.plans.registry import query
from frond.sources import files, images
from frond.sources.tables import load


def _new_folder(spark) -> str:
    return f"{shared_folder(spark)}/sink-{uuid.uuid4().hex}"


@query(
    "image_sink",
    f"""WITH {_PX}, b AS (SELECT vec_id, least(greatest(round((v + 0.4) / 0.8 * 255), 0), 255) AS g FROM px)
SELECT vec_id, 8 AS height, 8 AS width, sum(g)::BIGINT AS grey, sum(g * g)::BIGINT AS squares FROM b GROUP BY 1""",
)
def image_sink(spark, sf_dir):
    """Every image as a file of its own, read back and decoded."""
    at = _new_folder(spark)
    files.write_images(_px(spark, sf_dir).withColumn("v", (F.col("v") + 0.4) / 0.8 * 255), "vec_id", at)
    back = images.scan(spark, at, content=True).select(F.regexp_extract("path", r"(-?\d+)\.pgm$", 1).cast("long").alias("vec_id"), images.decode_pnm(F.col("content")).alias("i"))
    grey = F.transform(F.sequence(F.lit(1), F.length("i.data")), lambda k: F.conv(F.hex(F.substring("i.data", k, F.lit(1))), 16, 10).cast("long"))
    total = lambda f: F.aggregate(grey, F.lit(0).cast("long"), lambda a, x: a + f(x))
    return back.select("vec_id", F.col("i.height").alias("height"), F.col("i.width").alias("width"), total(lambda x: x).alias("grey"), total(lambda x: x * x).alias("squares"))


@query("prediction_sink", "SELECT doc_id AS leaf_id, quality AS y_true, 1 - toxic AS y_pred, quality = 1 - toxic AS correct FROM labels")
def prediction_sink(spark, sf_dir):
    """Labels as predictions, written as CSV and read back."""
    at = _new_folder(spark)
    files.write_predictions(load(spark, sf_dir, "labels").select(F.col("doc_id").alias("leaf_id"), F.col("quality").alias("y_true"), (1 - F.col("toxic")).alias("y_pred")), at)
    return spark.read.schema("leaf_id long, y_true int, y_pred int, correct boolean").option("header", True).csv(at)
