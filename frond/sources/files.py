"""Sinks of whole files: processed images, predictions and fitted models.

``BinaryFiles`` is a data source for writing rows of (path, content) as files of their own. Tasks write into a folder of the
job beside the target, under a name of the attempt; only when all tasks have succeeded are the files moved to their places,
and a job that fails takes its folder with it. So a task that is run again, or twice, leaves nothing half written. The target
is a folder that driver and executors share as a mounted file system.
"""

from __future__ import annotations

import os
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType


def local_path(path: str) -> str:
    if ":" in path.split("/")[0] and not path.startswith("file:"):
        raise ValueError(f"{path} is not on a mounted file system")
    return "/" + path.removeprefix("file:").lstrip("/")


def checked(relative: str) -> str:
    """A path below the target, or an error."""
    flat = os.path.normpath(relative)
    if not relative or os.path.isabs(relative) or flat.startswith("..") or flat == "." or relative.endswith("/"):
        raise ValueError(f"{relative!r} is no path below the target")
    return flat


@dataclass
class Written(WriterCommitMessage):
    """What a task has written: (path below the target, where it is for now)."""

    files: list[tuple[str, str]]


class BinaryWriter(DataSourceWriter):
    def __init__(self, target: str, overwrite: bool):
        self.target, self.overwrite = target, overwrite
        self.staging = f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}"

    def write(self, rows: Iterator[Row]) -> Written:
        files = []
        try:
            for row in rows:
                path = checked(row["path"])
                at = f"{self.staging}/{uuid.uuid4().hex}"
                os.makedirs(self.staging, exist_ok=True)
                with open(at, "xb") as f:
                    f.write(bytes(row["content"] or b""))
                    f.flush()
                    os.fsync(f.fileno())
                files.append((path, at))
        except BaseException:
            for _, at in files:
                os.unlink(at)
            raise
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        files = [f for m in messages if m is not None for f in m.files]
        paths = [p for p, _ in files]
        try:
            if len(set(paths)) < len(paths):
                raise ValueError("two rows have one path")
            taken = [] if self.overwrite else [p for p in paths if os.path.lexists(f"{self.target}/{p}")]
            if taken:
                raise FileExistsError(f"{taken[0]} is there already")
            os.makedirs(self.target, exist_ok=True)
            for path, at in files:
                os.makedirs(os.path.dirname(f"{self.target}/{path}"), exist_ok=True)
                os.replace(at, f"{self.target}/{path}")
        finally:
            shutil.rmtree(self.staging, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)  # with what lost attempts have left there


class BinaryFiles(DataSource):
    """``df.write.format("frond_binary").mode("append").save(folder)`` with columns path and content (binary)."""

    @classmethod
    def name(cls) -> str:
        return "frond_binary"

    def writer(self, schema: StructType, overwrite: bool) -> BinaryWriter:
        kinds = {f.name: f.dataType.simpleString() for f in schema}
        if kinds.get("path") != "string" or kinds.get("content") != "binary":
            raise ValueError("columns path (string) and content (binary) are needed")
        return BinaryWriter(local_path(self.options["path"]), overwrite)


def write_files(df: DataFrame, folder: str, overwrite: bool = False) -> None:
    """Write rows of (path, content) as files below ``folder``, all or none of them.

    A path that is there already is an error unless ``overwrite``, as are two rows with one path and paths that leave the
    folder. Null content is an empty file; other columns are ignored; an empty table writes nothing.
    """
    df.sparkSession.dataSource.register(BinaryFiles)
    df.select(F.col("path").cast("string").alias("path"), F.col("content").cast("binary").alias("content")).write.format("frond_binary").mode("overwrite" if overwrite else "append").save(folder)


def write_images(px: DataFrame, key: str, folder: str, overwrite: bool = False) -> None:
    """Write every image of a pixel table (key, y, x, v of 0 to 255) as a binary PGM file named by its key.

    Missing pixels are black, an image is as large as its largest places. One image is made in one task, by sorting its pixels'
    places within a group; images meet in one shuffle.
    """
    byte = F.least(F.greatest(F.round("v"), F.lit(0)), F.lit(255)).cast("int")
    places = F.map_from_entries(F.collect_list(F.struct((F.col("y").cast("long") * (1 << 20) + F.col("x")).alias("at"), byte.alias("v"))))
    images = px.filter("y is not null and x is not null").groupBy(key).agg((F.max("y") + 1).alias("h"), (F.max("x") + 1).alias("w"), places.alias("of"))
    line = lambda y: F.array_join(F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda x: F.lpad(F.hex(F.coalesce(F.try_element_at("of", y.cast("long") * (1 << 20) + x), F.lit(0))), 2, "0")), "")
    body = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), F.col("h") - 1), line), ""))
    head = F.concat(F.lit("P5\n"), F.col("w").cast("string"), F.lit(" "), F.col("h").cast("string"), F.lit("\n255\n")).cast("binary")
    write_files(images.select(F.concat(F.col(key).cast("string"), F.lit(".pgm")).alias("path"), F.concat(head, body).alias("content")), folder, overwrite)


#: Columns of a prediction file, in order; those that a table lacks are left out.
PREDICTION_COLUMNS = ("leaf_id", "image_path", "species", "level", "y_true", "y_pred", "p_unhealthy", "correct")


def write_predictions(df: DataFrame, folder: str, truth: str = "y_true", predicted: str = "y_pred") -> None:
    """Predictions as CSV files with a header: the known columns first, ``correct`` added, then all others; nested ones as JSON.
    The folder is replaced as a whole by Spark's own commit."""
    told = df.withColumn("correct", F.coalesce(F.col(truth).eqNullSafe(F.col(predicted)), F.lit(False)))
    names = [c for c in PREDICTION_COLUMNS if c in told.columns] + [c for c in told.columns if c not in PREDICTION_COLUMNS]
    flat = [F.to_json(c).alias(c) if told.schema[c].dataType.typeName() in ("array", "map", "struct") else F.col(c) for c in names]
    told.select(*flat).write.mode("overwrite").option("header", True).csv(folder)


def save_model(spark: SparkSession, model: PipelineModel, folder: str, **facts) -> None:
    """A fitted pipeline and what belongs to it (threshold, columns, ...) as one folder: facts as a row of JSON in ``facts``, the
    model in ``model``. The facts are written last, so a folder without them isn't whole."""
    model.write().overwrite().save(f"{folder}/model")
    import json

    spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string").coalesce(1).write.mode("overwrite").text(f"{folder}/facts")


def load_model(spark: SparkSession, folder: str) -> tuple[PipelineModel, dict]:
    import json

    facts = [r[0] for r in spark.read.text(f"{folder}/facts").collect()]  # one row
    if len(facts) != 1:
        raise ValueError(f"{folder} holds no whole model")
    return PipelineModel.load(f"{folder}/model"), json.loads(facts[0])
