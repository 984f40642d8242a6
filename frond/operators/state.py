"""State of loops: written as tables in the folder that driver and executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a session in one process that names none gets one of its own."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="frond-state-"))
    return context.getCheckpointDir()


class Tables:
    """A loop's tables. Each ``put`` writes one; ``drop`` removes those that are no longer read."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.at = f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"

    def put(self, df: DataFrame, name: str, by: list[str] = []) -> DataFrame:  # noqa: B006
        df.write.partitionBy(*by).parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def drop(self, name: str) -> None:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.at}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
