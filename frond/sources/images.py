"""Scans of image folders, and decoding of their bytes.

A folder scan is Spark's binaryFile source: file listing, splitting and retries are Spark's, and the content column is read
only where a query uses it. Decoding knows uncompressed PPM/PGM and BMP by itself and JPEG and PNG by Spark's own image source.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGE = "struct<height: int, width: int, channels: int, data: binary>"
MIME = {"jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png"}
_PNM = re.compile(rb"P([56])\s(?:#.*\n)?\s*(\d+)\s+(\d+)\s+(\d+)\s")


def scan(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, modificationTime, length and, if asked for, content of all image files below a folder."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{jpg,jpeg,png,ppm,pgm,JPG,JPEG,PNG}").load(root)
    return df if content else df.drop("content")


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def mime(path: Column, default: str = "image/jpeg") -> Column:
    """The media type by extension."""
    found = F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv])
    return F.coalesce(F.try_element_at(found, extension(path)), F.lit(default))


def split_uploads(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted files, and rejected ones with a status 400 and the reason."""
    kind = F.try_element_at(F.create_map(*[F.lit(x) for kv in MIME.items() for x in kv]), extension(F.col("path")))
    reason = F.when(kind.isNull(), "media type").when(F.col("length") == 0, "empty file")
    told = files.withColumn("reason", reason)
    return told.filter("reason is null").drop("reason"), told.filter("reason is not null").withColumn("status", F.lit(400))


def with_labels(files: DataFrame, levels: dict[str, str]) -> DataFrame:
    """species, level, view and file of <root>/species/level/view/file; rows of unknown levels are left out."""
    part = lambda i: F.element_at(F.split(F.col("path"), r"[/\\]"), -i)
    known = F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])
    out = files.withColumns({"species": part(4), "folder": part(3), "view": F.lower(part(2)), "file": part(1)})
    return out.withColumn("level", F.try_element_at(known, F.col("folder"))).filter("level is not null").drop("folder")


def first_existing_folder(files: DataFrame, priority: list[str]) -> DataFrame:
    """Of each (species, view), the files of the first folder in ``priority`` that has any."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col("folder"))
    best = files.filter(rank > 0).groupBy("species", "view").agg(F.min(rank).alias("best"))
    return files.withColumn("best", rank).join(best, ["species", "view", "best"], "left_semi").drop("best")


def counts_by_folder(files: DataFrame) -> DataFrame:
    return files.groupBy(F.regexp_replace("path", r"[/\\][^/\\]*$", "").alias("folder")).agg(F.count("*").alias("n"))


def is_test(path: Column, any_case: bool) -> Column:
    """Whether a file's name begins with test_; species files in any case, health files only in lower case."""
    stem = F.regexp_extract(path, r"([^/\\]*)$", 1)
    return F.startswith(F.lower(stem) if any_case else stem, F.lit("test_"))


def decode_pnm(content: Column) -> Column:
    """The image in the bytes of a binary PGM or PPM file."""
    return F.pandas_udf(_decode_pnm, IMAGE)(content)


def _decode_pnm(content: pd.Series) -> pd.DataFrame:
    """Binary PGM and PPM bytes as images (blue, green, red); null where the bytes are something else."""
    rows = []
    for raw in content:
        m = _PNM.match(raw or b"")
        if not m or int(m[4]) > 255:
            rows.append((None, None, None, None))
            continue
        channels, w, h = (1 if m[1] == b"5" else 3), int(m[2]), int(m[3])
        data = np.frombuffer(raw, np.uint8, offset=m.end())
        if len(data) < h * w * channels:
            rows.append((None, None, None, None))
            continue
        data = data[: h * w * channels].reshape(h, w, channels)[:, :, ::-1]
        rows.append((h, w, channels, data.tobytes()))
    return pd.DataFrame(rows, columns=["height", "width", "channels", "data"]).astype({"height": "Int32", "width": "Int32", "channels": "Int32"})


def decoded(spark: SparkSession, root: str) -> DataFrame:
    """path, height, width, channels and data (BGR bytes) of JPEG and PNG files; data is null where a file can't be read."""
    image = spark.read.format("image").option("recursiveFileLookup", "true").load(root).select("image.*")
    bad = F.col("height") < 0
    return image.select(F.col("origin").alias("path"), *[F.when(~bad, F.col(c)).alias(n) for c, n in (("height", "height"), ("width", "width"), ("nChannels", "channels"), ("data", "data"))])


def exif_time(text: Column) -> Column:
    """The capture time of an EXIF text."""
    return F.try_to_timestamp(text, F.lit("yyyy:MM:dd HH:mm:ss"))
