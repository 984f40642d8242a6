"""What several operators share: checkpoints in the shared folder, joins that stand hot keys, text splitting."""

from __future__ import annotations

import ctypes
import functools
import re
import sys
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType

#: ASCII white space, as the queries' contracts define it; the same class works in Java, Python and RE2.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
WORD_RE = re.compile(WORD)

#: A key is hot when it holds more than this share of all rows, so at most 1 / HOT_SHARE keys are.
HOT_SHARE = 1 / 2000
#: A table of ids is broadcast up to this many rows (about 16 MB in memory), and joined by a shuffle beyond.
BROADCAST_ROWS = 200_000
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


_kept: dict = {}


def given_back() -> None:
    """Return what Arrow and the C library hold free to the system; only glibc has a call for the latter."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None) if sys.platform == "linux" else None
    if trim:
        trim(0)


def of_stage(key, make):
    """What a Python worker keeps from task to task of one stage: made once, and dropped by the first task of another stage."""
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if _kept.get("stage") != stage:
        _kept.clear()
        given_back()
        _kept["stage"] = stage
    if key is not None and key not in _kept:
        _kept[key] = make()
    return _kept.get(key)


def modest_batches(spark: SparkSession) -> None:
    """Arrow batches of 1,000 rows where the session has Spark's default of 10,000, as each row here holds a whole text."""
    if spark.conf.get(BATCH_ROWS) == "10000":
        spark.conf.set(BATCH_ROWS, "1000")


def tidy(run):
    """A function of a task's batches that gives free memory back at the end, as Python workers live on."""

    @functools.wraps(run)
    def tidied(batches):
        of_stage(None, None)
        try:
            yield from run(batches)
        finally:
            given_back()

    return tidied


def ascii_lower(text: str) -> str:
    """Lower-case A-Z only, whatever else the text holds."""
    return text.lower() if text.isascii() else text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")


def shared_folder(spark: SparkSession) -> str:
    """The folder for checkpoints that the cluster names in spark.checkpoint.dir. Where it names none, a session in one
    process gets a folder of its own; on a cluster that is an error, as no machine's own folder is seen by the others."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not re.match(r"local(\[|$)", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="frond-checkpoints-"))
    return context.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, lasting: bool = False) -> DataFrame:
    """The same for the state of a loop: written as a table in the shared folder and read again.

    A checkpoint keeps the size that was estimated for its plan. In a loop that joins its state with itself the estimate is
    squared on every turn, until the driver runs out of memory over its digits; a table's size is the size of its files.
    Inside ``scratch`` the table lasts as long as that does, unless it is ``lasting``.
    """
    path = f"{_scratch[-1] if _scratch and not lasting else shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_scratch: list[str] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Within it ``written`` puts its tables into one folder, which goes when it ends; what is still needed must be saved by then."""
    _scratch.append(f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}")
    try:
        yield
    finally:
        removed(spark, _scratch.pop())


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder, wherever Spark's file systems have it."""
    there = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(there, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a saved table may be broadcast; it reads no more than rows + 1 rows."""
    return df.limit(rows + 1).count() <= rows


def join_small_or_shuffled(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """A join whose right side is broadcast only after its size has been checked; beyond that it is shuffled."""
    return left.join(F.broadcast(right) if small(right) else right, on, how)


def left_join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Left join with a right side that has one row for each key and says in ``weight`` how many left rows have it.

    Keys with more than HOT_SHARE of all ``total`` left rows number fewer than 1 / HOT_SHARE: they are broadcast, and
    the left rows that have them are not shuffled. All other keys are joined by a shuffle of even partitions.
    Both sides are read twice, so save what is dear to make.
    """
    limit = max(1000, int(total * HOT_SHARE))
    hot, rest = right.filter(F.col(weight) > limit), right.filter(F.col(weight) <= limit)
    names = hot.select(F.col(key))
    return left.join(F.broadcast(hot), key).unionByName(left.join(F.broadcast(names), key, "left_anti").join(rest, key, "left"))


def inner_join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, total: int) -> DataFrame:
    """Inner join with such a right side; both sides are read twice."""
    limit = max(1000, int(total * HOT_SHARE))
    hot, rest = right.filter(F.col(weight) > limit), right.filter(F.col(weight) <= limit)
    return left.join(F.broadcast(hot), key).unionByName(left.join(rest, key))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: str, keys: DataFrame | None = None) -> DataFrame:
    """Inner join with a right side that has one row for each key, where a few keys may hold most of the left rows.

    Up to BROADCAST_ROWS left rows any key is small enough for one task. Beyond, keys with more than HOT_SHARE of the left
    rows, fewer than 1 / HOT_SHARE, are found first. Their right rows are repeated
    so that each copy meets about that share of the left rows, dealt out by the column ``spread``. Right rows may be of any
    size, as only the hot keys are broadcast. ``keys`` is a saved table with the left side's keys, where that itself is dear
    to make.
    """
    keys = left if keys is None else keys
    if small(keys):
        return left.join(right, key)
    counts = keys.groupBy(key).agg(F.count("*").alias("_n"))
    total = counts.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    limit = max(1000, int(total * HOT_SHARE))
    hot = saved(counts.filter(F.col("_n") > limit).select(key, F.ceil(F.col("_n") / limit).cast("int").alias("_copies")))
    if hot.isEmpty():
        return left.join(right, key)
    copies = F.coalesce("_copies", F.lit(1))
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_copy", F.pmod(F.xxhash64(spread), copies).cast("int")).drop("_copies")
    repeated = right.join(F.broadcast(hot), key, "left").withColumn("_copy", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return dealt.join(repeated, [key, "_copy"]).drop("_copy")


def row_key(docs: DataFrame) -> Column:
    """A digest of a row's id, text and all other columns: equal for rows that are repeated as a whole, and for no others."""
    names = [F.col(f"`{c}`") for c in docs.columns]
    plain = [F.to_json(c) if isinstance(f.dataType, (StructType, ArrayType, MapType)) else c for c, f in zip(names, docs.schema)]
    rest = F.xxhash64(*[F.isnull(c) for c in names], *plain)
    return F.unhex(F.md5(F.concat_ws(":", F.col("doc_id").cast("string"), F.md5("text"), rest.cast("string"))))


def staying(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    ``decided`` (key: the row_key, stays) has a row for each row of ``docs`` that may go. Rows repeated as a whole are
    interchangeable; of those that stay one does.
    """
    made = saved(decided.groupBy("key").agg(F.count("*").alias("copies"), F.max("stays").alias("once")).filter("copies > 1 or not once").select("key", "once"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), row_key(docs).alias("key"))
    told = join_small_or_shuffled(whole, made, ["key"], "left")
    out = told.filter(F.isnull("once")).select("doc")
    if not made.filter("once").isEmpty():
        out = out.unionByName(told.filter("once").groupBy("key").agg(F.first("doc").alias("doc")).select("doc"))
    return out.select("doc.*")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
