"""Exact deduplication in DataFrame operations only.

Texts are equal when they are identical without ASCII white space. Documents are grouped by the 128-bit MD5 of the
normalised text. Inside groups of two or more, the bytes are compared by grouping on the text itself, so that two texts
with one hash fall into two classes. Only texts of such groups are shuffled, never the unique ones; copies on one task
are folded before the shuffle, so a group may hold any share of all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.llm.common import SPACE, left_join_hot, row_key, saved, small, staying


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE}]+", "")


def md5_128(norm: Column) -> Column:
    return F.unhex(F.md5(norm))


def hashed(rows: DataFrame, hash128=md5_128) -> DataFrame:
    """row, doc_id, hash, text_sha256 and n (code points of the original) of rows (row: what tells them apart, doc_id, text), saved."""
    norm = normalised(F.col("text"))
    return saved(rows.select("row", "doc_id", hash128(norm).alias("hash"), F.sha2(norm, 256).alias("text_sha256"), F.length(F.coalesce("text", F.lit(""))).alias("n")))


def variants(docs: DataFrame, rows: DataFrame, total: int, hash128=md5_128) -> DataFrame | None:
    """(hash, text_sha256, variant) of texts that share a hash with another text; None where no two texts do.

    The comparison groups the texts of repeated hashes by (hash, bytes).
    """
    repeated = saved(rows.groupBy("hash").agg(F.count("*").alias("size")).filter("size > 1"))
    norm = normalised(F.col("text"))
    every = docs.select(hash128(norm).alias("hash"), norm.alias("norm"))
    if small(repeated):
        texts = every.join(F.broadcast(repeated.select("hash")), "hash", "left_semi")
    else:
        texts = left_join_hot(every, repeated, "hash", "size", total).filter("size is not null").drop("size")
    by_bytes = texts.groupBy("hash", "norm").agg(F.count("*").alias("copies"))
    clashes = saved(
        by_bytes.groupBy("hash").agg(F.count("*").alias("texts"), F.sort_array(F.collect_set(F.sha2("norm", 256))).alias("shas")).filter("texts > 1")
    )
    if clashes.isEmpty():
        return None
    return clashes.select("hash", F.posexplode("shas").alias("variant", "text_sha256"))


def decisions(docs: DataFrame, hash128=md5_128) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256, and hash and row.

    Of equal texts the row with most code points in its original text stays, of those the one with the smallest doc_id
    (a null doc_id comes last), of repeated rows the first. Null and empty texts, and texts of white space only, are equal
    to each other. An empty table gives an empty result. Other columns of ``docs`` are ignored, so their names can't
    clash.
    """
    return _decided(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text"), hash128)


def _decided(docs: DataFrame, hash128=md5_128) -> DataFrame:
    rows = hashed(docs, hash128)
    total = rows.count()
    clashing = variants(docs, rows, total, hash128)
    if clashing is None:
        rows = rows.withColumn("key", F.concat("hash", F.lit(b"\0")))
    else:
        rows = saved(
            rows.join(clashing, ["hash", "text_sha256"], "left").withColumn("key", F.concat("hash", F.encode(F.coalesce("variant", F.lit(0)).cast("string"), "UTF-8"))).drop("variant")
        )
    best = F.min(F.struct((-F.col("n")).alias("less"), F.isnull("doc_id").alias("no_id"), F.col("doc_id").alias("id"), F.col("row").alias("row"))).alias("best")
    groups = saved(rows.groupBy("key").agg(F.count("*").alias("group_size"), best).filter("group_size > 1"))
    groups = groups.select("key", "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    joined = left_join_hot(rows, groups, "key", "group_size", total)
    return joined.select(
        "doc_id",
        F.when(F.isnull("group_size"), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"),
        "text_sha256",
        "hash",
        "row",
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The very rows of ``docs`` that ``decisions`` keeps, one for each group of equal texts, with all their columns.

    Rows are told apart by a digest of all their columns, so of rows with one id and text the same one stays on every run.
    Nulls, ties, repeated rows and empty tables are handled as ``decisions`` says; extra columns may have any names.
    """
    rows = docs.select(row_key(docs).alias("row"), "doc_id", "text")
    return staying(docs, _decided(rows).select(F.col("row").alias("key"), F.col("kept").alias("stays")))
