"""A training-text pipeline over the documents table: five stages, each calling one operator of ``frond.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All but the last return the columns of documents, and whatever
others the table has.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from frond.llm import bpe, exact_dedup, minhash, mixing, quality
from frond.llm.common import removed, shared_folder, table

#: What a worker keeps of what it has encoded; less than alone, as an executor has run four stages before.
ENCODED_CHUNKS = 100_000


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go; null and empty texts and fewer than 20 words are rejected. Repeated rows fare
    alike, a null doc_id is never trusted, an empty table gives an empty one."""
    return quality.kept(docs, table(spark, sf_dir, "labels"))


def exact_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one document stays: the longest original, then the smallest doc_id (null last); a row repeated as a
    whole stays once. Empty in, empty out."""
    return exact_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of a group of near duplicates one document stays: the smallest doc_id (null last). Texts without words are no
    duplicates. Empty in, empty out."""
    return minhash.deduplicated(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or left out until each source has its target of words. Null sources are one source, the last;
    null texts have no words and go along with the whole repetitions. Empty in, empty out."""
    return mixing.mixed(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the token ids of the text and the digests of both ways; null and empty texts have no ids."""
    return bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=True, chunks=ENCODED_CHUNKS)


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_duplicates", exact_duplicates),
    ("near_duplicates", near_duplicates),
    ("source_mix", source_mix),
    ("token_ids", token_ids),
]

#: SQL can express neither the likelihood ratio of hashed n-grams nor byte-pair merges; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; what each returns is written to the shared folder and read again.

    A stage's table goes when the next one's has been written; the last of them stays for the result to be read from.
    """
    docs = table(spark, sf_dir, "documents")
    at = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
        if before:
            removed(spark, f"{at}/{before}")
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)
