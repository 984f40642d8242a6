"""Quality rules: base measures of a text, and the log-likelihood ratio of its hashed n-grams.

Two multinomials over hashed unigrams and bigrams are counted: one over the trusted target (documents labelled good), one
over the raw corpus (all documents). A document's verdict is the ratio of its likelihoods under the two, divided by its
number of n-grams, against a fixed threshold; every document gets the same deterministic rule. Tokens are runs of letters
and digits or runs of signs, so that symbols stuck to words count as symbols.

The counts are summed by Spark over all rows; a table of ``BUCKETS`` weights, whose size is fixed, goes back to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.llm.bpe import Cache
from frond.llm.common import WORD_RE, join_small_or_shuffled, modest_batches, saved, tidy

BUCKETS = 1 << 14
#: Least mean log-likelihood ratio of a kept document, in nats an n-gram.
THRESHOLD = -0.1
MIN_WORDS, WINDOW, MAX_REPEATED = 20, 8, 30

_TOKEN = re.compile(r"\w+|[^\w\s]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_MIX, _MIX2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class Words(Cache):
    """Hashes of words, 64 bits each; a task keeps those that it has met last."""

    def __init__(self):
        super().__init__(lambda w: xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")), entries=30_000)

    def hashes(self, words: list[str]) -> np.ndarray:
        return np.array([self[w] for w in words], np.uint64)


def ngrams(text: str | None, known: Words) -> np.ndarray:
    """The buckets of a text's unigrams and bigrams, with repetitions."""
    h = known.hashes(_TOKEN.findall((text or "").lower()))
    pairs = (h[:-1] * _MIX + h[1:]) * _MIX2
    return (np.concatenate([h * _MIX2, pairs]) >> np.uint64(64 - 14)).astype(np.int64)


def measures(text: str | None, known: Words) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text; null has no words."""
    text = text or ""
    words = WORD_RE.findall(text)
    seen: set[str] = set()
    repeated = 0
    for line in text.split("\n"):
        if WORD_RE.search(line):
            repeated += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), repeated, _in_repeated_windows(words, known)


def _in_repeated_windows(words: list[str], known: Words) -> int:
    """Words that stand in a window of eight which the text has twice or more."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = known.hashes(words)
    windows = np.zeros(n, np.uint64)
    for i in range(WINDOW):
        windows = (windows ^ (windows >> np.uint64(31))) * _MIX + h[i : i + n]
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    starts = np.flatnonzero(counts[back] > 1)
    np.add.at(steps, starts, 1)
    np.add.at(steps, starts + WINDOW, -1)
    return int((steps[:-1].cumsum() > 0).sum())


def counts(docs: DataFrame, trusted: DataFrame) -> DataFrame:
    """(bucket, raw, target): n-grams of all ``docs`` and of those whose doc_id is in ``trusted`` (doc_id, saved)."""
    modest_batches(docs.sparkSession)
    marked = join_small_or_shuffled(docs.select("doc_id", "text"), trusted.withColumn("good", F.lit(True)), ["doc_id"], "left")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target, known = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64), Words()
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1)):
                found = np.bincount(ngrams(text.as_py(), known), minlength=BUCKETS)
                raw += found
                if good.as_py():
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    parts = marked.select("text", "good").mapInArrow(run, "bucket long, raw long, target long")
    return parts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def weights(docs: DataFrame, trusted: DataFrame) -> np.ndarray:
    """The log ratio of the two multinomials for every bucket, smoothed by one; all zero if nothing is trusted."""
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for bucket, r, t in counts(docs, trusted).collect():  # BUCKETS rows at most
        raw[bucket], target[bucket] = r, t
    if not target.any():
        return np.zeros(BUCKETS)
    return np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """The doc_ids that are labelled good; null ids and labels are not."""
    return saved(labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct())


MEASURED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double"


def judge(weight: np.ndarray, threshold: float = THRESHOLD) -> Callable[[Column], Column]:
    """A function from a column of texts to a struct of MEASURED."""

    @tidy
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Words()
        for texts in batches:
            rows = []
            for text in texts:
                n, chars, symbols, lines, repeats = measures(text, known)
                grams = ngrams(text, known)
                ratio = float(weight[grams].mean()) if len(grams) else 0.0
                failed = n < MIN_WORDS or 100 * repeats > MAX_REPEATED * n
                rows.append((n, chars, symbols, lines, repeats, failed, not failed and ratio >= threshold, ratio))
            yield pd.DataFrame(rows, columns=[x.split()[0] for x in MEASURED.split(", ")])

    return F.pandas_udf(run, MEASURED)


def verdicts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept and ratio for every row.

    A null or empty text has no words and fails the base rules. Rows repeated as a whole give repeated results; a null
    doc_id is never trusted. Without trusted documents the ratio is 0 and the base rules alone decide. An empty table
    gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    judged = docs.select("doc_id", judge(weights(docs, trusted_ids(labels)))(F.col("text")).alias("said"))
    return judged.select("doc_id", "said.*")


def kept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns, whatever their names; odd rows as in ``verdicts``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    judged = docs.select(whole, judge(weights(docs, trusted_ids(labels)))(F.col("text")).alias("said"))
    return judged.filter("said.kept").select("doc.*")
