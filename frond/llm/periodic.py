"""Periodic runs of words, found by an all-lag scan.

A text becomes an array of word ids. The array is compared with itself shifted by every lag up to half its length; where
equal places stand together long enough, they and the ``lag`` words that follow form a stretch with that period. A stretch
of length 2q and more that has a smaller period p has one that divides q, and the scan at lag p finds the very same
stretch, so the least lag of a (start, length) is its smallest period.

Spark deals the work out by documents and lags. Texts of up to LONG_CHARS are scanned where they are read, many at once:
arrays of texts of like length are laid end to end with ids of their own, so that no two texts share an id and no stretch
crosses a border. A longer text is cut into ranges of lags of about RANGE comparisons; each range is a row that carries the
ids and goes to any machine, and the stretches of a text meet again by its id and digest. Only long texts are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frond.llm.common import WORD_RE, modest_batches, tidy

#: Least length of a run in words, and least number of times that its period fits in.
MIN_WORDS, MIN_TIMES = 12, 2
#: Texts of more code points are scanned in ranges of lags.
LONG_CHARS = 50_000
#: Comparisons of one range, and the least number of lags in one, so that ids sent grow slower than the scan.
RANGE, RANGE_LAGS = 1 << 26, 2048
#: Words of short texts laid end to end for one scan; few enough for the cache and for ids of 16 bits.
TOGETHER = 1 << 15

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
RUNS = "array<struct<start: bigint, length: bigint, period: bigint>>"
FOUND = f"doc_id long, n_words long, runs {RUNS}, collapsed string"


def word_ids(texts: list[list[str]]) -> np.ndarray:
    """The words of several texts as numbers, end to end; equal numbers are equal words of one text."""
    out: list[int] = []
    top = 0
    for words in texts:
        known: dict[str, int] = {}
        out += [known.setdefault(w, top + len(known)) for w in words]
        top += len(known)
    return np.array(out, np.uint16 if top <= 1 << 16 else np.uint32)


def stretches(ids: np.ndarray, lags: range) -> np.ndarray:
    """Rows (start, length, lag) of the longest stretches that have one of the ``lags`` as a period and are long enough."""
    found = [np.empty((0, 3), np.int64)]
    for lag in lags:
        least = max(MIN_WORDS - lag, (MIN_TIMES - 1) * lag)  # equal places in a row
        if len(ids) - lag < least:
            break
        same = ids[lag:] == ids[: len(ids) - lag]
        if np.count_nonzero(same) < least:
            continue
        ends = same[: len(same) - least + 1] & same[least - 1 :]  # both ends of a window of ``least`` places
        if not ends.any() or not (ends & same[least // 2 : least // 2 + len(ends)]).any():
            continue
        at = np.flatnonzero(same)
        breaks = np.flatnonzero(np.diff(at) != 1)
        first, last = at[np.r_[0, breaks + 1]], at[np.r_[breaks, len(at) - 1]]
        size = last - first + 1
        enough = size >= least
        if enough.any():
            found.append(np.stack([first[enough], size[enough] + lag, np.full(enough.sum(), lag)], axis=1))
    return np.concatenate(found)


def primitive(found: np.ndarray) -> np.ndarray:
    """One row for each (start, length), with its least lag, by start and then by period."""
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    fresh = np.ones(len(found), bool)
    fresh[1:] = (found[1:, :2] != found[:-1, :2]).any(axis=1)
    found = found[fresh]
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def runs_of(texts: list[list[str]]) -> list[np.ndarray]:
    """The runs of every text, which come by length."""
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        upto, size = at, 0
        while upto < len(texts) and (upto == at or size + len(texts[upto]) <= TOGETHER):
            size += len(texts[upto])
            upto += 1
        borders = np.cumsum([0, *map(len, texts[at:upto])])
        lags = max(map(len, texts[at:upto])) // MIN_TIMES
        found = primitive(stretches(word_ids(texts[at:upto]), range(1, lags + 1)))
        cuts = np.searchsorted(found[:, 0], borders)
        for k in range(upto - at):
            own = found[cuts[k] : cuts[k + 1]].copy()
            own[:, 0] -= borders[k]
            out.append(own)
        at = upto
    return out


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words that no run contains after its first period, joined by one blank."""
    if not len(runs):
        return " ".join(words)
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    covered = steps.cumsum()
    return " ".join(w for w, c in zip(words, covered.tolist()) if not c)


def _told(ids: list, texts: list[list[str]], runs: list[np.ndarray]) -> pa.RecordBatch:
    every = np.concatenate([np.empty((0, 3), np.int64), *runs])
    offsets = np.cumsum([0, *map(len, runs)]).astype(np.int32)
    structs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(RUN))
    arrays = [
        pa.array(ids, pa.int64()),
        pa.array([len(w) for w in texts], pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets), structs),
        pa.array([collapsed(w, r) for w, r in zip(texts, runs)], pa.string()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "runs", "collapsed"])


@tidy
def _scan_whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) -> FOUND."""
    for batch in batches:
        rows = sorted(((WORD_RE.findall(t or ""), i) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())), key=lambda x: len(x[0]))
        texts = [w for w, _ in rows]
        yield _told([i for _, i in rows], texts, runs_of(texts))


def lag_ranges(n: int) -> Iterator[tuple[int, int]]:
    """Ranges (first, last) of all lags of n words, each of about RANGE comparisons."""
    first, top, work = 1, n // MIN_TIMES, max(RANGE, RANGE_LAGS * n)
    while first <= top:
        last = min(top, first + max(1, work // (n - first)) - 1)
        yield first, last
        first = last + 1


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, key, copies, text) -> (doc_id, key, copies, text or null, first, last, ids, width); a text goes with its first range."""
    for batch in batches:
        for i, key, copies, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = WORD_RE.findall(text)
            ids = word_ids([words])
            for first, last in lag_ranges(len(words)) if len(words) >= MIN_TIMES else [(1, 0)]:
                row = [[i], [key], [copies], [text if first == 1 else None], [first], [last], [ids.tobytes()], [ids.itemsize]]
                kinds = [pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, kinds)], ["doc_id", "key", "copies", "text", "first", "last", "ids", "width"])


@tidy
def _scan_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What ``_cut`` makes -> (doc_id, key, copies, text or null, runs)."""
    for batch in batches:
        found = [primitive(stretches(np.frombuffer(ids, f"u{width}"), range(a, b + 1))) for a, b, ids, width in zip(*(batch.column(k).to_pylist() for k in (4, 5, 6, 7)))]
        every, offsets = np.concatenate(found), np.cumsum([0, *map(len, found)]).astype(np.int32)
        structs = pa.StructArray.from_arrays([pa.array(every[:, k]) for k in range(3)], fields=list(RUN))
        arrays = [*(batch.column(k) for k in range(4)), pa.ListArray.from_arrays(pa.array(offsets), structs)]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "key", "copies", "text", "runs"])


@tidy
def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, copies, text, runs of all ranges) -> FOUND, as often as the row was there."""
    for batch in batches:
        for i, copies, text, found in zip(*(batch.column(k).to_pylist() for k in range(4))):
            words = WORD_RE.findall(text)
            runs = primitive(np.array([(r["start"], r["length"], r["period"]) for r in found], np.int64).reshape(-1, 3))
            told = _told([i], [words], [runs])
            for _ in range(copies):
                yield told


def runs(docs: DataFrame, long_chars: int = LONG_CHARS, size: str | None = None) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_words, runs (start, length and period in words, by start and then
    period) and collapsed (the words that no run contains after its first period, joined by one blank).

    A run has at least MIN_WORDS words, holds its smallest period MIN_TIMES times and can't be longer on either side. A null
    or empty text has no words and no runs. Repeated rows give repeated results, whatever their ids; a null doc_id is an id
    like any other. Texts of any length are read whole. An empty table gives an empty result; other columns are ignored.
    ``size`` may name a column that says how large a text is, where the text itself is dear to make.
    """
    modest_batches(docs.sparkSession)
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text"), (F.length(text) if size is None else F.col(size)).alias("size"))
    short = rows.filter(F.col("size") <= long_chars).select("doc_id", "text").mapInArrow(_scan_whole, FOUND)
    texts = rows.filter(F.col("size") > long_chars).groupBy("doc_id", F.unhex(F.md5("text")).alias("key")).agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    cut = texts.select("doc_id", "key", "copies", "text").mapInArrow(_cut, "doc_id long, key binary, copies long, text string, first long, last long, ids binary, width int")
    ranges = cut.repartition("doc_id", "key", "first").mapInArrow(_scan_ranges, f"doc_id long, key binary, copies long, text string, runs {RUNS}")
    whole = ranges.groupBy("doc_id", "key").agg(F.max("copies").alias("copies"), F.max("text").alias("text"), F.flatten(F.collect_list("runs")).alias("runs"))
    return short.unionByName(whole.select("doc_id", "copies", "text", "runs").mapInArrow(_joined, FOUND))
