"""Scoring texts with a class-based bigram model.

Exchange clustering gives each of the ``CORE`` most frequent words a class: words are moved, one after the other, to the
class that raises the likelihood of the class bigrams most, until none moves. The next words, up to ``CLASSED``, join the
class that explains the classes on both their sides best; then all words up to ``CLASSED`` are exchanged in the same way,
``WIDE_TURNS`` times, the classes beside every word being counted anew before each turn. Every rarer word that was seen
twice or more joins the class that explains the classes on both its sides best; the rarer words of a class have
transitions of their own. Words seen once stand for those never seen: both share one more class. The end of a text is a
class of its own. A text's probability is the product of the class transitions (smoothed towards the class frequencies)
and of the words' probabilities within their classes.

Word counts cover the whole training corpus, and the classes beyond ``CLASSED`` are found by word in a distributed table.
The training texts are cut into words twice, for the counts and for a table of word places, which all later passes read.
Tasks hold the ``HOT`` most frequent words (a fixed bound); what a document has of other words is joined with the table,
by keys none of which is frequent, each with the class or the word beside it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.llm.common import given_back, modest_batches, saved, scratch, tidy, written

CORE, CLASSED, HOT, CLASSES = 1024, 20_000, 120_000, 32
#: Weight of the class frequencies in a transition, in observations.
BETA = 5.0
TURNS, WIDE_TURNS = 15, 2
#: Words in a row of the table of places, and such rows that a task counts together, into a table of all cells or by word.
ROW_WORDS, SUM_ROWS, ROWS = 8_000, 16, 64
#: Texts, and about as many words at most, that a task scores together; words whose neighbours it sends in a batch.
TEXTS, TEXT_WORDS, SENT = 500, 200_000, 10_000
#: The class of words seen once or never, that of a text's end, and the first class of words beyond CLASSED.
OTHERS, STOP, TAIL = CLASSES, CLASSES + 1, CLASSES + 2
TOTAL = TAIL + CLASSES
#: The end of a text as a token; no word holds a line end.
END = "\n"


def words_of(text: pa.Scalar) -> list[bytes]:
    """The words of a whole text with A-Z in lower case, in UTF-8; bytes are split at ASCII white space alone."""
    return text.as_buffer().to_pybytes().lower().split() if text.is_valid else []


def _strings(words: list[bytes | None]) -> pa.Array:
    return pa.array(words, pa.binary()).cast(pa.string())


def _placed(words: list[bytes], get, limit: int) -> tuple[np.ndarray, list[bytes]]:
    """The places of a text's words, ``limit`` for those without one, then limit + 1 for its end; and the words without one."""
    x = np.array([*map(get, words, repeat(limit)), limit + 1], "<i4")
    return x, [words[i] for i in np.flatnonzero(x == limit).tolist()]


def word_counts(training: DataFrame) -> DataFrame:
    """(word, c) over all training texts, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out():
            return pa.RecordBatch.from_arrays([_strings(list(seen)), pa.array(list(seen.values()), pa.int64())], ["word", "c"])

        for batch in batches:
            for text in batch.column(0):
                seen.update(words_of(text))
                seen[END.encode()] += 1
                if len(seen) > 300_000:
                    yield out()
                    seen.clear()
        yield out()

    return written(training.select("text").mapInArrow(tidy(run), "word string, c long").groupBy("word").agg(F.sum("c").alias("c")))


def coded(training: DataFrame, shared, limit: int) -> DataFrame:
    """(ids, cold), written: whole texts, one after the other, as places of words (32 bits each) in the ``shared`` index;
    ``limit`` is a word that has none, and stands in ``cold``; limit + 1 is the end of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        ids: list[np.ndarray] = []
        cold: list[bytes] = []
        done: list[bytes] = []
        offsets = [0]
        held = 0

        def cut():
            done.append(np.concatenate(ids).tobytes())
            offsets.append(len(cold))
            ids.clear()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(done, pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), _strings(cold))], ["ids", "cold"])
            cold.clear()
            done.clear()
            offsets[1:] = []
            return rows

        for batch in batches:
            for text in batch.column(0):
                x, without = _placed(words_of(text), get, limit)
                ids.append(x)
                cold += without
                held += len(x)
                if held >= ROW_WORDS:
                    cut()
                    held = 0
                    if len(done) >= ROWS:
                        yield out()
        if ids:
            cut()
        yield out()

    return written(training.select("text").mapInArrow(tidy(run), "ids binary, cold array<string>"))


def _places(rows: pa.Array) -> np.ndarray:
    """The places of all rows; each ends with a text's end."""
    return np.concatenate([np.frombuffer(row.as_buffer(), "<i4") for row in rows]).astype(np.int64)


def _summed(places: DataFrame, cells: int, found) -> np.ndarray:
    """A table of a fixed number of cells, summed over the table of places; found(ids) gives the cells in which places count,
    and is called for SUM_ROWS rows at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(cells, np.int64)
        for batch in batches:
            for start in range(0, batch.num_rows, SUM_ROWS):
                table += np.bincount(found(_places(batch.column(0).slice(start, SUM_ROWS))), minlength=cells)
        at = np.flatnonzero(table)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(table[at])], ["cell", "n"])

    rows = places.select("ids").mapInArrow(tidy(run), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros(cells, np.int64)
    table[rows["cell"].to_numpy()] = rows["n"].to_numpy()
    del rows
    given_back()
    return table


def _add(table: np.ndarray, cells: np.ndarray) -> None:
    found, times = np.unique(cells, return_counts=True)
    table[found] += times


def _xlogx(x: np.ndarray) -> np.ndarray:
    return np.where(x > 0, x * np.log(np.maximum(x, 1e-300)), 0.0)


def _exchanged(pairs: np.ndarray, a: int, left: np.ndarray, right: np.ndarray, own: float, classes: int) -> int:
    """Take a word out of its class a and put it where the likelihood of the class bigrams ``pairs``, which change with it,
    is greatest. left, right: the classes before and after the word, without itself; own: how often it follows itself."""
    pairs[a] -= right
    pairs[:, a] -= left
    pairs[a, a] -= own
    eye = np.eye(len(pairs), dtype=bool)
    rows, columns = pairs + right[None, :], pairs + left[:, None]
    now = _xlogx(pairs)
    gain = np.where(eye, 0, _xlogx(rows) - now).sum(axis=1) + np.where(eye, 0, _xlogx(columns) - now).sum(axis=0)
    corner = np.diag(pairs)
    gain += _xlogx(corner + right + left + own) - _xlogx(corner)
    ahead, behind = pairs.sum(axis=1), pairs.sum(axis=0)
    gain -= _xlogx(ahead + right.sum() + own) - _xlogx(ahead) + _xlogx(behind + left.sum() + own) - _xlogx(behind)
    gain = gain[:classes]
    b = int(gain.argmax())
    if gain[b] <= gain[a] + 1e-9:
        b = int(a)
    pairs[b] += right
    pairs[:, b] += left
    pairs[b, b] += own
    return b


def exchange(bigrams: np.ndarray, classes: int = CLASSES, turns: int = TURNS) -> np.ndarray:
    """Classes of words from their bigram counts; words come in order of frequency, the last two rows (others, end) keep
    classes of their own: ``classes`` and ``classes + 1``."""
    n, total = len(bigrams) - 2, classes + 2
    where = np.concatenate([np.arange(n) % classes, [classes, classes + 1]])
    member = np.eye(total)[where]
    counts = bigrams.astype(float)
    pairs = member.T @ counts @ member
    for _ in range(turns):
        moved = 0
        for w in range(n):
            a, own = where[w], counts[w, w]
            right = np.bincount(where, counts[w], total)
            left = np.bincount(where, counts[:, w], total)
            right[a] -= own
            left[a] -= own
            where[w] = _exchanged(pairs, a, left, right, own, classes)
            moved += where[w] != a
        if not moved:
            break
    return where


def beside_classed(places: DataFrame, where: np.ndarray, classed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each of the first ``classed`` words how often every class stands before it and after it, and how often it follows
    itself. ``where`` has the class of every place."""

    def found(x: np.ndarray) -> np.ndarray:
        k = where[x]
        at = np.flatnonzero(x < classed)  # never the last of a row, which is a text's end
        before = np.concatenate([[STOP], k[:-1]])[at]
        return np.concatenate([before * classed + x[at], (TAIL + k[at + 1]) * classed + x[at], 2 * TAIL * classed + x[at][x[at + 1] == x[at]]])

    seen = _summed(places, (2 * TAIL + 1) * classed, found).reshape(-1, classed).astype(float)
    return seen[:TAIL].T, seen[TAIL : 2 * TAIL].T, seen[-1]


def exchanged_widely(where: np.ndarray, left: np.ndarray, right: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One turn of exchange for all words that have a class in ``where``, from the classes beside them."""
    pairs, where = np.zeros((TAIL, TAIL)), where.copy()
    np.add.at(pairs.T, where, left)
    beyond = np.zeros((TAIL, TAIL))
    np.add.at(beyond, where, right)
    pairs[:, CLASSES:] = beyond[:, CLASSES:]
    for w in range(len(where)):
        a = where[w]
        alone = np.zeros(TAIL)
        alone[a] = own[w]
        where[w] = _exchanged(pairs, a, left[w] - alone, right[w] - alone, own[w], CLASSES)
    return where


def most_frequent(counts: DataFrame, most: int) -> pd.DataFrame:
    """The most frequent words, ``most`` at most, by falling count: all whose count reaches a bound, which a histogram of
    the counts' logarithms (2,000 bins) sets. So no task sends more than it has of these words, however many tasks there are.
    """
    bin_ = F.floor(F.log2("c") * 32)
    bound, total = None, 0
    for row in sorted(counts.groupBy(bin_.alias("bin")).agg(F.count("*").alias("n")).collect(), reverse=True):
        total += row.n
        if total > most:
            break
        bound = row.bin
    top = counts.filter(bin_ >= (1 << 30 if bound is None else bound)).select("word", "c").toArrow().to_pandas()
    return top.sort_values(["c", "word"], ascending=[False, True], ignore_index=True)


def neighbours(places: DataFrame, shared, where: np.ndarray) -> DataFrame:
    """(word, other, cells, cell, n), written: the class transitions (cell, n), for each word of the class OTHERS in ``where``
    the classes before it (c) and after it (TAIL + c), a byte each (cells), and how often one of them is followed by another
    (other, n). A task counts what is beside the hot ones among these words and sends it once, at its end."""
    limit = len(where) - 2
    hot_others = np.flatnonzero(where[:limit] == OTHERS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = _strings([*shared.value, b"", b""])
        table = np.zeros(TAIL * TAIL, np.int64)
        beside = np.zeros(len(hot_others) * 2 * TAIL, np.int32)

        def out(rows: int, **columns):
            kinds = {"word": pa.string(), "other": pa.string(), "cells": pa.binary(), "cell": pa.int64(), "n": pa.int64()}
            return pa.RecordBatch.from_arrays([pa.nulls(rows, k) if (x := columns.get(c)) is None else x if isinstance(x, pa.Array) else pa.array(x, k) for c, k in kinds.items()], list(kinds))

        def packed(words: pa.Array, cells: np.ndarray, sizes: np.ndarray):
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
            return out(len(words), word=words, cells=pa.Array.from_buffers(pa.binary(), len(words), [None, offsets.buffers()[1], pa.py_buffer(cells.astype(np.uint8).tobytes())]))

        for batch in batches:
            for start in range(0, batch.num_rows, ROWS):
                part = batch.slice(start, ROWS)
                x = _places(part.column(0))
                k = where[x]
                before = np.concatenate([[STOP], k[:-1]])
                table += np.bincount(before * TAIL + k, minlength=len(table))
                cold = part.column(1).flatten().dictionary_encode()
                names = pa.concat_arrays([hot, cold.dictionary])
                x[x == limit] = limit + 2 + cold.indices.to_numpy(zero_copy_only=False)
                every = np.flatnonzero(k == OTHERS)
                at = every[x[every] < limit]
                own = np.searchsorted(hot_others, x[at]) * 2 * TAIL
                _add(beside, np.concatenate([own + before[at], own + TAIL + k[at + 1]]))
                at = every[x[every] > limit]
                of = np.argsort(x[at], kind="stable")
                found, n = np.unique(x[at], return_counts=True)
                yield packed(names.take(pa.array(found)), np.column_stack([before[at], TAIL + k[at + 1]])[of], 2 * n)
                at = every[k[every + 1] == OTHERS]
                found, n = np.unique(x[at] * len(names) + x[at + 1], return_counts=True)
                yield out(len(found), word=names.take(pa.array(found // len(names))), other=names.take(pa.array(found % len(names))), n=n)
        for start in range(0, len(hot_others), SENT):
            own = beside[start * 2 * TAIL : (start + SENT) * 2 * TAIL].reshape(-1, 2 * TAIL)
            sizes = own.sum(axis=1)
            seen = np.flatnonzero(sizes)
            yield packed(hot.take(pa.array(hot_others[start + seen])), np.repeat(np.tile(np.arange(2 * TAIL), len(own)), own.ravel()), sizes[seen])
        at = np.flatnonzero(table)
        yield out(len(at), cell=at, n=table[at])

    return written(places.mapInArrow(tidy(run), "word string, other string, cells binary, cell long, n long"))


def _lift(pairs: np.ndarray) -> np.ndarray:
    """How much likelier than by chance one class follows another, as a logarithm."""
    p = pairs + 0.5
    return np.log(p * p.sum() / (p.sum(axis=1, keepdims=True) * p.sum(axis=0)))


def joined_to_classes(beside: DataFrame, pairs: np.ndarray) -> DataFrame:
    """(word, c, class, cell), written for good: every word of ``beside`` (word, cells), its count and the class whose transitions
    ``pairs`` explain the classes on both its sides best (TAIL + class), OTHERS for words seen once; and without a word, how
    often (c) a cell is beside the words of each such class.

    None of these words is frequent, so a task takes all rows of a word, one after the other, and holds one word's counts.
    """
    lift = _lift(pairs)
    by_cell = np.concatenate([lift[:, :CLASSES], lift.T[:, :CLASSES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        moved = np.zeros((CLASSES, 2 * TAIL), np.int64)
        last, held = None, np.zeros(2 * TAIL, np.int64)

        def told(words: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
            c, best = counts[:, :TAIL].sum(axis=1), (counts @ by_cell).argmax(axis=1)
            np.add.at(moved, best[c > 1], counts[c > 1])
            return pa.RecordBatch.from_arrays([words, pa.array(c), pa.array(np.where(c > 1, TAIL + best, OTHERS)), pa.nulls(len(c), pa.int64())], ["word", "c", "class", "cell"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words, cells = batch.column(0), batch.column(1)
            new = np.ones(len(words), bool)
            new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
            run_of = np.cumsum(new) - 1
            sizes = pc.binary_length(cells).to_numpy()
            every = np.frombuffer(b"".join(cells.to_pylist()), np.uint8)
            counts = np.bincount(np.repeat(run_of, sizes) * 2 * TAIL + every, minlength=(run_of[-1] + 1) * 2 * TAIL).reshape(-1, 2 * TAIL)
            words = words.filter(pa.array(new))
            if last is not None and last == words[0].as_py():
                counts[0] += held
            elif last is not None:
                yield told(pa.array([last], pa.string()), held[None])
            last, held = words[-1].as_py(), counts[-1].copy()
            yield told(words[:-1], counts[:-1])
        if last is not None:
            yield told(pa.array([last], pa.string()), held[None])
        class_, cell = np.nonzero(moved)
        yield pa.RecordBatch.from_arrays([pa.nulls(len(cell), pa.string()), pa.array(moved[class_, cell]), pa.array(TAIL + class_), pa.array(cell)], ["word", "c", "class", "cell"])

    return written(beside.repartition("word").sortWithinPartitions("word").mapInArrow(tidy(run), "word string, c long, class long, cell long"), lasting=True)


@dataclass
class Model:
    """n, v: training tokens and distinct ones; ends: texts among them; index: the hot words' places; log-probabilities are
    decimal; mass: the tokens of each class; tail (word, c, class): all words beyond CLASSED."""

    n: int
    v: int
    ends: int
    index: dict[bytes, int]
    base: np.ndarray
    where: np.ndarray
    emission: np.ndarray
    transition: np.ndarray
    mass: np.ndarray
    rare_total: float
    tail: DataFrame


def fit(training: DataFrame) -> Model:
    """The model of ``training`` (text)."""
    with scratch(training.sparkSession):
        return _fit(training)


def _fit(training: DataFrame) -> Model:
    modest_batches(training.sparkSession)
    counts = word_counts(training)
    n, v = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    top = most_frequent(counts.filter(F.col("word") != END), HOT)
    index = dict(zip(map(str.encode, top["word"]), range(len(top))))
    hot_counts = top["c"].to_numpy(float)
    core, classed = min(CORE, len(top)), min(CLASSED, len(top))
    spark = training.sparkSession
    shared = spark.sparkContext.broadcast(index)
    ends = counts.filter(F.col("word") == END).first()

    limit = len(top)
    places = coded(training, shared, limit)
    size = core + 2

    def core_bigrams(ids: np.ndarray) -> np.ndarray:
        x = np.where(ids > limit, core + 1, np.minimum(ids, core))
        return np.concatenate([[core + 1], x[:-1]]) * size + x

    core_pairs = _summed(places, size * size, core_bigrams).reshape(size, size)
    where = np.full(limit + 2, OTHERS, np.int64)
    where[-1] = STOP
    core_classes = exchange(core_pairs)
    where[:core] = core_classes[:core]
    if classed > core:
        member = np.eye(TAIL)[core_classes]
        lift = _lift(member.T @ core_pairs @ member)
        left, right, _ = beside_classed(places, where, classed)
        where[core:classed] = (left[core:] @ lift[:, :CLASSES] + right[core:] @ lift.T[:, :CLASSES]).argmax(axis=1)
        for _ in range(WIDE_TURNS):
            where[:classed] = exchanged_widely(where[:classed], *beside_classed(places, where, classed))

    beside = neighbours(places, shared, where)
    pairs = np.zeros((TOTAL, TOTAL))
    for r in beside.filter("word is null").groupBy("cell").agg(F.sum("n").alias("n")).collect():  # TAIL^2 rows at most
        pairs[divmod(r.cell, TAIL)] = r.n
    told = joined_to_classes(beside.filter("cells is not null").select("word", "cells"), pairs[:TAIL, :TAIL])
    tail = told.filter("word is not null")
    known = tail.filter(F.col("class") != OTHERS).select("word", "class")
    # transitions from and to words that now have a class
    for r in told.filter("word is null").groupBy("class", "cell").agg(F.sum("c").alias("n")).collect():
        k = r.cell % TAIL
        if k != OTHERS:
            old, new = ((k, OTHERS), (k, r["class"])) if r.cell < TAIL else ((OTHERS, k), (r["class"], k))
            pairs[old] -= r.n
            pairs[new] += r.n
    follow = beside.filter("other is not null").join(known.withColumnRenamed("class", "a"), "word", "left")
    follow = follow.join(known.select(F.col("word").alias("other"), F.col("class").alias("b")), "other", "left")
    for r in follow.groupBy("a", "b").agg(F.sum("n").alias("n")).collect():
        pairs[OTHERS, OTHERS] -= r.n
        pairs[OTHERS if r.a is None else r.a, OTHERS if r.b is None else r.b] += r.n
    if len(top) > classed:  # the hot ones among them, as a frequent word is hot by its count alone
        for r in tail.filter((F.col("c") >= int(hot_counts[-1])) & (F.col("class") != OTHERS)).select("word", "class").collect():
            where[index[r.word.encode()]] = r["class"]

    where = where[:-1]
    of_class = pairs.sum(axis=0)
    share = (of_class + 1) / (of_class.sum() + TOTAL)
    transition = np.log10((pairs + BETA * share) / (pairs.sum(axis=1, keepdims=True) + BETA))
    rare_total = float(of_class[OTHERS] + (tail.filter(F.col("class") == OTHERS).count() if n else 0) + 1)
    emission = np.where(where[:-1] == OTHERS, np.log10((hot_counts + 1) / rare_total), np.log10(hot_counts / np.maximum(of_class[where[:-1]], 1e-9)))
    base = np.log10((hot_counts + 1) / (n + v + 1))
    return Model(n, v, ends.c if ends else 0, index, base, where, emission, transition, of_class, rare_total, tail.select("word", "c", "class"))


def scored(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of ``docs`` (doc_id, text).

    A null or empty text is its end alone. Repeated rows give repeated results; a null doc_id is never held out. Without
    training texts every word is unknown. An empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.index, model.base, model.where, model.emission, model.transition))
    end_count = model.ends
    end_base = math.log10((end_count + 1) / (model.n + model.v + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, base, where, emission, transition = shared.value
        limit, get = len(base), index.get
        # transitions of words that aren't hot are added later
        where = np.append(where[:-1], [TOTAL, STOP])
        transition = np.pad(transition, (0, 1))
        base, emission = np.append(base, [0.0, 0.0]), np.append(emission, [0.0, 0.0])

        def out(names: pa.Array, ids: list[np.ndarray], cold: list[bytes]) -> pa.RecordBatch:
            x, sizes = np.concatenate(ids), np.array([len(i) for i in ids])
            starts = np.cumsum(sizes) - sizes
            k = where[x]
            before = np.concatenate([[STOP], k[:-1]])
            known = np.add.reduceat((x < limit).astype(np.int64), starts) + (end_count > 0)
            columns = (sizes, known, np.add.reduceat(base[x], starts) + end_base, np.add.reduceat(emission[x] + transition[before, k], starts))
            # what is beside words that aren't hot: a class before (cell), one after (TOTAL + cell), or another such word
            words = _strings(cold).dictionary_encode()
            w, most = words.indices.to_numpy(), max(1, len(words.dictionary))
            at = np.flatnonzero(x == limit)
            left, right = before[at], k[at + 1]
            doc = np.repeat(np.arange(len(ids)), sizes)[at]
            key = (doc * most + w) * (2 * TOTAL + most)
            after = np.where(right == TOTAL, 2 * TOTAL + np.append(w[1:], 0), TOTAL + right) if len(at) else right
            found, times = np.unique(np.concatenate([(key + left)[left != TOTAL], key + after]), return_counts=True)
            (of, w), cell = np.divmod(found // (2 * TOTAL + most), most), found % (2 * TOTAL + most)
            two = cell >= 2 * TOTAL
            fields = [words.dictionary.take(pa.array(w)), words.dictionary.take(pa.array(cell - 2 * TOTAL, mask=~two)), pa.array(cell, mask=two), pa.array(times)]
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(of, minlength=len(ids)))]), pa.int32())
            edges = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(fields, ["word", "other", "cell", "times"]))
            return pa.RecordBatch.from_arrays([names, *map(pa.array, columns), edges], ["doc_id", "n_tokens", "hot_known", "hot_base", "hot_score", "rare"])

        for batch in batches:
            ids: list[np.ndarray] = []
            cold: list[bytes] = []
            start = held = 0
            for end, text in enumerate(batch.column(1), 1):
                x, without = _placed(words_of(text), get, limit)
                ids.append(x)
                cold += without
                held += len(x)
                if len(ids) == TEXTS or held >= TEXT_WORDS or end == batch.num_rows:
                    yield out(batch.column(0).slice(start, len(ids)), ids, cold)
                    ids, cold, start, held = [], [], end, 0

    schema = "doc_id long, n_tokens long, hot_known long, hot_base double, hot_score double, rare array<struct<word: string, other: string, cell: long, times: long>>"
    rows = saved(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(tidy(run), schema).withColumn("row", F.monotonically_increasing_id()))
    # a word that isn't hot is on few rows, so the joins' keys are even
    found = rows.select("row", F.inline("rare")).join(model.tail, "word", "left")
    found = found.withColumns({"c": F.coalesce("c", F.lit(0)), "class": F.coalesce("class", F.lit(OTHERS))})
    cell = F.col("cell")
    one = found.filter("other is null").select(
        "row",
        "times",
        F.when(cell < TOTAL, cell * TOTAL + F.col("class")).otherwise(F.col("class") * TOTAL + cell - TOTAL).alias("edge"),
        F.when(cell < TOTAL, F.col("c")).alias("c"),
    )
    # the word before another one that isn't hot gives its class alone, the other its class and count
    two = found.filter("other is not null").select("row", "times", "other", F.col("class").alias("before"))
    two = two.join(model.tail.withColumnRenamed("word", "other"), "other", "left")
    two = two.select("row", "times", (F.col("before") * TOTAL + F.coalesce("class", F.lit(OTHERS))).alias("edge"), F.coalesce("c", F.lit(0)).alias("c"))
    table = [(i * TOTAL + j, float(model.transition[i, j]), j, float(max(model.mass[j], 1e-9))) for i in range(TOTAL) for j in range(TOTAL)]
    edges = one.unionByName(two).join(F.broadcast(spark.createDataFrame(table, "edge long, step double, to long, mass double")), "edge")
    said = F.when(F.col("to") == OTHERS, F.log10((F.col("c") + 1) / F.lit(model.rare_total))).otherwise(F.log10(F.col("c") / F.col("mass")))
    sums = edges.groupBy("row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"),
        F.coalesce(F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(model.n + model.v + 1)))), F.lit(0.0)).alias("base"),
        F.sum(F.col("times") * (F.col("step") + F.coalesce(said, F.lit(0.0)))).alias("score"),
    )
    plus = lambda a, b: F.col(a) + F.coalesce(b, F.lit(0))
    return rows.join(sums, "row", "left").select(
        "doc_id",
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        "n_tokens",
        plus("hot_known", "known").alias("n_known"),
        F.lit(model.n).cast("long").alias("train_tokens"),
        plus("hot_base", "base").alias("base_score"),
        plus("hot_score", "score").alias("score"),
    )
