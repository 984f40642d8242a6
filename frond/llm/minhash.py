"""Near-duplicate documents by min-max hashing of word shingles, with every link confirmed on the full sets.

A document is the set of its distinct shingles of five words. Under each of ``PERMUTATIONS`` permutations both the
minimum and the maximum of the set are kept, so one evaluation gives two signature values; the values are cut into
``BANDS`` bands of ``ROWS`` and documents that agree in a band meet in a bucket. A pair at the threshold of 0.75 misses
all 80 bands with a probability of 1.6e-7.

Documents with equal sets form a class, and only classes are compared. First each class is compared with the ``HUBS``
classes with which it shares most bands, among those that come first in its buckets, and what is linked grows together.
Then the buckets whose members lie in different components are searched whole, in packs set against each other inside
tasks: a pair of different components is a candidate if ``LIKELY`` bytes of the sketches agree (at 0.75 fewer do with a
probability of 1e-6, at 0.6 as many do with one of 1e-2), and it is looked at in the first bucket that it shares only. A
first pass finds the members that have a candidate at all; these get their full sets, and a second pass confirms the
candidates by intersecting the sets where they lie, growing components together as it goes. So a bucket gives no more rows
than it has members, however many of its pairs are likely, none is capped, and every pair that could join two components
is looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frond.llm.bpe import Cache
from frond.llm.common import WORD_RE, ascii_lower, inner_join_hot, join_small_or_shuffled, left_join_hot, modest_batches, row_key, salted_join, saved, scratch, small, staying, tidy, written

SHINGLE, THRESHOLD = 5, 75
BANDS, ROWS = 80, 6
PERMUTATIONS = BANDS * ROWS // 2
#: Bytes of a sketch, those of them that the first comparison uses, and how many must agree there and over all.
SKETCH, SHORT, ALIKE, LIKELY = 2 * PERMUTATIONS, 128, 64, 314
#: Members of a pack, and the shingles that it holds at most (unless one set has more).
PACK, PACK_SHINGLES = 1024, 2_000_000
#: Classes that each class is first compared with, and the bands that it must share with them. These choose which pairs are
#: looked at first, not which are looked at.
HUBS, HUB_BANDS = 3, 3
#: Word hashes that a task keeps.
KNOWN = 30_000
SEED = 7
#: Shingles whose hashes under all permutations are held at once.
COLUMNS = 2048

_rng = np.random.default_rng(SEED)
_A = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64)
_WORD_MULT = _rng.integers(0, 1 << 63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_MULT = _rng.integers(0, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BAND_SALT = _rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)
_BAND_BITS = np.uint64(127)


def _hash(word: str) -> int:
    return xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))


def _mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of 64 over all others."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | None, known: Cache | None = None) -> np.ndarray:
    """The distinct 64-bit hashes of a text's shingles, sorted. Fewer than five words make one shingle, no words none."""
    known = Cache(_hash) if known is None else known
    words = WORD_RE.findall(ascii_lower(text or ""))
    if not words:
        return np.empty(0, np.uint64)
    h = np.array([known[w] for w in words], np.uint64)
    n = max(1, len(h) - SHINGLE + 1)
    if len(h) < SHINGLE:
        h = np.concatenate([h, np.zeros(SHINGLE - len(h), np.uint64)])
    total = np.full(n, min(len(words), SHINGLE), np.uint64)
    for i in range(SHINGLE):
        total += h[i : i + n] * _WORD_MULT[i]
    return np.unique(_mix(total))


def signature(s: np.ndarray) -> np.ndarray:
    """Minima, then maxima, of a non-empty set under all permutations."""
    low = high = None
    for at in range(0, len(s), COLUMNS):
        x = _A[:, None] * s[None, at : at + COLUMNS]
        x += _B[:, None]
        a, b = x.min(axis=1), x.max(axis=1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate([low, high])


def band_keys(sig: np.ndarray) -> np.ndarray:
    """57 bits of hash for every band, and the band's number in the last seven."""
    bands = sig.reshape(BANDS, ROWS)
    mixed = _mix((bands * _BAND_MULT).sum(axis=1, dtype=np.uint64) + _BAND_SALT)
    return (mixed & ~_BAND_BITS | np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


SIGNED = "key binary, doc_id long, set_id binary, n long, bands array<long>, sketch binary"


@tidy
def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Cache(_hash, KNOWN)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            ids, sizes, bands, sketches = [], [], [], []
            for text in part.column(2).to_pylist():
                s = shingles(text, known)
                sizes.append(len(s))
                if len(s):
                    sig = signature(s)
                    ids.append(_digest(s))
                    bands.append(band_keys(sig))
                    sketches.append(np.ascontiguousarray(sig.reshape(2, -1).T.ravel(), "<u8").view(np.uint8)[4::8].tobytes())
                else:
                    ids.append(None)
                    bands.append(None)
                    sketches.append(None)
            made = (pa.array(ids, pa.binary()), pa.array(sizes, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *made], [x.split()[0] for x in SIGNED.split(", ")])


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cid, text) to (cid, s: the shingles)."""
    known = Cache(_hash, KNOWN)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sets = [shingles(text, known).tobytes() for text in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], ["cid", "s"])


class _Pack:
    """Members of one bucket in parallel arrays; ``earlier`` has 32 bits of their band keys before this bucket's."""

    def __init__(self, cids: pa.Scalar, comps: pa.Scalar, sizes: pa.Scalar, sketches: pa.Scalar, bands: pa.Scalar, sets: pa.Scalar | None, band: int):
        self.cids, self.comps, self.sizes = (x.values.to_numpy(zero_copy_only=False).copy() for x in (cids, comps, sizes))
        self.sketches = np.frombuffer(b"".join(sketches.as_py()), np.uint8).reshape(-1, SKETCH)
        self.short = np.ascontiguousarray(self.sketches[:, :SHORT])
        self.earlier = bands.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS)[:, :band]
        self.sets = None if sets is None else [np.frombuffer(x, np.uint64) for x in sets.as_py()]

    def candidates(self, other: "_Pack", i: int) -> np.ndarray:
        """Places in this pack of what may be linked with member i of the other one, and doesn't meet it in an earlier band."""
        n = other.sizes[i]
        at = np.flatnonzero((self.comps != other.comps[i]) & (np.minimum(self.sizes, n) * 100 >= np.maximum(self.sizes, n) * THRESHOLD))
        if len(at):
            at = at[(self.short[at] == other.short[i]).sum(axis=1) >= ALIKE]
        if len(at):
            at = at[(self.sketches[at] == other.sketches[i]).sum(axis=1) >= LIKELY]
        return at[~(self.earlier[at] == other.earlier[i]).any(axis=1)] if len(at) else at

    def links(self, other: "_Pack", i: int, at: np.ndarray) -> np.ndarray:
        """Those of the candidates whose sets reach the threshold with that of member i of the other pack."""
        mine, sizes = other.sets[i], np.array([len(self.sets[k]) for k in at])
        there = np.concatenate([self.sets[k] for k in at])
        place = np.minimum(np.searchsorted(mine, there), len(mine) - 1)
        both = np.add.reduceat((mine[place] == there).astype(np.int64), np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        return at[100 * both >= THRESHOLD * (len(mine) + sizes - both)]


def _packs(batch: pa.RecordBatch, sets: bool) -> Iterator[tuple[int, _Pack, _Pack]]:
    """The pairs of packs of a batch, one in Python's memory at a time: columns band, then the fields of the first pack and of
    the second, which is null where a pack meets itself."""
    k = 6 if sets else 5
    for row in range(batch.num_rows):
        band, *fields = (c[row] for c in batch.columns)
        band = band.as_py()
        left = _Pack(*fields[:5], fields[5] if sets else None, band)
        yield band, left, _Pack(*fields[k : k + 5], fields[k + 5] if sets else None, band) if fields[k].is_valid else left


@tidy
def _suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of packs to their members (cid, band) that have a candidate in another component."""
    for batch in batches:
        found = set()
        for band, left, right in _packs(batch, False):
            for i in range(len(left.cids)):
                at = right.candidates(left, i)
                if len(at):
                    found.add((int(left.cids[i]), band))
                    found.update((c, band) for c in right.cids[at].tolist())
        rows = sorted(found)
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32())], ["cid", "band"])


@tidy
def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of packs with their sets to links (a, b) that join all components of theirs that have a link."""
    for batch in batches:
        found: list[tuple[int, int]] = []
        for _, left, right in _packs(batch, True):
            for i in range(len(left.cids)):
                at = right.candidates(left, i)
                at = right.links(left, i, at) if len(at) else at
                for k in at.tolist():
                    mine, other = left.comps[i], right.comps[k]
                    if mine != other:  # not joined by a link before
                        found.append((int(left.cids[i]), int(right.cids[k])))
                        left.comps[left.comps == other] = mine
                        right.comps[right.comps == other] = mine
        yield pa.RecordBatch.from_arrays([pa.array([min(p) for p in found], pa.int64()), pa.array([max(p) for p in found], pa.int64())], ["a", "b"])


@tidy
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, set_a, set_b) to the pairs whose sets reach the threshold."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            s, t = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(s, t, assume_unique=True))
            keep.append(100 * both >= THRESHOLD * (len(s) + len(t) - both))
        yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))


def components(links: DataFrame) -> DataFrame:
    """(cid, comp) for every class in a link: comp is the smallest class it is linked with, directly or not; a written table.

    On every turn a class takes the least of its own label, the labels around it and its label's label, so stars take two
    turns and long chains few. The number of labels never changes, so whether they may be broadcast is checked once; beyond
    that the joins are salted, as a hub or a label may be in most rows.
    """
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = written(both.groupBy(F.col("a").alias("cid")).agg(F.least(F.min("a"), F.min("b")).alias("comp")))
    few = small(labels)

    def meet(left: DataFrame, right: DataFrame, key: str, spread: str) -> DataFrame:
        return left.join(F.broadcast(right), key) if few else salted_join(left, right, key, spread)

    while True:
        around = meet(both, labels.withColumnRenamed("cid", "b"), "b", "a").groupBy(F.col("a").alias("cid")).agg(F.min("comp").alias("least"))
        heads = labels.select(F.col("cid").alias("comp"), F.col("comp").alias("head"))  # a label is a class of its component
        own = meet(labels, heads, "comp", "cid")
        turned = written(around.join(F.broadcast(own) if few else own, "cid").select("cid", F.least("comp", "least", "head").alias("comp"), F.col("comp").alias("old")))
        labels = turned.select("cid", "comp")
        if turned.filter(F.col("comp") != F.col("old")).isEmpty():
            return labels


def sets_of(wanted: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(cid, s: the full set) for the classes of ``wanted`` (cid), saved: read from the text of one document of each."""
    keys = saved(wanted.distinct().join(classes, "cid").select("cid", "key"))
    texts = docs.select("key", "text")
    if not small(keys):
        texts = texts.groupBy("key").agg(F.first("text").alias("text"))  # repeated rows give their text once
    found = join_small_or_shuffled(texts, keys, ["key"], "inner").select("cid", "text")
    return saved(found.mapInArrow(_sets, "cid long, s binary").dropDuplicates(["cid"]))


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """The candidate pairs (a, b) of classes that are links, by their full sets; a written table."""
    pairs = written(pairs)
    sets = sets_of(pairs.select(F.col("a").alias("cid")).union(pairs.select("b")), classes, docs)
    told = pairs
    for side, other in (("a", "b"), ("b", "a")):
        told = salted_join(told, sets.select(F.col("cid").alias(side), F.col("s").alias(f"set_{side}")), side, other, pairs)
    return written(told.select("a", "b", "set_a", "set_b").mapInArrow(_linked, "a long, b long"))


def _pairs_of_packs(members: DataFrame, fields: list[str]) -> DataFrame:
    """Every pack of every bucket against itself and each later pack of the bucket, for ``members`` with key, band, packs and
    the fields: band, and the fields as arrays, of the first pack and of the second (null for the pack itself)."""
    pack = F.pmod(F.xxhash64("key", "cid"), F.col("packs"))
    packed = members.withColumn("pack", pack).groupBy("key", "band", "pack", "packs").agg(F.collect_list(F.struct(*fields)).alias("x"))  # PACK members or so
    kinds = {f.name: f.dataType.simpleString() for f in members.schema}
    one = [F.col(f"x.{c}").alias(f"{c}1") for c in fields]
    within = packed.select("band", *one, *[F.lit(None).cast(f"array<{kinds[c]}>").alias(f"{c}2") for c in fields])
    several = packed.filter("packs > 1").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("packs") - 1))).filter("pack < other")
    others = packed.filter("packs > 1").select("key", F.col("pack").alias("other"), *[F.col(f"x.{c}").alias(f"{c}2") for c in fields])
    return within.unionByName(several.join(others, ["key", "other"]).select("band", *one, *[f"{c}2" for c in fields]))


def across_components(buckets: DataFrame, comps: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different components that share a bucket, enough to join all that are linked; written."""
    placed = join_small_or_shuffled(buckets, comps, ["cid"], "left").withColumn("comp", F.coalesce("comp", "cid"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m")).filter("low < high")
    live = inner_join_hot(placed.select("cid", "key", "comp"), saved(mixed.select("key", "m")), "key", "m", buckets.count())
    live = written(live.withColumn("band", F.col("key").bitwiseAND(F.lit(127)).cast("int")))
    fields = ["cid", "comp", "n", "sketch", "half_bands"]
    signed = classes.select("cid", "n", "sketch", F.transform("bands", lambda x: F.shiftright(x, 32).cast("int")).alias("half_bands"))
    told = live.withColumn("packs", F.ceil(F.col("m") / PACK)).join(signed, "cid")
    suspects = written(_pairs_of_packs(told, fields).mapInArrow(_suspects, "cid long, band int").distinct())
    if suspects.isEmpty():
        return suspects.select(F.col("cid").alias("a"), F.col("cid").alias("b"))
    left = written(live.drop("m").join(suspects, ["cid", "band"]).join(classes.select("cid", "n"), "cid"))
    sizes = left.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / PACK), F.ceil(F.sum("n") / PACK_SHINGLES)).alias("packs"), F.count("*").alias("m"))
    told = inner_join_hot(left.drop("n"), saved(sizes), "key", "m", left.count()).join(signed, "cid").join(sets_of(left.select("cid"), classes, docs), "cid")
    return written(_pairs_of_packs(told, [*fields, "s"]).mapInArrow(_across, "a long, b long").distinct())


def class_components(classes: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(cid, comp) of all classes that are linked with others; None where there is no link."""
    members = classes.select("cid", F.explode("bands").alias("key"))
    shared = saved(members.groupBy("key").agg(F.count("*").alias("m"), F.min("cid").alias("first")).filter("m > 1"))
    buckets = saved(inner_join_hot(members, shared, "key", "m", classes.count()))
    # a few comparisons a class, with the classes that come first in most of its buckets; all others are left to the packs
    met = buckets.filter("cid != first").groupBy(F.col("cid").alias("b")).agg(F.collect_list("first").alias("firsts"))  # one for each band at most
    by_bands = F.transform(F.array_distinct("firsts"), lambda x: F.struct(F.size(F.filter("firsts", lambda y: y == x)).alias("bands"), x.alias("a")))
    hubs = F.filter(F.slice(F.sort_array(by_bands, asc=False), 1, HUBS), lambda x: x["bands"] >= HUB_BANDS)
    links = confirmed(met.select(F.explode(F.transform(hubs, lambda x: x["a"])).alias("a"), "b"), classes, docs)
    links = links.unionByName(across_components(buckets, components(links), classes, docs))
    return None if links.isEmpty() else components(links)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept, and key and stays.

    component_id is the smallest doc_id that can be reached over links (100 * intersection >= 75 * union), the row's own
    included; kept says that it is the row's own. Null and empty texts, and texts without words, have no shingles and are
    linked with nothing. A null id is never the smallest; where a group has only null ids its component_id is null and its
    rows are kept. Rows repeated as a whole give repeated results. stays is true for one row of each group, and those
    repeated with it: that with the smallest doc_id (null last), of these the one with the smallest key (a digest of the
    row). An empty table gives an empty result; other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    return _labelled(docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long"), "text"))


def _labelled(docs: DataFrame) -> DataFrame:
    modest_batches(docs.sparkSession)
    signed = saved(docs.mapInArrow(_sign, SIGNED))
    order = F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "key")
    first = F.min_by(F.struct("bands", "sketch", "key"), "key")
    grouped = signed.filter("n > 0").groupBy("set_id").agg(F.count("*").alias("size"), F.min(order).alias("best"), F.max("n").alias("n"), first.alias("first"))
    classes = saved(grouped.select("set_id", "size", "best", "n", "first.*").withColumn("cid", F.monotonically_increasing_id()))
    ids = classes.select("cid", "set_id", "size", "best")
    with scratch(docs.sparkSession):
        comps = class_components(classes, docs)
        if comps is not None:
            least = comps.join(classes.select("cid", "best"), "cid").groupBy("comp").agg(F.min("best").alias("least"), F.count("*").alias("m"))
            of_class = left_join_hot(comps, saved(least), "comp", "m", comps.count()).select("cid", "least")
            ids = ids.join(of_class, "cid", "left").filter("size > 1 or least is not null").withColumn("best", F.coalesce("least", "best"))
        else:
            ids = ids.filter("size > 1")
        ids = saved(ids.select("set_id", "size", "best"))
    found = left_join_hot(signed.select("key", "doc_id", "set_id", "n"), ids, "set_id", "size", signed.count())
    component = F.when(F.isnull("size"), F.col("doc_id")).otherwise(F.col("best.doc_id"))
    return found.withColumn("component_id", component).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("doc_id") == F.col("component_id"), F.isnull("component_id")).alias("kept"),
        "key",
        F.coalesce(F.col("key") == F.col("best.key"), F.lit(True)).alias("stays"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, one for each group of near duplicates, with all their columns.

    Rows without shingles all stay. Rows are told apart by a digest of all their columns; nulls, ties, repeated rows and
    empty tables are handled as ``near_duplicates`` says, and extra columns may have any names.
    """
    labelled = _labelled(docs.select(row_key(docs).alias("key"), F.col("doc_id").cast("long"), "text"))
    return staying(docs, labelled.filter("n_shingles > 0").select("key", "stays"))
