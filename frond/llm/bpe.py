"""Byte-pair encoding and decoding with a given vocabulary.

A word's merges are found in a contiguous rank array: the array holds the start of every part and, beside it, the rank
of the merge of that part with the next. The least rank is looked for by a scan, the boundary it spans is deleted, and
the two ranks beside it are worked out again. Words are short, so the scans stay in a few cache lines; words over
``SCAN_LIMIT`` symbols go through a heap instead, which gives the same merges without a quadratic cost.

Rows are independent: Spark deals out the documents, no shuffle is needed, and each Python worker keeps a bounded
cache of the chunks that it met. The vocabulary file is read on the workers by path.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from frond.llm.common import modest_batches, of_stage, tidy

#: Symbols up to which a word is merged by scanning its rank array.
SCAN_LIMIT = 96
#: Chunks that a worker keeps in each of its two cache generations, and the longest chunk that is kept.
CACHE_ENTRIES, CACHE_CHARS = 200_000, 64
WORD_ENTRIES = 120_000

#: White space of the vocabulary's own patterns (fixed values: the Unicode White_Space property).
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Ranges of the letters and digits that Unicode 16.0 added, and the capitals among the additions with their small letters
#: (fixed values). The vocabulary's library knows these and nothing newer; Python's own tables may be older or newer.
_UNICODE_16 = (
    "\u1c89-\u1c8a\ua7cb-\ua7cd\ua7da-\ua7dc\U000105c0-\U000105f3\U00010d40-\U00010d65\U00010d6f-\U00010d85\U00010ec2-\U00010ec4\U00011380-\U00011389"
    "\U0001138b\U0001138e\U00011390-\U000113b5\U000113b7\U000113d1\U000113d3\U000116d0-\U000116e3\U00011bc0-\U00011be0\U00011bf0-\U00011bf9"
    "\U00013460-\U000143fa\U00016100-\U0001611d\U00016130-\U00016139\U00016d40-\U00016d6c\U00016d70-\U00016d79\U00018cff\U0001ccf0-\U0001ccf9"
    "\U0001e5d0-\U0001e5ed\U0001e5f0-\U0001e5fa"
)
_SMALL = {0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_SMALL |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 27 for c in range(0x16EA0, 0x16EB9)}
_CHUNK = re.compile(f"[^{_SPACE}]+")
_NONE = 1 << 60


def _byte_alphabet() -> list[str]:
    """Printable stand-ins for the 256 bytes: bytes that print stand for themselves, the others follow from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


@lru_cache(maxsize=1)
def _newer() -> re.Pattern:
    """Letters and digits of ``regex`` that Unicode 16.0 hasn't."""
    known = re.compile(f"[{_UNICODE_16}]")
    every = "".join(map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x110000)]))
    found = [c for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn" and not known.match(c)]
    return re.compile("[" + "".join(found) + "]") if found else re.compile(r"(?!)")


class Cache(dict):
    """A dictionary that makes what it lacks and forgets its older half when it is full."""

    def __init__(self, make, entries: int = CACHE_ENTRIES, longest: int = CACHE_CHARS):
        super().__init__()
        self.make, self.entries, self.longest, self.older = make, entries, longest, {}

    def __missing__(self, key: str):
        value = self.older.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > self.longest:
                return value
        if len(self) >= self.entries:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class Bpe:
    """Encoder and decoder for a ``tokenizers`` file of the kind: NFC, lower case, words by a pattern, bytes, word ends."""

    def __init__(self, path: str, chunks: int = CACHE_ENTRIES, words: int = WORD_ENTRIES):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {(a, b): i for i, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])}
        # the first look at a word only joins single symbols: their pairs by the joined text, the last with its ending
        self.pairs = {a + b: i for (a, b), i in self.ranks.items() if len(a) == 1 and len(b.removesuffix(self.suffix)) == 1}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = {str(i): t for t, i in (self.ids | self.special).items()}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"\s", _SPACE)
        self.words = regex.compile(pattern)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.bytes = _byte_alphabet()
        self.chunks, self.of_word = Cache(self._chunk, chunks), Cache(self._word, words)

    def merged(self, word: str) -> list[str]:
        """The parts of a word of byte stand-ins, after all merges."""
        text = word + self.suffix
        if len(word) > SCAN_LIMIT:
            return self._merged_by_heap(text, len(word))
        ranks = self.ranks
        n, pair = len(word), self.pairs.get
        starts = [*range(n), len(text)]
        adjacent = [pair(text[i : i + 2], _NONE) for i in range(n - 2)]
        if n > 1:
            adjacent.append(pair(text[n - 2 :], _NONE))
        while adjacent:
            least = min(adjacent)
            if least == _NONE:
                break
            i = adjacent.index(least)
            del starts[i + 1], adjacent[i]
            if i < len(adjacent):
                adjacent[i] = ranks.get((text[starts[i] : starts[i + 1]], text[starts[i + 1] : starts[i + 2]]), _NONE)
            if i:
                adjacent[i - 1] = ranks.get((text[starts[i - 1] : starts[i]], text[starts[i] : starts[i + 1]]), _NONE)
        return [text[a:b] for a, b in zip(starts, starts[1:])]

    def _merged_by_heap(self, text: str, n: int) -> list[str]:
        """The same merges for a long word: a heap of (rank, start) over a linked list of starts."""
        ends = {i: i + 1 for i in range(n - 1)} | {n - 1: len(text)}
        before = {i: i - 1 for i in range(n)}
        heap: list[tuple[int, int, int, int]] = []

        def offer(a: int) -> None:
            b = ends[a]
            if b in ends and (rank := self.ranks.get((text[a:b], text[b : ends[b]]))) is not None:
                heapq.heappush(heap, (rank, a, b, ends[b]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, a, b, end = heapq.heappop(heap)
            if ends.get(a) != b or ends.get(b) != end:  # one of the two has been merged since
                continue
            ends[a] = end
            del ends[b]
            if end in before:
                before[end] = a
            offer(a)
            if a:
                offer(before[a])
        return [text[a : ends[a]] for a in sorted(ends)]

    def _word(self, word: str) -> str:
        """The ids of a word of the pattern, as text."""
        parts = self.merged("".join([self.bytes[b] for b in word.encode()]))
        return " ".join([str(self.ids[p]) for p in parts])

    def _chunk(self, chunk: str) -> str:
        """The ids of what stands between two spaces, as text."""
        out: list[str] = []
        for piece in self.split.split(chunk) if "<|" in chunk else (chunk,):
            if piece in self.special:
                out.append(str(self.special[piece]))
            else:
                low = unicodedata.normalize("NFC", piece).replace("Σ", "σ").lower()
                shape = low
                if not low.isascii() and max(low) > "ԯ":
                    low = low.translate(_SMALL)
                    shape = _newer().sub("☃", low)  # to the library a sign like any other
                out += [self.of_word[low[m.start() : m.end()]] for m in self.words.finditer(shape)]
        return " ".join(out)

    def encode(self, text: str | None) -> str:
        """The ids of a whole text in decimal, joined by one space; null is empty."""
        found = _CHUNK.findall(text or "")
        chunks = self.chunks
        return " ".join([x for c in found if (x := chunks[c])])

    def decode(self, ids: str) -> str:
        """The text of such ids: their tokens joined by one space, special tokens kept, word ends as the vocabulary has them."""
        return " ".join(map(self.tokens.__getitem__, ids.split(" "))) if ids else ""


def bpe(path: str, chunks: int = CACHE_ENTRIES) -> Bpe:
    """One encoder for each worker process, stage and file."""
    return of_stage(("bpe", path, chunks), lambda: Bpe(path, chunks, max(1, chunks * WORD_ENTRIES // CACHE_ENTRIES)))


def encode(docs: DataFrame, path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """Add a column of token ids (array<int>) to any table. Null and empty texts give empty arrays."""

    @F.pandas_udf("array<int>")
    def run(texts):
        model = bpe(path)
        return texts.map(lambda t: [int(x) for x in model.encode(t).split(" ") if x])

    return docs.withColumn(ids, run(F.col(text)))


def decode(docs: DataFrame, path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """Add a column with the text of a column of token ids. A null array gives an empty text."""

    @F.pandas_udf("string")
    def run(arrays):
        model = bpe(path)
        return arrays.map(lambda a: model.decode(" ".join(map(str, a)) if a is not None else ""))

    return docs.withColumn(text, run(F.col(ids)))


def round_trip(docs: DataFrame, path: str, with_ids: bool = False, chunks: int = CACHE_ENTRIES) -> DataFrame:
    """Encode every text, decode the ids, and return doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids, if asked for).

    Both ways run in one pass over the rows, so ids and decoded texts need not leave the worker. A null or empty text has
    no tokens and the digests of the empty string; repeated rows give repeated results; other columns are ignored.
    ``chunks`` bounds what a worker keeps of what it has encoded.
    """
    modest_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(path, chunks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):  # a few MB of ids at a time
                part = batch.slice(at, 500)
                counts, ids_hex, text_hex, arrays = [], [], [], []
                for text in part.column(1).to_pylist():
                    ids = model.encode(text)
                    counts.append(ids.count(" ") + 1 if ids else 0)
                    ids_hex.append(hashlib.sha256(ids.encode()).hexdigest())
                    text_hex.append(hashlib.sha256(model.decode(ids).encode()).hexdigest())
                    if with_ids:
                        arrays.append([int(x) for x in ids.split(" ") if x])
                columns = [part.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    columns.append(pa.array(arrays, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)
