"""WARC archives as seekable Zstandard bundles.

A bundle is one file: independent Zstandard frames of about FRAME bytes that hold whole records, a skippable frame with the
record map (which record lies in which frame, from where, how long), and the seek table of the seekable format in a last
skippable frame. Any Zstandard tool unpacks a bundle to plain WARC; a reader that knows a record's place unpacks one frame.

Of records with equal payloads of LEAST bytes and more the one with the largest page_id is a response, the others are
revisits that refer to it and carry no payload.

Bundles reach the file system through Spark's text writer, one row a file, whose line separator is the seek table's last
byte: so any store that Spark can write to will do, its commit protocol applies, and a lost task leaves no half file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from frond.llm.common import join_small_or_shuffled, left_join_hot, modest_batches, salted_join, saved, small, tidy

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Bytes of records in a frame before it is closed, and of frames in a bundle; a larger record has a frame of its own.
FRAME, BUNDLE = 1 << 18, 8 << 20
LEVEL = 3
#: Bytes of records that a reader hands on at once.
READ = 4 << 20

# Fixed values of the formats.
SKIPPABLE_MAP, SKIPPABLE_SEEK, SEEKABLE, CHECKSUMS = 0x184D2A50, 0x184D2A5E, 0x8F92EAB1, 0x80
LAST_BYTE = "\u008f"
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_PLACE = np.dtype([("id", "<i8"), ("known", "u1"), ("frame", "<u4"), ("offset", "<u4"), ("length", "<u4")])
_CONTROL = re.compile(r"[\x00-\x20\x7f]")
RECORD = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"
PLACES = "path string, page_id long, frame int, frame_start long, frame_bytes long, offset long, length long"


def _payload(html: Column) -> Column:
    return F.coalesce(html, F.lit("")).cast("binary")


def decided(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, payload_digest (SHA-1), record_type and refers_to for every row of ``pages`` (page_id, url, html).

    Payloads are equal if their SHA-256 is. A null html is empty. A null page_id comes before all others. Rows repeated with
    the largest page_id are all responses. Only payloads of repeated digests can be revisits, so others meet no join of
    their own partition; a digest that holds a large share of all pages isn't shuffled.
    """
    payload = _payload(F.col("html"))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    large = F.octet_length("payload") >= least
    keyed = rows.filter(large).withColumn("key", F.unhex(F.sha2("payload", 256)))
    groups = saved(keyed.groupBy("key").agg(F.count("*").alias("copies"), F.max("page_id").alias("target")).filter("copies > 1"))
    if small(groups):
        met = keyed.join(F.broadcast(groups), "key", "left")
    else:
        met = left_join_hot(keyed, groups, "key", "copies", keyed.count())
    revisit = F.col("target").isNotNull() & F.coalesce(F.col("page_id") < F.col("target"), F.lit(True))
    found = met.select("page_id", "url", "payload", F.when(revisit, F.col("target")).alias("refers_to"))
    alone = rows.filter(~large).withColumn("refers_to", F.lit(None).cast("long"))
    kind = F.when(F.isnull("refers_to"), "response").otherwise("revisit")
    return found.unionByName(alone).select("page_id", "url", "payload", F.sha1("payload").alias("payload_digest"), kind.alias("record_type"), "refers_to")


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _id(name: bytes | None) -> int | None:
    found = re.fullmatch(rb"<urn:page:(-?\d+)>", name or b"")
    return int(found[1]) if found else None


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A WARC record. Control characters and blanks in the URL are percent-encoded; a null URL leaves its header out."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    heads = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if url is not None:
        heads.append(("WARC-Target-URI", _CONTROL.sub(lambda c: quote(c[0]), url)))
    if revisit:
        heads += [("WARC-Refers-To", _name(refers_to)), ("WARC-Profile", PROFILE)]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in heads).encode() + b"\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at ``at`` as a dict of RECORD, and where it ends. A payload that isn't what its digest says is an error."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].split(b"\r\n")
    if version != b"WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    heads = dict(line.split(b": ", 1) for line in lines)
    start, size = end + 4, int(heads[b"Content-Length"])
    body = data.index(b"\r\n\r\n", start) + 4
    stated = int(re.search(rb"\r\nContent-Length: (\d+)", data[start:body])[1])
    digest = base64.b32decode(heads[b"WARC-Payload-Digest"].removeprefix(b"sha1:")).hex()
    revisit = heads[b"WARC-Type"] == b"revisit"
    payload = None if revisit else data[body : start + size]
    if payload is not None and (len(payload) != stated or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"the payload of {heads[b'WARC-Record-ID']!r} is damaged")
    url = heads.get(b"WARC-Target-URI")
    return {
        "page_id": _id(heads[b"WARC-Record-ID"]),
        "url": None if url is None else url.decode(),
        "record_type": "revisit" if revisit else "response",
        "refers_to": _id(heads.get(b"WARC-Refers-To")),
        "payload_digest": digest,
        "payload_bytes": stated,
        "payload": payload,
    }, start + size + 4


class Bundle:
    """One file as it grows: frames, their seek table, and the places of its records."""

    def __init__(self, level: int = LEVEL):
        self.packer = zstandard.ZstdCompressor(level=level)
        self.frames: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.places: list[tuple[int, int, int, int, int]] = []
        self.open = bytearray()
        self.size = 0

    def add(self, page_id: int | None, data: bytes, frame: int) -> None:
        self.places.append((page_id or 0, page_id is not None, len(self.frames), len(self.open), len(data)))
        self.open += data
        if len(self.open) >= frame:
            self.close()

    def close(self) -> None:
        if self.open:
            whole = bytes(self.open)
            self._put(self.packer.compress(whole), len(whole), xxhash.xxh64_intdigest(whole) & 0xFFFFFFFF)
            self.open.clear()

    def _put(self, data: bytes, plain: int, check: int) -> None:
        self.frames.append(data)
        self.table.append((len(data), plain, check))
        self.size += len(data)

    def file(self) -> bytes:
        self.close()
        places = np.array(self.places, _PLACE).tobytes()
        self._put(struct.pack("<II", SKIPPABLE_MAP, len(places)) + places, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        seek = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        return b"".join(self.frames) + struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek


def seek_table(data: bytes) -> list[tuple[int, int, int, int]]:
    """(start, bytes, plain bytes, checksum) of each frame of a bundle, by its footer."""
    count, descriptor, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or descriptor != CHECKSUMS:
        raise ValueError("no seek table at the end of the file")
    out, start = [], 0
    for entry in struct.iter_unpack("<III", data[len(data) - 9 - 12 * count : len(data) - 9]):
        out.append((start, *entry))
        start += entry[0]
    return out


def unpacked(data: bytes, frame: tuple[int, int, int, int]) -> bytes:
    """One frame of a bundle, held against its checksum."""
    start, size, plain, check = frame
    whole = zstandard.ZstdDecompressor().decompress(data[start : start + size], max_output_size=plain)
    if len(whole) != plain or xxhash.xxh64_intdigest(whole) & 0xFFFFFFFF != check:
        raise ValueError(f"the frame at {start} is damaged")
    return whole


def record_map(data: bytes, table: list[tuple[int, int, int, int]]) -> np.ndarray:
    """The places of a bundle's records: id, known (0 where the id is null), frame, offset in it, length."""
    start, size = table[-1][:2]
    magic, length = struct.unpack("<II", data[start : start + 8])
    if magic != SKIPPABLE_MAP or length + 8 != size:
        raise ValueError("no record map before the seek table")
    return np.frombuffer(data, _PLACE, length // _PLACE.itemsize, start + 8)


def _packing(frame: int, bundle: int) -> Callable:
    """(page_id, url, payload, payload_digest, refers_to) -> bundles without their last byte, which the writer adds."""

    @tidy
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = Bundle()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([now.file()[:-1]], pa.binary())], ["bundle"])
        for batch in batches:
            for row in zip(*(batch.column(k) for k in range(5))):
                page_id, url, payload, digest, refers_to = (x.as_py() for x in row)
                now.add(page_id, record(page_id, url, payload, digest, refers_to), frame)
                if now.size >= bundle:
                    yield out()
                    now = Bundle()
        if now.places:
            yield out()

    return pack


def write(pages: DataFrame, path: str, least: int = LEAST, frame: int = FRAME, bundle: int = BUNDLE) -> None:
    """Archive every row of ``pages`` (page_id, url, html) in bundles under ``path``, a folder that Spark can write to.

    Odd rows are handled as in ``decided``; pages with one page_id share an identifier and keep a record each. An empty
    table makes a folder without records. Other columns are ignored.
    """
    modest_batches(pages.sparkSession)
    rows = decided(pages, least).select("page_id", "url", "payload", "payload_digest", "refers_to")
    packed = rows.mapInArrow(_packing(frame, bundle), "bundle binary")
    files = packed.select(F.col("bundle").cast("string").alias("value")).write.option("maxRecordsPerFile", 1)
    files.option("lineSep", LAST_BYTE).option("encoding", "ISO-8859-1").text(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")


def _batch(records: list[dict], payload: bool) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload_digest": pa.string(), "payload_bytes": pa.int64()}
    kinds |= {"payload": pa.binary()} if payload else {}
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in records], t) for k, t in kinds.items()], list(kinds))


def _in_batches(records: Iterator[dict], payload: bool) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for r in records:
        held.append(r)
        size += 200 + (len(r["payload"] or b"") if payload else 0)
        if size >= READ:
            yield _batch(held, payload)
            held, size = [], 0
    if held:
        yield _batch(held, payload)


def _reading(payload: bool) -> Callable:
    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records() -> Iterator[dict]:
            for batch in batches:
                for content in batch.column(0):
                    data = content.as_py()
                    for frame in seek_table(data):
                        if frame[2]:
                            whole, at = unpacked(data, frame), 0
                            while at < len(whole):
                                one, at = parsed(whole, at)
                                yield one

        return _in_batches(records(), payload)

    return run


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Every record under ``path``: RECORD, where a revisit's payload is null. Frames are held against their checksums and
    payloads against their digests even where ``payload`` is not asked for; a file that is no bundle is an error."""
    kinds = RECORD if payload else RECORD.removesuffix(", payload binary")
    return _files(spark, path).select("content").mapInArrow(_reading(payload), kinds)


def resolved(records: DataFrame) -> DataFrame:
    """``records`` with the payload of every revisit taken from the response that it refers to, however many refer to one."""
    responses = records.filter("record_type = 'response' and page_id is not null").groupBy("page_id", "payload_digest").agg(F.first("payload").alias("found"))
    revisits = saved(records.filter("record_type = 'revisit'").drop("payload").withColumn("at", F.struct(F.col("refers_to").alias("page_id"), "payload_digest")))
    held = responses.select(F.struct("page_id", "payload_digest").alias("at"), "found")
    met = salted_join(revisits, held, "at", "page_id", revisits.select("at"))
    return records.filter("record_type = 'response'").unionByName(met.drop("at").withColumnRenamed("found", "payload"))


@tidy
def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            data = content.as_py()
            table = seek_table(data)
            places = record_map(data, table)
            frames = np.array([x[:2] for x in table], np.int64)[places["frame"]]
            arrays = [
                pa.array([path.as_py()] * len(places), pa.string()),
                pa.array(places["id"].copy(), pa.int64(), mask=places["known"] == 0),
                pa.array(places["frame"].astype(np.int32)),
                pa.array(frames[:, 0]),
                pa.array(frames[:, 1]),
                pa.array(places["offset"].astype(np.int64)),
                pa.array(places["length"].astype(np.int64)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, [x.split()[0] for x in PLACES.split(", ")])


def index(spark: SparkSession, path: str) -> DataFrame:
    """PLACES: where each record lies, as file, frame (number, first byte, bytes), and offset and length in the unpacked frame."""
    return _files(spark, path).mapInArrow(_index, PLACES)


@tidy
def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[dict]:
        for batch in batches:
            for content, wanted in zip(batch.column(0), batch.column(1)):
                data = content.as_py()
                table, last, whole = seek_table(data), None, b""
                for place in sorted(wanted.as_py(), key=lambda x: (x["frame"], x["offset"])):
                    if place["frame"] != last:
                        last, whole = place["frame"], unpacked(data, table[place["frame"]])
                    yield parsed(whole, place["offset"])[0]

    return _in_batches(records(), True)


def fetch(spark: SparkSession, path: str, ids: DataFrame) -> DataFrame:
    """The records under ``path`` whose page_id is in ``ids`` (page_id), by their places; only the frames that hold them are
    unpacked. Ids that are null, repeated or not there give nothing more."""
    asked = saved(ids.filter("page_id is not null").select("page_id").distinct())
    found = join_small_or_shuffled(index(spark, path), asked, ["page_id"], "left_semi")
    files = saved(found.groupBy("path").agg(F.collect_list(F.struct("frame", "offset")).alias("wanted")))  # a bundle's records at most
    return _files(spark, path).join(files, "path").select("content", "wanted").mapInArrow(_fetch, RECORD)
