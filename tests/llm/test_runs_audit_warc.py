"""Periodic runs, filter audit and archives against plain versions and SQL, on small tables with odd rows."""

import hashlib
import io
import random
import re
import zlib
from itertools import permutations

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import rows_of, rows_of_sql
from pyspark.sql import functions as F

from frond.llm import audit, periodic, queries, warc

SMALL = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_runs(words):
    """(start, length, period) of every run, place by place."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        j = 0
        while j < len(words) - q:
            start = j
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            if j > start and j - start + q >= max(12, 2 * q):
                found.setdefault((start, j - start + q), q)
            j += 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapsed(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def plant(doc_id, words):
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("ab"), max_size=60), max_size=6))
def test_runs_of_words_are_those_found_place_by_place(texts):
    texts.sort(key=len)
    got = periodic.runs_of(texts)
    assert [[tuple(r) for r in own.tolist()] for own in got] == [plain_runs(t) for t in texts]
    assert [periodic.collapsed(t, r) for t, r in zip(texts, got)] == [plain_collapsed(t, plain_runs(t)) for t in texts]


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 1000), st.integers(1, 40), st.integers(2, 9))
def test_a_planted_period_is_found(seed, period, times):
    deal = random.Random(seed)
    cycle = [f"w{i}" for i in range(period)]
    words = [f"x{deal.random()}" for _ in range(30)] + (cycle * times) + [f"y{deal.random()}" for _ in range(30)]
    runs = [tuple(r) for r in periodic.runs_of([words])[0].tolist()]
    assert runs == ([(30, period * times, period)] if period * times >= 12 else [])


def test_ranges_of_lags_cover_every_lag_once(monkeypatch):
    monkeypatch.setattr(periodic, "RANGE", 1000)
    monkeypatch.setattr(periodic, "RANGE_LAGS", 3)
    for n in (2, 3, 100, 1001):
        lags = [q for a, b in periodic.lag_ranges(n) for q in range(a, b + 1)]
        assert lags == list(range(1, n // 2 + 1))


ODD = [None, "", " \t\n", "one", "a " * 11, "a " * 12, "a b " * 6, "x " + "a b c " * 5 + "a y", "Ünï 한국 " * 9, "w " * 3000, " ".join(f"v{i % 700}" for i in range(2500))]
DOCS = "doc_id long, text string, lang string, key string, copies long, size string, part string"


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "k", 3, "s", "p") for i, t in enumerate(ODD)] + [(None, "a b " * 9, None, None, None, None, None)] * 2 + [(5, "a " * 12, "en", "k", 3, "s", "p")]
    return spark.createDataFrame(rows, DOCS)


@pytest.mark.parametrize("long_chars", [periodic.LONG_CHARS, 30])
def test_runs_of_odd_rows_short_and_in_ranges(spark, odd, long_chars, monkeypatch):
    want = []
    for r in odd.collect():
        words = WORD.findall(r.text or "")
        runs = plain_runs(words)
        want.append((r.doc_id, len(words), runs, plain_collapsed(words, runs)))
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.runs(odd, long_chars).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.runs(odd.limit(0), long_chars).isEmpty()


def test_op11_against_brute_force(spark):
    rows = {r.doc_id: r for r in queries.op11_periodic(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(rows) == len(docs)
    met = 0
    for d in docs:
        words = plant(d.doc_id, WORD.findall(d.text or ""))
        runs = plain_runs(words)
        met += bool(runs)
        s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        r = rows[d.doc_id]
        assert (r.n_words, r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(words), len(runs), s, n, q, n and 1000 * n // q)
        assert r.runs_sha256 == sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)) and r.collapsed_sha256 == sha(plain_collapsed(words, runs))
    assert met > 10


# Filters.


def plain_audit(docs, labels):
    failing, good, toxic, first = [], {}, {}, {}
    for i, q, t in labels:
        if i is not None:
            good[i], toxic[i] = good.get(i, False) or q == 1, toxic.get(i, False) or t == 1
    for i, text, _ in docs:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    for i, text, lang in docs:
        x = text or ""
        w = WORD.findall(x)
        f = {
            "A": len(w) < 200,
            "B": 100 * len(set(w)) < 50 * len(w),
            "C": 100 * sum("A" <= c <= "Z" for c in x) > 3 * len(x),
            "D": any(c in "#$%&*|" for c in x),
            "E": i is not None and first[x] < i,
        }
        failing.append((lang or "", f, good.get(i, False), toxic.get(i, False)))
    out = {}
    for part in {f[0] for f in failing}:
        own = [f for f in failing if f[0] == part]
        for order in permutations("ABCDE"):
            left = own
            for step, name in enumerate(order, 1):
                here = [f for f in left if f[1][name]]
                left = [f for f in left if not f[1][name]]
                fails = [f for f in own if f[1][name]]
                only = [f for f in fails if sum(f[1].values()) == 1]
                out[part, "".join(order), step] = [len(left), len(here), len(fails) - len(here), len(only), sum(f[2] for f in here), sum(f[3] for f in here)]
        shapley = {n: sum(v[1] for (p, o, s), v in out.items() if p == part and o[s - 1] == n) for n in "ABCDE"}
        for (p, o, s), v in out.items():
            if p == part:
                v.append(shapley[o[s - 1]])
    return out


def audited(df):
    return {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley] for r in df.collect()}


def test_op12_agrees_with_sql_and_with_plain_replay(spark):
    got = queries.op12_audit(spark, SMALL)
    assert rows_of(got) == rows_of_sql(queries.OP12_SQL, SMALL)
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(got) == plain_audit(docs, labels)


def test_audit_of_odd_rows(spark, odd, monkeypatch):
    words = " ".join(f"w{i}" for i in range(250))
    more = [(20, words, "en"), (21, words, "fr"), (None, words, "fr"), (None, words, "fr"), (22, words + " $", ""), (20, words, "en"), (23, "A" * 40 + words, None), (24, "", "en"), (25, None, "en")]
    docs = odd.select("doc_id", "text", "lang", "key", "part").unionByName(spark.createDataFrame([(*m, "k", "p") for m in more], "doc_id long, text string, lang string, key string, part string"))
    labels = [(20, 1, 0), (20, 0, 1), (21, None, None), (None, 1, 1), (24, 1, 1)]
    table = spark.createDataFrame([(*r, "x") for r in labels], "doc_id long, quality int, toxic int, part string")
    want = plain_audit([(r.doc_id, r.text, r.lang) for r in docs.collect()], labels)
    assert audited(audit.replay(audit.flags(docs, table))) == want
    assert len(want) == 600 * 3
    monkeypatch.setattr(audit, "small", lambda df: False)  # as with very many copied texts
    assert audited(audit.replay(audit.flags(docs, table))) == want
    assert audited(audit.replay(audit.flags(docs, table.limit(0)))).keys() == want.keys()
    assert audit.replay(audit.flags(docs.limit(0), table)).isEmpty()


# Archives.

PAGES = "page_id long, url string, html string, payload string, record_type string, key string, path string"


@pytest.fixture(scope="module")
def pages(spark):
    big = "<p>gleich \r\n\r\n WARC/1.1</p>" * 60
    html = [(1, big), (7, big), (3, big), (7, big), (None, big), (4, "small"), (5, "small"), (6, None), (8, ""), (9, "é" * 500), (10, "é" * 500), (11, "é" * 499), (12, "x" * 999), (13, "x" * 999), (14, "z" * 700_000), (None, "n" * 2000), (None, "n" * 2000)]
    return spark.createDataFrame([(i, None if i == 4 else f"http://a.example/{i}?q=a b\r\n", h, "p", "t", "k", "q") for i, h in html], PAGES)


def told(r):
    return (r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)


def plain_archive(rows):
    out = []
    for i, h in rows:
        data = (h or "").encode()
        same = [j for j, g in rows if g == h and j is not None]
        revisit = len(data) >= 1000 and same and (i is None or i < max(same))
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", max(same) if revisit else None))
    return sorted(out, key=str)


def test_op13_agrees_with_sql(spark):
    assert rows_of(queries.op13_warc(spark, SMALL)) == rows_of_sql(queries.OP13_SQL, SMALL)


@pytest.mark.parametrize("frame, bundle", [(warc.FRAME, warc.BUNDLE), (700, 900)])
def test_archives_of_odd_pages_read_back(spark, pages, tmp_path, frame, bundle):
    at = str(tmp_path / "a")
    warc.write(pages, at, frame=frame, bundle=bundle)
    rows = [(r.page_id, r.html) for r in pages.collect()]
    back = warc.read(spark, at)
    assert sorted(map(told, back.collect()), key=str) == plain_archive(rows)
    whole = [(r.page_id, bytes(r.payload).decode()) for r in warc.resolved(back).collect()]
    assert sorted(whole, key=str) == sorted(((i, h or "") for i, h in rows), key=str)
    urls = {r.page_id: r.url for r in back.collect()}
    assert urls[4] is None and urls[5] == "http://a.example/5?q=a%20b%0D%0A"


def test_any_tool_unpacks_a_bundle_and_a_place_leads_to_its_record(spark, pages, tmp_path):
    at = str(tmp_path / "b")
    warc.write(pages.coalesce(1), at, frame=3000, bundle=1 << 20)
    (file,) = (tmp_path / "b").glob("part-*")
    data = file.read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert plain.count(b"WARC-Record-ID: ") == pages.count() and plain.startswith(b"WARC/1.1\r\n")
    table = warc.seek_table(data)
    assert sum(x[2] for x in table) == len(plain) and len(table) > 3 and table[-1][2] == 0
    for place in warc.index(spark, at).collect():
        alone = zstandard.ZstdDecompressor().decompress(data[place.frame_start : place.frame_start + place.frame_bytes])
        record, end = warc.parsed(alone, place.offset)
        assert record["page_id"] == place.page_id and end == place.offset + place.length


def test_fetch_by_identifier(spark, pages, tmp_path):
    at = str(tmp_path / "c")
    warc.write(pages, at, frame=2000, bundle=4000)
    ids = spark.createDataFrame([(7,), (14,), (14,), (99,), (None,), (6,)], "page_id long")
    got = sorted((r.page_id, len(r.payload)) for r in warc.fetch(spark, at, ids).collect())
    size = len(("<p>gleich \r\n\r\n WARC/1.1</p>" * 60).encode())
    assert got == [(6, 0), (7, size), (7, size), (14, 700_000)]


def test_damage_is_an_error(spark, pages, tmp_path):
    at = str(tmp_path / "d")
    warc.write(pages.coalesce(1), at)
    (file,) = (tmp_path / "d").glob("part-*")
    data = bytearray(file.read_bytes())
    table = warc.seek_table(bytes(data))
    record = warc.record(1, "u", b"abc", hashlib.sha1(b"abd").hexdigest(), None)
    with pytest.raises(ValueError, match="damaged"):
        warc.parsed(record)
    data[table[0][0] + 30] ^= 1
    with pytest.raises((ValueError, zstandard.ZstdError)):
        warc.unpacked(bytes(data), table[0])
    with pytest.raises(ValueError, match="no seek table"):
        warc.seek_table(bytes(data[:-1]))


def test_an_archive_of_no_pages(spark, pages, tmp_path):
    at = str(tmp_path / "e")
    warc.write(pages.limit(0), at)
    assert warc.read(spark, at).isEmpty() and warc.index(spark, at).isEmpty()


def test_many_revisits_of_one_page(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "small", lambda df: False)  # the way without a broadcast of all groups
    rows = spark.range(3000).select(F.col("id").alias("page_id"), F.lit("http://h").alias("url"), F.when(F.col("id") % 3 > 0, F.lit("c" * 1200)).otherwise(F.repeat(F.col("id").cast("string"), 300)).alias("html"))
    at = str(tmp_path / "f")
    warc.write(rows, at)
    assert sorted(map(told, warc.read(spark, at, payload=False).collect()), key=str) == plain_archive([(r.page_id, r.html) for r in rows.collect()])
    assert np.isin([r.refers_to for r in warc.read(spark, at).filter("record_type = 'revisit'").collect()], [2999]).all()
