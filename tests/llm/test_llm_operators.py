"""The ten operators against plain versions, on small tables with odd rows: nulls, empty and long texts, ties, repetitions."""

import math
import random
import re
from collections import Counter, defaultdict

import brute
import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from frond.llm import bpe, brown, chat, exact_dedup, line_dedup, minhash, mixing, pii, quality, queries, toxicity
from frond.llm.bpe import Bpe

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size long, kept boolean, hash string"  # with names that clash
LONG = " ".join(f"w{i % 977} x{i}" for i in range(20_000))
ODD = [
    None,
    "",
    " \t\n",
    "one",
    "One  two\nthree four five six",
    "one two three four five six",
    "Ünï 'code' <|endoftext|> don't ½ 한국어 😀 é é",
    "a" * 3000,
    LONG,
    LONG + " end",
    "call +1 (212) 555-0199 or a.b@mail.example.com 10.0.0.1 and 4111 1111 1111 1111",
    "same line\nsame line\n\nsame line " * 12,
]


@pytest.fixture(scope="module")
def documents(spark):
    d = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text", "source").collect()
    rows = [(r.doc_id, r.text, "en", r.source, 0, 5, False, "h") for r in d]
    return spark.createDataFrame(rows + [(10_000 + i, t, None, None if i % 3 else f"s{i % 2}", None, None, None, None) for i, t in enumerate(ODD)], DOCS)


@pytest.fixture(scope="module")
def rows(documents):
    return [(r.doc_id, r.text) for r in documents.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SMALL}/labels.parquet")


def test_bpe_equals_the_tokenizers_library(spark, documents, rows, empty):
    t = Tokenizer.from_file(VOCABULARY)
    t.no_truncation()
    t.no_padding()
    got = {r.doc_id: r for r in bpe.round_trip(documents, VOCABULARY, with_ids=True).collect()}
    for i, text in rows:
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert got[i].token_ids == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == brute.sha(" ".join(map(str, ids))) and got[i].decoded_sha256 == brute.sha(t.decode(ids, skip_special_tokens=False))
    assert bpe.round_trip(empty, VOCABULARY).count() == 0
    some = documents.filter("doc_id >= 10000")
    both = bpe.decode(bpe.encode(some, VOCABULARY), VOCABULARY).collect()
    assert {r.doc_id: brute.sha(r.decoded) for r in both} == {i: got[i].decoded_sha256 for i, _ in rows if i >= 10_000}


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text("ab'ΣçI 1<|endoftxsr>", max_size=200))
def test_bpe_on_any_text(text):
    model, t = bpe.bpe(VOCABULARY), Tokenizer.from_file(VOCABULARY) if not hasattr(test_bpe_on_any_text, "t") else test_bpe_on_any_text.t
    test_bpe_on_any_text.t = t
    ids = t.encode(text, add_special_tokens=False).ids
    assert model.encode(text) == " ".join(map(str, ids)) and model.decode(model.encode(text)) == t.decode(ids, skip_special_tokens=False)


def test_bpe_scan_and_heap_agree():
    model, rnd = Bpe(VOCABULARY), random.Random(4)
    for _ in range(300):
        word = "".join(rnd.choice("abcdeinrt") for _ in range(rnd.randint(1, 90)))
        assert model.merged(word) == model._merged_by_heap(word + model.suffix, len(word))


def test_mixing_reaches_its_targets(spark, documents, empty):
    got = mixing.shares(documents).collect()
    source = {r.doc_id: r.source for r in documents.collect()}
    sizes, taken, target = Counter(), Counter(), {}
    for r in got:
        sizes[source[r.doc_id]] += r.size
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
        assert 0 <= r.taken <= 2 * r.size
    want = brute.water(dict(sizes))
    assert {s: pytest.approx(t) for s, t in want.items()} == target
    assert all(abs(taken[s] - t) <= 1 for s, t in want.items())
    assert {(r.doc_id, r.taken) for r in mixing.shares(documents.repartition(5)).collect()} == {(r.doc_id, r.taken) for r in got}
    assert mixing.shares(empty).count() == 0 and mixing.mixed(empty).count() == 0
    mix = mixing.mixed(documents)
    assert mix.columns == documents.columns
    whole = Counter()
    for r in mix.select("source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(mixing.WORD)).alias("w")).collect():
        whole[r.source] += r.w
    most = {s: max(r.size for r in got if source[r.doc_id] == s) for s in want}
    assert all(abs(whole[s] - t) <= most[s] for s, t in want.items())


def test_mixing_without_words(spark):
    none = spark.createDataFrame([(1, None, None), (1, "", "a"), (None, " ", "a")], "doc_id long, text string, source string")
    assert [(r.size, r.target, r.taken) for r in mixing.shares(none).collect()] == [(0, 0.0, 0)] * 3


CHAT = "conv_id long, turn long, role string, text string, kind string, example long"


def test_chat_reads_back_what_it_wrote(spark, tmp_path):
    turns = [("user", "\\<s>[INST]\\\\"), ("assistant", "</s>\\"), ("assistant", None), (None, "[/ROLE]<\\s>"), ("to[/ROLE]ol\n", "x\ny"), ("user", "tail")]
    odd = [(1, i, r, x) for i, (r, x) in enumerate(turns)] + [(2, i, ("user", "assistant")[i % 2], "w" * 3000 + str(i)) for i in range(60)]
    odd += [(None, 1, "system", "only"), (3, 0, "user", "a"), (3, 0, "user", "a"), (3, 0, "assistant", "b"), (4, None, "user", ""), (5, 1, "assistant", "x" * 100_000), (5, 2, "assistant", "y")]
    real = [tuple(r) for r in spark.read.parquet(f"{SMALL}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows = odd + [(c + 100, *rest) for c, *rest in real]
    want = brute.conversations([(c, -1 if t is None else t, r, x) for c, t, r, x in rows])
    df = spark.createDataFrame([(*r, "k", 1) for r in rows], CHAT)
    made = chat.examples(df)
    for found in (chat.read_back(made, sorted_rows=True), chat.read_back(made)):
        assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in found.collect()} == want
    assert made.filter("kind = 'example'").count() == sum(r == "assistant" for _, _, r, _ in rows)
    assert made.filter("kind = 'example'").select("conv_id", "target_turn", "text", F.expr("substring(text, loss_start + 1, loss_end - loss_start)").alias("reply")).count() > 0
    assert chat.read_back(made).filter("n_damaged > 0").isEmpty()
    assert chat.read_back(chat.examples(df.limit(0))).count() == 0


def test_chat_examples_hold_the_whole_context(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(4)]
    got = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    assert [(r.target_turn, r.text[r.loss_start : r.loss_end]) for r in got] == [(1, "t1"), (3, "t3")]
    assert got[1].text == "[INST]user[/ROLE]t0[/INST]<s>t1</s>[INST]user[/ROLE]t2[/INST]<s>t3</s>"


def test_chat_expands_long_conversations_whole(spark):
    """Against the expansion by definition, over conversations far above any batch."""
    said = {7: [("user" if i % 3 else "assistant", f"{i}:" + "x" * 9000) for i in range(40)], 8: [("user", "y" * 50_000), ("assistant", "z" * 70_000), ("tool", "t")]}
    rows = [(c, i, r, x) for c, turns in said.items() for i, (r, x) in enumerate(turns)]
    turn = lambda r, x: f"<s>{x}</s>" if r == "assistant" else f"[INST]{r}[/ROLE]{x}[/INST]"
    want = {(c, i): "".join(turn(*t) for t in turns[: i + 1]) for c, turns in said.items() for i, (r, _) in enumerate(turns) if r == "assistant"}
    made = chat.examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    got = {(r.conv_id, r.target_turn): r for r in made.filter("kind = 'example'").collect()}
    assert {k: r.text for k, r in got.items()} == want
    assert all(r.text[r.loss_start : r.loss_end] == said[c][i][1] for (c, i), r in got.items())
    broken = made.withColumn("text", F.when((F.col("conv_id") == 7) & (F.col("example") == 2), F.replace("text", F.lit("0:x"), F.lit("0:y"))).otherwise(F.col("text")))
    assert {r.conv_id: r.n_damaged for r in chat.read_back(broken).collect()} == {7: 2, 8: 0}  # itself, and the next, which doesn't begin with it


def test_chat_query_adds_its_own_conversation(spark):
    own = queries.op3_chat(spark, SMALL).filter("conv_id = -1").first()
    text = "</s>[INST] ok [/INST]"
    assert (own.n_turns, own.loss_chars, own.loss_sha256) == (2, len(text), brute.sha(text))


def test_exact_dedup(spark, documents, rows, empty):
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decisions(documents).collect()}
    assert got == brute.exact(rows)
    assert exact_dedup.decisions(empty).count() == 0
    kept = exact_dedup.deduplicated(documents)
    assert kept.columns == documents.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in got.items() if v[2])


def test_exact_dedup_looks_behind_a_hash(spark, documents, rows):
    weak = lambda norm: F.substring(F.md5(norm), 1, 1)  # noqa: E731  sixteen hashes for all texts
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decisions(documents, weak).collect()}
    assert got == brute.exact(rows)


def test_exact_dedup_without_broadcasts(spark, documents, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "small", lambda df: False)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup.decisions(documents).collect()}
    assert got == brute.exact(rows)


def test_exact_dedup_repeated_rows_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "ab"), (2, "c"), (None, "c "), (1, "other")], "doc_id long, text string")
    got = [(str(r.doc_id), r.keep_id, r.group_size, r.kept) for r in exact_dedup.decisions(df).collect()]
    assert Counter(g[3] for g in got) == {True: 3, False: 3} and ("2", None, 2, False) in got
    assert sorted(str((r.doc_id, r.text)) for r in exact_dedup.deduplicated(df).collect()) == ["(1, 'a b')", "(1, 'other')", "(None, 'c ')"]


def test_stages_keep_the_very_row_and_any_column(spark):
    schema = "doc_id long, text string, _mark string, _again boolean, _quality string, key string, doc string, row long, stays boolean"
    long = "one two three four five six seven"
    rows = [(1, "ab", "m", True, "q", "k", "d", 1, None), (1, "a  b", None, None, None, None, None, 2, True), (2, long, "x", *[None] * 6), (2, long, "x", *[None] * 6), (None, long, "n", *[None] * 6), (None, None, *[None] * 7)]
    df = spark.createDataFrame(rows, schema)
    kept = exact_dedup.deduplicated(df)
    assert kept.columns == df.columns and Counter(map(tuple, kept.collect())) == Counter([rows[1], rows[2], rows[5]])
    near = minhash.deduplicated(df)
    assert near.columns == df.columns and Counter(map(tuple, near.collect())) == Counter([rows[0], rows[1], rows[2], rows[5]])
    good = quality.kept(df.withColumn("text", F.concat_ws(" ", *[F.lit(f"w{i}") for i in range(30)])), spark.createDataFrame([(99, 1)], "doc_id long, quality int"))
    assert good.columns == df.columns and good.count() == len(rows)
    assert mixing.mixed(df.withColumn("source", F.lit("s"))).columns == [*df.columns, "source"]
    for stage in (exact_dedup.deduplicated, minhash.deduplicated):
        assert stage(df.limit(0)).count() == 0 and stage(df.limit(0)).columns == df.columns


def test_toxicity_learns_and_holds_out(spark):
    got = queries.op5_toxicity(spark, "/root/testdata/sf0.01")
    rows = got.join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("held_out").collect()
    assert got.count() == 1000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    assert all(r.held_out == (brute.crc(r.doc_id) % 3 == 1) for r in rows)
    pos, neg = [r.score for r in rows if r.toxic], [r.score for r in rows if not r.toxic]
    assert sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / len(pos) / len(neg) > 0.85


def test_toxicity_takes_every_telling_unit(spark):
    """The log-odds of a small sample by brute force: all units beyond both thresholds are in the model, and no others."""
    words = [f"vile{i:02d}" for i in range(30)]
    texts = [(" ".join(words[i % 3 :: 3]) + " plain words here", 1, False) for i in range(60)] + [(f"plain words here and tale {i % 7}", 0, False) for i in range(90)]
    model = toxicity.fit(spark.createDataFrame(texts, "text string, toxic int, curve boolean").repartition(3))
    found = {label: [{u for w in text.split() for u in toxicity.units(w)} for text, toxic, _ in texts if toxic == label] for label in (1, 0)}
    n1, n0, expected = len(found[1]), len(found[0]), {}
    for unit in set().union(*found[1], *found[0]):
        a, b = sum(unit in x for x in found[1]), sum(unit in x for x in found[0])
        table = [(a, n1, a + b), (b, n0, a + b), (n1 - a, n1, n1 + n0 - a - b), (n0 - b, n0, n1 + n0 - a - b)]
        root = math.sqrt(max(0.0, 2 * sum(o * math.log(o * (n1 + n0) / (n * m)) for o, n, m in table if o)))
        odds = math.log((a + toxicity.PRIOR) / (n1 - a + toxicity.PRIOR)) - math.log((b + toxicity.PRIOR) / (n0 - b + toxicity.PRIOR))
        if root >= toxicity.LEAST_ROOT and odds >= toxicity.LEAST_ODDS:
            expected[unit] = min(odds, toxicity.MOST_ODDS)
    assert len(expected) >= 30 and model.odds == pytest.approx(expected)


def test_toxicity_on_odd_texts(spark, documents, empty, labels):
    model = toxicity.fit(toxicity.sampled(documents, labels, F.lit(True)))
    again = toxicity.fit(toxicity.sampled(documents, labels.filter("false"), F.lit(True)))
    for m in (model, again):
        assert toxicity.scored(documents, m).filter("score between 0 and 1").count() == documents.count() and toxicity.scored(empty, m).count() == 0


def segments_by_definition(scores):
    def find(a, b):
        best, total = None, 0
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 0 and (best is None or total > best[0] + 1e-12):
                    best = (total, i, j + 1)
        return [] if best is None else find(a, best[1]) + [best[1:]] + find(best[2], b)

    return find(0, len(scores))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.floats(-4, 4).map(lambda x: round(x, 3)), max_size=14), st.integers(0, 10**6))
def test_maximal_segments(scores, seed):
    rnd = random.Random(seed)
    scores = [s + rnd.random() * 1e-4 for s in scores]  # no ties
    assert [x[1:] for x in toxicity.segments(scores)] == segments_by_definition(scores)


def test_quality_measures(spark, documents, rows, empty, labels):
    got = {r.doc_id: r for r in quality.verdicts(documents, labels).collect()}
    for i, text in rows:
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.quality(text)
        assert r.kept == (not r.base_failed and r.ratio >= quality.THRESHOLD)
    kept = quality.kept(documents, labels)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.kept}
    assert quality.verdicts(empty, labels).count() == 0
    assert quality.verdicts(documents, labels.filter("false")).filter("ratio <> 0").isEmpty()


def test_quality_keeps_the_good_and_drops_the_bad(spark):
    v = queries.op6_quality(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").filter("not base_failed")
    share = {r.quality: r.k for r in v.groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert share[1] > 0.98 and share[0] < 0.15


def test_near_duplicates(spark, documents, rows, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(documents).collect()}
    assert got == brute.near(rows)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicated(documents)
    assert kept.columns == documents.columns and {r.doc_id for r in kept.collect()} == {i for i, v in got.items() if v[2]}


def test_near_duplicates_in_chains_and_crowds(spark):
    rnd = random.Random(9)
    base = [f"w{i}" for i in range(200)]
    rows, n = [], 0
    for start in range(0, 60, 2):  # a chain: neighbours are alike, its ends are not
        rows.append((n, " ".join(f"w{i}" for i in range(start, start + 60))))
        n += 1
    for _ in range(80):  # a crowd around one text, some within reach of each other only
        words = list(base)
        for _ in range(rnd.choice((1, 3, 5, 6))):
            words[rnd.randrange(200)] = f"x{rnd.randrange(10**6)}"
        rows.append((n, " ".join(words)))
        n += 1
    rows += [(n, rows[40][1]), (n + 1, rows[40][1].upper())]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df).collect()} == brute.near(rows)


def test_near_duplicates_null_ids_and_repeated_rows(spark):
    t = "one two three four five six seven"
    df = spark.createDataFrame([(None, t), (3, t), (3, t), (2, t + " eight"), (None, "other words"), (7, None)], "doc_id long, text string")
    got = sorted(str((r.doc_id, r.component_id, r.kept)) for r in minhash.near_duplicates(df).collect())
    assert got == sorted(map(str, [(None, 2, False), (3, 2, False), (3, 2, False), (2, 2, True), (None, None, True), (7, 7, True)]))


def test_personal_data(spark, documents, rows, empty):
    weights = pii.train(documents)
    got = {r.doc_id: r for r in pii.found(documents, weights).collect()}
    for i, text in rows:
        want = brute.private(text)
        n = Counter(k for _, k, _ in want)
        text_of = ",".join(f"{k}:{a}:{b}" for a, k, b in want)
        r = got[i]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(n[k] for k in brute.KINDS) and r.base_sha256 == brute.sha(text_of)
        assert set(filter(None, text_of.split(","))) <= set(r.spans.split(","))
    assert pii.train(empty) is None and pii.found(empty, None).count() == 0
    masked = pii.masked(documents.filter("doc_id = 10010"), weights).first().text
    assert masked == "call <phone> or <email> <ip> and <card>"


@settings(max_examples=400, deadline=None)
@given(st.text("a@.-+ 0123456789(1.25b)\né", max_size=60))
def test_personal_data_patterns(text):
    assert pii.base_spans(text)[0] == brute.private(text)


def test_reliabilities_tell_good_labelers_from_bad():
    rng = np.random.default_rng(3)
    truth = rng.random(4000) < 0.4
    right = (0.95, 0.9, 0.85, 0.8, 0.5)
    votes = np.stack([np.where(rng.random(4000) < a, truth, ~truth) * 2 for a in right], 1)
    keys, n = np.unique(np.concatenate([np.zeros((4000, 1), int), votes, np.zeros((4000, 1), int)], 1), axis=0, return_counts=True)
    p, table = pii.reliabilities(keys, n.astype(float))
    assert all(abs(table[j, 1, 2] - a) < 0.06 for j, a in enumerate(right))
    weights = pii.classifier(keys, n.astype(float), p)
    q = 1 / (1 + np.exp(-pii._features(keys) @ weights))
    assert ((q > 0.5) == (p > 0.5))[np.abs(p - 0.5) > 0.2].all()


def test_language_scores(spark, documents, rows, empty, monkeypatch):
    for hot, classed, core in ((200_000, 20_000, 1024), (300, 100, 40)):
        monkeypatch.setattr(brown, "HOT", hot)
        monkeypatch.setattr(brown, "CLASSED", classed)
        monkeypatch.setattr(brown, "CORE", core)
        held = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
        model = brown.fit(documents.filter(~held))
        got = {r.doc_id: r for r in brown.scored(documents, model, held).collect()}
        for i, want in brute.language(rows).items():
            r = got[i]
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == want[:4] and r.base_score == pytest.approx(want[4], rel=1e-9)
        assert brown.scored(empty, model, held).count() == 0
        # class transitions, and words within their classes, are distributions
        assert np.allclose((10**model.transition).sum(axis=1), 1)
        inside = np.zeros(brown.CLASSES)
        np.add.at(inside, model.where[:-1][model.where[:-1] < brown.CLASSES], 10 ** model.emission[model.where[:-1] < brown.CLASSES])
        assert np.allclose(inside[inside > 0], 1)
    assert brown.scored(documents, brown.fit(empty), held).filter("n_known > 0").isEmpty()


def test_language_model_beats_its_base(spark):
    r = queries.op9_brown(spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1] + 0.02 * abs(r[1])


def test_exchange_finds_planted_classes():
    rng = np.random.default_rng(2)
    n = 24
    group = np.arange(n) % 3
    bigrams = np.zeros((n + 2, n + 2))
    for _ in range(20_000):
        a = rng.integers(n)
        b = rng.choice(np.flatnonzero(group == (group[a] + 1) % 3))
        bigrams[a, b] += 1
    where = brown.exchange(bigrams, 3, 30)
    assert all(len(set(where[:n][group == g])) == 1 for g in range(3)) and len(set(where[:n])) == 3


PAGES = "page_id long, url string, html string, host string, keys string, n long"


def test_line_dedup(spark):
    rows = [(i, f"https://Site.example:80/p{i}", f"<p>menu</p><p>own {i}</p>menu<br>", "x", None, 1) for i in range(8)]
    rows += [(20, "http://lone.example/a", "menu<br>text", None, None, None), (21, None, "menu\nmenu", None, None, None), (22, "https://site.example/q", None, None, None, None)]
    rows += [(23, "https://site.example/r", "", None, None, None), (0, "https://Site.example:80/p0", "<p>menu</p><p>own 0</p>menu<br>", "x", None, 1)]
    df = spark.createDataFrame(rows, PAGES)
    got = defaultdict(list)
    for r in line_dedup.cleaned(df).collect():
        got[r.page_id].append((r.host, r.n_lines, r.n_dropped, r.text))
    assert got[0] == [("site.example", 3, 2, "own 0")] * 2 and got[5] == [("site.example", 3, 2, "own 5")]
    assert got[20] == [("lone.example", 2, 0, "menu\ntext")] and got[21] == [("", 2, 0, "menu\nmenu")] and got[22] == got[23] == [("site.example", 0, 0, "")]
    assert line_dedup.cleaned(df.limit(0)).count() == 0


def test_line_dedup_on_tags_by_the_pattern(spark):
    """Against the pattern that defines tags, and over pages on which that pattern would be quadratic."""
    pages = ["a<b>c\nd", "x>y<z>w", "<<a>b", "a<b", "<a\nb>c", "a>b>c<", "", None, " \x0b x \t\n\r y", ">" * 50, "<>" * 5, "k<a<b>c>d<e"]
    want = [[x for line in re.sub("<[^>]*>", "\n", p or "").split("\n") if (x := line.strip(" \t\n\x0b\f\r"))] for p in pages]
    long = ["<" * 300_000 + "x", "a" + " " * 300_000 + "b", "<b>" * 100_000]
    df = spark.createDataFrame(list(enumerate(pages + long)), "i long, h string")
    got = [r.lines for r in df.orderBy("i").select(line_dedup.lines_of(F.col("h")).alias("lines")).collect()]
    assert got == want + [[long[0]], [long[1]], []]


def test_line_dedup_joins_beyond_the_broadcast(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    want = sorted(map(tuple, line_dedup.cleaned(pages).collect()))
    monkeypatch.setattr(line_dedup, "BROADCAST_KEYS", -1)
    assert sorted(map(tuple, line_dedup.cleaned(pages).collect())) == want
