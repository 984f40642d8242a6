"""What tasks of the language model send: neighbours of hot words once, and scores that don't depend on how texts are batched."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frond.llm import brown


def test_a_task_sends_the_neighbours_of_a_hot_word_once(spark, monkeypatch):
    monkeypatch.setattr(brown, "ROWS", 1)
    monkeypatch.setattr(brown, "ROW_WORDS", 4)
    docs = spark.createDataFrame([("a x b x",), ("x a z",)] * 5, "text string").coalesce(1)
    shared = spark.sparkContext.broadcast({b"a": 0, b"b": 1, b"x": 2})
    where = np.array([0, 1, brown.OTHERS, brown.OTHERS, brown.STOP])
    rows = brown.neighbours(brown.coded(docs, shared, 3), shared, where).filter("cells is not null").collect()
    assert Counter(r.word for r in rows)["x"] == 1
    cells = {w: Counter(c for r in rows if r.word == w for c in r.cells) for w in ("x", "z")}
    ahead, stop = brown.TAIL, brown.STOP
    assert cells["x"] == dict.fromkeys([0, 1, stop, ahead, ahead + 1, ahead + stop], 5)
    assert cells["z"] == {0: 5, ahead + stop: 5}


def test_scores_do_not_depend_on_batches(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 20)
    monkeypatch.setattr(brown, "CLASSED", 40)
    monkeypatch.setattr(brown, "HOT", 60)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(60)
    docs = docs.unionByName(spark.createDataFrame([(-1, None), (-2, "never-a never-b never-a")], docs.schema)).coalesce(1)
    model = brown.fit(docs.filter("doc_id % 3 > 0"))
    told = lambda: {r.doc_id: (r.n_tokens, r.n_known, pytest.approx(r.base_score, rel=1e-12), pytest.approx(r.score, rel=1e-12)) for r in brown.scored(docs, model, F.lit(False)).collect()}
    want = told()
    monkeypatch.setattr(brown, "TEXTS", 7)
    monkeypatch.setattr(brown, "TEXT_WORDS", 300)
    assert {k: (v[0], v[1], v[2].expected, v[3].expected) for k, v in told().items()} == want and len(want) > 50
