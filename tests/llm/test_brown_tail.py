"""Words beyond the clustered ones have classes, and every word's class counts in transitions and scores."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from frond.llm import brown


def test_every_repeated_word_has_a_class(spark, monkeypatch):
    monkeypatch.setattr(brown, "CORE", 30)
    monkeypatch.setattr(brown, "CLASSED", 80)
    monkeypatch.setattr(brown, "HOT", 150)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    docs = docs.unionByName(spark.createDataFrame([(None, None), (-1, ""), (-2, "never-seen-a never-seen-b the never-seen-a")], docs.schema))
    held = F.coalesce(F.col("doc_id") % 5 == 0, F.lit(False)) | (F.col("doc_id") == -2)
    model = brown.fit(docs.filter(~F.coalesce(held, F.lit(False))))
    rows = [(r.doc_id, re.findall(rb"[^\x20\x09-\x0D]+", (r.text or "").encode().lower()), r.held) for r in docs.withColumn("held", F.coalesce(held, F.lit(False))).collect()]
    count = Counter(w for _, words, h in rows if not h for w in words)
    tail = {r.word.encode(): (r.c, r["class"]) for r in model.tail.collect()}
    classed = {w for w, i in model.index.items() if i < 80}
    assert {w: c for w, (c, _) in tail.items()} == {w: c for w, c in count.items() if w not in classed}
    assert all((k >= brown.TAIL) == (c > 1) for c, k in tail.values()) and len({k for _, k in tail.values()}) > 5
    class_of = {w: k for w, (_, k) in tail.items()} | {w: int(model.where[i]) for w, i in model.index.items() if i < 80}
    assert all(model.where[i] == class_of[w] for w, i in model.index.items())

    pairs = np.zeros((brown.TOTAL, brown.TOTAL))
    for _, words, h in rows:
        k = [brown.STOP, *[class_of.get(w, brown.OTHERS) for w in words], brown.STOP]
        if not h:
            np.add.at(pairs, (k[:-1], k[1:]), 1)
    mass = pairs.sum(axis=0)
    share = (mass + 1) / (mass.sum() + brown.TOTAL)
    step = np.log10((pairs + brown.BETA * share) / (pairs.sum(axis=1, keepdims=True) + brown.BETA))
    assert np.allclose(model.transition, step)
    rare = mass[brown.OTHERS] + sum(k == brown.OTHERS for _, k in tail.values()) + 1

    def said(w):
        k = class_of.get(w, brown.OTHERS)
        return np.log10((count[w] + 1) / rare) if k == brown.OTHERS else np.log10(count[w] / mass[k])

    got = {r.doc_id: r.score for r in brown.scored(docs, model, held).collect()}
    for i, words, _ in rows:
        k = [brown.STOP, *[class_of.get(w, brown.OTHERS) for w in words], brown.STOP]
        assert got[i] == pytest.approx(float(step[k[:-1], k[1:]].sum() + sum(map(said, words))), rel=1e-9)
