"""The pipeline's stages against plain versions, each on what its predecessor kept."""

import sys
from collections import Counter
from pathlib import Path

import brute
import duckdb
import pytest
from oracle import rows_of, rows_of_sql

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))
import corpus_pipeline  # noqa: E402
from frond.llm import quality, queries  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_agrees_with_sql(spark, name):
    assert rows_of(queries.QUERIES[name](spark, FOLDER)) == rows_of_sql(queries.ORACLES[name], FOLDER)


def test_stages(spark, tmp_path):
    docs, seen = spark.read.parquet(f"{FOLDER}/documents.parquet"), {}
    first = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, FOLDER).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert name == "token_ids" or docs.columns == first
        seen[name] = docs.collect()
    read = {r[0]: r[1] for r in duckdb.sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet'").fetchall()}
    good = {r.doc_id for r in seen["quality_rules"]}
    assert all(not brute.quality(read[i])[5] for i in good) and len(good) > 0.6 * len(read)
    texts = [(r.doc_id, r.text) for r in seen["quality_rules"]]
    assert sorted(r.doc_id for r in seen["exact_duplicates"]) == sorted(i for i, v in brute.exact(texts).items() if v[2])
    texts = [(r.doc_id, r.text) for r in seen["exact_duplicates"]]
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(i for i, v in brute.near(texts).items() if v[2])
    words = lambda rows: Counter([s for r in rows for s in [r.source] * len(brute.WORD.findall(r.text))])
    have, mixed = words(seen["near_duplicates"]), words(seen["source_mix"])
    longest = {s: max(len(brute.WORD.findall(r.text)) for r in seen["near_duplicates"] if r.source == s) for s in have}
    assert all(abs(mixed[s] - t) <= longest[s] for s, t in brute.water(dict(have)).items())
    assert Counter(r.doc_id for r in seen["token_ids"]) == Counter(r.doc_id for r in seen["source_mix"]) and all(len(r.token_ids) == r.n_tokens for r in seen["token_ids"])
    assert max(Counter(r.doc_id for r in seen["source_mix"]).values()) <= 2


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"] and out.count() > 0
    assert quality.THRESHOLD == -0.1
