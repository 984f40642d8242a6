"""One query for each operator of this subpackage, with production parameters, over whole tables."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frond.llm import audit, bpe, brown, chat, exact_dedup, line_dedup, minhash, mixing, periodic, pii, quality, toxicity, warc
from frond.llm.common import WORD, shared_folder, table


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(table(spark, sf_dir, "documents"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one more (-1) whose turns are made of the template's own control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, i, role, "</s>[INST] ok [/INST]") for i, role in enumerate(("user", "assistant"))], turns.schema)
    return chat.read_back(chat.examples(turns.unionByName(own)), sorted_rows=True)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, sf_dir, "documents")).drop("hash", "row")


OP4_SQL = r"""
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm
  FROM documents
), r AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
  FROM t WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id NULLS LAST)
)
SELECT doc_id, keep_id, group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r
"""

def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 3 == 1
    model = toxicity.fit(toxicity.sampled(docs, table(spark, sf_dir, "labels"), ~held_out))
    return toxicity.scored(docs, model).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", "predicted", "passages")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("key", "stays")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return pii.found(docs, pii.train(docs))


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    model = brown.fit(docs.filter(~F.coalesce(held_out, F.lit(False))))
    return brown.scored(docs, model, held_out)


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    clean = line_dedup.cleaned(table(spark, sf_dir, "pages"))
    return clean.select("page_id", "host", "n_lines", "n_dropped", F.length("text").cast("long").alias("kept_chars"), F.sha2("text", 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, row_number() OVER () AS row,
         lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)', 1)) AS host,
         list_filter(list_transform(
           string_split(regexp_replace(coalesce(html, ''), '<[^>]*>', chr(10), 'g'), chr(10)),
           lambda x: regexp_replace(x, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages
), h AS (SELECT host, count(*) AS n FROM p WHERE host <> '' GROUP BY host
), l AS (SELECT host, line, count(*) AS on_pages FROM (SELECT DISTINCT row, host, unnest(lines) AS line FROM p) GROUP BY host, line
), b AS (SELECT host, list(line) AS lines FROM l JOIN h USING (host) WHERE on_pages >= 3 AND on_pages > 0.3 * n GROUP BY host
), k AS (
  SELECT page_id, p.host, p.lines, CASE WHEN b.lines IS NULL THEN p.lines
         ELSE list_filter(p.lines, lambda x: NOT list_contains(b.lines, x)) END AS stay
  FROM p LEFT JOIN b ON p.host = b.host
)
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(stay) AS n_dropped,
       length(coalesce(array_to_string(stay, chr(10)), '')) AS kept_chars,
       sha256(coalesce(array_to_string(stay, chr(10)), '')) AS kept_sha256
FROM k
"""


def planted(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the size of the text as it was; of a tenth of the documents, told by a digest of the id, the text is
    made to repeat itself from one of its words on, which keeps the number of words. A null doc_id has no digest."""
    docs = docs.select("doc_id", "text", F.length(F.coalesce("text", F.lit(""))).alias("size"))
    h = F.crc32(F.col("doc_id").cast("string"))
    g = F.floor(h / 10).cast("long")
    words = docs.filter(h % 10 == 0).select("doc_id", "size", g.alias("g"), F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0)).alias("w"))
    n = F.size("w")
    a = F.when(n > 0, F.col("g") % n).otherwise(0).cast("int")
    placed = words.select("doc_id", "size", "w", n.alias("n"), a.alias("a"), (F.lit(1) + F.floor((n - a) / (3 + F.col("g") % 8))).cast("int").alias("p"))
    turns = F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")
    cycle = F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), turns))
    text = F.array_join(F.slice(F.concat(F.slice("w", F.lit(1), F.col("a")), cycle), F.lit(1), F.col("n")), " ")
    return placed.select("doc_id", text.alias("text"), "size").unionByName(docs.filter(F.coalesce(h % 10 != 0, F.lit(True))))


def op11_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.runs(planted(table(spark, sf_dir, "documents")), size="size")
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), F.concat(r.period.cast("string"), F.lit("\n")))), "")
    told = found.select("doc_id", "n_words", F.size("runs").cast("long").alias("n_runs"), longest.alias("most"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("most.length"), -F.col("most.period")
    return told.select(
        "doc_id", "n_words", "n_runs", (-F.col("most.start")).alias("start"), length.alias("length"), period.alias("period"),
        F.expr("1000 * most.length div -most.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


def op12_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.replay(audit.flags(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


OP12_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), f AS (
  SELECT doc_id, part, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w),
    100 * length(regexp_replace(x, '[^A-Z]+', '', 'g')) > 3 * length(x), regexp_matches(x, '[#$%&*|]'),
    coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false)] AS fails FROM t
), l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), g AS (
  SELECT part, fails, count(*) AS n, sum(coalesce(good, 0)) AS good, sum(coalesce(toxic, 0)) AS toxic
  FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails
), k AS (SELECT unnest([1, 2, 3, 4, 5]) AS i
), o AS (
  SELECT [a.i, b.i, c.i, d.i, e.i] AS ord FROM k a, k b, k c, k d, k e
  WHERE len(list_distinct([a.i, b.i, c.i, d.i, e.i])) = 5
), m AS (
  SELECT g.*, ord, k.i AS step, coalesce(nullif(list_position(list_transform(ord, lambda i: fails[i]), true), 0), 6) AS first,
         fails[ord[k.i]] AS failing, len(list_filter(fails, lambda z: z)) AS n_fails
  FROM g, o, k
), s AS (
  SELECT part, array_to_string(list_transform(ord, lambda i: 'ABCDE'[i]), '') AS filter_order, step,
         sum(CASE WHEN first > step THEN n ELSE 0 END)::BIGINT AS kept,
         sum(CASE WHEN first = step THEN n ELSE 0 END)::BIGINT AS removed,
         sum(CASE WHEN failing AND first < step THEN n ELSE 0 END)::BIGINT AS redundant,
         sum(CASE WHEN failing AND n_fails = 1 THEN n ELSE 0 END)::BIGINT AS unique_fails,
         sum(CASE WHEN first = step THEN good ELSE 0 END)::BIGINT AS good_lost,
         sum(CASE WHEN first = step THEN toxic ELSE 0 END)::BIGINT AS toxic_lost
  FROM m GROUP BY ALL
)
SELECT *, (sum(removed) OVER (PARTITION BY part, filter_order[step]))::BIGINT AS shapley FROM s
"""


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archives are written to a new folder in the shared one, and read from there."""
    at = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    warc.write(table(spark, sf_dir, "pages"), at)
    return warc.read(spark, at, payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS x FROM pages
), d AS (SELECT page_id, strlen(x) AS payload_bytes, sha1(x) AS payload_digest, CASE WHEN strlen(x) >= 1000 THEN max(page_id) OVER (PARTITION BY x) END AS top FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN top IS NOT NULL AND (page_id IS NULL OR page_id < top) THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS NULL OR page_id < top THEN top END AS refers_to
FROM d
"""

QUERIES = {"op1_bpe": op1_bpe, "op2_mixing": op2_mixing, "op3_chat": op3_chat, "op4_exact_dedup": op4_exact_dedup, "op5_toxicity": op5_toxicity, "op6_quality": op6_quality, "op7_minhash": op7_minhash, "op8_pii": op8_pii, "op9_brown": op9_brown, "op10_line_dedup": op10_line_dedup, "op11_periodic": op11_periodic, "op12_audit": op12_audit, "op13_warc": op13_warc}
ORACLES = {"op4_exact_dedup": OP4_SQL, "op10_line_dedup": OP10_SQL, "op12_audit": OP12_SQL, "op13_warc": OP13_SQL}
