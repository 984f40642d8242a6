"""Queries of scans, projections, joins, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from frond.functions import scalars
from frond.operators import joins, project
from frond.plans.registry import query
from frond.sources import images as image_files
from frond.sources.tables import load, run_summary, split_failures, union_of_keys

MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User and assistant text of each conversation as two views: characters and longest turn."""
    c = load(spark, sf_dir, "conversations")
    views = []
    for role in ("user", "assistant"):
        views.append(c.filter(F.col("role") == role).groupBy("conv_id").agg(F.sum(F.length("text")).cast("double").alias("chars"), F.max(F.length("text")).cast("double").alias("longest")))
    return views[0], views[1]


_VIEW_SQL = """
WITH t AS (SELECT conv_id, sum(length(text))::DOUBLE AS chars, max(length(text))::DOUBLE AS longest FROM conversations WHERE role = 'user' GROUP BY 1),
b AS (SELECT conv_id, sum(length(text))::DOUBLE AS chars, max(length(text))::DOUBLE AS longest FROM conversations WHERE role = 'assistant' GROUP BY 1)
"""


@query(
    "view_fusion",
    _VIEW_SQL
    + """SELECT conv_id, t.chars AS top_chars, t.longest AS top_longest, b.chars AS bottom_chars, b.longest AS bottom_longest,
CASE WHEN b.chars > t.chars THEN b.chars ELSE t.chars END AS worst_chars, CASE WHEN b.longest > t.longest THEN b.longest ELSE t.longest END AS worst_longest
FROM t JOIN b USING (conv_id)""",
)
def view_fusion(spark, sf_dir):
    top, bottom = _views(spark, sf_dir)
    return joins.fused_views(top, bottom, "conv_id", ["chars", "longest"])


@query(
    "unmatched_views",
    """WITH r AS (SELECT conv_id, max((role = 'user')::INT) AS t, max((role = 'assistant')::INT) AS b FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN t = 0 THEN 'top' ELSE 'bottom' END AS missing_view FROM r WHERE t + b = 1""",
)
def unmatched_views(spark, sf_dir):
    c = load(spark, sf_dir, "conversations")
    return joins.unmatched(c.filter("role = 'user'"), c.filter("role = 'assistant'"), "conv_id")


@query(
    "split_semi_anti",
    """SELECT CASE WHEN doc_id IN (SELECT doc_id FROM labels WHERE quality = 0) THEN 'test' ELSE 'train' END AS part, lang, count(*) AS n FROM documents GROUP BY 1, 2""",
)
def split_semi_anti(spark, sf_dir):
    train, test = joins.split_by_keys(load(spark, sf_dir, "documents").select("doc_id", "lang"), load(spark, sf_dir, "labels").filter("quality = 0"), "doc_id")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).groupBy("part", "lang").agg(F.count("*").alias("n"))


@query(
    "leakage_sources",
    """SELECT DISTINCT source FROM documents WHERE lang = 'en' AND source IN (SELECT source FROM documents WHERE lang = 'fr')""",
)
def leakage_sources(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return joins.leaked(d.filter("lang = 'en'"), d.filter("lang = 'fr'"), "source")


@query(
    "doc_lookup_ci",
    """WITH keyed AS (SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN 'nowhere' WHEN c_custkey % 2 = 0 THEN ' ' || upper(n_name) ELSE 'R' || n_regionkey END AS k
  FROM customer JOIN nation ON c_nationkey = n_nationkey),
names AS (SELECT lower(n_name) AS k, n_nationkey FROM nation UNION SELECT lower('r' || n_regionkey), n_nationkey FROM nation),
first AS (SELECT k, min(n_nationkey) AS n_nationkey FROM names GROUP BY k)
SELECT c_custkey, coalesce(f.n_nationkey, -1)::INT AS found, coalesce(n.n_name, '') AS name FROM keyed LEFT JOIN first f ON lower(trim(keyed.k)) = f.k LEFT JOIN nation n ON n.n_nationkey = f.n_nationkey""",
)
def doc_lookup_ci(spark, sf_dir):
    nation = load(spark, sf_dir, "nation")
    k = F.when(F.col("c_custkey") % 5 == 0, "nowhere").when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.upper("n_name"))).otherwise(F.concat(F.lit("R"), F.col("n_regionkey").cast("string")))
    rows = load(spark, sf_dir, "customer").join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", k.alias("k"))
    docs = nation.select("n_nationkey", "n_name", F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("code"))
    return joins.lookup_first(rows, docs, {"k": ["n_name", "code"]}, "n_nationkey", {"n_nationkey": -1, "n_name": ""}).select("c_custkey", F.col("n_nationkey").alias("found"), F.col("n_name").alias("name"))


@query(
    "theta_pairs",
    """WITH p(a, b) AS (VALUES ('src0', 'src1'), ('src1', 'src2'), ('src3', 'src9'), ('src0', 'src9'))
SELECT a || '|' || b AS pair, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents JOIN p ON source = a OR source = b GROUP BY 1""",
)
def theta_pairs(spark, sf_dir):
    pairs = [("src0", "src1"), ("src1", "src2"), ("src3", "src9"), ("src0", "src9")]
    # counts by source first, so the join expands a few rows and not the table
    by_source = load(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))
    return joins.in_pairs(by_source, "source", pairs).groupBy("pair").agg(F.sum("n").alias("n"), F.sum("chars").alias("chars"))


@query(
    "lookup_fallback",
    """WITH g AS (SELECT c_nationkey, avg(c_acctbal) AS m FROM customer GROUP BY 1), o AS (SELECT avg(c_acctbal) AS m FROM customer)
SELECT s_suppkey, round(s_acctbal - coalesce(g.m, o.m), 4) AS delta FROM supplier CROSS JOIN o LEFT JOIN g ON s_nationkey = c_nationkey""",
)
def lookup_fallback(spark, sf_dir):
    c = load(spark, sf_dir, "customer")
    return _deltas(load(spark, sf_dir, "supplier"), c, c)


def _deltas(supplier, c, known):
    by = known.groupBy(F.col("c_nationkey").alias("s_nationkey")).agg(F.avg("c_acctbal").alias("m"))
    out = joins.lookup_with_fallback(supplier, by, "s_nationkey", c.agg(F.avg("c_acctbal").alias("m")), ["m"])
    return out.select("s_suppkey", F.round(F.col("s_acctbal") - F.col("m"), 4).alias("delta"))


@query(
    "null_safe_join",
    """WITH a AS (SELECT DISTINCT CASE WHEN doc_id % 10 = 0 THEN NULL ELSE source END AS s FROM documents), b AS (SELECT DISTINCT CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS s FROM documents)
SELECT a.s, b.s IS NOT DISTINCT FROM a.s AS same FROM a JOIN b ON a.s IS NOT DISTINCT FROM b.s""",
)
def null_safe_join(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    return _same_sources(d, d)


def _same_sources(left, right):
    a = left.select(F.when(F.col("doc_id") % 10 != 0, F.col("source")).alias("s")).distinct()
    b = right.select(F.when(F.col("doc_id") % 7 != 0, F.col("source")).alias("t")).distinct()
    return a.join(b, F.col("s").eqNullSafe(F.col("t"))).select("s", F.col("s").eqNullSafe(F.col("t")).alias("same"))


@query(
    "as_of_last_event",
    """SELECT l.event_id, max_by(r.value, r.ts) AS value FROM (SELECT * FROM events WHERE event_type = 'purchase') l
LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY 1, 2) r ON l.user_id = r.user_id AND r.ts <= l.ts GROUP BY 1""",
)
def as_of_last_event(spark, sf_dir):
    e = load(spark, sf_dir, "events")
    right = e.filter("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    left = e.filter("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return joins.as_of(left, right, "user_id", "ts", "value").select("event_id", "value")


@query(
    "onehot_matrix",
    """SELECT o_custkey % 10 AS bucket, sum((o_orderstatus = 'F')::INT)::BIGINT AS status_F, sum((o_orderstatus = 'O')::INT)::BIGINT AS status_O, sum((o_orderstatus = 'P')::INT)::BIGINT AS status_P FROM orders GROUP BY 1""",
)
def onehot_matrix(spark, sf_dir):
    o = project.one_hot(load(spark, sf_dir, "orders").select("o_custkey", "o_orderstatus"), "o_orderstatus", ["F", "O", "P"], "status")
    return o.groupBy((F.col("o_custkey") % 10).alias("bucket")).agg(*[F.sum(f"status_{s}").alias(f"status_{s}") for s in "FOP"])


@query(
    "split_matrix",
    """SELECT o_orderpriority AS priority, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1""",
)
def split_matrix(spark, sf_dir):
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("priority")).pivot("o_orderstatus", ["F", "O", "P"]).count()
    return o.fillna(0)


@query(
    "align_union",
    """SELECT 'c' AS kind, c_custkey AS key, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier""",
)
def align_union(spark, sf_dir):
    c = load(spark, sf_dir, "customer").select(F.lit("c").alias("kind"), F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = load(spark, sf_dir, "supplier").select(F.col("s_acctbal").alias("balance"), F.lit("s").alias("kind"), F.col("s_suppkey").alias("key"))
    return union_of_keys([c, s], ("kind", "key"))


@query(
    "aligned_zero_fill",
    """SELECT c_custkey AS key, c_acctbal AS balance, 0.0::DOUBLE AS rank FROM customer UNION ALL SELECT s_suppkey, 0.0::DOUBLE, s_acctbal FROM supplier""",
)
def aligned_zero_fill(spark, sf_dir):
    a = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("balance"))
    b = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("rank"))
    x, y = project.aligned(a, b)
    return x.unionByName(y)


@query(
    "set_operations",
    """SELECT 'both' AS part, count(*) AS n FROM (SELECT c_nationkey FROM customer INTERSECT SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'either', count(*) FROM (SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier)
UNION ALL SELECT 'first', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT s_suppkey FROM supplier)""",
)
def set_operations(spark, sf_dir):
    c, s = load(spark, sf_dir, "customer"), load(spark, sf_dir, "supplier")
    parts = {
        "both": c.select("c_nationkey").intersect(s.select("s_nationkey")),
        "either": c.select("c_nationkey").union(s.select("s_nationkey")).distinct(),
        "first": c.select("c_custkey").subtract(s.select("s_suppkey")),
    }
    out = [d.agg(F.count("*").alias("n")).select(F.lit(k).alias("part"), "n") for k, d in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).filter("n > 1")


@query("first_seen", "SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1")
def first_seen(spark, sf_dir):
    """Distinct values with the place where each is first seen."""
    return load(spark, sf_dir, "events").groupBy("event_type").agg(F.min("event_id").alias("first_id"))


@query(
    "sort_abs_nulls_first",
    """SELECT n_nationkey, x, row_number() OVER (ORDER BY abs(x) ASC NULLS FIRST, n_nationkey) AS place FROM (
  SELECT n_nationkey, CASE WHEN n_nationkey % 6 = 0 THEN NULL ELSE n_nationkey - 12 END AS x FROM nation)""",
)
def sort_abs_nulls_first(spark, sf_dir):
    from pyspark.sql import Window

    n = load(spark, sf_dir, "nation").select("n_nationkey", F.when(F.col("n_nationkey") % 6 != 0, F.col("n_nationkey") - 12).alias("x"))
    return n.withColumn("place", F.row_number().over(Window.orderBy(F.abs("x").asc_nulls_first(), "n_nationkey")).cast("long"))


@query("top_orders", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def top_orders(spark, sf_dir):
    """A top-k report."""
    return load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query(
    "label_vocabulary",
    """SELECT o_orderkey, level, CASE level WHEN 'healthy' THEN 'healthy' WHEN 'high' THEN 'severe' ELSE 'slight_moderate' END AS tier, level = 'healthy' AS is_healthy,
CASE level WHEN 'healthy' THEN 5 WHEN 'low' THEN 35 WHEN 'mid' THEN 60 ELSE 85 END AS proxy FROM (
  SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'healthy' WHEN 1 THEN 'low' WHEN 2 THEN 'mid' ELSE 'high' END AS level FROM orders)""",
)
def label_vocabulary(spark, sf_dir):
    folder = F.element_at(F.array(*[F.lit(x) for x in project.LEVELS]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", project.strict_lookup(folder, project.LEVELS, "level").alias("level"))
    proxy = project.lookup(F.col("level"), {"healthy": 5, "low": 35, "mid": 60, "high": 85})
    return o.select("o_orderkey", "level", project.lookup(F.col("level"), project.TIERS).alias("tier"), (F.col("level") == "healthy").alias("is_healthy"), proxy.alias("proxy"))


@query(
    "score_levels",
    """SELECT p_partkey, CASE WHEN s < 8 THEN 'healthy' WHEN s < 25 THEN 'low' WHEN s < 50 THEN 'mid' ELSE 'high' END AS level,
CASE WHEN h > 0 THEN greatest(s, 8 + least(h / 0.015, 1.0) * 22) ELSE s END AS floored FROM (SELECT p_partkey, p_size::DOUBLE AS s, (p_partkey % 4) / 200.0::DOUBLE AS h FROM part)""",
)
def score_levels(spark, sf_dir):
    p = load(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("s"), ((F.col("p_partkey") % 4) / F.lit(200.0)).alias("h"))
    return p.select("p_partkey", scalars.levels(F.col("s")).alias("level"), scalars.hole_floor(F.col("s"), F.col("h")).alias("floored"))


@query(
    "sentinel_impute",
    """WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_quantity < 10 THEN -1.0 ELSE l_quantity END AS q FROM lineitem), m AS (SELECT quantile_cont(q, 0.5) AS m FROM t WHERE q <> -1.0)
SELECT l_partkey % 100 AS bucket, sum(CASE WHEN q = -1.0 THEN m ELSE q END) AS q FROM t, m GROUP BY 1""",
)
def sentinel_impute(spark, sf_dir):
    t = load(spark, sf_dir, "lineitem").select("l_partkey", F.when(F.col("l_quantity") < 10, F.lit(-1.0)).otherwise(F.col("l_quantity")).alias("q"))
    return project.imputed(t, ["q"]).groupBy((F.col("l_partkey") % 100).alias("bucket")).agg(F.sum("q").alias("q"))


@query(
    "scrub_and_clip",
    """SELECT event_id, round(least(greatest(coalesce(CASE WHEN isnan(z) OR isinf(z) THEN 0 ELSE z END, 0), -5), 5), 9) AS z FROM (
  SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL WHEN event_id % 7 = 0 THEN 'NaN'::DOUBLE WHEN event_id % 13 = 0 THEN 'Infinity'::DOUBLE ELSE (value - 50) / 5 END AS z FROM events)""",
)
def scrub_and_clip(spark, sf_dir):
    z = F.when(F.col("event_id") % 11 == 0, None).when(F.col("event_id") % 7 == 0, F.lit(float("nan"))).when(F.col("event_id") % 13 == 0, F.lit(float("inf"))).otherwise((F.col("value") - 50) / 5)
    e = project.scrubbed(load(spark, sf_dir, "events").select("event_id", z.alias("z")), ["z"])
    return e.select("event_id", F.round(scalars.clip(F.col("z"), -5.0, 5.0), 9).alias("z"))


@query(
    "url_path_parse",
    """SELECT page_id, lower(regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)) AS host,
CASE WHEN list_contains(string_split(lower(url), '/'), 'en') THEN 'en' WHEN list_contains(string_split(lower(url), '/'), 'fr') THEN 'fr' ELSE 'unknown' END AS view, regexp_matches(url, 'utm_') AS tagged FROM pages""",
)
def url_path_parse(spark, sf_dir):
    u = F.col("url")
    return load(spark, sf_dir, "pages").select("page_id", F.lower(F.regexp_extract(u, "^[a-z]+://([^/?#]+)", 1)).alias("host"), project.path_part(u, ["en", "fr"]).alias("view"), F.contains(u, F.lit("utm_")).alias("tagged"))


@query("json_kv", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS BIGINT))::BIGINT AS k, count(*) AS n FROM events GROUP BY 1")
def json_kv(spark, sf_dir):
    e = load(spark, sf_dir, "events").select("event_type", F.from_json("props", "k long")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.sum("k").alias("k"), F.count("*").alias("n"))


@query("exif_order", "SELECT event_id, strftime(date_trunc('second', ts), '%Y:%m:%d %H:%M:%S') AS exif, date_trunc('second', ts) AS taken FROM events")
def exif_order(spark, sf_dir):
    return _exif(load(spark, sf_dir, "events"))


def _exif(e):
    e = e.select("event_id", F.date_format("ts", "yyyy:MM:dd HH:mm:ss").alias("exif"))
    return e.withColumn("taken", image_files.exif_time(F.col("exif")).cast("timestamp_ntz"))


@query(
    "coverage_qc",
    """SELECT doc_id, c >= 0.02 AND c <= 0.75 AS qc_pass, CASE WHEN c < 0.02 THEN 'below' WHEN c > 0.75 THEN 'above' ELSE 'ok' END AS reason FROM (SELECT doc_id, least(n_chars / 4000.0, 1.0) AS c FROM documents)""",
)
def coverage_qc(spark, sf_dir):
    ok, why = project.coverage_check(F.col("c"))
    d = load(spark, sf_dir, "documents").select("doc_id", F.least(F.col("n_chars") / 4000.0, F.lit(1.0)).alias("c"))
    short = F.when(F.contains(why, F.lit("below")), "below").when(F.contains(why, F.lit("above")), "above").otherwise(why)
    return d.select("doc_id", ok.alias("qc_pass"), short.alias("reason"))


@query(
    "categories",
    """SELECT feature, CASE WHEN feature LIKE 'l\\_ext%' ESCAPE '\\' THEN 'price' WHEN feature LIKE 'l\\_q%' ESCAPE '\\' THEN 'size' ELSE 'other' END AS category, round(sum(value), 2) AS total FROM (
  UNPIVOT (SELECT l_orderkey, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME feature VALUE value) GROUP BY 1, 2""",
)
def categories(spark, sf_dir):
    long = project.long_form(load(spark, sf_dir, "lineitem"), ["l_orderkey"], MEASURES)
    totals = long.groupBy("feature").agg(F.round(F.sum("value"), 2).alias("total"))
    return totals.select("feature", project.category_of(F.col("feature"), {"l_ext": "price", "l_q": "size"}).alias("category"), "total")


@query(
    "failures_by_group",
    """SELECT fail_type, reason, count(*) AS n FROM (SELECT CASE WHEN n_chars < 60 THEN 'too_short' WHEN lang = 'es' THEN 'language' END AS fail_type, lang AS reason FROM documents) WHERE fail_type IS NOT NULL GROUP BY 1, 2""",
)
def failures_by_group(spark, sf_dir):
    kind = F.when(F.col("n_chars") < 60, "too_short").when(F.col("lang") == "es", "language")
    d = load(spark, sf_dir, "documents").select("doc_id", F.when(kind.isNotNull(), F.struct(kind.alias("type"), F.col("lang").alias("reason"))).alias("error"))
    return split_failures(d)[1].groupBy("fail_type", "reason").agg(F.count("*").alias("n"))


@query(
    "run_summary",
    """SELECT sum(n)::BIGINT AS total, sum(n - bad)::BIGINT AS successes, round_even(100.0 * sum(n - bad) / greatest(sum(n), 1), 2)::DOUBLE AS success_rate,
'{' || string_agg('"' || lang || '":' || bad, ',' ORDER BY lang) FILTER (bad > 0) || '}' AS failures FROM (SELECT lang, count(*) AS n, count(*) FILTER (n_chars < 60) AS bad FROM documents GROUP BY 1)""",
)
def run_summary_query(spark, sf_dir):
    return run_summary(load(spark, sf_dir, "documents").select("lang", (F.col("n_chars") >= 60).alias("ok")), "lang", "ok")


@query(
    "dispatch_union",
    """SELECT lang, 'compound' AS branch, count(*) AS n FROM documents WHERE n_chars >= 1500 GROUP BY 1 UNION ALL SELECT lang, 'simple', count(*) FROM documents WHERE NOT n_chars >= 1500 GROUP BY 1""",
)
def dispatch_union(spark, sf_dir):
    d = load(spark, sf_dir, "documents")
    count = lambda x, name: x.groupBy("lang").agg(F.count("*").alias("n")).withColumn("branch", F.lit(name))
    return count(d.filter("n_chars >= 1500"), "compound").unionByName(count(d.filter("not n_chars >= 1500"), "simple"))


@query(
    "scalar_functions",
    """SELECT p_partkey, round(CASE WHEN abs(p_size - 25) <= 1 THEN 0 ELSE -sign(p_size - 25) * log10(abs(p_size - 25) + 1e-10) END, 9) AS hu, least(abs(p_size * 7 % 180 - 90), 180 - abs(p_size * 7 % 180 - 90)) AS hue,
round(1 / (1 + exp(-(p_size - 25) / 100.0 / 0.2)), 9) AS prob, round_even(p_retailprice, 1)::DOUBLE AS price, round(CASE WHEN p_size > 10 THEN p_retailprice / p_size ELSE 0 END, 9) AS ratio FROM part""",
)
def scalar_functions(spark, sf_dir):
    x = (F.col("p_size") - 25).cast("double")
    hue = scalars.hue_distance((F.col("p_size") * 7 % 180).cast("int"), F.lit(90), 180)
    return load(spark, sf_dir, "part").select(
        "p_partkey",
        F.round(F.when(F.abs(x) <= 1, F.lit(0.0)).otherwise(scalars.signed_log(x)), 9).alias("hu"),
        hue.cast("int").alias("hue"),
        F.round(scalars.sigmoid(x / 100.0), 9).alias("prob"),
        scalars.half_even(F.col("p_retailprice"), 1).alias("price"),
        F.round(F.when(F.col("p_size") > 10, scalars.ratio(F.col("p_retailprice"), F.col("p_size"))).otherwise(0.0), 9).alias("ratio"),
    )


@query("text_functions", """SELECT n_nationkey, replace(upper(n_name[1]) || lower(n_name[2:]), '_', ' ') AS title, CASE WHEN contains(n_name, 'A') AND length(n_name) > 6 THEN 'has_a,long' WHEN contains(n_name, 'A') THEN 'has_a' WHEN length(n_name) > 6 THEN 'long' ELSE 'ok' END AS flags FROM nation""")
def text_functions(spark, sf_dir):
    n = load(spark, sf_dir, "nation")
    return n.select("n_nationkey", scalars.title_case(F.col("n_name")).alias("title"), scalars.flags(has_a=F.contains("n_name", F.lit("A")), long=F.length("n_name") > 6).alias("flags"))


@query("leakage_semi", "SELECT item_id FROM benchmark b WHERE EXISTS (SELECT 1 FROM documents d WHERE contains(d.text, b.text))")
def leakage_semi(spark, sf_dir):
    """Benchmark items whose text stands in a document: they meet in a run of six words, then the texts are compared."""
    from frond.operators.joins import contained

    return contained(load(spark, sf_dir, "benchmark"), "item_id", load(spark, sf_dir, "documents"), "text", 6)
