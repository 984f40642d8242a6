"""Null keys and fallbacks come from small tables, and the queries over whole tables lose no row."""

from frond.plans import registry, relational, statistics

SMALL = "/root/testdata/sf0.001"


def test_null_keys_and_fallbacks(spark):
    s = spark.createDataFrame([(1, 0, 5.0), (2, 9, 5.0)], "s_suppkey long, s_nationkey long, s_acctbal double")
    c = spark.createDataFrame([(0, 1.0), (12, 4.0)], "c_nationkey long, c_acctbal double")
    assert {r.s_suppkey: r.delta for r in relational._deltas(s, c, c).collect()} == {1: 4.0, 2: 2.5}
    left = spark.createDataFrame([(10, "x"), (1, "y"), (3, "z")], "doc_id long, source string")
    right = spark.createDataFrame([(7, "x"), (19, "y"), (2, "w")], "doc_id long, source string")
    assert {r.s for r in relational._same_sources(left, right).collect()} == {None, "y"}
    n = spark.createDataFrame([(1, float(x)) for x in range(10)] + [(2, 100.0)], "c_nationkey long, c_acctbal double")
    got = {r.c_nationkey: (r.n, r.median, r.iqr) for r in statistics._norm_stats(n).collect()}
    assert got == {1: (10, 4.5, 4.5), 2: (1, 5.0, 5.0)}
    nations = {r.c_nationkey: r.n for r in registry.QUERIES["norm_stats_fallback"](spark, SMALL).collect()}
    assert sum(nations.values()) == spark.read.parquet(f"{SMALL}/customer.parquet").count()
