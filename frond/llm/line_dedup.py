"""Dropping a site's boilerplate lines by their frequency relative to the site.

Pages are grouped by host; for every line of a host, the pages that contain it are divided by the host's pages, and
lines above the ratio are dropped. A line on a share ``ratio`` of a host's pages can't be one of more than (mean lines a
page / ratio) such lines, so each host's list of them is short however many pages it has: pages are matched with their
host's list, and no page's text is shuffled while the lists stay small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.llm.common import SPACE, left_join_hot, saved

RATIO, MIN_PAGES = 0.3, 3
#: Keys in all hosts' lists up to which these are broadcast whole (16 bytes each).
BROADCAST_KEYS = 500_000


def host_of(url: Column) -> Column:
    """The host of a URL in lower case, without user and port; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", 1))


def lines_of(html: Column) -> Column:
    """What stands between tags and line ends, trimmed, without empty lines; null has none. Linear in the page's length.

    A tag runs from a < to the next >. Only what stands before the last > is searched for tags, so every < that is tried
    has a > behind it, and none is tried in vain.
    """
    page = F.coalesce(html, F.lit(""))
    rest = F.substring_index(page, ">", -1)
    tagged = F.substring(page, F.lit(1), F.length(page) - F.length(rest))
    text = F.concat(F.regexp_replace(tagged, "<[^>]*>", "\n"), rest)
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\f\r"))), lambda x: x != "")


def _key(line: Column) -> Column:
    return F.unhex(F.md5(line))


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> tuple[DataFrame, int]:
    """A saved table (host, n: its pages, keys: the hashes of its boilerplate lines), and the number of pages read."""
    read = pages.select(host_of(F.col("url")).alias("host"), F.array_distinct(F.transform(lines_of(F.col("html")), _key)).alias("keys"))
    hosts = saved(pages.select(host_of(F.col("url")).alias("host")).groupBy("host").agg(F.count("*").alias("n")))
    total = hosts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    known = F.col("host") != ""
    counts = saved(read.filter(known).select("host", F.explode("keys").alias("key")).groupBy("host", "key").agg(F.count("*").alias("on")).filter(F.col("on") >= min_pages))
    above = left_join_hot(counts, hosts, "host", "n", total).filter(F.col("on") > ratio * F.col("n"))
    return saved(above.groupBy("host", "n").agg(F.collect_set("key").alias("keys"))), total


def cleaned(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """Every row of ``pages`` (page_id, url, html) with host, n_lines, n_dropped and text (the lines that stay, joined by \\n).

    A line is boilerplate if it stands on at least ``min_pages`` of its host's pages and on more than ``ratio`` of them;
    repetitions in one page count once. Pages without a host belong to no site and keep all lines. Null html has no
    lines. Repeated rows are pages like any other, ids play no part, other columns are ignored; an empty table gives an
    empty result.
    """
    lists, total = boilerplate(pages, ratio, min_pages)
    read = pages.select("page_id", host_of(F.col("url")).alias("host"), lines_of(F.col("html")).alias("lines"))
    keys = lists.agg(F.coalesce(F.sum(F.size("keys")), F.lit(0))).first()[0]
    listed = read.join(F.broadcast(lists), "host", "left") if keys <= BROADCAST_KEYS else left_join_hot(read, lists, "host", "n", total)
    # hosts have few boilerplate lines: mean lines a page / ratio at most
    stay = F.when(F.isnull("keys"), F.col("lines")).otherwise(F.filter("lines", lambda x: ~F.array_contains("keys", _key(x))))
    return listed.withColumn("stay", stay).select(
        "page_id",
        "host",
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size("stay")).cast("long").alias("n_dropped"),
        F.array_join("stay", "\n").alias("text"),
    )
