"""Joins of two views, of splits and look-ups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from frond.functions.scalars import worst_side

#: Rows of a look-up table up to which it is broadcast; beyond, Spark shuffles both sides.
LOOKUP_ROWS = 100_000


def bounded_broadcast(df: DataFrame, rows: int = LOOKUP_ROWS) -> DataFrame:
    """A broadcast hint for tables that are small; the check reads at most rows + 1 rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fused_views(top: DataFrame, bottom: DataFrame, key: str | list[str], features: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """One row for each key that both views have: top_f, bottom_f and worst_f of every feature, and ``keep`` of the top view."""
    keys = [key] if isinstance(key, str) else key
    a = top.select(*keys, *keep, *[F.col(f).alias(f"top_{f}") for f in features])
    b = bottom.select(*keys, *[F.col(f).alias(f"bottom_{f}") for f in features])
    worst = [worst_side(F.col(f"top_{f}"), F.col(f"bottom_{f}")).alias(f"worst_{f}") for f in features]
    return a.join(b, keys).select("*", *worst)


def unmatched(top: DataFrame, bottom: DataFrame, key: str) -> DataFrame:
    """Keys that exactly one of two tables has, and which view is missing; one shuffle of distinct keys."""
    tagged = top.select(key, F.lit(1).alias("t"), F.lit(0).alias("b")).unionByName(bottom.select(key, F.lit(0).alias("t"), F.lit(1).alias("b")))
    return tagged.groupBy(key).agg(F.max("t").alias("t"), F.max("b").alias("b")).filter("t + b = 1").select(key, F.when(F.col("t") == 0, "top").otherwise("bottom").alias("missing_view"))


def split_by_keys(rows: DataFrame, test: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Training and test rows: a key is test if ``test`` has it."""
    ids = test.select(key).distinct()
    return rows.join(ids, key, "left_anti"), rows.join(ids, key, "left_semi")


def lookup_first(rows: DataFrame, table: DataFrame, on: dict[str, list[str]], order: str, defaults: dict[str, object]) -> DataFrame:
    """Left join with the first row of a document table any of whose columns equals the key in any case; ``on`` is
    {key column: [table columns]}. Every match is an equi-join on an exploded name, so nothing is compared pair by pair."""
    ((key, names),) = on.items()
    place = Window.partitionBy("_name").orderBy(order)
    docs = table.withColumn("_name", F.explode(F.array_distinct(F.array(*[F.lower(F.trim(F.col(n))) for n in names]))))
    docs = docs.filter("_name is not null").withColumn("_place", F.row_number().over(place)).filter("_place = 1")
    docs = docs.select("_name", *defaults)
    out = rows.withColumn("_name", F.lower(F.trim(F.col(key)))).join(bounded_broadcast(docs), "_name", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()}).drop("_name")


def lookup_with_fallback(rows: DataFrame, table: DataFrame, key: str, overall: DataFrame, columns: list[str]) -> DataFrame:
    """``columns`` from a row's group, or, where the group has none, from the one row of ``overall``."""
    glob = overall.select(*[F.col(c).alias(f"_all_{c}") for c in columns])
    out = rows.join(table.select(key, *columns), key, "left").crossJoin(F.broadcast(glob))  # one row
    return out.withColumns({c: F.coalesce(c, f"_all_{c}") for c in columns}).drop(*[f"_all_{c}" for c in columns])


def in_pairs(rows: DataFrame, label: str, pairs: list[tuple[str, str]]) -> DataFrame:
    """A row for each pair that has its label: an OR of two equalities, made an equi-join by one row for each member."""
    members = rows.sparkSession.createDataFrame([(m, f"{a}|{b}") for a, b in pairs for m in dict.fromkeys((a, b))], f"{label} string, pair string")
    return rows.join(F.broadcast(members), label)  # two rows for each given pair


def leaked(test: DataFrame, train: DataFrame, key: str) -> DataFrame:
    return test.select(key).distinct().join(train.select(key), key, "left_semi")


def aligned_predictions(a: DataFrame, b: DataFrame, key: str, order: str) -> DataFrame:
    """Two sets of predictions side by side; a key that one of them lacks raises an error when rows are read."""
    both = a.join(b, key, "full")
    whole = F.when(F.col(a.columns[-1]).isNull() | F.col(b.columns[-1]).isNull(), F.raise_error(F.concat(F.lit("no pair for "), F.col(key).cast("string"))))
    return both.withColumn("_", whole).filter("_ is null").drop("_").orderBy(order)


def within(points: DataFrame, marks: DataFrame, key: str, reach: int) -> DataFrame:
    """Points with a mark at a Chebyshev distance of at most ``reach``: both sides meet in square cells of that width, so a
    point is compared with the marks of nine cells only."""
    cell = lambda c: F.floor(F.col(c) / reach)
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    near = marks.select(key, F.col("y").alias("my"), F.col("x").alias("mx"), shift.alias("s"))
    near = near.select(key, "my", "mx", (F.floor(F.col("my") / reach) + F.col("s.i")).alias("cy"), (F.floor(F.col("mx") / reach) + F.col("s.j")).alias("cx"))
    here = points.withColumns({"cy": cell("y"), "cx": cell("x")})
    close = (F.abs(here["y"] - near["my"]) <= reach) & (F.abs(here["x"] - near["mx"]) <= reach)
    return here.join(near, (here[key] == near[key]) & (here["cy"] == near["cy"]) & (here["cx"] == near["cx"]) & close, "left_semi").drop("cy", "cx")


def neighbour_edges(points: DataFrame, key: str) -> DataFrame:
    """The undirected edges between pixels that touch, with their lengths; every edge once."""
    ahead = [(0, 1), (1, -1), (1, 0), (1, 1)]
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in ahead]))
    ends = points.select(key, "y", "x", shift.alias("s")).select(key, "y", "x", (F.col("y") + F.col("s.i")).alias("y2"), (F.col("x") + F.col("s.j")).alias("x2"), F.hypot("s.i", "s.j").alias("w"))
    return ends.join(points.select(key, F.col("y").alias("y2"), F.col("x").alias("x2")), [key, "y2", "x2"]).select(key, "y", "x", "y2", "x2", "w")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str) -> DataFrame:
    """The last ``value`` at or before each left row's time: one union and one window, no range join."""
    both = left.select(key, time, F.lit(None).cast(right.schema[value].dataType).alias(value), F.lit(1).alias("_left"), F.struct(*left.columns).alias("_row")).unionByName(
        right.select(key, time, value, F.lit(0).alias("_left")), allowMissingColumns=True
    )
    w = Window.partitionBy(key).orderBy(time, "_left").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(value, F.last(value, ignorenulls=True).over(w)).filter("_left = 1").select("_row.*", value)


def contained(items: DataFrame, key: str, docs: DataFrame, text: str, words: int) -> DataFrame:
    """Keys of items whose text stands somewhere in a document.

    The text's second to (words + 1)th blank-separated words stand whole in any text that contains it, so items and
    documents meet in their hash; items too short for that are looked for in one pass with all of them at hand.
    """
    cut = F.split(F.col(text), " ")
    told = items.select(key, F.col(text).alias("_item"), cut.alias("_w"))
    long = told.filter(F.size("_w") >= words + 2).select(key, "_item", F.xxhash64(F.array_join(F.slice("_w", 2, words), " ")).alias("_h"))
    runs = F.transform(F.sequence(F.lit(1), F.size("_w") - words + 1), lambda i: F.xxhash64(F.array_join(F.slice(F.col("_w"), i, words), " ")))
    near = docs.select(F.col(text).alias("_doc"), cut.alias("_w")).filter(F.size("_w") >= words).select("_doc", F.explode(F.array_distinct(runs)).alias("_h"))
    found = near.join(bounded_broadcast(long), "_h").filter(F.contains("_doc", F.col("_item"))).select(key).distinct()
    short = told.filter(F.size("_w") < words + 2).select(key, "_item")
    if short.isEmpty():
        return found
    rest = bounded_broadcast(short).join(docs.select(F.col(text).alias("_doc")), F.contains(F.col("_doc"), F.col("_item")), "left_semi").select(key)
    return found.unionByName(rest)
