"""Connected components, and what components of pixels have to do with each other.

Components are found by hooking and pointer jumping over tables: every node has a parent; in each round nodes and their
parents take the smallest grandparent among their neighbours, and everyone moves up to its own grandparent. The rounds grow
with the logarithm of a component's extent. Each round's parents are written as a table, which cuts the lineage. A parent with
a large share of all nodes is looked up by a broadcast of such parents only, of which there are fewer than 1 / HOT_SHARE. All
other joins are hinted to be sorted ones: a table of numbers is some twenty times smaller as a file, by whose size Spark would
send it whole through the driver.

Pixels are labelled in square tiles first, each tile in one row and all tiles of a batch at once; only pixels on the border of
two tiles give edges, and the loop runs over components of tiles that such edges join, if there are any.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.operators.state import Tables

HOT_SHARE, HOT_LEAST = 1 / 2000, 100_000
SENTINEL = -1.0


def connected(nodes: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, component) for ``nodes`` (keys, node long): the smallest node that can be reached by ``edges`` (keys, a, b),
    which join nodes of one key in both directions.

    Repeated nodes and edges count once; ends that are no node are left out, as are null nodes. A node without edges is a
    component of its own. An empty table gives an empty result.
    """
    tables = Tables(nodes.sparkSession)
    known = tables.put(nodes.filter("node is not null").select(*keys, "node").distinct(), "nodes")
    total = known.count()
    both = edges.select(*keys, F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))).alias("e")).select(*keys, "e.u", "e.v")
    there = lambda name: known.withColumnRenamed("node", name).hint("merge")
    links = tables.put(both.filter("u <> v").distinct().join(there("u"), [*keys, "u"], "left_semi").join(there("v"), [*keys, "v"], "left_semi"), "links")
    parents = tables.put(known.withColumn("parent", F.col("node")), "parents-0")
    turn, limit, before = 0, max(HOT_LEAST, int(total * HOT_SHARE)), None
    while True:
        turn += 1
        up = tables.put(_with_grandparents(parents, keys, limit), f"up-{turn}")
        near = links.join(up.select(*keys, F.col("node").alias("v"), "grand").hint("merge"), [*keys, "v"]).groupBy(*keys, F.col("u").alias("node")).agg(F.min("grand").alias("least"))
        met = up.join(near.hint("merge"), [*keys, "node"], "left")
        # a node, and its parent, take the least grandparent beside it
        offers = met.select(*keys, F.explode(F.array(F.struct("node", F.least("grand", "least").alias("parent")), F.struct(F.col("parent").alias("node"), F.least("grand", "least").alias("parent")))).alias("o")).select(*keys, "o.*")
        after = tables.put(offers.groupBy(*keys, "node").agg(F.min("parent").alias("parent")), f"parents-{turn}")
        tables.drop(f"up-{turn}")
        now = after.agg(F.sum(F.col("parent").cast("decimal(38,0)"))).first()[0]  # parents only fall
        before, moved = now, now != before
        if not moved:
            tables.drop("links")
            return after.withColumnRenamed("parent", "component")
        if turn > 1:
            tables.drop(f"parents-{turn - 2}")
        parents = after


def _with_grandparents(parents: DataFrame, keys: list[str], limit: int) -> DataFrame:
    of = parents.select(*keys, F.col("node").alias("parent"), F.col("parent").alias("grand"))
    by = [*keys, "parent"]
    hot = parents.groupBy(*by).agg(F.count("*").alias("_n")).filter(F.col("_n") > limit).drop("_n")
    few = F.broadcast(of.join(F.broadcast(hot), by))
    return parents.join(few, by).unionByName(parents.join(F.broadcast(hot), by, "left_anti").join(of.hint("merge"), by))


#: Pixels of a row that a place number holds.
WIDTH = 1 << 20
#: Side of the square tiles that are labelled at once, and how many pixels of them together.
TILE, AT_ONCE = 32, 200_000
AHEAD = ((0, 1), (1, -1), (1, 0), (1, 1))


def tile_roots(tiles: list[np.ndarray]) -> list[np.ndarray]:
    """For each tile's cells (y * TILE + x inside the tile, in any order) the smallest cell of their 8-connected component."""
    wide = TILE + 1  # a column that is always empty, so that no row runs into the next
    cell = np.concatenate([np.asarray(t, dtype=np.int64) for t in tiles]) if tiles else np.zeros(0, dtype=np.int64)
    ends = np.cumsum([len(t) for t in tiles])
    which = np.repeat(np.arange(len(tiles)), [len(t) for t in tiles])
    known, back = np.unique(which * wide * wide + cell // TILE * wide + cell % TILE, return_inverse=True)
    pairs = []
    for i, j in AHEAD:
        at = np.searchsorted(known, known + i * wide + j)
        met = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == known + i * wide + j)
        pairs.append((met, at[met]))
    a, b = (np.concatenate(side) for side in zip(*pairs))
    root = np.arange(len(known))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        apart = low < high
        a, b = a[apart], b[apart]
        np.minimum.at(root, high[apart], low[apart])
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    found = known[root][back] % (wide * wide)
    return np.split(found // wide * TILE + found % wide, ends[:-1]) if tiles else []


def _tile_roots(cells: pd.Series) -> pd.Series:
    out, part, held = [], [], 0
    for tile in cells:
        part.append(tile)
        held += len(tile)
        if held >= AT_ONCE:
            out += tile_roots(part)
            part, held = [], 0
    return pd.Series(out + tile_roots(part), index=cells.index)


def labelled(px: DataFrame, key: str) -> DataFrame:
    """``px`` (key, y, x and more) with ``component``: the number (y * WIDTH + x) of the first pixel, in reading order, of the
    8-connected component that the pixel belongs to. Pixels without key or place are left out."""
    tables = Tables(px.sparkSession)
    tile = lambda c: F.floor(F.col(c) / TILE)
    rest = [c for c in px.columns if c != key]
    known = px.filter(F.col(key).isNotNull() & F.col("y").isNotNull() & F.col("x").isNotNull())
    tiles = known.groupBy(key, tile("y").alias("_ty"), tile("x").alias("_tx")).agg(F.collect_list(F.struct(*rest)).alias("_rows"))
    cells = F.transform("_rows", lambda r: (F.pmod(r["y"], F.lit(TILE)) * TILE + F.pmod(r["x"], F.lit(TILE))).cast("int"))
    each = tiles.withColumn("_roots", F.pandas_udf(_tile_roots, "array<int>")(cells)).select(key, "_ty", "_tx", F.explode(F.arrays_zip("_rows", "_roots")).alias("e"))
    first = (F.col("_ty") * TILE + F.floor(F.col("e._roots") / TILE)) * WIDTH + F.col("_tx") * TILE + F.col("e._roots") % TILE
    parts = tables.put(each.select(key, *[F.col(f"e._rows.{c}").alias(c) for c in rest], first.cast("long").alias("component")), "parts").select(*px.columns, "component")

    def on_border(c: str) -> Column:
        return F.pmod(F.col(c), F.lit(TILE)).isin(0, TILE - 1)

    border = parts.filter(on_border("y") | on_border("x")).select(key, "y", "x", "component").distinct()
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in AHEAD]))
    ends = border.select(key, (tile("y") * WIDTH + tile("x")).alias("_from"), F.col("component").alias("a"), "y", "x", shift.alias("s"))
    ends = ends.select(key, "_from", "a", (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x")).filter(F.col("_from") != tile("y") * WIDTH + tile("x"))
    edges = tables.put(ends.join(border.withColumnRenamed("component", "b").hint("merge"), [key, "y", "x"]).select(key, "a", "b").distinct(), "edges")
    if edges.isEmpty():
        return parts
    nodes = edges.select(key, F.explode(F.array("a", "b")).alias("node"))
    moved = connected(nodes, edges, [key]).filter("component <> node").select(key, F.col("node").alias("component"), F.col("component").alias("_to"))
    return parts.join(moved.hint("merge"), [key, "component"], "left").withColumn("component", F.coalesce("_to", "component")).select(*px.columns, "component")


def blobs(px: DataFrame, key: str) -> DataFrame:
    """One row for each component of ``labelled``: area, and the box top, left, height, width."""
    return px.groupBy(key, "component").agg(
        F.count("*").alias("area"), F.min("y").alias("top"), F.min("x").alias("left"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width")
    )


def blob_stats(px: DataFrame, key: str) -> DataFrame:
    """For each image: the number of components, and their largest and mean area."""
    return blobs(px, key).groupBy(key).agg(F.count("*").alias("n"), F.max("area").alias("largest"), F.avg("area").alias("mean"))


def square(reach: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]


def ellipse(size: int) -> list[tuple[int, int]]:
    """The offsets of a filled ellipse in a square of ``size`` (odd) pixels."""
    r = size // 2
    wide = {i: round(math.sqrt(r * r - i * i)) for i in range(-r, r + 1)}
    return [(i, j) for i in range(-r, r + 1) for j in range(-wide[i], wide[i] + 1)]


def dilated(px: DataFrame, key: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """The places (key, y, x) that ``offsets`` reach from any pixel, each once."""
    shift = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in offsets]))
    return px.select(key, "y", "x", shift.alias("s")).select(key, (F.col("y") + F.col("s.i")).alias("y"), (F.col("x") + F.col("s.j")).alias("x")).distinct()


def enclosed_fraction(px: DataFrame, key: str, mask: Column, vein: Column, least: int = 200) -> DataFrame:
    """For each image of a whole pixel table (key, y, x, ...): how much of the lamina (mask without veins) lies in components
    that no pixel of touches the background (not mask); -1 where the mask has fewer than ``least`` pixels or no lamina."""
    flat = px.select(key, "y", "x", F.coalesce(mask, F.lit(False)).alias("_mask"), F.coalesce(vein, F.lit(False)).alias("_vein"))
    parts = labelled(flat.filter("_mask and not _vein"), key)
    reached = dilated(flat.filter("not _mask"), key, square(1))
    # hinted: as files or shuffled these are far smaller than as a broadcast
    touching = parts.join(reached.hint("merge"), [key, "y", "x"], "left_semi").select(key, "component").distinct()
    inside = parts.join(touching.hint("merge"), [key, "component"], "left_anti").groupBy(key).agg(F.count("*").alias("_inside"))
    sizes = flat.groupBy(key).agg(F.count_if(F.col("_mask")).alias("_area"), F.count_if(F.col("_mask") & ~F.col("_vein")).alias("lamina"))
    told = sizes.join(inside.hint("merge"), key, "left").withColumn("enclosed", F.coalesce("_inside", F.lit(0)))
    return told.select(key, "lamina", "enclosed", F.when((F.col("_area") < least) | (F.col("lamina") == 0), F.lit(SENTINEL)).otherwise(F.try_divide(F.col("enclosed"), F.col("lamina"))).alias("fraction"))


def shadow_regions(px: DataFrame, key: str, value: str, least: int, dark: float, artifact: int, offsets: list[tuple[int, int]], passes: int | None = 1) -> DataFrame:
    """Components of ``px`` (key, y, x, value) by what they are: one row each with area, median and state.

    ``dark``: at least ``least`` pixels whose median value is below ``dark``. ``promoted``: fewer than ``artifact`` pixels, one
    of which ``offsets`` reach from a dark component. ``kept``: all others. With more passes (None: until nothing changes)
    promoted components count as dark in the next.
    """
    tables = Tables(px.sparkSession)
    places = tables.put(labelled(px.select(key, "y", "x", F.col(value).cast("double").alias("_v")), key), "places")
    found = places.groupBy(key, "component").agg(F.count("*").alias("area"), F.percentile("_v", 0.5).alias("median"))
    is_dark = (F.col("area") >= least) & (F.col("median") < dark)
    states = tables.put(found.withColumn("state", F.when(is_dark, "dark").otherwise("kept")), "states-0")
    turn, fresh = 0, states.filter("state = 'dark'")
    while passes is None or turn < passes:
        turn += 1
        reached = dilated(places.join(fresh.select(key, "component"), [key, "component"], "left_semi"), key, offsets)
        met = places.join(reached, [key, "y", "x"], "left_semi").select(key, "component").distinct().withColumn("_met", F.lit(True))
        small = (F.col("state") == "kept") & (F.col("area") < artifact) & F.coalesce("_met", F.lit(False))
        now = states.join(met, [key, "component"], "left").withColumn("_new", small).withColumn("state", F.when(small, "promoted").otherwise(F.col("state"))).drop("_met")
        now = tables.put(now, f"states-{turn}")
        fresh, states = now.filter("_new"), now.drop("_new")
        if passes is None and fresh.isEmpty():
            break
    return states


def left_right(px: DataFrame, key: str, above: float) -> DataFrame:
    """For each image of ``labelled`` pixels: components larger than ``above``, the share of their area in those whose box centre
    is left of the median centre, and the balance 1 - 2 |share - 1/2|; a half and 1 with fewer than two such components."""
    big = blobs(px, key).withColumn("cx", F.col("left") + F.col("width") / 2)
    wide = F.col("area") > above
    mid = big.groupBy(key).agg(F.count_if(wide).alias("n"), F.percentile(F.when(wide, F.col("cx")), 0.5).alias("_mid"))
    told = big.join(mid, key).groupBy(key, "n").agg(
        F.sum(F.when(wide & (F.col("cx") < F.col("_mid")), F.col("area")).otherwise(0)).alias("_left"), F.sum(F.when(wide, F.col("area")).otherwise(0)).alias("_all")
    )
    share = F.when(F.col("n") < 2, F.lit(0.5)).otherwise(F.try_divide(F.col("_left"), F.col("_all")))
    return told.select(key, "n", share.alias("share")).withColumn("balance", 1 - 2 * F.abs(F.col("share") - 0.5))


def hull(points: Column) -> Column:
    """The corners of the convex hull of an array of (x, y) that is sorted by x and then y: the lower chain from left to right
    and the upper one back, without points on its edges. Linear in the points times the hull's corners."""

    def turn(a: Column, b: Column, c: Column) -> Column:
        return (b["x"] - a["x"]) * (c["y"] - a["y"]) - (b["y"] - a["y"]) * (c["x"] - a["x"])

    def add(chain: Column, p: Column) -> Column:
        # corners stay up to the last one where the way on to p turns left
        last = F.filter(F.slice(F.sequence(F.lit(0), F.greatest(F.size(chain), F.lit(1)) - 1), F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))), lambda j: turn(F.get(chain, j - 1), F.get(chain, j), p) > 0)
        keep = F.when(F.size(chain) < 2, F.size(chain)).otherwise(F.coalesce(F.array_max(last), F.lit(0)) + 1)
        return F.concat(F.slice(chain, F.lit(1), keep), F.array(p))

    chain = lambda a: F.aggregate(a, F.slice(a, F.lit(1), F.lit(0)), add)
    open_end = lambda c: F.slice(c, F.lit(1), F.greatest(F.size(c) - 1, F.lit(1)))
    return F.array_distinct(F.concat(open_end(chain(points)), open_end(chain(F.reverse(points)))))


def spans(points: DataFrame, keys: list[str]) -> DataFrame:
    """For each group of points (x, y): n, the corners of their convex hull, and the greatest distance between two of them.

    Of the points in one column only the two ends can be corners, so a first aggregate, combined before the shuffle, leaves two
    points a column; the hull is found among these, and only corners are compared with each other. Null points don't count.
    """
    known = points.filter("x is not null and y is not null")
    ends = known.groupBy(*keys, F.col("x").cast("double").alias("x")).agg(F.count("*").alias("_n"), F.min(F.col("y").cast("double")).alias("_a"), F.max(F.col("y").cast("double")).alias("_b"))
    each = F.explode(F.array_distinct(F.array(F.struct("x", F.col("_a").alias("y"), F.col("_n").alias("n")), F.struct("x", F.col("_b").alias("y"), F.lit(0).cast("long").alias("n")))))
    flat = ends.select(*keys, each.alias("p"))
    sets = flat.groupBy(*keys).agg(F.sum("p.n").alias("n"), F.array_distinct(F.sort_array(F.collect_list(F.struct("p.x", "p.y")))).alias("_points"))
    cornered = sets.select(*keys, "n", hull(F.col("_points")).alias("_hull"))
    far = lambda c, p: F.array_max(F.transform(c, lambda q: F.hypot(p["x"] - q["x"], p["y"] - q["y"])))
    return cornered.select(*keys, "n", F.size("_hull").cast("long").alias("corners"), F.array_max(F.transform("_hull", lambda p: far(F.col("_hull"), p))).alias("span"))


def axis_roughness(px: DataFrame, key: str, bins: int = 40, least: int = 200, points: int = 5, filled: int = 8) -> DataFrame:
    """How uneven each shape's width is along its principal axis: the mean size of second differences of its widths over their
    median, from ``bins`` equal parts of the axis; -1 for fewer than ``least`` pixels, ``filled`` parts of ``points`` pixels or a
    shape without extent.

    The axis is the larger eigenvector of the second moments, in closed form, pointing right (or down).
    """
    x, y = F.col("x").cast("double"), F.col("y").cast("double")
    m = px.groupBy(key).agg(F.count("*").alias("_n"), F.avg(x).alias("_mx"), F.avg(y).alias("_my"), F.var_pop(x).alias("_a"), F.covar_pop(x, y).alias("_b"), F.var_pop(y).alias("_c"))
    top = (F.col("_a") + F.col("_c")) / 2 + F.hypot((F.col("_a") - F.col("_c")) / 2, F.col("_b"))
    skewed = F.abs("_b") > 1e-9
    ux = F.when(skewed, F.col("_b")).when(F.col("_a") >= F.col("_c"), F.lit(1.0)).otherwise(F.lit(0.0))
    uy = F.when(skewed, top - F.col("_a")).when(F.col("_a") >= F.col("_c"), F.lit(0.0)).otherwise(F.lit(1.0))
    axes = m.withColumns({"_ux": ux, "_uy": uy})
    length = F.hypot("_ux", "_uy") * F.when(F.col("_ux") < 0, F.lit(-1.0)).otherwise(F.lit(1.0))
    axes = axes.select(key, "_n", "_mx", "_my", (F.col("_ux") / length).alias("_ux"), (F.col("_uy") / length).alias("_uy"))
    dx, dy = x - F.col("_mx"), y - F.col("_my")
    on = px.select(key, "x", "y").join(axes, key).select(key, "_n", F.round(dx * F.col("_ux") + dy * F.col("_uy"), 9).alias("_t"), F.round(dy * F.col("_ux") - dx * F.col("_uy"), 9).alias("_s"))
    ends = on.groupBy(key).agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    part = F.least(F.floor((F.col("_t") - F.col("_low")) / (F.col("_high") - F.col("_low")) * bins + 1e-9), F.lit(bins - 1))
    cut = on.join(ends, key).withColumn("_bin", F.when(F.col("_high") - F.col("_low") > 1e-6, part).otherwise(F.lit(0)))
    widths = cut.groupBy(key, "_n", "_bin").agg(F.count("*").alias("_k"), (F.max("_s") - F.min("_s")).alias("_w")).filter(F.col("_k") >= points)
    rows = widths.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(F.struct("_bin", "_w"))), lambda p: p["_w"]).alias("w"), F.percentile("_w", 0.5).alias("_median"))
    second = F.transform(F.slice(F.sequence(F.lit(0), F.greatest(F.size("w"), F.lit(1)) - 1), F.lit(1), F.greatest(F.size("w") - 2, F.lit(0))), lambda i: F.abs(F.get("w", i) - 2 * F.get("w", i + 1) + F.get("w", i + 2)))
    rough = reduce(lambda a, f: f(a), [lambda s: F.aggregate(s, F.lit(0.0), lambda a, v: a + v), lambda s: s / F.greatest(F.size(second), F.lit(1)) / F.col("_median")], second)
    ok = (F.col("_n") >= least) & (F.size("w") >= F.greatest(F.lit(filled), F.lit(3))) & (F.col("_median") >= 1e-6)
    return m.select(key, "_n").join(rows, key, "left").select(key, F.col("_n").alias("n"), F.when(F.coalesce(ok, F.lit(False)), rough).otherwise(F.lit(SENTINEL)).alias("roughness"))
