"""Components of graphs and pixels, hulls and profiles of shapes against plain versions."""

import math
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frond.operators import components


def union_find(nodes, edges):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in edges:
        if a in top and b in top:
            a, b = sorted((find(a), find(b)))
            top[b] = a
    return {n: find(n) for n in nodes}


def test_random_graphs_and_long_chains(spark):
    deal = random.Random(8)
    graphs = {
        "sparse": (range(200), [(deal.randrange(200), deal.randrange(200)) for _ in range(120)]),
        "chain": (range(300), [(i, i + 1) for i in range(299)]),
        "turned": (range(300), [(i * 7 % 300, (i + 1) * 7 % 300) for i in range(299)]),
        "star": (range(50), [(49, i) for i in range(49)]),
        "odd": ([5, 5, 9, -3], [(5, 5), (5, 9), (9, 5), (9, 77)]),
        "lone": ([1], []),
    }
    nodes = spark.createDataFrame([(g, n) for g, (ns, _) in graphs.items() for n in ns] + [("lone", None)], "g string, node long")
    edges = spark.createDataFrame([(g, a, b) for g, (_, es) in graphs.items() for a, b in es], "g string, a long, b long")
    got = {(r.g, r.node): r.component for r in components.connected(nodes, edges, ["g"]).collect()}
    assert got == {(g, n): c for g, (ns, es) in graphs.items() for n, c in union_find(set(ns), es).items()}
    assert components.connected(nodes.limit(0), edges, ["g"]).isEmpty()


def test_a_hot_parent_is_looked_up_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_LEAST", 10)
    nodes = spark.range(500).select(F.lit("g").alias("g"), F.col("id").alias("node"))
    edges = nodes.select("g", F.lit(0).cast("long").alias("a"), F.col("node").alias("b"))
    assert components.connected(nodes, edges, ["g"]).select("component").distinct().collect() == [(0,)]


def grids():
    deal = random.Random(2)
    return {k: {(y, x): round(deal.random(), 3) for y in range(n) for x in range(m) if deal.random() < p} for k, (n, m, p) in enumerate([(9, 9, 0.5), (12, 5, 0.35), (1, 30, 0.7), (20, 20, 0.45), (4, 4, 0.0), (15, 15, 0.6)])}


@pytest.fixture(scope="module")
def px(spark):
    return spark.createDataFrame([(k, y, x, v) for k, g in grids().items() for (y, x), v in g.items()], "img long, y int, x int, v double")


def plain_labels(grid):
    near = [(a, b) for a, b in combinations(sorted(grid), 2) if max(abs(a[0] - b[0]), abs(a[1] - b[1])) <= 1]
    return union_find(set(grid), near)


def test_labels_of_grids(px):
    got = {(r.img, (r.y, r.x)): divmod(r.component, components.WIDTH) for r in components.labelled(px, "img").collect()}
    assert got == {(k, p): c for k, g in grids().items() for p, c in plain_labels(g).items()}


def test_blobs(px):
    for r in components.blobs(components.labelled(px, "img"), "img").collect():
        own = [p for p, c in plain_labels(grids()[r.img]).items() if c == divmod(r.component, components.WIDTH)]
        ys, xs = zip(*own)
        assert (r.area, r.top, r.left, r.height, r.width) == (len(own), min(ys), min(xs), max(ys) - min(ys) + 1, max(xs) - min(xs) + 1)


def test_enclosed_fraction(spark):
    full = {k: {(y, x): random.Random(k * 999 + y * 40 + x).random() for y in range(12) for x in range(12)} for k in range(6)}
    table = spark.createDataFrame([(k, y, x, v) for k, g in full.items() for (y, x), v in g.items()] + [(9, 0, 0, 0.0), (10, 0, 0, None)], "img long, y int, x int, v double")
    got = {r.img: r for r in components.enclosed_fraction(table, "img", F.col("v") > 0.12, F.col("v") > 0.6, 20).collect()}
    met = 0
    for k, g in full.items():
        lamina = {p: v for p, v in g.items() if 0.12 < v <= 0.6}
        outside = [p for p, v in g.items() if v <= 0.12]
        labels = plain_labels(lamina)
        touched = {c for p, c in labels.items() if any(max(abs(p[0] - q[0]), abs(p[1] - q[1])) <= 1 for q in outside)}
        inside = sum(c not in touched for c in labels.values())
        met += inside > 0
        assert (got[k].lamina, got[k].enclosed, got[k].fraction) == (len(lamina), inside, pytest.approx(inside / len(lamina)))
    assert met > 1 and got[9].fraction == got[10].fraction == -1.0


@pytest.mark.parametrize("passes", [1, 2, None])
def test_small_regions_beside_dark_ones_are_promoted(px, passes):
    offsets = [(i, j) for i, j in components.square(2) if abs(i) + abs(j) <= 2]
    low = px.filter("v < 0.8")
    got = {(r.img, divmod(r.component, components.WIDTH)): (r.area, r.median, r.state) for r in components.shadow_regions(low, "img", "v", 6, 0.45, 5, offsets, passes).collect()}
    want = {}
    for k, g in grids().items():
        own = {p: v for p, v in g.items() if v < 0.8}
        parts = defaultdict(list)
        for p, c in plain_labels(own).items():
            parts[c].append(p)
        median = {c: float(np.median([own[p] for p in ps])) for c, ps in parts.items()}
        state = {c: "dark" if len(ps) >= 6 and median[c] < 0.45 else "kept" for c, ps in parts.items()}
        turn = 0
        while passes is None or turn < passes:
            turn += 1
            reached = {(y + i, x + j) for c, s in state.items() if s != "kept" for y, x in parts[c] for i, j in offsets}
            new = [c for c, s in state.items() if s == "kept" and len(parts[c]) < 5 and reached & set(parts[c])]
            if not new:
                break
            state |= dict.fromkeys(new, "promoted")
        want |= {(k, c): (len(ps), pytest.approx(median[c]), state[c]) for c, ps in parts.items()}
    assert got == want and {s for _, _, s in want.values()} == {"dark", "promoted", "kept"}


def test_left_right(px):
    got = {r.img: (r.n, r.share, r.balance) for r in components.left_right(components.labelled(px, "img"), "img", 2).collect()}
    for k, g in grids().items():
        parts = defaultdict(list)
        for p, c in plain_labels(g).items():
            parts[c].append(p)
        if not parts:
            assert k not in got
            continue
        big = [(len(ps), min(x for _, x in ps) + (max(x for _, x in ps) - min(x for _, x in ps) + 1) / 2) for ps in parts.values() if len(ps) > 2]
        share = 0.5
        if len(big) > 1:
            mid = float(np.median([c for _, c in big]))
            share = sum(a for a, c in big if c < mid) / sum(a for a, _ in big)
        assert got[k] == (len(big), pytest.approx(share), pytest.approx(1 - 2 * abs(share - 0.5)))


def test_ellipses():
    assert components.ellipse(3) == [(-1, 0), (0, -1), (0, 0), (0, 1), (1, 0)]
    full = components.ellipse(11)
    assert len(full) == 89 and all((-i, j) in full and (i, -j) in full for i, j in full)


def test_spans_are_those_of_all_pairs(spark):
    deal = random.Random(6)
    sets = [[(deal.randrange(n), deal.randrange(n)) for _ in range(deal.randrange(1, 60))] for n in (2, 3, 8, 30, 200) for _ in range(8)]
    sets += [[(i, i) for i in range(9)], [(3, i) for i in range(9)], [(1, 1)], [(1, 1)] * 4, [(x, y) for x in range(7) for y in range(7)]]
    rows = [(k, float(x), float(y)) for k, s in enumerate(sets) for x, y in s] + [(0, None, 1.0)]
    got = {r.k: r for r in components.spans(spark.createDataFrame(rows, "k long, x double, y double"), ["k"]).collect()}
    for k, s in enumerate(sets):
        assert got[k].n == len(s) and got[k].span == pytest.approx(max((math.dist(a, b) for a, b in combinations(s, 2)), default=0.0))
    assert [got[len(sets) - i].corners for i in range(1, 6)] == [4, 1, 1, 2, 2]


def plain_roughness(points, bins, least, per, filled):
    p = np.array(points, float)
    if len(p) < least:
        return -1.0
    c = np.cov(p.T, bias=True)
    axis = np.linalg.eigh(c)[1][:, 1]
    if axis[0] < 0:
        axis = -axis
    q = p - p.mean(axis=0)
    t, s = np.round(q @ axis, 9), np.round(q @ np.array([-axis[1], axis[0]]), 9)
    at = np.minimum(np.floor((t - t.min()) / (t.max() - t.min()) * bins + 1e-9), bins - 1)
    w = np.array([np.ptp(s[at == b]) for b in range(bins) if (at == b).sum() >= per])
    return float(np.abs(np.diff(w, 2)).mean() / np.median(w)) if len(w) >= filled else -1.0


def test_roughness_of_rotated_shapes(spark):
    deal = random.Random(1)
    shapes = {}
    for k, turn in enumerate((0.0, 0.4, 1.1, 2.0, 2.9)):
        body = [(deal.uniform(-40, 40), deal.uniform(-1, 1)) for _ in range(900)]
        body = [(x, y * (8 + 4 * math.sin(x / 6))) for x, y in body]
        shapes[k] = [(x * math.cos(turn) - y * math.sin(turn) + 100, x * math.sin(turn) + y * math.cos(turn) + 70) for x, y in body]
    shapes |= {10: [(1.0, 1.0)] * 300, 11: [(0.0, 1.0), (2.0, 5.0)]}
    rows = [(k, y, x) for k, s in shapes.items() for x, y in s]
    got = {r.img: r.roughness for r in components.axis_roughness(spark.createDataFrame(rows, "img long, y double, x double"), "img", 20, 50, 5, 8).collect()}
    assert got[10] == got[11] == -1.0
    for k in range(5):
        assert got[k] == pytest.approx(plain_roughness(shapes[k], 20, 50, 5, 8), rel=1e-6) and got[k] > 0


def test_tiles_join_and_little_reaches_the_driver(spark, monkeypatch):
    wide = {(y, x) for y in range(70) for x in range(70) if y in (31, 64) or x == 66 or (y + 2 * x) % 7 == 0 and (x * y) % 3}
    images = {1: wide, 2: {(31, 31), (32, 32), (32, 30), (0, 0)}, 3: {(-1, -1), (0, 0), (0, 5)}}
    rows = [(k, y, x, float(y)) for k, img in images.items() for y, x in img]
    px = spark.createDataFrame([*rows, rows[0], (None, 1, 1, 0.0), (2, None, 1, 0.0)], "img long, y int, x int, v double")
    found = components.labelled(px, "img").collect()
    assert sorted((r.img, r.y, r.x, r.v) for r in found) == sorted([*rows, rows[0]])
    for k, img in images.items():
        left, want = set(img), {}
        while left:
            part, new = set(), {min(left)}
            while new:
                part |= new
                new = {(y + i, x + j) for y, x in new for i in (-1, 0, 1) for j in (-1, 0, 1)} & left - part
            want |= dict.fromkeys(part, min(y * components.WIDTH + x for y, x in part))
            left -= part
        assert {(r.y, r.x): r.component for r in found if r.img == k} == want
    # small images need no round of the loop, and no table of pixels is sent whole through the driver
    monkeypatch.setattr(components, "connected", None)
    small = components.labelled(spark.range(200).selectExpr("id as img", "explode(sequence(0, 63)) as p").selectExpr("img", "p div 8 as y", "p % 8 as x").filter("(img + y * x) % 3 > 0"), "img")
    assert "Join" not in small._jdf.queryExecution().optimizedPlan().toString()


def test_enclosed_fraction_broadcasts_nothing(spark):
    px = spark.range(300).selectExpr("id as img", "explode(sequence(0, 63)) as p").selectExpr("img", "p div 8 as y", "p % 8 as x", "(img * 7 + p * p) % 11 as v")
    found = components.enclosed_fraction(px, "img", F.col("v") > 2, F.col("v") > 8, 10)
    assert len(found.collect()) == 300
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
