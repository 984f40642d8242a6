"""Small cases with known answers: edge cases of joins, ranks, metrics, kernels, sources and streams."""

import math
import random
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from frond.functions import scalars
from frond.operators import index, joins, kernels, metrics, ml, project, ranks, stats, windows
from frond.sources import images, tables
from frond.streaming import events

NAN = float("nan")


def one(df):
    return df.collect()[0]


def test_worst_side_keeps_nan_of_the_first(spark):
    df = spark.createDataFrame([(1, 1.0, NAN), (2, NAN, 1.0), (3, 1.0, 2.0), (4, 2.0, 1.0), (5, -1.0, 0.5)], "k int, a double, b double")
    got = {r.k: r.w for r in df.select("k", scalars.worst_side(F.col("a"), F.col("b")).alias("w")).collect()}
    assert got[1] == 1.0 and math.isnan(got[2]) and (got[3], got[4], got[5]) == (2.0, 2.0, 0.5)


def test_clip_and_histogram_edges(spark):
    df = spark.createDataFrame([(NAN,), (None,), (9.0,), (-9.0,), (180.0,)], "x double")
    assert [r[0] for r in df.select(scalars.clip(F.col("x"), -5.0, 5.0)).collect()] == [0.0, 0.0, 5.0, -5.0, 5.0]
    assert df.filter("x = 180").select(scalars.histogram_bin(F.col("x"), 0.0, 180.0, 36)).first()[0] == 36


def test_percent_text_and_top_two(spark):
    df = spark.createDataFrame([("87%",), ("0.87",), ("87",), ("x",)], "t string")
    assert [r[0] for r in df.select(scalars.percent_text(F.col("t"))).collect()] == [0.87, 0.87, 0.87, None]
    assert spark.range(1).select(scalars.top_two(F.array(F.lit(0.2), F.lit(0.4), F.lit(0.4)), F.array(F.lit("a"), F.lit("b"), F.lit("c")))).first()[0] == ["b", "c"]
    assert spark.range(1).select(scalars.first_best(F.array(F.lit(1), F.lit(3), F.lit(3)))).first()[0] == 2


def test_softmax_and_angles(spark):
    p = spark.range(1).select(scalars.softmax(F.array(F.lit(1.0), F.lit(2.0)), 0.2), scalars.angle(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(2.0)), scalars.angle(F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(1.0))).first()
    assert sum(p[0]) == pytest.approx(1) and p[0][1] == pytest.approx(1 / (1 + math.exp(-5))) and p[1] == pytest.approx(90) and p[2] == 0


def test_unknown_level_raises(spark):
    df = spark.createDataFrame([("healthy",), (None,)], "l string")
    assert [r[0] for r in df.select(project.strict_lookup(F.col("l"), project.LEVELS)).collect()] == ["healthy", None]
    with pytest.raises(Exception, match="unknown"):
        spark.createDataFrame([("odd",)], "l string").select(project.strict_lookup(F.col("l"), project.LEVELS)).collect()


def test_fusion_needs_both_views(spark):
    a = spark.createDataFrame([(1, 2.0), (2, -1.0)], "k int, f double")
    b = spark.createDataFrame([(2, 3.0), (3, 1.0)], "k int, f double")
    assert [tuple(r) for r in joins.fused_views(a, b, "k", ["f"]).collect()] == [(2, -1.0, 3.0, 3.0)]
    assert sorted(tuple(r) for r in joins.unmatched(a, b, "k").collect()) == [(1, "bottom"), (3, "top")]


def test_aligned_predictions_raise_on_a_missing_key(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, p string")
    b = spark.createDataFrame([(1, "x")], "k int, q string")
    with pytest.raises(Exception, match="no pair for 2"):
        joins.aligned_predictions(a, b, "k", "k").collect()


def test_contained_short_and_long_items(spark):
    items = spark.createDataFrame([(1, "b c"), (2, "one two three four five six seven eight nine"), (3, "zz")], "i int, t string")
    docs = spark.createDataFrame([("a b c d",), ("so one two three four five six seven eight nine.",), (None,)], "t string")
    assert sorted(r[0] for r in joins.contained(items, "i", docs, "t", 6).collect()) == [1, 2]


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(-3, 6)), min_size=1, max_size=60))
def test_ranks_and_quantiles(spark, rows):
    df = spark.createDataFrame([(g, float(v)) for g, v in rows], "g string, v double")
    r = ranks.ranked(ranks.value_counts(df, ["g"], "v"), ["g"], "v", ranges=4)
    got = {(x.g, x.v): (x.rank, x.total) for x in r.collect()}
    for (g, v), (rank, total) in got.items():
        own = sorted(b for a, b in rows if a == g)
        assert total == len(own) and rank == sum(b < v for b in own) + (sum(b == v for b in own) + 1) / 2
    for x in ranks.quantiles(r, ["g"], "v", {"q": 0.25}).collect():
        assert x.q == pytest.approx(float(np.quantile([b for a, b in rows if a == x.g], 0.25)))


def test_auc_is_mirrored(spark):
    rnd = random.Random(3)
    df = spark.createDataFrame([(float(rnd.randint(0, 9)), rnd.random() < 0.4) for _ in range(200)], "x double, y boolean")
    a = one(stats.auc(df, [], "x", F.col("y"))).auc
    assert a == pytest.approx(1 - one(stats.auc(df.withColumn("x", -F.col("x")), [], "x", F.col("y"))).auc)
    assert one(stats.auc(df.filter("y"), [], "x", F.col("y"))).auc is None


def test_baseline_guards(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 5.0), ("b", 5.0), ("b", 5.0), ("c", 1.0), ("c", 2.0), ("c", 4.0)], "g string, v double")
    got = {r.g: (r.n, r.median, r.iqr) for r in stats.baseline(df, "g", "v", F.lit(True)).collect()}
    assert got == {"a": (2, None, None), "b": (3, 5.0, None), "c": (3, 2.0, 1.5)}


def test_trimmed_mean(spark):
    v = [float(x) for x in (1, 1, 2, 3, 4, 5, 6, 7, 8, 100)]
    df = spark.createDataFrame([("a", x) for x in v], "g string, v double")
    assert one(stats.trimmed_mean(df, ["g"], "v")).trimmed_mean == pytest.approx(statistics.mean(sorted(v)[1:-1]))


def test_mcnemar_and_agreement(spark):
    assert metrics.mcnemar_p(0, 0) == 1.0 and metrics.mcnemar_p(1, 5) == pytest.approx(0.21875)
    df = spark.createDataFrame([(True, True), (False, False)], "a boolean, b boolean")
    r = one(metrics.agreement(df, F.col("a"), F.col("b")))
    assert (r.q, r.disagreement) == (1.0, 0.0)


def test_threshold_takes_the_first_best(spark):
    df = spark.createDataFrame([(0.2, False), (0.9, True)], "p double, y boolean")
    best = one(metrics.best_threshold(metrics.threshold_sweep(df, "p", F.col("y"), [0.3, 0.5, 0.7])))
    assert (best.t, best.f1_macro) == (0.3, 1.0)


def test_percent_rank_of_ties(spark):
    df = spark.createDataFrame([("g", x) for x in (1, 2, 2, 5)], "g string, v int")
    assert sorted(r.pct for r in windows.percent_rank(df, ["g"], "v").collect()) == [25.0, 62.5, 62.5, 100.0]


def test_resampled_path(spark):
    df = spark.createDataFrame([("g", 0, 0.0, 0.0), ("g", 1, 3.0, 0.0), ("g", 2, 3.0, 6.0)], "g string, i int, x double, y double")
    got = {r.i: (round(r.x, 6), round(r.y, 6)) for r in windows.resampled(df, ["g"], "i", "x", "y", 4).collect()}
    assert got == {0: (0.0, 0.0), 1: (3.0, 0.0), 2: (3.0, 3.0), 3: (3.0, 6.0)}


def test_breakdown_sums_to_a_hundred(spark):
    long = spark.createDataFrame([(1, "a", 3.0), (1, "b", 1.0), (1, "c", -4.0), (2, "a", -1.0)], "k int, feature string, value double")
    got = {(r.k, r.feature): r.percentage for r in index.breakdown(long, "k", F.lit(1.0)).collect()}
    assert got == {(1, "a"): 75.0, (1, "b"): 25.0, (1, "c"): 0.0, (2, "a"): 0.0}


def test_non_negative_ridge(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [2.0, 1.0, -3.0]
    df = spark.createDataFrame([(*map(float, r), float(t)) for r, t in zip(x, y)], "a double, b double, c double, y double")
    w = index.non_negative_ridge(df, ["a", "b", "c"], "y")
    assert w["c"] == 0.0 and sum(w.values()) == pytest.approx(1) and w["a"] > w["b"] > 0


def flood(mask):
    left, n, sizes = {(y, x) for y, x in zip(*np.nonzero(mask))}, 0, []
    while left:
        todo, size = [left.pop()], 0
        while todo:
            y, x = todo.pop()
            size += 1
            for p in [(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]:
                if p in left:
                    left.remove(p)
                    todo.append(p)
        sizes.append(size)
        n += 1
    return n, sorted(sizes)


def test_components_against_flooding():
    rng = np.random.default_rng(5)
    for _ in range(60):
        mask = rng.random((rng.integers(1, 14), rng.integers(1, 14))) < 0.45
        labels, n = kernels.labelled(mask)
        assert (n, sorted(np.bincount(labels.ravel())[1:].tolist())) == flood(mask)


def test_morphology_and_shapes():
    ring = np.zeros((9, 9), bool)  # a margin of two: outside the image counts as neither for erosion nor for dilation
    ring[2:7, 2:7] = True
    ring[4, 4] = False
    assert kernels.filled(ring).sum() == 25 and kernels.closed(ring).sum() == 25
    area, perimeter, holes, extent, solidity, aspect, hu = kernels.shape_stats(ring.astype(float))
    assert (area, perimeter, holes, extent, aspect) == (24, 20, 1, 24 / 25, 1.0) and solidity == pytest.approx(24 / 25)
    assert kernels.invariants(ring) == pytest.approx(kernels.invariants(np.rot90(ring)))
    assert kernels.grown(ring, ring | True, 1).sum() > ring.sum()
    assert kernels.without_small(ring, 25).sum() == 0


def test_letterbox_and_patterns():
    image, scale, top, left = kernels.letterboxed(np.full((2, 4), 7.0), 8)
    assert image.shape == (8, 8) and scale == 2 and (top, left) == (2, 0) and (image[2:6] == 7).all() and (image[:2] == 255).all()
    share, entropy = kernels.lbp_stats(np.ones((5, 5)))
    assert share[8] == 1.0 and entropy == 0.0


def test_csv_falls_back_to_its_other_encoding(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("name,n\nMüller €,1\n".encode("cp1252"))
    (tmp_path / "b.csv").write_bytes("name,n\nMüller €,1\n".encode())
    for f in ("a.csv", "b.csv"):
        assert one(tables.read_csv(spark, str(tmp_path / f), "name string, n int", ("name",))).name == "Müller €"
    with pytest.raises(ValueError, match="missing"):
        tables.read_csv(spark, str(tmp_path / "b.csv"), "name string, n int", ("other",))


def test_image_scan_and_decoding(spark, tmp_path):
    for species, level, view, name in (("a", "healthy", "Top", "x.ppm"), ("a", "odd", "Top", "y.ppm"), ("b", "damaged_low", "bottom", "test_z.ppm")):
        d = tmp_path / species / level / view
        d.mkdir(parents=True)
        (d / name).write_bytes(b"P6 2 1 255\n" + bytes([1, 2, 3, 4, 5, 6]))
    (tmp_path / "b" / "damaged_low" / "bottom" / "bad.ppm").write_bytes(b"nothing")
    files = images.scan(spark, str(tmp_path), content=True)
    rows = images.with_labels(files, project.LEVELS).select("species", "level", "view", "file", images.decode_pnm(F.col("content")).alias("i")).collect()
    got = {(r.species, r.level, r.view, r.file): (r.i.height, r.i.width, bytes(r.i.data) if r.i.data is not None else None) for r in rows}
    assert got == {("a", "healthy", "top", "x.ppm"): (1, 2, bytes([3, 2, 1, 6, 5, 4])), ("b", "low", "bottom", "test_z.ppm"): (1, 2, bytes([3, 2, 1, 6, 5, 4])), ("b", "low", "bottom", "bad.ppm"): (None, None, None)}
    assert files.filter(images.is_test(F.col("path"), any_case=False)).count() == 1
    good, bad = images.split_uploads(files.select("path", "length"))
    assert good.count() == 0 and bad.count() == 4


def test_stream_equals_batch(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.parquet(str(tmp_path / "in"))
    q = events.to_folder(events.tumbling(events.read(spark, str(tmp_path / "in")), "1 day", "1000 days"), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination(120)
    closed = spark.read.schema("start timestamp, end timestamp, event_type string, n long, total double").parquet(str(tmp_path / "out"))
    assert closed.count() == 0  # the watermark has not passed
    q = events.to_folder(events.tumbling(events.read(spark, str(tmp_path / "in")), "1 day", "0 seconds"), str(tmp_path / "out2"), str(tmp_path / "check2"))
    q.awaitTermination(120)
    got = {(r.start, r.event_type): r.n for r in spark.read.parquet(str(tmp_path / "out2")).collect()}
    batch = {(r.start, r.event_type): r.n for r in events.tumbling(e, "1 day").collect()}
    assert got and all(batch[k] >= n for k, n in got.items())


def test_out_of_fold_never_sees_a_group(spark):
    df = spark.createDataFrame([(i, i % 6, float(i % 2), "ab"[i % 2]) for i in range(60)], "id int, leaf int, x double, label string")
    oof = ml.out_of_fold(df, ["x"], "label", "leaf", lambda: ml.linear(), folds=2)
    assert oof.count() == 60 and oof.filter("label <> predicted").count() == 0
    assert oof.groupBy("leaf").agg(F.countDistinct("fold").alias("n")).filter("n > 1").count() == 0


def test_skeleton_keeps_pieces_and_is_thin():
    rng = np.random.default_rng(8)
    bar = np.zeros((9, 20), bool)
    bar[3:6, 2:18] = True
    line = kernels.thinned(bar)
    assert kernels.labelled(line)[1] == 1 and line.sum(axis=0).max() == 1 and line.sum() >= 12
    for _ in range(20):
        mask = kernels.dilated(rng.random((12, 12)) < 0.1)
        assert kernels.labelled(kernels.thinned(mask))[1] == kernels.labelled(mask)[1]


def test_gradients_gabor_and_equalisation():
    ramp = np.tile(np.arange(8.0), (8, 1))
    share, mean, std, entropy, laplacian = kernels.gradient_stats(ramp)
    assert share[0] == 1.0 and entropy == 0.0
    stripes = np.tile([1.0, 1.0, -1.0, -1.0], (12, 3))
    bank = np.array(kernels.gabor_bank(stripes, waves=(4.0,), turns=2)[0]).reshape(2, 2)
    assert bank[0, 1] > 3 * bank[1, 1]
    out = kernels.equalised(np.random.default_rng(1).random((16, 16)))
    assert 0 <= out.min() and out.max() <= 1 + 1e-9 and kernels.equalised(np.ones((4, 4))).std() == 0
