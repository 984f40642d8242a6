"""File sinks: all or nothing; sketches within their error; tiles and grouping sets against plain versions."""

import os
import random

import pytest
from pyspark.sql import functions as F

from frond.operators import ml, sketches
from frond.sources import files


def below(folder):
    return {os.path.relpath(os.path.join(d, f), folder): open(os.path.join(d, f), "rb").read() for d, _, fs in os.walk(folder) for f in fs}


def test_files_are_written_whole_in_folders(spark, tmp_path):
    rows = [(f"k{i % 3}/f{i}.bin", bytes([i]) * i, i) for i in range(20)] + [("empty", None, 0)]
    df = spark.createDataFrame(rows, "path string, content binary, other int").repartition(5)
    at = str(tmp_path / "out")
    files.write_files(df, at)
    assert below(at) == {p: c or b"" for p, c, _ in rows}
    with pytest.raises(Exception, match="is there already"):
        files.write_files(df.limit(1), at)
    files.write_files(df.limit(1).withColumn("content", F.lit(b"new")), f"file:{at}", overwrite=True)
    assert sorted(below(at).values()).count(b"new") == 1 and len(below(at)) == 21
    files.write_files(df.limit(0), str(tmp_path / "none"))
    assert below(tmp_path / "none") == {} and [p for p in os.listdir(tmp_path) if "staging" in p] == []


@pytest.mark.parametrize("bad, said", [([("a", b"1"), ("a", b"2")], "two rows have one path"), ([("a", b"1"), ("../b", b"2")], "no path below"), ([("/abs", b"1")], "no path below"), ([("a", b"1"), ("", b"2")], "no path below")])
def test_bad_paths_leave_nothing(spark, tmp_path, bad, said):
    with pytest.raises(Exception, match=said):
        files.write_files(spark.createDataFrame(bad, "path string, content binary"), str(tmp_path / "out"))
    assert below(tmp_path) == {}


def test_a_failing_job_leaves_no_files(spark, tmp_path):
    rows = spark.range(0, 40, 1, 4).select(F.concat(F.lit("f"), "id").alias("path"), F.when(F.col("id") == 39, F.raise_error(F.lit("broken row"))).otherwise(F.lit(b"x")).cast("binary").alias("content"))
    with pytest.raises(Exception, match="broken row"):
        files.write_files(rows, str(tmp_path / "out"))
    assert below(tmp_path) == {}
    files.write_files(rows.filter("id < 39"), str(tmp_path / "out"))
    assert len(below(tmp_path / "out")) == 39


def test_a_task_that_runs_twice_counts_once(tmp_path):
    writer = files.BinaryWriter(str(tmp_path / "out"), False)
    row = {"path": "a/b", "content": b"1"}
    first, again = writer.write(iter([row])), writer.write(iter([row]))
    assert first.files != again.files
    writer.commit([again, None])  # the other attempt's file goes with the staging folder
    assert below(tmp_path) == {"out/a/b": b"1"}


def test_images_of_pixel_tables(spark, tmp_path):
    px = spark.createDataFrame([("i", 0, 0, 7.4), ("i", 1, 2, 300.0), ("j", 0, 0, None), ("j", None, 1, 5.0)], "img string, y int, x int, v double")
    files.write_images(px, "img", str(tmp_path / "pgm"))
    assert below(tmp_path / "pgm") == {"i.pgm": b"P5\n3 2\n255\n" + bytes([7, 0, 0, 0, 0, 255]), "j.pgm": b"P5\n1 1\n255\n\0"}


def test_predictions_and_models(spark, tmp_path):
    df = spark.createDataFrame([("l1", "a", "a", 0.25, [0.1]), ("l2", "a", "b", 0.75, None), ("l3", None, None, None, None)], "leaf_id string, y_pred string, y_true string, p_unhealthy double, more array<double>")
    files.write_predictions(df, str(tmp_path / "csv"))
    back = spark.read.option("header", True).csv(str(tmp_path / "csv"))
    assert back.columns == ["leaf_id", "y_true", "y_pred", "p_unhealthy", "correct", "more"]
    assert sorted((r.leaf_id, r.correct, r.more) for r in back.collect()) == [("l1", "true", "[0.1]"), ("l2", "false", None), ("l3", "true", None)]
    rows = spark.createDataFrame([(float(i), float(-i), "ab"[i % 2]) for i in range(20)], "u double, v double, label string")
    made, labels = ml.assembled(rows, ["u", "v"], "label")
    model = ml.forest(3, 2).fit(made)
    files.save_model(spark, model, str(tmp_path / "model"), threshold=0.4, labels=labels)
    loaded, facts = files.load_model(spark, str(tmp_path / "model"))
    assert facts == {"threshold": 0.4, "labels": ["a", "b"]}
    told = lambda m: [r.prediction for r in m.transform(made).orderBy("u").collect()]
    assert told(loaded) == told(model)


def test_sketches_merge_within_their_error(spark):
    df = spark.range(60_000).select((F.col("id") % 7).alias("g"), (F.col("id") % 20_011).alias("v"), F.lit("x").alias("sketchy")).unionByName(spark.createDataFrame([(0, None, "x")], "g long, v long, sketchy string"))
    own = sketches.distinct_sketches(df, ["g", "sketchy"], "v")
    for groups, exact in ((["g"], df.groupBy("g")), ([], df.groupBy())):
        want = {tuple(r)[:-1]: tuple(r)[-1] for r in exact.agg(F.countDistinct("v")).collect()}
        got = {tuple(r)[:-1]: tuple(r)[-1] for r in sketches.estimates(sketches.merged(own, groups)).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] / want[k] - 1) < 0.08 for k in want)
    assert sketches.estimates(sketches.merged(own.limit(0), [])).first()["distinct"] in (None, 0)


def test_tiles_with_heavy_ties(spark):
    deal = random.Random(3)
    rows = [("g", deal.choice([1.0, 1.0, 1.0, 2.0, deal.random()]), i) for i in range(103)] + [("h", 5.0, i) for i in range(3)] + [("h", None, 9)]
    got = {(r.g, r.i): r.tile for r in sketches.tiles(spark.createDataFrame(rows, "g string, v double, i long"), ["g"], "v", "i", 5).collect()}
    assert len(got) == len(rows) and got["h", 9] is None
    for g in "gh":
        own = sorted((v, i) for k, v, i in rows if k == g and v is not None)
        whole, extra = divmod(len(own), 5)
        want = [k + 1 for k in range(5) for _ in range(whole + (k < extra))]
        assert [got[g, i] for _, i in own] == want


def test_grouping_sets_and_trailing_frames(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("a", 2, 3.0), (None, 1, 5.0)], "k string, m int, v double")
    got = sorted(map(str, [tuple(r) for r in sketches.grouping_sets(df, ["k", "m"], [["k"], ["m"], []], {"v": F.sum("v")}).collect()]))
    assert got == sorted(map(str, [("a", None, 1, 5.0), (None, None, 1, 5.0), (None, 1, 2, 7.0), (None, 2, 2, 3.0), (None, None, 3, 10.0)]))
    e = spark.createDataFrame([("u", t, 1.0) for t in (0, 5, 10, 10, 16)], "u string, t long, v double")
    assert sorted((r.t, r.n) for r in sketches.trailing(e, ["u"], "t", 5, {"n": F.count("*")}).collect()) == [(0, 1), (5, 2), (10, 3), (10, 3), (16, 1)]
