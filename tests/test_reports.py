"""Reports against plain versions on small tables with missing values, empty levels and ties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from frond.operators import project, reports, stats

ORDER = ["healthy", "low", "mid", "high"]


def table(seed=2):
    deal = random.Random(seed)
    rows = []
    for g in ("a", "b", "few", "flat"):
        for f in ("x", "y"):
            for level in ORDER[: 3 if g == "b" else 4]:
                for _ in range(2 if g == "few" else 9):
                    v = 4.0 if g == "flat" and f == "x" else round(deal.gauss(ORDER.index(level), 1.0), 1)
                    rows.append((g, level, f, None if deal.random() < 0.1 else float("nan") if deal.random() < 0.1 else v))
    return rows + [("none", "low", "x", None), ("a", "other", "x", 50.0), ("a", None, "x", 60.0)]


def test_gap_report_and_weak_features(spark):
    rows = table()
    report = reports.gap_report(spark.createDataFrame(rows, "g string, level string, feature string, value double"), "g", "level", ORDER).cache()
    got = {(r.g, r.feature): r for r in report.collect()}
    weak = {}
    for g in ("a", "b", "few", "flat"):
        for f in ("x", "y"):
            own = [(lv, v) for k, lv, c, v in rows if (k, c) == (g, f) and v is not None and v == v]
            of = {lv: [v for x, v in own if x == lv] for lv in ORDER}
            r = got[g, f]
            assert (r.n_healthy, r.n_high) == (len(of["healthy"]), len(of["high"]))
            for lv in ORDER:
                assert r[f"median_{lv}"] == (pytest.approx(float(np.median(of[lv])), abs=6e-4) if of[lv] else None)
            base = of["healthy"] if len(of["healthy"]) >= 3 else [v for _, v in own]
            spread = float(np.subtract(*np.percentile(base, [75, 25])))
            effect = (np.median(of["high"]) - np.median(of["healthy"])) / spread if spread > 1e-6 and of["high"] and of["healthy"] else None
            assert r.effect == (None if effect is None else pytest.approx(effect, abs=6e-3))
            weak[g] = weak.get(g, 0) + (r.effect is not None and abs(r.effect) < 0.5)
    assert ("none", "x") not in got and got["flat", "x"].effect is None and got["b", "x"].effect is None
    assert {r.g: r.n_weak for r in reports.weak_features(report, "g").collect()} == {g: n for g, n in weak.items() if n}


def test_column_audit(spark):
    deal = random.Random(3)
    rows = []
    for i in range(60):
        level = ORDER[i % 4]
        rows += [(level, "same", 3.0), (level, "mostly", -1.0 if i % 3 else float(i)), (level, "holes", None if i % 2 else float("nan") if i % 10 == 0 else float(i)), (level, "trend", i % 4 + deal.random()), (level, "nothing", None)]
    rows += [("healthy", "few", float(i)) for i in range(4)] + [("unknown", "trend", 9.0)]
    got = {r.feature: r for r in reports.column_audit(spark.createDataFrame(rows, "level string, feature string, value double"), "level", ORDER).collect()}
    assert got["same"].flags == "CONSTANT" and got["same"].rho is None and got["nothing"].flags == "CONSTANT,HIGH-NAN"
    assert got["mostly"].flags.startswith("MOSTLY-SENTINEL") and got["mostly"].sentinel_pct == pytest.approx(200 / 3) and got["mostly"].n_distinct == 21
    assert "HIGH-NAN" in got["holes"].flags and got["holes"].null_pct == pytest.approx(60.0)
    assert got["trend"].flags == "ok" and got["trend"].rho > 0.9 and got["trend"].p < 1e-6 and got["few"].rho is None


def test_ranked_features_and_vote_impact(spark):
    long = spark.createDataFrame([(lab, f, v * k) for f, k in (("big", 9.0), ("small", 0.1), ("none", 0.0)) for lab, vs in (("a", (1, 2, 3)), ("b", (4, 5, 7))) for v in vs] + [(lab, "less", float(v)) for lab, v in (("a", 1), ("a", 9), ("b", 2), ("b", 10))], "lab string, feature string, value double")
    got = [(r.place, r.feature) for r in reports.ranked_features(long, "lab", "a", "b", 2).orderBy("place").collect()]
    assert got == [(1, "big"), (2, "small")]
    deal = random.Random(4)
    rows = [(deal.choice("uvw"), *[[deal.random() for _ in range(3)] for _ in range(3)]) for _ in range(80)]
    r = reports.vote_impact(spark.createDataFrame(rows, "t string, a array<double>, b array<double>, c array<double>"), ["a", "b", "c"], "b", list("uvw"), "t").first()
    full = ["uvw"[int(np.argmax(np.sum(p, axis=0)))] for _, *p in rows]
    part = ["uvw"[int(np.argmax(np.array(a) + np.array(c)))] for _, a, _, c in rows]

    def f1(pred):
        out = []
        for k in "uvw":
            t, p, hit = sum(x[0] == k for x in rows), pred.count(k), sum(x[0] == y == k for x, y in zip(rows, pred))
            out.append(2 * hit / (t + p) if t + p else 0.0)
        return np.mean(out)

    assert (r.n, r.n_flipped) == (80, sum(a != b for a, b in zip(full, part))) and r.n_flipped > 0
    assert (r.f1_with, r.f1_without) == (pytest.approx(f1(full)), pytest.approx(f1(part)))


def test_health_report_keeps_rows_without_predictions_and_fans_out(spark):
    scores = spark.createDataFrame([("l1", "s", "healthy", 1.0, 90.0), ("l2", "s", "high", 9.0, 10.0), ("l3", "s", "low", 3.0, 10.0), ("l4", "s", "low", 3.0, 50.0), ("l2", "t", "high", 8.0, 30.0)], "leaf_id string, species string, level string, severity_score_raw double, health_value double")
    predictions = spark.createDataFrame([("l1", "healthy", 0.1), ("l2", "unhealthy", 0.9), ("l2", "unhealthy", 0.8), ("l3", "unhealthy", 0.7)], "leaf_id string, stage1_pred string, stage1_p_unhealthy double")
    got = sorted((r.leaf_id, r.health_value, r.stage1_correct, r.health_percentile_in_group or -1) for r in reports.health_report(scores, predictions).collect())
    assert got == [("l1", 90.0, True, 100.0), ("l2", 10.0, True, 40.0), ("l2", 10.0, True, 40.0), ("l2", 30.0, True, 90.0), ("l2", 30.0, True, 90.0), ("l3", 10.0, True, 40.0), ("l4", 50.0, False, -1)]


def test_small_formulas(spark):
    df = spark.createDataFrame([(1.0,), (1.75,), (9.0,), (0.5,), (None,)], "x double")
    assert [r.g for r in df.select(reports.gradual(F.col("x")).alias("g")).collect()] == [0.0, 0.5, 1.0, 0.0, None]
    assert df.limit(1).select(reports.wax_index(F.lit(51.0), F.lit(255.0), F.lit(2.5)).alias("w")).first().w == pytest.approx((0.8 + 0.0 + 1.0) / 3)
    h = reports.density(stats.histogram(df, [], "x", 0.0, 10.0, 4), 0.0, 10.0, 4).orderBy("bin").collect()
    assert [r.density for r in h] == pytest.approx([0.3, 0, 0, 0.1]) and sum(r.density * 2.5 for r in h) == pytest.approx(1)
    px = spark.createDataFrame([("i", y, x, float(10 * y + x)) for y in range(5) for x in range(5)] + [("dot", 3, 3, 7.0)], "img string, y int, x int, v double")
    z = {r.img: (r.inner, r.outer) for r in reports.zones(px, "img", "v").collect()}
    far = [10 * y + x for y in range(5) for x in range(5) if np.hypot(y - 2, x - 2) / (np.hypot(2, 2) + 1e-6) >= 0.6]
    near = [10 * y + x for y in range(5) for x in range(5) if np.hypot(y - 2, x - 2) / (np.hypot(2, 2) + 1e-6) < 0.4]
    assert z == {"i": (pytest.approx(np.mean(near)), pytest.approx(np.mean(far))), "dot": (7.0, 0.0)}


def test_keys_and_column_sets(spark):
    df = spark.createDataFrame([("fern", 2, r"data\leaves\fern\image_01.tar.jpg"), ("x", None, "noext"), ("y", 3, "a/.hidden")], "s string, v int, path string")
    s, v, p = F.col("s"), F.col("v"), F.col("path")
    got = [tuple(r) for r in df.select(project.sample_id(s, v), project.image_key(s, F.lit("top"), p), project.leaf_key(s, F.lit("low"), p)).collect()]
    assert got == [("fern__v2", "fern_top_image_01.tar.jpg", "fern__low__image_01.tar"), (None, "x_top_noext", "x__low__noext"), ("y__v3", "y_top_.hidden", "y__low__.hidden")]
    assert len(set(project.REDUNDANT_COLOUR)) == 18 and len(project.DEAD_FEATURES) == 10 and len(project.ZERO_WEIGHT) == 3
    wide = spark.createDataFrame([(1, 2, 3)], ["colour_hsv_v_median", "colour_lab_l_median", "ldsi_miner_sub"])
    assert project.without(wide, project.REDUNDANT_COLOUR).columns == ["colour_lab_l_median", "ldsi_miner_sub"]
    assert project.without(wide, project.DEAD_FEATURES).columns == ["colour_hsv_v_median", "colour_lab_l_median"] and project.without(wide, project.ZERO_WEIGHT).columns == wide.columns
