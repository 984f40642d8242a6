"""Special functions, significance tests, series and stratified folds against plain versions."""

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from frond.functions import series, special
from frond.operators import folds, inference


def simpson(f, a, b, n=20_000):
    x = np.linspace(a, b, n + 1)
    y = f(x)
    return float((b - a) / (3 * n) * (y[0] + y[-1] + 4 * y[1:-1:2].sum() + 2 * y[2:-1:2].sum()))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def test_tails_of_distributions(spark):
    zs = [0.0, 0.1, 1.0, 1.96, 3.0, 6.0, 20.0]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select(special.normal_tails(F.col("z")).alias("p")).collect()
    assert [r.p for r in rows] == pytest.approx([math.erfc(z / math.sqrt(2)) for z in zs], rel=1e-11)
    pairs = [(x, d) for x in (0.0, 0.3, 2.0, 9.5, 60.0) for d in (1.0, 2.0, 5.0, 40.0)]
    density = lambda d: lambda x: x ** (d / 2 - 1) * np.exp(-x / 2) / (2 ** (d / 2) * math.gamma(d / 2))
    got = spark.createDataFrame(pairs, "x double, d double").select("x", "d", special.chi2_tail(F.col("x"), F.col("d")).alias("p")).collect()
    for r in got:
        want = math.erfc(math.sqrt(r.x / 2)) if r.d == 1 else simpson(density(r.d), r.x, r.x + 400)
        assert r.p == pytest.approx(want, rel=1e-6, abs=1e-15)
    student = lambda v: lambda t: math.gamma((v + 1) / 2) / math.sqrt(v * math.pi) / math.gamma(v / 2) * (1 + t * t / v) ** (-(v + 1) / 2)
    got = spark.createDataFrame([(t, v) for t in (0.0, 0.5, 2.0, 4.5) for v in (1.0, 3.0, 30.0, 150.0)], "t double, v double")
    for r in got.select("t", "v", special.t_tails(F.col("t"), F.col("v")).alias("p")).collect():
        assert r.p == pytest.approx(1 - 2 * simpson(student(r.v), 0, r.t) if r.t else 1.0, abs=1e-9)
    assert one(spark, special.normal_tails(F.lit(None).cast("double"))) is None


def test_large_shapes_and_log_gamma(spark):
    xs = [0.5, 1.0, 2.0, 7.5, 171.0, 5000.5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select(special.log_gamma(F.col("x")).alias("g")).collect()
    assert [r.g for r in rows] == pytest.approx([math.lgamma(x) for x in xs], rel=1e-12, abs=1e-13)
    near, far = (one(spark, special.t_tails(F.lit(2.5), F.lit(float(v)))) for v in (900_000, 2_000_000))
    assert near == pytest.approx(far, rel=1e-4) and far == pytest.approx(math.erfc(2.5 / math.sqrt(2)), rel=1e-4)  # stands for all above a million
    assert one(spark, special.chi2_tail(F.lit(10_000.0), F.lit(10_000.0))) == pytest.approx(0.4981, abs=1e-3)


def plain_sign_test(a, b):
    n, k = a + b, min(a, b)
    return min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0


def test_sign_test_is_the_binomial_sum(spark):
    pairs = [(0, 0), (0, 1), (3, 3), (1, 9), (12, 30), (30, 12), (400, 460), (0, 60)]
    rows = spark.createDataFrame(pairs, "a long, b long").select(special.sign_test(F.col("a"), F.col("b")).alias("p")).collect()
    assert [r.p for r in rows] == pytest.approx([plain_sign_test(a, b) for a, b in pairs], rel=1e-9)


def u_of(pos, neg):
    return sum((a > b) + (a == b) / 2 for a in pos for b in neg)


def test_mann_whitney_exact_and_approximate(spark):
    deal = random.Random(3)
    groups = {
        "few": ([1.0, 4.0, 7.0], [2.0, 3.0, 5.0, 6.0]),
        "far": ([10.0, 11.0, 12.0, 13.0], [1.0, 2.0, 3.0]),
        "ties": ([1.0, 2.0, 2.0, 5.0], [2.0, 3.0, 3.0, 9.0, 9.0]),
        "many": ([deal.random() for _ in range(40)], [deal.random() + 0.2 for _ in range(30)]),
        "same": ([1.0] * 5, [1.0] * 4),
        "alone": ([1.0, 2.0], []),
    }
    rows = [(g, s == 0, x) for g, sides in groups.items() for s in (0, 1) for x in sides[s]] + [("few", True, None)]
    got = {r.g: r for r in inference.mann_whitney(spark.createDataFrame(rows, "g string, y boolean, v double"), ["g"], "v", F.col("y")).collect()}
    assert len(got) == len(groups)
    for g, (pos, neg) in groups.items():
        r, n1, n0 = got[g], len(pos), len(neg)
        assert (r.n1, r.n0) == (n1, n0)
        if not neg:
            assert r.auc is None and r.p is None and r.cliffs_delta is None
            continue
        u = u_of(pos, neg)
        assert r.u == u and r.auc == pytest.approx(u / (n1 * n0)) and r.cliffs_delta == pytest.approx(2 * u / (n1 * n0) - 1)
        every = sorted(pos + neg)
        if g in ("few", "far"):  # count all ways to choose the positive rows
            all_u = [u_of(c, [x for x in every if x not in c]) for c in combinations(every, n1)]
            low = min(u, n1 * n0 - u)
            assert r.p == pytest.approx(min(1.0, 2 * sum(x <= low for x in all_u) / len(all_u)))
        else:
            n, tied = n1 + n0, sum(c**3 - c for c in Counter(every).values())
            var = n1 * n0 / 12 * (n + 1 - tied / (n * (n - 1)))
            want = 1.0 if var <= 0 else min(1.0, math.erfc(max(0.0, abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(2 * var)))
            assert r.p == pytest.approx(want, rel=1e-9)


def ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


def test_separation_monotony_and_signs(spark):
    deal = random.Random(9)
    order = ["a", "b", "c", "none"]
    rows = [(lv, round(deal.gauss(k, 1.5), 1)) for k, lv in enumerate(order[:3]) for _ in range(30)] + [("z", 3.0), (None, 1.0), ("a", None)]
    df = spark.createDataFrame(rows, "level string, v double")
    r = inference.monotony(df, "v", "level", order).first()
    kept = [(order.index(lv), v) for lv, v in rows if lv in order and v is not None]
    rho = np.corrcoef(ranks([k for k, _ in kept]), ranks([v for _, v in kept]))[0, 1]
    medians = [float(np.median([v for k, v in kept if k == i])) for i in range(3)]
    assert r.n == 90 and r.rho == pytest.approx(rho) and r.medians == pytest.approx([*medians, None]) and r.rising == (medians == sorted(medians))
    rv, n = ranks([v for _, v in kept]), len(kept)
    h = 12 / (n * (n + 1)) * sum(sum(x for x, (k, _) in zip(rv, kept) if k == i) ** 2 / 30 for i in range(3)) - 3 * (n + 1)
    h /= 1 - sum(c**3 - c for c in Counter(v for _, v in kept).values()) / (n**3 - n)
    assert r.h == pytest.approx(h) and r.h_p == pytest.approx(math.exp(-h / 2), rel=1e-8)  # two degrees of freedom
    s = inference.separation(df.filter("level <> 'z'"), "v", "level", "a", order).first()
    assert (s.n1, s.n0) == (60, 30) and s.medians[:3] == pytest.approx(medians) and s.medians[3] is None and s.iqrs[3] is None
    assert s.iqrs[0] == pytest.approx(float(np.subtract(*np.percentile([v for k, v in kept if k == 0], [75, 25]))))

    long = [(g, f, float(i), float(-i if (g, f) == ("odd", "x") else i) + deal.random() * 3) for g in ("p", "q", "r", "odd") for f in ("x", "y") for i in range(20)]
    long += [("tiny", "x", float(i), float(-i)) for i in range(14)] + [("flat", "x", 1.0, float(i)) for i in range(20)]
    got = {(r.g, r.f): r for r in inference.sign_corrections(spark.createDataFrame(long, "g string, f string, o double, v double"), "g", "f", "o", "v").collect()}
    assert {k: r.sign for k, r in got.items() if r.sign < 0} == {("odd", "x"): -1} and len(got) == 10
    assert got["tiny", "x"].p == 0.0 and got["flat", "x"].p is None and got["flat", "x"].rho is None
    few = spark.createDataFrame([("g", 1.0, 2.0), ("g", 2.0, 1.0)], "g string, x double, y double")
    assert inference.spearman_test(few, ["g"], "x", "y").first().p is None


# Series.


def plain_peaks(x, height=None, distance=1, prominence=None):
    n, out, i = len(x), [], 1
    while i < n - 1:
        j = i
        while j < n - 1 and x[j + 1] == x[i]:
            j += 1
        if x[i - 1] < x[i] and j < n - 1 and x[j + 1] < x[i]:
            out.append((i + j) // 2)
        i = j + 1
    if height is not None:
        out = [p for p in out if x[p] >= height]
    kept = []
    for p in sorted(out, key=lambda p: (-x[p], -p)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    told = []
    for p in sorted(kept):
        left = right = p
        low = [x[p], x[p]]
        while left >= 0 and x[left] <= x[p]:
            low[0], left = min(low[0], x[left]), left - 1
        while right < n and x[right] <= x[p]:
            low[1], right = min(low[1], x[right]), right + 1
        prom = x[p] - max(low)
        level, a, b = x[p] - prom / 2, p, p
        while x[a] > level:
            a -= 1
        while x[b] > level:
            b += 1
        at = (a + (level - x[a]) / (x[a + 1] - x[a]), b - (level - x[b]) / (x[b - 1] - x[b]))
        if prominence is None or prom >= prominence:
            told.append((p, x[p], prom, *at, at[1] - at[0]))
    return told


def some_series():
    deal = random.Random(5)
    out = [[], [1.0], [1.0, 2.0], [1.0, 2.0, 1.0], [2.0, 2.0, 2.0], [0.0, 3.0, 3.0, 3.0, 3.0, 1.0], [5.0, 1.0, 5.0], [1.0, 2.0, 2.0], list(map(float, range(40))), [float(-abs(i - 20)) for i in range(41)]]
    out += [[float(deal.randrange(-4, 5)) for _ in range(deal.randrange(3, 60))] for _ in range(150)]
    return out + [[deal.random() for _ in range(257)] for _ in range(5)]


@pytest.fixture(scope="module")
def curves(spark):
    rows = list(enumerate(some_series())) + [(9999, None)]
    return spark.createDataFrame(rows, "id long, s array<double>")


@pytest.mark.parametrize("bounds", [{}, {"height": 1.0}, {"distance": 4}, {"prominence": 2.0}, {"height": 0.0, "distance": 3, "prominence": 1.0}])
def test_peaks_are_those_found_by_walking(curves, bounds):
    as_columns = {k: F.lit(v) if k != "distance" else v for k, v in bounds.items()}
    got = {r.id: r.p for r in curves.select("id", series.peaks(F.col("s"), **as_columns).alias("p")).collect()}
    for i, x in enumerate(some_series()):
        want = plain_peaks(x, **bounds)
        assert [tuple(p) for p in got[i]] == [pytest.approx(w) for w in want], (i, x)
    assert got[9999] is None or got[9999] == []


def test_sharpness_against_walking(curves):
    got = {r.id: r.p for r in curves.select("id", series.sharpness(F.col("s")).alias("p")).collect()}
    some = 0
    for i, x in enumerate(some_series()):
        a = [abs(v) for v in x]
        found = plain_peaks(a, prominence=0.05 * max(a, default=0.0))
        if not a or max(a) < 1e-9 or len(found) < 3:
            assert not got[i]
            continue
        gap = float(np.median(np.diff([p[0] for p in found])))
        assert [tuple(p) for p in got[i]] == [pytest.approx((p[2], p[5] / gap)) for p in found]
        some += 1
    assert some > 50


def plain_savgol(x, window, order):
    half, n, out = window // 2, len(x), []
    for i in range(n):
        first = max(0, min(i - half, n - window))
        at = np.arange(window)
        out.append(float(np.polyval(np.polyfit(at, x[first : first + window], order), i - first)))
    return out


@pytest.mark.parametrize("window, order", [(5, 2), (7, 2), (7, 3), (15, 2), (3, 1)])
def test_savgol(spark, curves, window, order):
    got = {r.id: r.p for r in curves.select("id", series.savgol(F.col("s"), window, order).alias("p")).collect()}
    for i, x in enumerate(some_series()):
        assert got[i] == pytest.approx(plain_savgol(x, window, order) if len(x) >= window else x, abs=1e-9)
    x = np.arange(30.0)
    for y in (np.full(30, 4.0), 3 * x - 1, 0.5 * x * x - 2 * x + 7)[: order + 1]:
        assert one(spark, series.savgol(F.array(*map(F.lit, y.tolist())), window, order)) == pytest.approx(y.tolist())
    with pytest.raises(ValueError, match="odd"):
        series.savgol(F.col("s"), 4)


def test_the_window_of_smoothed_follows_the_length(curves):
    got = {r.id: r.p for r in curves.select("id", series.smoothed(F.col("s")).alias("p")).collect()}
    for i, x in enumerate(some_series()):
        n = len(x)
        window = max(5, min(15, n // 2 * 2 - 1))  # the rule as the profiles need it
        if window >= n:
            window = max(3, n if n % 2 else n - 1)
        assert got[i] == pytest.approx(plain_savgol(x, window, 2) if n >= 3 else x, abs=1e-9)


def test_planted_periods_are_found(spark):
    rows = [(p, [math.sin(2 * math.pi * i / p) + 0.01 * (i % 3) for i in range(120)]) for p in (6, 9, 14, 25)]
    rows += [(0, [1.0, 2.0, 3.0]), (1, list(map(float, range(30)))), (2, [1.0] * 20), (3, [])]
    got = {r.p: r.q for r in spark.createDataFrame(rows, "p long, s array<double>").select("p", series.period(F.col("s")).alias("q")).collect()}
    assert {p: got[p] for p in (6, 9, 14, 25)} == {p: p for p in (6, 9, 14, 25)}
    assert got[0] is None and got[2] is None and got[3] is None
    for p, s in rows[:4]:
        c = np.array(s) - np.mean(s)
        a = np.correlate(c, c, "full")[len(c) - 1 :]
        d = np.diff(a)
        first = np.where((d[:-1] < 0) & (d[1:] >= 0))[0][0] + 1
        assert got[p] == first + int(np.argmax(a[first : first + len(c) // 2]))


def test_gathered_orders_rows_by_place(spark):
    df = spark.createDataFrame([("a", 2, 5.0), ("a", 0, 1.0), ("a", 1, None), ("b", None, 1.0), ("a", 7, 2.0)], "g string, i long, v double")
    assert [(r.g, r.series) for r in series.gathered(df, ["g"], "i", "v").collect()] == [("a", [1.0, 5.0, 2.0])]
    assert series.gathered(df.limit(0), ["g"], "i", "v").isEmpty()


# Folds.


def plain_greedy(rows, k):
    """The usual rule, one group at a time: the fold with the least mean standard deviation of class shares."""
    classes = sorted({c for _, c in rows})
    groups = defaultdict(Counter)
    for g, c in rows:
        groups[g][c] += 1
    total = Counter(c for _, c in rows)
    held = np.zeros((k, len(classes)))
    out = {}
    for g, h in sorted(groups.items(), key=lambda x: (-np.std([x[1][c] for c in classes]), str(x[0]))):
        v = np.array([h[c] for c in classes])
        best = min(range(k), key=lambda f: (round(float(np.mean(np.std((held + np.eye(k)[f][:, None] * v) / [total[c] for c in classes], axis=0))), 12), held[f].sum()))
        held[best] += v
        out[g] = best
    return out


def worst_share(rows, fold, k):
    n, total = Counter((fold[g], c) for g, c in rows), Counter(c for _, c in rows)
    return max(abs(n[f, c] / total[c] - 1 / k) for f in range(k) for c in total)


@pytest.mark.parametrize("most", [folds.MOST_PATTERNS, 12, 1])
def test_no_group_is_split_and_classes_are_as_even_as_by_the_plain_rule(spark, most):
    deal = random.Random(4)
    rows = [(g, deal.choices("abc", [6, 3, 1])[0]) for g in range(300) for _ in range(deal.choice([1, 1, 2, 5, 9, 30]))]
    df = spark.createDataFrame(rows, "g long, c string")
    table = folds.assignments(df, "g", "c", 5, most=most).collect()
    fold = {r.g: r.fold for r in table}
    assert len(table) == len(fold) == 300 and set(fold.values()) == set(range(5))
    assert worst_share(rows, fold, 5) <= worst_share(rows, plain_greedy(rows, 5), 5) + (0.01 if most > 12 else 0.06)
    again = {r.g: r.fold for r in folds.assignments(df.repartition(7), "g", "c", 5, most=most).collect()}
    assert again == fold


def test_folds_of_odd_tables(spark):
    rows = [(None, "a")] * 5 + [(1, None), (1, "a"), (2, None), (3, "b"), (4, "b")] + [(g, "a") for g in range(10, 1010)]
    df = spark.createDataFrame(rows, "g long, c string")
    table = folds.assignments(df, "g", "c", 3).collect()
    assert len(table) == 1005 and sum(r.g is None for r in table) == 1
    joined = folds.stratified(df, "g", "c", 3)
    assert joined.count() == len(rows) and joined.filter("fold is null").isEmpty() and joined.filter("g is null").select("fold").distinct().count() == 1
    even = folds.balance(joined, "c", 3).filter("c = 'a'").collect()
    assert all(abs(r.share - 1 / 3) < 0.01 for r in even) and len(even) == 3
    assert folds.assignments(df.limit(0), "g", "c", 3).isEmpty()
    assert folds.assignments(df, "g", "c", 3, seed=1).collect() != folds.assignments(df, "g", "c", 3, seed=2).collect()
    with pytest.raises(ValueError, match="two folds"):
        folds.assignments(df, "g", "c", 1)


def test_groups_left_over_go_where_shares_grow_least():
    assert folds.dealt([((4, 0), 1, (4, 0)), ((0, 4), 1, (0, 4)), ((2, 2), 3, (6, 6))], 2) == [[1], [0], [0]]
    assert folds.dealt([], 3) == []
