"""Peaks, smoothing and periods of short series that are array columns: profiles, curves, histograms.

A series is one row, so millions of them are dealt over tasks without a shuffle; everything is built-in array functions.
Work is n log n in the series' length unless said otherwise. ``gathered`` makes such a column of rows.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from frond.functions.special import let


def gathered(df: DataFrame, groups: list[str], place: str, value: str, name: str = "series") -> DataFrame:
    """One row for each group with its values in order of their places, as doubles; rows without a place or value don't
    count. Ties of places are ordered by value."""
    rows = df.filter(F.col(place).isNotNull() & F.col(value).isNotNull())
    points = F.sort_array(F.collect_list(F.struct(F.col(place).alias("place"), F.col(value).cast("double").alias("value"))))
    return rows.groupBy(*groups).agg(points.alias("_points")).select(*groups, F.transform("_points", lambda p: p["value"]).alias(name))


def _at(a: Column, i: Column) -> Column:
    """Element i from 0; null outside."""
    return F.get(a, i.cast("int"))


def _upto(n: Column) -> Column:
    """0 to n - 1; empty if n is 0."""
    return F.slice(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), F.lit(1), F.greatest(n, F.lit(0)))


def _ladder(series: Column, better: Callable[[Column, Column], Column]) -> Column:
    """Level k has the best of 2^k neighbours from each place on."""

    def next_level(levels: Column, k: Column) -> Column:
        half = F.pow(F.lit(2), k - 1).cast("int")
        longer = let(F.element_at(levels, -1), lambda last: F.transform(_upto(F.size(last) - half), lambda i: better(_at(last, i), _at(last, i + half))))
        return F.concat(levels, F.array(longer))

    top = F.floor(F.log2(F.greatest(F.size(series), F.lit(1)).cast("double"))).cast("int")
    return F.aggregate(_upto(top), F.array(series), lambda acc, k: next_level(acc, k + 1))


def _walk(start: Column, left: bool, goes_on: Callable[[Column, Column], Column], state: Column, take: Callable[[Column, Column, Column], Column], levels: Column) -> Column:
    """Go from a place to the left or right for as long as ``goes_on`` holds for whole blocks of 2^k places, largest first.

    The state has a field ``at``; ``take`` gives the next one for level k and the block's first place.
    """

    def turn(s: Column, back: Column) -> Column:
        k = levels - 1 - back
        step = F.pow(F.lit(2), k).cast("int")
        first = s["at"] - step if left else s["at"] + 1
        return F.when((first >= 0) & F.coalesce(goes_on(k, first), F.lit(False)), take(s, k, first)).otherwise(s)

    return F.aggregate(_upto(levels), state, turn)


def plateaus(series: Column) -> Column:
    """The middle places (rounded down) of all stretches of equal values that are above both neighbours; the ends never are."""

    def found(s: Column) -> Column:
        starts = F.filter(_upto(F.size(s)), lambda i: (i == 0) | (_at(s, i) != _at(s, i - 1)))
        return let(starts, lambda b: F.transform(F.filter(_inner(F.size(b)), lambda k: _above(s, b, k)), lambda k: F.floor((_at(b, k) + _at(b, k + 1) - 1) / 2).cast("int")))

    def _inner(n: Column) -> Column:
        return F.slice(_upto(n), F.lit(2), F.greatest(n - 2, F.lit(0)))

    def _above(s: Column, b: Column, k: Column) -> Column:
        return (_at(s, _at(b, k)) > _at(s, _at(b, k - 1))) & (_at(s, _at(b, k)) > _at(s, _at(b, k + 1)))

    return let(series, found)


def spaced(series: Column, places: Column, distance: int) -> Column:
    """Of ``places`` those that stay when, from the highest down, each removes the lower ones nearer than ``distance``; of equal
    heights the later one comes first. Square in the number of places."""

    def found(v: Column) -> Column:
        s, p = v["s"], v["p"]
        by_height = F.transform(F.reverse(F.array_sort(F.transform(p, lambda i: F.struct(_at(s, i).alias("h"), i.alias("i"))))), lambda x: x["i"])
        none = F.slice(F.array(F.lit(0)), F.lit(1), F.lit(0))
        kept = F.aggregate(by_height, none, lambda acc, i: F.when(F.exists(acc, lambda j: F.abs(i - j) < distance), acc).otherwise(F.concat(acc, F.array(i))))
        return F.array_sort(kept)

    return let(F.struct(series.alias("s"), places.alias("p")), found)


def peaks(series: Column, height: Column | None = None, distance: int = 1, prominence: Column | None = None) -> Column:
    """An array of (place, height, prominence, left, right, width) for the peaks of a series, in order of places.

    A peak is a stretch of equal values above both neighbours, at its middle. First go peaks below ``height``, then those
    within ``distance`` of a higher one, then those with less than ``prominence``. The prominence is the height above the
    higher of the two lowest points between the peak and the next strictly higher sample (or the end) on either side. Left and
    right are where the series, interpolated, crosses half the prominence below the top, and width is their distance. Null or
    empty series, and those without a peak, have none.
    """

    def of(v: Column) -> Column:
        s = v["s"]
        levels = F.size(v["top"])
        lowest = lambda side_left: lambda i: _walk(
            i,
            side_left,
            lambda k, first: _at(_at(v["top"], k), first) <= _at(s, i),
            F.struct(i.cast("int").alias("at"), _at(s, i).alias("low")),
            lambda st, k, first: F.struct((first if side_left else first + F.pow(F.lit(2), k).cast("int") - 1).alias("at"), F.least(st["low"], _at(_at(v["low"], k), first)).alias("low")),
            levels,
        )["low"]
        beyond = lambda side_left: lambda i, level: _walk(
            i,
            side_left,
            lambda k, first: _at(_at(v["low"], k), first) > level,
            F.struct(i.cast("int").alias("at")),
            lambda st, k, first: F.struct((first if side_left else first + F.pow(F.lit(2), k).cast("int") - 1).alias("at")),
            levels,
        )["at"]

        def crossing(i: Column, level: Column, side_left: bool) -> Column:
            step = -1 if side_left else 1
            inner = let(beyond(side_left)(i, level), lambda at: F.struct(at.alias("at"), _at(s, at).alias("inside"), _at(s, at + step).alias("outside")))
            return let(inner, lambda c: c["at"] + step * F.coalesce((c["inside"] - level) / (c["inside"] - c["outside"]), F.lit(0.0)))

        def one(i: Column) -> Column:
            h = _at(s, i)
            return let(
                F.struct(i.alias("i"), (h - F.greatest(lowest(True)(i), lowest(False)(i))).alias("prominence")),
                lambda x: let(
                    F.struct(x["i"].alias("place"), h.alias("height"), x["prominence"].alias("prominence"), *[crossing(x["i"], h - x["prominence"] / 2, side).alias(name) for side, name in ((True, "left"), (False, "right"))]),
                    lambda p: F.struct(*[p[c].alias(c) for c in ("place", "height", "prominence", "left", "right")], (p["right"] - p["left"]).alias("width")),
                ),
            )

        places = plateaus(s)
        if height is not None:
            places = F.filter(places, lambda i: _at(s, i) >= height)
        if distance > 1:
            places = spaced(s, places, distance)
        all_of_them = F.transform(places, one)
        return all_of_them if prominence is None else F.filter(all_of_them, lambda p: p["prominence"] >= prominence)

    series = series.cast("array<double>")
    return let(F.struct(series.alias("s"), _ladder(series, F.greatest).alias("top"), _ladder(series, F.least).alias("low")), of)


#: Least prominence of a peak that counts for sharpness, as a share of the highest; least number of them.
SHARP_SHARE, SHARP_LEAST = 0.05, 3


def sharpness(series: Column) -> Column:
    """For each peak of |series|: its prominence and its half-height width over the median spacing of peaks; empty below
    SHARP_LEAST peaks. Peaks with less than SHARP_SHARE of the highest sample don't count."""

    def of(a: Column) -> Column:
        found = peaks(a, prominence=SHARP_SHARE * F.array_max(a))
        none = F.filter(F.transform(F.array(F.lit(0.0)), lambda x: F.struct(x.alias("prominence"), x.alias("width"))), lambda x: F.lit(False))

        def told(p: Column) -> Column:
            gaps = F.array_sort(F.transform(_upto(F.size(p) - 1), lambda k: (_at(p, k + 1)["place"] - _at(p, k)["place"]).cast("double")))
            return let(_median(gaps), lambda m: F.filter(F.transform(p, lambda x: F.struct(x["prominence"].alias("prominence"), (x["width"] / m).alias("width"))), lambda x: x["width"] > 1e-6))

        return F.when(F.array_max(a) < 1e-9, none).otherwise(let(found, lambda p: F.when(F.size(p) < SHARP_LEAST, none).otherwise(told(p))))

    return let(F.transform(series.cast("array<double>"), lambda x: F.abs(x)), of)


def _median(ordered: Column) -> Column:
    n = F.size(ordered)
    return (_at(ordered, F.floor((n - 1) / 2)) + _at(ordered, F.floor(n / 2))) / 2


def savgol_weights(window: int, order: int) -> np.ndarray:
    """Row r: the weights by which a window's samples give the value at its place r of the polynomial fitted to them."""
    x = np.arange(window) - (window - 1) / 2
    q, _ = np.linalg.qr(np.vander(x / max(1.0, np.abs(x).max()), order + 1))
    return q @ q.T


def savgol(series: Column, window: int, order: int = 2) -> Column:
    """Savitzky-Golay smoothing: each sample becomes the value of the polynomial fitted to the window around it; at either end
    the polynomial of the first or last whole window goes on. A series shorter than the window is an error of the caller's:
    it comes back as it is."""
    if window % 2 == 0 or window <= order:
        raise ValueError("the window is odd and larger than the order")
    half = window // 2
    weights = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in savgol_weights(window, order)])

    def of(v: Column) -> Column:
        s, n = v["s"], F.size(v["s"])

        def one(i: Column) -> Column:
            first = F.greatest(F.lit(0), F.least(i - half, n - window))
            parts = F.zip_with(F.slice(s, first + 1, F.lit(window)), _at(v["w"], i - first), lambda a, b: a * b)
            return F.aggregate(parts, F.lit(0.0), lambda acc, x: acc + x)

        return F.when(n < window, s).otherwise(F.transform(_upto(n), one))

    return let(F.struct(series.cast("array<double>").alias("s"), weights.alias("w")), of)


def smoothed(series: Column, most: int = 15, order: int = 2) -> Column:
    """``savgol`` with the widest odd window up to ``most`` that is shorter than the series (3 and 5 also if as long);
    a series of one or two samples stays."""
    n = F.size(series)
    out = series.cast("array<double>")
    for window in range(3, most + 1, 2):
        fits = n >= window if window <= 5 else n > window
        out = F.when(fits, savgol(series, window, order)).otherwise(out)
    return out


def autocorrelation(series: Column) -> Column:
    """Sums of products of the centred series with itself at lags 0, 1, ...; square in its length."""

    def of(s: Column) -> Column:
        n = F.size(s)
        total = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
        centred = let(total(s) / F.greatest(n, F.lit(1)), lambda m: F.transform(s, lambda x: x - m))
        return let(centred, lambda c: F.transform(_upto(n), lambda lag: total(F.zip_with(F.slice(c, F.lit(1), n - lag), F.slice(c, lag + 1, n - lag), lambda a, b: a * b))))

    return let(series.cast("array<double>"), of)


def period(series: Column, shaped: Callable[[Column], Column] = lambda a: a) -> Column:
    """The lag of the greatest autocorrelation after the first local minimum, within half the series' length from there; null
    if it never turns up again or has five samples or fewer. ``shaped`` may change the autocorrelation before it is searched,
    such as round it."""

    def of(a: Column) -> Column:
        n = F.size(a)
        turns = F.filter(_upto(n - 2), lambda i: (_at(a, i + 1) < _at(a, i)) & (_at(a, i + 2) >= _at(a, i + 1)))

        def search(first: Column) -> Column:
            part = F.slice(a, first + 1, F.floor(n / 2).cast("int"))
            return let(part, lambda p: first + F.array_position(p, F.array_max(p)).cast("int") - 1)

        return F.when((n > 5) & (F.size(turns) > 0), search(_at(turns, F.lit(0)) + 1))

    return let(shaped(autocorrelation(series)), of)
