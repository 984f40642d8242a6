"""Scalar functions as Column expressions; all of them stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def worst_side(a: Column, b: Column) -> Column:
    """b if it is a number larger than a, else a; a NaN in a stays (unlike greatest, which prefers NaN)."""
    return F.when(~F.isnan(b) & (b > a), b).otherwise(a)


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; NaN and null count as 0."""
    return F.least(F.greatest(F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0)), F.lit(low)), F.lit(high))


def ratio(x: Column, y: Column) -> Column:
    """x / y, and 0 where y is not positive."""
    return F.when(y > 0, x / y).otherwise(F.lit(0.0))


def robust_z(x: Column, median: Column, iqr: Column, bound: float) -> Column:
    """(x - median) / iqr within ±bound; null where the spread is unknown."""
    z = (x - median) / iqr
    return F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(-bound)), F.lit(bound)))  # greatest passes over null


def signed_log(x: Column) -> Column:
    return -F.signum(x) * F.log10(F.abs(x) + F.lit(1e-10))


def hue_distance(a: Column, b: Column, turn: float = 180.0) -> Column:
    d = F.abs(a - b)
    return F.least(d, F.lit(turn) - d)


def excess_green(r: Column, g: Column, b: Column) -> Column:
    return 2 * g - r - b


def chroma(a: Column, b: Column) -> Column:
    return F.hypot(a - 128, b - 128)


def sigmoid(score: Column, temperature: float = 0.2) -> Column:
    return 1 / (1 + F.exp(-score / F.lit(temperature)))


def softmax(scores: Column, temperature: float = 0.2) -> Column:
    """Probabilities of an array of scores, shifted by the largest."""
    e = F.transform(scores, lambda s: F.exp((s - F.array_max(scores)) / temperature))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y))


def angle(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Degrees between two vectors; 0 where one has no length."""
    norm = F.hypot(ax, ay) * F.hypot(bx, by)
    cos = (ax * bx + ay * by) / norm
    return F.when(norm > 0, F.degrees(F.acos(F.least(F.greatest(cos, F.lit(-1.0)), F.lit(1.0))))).otherwise(F.lit(0.0))


def dot(x: Column, y: Column) -> Column:
    return F.aggregate(F.zip_with(x, y, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)


def mean_of_valid(values: Column, missing: float = -1.0) -> Column:
    """The mean of an array's entries that are neither null nor the sentinel; 0 if there are none."""
    good = F.filter(values, lambda v: v.isNotNull() & (v != missing))
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda s, v: s + v) / F.size(good)).otherwise(F.lit(0.0))


def half_even(x: Column, places: int) -> Column:
    return F.bround(x, places)


def percent_text(text: Column) -> Column:
    """'87%' and '0.87' as a fraction; above 1 a number means percent; null if it isn't a number."""
    number = F.regexp_replace(text, r"[%\s]", "").try_cast("double")
    return F.when(F.contains(text, F.lit("%")) | (number > 1), number / 100).otherwise(number)


def title_case(text: Column) -> Column:
    return F.initcap(F.replace(text, F.lit("_"), F.lit(" ")))


def anchored_equal(a: Column, b: Column) -> Column:
    """Equality of whole texts in any case."""
    return F.lower(F.trim(a)) == F.lower(F.trim(b))


def flags(**named: Column) -> Column:
    """The names of the conditions that hold, joined by commas, or 'ok'."""
    joined = F.concat_ws(",", *[F.when(c, F.lit(n)) for n, c in named.items()])
    return F.when(joined == "", F.lit("ok")).otherwise(joined)


def levels(score: Column, bounds: tuple[float, ...] = (8, 25, 50), names: tuple[str, ...] = ("healthy", "low", "mid", "high")) -> Column:
    """The name of the half-open band that a score falls into."""
    out = F.lit(names[-1])
    for bound, name in reversed(list(zip(bounds, names))):
        out = F.when(score < bound, F.lit(name)).otherwise(out)
    return out


def hole_floor(score: Column, share: Column, full: float = 0.015, base: float = 8.0, extra: float = 22.0) -> Column:
    """A score raised to a floor that grows with the share of holes."""
    return F.when(share > 0, F.greatest(score, F.lit(base) + F.least(share / full, F.lit(1.0)) * extra)).otherwise(score)


def histogram_bin(x: Column, low: float, high: float, bins: int) -> Column:
    """The bin from 1; the last one holds its right edge; null outside."""
    return F.when((x >= low) & (x <= high), F.least(F.width_bucket(x, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)))


def first_best(values: Column) -> Column:
    """The place from 1 of the largest entry of an array, the first on ties."""
    return F.array_position(values, F.array_max(values))


def top_two(values: Column, names: Column) -> Column:
    """The names of the two largest entries, in order of the values, ties in order of place."""
    rows = F.zip_with(F.zip_with(values, F.sequence(F.lit(1), F.size(values)), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), names, lambda r, n: F.struct(r["v"].alias("v"), r["i"].alias("i"), n.alias("n")))
    return F.transform(F.slice(F.array_sort(rows), 1, 2), lambda r: r["n"])


def top_two_with(values: Column, names: Column) -> Column:
    """What ``top_two`` names, with the values: label, p, label_2, p_2; the second is null where there is one entry."""
    rows = F.zip_with(F.zip_with(values, F.sequence(F.lit(1), F.size(values)), lambda v, i: F.struct((-v).alias("v"), i.alias("i"))), names, lambda r, n: F.struct(r["v"].alias("v"), r["i"].alias("i"), n.alias("n")))
    two = F.array_sort(rows)
    of = lambda k: F.get(two, F.lit(k))
    return F.struct(of(0)["n"].alias("label"), (-of(0)["v"]).alias("p"), of(1)["n"].alias("label_2"), (-of(1)["v"]).alias("p_2"))


def dot(a: Column, b: Column) -> Column:
    """The dot product of two arrays of one length."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def linspace(low: Column, high: Column, n: int) -> Column:
    """``n`` values at even distances from low to high; the last one is high itself."""
    step = (high - low) / max(n - 1, 1)
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when((i == n - 1) & F.lit(n > 1), high.cast("double")).otherwise(low + i * step))


def polar(y: Column, x: Column, cy: Column, cx: Column, reach: Column) -> Column:
    """radius (over ``reach``) and angle in radians of a place around a centre."""
    return F.struct((F.hypot(y - cy, x - cx) / (reach + 1e-6)).alias("radius"), F.atan2(y - cy, x - cx).alias("angle"))
