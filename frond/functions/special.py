"""Special functions and the tails of distributions as Column expressions.

Series and continued fractions run a bounded number of steps inside Spark's ``aggregate``; they are meant for the few rows
of a test's result, not for raw data. Arguments are doubles; null gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of a series or continued fraction: enough for shape parameters up to about 10,000 (gamma) and 500,000 (beta).
STEPS = 1000
_TINY = 1e-300

# Lanczos' coefficients for g = 7.
_LANCZOS = (
    0.99999999999980993,
    676.5203681218851,
    -1259.1392167224028,
    771.32342877765313,
    -176.61502916214059,
    12.507343278686905,
    -0.13857109526572012,
    9.9843695780195716e-6,
    1.5056327351493116e-7,
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once, however often it stands in the result."""
    return F.element_at(F.transform(F.array(value), use), 1)


def log_gamma(x: Column) -> Column:
    """The logarithm of the gamma function for x > 0."""
    z = x - 1
    total = F.lit(_LANCZOS[0])
    for k, c in enumerate(_LANCZOS[1:], 1):
        total = total + F.lit(c) / (z + k)
    t = z + 7.5
    return 0.9189385332046727 + (z + 0.5) * F.log(t) - t + F.log(total)


def _safe(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _steps(start: Column, step: Callable[[Column, Column], Column], read: Callable[[Column], Column], steps: int) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda acc, i: step(acc, i.cast("double")), read)


def _state(**fields: Column) -> Column:
    return F.struct(*[v.cast("double").alias(k) for k, v in fields.items()])


def gamma_q(a: Column, x: Column, steps: int = STEPS) -> Column:
    """The regularised upper incomplete gamma function Q(a, x) for a > 0: 1 where x <= 0."""

    def found(v: Column) -> Column:
        a, x = v.a, v.x
        head = F.exp(a * F.log(x) - x - log_gamma(a))
        series = _steps(
            _state(term=1 / a, total=1 / a),
            lambda s, i: let(s.term * x / (a + i), lambda t: _state(term=t, total=s.total + t)),
            lambda s: s.total,
            steps,
        )

        def turn(s: Column, i: Column) -> Column:
            b = s.b + 2
            top = -i * (i - a)
            return let(
                F.struct((1 / _safe(top * s.d + b)).alias("d"), _safe(b + top / s.c).alias("c")),
                lambda n: _state(b=b, c=n.c, d=n.d, h=s.h * n.c * n.d),
            )

        first = x + 1 - a
        fraction = _steps(_state(b=first, c=F.lit(1 / _TINY), d=1 / _safe(first), h=1 / _safe(first)), turn, lambda s: s.h, steps)
        return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - head * series).otherwise(head * fraction)

    return let(_state(a=a, x=x), found)


def beta_i(x: Column, a: Column, b: Column, steps: int = STEPS) -> Column:
    """The regularised incomplete beta function I_x(a, b) for a, b > 0 and x in 0..1."""

    def fraction(x: Column, a: Column, b: Column) -> Column:
        def turn(s: Column, m: Column) -> Column:
            even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
            odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
            half = lambda s, top: F.struct((1 / _safe(1 + top * s.d)).alias("d"), _safe(1 + top / s.c).alias("c"))
            return let(half(s, even), lambda p: let(half(p, odd), lambda q: _state(c=q.c, d=q.d, h=s.h * p.c * p.d * q.c * q.d)))

        d = 1 / _safe(1 - (a + b) * x / (a + 1))
        return _steps(_state(c=F.lit(1.0), d=d, h=d), turn, lambda s: s.h, steps)

    def found(v: Column) -> Column:
        # the fraction converges fast on one side of the mean, and I_x(a, b) = 1 - I_(1 - x)(b, a)
        near = v.x < (v.a + 1) / (v.a + v.b + 2)
        turned = F.struct(near.alias("near"), *[F.when(near, p).otherwise(q).cast("double").alias(k) for k, p, q in (("x", v.x, 1 - v.x), ("a", v.a, v.b), ("b", v.b, v.a))])
        logs = lambda t: F.transform(F.array(t.a + t.b, t.a, t.b), log_gamma)
        head = lambda t: let(logs(t), lambda g: F.exp(g[0] - g[1] - g[2] + t.a * F.log(t.x) + t.b * F.log(1 - t.x)))
        inside = let(turned, lambda t: let(head(t) * fraction(t.x, t.a, t.b) / t.a, lambda i: F.when(t.near, i).otherwise(1 - i)))
        return F.when(v.x <= 0, F.lit(0.0)).when(v.x >= 1, F.lit(1.0)).otherwise(inside)

    return let(_state(x=x, a=a, b=b), found)


def normal_tails(z: Column) -> Column:
    """The share of a standard normal distribution beyond ±|z|."""
    return gamma_q(F.lit(0.5), z * z / 2)


def chi2_tail(x: Column, df: Column) -> Column:
    """The share of a chi-squared distribution above x."""
    return gamma_q(df / 2, x / 2)


def t_tails(t: Column, df: Column) -> Column:
    """The share of Student's distribution beyond ±|t|; a million degrees of freedom stand for any more."""
    return let(F.least(df, F.lit(1e6)), lambda d: beta_i(d / (d + t * t), d / 2, F.lit(0.5)))


def sign_test(a: Column, b: Column) -> Column:
    """The exact two-sided p-value of two counts that are equally likely for each case; 1 if both are 0."""
    low, high = F.least(a, b).cast("double"), F.greatest(a, b).cast("double")
    return F.when(high <= low, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * beta_i(F.lit(0.5), high, low + 1)))
