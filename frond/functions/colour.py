"""Colour spaces as Column expressions, on the 8-bit scales that image libraries use: each channel a whole number of 0..255."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# sRGB to XYZ over its white point (D65), one row for each of X, Y, Z.
_XYZ = (
    (0.412453 / 0.950456, 0.357580 / 0.950456, 0.180423 / 0.950456),
    (0.212671, 0.715160, 0.072169),
    (0.019334 / 1.088754, 0.119193 / 1.088754, 0.950227 / 1.088754),
)


def _byte(x: Column) -> Column:
    return F.least(F.greatest(F.round(x), F.lit(0.0)), F.lit(255.0))


def _linear(c: Column) -> Column:
    u = c / 255
    return F.when(u <= 0.04045, u / 12.92).otherwise(F.pow((u + 0.055) / 1.055, F.lit(2.4)))


def _root(t: Column) -> Column:
    return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16 / 116)


def lab(r: Column, g: Column, b: Column) -> dict[str, Column]:
    """lightness (0 to 255), and a and b (128 is neutral) of sRGB bytes."""
    line = [_linear(c) for c in (r, g, b)]
    x, y, z = (sum((k * c for k, c in zip(row, line)), F.lit(0.0)) for row in _XYZ)
    fx, fy, fz = _root(x), _root(y), _root(z)
    light = F.when(y > 0.008856, 116 * fy - 16).otherwise(903.3 * y)
    return {"lightness": _byte(light * 2.55), "a": _byte(500 * (fx - fy) + 128), "b": _byte(200 * (fy - fz) + 128)}


def saturation(r: Column, g: Column, b: Column) -> Column:
    """HSV saturation of bytes; 0 for black."""
    top, low = F.greatest(r, g, b), F.least(r, g, b)
    return F.when(top > 0, _byte((top - low) / top * 255)).otherwise(F.lit(0.0))
