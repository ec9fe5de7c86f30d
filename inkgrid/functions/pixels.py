"""Column functions over one pixel's channels (0 to 255)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def gray(r: Column, g: Column, b: Column) -> Column:
    return 0.299 * r + 0.587 * g + 0.114 * b


def brightness(r: Column, g: Column, b: Column) -> Column:
    return (r + g + b) / F.lit(3.0)


def luma_chroma(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return gray(r, g, b), 128 - 0.169 * r - 0.331 * g + 0.5 * b, 128 + 0.5 * r - 0.419 * g - 0.081 * b


def is_skin(r: Column, g: Column, b: Column) -> Column:
    y, cb, cr = luma_chroma(r, g, b)
    return (y > 60) & (cb > 85) & (cb < 135) & (cr > 135) & (cr < 180)


def lab(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Lab without gamma correction."""
    r, g, b = r / 255.0, g / 255.0, b / 255.0
    d = 6.0 / 29.0
    f = lambda t: F.when(t > d**3, F.cbrt(t)).otherwise(t / (3 * d * d) + 4.0 / 29.0)
    x = f((0.4124 * r + 0.3576 * g + 0.1805 * b) / 0.9505)
    y = f(0.2126 * r + 0.7152 * g + 0.0722 * b)
    z = f((0.0193 * r + 0.1192 * g + 0.9505 * b) / 1.089)
    return 116 * y - 16, 500 * (x - y), 200 * (y - z)


def content(value: Column, low: float, high: float) -> Column:
    """Strictly inside a band of brightness."""
    return (value > low) & (value < high)
