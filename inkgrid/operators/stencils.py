"""Neighbourhood operators on rasters that hold one array each: (page_id, width, height, g).

A page's pixels stay in its row, so no operator here shuffles; each is a few numpy calls over a stack of images, with windows
taken apart into rows and columns and sums that run, so that the cost doesn't grow with the area of a window.
Reads outside the image follow each operator's own border rule.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.operators.batches import map_images

ACROSS, DOWN = 2, 1


def _padded(s: np.ndarray, r: int, axis: int, value: float | None) -> np.ndarray:
    """A stack with r more pixels at both ends of an axis: value, or the edge's own where that is None."""
    width = [(r, r) if a == axis else (0, 0) for a in range(3)]
    return np.pad(s, width, mode="edge") if value is None else np.pad(s, width, constant_values=value)


def _at(s: np.ndarray, start: int, n: int, axis: int) -> np.ndarray:
    return s[:, :, start : start + n] if axis == ACROSS else s[:, start : start + n]


def _moved(s: np.ndarray, dx: int, dy: int, outside: float) -> np.ndarray:
    """The neighbour at (dx, dy) of every pixel."""
    out = np.full_like(s, outside)
    h, w = s.shape[1:]
    if abs(dx) < w and abs(dy) < h:
        out[:, max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)] = s[:, max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return out


def _along(s: np.ndarray, r: int, axis: int, of: np.ufunc, outside: float) -> np.ndarray:
    """of (a minimum or maximum) over 2r + 1 pixels of an axis, in windows that double."""
    n, size = s.shape[axis], 2 * r + 1
    padded, span = _padded(s, r, axis, outside), 1
    while 2 * span <= size:
        m = padded.shape[axis] - span
        padded = of(_at(padded, 0, m, axis), _at(padded, span, m, axis))
        span *= 2
    return of(_at(padded, 0, n, axis), _at(padded, size - span, n, axis))


def _extreme(s: np.ndarray, r: int, of: np.ufunc, outside: float) -> np.ndarray:
    return _along(_along(s, r, ACROSS, of, outside), r, DOWN, of, outside)


def _running(s: np.ndarray, r: int, axis: int, value: float | None = 0.0) -> np.ndarray:
    """Sums over 2r + 1 pixels of an axis."""
    n = s.shape[axis]
    total = _padded(np.cumsum(_padded(s, r, axis, value), axis=axis), 1, axis, 0.0)
    return _at(total, 2 * r + 1, n, axis) - _at(total, 0, n, axis)


def _square_sums(s: np.ndarray, r: int) -> np.ndarray:
    """Sums over squares, cut at the image's edge."""
    return _running(_running(s, r, ACROSS), r, DOWN)


def _interior(s: np.ndarray, margin: int = 1) -> np.ndarray:
    inside = np.zeros(s.shape[1:], dtype=bool)
    inside[margin : s.shape[1] - margin, margin : s.shape[2] - margin] = True
    return inside[None]


def box_blur(rasters: DataFrame, radius: int) -> DataFrame:
    """Means of squares; edge pixels go on beyond the border."""
    n = 2 * radius + 1
    return map_images(rasters, lambda s: _running(_running(s, radius, ACROSS, None) / n, radius, DOWN, None) / n)


def gauss_weights(sigma: float) -> list[float]:
    r = math.ceil(3 * sigma)
    raw = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-r, r + 1)]
    return [x / sum(raw) for x in raw]


def blurred(s: np.ndarray, sigma: float) -> np.ndarray:
    """A stack weighted along rows, then along columns; edge pixels go on beyond the border."""
    weights = gauss_weights(sigma)
    r = len(weights) // 2
    for axis in (ACROSS, DOWN):
        padded, n = _padded(s, r, axis, None), s.shape[axis]
        s = sum(w * _at(padded, k, n, axis) for k, w in enumerate(weights))
    return s


def gaussian_blur(rasters: DataFrame, sigma: float) -> DataFrame:
    return map_images(rasters, lambda s: blurred(s, sigma))


def gradient(s: np.ndarray) -> dict[str, np.ndarray]:
    """Magnitude and direction of 3 x 3 Sobel gradients; 0 at the border."""
    inside = _interior(s)
    smooth = lambda a, b, c: a + 2 * b + c
    side = lambda dx, dy: _moved(s, dx, dy, 0.0)
    gx = np.where(inside, smooth(side(1, -1), side(1, 0), side(1, 1)) - smooth(side(-1, -1), side(-1, 0), side(-1, 1)), 0.0)
    gy = np.where(inside, smooth(side(-1, 1), side(0, 1), side(1, 1)) - smooth(side(-1, -1), side(0, -1), side(1, -1)), 0.0)
    return {"magnitude": np.sqrt(gx * gx + gy * gy), "direction": np.arctan2(gy, gx)}


def sobel(rasters: DataFrame) -> DataFrame:
    """g becomes an array of (magnitude, direction); the border is 0."""
    return map_images(rasters, gradient, "struct<magnitude:double,direction:double>")


def magnitudes(rasters: DataFrame) -> DataFrame:
    """g becomes the gradients' magnitudes."""
    return map_images(rasters, lambda s: gradient(s)["magnitude"])


def morph_gradient(rasters: DataFrame, radius: int) -> DataFrame:
    """Largest minus smallest value of the square, within the image."""
    return map_images(rasters, lambda s: _extreme(s, radius, np.maximum, -np.inf) - _extreme(s, radius, np.minimum, np.inf))


def _disc_counts(s: np.ndarray, r: int) -> tuple[np.ndarray, int]:
    """How many pixels of the disc around each pixel are set, and how many it has."""
    h, w = s.shape[1:]
    # Sums of rows up to each pixel, carried on by r pixels on both sides.
    upto = np.zeros((len(s), h, w + 2 * r + 1), np.int32)
    upto[:, :, r + 1 : r + 1 + w] = np.cumsum(s > 0, axis=2)
    upto[:, :, r + 1 + w :] = upto[:, :, r + w : r + w + 1]
    total, size = np.zeros(s.shape, np.int32), 0
    for dy in range(-min(r, h), min(r, h) + 1):
        half = math.isqrt(r * r - dy * dy)
        rows = upto[:, max(0, dy) : h + min(0, dy)]
        total[:, max(0, -dy) : h - max(0, dy)] += rows[:, :, r + half + 1 : r + half + 1 + w] - rows[:, :, r - half : r - half + w]
    for dy in range(-r, r + 1):
        size += 2 * math.isqrt(r * r - dy * dy) + 1
    return total, size


def dilated(s: np.ndarray, radius: int) -> np.ndarray:
    return np.where(_disc_counts(s, radius)[0] > 0.5, 255.0, 0.0)


def eroded(s: np.ndarray, radius: int) -> np.ndarray:
    count, size = _disc_counts(s, radius)
    return np.where(count > size - 0.5, 255.0, 0.0)


def dilate(masks: DataFrame, radius: int) -> DataFrame:
    """255 where any pixel of the disc is set."""
    return map_images(masks, lambda s: dilated(s, radius))


def erode(masks: DataFrame, radius: int) -> DataFrame:
    """255 where the whole disc is set; outside the image nothing is."""
    return map_images(masks, lambda s: eroded(s, radius))


def morph_open(masks: DataFrame, radius: int) -> DataFrame:
    return map_images(masks, lambda s: dilated(eroded(s, radius), radius))


def morph_close(masks: DataFrame, radius: int) -> DataFrame:
    return map_images(masks, lambda s: eroded(dilated(s, radius), radius))


def threshold(rasters: DataFrame, above: float) -> DataFrame:
    return rasters.withColumn("g", F.transform("g", lambda v: F.when(v > above, 255.0).otherwise(0.0)))


#: Neighbours of a local binary pattern; the place in the list is the bit.
LBP = [(-1, -1), (0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0)]


def local_binary_pattern(rasters: DataFrame) -> DataFrame:
    """8-bit codes, a bit for each neighbour that is no smaller; the border is 0."""
    return map_images(rasters, lambda s: np.where(_interior(s), sum((_moved(s, dx, dy, -np.inf) >= s) * (1 << k) for k, (dx, dy) in enumerate(LBP)), 0), "int")


def adaptive_threshold(rasters: DataFrame, block: int, c: float) -> DataFrame:
    """255 where a pixel is above the mean of its block, cut at the border, less c."""
    r = block // 2
    return map_images(rasters, lambda s: np.where(s > _square_sums(s, r) / _square_sums(np.ones((1, *s.shape[1:])), r) - c, 255.0, 0.0))


def minima(s: np.ndarray, below: float | np.ndarray, radius: int) -> np.ndarray:
    return _interior(s, radius) & (s < below) & (s <= _extreme(s, radius, np.minimum, np.inf))


def local_minima(rasters: DataFrame, below: float, radius: int = 5) -> DataFrame:
    """1.0 where a value is under below and no neighbour within radius is smaller, radius away from the border."""
    return map_images(rasters, lambda s: minima(s, below, radius).astype(float))


def noise(rasters: DataFrame) -> DataFrame:
    """Share of pixels that differ from the mean of their four neighbours by more than 30; (page_id, noise)."""
    four = ((1, 0), (-1, 0), (0, 1), (0, -1))
    marked = map_images(rasters, lambda s: _interior(s) & (np.abs(s - sum(_moved(s, dx, dy, 0.0) for dx, dy in four) / 4) > 30), "int", "m")
    return marked.select("page_id", (F.aggregate("m", F.lit(0), lambda a, v: a + v) / (F.col("width") * F.col("height"))).alias("noise"))


def text_edges(rasters: DataFrame, strong: float = 80.0, least: int = 10) -> DataFrame:
    """1 where a strong edge has more than least strong pixels in its 5 x 5 square, itself included. g: magnitudes."""
    return map_images(rasters, lambda s: (s > strong) & (_square_sums((s > strong).astype(float), 2) > least + 0.5), "int")


def bubble_border(rasters: DataFrame, reach: int = 5, bright: float = 240.0, darker: float = 80.0) -> DataFrame:
    """1 where a bright pixel has one that is darker by darker among those reach away."""

    def of(s: np.ndarray) -> np.ndarray:
        lowest = np.minimum.reduce([_moved(s, dx, dy, np.inf) for dy in (-reach, 0, reach) for dx in (-reach, 0, reach)])
        return (s > bright) & (s - lowest > darker)

    return map_images(rasters, of, "int")


def label_edges(labels: DataFrame) -> DataFrame:
    """1 where a pixel's label differs from one of its four neighbours' labels."""

    def of(s: np.ndarray) -> np.ndarray:
        out = np.zeros(s.shape, dtype=bool)
        across, down = s[:, :, 1:] != s[:, :, :-1], s[:, 1:] != s[:, :-1]
        out[:, :, 1:] |= across
        out[:, :, :-1] |= across
        out[:, 1:] |= down
        out[:, :-1] |= down
        return out

    return map_images(labels, of, "int")


def distance_transform(masks: DataFrame, above: float = 0.0) -> DataFrame:
    """g becomes the chamfer distance (1 straight, 1.414 diagonal) to the nearest background pixel; 1e10 without one.

    A pass down and a pass up; within a row, distances to the left and right are running minima.
    """

    def passed(d: np.ndarray) -> np.ndarray:
        w = d.shape[2]
        x = np.arange(w)
        for y in range(d.shape[1]):
            row = d[:, y]
            if y:
                up = np.pad(d[:, y - 1], ((0, 0), (1, 1)), constant_values=np.inf)
                row = np.minimum.reduce([row, up[:, 1:-1] + 1, up[:, :-2] + 1.414, up[:, 2:] + 1.414])
            left = np.minimum.accumulate(row - x, axis=1) + x
            right = np.minimum.accumulate((row + x)[:, ::-1], axis=1)[:, ::-1] - x
            d[:, y] = np.minimum(left, right)
        return d

    def of(s: np.ndarray) -> np.ndarray:
        d = passed(np.where(s > above, np.inf, 0.0))
        d = passed(d[:, ::-1].copy())[:, ::-1]
        return np.where(np.isinf(d), 1e10, d)

    return map_images(masks, of)
