"""Panels from contours: edges by Canny's rules, what they enclose, and the boxes of what is large enough.

Gradients and thinning are stencils on pages. An edge stays if a strong one is reachable over weak ones, the outside is the
background that reaches the page's border, and an outer contour is a component of everything else: within a stack of pages for those
that a task holds, and over tables of runs for larger ones.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.operators import graphs, stacks
from inkgrid.operators.batches import STACK_PIXELS, map_images, per_stack
from inkgrid.operators.stencils import _moved

#: The tangent of 22.5 degrees in units of 2 ** -15, as the thinning of edges by direction rounds it.
TAN_22 = 13573


def marks(s: np.ndarray, low: float, high: float) -> np.ndarray:
    """2 for strong and 1 for weak edges of a stack: gradients |gx| + |gy| above high or low that are largest across the edge."""
    p = np.pad(s, ((0, 0), (1, 1), (1, 1)), mode="edge")
    across, down = p[:, :, 2:] - p[:, :, :-2], p[:, 2:] - p[:, :-2]
    gx = across[:, :-2] + 2 * across[:, 1:-1] + across[:, 2:]
    gy = down[:, :, :-2] + 2 * down[:, :, 1:-1] + down[:, :, 2:]
    ax, ay = np.abs(gx), np.abs(gy)
    m = ax + ay
    to = lambda dx, dy: _moved(m, dx, dy, 0.0)
    flat, steep = ay * 32768 < ax * TAN_22, ay * 32768 > ax * (TAN_22 + 65536)
    rising = (gx < 0) != (gy < 0)
    largest = np.where(flat, (m > to(-1, 0)) & (m >= to(1, 0)), np.where(steep, (m > to(0, -1)) & (m >= to(0, 1)), np.where(rising, (m > to(1, -1)) & (m > to(-1, 1)), (m > to(-1, -1)) & (m > to(1, 1)))))
    return np.where(largest & (m > low), 1.0 + (m > high), 0.0)


def reached(found: DataFrame, seed: str) -> DataFrame:
    """Runs, connected to eight sides, from which one is reachable where the column seed holds. Each way is open in both directions, so
    what reaches a seed is a component that has one."""
    known = graphs.labelled(found, diagonal=True)
    return known.join(known.where(seed).select("page_id", "root").distinct(), ["page_id", "root"], "left_semi")


def edges(rasters: DataFrame, low: float = 50.0, high: float = 150.0) -> DataFrame:
    """Runs (page_id, y, x0, x1, at) of edge pixels: strong ones, and weak ones that are connected with those."""
    marked = graphs.pixels(map_images(rasters, lambda s: marks(s, low, high), "int")).where("g > 0")
    return reached(graphs.runs(marked, strongest=F.max("g")), "strongest = 2").select("page_id", "y", "x0", "x1", "at")


def enclosed(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Runs of what runs surround, themselves included: all but the background that reaches the page's border over four sides."""
    background = graphs.labelled(graphs.gaps(found, pages)).join(pages.select("page_id", "width", "height"), "page_id")
    border = (F.col("x0") == 0) | (F.col("y") == 0) | (F.col("x1") == F.col("width") - 1) | (F.col("y") == F.col("height") - 1)
    holes = background.join(background.where(border).select("page_id", "root").distinct(), ["page_id", "root"], "left_anti")
    return graphs.joined(found.select("page_id", "y", "x0", "x1").unionByName(holes.select("page_id", "y", "x0", "x1")))


def outer_contours(found: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, root, x, y, w, h, area) of the outer contours of runs: box, and the area of the polygon through the pixels'
    centres. root is the contour's first pixel.

    Of each square of four neighbouring centres the polygon holds all if they are inside, half if three are. Two runs one above
    the other have as many whole squares as they share steps, and half ones where one goes on beyond the other's end.
    """
    inside = graphs.labelled(enclosed(found, pages), diagonal=True)
    a0, a1, b0, b1 = (F.col(c) for c in ("a.x0", "a.x1", "b.x0", "b.x1"))
    beyond = lambda p0, p1, q0, q1: ((p0 < q0) & (q0 <= p1)).cast("int") + ((q1 < p1) & (p0 <= q1)).cast("int")
    squares = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0)) + 0.5 * (beyond(a0, a1, b0, b1) + beyond(b0, b1, a0, a1))
    met = graphs.touching(inside, diagonal=True).select("page_id", F.col("a.at").alias("at"), squares.alias("area"))
    areas = met.join(inside.select("page_id", "at", "root"), ["page_id", "at"]).groupBy("page_id", "root").agg(F.sum("area").alias("area"))
    boxes = inside.groupBy("page_id", "root").agg(F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"))
    return boxes.join(areas, ["page_id", "root"], "left").withColumn("area", F.coalesce("area", F.lit(0.0)))


def stacked_contours(s: np.ndarray, low: float, high: float) -> tuple[np.ndarray, ...]:
    """(page, x, y, w, h, area) of the outer contours of a stack of pages: the same as outer_contours() of their edges()."""
    found = marks(s, low, high)
    h, w = s.shape[1:]
    marked = stacks.runs(found > 0)
    root = stacks.connected(len(marked.starts), *marked.touching(diagonal=True))
    strong = np.isin(root, root[marked.holding(found > 1)])
    edge = marked.drawn(strong)
    background = stacks.runs(~edge)
    root = stacks.connected(len(background.starts), *background.touching())
    border = (background.x0 == 0) | (background.y == 0) | (background.x1 == w - 1) | (background.y == h - 1)
    inside = stacks.runs(edge | background.drawn(~np.isin(root, root[border])))
    a, b = inside.touching(diagonal=True)
    root = stacks.connected(len(inside.starts), a, b)
    a0, a1, b0, b1 = inside.x0[a], inside.x1[a], inside.x0[b], inside.x1[b]
    beyond = lambda p0, p1, q0, q1: ((p0 < q0) & (q0 <= p1)).astype(int) + ((q1 < p1) & (p0 <= q1))
    squares = np.maximum(0, np.minimum(a1, b1) - np.maximum(a0, b0)) + 0.5 * (beyond(a0, a1, b0, b1) + beyond(b0, b1, a0, a1))
    area = np.bincount(root[a], squares, len(root))
    own = np.flatnonzero(root == np.arange(len(root)))
    return inside.page[own], *(c[own] for c in stacks.boxes(inside, root)), area[own]


def contour_panels(rasters: DataFrame, low: float = 50.0, high: float = 150.0, share: float = 0.01, most: int = STACK_PIXELS) -> DataFrame:
    """(page_id, x, y, w, h, area) of outer contours whose area is more than that share of their page. most: the pixels of a page that
    is worked off in a task, with others; the runs of larger ones are joined over tables."""

    def of(s: np.ndarray) -> tuple[np.ndarray, ...]:
        found = stacked_contours(s, low, high)
        large = found[-1] > share * s.shape[1] * s.shape[2]
        return tuple(c[large] for c in found)

    size = F.col("width").cast("long") * F.col("height")
    found = per_stack(rasters.where((size > 0) & (size <= most)), of, "x long, y long, w long, h long, area double")
    rest = rasters.where(size > most)
    if rest.isEmpty():
        return found
    pages = rest.select("page_id", "width", "height")
    larger = outer_contours(edges(rest, low, high), pages).join(pages, "page_id")
    return found.unionByName(larger.where(F.col("area") > share * F.col("width") * F.col("height")).select("page_id", "x", "y", "w", "h", "area"))
