"""Region formation on rasters: components, distances, watershed, superpixels, stable regions, lines, contours.

One page is one image of bounded size, so algorithms that walk over an image run on a page's array inside the task
that holds it, in Arrow batches of pages: pages are what Spark partitions. Joins and aggregates over what these find
(adjacency, bounding boxes, line pairs) are DataFrame operations.
"""

from __future__ import annotations

import heapq
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgrid.operators import graphs, stacks, stencils
from inkgrid.operators.batches import STACK_PIXELS, per_page, per_stack
from inkgrid.operators.rounds import cut

FOUR = ((1, 0), (-1, 0), (0, 1), (0, -1))


def label(mask: np.ndarray) -> np.ndarray:
    """4-connected components of the set pixels; a component's label is its first pixel's index, -1 elsewhere."""
    return np.where(mask, _joined(mask[:, 1:] & mask[:, :-1], mask[1:] & mask[:-1]), -1)


def _joined(across: np.ndarray, down: np.ndarray) -> np.ndarray:
    """The first pixel that each one is connected with, over joints to the right and down."""
    shape = (across.shape[0], down.shape[1])
    index = np.arange(shape[0] * shape[1]).reshape(shape)
    a = np.concatenate([index[:, :-1][across], index[:-1][down]])
    b = np.concatenate([index[:, 1:][across], index[1:][down]])
    root = index.ravel().copy()
    while True:
        # Neighbours pass on the smaller root, to themselves and to what they point at; then pointers are shortened.
        least = np.minimum(root[a], root[b])
        new = root.copy()
        for at in (a, b, root[a], root[b]):
            np.minimum.at(new, at, least)
        new = new[new]
        if (new == root).all():
            return root.reshape(shape)
        root = new


def _parts(labels: np.ndarray) -> tuple[np.ndarray, ...]:
    """(label, x, y, w, h, pixels) of each label from 0 on, by one sort of the pixels."""
    flat = labels.ravel()
    order = np.argsort(flat, kind="stable")
    order = order[np.searchsorted(flat[order], 0) :]
    if not len(order):
        return tuple(np.zeros(0, dtype=np.int64) for _ in range(6))
    found, starts, n = np.unique(flat[order], return_index=True, return_counts=True)
    ys, xs = np.divmod(order, labels.shape[1])
    x, y = np.minimum.reduceat(xs, starts), np.minimum.reduceat(ys, starts)
    return found, x, y, np.maximum.reduceat(xs, starts) - x + 1, np.maximum.reduceat(ys, starts) - y + 1, n


def _pixelwise(values: np.ndarray) -> list[np.ndarray]:
    """Columns x, y and value of an image."""
    ys, xs = np.divmod(np.arange(values.size), values.shape[1])
    return [xs, ys, values.ravel()]


def components(masks: DataFrame, above: float = 0.0) -> DataFrame:
    """(page_id, label, x, y, w, h, area, pixels) of each 4-connected component; area is the bounding box's, and the label the
    index of its first pixel. Runs of pixels are connected over the cluster, so that a page may be larger than a task."""
    found = graphs.labelled(graphs.runs(graphs.pixels(masks, "width").where(F.col("g") > above), "width"), "width")
    w, h = F.max("x1") - F.min("x0") + 1, F.max("y") - F.min("y") + 1
    boxes = found.groupBy("page_id", "width", "root").agg(F.min("x0").alias("x"), F.min("y").alias("y"), w.alias("w"), h.alias("h"), (w * h).alias("area"), F.sum(F.expr("x1 - x0 + 1")).alias("pixels"))
    return boxes.select("page_id", graphs.index("root").alias("label"), "x", "y", "w", "h", "area", "pixels")


def content_components(masks: DataFrame, least_w: int, least_h: int, above: float = 0.0) -> DataFrame:
    """Components whose box is as large as the smallest panel and more than three tenths full, with that share as fill."""
    found = components(masks, above).withColumn("fill", F.col("pixels") / F.col("area"))
    return found.where((F.col("area") >= least_w * least_h) & (F.col("fill") > 0.3))


def component_labels(masks: DataFrame, above: float = 0.0) -> DataFrame:
    """The label of every pixel as (page_id, x, y, label), -1 outside components."""
    return per_page(masks, lambda image: _pixelwise(label(image > above)), "x long, y long, label long")


def adjacency(labels: DataFrame) -> DataFrame:
    """(page_id, a, b), a < b: labels that touch along a side. labels: (page_id, x, y, label)."""
    here = labels.select("page_id", "x", "y", F.col("label").alias("p"))
    sides = [labels.select("page_id", (F.col("x") - dx).alias("x"), (F.col("y") - dy).alias("y"), F.col("label").alias("q")) for dx, dy in ((1, 0), (0, 1))]
    met = [here.join(s, ["page_id", "x", "y"]).where("p <> q").select("page_id", F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")) for s in sides]
    return met[0].union(met[1]).distinct()


def flood(gradient: np.ndarray, markers: np.ndarray) -> np.ndarray:
    """Watershed: markers (0: none) grow over the lowest gradients first; ties by order of arrival."""
    h, w = markers.shape
    # One more pixel around, labelled already, so that no step leaves the image.
    wide = w + 2
    labels = np.pad(markers.astype(np.int64), 1, constant_values=-1).ravel().tolist()
    cost = np.pad(gradient, 1).ravel().tolist()
    queue = [(cost[i], n, i) for n, i in enumerate(np.flatnonzero(np.array(labels) > 0).tolist())]
    heapq.heapify(queue)
    n = len(queue)
    while queue:
        _, _, i = heapq.heappop(queue)
        for j in (i + 1, i - 1, i + wide, i - wide):
            if not labels[j]:
                labels[j] = labels[i]
                heapq.heappush(queue, (cost[j], n, j))
                n += 1
    return np.array(labels).reshape(h + 2, wide)[1:-1, 1:-1]


def _square_extremes(image: np.ndarray, r: int) -> tuple[np.ndarray, np.ndarray]:
    s = image[None]
    return stencils._extreme(s, r, np.maximum, -np.inf)[0], stencils._extreme(s, r, np.minimum, np.inf)[0]


def _grown(seeded: DataFrame) -> DataFrame:
    """(page_id, x, y, label) of rasters whose g holds (gradient, seed): what each connected part of seeds reaches over the lowest
    gradients, labelled by the part's first pixel's index and one; 0 on pages without a seed.

    The watershed is the minimum spanning forest rooted in the seeds, with the larger gradient of two neighbours as weight: each
    pixel joins the seed from which the highest step of the way is lowest. Equal ones are told apart by the pixels' order.
    """
    px = cut(graphs.pixels(seeded, "width").select("page_id", "width", "x", "y", F.col("g.gradient").alias("w"), (F.col("g.seed") > 0).alias("seed")))
    parts = graphs.labelled(graphs.runs(px.where("seed").select("page_id", "x", "y")))
    seeds = parts.select("page_id", "y", F.explode(F.sequence("x0", "x1")).alias("x"), F.col("root").alias("seed")).select("page_id", graphs.at("x", "y").alias("at"), "seed")
    known = graphs.forest(graphs.grid_edges(px, "w"), seeds)
    found = px.select("page_id", "width", "x", "y", graphs.at("x", "y").alias("at")).join(known, ["page_id", "at"], "left")
    return found.select("page_id", "x", "y", F.coalesce(graphs.index("seed") + 1, F.lit(0)).alias("label"))


def watershed(rasters: DataFrame, radius: int = 1) -> DataFrame:
    """(page_id, x, y, label): regions grown on the morphological gradient from its minima (squares of radius)."""

    def of(s: np.ndarray) -> dict[str, np.ndarray]:
        gradient = stencils._extreme(s, radius, np.maximum, -np.inf) - stencils._extreme(s, radius, np.minimum, np.inf)
        return {"gradient": gradient, "seed": (gradient <= stencils._extreme(gradient, radius, np.minimum, np.inf)).astype(float)}

    return _grown(stencils.map_images(rasters, of, "struct<gradient:double,seed:double>"))


def otsu_level(values: np.ndarray) -> int:
    """The bin of 256 that parts rounded values with the largest variance between both sides; the first of equals."""
    n = np.bincount(np.clip(np.floor(values.ravel() + 0.5), 0, 255).astype(int), minlength=256)
    below, total = np.cumsum(n), np.cumsum(n * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        between = below * above * (total / below - (total[-1] - total) / above) ** 2
    return int(np.argmax(np.nan_to_num(between, posinf=0)))


def segment(image: np.ndarray, sigma: float = 1.5, radius: int = 2, reach: int = 5) -> np.ndarray:
    """Watershed labels from 1 on of the blurred image's gradient, from its low minima, those under half of Otsu's level; 0
    all over without any."""
    hi, lo = _square_extremes(stencils.blurred(image[None], sigma)[0], radius)
    gradient = hi - lo
    seeds = stencils.minima(gradient[None], 0.5 * otsu_level(gradient), reach)[0]
    return flood(gradient, label(seeds) + 1)


def panel_regions(rasters: DataFrame, sigma: float = 1.5, radius: int = 2, reach: int = 5) -> DataFrame:
    """(page_id, x, y, label) of the watershed that panels are read from: from low minima of the blurred image's gradient, those
    under half of Otsu's level."""

    def of(s: np.ndarray) -> dict[str, np.ndarray]:
        soft = stencils.blurred(s, sigma)
        gradient = stencils._extreme(soft, radius, np.maximum, -np.inf) - stencils._extreme(soft, radius, np.minimum, np.inf)
        half = np.array([0.5 * otsu_level(g) for g in gradient])[:, None, None]
        return {"gradient": gradient, "seed": stencils.minima(gradient, half, reach).astype(float)}

    return _grown(stencils.map_images(rasters, of, "struct<gradient:double,seed:double>"))


def region_boxes(labels: DataFrame, least_w: int = 1, least_h: int = 1, fill: float = 0.5) -> DataFrame:
    """Bounding boxes of labels that are large and full enough, with confidence 0.7 times how full they are."""
    boxes = labels.where("label > 0").groupBy("page_id", "label").agg(F.min("x").alias("x"), F.min("y").alias("y"), (F.max("x") - F.min("x") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.count("*").alias("n"))
    full = F.col("n") / (F.col("w") * F.col("h"))
    return boxes.where((F.col("w") >= least_w) & (F.col("h") >= least_h) & (full > fill)).select("page_id", "label", "x", "y", "w", "h", (0.7 * full).alias("confidence"))


def slic(image: np.ndarray, k: int, compactness: float = 10.0, rounds: int = 10) -> np.ndarray:
    """Labels of SLIC clusters: centres of a grid, moved to the lowest gradient around them, then rounds of taking the pixels
    within two steps and averaging; at last only connected parts that are large enough stay labels."""
    h, w = image.shape
    step = max(1.0, (h * w / k) ** 0.5)
    cy, cx = (a.ravel() for a in np.mgrid[step / 2 : h : step, step / 2 : w : step])
    slope = stencils.gradient(image[None])["magnitude"][0]
    for i, (y, x) in enumerate(zip(cy.astype(int), cx.astype(int), strict=True)):
        if 1 <= y < h - 1 and 1 <= x < w - 1:
            dy, dx = np.divmod(int(slope[y - 1 : y + 2, x - 1 : x + 2].argmin()), 3)
            cy[i], cx[i] = y + dy - 1, x + dx - 1
    cg = image[np.minimum(cy.astype(int), h - 1), np.minimum(cx.astype(int), w - 1)]
    ys, xs = (a.ravel().astype(float) for a in np.mgrid[0:h, 0:w])
    labels = np.zeros((h, w), dtype=np.int64)
    for _ in range(rounds):
        best = np.full((h, w), np.inf)
        for i in range(len(cy)):
            y0, y1, x0, x1 = max(0, math.floor(cy[i] - 2 * step)), math.ceil(cy[i] + 2 * step) + 1, max(0, math.floor(cx[i] - 2 * step)), math.ceil(cx[i] + 2 * step) + 1
            part = image[y0:y1, x0:x1]
            far = np.hypot(np.arange(y0, y0 + part.shape[0])[:, None] - cy[i], np.arange(x0, x0 + part.shape[1])[None] - cx[i])
            d = np.where(far <= 2 * step, (part - cg[i]) ** 2 + (far * compactness / step) ** 2, np.inf)
            closer = d < best[y0:y1, x0:x1]
            best[y0:y1, x0:x1][closer] = d[closer]
            labels[y0:y1, x0:x1][closer] = i
        n = np.bincount(labels.ravel(), minlength=len(cy))
        own = n > 0
        for centre, values in ((cy, ys), (cx, xs), (cg, image.ravel())):
            centre[own] = (np.bincount(labels.ravel(), values, minlength=len(cy)) / np.maximum(n, 1))[own]
    return connected(labels, int(step * step / 4))


def superpixels(rasters: DataFrame, k: int, compactness: float = 10.0, rounds: int = 10) -> DataFrame:
    """(page_id, x, y, label) of SLIC clusters, k at most before they are cut into connected parts."""
    return per_page(rasters, lambda image: _pixelwise(slic(image, k, compactness, rounds)), "x long, y long, label long")


def connected(labels: np.ndarray, least: int) -> np.ndarray:
    """New labels from 0 for the connected parts of at least so many pixels; a smaller part's pixels join the nearest of those."""
    parts = _joined(labels[:, 1:] == labels[:, :-1], labels[1:] == labels[:-1])
    found, inverse, n = np.unique(parts, return_inverse=True, return_counts=True)
    large = n >= max(1, least)
    if not large.any():
        return np.zeros(labels.shape, dtype=np.int64)
    # In the order of the old labels, then of the first pixels.
    order = np.lexsort((found, labels.ravel()[found]))
    number = np.full(len(found), -1, dtype=np.int64)
    number[order[large[order]]] = np.arange(large.sum())
    out = number[inverse.reshape(labels.shape)]
    new = out.copy()
    for y, x in np.argwhere(out < 0):
        r = 1
        while True:
            y0, x0 = max(0, y - r), max(0, x - r)
            near = out[y0 : y + r + 1, x0 : x + r + 1]
            ys, xs = np.nonzero(near >= 0)
            d = (ys + y0 - y) ** 2 + (xs + x0 - x) ** 2
            if len(d) and (d.min() <= r * r or r > max(labels.shape)):
                new[y, x] = near[ys[d.argmin()], xs[d.argmin()]]
                break
            r *= 2
    return new


def merge_similar(edges: DataFrame, distances: DataFrame, below: float = 0.5) -> DataFrame:
    """Adjacent regions whose histograms are closer than below: (page_id, a, b). distances: (page_id, a, b, distance)."""
    return edges.join(distances, ["page_id", "a", "b"]).where(F.col("distance") < below).select("page_id", "a", "b")


def component_tree(rasters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dark components of every brightness level that a page has: runs with their component's root, and components
    (page_id, width, level, root, x, y, w, h, n). All levels are one graph whose parts the level keeps apart."""
    px = graphs.pixels(rasters, "width").withColumn("v", F.floor("g"))
    levels = px.groupBy("page_id").agg(F.array_sort(F.collect_set("v")).alias("levels"))  # 256 at most for images of bytes
    upto = px.join(levels, "page_id").select("page_id", "width", "x", "y", F.explode(F.expr("filter(levels, k -> k >= v)")).alias("level"))
    found = graphs.labelled(graphs.runs(upto, "width", "level"), "width", "level")
    sizes = found.groupBy("page_id", "width", "level", "root").agg(
        F.min("x0").alias("x"), F.min("y").alias("y"), (F.max("x1") - F.min("x0") + 1).alias("w"), (F.max("y") - F.min("y") + 1).alias("h"), F.sum(F.expr("x1 - x0 + 1")).alias("n")
    )
    return found, sizes


def stable_regions(rasters: DataFrame, least: int, most: int, delta: int = 5, top: int = 100, task: int = STACK_PIXELS) -> DataFrame:
    """(page_id, level, label, x, y, w, h, n, growth): dark components over all levels that change least.

    growth is the share by which the component around it is larger delta levels on; a page's smallest growths are kept, ties by
    level and label. Pages of up to task pixels are worked off in stacks, larger ones over tables.
    """
    size = F.col("width").cast("long") * F.col("height")
    found = per_stack(rasters.where(size <= task), lambda s: stacks.stable(s, least, most, delta, top), "level double, label long, x long, y long, w long, h long, n long, growth double")
    rest = rasters.where(size > task)
    return found if rest.isEmpty() else found.unionByName(_table_regions(rest, least, most, delta, top))


def _table_regions(rasters: DataFrame, least: int, most: int, delta: int, top: int) -> DataFrame:
    """The same over tables. A component is found again by its first pixel, which lies in a run of the larger one."""
    found, sizes = component_tree(rasters)
    sizes = cut(sizes)
    levels = sizes.select("page_id", "level").distinct()
    wider = levels.alias("a").join(levels.alias("b"), "page_id").where(f"b.level <= a.level + {delta}").groupBy("page_id", F.col("a.level").alias("level")).agg(F.max("b.level").alias("wider"))
    own = sizes.where(F.col("n").between(least, most)).join(wider, ["page_id", "level"]).withColumn("ry", F.shiftright("root", 32)).withColumn("rx", F.col("root").bitwiseAND(F.lit((1 << 32) - 1)))
    there = found.select("page_id", F.col("level").alias("wider"), F.col("y").alias("ry"), "x0", "x1", F.col("root").alias("outer"))
    around = own.join(there, ["page_id", "wider", "ry"]).where("x0 <= rx AND rx <= x1")
    outer = sizes.select("page_id", F.col("level").alias("wider"), F.col("root").alias("outer"), F.col("n").alias("outer_n"))
    rows = around.join(outer, ["page_id", "wider", "outer"]).select("page_id", F.col("level").cast("double").alias("level"), graphs.index("root").alias("label"), "x", "y", "w", "h", "n", ((F.col("outer_n") - F.col("n")) / F.col("n")).alias("growth"))
    place = F.row_number().over(W.partitionBy("page_id").orderBy("growth", "level", "label"))
    return rows.withColumn("_k", place).where(F.col("_k") <= top).drop("_k")


def consensus(points: np.ndarray, seed: int, within: float, share: float, top: int, trials: int) -> list[tuple[float, float, int]]:
    """(angle, rho, strength) of lines through (x, y) points: of the lines through drawn pairs the one with most points in reach,
    then, without those, the next, as long as a line has more than share of the points left. Draws follow from the seed."""
    draw, found = np.random.default_rng(seed), []
    while len(points) > 1 and len(found) < top:
        i, j = draw.integers(0, len(points), (2, trials))
        i, j = i[i != j], j[i != j]
        (x1, y1), (x2, y2) = points[i].T, points[j].T
        angle = np.arctan2(x2 - x1, y1 - y2)
        rho = x1 * np.cos(angle) + y1 * np.sin(angle)
        near = [np.abs(points[:, 0] * np.cos(a) + points[:, 1] * np.sin(a) - r) < within for a, r in zip(angle, rho, strict=True)]
        k = int(np.argmax([n.sum() for n in near])) if near else 0
        if not near or near[k].sum() <= share * len(points):
            break
        found.append((float(angle[k]), float(rho[k]), int(near[k].sum())))
        points = points[~near[k]]
    return sorted(found, key=lambda f: -f[2])


def lines(points: DataFrame, within: float = 1.0, share: float = 0.1, top: int = 10, trials: int = 200) -> DataFrame:
    """(page_id, angle, rho, strength): lines x cos(angle) + y sin(angle) = rho through a page's strong points, by rounds of
    consensus that take a line's points out. points: (page_id, x, y); a page's are in one row, in a fixed order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, found = [], []
            for i, (page, own) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                made = consensus(np.array([(p["x"], p["y"]) for p in own], dtype=float), zlib.crc32(str(page).encode()), within, share, top, trials)
                rows += [i] * len(made)
                found += made
            columns = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.record_batch([batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(c, k) for c, k in zip(columns, (pa.float64(), pa.float64(), pa.int64()), strict=True))], names=["page_id", "angle", "rho", "strength"])

    listed = points.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("y", "x"))).alias("points"))
    return listed.mapInArrow(run, f"page_id {points.schema['page_id'].dataType.simpleString()}, angle double, rho double, strength long")


def snake(image: np.ndarray, contour: np.ndarray, alpha: float = 0.1, beta: float = 0.1, gamma: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Active contour: points move, one after another, to the neighbour of least energy. contour: (n, 2) of x, y."""
    gy, gx = np.gradient(image)
    strength = np.hypot(gx, gy)
    strength = strength / max(strength.max(), 1e-9)
    h, w = image.shape
    points = contour.astype(float).copy()
    n = len(points)
    for _ in range(rounds):
        moved = False
        for i in range(n):
            a, b = points[i - 1], points[(i + 1) % n]
            # A point stays where nothing near is better, so that contours don't drift over flat parts.
            options = [(points[i][0] + dx, points[i][1] + dy) for dx, dy in ((0, 0), *FOUR, (-1, -1), (1, -1), (-1, 1), (1, 1))]
            options = [(x, y) for x, y in options if 0 <= x < w and 0 <= y < h]

            def energy(p: tuple[float, float], a: np.ndarray = a, b: np.ndarray = b) -> float:
                bend = (a[0] + b[0] - 2 * p[0]) ** 2 + (a[1] + b[1] - 2 * p[1]) ** 2
                return (alpha + beta) * bend - gamma * strength[int(p[1]), int(p[0])]

            best = min(options, key=energy)
            moved |= best != tuple(points[i])
            points[i] = best
        if not moved:
            break
    return points


def refine_boundaries(rasters: DataFrame, boxes: DataFrame, points: int = 20, margin: int = 5) -> DataFrame:
    """(page_id, seq, x, y, w, h, boundary) of panels drawn tight by an active contour that starts margin pixels outside them,
    a page's image in one task."""
    listed = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "w", "h"))).alias("boxes"))
    rows = rasters.join(listed, "page_id").select("page_id", "width", "height", "g", "boxes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for page, w, h, g, found in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                image = np.asarray(g, dtype=float).reshape(h, w)
                for b in found:
                    t = np.linspace(0, 4, points, endpoint=False)
                    across = np.clip(np.where(t < 1, t, np.where(t < 2, 1, np.where(t < 3, 3 - t, 0))), 0, 1)
                    down = np.clip(np.where(t < 1, 0, np.where(t < 2, t - 1, np.where(t < 3, 1, 4 - t))), 0, 1)
                    start = np.stack([np.clip(b["x"] - margin + across * (b["w"] + 2 * margin), 0, w - 1).round(), np.clip(b["y"] - margin + down * (b["h"] + 2 * margin), 0, h - 1).round()], axis=1)
                    p = snake(image, start)
                    lo, hi = p.min(axis=0), p.max(axis=0)
                    out.append({"page_id": page, "seq": b["seq"], "x": int(lo[0]), "y": int(lo[1]), "w": int(hi[0] - lo[0]) + 1, "h": int(hi[1] - lo[1]) + 1, "boundary": [{"x": x, "y": y} for x, y in p.tolist()]})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("page_id", pa.int64()), ("seq", pa.int32()), ("x", pa.int64()), ("y", pa.int64()), ("w", pa.int64()), ("h", pa.int64()), ("boundary", pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))]))

    return rows.mapInArrow(run, "page_id long, seq int, x long, y long, w long, h long, boundary array<struct<x:double,y:double>>")
