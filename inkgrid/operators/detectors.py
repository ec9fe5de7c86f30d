"""Panel detectors on rasters (page_id, width, height, g), and detection as one plan of them.

Detectors that walk over an image run on it in the task that holds it; what they find are rows, and everything after
(overlaps, order, limits, types) is joins, folds and windows by page.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgrid.operators import pages, panels, regions, scoring, sequences, stacks, stencils, strips
from inkgrid.operators.batches import PART_PIXELS, map_images, per_page

BOX = "x long, y long, w long, h long"


@dataclass(frozen=True)
class Options:
    """What detection is told; the defaults suit pages of some thousand pixels a side."""

    least_w: int = 80
    least_h: int = 100
    most_panels: int = 50
    fast: bool = False
    vertical: bool = False
    block: int = 50
    sensitivity: float = 65.0
    superpixels: bool = True
    refine: bool = True


def _numbered(found: DataFrame) -> DataFrame:
    return found.withColumn("seq", F.row_number().over(W.partitionBy("page_id").orderBy("y", "x", "w", "h")).cast("int"))


def _runs(values: np.ndarray, limit: float, least: int, most: int) -> list[int]:
    """Midpoints of runs of least to most values above limit, after a running mean of seven; an open run at the end goes."""
    padded = np.pad(values, 3, mode="edge")
    smooth = np.convolve(padded, np.ones(7) / 7, mode="valid")
    hit = np.diff(np.concatenate([[0], (smooth > limit).astype(int)]))
    starts = np.flatnonzero(hit == 1)
    ends = np.flatnonzero(hit == -1)
    return [int(s + (e - s) / 2) for s, e in zip(starts, ends, strict=False) if least <= e - s <= most]


def _halved(image: np.ndarray) -> np.ndarray:
    """Means of 2 x 2 pixels, of those that exist at an odd edge."""
    return pages._blocks(image, 2) / pages._blocks(np.ones(image.shape), 2)


def gutters_multiscale(rasters: DataFrame, least_h: int = 100, sensitivity: float = 65.0, levels: int = 4, block: int = 8, close: int = 10) -> DataFrame:
    """(page_id, axis, at): gutters across (axis y) and down (axis x) of each page, found at every level of a pyramid.

    A pixel is gutter where the variance of its block is low; rows and columns are gutters where most of their pixels are.
    What the levels find is scaled back, and values that are close become one.
    """

    def of(image: np.ndarray) -> list:
        found: tuple[set[int], set[int]] = (set(), set())
        level = image
        for _ in range(levels):
            h, w = level.shape
            ratio = image.shape[1] / w
            n = pages._blocks(np.ones(level.shape), block)
            mean = pages._blocks(level, block) / n
            still = pages._blocks(level * level, block) / n - mean * mean < 200 - 1.5 * sensitivity
            whole = np.repeat(np.repeat(still, block, axis=0), block, axis=1)[:h, :w]
            least, most = max(2, int(least_h * 0.02 / ratio + 0.5)), int(min(h, w) * 0.15 + 0.5)
            for axis in (0, 1):
                at = _runs(whole.mean(axis=1 - axis), 1 - 0.3 * sensitivity / 100, least, most)
                found[axis].update(int(g * ratio + 0.5) for g in at)
            level = _halved(level)
        axes = [a for a in (0, 1) for _ in found[a]]
        return [axes, [*found[0], *found[1]]]

    found = per_page(rasters, of, "axis int, at long")
    # A page's two axes are merged apart from each other.
    keyed = found.select(F.struct("page_id", "axis").alias("page_id"), "at")
    merged = sequences.merge_close(keyed, close)
    return merged.select("page_id.page_id", F.when(F.col("page_id.axis") == 0, "y").otherwise("x").alias("axis"), "at")


def gutter_grid(rasters: DataFrame, o: Options) -> DataFrame:
    """Cells between the gutters of a page that are large enough."""
    gutters = gutters_multiscale(rasters, o.least_h, o.sensitivity)
    size = rasters.select("page_id", "width", "height")
    spans = []
    for axis, extent in (("y", "height"), ("x", "width")):
        cuts = size.select("page_id", extent).join(gutters.where(F.col("axis") == axis).select("page_id", "at"), "page_id", "left").withColumn("at", F.coalesce("at", F.lit(0)))
        spans.append(sequences.bands(cuts, extent))
    return sequences.band_grid(*spans, o.least_w, o.least_h).withColumn("conf", F.lit(70.0))


def row_bands(rasters: DataFrame, bright: float = 200.0, least_h: int = 8) -> DataFrame:
    """(page_id, x, y, w, h, conf) of the runs of at least least_h rows whose mean is below bright, as wide as the page; the darker
    the surer. Pages without pixels have none."""
    sums = F.expr("transform(sequence(0, height - 1), r -> aggregate(slice(g, r * width + 1, width), 0D, (a, v) -> a + v))")
    rows = rasters.where("width > 0 AND height > 0 AND g IS NOT NULL").select("page_id", "width", F.posexplode(sums).alias("y", "total"))
    full = rows.where(F.col("total") < bright * F.col("width"))
    run = F.col("y") - F.row_number().over(W.partitionBy("page_id").orderBy("y"))
    found = full.withColumn("run", run).groupBy("page_id", "run", "width").agg(F.min("y").alias("y"), F.count("*").alias("h"), F.sum("total").alias("total")).where(F.col("h") >= least_h)
    sure = 100.0 * (1.0 - F.col("total") / (255.0 * F.col("h") * F.col("width")))
    return found.select("page_id", F.lit(0).cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("width").cast("long").alias("w"), "h", sure.alias("conf"))


def borderless(rasters: DataFrame, least_w: int, least_h: int, block: int = 50, calm: float = 30.0, content: float = 0.3) -> DataFrame:
    """Panels without borders: blocks with content and weak edges, grown on all sides until an edge is strong."""

    def of(image: np.ndarray) -> list:
        m = stencils.gradient(image[None])["magnitude"][0]
        n = pages._blocks(np.ones(image.shape), block)
        full = pages._blocks(((image > 20) & (image < 240)).astype(float), block) > content * n
        ys, xs = np.nonzero(full & (pages._blocks(m, block) < calm * n))
        return [xs * block, ys * block, np.minimum(block, image.shape[1] - xs * block), np.minimum(block, image.shape[0] - ys * block)]

    grown = strips.grow_calm(stencils.magnitudes(rasters), _numbered(per_page(rasters, of, BOX)))
    return grown.where((F.col("w") >= least_w) & (F.col("h") >= least_h)).withColumn("conf", F.lit(60.0))


def _watershed_boxes(image: np.ndarray, least_w: float, least_h: float, fill: float = 0.5) -> list[tuple]:
    """(x, y, w, h, conf) of watershed regions that are large and full enough."""
    _, x, y, w, h, n = regions._parts(regions.segment(image) - 1)
    full = n / np.maximum(1, w * h)
    kept = (w >= least_w) & (h >= least_h) & (full > fill)
    return list(zip(*(c[kept].tolist() for c in (x, y, w, h, 70 * full)), strict=True))


def watershed_panels(rasters: DataFrame, least_w: int, least_h: int) -> DataFrame:
    """(page_id, x, y, w, h, conf) of the regions of a page's watershed, grown over the cluster: for pages of any size."""
    found = regions.region_boxes(regions.panel_regions(rasters), least_w, least_h)
    return found.select("page_id", "x", "y", "w", "h", (100 * F.col("confidence")).alias("conf"))


def page_watershed(rasters: DataFrame, least_w: int, least_h: int) -> DataFrame:
    """The same for pages that fit a task, each flooded where it is: no rounds, and ties by order of arrival."""
    return per_page(rasters, lambda image: list(map(list, zip(*_watershed_boxes(image, least_w, least_h), strict=True))) or [[]] * 5, BOX + ", conf double")


def hierarchical(rasters: DataFrame, least_w: int, least_h: int) -> DataFrame:
    """(page_id, x, y, w, h, conf, inset): large watershed panels, or in place of one the panels found inside, if more than one."""

    def of(image: np.ndarray) -> list:
        height, width = image.shape
        found = []
        for x, y, w, h, conf in _watershed_boxes(image, max(least_w, 0.3 * width), max(least_h, 0.2 * height)):
            inner = _watershed_boxes(image[y : y + h, x : x + w], least_w, least_h)
            found += [(x + a, y + b, c, d, e, 1) for a, b, c, d, e in inner] if len(inner) > 1 else [(x, y, w, h, conf, 0)]
        return list(map(list, zip(*found, strict=True))) or [[]] * 6

    rows = per_page(rasters, of, BOX + ", conf double, inset int")
    return rows.withColumn("inset", F.col("inset") == 1)


def superpixel_panels(rasters: DataFrame, pixels_each: int = 10_000, similar: float = 0.5, bins: int = 8) -> DataFrame:
    """(page_id, x, y, w, h, conf): touching superpixels with similar histograms are one panel, its box 25 pixels wider than the
    centres of its parts."""

    def of(image: np.ndarray) -> list:
        labels = regions.slic(image, max(1, round(image.size / pixels_each)))
        n = labels.max() + 1
        values = np.minimum((image / 256 * bins).astype(int), bins - 1)
        counts = np.zeros((n, bins))
        np.add.at(counts, (labels.ravel(), values.ravel()), 1)
        shares = counts / counts.sum(axis=1, keepdims=True)
        touching = {tuple(sorted(p)) for a, b in ((labels[:, 1:], labels[:, :-1]), (labels[1:], labels[:-1])) for p in zip(a[a != b].tolist(), b[a != b].tolist(), strict=True)}
        root = list(range(n))
        for a, b in sorted(touching):
            total = shares[a] + shares[b]
            if ((shares[a] - shares[b]) ** 2 / np.where(total > 0, total, 1)).sum() < similar:
                while root[a] != a:
                    a = root[a]
                while root[b] != b:
                    b = root[b]
                root[max(a, b)] = min(a, b)
        for k in range(n):
            root[k] = root[root[k]]
        size = np.bincount(labels.ravel(), minlength=n)
        ys, xs = np.divmod(np.arange(labels.size), labels.shape[1])
        cy, cx = (np.bincount(labels.ravel(), c, minlength=n) / size for c in (ys, xs))
        found = []
        for k in sorted(set(root)):
            own = [i for i in range(n) if root[i] == k]
            x0, y0 = max(0, int(cx[own].min() - 25)), max(0, int(cy[own].min() - 25))
            x1, y1 = min(labels.shape[1], int(cx[own].max() + 25)), min(labels.shape[0], int(cy[own].max() + 25))
            found.append((x0, y0, x1 - x0, y1 - y0))
        return list(map(list, zip(*found, strict=True)))

    return per_page(rasters, of, BOX).withColumn("conf", F.lit(60.0))


def diagonal(lines: DataFrame, sizes: DataFrame, parallel: float = 0.2, least_tilt: float = 15.0) -> DataFrame:
    """Bounds between each two lines of a page that are near parallel and neither level nor upright. lines: (page_id, angle, rho)."""
    tilt = F.abs(F.degrees("angle")) % 180
    slanted = lines.where((tilt > least_tilt) & (tilt < 180 - least_tilt) & (F.abs(tilt - 90) > least_tilt)).withColumn("i", F.row_number().over(W.partitionBy("page_id").orderBy("angle", "rho")))
    a, b = (slanted.select("page_id", *[F.col(c).alias(f"{c}_{n}") for c in ("i", "angle", "rho")]) for n in "ab")
    met = a.join(b, "page_id").where((F.col("i_a") < F.col("i_b")) & (F.abs(F.col("angle_a") - F.col("angle_b")) < parallel)).join(sizes, "page_id")
    # Where a line leaves the page at the top and at the bottom.
    at = lambda n, y: (F.col(f"rho_{n}") - y * F.sin(F.col(f"angle_{n}"))) / F.nullif(F.cos(F.col(f"angle_{n}")), F.lit(0.0))
    ends = [at(n, y) for n in "ab" for y in (F.lit(0.0), F.col("height"))]
    left, right = F.greatest(F.lit(0.0), F.least(*ends)), F.least(F.col("width").cast("double"), F.greatest(*ends))
    whole = lambda c: F.floor(c + 0.5).cast("long")
    return met.where(right > left).select("page_id", whole(left).alias("x"), F.lit(0).cast("long").alias("y"), whole(right - left).alias("w"), F.col("height").cast("long").alias("h"), F.lit(65.0).alias("conf"))


def diagonal_panels(rasters: DataFrame, strong: float = 80.0, every: int = 2) -> DataFrame:
    """Panels between slanted lines through strong edges, of which every second row and column is looked at."""

    def of(image: np.ndarray) -> list:
        ys, xs = np.nonzero(stencils.gradient(image[None])["magnitude"][0][::every, ::every] > strong)
        return [xs * every, ys * every]

    points = per_page(rasters, of, "x long, y long")
    return diagonal(regions.lines(points, within=5.0), rasters.select("page_id", "width", "height"))


def fast_simple(rasters: DataFrame, least_w: int, least_h: int, least_area: int = 5000) -> DataFrame:
    """Bright components of the blurred page above its Otsu level: (page_id, x, y, w, h, conf)."""

    def of(image: np.ndarray) -> list:
        s = image[None]
        blurred = stencils._running(stencils._running(s, 2, stencils.ACROSS, None) / 5, 2, stencils.DOWN, None) / 5
        return _large(blurred[0] > regions.otsu_level(blurred), least_w, least_h, least_area)

    return per_page(rasters, of, BOX).withColumn("conf", F.lit(80.0))


def _large(mask: np.ndarray, least_w: int, least_h: int, least_area: int) -> list:
    _, x, y, w, h, _ = regions._parts(regions.label(mask))
    kept = (w >= least_w) & (h >= least_h) & (w * h > least_area)
    return [x[kept], y[kept], w[kept], h[kept]]


def fast_optimized(rasters: DataFrame, least_w: int, least_h: int, least_area: int = 5000) -> DataFrame:
    """Like fast_simple on the closed and opened mask, for pages with a grid or vertical layout only."""
    laid_out = pages.signature(rasters).where("layout IN ('grid', 'vertical')").select("page_id")
    found = per_page(rasters, lambda image: _large(pages.opened(image) > 0, least_w, least_h, least_area), BOX)
    return found.join(laid_out, "page_id").withColumn("conf", F.lit(85.0))


def protection(rasters: DataFrame, strength: float = 0.8, skin: DataFrame | None = None) -> DataFrame:
    """Masks (page_id, width, height, g) of what cuts should spare, widened by up to 20 pixels: text, bubbles, and faces.

    Text are stable regions of a letter's size; bubbles are bright insides of closed contours. skin: masks of skin-coloured
    pixels (page_id, g) of colour pages; components of a face's size and shape are faces.
    """
    radius = max(1, round(20 * strength))

    def text_boxes(s: np.ndarray) -> list[tuple]:
        blurred = stencils._running(stencils._running(s, 1, stencils.ACROSS, None) / 3, 1, stencils.DOWN, None) / 3
        page, _, _, x, y, w, h, *_ = stacks.stable(blurred, 30, 5000, 5, 100)
        rows = np.column_stack([page, x, y, w, h]).astype(int)[(30 < w * h) & (w * h < 3000) & (0.2 < w / h) & (w / h < 5)]
        return [tuple(r) for r in np.unique(rows, axis=0).tolist()]

    def bubble_boxes(s: np.ndarray) -> list[tuple]:
        m = stencils.gradient(s)["magnitude"]
        strong = m > np.array([regions.otsu_level(image) for image in m])[:, None, None]
        closed = stencils.eroded(stencils.dilated(np.where(strong, 255.0, 0.0), 3), 3)
        page, x, y, w, h, n = stacks.parts(closed > 0)
        large = (w * h > 1000) & (n > 0.5 * w * h) & (0.5 < w / h) & (w / h < 2.5)
        found = []
        for k, x, y, w, h in np.column_stack([page, x, y, w, h])[large].tolist():
            r = min(w, h) / 4
            inside = s[k, max(0, int(y + h / 2 - r + 0.5)) : int(y + h / 2 + r + 0.5) + 1, max(0, int(x + w / 2 - r + 0.5)) : int(x + w / 2 + r + 0.5) + 1]
            if (inside > 200).sum() > r * r:
                found.append((k, x, y, w, h))
        return found

    def of(s: np.ndarray) -> np.ndarray:
        mask = np.zeros(s.shape)
        for k, x, y, w, h in text_boxes(s) + bubble_boxes(s) if s.size else ():
            mask[k, y : y + h, x : x + w] = 255.0
        return stencils.dilated(mask, radius)

    spared = map_images(rasters, of, most=PART_PIXELS)
    if skin is None:
        return spared

    def faces(s: np.ndarray) -> np.ndarray:
        found = stacks.runs(s > 0)
        root = stacks.connected(len(found.starts), *found.touching())
        _, _, w, h = stacks.boxes(found, root)
        n = np.bincount(root, found.ends - found.starts + 1, len(root))
        face = (w * h > 500) & (n > 0.3 * w * h) & (0.5 < w / h) & (w / h < 2)
        return stencils.dilated(np.where(found.drawn(face[root]), 255.0, 0.0), radius)

    of_faces = map_images(skin, faces).select("page_id", F.col("g").alias("faces"))
    both = spared.join(of_faces, "page_id", "left")
    return both.select("page_id", "width", "height", F.when(F.col("faces").isNull(), F.col("g")).otherwise(F.zip_with("g", "faces", lambda a, b: F.greatest(a, b))).alias("g"))


def detect(rasters: DataFrame, o: Options = Options()) -> DataFrame:
    """Panels (page_id, panel_id, position, x, y, w, h, conf, kind) of every page; pages without any give no row.

    Candidates of the gutter grid, and unless fast of watershed, superpixels, slanted lines, borderless and nested panels; then
    duplicates are merged, sides snapped to strong edges, panels ordered, limited and typed.
    """
    found = {"grid": gutter_grid(rasters, o)}
    if not o.fast:
        found["watershed"] = page_watershed(rasters, o.least_w, o.least_h)
        found["diagonal"] = diagonal_panels(rasters)
        found["borderless"] = borderless(rasters, o.least_w, o.least_h, o.block)
        found["hierarchical"] = hierarchical(rasters, o.least_w, o.least_h)
        if o.superpixels:
            found["superpixels"] = superpixel_panels(rasters)
    every = panels.union_candidates({k: df.select("page_id", *[F.col(c).cast("long").alias(c) for c in "xywh"], "conf") for k, df in found.items()})
    every = every.withColumn("seq", F.row_number().over(W.partitionBy("page_id").orderBy("detector", "y", "x", "w", "h")))
    merged = panels.merge_overlapping(every.select("page_id", "seq", "x", "y", "w", "h", "conf"))
    if o.refine and not o.fast:
        snapped = strips.snap_edges(stencils.magnitudes(rasters), merged.select("page_id", "seq", "x", "y", "w", "h"), o.least_w, o.least_h)
        merged = merged.drop("x", "y", "w", "h").join(snapped, ["page_id", "seq"])
    ordered = merged.join(panels.reading_order(merged, o.vertical), ["page_id", "seq"])
    kept = ordered.where(F.col("position") <= o.most_panels).join(rasters.select("page_id", "width", "height"), "page_id")
    return panels.reindex(kept, "position").select("page_id", "panel_id", "position", "x", "y", "w", "h", "conf", _kind().alias("kind"))


def _kind() -> Column:
    return F.when(F.col("overlapping"), "overlapping").otherwise(scoring.panel_type(F.col("width"), F.col("height")))
