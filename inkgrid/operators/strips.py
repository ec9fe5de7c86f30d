"""Panels against their page's pixels: how tight they are, what lies in strips beside them, where strong edges are.

A page's panels meet its image once, as one row, and all of them are measured on it in an Arrow batch; images are joined to
the list of panels and never repeated for each. Pixels outside the image are neither content nor edge.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.operators import panels, stencils
from inkgrid.operators.batches import _images

#: What of(image, boxes) gets and gives: boxes has a row (x, y, w, h) for each panel, in order of seq; one list a column.
Measure = Callable[[np.ndarray, np.ndarray], list]


def on_boxes(rasters: DataFrame, boxes: DataFrame, of: Measure, schema: str) -> DataFrame:
    """(page_id, seq, ...) of every panel (page_id, seq, x, y, w, h) whose page has a raster. A page's panels are in one row."""
    names = [c.strip().split()[0] for c in schema.split(",")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[c.strip().split()[1]] for c in schema.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _images(batch.column(3))
            pages, seqs, found = [], [], [[] for _ in names]
            for i, (w, h, listed) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                image = values[offsets[i] : offsets[i + 1]].astype(float).reshape(h, w)
                columns = of(image, np.array([[int(b[c]) for c in "xywh"] for b in listed]))
                pages += [i] * len(listed)
                seqs += [b["seq"] for b in listed]
                for column, new in zip(found, columns, strict=True):
                    column += [x.item() if isinstance(x, np.generic) else x for x in new]
            yield pa.record_batch([batch.column(0).take(pa.array(pages, pa.int64())), pa.array(seqs, pa.int32()), *[pa.array(c, k) for c, k in zip(found, kinds, strict=True)]], names=["page_id", "seq", *names])

    listed = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "w", "h"))).alias("boxes"))
    rows = rasters.where("g IS NOT NULL").join(listed, "page_id").select("page_id", "width", "height", "g", "boxes")
    page = rasters.schema["page_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"page_id {page}, seq int, {schema}")


def _cut(image: np.ndarray, x: int, y: int, w: int, h: int, step_x: int = 1, step_y: int = 1) -> np.ndarray:
    """Every step-th pixel of a rectangle, from its own corner on, of those inside the image."""
    x0, y0 = x if x >= 0 else x % step_x, y if y >= 0 else y % step_y
    return image[y0 : max(0, y + h) : step_y, x0 : max(0, x + w) : step_x]


def _steps(length: int, step: int) -> int:
    return max(0, -(-length // step))


def _content(part: np.ndarray, low: float, high: float) -> int:
    return int(((part > low) & (part < high)).sum())


def tightness(rasters: DataFrame, boxes: DataFrame, border: int = 5, step: int = 3, low: float = 10, high: float = 245) -> DataFrame:
    """(page_id, seq, tightness): share of content among every step-th pixel of the top and bottom strips of border rows."""

    def one(image: np.ndarray, x: int, y: int, w: int, h: int) -> float:
        total = 2 * border * _steps(w, step)
        return sum(_content(_cut(image, x, at, w, border, step), low, high) for at in (y, y + h - border)) / total if total else 0.0

    return on_boxes(rasters, boxes, lambda image, bs: [[one(image, *b) for b in bs]], "tightness double")


def strip_content(rasters: DataFrame, strips: DataFrame, across: int = 10, step: int = 3, low: float = 20, high: float = 235) -> DataFrame:
    """(page_id, seq, right, bottom): whether the strip of across pixels from x on, over h, and the one from y on, over w, have
    more content pixels than twice their sampled length. strips: (page_id, seq, x, y, w, h)."""

    def of(image: np.ndarray, bs: np.ndarray) -> list:
        right = [_content(_cut(image, x, y, across, h, 1, step), low, high) > 2 * h / step for x, y, _, h in bs]
        bottom = [_content(_cut(image, x, y, w, across, step, 1), low, high) > 2 * w / step for x, y, w, _ in bs]
        return [right, bottom]

    return on_boxes(rasters, strips, of, "right boolean, bottom boolean")


def has_structure(rasters: DataFrame, boxes: DataFrame, least_w: int, least_h: int, step: int = 4, low: float = 15, high: float = 240) -> DataFrame:
    """(page_id, seq, valid): large enough, at least a hundredth of the page, and over a tenth of the sampled pixels content."""

    def one(image: np.ndarray, x: int, y: int, w: int, h: int) -> bool:
        if w < least_w or h < least_h or 100 * w * h < image.size:
            return False
        return 10 * _content(_cut(image, x, y, w, h, step, step), low, high) > _steps(w, step) * _steps(h, step)

    return on_boxes(rasters, boxes, lambda image, bs: [[one(image, *b) for b in bs]], "valid boolean")


def _edge_strength(image: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    """Mean difference to the pixel right below over three equal channels, every second pixel of a rectangle."""
    height, width = image.shape
    ys, xs = np.arange(max(0, y), min(height, y + h), 2), np.arange(max(0, x), min(width, x + w), 2)
    ys, xs = ys[ys + 1 < height], xs[xs + 1 < width]
    return float(3 * np.abs(image[np.ix_(ys, xs)] - image[np.ix_(ys + 1, xs + 1)]).mean()) if len(ys) and len(xs) else 0.0


def edge_strength(rasters: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, seq, strength) of rectangles: mean colour difference along the diagonal, every second pixel."""
    return on_boxes(rasters, boxes, lambda image, bs: [[_edge_strength(image, *b) for b in bs]], "strength double")


def attend(rasters: DataFrame, boxes: DataFrame, radius: int = 10, strong: float = 50, grow: int = 2) -> DataFrame:
    """(page_id, seq, x, y, w, h): each side moves out by grow where the strip of radius pixels outside it is strong, within the image."""

    def one(image: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[int, int, int, int]:
        height, width = image.shape
        strips = (x, y - radius, w, radius), (x, y + h, w, radius), (x - radius, y, radius, h), (x + w, y, radius, h)
        top, bottom, left, right = (grow if _edge_strength(image, *s) > strong else 0 for s in strips)
        x, y, w, h = x - left, y - top, w + right, h + bottom
        return max(0, x), max(0, y), min(width - x, w), min(height - y, h)

    return on_boxes(rasters, boxes, lambda image, bs: list(zip(*[one(image, *b) for b in bs], strict=True)), "x long, y long, w long, h long")


def _line(magnitude: np.ndarray, at: int, start: int, length: int, step: int, upright: bool) -> float | None:
    """Summed magnitudes along a column or row, every step-th pixel; None outside the image."""
    m = magnitude.T if not upright else magnitude
    return float(m[max(0, start) : max(0, start + length) : step, at].sum()) if 0 <= at < m.shape[1] else None


def snap_edges(magnitudes: DataFrame, boxes: DataFrame, least_w: int, least_h: int, reach: int = 8, strong: float = 60, step: int = 3) -> DataFrame:
    """(page_id, seq, x, y, w, h): every side on the strongest line within reach whose sum is above strong for each sampled
    pixel, the first of equals; a panel that would lose a fifth of a side, or be too small, stays. magnitudes: rasters of edges."""

    def side(m: np.ndarray, at: int, start: int, length: int, upright: bool) -> int:
        best, found = 0.0, at
        for k in range(at - reach, at + reach + 1):
            s = _line(m, k, start, length, step, upright)
            if s is not None and s > best and s > strong * length / step:
                best, found = s, k
        return found

    def one(m: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[int, int, int, int]:
        left, right = side(m, x, y, h, True), side(m, x + w, y, h, True)
        top, bottom = side(m, y, x, w, False), side(m, y + h, x, w, False)
        new_w, new_h = right - left, bottom - top
        kept = new_w > 0.8 * w and new_h > 0.8 * h and new_w >= least_w and new_h >= least_h
        return (left, top, new_w, new_h) if kept else (x, y, w, h)

    return on_boxes(magnitudes, boxes, lambda m, bs: list(zip(*[one(m, *b) for b in bs], strict=True)), "x long, y long, w long, h long")


def snap_first(magnitudes: DataFrame, boxes: DataFrame, reach: int = 10, times: float = 1.2, step: int = 5) -> DataFrame:
    """(page_id, seq, x, y, w, h): left, right, top and bottom side in turn on the first line within reach whose sum exceeds
    that multiple of the magnitude at the side's own corner."""

    def first(m: np.ndarray, at: int, start: int, length: int, upright: bool, corner: float) -> int:
        for k in range(at - reach, at + reach + 1):
            s = _line(m, k, start, length, step, upright)
            if s is not None and s > times * corner:
                return k
        return at

    def one(m: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[int, int, int, int]:
        corner = lambda px, py: float(m[py, px]) if 0 <= py < m.shape[0] and 0 <= px < m.shape[1] else np.inf
        x = first(m, x, y, h, True, corner(x, y))
        w = first(m, x + w, y, h, True, corner(x + w, y)) - x
        y = first(m, y, x, w, False, corner(x, y))
        h = first(m, y + h, x, w, False, corner(x, y + h)) - y
        return x, y, w, h

    return on_boxes(magnitudes, boxes, lambda m, bs: list(zip(*[one(m, *b) for b in bs], strict=True)), "x long, y long, w long, h long")


def grow_calm(magnitudes: DataFrame, boxes: DataFrame, strong: float = 50, most: int = 100, step: int = 5) -> DataFrame:
    """(page_id, seq, x, y, w, h): left, right, top and bottom side in turn move out, at most so far, until the next line's mean
    edge is strong or the image ends."""

    def one(m: np.ndarray, x: int, y: int, w: int, h: int) -> tuple[int, int, int, int]:
        height, width = m.shape

        def room(at: int, towards: int, start: int, length: int, upright: bool, limit: int) -> int:
            n = 0
            while n < most and 0 <= at < limit and _line(m, at, start, length, step, upright) * step / length <= strong:
                n, at = n + 1, at + towards
            return n

        n = room(x - 1, -1, y, h, True, width)
        x, w = x - n, w + n
        w += room(x + w, 1, y, h, True, width)
        n = room(y - 1, -1, x, w, False, height)
        y, h = y - n, h + n
        return x, y, w, h + room(y + h, 1, x, w, False, height)

    return on_boxes(magnitudes, boxes, lambda m, bs: list(zip(*[one(m, *b) for b in bs], strict=True)), "x long, y long, w long, h long")


#: Gradients of text and of motion, and how many of a 5 x 5 square's pixels, itself included, text needs more than.
TEXT_EDGE, MOTION_EDGE, TEXT_CLUSTER = 80.0, 50.0, 10


def _edges(image: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Magnitudes and directions, 0 at the border."""
    found = stencils.gradient(image[None])
    return found["magnitude"][0], found["direction"][0]


def _around(on: np.ndarray, reach: int) -> np.ndarray:
    """How many set pixels the square around each pixel has, within the image."""
    h, w = on.shape
    sums = np.zeros((h + 1, w + 1), dtype=np.int64)
    sums[1:, 1:] = on.cumsum(0).cumsum(1)
    top, bottom = np.clip(np.arange(h) - reach, 0, h), np.clip(np.arange(h) + reach + 1, 0, h)
    left, right = np.clip(np.arange(w) - reach, 0, w), np.clip(np.arange(w) + reach + 1, 0, w)
    return sums[bottom][:, right] - sums[top][:, right] - sums[bottom][:, left] + sums[top][:, left]


def panel_measures(rasters: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, seq, text, motion, bright, edge, half_bright) of every panel, from its pixels.

    text: share of strong edges among others, motion: share of diagonal edges, bright: mean, all on the panel cut from its page.
    edge and half_bright read every second pixel of both directions on the whole page: four times the share of edges, and the mean.
    A panel off its page has 0 everywhere. A page's pixels are read once for all of its panels.
    """

    def of(image: np.ndarray, bs: np.ndarray) -> list:
        whole, _ = _edges(image)
        out = []
        for x, y, w, h in bs.tolist():
            part = _cut(image, x, y, w, h)
            if not part.size:
                out.append((0.0,) * 5)
                continue
            size, angle = _edges(part)
            turned = np.abs(np.degrees(angle))
            strong = size > TEXT_EDGE
            text = strong & (_around(strong, 2) > TEXT_CLUSTER)
            motion = (size > MOTION_EDGE) & (((turned > 30) & (turned < 60)) | ((turned > 120) & (turned < 150)))
            half = _cut(image, x, y, w, h, 2, 2)
            share = (_cut(whole, x, y, w, h, 2, 2) > MOTION_EDGE).mean() if half.size else 0.0
            out.append((text.mean(), motion.mean(), part.mean(), 4 * share, half.mean() if half.size else 0.0))
        return [list(map(float, c)) for c in zip(*out, strict=True)]

    return on_boxes(rasters, boxes, of, "text double, motion double, bright double, edge double, half_bright double")


def fuse(rasters: DataFrame, cv: DataFrame, ml: DataFrame, least_w: int, least_h: int) -> DataFrame:
    """Fuse two detectors on their pages' images: (page_id, source, seq, x, y, w, h, conf).

    Each first-detector panel takes, in order of seq, the free second-detector panel that overlaps it most. iou over 0.5: the
    tighter of both boxes with the larger confidence; over 0.2: the first box, its right and bottom side drawn in to the second
    one's where that is over 10 pixels tighter and the strip there has no content, with the mean confidence; else the first box at
    80 % confidence. Second-detector panels that nobody took are kept at 70 % if they have structure.
    """
    match = panels.fuse_exclusive(cv, ml)
    m = ml.select("page_id", F.col("seq").alias("match"), *[F.col(c).alias(f"m{c}") for c in "xywh"], F.col("conf").alias("m_conf"))
    own, other = tightness(rasters, cv).withColumnRenamed("tightness", "own"), tightness(rasters, ml).select("page_id", F.col("seq").alias("match"), F.col("tightness").alias("other"))
    met = cv.join(match, ["page_id", "seq"]).join(m, ["page_id", "match"], "left").join(own, ["page_id", "seq"], "left").join(other, ["page_id", "match"], "left")
    common = F.greatest(F.lit(0), F.least(F.expr("x + w"), F.expr("mx + mw")) - F.greatest("x", "mx")) * F.greatest(F.lit(0), F.least(F.expr("y + h"), F.expr("my + mh")) - F.greatest("y", "my"))
    met = met.withColumn("iou", F.coalesce(F.try_divide(common.cast("double"), F.expr("w * h + mw * mh") - common), F.lit(0.0)))
    # The strip from the second detector's right side on, and the one from its bottom on, both along the first box.
    partial = met.where("iou > 0.2 AND iou <= 0.5")
    right = strip_content(rasters, partial.selectExpr("page_id", "seq", "mx + mw AS x", "y", "w", "h")).select("page_id", "seq", "right")
    bottom = strip_content(rasters, partial.selectExpr("page_id", "seq", "x", "my + mh AS y", "w", "h")).select("page_id", "seq", "bottom")
    met = met.join(right, ["page_id", "seq"], "left").join(bottom, ["page_id", "seq"], "left")
    both, some = F.col("iou") > 0.5, F.col("iou") > 0.2
    tighter = both & (F.coalesce("other", F.lit(0.0)) > F.coalesce("own", F.lit(0.0)))
    narrower = ~both & some & (F.expr("mx + mw < x + w - 10")) & ~F.coalesce("right", F.lit(False))
    lower = ~both & some & (F.expr("my + mh < y + h - 10")) & ~F.coalesce("bottom", F.lit(False))
    sizes = {"x": F.col("x"), "y": F.col("y"), "w": F.when(narrower, F.expr("mx + mw - x")).otherwise(F.col("w")), "h": F.when(lower, F.expr("my + mh - y")).otherwise(F.col("h"))}
    conf = F.when(both, F.greatest("conf", "m_conf").cast("double")).when(some, (F.col("conf") + F.col("m_conf")) / 2.0).otherwise(F.col("conf") * 0.8)
    fused = met.select("page_id", F.lit("cv").alias("source"), "seq", *[F.when(tighter, F.col(f"m{c}")).otherwise(v).alias(c) for c, v in sizes.items()], conf.alias("conf"))
    taken = match.where("match IS NOT NULL").select("page_id", F.col("match").alias("seq"))
    left = ml.join(taken, ["page_id", "seq"], "left_anti")
    valid = has_structure(rasters, left, least_w, least_h).where("valid").select("page_id", "seq")
    return fused.union(left.join(valid, ["page_id", "seq"]).select("page_id", F.lit("ml").alias("source"), "seq", "x", "y", "w", "h", (F.col("conf") * 0.7).alias("conf")))
