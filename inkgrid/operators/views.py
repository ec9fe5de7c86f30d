"""Detection on several views of each page: flipped and scaled rasters as rows of one table, any detector run once on all of
them, and what it finds brought back onto the page.

A detector is a function from rasters (page_id, width, height, g) to panels (page_id, x, y, w, h, conf), of any type of page_id: a
view's page_id is a struct of the page's id, the view's name and the page's size, so that boxes return without a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgrid.operators import panels, strips
from inkgrid.operators.batches import _images

Detector = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class View:
    """How a page is shown: mirrored, upside down, or scaled, on a sheet of the page's own size or of the scaled one."""

    name: str
    mirrored: bool = False
    upside_down: bool = False
    scale: float = 1.0
    own_sheet: bool = False

    def drawn(self, image: np.ndarray) -> np.ndarray:
        """The nearest pixels of the image; what it doesn't reach is 0, and what leaves the sheet is cut off."""
        h, w = (max(1, int(n * self.scale + 0.5)) if self.own_sheet else n for n in image.shape)
        ys, xs = (np.floor((np.arange(n) + 0.5) / self.scale).astype(int) for n in (h, w))
        out = np.zeros((h, w))
        ys, xs = ys[ys < image.shape[0]], xs[xs < image.shape[1]]
        turned = image[:: -1 if self.upside_down else 1, :: -1 if self.mirrored else 1]
        out[: len(ys), : len(xs)] = turned[np.ix_(ys, xs)]
        return out


#: The views of test-time augmentation, and those of detection at several scales.
AUGMENTED = (View("flip_h", mirrored=True), View("flip_v", upside_down=True), View("scale_0.9", scale=0.9), View("scale_1.1", scale=1.1))
SCALED = tuple(View(f"scale_{s}", scale=s, own_sheet=True) for s in (0.5, 1.0, 1.5))


def show(rasters: DataFrame, views: tuple[View, ...]) -> DataFrame:
    """Rasters of every view of every page, page_id a struct (page_id, view, width, height). A page without pixels gives none."""
    page = rasters.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _images(batch.column(3))
            for i, (w, h) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                if not batch.column(3)[i].is_valid or not w or not h:
                    continue
                image = values[offsets[i] : offsets[i + 1]].astype(float).reshape(h, w)
                for view in views:
                    seen = view.drawn(image)
                    lists = pa.ListArray.from_arrays(pa.array([0, seen.size], pa.int32()), pa.array(seen.ravel()))
                    size = [pa.array([n], pa.int32()) for n in (w, h, *seen.shape[::-1])]
                    yield pa.record_batch([batch.column(0).slice(i, 1), pa.array([view.name]), *size, lists], names=["page_id", "view", "of_w", "of_h", "width", "height", "g"])

    shown = rasters.select("page_id", "width", "height", "g").mapInArrow(run, f"page_id {page}, view string, of_w int, of_h int, width int, height int, g array<double>")
    whose = F.struct("page_id", "view", F.col("of_w").alias("width"), F.col("of_h").alias("height")).alias("page_id")
    return shown.select(whose, "width", "height", "g")


def bring_back(found: DataFrame, views: tuple[View, ...]) -> DataFrame:
    """(page_id, seq, view, x, y, w, h, conf): boxes found on views in their page's pixels, rounded, as far as they lie on the page;
    seq numbers a page's boxes by view and place. Boxes beyond the page go."""
    of = lambda c: F.col(f"page_id.{c}")

    def told(field: Callable[[View], object]) -> Column:
        return F.element_at(F.create_map(*[F.lit(x) for v in views for x in (v.name, field(v))]), of("view"))

    scale = told(lambda v: float(v.scale))
    whole = lambda c: F.floor(c + 0.5).cast("long")
    x = F.when(told(lambda v: v.mirrored), of("width") - F.col("x") - F.col("w")).otherwise(F.col("x"))
    y = F.when(told(lambda v: v.upside_down), of("height") - F.col("y") - F.col("h")).otherwise(F.col("y"))
    back = found.select(of("page_id").alias("page_id"), of("view").alias("view"), of("width").alias("width"), of("height").alias("height"), whole(x / scale).alias("x"), whole(y / scale).alias("y"), whole(F.col("w") / scale).alias("w"), whole(F.col("h") / scale).alias("h"), "conf")
    zero = F.lit(0).cast("long")
    left, top = F.greatest(zero, "x"), F.greatest(zero, "y")
    right, bottom = F.least(F.col("width"), F.col("x") + F.col("w")), F.least(F.col("height"), F.col("y") + F.col("h"))
    inside = back.where((right > left) & (bottom > top)).select("page_id", "view", left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"), "conf")
    return _numbered(inside)


def _numbered(found: DataFrame) -> DataFrame:
    seq = F.row_number().over(W.partitionBy("page_id").orderBy("view", "y", "x", "w", "h", "conf"))
    return found.select("page_id", seq.alias("seq"), "view", "x", "y", "w", "h", "conf")


def detect_on(rasters: DataFrame, detector: Detector, views: tuple[View, ...] = AUGMENTED, iou: float = 0.5) -> DataFrame:
    """(page_id, seq, view, x, y, w, h, conf, score): what the detector finds on any view, after soft suppression on the page.

    The detector's plan stands once, over the table of all views; suppression is a join by page.
    """
    found = detector(show(rasters, views))
    return panels.soft_nms(bring_back(found, views), iou)


def agreed(detectors: dict[str, Detector], method: str = "vote") -> Detector:
    """One detector of several: panels that they agree on, by vote or as weighted averages."""

    def run(rasters: DataFrame) -> DataFrame:
        place = F.row_number().over(W.partitionBy("page_id").orderBy("y", "x", "w", "h", "conf"))
        found = {name: d(rasters).select("page_id", place.alias("seq"), *[F.col(c).cast("long").alias(c) for c in "xywh"], "conf") for name, d in detectors.items()}
        return panels.ensemble(found, method).select("page_id", "x", "y", "w", "h", "conf")

    return run


def advanced(rasters: DataFrame, detectors: dict[str, Detector], method: str = "vote") -> DataFrame:
    """(page_id, seq, view, x, y, w, h, conf, score): panels that the detectors agree on at several scales and on augmented views,
    sides moved out to strong edges, then soft suppression. The views of both kinds are one table for each detector."""
    views = AUGMENTED + SCALED
    if len({v.name for v in views}) < len(views):
        raise ValueError("views need names of their own")
    found = bring_back(agreed(detectors, method)(show(rasters, views)), views)
    moved = strips.attend(rasters, found.select("page_id", "seq", "x", "y", "w", "h"))
    return panels.soft_nms(moved.join(found.select("page_id", "seq", "view", "conf"), ["page_id", "seq"]))
