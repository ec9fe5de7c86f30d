"""Detection on views: what only one view shows is found, boxes return to the page, detectors are plan arguments."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import detectors, views
from inkgrid.operators.batches import per_page

RASTER = "page_id long, width int, height int, g array<double>"


def _corner(rasters):
    """A detector that only sees dark pixels in the top left quarter: one box around them."""

    def of(image):
        ys, xs = np.nonzero(image[: image.shape[0] // 2, : image.shape[1] // 2] < 100)
        return [[xs.min()], [ys.min()], [np.ptp(xs) + 1], [np.ptp(ys) + 1], [90.0]] if len(xs) else [[]] * 5

    return per_page(rasters, of, "x long, y long, w long, h long, conf double")


def _page(x, y, w, h, width=40, height=30):
    image = np.full((height, width), 255.0)
    image[y : y + h, x : x + w] = 0
    return image.ravel().tolist()


def test_a_panel_that_one_view_shows_returns_to_its_place(spark):
    rows = [(1, 40, 30, _page(25, 3, 10, 8)), (2, 40, 30, _page(4, 18, 9, 7)), (3, 40, 30, None), (4, 0, 0, []), (5, 40, 30, _page(22, 18, 9, 7))]
    rasters = spark.createDataFrame(rows, RASTER)
    assert _corner(rasters).count() == 0
    flips = views.AUGMENTED[:2]
    found = {(r["page_id"], r["view"]): (r["x"], r["y"], r["w"], r["h"]) for r in views.detect_on(rasters, _corner, flips).collect()}
    assert found == {(1, "flip_h"): (25, 3, 10, 8), (2, "flip_v"): (4, 18, 9, 7)}


@pytest.mark.parametrize("view", views.AUGMENTED + views.SCALED)
def test_boxes_return_within_a_pixel_or_two(spark, view):
    rasters = spark.createDataFrame([(7, 60, 50, _page(8, 11, 24, 20, 60, 50))], RASTER)

    def dark(shown):
        def of(image):
            # What a smaller scale leaves of the sheet is black and no part of the panel.
            ys, xs = np.nonzero(image[: int(50 * min(1, view.scale)), : int(60 * min(1, view.scale))] == 0) if not view.own_sheet else np.nonzero(image == 0)
            return [[xs.min()], [ys.min()], [np.ptp(xs) + 1], [np.ptp(ys) + 1], [90.0]]

        return per_page(shown, of, "x long, y long, w long, h long, conf double")

    row = views.detect_on(rasters, dark, (view,)).first()
    assert np.abs(np.array([row[c] for c in "xywh"]) - [8, 11, 24, 20]).max() <= 1


def test_boxes_beyond_the_page_go_and_others_are_cut(spark):
    whose = F.expr("named_struct('page_id', 'a', 'view', 'scale_0.9', 'width', 100, 'height', 50)").alias("page_id")
    boxes = spark.createDataFrame([(0, 40, 95, 8, 50.0), (0, 46, 95, 4, 50.0)], "x long, y long, w long, h long, conf double").select(whose, "*")
    found = views.bring_back(boxes, views.AUGMENTED).collect()
    assert [(r["page_id"], r["x"], r["y"], r["w"], r["h"]) for r in found] == [("a", 0, 44, 100, 6)]


def test_several_detectors_agree_and_run_once_each(spark):
    rasters = spark.createDataFrame([(1, 40, 60, _page(0, 15, 40, 20, 40, 60))], RASTER)
    both = {"bands": detectors.row_bands, "again": lambda r: detectors.row_bands(r, bright=210.0)}
    alone = {"bands": detectors.row_bands, "corner": _corner}
    found = views.advanced(rasters, both).collect()
    assert found and all(abs(r["y"] - 15) <= 3 and abs(r["h"] - 20) <= 5 for r in found)
    assert views.advanced(rasters, alone, "average").count() > 0
    assert views.advanced(rasters.limit(0), both).count() == 0
