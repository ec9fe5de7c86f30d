"""Stacks of pages against tables of runs, and how few jobs small pages take."""

import time

import numpy as np
from pyspark.sql import functions as F

from inkgrid.operators import contours, detectors, regions, stencils
from tests.test_operators import raster


def scenes(n=6):
    """Pages of several sizes with frames, textures and noise."""
    draw = np.random.default_rng(5)
    out = []
    for k in range(n):
        page = np.full((40 + 9 * (k % 3), 61 - 7 * (k % 2)), 255.0)
        page[4:20, 5:30] = draw.integers(0, 150, (16, 25)) // (1 + k) * 3
        page[24:38, 3:40] = 60 + 10 * k
        page[28:34, 20:26] = 200
        page[:, 45:] = draw.integers(60, 60 + 20 * (k + 1), page[:, 45:].shape)
        out.append(page)
    return [*out, np.zeros((3, 4)), np.full((1, 5), 9.0)]


def jobs(spark, group, run):
    """How many jobs it takes, and its rows."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        rows = run().collect()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)), rows
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_contour_panels_of_stacks_equal_those_over_tables(spark):
    r = raster(spark, *[p.tolist() for p in scenes()])
    count, rows = jobs(spark, "contours", lambda: contours.contour_panels(r, share=0.0))
    assert count <= 4  # each round of joining was a few
    found = sorted(map(tuple, rows))
    assert found == sorted(map(tuple, contours.contour_panels(r, share=0.0, most=2600).collect())) and len({p for p, *_ in found}) > 4


def spared(page, radius):
    """The mask of one page by a walk over each of its levels."""
    blurred = np.floor(stencils._running(stencils._running(page[None], 1, stencils.ACROSS, None) / 3, 1, stencils.DOWN, None)[0] / 3)
    rows = []
    for level in np.unique(blurred):
        wider = regions.label(blurred <= level + 5)
        for k, x, y, w, h, n in zip(*(c.tolist() for c in regions._parts(regions.label(blurred <= level))), strict=True):
            if 30 <= n <= 5000:
                rows.append((((wider == wider.flat[k]).sum() - n) / n, level, k, x, y, w, h))
    found = [r[3:] for r in sorted(rows)[:100] if 30 < r[5] * r[6] < 3000 and 0.2 < r[5] / r[6] < 5]
    m = stencils.gradient(page[None])["magnitude"]
    closed = stencils.eroded(stencils.dilated(np.where(m > regions.otsu_level(m), 255.0, 0.0), 3), 3)[0]
    for _, x, y, w, h, n in zip(*(c.tolist() for c in regions._parts(regions.label(closed > 0))), strict=True):
        r = min(w, h) / 4
        inside = page[max(0, int(y + h / 2 - r + 0.5)) : int(y + h / 2 + r + 0.5) + 1, max(0, int(x + w / 2 - r + 0.5)) : int(x + w / 2 + r + 0.5) + 1]
        if w * h > 1000 and n > 0.5 * w * h and 0.5 < w / h < 2.5 and (inside > 200).sum() > r * r:
            found.append((x, y, w, h))
    mask = np.zeros(page.shape)
    for x, y, w, h in found:
        mask[y : y + h, x : x + w] = 255.0
    return stencils.dilated(mask[None], radius)[0]


def test_protection_of_stacks_equals_a_walk_over_levels(spark):
    pages = [p for p in scenes() if p.size > 1000]
    bubble = np.full((70, 80), 90.0)
    bubble[10:60, 10:60] = np.where(np.arange(50) % 3 == 0, 255.0, 210.0)
    pages.append(bubble)
    skin = [np.zeros(p.shape) for p in pages]
    skin[0][5:35, 8:36] = 255
    skin[1][2:4, 2:50] = 255
    r, faces = raster(spark, *[p.tolist() for p in pages]), raster(spark, *[p.tolist() for p in skin])
    found = {x["page_id"]: np.array(x["g"]).reshape(x["height"], x["width"]) for x in detectors.protection(r, 0.1).collect()}
    assert all((found[i] == spared(p, 2)).all() for i, p in enumerate(pages)) and any(0 < f.mean() < 255 for f in found.values())
    own = np.zeros((1, *pages[0].shape))
    own[0, 5:35, 8:36] = 255
    whole = {x["page_id"]: np.array(x["g"]).reshape(x["height"], x["width"]) for x in detectors.protection(r, 0.1, faces).collect()}
    assert (whole[0] == np.maximum(found[0], stencils.dilated(own, 2)[0])).all() and (whole[1] == found[1]).all()


def test_protection_of_many_textured_pages_is_done_in_seconds(spark):
    draw = np.random.default_rng(8)
    r = raster(spark, *[draw.integers(0, 160, (64, 64)).tolist() for _ in range(8)])
    many = r.crossJoin(spark.range(50)).select((F.col("id") * 8 + F.col("page_id")).alias("page_id"), "width", "height", "g").coalesce(1).cache()
    assert many.count() == 400
    began = time.perf_counter()
    assert detectors.protection(many).count() == 400
    assert time.perf_counter() - began < 30  # a page took a quarter of a second and more


def test_stable_regions_of_stacks_equal_those_over_tables(spark):
    r = raster(spark, *[(p[:20, :30] // 16).tolist() for p in scenes(3)], [[5.0] * 20] * 20)
    count, rows = jobs(spark, "stable", lambda: regions.stable_regions(r, 3, 300, 2, 20))
    assert count <= 4  # each round of joining was a few
    found = sorted(map(tuple, rows))
    over_tables = regions.stable_regions(r, 3, 300, 2, 20, task=500)
    assert found == sorted(map(tuple, over_tables.collect())) and len({p for p, *_ in found}) > 2
    assert regions.stable_regions(r, 3, 300, 2, 20).dtypes == over_tables.dtypes == regions._table_regions(r, 3, 300, 2, 20).dtypes
