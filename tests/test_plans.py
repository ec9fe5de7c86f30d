"""Whole detection on a drawn page, the single detectors' shapes, and the panel stream."""

import json

import numpy as np
from pyspark.sql import functions as F

from inkgrid.operators import detectors, pages as page_metrics, regions
from inkgrid.streaming import pages
from tests.test_operators import raster


def page():
    """Two textured panels side by side, white gutters around and between."""
    image = np.full((64, 128), 255.0)
    texture = np.random.default_rng(1).integers(0, 120, (48, 48))
    image[8:56, 8:56] = texture
    image[8:56, 72:120] = texture
    return image


def test_detects_panels_between_gutters(spark):
    r = raster(spark, page().tolist())
    found = detectors.detect(r, detectors.Options(least_w=24, least_h=24, block=16)).collect()
    centres = {(p["x"] + p["w"] // 2 < 64) for p in found if p["w"] < 100}
    assert centres == {True, False} and [p["position"] for p in found] == sorted(p["position"] for p in found)
    fast = detectors.detect(r, detectors.Options(least_w=24, least_h=24, fast=True, sensitivity=100)).collect()
    assert {"page_id", "panel_id", "kind"} <= set(detectors.detect(r).columns) and len(fast) <= len(found)


def test_signature_and_protection(spark):
    r = raster(spark, page()[:32, :32].tolist(), [[255.0] * 16] * 16)
    rows = {x["page_id"]: x for x in page_metrics.signature(r).collect()}
    assert rows[1]["complexity"] == "low" and rows[1]["brightness"] == 255.0 and "gutter-detection" in rows[0]["algorithms"] and rows[0]["width"] == 32
    masks = detectors.protection(r, 0.1).collect()
    assert len(masks) == 2 and set(masks[0]["g"]) <= {0.0, 255.0} and max(masks[0]["g"]) == 255.0


def test_diagonal_and_hierarchical(spark):
    lines = spark.createDataFrame([(0, 0.6, 30.0), (0, 0.65, 60.0), (0, 0.0, 10.0)], "page_id long, angle double, rho double")
    sizes = spark.createDataFrame([(0, 100, 50)], "page_id long, width int, height int")
    assert [(p["y"], p["h"]) for p in detectors.diagonal(lines, sizes).collect()] == [(0, 50)]
    shaded = np.add.outer(np.arange(80.0), np.arange(80.0)) / 4 + 160
    shaded[10:70, 10:70] -= 90
    shaded[20:60, 20:35] -= 60
    shaded[20:60, 45:60] -= 60
    whole = detectors.watershed_panels(raster(spark, shaded.tolist()), 8, 8).collect()
    found = detectors.hierarchical(raster(spark, shaded.tolist()), 8, 8).collect()
    assert whole and all(p["w"] >= 8 and p["h"] >= 8 and p["x"] >= 0 and p["x"] + p["w"] <= 80 for p in [*whole, *found])


def test_connected_parts_are_relabelled():
    labels = np.array([[0, 0, 1], [0, 1, 1], [2, 1, 0]])
    new = regions.connected(labels, 2)
    assert new.min() == 0 and len(np.unique(new)) == 2


def test_stream_counts_each_panel_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    row = lambda p, s, t: json.dumps({"page_id": p, "seq": s, "x": 0, "y": 0, "w": 1, "h": 1, "conf": 0.5, "found_at": f"2026-01-01T{t}:00Z"})
    (tmp_path / "in" / "a.json").write_text("\n".join([row(1, 0, "10:00"), row(1, 0, "10:01"), row(1, 1, "10:02"), row(2, 0, "12:00")]))
    totals = pages.totals(pages.read_panels(spark, str(tmp_path / "in")))
    pages.write_totals(totals, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    (tmp_path / "in" / "b.json").write_text(row(3, 0, "13:00"))
    pages.write_totals(totals, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    found = spark.read.parquet(str(tmp_path / "out")).where(F.col("page_id") == 1).collect()
    assert [r["panels"] for r in found] == [2]
