"""Hand-made images and panels: border rules, worked layouts, numpy references."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import aggregates, panels, regions, scoring, sequences, stencils, strips
from inkgrid.sources import fixtures, images


def raster(spark, *pages):
    return spark.createDataFrame([(i, len(p[0]), len(p), [float(v) for row in p for v in row]) for i, p in enumerate(pages)], "page_id long, width int, height int, g array<double>")


def image(df, page=0):
    r = df.where(F.col("page_id") == page).first()
    return np.array(r["g"], dtype=float).reshape(r["height"], r["width"])


IMPULSE = [[0, 0, 0], [0, 9, 0], [0, 0, 0]]


def test_borders(spark):
    r = raster(spark, IMPULSE)
    assert np.allclose(image(stencils.box_blur(r, 1)), 1)
    assert image(stencils.sobel(r).withColumn("g", F.transform("g", lambda e: e["magnitude"]))).tolist() == [[0] * 3] * 3
    mask = stencils.threshold(r, 1)
    assert image(stencils.dilate(mask, 1)).tolist() == [[0, 255, 0], [255, 255, 255], [0, 255, 0]]
    assert image(stencils.erode(mask, 1)).sum() == 0
    full = stencils.threshold(raster(spark, [[9] * 3] * 3), 1)
    assert image(stencils.erode(full, 1)).tolist() == [[0, 0, 0], [0, 255, 0], [0, 0, 0]]


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (7, 1), (6, 9)])
def test_chained_stencils_equal_numpy(spark, shape):
    page = np.random.default_rng(3).integers(0, 256, shape).astype(float)
    blurred = np.pad(page, 1, mode="edge")
    blurred = sum(blurred[dy : dy + shape[0], dx : dx + shape[1]] for dy in range(3) for dx in range(3)) / 9
    assert np.allclose(image(stencils.box_blur(raster(spark, page.tolist()), 1)), blurred)
    hi, lo = regions._square_extremes(blurred, 1)
    assert np.allclose(image(stencils.morph_gradient(stencils.box_blur(raster(spark, page.tolist()), 1), 1)), hi - lo)


def test_components_touch_by_side_only(spark):
    corner = [[1, 1, 0, 0], [1, 1, 0, 0], [0, 0, 1, 1], [0, 0, 1, 1]]
    side = [[1, 1, 1, 1], [1, 1, 1, 1], [0, 0, 0, 0], [0, 0, 0, 0]]
    found = regions.components(raster(spark, corner, side)).groupBy("page_id").count().orderBy("page_id").collect()
    assert [r["count"] for r in found] == [2, 1]


def test_label_equals_a_walk():
    mask = np.random.default_rng(5).random((20, 30)) > 0.45
    labels = regions.label(mask)
    seen = np.full(mask.shape, -1)
    for start in map(tuple, np.argwhere(mask)):
        if seen[start] < 0:
            todo, name = [start], start[0] * 30 + start[1]
            seen[start] = name
            while todo:
                y, x = todo.pop()
                for dx, dy in regions.FOUR:
                    p = (y + dy, x + dx)
                    if 0 <= p[0] < 20 and 0 <= p[1] < 30 and mask[p] and seen[p] < 0:
                        seen[p] = name
                        todo.append(p)
    assert (labels == seen).all()


def test_otsu_parts_two_values(spark):
    r = aggregates.otsu(fixtures.pixels(raster(spark, [[10, 10, 200, 200]], [[5, 5, 5, 5]]))).orderBy("page_id").collect()
    assert [x["threshold"] for x in r] == [10, 0]


def test_watershed_covers_the_image(spark):
    labels = regions.watershed(raster(spark, [[0, 0, 9, 5, 5]] * 4))
    assert labels.where("label <= 0").count() == 0
    assert labels.select("label").distinct().count() >= 2


def panel_rows(spark, *boxes):
    return spark.createDataFrame([(0, i, *b) for i, b in enumerate(boxes)], "page_id long, seq int, x long, y long, w long, h long, conf long")


def test_inset_duplicate_partial(spark):
    inset = panel_rows(spark, (0, 0, 1000, 1000, 80), (100, 100, 300, 300, 70))
    assert [r["overlapping"] for r in panels.merge_overlapping(inset).orderBy("seq").collect()] == [False, True]
    same = panel_rows(spark, (0, 0, 500, 500, 80), (10, 10, 500, 500, 90))
    merged = panels.merge_overlapping(same).collect()
    assert [(r["x"], r["w"], r["conf"]) for r in merged] == [(0, 510, 90.0)]
    partial = panel_rows(spark, (0, 0, 500, 500, 80), (350, 0, 500, 500, 70))
    assert panels.merge_overlapping(partial).count() == 2
    assert panels.overlaps(partial).first()["overlap"] == "partial"


def test_suppression_keeps_the_first_of_equals(spark):
    same = panel_rows(spark, (0, 0, 100, 100, 50), (0, 0, 100, 100, 50), (300, 0, 100, 100, 40))
    assert sorted(r["seq"] for r in panels.nms(same).collect()) == [0, 2]
    empty = same.limit(0)
    assert panels.nms(empty).count() == panels.fuse_by_area(empty, empty).count() == panels.reading_order(empty).count() == 0


def test_flips_are_undone(spark):
    p = panel_rows(spark, (3, 5, 100, 70, 50))
    back = panels.restore(panels.augment(p, 640, 480), 640, 480)
    assert {(r["x"], r["y"], r["w"], r["h"]) for r in back.collect()} == {(3, 5, 100, 70)}


def test_reading_order_of_a_grid(spark):
    p = panel_rows(spark, (300, 10, 200, 200, 50), (0, 0, 200, 200, 50), (0, 300, 500, 200, 50))
    assert [r["seq"] for r in panels.reading_order(p).orderBy("position").collect()] == [1, 0, 2]


def test_gutters_and_merging(spark):
    profile = spark.createDataFrame([(0, i, 0.0 if 8 <= i < 20 else 1.0) for i in range(40)], "page_id long, pos long, value double")
    assert [r["at"] for r in sequences.gutters(profile, 100, 2, 30).collect()] == [14]
    values = spark.createDataFrame([(0, v) for v in (10, 14, 30, 100)], "page_id long, at long")
    assert sorted(r["at"] for r in sequences.merge_close(values, 10).collect()) == [12, 30, 100]


def test_panel_types_at_the_edges(spark):
    p = panel_rows(spark, (0, 500, 1200, 300, 1), (0, 0, 300, 300, 1), (100, 100, 200, 200, 1), (100, 100, 900, 350, 1), (100, 100, 600, 900, 1))
    assert [r["k"] for r in p.select("seq", scoring.panel_type(1200, 1800).alias("k")).orderBy("seq").collect()] == ["full-width", "bleed", "inset", "split", "standard"]


def test_quality_of_an_empty_page(spark):
    pages = spark.createDataFrame([(0, 100, 100, 0.0, 0.0)], "page_id long, page_w int, page_h int, noise double, compression double")
    r = scoring.quality(panel_rows(spark, (0, 0, 1, 1, 1)).limit(0), pages).first()
    assert (r["precision"], r["recall"], r["score"], r["issues"]) == (0.85, 0.65, 75, "panels may be missing")


def test_files_round_trip(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, body):
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    rows = b"".join(b"\0" + bytes([10 * y, 20, 30] * 3) for y in range(2))
    png = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")
    (tmp_path / "a.PNG").write_bytes(png)
    (tmp_path / "bad.png").write_bytes(b"no image")
    (tmp_path / "notes.txt").write_text("x")
    assert images.list_images(spark, str(tmp_path)).count() == 2
    read = {r["path"].rsplit("/", 1)[1]: r for r in images.read_images(spark, str(tmp_path)).collect()}
    assert (read["a.PNG"]["width"], read["a.PNG"]["height"], read["a.PNG"]["error"]) == (3, 2, None)
    assert read["bad.png"]["error"] == "Invalid image" and read["bad.png"]["data"] is None
    gray = images.to_gray(images.read_images(spark, str(tmp_path))).first()
    assert np.allclose(gray["g"][:3], 0.299 * 0 + 0.587 * 20 + 0.114 * 30) and np.allclose(gray["g"][3:], 0.299 * 10 + 0.587 * 20 + 0.114 * 30)
    crop = images.crops(fixtures.pixels(raster(spark, [[1, 2], [3, 4]])), panel_rows(spark, (1, 0, 1, 2, 1)))
    images.write_crops(crop, str(tmp_path / "out"))
    assert [p.read_text().split() for p in (tmp_path / "out").rglob("part*.txt")] == [["P2", "1", "2", "255", "2", "4"]]


def test_exported_panels_and_dataset_description(spark):
    import struct
    import zlib

    r = raster(spark, [[0, 50, 100], [150, 200, 250]])
    rows = images.export_panels(r, panel_rows(spark, (1, 0, 2, 2, 1), (5, 5, 2, 2, 1))).collect()
    assert [(x["seq"], x["name"]) for x in rows] == [(0, "0_panel_001.png")]
    data = bytes(rows[0]["png"])
    assert struct.unpack(">II", data[16:24]) == (2, 2)
    at = data.index(b"IDAT")
    assert zlib.decompress(data[at + 4 : at + 4 + struct.unpack(">I", data[at - 4 : at])[0]]) == bytes([0, 50, 100, 0, 200, 250])
    assert "nc: 1" in images.dataset_yaml("/data") and "path: /data" in images.dataset_yaml("/data")


def test_panel_measures_equal_loops_over_pixels(spark):
    """Text, motion and brightness on a panel's own pixels, edges on the page's; panels across and off the page, and of one pixel."""
    import math

    w, h = 23, 19
    rng = random.Random(5)
    g = [float(rng.choice([0, 40, 200, 255]) if x < 14 else 10 * (x + y) % 256) for y in range(h) for x in range(w)]
    boxes = [(0, 0, 0, w, h), (1, 3, 2, 9, 8), (2, 15, 4, 30, 30), (3, -4, -3, 12, 12), (4, 5, 5, 1, 1), (5, 50, 2, 5, 5), (6, 12, 3, 2, 14)]
    rasters = spark.createDataFrame([(1, w, h, g), (2, w, h, None)], "page_id long, width int, height int, g array<double>")
    rows = spark.createDataFrame([(p, *b) for p in (1, 2, 3) for b in boxes], "page_id long, seq int, x long, y long, w long, h long")
    found = {r["seq"]: r for r in strips.panel_measures(rasters, rows).collect()}
    assert set(found) == {b[0] for b in boxes}

    def edges(px):
        out = {}
        for (x, y) in px:
            near = [[px.get((x + i, y + j)) for i in (-1, 0, 1)] for j in (-1, 0, 1)]
            if any(v is None for row in near for v in row):
                out[x, y] = (0.0, 0.0)
                continue
            gx = sum(k * (row[2] - row[0]) for k, row in zip((1, 2, 1), near, strict=True))
            gy = sum(k * (near[2][i] - near[0][i]) for i, k in enumerate((1, 2, 1)))
            out[x, y] = (math.hypot(gx, gy), abs(math.degrees(math.atan2(gy, gx))))
        return out

    page = {(x, y): g[y * w + x] for y in range(h) for x in range(w)}
    whole = edges(page)
    for seq, x, y, bw, bh in boxes:
        own = {(i, j): v for (i, j), v in page.items() if x <= i < x + bw and y <= j < y + bh}
        r = found[seq]
        if not own:
            assert [r[c] for c in ("text", "motion", "bright", "edge", "half_bright")] == [0.0] * 5
            continue
        at = edges(own)
        text = [m > 80 and sum(at.get((i + a, j + b), (0,))[0] > 80 for a in range(-2, 3) for b in range(-2, 3)) > 10 for (i, j), (m, _) in at.items()]
        motion = [m > 50 and (30 < a < 60 or 120 < a < 150) for m, a in at.values()]
        half = [p for p in own if (p[0] - x) % 2 == 0 and (p[1] - y) % 2 == 0]
        assert r["text"] == pytest.approx(sum(text) / len(own)) and r["motion"] == pytest.approx(sum(motion) / len(own)) and r["bright"] == pytest.approx(sum(own.values()) / len(own))
        assert r["edge"] == pytest.approx(4 * sum(whole[p][0] > 50 for p in half) / len(half)) and r["half_bright"] == pytest.approx(sum(own[p] for p in half) / len(half))
    assert found[0]["text"] > 0 and found[0]["motion"] > 0
