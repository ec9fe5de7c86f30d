"""Components, forests and contours over tables of pixels against walks over single images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from inkgrid.operators import contours, evaluation, graphs, regions, rounds
from tests.test_operators import raster


def shapes(seed, h=40, w=70, share=0.55):
    return (np.random.default_rng(seed).random((h, w)) < share) * 255.0


def test_components_equal_labels_of_an_image(spark):
    pages = [shapes(1), shapes(2, 3, 200, 0.7), np.zeros((4, 4)), np.full((65, 65), 9.0), np.eye(40) * 9]
    spiral = np.zeros((41, 41))
    for k in range(0, 20, 2):
        spiral[k, k : 41 - k] = spiral[k : 41 - k, 40 - k] = spiral[40 - k, k : 41 - k] = spiral[k + 2 : 41 - k, k] = 1
        spiral[k + 2, k : k + 3] = 1
    rows = regions.components(raster(spark, *[p.tolist() for p in [*pages, spiral]])).collect()
    for i, page in enumerate([*pages, spiral]):
        k, x, y, w, h, n = regions._parts(regions.label(page > 0))
        assert sorted((r["label"], r["x"], r["y"], r["w"], r["h"], r["area"], r["pixels"]) for r in rows if r["page_id"] == i) == sorted(zip(*[c.tolist() for c in (k, x, y, w, h, w * h, n)], strict=True))


def test_long_paths_settle(spark):
    pairs = [(0, a, a + 1) for a in range(1, 900)] + [(1, a, a // 2) for a in range(2, 300)] + [(2, 5, 5), (2, 9, 7), (2, 7, 9), (2, 8, 7)]
    found = {(r["page_id"], r["u"]): r["to"] for r in graphs.roots(spark.createDataFrame(pairs, "page_id long, u long, v long"), "page_id").collect()}
    assert {v for (p, _), v in found.items() if p < 2} == {1} and found[2, 9] == found[2, 8] == 7


def brute_forest(g, seeds):
    """Kruskal over neighbours in the order of (larger value, first pixel, second pixel); trees with a seed never join."""
    h, w = g.shape
    pairs = sorted((max(g[y, x], g[y + dy, x + dx]), y * w + x, (y + dy) * w + x + dx) for y in range(h) for x in range(w) for dx, dy in ((1, 0), (0, 1)) if y + dy < h and x + dx < w)
    root, seed = list(range(h * w)), seeds.ravel().tolist()

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for _, p, q in pairs:
        a, b = find(p), find(q)
        if a != b and not (seed[a] and seed[b]):
            if not seed[a]:
                a, b = b, a
            root[b] = a
    return np.array([seed[find(i)] for i in range(h * w)]).reshape(h, w)


def bottleneck(g, labels, seeds):
    """Least largest value on a way from each pixel to a seed; within its own label if labels are given."""
    cost = np.where(seeds > 0, g, np.inf)
    while True:
        new = cost.copy()
        for axis in (0, 1):
            for step in (1, -1):
                near = np.roll(cost, step, axis)
                edge = np.zeros(g.shape, bool)
                edge[(0 if step == 1 else -1,) if axis == 0 else (slice(None), 0 if step == 1 else -1)] = True
                other = np.zeros(g.shape, bool) if labels is None else np.roll(labels, step, axis) != labels
                new = np.minimum(new, np.where(edge | other, np.inf, np.maximum(near, g)))
        if (new == cost).all():
            return cost
        cost = new


def test_forest_is_the_watershed(spark):
    draw = np.random.default_rng(4)
    pages = [draw.integers(0, 30, (24, 33)).astype(float), draw.integers(0, 3, (16, 16)).astype(float)]
    rows = regions.watershed(raster(spark, *[p.tolist() for p in pages])).collect()
    for i, page in enumerate(pages):
        found = np.zeros(page.shape, int)
        for r in rows:
            if r["page_id"] == i:
                found[r["y"], r["x"]] = r["label"]
        hi, lo = regions._square_extremes(page, 1)
        g = hi - lo
        seeds = regions.label(g <= regions._square_extremes(g, 1)[1]) + 1
        assert (found == brute_forest(g, seeds)).all()
        # Every pixel reaches its own seed over no larger a value than any seed.
        assert (bottleneck(g, found, seeds) == bottleneck(g, None, seeds)).all()
        assert set(np.unique(regions.flood(g, seeds))) == set(np.unique(found))


def test_marks_of_a_bright_square():
    page = np.zeros((1, 12, 12))
    page[0, 3:9, 3:9] = 200
    found = contours.marks(page, 50, 150)[0]
    assert set(np.unique(found)) == {0.0, 2.0} and (found[5] > 0).sum() == 2 and (found[:, 5] > 0).sum() == 2
    assert not contours.marks(np.full((1, 5, 5), 7.0), 50, 150).any()


def test_weak_edges_need_a_strong_one(spark):
    rows = [(0, 0, k, 1) for k in range(5)] + [(0, 1, 5, 2), (0, 2, 8, 1), (0, 3, 20, 1), (0, 4, 21, 1)]
    found = graphs.runs(spark.createDataFrame(rows, "page_id long, y long, x long, g int"), strongest=F.max("g"))
    assert sorted((r["y"], r["x0"], r["x1"]) for r in contours.reached(found, "strongest = 2").collect()) == [(0, 0, 4), (1, 5, 5)]


@pytest.mark.parametrize("seed", [1, 2])
def test_outer_contours_and_their_areas(spark, seed):
    """Areas against the polygon walked around each filled component."""
    mask = np.zeros((30, 40), bool)
    mask[2:20, 3] = mask[2:20, 15] = mask[2, 3:16] = mask[19, 3:16] = True  # a frame with things in it
    mask[6:9, 6:9] = mask[12, 12] = True
    mask[25, 5:30] = True  # a line has no area
    draw = np.random.default_rng(seed)
    mask[3:24, 20:38] |= draw.random((21, 18)) < 0.45
    ys, xs = np.nonzero(mask)
    px = spark.createDataFrame([(0, int(y), int(x)) for y, x in zip(ys, xs, strict=True)], "page_id long, y long, x long")
    pages = spark.createDataFrame([(0, 40, 30)], "page_id long, width int, height int")
    found = {(r["y"], r["x"], r["w"], r["h"], r["area"]) for r in contours.outer_contours(graphs.runs(px), pages).collect()}
    outside = regions.label(np.pad(~mask, 1, constant_values=True))
    filled = np.pad(outside != outside[0, 0], 1)[1:-1, 1:-1]
    assert found == brute_contours(filled)
    assert (2, 3, 13, 18, 204.0) in found and (25, 5, 25, 1, 0.0) in found


def brute_contours(filled):
    """Boxes and shoelace areas of borders followed around each 8-connected component; filled has a margin of one pixel."""
    h, w = filled.shape
    todo, out = filled.copy(), set()
    ring = [(0, -1), (1, -1), (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1)]
    for y0 in range(h):
        for x0 in range(w):
            if not todo[y0, x0]:
                continue
            stack, part = [(y0, x0)], []
            todo[y0, x0] = False
            while stack:
                y, x = stack.pop()
                part.append((y, x))
                for dx, dy in ring:
                    if todo[y + dy, x + dx]:
                        todo[y + dy, x + dx] = False
                        stack.append((y + dy, x + dx))
            own, at, back, walk = set(part), (y0, x0), 6, []
            while True:
                for k in range(1, 9):
                    dx, dy = ring[(back + k) % 8]
                    if (at[0] + dy, at[1] + dx) in own:
                        walk.append((at, (at[0] + dy, at[1] + dx)))
                        back, at = (back + k + 4) % 8, (at[0] + dy, at[1] + dx)
                        break
                else:
                    break
                if len(walk) > 1 and walk[-1] == walk[0]:
                    walk.pop()
                    break
            area = abs(sum(a[1] * b[0] - b[1] * a[0] for a, b in walk)) / 2
            ys, xs = [p[0] for p in part], [p[1] for p in part]
            out.add((min(ys) - 1, min(xs) - 1, max(xs) - min(xs) + 1, max(ys) - min(ys) + 1, area))
    return out


def test_running_sums_over_partitions(spark):
    rows = [(int(v), k) for k, v in enumerate(np.random.default_rng(3).integers(0, 50, 500))]
    frame = spark.createDataFrame(rows, "v int, k int").repartition(7)
    found = rounds.running(frame, [F.desc("v"), F.asc("k")], {"total": "v"}).collect()
    so_far = 0
    for v, k in sorted(rows, key=lambda r: (-r[0], r[1])):
        so_far += v
        assert next(r["total"] for r in found if r["k"] == k) == so_far


def brute_ap(labels, predictions, overlap):
    """Precision by rank over equal confidences, made falling from the right, times steps of recall."""

    def iou(a, b):
        w, h = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
        both = max(0, w) * max(0, h)
        return both / (a[2] * a[3] + b[2] * b[3] - both)

    hits = []
    for page in {p for p, *_ in predictions}:
        free = {s: box for p, s, *box in labels if p == page}
        for _, seq, *box, conf in sorted((r for r in predictions if r[0] == page), key=lambda r: (-r[-1], r[1])):
            near = sorted((-iou(free[s], box), s) for s in free if iou(free[s], box) >= overlap)
            hits.append((conf, bool(near)))
            if near:
                del free[near[0][1]]
    points, found, taken = [], 0, 0
    for conf in sorted({c for c, _ in hits}, reverse=True):
        found += sum(h for c, h in hits if c == conf)
        taken += sum(c == conf for c, _ in hits)
        points.append((found, found / taken))
    area, last = 0.0, 0
    for k, (f, _) in enumerate(points):
        area += (f - last) / len(labels) * max(p for _, p in points[k:])
        last = f
    return area, found / taken, found / len(labels)


def test_average_precision(spark):
    draw = np.random.default_rng(8)
    labels = [(p, s, *(int(v) for v in (draw.integers(0, 60), draw.integers(0, 60), draw.integers(20, 40), draw.integers(20, 40)))) for p in range(25) for s in range(4)]
    predictions = [(p, s + k * 10, x + int(draw.integers(-4, 5)), y + int(draw.integers(-3, 4)), w, h, int(draw.integers(40, 60))) for p, s, x, y, w, h in labels for k in range(2) if draw.random() < 0.7] + [(99, 0, 0, 0, 5, 5, 90)]
    found = {r["overlap"]: r for r in evaluation.average_precision(spark.createDataFrame(labels, "page_id long, seq int, x long, y long, w long, h long"), spark.createDataFrame(predictions, "page_id long, seq int, x long, y long, w long, h long, conf long")).collect()}
    assert len(found) == 10 and found[0.5]["predictions"] == len(predictions)
    for overlap, r in found.items():
        assert np.allclose((r["ap"], r["precision"], r["recall"]), brute_ap(labels, predictions, overlap))
    assert found[0.5]["ap"] > found[0.9]["ap"]


def test_panel_regions_have_the_flood_s_seeds(spark):
    """The surveyed form (blur, squares of 2, low minima within 5): seeds of a flood over one image, each pixel at its least highest step."""
    y, x = np.mgrid[0:40, 0:48]
    page = np.where((x % 24 < 4) | (y % 20 < 4), 250.0, 40.0 + (x * 5 + y * 3) % 30)
    rows = regions.panel_regions(raster(spark, page.tolist(), np.full((12, 12), 9.0).tolist())).collect()
    found = np.zeros(page.shape, int)
    for r in rows:
        if r["page_id"] == 0:
            found[r["y"], r["x"]] = r["label"]
    flooded = regions.segment(page)
    hi, lo = regions._square_extremes(regions.stencils.blurred(page[None], 1.5)[0], 2)
    g = hi - lo
    seeds = regions.label(regions.stencils.minima(g[None], 0.5 * regions.otsu_level(g), 5)[0]) + 1
    assert set(np.unique(found)) == set(np.unique(flooded)) and seeds.any()
    assert np.allclose(bottleneck(g, found, seeds), bottleneck(g, None, seeds))
    boxes = regions.region_boxes(regions.panel_regions(raster(spark, page.tolist())), 8, 8).collect()
    assert all(b["x"] >= 0 and b["x"] + b["w"] <= 48 and b["confidence"] <= 0.7 for b in boxes)
