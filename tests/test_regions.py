"""Region operators and stencils on images of 64 x 64 and more, with the parameters for whole pages, against plain walks."""

import time

import numpy as np
import pytest

from inkgrid.operators import detectors, pages, regions, stencils, strips
from tests.test_operators import image, panel_rows, raster

RNG = np.random.default_rng(9)


def scene(h=64, w=64):
    """Textured panels with gutters."""
    y, x = np.mgrid[0:h, 0:w]
    shade = np.kron(RNG.integers(30, 200, (-(-h // 16), -(-w // 16))), np.ones((16, 16)))[:h, :w]
    return np.where((x % 32 < 6) | (y % 32 < 6), 255.0, shade + (x * 7 + y * 13) % 40)


def around(s, y, x, r):
    return s[max(0, y - r) : y + r + 1, max(0, x - r) : x + r + 1]


def walk(s, of):
    return np.array([[of(y, x) for x in range(s.shape[1])] for y in range(s.shape[0])])


@pytest.fixture(scope="module")
def page():
    return scene()


def test_stencils_with_wide_windows_equal_walks(spark, page):
    h, w = page.shape
    r = raster(spark, page.tolist())
    clamped = lambda y, x: page[min(h - 1, max(0, y)), min(w - 1, max(0, x))]
    box = walk(page, lambda y, x: np.mean([clamped(y + j, x + i) for j in range(-3, 4) for i in range(-3, 4)]))
    assert np.allclose(image(stencils.box_blur(r, 3)), box)
    kernel = stencils.gauss_weights(1.5)
    n = len(kernel) // 2
    rows = walk(page, lambda y, x: sum(k * clamped(y, x + i - n) for i, k in enumerate(kernel)))
    gauss = walk(page, lambda y, x: sum(k * rows[min(h - 1, max(0, y + i - n)), x] for i, k in enumerate(kernel)))
    assert np.allclose(image(stencils.gaussian_blur(r, 1.5)), gauss)
    assert np.allclose(image(stencils.morph_gradient(r, 2)), walk(page, lambda y, x: np.ptp(around(page, y, x, 2))))
    assert np.allclose(image(stencils.adaptive_threshold(r, 15, 2)) > 0, walk(page, lambda y, x: page[y, x] > around(page, y, x, 7).mean() - 2))
    inner = lambda y, x, m: m <= y < h - m and m <= x < w - m
    assert (image(stencils.local_minima(r, 120.0, 5)) > 0).tolist() == walk(page, lambda y, x: bool(inner(y, x, 5) and page[y, x] < 120 and page[y, x] <= around(page, y, x, 5).min())).tolist()
    mask = page > 140
    disc = [(j, i) for j in range(-3, 4) for i in range(-3, 4) if i * i + j * j <= 9]
    set_at = lambda y, x: 0 <= y < h and 0 <= x < w and mask[y, x]
    m = stencils.threshold(r, 140.0)
    assert (image(stencils.dilate(m, 3)) > 0).tolist() == walk(page, lambda y, x: any(set_at(y + j, x + i) for j, i in disc)).tolist()
    assert (image(stencils.erode(m, 3)) > 0).tolist() == walk(page, lambda y, x: all(set_at(y + j, x + i) for j, i in disc)).tolist()
    far = walk(page, lambda y, x: min((max(abs(y - v), abs(x - u)) - min(abs(y - v), abs(x - u)) + 1.414 * min(abs(y - v), abs(x - u)) for v, u in np.argwhere(~mask)), default=1e10))
    assert np.allclose(image(stencils.distance_transform(m)), far)
    assert image(stencils.distance_transform(stencils.threshold(raster(spark, [[9] * 4] * 3), 1))).min() == 1e10


def test_pages_of_several_sizes_share_a_batch(spark, page):
    other = scene(20, 33)
    r = raster(spark, page.tolist(), other.tolist(), page[::-1].tolist()).coalesce(1)
    for k, p in enumerate((page, other, page[::-1])):
        assert np.allclose(image(stencils.morph_gradient(r, 1), k), walk(p, lambda y, x, p=p: np.ptp(around(p, y, x, 1))))
    none = spark.createDataFrame([(5, 2, 2, None), (6, 2, 2, [1.0, 2.0, 3.0, 4.0])], "page_id long, width int, height int, g array<double>").coalesce(1)
    found = {x["page_id"]: x["g"] for x in stencils.box_blur(none, 1).collect()}
    assert found[5] is None and len(found[6]) == 4 and regions.components(none).count() == 1 and stencils.box_blur(none.limit(0), 1).count() == 0


def test_watershed_grows_from_the_lowest_first(page):
    gradient = np.abs(np.gradient(page)[0])
    markers = regions.label(gradient <= regions._square_extremes(gradient, 1)[1]) + 1
    labels = markers.copy()
    queue = [(gradient[y, x], n, y, x) for n, (y, x) in enumerate(np.argwhere(labels > 0))]
    n = len(queue)
    while queue:  # the plain form: always the least of all that wait
        k = min(range(len(queue)), key=lambda i: queue[i][:2])
        _, _, y, x = queue.pop(k)
        for dx, dy in ((1, 0), (-1, 0), (0, 1), (0, -1)):
            v, u = y + dy, x + dx
            if 0 <= v < 64 and 0 <= u < 64 and not labels[v, u]:
                labels[v, u] = labels[y, x]
                queue.append((gradient[v, u], n, v, u))
                n += 1
    assert (regions.flood(gradient, markers) == labels).all()


def test_superpixels_are_nearest_connected_and_large(page):
    labels = regions.slic(page, 16)
    step = 16
    assert labels.min() == 0 and len(np.unique(labels)) == labels.max() + 1
    for k in range(labels.max() + 1):
        own = labels == k
        assert own.sum() >= step * step / 4
    small = regions.connected(np.array([[0, 0, 0, 1], [0, 2, 0, 1], [0, 0, 0, 1]]), 2)
    assert small[1, 1] == small[0, 0] and small[0, 3] != small[0, 0]


def test_stable_regions_equal_a_walk_over_every_level(spark):
    page = scene(40, 40)
    found = {(r["level"], r["label"]): (r["x"], r["y"], r["w"], r["h"], r["n"], round(r["growth"], 9)) for r in regions.stable_regions(raster(spark, page.tolist()), 30, 900, 5, 10_000).collect()}
    expected = {}
    for level in np.unique(page):
        labels, wider = regions.label(page <= level), regions.label(page <= level + 5)
        for k in np.unique(labels[labels >= 0]):
            ys, xs = np.nonzero(labels == k)
            if 30 <= len(xs) <= 900:
                outer = (wider == wider[ys[0], xs[0]]).sum()
                expected[int(level), int(k)] = (xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs), round((outer - len(xs)) / len(xs), 9))
    assert found == expected and len(found) > 20


def test_components_equal_numpy(spark, page):
    labels = regions.label(page > 140)
    found = {r["label"]: (r["x"], r["y"], r["w"], r["h"], r["pixels"]) for r in regions.components(raster(spark, page.tolist()), 140).collect()}
    expected = {}
    for k in np.unique(labels[labels >= 0]):
        ys, xs = np.nonzero(labels == k)
        expected[int(k)] = (xs.min(), ys.min(), np.ptp(xs) + 1, np.ptp(ys) + 1, len(xs))
    assert found == expected


def test_lines_through_points(spark):
    points = [(0, x, 10 + x) for x in range(30)] + [(0, x, 40) for x in range(40)] + [(0, 7, 3), (0, 20, 5)]
    found = regions.lines(spark.createDataFrame(points, "page_id long, x long, y long"), trials=200).collect()
    best = max(found, key=lambda r: r["strength"])
    assert best["strength"] >= 40 and abs(abs(np.sin(best["angle"])) - 1) < 1e-6 and abs(abs(best["rho"]) - 40) < 1e-6
    assert any(abs(abs(np.tan(r["angle"])) - 1) < 0.05 and r["strength"] >= 30 for r in found)


def test_contours_tighten_to_edges(spark):
    drawn = np.full((64, 64), 255.0)
    drawn[16:48, 16:48] = 20.0
    r = regions.refine_boundaries(raster(spark, drawn.tolist()), panel_rows(spark, (15, 15, 34, 34, 1)), points=40).first()
    assert len(r["boundary"]) == 40 and 0 <= r["x"] <= 20 and r["x"] + r["w"] >= 44


def test_sides_snap_to_edges_and_grow_over_calm(spark):
    drawn = np.full((80, 80), 200.0)
    drawn[20:60, 20:60] = 20.0
    r = raster(spark, drawn.tolist())
    box = panel_rows(spark, (24, 17, 33, 46, 1))
    s = strips.snap_edges(stencils.magnitudes(r), box, 10, 10).first()
    assert abs(s["x"] - 20) <= 1 and abs(s["y"] - 20) <= 1 and abs(s["x"] + s["w"] - 60) <= 1 and abs(s["y"] + s["h"] - 60) <= 1
    g = strips.grow_calm(stencils.magnitudes(r), panel_rows(spark, (30, 30, 10, 10, 1))).first()
    assert 20 <= g["x"] <= 22 and 20 <= g["y"] <= 22 and 58 <= g["x"] + g["w"] <= 60
    first = strips.snap_first(stencils.magnitudes(r), box).first()
    assert first["x"] == 19 and first["w"] > 0


def test_gutters_at_every_scale(spark):
    drawn = RNG.integers(0, 200, (200, 300)).astype(float)
    drawn[90:110] = 255
    drawn[:, 140:160] = 255
    found = {(r["axis"], r["at"]) for r in detectors.gutters_multiscale(raster(spark, drawn.tolist())).collect()}
    assert any(a == "y" and abs(at - 100) <= 8 for a, at in found) and any(a == "x" and abs(at - 150) <= 8 for a, at in found)


def test_characteristics_equal_plain_sums(spark, page):
    c = pages.characteristics(raster(spark, page.tolist())).first()
    assert (c["brightness"], c["contrast"]) == pytest.approx((page.mean(), page.std()))
    blocks = [page[y : y + 8, x : x + 8].var() for y in range(0, 56, 8) for x in range(0, 56, 8)]
    assert c["compression"] == pytest.approx(np.mean(blocks))
    m = image(stencils.magnitudes(raster(spark, page.tolist())))
    assert (c["edge_density"], c["clarity"]) == pytest.approx(((m > 50).mean(), (m > 100).mean()))


def test_a_whole_page_is_done_in_seconds(spark):
    """A page of 1000 x 1500 through blur, gradient, wide opening, distances and components, each in the published time for all."""
    r = raster(spark, scene(1500, 1000).tolist()).cache()
    r.count()
    for run in (lambda: stencils.gaussian_blur(r, 1.5), lambda: stencils.sobel(r), lambda: stencils.morph_open(stencils.threshold(r, 128.0), 5), lambda: stencils.distance_transform(stencils.threshold(r, 128.0)), lambda: regions.components(stencils.threshold(r, 128.0)), lambda: pages.characteristics(r)):
        began = time.perf_counter()
        assert run().count() > 0
        assert time.perf_counter() - began < 16
