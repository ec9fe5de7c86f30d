"""Queries over rasters: pixel projections, stencils, aggregates, gaps and islands, regions. Each with its DuckDB SQL
where SQL can say it in a few joins; the rest is held against numpy in the tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import pixels as px
from inkgrid.operators import aggregates as A
from inkgrid.operators import regions as R
from inkgrid.operators import scoring, sequences
from inkgrid.operators import stencils as S
from inkgrid.sources import fixtures as X
from inkgrid.sources import images


def _rgb() -> tuple[Column, Column, Column]:
    return F.col("r"), F.col("g"), F.col("b")


def _flat(rasters: DataFrame, name: str = "v") -> DataFrame:
    """(page_id, x, y, name) with values rounded, so that sums in another order compare equal."""
    return X.pixels(rasters).select("page_id", "x", "y", F.round(F.col("g").cast("double"), 6).alias(name))


def _mask(s: SparkSession, d: str) -> DataFrame:
    return S.threshold(X.raster8(s, d), 128.0)


def _edges(s: SparkSession, d: str) -> DataFrame:
    flat = X.pixels(S.sobel(X.raster8(s, d)))
    return flat.select("page_id", "x", "y", "g.magnitude", "g.direction")


def _magnitudes(s: SparkSession, d: str) -> DataFrame:
    return S.magnitudes(X.raster8(s, d))


def _px8(s: SparkSession, d: str) -> DataFrame:
    return X.pixels(X.raster8(s, d))


def _lab(s: SparkSession, d: str) -> DataFrame:
    l, a, b = px.lab(*_rgb())  # noqa: E741
    return X.docraster(s, d).groupBy("page_id").agg(*[F.round(F.sum(F.round(c, 4).cast("decimal(20,4)")), 2).cast("double").alias(n) for n, c in (("l", l), ("a", a), ("b", b))])


def _colours(s: SparkSession, d: str) -> DataFrame:
    doc = X.docraster(s, d)
    bright = px.brightness(*_rgb())
    total = lambda c: F.sum(F.when(c, 1).otherwise(0))
    return doc.groupBy("page_id").agg(F.sum(F.round(px.gray(*_rgb()) * 1000).cast("long")).alias("gray"), F.sum(F.round(bright * 3).cast("long")).alias("bright"), total(px.is_skin(*_rgb())).alias("skin"), total(bright > 80).alias("over"), *[total(px.content(bright, lo, hi)).alias(f"content_{lo}") for lo, hi in ((20, 240), (10, 245), (15, 240))])


def _letterbox(s: SparkSession, d: str) -> DataFrame:
    r = X.raster8(s, d)
    return images.letterbox(X.pixels(r), r.select("page_id", "width", "height"), 20).withColumn("v", F.round("v", 6))


def _gutters(s: SparkSession, d: str) -> DataFrame:
    profile = A.share_by(X.docraster(s, d), "y", px.brightness(*_rgb()) > 104, "value").withColumnRenamed("y", "pos")
    return sequences.gutters(profile, 100, 1, 12)


def _layout(s: SparkSession, d: str) -> DataFrame:
    low = lambda axis: A.line_variance(_px8(s, d), axis, 2).groupBy("page_id").agg((F.sum(F.when(F.col("variance") < 1800, 1).otherwise(0)) / F.count("*")).alias(f"low_{axis}"))
    return low("y").join(low("x"), "page_id").select("page_id", scoring.layout_type(F.col("low_y"), F.col("low_x")).alias("layout"))


def _page_stats(s: SparkSession, d: str) -> DataFrame:
    """Brightness, contrast, edge density, clarity and diagonal share of each image, joined by page."""
    edges = _edges(s, d)
    sums = A.page_statistics(_px8(s, d)).join(A.share(edges, F.col("magnitude") > 50, "edge_density"), "page_id").join(A.share(edges, F.col("magnitude") > 100, "clarity"), "page_id").join(A.action_density(edges), "page_id")
    return sums.select("page_id", *[F.round(c, 6).alias(c) for c in ("brightness", "contrast", "edge_density", "clarity", "action")])


def _cut_safety(s: SparkSession, d: str) -> DataFrame:
    """Of each horizontal cut through an image, whether more than a tenth of it runs over set pixels."""
    return A.share_by(X.pixels(_mask(s, d)), "y", F.col("g") > 0, "share").select("page_id", "y", (F.col("share") > 0.1).alias("unsafe"))


def _faces(s: SparkSession, d: str) -> DataFrame:
    found = R.components(_mask(s, d))
    return found.groupBy("page_id").agg(F.count("*").alias("n"), F.sum(F.when((F.col("area") > 4) & (F.col("area") < 30), 1).otherwise(0)).alias("faces"), F.sum(F.when((F.col("w") > 3) & (F.col("h") > 3), 1).otherwise(0)).alias("panels"))


def _quantised(s: SparkSession, d: str) -> DataFrame:
    return X.raster8(s, d).withColumn("g", F.transform("g", lambda v: F.floor(v / 64).cast("double")))


def _adjacent(s: SparkSession, d: str) -> DataFrame:
    return R.adjacency(_px8(s, d).select("page_id", "x", "y", F.floor(F.col("g") / 64).cast("int").alias("label")))


def _superpixel_panels(s: SparkSession, d: str) -> DataFrame:
    r = X.raster8(s, d)
    labels = R.superpixels(r, 4)
    counted = labels.join(_px8(s, d), ["page_id", "x", "y"]).groupBy("page_id", F.col("label").alias("seq"), F.floor(F.col("g") / 32).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    shares = counted.join(counted.groupBy("page_id", "seq").agg(F.sum("n").alias("all")), ["page_id", "seq"]).select("page_id", "seq", "bin", (F.col("n") / F.col("all")).alias("share"))
    return R.merge_similar(R.adjacency(labels), A.chi_square(shares))


QUERIES = {
    "px_colours": _colours,
    "px_lab": _lab,
    "px_threshold": lambda s, d: _flat(_mask(s, d)),
    "px_letterbox": _letterbox,
    "blur_box": lambda s, d: _flat(S.box_blur(X.raster8(s, d), 1)),
    "blur_gauss": lambda s, d: _flat(S.gaussian_blur(X.raster8(s, d), 0.5)),
    "edge_sobel": lambda s, d: _edges(s, d).select("page_id", "x", "y", F.round("magnitude", 6).alias("magnitude"), F.round("direction", 6).alias("direction")),
    "morph_gradient": lambda s, d: _flat(S.morph_gradient(X.raster8(s, d), 1)),
    "morph_dilate": lambda s, d: _flat(S.dilate(_mask(s, d), 1)),
    "morph_erode": lambda s, d: _flat(S.erode(_mask(s, d), 1)),
    "morph_open": lambda s, d: _flat(S.morph_open(_mask(s, d), 1)),
    "morph_close": lambda s, d: _flat(S.morph_close(_mask(s, d), 1)),
    "lbp": lambda s, d: _flat(S.local_binary_pattern(X.raster8(s, d))),
    "adaptive_threshold": lambda s, d: _flat(S.adaptive_threshold(X.raster8(s, d), 3, 2.0)),
    "local_minima": lambda s, d: _flat(S.local_minima(X.raster8(s, d), 200.0, 1)),
    "noise_px": lambda s, d: S.noise(X.raster8(s, d)),
    "edge_neighbors_text": lambda s, d: _flat(S.text_edges(_magnitudes(s, d))),
    "bubble_border_px": lambda s, d: _flat(S.bubble_border(X.raster8(s, d), 3, 140.0, 20.0)),
    "seg_edges": lambda s, d: _flat(S.label_edges(_quantised(s, d))),
    "hist_256": lambda s, d: A.histogram(_px8(s, d)),
    "otsu": lambda s, d: A.otsu(_px8(s, d)),
    "proj_row": lambda s, d: A.share_by(X.docraster(s, d), "y", px.brightness(*_rgb()) > 104, "share").withColumn("share", F.round("share", 6)),
    "proj_col": lambda s, d: A.share_by(X.docraster(s, d), "x", px.brightness(*_rgb()) > 104, "share").withColumn("share", F.round("share", 6)),
    "block_variance": lambda s, d: A.block_variance(_px8(s, d), 4).withColumn("variance", F.round("variance", 6)),
    "line_variance": lambda s, d: A.line_variance(_px8(s, d), "y", 2).withColumn("variance", F.round("variance", 6)),
    "gutter_width_run": lambda s, d: sequences.longest_low_run(A.line_variance(_px8(s, d), "y", 1), "y", 1800, 1),
    "compression_score": lambda s, d: A.block_variance(_px8(s, d), 4).where("n = 16").groupBy("page_id").agg(F.round(F.avg("variance"), 6).alias("score")),
    "page_stats": _page_stats,
    "colourfulness": lambda s, d: A.colourfulness(X.docraster(s, d)).select("page_id", F.round("colourfulness", 6).alias("colourfulness")),
    "text_density": lambda s, d: A.text_density(_edges(s, d), block=4).withColumn("text_density", F.round("text_density", 6)),
    "integral_image": lambda s, d: A.integral_image(_px8(s, d)),
    "pyramid": lambda s, d: A.pyramid(_px8(s, d)).withColumn("g", F.round("g", 6)),
    "lbp_hist": lambda s, d: A.box_histogram(X.pixels(S.local_binary_pattern(X.raster8(s, d))), X.boxes8(X.raster8(s, d))).withColumn("share", F.round("share", 6)),
    "chi2_hist": lambda s, d: A.chi_square(A.box_histogram(_px8(s, d), X.boxes8(X.raster8(s, d)))).withColumn("distance", F.round("distance", 6)),
    "layout_type": _layout,
    "cut_safety": _cut_safety,
    "gutters_1d": _gutters,
    "panel_crops": lambda s, d: images.crops(_px8(s, d), X.boxes8(X.raster8(s, d))),
    "src_downscale": lambda s, d: images.downscale(_px8(s, d), X.raster8(s, d), 4).withColumn("g", F.round("g", 6)),
    "components": lambda s, d: R.components(_mask(s, d)),
    "face_count": _faces,
    "distance_transform": lambda s, d: _flat(S.distance_transform(_mask(s, d)), "d"),
    "region_adjacency": _adjacent,
    "watershed_label": lambda s, d: R.watershed(X.raster8(s, d)),
    "panels_watershed": lambda s, d: R.region_boxes(R.watershed(X.raster8(s, d)), 3, 3).withColumn("confidence", F.round("confidence", 9)),
    "slic": lambda s, d: R.superpixels(X.raster8(s, d), 4),
    "panels_superpixel": _superpixel_panels,
    "mser": lambda s, d: R.stable_regions(X.raster8(s, d), 3, 40, delta=16).withColumn("growth", F.round("growth", 9)),
    "ransac_lines": lambda s, d: R.lines(_edges(s, d).where("magnitude > 200").select("page_id", "x", "y")),
    "snake_refine": lambda s, d: R.refine_boundaries(X.raster8(s, d), X.boxes8(X.raster8(s, d))),
}

_NEAR = "FROM px8 p JOIN px8 q ON q.page_id = p.page_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1"
_INNER = "p.x BETWEEN 1 AND 6 AND p.y BETWEEN 1 AND 6"
_SOBEL = f"""sob AS (SELECT page_id, x, y, CASE WHEN inside THEN sqrt(gx * gx + gy * gy) ELSE 0 END AS magnitude, CASE WHEN inside THEN atan2(gy, gx) ELSE 0 END AS direction FROM (SELECT p.page_id, p.x, p.y, {_INNER} AS inside,
    sum(q.g * (q.x - p.x) * CASE WHEN q.y = p.y THEN 2 ELSE 1 END) AS gx, sum(q.g * (q.y - p.y) * CASE WHEN q.x = p.x THEN 2 ELSE 1 END) AS gy {_NEAR} GROUP BY p.page_id, p.x, p.y))"""
_MASK = "m AS (SELECT page_id, x, y, CASE WHEN g > 128 THEN 255.0::DOUBLE ELSE 0 END AS v FROM px8)"
_DISC = "q.page_id = p.page_id AND abs(q.x - p.x) + abs(q.y - p.y) <= 1"


def _dilated(of: str) -> str:
    return f"SELECT p.page_id, p.x, p.y, max(q.v) AS v FROM {of} p JOIN {of} q ON {_DISC} GROUP BY p.page_id, p.x, p.y"


def _eroded(of: str) -> str:
    return f"SELECT p.page_id, p.x, p.y, CASE WHEN count(*) = 5 THEN min(q.v) ELSE 0 END AS v FROM {of} p JOIN {of} q ON {_DISC} GROUP BY p.page_id, p.x, p.y"


def _blur(weights: list[float]) -> str:
    r = len(weights) // 2
    row = " UNION ALL ".join(f"SELECT {k - r} AS o, {w!r}::DOUBLE AS k" for k, w in enumerate(weights))
    one = "SELECT p.page_id, p.x, p.y, sum(q.g * w.k) AS g FROM {t} p, w JOIN {t} q ON q.page_id = p.page_id AND {c} GROUP BY p.page_id, p.x, p.y"
    across = one.format(t="px8", c="q.y = p.y AND q.x = greatest(0, least(7, p.x + w.o))").replace("FROM px8 p, w JOIN px8 q", "FROM px8 p CROSS JOIN w JOIN px8 q")
    down = one.format(t="a", c="q.x = p.x AND q.y = greatest(0, least(7, p.y + w.o))").replace("FROM a p, w JOIN a q", "FROM a p CROSS JOIN w JOIN a q")
    return X.with_fixtures(f", w AS ({row}), a AS ({across}), b AS ({down}) SELECT page_id, x, y, round(g, 6) AS v FROM b", "px8")


_LBP = " + ".join(f"max(CASE WHEN q.x - p.x = {dx} AND q.y - p.y = {dy} AND q.g >= p.g THEN {1 << k} ELSE 0 END)" for k, (dx, dy) in enumerate(S.LBP))
_LBP_PX = f"lbp AS (SELECT p.page_id, p.x, p.y, CASE WHEN {_INNER} THEN {_LBP} ELSE 0 END AS v {_NEAR} GROUP BY p.page_id, p.x, p.y)"
_VAR = "sum(g * g) / count(*) - (sum(g) / count(*)) * (sum(g) / count(*))"
_BRIGHT = "((r + g + b) / 3.0::DOUBLE)"
_YCC = "(0.299 * r + 0.587 * g + 0.114 * b)::DOUBLE AS yy, (128 - 0.169 * r - 0.331 * g + 0.5 * b)::DOUBLE AS cb, (128 + 0.5 * r - 0.419 * g - 0.081 * b)::DOUBLE AS cr"
_F = lambda t: f"(CASE WHEN {t} > {(6 / 29) ** 3!r} THEN cbrt({t}) ELSE {t} / {3 * (6 / 29) ** 2!r} + {4 / 29!r} END)"
_XYZ = ["(0.4124::DOUBLE * r + 0.3576::DOUBLE * g + 0.1805::DOUBLE * b) / 0.9505::DOUBLE", "(0.2126::DOUBLE * r + 0.7152::DOUBLE * g + 0.0722::DOUBLE * b)", "(0.0193::DOUBLE * r + 0.1192::DOUBLE * g + 0.9505::DOUBLE * b) / 1.089::DOUBLE"]
_IN_BOX = "JOIN boxes8 c ON c.page_id = p.page_id AND p.x >= c.x AND p.x < c.x + c.w AND p.y >= c.y AND p.y < c.y + c.h"
_PROJ = f"SELECT page_id, {{a}}, round(avg(CASE WHEN {_BRIGHT} > 104 THEN 1.0::DOUBLE ELSE 0 END), 6) AS share FROM docpx GROUP BY page_id, {{a}}"
_HALF = "SELECT page_id, x // 2 AS x, y // 2 AS y, avg(g) AS g FROM {} GROUP BY page_id, x // 2, y // 2"
_COMPONENTS = f""", {_MASK}, s AS (SELECT page_id, x, y, y * 8 + x AS i FROM m WHERE v > 0), e AS (SELECT p.page_id, p.i, q.i AS j FROM s p JOIN s q ON {_DISC}),
    reach AS (SELECT page_id, i, i AS j FROM s UNION SELECT r.page_id, r.i, e.j FROM reach r JOIN e ON e.page_id = r.page_id AND e.i = r.j),
    l AS (SELECT page_id, i, min(j) AS label FROM reach GROUP BY page_id, i),
    comp AS (SELECT page_id, label, min(i % 8) AS x, min(i // 8) AS y, max(i % 8) - min(i % 8) + 1 AS w, max(i // 8) - min(i // 8) + 1 AS h, (max(i % 8) - min(i % 8) + 1) * (max(i // 8) - min(i // 8) + 1) AS area, count(*) AS pixels FROM l GROUP BY page_id, label)"""
#: Regions of the watershed on 8 x 8: seeds are connected parts of minima, then neighbours are taken in the order of the larger gradient and
#: joined unless both have a seed; a page's labels are one list, with seeds from 1 on and other trees below 0.
_WATERSHED = f""", gr AS MATERIALIZED (SELECT p.page_id, p.x, p.y, max(q.g) - min(q.g) AS g {_NEAR} GROUP BY p.page_id, p.x, p.y),
    sd AS MATERIALIZED (SELECT p.page_id, p.x, p.y, p.y * 8 + p.x AS i FROM gr p JOIN gr q ON q.page_id = p.page_id AND abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1 GROUP BY p.page_id, p.x, p.y, p.g HAVING p.g <= min(q.g)),
    sr AS (SELECT page_id, i, i AS j FROM sd UNION SELECT r.page_id, r.i, t.i FROM sr r JOIN sd s ON s.page_id = r.page_id AND s.i = r.j JOIN sd t ON t.page_id = s.page_id AND abs(t.x - s.x) + abs(t.y - s.y) = 1),
    sl AS MATERIALIZED (SELECT page_id, i, min(j) + 1 AS l FROM sr GROUP BY page_id, i),
    st AS (SELECT g.page_id, list(coalesce(sl.l, -1 - (g.y * 8 + g.x)) ORDER BY g.y * 8 + g.x) AS l FROM gr g LEFT JOIN sl ON sl.page_id = g.page_id AND sl.i = g.y * 8 + g.x GROUP BY g.page_id),
    eg AS MATERIALIZED (SELECT page_id, p, q, row_number() OVER (PARTITION BY page_id ORDER BY w, p, q) AS k FROM (SELECT a.page_id, a.y * 8 + a.x AS p, b.y * 8 + b.x AS q, greatest(a.g, b.g) AS w FROM gr a JOIN gr b ON b.page_id = a.page_id AND (b.x = a.x + 1 AND b.y = a.y OR b.x = a.x AND b.y = a.y + 1))),
    fl AS (SELECT page_id, 0::BIGINT AS k, l FROM st UNION ALL SELECT f.page_id, f.k + 1, CASE WHEN f.l[e.p + 1] = f.l[e.q + 1] OR f.l[e.p + 1] > 0 AND f.l[e.q + 1] > 0 THEN f.l
        WHEN f.l[e.p + 1] > 0 THEN list_transform(f.l, lambda v: CASE WHEN v = f.l[e.q + 1] THEN f.l[e.p + 1] ELSE v END) ELSE list_transform(f.l, lambda v: CASE WHEN v = f.l[e.p + 1] THEN f.l[e.q + 1] ELSE v END) END FROM fl f JOIN eg e ON e.page_id = f.page_id AND e.k = f.k + 1),
    ws AS MATERIALIZED (SELECT page_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, greatest(l[i], 0) AS label FROM (SELECT page_id, l, unnest(range(1, 65)) AS i FROM fl WHERE k = 112))"""
#: Dark components of every level by the smallest index that spreads, and how much larger the one around each is 16 levels on.
_MSER = """, lv AS MATERIALIZED (SELECT DISTINCT page_id, g AS level FROM px8), dk AS MATERIALIZED (SELECT p.page_id, level, x, y, y * 8 + x AS i FROM px8 p JOIN lv ON lv.page_id = p.page_id AND p.g <= lv.level),
    lab AS MATERIALIZED (WITH RECURSIVE k(page_id, level, i, x, y, l) USING KEY (page_id, level, i) AS (SELECT page_id, level, i, x, y, i AS l FROM dk UNION SELECT r.page_id, r.level, r.i, r.x, r.y, min(n.l)
        FROM (SELECT page_id, level, x + dx AS x, y + dy AS y, l FROM k CROSS JOIN (SELECT unnest([1, -1, 0, 0]) AS dx, unnest([0, 0, 1, -1]) AS dy)) n JOIN recurring.k r ON r.page_id = n.page_id AND r.level = n.level AND r.x = n.x AND r.y = n.y WHERE n.l < r.l GROUP BY r.page_id, r.level, r.i, r.x, r.y) SELECT * FROM k),
    cs AS MATERIALIZED (SELECT page_id, level, l AS label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, count(*) AS n FROM lab GROUP BY page_id, level, l),
    wd AS (SELECT a.page_id, a.level, max(b.level) AS wider FROM lv a JOIN lv b ON b.page_id = a.page_id AND b.level <= a.level + 16 GROUP BY a.page_id, a.level)
    SELECT c.page_id, c.level, c.label, c.x, c.y, c.w, c.h, c.n, (o.n - c.n)::DOUBLE / c.n AS growth FROM cs c JOIN wd ON wd.page_id = c.page_id AND wd.level = c.level JOIN lab a ON a.page_id = c.page_id AND a.level = wd.wider AND a.i = c.label JOIN cs o ON o.page_id = c.page_id AND o.level = wd.wider AND o.label = a.l
    WHERE c.n BETWEEN 3 AND 40 QUALIFY row_number() OVER (PARTITION BY c.page_id ORDER BY (o.n - c.n)::DOUBLE / c.n, c.level, c.label) <= 100"""

ORACLE = {
    "watershed_label": X.with_fixtures(f"{_WATERSHED} SELECT page_id, x, y, label FROM ws", "px8", recursive=True),
    "panels_watershed": X.with_fixtures(f"{_WATERSHED} SELECT page_id, label, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, round(0.7::DOUBLE * (count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1))::DOUBLE), 9) AS confidence FROM ws WHERE label > 0 GROUP BY page_id, label HAVING max(x) - min(x) >= 2 AND max(y) - min(y) >= 2 AND count(*) / ((max(x) - min(x) + 1) * (max(y) - min(y) + 1))::DOUBLE > 0.5", "px8", recursive=True),
    "mser": X.with_fixtures(_MSER.replace("(o.n - c.n)::DOUBLE / c.n AS growth", "round((o.n - c.n)::DOUBLE / c.n, 9) AS growth"), "px8"),
    "px_colours": X.with_fixtures(f", c AS (SELECT page_id, {_BRIGHT} AS bright, r + g + b AS total, {_YCC} FROM docpx) SELECT page_id, cast(sum(cast(round(yy * 1000) AS BIGINT)) AS BIGINT) AS gray, cast(sum(total) AS BIGINT) AS bright, count(*) FILTER (yy > 60 AND cb > 85 AND cb < 135 AND cr > 135 AND cr < 180) AS skin, count(*) FILTER (bright > 80) AS over, count(*) FILTER (bright > 20 AND bright < 240) AS content_20, count(*) FILTER (bright > 10 AND bright < 245) AS content_10, count(*) FILTER (bright > 15 AND bright < 240) AS content_15 FROM c GROUP BY page_id", "docpx"),
    "px_lab": X.with_fixtures(f", u AS (SELECT page_id, r / 255.0::DOUBLE AS r, g / 255.0::DOUBLE AS g, b / 255.0::DOUBLE AS b FROM docpx), t AS (SELECT page_id, {_F(_XYZ[0])} AS x, {_F(_XYZ[1])} AS y, {_F(_XYZ[2])} AS z FROM u) SELECT page_id, " + ", ".join(f"round(sum(cast(round({e}, 4) AS DECIMAL(20, 4))), 2)::DOUBLE AS {n}" for n, e in (("l", "116 * y - 16"), ("a", "500 * (x - y)"), ("b", "200 * (y - z)"))) + " FROM t GROUP BY page_id", "docpx"),
    "px_threshold": X.with_fixtures(f", {_MASK} SELECT page_id, x, y, v FROM m", "px8"),
    "px_letterbox": X.with_fixtures("SELECT p.page_id, i % 20 AS x, i // 20 AS y, round(p.g / 255.0::DOUBLE, 6) AS v FROM px8 p, (SELECT unnest(range(0, 400)) AS i) WHERE p.x = floor((i % 20) / 2.5) AND p.y = floor((i // 20) / 2.5)", "px8"),
    "blur_box": _blur([1 / 3] * 3),
    "blur_gauss": _blur(S.gauss_weights(0.5)),
    "edge_sobel": X.with_fixtures(f", {_SOBEL} SELECT page_id, x, y, round(magnitude, 6) AS magnitude, round(direction, 6) AS direction FROM sob", "px8"),
    "morph_gradient": X.with_fixtures(f"SELECT p.page_id, p.x, p.y, max(q.g) - min(q.g) AS v {_NEAR} GROUP BY p.page_id, p.x, p.y", "px8"),
    "morph_dilate": X.with_fixtures(f", {_MASK} {_dilated('m')}", "px8"),
    "morph_erode": X.with_fixtures(f", {_MASK} {_eroded('m')}", "px8"),
    "morph_open": X.with_fixtures(f", {_MASK}, n AS ({_eroded('m')}) {_dilated('n')}", "px8"),
    "morph_close": X.with_fixtures(f", {_MASK}, n AS ({_dilated('m')}) {_eroded('n')}", "px8"),
    "lbp": X.with_fixtures(f", {_LBP_PX} SELECT page_id, x, y, v::DOUBLE AS v FROM lbp", "px8"),
    "adaptive_threshold": X.with_fixtures(f"SELECT p.page_id, p.x, p.y, CASE WHEN any_value(p.g) > sum(q.g) / count(*) - 2.0 THEN 255.0::DOUBLE ELSE 0 END AS v {_NEAR} GROUP BY p.page_id, p.x, p.y", "px8"),
    "local_minima": X.with_fixtures(f"SELECT p.page_id, p.x, p.y, CASE WHEN {_INNER} AND any_value(p.g) < 200 AND any_value(p.g) <= min(q.g) THEN 1.0::DOUBLE ELSE 0 END AS v {_NEAR} GROUP BY p.page_id, p.x, p.y", "px8"),
    "noise_px": X.with_fixtures(f", n AS (SELECT p.page_id, p.x, p.y, {_INNER} AND abs(any_value(p.g) - sum(q.g) FILTER (q.x <> p.x OR q.y <> p.y) / 4) > 30 AS far FROM px8 p JOIN px8 q ON {_DISC} GROUP BY p.page_id, p.x, p.y) SELECT page_id, count(*) FILTER (far) / count(*)::DOUBLE AS noise FROM n GROUP BY page_id", "px8"),
    "edge_neighbors_text": X.with_fixtures(f", {_SOBEL} SELECT p.page_id, p.x, p.y, CASE WHEN any_value(p.magnitude) > 80 AND count(*) FILTER (q.magnitude > 80) > 10 THEN 1.0::DOUBLE ELSE 0 END AS v FROM sob p JOIN sob q ON q.page_id = p.page_id AND abs(q.x - p.x) <= 2 AND abs(q.y - p.y) <= 2 GROUP BY p.page_id, p.x, p.y", "px8"),
    "bubble_border_px": X.with_fixtures("SELECT p.page_id, p.x, p.y, CASE WHEN any_value(p.g) > 140 AND any_value(p.g) - min(q.g) > 20 THEN 1.0::DOUBLE ELSE 0 END AS v FROM px8 p JOIN px8 q ON q.page_id = p.page_id AND abs(q.x - p.x) IN (0, 3) AND abs(q.y - p.y) IN (0, 3) GROUP BY p.page_id, p.x, p.y", "px8"),
    "seg_edges": X.with_fixtures(f"SELECT p.page_id, p.x, p.y, max(CASE WHEN floor(q.g / 64) <> floor(p.g / 64) THEN 1.0::DOUBLE ELSE 0 END) AS v FROM px8 p JOIN px8 q ON {_DISC} GROUP BY p.page_id, p.x, p.y", "px8"),
    "hist_256": X.with_fixtures("SELECT page_id, cast(floor(g + 0.5) AS INT) AS bin, count(*) AS n FROM px8 GROUP BY page_id, bin", "px8"),
    "otsu": X.with_fixtures(", h AS (SELECT page_id, cast(g AS INT) AS bin, count(*) AS n FROM px8 GROUP BY page_id, bin), c AS (SELECT page_id, bin, sum(n) OVER w AS n0, sum(bin * n) OVER w AS s0, sum(n) OVER (PARTITION BY page_id) AS na, sum(bin * n) OVER (PARTITION BY page_id) AS sa FROM h WINDOW w AS (PARTITION BY page_id ORDER BY bin)), v AS (SELECT page_id, bin, CASE WHEN na = n0 THEN 0 ELSE n0::DOUBLE * (na - n0) * (s0::DOUBLE / n0 - (sa - s0)::DOUBLE / (na - n0)) * (s0::DOUBLE / n0 - (sa - s0)::DOUBLE / (na - n0)) END AS b FROM c) SELECT page_id, CASE WHEN max(b) > 0 THEN arg_max(bin, (b, -bin)) ELSE 0 END AS threshold FROM v GROUP BY page_id", "px8"),
    "proj_row": X.with_fixtures(_PROJ.format(a="y"), "docpx"),
    "proj_col": X.with_fixtures(_PROJ.format(a="x"), "docpx"),
    "block_variance": X.with_fixtures(f"SELECT page_id, x // 4 AS bx, y // 4 AS by, count(*) AS n, round({_VAR}, 6) AS variance FROM px8 GROUP BY page_id, x // 4, y // 4", "px8"),
    "line_variance": X.with_fixtures(f"SELECT page_id, y, round({_VAR}, 6) AS variance FROM px8 WHERE y % 2 = 0 GROUP BY page_id, y", "px8"),
    "gutter_width_run": X.with_fixtures(f", v AS (SELECT page_id, y, {_VAR} AS v FROM px8 GROUP BY page_id, y), l AS (SELECT page_id, y - row_number() OVER (PARTITION BY page_id ORDER BY y) AS island FROM v WHERE v < 1800), r AS (SELECT page_id, count(*) AS n FROM l GROUP BY page_id, island) SELECT p.page_id, coalesce(max(r.n), 0) AS width FROM (SELECT DISTINCT page_id FROM px8) p LEFT JOIN r ON r.page_id = p.page_id GROUP BY p.page_id", "px8"),
    "compression_score": X.with_fixtures(f", v AS (SELECT page_id, {_VAR} AS v FROM px8 GROUP BY page_id, x // 4, y // 4) SELECT page_id, round(avg(v), 6) AS score FROM v GROUP BY page_id", "px8"),
    "page_stats": X.with_fixtures(f", {_SOBEL}, e AS (SELECT page_id, count(*) FILTER (magnitude > 50) / count(*)::DOUBLE AS edge_density, count(*) FILTER (magnitude > 100) / count(*)::DOUBLE AS clarity, coalesce(count(*) FILTER (magnitude > 50 AND (abs(degrees(direction)) > 30 AND abs(degrees(direction)) < 60 OR abs(degrees(direction)) > 120 AND abs(degrees(direction)) < 150)) / nullif(count(*) FILTER (magnitude > 50), 0)::DOUBLE, 0) AS action FROM sob GROUP BY page_id), g AS (SELECT page_id, avg(g) AS brightness, sqrt({_VAR}) AS contrast FROM px8 GROUP BY page_id) SELECT page_id, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("brightness", "contrast", "edge_density", "clarity", "action")) + " FROM g JOIN e USING (page_id)", "px8"),
    "colourfulness": X.with_fixtures(f", c AS (SELECT page_id, {_BRIGHT} AS m, r, g, b FROM docpx) SELECT page_id, round(sqrt(avg(((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 3)), 6) AS colourfulness FROM c GROUP BY page_id", "docpx"),
    "text_density": X.with_fixtures(f", {_SOBEL}, c AS (SELECT page_id, count(*) AS n, count(*) FILTER (magnitude > 80) AS hard FROM sob GROUP BY page_id, x // 4, y // 4) SELECT page_id, round(sum(CASE WHEN hard > 0.3 * n THEN n ELSE 0 END) / sum(n)::DOUBLE, 6) AS text_density FROM c GROUP BY page_id", "px8"),
    "integral_image": X.with_fixtures("SELECT p.page_id, p.x, p.y, sum(q.g) AS total FROM px8 p JOIN px8 q ON q.page_id = p.page_id AND q.x <= p.x AND q.y <= p.y GROUP BY p.page_id, p.x, p.y", "px8"),
    "pyramid": X.with_fixtures(f", a AS ({_HALF.format('px8')}), b AS ({_HALF.format('a')}), c AS ({_HALF.format('b')}) " + " UNION ALL ".join(f"SELECT page_id, {k} AS level, x, y, round(g, 6) AS g FROM {t}" for k, t in enumerate(("px8", "a", "b", "c"))), "px8"),
    "lbp_hist": X.with_fixtures(f", {_LBP_PX} SELECT p.page_id, c.seq, v AS bin, round(count(*) / sum(count(*)) OVER (PARTITION BY p.page_id, c.seq)::DOUBLE, 6) AS share FROM lbp p {_IN_BOX} GROUP BY p.page_id, c.seq, v", "px8", "boxes8"),
    "chi2_hist": X.with_fixtures(f", h AS (SELECT p.page_id, c.seq, cast(g AS INT) AS bin, count(*) / sum(count(*)) OVER (PARTITION BY p.page_id, c.seq)::DOUBLE AS v FROM px8 p {_IN_BOX} GROUP BY p.page_id, c.seq, bin), j AS (SELECT coalesce(a.page_id, b.page_id) AS page_id, coalesce(a.v, 0) AS va, coalesce(b.v, 0) AS vb FROM (FROM h WHERE seq = 0) a FULL JOIN (FROM h WHERE seq = 1) b ON a.page_id = b.page_id AND a.bin = b.bin) SELECT page_id, 0 AS a, 1 AS b, round(sum((va - vb) * (va - vb) / (va + vb)), 6) AS distance FROM j GROUP BY page_id", "px8", "boxes8"),
    "layout_type": X.with_fixtures(f", r AS (SELECT page_id, avg((v < 1800)::INT) AS r FROM (SELECT page_id, {_VAR} AS v FROM px8 WHERE y % 2 = 0 GROUP BY page_id, y) GROUP BY page_id), c AS (SELECT page_id, avg((v < 1800)::INT) AS c FROM (SELECT page_id, {_VAR} AS v FROM px8 WHERE x % 2 = 0 GROUP BY page_id, x) GROUP BY page_id) SELECT page_id, CASE WHEN r > 0.3 AND c > 0.3 THEN 'grid' WHEN r > 0.3 AND c < 0.1 THEN 'vertical' WHEN r > 0.15 OR c > 0.15 THEN 'mixed' ELSE 'freeform' END AS layout FROM r JOIN c USING (page_id)", "px8"),
    "cut_safety": X.with_fixtures("SELECT page_id, y, avg((g > 128)::INT) > 0.1 AS unsafe FROM px8 GROUP BY page_id, y", "px8"),
    "gutters_1d": X.with_fixtures(f""", v AS (SELECT page_id, y AS pos, avg(CASE WHEN {_BRIGHT} > 104 THEN 1.0::DOUBLE ELSE 0 END) AS v FROM docpx GROUP BY page_id, y), z AS (SELECT page_id, max(pos) AS last FROM v GROUP BY page_id),
        s AS (SELECT z.page_id, z.last, v.pos, (SELECT sum(u.v) FROM (SELECT unnest(range(-3, 4)) AS o) k JOIN v u ON u.page_id = v.page_id AND u.pos = greatest(0, least(z.last, v.pos + k.o))) / 7 AS m FROM v JOIN z ON z.page_id = v.page_id),
        h AS (SELECT *, pos - row_number() OVER (PARTITION BY page_id ORDER BY pos) AS island FROM s WHERE m < 0.7), g AS (SELECT page_id, min(pos) AS a, max(pos) AS b, count(*) AS n, any_value(last) AS last FROM h GROUP BY page_id, island)
        SELECT page_id, cast(floor(a + n / 2.0) AS BIGINT) AS at, n AS length FROM g WHERE n BETWEEN 1 AND 12 AND b < last""", "docpx").replace(" AS at, n", ' AS "at", n'),
    "panel_crops": X.with_fixtures(f"SELECT p.page_id, c.seq, p.x - c.x AS x, p.y - c.y AS y, p.g FROM px8 p {_IN_BOX}", "px8", "boxes8"),
    "src_downscale": X.with_fixtures(f"SELECT page_id, x, y, round(g, 6) AS g FROM ({_HALF.format('px8')})", "px8"),
    "components": X.with_fixtures(f"{_COMPONENTS} SELECT * FROM comp", "px8", recursive=True),
    "face_count": X.with_fixtures(f"{_COMPONENTS} SELECT page_id, count(*) AS n, count(*) FILTER (area > 4 AND area < 30) AS faces, count(*) FILTER (w > 3 AND h > 3) AS panels FROM comp GROUP BY page_id", "px8", recursive=True),
    "distance_transform": X.with_fixtures(f", {_MASK} SELECT p.page_id, p.x, p.y, round(coalesce(min(greatest(abs(p.x - q.x), abs(p.y - q.y)) - least(abs(p.x - q.x), abs(p.y - q.y)) + 1.414::DOUBLE * least(abs(p.x - q.x), abs(p.y - q.y))), 1e10::DOUBLE), 6) AS d FROM m p LEFT JOIN m q ON q.page_id = p.page_id AND q.v = 0 GROUP BY p.page_id, p.x, p.y", "px8"),
    "region_adjacency": X.with_fixtures("SELECT DISTINCT p.page_id, least(floor(p.g / 64), floor(q.g / 64))::INT AS a, greatest(floor(p.g / 64), floor(q.g / 64))::INT AS b FROM px8 p JOIN px8 q ON q.page_id = p.page_id AND (q.x = p.x + 1 AND q.y = p.y OR q.x = p.x AND q.y = p.y + 1) WHERE floor(p.g / 64) <> floor(q.g / 64)", "px8"),
}
