"""Queries over panels on their pages' pixels, 64 x 64 scenes: tightness, strips, structure, snapping, fusion. Each with its
DuckDB SQL where SQL can say it; the rest is held against numpy in the tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.operators import contours, detectors, pages, regions, scoring, strips, views
from inkgrid.operators import stencils as S
from inkgrid.sources import fixtures as X
from inkgrid.sources import images

#: The smallest panel on scenes of 64 x 64.
LEAST_W, LEAST_H = 12, 14


def _scene(s: SparkSession, d: str) -> DataFrame:
    return X.scene64(s, d)


def _coarse(s: SparkSession, d: str) -> DataFrame:
    """Scenes of 16 brightness levels."""
    return _scene(s, d).withColumn("g", F.transform("g", lambda v: F.floor(v / 16) * 16.0))


def _cv(r: DataFrame) -> DataFrame:
    return X.boxes64(r)[0]


def _fuse(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return strips.fuse(r, *X.boxes64(r), LEAST_W, LEAST_H).withColumn("conf", F.round("conf", 6))


def _tightness(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return strips.tightness(r, _cv(r)).withColumn("tightness", F.round("tightness", 9))


def _strips(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return strips.strip_content(r, _cv(r))


def _structure(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return strips.has_structure(r, X.boxes64(r)[1], 16, 14)


def _strength(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return strips.edge_strength(r, _cv(r)).withColumn("strength", F.round("strength", 6))


def _attend(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return strips.attend(r, _cv(r))


def _snap(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return strips.snap_edges(S.magnitudes(r), _cv(r), LEAST_W, LEAST_H)


def _snap_first(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return strips.snap_first(S.magnitudes(r), _cv(r))


def _exported(s: SparkSession, d: str) -> DataFrame:
    r = _scene(s, d)
    return images.export_panels(r, _cv(r)).select("page_id", "seq", F.crc32("png").alias("crc"), F.length("png").alias("bytes"))


def _measured(s: SparkSession, d: str) -> DataFrame:
    """Panels with what their pixels show; scenes are gray, so that no pixel is skin."""
    r = _scene(s, d)
    return _cv(r).join(strips.panel_measures(r, _cv(r)), ["page_id", "seq"]).withColumn("face", F.lit(0.0))


def _content(s: SparkSession, d: str) -> DataFrame:
    found = _measured(s, d).withColumn("c", scoring.panel_content(F.lit(64), F.lit(64)))
    lines = F.floor(100 * F.col("motion") + 0.5).alias("motion_lines")
    return found.select("page_id", "seq", "c.kind", "c.confidence", F.round("text", 9).alias("text_density"), lines, F.round("bright", 6).alias("brightness"))


def _insight(s: SparkSession, d: str) -> DataFrame:
    found = _measured(s, d).withColumn("bright", F.col("half_bright"))
    kind = scoring.insight_kind(F.col("edge"), F.col("bright"), 64, 64)
    return found.select("page_id", "seq", kind.alias("kind"), F.round(scoring.panel_insight(F.col("edge"), F.lit(64), F.lit(64)), 9).alias("importance"))


def _scored(found: DataFrame) -> DataFrame:
    return found.select("page_id", "seq", "view", "x", "y", "w", "h", F.round("score", 6).alias("score"))


QUERIES = {
    "tta_detected": lambda s, d: _scored(views.detect_on(_scene(s, d), detectors.row_bands)),
    "multi_scale_detected": lambda s, d: _scored(views.detect_on(_scene(s, d), detectors.row_bands, views.SCALED)),
    "advanced_detected": lambda s, d: _scored(views.advanced(_scene(s, d), {"bands": detectors.row_bands})),
    "fuse_cv_ml": _fuse,
    "border_tightness": _tightness,
    "strip_content": _strips,
    "validate_structure": _structure,
    "edge_strength_strip": _strength,
    "attention_refine": _attend,
    "snap_edges": _snap,
    "snap_graphcut": _snap_first,
    "panel_content_measured": _content,
    "panel_insight_measured": _insight,
    "snk_export_blob": _exported,
    "contour_panels": lambda s, d: contours.contour_panels(_scene(s, d)),
    "panels_borderless": lambda s, d: detectors.borderless(_scene(s, d), 16, 16, block=16, calm=150.0),
    "panels_hierarchical": lambda s, d: detectors.hierarchical(_scene(s, d), LEAST_W, LEAST_H),
    "panels_diagonal": lambda s, d: detectors.diagonal_panels(_scene(s, d)),
    "gutters_multiscale": lambda s, d: detectors.gutters_multiscale(_scene(s, d), least_h=100, sensitivity=65),
    "fast_simple": lambda s, d: detectors.fast_simple(_scene(s, d), 8, 8, least_area=100),
    "fast_optimized": lambda s, d: detectors.fast_optimized(_scene(s, d), 8, 8, least_area=100),
    "characteristics": lambda s, d: pages.characteristics(_scene(s, d)),
    "signature": lambda s, d: pages.signature(_scene(s, d)),
    "protection_mask": lambda s, d: detectors.protection(_coarse(s, d)),
    "bubble_count": lambda s, d: pages.bubble_count(_scene(s, d)),
    "components_content": lambda s, d: regions.content_components(S.threshold(_scene(s, d), 140.0), 4, 4),
    "detect": lambda s, d: detectors.detect(_scene(s, d), detectors.Options(least_w=LEAST_W, least_h=LEAST_H, block=16)),
}


def _tight(of: str) -> str:
    return f"""SELECT b.page_id, b.seq, sum(CASE WHEN p.g > 10 AND p.g < 245 THEN (p.y >= b.y AND p.y < b.y + 5)::INT + (p.y >= b.y + b.h - 5 AND p.y < b.y + b.h)::INT ELSE 0 END)::DOUBLE / (10 * ((any_value(b.w) + 2) // 3)) AS tightness
        FROM {of} b JOIN px64 p ON p.page_id = b.page_id AND p.x >= b.x AND p.x < b.x + b.w AND (p.x - b.x) % 3 = 0 GROUP BY b.page_id, b.seq"""


def _strip(of: str) -> str:
    return f"""SELECT b.page_id, b.seq, count(*) FILTER (p.x >= b.x AND p.x < b.x + 10 AND p.y >= b.y AND p.y < b.y + b.h AND (p.y - b.y) % 3 = 0 AND p.g > 20 AND p.g < 235) > 2 * any_value(b.h) / 3.0::DOUBLE AS "right",
        count(*) FILTER (p.y >= b.y AND p.y < b.y + 10 AND p.x >= b.x AND p.x < b.x + b.w AND (p.x - b.x) % 3 = 0 AND p.g > 20 AND p.g < 235) > 2 * any_value(b.w) / 3.0::DOUBLE AS bottom FROM {of} b JOIN px64 p ON p.page_id = b.page_id GROUP BY b.page_id, b.seq"""


def _structured(of: str, w: int, h: int) -> str:
    return f"""SELECT b.page_id, b.seq, any_value(b.w) >= {w} AND any_value(b.h) >= {h} AND 100 * any_value(b.w * b.h) >= 4096 AND 10 * count(*) FILTER (p.g > 15 AND p.g < 240) > any_value(((b.w + 3) // 4) * ((b.h + 3) // 4)) AS valid
        FROM {of} b JOIN px64 p ON p.page_id = b.page_id AND p.x >= b.x AND p.x < b.x + b.w AND p.y >= b.y AND p.y < b.y + b.h AND (p.x - b.x) % 4 = 0 AND (p.y - b.y) % 4 = 0 GROUP BY b.page_id, b.seq"""


def _strong(of: str) -> str:
    """Mean difference along the diagonal of every second pixel of the rectangles of a table (page_id, k, x, y, w, h), 0 without any."""
    return f"""SELECT b.page_id, b.k, coalesce(3 * avg(abs(p.g - q.g)), 0) AS s FROM {of} b LEFT JOIN (px64 p JOIN px64 q ON q.page_id = p.page_id AND q.x = p.x + 1 AND q.y = p.y + 1)
        ON p.page_id = b.page_id AND p.x >= b.x AND p.x < b.x + b.w AND p.y >= b.y AND p.y < b.y + b.h AND (p.x - greatest(0, b.x)) % 2 = 0 AND (p.y - greatest(0, b.y)) % 2 = 0 GROUP BY b.page_id, b.k"""


_INTER = "greatest(0, least(c.x + c.w, m.x + m.w) - greatest(c.x, m.x)) * greatest(0, least(c.y + c.h, m.y + m.h) - greatest(c.y, m.y))"
_BEST = "SELECT page_id, arg_max(mseq, (iou, -mseq)) AS mseq FROM pr WHERE seq = {k} {free} GROUP BY page_id"
_FREE = "AND NOT EXISTS (SELECT 1 FROM {t} WHERE {t}.page_id = pr.page_id AND {t}.mseq = pr.mseq)"
_FUSE = f""", pr AS MATERIALIZED (SELECT * FROM (SELECT c.page_id, c.seq, m.seq AS mseq, ({_INTER})::DOUBLE / (c.w * c.h + m.w * m.h - {_INTER}) AS iou FROM cv64 c JOIN ml64 m ON m.page_id = c.page_id) WHERE iou > 0.2),
    b0 AS MATERIALIZED ({_BEST.format(k=0, free="")}), b1 AS MATERIALIZED ({_BEST.format(k=1, free=_FREE.format(t="b0"))}), b2 AS MATERIALIZED ({_BEST.format(k=2, free=_FREE.format(t="b0") + " " + _FREE.format(t="b1"))}),
    best AS (SELECT page_id, 0 AS seq, mseq FROM b0 UNION ALL SELECT page_id, 1, mseq FROM b1 UNION ALL SELECT page_id, 2, mseq FROM b2),
    j AS MATERIALIZED (SELECT c.*, m.seq AS mseq, m.x AS mx, m.y AS my, m.w AS mw, m.h AS mh, m.conf AS mconf, coalesce(pr.iou, 0) AS iou FROM cv64 c LEFT JOIN best ON best.page_id = c.page_id AND best.seq = c.seq
        LEFT JOIN ml64 m ON m.page_id = c.page_id AND m.seq = best.mseq LEFT JOIN pr ON pr.page_id = c.page_id AND pr.seq = c.seq AND pr.mseq = m.seq),
    tc AS ({_tight("cv64")}), tm AS ({_tight("ml64")}), s1 AS (SELECT page_id, seq, mx + mw AS x, y, w, h FROM j WHERE iou > 0.2), s2 AS (SELECT page_id, seq, x, my + mh AS y, w, h FROM j WHERE iou > 0.2), r AS ({_strip("s1")}), u AS ({_strip("s2")}),
    f AS (SELECT j.*, j.iou > 0.5 AND tm.tightness > tc.tightness AS tight, j.iou > 0.2 AND j.iou <= 0.5 AND mx + mw < j.x + j.w - 10 AND NOT r."right" AS narrow, j.iou > 0.2 AND j.iou <= 0.5 AND my + mh < j.y + j.h - 10 AND NOT u.bottom AS low
        FROM j LEFT JOIN tc ON tc.page_id = j.page_id AND tc.seq = j.seq LEFT JOIN tm ON tm.page_id = j.page_id AND tm.seq = j.mseq LEFT JOIN r ON r.page_id = j.page_id AND r.seq = j.seq LEFT JOIN u ON u.page_id = j.page_id AND u.seq = j.seq),
    v AS ({_structured("ml64", LEAST_W, LEAST_H)})
    SELECT page_id, 'cv' AS source, seq, CASE WHEN tight THEN mx ELSE x END AS x, CASE WHEN tight THEN my ELSE y END AS y, CASE WHEN tight THEN mw WHEN narrow THEN mx + mw - x ELSE w END AS w, CASE WHEN tight THEN mh WHEN low THEN my + mh - y ELSE h END AS h,
        round(CASE WHEN iou > 0.5 THEN greatest(conf, mconf)::DOUBLE WHEN iou > 0.2 THEN (conf + mconf) / 2.0::DOUBLE ELSE conf * 0.8::DOUBLE END, 6) AS conf FROM f
    UNION ALL SELECT m.page_id, 'ml', m.seq, m.x, m.y, m.w, m.h, round(m.conf * 0.7::DOUBLE, 6) FROM ml64 m JOIN v ON v.page_id = m.page_id AND v.seq = m.seq AND v.valid WHERE NOT EXISTS (SELECT 1 FROM best WHERE best.page_id = m.page_id AND best.mseq = m.seq)"""

_SOBEL = """rw AS (SELECT *, lead(g) OVER w - lag(g) OVER w AS d, lag(g) OVER w + 2 * g + lead(g) OVER w AS m3 FROM px64 WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
    sob AS MATERIALIZED (SELECT page_id, x, y, CASE WHEN x BETWEEN 1 AND 62 AND y BETWEEN 1 AND 62 THEN sqrt(power(lag(d) OVER w + 2 * d + lead(d) OVER w, 2) + power(lead(m3) OVER w - lag(m3) OVER w, 2)) ELSE 0 END AS m FROM rw WINDOW w AS (PARTITION BY page_id, x ORDER BY y))"""
#: The sides of a panel: where it stands, and the line's start and length along it.
_SIDES = "SELECT page_id, seq, 'l' AS side, x AS pos, y AS a, h AS n FROM cv64 UNION ALL SELECT page_id, seq, 'r', x + w, y, h FROM cv64 UNION ALL SELECT page_id, seq, 't', y, x, w FROM cv64 UNION ALL SELECT page_id, seq, 'b', y + h, x, w FROM cv64"
_SNAP = f""", {_SOBEL}, sides AS ({_SIDES}), o AS (SELECT unnest(range(-8, 9)) AS o),
    lines AS (SELECT *, pos + o AS line FROM sides CROSS JOIN o),
    sums AS (SELECT s.page_id, s.seq, s.side, s.pos, s.n, o, sum(e.m) AS v FROM lines s JOIN sob e ON e.page_id = s.page_id AND e.x = s.line WHERE s.side IN ('l', 'r') AND e.y >= s.a AND e.y < s.a + s.n AND (e.y - s.a) % 3 = 0 GROUP BY ALL
        UNION ALL SELECT s.page_id, s.seq, s.side, s.pos, s.n, o, sum(e.m) AS v FROM lines s JOIN sob e ON e.page_id = s.page_id AND e.y = s.line WHERE s.side IN ('t', 'b') AND e.x >= s.a AND e.x < s.a + s.n AND (e.x - s.a) % 3 = 0 GROUP BY ALL),
    best AS (SELECT page_id, seq, side, arg_max(pos + o, (round(v, 6), -o)) AS b FROM sums WHERE v > 60 * n / 3.0::DOUBLE GROUP BY page_id, seq, side),
    z AS (SELECT c.*, coalesce(max(b) FILTER (side = 'l'), any_value(c.x)) AS l, coalesce(max(b) FILTER (side = 'r'), any_value(c.x + c.w)) AS r, coalesce(max(b) FILTER (side = 't'), any_value(c.y)) AS t, coalesce(max(b) FILTER (side = 'b'), any_value(c.y + c.h)) AS u FROM cv64 c LEFT JOIN best ON best.page_id = c.page_id AND best.seq = c.seq GROUP BY ALL),
    k AS (SELECT *, r - l > 0.8 * w AND u - t > 0.8 * h AND r - l >= {LEAST_W} AND u - t >= {LEAST_H} AS kept FROM z)
    SELECT page_id, seq, CASE WHEN kept THEN l ELSE x END AS x, CASE WHEN kept THEN t ELSE y END AS y, CASE WHEN kept THEN r - l ELSE w END AS w, CASE WHEN kept THEN u - t ELSE h END AS h FROM k"""
_ATTEND = f""", strips AS (SELECT page_id, seq * 4 AS k, x, y - 10 AS y, w, 10 AS h FROM cv64 UNION ALL SELECT page_id, seq * 4 + 1, x, y + h, w, 10 FROM cv64 UNION ALL SELECT page_id, seq * 4 + 2, x - 10, y, 10, h FROM cv64 UNION ALL SELECT page_id, seq * 4 + 3, x + w, y, 10, h FROM cv64),
    e AS ({_strong("strips")}), g AS (SELECT page_id, k // 4 AS seq, max(CASE WHEN k % 4 = 0 AND s > 50 THEN 2 ELSE 0 END) AS t, max(CASE WHEN k % 4 = 1 AND s > 50 THEN 2 ELSE 0 END) AS b, max(CASE WHEN k % 4 = 2 AND s > 50 THEN 2 ELSE 0 END) AS l, max(CASE WHEN k % 4 = 3 AND s > 50 THEN 2 ELSE 0 END) AS r FROM e GROUP BY ALL)
    SELECT c.page_id, c.seq, greatest(0, c.x - l) AS x, greatest(0, c.y - t) AS y, least(64 - (c.x - l), c.w + r) AS w, least(64 - (c.y - t), c.h + b) AS h FROM cv64 c JOIN g USING (page_id, seq)"""

#: Gradients with repeated borders, thinned across their direction; then pixels reachable from strong ones and from outside, and areas
#: counted square by square.
_CONTOURS = """, c1 AS (SELECT *, coalesce(lead(g) OVER w, g) - coalesce(lag(g) OVER w, g) AS d, coalesce(lag(g) OVER w, g) + 2 * g + coalesce(lead(g) OVER w, g) AS m3 FROM px64 WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
    c2 AS (SELECT page_id, x, y, coalesce(lag(d) OVER w, d) + 2 * d + coalesce(lead(d) OVER w, d) AS gx, coalesce(lead(m3) OVER w, m3) - coalesce(lag(m3) OVER w, m3) AS gy FROM c1 WINDOW w AS (PARTITION BY page_id, x ORDER BY y)),
    c3 AS (SELECT *, abs(gx) + abs(gy) AS m, coalesce(lag(abs(gx) + abs(gy)) OVER w, 0) AS l, coalesce(lead(abs(gx) + abs(gy)) OVER w, 0) AS r FROM c2 WINDOW w AS (PARTITION BY page_id, y ORDER BY x)),
    c4 AS (SELECT *, coalesce(lag(m) OVER w, 0) AS u, coalesce(lead(m) OVER w, 0) AS d, coalesce(lag(l) OVER w, 0) AS ul, coalesce(lag(r) OVER w, 0) AS ur, coalesce(lead(l) OVER w, 0) AS dl, coalesce(lead(r) OVER w, 0) AS dr FROM c3 WINDOW w AS (PARTITION BY page_id, x ORDER BY y)),
    thin AS MATERIALIZED (SELECT page_id, x, y, m FROM c4 WHERE m > 50 AND CASE WHEN abs(gy) * 32768 < abs(gx) * 13573 THEN m > l AND m >= r WHEN abs(gy) * 32768 > abs(gx) * 79109 THEN m > u AND m >= d WHEN (gx < 0) <> (gy < 0) THEN m > ur AND m > dl ELSE m > ul AND m > dr END),
    o8 AS MATERIALIZED (SELECT dx, dy FROM (SELECT unnest(range(-1, 2)) AS dx) CROSS JOIN (SELECT unnest(range(-1, 2)) AS dy) WHERE dx <> 0 OR dy <> 0),
    edge AS MATERIALIZED (WITH RECURSIVE e AS (SELECT page_id, x, y FROM thin WHERE m > 150 UNION SELECT t.page_id, t.x, t.y FROM (SELECT page_id, x + dx AS x, y + dy AS y FROM e CROSS JOIN o8) n JOIN thin t ON t.page_id = n.page_id AND t.x = n.x AND t.y = n.y) SELECT * FROM e),
    back AS MATERIALIZED (SELECT page_id, x, y FROM px64 ANTI JOIN edge USING (page_id, x, y)),
    beyond AS MATERIALIZED (WITH RECURSIVE b AS (SELECT page_id, x, y FROM back WHERE x IN (0, 63) OR y IN (0, 63) UNION SELECT t.page_id, t.x, t.y FROM (SELECT page_id, x + dx AS x, y + dy AS y FROM b CROSS JOIN o8 WHERE dx * dy = 0) n JOIN back t ON t.page_id = n.page_id AND t.x = n.x AND t.y = n.y) SELECT * FROM b),
    inside AS MATERIALIZED (SELECT page_id, x, y, y * 64 + x AS i FROM px64 ANTI JOIN beyond USING (page_id, x, y)),
    lab AS MATERIALIZED (WITH RECURSIVE k(page_id, i, x, y, l) USING KEY (page_id, i) AS (SELECT page_id, i, x, y, i AS l FROM inside UNION SELECT r.page_id, r.i, r.x, r.y, min(n.l) FROM (SELECT page_id, x + dx AS x, y + dy AS y, l FROM k CROSS JOIN o8) n
        JOIN recurring.k r ON r.page_id = n.page_id AND r.x = n.x AND r.y = n.y WHERE n.l < r.l GROUP BY r.page_id, r.i, r.x, r.y) SELECT page_id, x, y, l FROM k),
    cells AS (SELECT page_id, l, count(*) FILTER (n = 4) + 0.5::DOUBLE * count(*) FILTER (n = 3) AS area FROM (SELECT page_id, l, x + dx AS cx, y + dy AS cy, count(*) AS n FROM lab CROSS JOIN (SELECT dx, dy FROM (SELECT unnest([0, 1]) AS dx) CROSS JOIN (SELECT unnest([0, 1]) AS dy)) GROUP BY ALL) GROUP BY ALL)
    SELECT page_id, min(x) AS x, min(y) AS y, max(x) - min(x) + 1 AS w, max(y) - min(y) + 1 AS h, any_value(area) AS area FROM lab JOIN cells USING (page_id, l) GROUP BY page_id, l HAVING any_value(area) > 40.96::DOUBLE"""



def _sobel_sql(of: str, key: str) -> str:
    """Expressions that end in so (key, x, y, g, m, a): magnitudes, 0 at the border, and directions in degrees, of a table of pixels."""
    return f""", s1 AS (SELECT *, lead(g) OVER r - lag(g) OVER r AS dx, lag(g) OVER r + 2 * g + lead(g) OVER r AS sx FROM {of} WINDOW r AS (PARTITION BY {key}, y ORDER BY x)),
    s2 AS (SELECT *, lag(dx) OVER c + 2 * dx + lead(dx) OVER c AS gx, lead(sx) OVER c - lag(sx) OVER c AS gy FROM s1 WINDOW c AS (PARTITION BY {key}, x ORDER BY y)),
    so AS MATERIALIZED (SELECT {key}, x, y, g, coalesce(sqrt(gx * gx + gy * gy), 0) AS m, coalesce(abs(degrees(atan2(gy, gx))), 0) AS a FROM s2)"""


_CONTENT = f""", pp AS (SELECT b.page_id, b.seq, p.x, p.y, p.g FROM cv64 b JOIN px64 p ON p.page_id = b.page_id AND p.x >= b.x AND p.x < b.x + b.w AND p.y >= b.y AND p.y < b.y + b.h){_sobel_sql("pp", "page_id, seq")},
    t1 AS (SELECT *, sum((m > 80)::INT) OVER (PARTITION BY page_id, seq, y ORDER BY x ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS n FROM so),
    t2 AS (SELECT *, sum(n) OVER (PARTITION BY page_id, seq, x ORDER BY y ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS around FROM t1),
    e AS (SELECT page_id, seq, avg((m > 80 AND around > 10)::INT) AS text, avg((m > 50 AND (a > 30 AND a < 60 OR a > 120 AND a < 150))::INT) AS motion, avg(g) AS bright FROM t2 GROUP BY page_id, seq),
    k AS (SELECT e.*, CASE WHEN text > 0.15 THEN 'dialogue' WHEN motion > 0.2 THEN 'action' WHEN bright > 180 AND text < 0.05 THEN 'establishing' WHEN w > 0.8 * 64 AND h < 0.2 * 64 THEN 'transition' ELSE 'mixed' END AS kind FROM e JOIN cv64 b ON b.page_id = e.page_id AND b.seq = e.seq)
    SELECT page_id, seq, kind, CASE kind WHEN 'dialogue' THEN 0.8::DOUBLE WHEN 'action' THEN 0.75::DOUBLE WHEN 'establishing' THEN 0.65::DOUBLE WHEN 'transition' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
    round(text, 9) AS text_density, cast(floor(100 * motion + 0.5) AS BIGINT) AS motion_lines, round(bright, 6) AS brightness FROM k"""
_INSIGHT = f"""{_sobel_sql("px64", "page_id")}, e AS (SELECT b.page_id, b.seq, b.w, b.h, 4 * avg((m > 50)::INT) AS edge, avg(g) AS bright FROM cv64 b JOIN so ON so.page_id = b.page_id AND so.x >= b.x AND so.x < b.x + b.w AND so.y >= b.y AND so.y < b.y + b.h AND (so.x - b.x) % 2 = 0 AND (so.y - b.y) % 2 = 0 GROUP BY b.page_id, b.seq, b.w, b.h)
    SELECT page_id, seq, CASE WHEN edge > 0.3 AND w > h THEN 'action' WHEN edge > 0.2 AND h > 1.5 * w THEN 'close-up' WHEN bright > 180 AND w > 0.8 * 64 THEN 'establishing' WHEN w > 0.9 * 64 AND h < 0.2 * 64 THEN 'transition' WHEN edge > 0.15 THEN 'dialogue' ELSE 'mixed' END AS kind,
    round(least(1.0::DOUBLE, 2.0::DOUBLE * w * h / 4096 + edge), 9) AS importance FROM e"""
_AUGMENTED = "('flip_h', true, false, 1.0::DOUBLE, 64), ('flip_v', false, true, 1.0::DOUBLE, 64), ('scale_0.9', false, false, 0.9::DOUBLE, 64), ('scale_1.1', false, false, 1.1::DOUBLE, 64)"
_SCALED = "('scale_0.5', false, false, 0.5::DOUBLE, 32), ('scale_1.0', false, false, 1.0::DOUBLE, 64), ('scale_1.5', false, false, 1.5::DOUBLE, 96)"


def _viewed(shown: str) -> str:
    """Expressions that end in nb (page_id, seq, view, x, y, w, h, conf): bands of dark rows on views (name, mirrored, upside down, scale, size), back on pages."""
    return f""", vw(view, mx, my, s, n) AS (VALUES {shown}), tg AS MATERIALIZED (SELECT *, unnest(range(n)) AS t FROM vw),
    xs AS (SELECT view, CASE WHEN mx THEN 63 - t ELSE floor((t + 0.5::DOUBLE) / s) END AS src FROM tg), ys AS (SELECT view, t, n, CASE WHEN my THEN 63 - t ELSE floor((t + 0.5::DOUBLE) / s) END AS src FROM tg),
    line AS MATERIALIZED (SELECT p.page_id, xs.view, p.y, sum(p.g) AS total FROM px64 p JOIN xs ON xs.src = p.x GROUP BY ALL),
    vr AS (SELECT pg.page_id, ys.view, ys.t AS y, ys.n, coalesce(line.total, 0) AS total FROM (SELECT DISTINCT page_id FROM px64) pg CROSS JOIN ys LEFT JOIN line ON line.page_id = pg.page_id AND line.view = ys.view AND line.y = ys.src),
    isl AS (SELECT *, y - row_number() OVER (PARTITION BY page_id, view ORDER BY y) AS k FROM vr WHERE total < 200 * n),
    bd AS (SELECT page_id, view, min(y) AS y, count(*) AS h, any_value(n) AS w, 100 * (1 - sum(total) / (255.0::DOUBLE * count(*) * any_value(n))) AS conf FROM isl GROUP BY page_id, view, k HAVING count(*) >= 8),
    bk AS (SELECT bd.page_id, bd.view, floor(CASE WHEN my THEN 64 - y - h ELSE y END / s + 0.5)::BIGINT AS y, floor(h / s + 0.5)::BIGINT AS h, floor(w / s + 0.5)::BIGINT AS w, conf FROM bd JOIN vw USING (view)),
    nb AS MATERIALIZED (SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY view, greatest(0, y), conf) AS seq, view, 0::BIGINT AS x, greatest(0, y) AS y, least(64, w) AS w, least(64, y + h) - greatest(0, y) AS h, conf FROM bk WHERE least(64, y + h) > greatest(0, y))"""


def _softly(of: str) -> str:
    """Soft suppression of a table (page_id, seq, view, x, y, w, h, conf)."""
    both = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
    return f""", io AS (SELECT b.page_id, b.seq, ({both})::DOUBLE / (a.w * a.h + b.w * b.h - {both}) AS iou FROM {of} a JOIN {of} b ON a.page_id = b.page_id AND (a.conf > b.conf OR a.conf = b.conf AND a.seq < b.seq)),
    dc AS (SELECT page_id, seq, sum(iou) AS decay FROM io WHERE iou > 0.5 GROUP BY page_id, seq), sc AS (SELECT n.*, conf / 100.0::DOUBLE * exp(-coalesce(decay, 0) / 0.5::DOUBLE) AS score FROM {of} n LEFT JOIN dc ON dc.page_id = n.page_id AND dc.seq = n.seq)
    SELECT page_id, seq, view, x, y, w, h, round(score, 6) AS score FROM sc WHERE score > 0.3"""


#: Each side moves out by two pixels where the strip of ten outside it is strong.
_MOVED = f""", st AS (SELECT page_id, seq * 4 AS k, x, y - 10 AS y, w, 10 AS h FROM nb UNION ALL SELECT page_id, seq * 4 + 1, x, y + h, w, 10 FROM nb UNION ALL SELECT page_id, seq * 4 + 2, x - 10, y, 10, h FROM nb UNION ALL SELECT page_id, seq * 4 + 3, x + w, y, 10, h FROM nb),
    eg AS ({_strong("st")}), gr AS (SELECT page_id, k // 4 AS seq, max(CASE WHEN k % 4 = 0 AND s > 50 THEN 2 ELSE 0 END) AS t, max(CASE WHEN k % 4 = 1 AND s > 50 THEN 2 ELSE 0 END) AS b, max(CASE WHEN k % 4 = 2 AND s > 50 THEN 2 ELSE 0 END) AS l, max(CASE WHEN k % 4 = 3 AND s > 50 THEN 2 ELSE 0 END) AS r FROM eg GROUP BY ALL),
    mo AS MATERIALIZED (SELECT nb.page_id, nb.seq, view, greatest(0, x - l) AS x, greatest(0, y - t) AS y, least(64 - (x - l), w + r) AS w, least(64 - (y - t), h + b) AS h, conf FROM nb JOIN gr USING (page_id, seq))"""
ORACLE = {
    "tta_detected": X.with_fixtures(_viewed(_AUGMENTED) + _softly("nb"), "px64"),
    "multi_scale_detected": X.with_fixtures(_viewed(_SCALED) + _softly("nb"), "px64"),
    "advanced_detected": X.with_fixtures(_viewed(_AUGMENTED + ", " + _SCALED) + _MOVED + _softly("mo"), "px64"),
    "panel_content_measured": X.with_fixtures(_CONTENT, "px64", "cv64"),
    "panel_insight_measured": X.with_fixtures(_INSIGHT, "px64", "cv64"),
    "contour_panels": X.with_fixtures(_CONTOURS, "px64").replace("px64 AS (", "px64 AS MATERIALIZED (", 1),
    "fuse_cv_ml": X.with_fixtures(_FUSE, "px64", "cv64", "ml64").replace("px64 AS (", "px64 AS MATERIALIZED (", 1),
    "border_tightness": X.with_fixtures(f"SELECT page_id, seq, round(tightness, 9) AS tightness FROM ({_tight('cv64')})", "px64", "cv64"),
    "strip_content": X.with_fixtures(_strip("cv64"), "px64", "cv64"),
    "validate_structure": X.with_fixtures(_structured("ml64", 16, 14), "px64", "ml64"),
    "edge_strength_strip": X.with_fixtures(f", b AS (SELECT page_id, seq AS k, x, y, w, h FROM cv64) SELECT page_id, k AS seq, round(s, 6) AS strength FROM ({_strong('b')})", "px64", "cv64"),
    "attention_refine": X.with_fixtures(_ATTEND, "px64", "cv64"),
    "snap_edges": X.with_fixtures(_SNAP, "px64", "cv64").replace("px64 AS (", "px64 AS MATERIALIZED (", 1),
}
