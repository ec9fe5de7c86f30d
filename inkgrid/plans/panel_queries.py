"""Queries over panels: joins, suppression, fusion, ensembles, order, classification, sinks. Each with its DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrid.functions import boxes
from inkgrid.functions.boxes import intersection_sql, iou_sql
from inkgrid.operators import panels as P
from inkgrid.operators import evaluation, pages, scoring, sequences
from inkgrid.sources import fixtures as X
from inkgrid.sources import images

W, H = X.PAGE_W, X.PAGE_H
SCALE = min(640.0 / W, 640.0 / H)


def _cv(spark: SparkSession, d: str) -> DataFrame:
    return X.panels_cv(spark, d)


def _both(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    cv = X.panels_cv(spark, d)
    return cv, X.panels_ml(cv)


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    cv, ml = _both(spark, d)
    return P.union_candidates({"cv": cv.drop("t"), "ml": ml})


def _best_match(spark: SparkSession, d: str) -> DataFrame:
    cv, ml = _both(spark, d)
    met = P.pairs(cv, ml).withColumn("iou", boxes.iou("a.", "b."))
    best = met.groupBy("page_id", F.col("a.seq").alias("seq")).agg(F.max("iou").alias("iou"))
    return best.select("page_id", "seq", F.round("iou", 9).alias("iou"))


def _merge_rects(spark: SparkSession, d: str) -> DataFrame:
    p = P.pairs(_cv(spark, d)).where(boxes.overlap_class("a.", "b.") == "duplicate")
    return p.select("page_id", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), *P.merge_rects("a.", "b."))


def _yolo(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.decode_anchors(X.anchors(_both(spark, d)[1]), SCALE, W, H)
    return found.select("page_id", "seq", *[F.round(c, 6).alias(c) for c in "xywh"], "conf")


def _quality(spark: SparkSession, d: str) -> DataFrame:
    cv = _cv(spark, d)
    pages = cv.groupBy("page_id").agg(F.max("t").alias("t")).select("page_id", F.lit(W).alias("page_w"), F.lit(H).alias("page_h"), (F.col("t") / 50.0).alias("noise"), (F.col("t") * 100.0).alias("compression"))
    return scoring.quality(P.nms(cv), pages)


def _adaptive(spark: SparkSession, d: str) -> DataFrame:
    c = _cv(spark, d).groupBy("page_id").agg(F.count("*").alias("n_panels"), F.max("t").alias("t"), F.min("x").alias("x"))
    c = c.selectExpr("page_id", "n_panels * 3 AS n_panels", "x % 40 AS gutter_width", "t AS faces", "n_panels * 2 AS bubbles", "x * 2.0D AS compression", "t / 50.0D AS clarity", "x / 2000.0D AS noise", "t / 15.0D AS action", "CASE WHEN t > 5 THEN 'vertical' WHEN t > 2 THEN 'grid' ELSE 'mixed' END AS layout")
    return c.select("page_id", *scoring.adaptive_options({"gutter": 65, "protection": 80, "edge": 60}))


def _grid(spark: SparkSession, d: str) -> DataFrame:
    cv = _cv(spark, d)
    rows = sequences.bands(cv.select("page_id", F.lit(H).alias("height"), F.col("y").alias("at")), "height")
    columns = sequences.bands(cv.select("page_id", F.lit(W).alias("width"), F.col("x").alias("at")), "width")
    return sequences.band_grid(rows, columns, 80, 100)


def _split(spark: SparkSession, d: str) -> DataFrame:
    return images.split_pages(_cv(spark, d))


def _soft(spark: SparkSession, d: str) -> DataFrame:
    return P.soft_nms(_cv(spark, d)).select("page_id", "seq", F.round("score", 9).alias("score"))


def _eval(spark: SparkSession, d: str) -> DataFrame:
    """Predictions against labels of the same page: recall and mean overlap at an iou of one half."""
    cv, ml = _both(spark, d)
    met = P.pairs(cv, ml).withColumn("iou", boxes.iou("a.", "b.")).where("iou > 0.5")
    hit = met.groupBy("page_id", F.col("a.seq").alias("seq")).agg(F.max("iou").alias("iou"))
    return cv.join(hit, ["page_id", "seq"], "left").groupBy("page_id").agg(F.count("*").alias("labels"), F.count("iou").alias("found"), F.round(F.coalesce(F.avg("iou"), F.lit(0.0)), 6).alias("mean_iou"))


def _precision(spark: SparkSession, d: str) -> DataFrame:
    """Average precision of the second detector's panels at each overlap from 0.5 to 0.95, the first one's taken as labels."""
    found = evaluation.average_precision(*_both(spark, d))
    return found.select(F.round("overlap", 2).alias("overlap"), "labels", "predictions", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "ap")])


def _typed(spark: SparkSession, d: str) -> DataFrame:
    return _cv(spark, d).select("page_id", "seq", scoring.panel_type(W, H).alias("kind"), scoring.panel_type_ml(W, H, F.col("conf") / 100.0).alias("kind_ml"))


def _content(spark: SparkSession, d: str) -> DataFrame:
    rows = _cv(spark, d).selectExpr("page_id", "seq", "w", "h", "t / 40.0D AS text", "(x % 100) / 300.0D AS motion", "(y % 100) / 250.0D AS face", "100 + x % 150 AS bright")
    return rows.select("page_id", "seq", scoring.panel_content(F.lit(W), F.lit(H)).alias("c"), F.round(scoring.panel_insight(F.col("motion"), F.lit(W), F.lit(H)), 9).alias("importance")).select("page_id", "seq", "c.kind", "c.confidence", "importance")


def _labels(spark: SparkSession, d: str) -> DataFrame:
    return _cv(spark, d).select("page_id", "seq", scoring.yolo_label(W, H).alias("line"))


def _summary(spark: SparkSession, d: str) -> DataFrame:
    cv, ml = _both(spark, d)
    return images.summary(ml, cv)


def _signed(spark: SparkSession, d: str) -> DataFrame:
    """Signatures of pages with panels, worked out from those: what tuning and rating read."""
    c = _cv(spark, d).groupBy("page_id").agg(F.count("*").alias("n"), F.max("t").alias("t"), F.min("x").alias("x"))
    return c.selectExpr(
        "page_id", "n * 3 AS n_panels", "x % 50 AS gutter_width", "t / 20.0D AS clarity", "1 - t / 9.0D AS noise", "CASE WHEN x > 250 THEN 0.8D ELSE 0.2D END AS compression", "t > 6 AS has_faces", "n > 4 AS has_bubbles", "t > 5 AS has_action", "t > 3 AS has_diagonals",
        "CASE WHEN t > 5 THEN 'vertical' WHEN t > 2 THEN 'grid' WHEN n > 3 THEN 'mixed' ELSE 'freeform' END AS layout", "CASE WHEN t > 3 OR n > 5 THEN 'high' WHEN n < 2 THEN 'low' ELSE 'medium' END AS complexity",
        "CASE WHEN t > 3 OR n > 5 THEN array('watershed', 'superpixels') WHEN n < 2 THEN array('projection-analysis') ELSE array('watershed') END AS algorithms",
    )


def _adaptive_sig(spark: SparkSession, d: str) -> DataFrame:
    return _signed(spark, d).select("page_id", *pages.adaptive_options({"gutter": 65, "protection": 80, "edge": 60}))


def _quality_sig(spark: SparkSession, d: str) -> DataFrame:
    sig = _signed(spark, d).withColumns({"page_w": F.lit(W), "page_h": F.lit(H)})
    return scoring.quality_by_signature(_cv(spark, d), sig)


def _order_smart(spark: SparkSession, d: str) -> DataFrame:
    cv = _cv(spark, d).withColumn("importance", F.round(F.least(F.lit(1.0), 2.0 * F.col("w") * F.col("h") / (W * H) + F.col("t") / 20.0), 6))
    return P.reading_order_smart(cv, _signed(spark, d).select("page_id", "layout"))


def _fallback(spark: SparkSession, d: str) -> DataFrame:
    cv, ml = _both(spark, d)
    return P.first_with_panels(ml.where("page_id % 3 > 0"), cv.drop("t"))


def _voted(spark: SparkSession, d: str) -> DataFrame:
    cv, ml = _both(spark, d)
    return P.ensemble({"a": cv.drop("t"), "b": ml, "c": cv.drop("t").where("seq % 2 = 0")}).select("page_id", "seq", "detector", *"xywh", "conf")


def _insight(spark: SparkSession, d: str) -> DataFrame:
    rows = _cv(spark, d).selectExpr("page_id", "seq", "x", "y", "w", "h", "t / 20.0D AS edge", "100 + x % 150 AS bright")
    return rows.select("page_id", "seq", scoring.insight_kind(F.col("edge"), F.col("bright"), W, H).alias("kind"), F.round(scoring.panel_insight(F.col("edge"), F.lit(W), F.lit(H)), 9).alias("importance"))


def _advanced(spark: SparkSession, d: str) -> DataFrame:
    """Panels seen on flipped and scaled images and at several scales, restored, united and softly suppressed."""
    found = P.advanced(_cv(spark, d), W, H)
    return found.select("page_id", "seq", F.round("score", 6).alias("score"))


def _segmented(spark: SparkSession, d: str) -> DataFrame:
    """Label maps of 8 x 8, spread over pages of 20 x 12, label 0 being background."""
    labels = X.pixels(X.raster8(spark, d)).select("page_id", "x", "y", F.floor(F.col("g") / 64).cast("int").alias("label"))
    return scoring.segmentation_mask(labels, 8, 8, 20, 12)


def _yolo_classes(spark: SparkSession, d: str) -> DataFrame:
    rows = X.anchors(_both(spark, d)[1]).withColumn("scores", F.expr("array(score, (i * 37 % 100) / 100.0D, (page_id * 13 % 100) / 100.0D)"))
    found = P.nms(scoring.decode_classes(rows, SCALE, W, H))
    return found.select("page_id", "seq", F.round("conf", 6).alias("conf"))


QUERIES = {
    "adaptive_opts_sig": _adaptive_sig,
    "quality_sig": _quality_sig,
    "reading_order_smart": _order_smart,
    "ml_hybrid_fallback": _fallback,
    "ensemble": _voted,
    "panel_insight": _insight,
    "advanced": _advanced,
    "seg_mask": _segmented,
    "yolo_decode_classes": _yolo_classes,
    "split_mod": lambda s, d: images.split_every(_cv(s, d)),
    "iou": lambda s, d: P.overlaps(_cv(s, d)).select("page_id", "a", "b", F.round("iou", 9).alias("iou"), F.round("containment", 9).alias("containment")),
    "overlap_class": lambda s, d: P.overlaps(_cv(s, d)).select("page_id", "a", "b", "overlap"),
    "merge_rects": _merge_rects,
    "containment_antijoin": lambda s, d: P.drop_contained(_cv(s, d)).select("page_id", "seq", "panel_id"),
    "nms_hard": lambda s, d: P.nms(_cv(s, d)).select("page_id", "seq", "conf"),
    "nms_soft": _soft,
    "overlap_mark": lambda s, d: P.mark_overlapping(_cv(s, d)),
    "overlap_merge": lambda s, d: P.merge_overlapping(_cv(s, d)).select("page_id", "seq", "x", "y", "w", "h", F.round("conf", 6).alias("conf"), "overlapping"),
    "best_match": _best_match,
    "fuse_by_area": lambda s, d: P.fuse_by_area(*_both(s, d)).withColumn("conf", F.round("conf", 6)),
    "fuse_exclusive": lambda s, d: P.fuse_exclusive(*_both(s, d)),
    "ensemble_vote": lambda s, d: P.vote(_candidates(s, d), 2),
    "ensemble_leaders": lambda s, d: P.leader_clusters(_cv(s, d)),
    "ensemble_wavg": lambda s, d: P.weighted_average(_cv(s, d)),
    "tta": lambda s, d: P.restore(P.augment(_cv(s, d), W, H), W, H),
    "multi_scale": lambda s, d: P.at_scales(_cv(s, d)),
    "reading_order": lambda s, d: P.reading_order(_cv(s, d)),
    "reading_order_vertical": lambda s, d: P.reading_order(_cv(s, d), vertical=True),
    "limit_panels": lambda s, d: P.limit(_cv(s, d), 3).select("page_id", "seq"),
    "reindex": lambda s, d: P.reindex(_cv(s, d), "y", "x", "seq").select("page_id", "seq", "panel_id"),
    "union_candidates": _candidates,
    "panel_type": _typed,
    "panel_content": _content,
    "quality": _quality,
    "adaptive_opts": _adaptive,
    "yolo_decode": _yolo,
    "yolo_normalize": _labels,
    "snk_json": lambda s, d: images.envelope(_cv(s, d).select("page_id", "seq", "x", "y", "w", "h", "conf")),
    "snk_summary": _summary,
    "split_pages": _split,
    "eval_match": _eval,
    "average_precision": _precision,
    "band_grid": _grid,
    "merge_close": lambda s, d: sequences.merge_close(_cv(s, d).select("page_id", F.col("x").alias("at")), 40),
}


def _overlap(a: str, b: str) -> str:
    common, small, large = intersection_sql(a, b), f"least({a}.w * {a}.h, {b}.w * {b}.h)", f"greatest({a}.w * {a}.h, {b}.w * {b}.h)"
    return f"CASE WHEN {common} / {small}::DOUBLE > 0.7 THEN 'contained' WHEN {iou_sql(a, b)} > 0.5 AND {small} / {large}::DOUBLE > 0.7 THEN 'duplicate' WHEN {iou_sql(a, b)} > 0.1 THEN 'partial' ELSE 'none' END"


def _fold(order: str, first: str, step: str, out: str, needs: str = "panels_cv", more: str = "", source: str = "panels_cv") -> str:
    """A page's panels one after another, in order, as a recursive query; p is the panel, f.kept what there is. The panels are
    those of source, a fixture or one of the expressions of more."""
    return X.with_fixtures(
        f"""{more}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY {order}) AS rk FROM {source}),
        f AS (SELECT p.page_id, 1::BIGINT AS done, [{first}] AS kept FROM r p WHERE rk = 1 UNION ALL SELECT f.page_id, f.done + 1, {step} FROM f JOIN r p ON p.page_id = f.page_id AND p.rk = f.done + 1),
        z AS (SELECT page_id, unnest(arg_max(kept, done)) AS q FROM f GROUP BY page_id) SELECT {out} FROM z""",
        needs,
        recursive=True,
    )


_BOX = "'seq': p.seq, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h, 'conf': p.conf"
_IOU = iou_sql("k", "p")
#: A page's predictions in order, at each overlap, as a recursive query; then running counts over the confidences.
_AP = """, pr AS (SELECT m.page_id, m.seq, m.conf, c.seq AS label, greatest(0, least(c.x + c.w, m.x + m.w) - greatest(c.x, m.x)) * greatest(0, least(c.y + c.h, m.y + m.h) - greatest(c.y, m.y)) AS common, c.w * c.h + m.w * m.h AS total FROM panels_ml m LEFT JOIN panels_cv c ON c.page_id = m.page_id),
    near AS (SELECT page_id, seq, conf, list({'iou': common::DOUBLE / (total - common), 'label': label} ORDER BY common::DOUBLE / (total - common) DESC, label) FILTER (common::DOUBLE / (total - common) >= 0.5) AS near FROM pr GROUP BY page_id, seq, conf),
    rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY conf DESC, seq) AS k FROM near), ov AS (SELECT unnest(range(10, 20)) / 20.0::DOUBLE AS overlap),
    f AS (SELECT DISTINCT page_id, overlap, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS label, NULL::BIGINT AS conf FROM rk CROSS JOIN ov
        UNION ALL SELECT page_id, overlap, k, CASE WHEN label IS NULL THEN used ELSE list_append(used, label) END, label, conf FROM (SELECT f.page_id, f.overlap, r.k, f.used, r.conf, list_filter(r.near, lambda c: c.iou >= f.overlap AND NOT list_contains(f.used, c.label))[1].label AS label FROM f JOIN rk r ON r.page_id = f.page_id AND r.k = f.k + 1)),
    g AS (SELECT overlap, conf, count(label) AS hits, count(*) AS n FROM f WHERE k > 0 GROUP BY overlap, conf),
    s AS (SELECT *, sum(hits) OVER w AS found, sum(n) OVER w AS taken FROM g WINDOW w AS (PARTITION BY overlap ORDER BY conf DESC)),
    e AS (SELECT *, max(found / taken::DOUBLE) OVER (PARTITION BY overlap ORDER BY conf) AS best FROM s), a AS (SELECT count(*) AS labels FROM panels_cv)
    SELECT round(overlap, 2) AS overlap, any_value(labels) AS labels, max(taken)::BIGINT AS predictions, round(max(found) / max(taken)::DOUBLE, 6) AS precision, round(max(found) / any_value(labels)::DOUBLE, 6) AS recall, round(sum(hits / labels::DOUBLE * best), 6) AS ap FROM e CROSS JOIN a GROUP BY overlap"""
_PAIR = "FROM panels_cv a JOIN panels_cv b ON a.page_id = b.page_id AND a.seq < b.seq"
_CONTAINS = f"{intersection_sql('k', 'p')} > 0.7::DOUBLE * (p.w * p.h)"
_CLAIM = f"list_extract(list_transform(list_filter(f.kept, lambda k: k.parent IS NULL AND {_CONTAINS}), lambda k: k.seq), 1)"
_DUP = f"({_IOU} > 0.5 AND least(k.w * k.h, p.w * p.h) > 0.7::DOUBLE * greatest(k.w * k.h, p.w * p.h))"
_INSIDE = f"{intersection_sql('k', 'p')} > 0.7::DOUBLE * least(k.w * k.h, p.w * p.h)"
_FIRST_DUP = f"list_extract(list_transform(list_filter(f.kept, lambda k: {_DUP}), lambda k: k.seq), 1)"
_MERGED = "{'seq': k.seq, 'x': least(k.x, p.x), 'y': least(k.y, p.y), 'w': greatest(k.x + k.w, p.x + p.w) - least(k.x, p.x), 'h': greatest(k.y + k.h, p.y + p.h) - least(k.y, p.y), 'conf': greatest(k.conf, p.conf::DOUBLE), 'overlapping': k.overlapping}"
_HELD = f"len(list_filter(f.kept, lambda k: {_INSIDE})) > 0"
_LEAD = f"list_extract(list_transform(list_filter(f.kept, lambda k: k.leader = k.seq AND {_IOU} > 0.5), lambda k: k.seq), 1)"
_LEADERS = _fold("seq", "{'seq': p.seq, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h, 'leader': p.seq}", f"list_append(f.kept, {{'seq': p.seq, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h, 'leader': coalesce({_LEAD}, p.seq)}})", "page_id, q.seq AS seq, q.leader AS leader")
_NMS = _fold("conf DESC, seq", f"{{{_BOX}}}", f"CASE WHEN len(list_filter(f.kept, lambda k: {_IOU} > 0.4)) > 0 THEN f.kept ELSE list_append(f.kept, {{{_BOX}}}) END", "page_id, q.seq AS seq, q.conf AS conf")


def _order(vertical: bool) -> str:
    apart = "p.y - l.first > 0.3 * l.tall" if vertical else "p.y - l.first >= 0.5 * least(p.h, l.tall)"
    new = "{'seq': p.seq, 'x': p.x, 'first': CASE WHEN APART THEN p.y ELSE l.first END, 'tall': CASE WHEN APART THEN p.h ELSE l.tall END, 'band': CASE WHEN APART THEN l.band + 1 ELSE l.band END}".replace("APART", f"({apart})")
    step = f"list_append(f.kept, list_extract(list_transform([f.kept[len(f.kept)]], lambda l: {new}), 1))"
    return _fold("y, x, seq", "{'seq': p.seq, 'x': p.x, 'first': p.y, 'tall': p.h, 'band': 0}", step, "page_id, q.seq AS seq, q.band AS band, row_number() OVER (PARTITION BY page_id ORDER BY q.band, q.x, q.first, q.seq) AS position").replace(
        "q.band, q.x, q.first, q.seq", "q.band, q.x, (SELECT y FROM panels_cv c WHERE c.page_id = z.page_id AND c.seq = q.seq), q.seq"
    )


_EXCLUSIVE = X.with_fixtures(
    f""", c AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY seq) AS rk FROM panels_cv), m AS (SELECT page_id, list({{'seq': seq, 'x': x, 'y': y, 'w': w, 'h': h}} ORDER BY seq) AS ms FROM panels_ml GROUP BY page_id),
    j AS (SELECT c.*, list_filter(coalesce(ms, []), lambda k: {iou_sql("k", "c")} > 0.2) AS near FROM c LEFT JOIN m USING (page_id)),
    f AS (SELECT page_id, 0::BIGINT AS k, NULL::BIGINT AS seq, NULL::BIGINT AS match, []::BIGINT[] AS used FROM j WHERE rk = 1
        UNION ALL SELECT f.page_id, f.k + 1, t.seq, t.match, CASE WHEN t.match IS NULL THEN f.used ELSE list_append(f.used, t.match) END
        FROM f JOIN LATERAL (SELECT j.seq, (SELECT arg_max(u.seq, (cast({iou_sql("u", "j")} AS DECIMAL(20, 15)), -u.seq)) FROM (SELECT unnest(j.near) AS u) WHERE NOT list_contains(f.used, u.seq)) AS match FROM j WHERE j.page_id = f.page_id AND j.rk = f.k + 1) t ON true)
    SELECT page_id, seq, match FROM f WHERE k > 0""",
    "panels_cv", "panels_ml", recursive=True,
)

_ROUND = "cast(floor({} + 0.5) AS BIGINT)"
_AUG = {"flip_h": (f"{W} - x - w", "y", "w", "h"), "flip_v": ("x", f"{H} - y - h", "w", "h"), "scale_0.9": ("x * 0.9::DOUBLE", "y * 0.9::DOUBLE", "w * 0.9::DOUBLE", "h * 0.9::DOUBLE"), "scale_1.1": ("x * 1.1::DOUBLE", "y * 1.1::DOUBLE", "w * 1.1::DOUBLE", "h * 1.1::DOUBLE")}
_VIEWS = " UNION ALL ".join(f"SELECT page_id, seq, '{v}' AS view, ({x})::DOUBLE AS x, ({y})::DOUBLE AS y, ({w})::DOUBLE AS w, ({h})::DOUBLE AS h FROM panels_cv" for v, (x, y, w, h) in _AUG.items())
_SC = "CASE view WHEN 'scale_0.9' THEN 0.9::DOUBLE WHEN 'scale_1.1' THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END"
_ISSUES = [("panels overlap or cover the page", "coverage > 0.9"), ("panels may be missing", "coverage < 0.3"), ("a panel is very large", "large > 0"), ("many panels are tiny", "tiny > 3"), ("the image is noisy", "noise > 0.1"), ("the image is compressed", "compression > 500")]
_P_LOSS = "(CASE WHEN coverage > 0.9 THEN 0.1 ELSE 0 END + CASE WHEN large > 0 THEN 0.05 ELSE 0 END + CASE WHEN tiny > 3 THEN 0.05 ELSE 0 END + CASE WHEN noise > 0.1 THEN 0.1 ELSE 0 END + CASE WHEN compression > 500 THEN 0.05 ELSE 0 END)::DOUBLE"
_R_LOSS = "(CASE WHEN coverage < 0.3 THEN 0.15 ELSE 0 END + CASE WHEN noise > 0.1 THEN 0.1 ELSE 0 END)::DOUBLE"
_EDGE = f"x < 5 AS l, x + w > {W} - 5 AS r, y < 5 AS t0, y + h > {H} - 5 AS b"
_BANDS = "SELECT page_id, pos AS s, lead(pos) OVER (PARTITION BY page_id ORDER BY pos) AS e FROM (SELECT page_id, {c} AS pos FROM panels_cv UNION SELECT page_id, 0 FROM panels_cv UNION SELECT page_id, {n} FROM panels_cv)"

_SIG = """, c AS (SELECT page_id, count(*) AS n, max(t) AS t, min(x) AS x FROM panels_cv GROUP BY page_id),
    sig AS (SELECT page_id, n * 3 AS n_panels, x % 50 AS gutter_width, t / 20.0::DOUBLE AS clarity, 1 - t / 9.0::DOUBLE AS noise, CASE WHEN x > 250 THEN 0.8::DOUBLE ELSE 0.2::DOUBLE END AS compression, t > 6 AS faces, n > 4 AS bubbles, t > 5 AS action, t > 3 AS diagonals,
        CASE WHEN t > 5 THEN 'vertical' WHEN t > 2 THEN 'grid' WHEN n > 3 THEN 'mixed' ELSE 'freeform' END AS layout, CASE WHEN t > 3 OR n > 5 THEN 'high' WHEN n < 2 THEN 'low' ELSE 'medium' END AS complexity FROM c)"""
_QSIG = f"""{_SIG}, a AS (SELECT s.*, count(*) AS k, sum(w * h) / {float(W * H)}::DOUBLE AS cover, sum(w * h)::DOUBLE / count(*) / ({W * H} / greatest(1, any_value(s.n_panels))::DOUBLE) AS ratio, count(*) FILTER (w * h > {W * H / 2}) AS large, count(*) FILTER (w < 50 OR h < 50) AS small
        FROM sig s JOIN panels_cv p ON p.page_id = s.page_id GROUP BY ALL),
    p AS (SELECT *, k / greatest(1, n_panels)::DOUBLE AS share FROM a),
    r AS (SELECT *, 0.85::DOUBLE - CASE WHEN cover > 0.9 THEN 0.1 WHEN cover < 0.3 THEN 0.05 ELSE 0 END::DOUBLE - CASE WHEN ratio > 2 OR ratio < 0.5 THEN 0.1 ELSE 0 END::DOUBLE - CASE WHEN noise > 0.15 THEN 0.1 ELSE 0 END::DOUBLE - CASE WHEN compression > 0.7 THEN 0.05 ELSE 0 END::DOUBLE AS pr,
        0.80::DOUBLE - CASE WHEN cover < 0.3 THEN 0.15 ELSE 0 END::DOUBLE - CASE WHEN share < 0.5 THEN 0.2 WHEN share > 2 THEN 0.1 ELSE 0 END::DOUBLE - CASE WHEN noise > 0.15 THEN 0.1 ELSE 0 END::DOUBLE AS re FROM p)
    SELECT page_id, round(pr, 4) AS precision, round(re, 4) AS recall, cast(floor(50 * (round(pr, 4) + round(re, 4)) + 0.5) AS BIGINT) AS score,
        concat_ws('; ', CASE WHEN large > 0 THEN 'very large panels' END, CASE WHEN small > 0 THEN 'very small panels' END, CASE WHEN cover > 0.9 THEN 'panels may be merged' WHEN cover < 0.3 THEN 'panels may be missing' END, CASE WHEN noise > 0.15 THEN 'noisy image' END, CASE WHEN compression > 0.7 THEN 'compressed image' END, CASE WHEN k > 2 * n_panels THEN 'more panels than expected' END) AS issues FROM r"""

ORACLE = {
    "adaptive_opts_sig": X.with_fixtures(f"{_SIG} SELECT page_id, cast(CASE WHEN gutter_width < 10 THEN 80 WHEN gutter_width > 30 THEN 55 ELSE 65 END AS INT) AS gutter, cast(CASE WHEN clarity < 0.1 THEN 80 WHEN clarity > 0.3 THEN 50 ELSE 60 END AS INT) AS edge, cast(CASE WHEN faces OR bubbles THEN 95 ELSE 80 END AS INT) AS protection, action OR diagonals AS diagonal, complexity = 'high' OR n_panels > 15 AS fast, CASE layout WHEN 'vertical' THEN 'webtoon' WHEN 'grid' THEN 'manga' ELSE 'auto' END AS kind, complexity <> 'low' AS watershed, complexity = 'high' AS superpixels FROM sig", "panels_cv"),
    "quality_sig": X.with_fixtures(_QSIG, "panels_cv"),
    "ml_hybrid_fallback": X.with_fixtures(", m AS (SELECT * FROM panels_ml WHERE page_id % 3 > 0) SELECT page_id, seq, x, y, w, h, conf, 'first' AS detector FROM m UNION ALL SELECT page_id, seq, x, y, w, h, conf, 'second' FROM panels_cv WHERE page_id NOT IN (SELECT page_id FROM m)", "panels_cv", "panels_ml"),
    "ensemble": X.with_fixtures(", u AS (SELECT page_id, 'a' AS detector, seq, x, y, w, h, conf FROM panels_cv UNION ALL SELECT page_id, 'b', seq, x, y, w, h, conf FROM panels_ml UNION ALL SELECT page_id, 'c', seq, x, y, w, h, conf FROM panels_cv WHERE seq % 2 = 0), k AS (SELECT *, concat_ws('_', " + ", ".join(f"cast(floor({c} / 10.0::DOUBLE + 0.5) AS BIGINT)" for c in "xywh") + ") AS key FROM u) SELECT page_id, seq, detector, x, y, w, h, conf FROM k QUALIFY count(*) OVER (PARTITION BY page_id, key) >= 2 AND row_number() OVER (PARTITION BY page_id, key ORDER BY detector, seq) = 1", "panels_cv", "panels_ml"),
    "panel_insight": X.with_fixtures(f", e AS (SELECT page_id, seq, w, h, t / 20.0::DOUBLE AS edge, 100 + x % 150 AS bright FROM panels_cv) SELECT page_id, seq, CASE WHEN edge > 0.3 AND w > h THEN 'action' WHEN edge > 0.2 AND h > 1.5 * w THEN 'close-up' WHEN bright > 180 AND w > 0.8 * {W} THEN 'establishing' WHEN w > 0.9 * {W} AND h < 0.2 * {H} THEN 'transition' WHEN edge > 0.15 THEN 'dialogue' ELSE 'mixed' END AS kind, round(least(1.0::DOUBLE, 2.0::DOUBLE * w * h / {W * H}::DOUBLE + edge), 9) AS importance FROM e", "panels_cv"),
    "seg_mask": X.with_fixtures("SELECT q.page_id, t.i % 20 AS x, t.i // 20 AS y, CASE WHEN floor(q.g / 64) > 0 THEN 255.0::DOUBLE ELSE 0 END AS v FROM px8 q JOIN (SELECT unnest(range(0, 240)) AS i) t ON q.x = t.i % 20 * 8 // 20 AND q.y = t.i // 20 * 8 // 12", "px8"),
    "split_mod": X.with_fixtures("SELECT page_id, CASE WHEN (row_number() OVER (ORDER BY page_id) - 1) % 5 = 0 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT page_id FROM panels_cv)", "panels_cv"),
    "iou": X.with_fixtures(f"SELECT a.page_id, a.seq AS a, b.seq AS b, round({iou_sql('a', 'b')}, 9) AS iou, round({intersection_sql('a', 'b')} / least(a.w * a.h, b.w * b.h)::DOUBLE, 9) AS containment {_PAIR} WHERE {intersection_sql('a', 'b')} > 0", "panels_cv"),
    "overlap_class": X.with_fixtures(f"SELECT a.page_id, a.seq AS a, b.seq AS b, {_overlap('a', 'b')} AS overlap {_PAIR} WHERE {intersection_sql('a', 'b')} > 0", "panels_cv"),
    "merge_rects": X.with_fixtures(f"SELECT a.page_id, a.seq AS a, b.seq AS b, least(a.x, b.x) AS x, least(a.y, b.y) AS y, greatest(a.x + a.w, b.x + b.w) - least(a.x, b.x) AS w, greatest(a.y + a.h, b.y + b.h) - least(a.y, b.y) AS h, greatest(a.conf, b.conf) AS conf, CASE WHEN a.w * a.h >= b.w * b.h THEN a.seq ELSE b.seq END AS kind_of {_PAIR} WHERE {_overlap('a', 'b')} = 'duplicate'", "panels_cv"),
    "containment_antijoin": X.with_fixtures(f"SELECT b.page_id, b.seq, 'panel-' || (row_number() OVER (PARTITION BY b.page_id ORDER BY b.seq) - 1) AS panel_id FROM panels_cv b WHERE NOT EXISTS (SELECT 1 FROM panels_cv a WHERE a.page_id = b.page_id AND a.w * a.h > b.w * b.h AND {intersection_sql('a', 'b')} > 0.8 * (b.w * b.h))", "panels_cv"),
    "nms_hard": _NMS,
    "nms_soft": X.with_fixtures(f"SELECT * FROM (SELECT p.page_id, p.seq, round(p.conf / 100.0::DOUBLE * exp(-coalesce((SELECT sum({iou_sql('a', 'p')}) FROM panels_cv a WHERE a.page_id = p.page_id AND (a.conf > p.conf OR a.conf = p.conf AND a.seq < p.seq) AND {iou_sql('a', 'p')} > 0.5), 0) / 0.5), 9) AS score FROM panels_cv p) WHERE score > 0.3", "panels_cv"),
    "overlap_mark": _fold("-(w * h), seq", "{'seq': p.seq, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h, 'parent': NULL::BIGINT}", f"list_append(f.kept, {{'seq': p.seq, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h, 'parent': {_CLAIM}}})", "page_id, q.seq AS seq, q.parent AS parent"),
    "overlap_merge": _fold("-(w * h), seq", "{'seq': p.seq, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h, 'conf': p.conf::DOUBLE, 'overlapping': false}", f"CASE WHEN len(list_filter(f.kept, lambda k: {_DUP})) > 0 THEN list_transform(f.kept, lambda k: CASE WHEN k.seq = {_FIRST_DUP.replace('lambda k', 'lambda m').replace('k.', 'm.')} THEN {_MERGED} ELSE k END) ELSE list_append(f.kept, {{'seq': p.seq, 'x': p.x, 'y': p.y, 'w': p.w, 'h': p.h, 'conf': CASE WHEN {_HELD} THEN p.conf * 0.9::DOUBLE ELSE p.conf::DOUBLE END, 'overlapping': {_HELD}}}) END", "page_id, q.seq AS seq, q.x AS x, q.y AS y, q.w AS w, q.h AS h, round(q.conf, 6) AS conf, q.overlapping AS overlapping"),
    "best_match": X.with_fixtures(f"SELECT a.page_id, a.seq, round(max({iou_sql('a', 'b')}), 9) AS iou FROM panels_cv a JOIN panels_ml b USING (page_id) GROUP BY a.page_id, a.seq", "panels_cv", "panels_ml"),
    "fuse_by_area": X.with_fixtures(f""", met AS MATERIALIZED (SELECT * FROM (SELECT a.page_id, a.seq, b.seq AS mseq, b.x, b.y, b.w, b.h, b.conf, {iou_sql('a', 'b')} AS iou FROM panels_cv a JOIN panels_ml b ON a.page_id = b.page_id) WHERE iou > 0.2),
        best AS MATERIALIZED (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY page_id, seq ORDER BY iou DESC, mseq) = 1), j AS (SELECT c.*, m.x AS mx, m.y AS my, m.w AS mw, m.h AS mh, m.conf AS mc, m.iou, coalesce(m.iou > 0.5 AND m.w * m.h < c.w * c.h, false) AS tight FROM panels_cv c LEFT JOIN best m ON m.page_id = c.page_id AND m.seq = c.seq)
        SELECT page_id, 'cv' AS source, seq, CASE WHEN tight THEN mx ELSE x END AS x, CASE WHEN tight THEN my ELSE y END AS y, CASE WHEN tight THEN mw ELSE w END AS w, CASE WHEN tight THEN mh ELSE h END AS h,
        round(CASE WHEN iou > 0.5 THEN greatest(conf, mc)::DOUBLE WHEN iou > 0.2 THEN (conf + mc) / 2.0::DOUBLE ELSE conf * 0.8::DOUBLE END, 6) AS conf FROM j
        UNION ALL SELECT l.page_id, 'ml', l.seq, l.x, l.y, l.w, l.h, round(l.conf * 0.7::DOUBLE, 6) FROM panels_ml l LEFT JOIN (SELECT DISTINCT page_id, mseq FROM met) u ON u.page_id = l.page_id AND u.mseq = l.seq WHERE u.mseq IS NULL""", "panels_cv", "panels_ml").replace("panels_cv AS (", "panels_cv AS MATERIALIZED (", 1),
    "fuse_exclusive": _EXCLUSIVE,
    "ensemble_vote": X.with_fixtures(", u AS (SELECT page_id, 'cv' AS detector, seq, x, y, w, h FROM panels_cv UNION ALL SELECT page_id, 'ml', seq, x, y, w, h FROM panels_ml) SELECT page_id, concat_ws('_', cast(floor(x / 10.0::DOUBLE + 0.5) AS BIGINT), cast(floor(y / 10.0::DOUBLE + 0.5) AS BIGINT), cast(floor(w / 10.0::DOUBLE + 0.5) AS BIGINT), cast(floor(h / 10.0::DOUBLE + 0.5) AS BIGINT)) AS key, count(*) AS votes, min((detector, seq))[1] AS detector, min((detector, seq))[2] AS seq FROM u GROUP BY page_id, key HAVING count(*) >= 1".replace("min((detector, seq))[1]", "arg_min(detector, (detector, seq))").replace("min((detector, seq))[2]", "arg_min(seq, (detector, seq))"), "panels_cv", "panels_ml"),
    "ensemble_leaders": _LEADERS,
    "ensemble_wavg": _LEADERS.replace("SELECT page_id, q.seq AS seq, q.leader AS leader FROM z", ", c AS (SELECT page_id, q.seq AS seq, q.leader AS leader FROM z) SELECT c.page_id, c.leader AS seq, " + ", ".join(f"cast(floor(sum(p.{c} * p.conf) / sum(p.conf)::DOUBLE + 0.5) AS BIGINT) AS {c}" for c in "xywh") + ", max(p.conf) AS conf, count(*) AS members FROM c JOIN panels_cv p ON p.page_id = c.page_id AND p.seq = c.seq GROUP BY c.page_id, c.leader"),
    "tta": X.with_fixtures(f", v AS ({_VIEWS}) SELECT page_id, seq, view, {_ROUND.format(f'''CASE WHEN view = 'flip_h' THEN {W} - x - w ELSE x / {_SC} END''')} AS x, {_ROUND.format(f'''CASE WHEN view = 'flip_v' THEN {H} - y - h ELSE y / {_SC} END''')} AS y, {_ROUND.format(f'w / {_SC}')} AS w, {_ROUND.format(f'h / {_SC}')} AS h FROM v", "panels_cv"),
    "multi_scale": X.with_fixtures("SELECT page_id, seq, scale, " + ", ".join(f"cast(floor(floor({c} * scale + 0.5) / scale + 0.5) AS BIGINT) AS {c}" for c in "xywh") + " FROM panels_cv, (SELECT unnest([0.5::DOUBLE, 1.0::DOUBLE, 1.5::DOUBLE]) AS scale)", "panels_cv"),
    "reading_order": _order(False),
    "reading_order_vertical": _order(True),
    "limit_panels": X.with_fixtures("SELECT page_id, seq FROM panels_cv QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY seq) <= 3", "panels_cv"),
    "reindex": X.with_fixtures("SELECT page_id, seq, 'panel-' || (row_number() OVER (PARTITION BY page_id ORDER BY y, x, seq) - 1) AS panel_id FROM panels_cv", "panels_cv"),
    "union_candidates": X.with_fixtures("SELECT page_id, seq, x, y, w, h, conf, 'cv' AS detector FROM panels_cv UNION ALL SELECT page_id, seq, x, y, w, h, conf, 'ml' FROM panels_ml", "panels_cv", "panels_ml"),
    "panel_type": X.with_fixtures(f", e AS (SELECT *, {_EDGE} FROM panels_cv) SELECT page_id, seq, CASE WHEN l AND r AND NOT t0 AND NOT b THEN 'full-width' WHEN l OR r OR t0 OR b THEN 'bleed' WHEN w * h / {W * H}::DOUBLE < 0.1 THEN 'inset' WHEN w > 0.4 * {H} AND h < 0.3 * {W} THEN 'split' ELSE 'standard' END AS kind, CASE WHEN conf / 100.0 < 0.5 THEN 'borderless' WHEN w * h / {W * H}::DOUBLE < 0.08 THEN 'inset' WHEN l AND r THEN 'full-width' WHEN l OR r OR t0 OR b THEN 'bleed' ELSE 'standard' END AS kind_ml FROM e", "panels_cv"),
    "panel_content": X.with_fixtures(f", e AS (SELECT page_id, seq, w, h, t / 40.0::DOUBLE AS tx, (x % 100) / 300.0::DOUBLE AS motion, (y % 100) / 250.0::DOUBLE AS face, 100 + x % 150 AS bright FROM panels_cv), k AS (SELECT *, CASE WHEN tx > 0.15 THEN 'dialogue' WHEN motion > 0.2 THEN 'action' WHEN face > 0.3 AND w < 0.4 * {W} THEN 'close-up' WHEN bright > 180 AND tx < 0.05 THEN 'establishing' WHEN w > 0.8 * {W} AND h < 0.2 * {H} THEN 'transition' ELSE 'mixed' END AS kind FROM e) SELECT page_id, seq, kind, CASE kind WHEN 'dialogue' THEN 0.8::DOUBLE WHEN 'action' THEN 0.75::DOUBLE WHEN 'close-up' THEN 0.7::DOUBLE WHEN 'establishing' THEN 0.65::DOUBLE WHEN 'transition' THEN 0.6::DOUBLE ELSE 0.5::DOUBLE END AS confidence, round(least(1.0::DOUBLE, 2.0::DOUBLE * w * h / {W * H}::DOUBLE + motion), 9) AS importance FROM k", "panels_cv"),
    "quality": _NMS.replace("SELECT page_id, q.seq AS seq, q.conf AS conf FROM z", f""", s AS (SELECT page_id, sum(q.w * q.h / {W * H}::DOUBLE) AS coverage, count(*) FILTER (q.w * q.h / {W * H}::DOUBLE > 0.5) AS large, count(*) FILTER (q.w * q.h / {W * H}::DOUBLE < 0.01) AS tiny FROM z GROUP BY page_id),
        g AS (SELECT s.*, max(t) / 50.0::DOUBLE AS noise, max(t) * 100.0::DOUBLE AS compression FROM s JOIN panels_cv c ON c.page_id = s.page_id GROUP BY ALL),
        u AS (SELECT *, round(0.85::DOUBLE - {_P_LOSS}, 4) AS precision, round(0.80::DOUBLE - {_R_LOSS}, 4) AS recall FROM g)
        SELECT page_id, precision, recall, cast(floor(50 * (precision + recall) + 0.5) AS BIGINT) AS score, concat_ws('; ', {', '.join(f"CASE WHEN {c} THEN '{k}' END" for k, c in _ISSUES)}) AS issues FROM u"""),
    "adaptive_opts": X.with_fixtures(", c AS (SELECT page_id, count(*) AS n, max(t) AS t, min(x) AS x FROM panels_cv GROUP BY page_id) SELECT page_id, cast(greatest(0, least(100, 65 + CASE WHEN x % 40 > 20 THEN 10 WHEN x % 40 < 10 THEN -10 ELSE 0 END)) AS INT) AS gutter, cast(greatest(0, least(100, 80 + CASE WHEN t > 5 OR n * 2 > 10 THEN 15 ELSE 0 END)) AS INT) AS protection, cast(CASE WHEN x * 2.0 > 500 THEN 80 WHEN t / 50.0::DOUBLE > 0.1 THEN 50 WHEN x / 2000.0::DOUBLE > 0.05 THEN 75 ELSE 60 END AS INT) AS edge, CASE WHEN t > 5 THEN 'webtoon' WHEN t > 2 THEN 'manga' ELSE 'auto' END AS kind, t / 15.0::DOUBLE > 0.3 AS diagonal, n * 3 > 15 AS fast FROM c", "panels_cv"),
    "yolo_decode": X.with_fixtures(f", b AS (SELECT page_id, i AS seq, greatest(0.0::DOUBLE, (cx - w / 2) / {SCALE!r}::DOUBLE) AS x, greatest(0.0::DOUBLE, (cy - h / 2) / {SCALE!r}::DOUBLE) AS y, w / {SCALE!r}::DOUBLE AS w, h / {SCALE!r}::DOUBLE AS h, score AS conf FROM anchors WHERE score >= 0.5) SELECT page_id, seq, round(x, 6) AS x, round(y, 6) AS y, round(least(w, {W} - x), 6) AS w, round(least(h, {H} - y), 6) AS h, conf FROM b WHERE least(w, {W} - x) >= 50 AND least(h, {H} - y) >= 50", "anchors"),
    "yolo_normalize": X.with_fixtures(f"SELECT page_id, seq, printf('0 %.6f %.6f %.6f %.6f', (x + w / 2.0::DOUBLE) / {W}, (y + h / 2.0::DOUBLE) / {H}, w / {float(W)}::DOUBLE, h / {float(H)}::DOUBLE) AS line FROM panels_cv", "panels_cv"),
    "snk_json": X.with_fixtures("""SELECT page_id, '{"page_id":' || page_id || ',"count":' || count(*) || ',"panels":[' || string_agg('{"seq":' || seq || ',"x":' || x || ',"y":' || y || ',"w":' || w || ',"h":' || h || ',"conf":' || conf || '}', ',' ORDER BY seq) || ']}' AS json FROM panels_cv GROUP BY page_id""", "panels_cv"),
    "snk_summary": X.with_fixtures("SELECT count(DISTINCT c.page_id) AS pages, (SELECT count(DISTINCT page_id) FROM panels_ml) AS pages_ok, (SELECT count(*) FROM panels_ml) AS panels, (SELECT count(*) FROM panels_ml) / count(DISTINCT c.page_id)::DOUBLE AS mean_panels FROM panels_cv c", "panels_cv", "panels_ml"),
    "average_precision": X.with_fixtures(_AP, "panels_cv", "panels_ml", recursive=True),
    "eval_match": X.with_fixtures(f", m AS (SELECT a.page_id, a.seq, max({iou_sql('a', 'b')}) AS iou FROM panels_cv a JOIN panels_ml b ON a.page_id = b.page_id WHERE {iou_sql('a', 'b')} > 0.5 GROUP BY a.page_id, a.seq) SELECT c.page_id, count(*) AS labels, count(iou) AS found, round(coalesce(avg(iou), 0::DOUBLE), 6) AS mean_iou FROM panels_cv c LEFT JOIN m ON m.page_id = c.page_id AND m.seq = c.seq GROUP BY c.page_id", "panels_cv", "panels_ml"),
    "band_grid": X.with_fixtures(f", r AS ({_BANDS.format(c='y', n=H)}), c AS ({_BANDS.format(c='x', n=W)}) SELECT r.page_id, c.s AS x, r.s AS y, c.e - c.s AS w, r.e - r.s AS h FROM r JOIN c ON r.page_id = c.page_id WHERE c.e - c.s >= 80 AND r.e - r.s >= 100", "panels_cv"),
    "merge_close": X.with_fixtures(""", s AS (SELECT page_id, x, row_number() OVER (PARTITION BY page_id ORDER BY x) AS rk FROM (SELECT DISTINCT page_id, x FROM panels_cv)),
        f AS (SELECT page_id, 1::BIGINT AS k, [x] AS kept FROM s WHERE rk = 1 UNION ALL SELECT f.page_id, f.k + 1, CASE WHEN s.x - kept[len(kept)] <= 40 THEN list_append(kept[:len(kept) - 1], cast(floor((kept[len(kept)] + s.x) / 2.0::DOUBLE + 0.5) AS BIGINT)) ELSE list_append(kept, s.x) END FROM f JOIN s ON s.page_id = f.page_id AND s.rk = f.k + 1)
        SELECT page_id, unnest(arg_max(kept, k)) AS at FROM f GROUP BY page_id""", "panels_cv", recursive=True),
}

#: CRC-32 of an id's decimal digits, as eight shifts for each of its bytes.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(page_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)), lambda crc, b: list_reduce(list_prepend(xor(crc, b), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))), 4294967295)"
_BEST = f"""(SELECT *, greatest(score, (i * 37 % 100) / 100.0::DOUBLE, (page_id * 13 % 100) / 100.0::DOUBLE) AS best FROM anchors)"""
_DECODED = f""", b AS (SELECT page_id, i AS seq, greatest(0.0::DOUBLE, (cx - w / 2) / {SCALE!r}::DOUBLE) AS x, greatest(0.0::DOUBLE, (cy - h / 2) / {SCALE!r}::DOUBLE) AS y, w / {SCALE!r}::DOUBLE AS w, h / {SCALE!r}::DOUBLE AS h, best AS conf FROM {_BEST} WHERE best >= 0.5),
    cut AS (SELECT page_id, seq, x, y, least(w, {W} - x) AS w, least(h, {H} - y) AS h, conf FROM b WHERE least(w, {W} - x) >= 50 AND least(h, {H} - y) >= 50)"""
_RATED = f"(SELECT page_id, seq, round(least(1.0::DOUBLE, 2.0::DOUBLE * w * h / {W * H}::DOUBLE + t / 20.0::DOUBLE), 6) AS importance FROM panels_cv)"
_SEEN = f"""SELECT page_id, seq, '1 ' || view AS origin, x, y, w, h FROM ({ORACLE["tta"]}) UNION ALL SELECT page_id, seq, '2 ' || scale::VARCHAR, x, y, w, h FROM ({ORACLE["multi_scale"]})"""
ORACLE |= {
    "split_pages": X.with_fixtures(f"SELECT page_id, CASE WHEN {_CRC} % 5 < 1 THEN 'val' ELSE 'train' END AS split FROM (SELECT DISTINCT page_id FROM panels_cv)", "panels_cv"),
    "yolo_decode_classes": _fold("conf DESC, seq", f"{{{_BOX}}}", f"CASE WHEN len(list_filter(f.kept, lambda k: {_IOU} > 0.4)) > 0 THEN f.kept ELSE list_append(f.kept, {{{_BOX}}}) END", "page_id, q.seq AS seq, round(q.conf, 6) AS conf", "anchors", _DECODED, "cut"),
    "reading_order_smart": X.with_fixtures(
        f"""{_SIG} SELECT o.page_id, o.seq, o.position FROM ({_order(True)}) o JOIN sig ON sig.page_id = o.page_id WHERE layout = 'vertical'
        UNION ALL SELECT o.page_id, o.seq, o.position FROM ({_order(False)}) o JOIN sig ON sig.page_id = o.page_id WHERE layout = 'grid'
        UNION ALL SELECT r.page_id, r.seq, row_number() OVER (PARTITION BY r.page_id ORDER BY importance DESC, r.seq) FROM {_RATED} r JOIN sig ON sig.page_id = r.page_id WHERE layout NOT IN ('vertical', 'grid')""",
        "panels_cv",
    ),
    "advanced": X.with_fixtures(
        f""", s AS ({_SEEN}), n AS (SELECT s.page_id, row_number() OVER (PARTITION BY s.page_id ORDER BY s.seq, origin) AS seq, s.x, s.y, s.w, s.h, c.conf FROM s JOIN panels_cv c ON c.page_id = s.page_id AND c.seq = s.seq),
        d AS (SELECT b.page_id, b.seq, sum({iou_sql("a", "b")}) AS decay FROM n a JOIN n b ON a.page_id = b.page_id AND (a.conf > b.conf OR a.conf = b.conf AND a.seq < b.seq) AND {iou_sql("a", "b")} > 0.5 GROUP BY b.page_id, b.seq),
        e AS (SELECT n.page_id, n.seq, n.conf / 100.0::DOUBLE * exp(-coalesce(decay, 0) / 0.5::DOUBLE) AS score FROM n LEFT JOIN d ON d.page_id = n.page_id AND d.seq = n.seq)
        SELECT page_id, seq, round(score, 6) AS score FROM e WHERE score > 0.3""",
        "panels_cv",
    ),
}
