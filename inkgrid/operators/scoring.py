"""Classification and scoring: decision trees over panel and page metrics, as CASE expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def panel_type(page_w: Column | int, page_h: Column | int, inset: bool = True, margin: int = 5) -> Column:
    """Type of a panel (x, y, w, h) by the page edges that it touches and its size."""
    w, h = F.col("w"), F.col("h")
    left, right, top, bottom = F.col("x") < margin, F.col("x") + w > F.lit(page_w) - margin, F.col("y") < margin, F.col("y") + h > F.lit(page_h) - margin
    small = F.lit(inset) & (w * h / (F.lit(page_w) * F.lit(page_h)) < 0.1)
    return F.when(left & right & ~top & ~bottom, "full-width").when(left | right | top | bottom, "bleed").when(small, "inset").when((w > 0.4 * F.lit(page_h)) & (h < 0.3 * F.lit(page_w)), "split").otherwise("standard")


def panel_type_ml(page_w: int, page_h: int, fill: Column, margin: int = 5) -> Column:
    """Type of a panel found by segmentation; how full its box is decides first."""
    w, h = F.col("w"), F.col("h")
    left, right, top, bottom = F.col("x") < margin, F.col("x") + w > page_w - margin, F.col("y") < margin, F.col("y") + h > page_h - margin
    return F.when(fill < 0.5, "borderless").when(w * h / (page_w * page_h) < 0.08, "inset").when(left & right, "full-width").when(left | right | top | bottom, "bleed").otherwise("standard")


def panel_content(page_w: Column, page_h: Column) -> Column:
    """(kind, confidence) of a panel by its text, motion and face density, brightness and size; the first rule wins."""
    text, motion, face, bright = F.col("text"), F.col("motion"), F.col("face"), F.col("bright")
    kind = lambda k, c: F.struct(F.lit(k).alias("kind"), F.lit(c).alias("confidence"))
    return (
        F.when(text > 0.15, kind("dialogue", 0.8))
        .when(motion > 0.2, kind("action", 0.75))
        .when((face > 0.3) & (F.col("w") < 0.4 * page_w), kind("close-up", 0.7))
        .when((bright > 180) & (text < 0.05), kind("establishing", 0.65))
        .when((F.col("w") > 0.8 * page_w) & (F.col("h") < 0.2 * page_h), kind("transition", 0.6))
        .otherwise(kind("mixed", 0.5))
    )


def panel_insight(edge: Column, page_w: Column, page_h: Column) -> Column:
    """Importance of a panel: twice its share of the page plus its edge density, at most 1."""
    return F.least(F.lit(1.0), 2.0 * F.col("w") * F.col("h") / (page_w * page_h) + edge)


def layout_type(low_rows: Column, low_columns: Column) -> Column:
    """Layout by the shares of low-variance rows and columns."""
    return F.when((low_rows > 0.3) & (low_columns > 0.3), "grid").when((low_rows > 0.3) & (low_columns < 0.1), "vertical").when((low_rows > 0.15) | (low_columns > 0.15), "mixed").otherwise("freeform")


def adaptive_options(defaults: dict[str, int]) -> list[Column]:
    """Options that follow a page's characteristics; the columns that they read are named as the characteristics are."""
    gutter = F.lit(defaults["gutter"]) + F.when(F.col("gutter_width") > 20, 10).when(F.col("gutter_width") < 10, -10).otherwise(0)
    protection = F.lit(defaults["protection"]) + F.when((F.col("faces") > 5) | (F.col("bubbles") > 10), 15).otherwise(0)
    edge = F.when(F.col("compression") > 500, defaults["edge"] + 20).when(F.col("clarity") > 0.1, defaults["edge"] - 10).when(F.col("noise") > 0.05, defaults["edge"] + 15).otherwise(defaults["edge"])
    kind = F.when(F.col("layout") == "vertical", "webtoon").when(F.col("layout") == "grid", "manga").otherwise("auto")
    whole = lambda c: F.greatest(F.lit(0), F.least(F.lit(100), c)).cast("int")
    return [whole(gutter).alias("gutter"), whole(protection).alias("protection"), whole(edge).alias("edge"), kind.alias("kind"), (F.col("action") > 0.3).alias("diagonal"), (F.col("n_panels") > 15).alias("fast")]


def quality(panels: DataFrame, pages: DataFrame) -> DataFrame:
    """(page_id, precision, recall, score, issues) of a page's panels.

    pages: (page_id, page_w, page_h, noise, compression). Precision starts at 0.85 and recall at 0.80; coverage, panel sizes
    and the image's condition take from them; pages without a panel count as covered by nothing.
    """
    share = F.col("w").cast("double") * F.col("h") / (F.col("page_w") * F.col("page_h"))
    sized = pages.join(panels.select("page_id", "w", "h"), "page_id", "left").withColumn("share", share)
    sums = sized.groupBy("page_id").agg(
        F.coalesce(F.sum("share"), F.lit(0.0)).alias("coverage"), F.sum(F.when(F.col("share") > 0.5, 1).otherwise(0)).alias("large"), F.sum(F.when(F.col("share") < 0.01, 1).otherwise(0)).alias("tiny"),
        F.first("noise").alias("noise"), F.first("compression").alias("compression"),
    )
    found = {
        "panels overlap or cover the page": (F.col("coverage") > 0.9, 0.1, 0.0),
        "panels may be missing": (F.col("coverage") < 0.3, 0.0, 0.15),
        "a panel is very large": (F.col("large") > 0, 0.05, 0.0),
        "many panels are tiny": (F.col("tiny") > 3, 0.05, 0.0),
        "the image is noisy": (F.col("noise") > 0.1, 0.1, 0.1),
        "the image is compressed": (F.col("compression") > 500, 0.05, 0.0),
    }
    taken = lambda k, start: F.lit(start) - sum((F.when(c[0], c[k]).otherwise(0.0) for c in found.values()), F.lit(0.0))
    rated = sums.withColumns({"precision": F.round(taken(1, 0.85), 4), "recall": F.round(taken(2, 0.80), 4), "issues": F.concat_ws("; ", *[F.when(c[0], k) for k, c in found.items()])})
    return rated.select("page_id", "precision", "recall", F.floor(50 * (F.col("precision") + F.col("recall")) + 0.5).alias("score"), "issues")


def decode_anchors(anchors: DataFrame, scale: float, page_w: int, page_h: int, least: float = 0.5, smallest: float = 50.0) -> DataFrame:
    """Detector rows with a score of least or more as panels on the page, cut at its edges; small ones go."""
    x, y = F.greatest(F.lit(0.0), (F.col("cx") - F.col("w") / 2) / scale), F.greatest(F.lit(0.0), (F.col("cy") - F.col("h") / 2) / scale)
    boxes = anchors.where(F.col("score") >= least).select("page_id", F.col("i").alias("seq"), x.alias("x"), y.alias("y"), (F.col("w") / scale).alias("w"), (F.col("h") / scale).alias("h"), F.col("score").alias("conf"))
    cut = boxes.withColumns({"w": F.least("w", page_w - F.col("x")), "h": F.least("h", page_h - F.col("y"))})
    return cut.where((F.col("w") >= smallest) & (F.col("h") >= smallest))


def yolo_label(page_w: int, page_h: int) -> Column:
    """Text line of a panel for training: class 0, centre and size as shares of the page, six decimals."""
    shares = [(F.col("x") + F.col("w") / 2.0) / page_w, (F.col("y") + F.col("h") / 2.0) / page_h, F.col("w") / float(page_w), F.col("h") / float(page_h)]
    return F.format_string("0 %.6f %.6f %.6f %.6f", *shares)


def insight_kind(edge: Column, bright: Column, page_w: int, page_h: int) -> Column:
    """What a panel shows by its edge density, brightness and shape; the first rule wins."""
    w, h = F.col("w"), F.col("h")
    return (
        F.when((edge > 0.3) & (w > h), "action").when((edge > 0.2) & (h > 1.5 * w), "close-up").when((bright > 180) & (w > 0.8 * page_w), "establishing")
        .when((w > 0.9 * page_w) & (h < 0.2 * page_h), "transition").when(edge > 0.15, "dialogue").otherwise("mixed")
    )


def quality_by_signature(panels: DataFrame, signatures: DataFrame) -> DataFrame:
    """(page_id, precision, recall, score, issues) of a page's panels beside what its signature leads to expect.

    signatures: (page_id, page_w, page_h, n_panels, noise, compression). Pages without a panel count as covered by nothing.
    """
    area = F.col("w").cast("double") * F.col("h")
    whole = F.col("page_w").cast("double") * F.col("page_h")
    sized = signatures.join(panels.select("page_id", "w", "h"), "page_id", "left")
    sums = sized.groupBy("page_id").agg(
        F.count("w").alias("n"), F.coalesce(F.sum(area), F.lit(0.0)).alias("area"), F.sum(F.when(area > 0.5 * whole, 1).otherwise(0)).alias("large"), F.sum(F.when((F.col("w") < 50) | (F.col("h") < 50), 1).otherwise(0)).alias("small"),
        F.first(whole).alias("whole"), F.first("n_panels").alias("n_panels"), F.first("noise").alias("noise"), F.first("compression").alias("compression"),
    )
    expected = F.greatest(F.lit(1), F.col("n_panels"))
    cover, ratio = F.col("area") / F.col("whole"), F.col("area") / F.greatest(F.lit(1), F.col("n")) / (F.col("whole") / expected)
    share, noisy, compressed = F.col("n") / expected, F.col("noise") > 0.15, F.col("compression") > 0.7
    loss = lambda *rules: sum((F.when(c, v).otherwise(0.0) for c, v in rules), F.lit(0.0))
    precision = 0.85 - loss((cover > 0.9, 0.1), (cover < 0.3, 0.05), ((ratio > 2) | (ratio < 0.5), 0.1), (noisy, 0.1), (compressed, 0.05))
    recall = 0.80 - loss((cover < 0.3, 0.15), (share < 0.5, 0.2), (share > 2, 0.1), (noisy, 0.1))
    issues = {"very large panels": F.col("large") > 0, "very small panels": F.col("small") > 0, "panels may be merged": cover > 0.9, "panels may be missing": cover < 0.3, "noisy image": noisy, "compressed image": compressed, "no panels": F.col("n") == 0, "more panels than expected": F.col("n") > 2 * F.col("n_panels")}
    rated = sums.withColumns({"precision": F.round(precision, 4), "recall": F.round(recall, 4), "issues": F.concat_ws("; ", *[F.when(c, k) for k, c in issues.items()])})
    return rated.select("page_id", "precision", "recall", F.floor(50 * (F.col("precision") + F.col("recall")) + 0.5).alias("score"), "issues")


#: What each issue suggests.
SUGGESTIONS = {
    "very large panels": "split large panels", "very small panels": "raise the smallest panel size", "noisy image": "raise the edge sensitivity", "compressed image": "use better images",
    "panels may be missing": "lower the gutter sensitivity", "panels may be merged": "raise the merge threshold",
}


def suggestions(issues: Column) -> Column:
    """Array of what to do about a list of issues as quality() and quality_by_signature() give it."""
    return F.array_compact(F.array(*[F.when(F.contains(issues, F.lit(k)), s) for k, s in SUGGESTIONS.items()]))


def segmentation_mask(labels: DataFrame, map_w: int, map_h: int, width: int, height: int) -> DataFrame:
    """(page_id, x, y, v): a label map spread over the page's pixels, 255 where the nearest label isn't background (0)."""
    reach = lambda c, n, m: F.expr(f"filter(sequence(cast({c} * {n} div {m} AS int), cast(least({n} - 1, ({c} + 1) * {n} div {m}) AS int)), t -> t * {m} div {n} = {c})")
    across = labels.select("page_id", "y", "label", F.explode(reach("x", width, map_w)).alias("tx"))
    return across.select("page_id", "label", "tx", F.explode(reach("y", height, map_h)).alias("ty")).select("page_id", F.col("tx").alias("x"), F.col("ty").alias("y"), F.when(F.col("label") > 0, 255.0).otherwise(0.0).alias("v"))


def decode_classes(anchors: DataFrame, scale: float, page_w: int, page_h: int, least: float = 0.5, smallest: float = 50.0) -> DataFrame:
    """Like decode_anchors for rows with an array of scores, one a class: the best class counts, the first of equals."""
    best = F.array_max("scores")
    rated = anchors.withColumns({"score": best, "class": F.array_position("scores", best) - 1})
    return decode_anchors(rated, scale, page_w, page_h, least, smallest)
