"""Aggregates over pixels (page_id, x, y, and a value or channels): histograms, projections, blocks, page statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def histogram(pixels: DataFrame, value: str = "g") -> DataFrame:
    """(page_id, bin, n) over 256 bins of the rounded, clamped value; empty bins are left out."""
    bin_ = F.greatest(F.lit(0), F.least(F.lit(255), F.floor(F.col(value) + 0.5))).cast("int")
    return pixels.groupBy("page_id", bin_.alias("bin")).agg(F.count("*").alias("n"))


def otsu(pixels: DataFrame, value: str = "g") -> DataFrame:
    """(page_id, threshold): the bin that parts the histogram with the largest variance between both sides; the first of equals.

    A bin can only be best where pixels fall into it, or, among equals, before it, so empty bins need no rows.
    """
    upto = W.partitionBy("page_id").orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    whole = W.partitionBy("page_id")
    sums = histogram(pixels, value).withColumns({"n0": F.sum("n").over(upto), "s0": F.sum(F.col("bin") * F.col("n")).over(upto), "n_all": F.sum("n").over(whole), "s_all": F.sum(F.col("bin") * F.col("n")).over(whole)})
    n1 = F.col("n_all") - F.col("n0")
    apart = F.col("s0").cast("double") / F.col("n0") - (F.col("s_all") - F.col("s0")) / F.nullif(n1, F.lit(0))
    between = F.coalesce(F.col("n0").cast("double") * n1 * apart * apart, F.lit(0.0))
    # The first of the largest; where none is above 0, the threshold is 0.
    best = sums.withColumn("between", between).groupBy("page_id").agg(F.max(F.struct("between", (-F.col("bin")).alias("early"))).alias("best"))
    return best.select("page_id", F.when(F.col("best.between") > 0, -F.col("best.early")).otherwise(0).alias("threshold"))


def share_by(pixels: DataFrame, axis: str, is_set: Column, name: str) -> DataFrame:
    """Share of set pixels along a row (axis y) or column (axis x)."""
    return pixels.groupBy("page_id", axis).agg(F.avg(F.when(is_set, 1.0).otherwise(0.0)).alias(name))


def block_variance(pixels: DataFrame, block: int = 8) -> DataFrame:
    """(page_id, bx, by, n, variance) of block x block pixels; blocks at the edge may be smaller."""
    cell = lambda c: F.floor(F.col(c) / block).alias(f"b{c}")
    mean = F.sum("g") / F.count("*")
    return pixels.groupBy("page_id", cell("x"), cell("y")).agg(F.count("*").alias("n"), (F.sum(F.col("g") * F.col("g")) / F.count("*") - mean * mean).alias("variance"))


def line_variance(pixels: DataFrame, axis: str, step: int) -> DataFrame:
    """Population variance of every step-th row (axis y) or column (axis x)."""
    mean = F.sum("g") / F.count("*")
    return pixels.where(F.col(axis) % step == 0).groupBy("page_id", axis).agg((F.sum(F.col("g") * F.col("g")) / F.count("*") - mean * mean).alias("variance"))


def page_statistics(pixels: DataFrame) -> DataFrame:
    """Of gray pixels: brightness (mean) and contrast (population deviation)."""
    mean = F.sum("g") / F.count("*")
    return pixels.groupBy("page_id").agg(mean.alias("brightness"), F.sqrt(F.greatest(F.lit(0.0), F.sum(F.col("g") * F.col("g")) / F.count("*") - mean * mean)).alias("contrast"))


def colourfulness(pixels: DataFrame) -> DataFrame:
    """Root of the mean variance of a pixel's three channels; (page_id, colourfulness)."""
    r, g, b = (F.col(c).cast("double") for c in "rgb")
    m = (r + g + b) / 3
    spread = ((r - m) * (r - m) + (g - m) * (g - m) + (b - m) * (b - m)) / 3
    return pixels.groupBy("page_id").agg(F.sqrt(F.sum(spread) / F.count("*")).alias("colourfulness"))


def share(pixels: DataFrame, condition: Column, name: str) -> DataFrame:
    """Share of pixels for which a condition holds; null counts as no."""
    return pixels.groupBy("page_id").agg((F.sum(F.when(condition, 1).otherwise(0)) / F.count("*")).alias(name))


def action_density(edges: DataFrame, strong: float = 50.0) -> DataFrame:
    """Of the strong edges, the share of diagonal ones; 0 without any. edges: (page_id, magnitude, direction)."""
    angle = F.abs(F.degrees("direction"))
    diagonal = ((angle > 30) & (angle < 60)) | ((angle > 120) & (angle < 150))
    hard = F.col("magnitude") > strong
    n = F.sum(F.when(hard, 1).otherwise(0))
    return edges.groupBy("page_id").agg(F.coalesce(F.try_divide(F.sum(F.when(hard & diagonal, 1.0).otherwise(0.0)), n), F.lit(0.0)).alias("action"))


def text_density(edges: DataFrame, strong: float = 80.0, dense: float = 0.3, block: int = 8) -> DataFrame:
    """Share of the page's pixels that lie in blocks with a dense share of strong edges."""
    cells = edges.groupBy("page_id", F.floor(F.col("x") / block), F.floor(F.col("y") / block)).agg(F.count("*").alias("n"), F.sum(F.when(F.col("magnitude") > strong, 1).otherwise(0)).alias("hard"))
    return cells.groupBy("page_id").agg((F.sum(F.when(F.col("hard") > dense * F.col("n"), F.col("n")).otherwise(0)) / F.sum("n")).alias("text_density"))


def halve(pixels: DataFrame) -> DataFrame:
    """The next level of a pyramid: means of 2 x 2 pixels, of those that exist at an odd edge."""
    half = lambda c: F.floor(F.col(c) / 2).alias(c)
    return pixels.groupBy("page_id", half("x"), half("y")).agg((F.sum("g") / F.count("*")).alias("g"))


def pyramid(pixels: DataFrame, levels: int = 4) -> DataFrame:
    """(page_id, level, x, y, g) of all levels, the image itself being level 0."""
    level = pixels.select("page_id", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "g")
    out = level.select("page_id", F.lit(0).alias("level"), "x", "y", "g")
    for k in range(1, levels):
        level = halve(level)
        out = out.union(level.select("page_id", F.lit(k).alias("level"), "x", "y", "g"))
    return out


def integral_image(pixels: DataFrame) -> DataFrame:
    """(page_id, x, y, total): sums over all pixels up and left of each, itself included."""
    along = lambda part, order: W.partitionBy("page_id", part).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    rows = pixels.withColumn("row", F.sum("g").over(along("y", "x")))
    return rows.select("page_id", "x", "y", F.sum("row").over(along("x", "y")).alias("total"))


def box_histogram(pixels: DataFrame, boxes: DataFrame, value: str = "g") -> DataFrame:
    """(page_id, seq, bin, share): normalised histogram of each box, cut at the image's edge."""
    inside = pixels.join(boxes, "page_id").where("px >= x AND px < x + w AND py >= y AND py < y + h") if "px" in pixels.columns else in_boxes(pixels, boxes)
    counted = inside.groupBy("page_id", "seq", F.col(value).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    return counted.select("page_id", "seq", "bin", (F.col("n") / F.sum("n").over(W.partitionBy("page_id", "seq"))).alias("share"))


def in_boxes(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels as (px, py, ...) with the box (seq, x, y, w, h) of the same page in which they lie."""
    moved = pixels.withColumnsRenamed({"x": "px", "y": "py"})
    return moved.join(boxes, "page_id").where("px >= x AND px < x + w AND py >= y AND py < y + h")


def chi_square(histograms: DataFrame) -> DataFrame:
    """(page_id, a, b, distance) of each two boxes' histograms of a page, a before b."""
    sides = histograms.groupBy("page_id", "seq").agg(F.map_from_entries(F.collect_list(F.struct("bin", "share"))).alias("m"))
    a, b = sides.select("page_id", F.col("seq").alias("a"), F.col("m").alias("ma")), sides.select("page_id", F.col("seq").alias("b"), F.col("m").alias("mb"))
    pairs = a.join(b, "page_id").where("a < b").select("page_id", "a", "b", "ma", "mb", F.explode(F.array_sort(F.array_union(F.map_keys("ma"), F.map_keys("mb")))).alias("bin"))
    p, q = (F.coalesce(F.try_element_at(m, F.col("bin")), F.lit(0.0)) for m in (F.col("ma"), F.col("mb")))
    return pairs.groupBy("page_id", "a", "b").agg(F.sum((p - q) * (p - q) / (p + q)).alias("distance"))
