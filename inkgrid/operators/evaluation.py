"""How well predicted panels meet labelled ones: greedy matches at several overlaps, and average precision."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrid.functions import boxes
from inkgrid.operators.rounds import running

#: Overlaps from one half to 0.95.
OVERLAPS = tuple(k / 20.0 for k in range(10, 20))


def greedy_matches(labels: DataFrame, predictions: DataFrame, overlaps: tuple[float, ...] = OVERLAPS) -> DataFrame:
    """(page_id, overlap, seq, conf, label): each prediction's label, null without one, at each overlap.

    A page's predictions take labels in the order of confidence (ties by seq): each the free one that it covers most, at least by the
    overlap, ties by the label's seq. Labels and predictions are (page_id, seq, x, y, w, h), and conf for predictions.
    """
    a, b = labels.select("page_id", F.struct("seq", "x", "y", "w", "h").alias("a")), predictions.select("page_id", F.struct("seq", "x", "y", "w", "h").alias("b"))
    met = b.join(a, "page_id").withColumn("iou", boxes.iou("a.", "b.")).where(F.col("iou") >= min(overlaps))
    near = met.groupBy("page_id", F.col("b.seq").alias("seq")).agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("less"), F.col("a.seq").alias("label")))).alias("near"))
    ranked = predictions.select("page_id", "seq", "conf").join(near, ["page_id", "seq"], "left")
    pages = ranked.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("conf")).alias("less"), "seq", "conf", F.coalesce("near", F.expr("array()")).alias("near")))).alias("all"))
    each = pages.select("page_id", "all", F.explode(F.array(*[F.lit(o) for o in overlaps])).alias("overlap"))
    kind = predictions.schema["conf"].dataType.simpleString(), predictions.schema["seq"].dataType.simpleString(), labels.schema["seq"].dataType.simpleString()
    pick = "element_at(filter(p.near, c -> -c.less >= overlap AND NOT array_contains(s.used, c.label)), 1).label"
    fold = f"""aggregate(all, named_struct('used', cast(array() AS array<{kind[2]}>), 'out', cast(array() AS array<struct<seq: {kind[1]}, conf: {kind[0]}, label: {kind[2]}>>)), (s, p) -> named_struct(
        'used', CASE WHEN try_element_at(filter(p.near, c -> -c.less >= overlap AND NOT array_contains(s.used, c.label)), 1) IS NULL THEN s.used ELSE array_append(s.used, {pick.replace("element_at", "try_element_at")}) END,
        'out', array_append(s.out, named_struct('seq', p.seq, 'conf', p.conf, 'label', {pick.replace("element_at", "try_element_at")}))), s -> s.out)"""
    return each.select("page_id", "overlap", F.explode(F.expr(fold)).alias("m")).select("page_id", "overlap", "m.seq", "m.conf", "m.label")


def average_precision(labels: DataFrame, predictions: DataFrame, overlaps: tuple[float, ...] = OVERLAPS) -> DataFrame:
    """(overlap, labels, predictions, precision, recall, ap) for each overlap, over all pages.

    ap is the area under the precision that recall can have at least: predictions are taken from the most confident on, those of
    equal confidence together, and each step of recall counts with the best precision from there on. Counts by confidence are
    summed up over range-partitioned rows, so that no task sees all.
    """
    n = labels.count()
    level = F.array_position(F.array(*[F.lit(o) for o in overlaps]), F.col("overlap"))
    matched = greedy_matches(labels, predictions, overlaps).groupBy("overlap", "conf").agg(F.count("label").alias("hits"), F.count("*").alias("n"))
    summed = running(matched.withColumn("level", level), [F.asc("level"), F.desc("conf")], {"found": "hits", "taken": "n"})
    before = summed.groupBy("level").agg(F.min(F.col("found") - F.col("hits")).alias("f"), F.min(F.col("taken") - F.col("n")).alias("t"))
    steps = summed.join(F.broadcast(before), "level").withColumn("found", F.col("found") - F.col("f")).withColumn("taken", F.col("taken") - F.col("t"))
    # From the last step back: the largest so far. Levels two apart start anew, as no precision is over 1.
    back = running(steps.withColumn("best", 2 * F.col("level") + F.col("found") / F.col("taken")), [F.asc("level"), F.asc("conf")], {"envelope": "best"}, largest=True)
    area = F.sum(F.col("hits") / n * (F.col("envelope") - 2 * F.col("level")))
    out = back.groupBy("overlap").agg(F.max("taken").alias("predictions"), F.max("found").alias("found"), area.alias("ap"))
    return out.select("overlap", F.lit(n).cast("long").alias("labels"), "predictions", (F.col("found") / F.col("predictions")).alias("precision"), (F.col("found") / n).alias("recall"), "ap")
