"""Panel algebra: overlap joins, suppression, fusion of detectors, ensembles, order.

Panels are rows (page_id, seq, x, y, w, h, conf, ...). Every join carries page_id as its equi key, so pages spread
over the cluster and pair up only within themselves. Where the result depends on a sequence of choices (greedy
suppression, exclusive matching, leader clusters), a page's panels are folded in their order by a higher-order function.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgrid.functions import boxes
from inkgrid.functions.boxes import intersection_sql, iou_sql

BOX = ["seq", "x", "y", "w", "h", "conf"]


def pairs(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """Pairs of panels of one page as structs a and b; within one table each pair once, a before b in seq."""
    left = a.select("page_id", F.struct(*[c for c in a.columns if c != "page_id"]).alias("a"))
    right = (b if b is not None else a).select("page_id", F.struct(*[c for c in (b if b is not None else a).columns if c != "page_id"]).alias("b"))
    met = left.join(right, "page_id")
    return met if b is not None else met.where("a.seq < b.seq")


def overlaps(panels: DataFrame) -> DataFrame:
    """Overlapping pairs of a page with their iou and class."""
    p = pairs(panels).where(boxes.intersection("a.", "b.") > 0)
    return p.select("page_id", F.col("a.seq").alias("a"), F.col("b.seq").alias("b"), boxes.iou("a.", "b.").alias("iou"), boxes.containment("a.", "b.").alias("containment"), boxes.overlap_class("a.", "b.").alias("overlap"))


def _fold(panels: DataFrame, order: str, step: str, start: str = "") -> DataFrame:
    """A page's panels, sorted by the expressions of order, folded by the SQL step over (kept, p); start: what is kept at first."""
    kinds = {f.name: f.dataType.simpleString() for f in panels.schema.fields}
    start = start or "cast(array() AS array<struct<" + ",".join(f"{c}:{kinds[c]}" for c in BOX) + ">>)"
    keyed = panels.selectExpr("page_id", f"struct({order}, {', '.join(BOX)}) AS p")
    listed = keyed.groupBy("page_id").agg(F.sort_array(F.collect_list("p")).alias("ps"))
    entry = "named_struct(" + ", ".join(f"'{c}', q.{c}" for c in BOX) + ")"
    return listed.selectExpr("page_id", f"aggregate(transform(ps, q -> {entry}), {start}, (kept, p) -> {step}) AS kept")


def nms(panels: DataFrame, threshold: float = 0.4) -> DataFrame:
    """Greedy suppression by falling confidence (then seq): a panel goes if a kept one overlaps it by more than threshold."""
    step = f"CASE WHEN exists(kept, k -> {iou_sql('k', 'p')} > {threshold}) THEN kept ELSE array_append(kept, p) END"
    return _fold(panels, "-conf AS o", step).select("page_id", F.inline("kept"))


def soft_nms(panels: DataFrame, iou: float = 0.5, sigma: float = 0.5, least: float = 0.3) -> DataFrame:
    """Confidence (percent) decays by exp(-iou/sigma) for each overlapping panel that comes before; weak ones go.

    A panel's factors only depend on the panels before it, so the loop has the closed form of one sum per panel.
    """
    before = (F.col("a.conf") > F.col("b.conf")) | ((F.col("a.conf") == F.col("b.conf")) & (F.col("a.seq") < F.col("b.seq")))
    heavy = pairs(panels, panels).where(before & (boxes.iou("a.", "b.") > iou))
    decay = heavy.groupBy("page_id", F.col("b.seq").alias("seq")).agg(F.sum(boxes.iou("a.", "b.")).alias("decay"))
    scored = panels.join(decay, ["page_id", "seq"], "left").withColumn("score", F.col("conf") / 100.0 * F.exp(-F.coalesce("decay", F.lit(0.0)) / sigma))
    return scored.where(F.col("score") > least).drop("decay")


def drop_contained(panels: DataFrame, share: float = 0.8) -> DataFrame:
    """Panels of which no strictly larger one covers more than share, with new ids in order of seq."""
    met = pairs(panels, panels).where((boxes.area("a.") > boxes.area("b.")) & (boxes.intersection("a.", "b.") > share * boxes.area("b.")))
    gone = met.select("page_id", F.col("b.seq").alias("seq")).distinct()
    return reindex(panels.join(gone, ["page_id", "seq"], "left_anti"))


def reindex(panels: DataFrame, *order: str) -> DataFrame:
    """panel_id: panel-0, panel-1, ... of each page."""
    return panels.withColumn("panel_id", F.concat(F.lit("panel-"), (F.row_number().over(W.partitionBy("page_id").orderBy(*(order or ("seq",)))) - 1).cast("string")))


def limit(panels: DataFrame, n: int = 50) -> DataFrame:
    """The first n panels of each page."""
    return panels.withColumn("_n", F.row_number().over(W.partitionBy("page_id").orderBy("seq"))).where(F.col("_n") <= n).drop("_n")


def mark_overlapping(panels: DataFrame) -> DataFrame:
    """By falling area, each unclaimed panel claims later ones that it contains: claimed ones lose 5 % confidence.

    Returns (page_id, seq, parent): parent is the seq of the claiming panel, null for the others.
    """
    kinds = {f.name: f.dataType.simpleString() for f in panels.schema.fields}
    start = f"cast(array() AS array<struct<seq:{kinds['seq']},x:{kinds['x']},y:{kinds['y']},w:{kinds['w']},h:{kinds['h']},parent:{kinds['seq']}>>)"
    inside = f"{intersection_sql('k', 'p')} > 0.7D * (p.w * p.h)"
    claimer = f"filter(kept, k -> k.parent IS NULL AND {inside})"
    step = f"array_append(kept, named_struct('seq', p.seq, 'x', p.x, 'y', p.y, 'w', p.w, 'h', p.h, 'parent', get(transform({claimer}, k -> k.seq), 0)))"
    return _fold(panels, "-(w * h) AS o", step, start).select("page_id", F.inline("kept")).select("page_id", "seq", "parent")


def merge_overlapping(panels: DataFrame) -> DataFrame:
    """Duplicates become their bounding box; contained panels stay, with 10 % less confidence and overlapping set.

    By falling area; a duplicate has iou over 0.5 and a size ratio over 0.7 with a kept panel, and is tested first.
    """
    kinds = {f.name: f.dataType.simpleString() for f in panels.schema.fields}
    entry = f"struct<seq:{kinds['seq']},x:{kinds['x']},y:{kinds['y']},w:{kinds['w']},h:{kinds['h']},conf:double,overlapping:boolean>"
    duplicate = f"({iou_sql('k', 'p')} > 0.5 AND least(k.w * k.h, p.w * p.h) > 0.7D * greatest(k.w * k.h, p.w * p.h))"
    contained = f"{intersection_sql('k', 'p')} > 0.7D * least(k.w * k.h, p.w * p.h)"
    right, bottom = "greatest(k.x + k.w, p.x + p.w)", "greatest(k.y + k.h, p.y + p.h)"
    merged = f"named_struct('seq', k.seq, 'x', least(k.x, p.x), 'y', least(k.y, p.y), 'w', {right} - least(k.x, p.x), 'h', {bottom} - least(k.y, p.y), 'conf', greatest(k.conf, cast(p.conf AS double)), 'overlapping', k.overlapping)"
    first = f"get(transform(filter(kept, m -> {duplicate.replace('k.', 'm.')}), m -> m.seq), 0)"
    # The first duplicate takes the panel in; the others are left as they are.
    step = f"CASE WHEN exists(kept, k -> {duplicate}) THEN transform(kept, k -> CASE WHEN k.seq = {first} THEN {merged} ELSE k END) ELSE array_append(kept, named_struct('seq', p.seq, 'x', p.x, 'y', p.y, 'w', p.w, 'h', p.h, 'conf', CASE WHEN exists(kept, k -> {contained}) THEN p.conf * 0.9D ELSE cast(p.conf AS double) END, 'overlapping', exists(kept, k -> {contained}))) END"
    return _fold(panels, "-(w * h) AS o", step, f"cast(array() AS array<{entry}>)").select("page_id", F.inline("kept"))


def merge_rects(a: str, b: str) -> list[Column]:
    """Bounding box of two rectangles, the larger confidence, and the seq of the larger one."""
    x, y = F.least(F.col(f"{a}x"), F.col(f"{b}x")), F.least(F.col(f"{a}y"), F.col(f"{b}y"))
    right = F.greatest(F.col(f"{a}x") + F.col(f"{a}w"), F.col(f"{b}x") + F.col(f"{b}w"))
    bottom = F.greatest(F.col(f"{a}y") + F.col(f"{a}h"), F.col(f"{b}y") + F.col(f"{b}h"))
    larger = F.when(boxes.area(a) >= boxes.area(b), F.col(f"{a}seq")).otherwise(F.col(f"{b}seq"))
    return [x.alias("x"), y.alias("y"), (right - x).alias("w"), (bottom - y).alias("h"), F.greatest(F.col(f"{a}conf"), F.col(f"{b}conf")).alias("conf"), larger.alias("kind_of")]


def fuse_by_area(cv: DataFrame, ml: DataFrame) -> DataFrame:
    """Fuse two detectors without their images (strips.fuse() looks at those): each first-detector panel with the best second-detector panel of its page.

    iou over 0.5: the smaller of both boxes with the larger confidence; over 0.2: the mean confidence on the first box;
    else the first box at 80 % confidence. Second-detector panels that nobody matched over 0.2 are kept at 70 %.
    Returns (page_id, source, seq, x, y, w, h, conf).
    """
    met = pairs(cv, ml).withColumn("iou", boxes.iou("a.", "b.")).where("iou > 0.2")
    best = met.groupBy("page_id", F.col("a.seq").alias("seq")).agg(F.max(F.struct("iou", (-F.col("b.seq")).alias("early"), "b")).alias("m"))
    joined = cv.join(best, ["page_id", "seq"], "left")
    tight = (F.col("m.iou") > 0.5) & (F.col("m.b.w") * F.col("m.b.h") < F.col("w") * F.col("h"))
    conf = F.when(F.col("m.iou") > 0.5, F.greatest("conf", F.col("m.b.conf")).cast("double")).when(F.col("m.iou") > 0.2, (F.col("conf") + F.col("m.b.conf")) / 2.0).otherwise(F.col("conf") * 0.8)
    fused = joined.select("page_id", F.lit("cv").alias("source"), "seq", *[F.when(tight, F.col(f"m.b.{c}")).otherwise(F.col(c)).alias(c) for c in "xywh"], conf.alias("conf"))
    used = met.select("page_id", F.col("b.seq").alias("seq")).distinct()
    left = ml.join(used, ["page_id", "seq"], "left_anti").select("page_id", F.lit("ml").alias("source"), "seq", "x", "y", "w", "h", (F.col("conf") * 0.7).alias("conf"))
    return fused.union(left)


def fuse_exclusive(cv: DataFrame, ml: DataFrame) -> DataFrame:
    """A second-detector panel serves one first-detector panel only, in order of seq: (page_id, seq, match)."""
    entry = lambda df, name: df.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "w", "h"))).alias(name))
    both = entry(cv, "cs").join(entry(ml, "ms"), "page_id", "left")
    free = f"transform(filter(coalesce(ms, cast(array() AS array<struct<seq:int,x:bigint,y:bigint,w:bigint,h:bigint>>)), m -> NOT exists(done, d -> d.match <=> m.seq) AND {iou_sql('m', 'c')} > 0.2), m -> named_struct('iou', {iou_sql('m', 'c')}, 'early', -m.seq))"
    fold = f"aggregate(cs, cast(array() AS array<struct<seq:int,match:int>>), (done, c) -> array_append(done, named_struct('seq', c.seq, 'match', -(array_max({free}).early))))"
    return both.selectExpr("page_id", f"inline({fold})")


def vote(panels: DataFrame, detectors: int) -> DataFrame:
    """Panels whose place and size, in tens of pixels, at least half of the detectors agree on; the first represents them."""
    key = F.concat_ws("_", *[F.floor(F.col(c) / 10.0 + 0.5).cast("string") for c in "xywh"])
    grouped = panels.groupBy("page_id", key.alias("key")).agg(F.count("*").alias("votes"), F.min(F.struct("detector", "seq")).alias("first"))
    return grouped.where(F.col("votes") >= -(-detectors // 2)).select("page_id", "key", "votes", F.col("first.detector").alias("detector"), F.col("first.seq").alias("seq"))


def leader_clusters(panels: DataFrame, iou: float = 0.5) -> DataFrame:
    """Each panel in order of seq joins the first cluster whose first member overlaps it, or starts one: (page_id, seq, leader)."""
    kinds = {f.name: f.dataType.simpleString() for f in panels.schema.fields}
    start = f"cast(array() AS array<struct<seq:{kinds['seq']},x:{kinds['x']},y:{kinds['y']},w:{kinds['w']},h:{kinds['h']},leader:{kinds['seq']}>>)"
    found = f"get(transform(filter(kept, k -> k.leader = k.seq AND {iou_sql('k', 'p')} > {iou}), k -> k.seq), 0)"
    step = f"array_append(kept, named_struct('seq', p.seq, 'x', p.x, 'y', p.y, 'w', p.w, 'h', p.h, 'leader', coalesce({found}, p.seq)))"
    return _fold(panels, "seq AS o", step, start).select("page_id", F.inline("kept")).select("page_id", "seq", "leader")


def weighted_average(panels: DataFrame) -> DataFrame:
    """One box for each leader cluster: means weighted by confidence, and the largest confidence."""
    clustered = panels.join(leader_clusters(panels), ["page_id", "seq"])
    mean = lambda c: F.floor(F.sum(F.col(c) * F.col("conf")) / F.sum("conf") + 0.5).alias(c)
    return clustered.groupBy("page_id", F.col("leader").alias("seq")).agg(*[mean(c) for c in "xywh"], F.max("conf").alias("conf"), F.count("*").alias("members"))


def augment(panels: DataFrame, width: int, height: int) -> DataFrame:
    """Panels as a detector sees them on flipped and scaled images: (page_id, seq, view, x, y, w, h)."""
    x, y, w, h = (F.col(c).cast("double") for c in "xywh")
    seen = {"flip_h": (width - x - w, y, w, h), "flip_v": (x, height - y - h, w, h)} | {f"scale_{s}": (x * s, y * s, w * s, h * s) for s in (0.9, 1.1)}
    views = F.array(*[F.struct(F.lit(v).alias("view"), *[c.alias(n) for c, n in zip(box, "xywh", strict=True)]) for v, box in seen.items()])
    return panels.select("page_id", "seq", F.inline(views))


def restore(views: DataFrame, width: int, height: int) -> DataFrame:
    """Undo augment: what was found on a view, in the image's own coordinates, rounded."""
    scale = F.when(F.col("view") == "scale_0.9", 0.9).when(F.col("view") == "scale_1.1", 1.1).otherwise(1.0)
    x = F.when(F.col("view") == "flip_h", width - F.col("x") - F.col("w")).otherwise(F.col("x") / scale)
    y = F.when(F.col("view") == "flip_v", height - F.col("y") - F.col("h")).otherwise(F.col("y") / scale)
    whole = lambda c: F.floor(c + 0.5).cast("long")
    return views.select("page_id", "seq", "view", whole(x).alias("x"), whole(y).alias("y"), whole(F.col("w") / scale).alias("w"), whole(F.col("h") / scale).alias("h"))


def at_scales(panels: DataFrame, scales: tuple[float, ...] = (0.5, 1.0, 1.5)) -> DataFrame:
    """Panels at several scales and back, as one table with the scale: what detection at many scales sees."""
    each = F.explode(F.array(*[F.lit(s) for s in scales])).alias("scale")
    seen = panels.select("page_id", "seq", "x", "y", "w", "h", each)
    there = lambda c: F.floor(F.floor(F.col(c) * F.col("scale") + 0.5) / F.col("scale") + 0.5).cast("long").alias(c)
    return seen.select("page_id", "seq", "scale", *[there(c) for c in "xywh"])


def reading_order(panels: DataFrame, vertical: bool = False) -> DataFrame:
    """Rows from top to bottom, panels of a row from left to right: (page_id, seq, band, position).

    Sorted by y, a panel opens a new band where it no longer lies level with the band's first panel: further down than
    30 % of that one's height (vertical pages) or half the smaller height.
    """
    kinds = {f.name: f.dataType.simpleString() for f in panels.schema.fields}
    apart = "p.y - last.y > 0.3D * last.h" if vertical else "p.y - last.y >= 0.5D * least(p.h, last.h)"
    fields = f"seq:{kinds['seq']},x:{kinds['x']},y:{kinds['y']},h:{kinds['h']},first:{kinds['y']},tall:{kinds['h']},band:int"
    last = "get(transform(slice(kept, -1, 1), l -> named_struct('y', l.first, 'h', l.tall, 'band', l.band)), 0)"
    new = f"transform(array({last}), last -> last IS NULL OR {apart})[0]"
    entry = f"transform(array({last}), last -> transform(array({new}), fresh -> named_struct('seq', p.seq, 'x', p.x, 'y', p.y, 'h', p.h, 'first', CASE WHEN fresh THEN p.y ELSE last.y END, 'tall', CASE WHEN fresh THEN p.h ELSE last.h END, 'band', CASE WHEN fresh THEN coalesce(last.band, -1) + 1 ELSE last.band END))[0])[0]"
    step = f"CASE WHEN size(kept) = 0 THEN array(named_struct('seq', p.seq, 'x', p.x, 'y', p.y, 'h', p.h, 'first', p.y, 'tall', p.h, 'band', 0)) ELSE array_append(kept, {entry}) END"
    folded = _fold(panels, "y AS o1, x AS o2", step, f"cast(array() AS array<struct<{fields}>>)").select("page_id", F.inline("kept"))
    place = F.row_number().over(W.partitionBy("page_id").orderBy("band", "x", "y", "seq"))
    return folded.select("page_id", "seq", "band", place.alias("position"))


def union_candidates(detectors: dict[str, DataFrame]) -> DataFrame:
    """The panels of several detectors as one table, told apart by the column detector."""
    out = None
    for name, df in detectors.items():
        rows = df.withColumn("detector", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def reading_order_smart(panels: DataFrame, layouts: DataFrame) -> DataFrame:
    """(page_id, seq, position): pages with a vertical or grid layout in reading order, all others by falling importance.

    panels: with importance; layouts: (page_id, layout).
    """
    known = panels.join(layouts, "page_id")
    rows = [reading_order(known.where(F.col("layout") == k).drop("layout", "importance"), k == "vertical").select("page_id", "seq", "position") for k in ("vertical", "grid")]
    rank = F.row_number().over(W.partitionBy("page_id").orderBy(F.desc("importance"), "seq"))
    rest = known.where(~F.col("layout").isin("vertical", "grid")).select("page_id", "seq", rank.alias("position"))
    return rows[0].union(rows[1]).union(rest)


def first_with_panels(first: DataFrame, second: DataFrame) -> DataFrame:
    """The first detector's panels, and the second's on pages for which the first has none; told apart by detector."""
    missing = second.join(first.select("page_id").distinct(), "page_id", "left_anti")
    return union_candidates({"first": first, "second": missing})


def ensemble(detectors: dict[str, DataFrame], method: str = "vote") -> DataFrame:
    """Panels that several detectors agree on: none give none, one its own, more by vote or as weighted averages."""
    if not detectors:
        raise ValueError("no detectors")
    every = union_candidates(detectors)
    if len(detectors) == 1:
        return every
    if method == "vote":
        return every.join(vote(every, len(detectors)).select("page_id", "detector", "seq"), ["page_id", "detector", "seq"])
    numbered = every.withColumn("seq", F.row_number().over(W.partitionBy("page_id").orderBy("detector", "seq")))
    return weighted_average(numbered).withColumn("detector", F.lit("average"))


def _shown(box: list[np.ndarray], width: int, height: int) -> list[np.ndarray]:
    """x, y, w and h of panels as restore(augment()) and at_scales() give them: a row for each panel, a column for each view."""
    x, y, w, h = (c.astype(float) for c in box)
    whole = lambda c: np.floor(c + 0.5)
    views = [(width - (width - x - w) - w, y, w, h), (x, height - (height - y - h) - h, w, h), *[tuple(c * s / s for c in (x, y, w, h)) for s in (0.9, 1.1)]]
    views += [tuple(whole(c * s) / s for c in (x, y, w, h)) for s in (0.5, 1.0, 1.5)]
    return [whole(np.column_stack(c)) for c in zip(*views, strict=True)]


def _shares(a: tuple, b: tuple) -> np.ndarray:
    """Overlap of boxes as iou, 0 up to a half. What is not known is passed over, as greatest() and least() do."""
    (ax, ay, aw, ah), (bx, by, bw, bh) = a, b
    common = np.fmax(0, np.fmin(ax + aw, bx + bw) - np.fmax(ax, bx)) * np.fmax(0, np.fmin(ay + ah, by + bh) - np.fmax(ay, by))
    union = aw * ah + bw * bh - common
    found = np.divide(common, union, out=np.zeros(union.shape), where=union != 0)
    return np.where(found > 0.5, found, 0.0)


def _decays(page: np.ndarray, conf: np.ndarray, views: list[np.ndarray]) -> np.ndarray:
    """What soft_nms() sums up for each view of panels in order of page and seq: overlaps with the views that come before.

    Views of one panel follow each other. Those of two are looked at where the boxes around their views overlap enough for any of them.
    """
    decay = np.zeros(views[0].shape)
    column = lambda k: tuple(c[:, k] for c in views)
    for k in range(1, decay.shape[1]):
        for j in range(k):
            decay[:, k] += np.where(conf == conf, _shares(column(j), column(k)), 0.0)
    x, y, w, h = views
    left, top, right, bottom = x.min(1), y.min(1), (x + w).max(1), (y + h).max(1)
    least = (w * h).min(1)
    i, step = np.arange(len(page)), 0
    while len(i):
        step += 1
        i = i[i + step < len(page)]
        i = i[page[i] == page[i + step]]
        j = i + step
        across, down = (np.fmin(hi[i], hi[j]) - np.fmax(lo[i], lo[j]) for lo, hi in ((left, right), (top, bottom)))
        near = (across > 0) & (down > 0) & (across * down >= 0.5 * np.maximum(least[i], least[j])) & ((conf[i] >= conf[j]) | (conf[i] < conf[j]))
        first = np.where(conf[i] >= conf[j], i, j)[near]
        later = (i + j)[near] - first
        for k in range(0, len(first), 10_000):
            a, b = first[k : k + 10_000], later[k : k + 10_000]
            np.add.at(decay, b, _shares(tuple(c[a][:, :, None] for c in views), tuple(c[b][:, None] for c in views)).sum(1))
    return decay


def advanced(panels: DataFrame, width: int, height: int, sigma: float = 0.5, least: float = 0.3) -> DataFrame:
    """Panels as found on flipped, scaled and rescaled images, restored, as one table after soft suppression; seq numbers them.

    The same as soft_nms() of restore(augment()) and at_scales() numbered by seq and view. A page's panels are one row, and its views are
    made where they are compared: a table of all views would be dealt out and joined with itself by page.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            rows = pa.RecordBatch.from_struct_array(lists.flatten())
            page = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
            number = lambda c, rows=rows: rows.column(c).to_numpy(zero_copy_only=False).astype(float)
            order = np.lexsort((rows.column("seq").to_numpy(zero_copy_only=False), page))
            page = page[order]
            views = _shown([number(c)[order] for c in "xywh"], width, height)
            decay = _decays(page, number("conf")[order], views)
            n = decay.shape[1]
            seq = (np.arange(len(page)) - np.searchsorted(page, page))[:, None] * n + np.arange(1, n + 1)
            whole = [pa.array(c.ravel(), from_pandas=True).cast(pa.int64()) for c in views]
            conf = rows.column("conf").take(pa.array(np.repeat(order, n)))
            yield pa.record_batch([batch.column(0).take(pa.array(np.repeat(page, n))), pa.array(seq.ravel().astype(np.int32)), *whole, conf, pa.array(decay.ravel())], names=["page_id", "seq", *"xywh", "conf", "decay"])

    kinds = {f.name: f.dataType.simpleString() for f in panels.schema.fields}
    of_page = panels.where("page_id IS NOT NULL AND seq IS NOT NULL").groupBy("page_id").agg(F.collect_list(F.struct("seq", *"xywh", "conf")).alias("ps"))
    every = of_page.mapInArrow(run, f"page_id {kinds['page_id']}, seq int, x long, y long, w long, h long, conf {kinds['conf']}, decay double")
    scored = every.withColumn("score", F.col("conf") / 100.0 * F.exp(-F.col("decay") / sigma))
    return scored.where(F.col("score") > least).drop("decay")
