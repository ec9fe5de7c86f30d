"""Image files in, results out: listing, decoding, downscaling, JSON, labels and panel crops."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgrid.operators.rounds import running

#: Image file suffixes.
SUFFIXES = ("jpg", "jpeg", "png", "webp", "bmp")
LARGEST_SIDE = 2000


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, modificationTime) of the image files of a folder, not of those below it; names in any case."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder)
    return files.select("path", "length", "modificationTime").where(F.lower("path").rlike(r"\.(" + "|".join(SUFFIXES) + ")$"))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, width, height, channels, data, error); error is set, and data null, where a file can't be decoded.

    data holds interleaved bytes in the order blue, green, red as Spark's image source gives them.
    """
    image = spark.read.format("image").option("dropInvalid", "false").load(folder).select("image.*")
    bad = F.col("height") < 0
    return image.select(F.col("origin").alias("path"), "width", "height", F.col("nChannels").alias("channels"), F.when(~bad, F.col("data")).alias("data"), F.when(bad, "Invalid image").alias("error"))


def to_gray(images: DataFrame) -> DataFrame:
    """Rasters (page_id, width, height, g) of decoded images; page_id is a hash of the path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            out = []
            for data, channels in zip(batch.column("data"), batch.column("channels").to_pylist(), strict=True):
                px = np.frombuffer(data.as_py(), dtype=np.uint8).reshape(-1, channels).astype(float)
                out.append((px[:, 0] if channels == 1 else px[:, :3] @ [0.114, 0.587, 0.299]).tolist())
            yield pa.record_batch([*(batch.column(c) for c in ("page_id", "width", "height")), pa.array(out, pa.list_(pa.float64()))], names=["page_id", "width", "height", "g"])

    good = images.where("error IS NULL").select(F.xxhash64("path").alias("page_id"), "width", "height", "data", "channels")
    return good.mapInArrow(run, "page_id long, width int, height int, g array<double>")


def downscale(pixels: DataFrame, pages: DataFrame, largest: int = LARGEST_SIDE) -> DataFrame:
    """Means over the source pixels of each target pixel, for pages whose larger side exceeds largest. pages: (page_id, width, height)."""
    side = F.greatest("width", "height")
    scale = F.when(side > largest, F.lit(float(largest)) / side).otherwise(1.0)
    sized = pixels.join(pages.select("page_id", scale.alias("scale")), "page_id")
    small = lambda c: F.floor(F.col(c) * F.col("scale")).alias(c)
    return sized.groupBy("page_id", small("x"), small("y")).agg((F.sum("g") / F.count("*")).alias("g"))


def letterbox(pixels: DataFrame, pages: DataFrame, side: int = 640) -> DataFrame:
    """(page_id, x, y, v): the nearest-pixel fit of each page into a square, top left, values from 0 to 1. Target (x, y) reads
    floor(x / scale); what the page doesn't reach has no row, and is 0. pages: (page_id, width, height)."""
    scale = F.least(F.lit(float(side)) / F.col("width"), F.lit(float(side)) / F.col("height"))
    sized = pixels.join(pages.select("page_id", scale.alias("scale")), "page_id")
    # The targets of a source pixel: those whose quotient lies in it.
    reach = lambda c: F.expr(f"filter(sequence(cast(floor({c} * scale) AS int), cast(least({side} - 1, ceil(({c} + 1) * scale)) AS int)), t -> floor(t / scale) = {c})")
    across = sized.select("page_id", "scale", "y", "g", F.explode(reach("x")).alias("tx"))
    return across.select("page_id", "g", "tx", F.explode(reach("y")).alias("ty")).select("page_id", F.col("tx").alias("x"), F.col("ty").alias("y"), (F.col("g") / 255.0).alias("v"))


def png(image) -> bytes:
    """A gray image of bytes, rows first, as a PNG file."""
    import struct
    import zlib

    h, w = image.shape
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    rows = b"".join(b"\0" + r.tobytes() for r in image)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows, 6)) + chunk(b"IEND", b"")


def export_panels(rasters: DataFrame, boxes: DataFrame) -> DataFrame:
    """(page_id, seq, name, png): each panel cut from its page as the bytes of a gray PNG file; a panel off the page gives none."""
    from inkgrid.operators.batches import _images

    listed = boxes.groupBy("page_id").agg(F.sort_array(F.collect_list(F.struct("seq", "x", "y", "w", "h"))).alias("boxes"))
    rows = rasters.where("g IS NOT NULL").join(listed, "page_id").select("page_id", "width", "height", "g", "boxes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        for batch in batches:
            values, offsets = _images(batch.column(3))
            for i, (w, h, found) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(4).to_pylist(), strict=True)):
                image = np.clip(np.floor(values[offsets[i] : offsets[i + 1]].astype(float) + 0.5), 0, 255).astype(np.uint8).reshape(h, w)
                cuts = [(b["seq"], image[max(0, b["y"]) : max(0, b["y"] + b["h"]), max(0, b["x"]) : max(0, b["x"] + b["w"])]) for b in found]
                cuts = [(k, c) for k, c in cuts if c.size]
                page = batch.column(0).take(pa.array([i] * len(cuts), pa.int64()))
                yield pa.record_batch([page, pa.array([k for k, _ in cuts], pa.int32()), pa.array([png(c) for _, c in cuts], pa.binary())], names=["page_id", "seq", "png"])

    kind = rasters.schema["page_id"].dataType.simpleString()
    cut = rows.mapInArrow(run, f"page_id {kind}, seq int, png binary")
    return cut.select("page_id", "seq", F.format_string("%s_panel_%03d.png", F.col("page_id").cast("string"), F.col("seq") + 1).alias("name"), "png")


def dataset_yaml(folder: str, names: tuple[str, ...] = ("panel",)) -> str:
    """The description of a training set: where its parts are, and the classes."""
    return f"path: {folder}\ntrain: images/train\nval: images/val\nnc: {len(names)}\nnames: [{', '.join(names)}]\n"


def split_every(pages: DataFrame, every: int = 5, bucket: int = 1024) -> DataFrame:
    """(page_id, split): every so many pages in order of their integer ids are val, from the first on.

    Pages are numbered within buckets of ids; the buckets' sizes are summed up in order over range partitions, so that no task
    holds them all.
    """
    ids = pages.select("page_id").distinct().withColumn("bucket", F.floor(F.col("page_id") / bucket))
    sizes = ids.groupBy("bucket").agg(F.count("*").alias("n"))
    before = running(sizes, [F.col("bucket")], {"upto": "n"}).select("bucket", (F.col("upto") - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("bucket").orderBy("page_id")) - 1
    return ids.withColumn("i", place).join(before, "bucket").select("page_id", F.when((F.col("i") + F.col("before")) % every == 0, "val").otherwise("train").alias("split"))


def envelope(panels: DataFrame) -> DataFrame:
    """One JSON line for each page: {"page_id", "count", "panels": [...]} in order of seq."""
    entry = F.struct(*[c for c in panels.columns if c != "page_id"])
    listed = panels.groupBy("page_id").agg(F.sort_array(F.collect_list(entry)).alias("panels"))
    return listed.select("page_id", F.to_json(F.struct("page_id", F.size("panels").alias("count"), "panels")).alias("json"))


def summary(panels: DataFrame, pages: DataFrame) -> DataFrame:
    """Totals: pages, pages with panels, panels, mean panels of a page."""
    counted = pages.select("page_id").distinct().join(panels.groupBy("page_id").agg(F.count("*").alias("n")), "page_id", "left")
    return counted.agg(F.count("*").alias("pages"), F.count("n").alias("pages_ok"), F.coalesce(F.sum("n"), F.lit(0)).alias("panels"), (F.coalesce(F.sum("n"), F.lit(0)) / F.count("*")).alias("mean_panels"))


def write_labels(labels: DataFrame, folder: str) -> None:
    """Text files of label lines (page_id, split, line), a folder for each split and page bucket."""
    labels.select(F.concat_ws("\t", "page_id", "line").alias("value"), "split").write.partitionBy("split").text(folder)


def split_pages(pages: DataFrame, every: int = 5, of: int = 1) -> DataFrame:
    """(page_id, split): val for pages whose hash falls into the first of every parts, else train; no global sort."""
    part = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(every))
    return pages.select("page_id").distinct().select("page_id", F.when(part < of, "val").otherwise("train").alias("split"))


def crops(pixels: DataFrame, boxes: DataFrame) -> DataFrame:
    """Pixels of each panel in its own coordinates: (page_id, seq, x, y, g)."""
    from inkgrid.operators.aggregates import in_boxes

    return in_boxes(pixels, boxes).selectExpr("page_id", "seq", "px - x AS x", "py - y AS y", "g")


def write_crops(crop: DataFrame, folder: str) -> None:
    """Portable graymap files, <page>_panel_<seq>.pgm, written by the tasks that hold a panel's pixels."""
    names = F.format_string("%s_panel_%03d.pgm", F.col("page_id").cast("string"), F.col("seq") + 1)
    rows = crop.groupBy("page_id", "seq").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"), F.sort_array(F.collect_list(F.struct("y", "x", F.floor(F.col("g") + 0.5).cast("int").alias("g")))).alias("px"))
    text = F.concat_ws("\n", F.lit("P2"), F.concat_ws(" ", "w", "h"), F.lit("255"), F.array_join(F.expr("transform(px, p -> cast(p.g AS string))"), " "))
    rows.select(text.alias("value"), names.alias("name")).write.partitionBy("name").text(folder)
