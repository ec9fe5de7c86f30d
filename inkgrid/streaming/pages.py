"""Panels as they arrive: a file stream of JSON lines to totals by page, with late and repeated rows dealt with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

PANEL = "page_id long, seq int, x long, y long, w long, h long, conf double, found_at timestamp"


def read_panels(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PANEL).option("maxFilesPerTrigger", files_per_batch).json(folder)


def totals(panels: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Per window and page: panels and their mean confidence; a panel that comes twice within the watermark counts once."""
    fresh = panels.withWatermark("found_at", late).dropDuplicatesWithinWatermark(["page_id", "seq"])
    return fresh.groupBy(F.window("found_at", window), "page_id").agg(F.count("*").alias("panels"), F.avg("conf").alias("conf"))


def write_totals(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Append finished windows as Parquet; runs over what is there and stops."""
    flat = df.select(F.col("window.start").alias("from"), F.col("window.end").alias("to"), "page_id", "panels", "conf")
    return flat.writeStream.format("parquet").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
