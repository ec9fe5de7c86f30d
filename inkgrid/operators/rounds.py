"""What operators that work in rounds share: cutting lineage, and running sums over all rows of a table."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


@cache
def _own(_application: str) -> str:
    """One local folder for each session that may do without a shared one."""
    return tempfile.mkdtemp(prefix="spark-rounds-")


def _folder(spark: SparkSession) -> str:
    """A new folder below the one in spark.checkpoint.dir. Only a local session may do without that setting."""
    context = spark.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if not shared and (not context.master.startswith("local") or context.master.startswith("local-cluster")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{shared or _own(context.applicationId)}/rounds-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Write the rows as a table to the shared folder and go on from there, so that a lost executor costs no earlier round. (What a
    checkpoint() keeps of the plan's constraints doubles with every round that joins it with itself; a table has none.)"""
    folder = _folder(df.sparkSession)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def running(rows: DataFrame, order: list[Column], sums: dict[str, str], largest: bool = False) -> DataFrame:
    """rows with running sums (or largest values so far) of columns over all rows in that order: {new column: column}. Equal rows
    count in any order.

    The sort is range-partitioned; each partition goes on from the total before it, a row for each partition.
    """
    of, join = (F.max, F.greatest) if largest else (F.sum, lambda a, b: a + b)
    placed = cut(rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftrightunsigned("_at", 33))
    totals = placed.groupBy("_part").agg(*[of(c).alias(f"_{n}") for n, c in sums.items()])
    before, so_far = [], [None] * len(sums)
    for row in totals.orderBy("_part").collect():
        before.append((row["_part"], *so_far))
        so_far = [x if a is None or x is None else max(a, x) if largest else a + x for a, x in zip(so_far, row[1:], strict=True)]
    found = placed.join(F.broadcast(rows.sparkSession.createDataFrame(before, totals.schema)), "_part")
    here = W.partitionBy("_part").orderBy("_at")
    for n, c in sums.items():
        own = of(c).over(here)
        found = found.withColumn(n, F.when(F.col(f"_{n}").isNull(), own).otherwise(join(own, F.col(f"_{n}"))))
    return found.drop("_at", "_part", *[f"_{n}" for n in sums])
