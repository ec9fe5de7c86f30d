"""Derived inputs: rasters and panels worked out from the given tables (see FIXTURES.md), whole tables and texts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
PAGE_W, PAGE_H = 1200, 1800


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def panels_cv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, seq, x, y, w, h, conf, t) of a first detector, one page for each order."""
    lines = table(spark, sf_dir, "lineitem").withColumn("seq", F.row_number().over(W.partitionBy("l_orderkey").orderBy(*ORDER)))
    return lines.selectExpr(
        "l_orderkey AS page_id", "seq", "(l_partkey * 37) % 500 AS x", "(l_suppkey * 53 + l_linenumber * 97) % 900 AS y", "80 + (l_partkey * 13) % 600 AS w",
        "100 + (cast(l_quantity AS bigint) * 29) % 700 AS h", "cast(50 + round(l_discount * 400) AS bigint) AS conf", "cast(round(l_tax * 100) AS bigint) AS t",
    )


def panels_ml(cv: DataFrame) -> DataFrame:
    """A second detector's panels, shifted and shrunk from the first's."""
    return cv.where("(page_id + seq) % 5 <> 0").selectExpr("page_id", "seq", "x + t * 6 AS x", "y + t * 5 AS y", "greatest(50, w - t * 12) AS w", "greatest(50, h - t * 3) AS h", "40 + t * 6 AS conf")


def anchors(ml: DataFrame) -> DataFrame:
    """Raw detector rows in the 640-pixel letterbox: (page_id, i, cx, cy, w, h, score)."""
    s = f"least(640.0D / {PAGE_W}, 640.0D / {PAGE_H})"
    return ml.selectExpr("page_id", "seq AS i", f"(x + w / 2.0D) * {s} AS cx", f"(y + h / 2.0D) * {s} AS cy", f"w * {s} AS w", f"h * {s} AS h", "conf / 100.0D AS score")


def raster8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, width, height, g array<double>): an 8 x 8 image for each embedding."""
    g = F.transform(F.slice("embedding", 1, 64), lambda e: F.greatest(F.lit(0.0), F.least(F.lit(255.0), F.floor(128 + e.cast("double") * 400).cast("double"))))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page_id"), F.lit(8).alias("width"), F.lit(8).alias("height"), g.alias("g"))


def boxes8(rasters: DataFrame) -> DataFrame:
    """Two panels on each 8 x 8 image: (page_id, seq, x, y, w, h)."""
    two = "array(named_struct('seq', 0, 'x', page_id % 3, 'y', page_id % 4, 'w', 4 + page_id % 2, 'h', 3 + page_id % 2), named_struct('seq', 1, 'x', 1 + page_id % 2, 'y', 0L, 'w', 6L, 'h', 5 + page_id % 3))"
    return rasters.selectExpr("page_id", f"inline({two})")


def scene64(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, width, height, g): a page of textured panels with white gutters for each embedding, 64 x 64. Of three pages, two
    have four panels and one has two, one above the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[0:64, 0:64]
        # Some pages at a time: what a batch of thousands makes on the way is several times its pixels.
        for part in (batch.slice(k, 256) for batch in batches for k in range(0, batch.num_rows, 256)):
            page = part.column(0).to_numpy()[:, None, None]
            small = part.column(1).flatten().to_numpy().reshape(-1, 8, 8)
            grown = np.repeat(np.repeat(small, 8, axis=1), 8, axis=2)
            gutter = np.where(page % 3 == 1, y % 32 < 12, (x % 32 < 8) | (y % 32 < 8))
            g = np.where(gutter, 255.0, np.minimum(255.0, np.floor(grown * 0.7) + (x * 7 + y * 13 + page) % 40))
            n = len(g)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * 4096, pa.int32()), pa.array(g.ravel()))
            yield pa.record_batch([part.column(0), pa.array(np.full(n, 64), pa.int32()), pa.array(np.full(n, 64), pa.int32()), lists], names=["page_id", "width", "height", "g"])

    return raster8(spark, sf_dir).select(F.col("page_id").cast("long").alias("page_id"), "g").mapInArrow(run, "page_id long, width int, height int, g array<double>")


def boxes64(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What two detectors find on pages of 64 x 64: (page_id, seq, x, y, w, h, conf) each."""
    three = [("page_id % 5", "page_id % 7", "26 + page_id % 6", "24 + page_id % 9"), ("30 + page_id % 6", "2 + page_id % 3", "28 - page_id % 5", "30"), ("page_id % 3", "33 + page_id % 4", "60 - page_id % 7", "26")]
    rows = ", ".join(f"named_struct('seq', {k}, 'x', {x}, 'y', {y}, 'w', {w}, 'h', {h}, 'conf', 60 + (page_id * 7 + {k} * 11) % 35)" for k, (x, y, w, h) in enumerate(three))
    cv = pages.selectExpr("cast(page_id AS bigint) AS page_id").selectExpr("page_id", f"inline(array({rows}))").selectExpr("page_id", "cast(seq AS int) AS seq", *[f"cast({c} AS bigint) AS {c}" for c in ("x", "y", "w", "h", "conf")])
    ml = cv.where("(page_id + seq) % 4 <> 0").selectExpr("page_id", "seq", "x + page_id % 3 AS x", "y + page_id % 2 AS y", "w - (page_id * 3 + seq * 5) % 15 AS w", "h - (page_id * 5 + seq * 7) % 14 AS h", "40 + (page_id + seq) % 50 AS conf")
    more = cv.where("seq = 0 AND page_id % 3 = 0").selectExpr("page_id", "cast(9 AS int) AS seq", "22 + page_id % 9 AS x", "20L AS y", "30L AS w", "22 + page_id % 8 AS h", "70L AS conf")
    return cv, ml.union(more)


def docraster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, x, y, r, g, b): whole texts as images 64 wide; channels are the code points at i, i + 1 and i + 2."""
    docs = table(spark, sf_dir, "documents").where("length(text) > 0").select(F.col("doc_id").alias("page_id"), F.split("text", "").alias("c"))
    docs = docs.select("page_id", F.expr("transform(c, s -> ascii(s))").alias("v"))
    # The three channels are zipped before they are taken apart, so that no pixel carries the whole array along.
    later = lambda k: f"concat(slice(v, {k + 1}, greatest(0, size(v) - {k})), array_repeat(255, least({k}, size(v))))"
    px = docs.select("page_id", F.posexplode(F.arrays_zip(F.col("v").alias("r"), F.expr(later(1)).alias("g"), F.expr(later(2)).alias("b"))).alias("i", "c"))
    return px.select("page_id", F.expr("i % 64").alias("x"), F.expr("i div 64").alias("y"), "c.r", "c.g", "c.b")


def pixels(rasters: DataFrame) -> DataFrame:
    """(page_id, x, y, g) of rasters that hold an array each."""
    return rasters.select("page_id", "width", F.posexplode("g").alias("i", "g")).selectExpr("page_id", "i % width AS x", "i div width AS y", "g")


#: The same inputs as DuckDB common table expressions.
SQL = {
    "panels_cv": f"""SELECT l_orderkey AS page_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(ORDER)}) AS seq, (l_partkey * 37) % 500 AS x,
        (l_suppkey * 53 + l_linenumber * 97) % 900 AS y, 80 + (l_partkey * 13) % 600 AS w, 100 + (cast(l_quantity AS bigint) * 29) % 700 AS h,
        cast(50 + round(l_discount * 400) AS bigint) AS conf, cast(round(l_tax * 100) AS bigint) AS t FROM lineitem""",
    "panels_ml": "SELECT page_id, seq, x + t * 6 AS x, y + t * 5 AS y, greatest(50, w - t * 12) AS w, greatest(50, h - t * 3) AS h, 40 + t * 6 AS conf FROM panels_cv WHERE (page_id + seq) % 5 <> 0",
    "anchors": f"""SELECT page_id, seq AS i, (x + w / 2.0::DOUBLE) * s AS cx, (y + h / 2.0::DOUBLE) * s AS cy, w * s AS w, h * s AS h, conf / 100.0::DOUBLE AS score
        FROM panels_ml, (SELECT least(640.0::DOUBLE / {PAGE_W}, 640.0::DOUBLE / {PAGE_H}) AS s)""",
    "px8": """SELECT vec_id AS page_id, (i - 1) % 8 AS x, (i - 1) // 8 AS y, greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor(128 + cast(embedding[i] AS DOUBLE) * 400))) AS g
        FROM embeddings, (SELECT unnest(range(1, 65)) AS i)""",
    "px64": """SELECT page_id, x, y, CASE WHEN CASE WHEN page_id % 3 = 1 THEN y % 32 < 12 ELSE x % 32 < 8 OR y % 32 < 8 END THEN 255.0::DOUBLE ELSE least(255.0::DOUBLE, floor(g8 * 0.7::DOUBLE) + (x * 7 + y * 13 + page_id) % 40) END AS g
        FROM (SELECT vec_id AS page_id, i % 64 AS x, i // 64 AS y, greatest(0.0::DOUBLE, least(255.0::DOUBLE, floor(128 + cast(embedding[i // 512 * 8 + i % 64 // 8 + 1] AS DOUBLE) * 400))) AS g8 FROM embeddings, (SELECT unnest(range(0, 4096)) AS i))""",
    "cv64": """SELECT page_id, seq, x, y, w, h, 60 + (page_id * 7 + seq * 11) % 35 AS conf FROM (SELECT vec_id AS page_id, 0 AS seq, vec_id % 5 AS x, vec_id % 7 AS y, 26 + vec_id % 6 AS w, 24 + vec_id % 9 AS h FROM embeddings
        UNION ALL SELECT vec_id, 1, 30 + vec_id % 6, 2 + vec_id % 3, 28 - vec_id % 5, 30 FROM embeddings UNION ALL SELECT vec_id, 2, vec_id % 3, 33 + vec_id % 4, 60 - vec_id % 7, 26 FROM embeddings)""",
    "ml64": """SELECT page_id, seq, x + page_id % 3 AS x, y + page_id % 2 AS y, w - (page_id * 3 + seq * 5) % 15 AS w, h - (page_id * 5 + seq * 7) % 14 AS h, 40 + (page_id + seq) % 50 AS conf FROM cv64 WHERE (page_id + seq) % 4 <> 0
        UNION ALL SELECT page_id, 9, 22 + page_id % 9, 20, 30, 22 + page_id % 8, 70 FROM cv64 WHERE seq = 0 AND page_id % 3 = 0""",
    "boxes8": """SELECT vec_id AS page_id, 0 AS seq, vec_id % 3 AS x, vec_id % 4 AS y, 4 + vec_id % 2 AS w, 3 + vec_id % 2 AS h FROM embeddings
        UNION ALL SELECT vec_id, 1, 1 + vec_id % 2, 0, 6, 5 + vec_id % 3 FROM embeddings""",
    "docpx": """SELECT page_id, i % 64 AS x, i // 64 AS y, unicode(v[i + 1]) AS r, coalesce(unicode(v[i + 2]), 255) AS g, coalesce(unicode(v[i + 3]), 255) AS b
        FROM (SELECT page_id, v, unnest(range(0, len(v))) AS i FROM (SELECT doc_id AS page_id, regexp_split_to_array(text, '') AS v FROM documents WHERE length(text) > 0))""",
}
#: What each builds on.
NEEDS = {"panels_ml": ["panels_cv"], "anchors": ["panels_cv", "panels_ml"], "ml64": ["cv64"]}


def with_fixtures(sql: str, *names: str, recursive: bool = False) -> str:
    """DuckDB SQL with the named inputs in front; sql starts with SELECT, or with a comma and more expressions."""
    wanted: list[str] = []
    for n in names:
        wanted += [x for x in [*NEEDS.get(n, []), n] if x not in wanted]
    parts = ", ".join(f"{n} AS ({SQL[n]})" for n in wanted)
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{'' if sql.lstrip().startswith(',') else ' '}{sql}"
