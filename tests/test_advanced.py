"""Panels on all views of a page against the table of views that is joined with itself."""

import random

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from inkgrid.operators import panels


def over_tables(p, width, height):
    conf = p.select("page_id", "seq", "conf")
    views = panels.restore(panels.augment(p, width, height), width, height).select("page_id", "seq", F.concat(F.lit("1 "), "view").alias("from"), *"xywh")
    scaled = panels.at_scales(p).select("page_id", "seq", F.concat(F.lit("2 "), F.col("scale").cast("string")).alias("from"), *"xywh")
    every = views.union(scaled).join(conf, ["page_id", "seq"])
    return panels.soft_nms(every.withColumn("seq", F.row_number().over(W.partitionBy("page_id").orderBy("seq", "from"))).drop("from"))


def test_views_of_a_page_suppress_each_other_as_over_tables(spark):
    draw = random.Random(3)
    rows = [(page, 3 * k - 2, draw.randint(0, 90), draw.randint(0, 90), draw.randint(0, 60), draw.randint(1, 60), draw.choice([55, 70, 70, 90])) for page in range(12) for k in range(page)]
    rows += [(50, k, 10 + k % 2, 20, 40, 30, 80 + k % 3) for k in range(30)]
    rows += [(60, 1, None, 5, 9, 9, 80), (60, 2, 4, 5, 9, 9, None), (60, 3, 4, 5, 9, 9, 70), (None, 1, 4, 5, 9, 9, 70), (61, None, 4, 5, 9, 9, 70), (62, 1, 4, 5, 0, 9, 70), (62, 2, 4, 5, -3, 9, 70)]
    p = spark.createDataFrame(rows, "page_id long, seq int, x long, y long, w long, h long, conf long").repartition(3)
    found, expected = panels.advanced(p, 120, 150), over_tables(p, 120, 150)
    assert found.dtypes == expected.dtypes
    told = lambda df: sorted(map(repr, df.withColumn("score", F.round("score", 9)).collect()))
    assert told(found) == told(expected) and found.count() > 90


def test_views_are_not_dealt_out(spark):
    p = spark.range(40).selectExpr("id % 7 AS page_id", "cast(id AS int) AS seq", "id AS x", "id AS y", "id + 9 AS w", "id + 9 AS h", "50 + id AS conf")
    plan = panels.advanced(p, 120, 150)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
