"""Panel files written and read as a data source: round trips, failed tasks, other writes' files."""

import pytest
from pyspark.sql import functions as F

from inkgrid.sources import fixtures, images, panel_files


def rows(df):
    return sorted((r["name"], bytes(r["png"])) for r in df.collect())


def test_round_trip_of_exported_panels(spark, data, tmp_path):
    panel_files.register(spark)
    scenes = fixtures.scene64(spark, data).where("page_id < 40")
    made = images.export_panels(scenes, fixtures.boxes64(scenes)[0]).select("name", "png")
    folder = str(tmp_path / "panels")
    made.repartition(3).write.format("panel_files").mode("append").save(folder)
    back = spark.read.format("panel_files").load(folder)
    assert back.rdd.getNumPartitions() == 3 and rows(back) == rows(made) and len(rows(back)) > 100
    made.limit(2).coalesce(1).write.format("panel_files").mode("append").save(folder)
    assert spark.read.format("panel_files").load(folder).count() == made.count() + 2  # a frame read before keeps its parts
    made.where("name LIKE '1\\_%'").coalesce(1).write.format("panel_files").mode("overwrite").save(folder)
    assert rows(spark.read.format("panel_files").load(folder)) == rows(made.where("name LIKE '1\\_%'"))
    assert not (tmp_path / "panels" / "_staging").exists()


@pytest.mark.parametrize("bad", [("a/b.png", b"x"), (None, b"x"), ("c.png", None), ("same.png", b"y")])
def test_failed_write_leaves_nothing(spark, tmp_path, bad):
    panel_files.register(spark)
    folder = tmp_path / "panels"
    good = spark.createDataFrame([(f"{i}.png", b"abc") for i in range(20)], panel_files.SCHEMA).repartition(2)
    good.write.format("panel_files").mode("append").save(str(folder))
    before = sorted(str(p) for p in folder.rglob("*"))
    more = spark.createDataFrame([("same.png", b"x"), bad], panel_files.SCHEMA).coalesce(1).union(good.select(F.concat(F.lit("n"), "name").alias("name"), "png"))
    with pytest.raises(Exception, match="no file can have|File exists"):
        more.write.format("panel_files").mode("append").save(str(folder))
    assert sorted(str(p) for p in folder.rglob("*")) == before


def test_empty_table_and_wrong_columns(spark, tmp_path):
    panel_files.register(spark)
    folder = str(tmp_path / "none")
    spark.createDataFrame([], panel_files.SCHEMA).write.format("panel_files").mode("append").save(folder)
    assert spark.read.format("panel_files").load(folder).count() == 0
    with pytest.raises(Exception, match="takes columns"):
        spark.range(3).write.format("panel_files").mode("append").save(folder)
