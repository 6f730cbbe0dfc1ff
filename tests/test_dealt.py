"""Tables that grow from small files: dealt to tasks by picture, never sent whole through the driver."""

import re

import pytest
from pyspark.sql import functions as F
from test_refinement import items, rows_of

from inkframe.operators import pixels as P
from inkframe.operators import refinement as R
from inkframe.plans import catalog
from inkframe.sources import derived as D
from inkframe.sources.staged import staged


@pytest.fixture(scope="module")
def suppliers(spark, tmp_path_factory):
    place = str(tmp_path_factory.mktemp("suppliers"))
    spark.range(1, 1301).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{place}/supplier.parquet")
    return place


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_small_file_is_dealt_by_what_its_rows_become(spark, suppliers):
    assert [f(spark, suppliers).rdd.getNumPartitions() for f in (D.pixels, D.photographs, D.underlined)] == [3, 10, 32]
    parts = D.pixels(spark, suppliers).select("glyph_id", F.spark_partition_id().alias("p")).distinct()
    assert parts.count() == 1300 and parts.select("p").distinct().count() == 3


@pytest.mark.parametrize("name", ["coloured_ink", "fill_ratio", "glyph_features", "ink_maps", "otsu_threshold", "hole_counts"])
def test_no_table_of_pixels_goes_through_the_driver(spark, suppliers, name):
    p = plan(catalog.QUERIES[name](spark, suppliers))
    assert "BroadcastExchange" not in p and ("SortMergeJoin" in p or name == "otsu_threshold")


def test_a_staged_table_is_not_broadcast_for_its_small_file(spark):
    a = staged(spark.range(1000).select("id", F.lit(1).alias("v")), "a")
    assert "Broadcast" not in plan(a.join(spark.range(1000), "id")) and a.join(spark.range(500), "id").count() == 500


def test_images_of_specks_alone_have_no_lines(spark):
    speck = list(rows_of(7, "5", {})[0])
    speck[4:6], speck[7], speck[9] = [2, 2], 0.2, 0.2
    got = R.refine_images(items(spark, [tuple(speck), *rows_of(8, "12345", {})]))
    assert [r.image_id for r in got.collect()] == [8]
    none = spark.range(1).select(R.median(F.array().cast("array<double>")).alias("m"), R.median(F.array(F.lit(3.0), F.lit(1.0))).alias("two"), R.median(F.array(F.lit(5.0), F.lit(1.0), F.lit(2.0))).alias("three"))
    assert none.first() == (None, 2.0, 2.0)


def test_lines_of_reading_are_dealt_by_their_glyphs(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "DEALT", 1000)
    spark.range(1, 901).select(F.col("id").alias("o_orderkey"), (F.col("id") % 60).alias("o_custkey")).coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    s = catalog._sequence(spark, str(tmp_path))
    assert s.rdd.getNumPartitions() == 9 and s.count() == 900
    assert catalog.QUERIES["beam_select"](spark, str(tmp_path)).count() == 60


@pytest.mark.parametrize("name", ["ruled_line_runs", "ruled_lines_less_strokes", "page_grids", "hole_counts"])
def test_runs_stay_with_their_picture(spark, tmp_path, monkeypatch, name):
    """Every shuffle after the pictures are made is by picture, to as many tasks as its rows need: none is left to the size of packed files."""
    monkeypatch.setattr("inkframe.sources.staged.TAKEN", 20)
    spark.range(1, 13).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalog.QUERIES[name](spark, str(tmp_path))
    dealt = re.findall(r"hashpartitioning\((\w+)#\d+L?(.*?), (\d+)\), (\w+)", plan(found))
    assert dealt and all(key == "glyph_id" and not more for key, more, *_ in dealt)
    assert max(int(n) for *_, n, _ in dealt) > 1 and found.count() > 0


def test_columns_are_slim_when_valleys_are_looked_for(spark):
    """A picture's running sums are one row, not a copy of them on each of its columns."""
    columns = spark.range(60).select(F.lit(1).alias("glyph_id"), F.col("id").alias("x"), (F.abs(F.col("id") - 30) + 1).alias("n"), F.lit(60).cast("long").alias("width"))
    found = P.valleys(columns)
    assert not re.search(r"Window \[[^\n]*collect_list", plan(found)) and [r.x for r in found.collect()] == [30]


def test_what_blobs_hold_is_found_without_a_row_for_a_pixel(spark, monkeypatch):
    """No table that blobs stage is longer than the pages' own runs."""
    from inkframe.operators import regions

    rows = {}

    def counted(df, name, *more, **named):
        table = staged(df, name, *more, **named)
        rows[name] = max(rows.get(name, 0), table.count())
        return table

    monkeypatch.setattr(regions, "staged", counted)
    assert catalog.QUERIES["blobs_on_lines"](spark, "/root/testdata/sf0.001").count() > 10
    assert rows["runs"] > 1000 and max(rows.values()) == rows["runs"]


def test_wide_boxes_are_cut_in_one_pass(spark, tmp_path):
    """Boxes that are cut again and again take no table and no job a round, and no shuffle but by picture."""
    spark.range(1, 41).select(F.col("id").alias("s_suppkey")).coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    found = catalog.QUERIES["recursive_splits"](spark, str(tmp_path))
    p = plan(found)
    assert p.count("Scan parquet") == 2 and set(re.findall(r"hashpartitioning\((\w+)#", p)) <= {"glyph_id", "image_id", "s_suppkey"}
    assert found.filter("path like '%.%'").count() > 0
