"""Backlog order and completeness, status corners, library lookup, plans."""

import re

import pytest
from pyspark.sql import functions as F

from rimlight.operators import backlog as B
from rimlight.operators.tree import library_of_item
from rimlight.operators.zone_kernel import frame_zone_colors
from rimlight.model import Layout
from rimlight.sources import binaries, catalog, tables
from rimlight.sources import derived as D


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_every_item_is_accounted_for(spark, sf_dir):
    cat, bins, excluded, files = (
        D.catalog(spark, sf_dir), D.binaries(spark, sf_dir), D.excluded_libraries(spark, sf_dir), D.source_files(spark, sf_dir))
    eligible = catalog.path_filter(catalog.item_type_filter(cat))
    allowed = B.exclude_libraries(eligible, excluded)
    present = B.existing_sources(allowed, files)
    pending = B.pending_items(cat, bins, excluded, files)
    done = present.join(bins, "item_id", "left_semi")
    assert pending.count() > 0 and done.count() > 0 and present.count() < allowed.count() < eligible.count()
    assert pending.count() + done.count() == present.count()


ITEMS = [("a", "2024-03-01T00:00:00.0000000Z", "Movie", "c"), ("b", "garbage", "Movie", "B"),
         ("c", "2024-05-01T00:00:00.0000000Z", "Serie", "a"), ("d", "2024-03-01T00:00:00.0000000Z", "Serie", "b"),
         ("e", None, "Serie", "A")]


@pytest.mark.parametrize("order, expected", [
    ("newest_first", "cadbe"), ("OLDEST_first", "beadc"), ("alphabetical", "ebcda"), ("movies_newest_first", "abcde"),
    ("no such order", "cadbe"), (None, "cadbe")])
def test_orders(spark, order, expected):
    rows = spark.createDataFrame(ITEMS, "item_id string, date_created string, kind string, name string").repartition(3)
    assert "".join(r.item_id for r in B.backlog(rows, order).collect()) == expected


def test_series_order(spark, sf_dir):
    rows = B.series_recency(spark.createDataFrame(
        [("s1", "2024-01-05"), ("s2", "2024-02-01"), ("s1", "2024-03-01"), ("s3", "junk")],
        "series_id string, date_created string")).collect()
    assert [r.series_id for r in rows] == ["s1", "s2", "s3"]


def test_library_of_item(spark):
    tree = [("lib", None, "CollectionFolder"), ("view", "lib", "UserView"), ("f0", "lib", "Folder"), ("in_view", "view", "Movie"),
            ("orphan", "gone", "Movie"), ("top", None, "Folder"), ("under_top", "top", "Movie"), ("x", "y", "Folder"),
            ("y", "x", "Folder"), ("in_cycle", "x", "Movie")]
    tree += [(f"f{i}", f"f{i - 1}", "Folder") for i in range(1, 40)] + [("deep", "f39", "Movie")]
    got = {r.item_id: r.library_id for r in library_of_item(
        spark.createDataFrame(tree, "item_id string, parent_id string, node_type string")).collect()}
    assert len(got) == len(tree)
    assert (got["lib"], got["view"], got["in_view"], got["deep"], got["f20"]) == ("lib", "view", "view", "lib", "lib")
    assert (got["orphan"], got["top"], got["under_top"], got["in_cycle"], got["x"]) == ("gone", None, "top", "x", "y")


def test_filters_reach_the_scan(spark, sf_dir, tmp_path):
    D.catalog(spark, sf_dir).write.parquet(str(tmp_path / "catalog"))
    text = plan(catalog.path_filter(catalog.read_catalog(spark, str(tmp_path / "catalog"))).select("item_id"))
    assert re.search(r"PushedFilters: \[.*In\(item_type", text) and "IsNotNull(path)" in text
    assert "date_created" not in re.search(r"ReadSchema: (\S+)", text).group(1)


def test_listing_reads_no_content(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"12345")
    text = plan(binaries.binary_listing(spark, str(tmp_path)).where("length > 3"))
    assert "content" not in re.search(r"ReadSchema: (\S+)", text).group(1)
    assert "GreaterThan(length,3)" in text


def test_kernel_needs_no_shuffle(spark, tmp_path):
    spark.range(3).select(F.lit(1).alias("title_id"), F.col("id").alias("frame_idx"), F.col("id").alias("ts_us"),
                          F.lit(bytearray(172_800)).alias("pixels")).write.parquet(str(tmp_path / "f"))
    assert "Exchange" not in plan(frame_zone_colors(spark.read.parquet(str(tmp_path / "f")), Layout()))


def test_frame_table_spreads_a_hot_title_and_skips_files(spark, tmp_path):
    path = str(tmp_path / "t")
    frames = spark.range(8000).select(
        F.when(F.col("id") < 6000, 1).otherwise(2).alias("title_id"), F.col("id").alias("frame_idx"),
        (F.col("id") * 40_000).alias("ts_us"), F.lit(bytearray(48)).alias("payload"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_light_frames(frames, path)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    table = tables.read_light_frames(spark, path)
    assert table.where("title_id = 1").select(F.input_file_name()).distinct().count() > 3
    part = tables.read_light_frames(spark, path, titles=[1], from_us=40_000_000, to_us=80_000_000)
    assert part.count() == 1000
    assert re.search(r"PushedFilters: \[.*EqualTo\(title_id,1\)|In\(title_id", plan(part))
    assert "GreaterThanOrEqual(ts_us,40000000)" in plan(part)
