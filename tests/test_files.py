"""Files: round trips, damaged input, the shared folder."""

import json
import os
import struct

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, LessThan

from rimlight import session
from rimlight.sources import binaries, ledfiles, lightsource, metadata


def led_file(path, magic=b"AMb2", fps=24.0, counts=(1, 1, 0, 0), fmt=0, frames=3, tail=b""):
    size = sum(counts) * (4 if fmt == 1 else 3)
    body = b"".join(struct.pack("<Q", i * 41_666) + bytes([i] * size) for i in range(frames))
    path.write_bytes(struct.pack("<4sf4HB", magic, fps, *counts, fmt) + body + tail)


@pytest.fixture
def folder(tmp_path):
    led_file(tmp_path / "rgb.bin")
    led_file(tmp_path / "rgbw.bin", fmt=1, fps=float("nan"))
    led_file(tmp_path / "magic.bin", magic=b"AMb3")
    led_file(tmp_path / "header.bin", frames=0)
    led_file(tmp_path / "cut.bin", frames=2, tail=b"\0" * 13)
    led_file(tmp_path / "nolights.bin", counts=(0, 0, 0, 0), frames=2)
    (tmp_path / "short.bin").write_bytes(b"AMb2")
    (tmp_path / "other.txt").write_bytes(b"x")
    return str(tmp_path)


def test_listing_and_headers(spark, folder):
    listing = binaries.binary_listing(spark, folder)
    sizes = {r.item_id: r.length for r in listing.collect()}
    assert sizes["rgb"] == 17 + 3 * 14 and "other" not in sizes
    titles = {r.item_id: r for r in ledfiles.led_titles(listing).collect()}
    assert set(titles) == {"rgb", "rgbw", "header", "cut", "nolights"}
    assert (titles["rgb"].fps, titles["rgb"].top, titles["rgbw"].fmt) == (24.0, 1, 1)


@pytest.mark.parametrize("per_range", [1, 2, 4096])
def test_frames(spark, folder, per_range):
    titles = ledfiles.led_titles(binaries.binary_listing(spark, folder))
    rows = ledfiles.led_frames(titles, per_range).collect()
    frames = {}
    for r in rows:
        frames.setdefault(r.item_id, {})[r.frame_idx] = (r.ts_us, bytes(r.payload))
    assert {k: len(v) for k, v in frames.items()} == {"rgb": 3, "rgbw": 3, "cut": 2, "nolights": 2}
    assert frames["rgb"][2] == (83_332, bytes([2] * 6)) and frames["rgbw"][1] == (41_666, bytes([1] * 8))


def test_round_trip(spark, tmp_path):
    rows = [(f"item{t}", i, i * 40_000, bytearray([t, i % 256] * 12)) for t in range(3) for i in range(700)]
    frames = spark.createDataFrame(rows, "item_id string, frame_idx long, ts_us long, payload binary")
    titles = spark.createDataFrame([(f"item{t}", 25.0, 3, 2, 1, 2, 0) for t in range(3)],
                                   "item_id string, fps double, top int, bottom int, left int, right int, fmt int")
    report = {r.item_id: (r.frames, r.bytes) for r in ledfiles.write_led_binaries(
        frames.repartition(7), titles, str(tmp_path)).collect()}
    assert report == {f"item{t}": (700, 17 + 700 * 32) for t in range(3)}
    assert sorted(os.listdir(tmp_path)) == ["item0.bin", "item1.bin", "item2.bin"]  # nothing half-written
    back = ledfiles.led_binary_scan(binaries.binary_listing(spark, str(tmp_path)))
    assert back.exceptAll(frames).isEmpty() and frames.exceptAll(back).isEmpty()


def test_metadata_documents(spark, tmp_path):
    good = {"Id": "other", "Name": "N", "VendorDateCreated": "2024-01-01", "ExtractionStatus": "failed",
            "CreatedAt": "2024-01-02T03:04:05.6789012+00:00", "ExtractionFramesTotal": 7, "Season": None}
    (tmp_path / "a.item.json").write_text(json.dumps(good, indent=2))
    (tmp_path / "b.item.json").write_text("")
    (tmp_path / "c.item.json").write_text("  \n ")
    (tmp_path / "d.item.json").write_text('{"Id": ')
    (tmp_path / "e.item.json").write_text("{}")
    (tmp_path / "f.json").write_text("{}")
    rows = {r.item_id: r for r in metadata.metadata_scan(spark, str(tmp_path), date_key="VendorDateCreated").collect()}
    assert set(rows) == {"a", "e"}  # the id is that of the file name
    a, e = rows["a"], rows["e"]
    assert (a.name, a.date_created, a.extraction_status, a.frames_total) == ("N", "2024-01-01", "failed", 7)
    assert a.created_at is not None
    assert (e.kind, e.extraction_status, e.extraction_attempts, e.viewed, e.season) == ("Video", "pending", 0, False, None)
    bad = {r.item_id: r.reason for r in metadata.metadata_errors(spark, str(tmp_path)).collect()}
    assert bad == {"b": "blank", "c": "blank", "d": "malformed"}
    assert len(os.listdir(tmp_path)) == 6  # nothing was deleted


def test_shared_folder_is_the_configured_one(spark):
    configured = spark.conf.get("spark.checkpoint.dir")
    assert session.fresh_folder(spark, "x").startswith(configured)
    rows = session.checkpointed(spark.range(5).select((F.col("id") * 2).alias("v")))
    assert rows.count() == 5
    assert spark.sparkContext.getCheckpointDir().removeprefix("file:").startswith(configured)


TITLE = "item_id string, fps double, top int, bottom int, left int, right int, fmt int"


def many_frames(spark, counts):
    rows = [(item, i, i * 40_000, bytearray([i % 256] * 6)) for item, n in counts.items() for i in range(n)]
    titles = spark.createDataFrame([(item, 25.0, 1, 1, 0, 0, 0) for item in counts], TITLE)
    return spark.createDataFrame(rows, "item_id string, frame_idx long, ts_us long, payload binary"), titles


def test_source_joins_the_ranges_of_a_title(spark, tmp_path):
    frames, titles = many_frames(spark, {"long": 5000, "short": 3, "one": 1})
    lightsource.save_light_binaries(frames, titles, str(tmp_path))
    assert sorted(os.listdir(tmp_path)) == ["long.bin", "one.bin", "short.bin"]
    assert os.path.getsize(tmp_path / "long.bin") == 17 + 5000 * 14
    for range_bytes in (100, 10_000, 1 << 26):
        back = lightsource.read_light_binaries(spark, str(tmp_path), range_bytes)
        assert back.exceptAll(frames).isEmpty() and back.count() == 5004


def test_source_opens_what_a_filter_needs(spark, tmp_path):
    frames, titles = many_frames(spark, {"a": 40, "b": 40, "c": 40})
    lightsource.save_light_binaries(frames, titles, str(tmp_path))
    (tmp_path / "a.bin").write_bytes(b"AMb2" + b"\xff" * 40)  # no reader could take this
    back = lightsource.read_light_binaries(spark, str(tmp_path))
    rows = back.where((F.col("item_id") == "b") & (F.col("frame_idx") > 5) & (F.col("frame_idx") <= 8)).collect()
    assert sorted((r.item_id, r.frame_idx, r.ts_us) for r in rows) == [("b", i, i * 40_000) for i in (6, 7, 8)]
    reader = lightsource._Reader(str(tmp_path), 1 << 20)
    left = list(reader.pushFilters([EqualTo(("item_id",), "c"), LessThan(("frame_idx",), 10), EqualTo(("ts_us",), 0)]))
    assert [type(f).__name__ for f in left] == ["EqualTo"] and [f[0] for p in reader.partitions() for f in p.files] == ["c.bin"]
    assert sum(b.num_rows for p in reader.partitions() for b in reader.read(p)) == 10


def test_aborted_write_leaves_no_file(spark, tmp_path):
    frames, titles = many_frames(spark, {"a": 500, "b": 500})
    broken = frames.withColumn("payload", F.when((F.col("item_id") == "b") & (F.col("frame_idx") == 400), F.expr("raise_error('no')").cast("binary")).otherwise(F.col("payload")))
    with pytest.raises(Exception, match="no"):
        lightsource.save_light_binaries(broken, titles, str(tmp_path))
    assert [n for n in os.listdir(tmp_path) if not n.startswith(".")] == []
    twice = frames.unionByName(frames.where("item_id = 'a' and frame_idx = 7"))
    with pytest.raises(Exception, match="overlap"):
        lightsource.save_light_binaries(twice, titles, str(tmp_path))
    assert [n for n in os.listdir(tmp_path) if n.endswith(".bin")] == []
