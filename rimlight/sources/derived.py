"""Inputs derived from the given tables, so that every operator grows with them.

The rules are those of FIXTURES.md; the SQL twins in ``checks`` state them a second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.functions.packed import pack_bytes
from rimlight.model import FRAME_HEIGHT, FRAME_WIDTH, MAPPING_SCHEMA, Layout
from rimlight.operators.timeline import frame_index
from rimlight.session import fresh_folder

# 64 embedding values are 16 RGBW lights
STRIP = Layout(top=5, bottom=5, left=3, right=3, rgbw=True)
# working size of the exploded pixel form
SMALL_WIDTH, SMALL_HEIGHT = 48, 27


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _md5(value: Column) -> Column:
    return F.md5(value.cast("string"))


def _numbered_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(
        F.col("label").alias("title_id"), "vec_id", "embedding")
    jitter = (F.col("title_id") % 2) * (F.col("frame_idx") % 3) * 1000
    ts = F.floor(F.col("frame_idx") * F.lit(1e6) / 24).cast("long") + jitter
    return frame_index(vectors, "vec_id").withColumn("ts_us", ts.cast("long"))


def _bytes_of_vector() -> Column:
    return F.transform("embedding", lambda v: F.greatest(
        F.lit(0), F.least(F.lit(255), F.floor(v.cast("double") * 220 + 128))).cast("int"))


_STORED: dict[tuple[str, str, str], str] = {}


def _stored(spark: SparkSession, sf_dir: str, name: str, rows: Callable[[], DataFrame]) -> DataFrame:
    """The rows as a table in the shared folder, written once per application."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _STORED:
        path = fresh_folder(spark, name)
        rows().write.parquet(path)
        _STORED[key] = path
    return spark.read.parquet(_STORED[key])


def led_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(title_id, frame_idx, ts_us, payload)``: one packed frame per embedding."""
    return _stored(spark, sf_dir, "led-frames", lambda: _numbered_vectors(spark, sf_dir).select(
        "title_id", "frame_idx", "ts_us", pack_bytes(_bytes_of_vector()).alias("payload")))


def led_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long twin of ``led_frames``: one row per light."""

    def rows() -> DataFrame:
        lights = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(
            i.alias("led_idx"),
            *[F.get(F.col("v"), i * 4 + n).alias(c) for n, c in enumerate("rgbw")]))
        values = _numbered_vectors(spark, sf_dir).withColumn("v", _bytes_of_vector())
        return values.select("title_id", "frame_idx", "ts_us", F.explode(lights).alias("l")).select(
            "title_id", "frame_idx", "ts_us", "l.*")

    return _stored(spark, sf_dir, "led-samples", rows)


def led_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Header of every title; the rates cover plausible, missing and broken values."""
    rate = (F.when(F.col("title_id") % 4 == 0, F.lit(24.0))
            .when(F.col("title_id") % 4 == 1, F.lit(0.0))
            .when(F.col("title_id") % 4 == 2, F.lit(float("nan"))).otherwise(F.lit(301.0)))
    return (
        table(spark, sf_dir, "embeddings").select(F.col("label").alias("title_id")).distinct()
        .select("title_id", rate.alias("fps"), F.lit(5).alias("top"), F.lit(5).alias("bottom"),
                F.lit(3).alias("left"), F.lit(3).alias("right"), F.lit(1).alias("fmt"))
    )


def pixels(spark: SparkSession, sf_dir: str, width: int = SMALL_WIDTH, height: int = SMALL_HEIGHT) -> DataFrame:
    """Exploded frames, one per embedding."""
    x, y, v = F.col("x"), F.col("y"), F.col("vec_id")
    byte = lambda c: (c % 256).cast("int")
    return (
        _numbered_vectors(spark, sf_dir).select("title_id", "frame_idx", "vec_id")
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.lit(width - 1))))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(height - 1))))
        .select(
            "title_id", "frame_idx", "x", "y",
            byte(x * 7 + y * 13 + v * 31).alias("r"),
            byte(x * x + y * 5 + v * 17).alias("g"),
            byte(x * 3 + y * y + v * 53).alias("b"))
    )


def frames(spark: SparkSession, sf_dir: str, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT) -> DataFrame:
    """Packed twin of ``pixels``: ``(title_id, frame_idx, ts_us, pixels)``, row-major rgb24."""

    def paint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, x = np.mgrid[0:height, 0:width]
        # bytes wrap around at 256 by themselves
        base = np.stack([x * 7 + y * 13, x * x + y * 5, x * 3 + y * y], axis=2).astype(np.uint8)
        step = np.array([31, 17, 53])
        for batch in batches:
            vec_ids = batch.column("vec_id").to_pylist()
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                images = [(base + (v * step).astype(np.uint8)).tobytes() for v in vec_ids[at:at + 64]]
                yield pa.RecordBatch.from_arrays(
                    [part.column("title_id"), part.column("frame_idx"), part.column("ts_us"),
                     pa.array(images, pa.binary())],
                    names=["title_id", "frame_idx", "ts_us", "pixels"])

    # few bytes per row come in, so the number of painting tasks has to be set
    seeds = _numbered_vectors(spark, sf_dir).select("title_id", "frame_idx", "ts_us", "vec_id").repartition(
        spark.sparkContext.defaultParallelism, "title_id", "frame_idx")
    return seeds.mapInArrow(
        paint, "title_id int, frame_idx bigint, ts_us bigint, pixels binary")


def layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layouts of many sizes, one per supplier; some sides have no lights."""
    k = F.col("s_suppkey")
    part = lambda n, m, a: (k * n % m + a).cast("int")
    return table(spark, sf_dir, "supplier").select(
        k.alias("layout_id"),
        part(16, 640, 16).alias("width"), part(9, 360, 9).alias("height"),
        part(7, 97, 0).alias("top"), part(11, 89, 1).alias("bottom"),
        part(3, 53, 0).alias("left"), part(5, 49, 0).alias("right"))


def playback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (F.when(F.col("event_type") == "signup", "start")
            .when(F.col("event_type") == "purchase", "stop").otherwise("progress"))
    return table(spark, sf_dir, "events").select(
        "event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("session_id"),
        (F.col("user_id") % 10).cast("int").alias("title_id"), kind.alias("kind"),
        F.col("value").alias("position_s"), (F.col("event_type") == "error").alias("is_paused"))


def short_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events on the scale of the test titles, which last seconds: a 200th of positions, a 100,000th of the time."""
    us = F.unix_micros("ts")
    base = F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))
    return playback_events(spark, sf_dir).withColumns({
        "position_s": F.col("position_s") / 200,
        "ts": F.timestamp_micros(base + F.floor((us - base) / 100_000).cast("long"))})


def catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return table(spark, sf_dir, "documents").select(
        _md5(d).alias("item_id"), F.md5("lang").alias("library_id"),
        F.when(d % 29 != 0, F.concat(F.lit("Item "), F.lpad(d.cast("string"), 8, "0"))).alias("name"),
        F.when(d % 3 == 0, "Movie").when(d % 3 == 1, "Episode").otherwise("Video").alias("item_type"),
        F.when(d % 17 != 0, F.concat(
            F.lit("/media/"), "source", F.lit("/"), d.cast("string"), F.lit(".mkv"))).alias("path"),
        F.when(d % 23 == 0, "garbage").otherwise(F.concat(
            F.lit("2024-"), two(d % 12 + 1), F.lit("-"), two(d % 28 + 1),
            F.lit("T00:00:00.0000000Z"))).alias("date_created"))


def excluded_libraries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library of Spanish documents, in upper-case dashed spelling."""
    h = F.upper(F.md5(F.col("lang")))
    dashed = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                         F.substring(h, 17, 4), F.substring(h, 21, 12))
    return table(spark, sf_dir, "documents").where(F.col("lang") == "es").select(
        dashed.alias("library_id")).distinct()


def extraction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    status = F.when(F.col("quality") == 1, "completed").when(d % 2 == 0, "failed").otherwise("extracting")
    return table(spark, sf_dir, "labels").select(
        _md5(d).alias("item_id"), status.alias("extraction_status"),
        (F.col("toxic") + 1).cast("int").alias("extraction_attempts"),
        F.lit(7).alias("extraction_progress"),
        (d % 5000).cast("long").alias("frames_current"),
        F.when(d % 7 == 0, 0).otherwise(5000).cast("long").alias("frames_total"))


def metadata_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full-width metadata rows of the labelled documents."""
    d = F.col("doc_id")
    cat = catalog(spark, sf_dir).withColumnRenamed("item_id", "_id")
    items = table(spark, sf_dir, "labels").select("doc_id", _md5(d).alias("_k")).join(
        extraction_items(spark, sf_dir), F.col("_k") == F.col("item_id")).join(
        cat, F.col("item_id") == F.col("_id"))
    base = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return items.select(
        "item_id", "library_id", F.coalesce("name", F.lit("Unknown")).alias("name"), "item_type",
        F.lit("Video").alias("kind"), F.lit(None).cast("int").alias("season"),
        F.lit(None).cast("int").alias("episode"), F.coalesce("path", F.lit("")).alias("path"),
        "date_created", base.alias("created_at"),
        F.timestamp_micros(F.unix_micros(base) + d * 1_000_000).alias("updated_at"),
        "extraction_status", F.lit(None).cast("string").alias("extraction_error"),
        "extraction_attempts", F.lit(False).alias("viewed"), "extraction_progress",
        "frames_current", "frames_total")


def binaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existing binaries; one completed item in five has none, three have no catalog row."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    done = table(spark, sf_dir, "labels").where("quality = 1 and doc_id % 5 <> 0").select("doc_id")
    known = done.join(docs, "doc_id").select(
        _md5(F.col("doc_id")).alias("item_id"), (F.lit(17) + F.col("n_chars") * 836).cast("long").alias("length"))
    orphans = table(spark, sf_dir, "region").where("r_regionkey < 3").select(
        F.concat(F.lit("orphan"), F.col("r_regionkey").cast("string")).alias("item_id"),
        F.lit(17).cast("long").alias("length"))
    return known.unionByName(orphans)


def source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing of existing media files; those of very short documents are missing."""
    return table(spark, sf_dir, "documents").where("n_chars >= 400").select(F.concat(
        F.lit("/media/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".mkv")).alias("path"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    raw = F.concat("c_mktsegment", F.lit("|"), (F.lit(1700000000000) + key).cast("string"))
    return table(spark, sf_dir, "customer").select(
        key.alias("session_id"), F.base64(F.encode(raw, "utf-8")).alias("device_id"),
        F.concat(F.lit("Room "), F.col("c_nationkey").cast("string"), F.lit("-TV")).alias("device_name"))


# (order, identifier, host, port, top, bottom, left, right, input position)
MAPPING_ROWS = [
    (0, "QlVJTERJTkd8MTYwMDAwMDAwMDAwMA==", "h0", 19446, 89, 89, 49, 49, 0),
    (1, "room 3-tv", "h1", 19446, 5, 5, 3, 3, 4),
    (2, "Room 1", "h2", 19446, 5, 5, 3, 3, -7),
    (3, "room1", "h2", 19446, 9, 9, 9, 9, 0),
    (4, "ROOM 3-TV", "h3", 19447, 0, 0, 0, 0, 0),
    (5, "  ", "h4", 19446, 1, 1, 1, 1, 0),
    (6, "---", "h5", 19446, 1, 1, 1, 1, 0),
]


def device_mappings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPING_ROWS, MAPPING_SCHEMA)


def item_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))

    def nodes(name: str, item: Column, parent: Column, kind: str) -> DataFrame:
        return table(spark, sf_dir, name).select(
            item.alias("item_id"), parent.alias("parent_id"), F.lit(kind).alias("node_type"))

    return (
        nodes("region", key("r", "r_regionkey"), F.lit(None).cast("string"), "CollectionFolder")
        .unionByName(nodes("nation", key("n", "n_nationkey"), key("r", "n_regionkey"), "Folder"))
        .unionByName(nodes("customer", key("c", "c_custkey"), F.when(
            F.col("c_custkey") % 50 == 0, "missing").otherwise(key("n", "c_nationkey")), "Folder"))
        .unionByName(nodes("orders", key("o", "o_orderkey"), key("c", "o_custkey"), "Movie"))
    )
