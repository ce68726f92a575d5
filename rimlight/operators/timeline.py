"""Frame clocks: ordinals, timestamps, gaps, and the search for a start frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimlight.functions import color, media
from rimlight.model import BINARY_HEADER_BYTES, FALLBACK_FPS, PROGRESS_EVERY_FRAMES, TIMESTAMP_BYTES
from rimlight.operators import ordered

SEEK_BUCKET_US = 60_000_000


def frame_index(frames: DataFrame, order: str, fps: Column | None = None) -> DataFrame:
    """Number the frames of each title along ``order``; with ``fps`` also add ``ts_us``."""
    out = ordered.with_row_index(frames, ["title_id"], order)
    return out if fps is None else out.withColumn("ts_us", media.frame_ts(F.col("frame_idx"), fps))


def infer_fps(titles: DataFrame, frames: DataFrame) -> DataFrame:
    """Header rate if plausible, else from the first two timestamps, else 24."""
    gaps = (
        frames.where(F.col("frame_idx") < 2)
        .groupBy("title_id")
        .agg(
            F.max(F.when(F.col("frame_idx") == 0, F.col("ts_us"))).alias("ts0"),
            F.max(F.when(F.col("frame_idx") == 1, F.col("ts_us"))).alias("ts1"),
        )
        .select("title_id", F.abs(F.col("ts1").cast("double") - F.col("ts0")).alias("gap_us"))
    )
    header = F.col("fps").cast("float").cast("double")
    plausible = ~F.isnan(header) & (header > 0.001) & (header <= 300.0)
    rate = (
        F.when(plausible, header)
        .when(F.col("gap_us") > 0, F.lit(1e6) / F.col("gap_us"))
        .otherwise(F.lit(FALLBACK_FPS))
    )
    return titles.join(gaps, "title_id", "left").select("title_id", rate.alias("fps"))


def frame_dt(frames: DataFrame, rates: DataFrame) -> DataFrame:
    """Add ``dt_s``: seconds since the previous frame, or one frame period if that is not positive.

    Titles without a rate count as 24 frames per second.
    """
    return _gaps(frames, rates).drop(ordered.CHUNK)


def frame_clock(frames: DataFrame, rates: DataFrame, keep_chunk: bool = False) -> DataFrame:
    """Add ``dt_s`` and ``clock_s``, the running sum of the gaps of a title.

    Both passes window the same (title, chunk) groups, so the rows are exchanged once. With
    ``keep_chunk`` a join on (title, chunk) can follow without another exchange.
    """
    clock = ordered.with_carry(
        _gaps(frames, rates), ["title_id"], ["frame_idx"], sums={"clock_s": F.col("dt_s")})
    return clock if keep_chunk else clock.drop(ordered.CHUNK)


def frame_schedule(frames: DataFrame, rates: DataFrame) -> DataFrame:
    """``frame_clock`` with what players need: ``nth`` (0-based ordinal), ``prev_idx`` (the frame before), ``due_us``.

    A player takes frames in file order and never waits for one whose time has passed, so a frame
    is due at the largest timestamp up to it. The chunk stays in the result.
    """
    timed = ordered.with_carry(
        _gaps(frames, rates), ["title_id"], ["frame_idx"], previous={"prev_idx": F.col("frame_idx")},
        sums={"clock_s": F.col("dt_s"), "nth": F.lit(1).cast("long")}, maxima={"due_us": F.col("ts_us")})
    return timed.withColumn("nth", F.col("nth") - 1)


def _gaps(frames: DataFrame, rates: DataFrame) -> DataFrame:
    timed = ordered.with_carry(
        frames.withColumn(ordered.CHUNK, ordered.frame_chunk()),
        ["title_id"], ["frame_idx"], previous={"_prev_ts": F.col("ts_us")},
        per_key=rates.select("title_id", F.col("fps").alias("_fps")))
    gap = (F.col("ts_us").cast("double") - F.col("_prev_ts").cast("double")) / F.lit(1e6)
    period = F.lit(1.0) / F.coalesce("_fps", F.lit(FALLBACK_FPS))
    return timed.withColumn("dt_s", F.when(gap > 0, gap).otherwise(period)).drop("_prev_ts", "_fps")


def frame_luminance(samples: DataFrame) -> DataFrame:
    """Mean luminance of the source lights of every frame; the white channel is ignored."""
    points = color.luma_points(F.col("r"), F.col("g"), F.col("b"))
    return samples.groupBy("title_id", "frame_idx").agg(
        (F.sum(points).cast("double") / (F.count(F.lit(1)) * 10_000)).alias("lum"))


def title_summary(frames: DataFrame) -> DataFrame:
    """Frames, last timestamp and exported file size of every title."""
    size = F.lit(BINARY_HEADER_BYTES) + F.sum(F.length("payload") + TIMESTAMP_BYTES)
    return (
        frames.groupBy("title_id")
        .agg(
            F.count(F.lit(1)).alias("frames"),
            F.max("ts_us").alias("last_ts_us"),
            size.cast("long").alias("file_bytes"),
        )
        .withColumn("file_mb", media.bytes_to_mb(F.col("file_bytes")))
    )


def complete_payloads(frames: DataFrame, titles: DataFrame) -> DataFrame:
    """Frames whose payload has the size that the title's header promises."""
    expected = (F.col("top") + F.col("bottom") + F.col("left") + F.col("right")) * F.when(
        F.col("fmt") == 1, 4).otherwise(3)
    sizes = titles.select("title_id", expected.alias("_bytes"))
    return frames.join(sizes, "title_id").where(F.length("payload") == F.col("_bytes")).drop("_bytes")


def progress_samples(frames: DataFrame, every: int = PROGRESS_EVERY_FRAMES) -> DataFrame:
    """Progress reports: each ``every``-th frame, and a final one with the frame count."""
    done = F.col("frame_idx") + 1
    sampled = frames.where(done % every == 0).select(
        "title_id", done.alias("frames_done"), F.lit(False).alias("is_final"))
    final = frames.groupBy("title_id").agg(F.count(F.lit(1)).alias("frames_done")).withColumn(
        "is_final", F.lit(True))
    return sampled.unionByName(final)


def first_at(
    frames: DataFrame, lookups: DataFrame, at: str, bucket: float, extras: Sequence[str] = (),
) -> DataFrame:
    """``title_id, wanted, hit, last`` of every distinct lookup ``(title_id, wanted)``.

    ``hit`` is the first frame (smallest ``frame_idx``) whose column ``at`` reaches ``wanted``, null past the end,
    and ``last`` the last frame of the title, both with the columns ``extras``. Frames and lookups meet per
    (title, bucket of ``at``); what lies in later buckets comes from one row per bucket. The smallest frame
    number is taken, so values that run backwards give the same answer as a scan in file order.
    """
    no = lambda c: F.floor(F.col(c) / F.lit(bucket)).cast("long")
    frame = F.struct("frame_idx", *extras)
    points = frames.select("title_id", no(at).alias("_b"), F.col(at).alias("wanted"), frame.alias("_f"), F.lit(0).alias("_kind"))
    asked = lookups.select("title_id", "wanted").distinct().select(
        "title_id", no("wanted").alias("_b"), "wanted", F.lit(None).cast(points.schema["_f"].dataType).alias("_f"), F.lit(1).alias("_kind"))
    mixed = points.unionByName(asked)
    buckets = mixed.groupBy("title_id", "_b").agg(F.min("_f").alias("_min"), F.max("_f").alias("_max"))
    across = Window.partitionBy("title_id").orderBy("_b")
    carry = buckets.select(
        "title_id", "_b", F.min("_min").over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_next"),
        F.max("_max").over(across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("last"))

    # latest first; at equal times frames come before the lookup
    downwards = Window.partitionBy("title_id", "_b").orderBy(F.desc("wanted"), "_kind").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return (
        mixed.withColumn("_here", F.min("_f").over(downwards))
        .where(F.col("_kind") == 1)
        .join(carry, ["title_id", "_b"])
        .select("title_id", "wanted", F.least("_here", "_next").alias("hit"), "last")
    )


def seek_frame(frames: DataFrame, lookups: DataFrame, bucket_us: int = SEEK_BUCKET_US) -> DataFrame:
    """Add ``frame_idx``: the first frame with ``ts_us >= target_us``, past the end the last one."""
    found = first_at(frames, lookups.withColumn("wanted", F.col("target_us")), "ts_us", bucket_us).select(
        "title_id", F.col("wanted").alias("target_us"), F.coalesce("hit.frame_idx", "last.frame_idx").alias("frame_idx"))
    return lookups.join(found, ["title_id", "target_us"], "left")
