"""Smaller and better searchable light sequences: runs, deltas, cuts, chunks, indexes, checks.

Frames are ``(title_id, frame_idx, ts_us, payload)``; where brightness matters they carry ``lum``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimlight.functions.packed import payload_delta
from rimlight.operators import ordered
from rimlight.operators.selection import select_ranks
from rimlight.session import checkpointed

CHUNK_US = 10_000_000
KEYFRAME_EVERY = 48
DELTA_THRESHOLD = 10
SCENE_CUT = 0.4
BRIGHTNESS_BIN = 16
DIM_6_BIT, DIM_7_BIT = 32, 96  # chunk brightness below which 6 and 7 bits are enough
_TITLE = ["title_id"]


def _with_previous_payload(frames: DataFrame) -> DataFrame:
    return ordered.with_carry(
        frames.withColumn(ordered.CHUNK, ordered.frame_chunk()), _TITLE, ["frame_idx"],
        previous={"_prev": F.col("payload")})


def _chunk_of(ts: str, chunk_us: int) -> Column:
    return F.floor(F.col(ts) / F.lit(chunk_us)).cast("long")


def frame_runs(frames: DataFrame, similarity: float = 1.0) -> DataFrame:
    """Consecutive frames that repeat the one before as one row with a count.

    At ``similarity`` 1 frames have to be identical; below, the mean channel difference to the
    previous frame may be up to ``1 - similarity``.
    """
    rows = _with_previous_payload(frames)
    if similarity >= 1.0:
        repeats = F.col("payload") == F.col("_prev")
    else:
        repeats = payload_delta("payload", "_prev") <= F.lit(1.0 - similarity)
    rows = rows.withColumn("_new", (~F.coalesce(repeats, F.lit(False))).cast("long")).drop("_prev")
    rows = ordered.with_carry(rows, _TITLE, ["frame_idx"], sums={"run_no": F.col("_new")})
    return rows.groupBy("title_id", "run_no").agg(
        F.min("frame_idx").alias("first_frame"), F.count(F.lit(1)).alias("frames"),
        F.min("ts_us").alias("first_ts_us"), F.max("ts_us").alias("last_ts_us"),
        F.min_by("payload", "frame_idx").alias("payload"))


def expand_runs(runs: DataFrame, clock: DataFrame) -> DataFrame:
    """Frames of ``frame_runs``: ``title_id, frame_idx, ts_us, payload`` for every frame of ``clock(title_id, frame_idx, ts_us)``.

    Every frame takes the payload of its run; exact for identical runs, else within the similarity of each step.
    Runs and clock meet per (title, chunk of frames), so a run over half a title is spread over its chunks.
    """
    no = lambda c: F.floor(c / ordered.FRAME_CHUNK).cast("long")
    last = F.col("first_frame") + F.col("frames") - 1
    spread = runs.select("title_id", "first_frame", last.alias("_last"), "payload",
                         F.explode(F.sequence(no(F.col("first_frame")), no(last))).alias(ordered.CHUNK))
    timed = clock.select("title_id", "frame_idx", "ts_us", ordered.frame_chunk().alias(ordered.CHUNK))
    return timed.join(spread, ["title_id", ordered.CHUNK]).where("frame_idx between first_frame and _last").select(
        "title_id", "frame_idx", "ts_us", "payload")


def delta_frames(
    samples: DataFrame, every: int = KEYFRAME_EVERY, threshold: int = DELTA_THRESHOLD,
) -> DataFrame:
    """All lights of keyframes; between them the lights that moved away from the last keyframe."""
    key = (F.col("frame_idx") - F.col("frame_idx") % every).alias("key_frame")
    group = Window.partitionBy("title_id", "key_frame", "led_idx").orderBy("frame_idx")
    rows = samples.select("*", key).withColumns({
        f"d{c}": F.col(c) - F.first(c).over(group) for c in "rgbw"})
    is_key = F.col("frame_idx") == F.col("key_frame")
    moved = F.greatest(*[F.abs(f"d{c}") for c in "rgbw"]) > threshold
    value = lambda c: F.when(is_key, F.col(c)).otherwise(F.col(f"d{c}")).alias(c)
    return rows.where(is_key | moved).select(
        "title_id", "frame_idx", "key_frame", "led_idx", is_key.alias("is_key"),
        *[value(c) for c in "rgbw"])


def restore_deltas(deltas: DataFrame, clock: DataFrame, every: int = KEYFRAME_EVERY) -> DataFrame:
    """All lights of all frames of ``clock(title_id, frame_idx, ts_us)`` from ``delta_frames``.

    A light stands where the keyframe had it, moved by its delta where there is one: exact at threshold 0, else
    within the threshold. The rows of one light between two keyframes (``every`` at most) form one group, which is
    unfolded over its frames; the table is not joined with itself.
    """
    channels = ["r", "g", "b", "w"]
    delta = F.map_from_entries(F.collect_list(F.when(~F.col("is_key"), F.struct("frame_idx", F.struct(*channels)))))
    groups = deltas.groupBy("title_id", "key_frame", "led_idx").agg(
        *[F.max(F.when(F.col("is_key"), F.col(c))).alias(f"_{c}") for c in channels], delta.alias("_moved"))
    unfolded = groups.withColumn("frame_idx", F.explode(F.sequence("key_frame", F.col("key_frame") + (every - 1)))).withColumn(
        "_d", F.try_element_at("_moved", F.col("frame_idx")))
    value = lambda c: (F.col(f"_{c}") + F.coalesce(F.col(f"_d.{c}"), F.lit(0))).alias(c)
    return unfolded.select("title_id", "frame_idx", "led_idx", *[value(c) for c in channels]).join(
        clock.select("title_id", "frame_idx", "ts_us"), ["title_id", "frame_idx"])


def scene_cuts(frames: DataFrame, threshold: float = SCENE_CUT) -> DataFrame:
    """Colour difference of every frame to the one before, and whether it is a cut."""
    rows = _with_previous_payload(frames).select("title_id", "frame_idx", "ts_us", F.coalesce(
        payload_delta("payload", "_prev"), F.lit(0.0)).alias("delta"))
    return rows.withColumn("is_cut", F.col("delta") > threshold)


def chunks(frames: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Start, frame count and mean brightness per stretch of time."""
    return frames.groupBy("title_id", _chunk_of("ts_us", chunk_us).alias("chunk_no")).agg(
        F.min("ts_us").alias("start_ts_us"), F.count(F.lit(1)).alias("frames"),
        F.bround(F.avg("lum"), 0).cast("int").alias("brightness"))


def brightness_histogram(frames: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    bin_no = F.floor(F.col("lum") / BRIGHTNESS_BIN).cast("int")
    return frames.groupBy(
        "title_id", _chunk_of("ts_us", chunk_us).alias("chunk_no"), bin_no.alias("bin")
    ).agg(F.count(F.lit(1)).alias("frames"))


def seek_index(frames: DataFrame, every_us: int = CHUNK_US) -> DataFrame:
    """Earliest frame of every interval: where a reader starts for a position in it."""
    return frames.groupBy("title_id", _chunk_of("ts_us", every_us).alias("interval_no")).agg(
        F.min("ts_us").alias("ts_us"), F.min_by("frame_idx", "ts_us").alias("frame_idx"))


def vfr_report(frames: DataFrame, jitter: float = 1.2, gap_factor: float = 1.5) -> DataFrame:
    """Frame durations per title; ``is_vfr`` when the longest exceeds the shortest by ``jitter``.

    All figures come from the histogram of durations, and the median by selection of its rank, so a title with ever so
    many different durations is never gathered in one place.
    """
    timed = ordered.with_carry(
        frames.select("title_id", "frame_idx", "ts_us").withColumn(ordered.CHUNK, ordered.frame_chunk()),
        _TITLE, ["frame_idx"], previous={"_prev": F.col("ts_us")})
    hist = checkpointed(timed.where("_prev is not null").groupBy(
        "title_id", (F.col("ts_us") - F.col("_prev")).alias("gap")).agg(F.count(F.lit(1)).alias("n")))
    sizes = hist.groupBy("title_id").agg(F.sum("n").alias("_all"))
    # of an even number of gaps the two in the middle
    ranks = sizes.select("title_id", F.explode(F.array(F.floor((F.col("_all") + 1) / 2), F.floor(F.col("_all") / 2) + 1)).alias("rank")).distinct()
    medians = select_ranks(hist, _TITLE, "gap", ranks).groupBy("title_id").agg(
        ((F.min("gap") + F.max("gap")) / F.lit(2.0)).alias("_median"))
    n, gap = F.col("n"), F.col("gap")
    mean = F.sum(n * gap) / F.sum(n)
    report = hist.join(medians, "title_id").groupBy("title_id").agg(
        F.sum("n").alias("gaps"), F.min("gap").alias("min_gap_us"), F.max("gap").alias("max_gap_us"),
        F.max("_median").alias("median_gap_us"), mean.alias("mean_gap_us"),
        F.sqrt(F.greatest(F.sum(n * gap * gap) / F.sum(n) - mean * mean, F.lit(0.0))).alias("stddev_gap_us"),
        F.sum(F.when(gap > F.col("_median") * gap_factor, n).otherwise(0)).alias("drops"))
    return report.withColumn("is_vfr", F.col("max_gap_us") > F.col("min_gap_us") * F.lit(jitter))


def bit_depth(frames: DataFrame, chunk_us: int = CHUNK_US) -> DataFrame:
    """Bits per channel that a chunk needs, by its brightness."""
    bits = F.when(F.col("brightness") < DIM_6_BIT, 6).when(F.col("brightness") < DIM_7_BIT, 7).otherwise(8)
    return chunks(frames, chunk_us).select("title_id", "chunk_no", "brightness", bits.alias("bits"))


def dark_frames(frames: DataFrame, threshold: float) -> DataFrame:
    """Frames too dark to be worth sending."""
    return frames.where(F.col("lum") < threshold)


def crc_of_frame(body: Column) -> Column:
    return F.crc32(body)


def md5_of_frame(body: Column) -> Column:
    return F.conv(F.substring(F.md5(body), 1, 8), 16, 10).cast("long")


def chunk_checksum(frames: DataFrame, chunk_us: int = CHUNK_US, digest=md5_of_frame) -> DataFrame:
    """Checksum per chunk: the sum of 32-bit digests of "number:timestamp:" and the payload's bytes.

    The frame number is part of the digested text, so the sum notices swapped frames although
    it can be formed in any order.
    """
    head = F.concat(F.col("frame_idx").cast("string"), F.lit(":"), F.col("ts_us").cast("string"), F.lit(":"))
    body = F.concat(head.cast("binary"), F.col("payload"))
    return frames.groupBy("title_id", _chunk_of("ts_us", chunk_us).alias("chunk_no")).agg(
        F.count(F.lit(1)).alias("frames"),
        (F.sum(digest(body)) % F.lit(2 ** 32)).alias("checksum"))


def bad_chunks(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Chunks that are missing on one side or differ."""
    key = ["title_id", "chunk_no"]
    left = expected.select(*key, F.struct("frames", "checksum").alias("_a"))
    right = actual.select(*key, F.struct("frames", "checksum").alias("_b"))
    return left.join(right, key, "full").where(~F.col("_a").eqNullSafe(F.col("_b"))).select(
        *key, F.when(F.col("_a").isNull(), "unexpected").when(F.col("_b").isNull(), "missing")
        .otherwise("damaged").alias("problem"))
