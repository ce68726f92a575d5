"""A table of light frames with its seek index beside it: positions are found in the index, frames only where it is needed.

The index has one row per title and interval of time: how its frames and timestamps begin and end. For a position,
the later intervals answer from the index alone, and so does its own interval unless the position falls inside.
Frames are read of those intervals only: as filters on title and time that reach the pages of the files while there
are at most ``PUSHED`` intervals, and by a semi-join beyond.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimlight.operators.compaction import CHUNK_US, seek_index
from rimlight.session import checkpointed
from rimlight.sources.tables import PAGE_ROWS, write_light_frames

#: Intervals whose limits are pushed into the scan as filters.
PUSHED = 200


def write_indexed_frames(frames: DataFrame, path: str, every_us: int = CHUNK_US, page_rows: int = PAGE_ROWS) -> None:
    """Frames below ``path/frames``, and ``path/index`` made from what was written."""
    write_light_frames(frames, f"{path}/frames", page_rows=page_rows)
    written = frames.sparkSession.read.parquet(f"{path}/frames").select("title_id", "frame_idx", "ts_us")
    limits = written.groupBy("title_id", F.floor(F.col("ts_us") / F.lit(every_us)).cast("long").alias("interval_no")).agg(
        F.min("frame_idx").alias("min_frame"), F.max("frame_idx").alias("max_frame"), F.max("ts_us").alias("max_ts_us"))
    rows = seek_index(written, every_us).join(limits, ["title_id", "interval_no"]).withColumn("every_us", F.lit(every_us).cast("long"))
    rows.repartitionByRange("title_id", "interval_no").sortWithinPartitions("title_id", "interval_no").write.parquet(f"{path}/index")


def frames_of_intervals(frames: DataFrame, intervals: DataFrame, every_us: int, pushed: int = PUSHED) -> DataFrame:
    """Frames of the (title, interval) pairs of a stored table."""
    few = intervals.limit(pushed + 1).collect()
    if len(few) <= pushed:

        def inside(r) -> Column:  # noqa: ANN001
            at = r.interval_no * every_us
            return (F.col("title_id") == r.title_id) & (F.col("ts_us") >= at) & (F.col("ts_us") < at + every_us)

        return frames.where(reduce(lambda a, b: a | b, map(inside, few), F.lit(False)))
    return frames.withColumn("interval_no", F.floor(F.col("ts_us") / F.lit(every_us)).cast("long")).join(
        intervals, ["title_id", "interval_no"], "left_semi").drop("interval_no")


def seek_indexed(spark: SparkSession, path: str, lookups: DataFrame, pushed: int = PUSHED) -> DataFrame:
    """Add ``frame_idx`` to ``lookups(title_id, target_us)``: the first frame at or after the time, past the end the last one."""
    index = spark.read.parquet(f"{path}/index")
    first = index.select("every_us").first()
    if first is None:
        return lookups.withColumn("frame_idx", F.lit(None).cast("long"))
    every = first.every_us
    wanted = lookups.select("title_id", "target_us").distinct().withColumn(
        "interval_no", F.floor(F.col("target_us") / F.lit(every)).cast("long"))
    # lookups take their place among the intervals of the title; a window over index rows, never over frames
    mixed = index.select("title_id", "interval_no", "min_frame", "max_frame").unionByName(
        wanted.select("title_id", "interval_no").distinct(), allowMissingColumns=True)
    across = Window.partitionBy("title_id").orderBy("interval_no")
    later = F.min("min_frame").over(across.rangeBetween(1, Window.unboundedFollowing))
    last = F.max("max_frame").over(Window.partitionBy("title_id"))
    around = mixed.withColumns({"_later": later, "_last": last}).groupBy("title_id", "interval_no").agg(
        F.first("_later").alias("_later"), F.first("_last").alias("_last"))
    own = index.select("title_id", "interval_no", F.col("ts_us").alias("_min_ts"), F.col("max_ts_us").alias("_max_ts"), F.col("min_frame").alias("_min_frame"))
    placed = checkpointed(wanted.join(around, ["title_id", "interval_no"]).join(own, ["title_id", "interval_no"], "left").withColumns({
        "_whole": F.when(F.col("_min_ts") >= F.col("target_us"), F.col("_min_frame")),
        "_inside": F.coalesce((F.col("_min_ts") < F.col("target_us")) & (F.col("target_us") <= F.col("_max_ts")), F.lit(False))}))
    needed = checkpointed(placed.where("_inside").select("title_id", "interval_no").distinct())
    frames = frames_of_intervals(spark.read.parquet(f"{path}/frames").select("title_id", "frame_idx", "ts_us"), needed, every, pushed)
    found = frames.withColumn("interval_no", F.floor(F.col("ts_us") / F.lit(every)).cast("long")).join(
        placed.where("_inside").select("title_id", "interval_no", "target_us"), ["title_id", "interval_no"]).where(
        "ts_us >= target_us").groupBy("title_id", "target_us").agg(F.min("frame_idx").alias("_found"))
    answer = placed.join(found, ["title_id", "target_us"], "left").select(
        "title_id", "target_us", F.coalesce(F.least("_whole", "_found", "_later"), F.col("_last")).alias("frame_idx"))
    return lookups.join(answer, ["title_id", "target_us"], "left")
