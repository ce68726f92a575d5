"""Light frames and display frames as Parquet tables.

Rows are range-partitioned by title and frame number and sorted inside the files, so a large
title spreads over many files, and a filter on title and frames or time skips row groups.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows of a Parquet page of light frames: the least that a filtered scan reads of a file.
PAGE_ROWS = 1024


def write_light_frames(frames: DataFrame, path: str, mode: str = "errorifexists", page_rows: int = PAGE_ROWS) -> None:
    order = ["title_id", "frame_idx"]
    frames.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).option(
        "parquet.page.row.count.limit", str(page_rows)).parquet(path)


def read_light_frames(
    spark: SparkSession, path: str, titles: list | None = None, from_us: int | None = None, to_us: int | None = None,
) -> DataFrame:
    """Frames of a table; title and time limits are pushed into the scan."""
    frames = spark.read.parquet(path)
    if titles is not None:
        frames = frames.where(F.col("title_id").isin(titles))
    if from_us is not None:
        frames = frames.where(F.col("ts_us") >= from_us)
    if to_us is not None:
        frames = frames.where(F.col("ts_us") < to_us)
    return frames


def write_display_frames(displayed: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """In sending order per target: a sender reads its files front to back."""
    order = ["host", "port", "session_id", "frame_idx"]
    displayed.repartitionByRange(*order).sortWithinPartitions(*order).write.mode(mode).parquet(path)
