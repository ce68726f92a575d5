"""Backlog to light data: which titles are due, and the colours of their frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.functions import media
from rimlight.model import Layout
from rimlight.operators.backlog import backlog, pending_items
from rimlight.operators.zone_kernel import frame_zone_colors


def extraction_backlog(
    catalog: DataFrame, binaries: DataFrame, excluded: DataFrame, files: DataFrame | None,
    order: str = "newest_first", stored: DataFrame | None = None,
) -> DataFrame:
    return backlog(pending_items(catalog, binaries, excluded, files, stored), order)


def extract_lights(frames: DataFrame, pending: DataFrame, layout: Layout, width: int, height: int) -> DataFrame:
    """Light frames of all pending titles, in parallel over frames rather than title by title."""
    due = frames.join(pending.select("title_id"), "title_id", "left_semi")
    return frame_zone_colors(due, layout, width, height)


def finish_items(items: DataFrame, outcome: DataFrame, now: Column) -> DataFrame:
    """Metadata after a run. ``outcome(item_id, frames, frames_total, cancelled, error)``.

    Cancelled: pending again. An error, or nothing written: failed, with the reason. Otherwise
    completed. Every run counts as an attempt.
    """
    ok = F.col("o.error").isNull() & (F.coalesce(F.col("o.frames"), F.lit(0)) > 0)
    cancelled = F.coalesce(F.col("o.cancelled"), F.lit(False))
    status = F.when(cancelled, "pending").when(ok, "completed").otherwise("failed")
    error = F.when(~cancelled & ~ok, F.coalesce(F.col("o.error"), F.lit("no frames written")))
    frames = F.when(cancelled, F.lit(0)).otherwise(F.coalesce(F.col("o.frames"), F.lit(0))).cast("long")
    total = F.when(cancelled, F.lit(0)).otherwise(F.coalesce(F.col("o.frames_total"), F.lit(0))).cast("long")
    ran = outcome.select("item_id", F.struct("frames", "frames_total", "cancelled", "error").alias("o"))
    return items.join(ran, "item_id").withColumns({
        "extraction_status": status, "extraction_error": error,
        "frames_current": frames, "frames_total": total,
        "extraction_progress": media.progress_pct(frames, total),
        "extraction_attempts": F.col("extraction_attempts") + 1, "updated_at": now,
    }).drop("o")
