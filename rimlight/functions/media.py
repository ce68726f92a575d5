"""Column functions on ticks, frame rates, progress and display geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rimlight.model import FALLBACK_DURATION_S, FALLBACK_FPS, TICKS_PER_SECOND


def ticks_to_seconds(ticks: Column) -> Column:
    return F.coalesce(ticks, F.lit(0)) / F.lit(float(TICKS_PER_SECOND))


def progress_pct(current: Column, total: Column, unknown: Column | int = 0) -> Column:
    """Whole percent done, at most 99; ``unknown`` is the answer when no total is known."""
    unknown = unknown if isinstance(unknown, Column) else F.lit(unknown)
    done = F.call_function("div", current * 100, F.nullif(total, F.lit(0)))
    return F.when(total > 0, F.least(F.lit(99), done).cast("int")).otherwise(unknown)


def parse_fps(text: Column) -> Column:
    """Frame rate of a "num/den" string as a single-precision value; 24 when implausible."""
    part = F.split(F.trim(text), "/")
    num = F.trim(F.get(part, F.lit(0))).try_cast("int")
    den = F.trim(F.get(part, F.lit(1))).try_cast("int")
    fps = (num.cast("float") / F.nullif(den, F.lit(0)).cast("float")).cast("float")
    valid = (F.size(part) == 2) & (den > 0) & (fps > 0) & (fps < 200)
    return F.when(valid, fps).otherwise(F.lit(FALLBACK_FPS).cast("float")).cast("double")


def estimate_frames(duration_s: Column, fps: Column) -> Column:
    """Expected frame count, with the usual fallbacks for missing values."""
    seconds = F.coalesce(duration_s, F.lit(FALLBACK_DURATION_S))
    rate = F.coalesce(fps, F.lit(FALLBACK_FPS))
    return F.floor(seconds * rate).cast("long")


def frame_ts(frame_idx: Column, fps: Column) -> Column:
    """Timestamp in microseconds; the rate is single precision, as in the file header."""
    return F.floor(frame_idx * F.lit(1_000_000.0) / fps.cast("float").cast("double")).cast("long")


def target_count(wanted: Column, source: Column) -> Column:
    """Lights on one side of a target: its own count, else that of the source, at least 1."""
    return F.when(wanted > 0, wanted).otherwise(F.greatest(F.lit(1), source))


def start_target_us(start_s: Column, lead_s: float) -> Column:
    """Where playback starts; the lead applies to starts only."""
    return _us(F.greatest(F.lit(0.0), start_s + F.lit(lead_s)))


def seek_target_us(position_s: Column) -> Column:
    return _us(F.greatest(F.lit(0.0), position_s))


def _us(seconds: Column) -> Column:
    return F.floor(seconds * F.lit(1_000_000.0)).cast("long")


def send_at_us(ts_us: Column, base_ts_us: Column) -> Column:
    """Offset from the first displayed frame."""
    return F.greatest(F.lit(0).cast("long"), ts_us - base_ts_us)


def bytes_to_mb(size: Column) -> Column:
    return size / F.lit(1024.0) / F.lit(1024.0)
