"""Zone colours of packed frames: one row in, one row out, no shuffle.

All zone pixels of a batch of frames are handled as flat numpy arrays. The index tables depend
on the layout only and travel with the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimlight.model import (
    CENTRE_SHARE,
    EDGE_SHARE,
    FRAME_HEIGHT,
    FRAME_WIDTH,
    GREY_WEIGHTS,
    MIN_PIXEL_WEIGHT,
    Layout,
)
from rimlight.operators.zones import zone_table

# Frames per numpy pass: about 150 bytes of scratch per zone pixel and frame.
FRAMES_PER_PASS = 8


class ZoneIndex:
    """Zone pixels of a layout as one flat list: where they lie, their neighbours, their weights.

    Neighbours stay inside the zone, so they are positions in the same list.
    """

    def __init__(self, layout: Layout, width: int, height: int):
        self.layout = layout
        rects = zone_table(layout, width, height)
        self.used = [i for i, (x1, y1, x2, y2) in enumerate(rects) if x2 > x1 and y2 > y1]
        parts: dict[str, list[np.ndarray]] = {
            k: [] for k in ("pixel", "left", "right", "up", "down", "centre", "zone")}
        self.starts, size = [], 0
        for zone, led in enumerate(self.used):
            x1, y1, x2, y2 = rects[led]
            w, h = x2 - x1, y2 - y1
            y, x = np.mgrid[0:h, 0:w]

            def at(dx: int, dy: int) -> np.ndarray:
                return size + np.clip(y + dy, 0, h - 1) * w + np.clip(x + dx, 0, w - 1)

            sigma = max(min(w, h) / 4.0, 1.0)
            dist = (x - w // 2) ** 2 + (y - h // 2) ** 2
            values = {
                "pixel": (y + y1) * width + x + x1, "left": at(-1, 0), "right": at(1, 0),
                "up": at(0, -1), "down": at(0, 1), "centre": np.exp(-dist / (2.0 * sigma * sigma)),
                "zone": np.full((h, w), zone),
            }
            for k, v in values.items():
                parts[k].append(v.ravel())
            self.starts.append(size)
            size += w * h
        if not size:
            return
        flat = {k: np.concatenate(v) for k, v in parts.items()}
        self.pixel, self.zone = flat["pixel"], flat["zone"]
        self.left, self.right, self.up, self.down = (flat[k] for k in ("left", "right", "up", "down"))
        self.centre = flat["centre"][:, None] * CENTRE_SHARE

    def colors(self, rgb: np.ndarray) -> np.ndarray:
        """(frames, bytes) -> (frames, lights, channels). Inside, the frames are the last axis, so
        that a pixel's values of all frames lie together."""
        frames = rgb.shape[0]
        out = np.zeros((frames, self.layout.total, self.layout.channels), dtype=np.uint8)
        if not self.used:
            return out
        by_pixel = np.ascontiguousarray(rgb.T).reshape(-1, 3, frames)[self.pixel]
        channels = [by_pixel[:, c].astype(np.float64) for c in range(3)]
        kr, kg, kb = GREY_WEIGHTS
        grey = channels[0] * kr + channels[1] * kg + channels[2] * kb
        left, right = grey[self.left], grey[self.right]
        along = right - left
        across = left + 2.0 * grey + right
        gx = along[self.up] + 2.0 * along + along[self.down]
        gy = across[self.down] - across[self.up]
        edge = np.sqrt(gx * gx + gy * gy)
        strongest = np.maximum.reduceat(edge, self.starts, axis=0)
        strongest[strongest == 0] = 1.0
        edge /= strongest[self.zone]
        weight = np.maximum(edge * EDGE_SHARE + self.centre, MIN_PIXEL_WEIGHT)
        total = np.add.reduceat(weight, self.starts, axis=0)
        mean = np.stack([
            np.add.reduceat(weight * c, self.starts, axis=0) / total for c in channels], axis=2)
        color = np.clip(np.rint(mean), 0, 255).astype(np.uint8).transpose(1, 0, 2)
        if self.layout.rgbw:
            white = color.min(axis=2, keepdims=True)
            color = np.concatenate([color - white, white], axis=2)
        out[:, self.used] = color
        return out


def frame_zone_colors(
    frames: DataFrame, layout: Layout, width: int = FRAME_WIDTH, height: int = FRAME_HEIGHT,
) -> DataFrame:
    """``frames(title_id, frame_idx, ts_us, pixels)`` -> ``(title_id, frame_idx, ts_us, payload)``.

    Frames of the wrong size are dropped. A frame is 172 800 bytes at working size, so sessions
    should keep ``spark.sql.execution.arrow.maxRecordsPerBatch`` near 256.
    """
    size = width * height * 3

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = ZoneIndex(layout, width, height)
        for batch in batches:
            pixels = batch.column("pixels")
            payloads: list[bytes] = []
            for at in range(0, batch.num_rows, FRAMES_PER_PASS):
                part = [np.frombuffer(p.as_buffer(), dtype=np.uint8)
                        for p in pixels.slice(at, FRAMES_PER_PASS)]
                payloads.extend(row.tobytes() for row in index.colors(np.stack(part)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("title_id"), batch.column("frame_idx"), batch.column("ts_us"),
                 pa.array(payloads, pa.binary())],
                names=["title_id", "frame_idx", "ts_us", "payload"])

    return (
        frames.where(F.length("pixels") == size)
        .select("title_id", "frame_idx", "ts_us", "pixels")
        .mapInArrow(run, T.StructType([*[frames.schema[c] for c in ("title_id", "frame_idx", "ts_us")], T.StructField("payload", T.BinaryType())]))
    )
