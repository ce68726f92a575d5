"""Records, schemas and fixed values shared by all operators."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# ---- fixed values -------------------------------------------------------------------------
# They have to equal those of existing data files, documents and players; defaults of the two records and the keys included.
BINARY_MAGIC = b"AMb2"
BINARY_HEADER_BYTES = 17  # magic, f32 fps, 4 x u16 counts, u8 format
TIMESTAMP_BYTES = 8
FORMAT_RGBW = 1
FRAME_WIDTH = 320
FRAME_HEIGHT = 180
FALLBACK_FPS = 24.0
FALLBACK_DURATION_S = 60.0
PROGRESS_EVERY_FRAMES = 200
SEEK_JUMP_S = 0.5
TICKS_PER_SECOND = 10_000_000
ITEM_TYPES = ("Movie", "Episode")
LIBRARY_NODE_TYPES = ("CollectionFolder", "UserView")
MIN_ZONE_DEPTH = 12
MAX_ZONE_DEPTH_SHARE = 0.12
GREY_WEIGHTS = (0.299, 0.587, 0.114)
LUMA_WEIGHTS = (2126, 7152, 722)  # ten-thousandths
EDGE_SHARE = 0.7
CENTRE_SHARE = 0.3
MIN_PIXEL_WEIGHT = 0.01


@dataclass(frozen=True)
class Layout:
    """Number of lights per screen side."""

    top: int = 89
    bottom: int = 89
    left: int = 49
    right: int = 49
    rgbw: bool = False

    @property
    def total(self) -> int:
        return self.top + self.right + self.bottom + self.left

    @property
    def channels(self) -> int:
        return 4 if self.rgbw else 3


@dataclass(frozen=True)
class Tuning:
    """Tone and smoothing settings of a display."""

    sync_lead_s: float = 0.2
    smooth_s: float = 0.12
    gamma: float = 2.2
    saturation: float = 1.0
    brightness_target: float = 60.0
    gamma_red: float = 1.0
    gamma_green: float = 1.0
    gamma_blue: float = 1.0
    red_boost: float = 0.0
    green_boost: float = 0.0
    blue_boost: float = 0.0
    min_led_brightness: float = 0.0

    @property
    def tau(self) -> float:
        """Smoothing time constant; 0 switches smoothing off."""
        return 0.0 if self.smooth_s <= 0 else min(max(self.smooth_s, 0.001), 5.0)


# Column of the metadata table -> key of the JSON documents. The creation-date key carries a
# vendor prefix in the field, so readers take it as an argument.
METADATA_KEYS = {
    "item_id": "Id",
    "library_id": "LibraryId",
    "name": "Name",
    "item_type": "Type",
    "kind": "Kind",
    "season": "Season",
    "episode": "Episode",
    "path": "FilePath",
    "date_created": "DateCreated",
    "created_at": "CreatedAt",
    "updated_at": "UpdatedAt",
    "extraction_status": "ExtractionStatus",
    "extraction_error": "ExtractionError",
    "extraction_attempts": "ExtractionAttempts",
    "viewed": "Viewed",
    "extraction_progress": "ExtractionProgress",
    "frames_current": "ExtractionFramesCurrent",
    "frames_total": "ExtractionFramesTotal",
}
# --------------------------------------------------------------------------------------------

METADATA_SCHEMA = T.StructType([
    T.StructField("item_id", T.StringType()),
    T.StructField("library_id", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("item_type", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("season", T.IntegerType()),
    T.StructField("episode", T.IntegerType()),
    T.StructField("path", T.StringType()),
    T.StructField("date_created", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("extraction_status", T.StringType()),
    T.StructField("extraction_error", T.StringType()),
    T.StructField("extraction_attempts", T.IntegerType()),
    T.StructField("viewed", T.BooleanType()),
    T.StructField("extraction_progress", T.IntegerType()),
    T.StructField("frames_current", T.LongType()),
    T.StructField("frames_total", T.LongType()),
])

MAPPING_SCHEMA = T.StructType([
    T.StructField("mapping_order", T.IntegerType()),
    T.StructField("device_identifier", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("port", T.IntegerType()),
    T.StructField("top", T.IntegerType()),
    T.StructField("bottom", T.IntegerType()),
    T.StructField("left", T.IntegerType()),
    T.StructField("right", T.IntegerType()),
    T.StructField("input_position", T.IntegerType()),
])
