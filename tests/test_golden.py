"""Fixed values worked out by hand or by a direct loop."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimlight.functions import color, ids, media, packed
from rimlight.model import Layout, Tuning
from rimlight.operators.display_kernel import finish_values, smooth_values, tone_values
from rimlight.operators.zone_kernel import ZoneIndex, frame_zone_colors
from rimlight.operators.zones import layout_frame, zone_colors, zone_pixels, zone_rects, zone_table


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first()


@pytest.mark.parametrize("layout, zones, first, index_t, last, pixels, distinct", [
    (Layout(), 276, (0, 0, 3, 12), (308, 0, 320, 3), (0, 0, 12, 3), 12_000, 11_424),
    (Layout(4, 4, 2, 2), 12, (0, 0, 80, 21), (282, 0, 320, 90), (0, 0, 38, 90), 27_120, 23_928),
])
def test_geometry(spark, layout, zones, first, index_t, last, pixels, distinct):
    rects = [tuple(r[2:]) for r in zone_rects(layout_frame(spark, layout, 320, 180)).drop("layout_id").orderBy(
        "led_idx").select("led_idx", "side", "x1", "y1", "x2", "y2").collect()]
    assert rects == zone_table(layout, 320, 180)
    assert (len(rects), rects[0], rects[layout.top], rects[-1]) == (zones, first, index_t, last)
    lookup = zone_pixels(spark, layout, 320, 180)
    assert lookup.count() == pixels
    assert lookup.select("x", "y").distinct().count() == distinct


def test_geometry_with_empty_zones(spark):
    rects = zone_table(Layout(400, 0, 0, 0), 320, 180)
    empty = [r for r in rects if r[2] <= r[0]]
    assert (len(rects), len(empty), rects[0], rects[-1]) == (400, 80, (0, 0, 0, 12), (319, 0, 320, 12))
    assert zone_pixels(spark, Layout(400, 0, 0, 0), 320, 180).count() == 3_840


@pytest.mark.parametrize("layout, size", [
    (Layout(7, 3, 5, 2), (48, 27)), (Layout(1, 1, 1, 1), (5, 4)), (Layout(0, 9, 0, 4), (640, 360)),
    (Layout(50, 60, 70, 80), (33, 17))])
def test_geometry_agrees_with_task_table(spark, layout, size):
    rows = zone_rects(layout_frame(spark, layout, *size)).orderBy("led_idx").collect()
    clipped = [(max(r.x1, 0), max(r.y1, 0), min(r.x2, size[0]), min(r.y2, size[1])) for r in rows]
    assert clipped == zone_table(layout, *size)


def pattern(frame):
    y, x = np.mgrid[0:180, 0:320]
    return (np.stack([x * 7 + y * 13 + frame * 31, x * x + y * 5 + frame * 17, x * 3 + y * y + frame * 53], axis=2)
            % 256).astype(np.uint8)


GOLDEN = [(129, 126, 132), (129, 122, 126), (128, 128, 128), (126, 125, 131), (127, 128, 130), (128, 128, 135),
          (126, 127, 126), (127, 128, 129), (129, 126, 127), (130, 128, 124), (127, 127, 121), (128, 128, 127)]


def test_zone_colors_of_pattern(spark):
    index = ZoneIndex(Layout(4, 4, 2, 2), 320, 180)
    assert [tuple(map(int, c)) for c in index.colors(pattern(0).reshape(1, -1))[0]] == GOLDEN
    x, y = F.col("x"), F.col("y")
    pixels = spark.range(320).select(F.col("id").cast("int").alias("x")).withColumn(
        "y", F.explode(F.sequence(F.lit(0), F.lit(179)))).select(
        F.lit(0).alias("title_id"), F.lit(0).alias("frame_idx"), "x", "y", ((x * 7 + y * 13) % 256).alias("r"),
        ((x * x + y * 5) % 256).alias("g"), ((x * 3 + y * y) % 256).alias("b"))
    rows = zone_colors(pixels, Layout(4, 4, 2, 2), 320, 180).orderBy("led_idx").collect()
    assert [(r.r, r.g, r.b) for r in rows] == GOLDEN


def direct_zone(frame, rect):
    """Plain loop over the pixels of one zone."""
    x1, y1, x2, y2 = rect
    grey = frame.astype(float) @ np.array([0.299, 0.587, 0.114])
    mag = {}
    for y in range(y1, y2):
        for x in range(x1, x2):
            at = lambda dx, dy: grey[min(max(y + dy, y1), y2 - 1), min(max(x + dx, x1), x2 - 1)]
            gx = at(1, -1) + 2 * at(1, 0) + at(1, 1) - at(-1, -1) - 2 * at(-1, 0) - at(-1, 1)
            gy = at(-1, 1) + 2 * at(0, 1) + at(1, 1) - at(-1, -1) - 2 * at(0, -1) - at(1, -1)
            mag[x, y] = math.sqrt(gx * gx + gy * gy)
    top = max(mag.values()) or 1.0
    w, h = x2 - x1, y2 - y1
    sigma = max(min(w, h) / 4, 1.0)
    total, acc = 0.0, np.zeros(3)
    for (x, y), m in mag.items():
        d = (x - x1 - w // 2) ** 2 + (y - y1 - h // 2) ** 2
        k = max(0.7 * m / top + 0.3 * math.exp(-d / (2 * sigma * sigma)), 0.01)
        acc += k * frame[y, x]
        total += k
    return tuple(int(v) for v in np.rint(acc / total))


def test_kernel_against_direct_loop():
    rng = np.random.default_rng(5)
    frame = rng.integers(0, 256, (45, 80, 3), dtype=np.uint8)
    frame[:, 40:] = 10  # a hard vertical edge, flat on one side
    layout = Layout(6, 5, 4, 3)
    got = ZoneIndex(layout, 80, 45).colors(frame.reshape(1, -1))[0]
    for led, rect in enumerate(zone_table(layout, 80, 45)):
        assert tuple(map(int, got[led])) == direct_zone(frame, rect), led


@pytest.mark.parametrize("rgb, expected", [((10, 20, 30), (0, 10, 20, 10)), ((0, 0, 0), (0, 0, 0, 0))])
def test_uniform_frame(spark, rgb, expected):
    data = bytes(rgb) * (320 * 180)
    frames = spark.createDataFrame([(1, 0, 0, data), (1, 1, 41666, data[:-1])],
                                   "title_id int, frame_idx long, ts_us long, pixels binary")
    rows = frame_zone_colors(frames, Layout(rgbw=True)).collect()
    assert len(rows) == 1  # the incomplete frame is gone
    assert bytes(rows[0].payload) == bytes(expected) * 276
    plain = frame_zone_colors(frames, Layout()).first().payload
    assert bytes(plain) == bytes(rgb) * 276


@pytest.mark.parametrize("rgb, tuning, lum, gamma, factor, out", [
    ((128, 128, 128), Tuning(), 128.0, 1.537412, 0.628125, (102.3031,) * 3),
    ((200, 40, 10), Tuning(), 71.85, 1.828071, 0.884551, (197.4906, 81.8828, 38.3575)),
    ((5, 5, 5), Tuning(), 5.0, 2.174118, 2.5, (75.2323,) * 3),
    ((200, 40, 10), Tuning(saturation=3.0), 71.85, 1.828071, 0.884551, (225.5605, 0.0, 0.0)),
])
def test_tone(spark, rgb, tuning, lum, gamma, factor, out):
    r, g, b = (F.lit(v) for v in rgb)
    light = (color.luma_points(r, g, b) / 10_000)
    row = one(spark, lum=light, gamma=color.adaptive_gamma(light, tuning.gamma),
              factor=color.brightness_factor(light, tuning.brightness_target),
              t=color.tune_color(r, g, b, light, tuning))
    assert row.lum == pytest.approx(lum)
    assert row.gamma == pytest.approx(gamma, abs=1e-5)
    assert row.factor == pytest.approx(factor, abs=1e-5)
    assert tuple(row.t) == pytest.approx(out, abs=1e-3)
    kernel = tone_values(np.array([[rgb]], dtype=np.uint8), tuning)[0, 0]
    assert tuple(kernel) == pytest.approx(tuple(row.t), abs=1e-9)


def test_rounding_is_half_even(spark):
    row = one(spark, a=color.clamp_byte(F.lit(2.5)), b=color.clamp_byte(F.lit(3.5)), c=color.clamp_byte(F.lit(-4.0)),
              d=color.clamp_byte(F.lit(256.5)))
    assert tuple(row) == (2, 4, 0, 255)


def test_clamp_of_nan(spark):
    nan = F.lit(float("nan"))
    row = one(spark, a=color.clampf(nan, 0.0, 1.0), b=color.clampf(F.lit(2.0), 0.0, 1.0), c=color.clampf(F.lit(-2.0), 0.0, 1.0))
    assert tuple(row) == (0.0, 1.0, 0.0)


def test_gamma_clamps(spark):
    row = one(spark, low=color.adaptive_gamma(F.lit(0.0), 0.1), high=color.adaptive_gamma(F.lit(0.0), 9.0))
    assert tuple(row) == (1.0, 3.0)


def test_floor_and_blackout(spark):
    tuning = Tuning(min_led_brightness=20.0, red_boost=2.0)
    row = one(spark, o=color.floor_and_blackout(F.lit(5.0), F.lit(0.4), F.lit(0.0), tuning),
              p=color.floor_and_blackout(F.lit(5.0), F.lit(30.0), F.lit(0.0), tuning))
    assert tuple(row.o) == (0, 0, 0)  # 0.2126 * 40 is below half the floor
    assert tuple(row.p) == (40, 30, 0)
    acc = np.array([[[5.0, 0.4, 0.0], [5.0, 30.0, 0.0]]])
    assert finish_values(acc, tuning)[0].tolist() == [[0, 0, 0], [40, 30, 0]]


def test_smoothing_off_is_identity():
    values = np.arange(24, dtype=float).reshape(2, 4, 3)
    assert (smooth_values(values.copy(), values[0] * 0, np.array([0.1, 0.1]), 0.0) == values).all()


@pytest.mark.parametrize("text, rate", [
    ("24000/1001", 23.976024627685547), ("30/1", 30.0), ("0/0", 24.0), ("abc", 24.0), ("25", 24.0), ("200/1", 24.0),
    ("-30/1", 24.0), (" 25/1\n", 25.0), ("1/2/3", 24.0), ("", 24.0)])
def test_parse_fps(spark, text, rate):
    assert one(spark, v=media.parse_fps(F.lit(text))).v == rate


def test_frame_timestamps_use_single_precision(spark):
    rows = spark.range(3).select(media.frame_ts(F.col("id"), F.lit(24000 / 1001)).alias("t")).collect()
    rate = 23.976024627685547
    assert [r.t for r in rows] == [int(i * 1e6 / rate) for i in range(3)]


@pytest.mark.parametrize("text, guid", [
    ("0123456789ABCDEF0123456789abcdef", "0123456789abcdef0123456789abcdef"),
    ("{01234567-89ab-cdef-0123-456789abcdef}", "0123456789abcdef0123456789abcdef"),
    ("(01234567-89ab-cdef-0123-456789abcdef)", "0123456789abcdef0123456789abcdef"),
    ("{0x01234567,0x89ab,0xcdef,{0x01,0x23,0x45,0x67,0x89,0xab,0xcd,0xef}}", "0123456789abcdef0123456789abcdef"),
    ("{01234567-89ab-cdef-0123-456789abcdef", None), ("0123", None), ("", None), (None, None),
    ("0123456789abcdef-0123456789abcdef", None)])
def test_canon_guid(spark, text, guid):
    assert one(spark, v=ids.canon_guid(F.lit(text).cast("string"))).v == guid


@pytest.mark.parametrize("plain, stripped", [
    ("Browser|1600000000000", "Browser"), ("a|b|1", "a|b"), ("|123", None), ("agent|1234567890123456789", "agent"),
    ("agent|12345678901234567890", None), ("no pipe", None), ("x" * 120 + "|1", "x" * 120), ("agent|", "agent"),
    ("Ünï|1", "Ünï")])
def test_strip_device_ts(spark, plain, stripped):
    import base64

    encode = lambda s: base64.b64encode(s.encode()).decode()
    raw = encode(plain)
    assert one(spark, v=ids.strip_device_ts(F.lit(raw))).v == (raw if stripped is None else encode(stripped))


@pytest.mark.parametrize("text", ["not base64!", "", "abc", "Room 1"])
def test_strip_device_ts_leaves_other_text(spark, text):
    assert one(spark, v=ids.strip_device_ts(F.lit(text))).v == text


def test_packing(spark):
    values = list(range(0, 256, 5))
    row = one(spark, p=packed.pack_bytes(F.array(*[F.lit(v) for v in values])))
    assert bytes(row.p) == bytes(values)
    back = one(spark, v=packed.unpack_bytes(F.lit(bytearray(values))), none=packed.unpack_bytes(F.lit(bytearray())))
    assert back.v == values and back.none == []


def test_rotation(spark):
    data = bytearray(range(12))
    row = one(spark, same=packed.rotate_payload(F.lit(data), packed.rotation(F.lit(-8), F.lit(4)), 3),
              by1=packed.rotate_payload(F.lit(data), packed.rotation(F.lit(-1), F.lit(4)), 3))
    assert bytes(row.same) == bytes(data)
    assert bytes(row.by1) == bytes(data[3:] + data[:3])
