"""The moving average in its two forms against the plain recurrence."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rimlight.model import Tuning
from rimlight.operators.display_kernel import finish_values, smooth_frames, smooth_values, tone_values
from rimlight.operators.timeline import frame_clock
from rimlight.operators.tone import resample_leds, smooth


def sequence(n=700, seed=3):
    """Irregular timestamps: repeats, steps back, long pauses."""
    rng = random.Random(seed)
    ts, out = 0, []
    for i in range(n):
        out.append((1, i, ts, rng.randrange(256)))
        ts += rng.choice([0, -5_000, 1_000, 40_000, 41_666, 300_000, 15_000_000 if i % 97 == 5 else 33_333])
    return out


def recurrence(rows, tau, fps=24.0):
    acc, out = float(rows[0][3]), []
    for i, (_, _, ts, v) in enumerate(rows):
        dt = (ts - rows[i - 1][2]) / 1e6 if i else 0.0
        dt = dt if dt > 0 else 1 / fps
        k = 1 - math.exp(-dt / tau) if tau > 0 else 1.0
        acc = acc * (1 - k) + (v * 0.5) * k
        out.append(acc)
    return out


@pytest.mark.parametrize("tau", [0.0, 0.001, 0.12, 5.0])
def test_smooth_equals_recurrence(spark, tau):
    data = sequence()
    frames = spark.createDataFrame(data, "title_id int, frame_idx long, ts_us long, v int")
    rates = spark.createDataFrame([(1, 24.0)], "title_id int, fps double")
    rows = frame_clock(frames, rates).withColumn("x", F.col("v") * 0.5)
    got = smooth(rows, ["title_id"], {"a": ("x", "v")}, tau).orderBy("frame_idx").collect()
    assert [r.a for r in got] == pytest.approx(recurrence(data, tau), abs=1e-9)


@pytest.mark.parametrize("tau", [0.0, 0.12, 5.0])
@pytest.mark.parametrize("chunk_frames", [1, 16, 4096])
def test_kernel_chunks_do_not_matter(spark, tau, chunk_frames):
    rng = np.random.default_rng(1)
    data = sequence()
    payloads = rng.integers(0, 256, (len(data), 4, 3), dtype=np.uint8)
    rows = [(*d[:3], bytearray(p.tobytes())) for d, p in zip(data, payloads)]
    frames = spark.createDataFrame(rows, "title_id int, frame_idx long, ts_us long, payload binary")
    rates = spark.createDataFrame([(1, 24.0)], "title_id int, fps double")
    tuning = Tuning(smooth_s=tau)
    timed = frame_clock(frames, rates).withColumns(
        {"channels": F.lit(3), "total_tgt": F.lit(6), "turn": F.lit(2)})
    got = {r.frame_idx: bytes(r.payload) for r in smooth_frames(timed, ["title_id"], tuning, chunk_frames).collect()}
    dt = np.array([(data[i][2] - data[i - 1][2]) / 1e6 if i else 0.0 for i in range(len(data))])
    dt[dt <= 0] = 1 / 24
    acc = smooth_values(tone_values(payloads, tuning), payloads[0], dt, tuning.tau)
    light = [t * 4 // 6 for t in range(6)]
    expected = np.roll(finish_values(acc, tuning)[:, light], -2, axis=1)
    assert got == {i: e.tobytes() for i, e in enumerate(expected)}


def test_resample_to_same_count_is_identity(spark):
    samples = spark.createDataFrame([(1, 0, i, i * 3) for i in range(16)], "title_id int, frame_idx long, led_idx int, r int")
    target = spark.createDataFrame([(1, 9, 16, 16), (1, 8, 16, 0)], "title_id int, target_id int, total_src int, total_tgt int")
    rows = resample_leds(samples, target).collect()
    assert sorted((r.tgt_led, r.r) for r in rows) == [(i, i * 3) for i in range(16)]
