"""Two-level carries against plain windows, with hot keys and tiny chunks."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimlight.operators import ordered
from rimlight.operators import playback as P
from rimlight.operators.timeline import seek_frame


def skewed(spark, n=4000):
    """Two thirds of the rows belong to key 0; positions have gaps and some values are null."""
    i = F.col("id")
    return spark.range(n).select(
        F.when(i % 3 < 2, 0).otherwise(i % 7 + 1).alias("key"), (i * 3 + i % 2).alias("pos"),
        F.when(i % 5 != 0, (i * 7919) % 101).alias("v"))


@pytest.mark.parametrize("size", [1, 7, 512, 10**9])
def test_with_carry_equals_plain_windows(spark, size):
    df = skewed(spark)
    w = Window.partitionBy("key").orderBy("pos")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    expected = df.select(
        "*", F.lag("v").over(w).alias("prev"), F.last("v", ignorenulls=True).over(before).alias("last"),
        F.sum(F.coalesce("v", F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("total"))
    got = ordered.with_carry(
        df.withColumn("chunk", F.floor(F.col("pos") / size)), ["key"], ["pos"], previous={"prev": F.col("v")},
        last_before={"last": F.col("v")}, sums={"total": F.coalesce("v", F.lit(0))}).drop("chunk")
    assert sorted(map(repr, got.select(expected.columns).collect())) == sorted(map(repr, expected.collect()))


def test_row_index(spark):
    rows = ordered.with_row_index(skewed(spark), ["key"], "pos").orderBy("key", "pos").collect()
    seen = {}
    for r in rows:
        assert r.frame_idx == seen.get(r.key, 0)
        seen[r.key] = r.frame_idx + 1


@pytest.mark.parametrize("bucket_us", [1, 100, 10**9])
def test_seek_frame_with_backward_time(spark, bucket_us):
    times = [0, 40, 80, 30, 30, 500, 490, 1000]
    frames = spark.createDataFrame([(1, i, t) for i, t in enumerate(times)], "title_id int, frame_idx long, ts_us long")
    targets = [0, 1, 30, 41, 80, 81, 491, 500, 501, 1000, 1001, 10**7]
    lookups = spark.createDataFrame([(1, t) for t in targets for _ in range(3)], "title_id int, target_us long")
    got = {r.target_us: r.frame_idx for r in seek_frame(frames, lookups, bucket_us).collect()}
    scan = lambda t: next((i for i, x in enumerate(times) if x >= t), len(times) - 1)
    assert got == {t: scan(t) for t in targets}


def test_seek_frame_keeps_every_lookup(spark):
    frames = spark.createDataFrame([(1, 0, 0)], "title_id int, frame_idx long, ts_us long")
    lookups = spark.createDataFrame([(1, 5), (1, 5), (2, 0)], "title_id int, target_us long")
    rows = sorted((r.title_id, r.frame_idx) for r in seek_frame(frames, lookups).collect())
    assert [r for r in rows if r[0] == 1] == [(1, 0), (1, 0)]
    assert [r for r in rows if r[0] == 2] == [(2, None)]


def events(spark, rows):
    return spark.createDataFrame(
        [(i, s, t, k, p, z) for i, (s, t, k, p, z) in enumerate(rows)],
        "event_id long, session_id long, at long, kind string, position_s double, is_paused boolean").select(
        "event_id", F.timestamp_seconds("at").alias("ts"), "session_id", F.lit(1).alias("title_id"), "kind",
        "position_s", "is_paused")


SCRIPT = [
    (1, 0, "progress", 9.0, False),   # before any start: ignored
    (1, 10, "start", 0.0, False),
    (1, 20, "progress", 5.0, False),  # first position: no seek
    (1, 30, "progress", 5.4, False),
    (1, 40, "progress", 99.0, False),  # seek
    (1, 50, "progress", 99.0, True),   # pause
    (1, 60, "progress", 99.5, True),
    (1, 70, "progress", 99.5, False),  # resume
    (1, 80, "stop", 0.0, False),
    (1, 85, "progress", 1.0, True),    # after the stop: ignored
    (1, 90, "start", 0.0, False),
    (1, 95, "progress", 50.0, False),  # first after a stop: no seek
    (1, 100, "start", 0.0, False),     # replaces the running play
    (1, 110, "progress", 50.0, True),  # pause, position unchanged
    (1, 120, "stop", 0.0, False),
]


@pytest.mark.parametrize("chunk_us", [1_000_000, 25_000_000, 10**12])
def test_playback_script(spark, chunk_us):
    ev = events(spark, SCRIPT)
    assert [r.event_id for r in P.seek_events(ev, chunk_us).collect()] == [4]
    changes = {r.event_id: r.change for r in P.pause_changes(ev, chunk_us).collect()}
    assert changes == {5: "pause", 7: "resume", 13: "pause"}
    played = {r.play_no: r.played_s for r in P.played_time(ev, chunk_us).collect()}
    # play 1: seek at 40, then 40..50 and 70..80; play 2: 90..100; play 3: 100..110
    assert played == {1: 20.0, 2: 10.0, 3: 10.0}


def test_chunks_are_spans_of_time_for_every_key(spark):
    ev = events(spark, [(1, t * 60, "progress", 0.0, False) for t in range(50)] + [(2, t * 60, "stop", 0.0, False) for t in range(5)])
    chunks = ev.groupBy("session_id").agg(F.count_distinct(ordered.event_chunk()).alias("n"))
    assert {r.session_id: r.n for r in chunks.collect()} == {1: 50, 2: 5}
