"""Cases the registered queries do not reach: blank paths, late events, text ids, empty streams, short payloads."""

from pyspark.sql import functions as F
from test_ordered import events
from test_streams import stream

from rimlight.operators import backlog as B
from rimlight.plans import display, extraction
from rimlight.session import fresh_folder
from rimlight.sources import derived as D
from rimlight.streaming import playback as S
from rimlight.streaming.tables import read_events, run_to_table


def changes(spark, ev, cut, **how):
    out = run_to_table(S.stream_changes(stream(spark, [ev.where(F.col("event_id") < cut), ev.where(F.col("event_id") >= cut)], 1), **how))
    return sorted((r.event_id, r.change) for r in out.collect())


def test_late_events_after_a_stop_stay_late(spark):
    ev = events(spark, [(1, 10, "start", 0.0, False), (1, 100, "stop", 0.0, False), (1, 50, "start", 0.0, False), (1, 120, "start", 0.0, False)])
    assert changes(spark, ev, 2) == [(0, "open"), (1, "close"), (2, "late"), (3, "open")]


def test_idle_sessions_are_forgotten(spark):
    day = 86_400
    ev = events(spark, [(1, 10, "start", 0.0, False), (2, 40 * day, "start", 0.0, False), (1, 41 * day, "stop", 0.0, False)])
    src = stream(spark, [ev.where("event_id = 0"), ev.where("event_id = 1"), ev.where("event_id = 2")], 1)
    assert sorted((r.event_id, r.change) for r in run_to_table(S.stream_changes(src, idle="2 days")).collect()) == [(0, "open"), (1, "open")]


def test_text_ids_in_streams(spark):
    ev = events(spark, [(1, 10, "start", 0.0, False), (1, 20, "progress", 1.0, False), (1, 30, "progress", 9.0, True)])
    text = ev.withColumns({"session_id": F.concat(F.lit("s"), "session_id"), "title_id": F.md5(F.col("title_id").cast("string"))})
    out = run_to_table(S.stream_changes(stream(spark, [text.where("event_id < 2"), text.where("event_id >= 2")], 1)))
    assert sorted((r.session_id, r.change, len(r.title_id)) for r in out.collect()) == [("s1", "open", 32), ("s1", "pause", 32), ("s1", "seek", 32)]


def test_an_empty_stream_gives_an_empty_table(spark):
    folder = fresh_folder(spark, "none")
    ev = events(spark, [(1, 10, "start", 0.0, False)])
    ev.limit(0).write.parquet(folder)
    assert run_to_table(S.stream_changes(read_events(spark, folder, ev.schema))).count() == 0


def test_sync_skips_missing_paths_and_takes_over_blank_ones(spark, sf_dir):
    now = F.lit("2025-01-01 00:00:00").cast("timestamp")
    cat = spark.createDataFrame([("a", "l", "A", "Movie", "", None), ("b", "l", "B", "Movie", None, None), ("c", "l", None, "Episode", "/c", None)],
                                "item_id string, library_id string, name string, item_type string, path string, date_created string")
    stored = D.metadata_items(spark, sf_dir).limit(1).withColumns({"item_id": F.lit("c"), "name": F.lit("Known"), "path": F.lit("/old")})
    none = spark.createDataFrame([], "library_id string")
    rows = {r.item_id: (r.path, r.name) for r in B.sync_catalog(cat, stored, none, now).collect()}
    assert rows == {"a": ("", "A"), "c": ("/c", "Known")}
    bins = spark.createDataFrame([], "item_id string")
    assert {r.item_id for r in B.pending_items(cat, bins, none).collect()} == {"c"}
    assert {(r.item_id, r.path) for r in B.pending_items(cat, bins, none, stored=stored).collect()} == {("c", "/old")}


def test_an_error_wins_over_written_frames(spark, sf_dir):
    item = D.metadata_items(spark, sf_dir).limit(1).withColumn("item_id", F.lit("x"))
    ran = spark.createDataFrame([("x", 12, 40, False, "broke off")], "item_id string, frames int, frames_total int, cancelled boolean, error string")
    r = extraction.finish_items(item, ran, F.current_timestamp()).first()
    assert (r.extraction_status, r.extraction_error, r.frames_current) == ("failed", "broke off", 12)


def test_short_payloads_are_left_out_of_the_display(spark, sf_dir):
    frames = D.led_frames(spark, sf_dir)
    cut = frames.withColumn("payload", F.when(F.col("frame_idx") % 10 == 3, F.substring("payload", 1, 7)).otherwise(F.col("payload")))
    events = spark.createDataFrame([(1, 1, 4, "start", 0.0, False)], "session_id bigint, event_id bigint, title_id int, kind string, position_s double, is_paused boolean"
                                   ).withColumn("ts", F.timestamp_seconds(F.lit(1_700_000_000)))
    sessions = spark.createDataFrame([(1, "", "Den")], "session_id long, device_id string, device_name string")
    from rimlight.model import MAPPING_SCHEMA

    mappings = spark.createDataFrame([(0, "den", "h", 1, 1, 1, 1, 1, 0)], MAPPING_SCHEMA)
    shown = display.display_frames(events, sessions, mappings, D.led_titles(spark, sf_dir), cut)
    got = {r.frame_idx for r in shown.select("frame_idx").collect()}
    assert got and not [i for i in got if i % 10 == 3]
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan


def test_crc_checksums(spark, sf_dir):
    import zlib

    from rimlight.operators import compaction as C

    frames = D.led_frames(spark, sf_dir)
    want = {}
    for r in frames.collect():
        key = (r.title_id, r.ts_us // 500_000)
        want[key] = (want.get(key, 0) + zlib.crc32(f"{r.frame_idx}:{r.ts_us}:".encode() + bytes(r.payload))) % 2 ** 32
    got = {(r.title_id, r.chunk_no): r.checksum for r in C.chunk_checksum(frames, 500_000, C.crc_of_frame).collect()}
    assert got == want
