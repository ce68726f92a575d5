"""Streams: several micro-batches give what one gives; late events are reported."""

from pyspark.sql import functions as F
from test_ordered import SCRIPT, events

from rimlight.session import fresh_folder
from rimlight.sources import derived as D
from rimlight.streaming import playback as S
from rimlight.streaming.tables import read_events, run_to_table


def stream(spark, parts, per_batch=None):
    folder = fresh_folder(spark, "in")
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return read_events(spark, folder, parts[0].schema, per_batch)


def rows(df):
    return sorted(map(tuple, df.drop("batch").collect()), key=repr)


def test_batches_do_not_matter(spark, sf_dir):
    ev = D.playback_events(spark, sf_dir)
    cut = F.dayofmonth("ts")
    parts = [ev.where(cut < 9), ev.where((cut >= 9) & (cut < 20)), ev.where(cut >= 20)]
    many = rows(run_to_table(S.stream_changes(stream(spark, parts, 1))))
    assert many and many == rows(run_to_table(S.stream_changes(stream(spark, [ev]))))


def test_script(spark):
    ev = events(spark, SCRIPT)
    out = run_to_table(S.stream_changes(stream(spark, [ev.where("event_id < 6"), ev.where("event_id >= 6")], 1)))
    got = sorted((r.event_id, r.change) for r in out.collect())
    assert got == [(1, "open"), (4, "seek"), (5, "pause"), (7, "resume"), (8, "close"), (10, "open"), (12, "close"),
                   (12, "open"), (13, "pause"), (14, "close")]


def test_late_events_change_nothing(spark):
    ev = events(spark, [(1, 10, "start", 0.0, False), (1, 30, "progress", 5.0, False), (1, 20, "progress", 80.0, True),
                        (1, 40, "progress", 5.2, False)])
    out = run_to_table(S.stream_changes(stream(spark, [ev.where("event_id < 2"), ev.where("event_id >= 2")], 1)))
    assert sorted((r.event_id, r.change) for r in out.collect()) == [(0, "open"), (2, "late")]


def test_mapping_changes_apply_to_the_next_start(spark):
    ev = events(spark, [(1, 10, "start", 0.0, False), (1, 20, "start", 0.0, False)])
    sessions = spark.createDataFrame([(1, "", "Den")], "session_id long, device_id string, device_name string")
    hosts = iter(["h1", "h2"])

    def mappings():
        from rimlight.model import MAPPING_SCHEMA

        return spark.createDataFrame([(0, "den", next(hosts), 1, 1, 1, 1, 1, 0)], MAPPING_SCHEMA)

    src = stream(spark, [ev.where("event_id = 0"), ev.where("event_id = 1")], 1)
    out = run_to_table(src, each=lambda b: S.route_starts(b, sessions, mappings))
    assert sorted((r.event_id, r.host) for r in out.collect()) == [(0, "h1"), (1, "h2")]
