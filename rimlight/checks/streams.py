"""Streaming forms; each runs over all available input and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimlight.checks.library import PROGRESS, progress_reports
from rimlight.checks.registry import check
from rimlight.checks.sql import CATALOG, EVENTS, ROUTES
from rimlight.session import fresh_folder
from rimlight.sources import derived as D
from rimlight.streaming import library as L
from rimlight.streaming import playback as S
from rimlight.streaming.progress import ProgressTable, run_progress
from rimlight.streaming.tables import read_events, run_to_table

_SLICES = 3


def _playback_stream(spark, sf):
    """The events in a few micro-batches; each batch holds the next stretch of time."""
    events = D.playback_events(spark, sf)
    folder = fresh_folder(spark, "events")
    day = F.dayofmonth("ts")
    for no in range(_SLICES):
        part = events.where(F.floor((day - 1) * _SLICES / 31) == no)
        part.repartition("session_id").write.mode("append").parquet(f"{folder}/slice={no}")
    return read_events(spark, f"{folder}/*", events.schema, bytes_per_batch=64 << 20)


def _stream_of(spark, rows):
    folder = fresh_folder(spark, "stream-in")
    rows.write.parquet(folder)
    return read_events(spark, folder, rows.schema)


def _library_events(spark, sf):
    doc = D.table(spark, sf, "documents").select(
        F.md5(F.col("doc_id").cast("string")).alias("item_id"),
        F.when(F.col("doc_id") % 4 == 3, "removed").otherwise("added").alias("event"))
    return _stream_of(spark, D.catalog(spark, sf).join(doc, "item_id"))


@check(f"""with {CATALOG} select item_id, library_id, coalesce(name, 'Unknown') as name, item_type,
       case item_type when 'Episode' then 'Serie' else 'Movie' end as kind, path, date_created from allowed
       where doc_id % 4 <> 3 and item_id not in (select item_id from binaries)""")
def stream_new_items(spark, sf):
    return run_to_table(L.stream_new_items(
        _library_events(spark, sf), D.excluded_libraries(spark, sf), D.binaries(spark, sf))).drop("batch")


@check(f"""with {CATALOG} select item_id, 'on' as gate from allowed where item_id not in (select item_id from binaries)""")
def auto_extract_gate(spark, sf):
    """The same additions with automatic extraction switched on and off: only the first pass."""
    added = D.catalog(spark, sf).withColumn("event", F.lit("added"))
    runs = [run_to_table(L.stream_new_items(_stream_of(spark, added), D.excluded_libraries(spark, sf), D.binaries(spark, sf), enabled=on))
            .select("item_id", F.lit("on" if on else "off").alias("gate")) for on in (True, False)]
    return runs[0].unionByName(runs[1])


@check(f"""with {CATALOG} select item_id, name from catalog where doc_id % 4 = 3 and item_type in ('Movie', 'Episode')
       and item_id in (select item_id from binaries)""")
def stream_removed_items(spark, sf):
    return run_to_table(L.stream_removed_items(_library_events(spark, sf), D.binaries(spark, sf))).drop("batch")


@check(f"with {PROGRESS} select item_id, ts, frames_current, frames_total from latest")
def stream_progress(spark, sf):
    """The upsert table after four batches, with a snapshot in between; the first batch is replayed."""
    table = ProgressTable(spark, fresh_folder(spark, "progress"), compact_every=3)
    reports, folder = progress_reports(spark, sf), fresh_folder(spark, "stream-in")
    reports.repartition(4).write.parquet(folder)
    stream = read_events(spark, folder, reports.schema, files_per_batch=1)
    run_progress(stream, table, fresh_folder(spark, "stream-state"))
    table.upsert(progress_reports(spark, sf).limit(5), 0)
    return table.read().withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@check(f"with {EVENTS} select session_id, event_id, position_s, prev_position_s from p where abs(position_s - prev_position_s) > 0.5")
def stream_seeks(spark, sf):
    return run_to_table(S.stream_seeks(_playback_stream(spark, sf))).drop("batch")


@check(f"""with {EVENTS} select session_id, event_id, case when is_paused then 'pause' else 'resume' end as change from p
       where is_paused <> prev_paused""")
def stream_pause(spark, sf):
    return run_to_table(S.stream_pause(_playback_stream(spark, sf))).drop("batch")


@check(f"""with {EVENTS}, h as (select *, last_value(case when kind = 'start' then title_id end ignore nulls) over (
         partition by session_id order by ts, event_id rows between unbounded preceding and 1 preceding) as was from c)
       select session_id, event_id, title_id, 'open' as change from h where kind = 'start'
       union all select session_id, event_id, was, 'close' from h where kind in ('start', 'stop') and ctl = 'start'""")
def stream_sessions(spark, sf):
    return run_to_table(S.stream_sessions(_playback_stream(spark, sf))).drop("batch")


@check(f"""with {EVENTS}, {ROUTES} select event_id, session_id, title_id, host, port, mapping_order from e join routes using (session_id)
       where kind = 'start'""")
def stream_routing(spark, sf):
    sessions = D.sessions(spark, sf)
    return run_to_table(_playback_stream(spark, sf), each=lambda batch: S.route_starts(
        batch, sessions, lambda: D.device_mappings(spark), strict=True)).select(
        "event_id", "session_id", "title_id", "host", "port", "mapping_order")
