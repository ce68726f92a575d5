"""Catalog, metadata, binaries, backlog and status."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from rimlight.checks.registry import check
from rimlight.checks.sql import CATALOG, FRAMES, SAMPLES
from rimlight.functions import ids
from rimlight.operators import backlog as B
from rimlight.operators.timeline import title_summary
from rimlight.operators.tree import library_of_item
from rimlight.plans import extraction
from rimlight.session import checkpointed, fresh_folder
from rimlight.sources import binaries as bins
from rimlight.sources import catalog as cat
from rimlight.sources import derived as D
from rimlight.sources import ledfiles, lightsource, metadata

_NOW_SQL = "timestamp '2024-06-01 00:00:00'"


def _now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp")


def _write(rows) -> None:
    rows.write.format("noop").mode("overwrite").save()


# ---- catalog --------------------------------------------------------------------------------

@check(f"with {CATALOG} select item_id, library_id, name, item_type, path, date_created from catalog "
       "where item_type in ('Movie', 'Episode')")
def catalog_scan(spark, sf):
    path = fresh_folder(spark, "catalog")
    D.catalog(spark, sf).write.parquet(path)
    return cat.read_catalog(spark, path)


@check(f"with {CATALOG} select item_id, path from catalog where path is not null and path <> ''")
def path_filter(spark, sf):
    return cat.path_filter(D.catalog(spark, sf)).select("item_id", "path")


@check(f"with {CATALOG} select item_id, item_type from catalog where item_type in ('Movie', 'Episode')")
def item_type_filter(spark, sf):
    return cat.item_type_filter(D.catalog(spark, sf)).select("item_id", "item_type")


@check(f"""with {CATALOG} select item_id, case item_type when 'Episode' then 'Serie' when 'Movie' then 'Movie'
       else 'Video' end as kind, coalesce(name, 'Unknown') as name from catalog""")
def kind_and_default_name(spark, sf):
    return D.catalog(spark, sf).select(
        "item_id", cat.kind_of(F.col("item_type")).alias("kind"), cat.default_name(F.col("name")).alias("name"))


@check(f"""with {CATALOG} select item_id, library_id, coalesce(name, 'Unknown') as name, item_type,
       case item_type when 'Episode' then 'Serie' when 'Movie' then 'Movie' else 'Video' end as kind, path, date_created,
       'pending' as extraction_status, 0 as extraction_attempts, false as viewed, 0 as extraction_progress
       from catalog where item_id not in (select item_id from items)""")
def new_item_defaults(spark, sf):
    fresh = D.catalog(spark, sf).join(D.extraction_items(spark, sf).select("item_id"), "item_id", "left_anti")
    return metadata.new_item_defaults(fresh, _now()).select(
        "item_id", "library_id", "name", "item_type", "kind", "path", "date_created", "extraction_status",
        "extraction_attempts", "viewed", "extraction_progress")


_SPELLED = """
spelled as (
  select doc_id, case doc_id % 7
      when 0 then upper(h) when 1 then d when 2 then concat('{', d, '}') when 3 then concat('(', upper(d), ')')
      when 4 then concat(' ', h, ' ') when 5 then concat(h, 'x') else '' end as item_id, h
  from (select doc_id, h, concat_ws('-', substr(h, 1, 8), substr(h, 9, 4), substr(h, 13, 4), substr(h, 17, 4), substr(h, 21)) as d
        from (select doc_id, md5(cast(doc_id as varchar)) as h from documents)))"""


def _spelled(spark, sf):
    h = F.md5(F.col("doc_id").cast("string"))
    d = F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.substring(h, 13, 4),
                    F.substring(h, 17, 4), F.substring(h, 21, 12))
    way = F.col("doc_id") % 7
    text = (F.when(way == 0, F.upper(h)).when(way == 1, d).when(way == 2, F.concat(F.lit("{"), d, F.lit("}")))
            .when(way == 3, F.concat(F.lit("("), F.upper(d), F.lit(")")))
            .when(way == 4, F.concat(F.lit(" "), h, F.lit(" ")))
            .when(way == 5, F.concat(h, F.lit("x"))).otherwise(""))
    return D.table(spark, sf, "documents").select("doc_id", text.alias("item_id"))


@check(f"with {_SPELLED} select doc_id, case when doc_id % 7 < 5 then h end as guid from spelled")
def canon_guid(spark, sf):
    return _spelled(spark, sf).select("doc_id", ids.canon_guid(F.col("item_id")).alias("guid"))


@check(f"with {_SPELLED} select doc_id, h as guid from spelled where doc_id % 7 < 5")
def id_filter(spark, sf):
    return cat.id_filter(_spelled(spark, sf)).select("doc_id", "guid")


@check("select o_orderkey, replace(lower(o_orderpriority), '-', '') as library_id from orders")
def norm_library_id(spark, sf):
    return D.table(spark, sf, "orders").select(
        "o_orderkey", ids.norm_library_id(F.col("o_orderpriority")).alias("library_id"))


@check("select doc_id, regexp_replace(lower(substr(text, 1)), '[^\\p{L}\\p{Nd}]', '', 'g') as name from documents")
def norm_name(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", ids.norm_name(F.col("text")).alias("name"))


@check(f"with {CATALOG} select item_id, try_cast(left(date_created, 19) as timestamp) as created from catalog")
def parse_date(spark, sf):
    return D.catalog(spark, sf).select(
        "item_id", ids.parse_date(F.col("date_created")).cast("timestamp_ntz").alias("created"))


@check("select event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '0Z') as text from events")
def round_trip_date(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id", ids.round_trip_date(F.col("ts").cast("timestamp")).alias("text"))


# ---- libraries, backlog ---------------------------------------------------------------------

@check(f"with {CATALOG} select item_id, library_id from catalog where library_id <> md5('es')")
def exclude_libraries(spark, sf):
    return B.exclude_libraries(D.catalog(spark, sf), D.excluded_libraries(spark, sf)).select("item_id", "library_id")


@check("select distinct md5(lang) as library_id from documents where lang = 'es'")
def excluded_set(spark, sf):
    return D.excluded_libraries(spark, sf).select(ids.norm_library_id(F.col("library_id")).alias("library_id")).distinct()


@check(f"with {CATALOG} select item_id, path from catalog where path in (select path from files)")
def existing_sources(spark, sf):
    return B.existing_sources(D.catalog(spark, sf), D.source_files(spark, sf)).select("item_id", "path")


def _pending(spark, sf):
    return B.pending_items(D.catalog(spark, sf), D.binaries(spark, sf), D.excluded_libraries(spark, sf),
                           D.source_files(spark, sf))


@check(f"with {CATALOG} select * from pending")
def pending_items(spark, sf):
    return _pending(spark, sf)


@check(f"""with {CATALOG} select a.item_id, library_id, case when i.doc_id is null then coalesce(name, 'Unknown') else concat('Old ', coalesce(name, 'Unknown')) end as name,
       item_type, case when i.doc_id is not null then 'Video' when item_type = 'Episode' then 'Serie' else 'Movie' end as kind, path, date_created
       from allowed a left join items i on i.item_id = a.item_id where path in (select path from files)
       and a.item_id not in (select item_id from binaries) and (i.doc_id is null or not path like '%3.mkv')""")
def pending_items_stored(spark, sf):
    """Stored items have other names than the catalog, and some a blank path."""
    stored = D.metadata_items(spark, sf).withColumns({
        "name": F.concat(F.lit("Old "), "name"), "path": F.when(F.col("path").like("%3.mkv"), "").otherwise(F.col("path"))})
    return B.pending_items(D.catalog(spark, sf), D.binaries(spark, sf), D.excluded_libraries(spark, sf), D.source_files(spark, sf), stored)


_DATE = "try_cast(left(date_created, 19) as timestamp)"
for _order, _sql in {
    "newest_first": f"{_DATE} desc nulls last",
    "oldest_first": f"{_DATE} asc nulls first",
    "alphabetical": "name asc",
    "movies_newest_first": f"case when kind = 'Movie' then 0 else 1 end, {_DATE} desc nulls last",
}.items():
    check(f"with {CATALOG} select item_id, name, kind, date_created from pending order by {_sql}, item_id",
          name=f"backlog_{_order}")(
        lambda spark, sf, o=_order: B.backlog(_pending(spark, sf), o).select("item_id", "name", "kind", "date_created"))


@check(f"""with {CATALOG}, k as (select a.*, m.doc_id is not null as seen, m.extraction_status as st,
         m.extraction_attempts as att from allowed a left join items m on m.item_id = a.item_id)
       select item_id, library_id, coalesce(name, 'Unknown') as name, path,
              coalesce(st, 'pending') as extraction_status, coalesce(att, 0) as extraction_attempts, {_NOW_SQL} as updated_at,
              case when seen then timestamp '2024-01-01 00:00:00' else {_NOW_SQL} end as created_at from k
       union all
       select i.item_id, library_id, coalesce(name, 'Unknown'), coalesce(path, ''), extraction_status, extraction_attempts,
              timestamp '2024-01-01 00:00:00' + to_seconds(i.doc_id), timestamp '2024-01-01 00:00:00'
       from items i join catalog c on c.item_id = i.item_id where i.item_id not in (select item_id from allowed)""")
def sync_catalog(spark, sf):
    out = B.sync_catalog(D.catalog(spark, sf), D.metadata_items(spark, sf), D.excluded_libraries(spark, sf), _now())
    return out.select("item_id", "library_id", "name", "path", "extraction_status", "extraction_attempts",
                      F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
                      F.col("created_at").cast("timestamp_ntz").alias("created_at"))


@check(f"""with {CATALOG}, d as (select l.doc_id, l.doc_id % 3 as way from labels l)
       select md5(cast(doc_id as varchar)) as item_id,
              case when way = 0 then 'changed again' when way = 1 then 'changed' else coalesce(c.name, 'Unknown') end as name,
              case when way = 2 then timestamp '2024-01-01 00:00:00' + to_seconds(doc_id) else {_NOW_SQL} end as updated_at,
              timestamp '2024-01-01 00:00:00' as created_at
       from d join catalog c using (doc_id)
       union all select concat('new', cast(r_regionkey as varchar)), 'fresh', {_NOW_SQL}, {_NOW_SQL} from region""")
def metadata_upsert(spark, sf):
    stored = D.metadata_items(spark, sf)
    # every third item twice, every third once; one change without an id, some unknown ids
    way = F.unix_seconds("updated_at") % 3
    first = F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")) % 3
    no = F.pmod(way - first, F.lit(3))
    one = stored.where(no < 2).withColumn("name", F.lit("changed"))
    two = stored.where(no == 0).withColumns({
        "name": F.lit("changed again"), "updated_at": F.timestamp_add("SECOND", F.lit(5), F.col("updated_at"))})
    fresh = metadata.new_item_defaults(D.table(spark, sf, "region").select(
        F.concat(F.lit("new"), F.col("r_regionkey").cast("string")).alias("item_id"), F.lit("l").alias("library_id"),
        F.lit("fresh").alias("name"), F.lit("Movie").alias("item_type"), F.lit("p").alias("path"),
        F.lit(None).cast("string").alias("date_created")), F.lit(None).cast("timestamp"))
    blank = one.withColumn("item_id", F.lit(""))
    changes = one.unionByName(two).unionByName(fresh).unionByName(blank)
    return metadata.metadata_upsert(stored, changes, _now()).select(
        "item_id", "name", F.col("updated_at").cast("timestamp_ntz").alias("updated_at"),
        F.col("created_at").cast("timestamp_ntz").alias("created_at"))


# ---- files ----------------------------------------------------------------------------------

def _metadata_folder(spark, sf) -> str:
    folder = fresh_folder(spark, "metadata")
    no = F.unix_seconds("updated_at") - F.unix_seconds("created_at")
    docs = metadata.metadata_documents(D.metadata_items(spark, sf))
    docs = docs.join(D.metadata_items(spark, sf).select("item_id", no.alias("no")), "item_id").select(
        "item_id", F.when(F.col("no") % 11 == 0, " \n").when(F.col("no") % 11 == 1, F.left("content", F.lit(40)))
        .otherwise(F.col("content")).alias("content"))
    _write(metadata.write_documents(docs, folder))
    return folder


@check(f"""with {CATALOG} select i.item_id, library_id, coalesce(name, 'Unknown') as name, item_type, coalesce(path, '') as path,
       date_created, extraction_status, extraction_attempts, extraction_progress, frames_current, frames_total,
       timestamp '2024-01-01 00:00:00' + to_seconds(i.doc_id) as updated_at
       from items i join catalog c on c.item_id = i.item_id where i.doc_id % 11 not in (0, 1)""")
def metadata_scan(spark, sf):
    return metadata.metadata_scan(spark, _metadata_folder(spark, sf)).select(
        "item_id", "library_id", "name", "item_type", "path", "date_created", "extraction_status",
        "extraction_attempts", "extraction_progress", "frames_current", "frames_total",
        F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@check(f"""with {CATALOG} select item_id, case when doc_id % 11 = 0 then 'blank' else 'malformed' end as reason
       from items where doc_id % 11 in (0, 1)""")
def metadata_errors(spark, sf):
    return metadata.metadata_errors(spark, _metadata_folder(spark, sf))


def _exported(spark, sf) -> tuple[str, object]:
    """Light binaries of all titles in a new folder; named like items. Plus the writer's report."""
    folder = fresh_folder(spark, "binaries")
    named = F.md5(F.col("title_id").cast("string")).alias("item_id")
    frames = D.led_frames(spark, sf).select(named, "frame_idx", "ts_us", "payload")
    titles = D.led_titles(spark, sf).select(named, "fps", "top", "bottom", "left", "right", "fmt")
    return folder, ledfiles.write_led_binaries(frames, titles, folder)


def _export_folder(spark, sf) -> str:
    folder, report = _exported(spark, sf)
    _write(report)
    return folder


@check(f"""with {FRAMES} select md5(cast(title_id as varchar)) as item_id, count(*) as frames, 17 + 72 * count(*) as bytes
       from v group by title_id""")
def led_binary_sink(spark, sf):
    return _exported(spark, sf)[1]


@check(f"""with {SAMPLES} select md5(cast(title_id as varchar)) as item_id, frame_idx, ts_us, payload_hex from led_frames
       where title_id in (2, 5) and frame_idx >= 3 and frame_idx < 40""")
def light_binaries_source(spark, sf):
    """Written by several tasks through the data source and read back through its filters."""
    named = F.md5(F.col("title_id").cast("string")).alias("item_id")
    folder = fresh_folder(spark, "light-source")
    lightsource.save_light_binaries(
        D.led_frames(spark, sf).select(named, "frame_idx", "ts_us", "payload"),
        D.led_titles(spark, sf).select(named, "fps", "top", "bottom", "left", "right", "fmt"), folder)
    two = [hashlib.md5(str(i).encode()).hexdigest() for i in (2, 5)]
    rows = lightsource.read_light_binaries(spark, folder).where(F.col("item_id").isin(two) & (F.col("frame_idx") >= 3) & (F.col("frame_idx") < 40))
    return rows.select("item_id", "frame_idx", "ts_us", F.hex("payload").alias("payload_hex"))


@check(f"""with {CATALOG}, {FRAMES} select md5(cast(title_id as varchar)) as item_id, count(*) as frames, 17 + 72 * count(*) as bytes,
       count(*) as frames_read, max(ts_us) as last_ts_us from vt where md5(cast(title_id as varchar)) in (select item_id from pending) group by title_id""")
def extract_to_binaries(spark, sf):
    """Catalog to backlog to zone colours to light binaries under 32-digit ids, and back from the files."""
    due = extraction.extraction_backlog(
        D.catalog(spark, sf), D.binaries(spark, sf), D.excluded_libraries(spark, sf), D.source_files(spark, sf))
    named = F.md5(F.col("title_id").cast("string")).alias("title_id")
    frames = D.frames(spark, sf, D.SMALL_WIDTH, D.SMALL_HEIGHT).select(named, "frame_idx", "ts_us", "pixels")
    lights = extraction.extract_lights(frames, due.select(F.col("item_id").alias("title_id")), D.STRIP, D.SMALL_WIDTH, D.SMALL_HEIGHT)
    lights = lights.withColumnRenamed("title_id", "item_id")
    titles = lights.select("item_id").distinct().select("item_id", F.lit(24.0).alias("fps"), *[
        F.lit(getattr(D.STRIP, c)).alias(c) for c in ("top", "bottom", "left", "right")], F.lit(1).alias("fmt"))
    folder = fresh_folder(spark, "extracted")
    report = checkpointed(ledfiles.write_led_binaries(lights, titles, folder))
    read = ledfiles.led_binary_scan(bins.binary_listing(spark, folder)).groupBy("item_id").agg(
        F.count(F.lit(1)).alias("frames_read"), F.max("ts_us").alias("last_ts_us"))
    return report.join(read, "item_id")


@check(f"""with {FRAMES} select md5(cast(title_id as varchar)) as item_id, 17 + 72 * count(*) as length
       from v group by title_id""")
def binary_listing(spark, sf):
    return bins.binary_listing(spark, _export_folder(spark, sf)).select("item_id", "length")


@check(f"""with {SAMPLES} select md5(cast(title_id as varchar)) as item_id,
       case when isnan(fps) then -1.0 else fps end as fps, 5 as "top", 5 as bottom, 3 as "left", 3 as "right", 1 as fmt
       from led_titles""")
def led_titles(spark, sf):
    titles = ledfiles.led_titles(bins.binary_listing(spark, _export_folder(spark, sf)))
    fps = F.when(F.isnan("fps"), -1.0).otherwise(F.col("fps")).alias("fps")
    return titles.select("item_id", fps, "top", "bottom", "left", "right", "fmt")


@check(f"""with {SAMPLES} select md5(cast(title_id as varchar)) as item_id, frame_idx, ts_us, payload_hex from led_frames""")
def led_binary_scan(spark, sf):
    frames = ledfiles.led_binary_scan(bins.binary_listing(spark, _export_folder(spark, sf)))
    return frames.select("item_id", "frame_idx", "ts_us", F.hex("payload").alias("payload_hex"))


@check(f"with {CATALOG} select item_id, length from binaries where item_id not in (select item_id from catalog)")
def orphan_binaries(spark, sf):
    return bins.orphan_binaries(D.binaries(spark, sf), D.catalog(spark, sf))


@check(f"""with {CATALOG} select item_id, length from binaries
       where item_id not in (select item_id from items where extraction_attempts > 1)""")
def invalidate_binary(spark, sf):
    redo = D.extraction_items(spark, sf).where("extraction_attempts > 1")
    return bins.invalidate_binary(D.binaries(spark, sf), redo)


@check(f"""with {FRAMES}, last as (select title_id, max(frame_idx) as f from v group by title_id)
       select title_id, frame_idx, 48 * 27 * 3 as bytes from v where (title_id, frame_idx) not in (select title_id, f from last)""")
def frames_scan(spark, sf):
    """Every title ends with an incomplete frame."""
    frames = D.frames(spark, sf, D.SMALL_WIDTH, D.SMALL_HEIGHT)
    ends = D.led_frames(spark, sf).groupBy("title_id").agg(F.max("frame_idx").alias("last"))
    cut = frames.join(ends, "title_id").withColumn("pixels", F.when(
        F.col("frame_idx") == F.col("last"), F.substring("pixels", 1, 1000)).otherwise(F.col("pixels")))
    return ledfiles.frames_scan(cut, D.SMALL_WIDTH, D.SMALL_HEIGHT).select(
        "title_id", "frame_idx", F.length("pixels").alias("bytes"))


@check(f"""with {CATALOG}, o as (select item_id, doc_id, doc_id % 4 as way, extraction_attempts from items)
       select item_id, case when way = 0 then 'pending' when way = 1 or doc_id % 8 = 2 then 'failed' else 'completed' end as extraction_status,
              case when way = 0 then null when doc_id % 8 = 2 then 'decoder broke off' when way = 1 then 'no frames written' end as extraction_error, extraction_attempts + 1 as extraction_attempts,
              case when way < 2 then 0 else doc_id end as frames_current,
              case when way = 0 then 0 else 2000 end as frames_total,
              case when way < 2 then 0 else least(99, doc_id * 100 // 2000) end as extraction_progress
       from o where not (way >= 2 and doc_id = 0)""")
def finish_items(spark, sf):
    """Outcome of an extraction run: some cancelled, some without frames, some with frames and an error, the rest done."""
    way = F.col("doc_id") % 4
    error = F.when(F.col("doc_id") % 8 == 2, "decoder broke off")
    outcome = D.table(spark, sf, "labels").select(
        F.md5(F.col("doc_id").cast("string")).alias("item_id"), F.when(way != 1, F.col("doc_id")).alias("frames"),
        F.lit(2000).alias("frames_total"), (way == 0).alias("cancelled"), error.alias("error"))
    return extraction.finish_items(D.metadata_items(spark, sf), outcome, _now()).select(
        "item_id", "extraction_status", "extraction_error", "extraction_attempts", "frames_current", "frames_total",
        "extraction_progress")


# ---- status ---------------------------------------------------------------------------------

_REQUESTS = _SPELLED + """,
req as (select distinct item_id, h as guid from spelled where doc_id % 7 < 5),
strangers as (select md5(concat('c', cast(c_custkey as varchar))) as item_id from customer)"""

_STATUS = """case when {ok} then concat('/data/lights/', r.guid, '.bin') end as binary_path,
       b.length is not null and {ok} as has_binary, case when {ok} then coalesce(b.length, 0) else 0 end as binary_size,
       case when {ok} then extraction_status end as extraction_status,
       case when {ok} then coalesce(extraction_progress, 0) else 0 end as extraction_progress,
       case when {ok} then coalesce(frames_current, 0) else 0 end as frames_current,
       case when {ok} then coalesce(frames_total, 0) else 0 end as frames_total"""


@check(f"""with {CATALOG}, {_REQUESTS} select r.item_id, r.guid, c.name as item_name, {_STATUS.format(ok='true')}
       from req r join catalog c on c.item_id = r.guid left join items i on i.item_id = r.guid
       left join binaries b on b.item_id = r.guid""")
def batch_status(spark, sf):
    known = _spelled(spark, sf).select("item_id")
    strangers = D.table(spark, sf, "customer").select(
        F.md5(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("item_id"))
    requests = known.unionByName(known).unionByName(strangers)
    return B.batch_status(requests, D.catalog(spark, sf), D.extraction_items(spark, sf), D.binaries(spark, sf))


@check(f"""with {CATALOG}, {_REQUESTS}, r as (select item_id, guid from req union all select item_id, item_id from strangers)
       select r.item_id, r.guid, c.name as item_name, {_STATUS.format(ok="(c.item_id is not null and coalesce(c.path, '') <> '')")}
       from r left join catalog c on c.item_id = r.guid left join items i on i.item_id = r.guid
       left join binaries b on b.item_id = r.guid""")
def item_status(spark, sf):
    strangers = D.table(spark, sf, "customer").select(
        F.md5(F.concat(F.lit("c"), F.col("c_custkey").cast("string"))).alias("item_id"))
    requests = _spelled(spark, sf).select("item_id").unionByName(strangers)
    return B.item_status(requests, D.catalog(spark, sf), D.extraction_items(spark, sf), D.binaries(spark, sf))


def progress_reports(spark, sf):
    """Reports on as many items as there are users."""
    k = F.col("event_id")
    return D.table(spark, sf, "events").select(
        F.md5(F.col("user_id").cast("string")).alias("item_id"), F.col("ts").cast("timestamp").alias("ts"),
        (k % 6000).alias("frames_current"), F.when(k % 9 == 0, 0).otherwise(5000).cast("long").alias("frames_total"))


PROGRESS = """
reports as (select md5(cast(user_id as varchar)) as item_id, ts, event_id % 6000 as frames_current,
                   case when event_id % 9 = 0 then 0 else 5000 end as frames_total from events),
latest as (select * from reports qualify row_number() over (
             partition by item_id order by ts desc, frames_current desc, frames_total desc) = 1)"""


@check(f"""with {CATALOG}, {PROGRESS} select i.item_id,
       case when l.item_id is not null and extraction_status = 'extracting' then l.frames_current else i.frames_current end as frames_current,
       case when l.item_id is not null and extraction_status = 'extracting' then l.frames_total else i.frames_total end as frames_total,
       case when l.item_id is not null and extraction_status = 'extracting' and l.frames_total > 0
            then least(99, l.frames_current * 100 // l.frames_total) else extraction_progress end as extraction_progress
       from items i left join latest l on l.item_id = i.item_id""")
def progress_overlay(spark, sf):
    return metadata.progress_overlay(D.extraction_items(spark, sf), progress_reports(spark, sf)).select(
        "item_id", "frames_current", "frames_total", "extraction_progress")


@check(f"""with {CATALOG} select count(*) as total_videos,
       count(*) filter (extraction_status = 'completed' and item_id in (select item_id from binaries)) as extracted_videos,
       count(*) filter (extraction_status = 'failed') as failed_videos from items""")
def extraction_stats(spark, sf):
    return B.extraction_stats(D.extraction_items(spark, sf), D.binaries(spark, sf))


@check(f"""with {CATALOG} select source as series_id, max({_DATE}) as newest, count(*) as episodes
       from catalog where item_type = 'Episode' group by source""")
def series_recency(spark, sf):
    episodes = D.catalog(spark, sf).where("item_type = 'Episode'")
    source = D.table(spark, sf, "documents").select(F.md5(F.col("doc_id").cast("string")).alias("item_id"), "source")
    return B.series_recency(episodes.join(source, "item_id").withColumnRenamed("source", "series_id")).withColumn(
        "newest", F.col("newest").cast("timestamp_ntz"))


_TREE = """
tree as (
  select concat('r', cast(r_regionkey as varchar)) as item_id, cast(null as varchar) as parent_id, 'CollectionFolder' as node_type from region
  union all select concat('n', cast(n_nationkey as varchar)), concat('r', cast(n_regionkey as varchar)), 'Folder' from nation
  union all select concat('c', cast(c_custkey as varchar)),
      case when c_custkey % 50 = 0 then 'missing' else concat('n', cast(c_nationkey as varchar)) end, 'Folder' from customer
  union all select concat('o', cast(o_orderkey as varchar)), concat('c', cast(o_custkey as varchar)), 'Movie' from orders),
walk as (
  select item_id, item_id as here, parent_id as up, node_type from tree
  union all
  select w.item_id, t.item_id, t.parent_id, t.node_type from walk w join tree t on t.item_id = w.up
  where w.node_type not in ('CollectionFolder', 'UserView')),
found as (select item_id, here as root from walk where node_type in ('CollectionFolder', 'UserView'))"""


@check(f"""with recursive {_TREE} select t.item_id, coalesce(f.root, t.parent_id) as library_id
       from tree t left join found f on f.item_id = t.item_id""", name="library_of_item")
def _library_of_item(spark, sf):
    return library_of_item(D.item_tree(spark, sf))


@check(f"""with {FRAMES} select title_id, count(*) as frames, max(ts_us) as last_ts_us, 17 + 72 * count(*) as file_bytes,
       round((17 + 72 * count(*)) / 1048576.0::double, 9) as file_mb from vt group by title_id""", name="title_summary")
def _title_summary(spark, sf):
    return title_summary(D.led_frames(spark, sf)).withColumn("file_mb", F.round("file_mb", 9))
