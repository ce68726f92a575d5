"""Extraction metadata: JSON documents in, table snapshots and JSON documents out."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimlight.functions import media
from rimlight.model import METADATA_KEYS, METADATA_SCHEMA
from rimlight.sources.files import empty_files, open_folder

# Values of keys that a document leaves out.
_DEFAULTS = {
    "library_id": "", "name": "", "item_type": "Video", "kind": "Video", "path": "",
    "extraction_status": "pending", "extraction_attempts": 0, "viewed": False,
    "extraction_progress": 0, "frames_current": 0, "frames_total": 0,
}


def _keys(date_key: str) -> dict[str, str]:
    return {**METADATA_KEYS, "date_created": date_key}


def _parsed(spark: SparkSession, folder: str, suffix: str, date_key: str) -> DataFrame:
    schema = T.StructType([
        T.StructField(_keys(date_key)[f.name], f.dataType) for f in METADATA_SCHEMA.fields
    ] + [T.StructField("_corrupt", T.StringType())])
    name = F.col("_metadata.file_name")
    return (
        spark.read.format("text").option("wholetext", "true").option("pathGlobFilter", f"*{suffix}").load(folder)
        .select(F.left(name, F.length(name) - F.lit(len(suffix))).alias("item_id"), "value")
        .where("item_id <> ''")
        .withColumn("doc", F.from_json("value", schema, {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    )


def metadata_scan(
    spark: SparkSession, folder: str, suffix: str = ".item.json", date_key: str = "DateCreated",
) -> DataFrame:
    """One row per readable document of the folder; the id comes from the file name.

    Blank and malformed documents are left out here and listed by ``metadata_errors``. Files
    are never changed or deleted.
    """
    keys = _keys(date_key)

    def value(field: T.StructField) -> Column:
        col = F.col(f"doc.{keys[field.name]}")
        if field.name in _DEFAULTS:
            col = F.coalesce(col, F.lit(_DEFAULTS[field.name]).cast(field.dataType))
        return col.alias(field.name)

    rows = _parsed(spark, folder, suffix, date_key).where(
        "trim(value) <> '' and doc is not null and doc._corrupt is null")
    return rows.select("item_id", *[value(f) for f in METADATA_SCHEMA.fields if f.name != "item_id"])


def metadata_errors(
    spark: SparkSession, folder: str, suffix: str = ".item.json", date_key: str = "DateCreated",
) -> DataFrame:
    """Documents that ``metadata_scan`` leaves out, with the reason."""
    blank = F.regexp_replace("value", r"\s", "") == ""
    reason = F.when(blank, "blank").otherwise("malformed")
    unread = _parsed(spark, folder, suffix, date_key).where(
        blank | F.col("doc").isNull() | F.col("doc._corrupt").isNotNull()
    ).select("item_id", reason.alias("reason"))
    empty = empty_files(spark, folder, suffix).select("item_id", F.lit("blank").alias("reason"))
    return unread.unionByName(empty)


def metadata_upsert(stored: DataFrame, changes: DataFrame, now: Column) -> DataFrame:
    """New snapshot: changed rows replace stored ones; of several changes to an id the latest wins.

    ``updated_at`` becomes ``now`` on changed rows; ``created_at`` is kept once it is set. Both
    inputs are reduced to one row per id before the join, so a hot id does not skew it.
    """
    columns = [f.name for f in METADATA_SCHEMA.fields]
    rest = [c for c in columns if c != "item_id"]

    def latest(rows: DataFrame, alias: str) -> DataFrame:
        return rows.where("item_id <> ''").groupBy("item_id").agg(F.max(F.struct(
            "updated_at", *[c for c in rest if c != "updated_at"])).alias(alias))

    both = latest(stored, "old").join(latest(changes, "new"), "item_id", "full")
    changed = F.col("new").isNotNull()

    def pick(name: str) -> Column:
        old, new = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name == "created_at":
            return F.coalesce(old, new, now)
        if name == "updated_at":
            return F.when(changed, now).otherwise(old)
        return F.when(changed, new).otherwise(old)

    return both.select("item_id", *[pick(c).alias(c) for c in rest])


def new_item_defaults(items: DataFrame, now: Column, *more: Column) -> DataFrame:
    """Full metadata rows for catalog items that are seen for the first time, and ``more`` columns of the items."""
    from rimlight.sources.catalog import default_name, kind_of

    values = {
        "item_id": F.col("item_id"), "library_id": F.col("library_id"),
        "name": default_name(F.col("name")), "item_type": F.col("item_type"),
        "kind": kind_of(F.col("item_type")), "path": F.col("path"),
        "date_created": F.col("date_created"), "created_at": now, "updated_at": now,
        "extraction_status": F.lit("pending"), "extraction_attempts": F.lit(0),
        "viewed": F.lit(False), "extraction_progress": F.lit(0),
        "frames_current": F.lit(0), "frames_total": F.lit(0),
    }
    return items.select(*[
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METADATA_SCHEMA.fields], *more)


def progress_overlay(items: DataFrame, progress: DataFrame) -> DataFrame:
    """Latest reported progress over the stored one, for items that are being extracted."""
    latest = progress.groupBy("item_id").agg(
        F.max(F.struct("ts", "frames_current", "frames_total")).alias("_p"))
    live = F.col("_p").isNotNull() & (F.col("extraction_status") == "extracting")
    cur = F.when(live, F.col("_p.frames_current")).otherwise(F.col("frames_current"))
    tot = F.when(live, F.col("_p.frames_total")).otherwise(F.col("frames_total"))
    pct = F.when(live, media.progress_pct(
        F.col("_p.frames_current"), F.col("_p.frames_total"), F.col("extraction_progress"))
    ).otherwise(F.col("extraction_progress"))
    return items.join(latest, "item_id", "left").withColumns({
        "frames_current": cur, "frames_total": tot, "extraction_progress": pct}).drop("_p")


def metadata_documents(items: DataFrame, date_key: str = "DateCreated") -> DataFrame:
    """``(item_id, content)``: the indented JSON document of every item."""
    keys = _keys(date_key)
    doc = F.struct(*[F.col(f.name).alias(keys[f.name]) for f in METADATA_SCHEMA.fields])
    options = {"pretty": "true", "ignoreNullFields": "false"}
    return items.select("item_id", F.to_json(doc, options).alias("content"))


def write_documents(documents: DataFrame, folder: str, suffix: str = ".item.json") -> DataFrame:
    """Write one file per row of ``(item_id, content)``; returns ``(item_id, bytes)`` when acted upon.

    A file appears under its name only when it is complete, and a repeated task writes it anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_folder(folder)
        for batch in batches:
            sizes = []
            for item_id, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = content.encode()
                temp = f"{root}/{item_id}{suffix}.{uuid.uuid4().hex}.tmp"
                with fs.open_output_stream(temp) as out:
                    out.write(data)
                fs.move(temp, f"{root}/{item_id}{suffix}")
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64())], names=["item_id", "bytes"])

    return documents.select("item_id", "content").mapInArrow(run, "item_id string, bytes bigint")
