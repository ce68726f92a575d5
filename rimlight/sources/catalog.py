"""Catalog reader and the row filters that apply to it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.functions import ids
from rimlight.model import ITEM_TYPES


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All libraries in one scan; type and path filters reach the Parquet reader."""
    return item_type_filter(spark.read.parquet(path))


def item_type_filter(items: DataFrame) -> DataFrame:
    return items.where(F.col("item_type").isin(*ITEM_TYPES))


def path_filter(items: DataFrame) -> DataFrame:
    return items.where(F.col("path").isNotNull() & (F.col("path") != ""))


def id_filter(requests: DataFrame, column: str = "item_id") -> DataFrame:
    """Requests with a usable id, as ``guid``; blank and malformed ids are skipped."""
    return requests.withColumn("guid", ids.canon_guid(F.col(column))).where("guid is not null")


def kind_of(item_type: Column) -> Column:
    return (F.when(item_type == "Episode", "Serie").when(item_type == "Movie", "Movie")
            .otherwise("Video"))


def default_name(name: Column, known: Column | None = None) -> Column:
    return F.coalesce(name, known if known is not None else F.lit("Unknown"))


def auto_extract_gate(events: DataFrame, enabled: bool) -> DataFrame:
    """Pass library events only while automatic extraction is switched on."""
    return events.where(F.lit(enabled))
