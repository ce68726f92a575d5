"""Which light binaries exist, and which of them should not."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def binary_listing(spark: SparkSession, folder: str, suffix: str = ".bin") -> DataFrame:
    """``(item_id, path, length)`` of every binary; the content column is never read.

    Files of length 0 are not listed: they hold no light data, so their items stay pending.
    """
    name = F.substring_index("path", "/", -1)
    return (
        spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").load(folder)
        .select(F.left(name, F.length(name) - F.lit(len(suffix))).alias("item_id"), "path", "length")
    )


def orphan_binaries(binaries: DataFrame, catalog: DataFrame) -> DataFrame:
    """Binaries of items that are no longer in the catalog. Deleting them is up to the caller."""
    return binaries.join(catalog.select("item_id"), "item_id", "left_anti")


def invalidate_binary(binaries: DataFrame, invalid: DataFrame) -> DataFrame:
    """Listing without the given items, which makes them pending again; metadata is untouched."""
    return binaries.join(invalid.select("item_id"), "item_id", "left_anti")
