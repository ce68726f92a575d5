"""Library events: items to extract, binaries to drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.operators.backlog import exclude_libraries
from rimlight.sources.catalog import auto_extract_gate, default_name, item_type_filter, kind_of, path_filter


def stream_new_items(
    events: DataFrame, excluded: DataFrame, binaries: DataFrame, enabled: bool = True,
) -> DataFrame:
    """Added items that have to be extracted.

    The static sides are listed once, when the query is built. To see binaries written meanwhile,
    call this inside ``foreachBatch`` with tables that are read anew.
    """
    added = auto_extract_gate(events.where("event = 'added'"), enabled)
    items = exclude_libraries(path_filter(item_type_filter(added)), excluded)
    return items.join(binaries.select("item_id"), "item_id", "left_anti").select(
        "item_id", "library_id", default_name(F.col("name")).alias("name"), "item_type",
        kind_of(F.col("item_type")).alias("kind"), "path", "date_created")


def stream_removed_items(events: DataFrame, binaries: DataFrame) -> DataFrame:
    """Removed items whose binary is still there."""
    removed = item_type_filter(events.where("event = 'removed'"))
    return removed.join(binaries.select("item_id"), "item_id", "left_semi").select("item_id", "name")
