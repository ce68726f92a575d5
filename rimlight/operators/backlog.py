"""Which items still need light data, and in what order; status of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.functions import ids
from rimlight.sources.catalog import default_name, id_filter, item_type_filter, kind_of, path_filter
from rimlight.sources.metadata import new_item_defaults


def exclude_libraries(items: DataFrame, excluded: DataFrame) -> DataFrame:
    """Drop items of excluded libraries, whatever the spelling of the library id."""
    keys = excluded.select(ids.norm_library_id(F.col("library_id")).alias("_x")).distinct()
    return items.join(keys, ids.norm_library_id(F.col("library_id")) == F.col("_x"), "left_anti")


def existing_sources(items: DataFrame, files: DataFrame) -> DataFrame:
    return items.join(files.select("path"), "path", "left_semi")


def sync_catalog(catalog: DataFrame, stored: DataFrame, excluded: DataFrame, now: Column) -> DataFrame:
    """Metadata snapshot after a library sync: new items added, path and name refreshed.

    Items without a path are skipped; a blank path is taken over and keeps the item out of the backlog.
    """
    items = exclude_libraries(item_type_filter(catalog), excluded).where("path is not null and item_id <> ''")
    columns = [c for c in stored.columns if c != "item_id"]
    new = new_item_defaults(items, now, F.col("name").alias("_given")).groupBy("item_id").agg(
        F.max(F.struct(*columns, "_given")).alias("new"))
    old = stored.where("item_id <> ''").groupBy("item_id").agg(
        F.max(F.struct("updated_at", *[c for c in columns if c != "updated_at"])).alias("old"))
    seen, known = F.col("new").isNotNull(), F.col("old").isNotNull()

    def pick(name: str) -> Column:
        was, now_is = F.col(f"old.{name}"), F.col(f"new.{name}")
        if name == "created_at":
            return F.coalesce(was, now_is, now)
        if name == "updated_at":
            return F.when(seen, now).otherwise(was)
        if name == "name":
            now_is, known_name = default_name(F.col("new._given"), was), now_is
            return F.when(seen & known, now_is).when(seen, known_name).otherwise(was)
        if name == "path":
            return F.when(seen, now_is).otherwise(was)
        return F.when(known, was).otherwise(now_is)

    return old.join(new, "item_id", "full").select("item_id", *[pick(c).alias(c) for c in columns])


def pending_items(
    catalog: DataFrame, binaries: DataFrame, excluded: DataFrame, files: DataFrame | None = None,
    stored: DataFrame | None = None,
) -> DataFrame:
    """Items without a binary, earlier failures included, in all libraries that are not excluded.

    What is stored about an item comes before what the catalog says, its path included.
    """
    items = exclude_libraries(item_type_filter(catalog), excluded).where("path is not null").select(
        "item_id", "library_id", default_name(F.col("name")).alias("name"), "item_type",
        kind_of(F.col("item_type")).alias("kind"), "path", "date_created")
    if stored is not None:
        known = stored.select("item_id", F.struct(*[c for c in items.columns if c != "item_id"]).alias("_s"))
        items = items.join(known, "item_id", "left").select("item_id", *[
            F.when(F.col("_s").isNotNull(), F.col(f"_s.{c}")).otherwise(F.col(c)).alias(c) for c in items.columns if c != "item_id"])
    items = path_filter(items)
    if files is not None:
        items = existing_sources(items, files)
    columns = ["item_id", "library_id", "name", "item_type", "kind", "path", "date_created"]
    return items.join(binaries.select("item_id"), "item_id", "left_anti").select(*columns)


def backlog(pending: DataFrame, order: str | None = "newest_first") -> DataFrame:
    """Pending items in extraction order; unknown orders mean newest first, ties go by id.

    Unparsable dates count as the earliest date.
    """
    date = ids.parse_date(F.col("date_created"))
    newest, oldest = date.desc_nulls_last(), date.asc_nulls_first()
    sorts = {
        "oldest_first": [oldest],
        "alphabetical": [F.col("name").asc()],
        "movies_newest_first": [(F.col("kind") == "Movie").desc(), newest],
    }
    return pending.orderBy(*sorts.get((order or "").lower(), [newest]), F.col("item_id"))


def extraction_stats(items: DataFrame, binaries: DataFrame) -> DataFrame:
    """Totals: all, completed with an existing binary, failed."""
    joined = items.join(
        binaries.select("item_id").distinct().withColumn("_has", F.lit(True)), "item_id", "left")
    return joined.agg(
        F.count(F.lit(1)).alias("total_videos"),
        F.count_if((F.col("extraction_status") == "completed") & F.col("_has")).alias("extracted_videos"),
        F.count_if(F.col("extraction_status") == "failed").alias("failed_videos"))


def _status_columns(folder: str, path_known: Column) -> list[Column]:
    has = F.col("_length").isNotNull() & path_known
    return [
        F.col("name").alias("item_name"),
        has.alias("has_binary"),
        F.when(path_known, F.concat(F.lit(f"{folder}/"), F.col("guid"), F.lit(".bin"))).alias("binary_path"),
        F.when(has, F.col("_length")).otherwise(F.lit(0)).cast("long").alias("binary_size"),
        F.when(path_known, F.col("extraction_status")).alias("extraction_status"),
        *[F.when(path_known, F.coalesce(F.col(c), F.lit(0))).otherwise(F.lit(0)).alias(c)
          for c in ("extraction_progress", "frames_current", "frames_total")],
    ]


def _with_state(requests: DataFrame, catalog: DataFrame, items: DataFrame, binaries: DataFrame,
                how: str) -> DataFrame:
    known = catalog.select(F.col("item_id").alias("guid"), "name", "path", F.lit(True).alias("_known"))
    meta = items.select(F.col("item_id").alias("guid"), "extraction_status", "extraction_progress",
                        "frames_current", "frames_total")
    sizes = binaries.select(F.col("item_id").alias("guid"), F.col("length").alias("_length"))
    return requests.join(known, "guid", how).join(meta, "guid", "left").join(sizes, "guid", "left")


def batch_status(
    requests: DataFrame, catalog: DataFrame, items: DataFrame, binaries: DataFrame,
    folder: str = "/data/lights",
) -> DataFrame:
    """Status of the requested ids that exist; repeated requests give one row per spelling."""
    wanted = id_filter(requests.select("item_id")).distinct()
    joined = _with_state(wanted, catalog, items, binaries, "inner")
    return joined.select("item_id", "guid", *_status_columns(folder, F.lit(True)))


def item_status(
    requests: DataFrame, catalog: DataFrame, items: DataFrame, binaries: DataFrame,
    folder: str = "/data/lights",
) -> DataFrame:
    """Status per requested id; unknown items and items without a path give a bare row."""
    joined = _with_state(id_filter(requests.select("item_id")), catalog, items, binaries, "left")
    path_known = F.coalesce(F.col("_known") & (F.col("path") != ""), F.lit(False))
    return joined.select("item_id", "guid", *_status_columns(folder, path_known))


def series_recency(episodes: DataFrame) -> DataFrame:
    """Series ordered by their newest episode."""
    return (
        episodes.groupBy("series_id").agg(
            F.max(ids.parse_date(F.col("date_created"))).alias("newest"),
            F.count(F.lit(1)).alias("episodes"))
        .orderBy(F.col("newest").desc_nulls_last(), "series_id")
    )
