"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.session import fresh_folder, shared_folder

SPACE = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
#: Rows up to which a table is broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 100_000

#: Rows that travel to a Python worker at once. A batch is held by the JVM and the worker several times over, and texts
#: are long: Spark's default of 10 000 rows takes some 100 MB a task on either side.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. ``lower`` does just that where all characters are ASCII."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from: a fifth of the ids by CRC, and rows without an id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage is cut, rows outlive executors."""
    path = fresh_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast a stored table whose counted rows stay below the bound, else leave the join to a shuffle."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased (what ``bytes`` does by itself)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready(spark: SparkSession) -> None:
    """Workers can import this package, intermediate tables have a shared folder, and batches have ``BATCH_ROWS`` at most."""
    from rimlight.session import ship_package

    ship_package(spark)
    shared_folder(spark)
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, str(BATCH_ROWS))
