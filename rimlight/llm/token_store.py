"""Token-ID output: texts as lists of token ids in Parquet, in the order of their documents.

Layout below one folder:

* ``tokens/``  one row per document in ascending order of its id: ``shard`` (the write task, ascending
  with the ids), ``doc_id``, ``n_tokens``, ``shard_start`` (ids of the shard before this document) and
  ``ids``, a list of 32-bit integers. Lists are dictionary-encoded (16 bits an id for a vocabulary of
  50 000) and fall back to delta packing where a dictionary grows too large; the other columns are
  delta-packed without a dictionary. Row groups and pages are small and carry page indexes, so a
  reader of some documents or of the metadata alone touches little more than that.
* ``shards/``  one row per shard: ``shard`` and ``base``, the ids of all shards before it.

Cases: a null text is an empty one and has only the end id; null ids come first; rows that share an id
are ordered by a hash of their text and all kept; an empty table gives two empty tables; columns
besides the two named ones are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rimlight.llm.common import broadcast_if_small

SCHEMA = "shard int, doc_id long, n_tokens long, shard_start long, ids array<int>"
PARQUET = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "2000",
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#n_tokens": "false",
    "parquet.enable.dictionary#shard_start": "false",
}
DOCS_AT_ONCE = 256


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, text: str = "text", doc_id: str = "doc_id") -> None:
    """Encode every text with the tokenizer file, append ``end_id``, and write the store to ``path``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from rimlight.llm.tokenize import encoder_of

        encoder, shard, before = encoder_of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                lists = encoder.encode([t or "" for t in part.column("text").to_pylist()])
                n = np.fromiter((len(x) + 1 for x in lists), np.int64, len(lists))
                ends = np.cumsum(n)
                flat = np.full(int(ends[-1]), end_id, np.int32)
                for x, e in zip(lists, ends):
                    flat[e - 1 - len(x):e - 1] = x
                ids = pa.ListArray.from_arrays(np.concatenate(([0], ends)).astype(np.int32), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(n), shard, np.int32)), part.column("doc_id"), pa.array(n), pa.array(before + ends - n), ids],
                    names=["shard", "doc_id", "n_tokens", "shard_start", "ids"])
                before += int(ends[-1])

    order = [F.col("doc_id").asc_nulls_first(), F.col("h")]
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("h"))
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text")
    ordered.mapInArrow(encode, SCHEMA).write.options(**PARQUET).parquet(f"{path}/tokens")
    ends = _tokens(docs.sparkSession, path).groupBy("shard").agg(F.sum("n_tokens").alias("n"))  # reads two columns
    before = F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    ends.select("shard", F.coalesce(before, F.lit(0)).alias("base")).write.parquet(f"{path}/shards")


def _tokens(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).parquet(f"{path}/tokens")


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before), ``n_tokens``, ``ids``; limits on ids reach the pages.

    Select fewer columns and the lists are not read.
    """
    rows = _tokens(spark, path)
    if first is not None:
        rows = rows.where(F.col("doc_id") >= first)
    if last is not None:
        rows = rows.where(F.col("doc_id") <= last)
    shards = broadcast_if_small(spark.read.schema("shard int, base long").parquet(f"{path}/shards"))
    return rows.join(shards, "shard").select("doc_id", (F.col("base") + F.col("shard_start")).alias("start"), "n_tokens", "ids")


def with_crc32(rows: DataFrame) -> DataFrame:
    """``ids`` replaced by ``ids_crc32``, over the ids as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<u4")
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crc, pa.int64())],
                                             names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
