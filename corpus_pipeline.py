"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

Language ID drops documents whose words are not of the learned languages; the Jaccard join keeps the smallest id of each group
of near copies; decontamination drops documents that cover a benchmark item; mixing repeats and drops
documents until sources have their target sizes; the last stage writes token ids and returns their index.

Every stage passes on all columns and rows that it does not decide against, in any column types; stages read
``doc_id``, ``text``, ``lang`` and ``source`` and give null, empty and repeated rows the results that the
operators define. Rows without an id have no near copies. Of rows with one id and one text the near-copy stage keeps one;
unlike texts under one id are documents of their own.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.llm import decontam, jaccard_join, langid, mixing, token_store
from rimlight.llm.common import broadcast_if_small, ready, stored
from rimlight.session import fresh_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
ORACLE_SQL = None


def _new(docs: DataFrame, name: str) -> str:
    """A column name that ``docs`` does not have."""
    while name in docs.columns:
        name += "_"
    return name


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose words are of learned languages, of one or of several."""
    ready(spark)
    return langid.keep_known(docs, langid.fit(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest id, of each group of near copies. Texts that are not linked all stay, under one id too."""
    ready(spark)
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = _replaced(docs, "doc_id")
        return docs.join(broadcast_if_small(gone), docs["doc_id"] == gone["gone"], "left_anti").select(docs.columns)
    # ids do not tell rows apart: every (id, text) gets a number of its own, in their order
    h, g, row = (_new(docs, n) for n in ("h", "g", "row"))
    hashed = named.withColumns({h: F.xxhash64("text"), g: F.xxhash64(F.lit("row"), "text")})
    order = ["doc_id", h, g]
    rows = stored(hashed.select(order).distinct().repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        row, F.monotonically_increasing_id()), "rows")
    numbered = stored(hashed.join(rows, order), "numbered")
    gone = _replaced(numbered, row)
    kept = numbered.join(broadcast_if_small(gone), numbered[row] == gone["gone"], "left_anti")
    return kept.dropDuplicates([row]).select(docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))


def _replaced(docs: DataFrame, key: str) -> DataFrame:
    """``gone``: keys of documents for which one with a smaller key stays."""
    groups = jaccard_join.similar_groups(docs, doc_id=key)
    return stored(groups.where(F.col("component_id") != F.col("doc_id")).select(F.col("doc_id").alias("gone")).distinct(), "gone")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that cover no benchmark item."""
    ready(spark)
    return decontam.drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    ready(spark)
    h, copies, copy = (_new(docs, n) for n in ("h", "copies", "copy"))
    taken = mixing.mix(docs).where(F.col("copies") > 0).select(
        F.col("doc_id").alias("t_doc"), F.col("source").alias("t_source"), F.col("h").alias("t_h"), F.col("copies").alias(copies))
    keyed = docs.withColumn(h, mixing.unit_hash())
    same = F.col("doc_id").eqNullSafe(taken["t_doc"]) & F.col("source").eqNullSafe(taken["t_source"]) & (F.col(h) == taken["t_h"])
    return keyed.join(taken, same).withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(docs.columns)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token store's index: place, length and checksum of every document's ids."""
    ready(spark)
    path = fresh_folder(spark, "tokens")
    token_store.write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.with_crc32(token_store.read_tokens(spark, path))


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("near_copies", near_copies),
    ("decontaminated", decontaminated),
    ("mixed", mixed),
    ("token_ids", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    ready(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
