"""Line dedup: lines that many documents share are dropped from all of them.

Lines are exploded as 128-bit hashes of their normalised form. Each document counts once for a
hash; hashes of ``min_docs`` or more documents are frequent. The frequent hashes of a document
come back to it by its id, and the document is put together again from its other lines, in place.

Cases: a null text is an empty text, which is one empty line; lines whose key is shorter than
``min_chars`` never go; every row counts as a document, rows that share an id as well; rows without
an id are handled like others; columns besides the two named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import SPACE, broadcast_if_small, lower_ascii, stored

#: Frequent hashes (two longs each) up to which they are broadcast to the scan: some 20 MB.
BROADCAST_KEYS = 500_000


def _line_key(line: Column, min_chars: int) -> Column:
    # arrays of one give the stripped line and the key a name: each is worked out once, not at every use of it
    key = F.transform(F.array(F.btrim(line, F.lit(SPACE))), lower_ascii)
    hashes = F.transform(key, lambda k: F.when(
        F.length(k) >= min_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit("line"), k).alias("g"))))
    return F.get(hashes, F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def dedup_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``text`` without the shared lines, ``n_lines``, ``n_dropped``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    keys = F.filter(F.array_distinct(F.transform(_lines(F.col("text")), lambda x: _line_key(x, min_chars))), lambda k: k.isNotNull())
    exploded = docs.select("doc_id", F.explode(keys).alias("k")).select("doc_id", "k.h", "k.g")
    frequent = stored(exploded.groupBy("h", "g").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs).select("h", "g"), "lines")
    dropped = (exploded.join(broadcast_if_small(frequent, BROADCAST_KEYS), ["h", "g"])
               .groupBy("doc_id").agg(F.collect_set(F.struct("h", "g")).alias("gone"))
               .withColumnRenamed("doc_id", "gone_id"))
    lines = _lines(F.col("text"))
    kept = F.when(F.col("gone").isNull(), lines).otherwise(
        F.filter(lines, lambda x: ~F.coalesce(F.array_contains(F.col("gone"), _line_key(x, min_chars)), F.lit(False))))
    return (docs.join(dropped, F.col("doc_id").eqNullSafe(F.col("gone_id")), "left")
            .select("doc_id", F.size(lines).cast("long").alias("n_lines"), kept.alias("kept"))
            .select("doc_id", F.array_join("kept", "\n").alias("text"), "n_lines",
                    (F.col("n_lines") - F.size("kept")).alias("n_dropped")))
