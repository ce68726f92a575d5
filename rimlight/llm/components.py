"""Connected components of an edge table by alternating large and small stars, all in Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """``id``, ``component`` (the smallest id it reaches) for every id of the edges (``a``, ``b``).

    Each round hangs neighbours below the smallest id seen; rounds grow with the logarithm of the
    number of nodes. Every round is written, so lineage stays short.
    """
    edges = stored(_ordered(edges.select("a", "b").mapInArrow(_forest, "a long, b long")), "edges")
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(low, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        # the lower ends hang below the least of them, and so does the upper end
        lower = large.join(down, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = _ordered(lower.unionByName(down.select("a", F.col("m").alias("b"))))
        edges = stored(small, "edges")
        before, mark = mark, _mark(edges)
        if before == mark:
            break
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
        edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's edges those that connect something new; the components stay the same."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up]
            x = parent[x]
        return x

    for batch in batches:
        kept_a, kept_b = [], []
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            p, q = top(a), top(b)
            if p != q or a == b:
                parent[max(p, q)] = min(p, q)
                kept_a.append(a)
                kept_b.append(b)
        yield pa.RecordBatch.from_arrays([pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], names=["a", "b"])


def _ordered(edges: DataFrame) -> DataFrame:
    """Distinct edges with the larger id first, loops left out."""
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") > F.col("b")).distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
