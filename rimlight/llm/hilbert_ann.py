"""Approximate nearest neighbours by shifted space-filling curves.

Every vector is projected on a few random directions, shifted, put on a grid and given its place on a Hilbert
curve; ``CURVES`` such orderings differ in directions and shift. Spark sorts the places by range partitioning,
so each vector has a rank on every curve. A query is compared with all vectors within ``window`` ranks on any
curve, by exact distance in double precision; what the curves found is merged and ranked again.

The window is measured, not guessed: for a bounded sample of queries the true neighbours are found by brute
force (one pass over the vectors), and the window is the one that ``RECALL`` of them fall into on some curve.
So data without structure gets a wide window and stays correct, and clustered data a narrow one.

Equal vectors are one point of the index and carry the ``k`` + 1 smallest of their ids: exactly those that a
result of ``k`` can need. Points are ordered by (distance, smallest id) wherever some are kept. Curves are cut into blocks of ``BLOCK`` ranks, and queries are sent to the blocks in
their window, so a task never holds more than a block and a bounded number of queries.

Cases: vectors that are null, zero or hold null or non-finite components, rows without an id, and vectors of
another length than most take no part, neither as query nor as candidate; fewer than ``k`` candidates give
fewer rows; ties go to the smaller id; of repeated ids the nearest counts; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import broadcast_if_small, stored

CURVES = 16
DIRECTIONS = 6
BITS = 8
BLOCK = 1024
QUERIES_PER_GROUP = 2048
SAMPLE = 64
RECALL = 0.98
LEAST_WINDOW = 32
SALTS = 64


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Places on the Hilbert curve of integer grid points (rows), by Skilling's transpose method."""
    x = [cells[:, i].astype(np.int64) for i in range(cells.shape[1])]
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        low = q - 1
        for i in range(len(x)):
            on = (x[i] & q) != 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(on, x[0] ^ low, x[0] ^ swap)
            if i:
                x[i] = x[i] ^ swap
        q >>= 1
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    flip, q = np.zeros_like(x[0]), top
    while q > 1:
        flip = np.where((x[-1] & q) != 0, flip ^ (q - 1), flip)
        q >>= 1
    place = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for axis in x:
            place = (place << 1) | (((axis ^ flip) >> b) & 1)
    return place


def _directions(width: int) -> np.ndarray:
    """Random orthogonal directions, as many as there are components at most, for every curve."""
    rng = np.random.default_rng(11)
    n = min(width, DIRECTIONS)
    return np.stack([np.linalg.qr(rng.normal(size=(width, width)))[0][:, :n] for _ in range(CURVES)])


def _decoded(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(-1, width)


def points(vectors: DataFrame, k: int, vector: str, vec_id: str) -> tuple[DataFrame, DataFrame, int]:
    """The distinct vectors (``a``, ``b`` hashes, ``point`` bytes) with their smallest ids, all usable rows, and the length."""
    body = F.transform(F.col(vector), lambda x: x.cast("double"))
    usable = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.exists("v", lambda x: x != 0)
              & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), body.alias("v")).where(F.coalesce(usable, F.lit(False)))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.col("c").desc(), F.col("n").desc()).first()
    width = lengths["n"] if lengths else 1
    rows = rows.where(F.size("v") == width).select("vec_id", "v", F.xxhash64("v").alias("a"), F.xxhash64(F.lit("b"), "v").alias("b"))

    def least(frame: DataFrame, *keys: Column) -> DataFrame:
        order = F.row_number().over(Window.partitionBy(*keys).orderBy("vec_id"))
        return frame.withColumn("n", order).where(F.col("n") <= k + 1).drop("n")

    few = least(least(rows, F.col("a"), F.col("b"), F.pmod("vec_id", F.lit(SALTS))), F.col("a"), F.col("b"))

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = batch.column("v")
            flat = np.ascontiguousarray(v.flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, width)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), batch.column("ids"), pa.array([r.tobytes() for r in flat], pa.binary())],
                                             names=["a", "b", "ids", "point"])

    grouped = few.groupBy("a", "b").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.first("v").alias("v"))
    return stored(grouped.mapInArrow(packed, "a long, b long, ids array<long>, point binary"), "points"), rows.select("vec_id", "a", "b"), width


def _bounds(index: DataFrame, turned: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest projection in every direction of every curve."""
    def extremes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lo = hi = None
        for batch in batches:
            if batch.num_rows:
                p = np.einsum("nw,cwd->ncd", _decoded(batch.column("point"), width), turned).reshape(batch.num_rows, -1)
                lo = p.min(axis=0) if lo is None else np.minimum(lo, p.min(axis=0))
                hi = p.max(axis=0) if hi is None else np.maximum(hi, p.max(axis=0))
        if lo is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(lo))), pa.array(lo), pa.array(hi)], names=["i", "lo", "hi"])

    found = index.select("point").mapInArrow(extremes, "i long, lo double, hi double").groupBy("i").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("i").collect()
    shape = (turned.shape[0], turned.shape[2])
    if not found:
        return np.zeros(shape), np.zeros(shape)
    return np.array([r["lo"] for r in found]).reshape(shape), np.array([r["hi"] for r in found]).reshape(shape)


def ranked(index: DataFrame, width: int) -> DataFrame:
    """``curve``, ``rank``, ``a``, ``b``: the order of all points on every curve."""
    turned = _directions(width)
    lo, hi = _bounds(index, turned, width)
    span = np.maximum(hi - lo, 1e-12)
    shift = np.random.default_rng(13).random(lo.shape) * span

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.einsum("nw,cwd->cnd", _decoded(batch.column("point"), width), turned)
            for c in range(CURVES):
                grid = np.clip(((p[c] - lo[c] + shift[c]) / (2 * span[c]) * (1 << BITS)).astype(np.int64), 0, (1 << BITS) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(grid), c, np.int32)), pa.array(hilbert(grid, BITS)), batch.column("a"), batch.column("b")],
                                                 names=["curve", "place", "a", "b"])

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(np.arange(n, n + batch.num_rows)),
                                              *(batch.column(c) for c in ("curve", "a", "b"))], names=["part", "at", "curve", "a", "b"])
            n += batch.num_rows

    order = ["curve", "place", "a", "b"]
    sorted_ = index.mapInArrow(placed, "curve int, place long, a long, b long").repartitionByRange(*order).sortWithinPartitions(*order)
    rows = stored(sorted_.mapInArrow(numbered, "part int, at long, curve int, a long, b long"), "ranks")
    parts = rows.groupBy("curve", "part").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    before = F.sum("n").over(Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = stored(parts.select("curve", "part", (F.coalesce(before, F.lit(0)) - F.col("first")).alias("base")), "parts")
    return rows.join(broadcast_if_small(parts), ["curve", "part"]).select("curve", (F.col("base") + F.col("at")).alias("rank"), "a", "b")


def _distances(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    diff = rows - query
    return np.sqrt((diff * diff).sum(axis=1))


def true_neighbours(index: DataFrame, queries: list[tuple[int, int, bytes]], k: int, width: int) -> list[tuple]:
    """Brute force for a bounded list of queries: (query a, b, neighbour a, b, distance), ``k`` points each."""
    asked = np.frombuffer(b"".join(q[2] for q in queries), "<f8").reshape(-1, width)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _decoded(batch.column("point"), width)
            a, b, least = (batch.column(c).to_numpy() for c in ("a", "b", "least"))
            out = []
            for q, (qa, qb, _) in enumerate(queries):
                d = _distances(asked[q], rows)
                d[(a == qa) & (b == qb)] = np.inf
                for i in np.lexsort((least, d))[:k]:
                    if d[i] < np.inf:
                        out.append((q, int(a[i]), int(b[i]), int(least[i]), float(d[i])))
            yield pa.RecordBatch.from_pylist([dict(zip(("q", "a", "b", "least", "d"), r)) for r in out],
                                             schema=pa.schema([("q", pa.int32()), *((c, pa.int64()) for c in ("a", "b", "least")), ("d", pa.float64())]))

    rank = F.row_number().over(Window.partitionBy("q").orderBy("d", "least", "a", "b"))
    rows = index.select("a", "b", F.element_at("ids", 1).alias("least"), "point").mapInArrow(nearest, "q int, a long, b long, least long, d double").withColumn("n", rank).where(F.col("n") <= k).collect()
    return [(*queries[r["q"]][:2], r["a"], r["b"], r["d"]) for r in rows]


def measured_window(index: DataFrame, ranks: DataFrame, asked: DataFrame, k: int, width: int) -> int:
    """The window that the ``RECALL`` share of a query sample's true neighbours fall into on some curve."""
    sample = [tuple(r) for r in asked.join(index, ["a", "b"]).select("a", "b", "point").orderBy("a", "b").limit(SAMPLE).collect()]
    truth = true_neighbours(index, sample, k, width) if sample else []
    if not truth:
        return LEAST_WINDOW
    spark = index.sparkSession
    wanted = spark.createDataFrame(sorted({t[:2] for t in truth} | {t[2:4] for t in truth}), "a long, b long")
    place = {(r["curve"], r["a"], r["b"]): r["rank"] for r in ranks.join(F.broadcast(wanted), ["a", "b"]).collect()}
    apart = sorted(min(abs(place[c, qa, qb] - place[c, na, nb]) for c in range(CURVES)) for qa, qb, na, nb, _ in truth)
    return max(LEAST_WINDOW, apart[min(len(apart) - 1, int(np.ceil(RECALL * len(apart))))])


def _first_choice(q: np.ndarray, body: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Rows that can be among the ``n`` nearest: all whose expanded distance is within rounding of the n-th, ties included."""
    qq = q @ q
    rough = own - 2 * (body @ q) + qq
    error = 4 * (len(q) + 4) * np.finfo(float).eps * (own + 2 * np.sqrt(own) * np.sqrt(qq) + qq)
    return np.flatnonzero(~(rough - error > np.partition(rough + error, n - 1)[n - 1]))  # what overflowed stays


def _compare(window: int, width: int, k: int):
    def compare(rows: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(rows) and len(asked):
            body = np.frombuffer(b"".join(rows["point"]), "<f8").reshape(-1, width)
            own = (body * body).sum(axis=1)
            rank, a, b, least = (rows[c].to_numpy() for c in ("rank", "a", "b", "least"))
            for qr, qa, qb, qp in zip(asked["rank"], asked["a"], asked["b"], asked["point"]):
                near = np.flatnonzero(np.abs(rank - qr) <= window)
                q = np.frombuffer(qp, "<f8")
                if len(near) > k + 1:
                    near = near[_first_choice(q, body[near], own[near], k + 1)]
                d = _distances(q, body[near])
                for i in np.lexsort((b[near], a[near], least[near], d))[:k + 1]:
                    out.append((qa, qb, a[near[i]], b[near[i]], least[near[i]], d[i]))
        return pd.DataFrame(out, columns=["qa", "qb", "a", "b", "least", "score"])

    return compare


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, vector: str = "embedding", vec_id: str = "vec_id") -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (Euclidean distance) for the rows whose id meets ``is_query`` (over ``vec_id``)."""
    index, rows, width = points(vectors, k, vector, vec_id)
    queries = stored(rows.where(is_query), "queries")
    asked = stored(queries.select("a", "b").distinct(), "asked")
    ranks = stored(ranked(index, width), "order")
    window = measured_window(index, ranks, asked, k, width)
    n_asked, n_points = asked.count(), max(1, index.count())
    shares = max(1, -(-(2 * window + BLOCK) * n_asked // (n_points * QUERIES_PER_GROUP)))
    body = index.select("a", "b", "point")
    here = (ranks.join(index.select("a", "b", F.element_at("ids", 1).alias("least"), "point"), ["a", "b"]).withColumn("block", F.floor(F.col("rank") / BLOCK))
            .withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(shares - 1)))))
    sent = (stored(ranks.join(asked, ["a", "b"], "left_semi").join(body, ["a", "b"]), "sent")
            .withColumn("share", F.pmod(F.xxhash64("a", "b"), F.lit(shares)).cast("int"))
            .withColumn("block", F.explode(F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / BLOCK), F.floor((F.col("rank") + window) / BLOCK)))))
    key = ["curve", "block", "share"]
    found = (here.groupBy(*key).cogroup(sent.groupBy(*key))
             .applyInPandas(_compare(window, width, k), "qa long, qb long, a long, b long, least long, score double")
             .dropDuplicates(["qa", "qb", "a", "b"]))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("qa", "qb").orderBy("score", "least", "a", "b"))).where(F.col("n") <= k + 1).drop("n", "least")
    ids = best.join(index.select("a", "b", "ids"), ["a", "b"]).select("qa", "qb", "score", F.explode("ids").alias("vec_id"))
    merged = (queries.select(F.col("vec_id").alias("query_id"), F.col("a").alias("qa"), F.col("b").alias("qb")).distinct()
              .join(ids, ["qa", "qb"]).where(F.col("vec_id") != F.col("query_id")).groupBy("query_id", "vec_id").agg(F.min("score").alias("score")))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return merged.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
