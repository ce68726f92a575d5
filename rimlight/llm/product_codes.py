"""Product codes of vectors by exact integer arithmetic on floating-point matrix products.

Every component x becomes the integer floor(``scale`` * x). Vectors are cut into ``parts`` equal parts, and each
part position has a codebook of ``entries`` integer vectors, which starts as the parts of the vectors with the
smallest ids. A round assigns each part to its nearest entry and replaces entries by the floored mean of their parts.

Distances are exact. Integers are broken into limbs of so few bits that a dot product of two limb vectors stays
below 2^53, so the products of whole batches by float64 BLAS are whole numbers without rounding; shifted by their
limbs' places they add up in int64 to the dot products, and |c|^2 - 2vc is compared by a first argmin, so
ties go to the lower entry. Where int64 cannot hold a distance the limb products are added as Python integers instead.

A round is one scan: each task sums the parts of every entry, limb by limb, and gives one row per (part, entry,
limb); Spark adds these up, and what reaches the driver is the new codebook (``parts`` * ``entries`` rows a limb), which goes
out with the next scan. No row is exchanged, whatever its label or vector; summing errors by label is a grouped
aggregate with partial sums, joined back to the codes.

Cases: rows whose vector is null, empty or holds null or non-finite components are dropped; a vector whose
length differs from that of the smallest id (or cannot be cut into equal parts) keeps its row with null code and
error; repeated ids are rows of their own, ties for the first codebook go by the vector, null ids come last;
fewer rows than entries give a shorter codebook; unused entries stay; an error beyond a long is null; an empty
table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rimlight.llm.common import broadcast_if_small, stored

#: Vectors whose distances to all entries are held at once (8 bytes * parts * entries each).
BLOCK = 1024
_LONG = 2**63


def integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), int64 where that is safe and Python integers beyond. ``scale`` is a power of two."""
    values = values.astype(np.float64)
    if not values.size or np.abs(values).max() < 2.0**60 / scale:
        return np.floor(values * scale).astype(np.int64)
    flat = [int(x) * scale if abs(x) >= 2.0**53 else int(np.floor(x * scale)) for x in values.ravel().tolist()]
    return np.array(flat, object).reshape(values.shape)


def limb_bits(width: int) -> int:
    """Bits of a limb such that ``width`` products of two limbs add up to 2^53 at most."""
    return (53 - (width - 1).bit_length()) // 2


def limbs(values: np.ndarray, bits: int) -> list[np.ndarray]:
    """Limbs from low to high with values = sum(limb_j << (j * bits)); the highest one carries the sign."""
    out = []
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    while not -(1 << bits) <= low <= high <= 1 << bits:
        out.append((values & ((1 << bits) - 1)).astype(np.float64))
        values, low, high = values >> bits, low >> bits, high >> bits
    return [*out, values.astype(np.float64)]


def dot_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact dot products of integer vectors: (parts, n, width) and (parts, k, width) to (parts, n, k)."""
    width = a.shape[-1]
    bits = limb_bits(width)
    largest = width * max(1, int(abs(a).max())) * max(1, int(abs(b).max())) if a.size and b.size else 0
    kind = np.int64 if largest < _LONG // 4 else object
    out = np.zeros((a.shape[0], a.shape[1], b.shape[1]), kind)
    second = [np.ascontiguousarray(x.transpose(0, 2, 1)) for x in limbs(b, bits)]
    for i, x in enumerate(limbs(a, bits)):
        for j, y in enumerate(second):
            product = (x @ y).astype(np.int64)
            out += product << (bits * (i + j)) if kind is np.int64 else product.astype(object) * (1 << (bits * (i + j)))
    return out


def nearest(vectors: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry and the squared distance: (parts, n, width) and (parts, k, width) to (parts, n) each."""
    dot = dot_products(vectors, books)
    wide = dot.dtype == object or max(_peak(vectors), _peak(books)) >= _LONG // 16
    if wide:
        vectors, books, dot = vectors.astype(object), books.astype(object), dot.astype(object)
    rest = (books * books).sum(axis=2)[:, None, :] - 2 * dot
    code = rest.argmin(axis=2)
    error = np.take_along_axis(rest, code[:, :, None], 2)[:, :, 0] + (vectors * vectors).sum(axis=2)
    return code, error


def _peak(values: np.ndarray) -> int:
    return values.shape[-1] * int(abs(values).max()) ** 2 if values.size else 0


def _blocks(batch: pa.RecordBatch, dims: int, parts: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of vectors with ``dims`` components, and their parts (parts, n, width)."""
    column = batch.column("vector")
    rows = np.flatnonzero(np.asarray(column.value_lengths()) == dims)
    for at in range(0, len(rows), BLOCK):
        some = rows[at:at + BLOCK]
        flat = column.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False)
        yield some, integers(flat.reshape(len(some), parts, -1), scale).transpose(1, 0, 2)


def _usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows with a vector that holds finite components only."""
    finite = F.forall(F.col(vector), lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where(F.coalesce(finite, F.lit(False)) & (F.size(vector) > 0))


def first_books(rows: DataFrame, parts: int, entries: int, scale: int) -> np.ndarray:
    """The parts of the ``entries`` smallest ids: (parts, entries, width)."""
    lowest = rows.where(F.size("vector") % parts == 0).orderBy(F.asc_nulls_last("vec_id"), "vector")
    found = [r.vector for r in lowest.limit(entries).select("vector").collect()]
    if found and {len(v) for v in found} != {len(found[0])}:
        found = [r.vector for r in lowest.where(F.size("vector") == len(found[0])).limit(entries).select("vector").collect()]
    if not found:
        return np.zeros((parts, 0, 0), np.int64)
    return integers(np.array(found, np.float64).reshape(len(found), parts, -1), scale).transpose(1, 0, 2)


def next_books(rows: DataFrame, books: np.ndarray, scale: int) -> np.ndarray:
    """One round: entries become the floored means of the parts that are nearest to them."""
    parts, entries, width = books.shape
    bits = limb_bits(width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(parts * entries, np.int64)
        sums: list[np.ndarray] = []
        for batch in batches:
            for _, vectors in _blocks(batch, parts * width, parts, scale):
                slot = (nearest(vectors, books)[0] + np.arange(parts)[:, None] * entries).ravel()
                counts += np.bincount(slot, minlength=len(counts))
                for j, limb in enumerate(limbs(vectors, bits)):
                    if j == len(sums):
                        sums.append(np.zeros((len(counts), width), np.int64))
                    for d in range(width):
                        sums[j][:, d] += np.bincount(slot, limb[:, :, d].ravel(), len(counts)).astype(np.int64)
        used = np.flatnonzero(counts)
        for j, total in enumerate(sums):
            # the count goes with the lowest limb
            yield pa.RecordBatch.from_arrays(
                [pa.array(used), pa.array(np.full(len(used), j)), pa.array(counts[used] * (j == 0)),
                 pa.array(list(total[used]), pa.list_(pa.int64()))], ["slot", "limb", "n", "sums"])

    partial = rows.select("vector").mapInArrow(run, "slot long, limb long, n long, sums array<long>")
    total = partial.groupBy("slot", "limb").agg(
        F.sum("n").alias("n"), *[F.sum(F.col("sums")[d].cast("decimal(20,0)")).alias(f"s{d}") for d in range(width)])
    counts: dict[int, int] = {}
    sums: dict[int, list[int]] = {}
    for r in total.collect():  # at most parts * entries rows a limb
        counts[r.slot] = counts.get(r.slot, 0) + r.n
        old = sums.get(r.slot, [0] * width)
        sums[r.slot] = [x + (int(r[f"s{d}"]) << (bits * r.limb)) for d, x in enumerate(old)]
    fresh = books.astype(object).reshape(parts * entries, width)
    for slot, n in counts.items():
        fresh[slot] = [x // n for x in sums[slot]]
    peak = max((abs(x) for x in fresh.ravel()), default=0)
    return fresh.reshape(books.shape).astype(np.int64 if peak < 2**62 else object)


def encoded(rows: DataFrame, books: np.ndarray, scale: int, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``code`` (two hex digits a part) and ``error`` (exact squared distance)."""
    parts, entries, width = books.shape
    digits = max(2, len(f"{max(entries - 1, 0):x}"))
    names = np.array([f"{e:0{digits}x}" for e in range(entries)], object)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = np.full(batch.num_rows, None, object)
            error = np.full(batch.num_rows, None, object)
            for at, vectors in _blocks(batch, parts * width, parts, scale) if entries else ():
                index, distance = nearest(vectors, books)
                code[at] = names[index].sum(axis=0)
                error[at] = [e if e < _LONG else None for e in distance.astype(object).sum(axis=0).tolist()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in keep], pa.array(code, pa.string()), pa.array(error, pa.int64())], [*keep, "code", "error"])

    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return rows.select(*keep, "vector").mapInArrow(run, schema)


def compress(
    vectors: DataFrame, parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256,
    vec_id: str = "vec_id", vector: str = "embedding", label: str = "label",
) -> tuple[DataFrame, np.ndarray]:
    """``vec_id, label, code, error, label_error`` of every usable row, and the codebooks (parts, entries, width)."""
    rows = _usable(vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).alias("label"), F.col(vector).alias("vector")), "vector")
    books = first_books(rows, parts, entries, scale)
    for _ in range(rounds if books.size else 0):
        books = next_books(rows, books, scale)
    coded = stored(encoded(rows, books, scale, ["vec_id", "label"]), "codes")
    totals = stored(coded.groupBy(F.col("label").alias("of_label")).agg(F.try_sum("error").alias("label_error")), "label-errors")
    return coded.join(broadcast_if_small(totals), F.col("label").eqNullSafe(F.col("of_label")), "left").drop("of_label"), books


def digest(books: np.ndarray) -> str:
    """SHA-256 of all components in decimal, by part, entry and position, comma-joined."""
    return hashlib.sha256(",".join(str(x) for x in books.ravel().tolist()).encode()).hexdigest()
