"""N-gram Jaccard join by PartEnum signatures.

A document is the set of its five-word shingles. Two sets of sizes r <= s with a Jaccard similarity of
0.8 or more differ in at most k = (r + s) / 9 shingles, and s <= 1.25 r. Sizes are cut into bands so narrow
that a set meets its partners in its own band or the one below. For each band the shingle domain is
divided twice: into more than k / 2 partitions, and each of these into three parts. Two similar sets
differ by less than two shingles in some partition, so at least two of its three parts are the same in
both. A signature is the hash of a band, a partition, a pair of its parts and the shingles in these: three
signatures a partition, of four to five shingles each.

Signatures of few shingles tell little: the empty ones nothing, and one that holds a single shingle of
a widely used line is shared by many documents that have nothing else in common. Only those of two
or more shingles are used (of one in the bands of small sets). What it costs to leave no telling signature
of a partition in common is then two differences where all three are telling, one where some are, none
where none is; there are some more partitions than needed, so that these costs exceed k in nearly every set.
Where they do, a telling signature is shared by any similar set. The few other sets emit all their
signatures, empty ones as well; of two similar sets both must be of that kind to need it.

Steps, each a Spark job over all rows:

1. every text becomes a 128-bit key of its words, the size of its set and a histogram of it;
   equal keys are one class;
2. signatures, of one text per key and task, travel packed in blocks; each block group finds the
   signatures of two or more texts (a bucket);
3. every member of a bucket is compared with one representative, the member that occurs in most buckets (copies
   meet their original more often than each other): first the histograms, which bound the number of
   shared shingles from above, then, if they allow it, the shingle sets, exactly;
4. buckets that still hold members of different components are compared pair by pair in that way, in
   blocks of bounded size, each pair of blocks a group of its own;
5. verified links, and membership in classes, give the components.

Links inside a component need not be enumerated; a pair is skipped only if it is connected already or
proven dissimilar, so no link between different components is lost.

Cases: null, empty and blank texts have no shingles and no links; a text of fewer than five words is one
shingle; repeated texts are one class; rows that share an id are one node; a row without an id is
counted but links with nothing; columns besides the two named ones are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from rimlight.llm.common import stored, words_of
from rimlight.llm.components import components

SHINGLE_WORDS = 5
PERCENT = 80
#: Signatures that one block group holds on average (16 bytes each).
GROUP_SIGNATURES = 500_000
#: Signatures that a task packs at once.
PACKED = 1_000_000
#: Members of one comparison group, and of one block of a bucket.
MEMBERS = 500
#: Shingles (8 bytes each) of the texts that are compared within one group.
GROUP_SHINGLES = 3_000_000
#: Bytes of a table of texts and members before it is packed to bits, and pairs compared at once (1 kB each).
TABLE_BYTES, PAIRS_AT_ONCE = 16 << 20, 8_000
#: Cells of a set's histogram, one byte each.
CELLS = 256
#: Bands up to this size take signatures of a single shingle.
SMALL = 64
#: Bits of the sieve that spares most documents a shuffle; beyond its reach more pass, the result is the same.
SIEVE_BITS = 1 << 24
#: Parts of a partition, of which two similar sets differ in one at most in some partition.
PARTS = 3
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """64-bit finalizer: every input bit reaches every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``n``-word shingles; of the whole where there are fewer words."""
    if not words:
        return np.zeros(0, np.uint64)
    hashed = _mixed(np.fromiter(map(xxh3_64_intdigest, words), np.uint64, len(words)))
    n = min(n, len(words))
    rolled = np.full(len(words) - n + 1, n, np.uint64)
    for j in range(n):
        rolled = rolled * _MULTIPLIER + hashed[j:j + len(rolled)]
    rolled = np.sort(_mixed(rolled))
    return rolled[np.concatenate(([True], rolled[1:] != rolled[:-1]))]


class Bands:
    """Size bands and, for each, the number of partitions and how far two of its sets may differ."""

    def __init__(self, percent: int = PERCENT) -> None:
        self.percent = percent
        self.high = [0]
        self.salts: dict[int, np.ndarray] = {}

    def of(self, size: int) -> int:
        while self.high[-1] < size:
            low = self.high[-1] + 1
            self.high.append(max(low, low * 100 // self.percent))
        return int(np.searchsorted(self.high, size))

    def plan(self, band: int) -> tuple[int, int, int]:
        """How far two sets may differ, the number of partitions, and the least shingles of a telling signature."""
        top = self.high[band]
        most = (top + top * 100 // self.percent) * (100 - self.percent) // (100 + self.percent)
        return most, (most // 2 + 1) * 6 // 5 + 2, 1 if top <= SMALL else 2

    def salt(self, band: int, parts: int) -> np.ndarray:
        """What sets the signatures of a band and of its parts apart."""
        if band not in self.salts:
            self.salts[band] = _mixed(np.arange(parts, dtype=np.uint64) * _MULTIPLIER ^ _mixed(np.array([band], np.uint64))[0])
        return self.salts[band]

    def signatures(self, members: np.ndarray) -> np.ndarray:
        band = self.of(len(members))
        out = []
        for b in (band, band - 1):
            if b < 1 or len(members) * self.percent > self.high[b] * 100:
                continue
            differ, partitions, least = self.plan(b)
            parts = PARTS * partitions
            place = (((members >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.int64)  # ascending, as members are
            body, held = np.zeros(parts, np.uint64), np.bincount(place, minlength=parts)
            filled = np.flatnonzero(held)
            body[filled] = np.add.reduceat(_mixed(members ^ np.uint64(b)), (np.cumsum(held) - held)[filled])
            # a signature leaves out one part of its partition
            body, held = (x.reshape(partitions, PARTS).sum(axis=1, keepdims=True, dtype=x.dtype) - x.reshape(partitions, PARTS) for x in (body, held))
            sigs = _mixed(body.ravel() ^ self.salt(b, parts))
            telling = held >= least
            cost = telling.any(axis=1).sum() + telling.all(axis=1).sum()
            out.append(sigs[telling.ravel()] if cost > differ else sigs)
        return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _histogram(members: np.ndarray) -> bytes:
    """Shingles by cell, at most 255."""
    return np.minimum(np.bincount((members % np.uint64(CELLS)).astype(np.int64), minlength=CELLS), 255).astype(np.uint8).tobytes()


def _cells(column) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint8).reshape(-1, CELLS)


def _may_be_similar(cells_a: np.ndarray, size_a: np.ndarray, cells_b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """False where sizes or histograms prove that too few shingles are shared (rows against rows, or one against rows).

    Cells bound the shared shingles by the lesser counts; shingles beyond a full cell's 255 could all be shared.
    """
    need = -(-PERCENT * (size_a + size_b) // (100 + PERCENT))
    beyond = np.minimum(size_a - cells_a.sum(axis=-1, dtype=np.int64), size_b - cells_b.sum(axis=-1, dtype=np.int64))
    return (np.minimum(size_a, size_b) >= need) & (np.minimum(cells_a, cells_b).sum(axis=-1, dtype=np.int64) + beyond >= need)


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keys, sizes, cells = [], [], []
        for text in batch.column("text").to_pylist():
            words = words_of(text)
            members = shingle_set(words)
            keys.append(hashlib.md5(b" ".join(words), usedforsecurity=False).digest() if words else None)
            sizes.append(len(members))
            cells.append(_histogram(members))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(cells, pa.binary())],
                                         names=["doc_id", "key", "n_shingles", "cells"])


def _pack(groups: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bands, seen = Bands(), set()
        sigs, ids, held = [], [], 0

        def packed() -> pa.RecordBatch:
            sig = np.concatenate(sigs)
            doc = np.repeat(np.array(ids, np.int64), [len(s) for s in sigs])
            group = (sig % np.uint64(groups)).astype(np.int32)
            order = np.argsort(group, kind="stable")
            sig, doc, group = sig[order], doc[order], group[order]
            at = np.flatnonzero(np.diff(group, prepend=-1))
            ends = np.append(at[1:], len(group))
            short = sig.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 3:]  # equal ones stay equal; a chance match is only a candidate
            step = np.diff(doc, prepend=0)
            step[at] = doc[at]
            return pa.RecordBatch.from_arrays([
                pa.array(group[at]), pa.array([short[a:e].tobytes() for a, e in zip(at, ends)], pa.binary()),
                pa.array([step[a:e].tobytes() for a, e in zip(at, ends)], pa.binary())], names=["part", "sigs", "ids"])

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                if doc_id is None or not words:
                    continue
                key = hashlib.md5(b" ".join(words), usedforsecurity=False).digest()
                if key in seen:
                    continue
                seen.add(key)
                sigs.append(bands.signatures(shingle_set(words)))
                ids.append(doc_id)
                held += len(sigs[-1])
                if held >= PACKED:
                    yield packed()
                    sigs, ids, held = [], [], 0
        if held:
            yield packed()

    return pack


def _buckets(pdf: pd.DataFrame) -> pd.DataFrame:
    """Signatures of several texts: ``sig`` and the sorted ``ids``, each set of ids once."""
    short = np.frombuffer(b"".join(pdf["sigs"]), np.uint8).reshape(-1, 5)
    sig = np.zeros((len(short), 8), np.uint8)
    sig[:, 3:] = short
    sig = sig.view("<u8").reshape(-1)
    doc = np.concatenate([np.cumsum(np.frombuffer(b, np.int64)) for b in pdf["ids"]])
    order = np.argsort(sig, kind="stable")
    sig, doc = sig[order], doc[order]
    same = sig[1:] == sig[:-1]
    several = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    sig, doc = sig[several], doc[several]
    order = np.lexsort((doc, sig))
    sig, doc = sig[order], doc[order]
    at = np.flatnonzero(np.concatenate(([True], sig[1:] != sig[:-1]))) if len(sig) else np.zeros(0, int)
    marks, known, rows = doc.tobytes(), set(), []
    for a, e in zip(at.tolist(), np.append(at[1:], len(sig)).tolist()):
        mark = marks[8 * a:8 * e]
        if mark in known:
            continue
        known.add(mark)
        ids = np.unique(doc[a:e])  # an id may be there several times
        if len(ids) < 2 or (len(ids) < e - a and ids.tobytes() in known):
            continue
        known.add(ids.tobytes())
        rows.append((int(sig[a].astype(np.int64)), ids))
    return pd.DataFrame(rows, columns=["sig", "ids"])


def _with_representatives(buckets: DataFrame) -> DataFrame:
    """``sig``, ``rep``, ``n`` (members) and ``id`` of the members of all buckets; the representative is in most buckets of all members."""
    member = buckets.select("sig", F.size("ids").alias("n"), F.explode("ids").alias("id"))
    often = member.groupBy("id").agg(F.count(F.lit(1)).alias("w"))
    rep = member.join(often, "id").groupBy("sig").agg(F.max_by("id", F.struct("w", F.xxhash64("id"), "id")).alias("rep"))
    return stored(member.join(rep, "sig").select("sig", "rep", "n", "id"), "members")


def _unsettled(member: DataFrame, found: DataFrame, rows: DataFrame) -> DataFrame:
    """Members of buckets with several components, dealt to pairs of blocks (``pair``; ``side`` is 0 within one block)."""
    rest = stored(member.where(F.col("n") > 2).join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), "rest")
    several = rest.groupBy("sig").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("sig")
    blocks = F.ceil(F.col("n") / MEMBERS).cast("int")
    dealt = (rest.join(several, "sig", "left_semi").withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1))))
    side = F.when(F.col("block") == F.col("other"), 0).when(F.col("block") < F.col("other"), 1).otherwise(2)
    facts = rows.select(F.col("doc_id").alias("id"), "n_shingles", "cells")
    pair = F.xxhash64("sig", F.least("block", "other"), F.greatest("block", "other"))
    return dealt.join(facts, "id").select(pair.alias("pair"), side.alias("side"), "rep", "id", "component", "n_shingles", "cells")


def _similar(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * shared >= percent * (len(a) + len(b) - shared)


def _verify(pdf: pd.DataFrame) -> pd.DataFrame:
    """The members of one group that are similar to its representative."""
    sets = [np.frombuffer(b, np.uint64) for b in pdf["members"]]
    rep = pdf["rep"].iloc[0]
    own = [s for s, i in zip(sets, pdf["id"]) if i == rep]
    found = [i for s, i in zip(sets, pdf["id"]) if i != rep and any(_similar(o, s) for o in own)]
    return pd.DataFrame({"a": np.full(len(found), rep, np.int64), "b": np.array(found, np.int64)})


def _possible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Candidate pairs whose sizes and histograms allow a link."""
    for batch in batches:
        if batch.num_rows:
            cells = [_cells(batch.column(c).to_pylist()) for c in ("rep_cells", "cells")]
            sizes = [batch.column(c).to_numpy() for c in ("rep_size", "n_shingles")]
            yield batch.select(["rep", "id"]).filter(pa.array(_may_be_similar(cells[0], sizes[0], cells[1], sizes[1])))


def _marks(ids: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashed ids: a first sieve for rows to be joined with ``ids``."""
    rows = (ids.select((F.pmod(F.xxhash64("id"), F.lit(SIEVE_BITS)) + 1).alias("p"))
            .groupBy(F.expr("bitmap_bucket_number(p)").alias("k")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("bits")).collect())
    marks = np.zeros(SIEVE_BITS // 8, np.uint8)
    for r in rows:
        marks[(r["k"] - 1) * 4096:r["k"] * 4096] = np.frombuffer(bytes(r["bits"]), np.uint8)
    return marks


def _sets_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id``, ``members`` of the documents named by ``ids``, and of a few more that the sieve lets pass."""
    marks = docs.sparkSession.sparkContext.broadcast(_marks(ids))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("p").to_numpy()
            batch = batch.filter(pa.array((marks.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1))
            found = [shingle_set(words_of(t)).tobytes() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.binary())], names=["id", "members"])

    return docs.where(F.col("doc_id").isNotNull()).withColumn("p", F.pmod(F.xxhash64("doc_id"), F.lit(SIEVE_BITS))).mapInArrow(sets, "id long, members binary")


def _possible_links(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The similar ones among candidate pairs (``rep``, ``id``), histograms first."""
    facts = rows.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("id"), "n_shingles", "cells")
    of_rep = facts.select(F.col("id").alias("rep"), F.col("n_shingles").alias("rep_size"), F.col("cells").alias("rep_cells"))
    return _links(stored(pairs.distinct().join(facts, "id").join(of_rep, "rep").mapInArrow(_possible, "rep long, id long").distinct(), "pairs"), docs)


def _links(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The similar ones among pairs (``rep``, ``id``). A representative's members are dealt to groups of bounded size."""
    crowd = pairs.groupBy("rep").agg(F.ceil(F.count(F.lit(1)) / MEMBERS).alias("groups"))
    dealt = pairs.join(crowd, "rep").withColumn("deal", F.pmod(F.xxhash64("id"), F.col("groups"))).select("rep", "deal", "id")
    dealt = stored(dealt.unionByName(dealt.select("rep", "deal").distinct().withColumn("id", F.col("rep"))), "dealt")
    return stored(dealt.join(_sets_of(docs, dealt), "id").groupBy("rep", "deal").applyInPandas(_verify, "a long, b long"), "links")


def _shared_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Shared members of the sets ``left[i]`` and ``right[i]``, by bitmaps over the members that several sets have."""
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    _, member, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    several = times > 1
    number = (np.cumsum(several) - 1)[member]
    owner, number = owner[several[member]], number[several[member]]
    order = np.argsort(number, kind="stable")
    owner, number = owner[order], number[order]
    shared = np.zeros(len(left), np.int64)
    block = max(64, min(8192, TABLE_BYTES // len(sets) // 64 * 64))
    for first in range(0, int(several.sum()), block):
        a, e = np.searchsorted(number, (first, first + block))
        table = np.zeros((len(sets), block), bool)
        table[owner[a:e], number[a:e] - first] = True
        bits = np.packbits(table, axis=1).view(np.uint64)
        for k in range(0, len(left), PAIRS_AT_ONCE):
            part = slice(k, k + PAIRS_AT_ONCE)
            shared[part] += np.bitwise_count(bits[left[part]] & bits[right[part]]).sum(axis=1, dtype=np.int64)
    return shared


def _verify_dense(pairs: pd.DataFrame, sets: pd.DataFrame) -> pd.DataFrame:
    """The similar ones among the pairs, component by component."""
    found_a, found_b = [], []
    order = np.argsort(pairs["component"].to_numpy(), kind="stable")
    of, reps, ids = (pairs[c].to_numpy()[order] for c in ("component", "rep", "id"))
    own_order = np.lexsort((sets["text_id"].to_numpy(), sets["of"].to_numpy()))
    own, text_id, members = sets["of"].to_numpy()[own_order], sets["text_id"].to_numpy()[own_order], sets["members"].to_numpy()[own_order]
    starts = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, int)
    for a, e in zip(starts.tolist(), np.append(starts[1:], len(of)).tolist()):
        lo, hi = np.searchsorted(own, of[a], "left"), np.searchsorted(own, of[a], "right")
        body, names = [np.frombuffer(b, np.uint64) for b in members[lo:hi]], text_id[lo:hi]
        size = np.array([len(x) for x in body])
        left, right = np.searchsorted(names, reps[a:e]), np.searchsorted(names, ids[a:e])
        if len(np.unique(names)) < len(names):  # an id with several texts: all of them count
            rows = pd.DataFrame({"name": names, "row": np.arange(len(names))})
            both = pd.DataFrame({"rep": reps[a:e], "id": ids[a:e]}).merge(rows.rename(columns={"name": "rep", "row": "left"}), on="rep").merge(
                rows.rename(columns={"name": "id", "row": "right"}), on="id")
            left, right = both["left"].to_numpy(), both["right"].to_numpy()
        shared = _shared_counts(body, left, right)
        link = 100 * shared >= PERCENT * (size[left] + size[right] - shared)
        found_a.append(names[left[link]])
        found_b.append(names[right[link]])
    none = [np.zeros(0, np.int64)]
    return pd.DataFrame({"a": np.concatenate(found_a or none), "b": np.concatenate(found_b or none)})


def _shares(weights: DataFrame) -> int:
    """Groups that components are dealt to: about ``GROUP_SHINGLES`` in each, and enough for all tasks of a shuffle."""
    total = weights.agg(F.sum("w")).first()[0] or 0
    return max(int(weights.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // GROUP_SHINGLES))


def _dense_links(pairs: DataFrame, rows: DataFrame, docs: DataFrame) -> DataFrame:
    """The links that matter among many candidate pairs of the same texts.

    Pairs are grouped by the components they would form if all were similar, so a text's set travels once. Groups
    hold ``GROUP_SHINGLES`` at most; larger components go the way of single pairs.
    """
    groups = stored(components(pairs.select(F.col("rep").alias("a"), F.col("id").alias("b"))), "candidates")
    sizes = rows.groupBy(F.col("doc_id").alias("id")).agg(F.sum("n_shingles").alias("n_shingles"))
    weight = stored(groups.join(sizes, "id").groupBy("component").agg(F.sum("n_shingles").alias("w")), "weights")
    small = weight.where(F.col("w") <= GROUP_SHINGLES)
    key = F.pmod(F.xxhash64("component"), F.lit(_shares(small)))
    held = stored(groups.join(small.select("component"), "component").select("id", "component", key.alias("deal")), "held")
    ours = pairs.join(held.withColumnRenamed("id", "rep"), "rep").select("deal", "component", "rep", "id")
    sets = _sets_of(docs, held).join(held, "id").select(F.col("deal").alias("share"), F.col("component").alias("of"), F.col("id").alias("text_id"), "members")
    dense = ours.groupBy("deal").cogroup(sets.groupBy("share")).applyInPandas(_verify_dense, "a long, b long")
    large = groups.join(weight.where(F.col("w") > GROUP_SHINGLES).select("component"), "component").select(F.col("id").alias("rep"))
    sparse = stored(pairs.join(large, "rep", "left_semi"), "sparse")
    dense = stored(dense, "links")
    return dense if sparse.isEmpty() else dense.unionByName(_links(sparse, docs))


def _left_over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within pairs of blocks (rows come sorted by them) in different components that were not compared yet and may be similar."""
    known: set[tuple[int, int]] = set()
    held: list[pa.RecordBatch] = []

    def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
        pair, side, rep, ids, comp, size = (table.column(c).to_numpy() for c in ("pair", "side", "rep", "id", "component", "n_shingles"))
        cells = _cells(table.column("cells").to_pylist())
        at = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
        for a, e in zip(at.tolist(), np.append(at[1:], len(pair)).tolist()):
            if (comp[a:e] == comp[a]).all():
                continue
            fresh: dict[tuple[int, int], None] = {}
            inner = np.arange(a, e)[ids[a:e] != rep[a:e]]  # the representative was compared with all
            for n, k in enumerate(inner[:-1].tolist()):
                other = inner[n + 1:]
                other = other[(comp[other] != comp[k]) & ((side[other] == 0) | (side[other] != side[k]))]
                if len(other):
                    other = other[_may_be_similar(cells[k], size[k], cells[other], size[other])]
                    fresh.update(dict.fromkeys((min(x), max(x)) for x in zip([ids[k].item()] * len(other), ids[other].tolist())))
            new = [x for x in fresh if x not in known]
            if len(known) > 100_000:
                known.clear()
            known.update(new)
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in new], pa.int64()), pa.array([x for _, x in new], pa.int64())], names=["rep", "id"])

    for batch in batches:
        if not batch.num_rows:
            continue
        pair = batch.column("pair").to_numpy()
        last = int(np.searchsorted(pair == pair[-1], True)) if pair[0] != pair[-1] else 0
        if last or (held and held[-1].column("pair")[-1].as_py() != pair[0]):  # a pair of blocks ends in this batch
            if last:
                held.append(batch.slice(0, last))
            yield from compared(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from compared(pa.Table.from_batches(held))


def similar_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links."""
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    rows = stored(docs.mapInArrow(_describe, "doc_id long, key binary, n_shingles long, cells binary"), "sizes")
    total = rows.agg(F.sum("n_shingles")).first()[0] or 0
    groups = max(1, -(-total // (2 * GROUP_SIGNATURES)))
    packed = docs.mapInArrow(_pack(groups), "part int, sigs binary, ids binary")
    buckets = packed.groupBy("part").applyInPandas(_buckets, "sig long, ids array<long>")
    buckets = buckets.groupBy(F.xxhash64("ids").alias("mark")).agg(F.first("sig").alias("sig"), F.first("ids").alias("ids"))
    member = _with_representatives(stored(buckets.drop("mark"), "buckets"))
    links = _possible_links(member.where(F.col("id") != F.col("rep")).select("rep", "id"), rows, docs)

    classes = rows.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "key")
    first = classes.groupBy("key").agg(F.min("doc_id").alias("first"))
    same = classes.join(first, "key").where(F.col("doc_id") != F.col("first")).select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    known = same.unionByName(links)
    found = components(known)

    rest = _unsettled(member, found, rows).repartition("pair").sortWithinPartitions("pair")
    rest = stored(rest.mapInArrow(_left_over, "rep long, id long").distinct(), "left")
    if not rest.isEmpty():
        found = components(known.unionByName(_dense_links(rest, rows, docs)))
    return (rows.join(found.withColumnRenamed("id", "doc_id"), "doc_id", "left")
            .select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")))
