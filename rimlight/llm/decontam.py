"""Benchmark decontamination by greedy string tiling.

A text's tokens are its lower-cased runs of word characters. Seeds are the ``min_match``-token windows
of the benchmark items, by Karp-Rabin hash. A document that shares seeds with an item is tiled against
it: matches are found at a search length that runs down to ``min_match``, the longest are marked first,
and marked tokens take part in no other tile, on either side. The share of an item's tokens under tiles
is its coverage; it does not depend on the order of the passages. Seeds alone bound the coverage from
above, so pairs that cannot reach the threshold are not tiled.

The benchmark is a stated query set: it is sent to the tasks in blocks of bounded size, one pass over the
documents for each block, so no join has a hot key and nothing grows with the documents.

Cases: null and empty texts match nothing; items with fewer than ``min_match`` tokens have no seed and
match nothing; items with null ids take part and are reported with a null id; repeated items are
reported once for each row; repeated documents are answered row by row; an empty benchmark leaks nothing.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TOKEN = re.compile(r"\w+")
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Characters of benchmark text in one block; a block is held by the driver and every worker.
BLOCK_CHARS = 16_000_000
FIRST_SEARCH = 20


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text.lower()) if text else []


def _windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2**64) of all windows of ``n`` tokens."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(ids) - n + 1, np.uint64)
    values = ids.astype(np.uint64)
    for j in range(n):
        out = out * BASE + values[j:j + len(out)]
    return out


def _matches(doc: np.ndarray, item: np.ndarray, free_doc: np.ndarray, free_item: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """Maximal matches of at least ``n`` free tokens as (length, item position, document position)."""
    places = defaultdict(list)
    for j, h in enumerate(_windows(item, n).tolist()):
        if free_item[j:j + n].all():
            places[h].append(j)
    if not places:
        return []
    hashes = _windows(doc, n)
    open_ = np.concatenate(([0], np.cumsum(~free_doc)))
    hits = np.flatnonzero(np.isin(hashes, np.fromiter(places, np.uint64, len(places))) & (open_[n:] == open_[:len(open_) - n]))
    out = []
    for i in hits.tolist():
        for j in places[int(hashes[i])]:
            if i and j and free_doc[i - 1] and free_item[j - 1] and doc[i - 1] == item[j - 1]:
                continue  # part of the match that began one token earlier
            most = min(len(doc) - i, len(item) - j)
            same = (doc[i:i + most] == item[j:j + most]) & free_doc[i:i + most] & free_item[j:j + most]
            length = most if same.all() else int(same.argmin())
            if length >= n:
                out.append((length, j, i))
    return out


def tile(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Tiles as (document position, item position, length); longest first, ties to the earlier item token."""
    free_doc, free_item = np.ones(len(doc), bool), np.ones(len(item), bool)
    tiles, search = [], max(min_match, min(FIRST_SEARCH, len(item)))
    while True:
        found = _matches(doc, item, free_doc, free_item, search)
        longest = max(found, default=(0, 0, 0))[0]
        if longest > 2 * search:
            search = longest
            continue
        again = False
        for length, j, i in sorted(found, key=lambda x: (-x[0], x[1], x[2])):
            if free_doc[i:i + length].all() and free_item[j:j + length].all():
                free_doc[i:i + length] = free_item[j:j + length] = False
                tiles.append((i, j, length))
            elif free_item[j:j + length].any() and free_doc[i:i + length].any():
                again = True  # what an overlap left over may still be long enough
        if again:
            continue
        if search == min_match:
            return tiles
        search = max(min_match, search // 2)


class Benchmark:
    """One block of items: vocabulary, seeds, and the tiling of a text against them."""

    def __init__(self, items: list[tuple[int | None, str | None]], min_match: int, coverage: float) -> None:
        self.min_match, self.coverage = min_match, coverage
        words = [(item_id, tokens(text)) for item_id, text in items]
        words = [(item_id, w) for item_id, w in words if len(w) >= min_match]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(x for _, ws in words for x in ws), 1)}
        self.ids = [item_id for item_id, _ in words]
        self.items = [np.array([self.vocabulary[x] for x in ws], np.int64) for _, ws in words]
        seeds = [(h, k, j) for k, item in enumerate(self.items) for j, h in enumerate(_windows(item, min_match).tolist())]
        seeds.sort()
        self.seed_hash = np.array([s[0] for s in seeds], np.uint64)
        self.seed_item = np.array([s[1] for s in seeds], np.int64)
        self.seed_at = np.array([s[2] for s in seeds], np.int64)

    def leaks(self, text: str | None) -> list[tuple[int | None, float, list[tuple[int, int, int]]]]:
        if not text or not self.items:
            return []
        doc = np.array([self.vocabulary.get(w, 0) for w in tokens(text)], np.int64)
        hashes = _windows(doc, self.min_match)
        known = np.concatenate(([0], np.cumsum(doc == 0)))
        hashes = np.unique(hashes[known[self.min_match:] == known[:len(known) - self.min_match]]) if len(hashes) else hashes
        left, right = np.searchsorted(self.seed_hash, hashes, "left"), np.searchsorted(self.seed_hash, hashes, "right")
        shared = [np.arange(a, b) for a, b in zip(left, right) if b > a]
        if not shared:
            return []
        shared = np.concatenate(shared)
        out = []
        for k in np.unique(self.seed_item[shared]).tolist():
            item = self.items[k]
            under = np.zeros(len(item) + 1, np.int64)
            at = self.seed_at[shared[self.seed_item[shared] == k]]
            np.add.at(under, at, 1)
            np.add.at(under, at + self.min_match, -1)
            if (np.cumsum(under[:-1]) > 0).sum() < self.coverage * len(item):
                continue
            tiles = tile(doc, item, self.min_match)
            share = sum(t[2] for t in tiles) / len(item)
            if share >= self.coverage:
                out.append((self.ids[k], share, tiles))
        return out


def _blocks(benchmark: DataFrame, text: str, item_id: str) -> Iterator[list[tuple]]:
    """The benchmark in blocks of bounded size, fetched one after the other."""
    rows = benchmark.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield sorted(map(tuple, part.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))


LEAK = "array<struct<item_id: bigint, coverage: double, tiles: array<struct<doc_token: int, item_token: int, length: int>>>>"
_TILE = pa.struct([("doc_token", pa.int32()), ("item_token", pa.int32()), ("length", pa.int32())])
_LEAKS = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("tiles", pa.list_(_TILE))]))


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = 4, coverage: float = 0.5, text: str = "text",
               item_text: str = "text", item_id: str = "item_id", leaks: str = "leaks") -> DataFrame:
    """All rows and columns of ``docs`` and ``leaks``: the items it covers, with coverage and tiles (in tokens)."""
    if leaks in docs.columns:
        raise ValueError(f"column {leaks} is there already; name another")
    schema = docs.withColumn(leaks, F.expr(f"cast(array() as {LEAK})")).schema
    out = docs.withColumn(leaks, F.expr(f"cast(array() as {LEAK})"))
    for block in _blocks(benchmark, item_text, item_id):
        out = out.mapInArrow(_marker(docs.sparkSession.sparkContext.broadcast(block), min_match, coverage, text, leaks), schema)
    return out


def _marker(block, min_match: int, coverage: float, text: str, leaks: str):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        against = Benchmark(block.value, min_match, coverage)
        for batch in batches:
            found = []
            for body, before in zip(batch.column(text).to_pylist(), batch.column(leaks).to_pylist()):
                found.append(before + [
                    {"item_id": i, "coverage": c, "tiles": [dict(zip(("doc_token", "item_token", "length"), t)) for t in tiles]}
                    for i, c, tiles in against.leaks(body)])
            at = batch.schema.get_field_index(leaks)
            yield batch.set_column(at, leaks, pa.array(found, _LEAKS))

    return mark


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The documents that cover no benchmark item, with their columns."""
    name = "leaks"
    while name in docs.columns:
        name += "_"
    return find_leaks(docs, benchmark, leaks=name, **how).where(F.size(name) == 0).drop(name)
