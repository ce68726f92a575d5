"""Periodic runs of words: Lyndon arrays from the grouping phase of a suffix sorter, roots extended to runs.

A run is a stretch of words with smallest period p, long enough (``min_length`` and ``min_exponent`` * p), that
no neighbouring word extends with period p. By the runs theorem every run holds a root that is the longest Lyndon
word from its position on, under one of two opposite orders of the words. ``lyndon_lengths`` gets these
lengths for all positions from phase one of Baier's suffix sorter: suffixes are grouped by their first word,
groups are taken from the highest down, and the members of a group lengthen the word of the nearest position
to their left that is still waiting. A group's word is then the longest Lyndon word of its members; the sorting
phase is not needed. Each root is extended by longest common extensions to both sides (blocks of doubling
size compared as bytes, then halved), once for each stretch of one period.

Grouping runs on the parts of a text that can hold a run at all. In a run of period p all k-grams but the last
come again p words later, with k the least of length - p over all periods: so a run lies in a stretch of
positions whose k-gram recurs within a distance that the length of the stretch allows (``_parts``). The rest of a
text holds no run, so nothing is lost, and the work of a text is in proportion to its length.

Texts are handled one by one inside tasks; there is no shuffle.

Cases: a null or empty text, or one of white space, has no runs and the empty collapsed text; each row is answered
for itself, repeated and null ids too; an empty table gives an empty result; of the columns only the
two named ones are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Run = tuple[int, int, int]
RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
#: Rounds of narrowing in ``_parts``: what is left after them is grouped, needed or not.
_ROUNDS = 8
_MULTIPLIERS = np.random.default_rng(12).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def lyndon_lengths(word: list[int]) -> list[int]:
    """Length of the longest Lyndon word from every position, the end of the text being lowest."""
    n = len(word)
    lengths = [0] * (n + 2)
    left, right = list(range(-1, n + 1)), list(range(1, n + 3))  # waiting positions 1..n, 0 and n + 1 are the ends
    first: dict[int, list[int]] = {}
    for i, c in enumerate(word, 1):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first)]
    context = [1] * len(members)
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    home = [0] * (n + 2)
    for g, group in enumerate(members):
        for i in group:
            home[i] = g
    g = len(members) - 1
    while g >= 0:
        size = context[g]
        found: dict[int, list[int]] = {}  # how often a waiting position was met -> the positions, rising
        last, times = 0, 0
        for i in members[g]:
            if home[i] != g:
                continue
            lengths[i] = size
            before, after = left[i], right[i]
            right[before], left[after] = after, before
            if before == last:
                times += 1
            else:
                if last:
                    found.setdefault(times, []).append(last)
                last, times = before, 1
        if last:
            found.setdefault(times, []).append(last)
        for times in sorted(found, reverse=True):
            moved: dict[int, int] = {}
            for i in found[times]:
                old = home[i]
                new = moved.get(old)
                if new is None:
                    new = moved[old] = len(members)
                    members.append([])
                    context.append(context[old] + times * size)
                    up = above[old]
                    below.append(old)
                    above.append(up)
                    above[old] = below[up] = new
                members[new].append(i)
                home[i] = new
        g = below[g]
    return lengths[1:n + 1]


def _common(codes: bytes, i: int, j: int, limit: int) -> int:
    """How many words from i and from j on agree, at most ``limit`` (4 bytes a word)."""
    done, step = 0, 8
    while done < limit:
        m = min(step, limit - done)
        a, b = 4 * (i + done), 4 * (j + done)
        if codes[a:a + 4 * m] == codes[b:b + 4 * m]:
            done, step = done + m, 2 * step
            continue
        while m > 1:  # the first difference lies in this block
            half = m // 2
            a, b = 4 * (i + done), 4 * (j + done)
            if codes[a:a + 4 * half] == codes[b:b + 4 * half]:
                done, m = done + half, m - half
            else:
                m = half
        return done
    return done


def _parts(ids: np.ndarray, k: int, exponent: float) -> list[tuple[int, int]]:
    """Disjoint parts of the text, rising, such that every run lies in one of them."""
    n = len(ids)
    if n < k + 1:
        return []
    grams = np.zeros(n - k + 1, np.uint64)
    wide = ids.astype(np.uint64) + np.uint64(1)
    for j in range(k):
        grams = (grams ^ (grams >> np.uint64(29))) * _MULTIPLIERS[j % 64] + wide[j:n - k + 1 + j]
    order = np.argsort(grams, kind="stable")
    ordered = grams[order]
    same = ordered[1:] == ordered[:-1]
    if not same.any():
        return []
    recurs = np.full(len(grams), n, np.int64)
    recurs[order[:-1][same]] = (order[1:] - order[:-1])[same]
    alive = recurs < n
    for _ in range(_ROUNDS):
        edge = np.flatnonzero(np.diff(np.concatenate(([False], alive, [False])).view(np.int8)))
        starts, ends = edge[::2], edge[1::2]
        most = np.floor((ends - starts + k - 1) / (exponent - 1)).astype(np.int64)
        inside = np.zeros(len(alive), np.int64)
        inside[alive] = np.repeat(most, ends - starts)
        narrower = alive & (recurs <= inside)
        if (narrower == alive).all():
            break
        alive = narrower
    parts: list[tuple[int, int]] = []
    edge = np.flatnonzero(np.diff(np.concatenate(([False], alive, [False])).view(np.int8)))
    for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
        end = min(n, e + k - 1 + int((e - s + k - 1) / (exponent - 1)))
        if parts and s <= parts[-1][1]:
            parts[-1] = (parts[-1][0], max(end, parts[-1][1]))
        else:
            parts.append((s, end))
    return parts


def runs_of(words: list, min_length: int = 6, min_exponent: float = 4.0) -> list[Run]:
    """All runs (start, length, period) of a sequence, by start, then period. ``min_exponent`` is 2 or more."""
    if min_exponent < 2:
        raise ValueError("a run repeats its period at least twice")
    known: dict = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int32)
    # the shortest stretch that has to recur, over all periods
    k = max(1, min(max(min_length, math.ceil(min_exponent * p)) - p for p in range(1, max(min_length, 1) + 1)))
    parts = _parts(ids, k, min_exponent)
    if not parts:
        return []
    codes, n, top = ids.tobytes(), len(ids), len(known)
    backwards = ids[::-1].tobytes()
    plain = ids.tolist()
    found: set[Run] = set()
    for lo, hi in parts:
        part = plain[lo:hi]
        for rising in (True, False):
            covered: dict[int, int] = {}  # period -> end of its last stretch
            lengths = lyndon_lengths(part if rising else [top - c for c in part])
            for i, p in enumerate(lengths, lo):
                after = i + p
                if after >= n or plain[i] != plain[after] or after <= covered.get(p, 0):
                    continue
                end = after + _common(codes, i, after, n - after)
                start = i - _common(backwards, n - i, n - after, i)
                covered[p] = end
                if end - start >= max(min_length, min_exponent * p):
                    found.add((start, end - start, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(words: list, runs: list[Run]) -> list:
    """The words left when each run keeps its first period only."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [w for w, out in zip(words, np.cumsum(gone).tolist()) if not out]


def periodic_runs(docs: DataFrame, min_length: int = 6, min_exponent: float = 4.0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``runs`` (start, length, period; word numbers from 0) and ``collapsed``,
    the text without the repetitions, its words joined by one space."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("runs", T.ArrayType(RUN)), T.StructField("collapsed", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        struct = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])
        for batch in batches:
            found, kept = [], []
            for value in batch.column("text").cast(pa.binary()).to_pylist():
                words = (value or b"").split()  # bytes split at ASCII white space only
                runs = runs_of(words, min_length, min_exponent)
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                kept.append(b" ".join(collapsed(words, runs)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.list_(struct)), pa.array(kept, pa.binary()).cast(pa.string())],
                ["doc_id", "runs", "collapsed"])

    return docs.mapInArrow(run, schema)
