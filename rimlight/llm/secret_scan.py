"""Secrets in texts: patterns, and tokens that a battery of randomness tests cannot tell from random characters.

Base findings are assignments of a password, key or token, access key ids and long runs of hex digits, by pattern.

The method looks at all tokens of ``MIN_TOKEN`` or more characters, those within base findings too. From its characters a token's encoding is
inferred (``ENCODINGS``: hex, base 32, letters, letters with digits, base 64 ...), and its characters become ranks in that
alphabet. Three tests ask whether the ranks could be random: chi-squared for a uniform use of the alphabet, with
the exact mean and variance for the length; the number of runs above and below the middle; and the correlation of
neighbours. Fisher's sum of -2 ln p is the token's departure from randomness.

A token of ordinary text departs much, a secret little, and how well the two can be told apart depends on length and
encoding. So departures are compared with the corpus itself: every document's ordinary words, joined, are cut into
stretches for every stratum (encoding, length class) from end to end, and all of them, written in the stratum's alphabet,
give the distribution of departures of ordinary text. The share of ordinary stretches that depart no more than a
token is the token's p-value, and Benjamini and Hochberg's rule is applied within every stratum, over distinct
tokens, to keep the false share of what is reported at ``FALSE_SHARE``. Strata in which ordinary text looks random,
as short strings of lower-case letters do, report nothing by this. Stretches have the least length of their
class, which can only raise p-values.

One scan gives spans, tests and ordinary departures, which are stored without the texts; distributions are
grouped counts of (stratum, binned departure), a bounded table, summed up over each batch of texts in the scan. There the
battery works on all stretches of a length at once: chi-squared and runs follow from whole numbers and are looked up, sums for the
correlation are differences of running sums. Tokens are counted once by hash, however often they are repeated.

Cases: a null text is an empty one; rows are answered one by one, repeated and null ids too; an empty table gives an empty
result; numbers alone are no secrets for this method; a token within a base finding that passes is a span of its own
beside it; columns besides the two named ones are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import cache
from math import erfc, log, sqrt

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from rimlight.llm.common import stored

KINDS = ("assign", "access", "hex")
RANDOM = "random"
MIN_TOKEN = 16
FALSE_SHARE = 0.05
#: Least lengths of the length classes.
LENGTHS = (16, 20, 24, 32, 40, 64, 128)
#: Width of a bin of departures, and the last bin.
BIN, LAST_BIN = 0.5, 400
#: Ordinary characters that are worked on at once, a multiple of all ``LENGTHS``.
BLOCK = 1920 * 200
#: Steps in 1 of the table of normal tails. Between them weights are interpolated, to some 1e-8.
STEPS = 8192

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# a run of fewer characters fails from its beginning and from everywhere, so the least length can be in the pattern
_ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
_HEX = re.compile(r"[0-9a-f]{16,}")
_TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_TOKEN)

_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Alphabets in order of rank; a token has the first one that holds all of its characters.
ENCODINGS = {
    "decimal": _DIGITS,
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "lower": _LOWER,
    "upper": _UPPER,
    "base32": _UPPER + "234567",
    "letters": _UPPER + _LOWER,
    "lower36": _DIGITS + _LOWER,
    "upper36": _DIGITS + _UPPER,
    "base62": _DIGITS + _UPPER + _LOWER,
    "base64": _UPPER + _LOWER + _DIGITS + "+/",
    "base64url": _UPPER + _LOWER + _DIGITS + "-_",
    "mixed": _UPPER + _LOWER + _DIGITS + "+/-_",
}
TESTED = tuple(e for e in ENCODINGS if e != "decimal")
STRATA = tuple((e, n) for e in TESTED for n in LENGTHS)
_ANY = _LOWER + _UPPER + _DIGITS


def _table(alphabet: str) -> np.ndarray:
    out = np.full(256, -1, np.int16)
    out[list(alphabet.encode())] = range(len(alphabet))
    return out


_RANKS = {e: _table(a) for e, a in ENCODINGS.items()}
_ORDINARY = _table(_ANY)
_SPACE = _table(" \t\n\r\x0b\x0c") >= 0
_CLASS = np.searchsorted(LENGTHS, np.arange(LENGTHS[-1] + 1), side="right") - 1


def _normal_tail(z: float) -> float:
    return erfc(abs(z) / sqrt(2.0))


def chi_squared_p(ranks: np.ndarray, k: int) -> float:
    """Chance of at least this unevenness among ``k`` equally likely ranks: a gamma law of the statistic's exact
    mean k - 1 and variance 2 (k - 1)(1 - 1/n), by Wilson and Hilferty's cube root."""
    counts = np.bincount(ranks, minlength=k)
    return _uneven_p(int((counts.astype(np.int64) ** 2).sum()), len(ranks), k)


def _uneven_p(squares: int, n: int, k: int) -> float:
    """``chi_squared_p`` from the sum of squared counts."""
    x = float(squares) * k / n - n
    mean, variance = k - 1.0, 2.0 * (k - 1.0) * (1.0 - 1.0 / n)
    shape = mean * mean / variance
    z = ((max(x, 0.0) / mean) ** (1 / 3) - (1 - 1 / (9 * shape))) * sqrt(9 * shape)
    return 0.5 * erfc(z / sqrt(2.0))


def runs_p(ranks: np.ndarray, k: int) -> float:
    """Wald and Wolfowitz's test on ranks above and below the middle; ranks all on one side are as likely as 2^(1-n)."""
    high = ranks * 2 >= k
    return _sides_p(int(high.sum()), int((high[1:] != high[:-1]).sum()), len(ranks))


def _sides_p(a: int, changes: int, n: int) -> float:
    """``runs_p`` from the number of ranks above the middle and the changes of side."""
    b = n - a
    if not a or not b:
        return 2.0 ** (1 - n)
    runs = 1 + changes
    mean = 2.0 * a * b / n + 1
    variance = (mean - 1) * (mean - 2) / (n - 1)
    return _normal_tail((runs - mean) / sqrt(variance)) if variance > 0 else 1.0


def correlation_p(ranks: np.ndarray) -> float:
    """Correlation of every rank with the next, under random order: mean -1/(n - 1), variance about 1/n."""
    n = len(ranks)
    x = ranks - ranks.mean()
    spread = float(x @ x)
    if spread == 0:
        return 2.0 ** (1 - n)
    return _normal_tail((float(x[1:] @ x[:-1]) / spread + 1.0 / (n - 1)) * sqrt(n))


def departure(ranks: np.ndarray, k: int) -> float:
    """Fisher's combination of the battery: low for random characters (6 on average), high for others."""
    return sum(_weight(p) for p in (chi_squared_p(ranks, k), runs_p(ranks, k), correlation_p(ranks)))


def _weight(p: float) -> float:
    return -2.0 * log(max(p, 1e-300))


def encoding_of(token: bytes) -> tuple[str, np.ndarray] | None:
    """The first encoding with all of the token's characters (padding aside), and the ranks in it."""
    codes = np.frombuffer(token.rstrip(b"="), np.uint8)
    for name, table in _RANKS.items():
        ranks = table[codes]
        if len(ranks) and ranks.min() >= 0:
            return name, ranks.astype(np.int64)
    return None


def _bin(value: float) -> int:
    return min(int(value / BIN), LAST_BIN)


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of kind, kind, end) of the checked pattern findings, in that order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, "assign", m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, "access", m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, "hex", m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def token_tests(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, stratum, binned departure, hash) of the tokens that the battery looks at."""
    out = []
    for m in _TOKEN.finditer(text):
        start, end = m.span()
        token = m.group().encode()
        known = encoding_of(token)
        if known is None or known[0] == "decimal" or len(known[1]) < MIN_TOKEN:
            continue
        name, ranks = known
        stratum = TESTED.index(name) * len(LENGTHS) + int(_CLASS[min(len(ranks), LENGTHS[-1])])
        out.append((start, end, stratum, _bin(departure(ranks, len(ENCODINGS[name]))), xxhash.xxh64_intdigest(token) - 2**63))
    return out


@cache
def _uneven(n: int, k: int) -> np.ndarray:
    """Weights of the chi-squared test by the sum of squared counts."""
    return np.array([_weight(_uneven_p(x, n, k)) for x in range(n * n + 1)])


@cache
def _sides(n: int) -> np.ndarray:
    """Weights of the runs test by n times the ranks above the middle, and the changes of side."""
    return np.array([_weight(_sides_p(a, c, n)) for a in range(n + 1) for c in range(n)])


@cache
def _tails() -> np.ndarray:
    """Weights of ``_normal_tail`` at every step that ranks of any of the ``LENGTHS`` can reach."""
    return np.array([_weight(_normal_tail(i / STEPS)) for i in range(int((sqrt(LENGTHS[-1]) + 2) * STEPS))])


def _totals(values: np.ndarray) -> np.ndarray:
    """Sums of all values before each place."""
    out = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=out[1:])
    return out


def _ordinary_ranks(text: str) -> np.ndarray:
    """Ranks among letters and digits of the text's ordinary words, joined."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ends = np.concatenate([[-1], np.flatnonzero(_SPACE[raw]), [len(raw)]])
    ranks = _ORDINARY[raw]
    for i in np.flatnonzero(np.diff(ends) > MIN_TOKEN).tolist():
        ranks[ends[i] + 1:ends[i + 1]] = -1
    return ranks[ranks >= 0].astype(np.uint8)


def _blocks(texts: Sequence[str]) -> Iterator[list[np.ndarray]]:
    """The ordinary ranks of the texts, about ``BLOCK`` at a time. Long texts are cut where stretches of all lengths end."""
    block, size = [], 0
    for text in texts:
        ranks = _ordinary_ranks(text)
        while len(ranks):
            piece, ranks = (ranks, ranks[:0]) if len(ranks) < 2 * BLOCK else (ranks[:BLOCK], ranks[BLOCK:])
            block.append(piece)
            size += len(piece)
            if size >= BLOCK:
                yield block
                block, size = [], 0
    if block:
        yield block


def _stretches(sizes: np.ndarray, n: int) -> np.ndarray:
    """Starts of stretches of ``n`` ranks, in joined texts of these sizes: one after the other, and one up to the end."""
    ends = np.cumsum(sizes)
    per = np.where(sizes >= n, -(-sizes // n), 0)
    which = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(which)) - np.repeat(np.cumsum(per) - per, per)
    return np.minimum((ends - sizes)[which] + nth * n, ends[which] - n)


def _squares(stretches: np.ndarray) -> np.ndarray:
    """Sum of squared counts of the ranks in every column: a rank for itself, and two for every pair of equal ones."""
    pairs = np.zeros(stretches.shape[1], np.int64)
    for lag in range(1, len(stretches)):
        pairs += (stretches[lag:] == stretches[:-lag]).view(np.uint8).sum(axis=0, dtype=np.uint8)
    return len(stretches) + 2 * pairs


def _correlation_weights(ranks: np.ndarray, totals: Sequence[np.ndarray], starts: np.ndarray, n: int) -> np.ndarray:
    """Weights of ``correlation_p`` of every stretch, from running sums of ranks, their squares and products with the next."""
    ends = starts + n
    t, q, p = totals[0][ends] - totals[0][starts], totals[1][ends] - totals[1][starts], totals[2][ends - 1] - totals[2][starts]
    spread = n * (n * q - t * t)
    above = n * n * p - n * t * (2 * t - ranks[starts] - ranks[ends - 1]) + (n - 1) * t * t
    z = np.abs(above / np.maximum(spread, 1) + 1.0 / (n - 1)) * (sqrt(n) * STEPS)
    step = z.astype(np.int64)
    low = _tails()[step]
    out = low + (_tails()[step + 1] - low) * (z - step)
    out[spread == 0] = _weight(2.0 ** (1 - n))
    return out


def _departures(texts: Sequence[np.ndarray]) -> Iterator[tuple[list[int], np.ndarray]]:
    """The binned departures of all stretches of the texts' ranks, with the strata that they are of."""
    sizes = np.array([len(x) for x in texts], np.int64)
    joined = np.concatenate(texts)
    cut = {n: starts for n in LENGTHS if len(starts := _stretches(sizes, n))}
    columns = {n: joined[starts + np.arange(n)[:, None]] for n, starts in cut.items()}
    # alphabets of one size give the same departures, and those of as many characters as there are or more the same ranks
    for mod in sorted({min(len(ENCODINGS[e]), len(_ANY)) for e in TESTED}):
        ranks = (joined % np.uint8(mod)).astype(np.int64)
        totals = _totals(ranks), _totals(ranks * ranks), _totals(ranks[:-1] * ranks[1:])
        squares = {n: _squares(x % np.uint8(mod)) for n, x in columns.items()}
        weights = {n: _correlation_weights(ranks, totals, starts, n) for n, starts in cut.items()}
        for k in sorted({k for k in (len(ENCODINGS[e]) for e in TESTED) if min(k, len(_ANY)) == mod}):
            high = ranks * 2 >= k
            above, changes = _totals(high), _totals(high[1:] != high[:-1])
            for n, starts in cut.items():
                side = (above[starts + n] - above[starts]) * n + changes[starts + n - 1] - changes[starts]
                total = _uneven(n, k)[squares[n]] + _sides(n)[side] + weights[n]
                yield [i for i, (e, length) in enumerate(STRATA) if length == n and len(ENCODINGS[e]) == k], np.minimum(
                    total * (1 / BIN), LAST_BIN).astype(np.int64)


def ordinary_tests(text: str) -> list[tuple[int, int]]:
    """(stratum, binned departure) of all stretches of the text's ordinary words, in the alphabets of all strata."""
    return [(s, b) for block in _blocks([text]) for strata, bins in _departures(block) for s in strata for b in bins.tolist()]


def ordinary_counts(texts: Sequence[str]) -> list[tuple[int, int, int]]:
    """(stratum, binned departure, number) of the ``ordinary_tests`` of all the texts."""
    counts = np.zeros((len(STRATA), LAST_BIN + 1), np.int64)
    for block in _blocks(texts):
        for strata, bins in _departures(block):
            counts[strata] += np.bincount(bins, minlength=LAST_BIN + 1)
    return [(s, b, int(counts[s, b])) for s, b in np.argwhere(counts).tolist()]


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])
_TEST = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "end", "stratum", "bin", "hash")])
_STRETCH = T.StructType([T.StructField(n, T.LongType()) for n in ("stratum", "bin")])
_COUNT = T.StructType([*_STRETCH, T.StructField("number", T.LongType())])


def _scan(docs: DataFrame, counted: bool = False) -> DataFrame:
    """``doc_id``, ``base``, ``tests``, ``ordinary`` of every row.

    With ``counted`` equal stretches are counted over each batch: the first row of a batch has the counts of all of its rows.
    """
    ordinary = _COUNT if counted else _STRETCH
    schema = T.StructType([docs.schema["doc_id"], T.StructField("base", T.ArrayType(_SPAN)), T.StructField("tests", T.ArrayType(_TEST)),
                           T.StructField("ordinary", T.ArrayType(ordinary))])
    types = [pa.list_(pa.struct([("start", pa.int64()), ("rank", pa.int32()), ("kind", pa.string()), ("end", pa.int64())])),
             pa.list_(pa.struct([(f.name, pa.int64()) for f in _TEST])), pa.list_(pa.struct([(f.name, pa.int64()) for f in ordinary]))]
    names = [("start", "rank", "kind", "end"), tuple(_TEST.names), tuple(ordinary.names)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [text or "" for text in batch.column("text").to_pylist()]
            found = [base_spans(t) for t in texts], [token_tests(t) for t in texts], [
                ordinary_counts(texts) if not i else [] for i in range(len(texts))] if counted else [ordinary_tests(t) for t in texts]
            columns = [[[dict(zip(keys, r)) for r in rows] for rows in column] for keys, column in zip(names, found)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, types)]], ["doc_id", "base", "tests", "ordinary"])

    return docs.mapInArrow(run, schema)


def accepted_bins(scanned: DataFrame) -> DataFrame:
    """``stratum``, ``most``: the largest binned departure reported in each stratum, where there is one.

    Grouped counts only: at most ``STRATA`` times ``LAST_BIN`` rows meet in the windows. ``scanned`` may be ``counted``.
    """
    number = F.col("o.number") if "number" in scanned.schema["ordinary"].dataType.elementType.names else F.lit(1).cast("long")
    ordinary = scanned.select(F.explode("ordinary").alias("o")).groupBy("o.stratum", "o.bin").agg(F.sum(number).alias("ordinary"))
    tokens = (scanned.select(F.explode("tests").alias("t")).select("t.stratum", "t.bin", "t.hash").distinct()
              .groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("tokens")))
    both = ordinary.join(tokens, ["stratum", "bin"], "full").fillna(0, ["ordinary", "tokens"])
    upto = Window.partitionBy("stratum").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("stratum")
    p = (F.sum("ordinary").over(upto) + 1) / (F.sum("ordinary").over(whole) + 1)
    rule = both.select("stratum", "bin", (p * F.sum("tokens").over(whole) <= FALSE_SHARE * F.sum("tokens").over(upto)).alias("ok"), "tokens")
    return rule.where("ok and tokens > 0").groupBy("stratum").agg(F.max("bin").alias("most"))


def find_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` (pattern findings) and ``spans`` (with the random tokens)."""
    scanned = stored(_scan(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), counted=True), "secrets")
    # one row a stratum, of which there are a fixed number
    most = {r.stratum: r.most for r in accepted_bins(scanned).collect()}
    limits = F.array(*[F.lit(most.get(s, -1)) for s in range(len(STRATA))])
    passed = F.filter("tests", lambda t: t["bin"] <= F.element_at(limits, (t["stratum"] + 1).cast("int")))
    random = F.transform(passed, lambda t: F.struct(t["start"].alias("start"), F.lit(len(KINDS)).alias("rank"), F.lit(RANDOM).alias("kind"), t["end"].alias("end")))
    return scanned.select("doc_id", "base", F.array_sort(F.concat("base", random)).alias("spans"))


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
