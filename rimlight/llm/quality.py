"""Quality by nearest-neighbour voting in a latent-semantic space.

Features are hashed byte trigrams of the lower-cased text and hashed four-grams of character shapes
(letters by case, digits, spaces, each punctuation mark), weighted by log frequency and by inverse
document frequency over all documents. The labelled sample (``PER_LABEL`` documents of either label, the
bound) is decomposed into ``DIMENSIONS`` latent directions. Its vectors are broadcast; every document's
vector is compared with all of them, in blocks, by exact cosine, and labels vote with a power of the
similarity, weighted so that the sample's shares are those of all labels. A monotone calibration fitted on
leave-one-out votes turns votes into probabilities.

Cases: null and empty texts have no features and get the share of label 1 in all labels, as has every
text if there is no label at all (then 0); several labels of a document count as 1 if any is 1; null ids
teach nothing; rows are answered one by one; columns besides the named ones are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm import labelled
from rimlight.llm.common import stored

HALF = 1024
FEATURES = 2 * HALF
DIMENSIONS = 64
PER_LABEL = 1_500
POWER = 12
DOCS_AT_ONCE = 256
EXAMPLES_AT_ONCE = 1_024
_SPREAD = np.uint64(0x9E3779B97F4A7C15)

_SHAPE = np.zeros(256, np.uint64)
for _b in range(256):
    _c = chr(_b)
    _SHAPE[_b] = (1 if "a" <= _c <= "z" or _b >= 192 else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _c in "\t " else 5 if _c in "\r\n"
                  else 0 if 128 <= _b < 192 else 6 + _b)
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += np.uint64(32)


def _grams(codes: np.ndarray, n: int) -> np.ndarray:
    if len(codes) < n:
        return np.zeros(HALF)
    gram = codes[:len(codes) - n + 1]
    for j in range(1, n):
        gram = gram * np.uint64(263) + codes[j:len(codes) - n + 1 + j]
    return np.bincount(((gram * _SPREAD) >> np.uint64(54)).astype(np.int64), minlength=HALF)


def feature_counts(text: str | None) -> np.ndarray:
    raw = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    shape = _SHAPE[raw]
    return np.concatenate((_grams(_LOWER[raw], 3), _grams(shape[shape > 0], 4)))


def _doc_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, n = np.zeros(FEATURES, np.int64), 0
    for batch in batches:
        for text in batch.column("text").to_pylist():
            total += feature_counts(text) > 0
            n += 1
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(FEATURES + 1)), pa.array(np.append(total, n))], names=["feature", "n"])


class Latent:
    """Feature weights, latent directions, the labelled vectors and the calibration."""

    def __init__(self, idf: np.ndarray, texts: list[str | None], labels: list[int], share: dict[int, float], prior: float) -> None:
        self.idf, self.prior = idf, prior
        rows = self._weighted(texts)
        full = np.flatnonzero(rows.any(axis=1))
        rows, self.labels = rows[full], np.array(labels, np.int64)[full]
        self.vote = np.array([share[y] for y in self.labels.tolist()])
        values, directions = np.linalg.eigh(rows.T @ rows)
        self.directions = directions[:, np.argsort(-values)[:DIMENSIONS]].astype(np.float32)
        self.examples = self._unit(rows @ self.directions)
        raw = np.concatenate([self._votes(self.examples[a:a + 256], a) for a in range(0, len(full), 256)]) if len(full) else np.zeros(0)
        self.calibrated = labelled.Calibration(raw, self.labels, self.vote, prior)

    def _weighted(self, texts: list[str | None]) -> np.ndarray:
        rows = np.log1p(np.array([feature_counts(t) for t in texts], np.float32).reshape(-1, FEATURES)) * self.idf
        return self._unit(rows)

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return rows / np.maximum(np.sqrt((rows * rows).sum(axis=1, keepdims=True)), 1e-12)

    def _votes(self, vectors: np.ndarray, skip_from: int | None = None) -> np.ndarray:
        """Weighted share of label 1 among the examples; a training vector does not vote for itself."""
        ones, all_ = np.zeros(len(vectors)), np.full(len(vectors), 1e-30)
        for a in range(0, len(self.examples), EXAMPLES_AT_ONCE):
            part = slice(a, a + EXAMPLES_AT_ONCE)
            power = np.maximum(vectors @ self.examples[part].T, 0).astype(float) ** POWER
            if skip_from is not None:
                own = np.arange(len(vectors)) + skip_from - a
                inside = np.flatnonzero((own >= 0) & (own < power.shape[1]))
                power[inside, own[inside]] = 0
            power *= self.vote[part]
            ones += power @ self.labels[part]
            all_ += power.sum(axis=1)
        return ones / all_

    def score(self, texts: list[str | None]) -> np.ndarray:
        rows = self._weighted(texts)
        out = np.full(len(texts), self.prior)
        full = np.flatnonzero(rows.any(axis=1))
        if len(full) and len(self.examples):
            out[full] = self.calibrated(self._votes(self._unit(rows[full] @ self.directions)))
        return out


def score_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id`` and ``score``, the probability of label 1."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows, counts = labelled.label_counts(labels, label)
    found = sorted(((r["doc_id"], r["text"], r["label"]) for r in stored(labelled.sample(docs, rows, counts, PER_LABEL), "labelled").collect()), key=lambda r: r[0])
    df = np.zeros(FEATURES + 1)
    for r in docs.mapInArrow(_doc_frequencies, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n")).collect():
        df[r["feature"]] = r["n"]
    idf = (np.log((df[-1] + 1) / (df[:-1] + 1)) + 0.05).astype(np.float32)
    have = {y: max(1, sum(r[2] == y for r in found)) for y in counts}
    model = Latent(idf, [r[1] for r in found], [r[2] for r in found], {y: counts[y] / have[y] for y in counts},
                   counts.get(1, 0) / max(1, sum(counts.values())))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            scores = np.concatenate([shared.value.score(texts[a:a + DOCS_AT_ONCE]) for a in range(0, len(texts), DOCS_AT_ONCE)]) if texts else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], names=["doc_id", "score"])

    return docs.mapInArrow(vote, docs.select("doc_id").withColumn("score", F.lit(0.0)).schema)
