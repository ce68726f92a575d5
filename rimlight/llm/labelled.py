"""Bounded samples of labelled documents, and calibration of scores, for the neighbour classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import held_out


def label_counts(labels: DataFrame, label: str, doc_id: str = "doc_id") -> tuple[DataFrame, dict[int, int]]:
    """``doc_id``, ``label`` (1 if any row of the document says so) of the rows to learn from, and their counts."""
    rows = (labels.where(~held_out(F.col(doc_id)) & F.col(label).isin(0, 1))
            .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("label")))
    return rows, {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}


def sample(docs: DataFrame, rows: DataFrame, counts: dict[int, int], per_label: int, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Texts of the ``per_label`` documents of either label that come first by a hash of the id.

    The chosen ids are bounded by the parameter, so they are broadcast to the scan of the documents.
    """
    chosen = None
    for label in counts:
        part = rows.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
        chosen = part if chosen is None else chosen.unionByName(part)
    if chosen is None:
        chosen = rows.limit(0)
    return (docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
            .join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))


class Calibration:
    """A rising step function from raw votes to the share of label 1, fitted by pooling adjacent violators."""

    def __init__(self, raw: np.ndarray, label: np.ndarray, weight: np.ndarray, prior: float) -> None:
        order = np.argsort(raw, kind="stable")
        groups: list[list[float]] = []  # right end, weighted labels, weight
        for x, y, w in zip(raw[order], label[order], weight[order]):
            groups.append([x, y * w, w])
            while len(groups) > 1 and (groups[-2][0] == groups[-1][0] or groups[-2][1] * groups[-1][2] >= groups[-1][1] * groups[-2][2]):
                x2, s2, w2 = groups.pop()
                groups[-1] = [x2, groups[-1][1] + s2, groups[-1][2] + w2]
        self.ends = np.array([g[0] for g in groups])
        # one document's weight of the prior in each group keeps scores off 0 and 1
        unit = float(weight.mean()) if len(weight) else 1.0
        self.share = np.array([(g[1] + prior * unit) / (g[2] + unit) for g in groups])
        self.prior = prior

    def __call__(self, raw: np.ndarray) -> np.ndarray:
        if not len(self.ends):
            return np.full(len(raw), self.prior)
        return self.share[np.minimum(np.searchsorted(self.ends, raw), len(self.ends) - 1)]
