"""Language ID of code-switched text by a linear-chain conditional random field.

The field labels words; a text's language is the label with the largest expected number of words, and
the score is that number as a share of its words. It is fitted on excerpts of ``EXCERPT_WORDS`` words of
about ``DOCS_PER_LABEL`` documents for each language, chosen by a hash of the id: the bounded sample. Half
of the training sequences are excerpts, half are strung together from pieces of several documents, so
that the transitions learn to stay and to switch. Prediction reads whole texts.

Cases: a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing can be
learned; rows without a language or an id teach nothing; rows are answered one by one, so repeated ids
do no harm; other columns pass through untouched.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rimlight.llm import crf
from rimlight.llm.common import held_out

DOCS_PER_LABEL = 1500
EXCERPT_WORDS = 60
#: A word is in the lexicon if so many excerpts have it.
LEXICON_DOCS = 3
DOCS_AT_ONCE = 512
#: Mean share of known features below which a text is in none of the learned languages: their own texts have 0.97 and more,
#: other scripts below 0.3, strings of rare consonants about 0.67.
LEAST_FAMILIAR = 0.7
UNKNOWN = "und"


def training_excerpts(docs: DataFrame, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """``label``, ``excerpt``: about ``DOCS_PER_LABEL`` documents a language, each cut at a place given by its id."""
    rows = docs.where(~held_out(F.col(doc_id)) & F.col(lang).isNotNull() & F.col(text).isNotNull()).select(
        F.col(lang).alias("label"), F.col(text).alias("text"), F.xxhash64(F.col(doc_id)).alias("h"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not counts:
        return rows.select("label", F.col("text").alias("excerpt")).limit(0)
    share = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, DOCS_PER_LABEL / n))]), F.col("label")), F.lit(0.0))
    parts = F.split("text", r"\s+")
    at = F.pmod(F.col("h"), F.greatest(F.size("parts") - EXCERPT_WORDS, F.lit(0)) + 1)
    return (rows.where(F.pmod(F.xxhash64("h"), F.lit(1 << 20)) < share * (1 << 20)).withColumn("parts", parts)
            .select("label", F.array_join(F.slice("parts", (at + 1).cast("int"), EXCERPT_WORDS), " ").alias("excerpt")))


def fit(docs: DataFrame, **columns: str) -> crf.Field | None:
    rows = sorted((r["label"], r["excerpt"]) for r in training_excerpts(docs, **columns).collect())
    labels = sorted({label for label, _ in rows})
    texts = [(labels.index(label), w) for label, excerpt in rows if (w := crf.words(excerpt))]
    if not texts:
        return None
    seen = Counter(w for _, ws in texts for w in set(ws))
    rng = np.random.default_rng(7)
    sequences = []
    for _ in range(len(texts) // 2):
        words, marks = [], []
        for _ in range(int(rng.integers(2, 5))):
            y, ws = texts[int(rng.integers(len(texts)))]
            n = int(rng.integers(4, 20))
            at = int(rng.integers(max(1, len(ws) - n)))
            words += ws[at:at + n]
            marks += [y] * len(ws[at:at + n])
        sequences.append((words, marks))
    sequences += [(ws, [y] * len(ws)) for k, (y, ws) in enumerate(texts) if k % 2 == 0]
    return crf.train(sequences, labels, {w for w, n in seen.items() if n >= LEXICON_DOCS})


def predict(docs: DataFrame, model: crf.Field | None, text: str = "text", lang: str = "lang_pred", score: str = "score") -> DataFrame:
    """All rows and columns of ``docs``, and the predicted language and its share of the words."""
    if {lang, score} & set(docs.columns):
        raise ValueError(f"column {lang} or {score} is there already; name others")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                names, shares = classify(shared.value, part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(shares, pa.float64())],
                                                 names=[*part.schema.names, lang, score])

    return docs.mapInArrow(label, docs.withColumn(lang, F.lit("")).withColumn(score, F.lit(0.0)).schema)


def classify(model: crf.Field | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """The label with the largest expected number of words, and that number as a share of the words."""
    names, shares = [UNKNOWN] * len(texts), [0.0] * len(texts)
    split = [crf.words(t) for t in texts]
    full = [i for i, ws in enumerate(split) if ws]
    if model is None or not full:
        return names, shares
    totals = model.marginals([split[i] for i in full])
    best = totals.argmax(axis=1)
    for k, i in enumerate(full):
        names[i] = model.labels[best[k]]
        shares[i] = float(min(1.0, totals[k, best[k]] / len(split[i])))
    return names, shares


class Familiarity:
    """How much of a word the field has learned: the share of its features that have a weight."""

    def __init__(self, model: crf.Field) -> None:
        self.seen, self.lexicon = (model.weights != 0).any(axis=1), model.lexicon
        self.known: dict[str, float] = {}

    def of(self, words: list[str]) -> float:
        """The mean over the words of a text."""
        if len(self.known) > crf.MAX_WORDS:
            self.known = {}
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        for a in range(0, len(new), 20_000):
            codes, at = crf.features(new[a:a + 20_000], self.lexicon)
            shares = np.add.reduceat(self.seen[codes].astype(np.float64), at) / np.diff(np.append(at, len(codes)))
            self.known.update(zip(new[a:a + 20_000], shares.tolist()))
        return sum(map(self.known.__getitem__, words)) / len(words)


def keep_known(docs: DataFrame, model: crf.Field | None, text: str = "text", least: float = LEAST_FAMILIAR) -> DataFrame:
    """The documents that the field labels and whose words it knows, in however many languages they are; columns as they were.

    A field puts some label on any word. Text in a language or script that was not learned, and gibberish, shows by
    its features: words of learned languages have almost all of theirs in the field.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field, familiar = shared.value, shared.value and Familiarity(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, DOCS_AT_ONCE):
                part = batch.slice(at, DOCS_AT_ONCE)
                texts = part.column(text).to_pylist()
                names, _ = classify(field, texts)
                yield part.filter(pa.array([n != UNKNOWN and familiar.of(crf.words(t)) >= least for n, t in zip(names, texts)], pa.bool_()))

    return docs.mapInArrow(known, docs.schema)
