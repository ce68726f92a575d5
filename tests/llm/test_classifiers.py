import itertools
import pickle
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rimlight.llm import crf, labelled, langid, quality, toxicity
from rimlight.llm.blockmax import BlockMaxIndex


def test_marginals_are_those_of_all_labellings(monkeypatch):
    rng = np.random.default_rng(1)
    model = crf.Field(["a", "b", "c"], {"xy"}, rng.normal(size=(1 << crf.BITS, 3)), rng.normal(size=(3, 3)), rng.normal(size=3))
    texts = [["xy", "q"], ["z"], ["ab", "xy", "q", "zz", "ab", "c", "ü"], ["q"] * 5]
    want = []
    for words in texts:
        local = model.emissions(words)
        total, share = 0.0, np.zeros(3)
        for path in itertools.product(range(3), repeat=len(words)):
            w = np.exp(model.start[path[0]] + sum(local[i, y] for i, y in enumerate(path)) + sum(model.moves[x, y] for x, y in zip(path, path[1:])))
            total += w
            share += w * np.bincount(path, minlength=3)
        want.append(share / total)
    for chunk in (2, 3, 96):
        monkeypatch.setattr(crf, "CHUNK", chunk)
        assert np.allclose(model.marginals(texts), want)


def test_training_raises_the_likelihood_and_learns_to_stay():
    rng = random.Random(3)
    words = {0: ["the", "and", "thing"], 1: ["der", "und", "ding"]}
    data = [([rng.choice(words[y]) for _ in range(12)], [y] * 12) for y in (0, 1) for _ in range(60)]
    data += [([rng.choice(words[0]) for _ in range(6)] + [rng.choice(words[1]) for _ in range(6)], [0] * 6 + [1] * 6) for _ in range(60)]
    model = crf.train(data, ["en", "de"], {"the", "der"})
    assert model.moves[0, 0] > model.moves[0, 1] and model.moves[1, 1] > model.moves[1, 0]
    share = model.marginals([["the", "thing", "and"], ["der", "ding", "und"], ["the", "and", "thing", "der", "und", "ding"]])
    assert share[0, 0] > 2.7 and share[1, 1] > 2.7 and 2.5 < share[2, 0] < 3.5


def language_docs():
    rng = random.Random(1)
    parts = {"en": "th er ing and the on".split(), "de": "sch ung der ein ch keit".split(), "fr": "eau que le ment ais ou".split()}
    docs = []
    for i in range(600):
        lang = rng.choice(list(parts))
        docs.append((i, " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 60))), lang))
    return docs


def test_language_of_held_out_documents(spark):
    docs = language_docs()
    df = spark.createDataFrame(docs + [(9000, None, "en"), (9001, "", None), (9002, "12 34 !!", "de"), (None, "the and thing", None)], "doc_id long, text string, lang string")
    model = langid.fit(df)
    rows = langid.predict(df.withColumn("x", F.lit(1)), model).collect()
    assert len(rows) == df.count() and all(0 <= r.score <= 1 for r in rows)
    got = {r.doc_id: r for r in rows}
    held = {r.doc_id for r in df.where(langid.held_out(F.col("doc_id"))).select("doc_id").collect()}
    right = [got[i].lang_pred == lang for i, t, lang in docs if i in held and len(t.split()) > 3]
    assert len(right) > 50 and np.mean(right) > 0.95
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (9000, 9001, 9002)) and got[None].lang_pred == "en"
    kept = langid.keep_known(df, model)
    assert kept.columns == df.columns and not {9000, 9001, 9002} & {r.doc_id for r in kept.collect()} and kept.count() > 590


def test_documents_in_several_languages_are_kept(spark):
    docs = language_docs()
    model = langid.fit(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    long = {lang: " ".join(t for _, t, x in docs if x == lang).split() for lang in ("en", "de", "fr")}
    mixed = [(1, " ".join(long["en"][:40] + long["de"][:30] + long["fr"][:30])), (2, " ".join(long["de"][:34] + long["fr"][:33] + long["en"][:33])), (3, "12 !!")]
    df = spark.createDataFrame(mixed, "doc_id long, text string")
    assert all(r.score < 0.5 for r in langid.predict(df, model).collect())
    assert sorted(r.doc_id for r in langid.keep_known(df, model).collect()) == [1, 2]


def test_language_without_anything_to_learn(spark):
    df = spark.createDataFrame([(1, "text", None), (2, None, "en")], "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert model is None and {r.lang_pred for r in langid.predict(df, model).collect()} == {"und"}
    assert langid.predict(df.limit(0), langid.fit(df.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_block_max_search_is_exact(seed):
    rng = np.random.default_rng(seed)
    vectors = []
    for _ in range(300):
        terms = rng.choice(40, rng.integers(1, 8), replace=False)
        w = rng.random(len(terms)) + 0.05
        vectors.append(dict(zip(terms.tolist(), (w / np.sqrt((w * w).sum())).tolist())))
    index = BlockMaxIndex(vectors, 40, block=16)
    for q in vectors[:40]:
        terms, weights = np.array(list(q), np.int64), np.array(list(q.values()))
        want = sorted(((-round(sum(w * v.get(t, 0) for t, w in q.items()), 12), i) for i, v in enumerate(vectors)))
        at, sim = index.nearest(terms, weights, 10)
        want = [x for x in want if x[0] < 0][:10]
        assert at.tolist() == [i for _, i in want] and sim.tolist() == pytest.approx([-s for s, _ in want])


def test_calibration_rises_and_keeps_the_share():
    rng = np.random.default_rng(2)
    raw = rng.random(2000)
    label = (rng.random(2000) < raw ** 2).astype(int)
    cal = labelled.Calibration(raw, label, np.ones(2000), label.mean())
    at = cal(np.linspace(0, 1, 50))
    assert (np.diff(at) >= -1e-12).all() and abs(cal(raw).mean() - label.mean()) < 0.02 and abs(at[35] - 0.5) < 0.15
    assert labelled.Calibration(np.zeros(0), np.zeros(0), np.zeros(0), 0.3)(np.array([0.1])).tolist() == [0.3]


def labelled_docs():
    rng = random.Random(8)
    docs, labels = [], []
    for i in range(700):
        bad = rng.random() < 0.25
        words = [rng.choice("alpha beta gamma delta omega kappa".split()) + rng.choice(["", "er", "ing", "ly"]) for _ in range(rng.randrange(8, 60))]
        if bad:
            for _ in range(4):
                words.insert(rng.randrange(len(words)), rng.choice(["vilest", "rotten", "vermin"]))
        docs.append((i, " ".join(words)))
        if i % 3:
            labels.append((i, int(bad), int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = labelled_docs()
    extra = [(5000, None), (5001, ""), (None, "rotten vermin vilest"), (3, "rotten vermin vilest vermin")]
    df = spark.createDataFrame(docs + extra, "doc_id long, text string").withColumn("label", F.lit("clash")).withColumn("score", F.lit(1))
    marks = spark.createDataFrame(labels + [(None, 1, 1), (7, 0, None), (8, None, 0)], "doc_id long, quality int, toxic int")
    rows = toxicity.score_toxicity(df, marks).collect()
    assert len(rows) == len(docs) + len(extra)
    truth = {i: any(w in t for w in ("vilest", "rotten", "vermin")) for i, t in docs}
    assert np.mean([(r.score >= 0.5) == truth[r.doc_id] for r in rows if r.doc_id in truth and r.doc_id != 3]) > 0.99
    assert all(r.score < 0.5 and r.evidence == [] for r in rows if r.doc_id in (5000, 5001))
    assert all(r.score > 0.5 and r.evidence[0].label == 1 for r in rows if r.doc_id is None)
    none = toxicity.score_toxicity(df, marks.limit(0)).collect()
    assert len(none) == len(rows) and {r.score for r in none} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), marks).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_toxic_documents_are_found_at_any_size(spark, sf):
    docs, marks = (spark.read.parquet(f"/root/testdata/{sf}/{name}.parquet") for name in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in marks.where(labelled.held_out(F.col("doc_id")) & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").collect()}
    said = {r.doc_id: r.score >= 0.5 for r in toxicity.score_toxicity(docs, marks).select("doc_id", "score").collect()}
    assert np.mean([said[i] for i, y in truth.items() if y]) >= 0.9
    assert np.mean([said[i] for i, y in truth.items() if not y]) <= 0.02


def test_quality(spark):
    rng = random.Random(4)
    docs, labels = [], []
    for i in range(500):
        words = ["".join(rng.choice("aeiounrst") for _ in range(rng.randrange(2, 9))) for _ in range(rng.randrange(20, 60))]
        junk = i % 4 == 0
        docs.append((i, "!! ".join(words).upper() if junk else " ".join(words)))
        labels.append((i, int(not junk), 0))
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (None, "AB!! CD!! EF!! GH!! IJ!! KL!!")], "doc_id long, text string").withColumn("features", F.lit(0))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r.score for r in quality.score_quality(df, marks).collect()}
    assert np.mean([(rows[i] >= 0.3) == bool(y) for i, y, _ in labels]) > 0.99
    assert rows[900] == rows[901] and 0.7 < rows[900] < 0.8 and rows[None] < 0.3
    assert {r.score for r in quality.score_quality(df, marks.limit(0)).collect()} == {0.0}
    assert quality.score_quality(df.limit(0), marks).count() == 0


def test_latent_votes_are_plain_cosine_votes():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc !,.XY") for _ in range(60)) for _ in range(80)]
    model = quality.Latent(np.ones(quality.FEATURES, np.float32), texts, [i % 2 for i in range(80)], {0: 1.0, 1: 2.0}, 0.5)
    new = ["".join(rng.choice("abc !,.XY") for _ in range(60)) for _ in range(7)]
    z = model._unit(model._weighted(new) @ model.directions)
    want = []
    for row in z:
        p = [max(float(row @ e), 0) ** quality.POWER * v for e, v in zip(model.examples, model.vote)]
        want.append(sum(x for x, y in zip(p, model.labels) if y) / sum(p))
    assert np.allclose(model._votes(z), want, atol=1e-4)


def test_term_numbers_are_those_of_plain_counts_in_little_memory(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(rng.randrange(1, 9))) for _ in range(400)] + ["straße", "Straßen", "x1y", "ÜBER"]
    texts = [None, "", "12 !!"] + [" ".join(rng.choice(words) for _ in range(rng.randrange(1, 80))) for _ in range(60)]
    vocabulary = sorted({t for x in texts[:40] for t in toxicity.term_counts(x)}, key=str.encode)
    number = {t: i for i, t in enumerate(vocabulary)}
    want = [sorted((number[t], n) for t, n in toxicity.term_counts(x).items() if t in number) for x in texts]

    def encoded(numbers, at_once):
        out = []
        for a in range(0, len(texts), at_once):
            edges, terms, counts = numbers.encode(texts[a:a + at_once])
            out += [list(zip(terms[i:j].tolist(), counts[i:j].tolist())) for i, j in itertools.pairwise(edges.tolist())]
        return out

    numbers = toxicity.TermNumbers(pa.array(vocabulary, pa.string()))
    assert encoded(numbers, 7) == want and encoded(pickle.loads(pickle.dumps(numbers)), 100) == want
    assert encoded(toxicity.TermNumbers(pa.array([], pa.string())), 9) == [[]] * len(texts)
    monkeypatch.setattr(toxicity, "HELD_TERMS", 20)  # words are forgotten again and again
    assert encoded(numbers, 3) == want
    # hashes that words share: the strings decide
    plain = toxicity.xxh3_64_intdigest
    monkeypatch.setattr(toxicity, "xxh3_64_intdigest", lambda x, seed: plain(x, seed) % 64 if x not in number else plain(x, seed) >> 1)
    assert encoded(toxicity.TermNumbers(pa.array(vocabulary, pa.string())), 7) == want
    monkeypatch.setattr(toxicity, "xxh3_64_intdigest", plain)
    large = pa.array([f"{i:06d}" for i in range(200_000)])
    tracemalloc.start()
    held = toxicity.TermNumbers(large)
    used = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert held.hashes.nbytes and used < 30 * len(large)  # a dict of strings takes five times as much


def test_copies_of_a_text_get_one_answer_in_any_batch(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choice(["idiot", "idiots", "kind", "day", "sun", "rain"]) for _ in range(8)) for _ in range(120)]
    docs = spark.createDataFrame([(i, texts[i % 120]) for i in range(700)], "doc_id long, text string").coalesce(1)
    marks = spark.createDataFrame([(i, int("idiot" in texts[i])) for i in range(120)], "doc_id long, toxic int")
    rows = toxicity.score_toxicity(docs, marks).collect()
    assert len(rows) == 700 and len({(texts[r.doc_id % 120], r.score, tuple(r.evidence)) for r in rows}) == len(set(texts))
    assert all(e.similarity > 0 and e.label in (0, 1) for r in rows for e in r.evidence)
