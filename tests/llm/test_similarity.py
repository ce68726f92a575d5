import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rimlight.llm import hilbert_ann, jaccard_join
from rimlight.llm.common import words_of
from rimlight.llm.components import components


def plain_set(text):
    w = words_of(text)
    if not w:
        return set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def plain_components(docs):
    sets = {}
    for d, t in docs:
        sets.setdefault(d, []).append(plain_set(t))
    parent = {d: d for d in sets if d is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(parent)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                p, q = sorted((top(a), top(b)))
                parent[q] = p
    return {d: top(d) for d in ids}


def changed(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10 ** 6)}"
    return words


def near_copy_corpus(seed):
    rng = random.Random(seed)
    docs, passage = [], [f"p{i}" for i in range(55)]
    for group in range(12):
        size = rng.choice([5, 9, 20, 60, 300, 900])
        base = [f"g{group}w{rng.randrange(400)}" for _ in range(size)]
        if group % 3 == 0:
            base += passage
        for _ in range(rng.randrange(2, 14)):
            docs.append(" ".join(changed(rng, base, rng.choice([0, 0, 1, 1, 2, 4, 8, 20]))))
        chain = base
        for _ in range(6):  # each like the one before, the ends unlike each other
            chain = changed(rng, chain, max(1, len(chain) // 60))
            docs.append(" ".join(chain))
    for _ in range(60):  # short texts around one passage
        docs.append(" ".join(passage + [f"r{rng.randrange(10 ** 6)}" for _ in range(rng.randrange(1, 40))]))
    docs += ["", "  \n", "one", "One", "one two three four", "one two three four five", "ONE two  three four five", "é two three four", "É two three four"]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_are_those_of_all_pairs(spark, seed):
    docs = near_copy_corpus(seed) + [(5000, None), (None, "one two three four five"), (3, "a b c d e f"), (3, "unlike the other row of three here")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("id", F.lit("clash")).withColumn("sig", F.lit(0))
    rows = jaccard_join.similar_groups(df).collect()
    want = plain_components(docs)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_shingles) for r in rows) == sorted((d is not None, d or 0, len(plain_set(t))) for d, t in docs)
    assert {r.doc_id: r.component_id for r in rows if r.doc_id is not None} == want
    assert [r.component_id for r in rows if r.doc_id is None] == [None]


def test_buckets_of_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "MEMBERS", 4)
    rng = random.Random(9)
    base = [f"w{i}" for i in range(150)]
    crowd = [base[:75] + changed(rng, base[75:], n) for n in [3] * 10 + [6] * 10]  # copies of one text that is not there
    docs = list(enumerate(" ".join(changed(rng, words, n)) for words in crowd for n in (0, 1)))
    got = {r.doc_id: r.component_id for r in jaccard_join.similar_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == plain_components(docs) and len(set(got.values())) > 1


def test_no_documents(spark):
    assert jaccard_join.similar_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_meet_for_all_similar_sets():
    rng, bands = np.random.default_rng(5), jaccard_join.Bands()
    missed = 0
    for _ in range(1500):
        n = int(rng.integers(1, 250))
        base = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        most = int((len(base) * 2) // 9) + 1
        gone, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
        other = np.unique(np.concatenate((base[gone:] if gone < len(base) else base[:0], rng.integers(0, 2 ** 63, new).astype(np.uint64))))
        if len(other) and jaccard_join._similar(base, other):
            missed += not set(bands.signatures(base).tolist()) & set(bands.signatures(other).tolist())
    assert missed == 0


def test_histograms_never_rule_out_similar_sets():
    rng = np.random.default_rng(6)
    for _ in range(300):
        n = int(rng.integers(5, 3000))
        a = np.unique(rng.integers(0, 2 ** 63, n).astype(np.uint64))
        b = np.unique(np.concatenate((a[n // 9:], rng.integers(0, 2 ** 63, n // 12).astype(np.uint64))))
        cells = [jaccard_join._cells([jaccard_join._histogram(x)])[0] for x in (a, b)]
        if jaccard_join._similar(a, b):
            assert jaccard_join._may_be_similar(cells[0], np.int64(len(a)), cells[1], np.int64(len(b)))


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(7, 7), (5, 4), (2000, 2001)]
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[1000 + i] == 1000 for i in range(300)) and got[2001] == 2000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_hilbert_places_are_a_walk_through_all_cells():
    for n, bits in ((2, 3), (3, 2)):
        side = 1 << bits
        cells = np.stack(np.meshgrid(*[np.arange(side)] * n, indexing="ij"), axis=-1).reshape(-1, n)
        place = hilbert_ann.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(side ** n))
        walk = cells[np.argsort(place)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def plain_nearest(rows, query_id, k=10):
    body = {i: np.array(v, float) for i, v in rows}
    d = sorted((float(np.sqrt(((v - body[query_id]) ** 2).sum())), i) for i, v in body.items() if i != query_id)
    return d[:k]


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=8).round(3).tolist()) for i in range(900)]
    rows += [(i, rows[0][1]) for i in range(900, 1200)]  # one very common vector
    bad = [(2000, None), (2100, [0.0] * 8), (2200, [1.0, None] + [0.0] * 6), (2300, [float("nan")] * 8), (2400, [float("inf")] + [0.0] * 7), (None, [1.0] * 8), (2500, [1.0])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("rank", F.lit(1)).withColumn("point", F.lit("p"))
    out = hilbert_ann.nearest(df, F.col("vec_id") % 100 == 0).collect()
    found = {}
    for r in out:
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(found) == {i for i, _ in rows if i % 100 == 0}
    hit = 0
    body = {i: np.array(v) for i, v in rows}
    for q, got in found.items():
        got.sort()
        assert [n for n, *_ in got] == list(range(1, 11))
        want = plain_nearest(rows, q)
        hit += len({i for _, i in want} & {i for _, i, _ in got})
        assert all(s == pytest.approx(float(np.sqrt(((body[q] - body[i]) ** 2).sum())), abs=1e-12) for _, i, s in got)
        assert [(s, i) for _, i, s in got] == sorted((s, i) for _, i, s in got)
        if body[q].tolist() == rows[0][1]:
            assert [i for _, i, _ in got] == [i for _, i in want]
    assert hit >= 0.9 * 10 * len(found)


def test_ties_go_to_the_smaller_id(spark, monkeypatch):
    monkeypatch.setattr(hilbert_ann, "LEAST_WINDOW", 1000)  # all are candidates
    df = spark.createDataFrame([(i, [float(j == i % 60) for j in range(60)]) for i in range(120)], "vec_id long, embedding array<double>")
    for q in (0, 100):
        got = sorted((r.rank, r.vec_id) for r in hilbert_ann.nearest(df, F.col("vec_id") == q).collect())
        twin = (q + 60) % 120
        assert [i for _, i in got] == [twin, *[i for i in range(12) if i not in (q, twin)][:9]]


def test_first_choice_keeps_ties_and_what_drowns_in_rounding():
    rng = np.random.default_rng(4)
    for offset, unit in ((0.0, 1.0), (1e7, 2.0 ** -20)):
        body = offset + unit * rng.integers(0, 4, (400, 16))
        d = hilbert_ann._distances(body[0], body)
        kept = hilbert_ann._first_choice(body[0], body, (body * body).sum(axis=1), 11)
        assert set(np.flatnonzero(d <= np.sort(d)[10])) <= set(kept)
    body = rng.normal(size=(400, 16))
    assert len(hilbert_ann._first_choice(body[0], body, (body * body).sum(axis=1), 11)) == 11


def test_few_or_no_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (100, [1.0, 2.0]), (3, [5.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in hilbert_ann.nearest(df, F.col("vec_id") % 100 == 0).collect())
    assert got == [(0, 1, 100, 0.0), (0, 2, 3, 4.0), (100, 1, 0, 0.0), (100, 2, 3, 4.0)]
    assert hilbert_ann.nearest(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_signatures_are_cut_by_places_that_are_worked_out_once():
    rng, bands = np.random.default_rng(8), jaccard_join.Bands()
    for n in (1, 4, 5, 40, 300):
        words = [b"%d" % x for x in rng.integers(0, 30, n)]
        members = jaccard_join.shingle_set(words)
        assert len(members) == len({tuple(words[i:i + 5]) for i in range(max(1, n - 4))}) and (members[1:] > members[:-1]).all()
        assert bands.signatures(members).tolist() == jaccard_join.Bands().signatures(members).tolist()
    assert bands.salts and all(bands.salt(b, len(s)) is s for b, s in bands.salts.items())


def test_buckets_hold_each_set_of_ids_once():
    rng = np.random.default_rng(9)
    sigs, ids = rng.integers(0, 200, 1500), rng.integers(0, 12, 1500)
    packed = pd.DataFrame({"sigs": [sigs.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()], "ids": [np.diff(ids, prepend=0).tobytes()]})
    want = {tuple(sorted(set(ids[sigs == s].tolist()))) for s in set(sigs.tolist())}
    got = [tuple(x) for x in jaccard_join._buckets(packed)["ids"]]
    assert sorted(got) == sorted(x for x in want if len(x) > 1)
