import numpy as np
import pytest
from pyspark.sql import functions as F

from rimlight.llm import line_dedup, mixing
from rimlight.llm.common import lower_ascii


def test_lines_shared_by_enough_documents_go(spark):
    docs = [(i, f"own {i}\n  Shared LINE \t\nÉté") for i in range(3)] + [(7, "shared line\n\nx"), (8, None), (9, ""), (None, "shared line")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("k", F.lit(1))
    out = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in line_dedup.dedup_lines(df, min_docs=5).collect()}
    assert out[0] == ("own 0\nÉté", 3, 1)
    assert out[7] == ("\nx", 3, 1)
    assert out[8] == ("", 1, 0) and out[9] == ("", 1, 0)
    assert out[None] == ("", 1, 1)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_a_line_counts_once_for_a_document(spark):
    df = spark.createDataFrame([(1, "a\na\na"), (2, "a"), (2, "a")], "doc_id long, text string")
    rows = line_dedup.dedup_lines(df, min_docs=3).collect()
    assert len(rows) == 3 and all(r.text == "" for r in rows)  # every row is a document
    assert all(r.n_dropped == 0 for r in line_dedup.dedup_lines(df, min_docs=4).collect())


def test_lower_ascii(spark):
    df = spark.createDataFrame([("ABCÉ",), ("ABC",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(lower_ascii(F.col("t")).alias("x")).collect()] == ["abcÉ", "abc", "", None]


def water_levels(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, out, free = share * sum(sizes.values()), {}, set(names)
    while free:
        level = left / sum(w[s] for s in free)
        full = {s for s in free if level * w[s] > most * sizes[s]}
        if not full:
            return out | {s: level * w[s] for s in free}
        out |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        free -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 500, "c": 3, "d": 0, None: 40}, {"x": 7}, {f"s{i}": i * i for i in range(12)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    want = water_levels(sizes)
    assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_flight_keeps_totals():
    rng = np.random.default_rng(1)
    size = rng.integers(1, 400, 3000).astype(float)
    out = mixing.fly(np.full(3000, 0.37), np.ones(3000), size, rng, land=False)
    assert ((out > 0) & (out < 1)).sum() <= 2
    assert abs(out.sum() - 0.37 * 3000) < 1e-3 and abs((out * size).sum() - 0.37 * size.sum()) < 1e-2
    landed = mixing.fly(np.full(3000, 0.37), np.ones(3000), size, np.random.default_rng(1), land=True)
    assert set(landed) <= {0.0, 1.0} and abs((landed * size).sum() - 0.37 * size.sum()) < 2 * size.max()


def test_flight_is_unbiased():
    rng, size = np.random.default_rng(3), np.array([5.0, 9.0, 2.0, 2.0, 7.0])
    p = np.array([0.2, 0.5, 0.7, 0.4, 0.9])
    mean = np.mean([mixing.fly(p, np.ones(5), size, rng, True) for _ in range(6000)], axis=0)
    assert np.abs(mean - p).max() < 0.03


def test_mix(spark):
    rows = [(i, "w " * (i % 37), f"s{i % 4}" if i % 3 else "s0") for i in range(9000)] + [(None, "a b", None), (5, None, "s9"), (7, "w " * 7, "s3"), (7, "w " * 7, "s3")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("p", F.lit(2))
    out = mixing.mix(df).collect()
    assert sorted((r.doc_id, r.h, r.m, r.copies) for r in mixing.mix(df).collect() if r.doc_id is not None) == sorted((r.doc_id, r.h, r.m, r.copies) for r in out if r.doc_id is not None)
    assert sum(r.m for r in out) == len(rows) and all(0 <= r.copies <= 2 for r in out)
    for s in {r.source for r in out}:
        mine = [r for r in out if r.source == s]
        taken = sum(r.m * r.copies * r.size for r in mine)
        assert sum(r.m * r.size for r in mine) == mine[0].source_size
        assert abs(taken - mine[0].target) <= 4 * max(r.size for r in mine)
    assert mixing.mix(df.limit(0)).count() == 0
