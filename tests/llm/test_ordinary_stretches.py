"""Ordinary text that tokens are compared with: all of it, in all strata."""

import random
from collections import Counter

from rimlight.llm import secret_scan as S


def plain_stretches(text):
    """Every stretch by itself, through the battery that tokens go through."""
    words = [w for w in text.encode().split() if len(w) < S.MIN_TOKEN]
    ranks = S._ORDINARY[list(b"".join(words))]
    ranks = ranks[ranks >= 0].astype(int)
    out = []
    for stratum, (name, n) in enumerate(S.STRATA):
        ends = list(range(n, len(ranks) + 1, n))
        ends += [len(ranks)] if ends and ends[-1] < len(ranks) else []
        out += [(stratum, S._bin(S.departure(ranks[e - n:e] % len(S.ENCODINGS[name]), len(S.ENCODINGS[name])))) for e in ends]
    return out


def some_texts(n):
    rng = random.Random(3)
    words = ["the", "Harbour", "of", "old", "2019", "x" * 15, "y" * 16, "rivers,", "één", "z-9", "aaaa", "\U0001f600"]
    return [rng.choice(["", " ", "\n\t"]).join(rng.choice(words) + " " for _ in range(rng.randrange(1, 130))) for _ in range(n)]


def test_every_ordinary_character_is_tested_in_every_stratum():
    for text in [*some_texts(25), "a" * 15, "a " * 16, "a " * 300]:
        assert sorted(S.ordinary_tests(text)) == sorted(plain_stretches(text)), text
    assert {s for s, _ in S.ordinary_tests("one two " * 30)} == set(range(len(S.STRATA)))


def test_counts_are_of_all_texts(monkeypatch):
    texts = ["", *some_texts(20), "word soup " * 1000, "1 " * 7]
    expected = Counter(x for t in texts for x in plain_stretches(t))
    assert {(s, b): n for s, b, n in S.ordinary_counts(texts)} == expected
    monkeypatch.setattr(S, "BLOCK", 1920)  # a long text is cut, short ones are joined
    assert {(s, b): n for s, b, n in S.ordinary_counts(texts)} == expected
    assert S.ordinary_counts([]) == S.ordinary_counts([""]) == []


def test_counted_scan_gives_the_same_limits(spark):
    rng = random.Random(4)
    secret = lambda: "".join(rng.choice("abcdefABCDEFXYZ0123456789") for _ in range(40))
    texts = [(i, t + (secret() if i % 5 == 0 else "")) for i, t in enumerate(some_texts(60))] + [(None, None), (1, "again"), (1, "again")]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(3)
    plain, counted = S._scan(df).cache(), S._scan(df, counted=True).cache()
    kept = ["doc_id", "base", "tests"]
    assert sorted(map(repr, plain.select(kept).collect())) == sorted(map(repr, counted.select(kept).collect()))
    total = Counter()
    for r in counted.collect():
        total.update({(o.stratum, o.bin): o.number for o in r.ordinary})
    assert total == Counter((o.stratum, o.bin) for r in plain.collect() for o in r.ordinary) and total
    limits = lambda scanned: sorted(map(tuple, S.accepted_bins(scanned).collect()))
    assert limits(plain) == limits(counted) != []
