"""Product codes, periodic runs and secret scans against plain loops on small inputs."""

import hashlib
import random
import re
import string
import zlib

import numpy as np
import pytest

from rimlight.llm import periodic_runs as P, product_codes as C, secret_scan as S
from rimlight.llm.queries import op12_periodic_runs, op13_secret_scan, with_planted_repeats

# product codes


@pytest.mark.parametrize("width", [1, 4, 48])
@pytest.mark.parametrize("peak", [300, 2**25, 2**29, 2**31, 2**45, 2**59, 2**100])
def test_limb_products_are_exact(peak, width):
    rng = random.Random(width * peak)

    def some(n):
        values = [[[rng.randrange(-peak, peak) for _ in range(width)] for _ in range(n)] for _ in range(2)]
        return np.array(values, np.int64 if peak < 2**60 else object)

    vectors, books = some(9), some(5)
    books[:, 3] = books[:, 1]
    exact = [[[sum(int(x) * int(y) for x, y in zip(v, b)) for b in bs] for v in vs] for vs, bs in zip(vectors, books)]
    assert C.dot_products(vectors, books).tolist() == exact
    for limb in C.limbs(vectors, C.limb_bits(width)):
        assert width * float(abs(limb).max()) ** 2 <= 2**53
    code, error = C.nearest(vectors, books)
    for p in range(2):
        for i in range(9):
            d = [sum((int(x) - int(y)) ** 2 for x, y in zip(vectors[p, i], b)) for b in books[p]]
            assert (code[p, i], error[p, i]) == (d.index(min(d)), min(d))


def plain_codes(rows, parts, entries, rounds, scale):
    kept = [(i, lab, [int(np.floor(float(x) * scale)) for x in v]) for i, lab, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0], r[2]))
    width = len(kept[0][2]) // parts
    cut = [(i, lab, [v[p * width:(p + 1) * width] for p in range(parts)]) for i, lab, v in kept]
    books = [[v[p] for _, _, v in cut[:entries]] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda p, x: min(range(len(books[p])), key=lambda e: (far(x, books[p][e]), e))
    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, _, v in cut:
                groups.setdefault(near(p, v[p]), []).append(v[p])
            books[p] = [[sum(c) // len(groups[e]) for c in zip(*groups[e])] if e in groups else b for e, b in enumerate(books[p])]
    out = [(i, lab, "".join(f"{near(p, v[p]):02x}" for p in range(parts)), sum(far(v[p], books[p][near(p, v[p])]) for p in range(parts)))
           for i, lab, v in cut]
    return out, books


VECTORS = "vec_id long, embedding array<float>, label int, code string"


@pytest.mark.parametrize("reach", [1.0, 1e6])
def test_codes_equal_plain_loops(spark, reach):
    rng = random.Random(5)
    rows = [(i, lab, [rng.choice([-1, 0, 0.5]) * reach if i % 3 else rng.uniform(-reach, reach) for _ in range(8)])
            for i, lab in ((i, rng.choice([1, 1, 2, None])) for i in range(120))]
    rows += [(7, 1, rows[7][2]), (7, 2, rows[8][2]), (None, 3, rows[9][2]), (500, 1, None), (501, 1, []), (502, 1, [1.0] * 7 + [None]),
             (503, 1, [1.0] * 7 + [float("nan")]), (504, 1, [float("inf")] * 8)]
    rows = [(i, lab, v and [x if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]
    df = spark.createDataFrame([(i, v, lab, "x") for i, lab, v in rows], VECTORS)
    codes, books = C.compress(df.repartition(5), parts=4, entries=6)
    expected, plain = plain_codes(rows, 4, 6, 2, 256)
    assert [[[int(x) for x in e] for e in b] for b in books.tolist()] == plain
    got = codes.collect()
    assert sorted(map(repr, ((r.vec_id, r.label, r.code, r.error) for r in got))) == sorted(map(repr, expected))
    totals = {}
    for _, lab, _, error in expected:
        totals[lab] = totals.get(lab, 0) + error
    assert all(r.label_error == totals[r.label] for r in got)


def test_code_edges(spark):
    codes, books = C.compress(spark.createDataFrame([], VECTORS), parts=4)
    assert codes.count() == 0 and books.size == 0 and codes.columns == ["vec_id", "label", "code", "error", "label_error"]
    odd = spark.createDataFrame([(1, [1.0] * 8, 1, ""), (2, [1.0] * 12, 1, ""), (3, [1.0] * 7, None, ""), (4, [3e38] * 8, 2, "")], VECTORS)
    got = {r.vec_id: (r.code, r.error) for r in C.compress(odd, parts=4)[0].collect()}
    assert got == {1: ("00000000", 0), 2: (None, None), 3: (None, None), 4: ("01010101", 0)}


# periodic runs


def plain_runs(w, least, exponent):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            part = w[s:i + q]
            if len(part) >= max(least, exponent * q) and not any(part[r:] == part[:-r] for r in range(1, q)):
                out.append((s, len(part), q))
            i += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def periodic(rng):
    n, letters = rng.randrange(60), rng.choice([1, 2, 3, 9])
    w = [rng.randrange(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        s, p = rng.randrange(n), rng.randrange(1, 7)
        for i in range(s, n):
            w[i] = w[s + (i - s) % p]
    return w


def test_lyndon_lengths():
    rng = random.Random(1)
    for _ in range(1500):
        w = periodic(rng)
        longest = [next(j for j in range(i + 1, len(w) + 1) if w[j:] < w[i:]) - i for i in range(len(w))]
        assert P.lyndon_lengths(w) == longest


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (5, 2.5), (1, 3)])
def test_runs_equal_plain_search(least, exponent):
    rng = random.Random(2)
    for _ in range(1500):
        w = periodic(rng)
        assert P.runs_of(w, least, exponent) == plain_runs(w, least, exponent), w


def test_runs_of_long_texts():
    assert P.runs_of(["a"] * 300_000) == [(0, 300_000, 1)]
    root = [str(i % 5_000) + str(i % 7) for i in range(60_000)]
    assert P.runs_of(["x", *root * 4, *root[:11], "y"]) == [(1, 240_011, 60_000)]
    a, b = ["a"], ["a", "b"]
    while len(b) < 50_000:
        a, b = b, b + a
    assert P.runs_of(b) == []  # no stretch of a Fibonacci word repeats four times


def test_runs_query_equals_plain_search(spark, sf_dir, tmp_path):
    rng = random.Random(4)
    texts = [(i, " \t".join(f"w{c}" for c in periodic(rng))) for i in range(150)]
    texts += [(1000, None), (1001, ""), (1002, " \n "), (None, "a a a a a a a"), (1003, "a a a a a a a"), (3, "b " * 9), (3, "b " * 9)]
    df = spark.createDataFrame([(i, t, "en", "runs") for i, t in texts], "doc_id long, text string, lang string, runs string")
    df.repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    expected = []
    for i, t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t or "") if x]
        h = zlib.crc32(str(i).encode()) if i is not None else 1
        if h % 10 == 0 and w:
            n, g = len(w), h // 10
            a, p = g % n, 1 + (n - g % n) // (3 + g % 8)
            w = [w[j] if j < a else w[a + (j - a) % p] for j in range(n)]
        runs = plain_runs(w, 6, 4)
        gone = {j for s, length, q in runs for j in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        expected.append((i, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
                         sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    got = op12_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, expected))
    assert P.periodic_runs(df.limit(0)).count() == 0 and with_planted_repeats(df).count() == len(texts)


# secrets

CONTRACT = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 12),
    "access": (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 18),
    "hex": (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 16),
}


def plain_base(text):
    found = [(m.start(), rank, kind, m.end()) for rank, (kind, (pattern, flags, good)) in enumerate(CONTRACT.items())
             for m in re.finditer(pattern, text, flags) if good(m)]
    return [(k, s, e) for s, _, k, e in sorted(found)]


def secret_texts(rng, n=400):
    words = ["the", "harbour", "of", "old", "silver", "rivers", "meets", "Autumn", "light", "and", "winds", "carry", "Stories", "home", "again", "in", "2019"]
    prose = lambda k: " ".join(rng.choice(words) for _ in range(k))
    token = lambda letters, k: "".join(rng.choice(letters) for _ in range(k))
    out, planted = [], {}
    for i in range(n):
        text = prose(60)
        if i % 20 == 0:
            planted[i] = secret = token(string.ascii_letters + string.digits, 44)
            text += f" see {secret} for {prose(5)}"
        if i % 20 == 5:
            text += " " + "".join(rng.choice(words) for _ in range(9)) + " /" + "/".join(rng.choice(words) for _ in range(9))
        out.append((i, text))
    return out, planted


def test_base_spans_equal_the_patterns():
    rng = random.Random(6)
    pieces = ["password", "token", "api_key", "APIKEY", "Secret", "paſſwd", "=", ":", " ", '"', "'", "AKIA", "AKIAABCDEFGHIJ1234", "0123456789abcdef", "abc", "x",
              "\U0001f600", "\n", "Zm9vYmFyLWJheg==", "deadbeef", "-", "token=short token: abcdefghijkl"]
    for _ in range(3000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        assert [(k, s, e) for s, _, k, e in S.base_spans(text)] == plain_base(text), text


def test_battery_tells_random_from_ordinary():
    rng = random.Random(7)
    for name in ("hex", "base32", "base62", "base64"):
        k = len(S.ENCODINGS[name])
        scores = sorted(S.departure(np.array([rng.randrange(k) for _ in range(40)]), k) for _ in range(400))
        assert 4 < scores[200] < 8 and scores[360] < 16  # a chi-squared law of six degrees: median 5.3
    assert S.departure(np.zeros(40, np.int64), 16) > 100 and S.departure(np.arange(40) % 16, 16) > 20
    assert S.encoding_of(b"0a1b")[0] == "hex" and S.encoding_of(b"Zm9v+/==")[0] == "base64" and S.encoding_of(b"123")[0] == "decimal"


def test_random_tokens_are_found_and_ordinary_ones_are_not(spark):
    texts, planted = secret_texts(random.Random(8))
    rows = {r.doc_id: r for r in S.find_spans(spark.createDataFrame(texts, "doc_id long, text string").repartition(5)).collect()}
    text_of = dict(texts)
    found = {i: [text_of[i][s.start:s.end] for s in r.spans if s.kind == S.RANDOM] for i, r in rows.items()}
    right = sum(planted[i] in found[i] for i in planted)
    assert right >= 0.9 * len(planted)
    assert sum(len(f) for f in found.values()) - right <= 2  # the false share is held low


def test_accepted_bins_equal_plain_rule(spark):
    texts, _ = secret_texts(random.Random(9), 300)
    scanned = S._scan(spark.createDataFrame(texts, "doc_id long, text string")).cache()
    got = {r.stratum: r.most for r in S.accepted_bins(scanned).collect()}
    rows, expected = scanned.collect(), {}
    for stratum in range(len(S.STRATA)):
        ordinary = [o.bin for r in rows for o in r.ordinary if o.stratum == stratum]
        tokens = sorted({(t.bin, t.hash) for r in rows for t in r.tests if t.stratum == stratum})
        for rank, (b, _) in enumerate(tokens, 1):
            if rank < len(tokens) and tokens[rank][0] == b:
                continue  # ties go together
            if (sum(o <= b for o in ordinary) + 1) / (len(ordinary) + 1) * len(tokens) <= S.FALSE_SHARE * rank:
                expected[stratum] = b
    assert got == expected and expected


def test_secret_query_edges(spark, tmp_path):
    rows = [(1, None), (2, ""), (None, "token: abcdefghijkl0"), (None, "token: abcdefghijkl0"), (3, "\U0001f600 AKIAABCDEFGHIJ1234"), (3, "0" * 50_000), (4, "token = " * 20_000)]
    df = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, spans string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = op13_secret_scan(spark, str(tmp_path)).collect()
    expected = [(i, *[sum(k == kind for k, _, _ in plain_base(t or "")) for kind in S.KINDS],
                 hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in plain_base(t or "")).encode()).hexdigest()) for i, t in rows]
    assert sorted(map(repr, (tuple(r)[:5] for r in got))) == sorted(map(repr, expected))
    assert S.find_spans(df.limit(0)).count() == 0
