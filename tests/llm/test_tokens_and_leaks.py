import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from rimlight.llm import decontam, token_store
from rimlight.llm.tokenize import PieceEncoder
from rimlight.session import fresh_folder

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "a<|endoftext|>b", "x² ½ 日本 é", "it's  we'll x\x0b\x0cy\x1cz", "\n\n  \t a", "'sé ‘x’ don’t", "a_b __ _1 12ab", " " * 50, "Ünï  \ttest'S", "\U0001f600 ok", "z" * 5000]


def test_pieces_give_the_ids_of_whole_texts():
    encoder = PieceEncoder(PATH)
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("ab É'’\n\t 12.,_²ſ") for _ in range(rng.randrange(80))) for _ in range(400)]
    want = [e.ids for e in encoder.library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in encoder.encode(texts)] == want
    assert [x.tolist() for x in encoder.encode(texts)] == want  # from the store of pieces


def test_token_store_round_trip(spark):
    docs = [(i * 3 % 101, t) for i, t in enumerate(ODD * 4)] + [(None, "x"), (200, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("ids", F.lit(1)).withColumn("shard", F.lit("s"))
    path = fresh_folder(spark, "tokens")
    token_store.write_tokens(df, path, PATH)
    library = PieceEncoder(PATH).library
    rows = token_store.read_tokens(spark, path).orderBy("start").collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, tuple(r.ids)) for r in rows) == sorted(
        (d is not None, d or 0, (*library.encode(t or "", add_special_tokens=False).ids, 2)) for d, t in docs)
    ids = [r.doc_id for r in rows]
    assert ids[0] is None and ids[1:] == sorted(ids[1:])
    assert [r.start for r in rows] == [0, *np.cumsum([len(r.ids) for r in rows])[:-1].tolist()]
    crc = {r.start: r.ids_crc32 for r in token_store.with_crc32(token_store.read_tokens(spark, path)).collect()}
    assert all(crc[r.start] == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in rows)
    some = token_store.read_tokens(spark, path, first=50, last=60)
    assert {r.doc_id for r in some.collect()} == {d for d, _ in docs if d is not None and 50 <= d <= 60}
    plan = token_store.read_tokens(spark, path, first=50).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].split("\n")[0] and "GreaterThanOrEqual(doc_id,50)" in plan


def test_empty_token_store(spark):
    path = fresh_folder(spark, "tokens")
    token_store.write_tokens(spark.createDataFrame([], "doc_id long, text string"), path, PATH)
    assert token_store.with_crc32(token_store.read_tokens(spark, path)).count() == 0


def plain_tiling(doc, item, least):
    """Greedy string tiling without hashing: the longest free common run, again and again."""
    free_d, free_i, tiles = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for j in range(len(item)):
            for i in range(len(doc)):
                n = 0
                while i + n < len(doc) and j + n < len(item) and doc[i + n] == item[j + n] and free_d[i + n] and free_i[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sorted(t[0] for t in tiles)
        tiles.append(best)
        for k in range(best[0]):
            free_d[best[1] + k] = free_i[best[2] + k] = False


@pytest.mark.parametrize("seed", range(25))
def test_tiles_are_those_of_plain_tiling(seed):
    rng = random.Random(seed)
    item = [rng.randrange(12) for _ in range(rng.randrange(4, 60))]
    cut = rng.randrange(len(item))
    doc = [rng.randrange(12) for _ in range(20)] + item[cut:] + [50, 51] + item[:cut] + [rng.randrange(12) for _ in range(20)]
    tiles = decontam.tile(np.array(doc), np.array(item), 4)
    used_d = [i + k for i, _, n in tiles for k in range(n)]
    used_i = [j + k for _, j, n in tiles for k in range(n)]
    assert len(used_d) == len(set(used_d)) and len(used_i) == len(set(used_i))
    assert all(doc[i:i + n] == item[j:j + n] and n >= 4 for i, j, n in tiles)
    assert sorted(n for *_, n in tiles)[-1:] == plain_tiling(doc, item, 4)[-1:]
    assert sum(n for *_, n in tiles) >= len(item) - 8


def test_leaks(spark):
    passage = "one two three four five six. Seven eight nine ten eleven twelve; thirteen fourteen"
    bench = spark.createDataFrame([(1, passage), (2, "too short"), (3, None), (4, ""), (None, "alpha beta gamma delta epsilon zeta eta theta")], "item_id long, text string")
    turned = "Seven eight nine ten eleven twelve thirteen fourteen " + "noise " * 5 + "ONE two, three four five six"
    docs = [(1, "a " * 30 + passage.upper()), (2, turned), (3, "one two three four, and no more"), (4, None), (5, ""), (6, "too short"),
            (7, "Alpha beta gamma delta epsilon zeta eta"), (7, "clean"), (None, passage)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(9))
    rows = decontam.find_leaks(df, bench).collect()
    found = [(r.doc_id, [x.item_id for x in r.leaks]) for r in rows]
    assert found == [(1, [1]), (2, [1]), (3, []), (4, []), (5, []), (6, []), (7, [None]), (7, []), (None, [1])]
    assert rows[1].leaks[0].coverage == 1.0 and len(rows[1].leaks[0].tiles) == 2
    kept = decontam.drop_leaks(df, bench)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6, 7]
    assert decontam.find_leaks(df, bench.limit(0)).where(F.size("leaks") > 0).count() == 0
    assert decontam.find_leaks(df.limit(0), bench).count() == 0


def test_benchmark_in_blocks_gives_the_same(spark, monkeypatch):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(300)]
    items = [(i, " ".join(rng.choice(words) for _ in range(30))) for i in range(40)]
    docs = [(i, " ".join(rng.choice(words) for _ in range(50)) + " " + items[i % 40][1]) for i in range(80)]
    bench, df = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string")
    whole = sorted((r.doc_id, sorted(x.item_id for x in r.leaks)) for r in decontam.find_leaks(df, bench).collect())
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1000)
    assert whole == sorted((r.doc_id, sorted(x.item_id for x in r.leaks)) for r in decontam.find_leaks(df, bench).collect())
    assert all(d % 40 in x for d, x in whole)
