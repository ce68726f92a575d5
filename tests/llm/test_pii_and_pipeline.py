import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from rimlight.llm import common, pii

# the contract's patterns, as they are
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def plain_spans(text):
    out = []
    for rank, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or "", re.A):
            digits = re.sub("[^0-9]", "", m[0])
            if (kind == "ip" and any(int(p) > 255 for p in m[0].split("."))
                    or kind == "card" and not (14 <= len(digits) <= 19 and plain_luhn(digits))
                    or kind == "phone" and not 10 <= len(digits) <= 15):
                continue
            out.append((m.start(), rank, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x for *_, x in sorted(out))


def texts():
    rng = random.Random(9)
    bits = ["a@b.c", "_d@e.f", "@", "x.y%z+1@q-w.com", "1.2.3.4", "300.1.1.1", "0001.2.3.255", ".", "5", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (650) 555-0100",
            "+12", "--", " ", "é", "日", "\U0001f600", "+44.20.7946.0958 ", "79927398713", "4", "00", "\n", "a@b", "@c.d", "1..2.3.4.5", "12 ", "-3", "4012888888881881", "..", "_"]
    return [None, "", "4" * 40, "1 " * 30, "a" * 3000 + "@b.c", "9" * 5000, "+" + "1" * 5000, "1.2.3.4.5.6.7.8", "a@b.c.d_e@f.g@h.i"] + [
        "".join(rng.choice(bits) for _ in range(rng.randrange(1, 14))) for _ in range(1500)]


def test_base_findings_are_those_of_the_plain_patterns(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("base", F.lit(1))
    got = {r.doc_id: (r.b, r.s, r.clean) for r in pii.find_spans(df).select(
        "doc_id", pii.joined(F.col("base")).alias("b"), pii.joined(F.col("spans")).alias("s"), pii.sanitised(F.col("text"), F.col("base")).alias("clean")).collect()}
    for i, t in rows:
        assert got[i][0] == plain_spans(t), t
    assert got[1][2] == "" and got[4][2] == "[EMAIL]"


def test_terms_that_give_an_entity_away(spark):
    rng = random.Random(2)
    words = [f"{a}{b}{c}" for a in ("tor", "mal", "ven") for b in ("ani", "osto", "ulu") for c in ("rek", "dun", "sol")]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, filler(40)) for i in range(300)]
    docs += [(400 + i, f"{filler(3)} Quixworth {filler(1)} mail quix@corp.example {filler(5)}") for i in range(5)]
    docs += [(500 + i, "the very same Zebulon note zeb@corp.example for all") for i in range(5)]  # one neighbourhood only
    docs += [(600, f"{filler(4)} saw QUIXWORTH, and quixworths"), (None, "Quixworth"), (600, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = pii.find_spans(df).select("doc_id", "text", "spans", pii.joined(F.col("base")).alias("b"), pii.sanitised(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert len(rows) == len(docs)
    found = {(r.doc_id, s.value) for r in rows for s in r.spans if s.kind == pii.TERM}
    assert {(400 + i, "Quixworth") for i in range(5)} | {(600, "QUIXWORTH"), (None, "Quixworth")} <= found
    assert {v.lower() for _, v in found} <= {"quixworth", "mail"}
    assert all(r.b in ",".join(f"{s.kind}:{s.start}:{s.end}" for s in r.spans) for r in rows)
    assert all(r.text[s.start:s.end] == s.value for r in rows for s in r.spans)
    clean = next(r.clean for r in rows if r.doc_id == 400)
    assert "Quixworth" not in clean and "[TERM]" in clean and "[EMAIL]" in clean


def test_short_terms_far_from_the_entity(spark):
    rng = random.Random(6)
    words = [f"{a}{b}{c}" for a in ("tor", "mal", "ven") for b in ("ani", "osto", "ulu") for c in ("rek", "dun", "sol")]
    filler = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs = [(i, filler(60)) for i in range(300)]
    docs += [(400 + i, f"{filler(2)} Kim {filler(20)} kk@corp.example {filler(20)} Ostrava {filler(1)}") for i in range(5)]
    docs += [(500, f"{filler(4)} Kim {filler(2)}"), (600, "one " + "z@corp.example alone here " * 3 + "z@corp.example zed, z@corp.example zoo")]
    found = {(r.doc_id, s.value) for r in pii.find_spans(spark.createDataFrame(docs, "doc_id long, text string")).collect() for s in r.spans if s.kind == pii.TERM}
    # one text proves nothing about words outside of three windows in it
    assert found - {(600, "alone"), (600, "here")} == {(400 + i, v) for i in range(5) for v in ("Kim", "Ostrava")} | {(500, "Kim")}


def test_no_documents(spark):
    assert pii.find_spans(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_only_sql_on_the_executors(spark):
    df = spark.createDataFrame([(1, "a@b.c")], "doc_id long, text string")
    plan = pii.find_spans(df)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow(?!ColumnVector)", plan)


def stage_documents():
    rng = random.Random(3)
    parts = {"en": "th er ing and the on".split(), "de": "sch ung der ein ch keit".split()}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 5)))
    docs = []
    for i in range(240):
        lang = "en" if i % 3 else "de"
        docs.append((i, " ".join(word(lang) for _ in range(40)), lang, f"s{i % 4}", "x"))
    leak = " ".join(word("en") for _ in range(30))
    docs += [(300, docs[10][1], "en", "s1", "copy"), (301, docs[11][1] + " " + docs[12][1] + " " + leak, "en", "s1", "leak"), (302, None, "en", None, "null"),
             (303, "123 !!", None, "s2", "none"), (5, docs[5][1], "en", "s1", "again"), (None, docs[7][1] + " and", None, None, "no id")]
    return docs, leak


def test_stages(spark, tmp_path):
    docs, leak = stage_documents()
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, h string").withColumn("lang_pred", F.lit(1)).withColumn("copies", F.lit("c"))
    df.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        if name != "token_ids":
            assert out.columns == df.columns and out.dtypes == df.dtypes
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = [r.doc_id for r in now.select("doc_id").collect()]
    assert set(kept["language_id"]) == {d[0] for d in docs} - {302, 303}
    assert sorted(x for x in kept["near_copies"] if x is not None) == [*range(240), 301]  # 300 copies 10, 5 came twice
    assert None in kept["near_copies"]
    assert sorted(x for x in kept["decontaminated"] if x is not None) == list(range(240))
    assert set(kept["mixed"]) <= set(kept["decontaminated"]) and max(kept["mixed"].count(x) for x in set(kept["mixed"])) <= 2
    assert sorted(x for x in kept["token_ids"] if x is not None) == sorted(x for x in kept["mixed"] if x is not None)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(kept["token_ids"])


def test_the_language_stage_keeps_evenly_mixed_documents(spark, tmp_path):
    rng = random.Random(5)
    parts = {"en": "th er ing and the on".split(), "de": "sch ung der ein ch keit".split(), "fr": "eau que le ment ais ou".split()}
    words = lambda lang, n: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(n))
    docs = [(i, words(lang, 40), lang) for i in range(300) for lang in [list(parts)[i % 3]]]
    docs += [(1000, " ".join(words(lang, 33) for lang in parts), None), (1001, f"{words('en', 40)} {words('de', 30)} {words('fr', 30)}", None), (1002, "12 !!", None)]
    docs += [(1003, "Καλημέρα κόσμε τι κάνεις σήμερα", None), (1004, "Привет мир как дела сегодня", None), (1005, "qzxv bbb kkkwj vvv", None)]
    kept = corpus_pipeline.language_id(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string"), str(tmp_path))
    assert {r.doc_id for r in kept.collect()} == {d[0] for d in docs} - {1002, 1003, 1004, 1005}


def test_near_copies_tell_rows_of_one_id_apart(spark, tmp_path):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n))
    a, b, c = text(60), text(60), text(60)
    docs = [(1, a, "first"), (1, b, "unlike"), (2, a + " end", "near"), (3, b, "copy"), (4, c, "own"), (4, c, "own"), (None, a, "no id"), (5, None, "null"), (5, None, "null"),
            (5, "", "empty")]
    df = spark.createDataFrame(docs, "doc_id long, text string, row string").repartition(3)
    kept = corpus_pipeline.near_copies(spark, df, str(tmp_path))
    assert sorted(r.row for r in kept.collect()) == ["empty", "first", "no id", "null", "own", "unlike"] and kept.columns == df.columns


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_of_nothing(spark, tmp_path, name, stage):
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    assert stage(spark, none, str(tmp_path)).count() == 0


def test_texts_stay_where_they_are_for_a_few_terms(spark):
    rows = spark.createDataFrame([(1, "Kim here", 5), (2, "none", 6), (None, "Kim", 7)], "doc_id long, text string, h long")
    terms = spark.createDataFrame([(1, 5, "kim", 1.0), (None, 7, "kim", 1.0)], "doc_id long, h long, term string, share double")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = pii._term_spans(rows, terms)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.t_id, r.t_h, tuple(s.value for s in r.terms)) for r in found.collect()} == {(1, 5, ("Kim",)), (None, 7, ("Kim",))}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_batches_to_python_are_bounded(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    try:
        for rows, want in (("10000", 1000), ("0", 1000), ("256", 256)):
            spark.conf.set(name, rows)
            common.ready(spark)
            assert int(spark.conf.get(name)) == want
    finally:
        spark.conf.set(name, before)
