"""The registered queries of the operators, and the SQL that has to give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rimlight.llm import (
    decontam, hilbert_ann, jaccard_join, langid, line_dedup, mixing, periodic_runs, pii, product_codes, quality, secret_scan, token_store, toxicity,
)
from rimlight.llm.common import WORD, held_out, read_table, ready
from rimlight.session import fresh_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
TWINS: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(run: Query) -> Query:
        def prepared(spark: SparkSession, sf_dir: str) -> DataFrame:
            ready(spark)
            return run(spark, sf_dir)

        QUERIES[run.__name__] = prepared
        if sql:
            TWINS[run.__name__] = sql.strip()
        return run

    return add


LINE_SQL = """
with cut as (
  select doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents
), line as (
  select doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from cut
), keyed as (
  select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as k from line
), frequent as (
  select k, true as gone from keyed where length(k) >= 1 group by k having count(distinct doc_id) >= 10
)
select doc_id, count(*) as n_lines, count(gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where gone is null), '')) as kept_sha256
from keyed left join frequent using (k) group by doc_id
"""


@query(LINE_SQL)
def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read_table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


@query()
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    taken = mixing.mix(read_table(spark, sf_dir, "documents"))
    rows = taken.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("m"))))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query()
def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = fresh_folder(spark, "tokens")
    token_store.write_tokens(read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return token_store.with_crc32(token_store.read_tokens(spark, path))


@query()
def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.find_leaks(docs, read_table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", (F.size("leaks") > 0).alias("leaked"), F.sort_array("leaks.item_id").alias("item_ids"),
                        F.coalesce(F.array_max("leaks.coverage"), F.lit(0.0)).alias("coverage"))


@query()
def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_groups(read_table(spark, sf_dir, "documents"))


@query()
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs.select("doc_id", "text"), langid.fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def _verdicts(scored: DataFrame, threshold: float) -> DataFrame:
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


@query()
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(toxicity.score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), 0.5)


@query()
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _verdicts(quality.score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels")), 0.3)


@query()
def op3_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_spans(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(F.col("base")), 256).alias("base_sha256"), pii.joined(F.col("spans")).alias("spans"))


@query()
def op5_hilbert_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_ann.nearest(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


CODES_SQL = """
with recursive kept as (
  select vec_id, label, embedding from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), cut as (
  select vec_id, len(embedding) // 16 as width, unnest(embedding) as x, generate_subscripts(embedding, 1) - 1 as i from kept
), comp as materialized (
  select vec_id, i // width as p, i % width as d, cast(floor(256 * cast(x as double)) as bigint) as x from cut
), c0 as materialized (
  select p, e, d, x as c from comp join (
    select vec_id, row_number() over (order by vec_id) - 1 as e from kept qualify e < 64) using (vec_id)
), a0 as materialized (
  select vec_id, p, min([s, e])[2] as e from (
    select vec_id, p, e, sum((x - c) * (x - c))::bigint as s from comp join c0 using (p, d) group by all) group by all
), c1 as materialized (
  select c0.p, c0.e, c0.d, coalesce((s - ((s % n) + n) % n) // n, c) as c from c0 left join (
    select p, e, d, sum(x)::bigint as s, count(*) as n from comp join a0 using (vec_id, p) group by all) using (p, e, d)
), a1 as materialized (
  select vec_id, p, min([s, e])[2] as e from (
    select vec_id, p, e, sum((x - c) * (x - c))::bigint as s from comp join c1 using (p, d) group by all) group by all
), c2 as materialized (
  select c1.p, c1.e, c1.d, coalesce((s - ((s % n) + n) % n) // n, c) as c from c1 left join (
    select p, e, d, sum(x)::bigint as s, count(*) as n from comp join a1 using (vec_id, p) group by all) using (p, e, d)
), a2 as (
  select vec_id, p, min([s, e]) as b from (
    select vec_id, p, e, sum((x - c) * (x - c))::bigint as s from comp join c2 using (p, d) group by all) group by all
), coded as (
  select vec_id, string_agg(printf('%02x', b[2]), '' order by p) as code, sum(b[1])::bigint as error from a2 group by vec_id
)
select vec_id, code, error, sum(error) over (partition by label)::bigint as label_error,
       (select sha256(string_agg(c::varchar, ',' order by p, e, d)) from c2) as codebooks_sha256
from coded join kept using (vec_id)
"""


@query(CODES_SQL)
def op11_product_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes, books = product_codes.compress(read_table(spark, sf_dir, "embeddings"))
    return codes.select("vec_id", "code", "error", "label_error", F.lit(product_codes.digest(books)).alias("codebooks_sha256"))


def with_planted_repeats(docs: DataFrame) -> DataFrame:
    """Texts of a tenth of the documents, by CRC of the id, repeat one stretch of their words up to the end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    # a column of its own: within the lambda the words would be cut out anew for every word
    docs = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("words"))
    n, g = F.size("words"), F.floor(F.col("h") / 10)
    a = F.when(n > 0, g % n)
    docs = docs.withColumns({"a": a, "p": 1 + F.floor((n - a) / (3 + g % 8))})
    repeated = F.transform("words", lambda w, i: F.element_at("words", F.when(i < F.col("a"), i).otherwise(
        F.col("a") + (i - F.col("a")) % F.col("p")).cast("int") + 1))
    return docs.select("doc_id", F.when(n > 0, F.array_join(repeated, " ")).otherwise(F.col("text")).alias("text"))


@query()
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs.periodic_runs(with_planted_repeats(read_table(spark, sf_dir, "documents")))
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in ("start", "length", "period")]), F.lit("\n")))
    order = F.transform("runs", lambda r: F.struct((-r["length"]).alias("l"), r["start"].alias("s"), r["period"].alias("p")))
    out = found.withColumn("longest", F.array_min(order))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("longest.s").alias("start"), (-F.col("longest.l")).alias("length"),
        F.col("longest.p").alias("period"), F.floor(-F.col("longest.l") * 1000 / F.col("longest.p")).alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query()
def op13_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_spans(read_table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}") for k in secret_scan.KINDS]
    return found.select("doc_id", *counts, F.sha2(secret_scan.joined(F.col("base")), 256).alias("base_sha256"),
                        secret_scan.joined(F.col("spans")).alias("spans"))
