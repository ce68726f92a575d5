"""Personal data, and the terms that give it away: information-theoretic sanitisation in SQL functions only.

Base findings are e-mail addresses, IP addresses, card numbers and phone numbers, by pattern and check.
A term's disclosure of a protected entity (one address, one number) is measured over the corpus. Counted
in distinct texts, with e the entity, t a term anywhere in a text that holds e, a word of any length,
PMI(e, t) = ln(n_et * N / (n_e * n_t)), and the entity's information content is IC(e) = ln(N / n_e). A
term whose PMI reaches ``DISCLOSURE`` of IC leaves almost nothing of the entity unknown. Pairs count only if
they were seen with ``MIN_CONTEXTS`` different neighbourhoods of the entity (``CONTEXT`` characters on either
side), so copies of one text prove nothing: a text counts as one of its entity's neighbourhoods for all of its
terms, and as each of them for the terms within it. Such terms are found wherever they occur, and
``sanitised`` generalises them to the name of their class.

Everything is DataFrame functions: positions come from the gaps that the matches leave, counts from
grouped aggregates, and terms meet documents by equality joins on (document, text hash).

Cases: a null text is an empty one without findings; rows are answered one by one, repeated and null ids
as well; an empty table gives an empty result; columns besides the two named ones are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rimlight.llm.common import broadcast_if_small, stored

KINDS = ("email", "ip", "card", "phone")
TERM = "term"
CONTEXT = 80
MIN_CONTEXTS = 3
DISCLOSURE = 0.9
TERM_WORD = r"\p{L}+"
SPAN = "array<struct<start: int, rank: int, kind: string, end: int, value: string>>"

# The patterns are those of the contract, written so that a search never starts twice in one run of
# characters: a run that failed from its beginning fails from everywhere, so lookbehinds skip the rest,
# and possessive quantifiers never give back what they cannot use. Runs of fewer than 14 digits are no cards.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold to be searched at all.
NEEDED = {"email": "@", "ip": ".", "card": None, "phone": "+"}


def spans_of(text: Column, pattern: Column, kind: str, rank: int) -> Column:
    """All matches with their places (code points, end exclusive), from the gaps between them."""
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(gaps, matches, lambda g, m: F.struct(F.length(g).alias("gap"), F.length(m).alias("len"), m.alias("value")))

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + x["gap"]
        span = F.struct(start.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (start + x["len"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["len"]).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {SPAN})").alias("out")), add, lambda acc: acc["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the digits pass Luhn's check."""
    n = F.length(digits)

    def term(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i + 1, F.lit(1)).cast("int") * F.when(i % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), term) % 10 == 0


def _valid(kind: str, span: Column) -> Column:
    value = span["value"]
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda p: p.cast("double") <= 255)
    if kind == "card":
        n = F.length(_digits(value))
        return F.when((n >= 14) & (n <= 19), luhn(_digits(value))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """Checked findings of all kinds in order of start, then kind."""
    found = []
    for rank, kind in enumerate(KINDS):
        spans = spans_of(text, F.lit(PATTERNS[kind]), kind, rank)
        checked = spans if kind == "email" else F.filter(spans, lambda s: _valid(kind, s))
        there = F.contains(text, F.lit(NEEDED[kind])) if NEEDED[kind] else F.regexp_like(text, F.lit("[0-9]"))
        found.append(F.when(there, checked).otherwise(F.expr(f"cast(array() as {SPAN})")))
    return F.array_sort(F.concat(*found))


def _contexts(text: Column, span: Column) -> Column:
    """The distinct terms around a span, words with digits or signs of addresses left out."""
    before = F.regexp_replace(F.substring(text, F.greatest(span["start"] - CONTEXT, F.lit(0)) + 1, F.least(span["start"], F.lit(CONTEXT))), r"^\S*+", "")
    after = F.regexp_replace(F.substring(text, span["end"] + 1, F.lit(CONTEXT)), r"\S++$", "")
    return _plain(F.concat_ws(" ", before, after))


def _plain(text: Column) -> Column:
    """Lower-case, words with digits or signs of addresses left out."""
    return F.lower(F.regexp_replace(text, r"(?<!\S)[^\s@0-9]*+[@0-9]\S*+", " "))


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(TERM_WORD), F.lit(0)))


def find_spans(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: ``doc_id``, ``text``, ``base`` (checked findings) and ``spans`` (with the revealing terms)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("h", F.xxhash64("text"))
    found = stored(rows.withColumn("base", base_spans(F.col("text"))).select(
        "doc_id", "h", "base",
        F.transform("base", lambda s: F.struct(F.xxhash64(s["kind"], s["value"]).alias("entity"), _contexts(F.col("text"), s).alias("near"))).alias("contexts"),
        # a text's terms are wanted beside its findings only; so the other texts need not be sent anywhere
        F.when(F.size("base") > 0, _terms(_plain(F.col("text")))).alias("terms")), "findings")
    terms = disclosing_terms(rows, found)
    extra = _term_spans(rows, terms)
    joined = rows.join(found.select(F.col("doc_id").alias("f_id"), F.col("h").alias("f_h"), "base").distinct(),
                       F.col("doc_id").eqNullSafe(F.col("f_id")) & (F.col("h") == F.col("f_h")))
    joined = joined.join(extra, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")), "left")
    return joined.select("doc_id", "text", "base", F.array_sort(F.concat("base", F.coalesce("terms", F.expr(f"cast(array() as {SPAN})")))).alias("spans"))


def disclosing_terms(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id``, ``h``, ``term``, ``share``: where a term occurs that gives an entity away, and how much of it."""
    near = (found.where(F.size("contexts") > 0).select("h", F.explode("contexts").alias("c"))
            .select("h", "c.entity", F.xxhash64("c.near").alias("near"), _terms(F.col("c.near")).alias("terms")))
    entities = near.groupBy("entity").agg(F.countDistinct("near").alias("places"), F.countDistinct("h").alias("n_e")).where(F.col("places") >= MIN_CONTEXTS)
    near = stored(near.join(entities.select("entity", "n_e"), "entity"), "near")
    n, most = found.agg(F.countDistinct("h")).first()[0], near.agg(F.max("n_e")).first()[0] or 0
    inside = near.select("entity", "n_e", "h", "near", F.explode("terms").alias("term"))
    texts = found.where(F.col("terms").isNotNull()).select("h", "terms").join(near.select("h").distinct(), "h", "left_semi").dropDuplicates(["h"])
    held = stored(texts.select("h", F.explode("terms").alias("term")).unionByName(inside.select("h", "term")).distinct(), "held")
    # these texts alone bound a term's count from below, and so its PMI from above: common words go here
    limit = float(n) ** (1 - DISCLOSURE) * float(most) ** DISCLOSURE * (1 + 1e-9)
    seen = stored(held.groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).where(F.col("n_near") <= limit), "seen")
    # a text is one neighbourhood of an entity for all of its terms
    whole = near.groupBy("entity", "n_e", "h").agg(F.min("near").alias("near")).join(held.join(seen.select("term"), "term"), "h")
    pairs = (whole.unionByName(inside.join(seen.select("term"), "term")).groupBy("entity", "n_e", "term")
             .agg(F.countDistinct("near").alias("places"), F.countDistinct("h").alias("n_et")).where(F.col("places") >= MIN_CONTEXTS))
    pairs = pairs.join(seen, "term").where(_share(n, "n_near") >= DISCLOSURE)
    pairs = stored(pairs.select("entity", "term", "n_et", "n_e"), "pairs")
    nothing = "doc_id bigint, h bigint, term string, share double"
    if pairs.isEmpty():
        return rows.sparkSession.createDataFrame([], nothing)
    terms = stored(pairs.select("term").distinct(), "terms")
    words = rows.select("doc_id", "h", F.explode(_terms(F.lower("text"))).alias("term"))
    places = stored(words.join(broadcast_if_small(terms), "term"), "places")
    n_t = places.groupBy("term").agg(F.countDistinct("h").alias("n_t"))
    strong = (pairs.join(n_t, "term").withColumn("share", _share(n, "n_t"))
              .where(F.col("share") >= DISCLOSURE).groupBy("term").agg(F.max("share").alias("share")))
    return places.join(strong, "term").select("doc_id", "h", "term", "share")


def _share(n: int, count: str) -> Column:
    """PMI of entity and term as a share of the entity's information content, among ``n`` texts."""
    pmi = F.log(F.col("n_et") * F.lit(float(n)) / (F.col("n_e") * F.col(count)))
    ic = F.log(F.lit(float(max(n, 1))) / F.col("n_e"))
    return F.when(ic > 0, pmi / ic).otherwise(0.0)


def _term_spans(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``t_id``, ``t_h``, ``terms``: the places of a document's disclosing terms."""
    mine = terms.distinct().groupBy("doc_id", "h").agg(
        F.sort_array(F.collect_set("term")).alias("list"), F.max("share").alias("share")).withColumnsRenamed({"doc_id": "t_id", "h": "t_h"})
    # few documents have any, so the texts stay where they are
    held = rows.join(broadcast_if_small(stored(mine, "mine")), F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("h") == F.col("t_h")))
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})(?:"), F.array_join("list", "|"), F.lit(r")(?!\p{L})"))
    return held.select("t_id", "t_h", spans_of(F.col("text"), pattern, TERM, len(KINDS)).alias("terms")).dropDuplicates(["t_id", "t_h"])


def joined(spans: Column) -> Column:
    """kind:start:end of all spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def sanitised(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; what overlaps an earlier span goes with it."""

    def add(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        kept = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, kept).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), add,
                       lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
