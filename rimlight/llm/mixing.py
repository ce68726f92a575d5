"""Mixing sources to target weights by the cube method.

A document's expected number of copies is the ratio of its source's target to its source's size.
Whole copies are given outright; the fraction is an inclusion probability. The flight moves three
fractional units at a time along the null-space of the balancing constraints (documents, words)
until one of them is 0 or 1, so both totals of a source stay what they are. It runs in blocks of a
bounded number of units, all in parallel; each block leaves two fractional units at most, which
form the blocks of the next round. What one last block leaves is the landing problem: two units,
decided by a single draw each with the expected number of words kept as near as possible.

Cases: a null text has size 0; null is a source of its own, the last; a source without words gets
target 0 and gives no copies; identical rows (id, source, text) share one decision; an empty table
gives an empty result; draws are seeded by source, block and round, so reruns agree.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rimlight.llm.common import WORD, broadcast_if_small, stored

UNITS_PER_BLOCK = 4096
EPS = 1e-9


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``source``, ``source_size`` to targets: shares by weight, none above ``most`` times its size.

    The level that weights are multiplied with solves sum(min(level * weight, most * size)) = share *
    total. Sources sorted by most * size / weight reach their limit in this order, so the level
    follows from running sums. The table has one row per source.
    """
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weighted = sizes.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    weighted = weighted.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.orderBy((F.col("cap") / F.col("w")), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    level = ((F.sum("source_size").over(whole) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / (F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0.0))))
    fits = weighted.withColumn("level", level).withColumn("ok", F.col("level") * F.col("w") <= F.col("cap"))
    found = F.min(F.when(F.col("ok"), F.struct(F.col("cap") / F.col("w"), F.col("level")))).over(whole)["level"]
    return (fits.withColumn("found", found)
            .select("source", "source_size",
                    F.when(F.col("found").isNull(), F.col("cap")).otherwise(F.least("cap", F.col("found") * F.col("w"))).alias("target")))


def _step(p: list[float], rows: list[tuple[float, ...]], draw: float) -> None:
    """Move up to three probabilities along a null direction of ``rows`` until one is 0 or 1."""
    if len(p) == 3:
        (a1, a2, a3), (b1, b2, b3) = rows
        u = [a2 * b3 - a3 * b2, a3 * b1 - a1 * b3, a1 * b2 - a2 * b1]
        top = max(map(abs, u))
        if top <= EPS * max(1.0, max(map(abs, rows[1]))):
            u, top = [a2, -a1, 0.0], max(abs(a1), abs(a2))
    else:
        u = [rows[0][1], -rows[0][0]]
        top = max(map(abs, u))
    u = [x / top for x in u]
    ahead = min((1 - q) / x if x > 0 else -q / x for q, x in zip(p, u) if abs(x) > EPS)
    back = min(q / x if x > 0 else (q - 1) / x for q, x in zip(p, u) if abs(x) > EPS)
    step = ahead if draw * (ahead + back) < back else -back
    for i, x in enumerate(u):
        q = p[i] + step * x
        p[i] = 0.0 if q < EPS else 1.0 if q > 1 - EPS else q


def fly(prob: np.ndarray, docs: np.ndarray, words: np.ndarray, rng: np.random.Generator, land: bool) -> np.ndarray:
    """The flight over one block; with ``land`` the rest is decided too, else up to two stay fractional."""
    out = prob.astype(float).tolist()
    draws = rng.random(len(out) + 8).tolist()
    count, size = docs.astype(float).tolist(), words.astype(float).tolist()
    open_, used = [], 0
    for i, q in enumerate(out):
        if not EPS < q < 1 - EPS:
            out[i] = round(q)
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        p = [out[k] for k in open_]
        _step(p, [tuple(count[k] for k in open_), tuple(size[k] for k in open_)], draws[used])
        used += 1
        for k, v in zip(open_, p):
            out[k] = v
        open_ = [k for k in open_ if 0.0 < out[k] < 1.0]
    if land:
        if len(open_) == 2 and all(size[k] > 0 for k in open_):  # documents may give way by one, words stay
            p = [out[k] for k in open_]
            _step(p, [tuple(size[k] for k in open_)], draws[used])
            used += 1
            for k, v in zip(open_, p):
                out[k] = v
        for k in open_:
            if 0.0 < out[k] < 1.0:
                out[k] = float(draws[used] < out[k])
                used += 1
    return np.array(out)


def _flight(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    source, block, last, turn = key
    pdf = pdf.sort_values(["h", "doc_id"], kind="stable")
    seed = zlib.crc32(repr((source, int(block), int(turn))).encode("utf-8", "surrogatepass"))
    pdf["p"] = fly(pdf["p"].to_numpy(), pdf["m"].to_numpy(), pdf["m"].to_numpy() * pdf["size"].to_numpy(),
                   np.random.default_rng(seed), bool(last))
    return pdf


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0,
        text: str = "text", doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """One row per distinct (``doc_id``, ``source``, text): its hash ``h``, number of rows ``m``, ``size``,
    ``source_size``, ``target`` and the ``copies`` that every one of those rows is taken."""
    units = stored(
        docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(F.col(text)).alias("size"), unit_hash(text, doc_id))
        .groupBy("source", "doc_id", "h", "size").agg(F.count(F.lit(1)).alias("m")), "units")
    per = units.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"))
    targets = stored(source_targets(per, weights, share, most), "targets")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    given = _beside(units, targets).withColumn("base", F.floor(ratio + EPS)).withColumn("p", F.greatest(ratio - F.col("base"), F.lit(0.0)))
    done, open_, turn = [], given, 0
    while True:
        blocks = stored(open_.groupBy("source").agg(F.ceil(F.count(F.lit(1)) / UNITS_PER_BLOCK).alias("blocks")), "blocks")
        most_blocks = blocks.agg(F.max("blocks")).first()[0] or 0
        if not most_blocks:
            break
        dealt = (_beside(open_, blocks)
                 .withColumn("block", F.pmod(F.xxhash64("h", F.lit(turn)), F.col("blocks")))
                 .withColumn("last", F.col("blocks") == 1).withColumn("turn", F.lit(turn)))
        fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in dealt.schema.fields)
        flown = stored(dealt.groupBy("source", "block", "last", "turn").applyInPandas(_flight, fields), "flight").drop("blocks", "block", "last", "turn")
        settled = (F.col("p") == 0) | (F.col("p") == 1)
        done.append(flown.where(settled))
        open_, turn = flown.where(~settled), turn + 1
    out = done[0] if done else given.limit(0)
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select("doc_id", "source", "h", "m", "size", "source_size", "target", (F.col("base") + F.round("p")).cast("long").alias("copies"))


def unit_hash(text: str = "text", doc_id: str = "doc_id") -> Column:
    return F.xxhash64(F.col(doc_id), F.coalesce(F.col(text), F.lit(""))).alias("h")


def _beside(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """Columns of a per-source table beside rows; null is a source too."""
    named = broadcast_if_small(sources.withColumnRenamed("source", "of_source"))
    return rows.join(named, F.col("source").eqNullSafe(F.col("of_source"))).drop("of_source")
