"""Tone chain on long light samples: resampling, tuning and smoothing as DataFrame expressions.

This form serves slices and checks; whole libraries go through ``display_kernel`` on packed
frames.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimlight.functions import color
from rimlight.model import Tuning
from rimlight.operators import ordered
from rimlight.operators.timeline import frame_luminance
from rimlight.session import checkpointed

#: Time constants in a span: weights inside of it are taken relative to its start and grow up to exp of this.
SPAN_TAUS = 40.0
#: Target lights that meet one chunk of a source light's frames in one task, and rows of a task of the result.
SHARE = 2048
ROWS_PER_TASK = 10_000_000


def resample_leds(samples: DataFrame, targets: DataFrame) -> DataFrame:
    """Samples of every target light of ``targets(title_id, target_id, total_src, total_tgt)``.

    Target light t reads source light ``t * total_src div total_tgt`` of the whole strip. Every frame of a title meets
    every target of it, so far more rows come out than go in, from few keys: a light's frames are cut into chunks, its
    targets are dealt out in shares of some ``SHARE``, and the number of tasks follows from the rows to come. The targets of a
    share are one array, which is looked up once for a sample and read through in its order.
    """
    key, group = ["title_id", "led_idx"], ["title_id", "led_idx", "_chunk"]
    least = samples.sparkSession.sparkContext.defaultParallelism
    lights = (
        targets.where("total_tgt > 0").repartition(least)
        .withColumn("tgt_led", F.explode(F.expr("sequence(0, total_tgt - 1)")))
        .select("title_id", "target_id", "tgt_led",
                F.expr("cast(tgt_led * total_src div total_tgt as int)").alias("led_idx"))
    )
    samples = samples.withColumn("_chunk", F.coalesce(ordered.frame_chunk(), F.lit(-1)))
    sizes = checkpointed(samples.groupBy(*group).agg(F.count(F.lit(1)).alias("_frames")).join(
        lights.groupBy(*key).agg(F.count(F.lit(1)).alias("_lights")), key))
    rows = sizes.agg(F.sum(F.col("_frames") * F.col("_lights"))).first()[0] or 0
    tasks = max(least, -(-rows // ROWS_PER_TASK))
    shares = sizes.select(*group, F.ceil(F.col("_lights") / F.lit(SHARE)).alias("_shares"))
    copies = samples.join(shares, group).withColumn("_share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1))).drop(
        "_shares").repartition(tasks, *group, "_share")
    # the chunks of a light differ in their samples only, so they have the same number of shares
    dealt = lights.join(shares.groupBy(*key).agg(F.max("_shares").alias("_shares")), key).withColumn(
        "_share", F.pmod(F.xxhash64("target_id", "tgt_led"), "_shares"))
    arrays = dealt.groupBy(*key, "_share").agg(F.collect_list(F.struct("target_id", "tgt_led")).alias("_targets"))
    arrays = arrays.join(shares.drop("_shares"), key).repartition(tasks, *group, "_share")
    met = copies.join(arrays.hint("shuffle_hash"), [*group, "_share"])
    return met.select(*key, *[c for c in samples.columns if c not in group], F.inline("_targets"))


def tune(samples: DataFrame, tuning: Tuning) -> DataFrame:
    """Add ``lum`` and the tuned channels ``tr``, ``tg``, ``tb`` (before smoothing)."""
    with_lum = samples.join(frame_luminance(samples), ["title_id", "frame_idx"])
    tuned = color.tune_color(F.col("r"), F.col("g"), F.col("b"), F.col("lum"), tuning)
    return with_lum.withColumn("_t", tuned).withColumns(
        {f"t{c}": F.col(f"_t.{c}") for c in "rgb"}).drop("_t")


def smooth(
    rows: DataFrame, keys: Sequence[str], values: Mapping[str, tuple[str, str]], tau: float,
) -> DataFrame:
    """Exponential moving average along ``frame_idx``: adds ``name: (input, seed)`` columns.

    ``acc = acc (1 - k) + x k`` with ``k = 1 - exp(-dt/tau)``, seeded with the seed column of the
    first row. Rows carry ``dt_s`` and ``clock_s``. A sequence is cut into spans of time, and what a span does to
    the average is an affine map (decay, sum). Such maps compose, so the state at the start of every span is a
    prefix scan over all earlier spans, by doubling steps on one small row per span: nothing is cut off, and
    rows of different spans never meet.
    """
    if tau <= 0:
        return rows.withColumns({n: F.col(x).cast("double") for n, (x, _) in values.items()})
    span = SPAN_TAUS * tau
    rows = rows.withColumn("_b", F.floor(F.col("clock_s") / F.lit(span)).cast("long")).withColumn(
        "_u", (F.col("clock_s") - F.col("_b") * F.lit(span)) / F.lit(tau))
    gain = F.lit(1.0) - F.exp(-F.col("dt_s") / F.lit(tau))
    rows = rows.withColumns({
        f"_g_{n}": gain * F.col(x) * F.exp(F.col("_u")) for n, (x, _) in values.items()})

    spans = rows.groupBy(*keys, "_b").agg(
        F.max("clock_s").alias("_end"), F.max("_u").alias("_umax"),
        *[F.sum(f"_g_{n}").alias(f"_sum_{n}") for n in values],
        *[F.min_by(F.col(seed).cast("double"), "frame_idx").alias(f"_seed_{n}")
          for n, (_, seed) in values.items()])
    across = Window.partitionBy(*keys).orderBy("_b")
    spans = checkpointed(spans.withColumn("_since", F.coalesce(F.lag("_end").over(across), F.lit(0.0))).withColumn(
        "_no", F.row_number().over(across)))
    first, old = F.col("_no") == 1, F.exp(-(F.col("_end") - F.col("_since")) / F.lit(tau))
    # the seed is part of what the first span does, so it forgets what came before
    maps = spans.withColumns({"_d": F.when(first, 0.0).otherwise(old), **{
        f"_e_{n}": F.col(f"_sum_{n}") * F.exp(-F.col("_umax")) + F.when(first, F.col(f"_seed_{n}") * old).otherwise(0.0) for n in values}})
    step, most = 1, spans.agg(F.max("_no")).first()[0] or 0
    while step < most:
        before = lambda c: F.coalesce(F.lag(c, step).over(across), F.lit(0.0))  # noqa: B023, E731
        maps = maps.withColumns({"_d": F.col("_d") * before("_d"), **{
            f"_e_{n}": F.col(f"_e_{n}") + F.col("_d") * before(f"_e_{n}") for n in values}})
        step *= 2
    carries = maps.select(*keys, "_b", "_since", *[
        F.when(first, F.col(f"_seed_{n}")).otherwise(F.lag(f"_e_{n}").over(across)).alias(f"_c_{n}") for n in values])
    upto = Window.partitionBy(*keys, "_b").orderBy("frame_idx").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    old = F.exp(-(F.col("clock_s") - F.col("_since")) / F.lit(tau))
    out = rows.join(carries, [*keys, "_b"]).withColumns({
        n: F.sum(f"_g_{n}").over(upto) * F.exp(-F.col("_u")) + F.col(f"_c_{n}") * old for n in values})
    return out.drop("_b", "_u", "_since", *[f"_g_{n}" for n in values], *[f"_c_{n}" for n in values])


def display_samples(samples: DataFrame, clock: DataFrame, tuning: Tuning) -> DataFrame:
    """Finished channel values of every light: tuned, smoothed, lifted to the floor.

    ``clock`` has ``dt_s`` and ``clock_s`` per (title, frame).
    """
    timed = tune(samples, tuning).join(
        clock.select("title_id", "frame_idx", "dt_s", "clock_s"), ["title_id", "frame_idx"])
    smoothed = smooth(timed, ["title_id", "led_idx"], {
        "ar": ("tr", "r"), "ag": ("tg", "g"), "ab": ("tb", "b"), "aw": ("w", "w")}, tuning.tau)
    out = color.floor_and_blackout(F.col("ar"), F.col("ag"), F.col("ab"), tuning)
    return smoothed.withColumn("_o", out).select(
        "title_id", "frame_idx", "led_idx", F.col("_o.r").alias("r"), F.col("_o.g").alias("g"),
        F.col("_o.b").alias("b"), color.clamp_byte(F.col("aw")).alias("w"))
