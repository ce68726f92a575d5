"""Order statistics of weighted values without gathering a key: selection digit by digit."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimlight.session import checkpointed

#: Bits decided in a round: no task sees more than 2^16 counts of one key and rank.
DIGIT_BITS = 16


def select_ranks(counts: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame) -> DataFrame:
    """``ranks`` (``keys, rank``, distinct) with the column ``value``: the value at that 1-based rank of its key.

    ``counts`` has ``keys``, a whole-number ``value`` and its number ``n``; it should be stored. From the high
    digits down, values are counted per digit below the digits found so far, and the digit in whose counts the rank falls
    is kept with the rank inside it. Counts are combined before they are exchanged, and what meets in a window is one
    row per digit, however many different values a key has.
    """
    keys = list(keys)
    # the digits so far are the value without its lower bits; before the first round nothing is known
    found = ranks.select(*keys, "rank", F.col("rank").alias("_left"), F.lit(0).cast("long").alias("_digits"))
    for shift in range(64 - DIGIT_BITS, -1, -DIGIT_BITS):
        digits = F.shiftright(F.col(value).cast("long"), shift)
        above = F.lit(0).cast("long") if shift == 64 - DIGIT_BITS else F.shiftright(digits, DIGIT_BITS)
        per_digit = counts.select(*keys, digits.alias("_digit"), above.alias("_digits"), "n").join(found, [*keys, "_digits"]).groupBy(
            *keys, "rank", "_left", "_digit").agg(F.sum("n").alias("_n"))
        upto = Window.partitionBy(*keys, "rank").orderBy("_digit").rowsBetween(Window.unboundedPreceding, 0)
        hit = per_digit.withColumn("_to", F.sum("_n").over(upto)).where("_left > _to - _n and _left <= _to")
        found = checkpointed(hit.select(*keys, "rank", (F.col("_left") - F.col("_to") + F.col("_n")).alias("_left"), F.col("_digit").alias("_digits")))
    return found.select(*keys, "rank", F.col("_digits").alias(value))
