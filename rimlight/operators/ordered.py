"""Ordered per-key computations that do not put a whole key into one task.

A title or session may hold a large share of all rows, so a window over the key alone would
sort that share in a single task. ``with_carry`` works on two levels instead: rows are windowed
inside (key, chunk), one summary row per chunk is carried across the chunks of the key, and the
two are joined on (key, chunk). The chunk column must not decrease along the order. Frames use
``frame_idx div FRAME_CHUNK``, a hard bound on rows per chunk. Events are split by spans of time, so the
summary of a key is bounded by the time the data covers.

The chunk column stays in the result: a following call with the same chunk finds its rows
already partitioned.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimlight.session import checkpointed

FRAME_CHUNK = 4096
EVENT_CHUNK_US = 60_000_000
_PARTITION_BITS = 33  # monotonically_increasing_id has the partition above these bits
CHUNK = "chunk"


def frame_chunk(order: str = "frame_idx", size: int = FRAME_CHUNK) -> Column:
    return F.floor(F.col(order) / F.lit(size)).cast("long")


def event_chunk(ts: str = "ts", width_us: int = EVENT_CHUNK_US) -> Column:
    """Chunk of an event: its span of time, for every key alike."""
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(width_us)).cast("long")


def with_carry(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    previous: Mapping[str, Column] | None = None,
    last_before: Mapping[str, Column] | None = None,
    sums: Mapping[str, Column] | None = None,
    maxima: Mapping[str, Column] | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Add columns that depend on earlier rows of the same key; ``df`` has a ``chunk`` column.

    ``previous``: value of the row before. ``last_before``: last non-null value strictly before
    the row. ``sums`` and ``maxima``: running sum and maximum, the row included. ``per_key``: at most one row per key, whose
    other columns ride along with the carries (null for unknown keys). That spares the rows an
    exchange by the key alone.
    """
    previous, last_before, sums, maxima = previous or {}, last_before or {}, sums or {}, maxima or {}
    position = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    inputs = {**previous, **last_before, **sums, **maxima}
    df = df.withColumns({f"_v_{n}": e for n, e in inputs.items()})

    def summary_of(name: str) -> Column:
        value = F.col(f"_v_{name}")
        if name in previous:
            return F.max_by(value, position)
        if name in last_before:
            return F.max_by(value, F.when(value.isNotNull(), position))
        return F.max(value) if name in maxima else F.sum(value)

    across = Window.partitionBy(*keys).orderBy(CHUNK)
    earlier = across.rowsBetween(Window.unboundedPreceding, -1)

    def carry_of(name: str) -> Column:
        value = F.col(f"_s_{name}")
        if name in previous:
            return F.lag(value).over(across)
        if name in last_before:
            return F.last(value, ignorenulls=True).over(earlier)
        return (F.max(value) if name in maxima else F.sum(value)).over(earlier)

    summary = df.groupBy(*keys, CHUNK).agg(*[summary_of(n).alias(f"_s_{n}") for n in inputs])
    carries = summary.select(*keys, CHUNK, *[carry_of(n).alias(f"_c_{n}") for n in inputs])

    if per_key is not None:
        carries = carries.join(per_key, list(keys), "left")

    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    before = inside.rowsBetween(Window.unboundedPreceding, -1)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def within(name: str) -> Column:
        value = F.col(f"_v_{name}")
        if name in previous:
            return F.lag(value).over(inside)
        if name in last_before:
            return F.last(value, ignorenulls=True).over(before)
        return (F.max(value) if name in maxima else F.sum(value)).over(upto)

    def result_of(name: str) -> Column:
        value, carry = F.col(f"_w_{name}"), F.col(f"_c_{name}")
        if name in previous:
            return F.when(F.col("_no") == 1, carry).otherwise(value)
        if name in last_before:
            return F.coalesce(value, carry)
        if name in maxima:
            return F.greatest(value, carry)
        return F.coalesce(carry, F.lit(0).cast(df.schema[f"_v_{name}"].dataType)) + value

    # windows come first: their sort also serves the join that follows
    windowed = df.withColumns({"_no": F.row_number().over(inside), **{f"_w_{n}": within(n) for n in inputs}})
    out = windowed.join(carries, [*keys, CHUNK], "left").withColumns({n: result_of(n) for n in inputs})
    return out.drop("_no", *[f"_{part}_{n}" for n in inputs for part in "vwc"])


def with_row_index(
    df: DataFrame, keys: Sequence[str], order: str, name: str = "frame_idx",
) -> DataFrame:
    """Add the 0-based ordinal of every row of its key along a unique column, however sparse it is.

    Rows are dealt out by ranges of (key, order), sorted and stored with their number in their partition. A key's rows
    are consecutive there, so its count per partition gives the offsets to add: one small row per key and partition.
    """
    sort = [*keys, order]
    numbered = checkpointed(df.repartitionByRange(*sort).sortWithinPartitions(*sort).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_at"), _PARTITION_BITS).alias("_part")
    runs = numbered.groupBy(*keys, part).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_part").alias("_p"),
                          (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_from")).alias("_add"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    joined = numbered.withColumn("_part", part).join(offsets, [F.col("_part") == F.col("_p"), *same])
    return joined.withColumn(name, F.col("_at") + F.col("_add")).select(*df.columns, name)
