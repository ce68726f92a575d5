"""Light zones: geometry and the exploded (one row per zone pixel) form of zone colours.

The exploded form defines the result and serves checks and small slices; libraries go through
``zone_kernel``, which needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rimlight.functions import color
from rimlight.model import MAX_ZONE_DEPTH_SHARE, MIN_ZONE_DEPTH, Layout

ZONE = ("title_id", "frame_idx", "led_idx")
# A zone map is bounded by the frame, not by the data; larger maps are joined by shuffle.
MAX_BROADCAST_ZONE_PIXELS = 2_000_000
# Pixels of the layouts that one task spreads out; a layout has no more zone pixels than four times its own.
PIXELS_PER_TASK = 100_000_000


def _depth(length: Column, count: Column, across: Column) -> Column:
    spacing = F.when(count > 0, length / count).otherwise(length.cast("double"))
    wanted = F.bround(spacing * 2.0, 0).cast("int")
    high = F.floor(across * F.lit(MAX_ZONE_DEPTH_SHARE)).cast("int")
    # the low bound is tested first, so it also wins over a smaller high bound
    return F.when(wanted < MIN_ZONE_DEPTH, F.lit(MIN_ZONE_DEPTH)).otherwise(F.least(wanted, high))


def zone_rects(layouts: DataFrame) -> DataFrame:
    """Ordered zone rectangles of every layout row (``layout_id, width, height, top, bottom, left, right``).

    Order: top left to right, right downwards, bottom right to left, left upwards.
    """
    w, h = F.col("width"), F.col("height")
    sides = F.array(*[
        F.struct(F.lit(no).alias("no"), F.lit(side).alias("side"), F.col(side).alias("n"))
        for no, side in enumerate(("top", "right", "bottom", "left"))
    ])
    i, n, side = F.col("i"), F.col("n"), F.col("side")
    before = {
        "top": F.lit(0),
        "right": F.col("top"),
        "bottom": F.col("top") + F.col("right"),
        "left": F.col("top") + F.col("right") + F.col("bottom"),
    }

    def pick(top: Column, right: Column, bottom: Column, left: Column) -> Column:
        return (F.when(side == "top", top).when(side == "right", right)
                .when(side == "bottom", bottom).otherwise(left)).cast("int")

    div = lambda a, b: F.call_function("div", a.cast("long"), b.cast("long"))
    top_d, bottom_d = _depth(w, F.col("top"), h), _depth(w, F.col("bottom"), h)
    left_d, right_d = _depth(h, F.col("left"), w), _depth(h, F.col("right"), w)
    zero = F.lit(0)
    return (
        layouts.withColumn("_s", F.explode(sides))
        .select("*", "_s.side", "_s.n").drop("_s")
        .where(n > 0)
        .withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))
        .select(
            "layout_id",
            (i + pick(*[before[s] for s in ("top", "right", "bottom", "left")])).alias("led_idx"),
            "side",
            pick(div(i * w, n), w - right_d, div((n - i - 1) * w, n), zero).alias("x1"),
            pick(zero, div(i * h, n), h - bottom_d, div((n - i - 1) * h, n)).alias("y1"),
            pick(div((i + 1) * w, n), w, div((n - i) * w, n), left_d).alias("x2"),
            pick(top_d, div((i + 1) * h, n), h, div((n - i) * h, n)).alias("y2"),
        )
    )


def dealt_layouts(layouts: DataFrame) -> DataFrame:
    """The layouts, dealt out by ``layout_id`` for work on all of their pixels: a few bytes a layout become up to millions of
    rows, so the number of tasks follows from the pixels and not from the size of the table."""
    pixels = layouts.agg(F.sum(F.col("width").cast("long") * F.col("height"))).first()[0] or 0
    tasks = max(layouts.sparkSession.sparkContext.defaultParallelism, -(-pixels // PIXELS_PER_TASK))
    return layouts.repartition(tasks, "layout_id")


def layout_frame(spark: SparkSession, layout: Layout, width: int, height: int) -> DataFrame:
    """One-row layout table."""
    return spark.range(1).select(
        F.lit(0).alias("layout_id"), F.lit(width).alias("width"), F.lit(height).alias("height"),
        *[F.lit(getattr(layout, s)).alias(s) for s in ("top", "bottom", "left", "right")])


def zone_table(layout: Layout, width: int, height: int) -> list[tuple[int, int, int, int]]:
    """Rectangles of one layout in light order, cut to the frame; used to set up tasks."""
    def depth(length: int, count: int, across: int) -> int:
        wanted = round(2 * (length / count if count else length))
        return MIN_ZONE_DEPTH if wanted < MIN_ZONE_DEPTH else min(wanted, int(across * MAX_ZONE_DEPTH_SHARE))

    def cuts(length: int, count: int) -> list[tuple[int, int]]:
        return [(i * length // count, (i + 1) * length // count) for i in range(count)]

    def cuts_back(length: int, count: int) -> list[tuple[int, int]]:
        return [((count - i - 1) * length // count, (count - i) * length // count)
                for i in range(count)]

    right = width - depth(height, layout.right, width)
    low = height - depth(width, layout.bottom, height)
    rects = [(a, 0, b, depth(width, layout.top, height)) for a, b in cuts(width, layout.top)]
    rects += [(right, a, width, b) for a, b in cuts(height, layout.right)]
    rects += [(a, low, b, height) for a, b in cuts_back(width, layout.bottom)]
    rects += [(0, a, depth(height, layout.left, width), b)
              for a, b in cuts_back(height, layout.left)]
    return [(max(x1, 0), max(y1, 0), min(x2, width), min(y2, height)) for x1, y1, x2, y2 in rects]


def zone_pixels(spark: SparkSession, layout: Layout, width: int, height: int) -> DataFrame:
    """Lookup (x, y) -> light; pixels in corners belong to several lights."""
    rects = zone_rects(layout_frame(spark, layout, width, height))
    inside = rects.select(
        "led_idx",
        F.greatest("x1", F.lit(0)).alias("x1"), F.greatest("y1", F.lit(0)).alias("y1"),
        F.least("x2", F.lit(width)).alias("x2"), F.least("y2", F.lit(height)).alias("y2"),
    ).where("x2 > x1 and y2 > y1")
    return (
        inside.withColumn("x", F.explode(F.expr("sequence(x1, x2 - 1)")))
        .withColumn("y", F.explode(F.expr("sequence(y1, y2 - 1)")))
        .select(
            "led_idx", "x", "y",
            (F.col("x") - F.col("x1")).alias("zx"), (F.col("y") - F.col("y1")).alias("zy"),
            (F.col("x2") - F.col("x1")).alias("zw"), (F.col("y2") - F.col("y1")).alias("zh"))
    )


def pixels_in_zones(pixels: DataFrame, layout: Layout, width: int, height: int) -> DataFrame:
    """Every pixel once per zone that contains it."""
    lookup = zone_pixels(pixels.sparkSession, layout, width, height)
    # zones of one side do not overlap each other, so four frames bound the map
    if 4 * width * height <= MAX_BROADCAST_ZONE_PIXELS:
        lookup = F.broadcast(lookup)
    return pixels.join(lookup, ["x", "y"])


def sobel(zoned: DataFrame) -> DataFrame:
    """Add ``gx``, ``gy``, ``edge`` from a 3x3 Sobel filter whose neighbours stay inside the zone.

    The filter is separable: one pass along x, one along y. All windows and the aggregate
    that follows share one exchange on (title, frame, light).
    """
    along_x = Window.partitionBy(*ZONE, "y").orderBy("x")
    along_y = Window.partitionBy(*ZONE, "x").orderBy("y")
    one = lambda f, c, w: F.coalesce(f(c).over(w), F.col(c))
    grey = color.grey(F.col("r"), F.col("g"), F.col("b"))
    step1 = (
        zoned.repartition(*ZONE)
        .withColumn("grey", grey)
        .withColumns({"_l": one(F.lag, "grey", along_x), "_r": one(F.lead, "grey", along_x)})
        .withColumns({
            "_dx": F.col("_r") - F.col("_l"),
            "_sx": F.col("_l") + 2 * F.col("grey") + F.col("_r"),
        })
    )
    step2 = step1.withColumns({
        "gx": one(F.lag, "_dx", along_y) + 2 * F.col("_dx") + one(F.lead, "_dx", along_y),
        "gy": one(F.lead, "_sx", along_y) - one(F.lag, "_sx", along_y),
    })
    return step2.withColumn("edge", color.edge_magnitude(F.col("gx"), F.col("gy"))).drop(
        "_l", "_r", "_dx", "_sx")


def edge_norm(edges: DataFrame) -> DataFrame:
    """Add ``edge_n``: the magnitude relative to the strongest edge of the zone."""
    strongest = F.max("edge").over(Window.partitionBy(*ZONE))
    return edges.withColumn(
        "edge_n", F.when(strongest > 0, F.col("edge") / strongest).otherwise(F.col("edge")))


def weighted(edges: DataFrame) -> DataFrame:
    """Add ``weight`` of every zone pixel."""
    centre = color.center_weight(F.col("zx"), F.col("zy"), F.col("zw"), F.col("zh"))
    return edges.withColumn("weight", color.pixel_weight(F.col("edge_n"), centre))


def zone_means(pixels: DataFrame) -> DataFrame:
    """Weighted mean colour per zone; the truncated plain mean where all weights are 0."""
    total = F.sum("weight")

    def mean(c: str) -> Column:
        return (
            F.when(total > 0, color.clamp_byte(F.sum(F.col("weight") * F.col(c)) / total))
            .otherwise(F.floor(F.avg(c)).cast("int"))
            .alias(c)
        )

    return pixels.groupBy(*ZONE).agg(*[mean(c) for c in "rgb"])


def zone_colors(pixels: DataFrame, layout: Layout, width: int, height: int) -> DataFrame:
    """Edge-dominant colour of every light of every frame; lights without pixels are black."""
    means = zone_means(weighted(edge_norm(sobel(pixels_in_zones(pixels, layout, width, height)))))
    empty = [led for led, (x1, y1, x2, y2) in enumerate(zone_table(layout, width, height))
             if x2 <= x1 or y2 <= y1]
    if not empty:
        return means
    black = (
        pixels.select("title_id", "frame_idx").distinct()
        .withColumn("led_idx", F.explode(F.array(*[F.lit(led) for led in empty])))
        .select(*ZONE, *[F.lit(0).alias(c) for c in "rgb"])
    )
    return means.unionByName(black)
