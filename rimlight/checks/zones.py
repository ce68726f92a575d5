"""Zone geometry and zone colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimlight.checks.registry import check
from rimlight.checks.sql import rects, zone_pixels, zone_weights
from rimlight.functions import color
from rimlight.model import FRAME_HEIGHT, FRAME_WIDTH
from rimlight.operators import zones as Z
from rimlight.operators.zone_kernel import frame_zone_colors
from rimlight.plans.extraction import extract_lights
from rimlight.sources import derived as D

_LAYOUTS = """
layouts as (select s_suppkey as layout_id, cast(s_suppkey * 16 % 640 + 16 as int) as width,
                   cast(s_suppkey * 9 % 360 + 9 as int) as height, cast(s_suppkey * 7 % 97 as int) as "top",
                   cast(s_suppkey * 11 % 89 + 1 as int) as bottom, cast(s_suppkey * 3 % 53 as int) as "left",
                   cast(s_suppkey * 5 % 49 as int) as "right" from supplier),"""

_SMALL_W = zone_weights(D.SMALL_WIDTH, D.SMALL_HEIGHT)


@check(f"with {_LAYOUTS} {rects('layouts')} select layout_id, led_idx, side, x1, y1, x2, y2 from rects")
def zone_rects(spark, sf):
    return Z.zone_rects(D.layouts(spark, sf))


def _zoned(spark, sf):
    return Z.pixels_in_zones(D.pixels(spark, sf), D.STRIP, D.SMALL_WIDTH, D.SMALL_HEIGHT)


@check(f"""with {zone_pixels(D.SMALL_WIDTH, D.SMALL_HEIGHT)} select title_id, frame_idx, led_idx, count(*) as pixels,
       cast(sum((x + 100 * y) * (r + 3 * g + 7 * b)) as bigint) as content from zp group by all""")
def pixels_in_zones(spark, sf):
    return _zoned(spark, sf).groupBy(*Z.ZONE).agg(
        F.count(F.lit(1)).alias("pixels"),
        F.sum((F.col("x") + 100 * F.col("y")) * (F.col("r") + 3 * F.col("g") + 7 * F.col("b"))).alias("content"))


@check(f"""with {zone_pixels(D.SMALL_WIDTH, D.SMALL_HEIGHT)} select title_id, frame_idx, led_idx,
       round(sum(grey), 3) as grey from zp group by all""")
def grey(spark, sf):
    value = color.grey(F.col("r"), F.col("g"), F.col("b"))
    return _zoned(spark, sf).groupBy(*Z.ZONE).agg(F.round(F.sum(value), 3).alias("grey"))


@check(f"""with {_SMALL_W} select title_id, frame_idx, led_idx, round(sum(gx * (x + 1)), 2) as gx, round(sum(gy * (y + 1)), 2) as gy,
       round(max(edge), 5) as strongest from zw group by all""")
def sobel(spark, sf):
    return Z.sobel(_zoned(spark, sf)).groupBy(*Z.ZONE).agg(
        F.round(F.sum(F.col("gx") * (F.col("x") + 1)), 2).alias("gx"),
        F.round(F.sum(F.col("gy") * (F.col("y") + 1)), 2).alias("gy"), F.round(F.max("edge"), 5).alias("strongest"))


@check(f"""with {_SMALL_W} select title_id, frame_idx, led_idx, round(sum(edge * (x + y)), 5) as edge from zw group by all""")
def edge_magnitude(spark, sf):
    edges = Z.sobel(_zoned(spark, sf))
    value = color.edge_magnitude(F.col("gx"), F.col("gy")) * (F.col("x") + F.col("y"))
    return edges.groupBy(*Z.ZONE).agg(F.round(F.sum(value), 5).alias("edge"))


@check(f"""with {_SMALL_W} select title_id, frame_idx, led_idx, round(sum(edge_n * (x + y)), 5) as edge_n,
       round(max(edge_n), 9) as top from zw group by all""")
def edge_norm(spark, sf):
    return Z.edge_norm(Z.sobel(_zoned(spark, sf))).groupBy(*Z.ZONE).agg(
        F.round(F.sum(F.col("edge_n") * (F.col("x") + F.col("y"))), 5).alias("edge_n"),
        F.round(F.max("edge_n"), 9).alias("top"))


@check(f"""with {_LAYOUTS} {rects('layouts')}, z as (select layout_id, led_idx, x2 - x1 as w, y2 - y1 as h from rects
         where x2 > x1 and y2 > y1), row as (select *, unnest(range(h)) as y from z), p as (select *, unnest(range(w)) as x from row),
       c as (select *, exp(-(power(x - w // 2, 2) + power(y - h // 2, 2)) /
         (2.0::double * power(greatest(least(w, h) / 4.0::double, 1.0::double), 2))) as weight from p)
       select layout_id, led_idx, count(*) as pixels, round(sum(weight * (x + 2 * y + 1)), 4) as weight, round(min(weight), 9) as low from c group by all""")
def center_weight(spark, sf):
    """Weights of all pixels of every zone of every layout, summed up with their places."""
    z = Z.zone_rects(Z.dealt_layouts(D.layouts(spark, sf))).where("x2 > x1 and y2 > y1").select(
        "layout_id", "led_idx", (F.col("x2") - F.col("x1")).alias("w"), (F.col("y2") - F.col("y1")).alias("h"))
    p = z.withColumn("y", F.explode(F.expr("sequence(0, h - 1)"))).withColumn("x", F.explode(F.expr("sequence(0, w - 1)")))
    weight = color.center_weight(F.col("x"), F.col("y"), F.col("w"), F.col("h"))
    return p.groupBy("layout_id", "led_idx").agg(
        F.count(F.lit(1)).alias("pixels"), F.round(F.sum(weight * (F.col("x") + 2 * F.col("y") + 1)), 4).alias("weight"), F.round(F.min(weight), 9).alias("low"))


@check(f"""with {_SMALL_W} select title_id, frame_idx, led_idx, round(sum(weight * (x + y)), 5) as weight,
       round(min(weight), 9) as low from zww group by all""")
def pixel_weight(spark, sf):
    return Z.weighted(Z.edge_norm(Z.sobel(_zoned(spark, sf)))).groupBy(*Z.ZONE).agg(
        F.round(F.sum(F.col("weight") * (F.col("x") + F.col("y"))), 5).alias("weight"),
        F.round(F.min("weight"), 9).alias("low"))


@check(f"with {_SMALL_W} select title_id, frame_idx, led_idx, r, g, b from zc")
def zone_colors(spark, sf):
    return Z.zone_colors(D.pixels(spark, sf), D.STRIP, D.SMALL_WIDTH, D.SMALL_HEIGHT)


@check(f"""with {zone_pixels(D.SMALL_WIDTH, D.SMALL_HEIGHT)} select title_id, frame_idx, led_idx, cast(floor(avg(r)) as int) as r,
       cast(floor(avg(g)) as int) as g, cast(floor(avg(b)) as int) as b from zp group by all""")
def zone_mean_fallback(spark, sf):
    """All weights 0: the truncated plain mean takes over."""
    return Z.zone_means(_zoned(spark, sf).withColumn("weight", F.lit(0.0)))


@check(f"""with {_SMALL_W} select title_id, frame_idx, led_idx, r - least(r, g, b) as r, g - least(r, g, b) as g,
       b - least(r, g, b) as b, least(r, g, b) as w from zc""")
def white_extract(spark, sf):
    colors = Z.zone_colors(D.pixels(spark, sf), D.STRIP, D.SMALL_WIDTH, D.SMALL_HEIGHT)
    return colors.select(*Z.ZONE, color.white_extract(F.col("r"), F.col("g"), F.col("b")).alias("c")).select(*Z.ZONE, "c.*")


_KERNEL = """ select title_id, frame_idx, string_agg(printf('%02X%02X%02X%02X', r - least(r, g, b), g - least(r, g, b),
       b - least(r, g, b), least(r, g, b)), '' order by led_idx) as payload_hex from zc"""


@check(f"with {zone_weights(FRAME_WIDTH, FRAME_HEIGHT)} {_KERNEL} group by all", name="frame_zone_colors")
def _frame_zone_colors(spark, sf):
    """Whole frames at working size."""
    return frame_zone_colors(D.frames(spark, sf), D.STRIP).select(
        "title_id", "frame_idx", F.hex("payload").alias("payload_hex"))


@check(f"""with {_SMALL_W}
       {_KERNEL} where title_id % 3 <> 0 group by all""", name="extract_lights")
def _extract_lights(spark, sf):
    """Every third title is taken as done already."""
    frames = D.frames(spark, sf, D.SMALL_WIDTH, D.SMALL_HEIGHT)
    pending = D.led_frames(spark, sf).where("title_id % 3 <> 0").select("title_id").distinct()
    return extract_lights(frames, pending, D.STRIP, D.SMALL_WIDTH, D.SMALL_HEIGHT).select(
        "title_id", "frame_idx", F.hex("payload").alias("payload_hex"))


