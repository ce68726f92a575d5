"""Frame clocks, luminance, tone, smoothing, packing."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimlight.checks.registry import check
from rimlight.checks.sql import FRAMES, SAMPLES, TIMED, finished, tuned
from rimlight.functions import color, media, packed
from rimlight.model import Tuning
from rimlight.operators import timeline as TL
from rimlight.operators import tone
from rimlight.operators.display_kernel import smooth_frames as run_kernel
from rimlight.session import fresh_folder
from rimlight.sources import derived as D
from rimlight.sources import indexed

# floor, boosts and channel gammas all at work
STRONG = Tuning(smooth_s=0.25, gamma=2.6, saturation=1.7, brightness_target=80.0, gamma_red=1.2, gamma_green=0.9,
                gamma_blue=1.1, red_boost=2.0, green_boost=1.0, blue_boost=1.5, min_led_brightness=20.0)
VIVID = Tuning(saturation=3.0)


# ---- clocks ---------------------------------------------------------------------------------

@check(f"with {FRAMES} select title_id, frame_idx, vec_id, cast(floor(frame_idx * 1e6 / cast(cast(23.976 as float) as double)) as bigint) as ts_us from v")
def frame_index(spark, sf):
    vectors = D.table(spark, sf, "embeddings").select(F.col("label").alias("title_id"), "vec_id")
    return TL.frame_index(vectors, "vec_id", F.lit(23.976))


@check(f"with {TIMED} select title_id, round(rate, 9) as fps from rates")
def infer_fps(spark, sf):
    return TL.infer_fps(D.led_titles(spark, sf), D.led_frames(spark, sf)).withColumn("fps", F.round("fps", 9))


def timed_frames(spark, sf):
    frames = D.led_frames(spark, sf)
    return TL.frame_clock(frames, TL.infer_fps(D.led_titles(spark, sf), frames))


@check(f"with {TIMED} select title_id, frame_idx, round(dt_s, 9) as dt_s from timed")
def frame_dt(spark, sf):
    frames = D.led_frames(spark, sf)
    timed = TL.frame_dt(frames, TL.infer_fps(D.led_titles(spark, sf), frames))
    return timed.select("title_id", "frame_idx", F.round("dt_s", 9).alias("dt_s"))


@check(f"""with {TIMED} select title_id, frame_idx, round(sum(dt_s) over (partition by title_id order by frame_idx), 8) as clock_s
       from timed""")
def frame_clock(spark, sf):
    return timed_frames(spark, sf).select("title_id", "frame_idx", F.round("clock_s", 8).alias("clock_s"))


@check("""select event_id, cast(floor(coalesce(case when event_id % 10 <> 0 then value * 10 end, 60) *
       coalesce(case when event_id % 7 <> 0 then cast(cast(23.976 as float) as double) end, 24)) as bigint) as frames from events""")
def estimate_frames(spark, sf):
    k = F.col("event_id")
    return D.table(spark, sf, "events").select("event_id", media.estimate_frames(
        F.when(k % 10 != 0, F.col("value") * 10),
        F.when(k % 7 != 0, F.lit(23.976).cast("float").cast("double"))).alias("frames"))


_RATE_TEXT = """case event_id % 8 when 0 then '24000/1001' when 1 then concat(event_id % 400, '/', user_id % 5) when 2 then 'abc'
       when 3 then '25' when 4 then ' 60000/1001 ' when 5 then '500/1' when 6 then concat(event_id, '/1001') else '-30/1' end"""


@check(f"""with t as (select event_id, string_split(trim({_RATE_TEXT}), '/') as a from events),
       n as (select event_id, len(a) as parts, try_cast(a[1] as int) as num, try_cast(a[2] as int) as den from t),
       f as (select *, cast(num as float) / cast(nullif(den, 0) as float) as fps from n)
       select event_id, round(case when parts = 2 and den > 0 and fps > 0 and fps < 200 then cast(cast(fps as float) as double)
              else 24.0 end, 9) as fps from f""")
def parse_fps(spark, sf):
    k = F.col("event_id")
    text = (F.when(k % 8 == 0, "24000/1001").when(k % 8 == 1, F.concat_ws("/", (k % 400).cast("string"), (F.col("user_id") % 5).cast("string")))
            .when(k % 8 == 2, "abc").when(k % 8 == 3, "25").when(k % 8 == 4, " 60000/1001 ").when(k % 8 == 5, "500/1")
            .when(k % 8 == 6, F.concat(k.cast("string"), F.lit("/1001"))).otherwise("-30/1"))
    return D.table(spark, sf, "events").select("event_id", F.round(media.parse_fps(text), 9).alias("fps"))


@check("select event_id, coalesce(case when event_id % 11 <> 0 then event_id * 1234567 end, 0) / 1e7 as seconds from events")
def ticks_to_seconds(spark, sf):
    k = F.col("event_id")
    return D.table(spark, sf, "events").select(
        "event_id", media.ticks_to_seconds(F.when(k % 11 != 0, k * 1234567)).alias("seconds"))


@check("""select l_orderkey, l_linenumber, cast(l_quantity as bigint) as current, l_linenumber * 10 % 60 as total,
       case when l_linenumber * 10 % 60 > 0 then least(99, cast(l_quantity as bigint) * 100 // (l_linenumber * 10 % 60)) else 0 end as pct
       from lineitem""")
def progress_pct(spark, sf):
    cur, tot = F.col("l_quantity").cast("long"), F.col("l_linenumber") * 10 % 60
    return D.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", cur.alias("current"), tot.alias("total"), media.progress_pct(cur, tot).alias("pct"))


@check("select event_id, cast(floor(greatest(0.0, value - 100 + 0.2::double) * 1000000) as bigint) as start_us, "
       "cast(floor(greatest(0.0, value - 100) * 1000000) as bigint) as seek_us from events")
def start_target_us(spark, sf):
    at = F.col("value") - 100
    return D.table(spark, sf, "events").select(
        "event_id", media.start_target_us(at, 0.2).alias("start_us"), media.seek_target_us(at).alias("seek_us"))


@check(f"""with {FRAMES} select title_id, frame_idx, greatest(0, ts_us - 500000) as send_at_us from vt""")
def send_at_us(spark, sf):
    return D.led_frames(spark, sf).select(
        "title_id", "frame_idx", media.send_at_us(F.col("ts_us"), F.lit(500_000)).alias("send_at_us"))


@check("select doc_id, round(n_chars / 1024.0::double / 1024.0::double, 12) as mb from documents")
def bytes_to_mb(spark, sf):
    return D.table(spark, sf, "documents").select("doc_id", F.round(media.bytes_to_mb(F.col("n_chars")), 12).alias("mb"))


@check("select s_suppkey, case when s_suppkey % 5 - 2 > 0 then s_suppkey % 5 - 2 else greatest(1, s_suppkey % 3) end as leds from supplier")
def target_counts(spark, sf):
    k = F.col("s_suppkey")
    return D.table(spark, sf, "supplier").select("s_suppkey", media.target_count(k % 5 - 2, k % 3).alias("leds"))


@check(f"""with {FRAMES}, n as (select *, count(*) over (partition by title_id) as all_frames from v)
       select title_id, frame_idx + 1 as frames_done, false as is_final from n where (frame_idx + 1) % 20 = 0
       union all select title_id, max(all_frames), true from n group by title_id""")
def progress_samples(spark, sf):
    return TL.progress_samples(D.led_frames(spark, sf), every=20)


@check(f"""with {FRAMES} select title_id, frame_idx from v where frame_idx % 10 <> 9""")
def complete_payloads(spark, sf):
    """Every tenth frame is cut short."""
    cut = D.led_frames(spark, sf).withColumn("payload", F.when(
        F.col("frame_idx") % 10 == 9, F.substring("payload", 1, 60)).otherwise(F.col("payload")))
    return TL.complete_payloads(cut, D.led_titles(spark, sf)).select("title_id", "frame_idx")


_SEEKS = f"""with {FRAMES}, l as (select event_id, cast(user_id % 10 as int) as title_id, cast(floor(value * 1e4) as bigint) as target_us from events),
       w as (select distinct title_id, target_us from l),
       ends as (select title_id, max(frame_idx) as last from v group by title_id),
       hit as (select w.title_id, w.target_us, min(t.frame_idx) as frame_idx
               from w left join vt t on t.title_id = w.title_id and t.ts_us >= w.target_us group by all)
       select event_id, l.title_id, l.target_us, coalesce(hit.frame_idx, last) as frame_idx
       from l join hit using (title_id, target_us) join ends on ends.title_id = l.title_id"""


def _lookups(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id", (F.col("user_id") % 10).cast("int").alias("title_id"),
        F.floor(F.col("value") * 1e4).cast("long").alias("target_us"))


@check(_SEEKS)
def seek_frame(spark, sf):
    # short buckets, so that answers lie in the same, a later or no bucket
    return TL.seek_frame(D.led_frames(spark, sf), _lookups(spark, sf), bucket_us=100_000)


@check(_SEEKS)
def seek_indexed(spark, sf):
    """The same through a stored seek index; frames are read only of intervals that a position falls into."""
    path = fresh_folder(spark, "indexed")
    indexed.write_indexed_frames(D.led_frames(spark, sf), path, every_us=100_000)
    return indexed.seek_indexed(spark, path, _lookups(spark, sf))


# ---- tone -----------------------------------------------------------------------------------

@check(f"with {TIMED} select title_id, frame_idx, round(lum, 9) as lum from lums")
def frame_luminance(spark, sf):
    return TL.frame_luminance(D.led_samples(spark, sf)).withColumn("lum", F.round("lum", 9))


@check(f"with {TIMED} select title_id, frame_idx, round(lum, 9) as lum from lums")
def payload_luminance(spark, sf):
    """The same on packed frames."""
    return D.led_frames(spark, sf).select(
        "title_id", "frame_idx", F.round(packed.payload_luminance("payload", F.lit(4)), 9).alias("lum"))


_WILD = "case when event_id % 13 = 0 then cast('nan' as double) else value - 50 end"


@check(f"""select event_id, case when isnan({_WILD}) then 0.0 else greatest(0.0, least(100.0, {_WILD})) end as v from events""")
def clampf(spark, sf):
    wild = F.when(F.col("event_id") % 13 == 0, F.lit(float("nan"))).otherwise(F.col("value") - 50)
    return D.table(spark, sf, "events").select("event_id", color.clampf(wild, 0.0, 100.0).alias("v"))


@check("select event_id, round(greatest(1.0, least(3.0, 2.2::double * (1.0 - value / 255.0::double * 0.6::double))), 9) as gamma from events")
def adaptive_gamma(spark, sf):
    return D.table(spark, sf, "events").select("event_id", F.round(color.adaptive_gamma(F.col("value"), 2.2), 9).alias("gamma"))


@check("""select event_id, round(case when value > 1 then greatest(0.05, least(2.5, 60.0::double / value * 0.7::double + 0.3::double))
       else 1.0 end, 9) as factor from events""")
def brightness_factor(spark, sf):
    return D.table(spark, sf, "events").select(
        "event_id", F.round(color.brightness_factor(F.col("value"), 60.0), 9).alias("factor"))


def _tuned_check(name: str, tuning: Tuning) -> None:
    sql = f"""with {TIMED}, s as (select * from led_samples join lums using (title_id, frame_idx)),
        t as (select title_id, frame_idx, led_idx, {tuned(tuning)} from s)
        select title_id, frame_idx, led_idx, round(tr, 6) as tr, round(tg, 6) as tg, round(tb, 6) as tb from t"""

    def query(spark, sf):
        return tone.tune(D.led_samples(spark, sf), tuning).select(
            "title_id", "frame_idx", "led_idx", *[F.round(c, 6).alias(c) for c in ("tr", "tg", "tb")])

    check(sql, name)(query)


_tuned_check("tune_color", Tuning())
_tuned_check("tune_color_vivid", VIVID)


@check(f"""with {SAMPLES}, a as (select title_id, frame_idx, led_idx, r * 0.9::double as ar, g * 0.3::double as ag, b * 0.7::double as ab,
       w * 0.5::double as aw from led_samples) select title_id, frame_idx, led_idx, {finished(STRONG)} from a""")
def floor_and_blackout(spark, sf):
    s = D.led_samples(spark, sf)
    out = color.floor_and_blackout(F.col("r") * 0.9, F.col("g") * 0.3, F.col("b") * 0.7, STRONG)
    return s.select("title_id", "frame_idx", "led_idx", out.alias("o"),
                    color.clamp_byte(F.col("w") * 0.5).alias("w")).select("title_id", "frame_idx", "led_idx", "o.*", "w")


@check(f"""with {SAMPLES}, tg as (select s_suppkey as target_id, cast(s_suppkey % 10 as int) as title_id, s_suppkey % 40 as n from supplier),
       lights as (select *, unnest(range(n)) as tgt_led from tg)
       select target_id, frame_idx, tgt_led, l.title_id, led_idx, r, g, b, w from lights l
       join led_samples s on s.title_id = l.title_id and s.led_idx = l.tgt_led * 16 // l.n""")
def resample_leds(spark, sf):
    targets = D.table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("target_id"), (F.col("s_suppkey") % 10).cast("int").alias("title_id"),
        F.lit(16).alias("total_src"), (F.col("s_suppkey") % 40).cast("int").alias("total_tgt"))
    return tone.resample_leds(D.led_samples(spark, sf).drop("ts_us"), targets)


def ema(tuning: Tuning) -> str:
    """CTEs up to ``ema``: the recurrence, one step per frame."""
    k = f"1.0::double - exp(-dt_s / {tuning.tau}::double)" if tuning.tau > 0 else "1.0::double"
    return f"""{TIMED},
s as (select * from led_samples join lums using (title_id, frame_idx) join timed using (title_id, frame_idx)),
t as materialized (select title_id, frame_idx, led_idx, r, g, b, w, {k} as k, {tuned(tuning)} from s),
ema as (
  select title_id, frame_idx, led_idx, r * (1 - k) + tr * k as ar, g * (1 - k) + tg * k as ag, b * (1 - k) + tb * k as ab,
         w * 1.0::double as aw from t where frame_idx = 0
  union all
  select t.title_id, t.frame_idx, t.led_idx, ar * (1 - k) + tr * k, ag * (1 - k) + tg * k, ab * (1 - k) + tb * k, aw * (1 - k) + w * k
  from ema e join t on t.title_id = e.title_id and t.led_idx = e.led_idx and t.frame_idx = e.frame_idx + 1)"""


@check(f"with recursive {ema(Tuning())} select title_id, frame_idx, led_idx, round(ar, 5) as ar, round(ag, 5) as ag, "
       "round(ab, 5) as ab, round(aw, 5) as aw from ema")
def smooth(spark, sf):
    tuning = Tuning()
    clock = timed_frames(spark, sf).select("title_id", "frame_idx", "dt_s", "clock_s")
    rows = tone.tune(D.led_samples(spark, sf), tuning).join(clock, ["title_id", "frame_idx"])
    out = tone.smooth(rows, ["title_id", "led_idx"], {
        "ar": ("tr", "r"), "ag": ("tg", "g"), "ab": ("tb", "b"), "aw": ("w", "w")}, tuning.tau)
    return out.select("title_id", "frame_idx", "led_idx", *[F.round(c, 5).alias(c) for c in ("ar", "ag", "ab", "aw")])


@check(f"with recursive {ema(STRONG)} select title_id, frame_idx, led_idx, {finished(STRONG)} from ema")
def display_samples(spark, sf):
    clock = timed_frames(spark, sf)
    return tone.display_samples(D.led_samples(spark, sf), clock, STRONG)


@check(f"""with recursive {ema(STRONG)}, o as (select title_id, frame_idx, led_idx, {finished(STRONG)} from ema)
       select title_id, frame_idx, string_agg(printf('%02X%02X%02X%02X', r, g, b, w), '' order by (led_idx - 3 + 16) % 16) as payload_hex
       from o group by all""")
def smooth_frames(spark, sf):
    """The packed kernel, with chunks of eight frames; the strip is turned by three lights."""
    frames = timed_frames(spark, sf).withColumns(
        {"channels": F.lit(4), "total_tgt": F.lit(16), "turn": F.lit(3)})
    return run_kernel(frames, ["title_id"], STRONG, chunk_frames=8).select(
        "title_id", "frame_idx", F.hex("payload").alias("payload_hex"))


# ---- packing --------------------------------------------------------------------------------

@check(f"with {SAMPLES} select title_id, frame_idx, payload_hex from led_frames")
def pack_leds(spark, sf):
    return D.led_frames(spark, sf).select("title_id", "frame_idx", F.hex("payload").alias("payload_hex"))


@check(f"""with {SAMPLES} select title_id, frame_idx, led_idx, r, g, b, w from led_samples""")
def unpack_leds(spark, sf):
    bytes_ = D.led_frames(spark, sf).select("title_id", "frame_idx", packed.unpack_bytes(F.col("payload")).alias("v"))
    lights = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.struct(
        i.alias("led_idx"), *[F.get(F.col("v"), i * 4 + n).alias(c) for n, c in enumerate("rgbw")]))
    return bytes_.select("title_id", "frame_idx", F.explode(lights).alias("l")).select("title_id", "frame_idx", "l.*")


@check(f"""with {SAMPLES} select title_id, frame_idx,
       string_agg(printf('%02X%02X%02X%02X', r, g, b, w), '' order by (led_idx - abs(title_id - 5) % 16 + 16) % 16) as payload_hex
       from led_samples group by all""")
def rotate_leds(spark, sf):
    turn = packed.rotation(F.col("title_id") - 5, F.lit(16))
    return D.led_frames(spark, sf).select(
        "title_id", "frame_idx", F.hex(packed.rotate_payload(F.col("payload"), turn, 4)).alias("payload_hex"))
