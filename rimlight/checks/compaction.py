"""Runs, deltas, cuts, chunks, indexes and checksums."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimlight.checks.registry import check
from rimlight.checks.sql import FRAMES, SAMPLES, TIMED
from rimlight.functions import packed
from rimlight.operators import compaction as C
from rimlight.sources import derived as D

_DELTAS = f"""{SAMPLES},
diffs as (select a.title_id, a.frame_idx, sum(abs(a.r - b.r) + abs(a.g - b.g) + abs(a.b - b.b) + abs(a.w - b.w)) / (64 * 255.0::double) as delta
          from led_samples a join led_samples b on a.title_id = b.title_id and a.led_idx = b.led_idx and a.frame_idx = b.frame_idx + 1 group by all),
d as (select vt.title_id, vt.frame_idx, vt.ts_us, delta from vt left join diffs using (title_id, frame_idx))"""


@check(f"with {_DELTAS} select title_id, frame_idx, ts_us, round(coalesce(delta, 0), 9) as delta, coalesce(delta, 0) > 0.14 as is_cut from d")
def scene_cuts(spark, sf):
    return C.scene_cuts(D.led_frames(spark, sf), threshold=0.14).withColumn("delta", F.round("delta", 9))


@check(f"""with {_DELTAS}, m as (select *, case when delta <= 1.0::double - 0.85::double then 0 else 1 end as fresh from d),
       n as (select *, cast(sum(fresh) over (partition by title_id order by frame_idx) as bigint) as run_no from m)
       select title_id, run_no, min(frame_idx) as first_frame, count(*) as frames, min(ts_us) as first_ts_us, max(ts_us) as last_ts_us
       from n group by title_id, run_no""", name="frame_runs_similar")
def _similar(spark, sf):
    return C.frame_runs(D.led_frames(spark, sf), similarity=0.85).drop("payload")


@check(f"""with {FRAMES}, k as (select *, coalesce(md5(cast(vec_id // 3 as varchar)) = lag(md5(cast(vec_id // 3 as varchar))) over (
         partition by title_id order by frame_idx), false) as same from vt),
       n as (select *, cast(sum(case when same then 0 else 1 end) over (partition by title_id order by frame_idx) as bigint) as run_no from k)
       select title_id, run_no, min(frame_idx) as first_frame, count(*) as frames, min(ts_us) as first_ts_us, max(ts_us) as last_ts_us,
              md5(cast(min(vec_id) // 3 as varchar)) as payload from n group by title_id, run_no""")
def frame_runs(spark, sf):
    """Payloads that repeat: neighbours among the vectors share one."""
    vectors = D._numbered_vectors(spark, sf)
    frames = vectors.select("title_id", "frame_idx", "ts_us", F.md5(
        F.floor(F.col("vec_id") / 3).cast("string")).cast("binary").alias("payload"))
    return C.frame_runs(frames).withColumn("payload", F.col("payload").cast("string"))


@check(f"""with {SAMPLES}, k as (select s.*, s.frame_idx // 48 * 48 as key_frame from led_samples s),
       j as (select k.title_id, k.frame_idx, k.key_frame, k.led_idx, k.r, k.g, k.b, k.w, k.r - o.r as dr, k.g - o.g as dg, k.b - o.b as db, k.w - o.w as dw
             from k join led_samples o on o.title_id = k.title_id and o.led_idx = k.led_idx and o.frame_idx = k.key_frame)
       select title_id, frame_idx, key_frame, led_idx, frame_idx = key_frame as is_key,
              case when frame_idx = key_frame then r else dr end as r, case when frame_idx = key_frame then g else dg end as g,
              case when frame_idx = key_frame then b else db end as b, case when frame_idx = key_frame then w else dw end as w
       from j where frame_idx = key_frame or greatest(abs(dr), abs(dg), abs(db), abs(dw)) > 10""")
def delta_frames(spark, sf):
    return C.delta_frames(D.led_samples(spark, sf))


_LIT = f"""{TIMED},
lit as (select vt.title_id, vt.frame_idx, vt.ts_us, lum, vt.ts_us // 500000 as chunk_no from vt join lums using (title_id, frame_idx))"""
_STEP = 500_000  # titles of the test data are seconds long


def _lit(spark, sf):
    return D.led_frames(spark, sf).withColumn("lum", packed.payload_luminance("payload", F.lit(4)))


@check(f"""with {_LIT} select title_id, chunk_no, min(ts_us) as start_ts_us, count(*) as frames,
       cast(round_even(avg(lum), 0) as int) as brightness from lit group by all""")
def chunks(spark, sf):
    return C.chunks(_lit(spark, sf), _STEP)


@check(f"with {_LIT} select title_id, chunk_no, cast(floor(lum / 16) as int) as bin, count(*) as frames from lit group by all")
def brightness_histogram(spark, sf):
    return C.brightness_histogram(_lit(spark, sf), _STEP)


@check(f"with {_LIT} select title_id, chunk_no as interval_no, min(ts_us) as ts_us, arg_min(frame_idx, ts_us) as frame_idx from lit group by all")
def seek_index(spark, sf):
    return C.seek_index(D.led_frames(spark, sf), _STEP)


_ALL_SAMPLES = f"with {SAMPLES} select title_id, frame_idx, ts_us, led_idx, r, g, b, w from led_samples"


@check(f"with {SAMPLES} select title_id, frame_idx, ts_us, payload_hex from led_frames")
def expand_runs(spark, sf):
    """Runs of identical frames and back."""
    frames = D.led_frames(spark, sf)
    return C.expand_runs(C.frame_runs(frames), frames).select("title_id", "frame_idx", "ts_us", F.hex("payload").alias("payload_hex"))


@check(_ALL_SAMPLES)
def restore_deltas(spark, sf):
    """Without a threshold nothing is lost."""
    samples = D.led_samples(spark, sf)
    return C.restore_deltas(C.delta_frames(samples, every=12, threshold=0), D.led_frames(spark, sf), every=12)


@check(f"""with {SAMPLES}, k as (select *, first_value(struct_pack(r := r, g := g, b := b, w := w)) over (
         partition by title_id, led_idx, frame_idx // 12 order by frame_idx) as f from led_samples),
       m as (select *, greatest(abs(r - f.r), abs(g - f.g), abs(b - f.b), abs(w - f.w)) > 10 as moved from k)
       select title_id, frame_idx, ts_us, led_idx, case when moved then r else f.r end as r, case when moved then g else f.g end as g,
              case when moved then b else f.b end as b, case when moved then w else f.w end as w from m""")
def restore_deltas_lossy(spark, sf):
    samples = D.led_samples(spark, sf)
    return C.restore_deltas(C.delta_frames(samples, every=12), D.led_frames(spark, sf), every=12)


@check(f"""with {FRAMES}, g as (select title_id, ts_us - lag(ts_us) over (partition by title_id order by frame_idx) as gap from vt),
       m as (select title_id, median(gap) as med from g where gap is not null group by title_id)
       select title_id, count(*) as gaps, min(gap) as min_gap_us, max(gap) as max_gap_us, any_value(med) as median_gap_us,
              round(sum(gap) / count(*), 6) as mean_gap_us, round(stddev_pop(gap), 4) as stddev_gap_us,
              count(*) filter (gap > 1.5 * med) as drops, max(gap) > 1.04::double * min(gap) as is_vfr
       from g join m using (title_id) where gap is not null group by title_id""")
def vfr_report(spark, sf):
    return C.vfr_report(D.led_frames(spark, sf), jitter=1.04).withColumns({
        "mean_gap_us": F.round("mean_gap_us", 6), "stddev_gap_us": F.round("stddev_gap_us", 4)})


@check(f"""with {_LIT}, c as (select title_id, chunk_no, cast(round_even(avg(lum), 0) as int) as brightness from lit group by all)
       select title_id, chunk_no, brightness, case when brightness < 32 then 6 when brightness < 96 then 7 else 8 end as bits from c""")
def bit_depth(spark, sf):
    return C.bit_depth(_lit(spark, sf), _STEP)


@check(f"with {_LIT} select title_id, frame_idx, ts_us, round(lum, 9) as lum from lit where lum < 125")
def dark_frames(spark, sf):
    return C.dark_frames(_lit(spark, sf), 125.0).select("title_id", "frame_idx", "ts_us", F.round("lum", 9).alias("lum"))


_SUMS = """select title_id, ts_us // 500000 as chunk_no, count(*) as frames,
       cast(sum(('0x' || substr(md5(encode(concat(frame_idx, ':', ts_us, ':')) || from_hex(payload_hex)), 1, 8))::bigint) % 4294967296 as bigint) as checksum"""


@check(f"with {SAMPLES} {_SUMS} from led_frames group by all")
def chunk_checksum(spark, sf):
    return C.chunk_checksum(D.led_frames(spark, sf), _STEP)


@check()
def chunk_checksum_crc(spark, sf):
    """The other digest; SQL engines at hand have no CRC-32."""
    return C.chunk_checksum(D.led_frames(spark, sf), _STEP, C.crc_of_frame)


@check(f"""with {SAMPLES} select distinct title_id, ts_us // 500000 as chunk_no, 'damaged' as problem from led_frames where frame_idx % 20 = 7""")
def bad_chunks(spark, sf):
    """Every twentieth frame differs in the second snapshot."""
    frames = D.led_frames(spark, sf)
    other = frames.withColumn("payload", F.when(
        F.col("frame_idx") % 20 == 7, F.substring("payload", 1, 63)).otherwise(F.col("payload")))
    return C.bad_chunks(C.chunk_checksum(frames, _STEP), C.chunk_checksum(other, _STEP))
