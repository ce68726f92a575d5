"""Routing, plays, seeks, pauses and display frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from rimlight.checks.registry import check
from rimlight.checks.sql import EVENTS, FRAMES, ROUTES, SENT, TIMED, finished, segments, tuned
from rimlight.functions import ids
from rimlight.model import Tuning
from rimlight.operators import playback as P
from rimlight.operators import routing as R
from rimlight.operators import segments as S
from rimlight.operators import timeline as TL
from rimlight.plans import display
from rimlight.session import checkpointed
from rimlight.sources import derived as D

# ---- routing --------------------------------------------------------------------------------


@check("""select s_suppkey, s_suppkey % 4 as way from supplier where s_suppkey % 4 <> 0 and s_suppkey % 3 <> 0""")
def mapping_filter(spark, sf):
    k = F.col("s_suppkey")
    rows = D.table(spark, sf, "supplier").select(
        "s_suppkey", (k % 4).alias("way"), F.when(k % 4 != 0, "id").otherwise("  ").alias("device_identifier"),
        F.when(k % 3 != 0, "host").alias("host"))
    return R.mapping_filter(rows).select("s_suppkey", "way")


_DEVICE = """
raw as (select c_custkey, case c_custkey % 6
      when 0 then concat(c_mktsegment, '|', cast(1700000000000 + c_custkey as varchar))
      when 1 then concat(c_name, '|a|', cast(c_custkey as varchar)) when 2 then concat('|', c_name)
      when 3 then concat(c_name, '|1234567890123456789') when 4 then concat(c_name, '|12345678901234567890')
      else c_name end as text from customer),
dev as (select c_custkey, text, case when c_custkey % 6 = 5 then concat('#', text) else to_base64(encode(text)) end as device_id from raw)"""


@check(f"""with {_DEVICE} select c_custkey, case c_custkey % 6
       when 0 then to_base64(encode(split_part(text, '|', 1))) when 1 then to_base64(encode(concat(split_part(text, '|', 1), '|a')))
       when 3 then to_base64(encode(split_part(text, '|', 1))) else device_id end as device_id from dev""")
def strip_device_ts(spark, sf):
    k, name = F.col("c_custkey"), F.col("c_name")
    text = (F.when(k % 6 == 0, F.concat("c_mktsegment", F.lit("|"), (k + 1700000000000).cast("string")))
            .when(k % 6 == 1, F.concat(name, F.lit("|a|"), k.cast("string"))).when(k % 6 == 2, F.concat(F.lit("|"), name))
            .when(k % 6 == 3, F.concat(name, F.lit("|1234567890123456789")))
            .when(k % 6 == 4, F.concat(name, F.lit("|12345678901234567890"))).otherwise(name))
    device = F.when(k % 6 == 5, F.concat(F.lit("#"), text)).otherwise(F.base64(F.encode(text, "utf-8")))
    return D.table(spark, sf, "customer").select("c_custkey", ids.strip_device_ts(device).alias("device_id"))


@check(f'with {ROUTES} select session_id, host, port, mapping_order, "top", bottom, "left", "right", input_position from routes')
def route_sessions(spark, sf):
    return R.route_sessions(D.sessions(spark, sf), D.device_mappings(spark), strict=True)


@check(f"""with {ROUTES}, loose as (select session_id, host, port, mapping_order from routes
       union all select session_id, 'h5', 19446, 6 from sess) select * from loose""")
def route_sessions_loose(spark, sf):
    """An identifier without letters and digits matches every named device."""
    return R.route_sessions(D.sessions(spark, sf), D.device_mappings(spark), strict=False).select(
        "session_id", "host", "port", "mapping_order")


@check("""select l_orderkey as session_id, l_returnflag as host, cast(l_suppkey % 3 as int) as port, min(l_linenumber) as mapping_order
       from lineitem group by all""")
def first_targets(spark, sf):
    """Order lines as matches: per order and (flag, port) the first line wins."""
    lines = D.table(spark, sf, "lineitem")
    matches = lines.select(F.col("l_orderkey").alias("session_id"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("mapping_order"))
    zero = F.lit(0)
    mappings = lines.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("mapping_order"), F.col("l_returnflag").alias("host"),
        (F.col("l_suppkey") % 3).cast("int").alias("port"),
        *[zero.alias(c) for c in ("top", "bottom", "left", "right", "input_position")])
    return R.first_targets(matches, mappings).select(
        "session_id", "host", "port", F.split("mapping_order", "-")[1].cast("int").alias("mapping_order"))


# ---- events ---------------------------------------------------------------------------------

_DAY_US = 86_400_000_000


@check(f"with {EVENTS} select session_id, event_id, position_s, prev_position_s from p where abs(position_s - prev_position_s) > 0.5")
def seek_events(spark, sf):
    return P.seek_events(D.playback_events(spark, sf), _DAY_US).drop("ts")


@check(f"""with {EVENTS}, f as (select *, cast(sum(case when is_paused <> prev_paused then 1 else 0 end) over (
         partition by session_id order by ts, event_id) as bigint) as flips from p)
       select session_id, play_no, flips, is_paused, count(*) as events, min(ts) as first_ts, max(ts) as last_ts from f
       group by session_id, play_no, flips, is_paused""")
def pause_islands(spark, sf):
    return P.pause_islands(D.playback_events(spark, sf), _DAY_US).withColumns(
        {c: F.col(c).cast("timestamp_ntz") for c in ("first_ts", "last_ts")})


@check(f"""with {EVENTS} select session_id, event_id, case when is_paused then 'pause' else 'resume' end as change from p
       where is_paused <> prev_paused""")
def pause_changes(spark, sf):
    return P.pause_changes(D.playback_events(spark, sf), _DAY_US).drop("ts")


@check(f"""with {EVENTS},
       o as (select session_id, play_no, ts, event_id, kind, next_ts, is_paused from c where kind = 'start' or (kind = 'progress' and ctl = 'start')),
       k as (select session_id, play_no, max(ts) as seek_ts from p where abs(position_s - prev_position_s) > 0.5 group by all)
       select session_id, play_no, coalesce(sum(case when (seek_ts is null or ts >= seek_ts) and not (is_paused and kind = 'progress')
              then epoch_us(next_ts) - epoch_us(ts) end), 0) / 1e6 as played_s
       from o left join k using (session_id, play_no) group by session_id, play_no""")
def played_time(spark, sf):
    return P.played_time(D.playback_events(spark, sf), _DAY_US)


_T = Tuning()
_SEGMENTS = segments(_T.sync_lead_s)


def _plain_times(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _segments(spark, sf):
    return S.play_segments(D.short_events(spark, sf), _T.sync_lead_s, _DAY_US)


@check(f"with {_SEGMENTS} select * from sg")
def play_segments(spark, sf):
    """Plays cut at starts, stops, seeks and pauses."""
    return _plain_times(_segments(spark, sf), "begin_ts", "end_ts")


@check(f"with {_SEGMENTS}, {ROUTES} select session_id, play_no, opening_no, begin_ts, title_id, host, port, mapping_order from sg join routes using (session_id)")
def session_fanout(spark, sf):
    """Every segment of every play, once per target."""
    routes = R.route_sessions(D.sessions(spark, sf), D.device_mappings(spark), strict=True)
    return _plain_times(P.session_fanout(_segments(spark, sf), routes), "begin_ts").select(
        "session_id", "play_no", "opening_no", "begin_ts", "title_id", "host", "port", "mapping_order")


@check(f"""with {FRAMES}, {_SEGMENTS}, {SENT} select session_id, play_no, opening_no, begin_ts, start_frame, min(frame_idx) as first_frame,
       max(frame_idx) as last_frame, count(*) as frames from sent group by all""")
def segment_frames(spark, sf):
    """Frames of every segment, by search in the titles' schedules."""
    frames = D.led_frames(spark, sf)
    schedule = checkpointed(TL.frame_schedule(frames, TL.infer_fps(D.led_titles(spark, sf), frames)))
    return _plain_times(S.frame_ranges(checkpointed(_segments(spark, sf)), schedule), "begin_ts").select(
        "session_id", "play_no", "opening_no", "begin_ts", "start_frame", "first_frame", "last_frame", "frames")


def _shown(run: str) -> str:
    """CTEs up to ``shown``. The average goes along the frames in sending order, through the whole of each ``run`` (columns)."""
    return f"""{TIMED}, {_SEGMENTS}, {ROUTES}, {SENT},
s as (select * from led_samples join lums using (title_id, frame_idx) join timed using (title_id, frame_idx)),
t as materialized (select title_id, frame_idx, led_idx, r, g, b, w, 1.0::double - exp(-dt_s / {_T.tau}::double) as k, {tuned(_T)} from s),
sq as materialized (select *, row_number() over (partition by {run} order by opening_no, frame_idx) as n from sent
                    where session_id in (select session_id from routes)),
stp as materialized (select sq.session_id, sq.play_no, opening_no, n, t.* exclude (title_id) from sq join t using (title_id, frame_idx)),
ema as (
  select {run}, n, frame_idx, opening_no as o, led_idx, r * (1 - k) + tr * k as ar, g * (1 - k) + tg * k as ag, b * (1 - k) + tb * k as ab,
         w * 1.0::double as aw from stp where n = 1
  union all
  select {", ".join(f"e.{c.strip()}" for c in run.split(","))}, t.n, t.frame_idx, t.opening_no, t.led_idx, ar * (1 - k) + tr * k, ag * (1 - k) + tg * k,
         ab * (1 - k) + tb * k, aw * (1 - k) + w * k
  from ema e join stp t on {" and ".join(f"t.{c.strip()} = e.{c.strip()}" for c in run.split(","))} and t.led_idx = e.led_idx and t.n = e.n + 1),
bytes as (select session_id, o as opening_no, frame_idx, led_idx, {finished(_T)} from ema),
pl as (select session_id, host, port, (case when "top" > 0 then "top" else 5 end) + (case when bottom > 0 then bottom else 5 end)
              + (case when "left" > 0 then "left" else 3 end) + (case when "right" > 0 then "right" else 3 end) as n, abs(input_position) as pos from routes),
strips as (
  select p.session_id, host, port, opening_no, frame_idx, string_agg(printf('%02X%02X%02X%02X', r, g, b, w), '' order by (i - pos % n + n) % n) as payload_hex
  from (select *, unnest(range(n)) as i from pl) p join bytes y on y.session_id = p.session_id and y.led_idx = i * 16 // n group by all),
shown as (select x.session_id, host, port, play_no, x.opening_no, title_id, x.frame_idx, d as send_at_us,
                 begin_ts + to_microseconds(d - played_us) as sent_ts, payload_hex
          from strips x join sq using (session_id, opening_no, frame_idx))"""


_DISPLAY = "select session_id, host, port, play_no, opening_no, title_id, frame_idx, send_at_us, sent_ts, md5(payload_hex) as payload_md5 from shown"


def _displayed(spark, sf, **options):
    out = display.display_frames(
        D.short_events(spark, sf), D.sessions(spark, sf), D.device_mappings(spark), D.led_titles(spark, sf),
        D.led_frames(spark, sf), _T, strict=True, encode=lambda payload: F.md5(F.hex(payload)), **options)
    return _plain_times(out.withColumnRenamed("payload", "payload_md5"), "sent_ts")


@check(f"with recursive {_shown('session_id, play_no')} {_DISPLAY}", name="display_frames")
def _display_frames(spark, sf):
    """The whole playback path: segments, routing, tone, smoothing through seeks, resampling, rotation, schedule."""
    return _displayed(spark, sf)


@check(f"with recursive {_shown('session_id, play_no, opening_no').replace('opening_no as o, ', '').replace('t.opening_no, t.led_idx', 't.led_idx').replace('o as opening_no', 'opening_no')} {_DISPLAY}",
       name="display_frames_reset")
def _display_frames_reset(spark, sf):
    """The same with smoothing that starts anew at every seek."""
    return _displayed(spark, sf, reset_on_seek=True)


@check(f"""with {FRAMES}, {_SEGMENTS}, {ROUTES}, {SENT},
       pl as (select session_id, host, port, (case when "top" > 0 then "top" else 5 end) + (case when bottom > 0 then bottom else 5 end)
              + (case when "left" > 0 then "left" else 3 end) + (case when "right" > 0 then "right" else 3 end) as n from routes)
       select title_id, count(distinct (session_id, host, port)) as players, count(*) as frames_sent, cast(sum(n * 4) as bigint) as bytes_sent
       from sent join pl using (session_id) group by title_id""", name="display_summary")
def _display_summary(spark, sf):
    return display.display_summary(
        D.short_events(spark, sf), D.sessions(spark, sf), D.device_mappings(spark), D.led_titles(spark, sf), D.led_frames(spark, sf), _T)
