"""Shared common table expressions of the SQL twins (DuckDB dialect)."""

from __future__ import annotations

from rimlight.model import Tuning

FRAMES = """
v as (select label as title_id, vec_id, embedding,
             row_number() over (partition by label order by vec_id) - 1 as frame_idx from embeddings),
vt as (select *, cast(floor(frame_idx * 1e6 / 24) as bigint) + (title_id % 2) * (frame_idx % 3) * 1000 as ts_us
       from v)"""

_BYTE = "cast(greatest(0, least(255, floor(cast(embedding[led*4+{n}] as double) * 220 + 128))) as int)"

SAMPLES = FRAMES + f""",
led_samples as (
  select title_id, frame_idx, ts_us, cast(led as int) as led_idx,
         {_BYTE.format(n=1)} as r, {_BYTE.format(n=2)} as g, {_BYTE.format(n=3)} as b, {_BYTE.format(n=4)} as w
  from (select *, unnest(range(16)) as led from vt)),
led_frames as (
  select title_id, frame_idx, ts_us,
         string_agg(printf('%02X%02X%02X%02X', r, g, b, w), '' order by led_idx) as payload_hex
  from led_samples group by all),
led_titles as (
  select distinct label as title_id,
         case label % 4 when 0 then 24.0 when 1 then 0.0 when 2 then cast('nan' as double) else 301.0 end as fps
  from embeddings)"""

# every title lasts 50 ms or less, so the second timestamp decides where the header does not
TIMED = SAMPLES + """,
rates as (
  select t.title_id, case when not isnan(fps) and fps > 0.001 and fps <= 300 then fps
                          when abs(f1.ts_us - f0.ts_us) > 0 then 1e6 / abs(f1.ts_us - f0.ts_us)
                          else 24.0 end as rate
  from led_titles t
  left join vt f0 on f0.title_id = t.title_id and f0.frame_idx = 0
  left join vt f1 on f1.title_id = t.title_id and f1.frame_idx = 1),
gaps as (select title_id, frame_idx, ts_us,
                (ts_us - lag(ts_us) over (partition by title_id order by frame_idx)) / 1e6 as gap from vt),
timed as (select g.title_id, frame_idx, ts_us, case when gap > 0 then gap else 1.0 / rate end as dt_s
          from gaps g join rates using (title_id)),
lums as (select title_id, frame_idx,
                cast(sum(2126 * r + 7152 * g + 722 * b) as double) / (count(*) * 10000) as lum
         from led_samples group by all)"""


def clamp(value: str, low: float, high: float) -> str:
    return f"(case when isnan({value}) then {low} else greatest({low}, least({high}, {value})) end)"


def tuned(tuning: Tuning, r: str = "r", g: str = "g", b: str = "b", lum: str = "lum") -> str:
    """Select list tr, tg, tb on columns r, g, b, lum."""
    sat = min(max(tuning.saturation, 0.0), 5.0)
    lin = [f"power({c} / 255.0::double, {x}::double)"
           for c, x in ((r, tuning.gamma_red), (g, tuning.gamma_green), (b, tuning.gamma_blue))]
    mean = f"(({lin[0]} + {lin[1]} + {lin[2]}) / 3.0::double)"
    gamma = f"greatest(1.0::double, least(3.0::double, {tuning.gamma}::double * (1.0::double - {lum} / 255.0::double * 0.6::double)))"
    gain = (f"greatest(0.3::double, least(1.8::double, case when {lum} > 1 then greatest(0.05::double, least(2.5::double, "
            f"{max(1.0, tuning.brightness_target)}::double / {lum} * 0.7::double + 0.3::double)) else 1.0::double end))")
    cols = []
    for name, x in zip(("tr", "tg", "tb"), lin):
        mixed = f"({mean} + ({x} - {mean}) * {sat}::double)"
        cols.append(f"(case when {mixed} < 0 then 0.0::double else least(1.0::double, power({mixed}, 1.0::double / {gamma})) end)"
                    f" * {gain} * 255.0::double as {name}")
    return ", ".join(cols)


def finished(tuning: Tuning) -> str:
    """Select list r, g, b, w on smoothed columns ar, ag, ab, aw."""
    low = max(0.0, tuning.min_led_brightness)
    lift = {}
    for c, boost in (("r", tuning.red_boost), ("g", tuning.green_boost), ("b", tuning.blue_boost)):
        v = f"round_even(a{c}, 0)"
        lift[c] = f"(case when {v} > 0 and {v} < {low * boost}::double then {low * boost}::double else {v} end)"
    dim = (f"({lift['r']} * 0.2126::double + {lift['g']} * 0.7152::double + {lift['b']} * 0.0722::double"
           f" < {low * 0.5}::double)")
    cols = [f"case when {dim} then 0 else cast(greatest(0, least(255, round_even({lift[c]}, 0))) as int) end as {c}"
            for c in "rgb"]
    return ", ".join([*cols, "cast(greatest(0, least(255, round_even(aw, 0))) as int) as w"])


def depth(length: str, count: str, across: str) -> str:
    wanted = f"round_even(2.0::double * (case when {count} > 0 then {length}::double / {count} else {length} end), 0)"
    return f"cast(case when {wanted} < 12 then 12 else least({wanted}, floor({across} * 0.12::double)) end as int)"


def rects(layouts: str) -> str:
    """CTE ``rects`` over a table with layout_id, width, height, top, bottom, left, right."""
    return f"""
lay as (select layout_id, width as w, height as h, "top" as t, bottom as bo, "left" as l, "right" as ri from {layouts}),
rects as (
  select layout_id, i as led_idx, 'top' as side, i * w // t as x1, 0 as y1, (i + 1) * w // t as x2,
         {depth('w', 't', 'h')} as y2 from (select *, unnest(range(t)) as i from lay where t > 0)
  union all
  select layout_id, t + i, 'right', w - {depth('h', 'ri', 'w')}, i * h // ri, w, (i + 1) * h // ri
  from (select *, unnest(range(ri)) as i from lay where ri > 0)
  union all
  select layout_id, t + ri + i, 'bottom', (bo - i - 1) * w // bo, h - {depth('w', 'bo', 'h')}, (bo - i) * w // bo, h
  from (select *, unnest(range(bo)) as i from lay where bo > 0)
  union all
  select layout_id, t + ri + bo + i, 'left', 0, (l - i - 1) * h // l, {depth('h', 'l', 'w')}, (l - i) * h // l
  from (select *, unnest(range(l)) as i from lay where l > 0))"""


def zone_pixels(width: int, height: int) -> str:
    """CTEs up to ``zp``: one row per frame, zone and pixel, with the zone rectangle."""
    return FRAMES + f""",
strip as (select 0 as layout_id, {width} as width, {height} as height, 5 as "top", 5 as bottom, 3 as "left", 3 as "right"),
{rects('strip').strip()},
xy as (select x, y from (select unnest(range({width})) as x), (select unnest(range({height})) as y)),
zxy as (select led_idx, x, y, x1, y1, x2, y2 from rects join xy on x >= x1 and x < x2 and y >= y1 and y < y2),
zp as (select title_id, frame_idx, led_idx, x, y, x1, y1, x2, y2, r, g, b,
              r * 0.299::double + g * 0.587::double + b * 0.114::double as grey
       from (select title_id, frame_idx, led_idx, x, y, x1, y1, x2, y2, (x*7 + y*13 + vec_id*31) % 256 as r,
                    (x*x + y*5 + vec_id*17) % 256 as g, (x*3 + y*y + vec_id*53) % 256 as b
             from vt cross join zxy))"""


def zone_weights(width: int, height: int) -> str:
    """CTEs up to ``zw``: gradient, edge, normalized edge, centre and weight of every zone pixel."""
    return zone_pixels(width, height) + """,
dxs as (select *, coalesce(lead(grey) over wx, grey) - coalesce(lag(grey) over wx, grey) as dx,
               coalesce(lag(grey) over wx, grey) + 2 * grey + coalesce(lead(grey) over wx, grey) as sx
        from zp window wx as (partition by title_id, frame_idx, led_idx, y order by x)),
grad as (select *, coalesce(lag(dx) over wy, dx) + 2 * dx + coalesce(lead(dx) over wy, dx) as gx,
                coalesce(lead(sx) over wy, sx) - coalesce(lag(sx) over wy, sx) as gy
         from dxs window wy as (partition by title_id, frame_idx, led_idx, x order by y)),
edges as (select *, sqrt(gx * gx + gy * gy) as edge from grad),
tops as (select title_id, frame_idx, led_idx, max(edge) as top_edge from edges group by all),
zw as (select e.*, case when top_edge > 0 then edge / top_edge else edge end as edge_n,
              exp(-(power(x - x1 - (x2 - x1) // 2, 2) + power(y - y1 - (y2 - y1) // 2, 2))
                  / (2.0::double * power(greatest(least(x2 - x1, y2 - y1) / 4.0::double, 1.0::double), 2))) as centre
       from edges e join tops using (title_id, frame_idx, led_idx)),
zww as (select *, greatest(edge_n * 0.7::double + centre * 0.3::double, 0.01::double) as weight from zw),
zc as (select title_id, frame_idx, led_idx,
              cast(greatest(0, least(255, round_even(sum(weight * r) / sum(weight), 0))) as int) as r,
              cast(greatest(0, least(255, round_even(sum(weight * g) / sum(weight), 0))) as int) as g,
              cast(greatest(0, least(255, round_even(sum(weight * b) / sum(weight), 0))) as int) as b
       from zww group by all)"""


CATALOG = """
catalog as (
  select doc_id, md5(cast(doc_id as varchar)) as item_id, md5(lang) as library_id,
         case when doc_id % 29 = 0 then null else concat('Item ', lpad(cast(doc_id as varchar), 8, '0')) end as name,
         case doc_id % 3 when 0 then 'Movie' when 1 then 'Episode' else 'Video' end as item_type,
         case when doc_id % 17 = 0 then null else concat('/media/', source, '/', cast(doc_id as varchar), '.mkv') end as path,
         case when doc_id % 23 = 0 then 'garbage'
              else concat('2024-', lpad(cast(doc_id % 12 + 1 as varchar), 2, '0'), '-',
                          lpad(cast(doc_id % 28 + 1 as varchar), 2, '0'), 'T00:00:00.0000000Z') end as date_created,
         source, n_chars
  from documents),
items as (
  select md5(cast(doc_id as varchar)) as item_id, doc_id,
         case when quality = 1 then 'completed' when doc_id % 2 = 0 then 'failed' else 'extracting' end as extraction_status,
         toxic + 1 as extraction_attempts, 7 as extraction_progress, doc_id % 5000 as frames_current,
         case when doc_id % 7 = 0 then 0 else 5000 end as frames_total
  from labels),
binaries as (
  select md5(cast(l.doc_id as varchar)) as item_id, 17 + d.n_chars * 836 as length
  from labels l join documents d on l.doc_id = d.doc_id where quality = 1 and l.doc_id % 5 <> 0
  union all select concat('orphan', cast(r_regionkey as varchar)), 17 from region where r_regionkey < 3),
files as (select concat('/media/', source, '/', cast(doc_id as varchar), '.mkv') as path from documents where n_chars >= 400),
allowed as (select * from catalog where item_type in ('Movie', 'Episode') and path is not null and path <> ''
            and library_id <> md5('es')),
pending as (
  select item_id, library_id, coalesce(name, 'Unknown') as name, item_type,
         case item_type when 'Episode' then 'Serie' when 'Movie' then 'Movie' else 'Video' end as kind, path, date_created
  from allowed where item_id not in (select item_id from binaries) and path in (select path from files))"""

EVENTS = """
e as (select event_id, ts, user_id as session_id, cast(user_id % 10 as int) as title_id,
             case event_type when 'signup' then 'start' when 'purchase' then 'stop' else 'progress' end as kind,
             value as position_s, event_type = 'error' as is_paused from events),
c as (select *, last_value(case when kind in ('start', 'stop') then kind end ignore nulls) over (
                  partition by session_id order by ts, event_id rows between unbounded preceding and 1 preceding) as ctl,
             cast(sum(case when kind = 'start' then 1 else 0 end) over w as bigint) as play_no,
             cast(sum(case when kind = 'stop' then 1 else 0 end) over w as bigint) as stops,
             lead(ts) over w as next_ts
      from e window w as (partition by session_id order by ts, event_id)),
p as (select *, lag(position_s) over (partition by session_id, stops order by ts, event_id) as prev_position_s,
             coalesce(lag(is_paused) over (partition by session_id, play_no order by ts, event_id), false) as prev_paused
      from c where kind = 'progress' and ctl = 'start')"""

_MAPPING = """
mapping(mapping_order, device_identifier, host, port, "top", bottom, "left", "right", input_position) as (values
  (0, 'QlVJTERJTkd8MTYwMDAwMDAwMDAwMA==', 'h0', 19446, 89, 89, 49, 49, 0),
  (1, 'room 3-tv', 'h1', 19446, 5, 5, 3, 3, 4),
  (2, 'Room 1', 'h2', 19446, 5, 5, 3, 3, -7),
  (3, 'room1', 'h2', 19446, 9, 9, 9, 9, 0),
  (4, 'ROOM 3-TV', 'h3', 19447, 0, 0, 0, 0, 0),
  (5, '  ', 'h4', 19446, 1, 1, 1, 1, 0),
  (6, '---', 'h5', 19446, 1, 1, 1, 1, 0))"""

ROUTES = _MAPPING + """,
sess as (select c_custkey as session_id, c_mktsegment,
                to_base64(encode(concat(c_mktsegment, '|', cast(1700000000000 + c_custkey as varchar)))) as device_id,
                concat('Room ', cast(c_nationkey as varchar), '-TV') as device_name from customer),
matched as (
  select session_id, m.* from sess join mapping m
    on trim(m.device_identifier) <> '' and (
       (m.mapping_order = 0 and c_mktsegment = 'BUILDING')
       or lower(m.device_identifier) = lower(device_name)
       or (length(regexp_replace(lower(m.device_identifier), '[^a-z0-9]', '', 'g')) > 0 and
           contains(regexp_replace(lower(device_name), '[^a-z0-9]', '', 'g'),
                    regexp_replace(lower(m.device_identifier), '[^a-z0-9]', '', 'g'))))),
routes as (select session_id, host, port, mapping_order, "top", bottom, "left", "right", input_position from matched
           qualify row_number() over (partition by session_id, host, port order by mapping_order) = 1)"""

# events on the scale of the test titles: see derived.short_events
_SHORT_EVENTS = EVENTS.replace(
    "event_id, ts,", "event_id, make_timestamp(1704067200000000 + (epoch_us(ts) - 1704067200000000) // 100000) as ts,", 1).replace(
    "value as position_s", "value / 200 as position_s", 1)


def segments(lead_s: float) -> str:
    """CTEs up to ``sg``: stretches of unpaused play, each with its opening."""
    return _SHORT_EVENTS + f""",
fl as (select c.*, coalesce(abs(p.position_s - p.prev_position_s) > 0.5, false) as seek, coalesce(p.is_paused <> p.prev_paused, false) as flip,
              p.event_id is not null as prog from c left join p using (session_id, event_id)),
bd as (select *, kind = 'start' or seek as opening, kind = 'start' or (prog and not is_paused) as sending
       from fl where kind = 'start' or seek or flip or (kind = 'stop' and ctl = 'start')),
bn as (select * exclude (title_id), cast(sum(case when opening then 1 else 0 end) over w as bigint) as opening_no, lead(ts) over w as end_ts,
              last_value(case when kind = 'start' then title_id end ignore nulls) over (
                partition by session_id order by ts, event_id rows between unbounded preceding and current row) as title_id
       from bd window w as (partition by session_id order by ts, event_id)),
op as (select session_id, opening_no, case kind when 'start' then 'start' else 'seek' end as opened_by,
              cast(floor(greatest(0, position_s + (case kind when 'start' then {lead_s}::double else 0 end)) * 1000000) as bigint) as target_us
       from bn where opening),
iv as (select session_id, event_id, play_no, opening_no, title_id, ts as begin_ts, end_ts, epoch_us(end_ts) - epoch_us(ts) as length_us
       from bn where sending and (end_ts is null or end_ts > ts)),
sg as (select session_id, play_no, opening_no, opened_by, title_id, target_us, begin_ts, end_ts,
              cast(coalesce(sum(length_us) over (partition by session_id, opening_no order by begin_ts, event_id
                rows between unbounded preceding and 1 preceding), 0) as bigint) as played_us, length_us
       from iv join op using (session_id, opening_no))"""


# CTEs up to ``sent`` after FRAMES and ``sg``: the frames of every segment
SENT = """
ends as (select title_id, max(frame_idx) as last from v group by title_id),
ost as (select o.title_id, o.target_us, coalesce(min(x.frame_idx), any_value(last)) as start_frame
        from (select distinct title_id, target_us from sg) o join ends using (title_id)
        left join vt x on x.title_id = o.title_id and x.ts_us >= o.target_us group by all),
rg as (select sg.*, start_frame, b.ts_us as base_ts from sg join ost using (title_id, target_us)
       join vt b on b.title_id = sg.title_id and b.frame_idx = start_frame),
sent as (select rg.*, f.frame_idx, f.ts_us - base_ts as d from rg
         join vt f on f.title_id = rg.title_id and f.frame_idx >= start_frame and f.ts_us - base_ts >= played_us
           and (length_us is null or f.ts_us - base_ts < played_us + length_us))"""
