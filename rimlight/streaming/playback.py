"""Playback events: sessions opening and closing, seeks, pauses, routing."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rimlight.model import SEEK_JUMP_S
from rimlight.operators.routing import route_sessions

_STATE = ("last_ts long, last_id {event_id}, title_id {title_id}, is_open boolean, paused boolean, "
          "has_position boolean, position_s double")
_OUT = ("session_id {session_id}, event_id {event_id}, ts_us long, change string, title_id {title_id}, "
        "position_s double, prev_position_s double")
_OUT_COLUMNS = ["session_id", "event_id", "ts_us", "change", "title_id", "position_s", "prev_position_s"]


def _last_before(marked: np.ndarray) -> np.ndarray:
    """For each row the place of the last marked row before it, or -1."""
    at = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))
    return np.concatenate(([-1], at[:-1]))


def _follow(idle_ms: int):
    def follow(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        """Changes of one session within a micro-batch, events taken in (time, id) order.

        Events before the last one seen are late: they change nothing and are reported as such, also
        after a stop. A session that was idle for so long that its state timed out starts anew.
        """
        if state.hasTimedOut:
            state.remove()
            return
        parts = list(batches)
        events = parts[0] if len(parts) == 1 else pd.concat(parts)
        blank = (None, None, None, False, False, False, 0.0)
        last_ts, last_id, title, is_open, paused, has_pos, pos = state.get if state.exists else blank
        if last_ts is not None and last_ts // 1000 + idle_ms <= state.getCurrentWatermarkMs():
            last_ts, last_id, title, is_open, paused, has_pos, pos = blank  # due to go with this batch
        ts, ids, kind, titles, places, pausing = (
            events[c].to_numpy() for c in ("ts_us", "event_id", "kind", "title_id", "position_s", "is_paused"))
        order = np.lexsort((ids, ts))
        late = np.zeros(len(ts), bool) if last_ts is None else (ts < last_ts) | ((ts == last_ts) & (ids < last_id))
        out = [(ids[late], ts[late], "late", [title] * int(late.sum()), places[late], np.nan)] if late.any() else []
        order = order[~late[order]]
        if len(order):
            ts, ids, kind, titles, places, pausing = (x[order] for x in (ts, ids, kind, titles, places, pausing.astype(bool)))
            start, stop = kind == "start", kind == "stop"
            before = _last_before(start | stop)
            was_open = np.where(before < 0, is_open, start[before])
            begun = _last_before(start)
            was_title = np.where(begun < 0, np.array([title], object), titles.astype(object)[begun])
            active = ~(start | stop) & was_open
            # the progress before, in the same play for pauses, since the last stop for positions
            prior, stopped = _last_before(active), _last_before(stop)
            was_paused = np.where((prior >= 0) & (prior > begun), pausing[prior], (begun < 0) & paused)
            known = np.where(prior >= 0, prior > stopped, (stopped < 0) & has_pos)
            was_at = np.where(prior >= 0, places[prior], pos)
            ends = (start | stop) & was_open
            flips = active & (pausing != was_paused)
            jumps = active & known & (np.abs(places - was_at) > SEEK_JUMP_S)
            out += [(ids[ends], ts[ends], "close", was_title[ends], places[ends], np.nan),
                    (ids[start], ts[start], "open", titles[start], places[start], np.nan),
                    (ids[flips], ts[flips], np.where(pausing[flips], "pause", "resume"), was_title[flips], places[flips], np.nan),
                    (ids[jumps], ts[jumps], "seek", was_title[jumps], places[jumps], was_at[jumps])]
            last_control, last_start, last_stop, last_act = (
                int(np.flatnonzero(m)[-1]) if m.any() else -1 for m in (start | stop, start, stop, active))
            is_open = bool(start[last_control]) if last_control >= 0 else is_open
            paused = is_open and bool(pausing[last_act] if last_act > last_start else paused and last_start < 0)
            has_pos = last_act > last_stop or (has_pos and last_stop < 0)
            pos = float(places[last_act]) if last_act > last_stop else pos
            title = pd.Series(titles[last_start:last_start + 1]).tolist()[0] if last_start >= 0 else title
            last_ts, last_id = int(ts[-1]), pd.Series(ids[-1:]).tolist()[0]
        state.update((last_ts, last_id, title, bool(is_open), bool(paused), bool(has_pos), pos))
        state.setTimeoutTimestamp(max(last_ts // 1000, state.getCurrentWatermarkMs()) + idle_ms)
        out = [part for part in out if len(part[0])]
        if out:
            joined = [np.concatenate([np.broadcast_to(np.asarray(part[i], object if i == 3 else None), len(part[0])) for part in out]) for i in range(6)]
            yield pd.DataFrame(dict(zip(_OUT_COLUMNS, [key[0], joined[0], joined[1], joined[2], pd.Series(joined[3].tolist()), *joined[4:]])))

    return follow


def stream_changes(events: DataFrame, idle: str = "30 days") -> DataFrame:
    """Opens, closes, seeks, pauses, resumes and late events of all sessions.

    Ids may be of any type that sorts. The state of a session is one small row; it stays after a stop, so
    that late events are known as such, and goes when event time is ``idle`` past its last event, stopped or
    not. Events that are older than that are dropped. A session's events within a micro-batch are handled in
    one task; ``read_events`` limits micro-batches for that.
    """
    narrow = events.withWatermark("ts", idle).select(
        "session_id", "event_id", "ts", F.unix_micros("ts").alias("ts_us"), "title_id", "kind", "position_s", "is_paused")
    types = {c: events.schema[c].dataType.simpleString() for c in ("session_id", "event_id", "title_id")}
    days = events.sparkSession.sql(f"select cast(interval '{idle}' as interval day to second) as i").first()["i"]
    return narrow.groupBy("session_id").applyInPandasWithState(
        _follow(int(days.total_seconds() * 1000)), _OUT.format(**types), _STATE.format(**types), "append", GroupStateTimeout.EventTimeTimeout)


def stream_seeks(events: DataFrame, idle: str = "30 days") -> DataFrame:
    return stream_changes(events, idle).where("change = 'seek'").select(
        "session_id", "event_id", "position_s", "prev_position_s")


def stream_pause(events: DataFrame, idle: str = "30 days") -> DataFrame:
    return stream_changes(events, idle).where("change in ('pause', 'resume')").select(
        "session_id", "event_id", "change")


def stream_sessions(events: DataFrame, idle: str = "30 days") -> DataFrame:
    return stream_changes(events, idle).where("change in ('open', 'close')").select(
        "session_id", "event_id", "title_id", "change")


def route_starts(batch: DataFrame, sessions: DataFrame, mappings: Callable[[], DataFrame], strict: bool = True) -> DataFrame:
    """Targets of the sessions started in a micro-batch, for ``foreachBatch``.

    The mapping table is read again for every batch, so changes to it apply to the next start.
    """
    starts = batch.where("kind = 'start'").select("event_id", "session_id", "title_id")
    wanted = sessions.join(starts.select("session_id"), "session_id", "left_semi")
    return starts.join(route_sessions(wanted, mappings(), strict), "session_id")
