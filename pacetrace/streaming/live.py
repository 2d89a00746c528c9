"""Live detectors: session rotation, laps, corner exits, fuel and shard cuts over frames in order.

Each is a ``Detector`` for ``ordered_stream``; the batch forms of the same rules are in ``detectors``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .detectors import COOLDOWN_S, IDLE_S, RESTART_S
from .ordered import TIME, Detector, ordered_stream


def _num(x):
    """A plain number or None, for JSON."""
    return None if x is None or pd.isna(x) else x.item() if hasattr(x, "item") else x


def _changes(*columns: np.ndarray) -> np.ndarray:
    """Rows whose value differs from the row before in any column; the first row is not among them."""
    new = np.zeros(len(columns[0]), bool)
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


class Rotation(Detector):
    """Session starts and ends of a source.  A session ends with its last frame when the source falls silent for
    ``idle_s``, changes track or vehicle, or when its clock falls back; silence needs no further frame to be seen."""

    output = "source_id string, session_no long, event string, frame_id long, track_name string, vehicle_name string, reason string"
    start = [None, None, None, None, 0, None, False]  # track, vehicle, clock, arrival, number, last frame, open

    def __init__(self, idle_s: float = IDLE_S) -> None:
        self.idle_s = idle_s
        self.idle_ms = int(idle_s * 1000)

    def _closed(self, source, state, reason) -> tuple:
        return source, state[4], "closed", state[5], state[0], state[1], reason

    def frames(self, source, state, pdf):
        track, vehicle = pdf["track_name"].to_numpy(object), pdf["vehicle_name"].to_numpy(object)
        clock, arrival, frame = pdf["session_time_s"].to_numpy(), pdf["arrival_s"].to_numpy(), pdf["frame_id"].to_numpy()
        before = [np.concatenate(([s], c[:-1])) for s, c in zip(
            (state[0], state[1], np.nan if state[2] is None else state[2], np.nan if state[3] is None else state[3]), (track, vehicle, clock, arrival))]
        silent = arrival - before[3].astype(float) >= self.idle_s
        moved = (track != before[0]) | (vehicle != before[1])
        back = clock < before[2].astype(float) - RESTART_S
        new = silent | moved | back
        new[0] |= not state[6]
        rows = []
        for i in np.flatnonzero(new):
            if i:
                state = [track[i - 1], vehicle[i - 1], None, None, state[4], int(frame[i - 1]), True]
            if state[6]:
                rows.append(self._closed(source, state, "idle" if silent[i] else "changed" if moved[i] else "restarted"))
            state = [None, None, None, None, state[4] + 1, None, True]
            rows.append((source, state[4], "started", int(frame[i]), track[i], vehicle[i], None))
        return rows, [track[-1], vehicle[-1], _num(clock[-1]), _num(arrival[-1]), state[4], int(frame[-1]), True]

    def idle(self, source, state):
        return ([self._closed(source, state, "idle")] if state[6] else []), [*state[:6], False]


class Laps(Detector):
    """Lap starts and completions; a lap completes when its number goes forward on the same track, else it is dropped."""

    output = (
        "source_id string, frame_id long, event string, lap_number int, lap_time_s double, frame_count long, "
        "track_name string, start_frame long, segment_index int"
    )
    start = [None, None, 0, None, None, -1]  # lap, track, frames, last lap time, first frame, segment

    def frames(self, source, state, pdf):
        lap, track, count, last, first, segment = state
        laps, tracks = pdf["lap_number"].to_numpy(), pdf["track_name"].to_numpy(object)
        times, ids = pdf["lap_time_s"].to_numpy(), pdf["frame_id"].to_numpy()
        at = _changes(laps, tracks)
        if lap is None or laps[0] != lap or tracks[0] != track:
            at = np.concatenate(([0], at))
        rows, done = [], 0
        for i in at.tolist():
            count, last = count + i - done, (times[i - 1] if i else last)
            if lap is not None and tracks[i] == track and laps[i] > lap:
                rows.append((source, int(ids[i]), "lap_completed", lap, _num(last), count, track, first, segment))
            lap, track, count, done, first, segment = int(laps[i]), tracks[i], 0, i, int(ids[i]), segment + 1
            rows.append((source, int(ids[i]), "new_lap", lap, None, None, track, first, segment))
        return rows, [lap, track, count + len(pdf) - done, _num(times[-1]), first, segment]


class Exits(Detector):
    """Corner exits after a source's first completed lap on a track, at most one per cooldown; a change of track starts
    anew.  Needs ``corner_id`` and ``corner_end_m`` of the corner that a frame is in."""

    output = "source_id string, frame_id long, lap_number int, session_time_s double, exited_corner int, exit_distance_m double"
    start = [None, None, None, False, None, None]  # corner, its end, lap, a lap completed, last exit, track

    def __init__(self, cooldown_s: float = COOLDOWN_S) -> None:
        self.cooldown_s = cooldown_s

    def frames(self, source, state, pdf):
        track = pdf["track_name"].to_numpy(object) if "track_name" in pdf else np.full(len(pdf), None)
        rows, cuts = [], [0, *_changes(track).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            if track[a] != state[5]:
                state = [*self.start[:5], track[a]]
            found, state = self._on_one_track(source, state, pdf.iloc[a:b])
            rows += found
        return rows, state

    def _on_one_track(self, source, state, pdf):
        corner0, end0, lap0, completed0, last, track = state
        corner = pdf["corner_id"].fillna(-1).to_numpy().astype("int64")
        end, lap = pdf["corner_end_m"].to_numpy(dtype="float64"), pdf["lap_number"].to_numpy()
        d, t, ids = pdf["lap_distance_m"].to_numpy(), pdf["session_time_s"].to_numpy(), pdf["frame_id"].to_numpy()
        p_corner = np.concatenate(([-1 if corner0 is None else corner0], corner[:-1]))
        p_end = np.concatenate(([np.nan if end0 is None else end0], end[:-1]))
        p_lap = np.concatenate(([lap[0] if lap0 is None else lap0], lap[:-1]))
        completed = completed0 | np.logical_or.accumulate(lap > p_lap)
        hit = completed & (lap == p_lap) & (p_corner >= 0) & ((corner < 0) | ((corner != p_corner) & (d >= p_end)))
        rows = []
        for i in np.flatnonzero(hit):
            if last is None or t[i] - last >= self.cooldown_s:
                last = float(t[i])
                rows.append((source, int(ids[i]), int(lap[i]), last, int(p_corner[i]), float(d[i] if corner[i] < 0 else p_end[i])))
        return rows, [int(corner[-1]), _num(end[-1]), int(lap[-1]), bool(completed[-1]), last, track]


class Fuel(Detector):
    """Fuel facts of a session after each of its segments: what ``fuel_by_lap`` and ``fuel_facts`` say of the frames so far.

    The state is an aggregate that takes any run of frames: first and last reading, the lap numbers seen, and how often each
    session type and race length occurred.  The last segment is stated when the source falls silent.
    """

    output = (
        "source_id string, segment_index int, lap_number int, laps_completed long, start_l double, end_l double, per_lap_l double, laps_left double, "
        "session_code int, race_laps_total int, race_laps_left int, fuel_status string"
    )
    start = [None, -1, [], None, None, {}, {}, False]  # lap, segment, laps seen, first, last, types, lengths, a segment is open

    def __init__(self, idle_s: float = 60.0) -> None:
        self.idle_ms = int(idle_s * 1000)

    @staticmethod
    def _mode(counts: dict[str, int]):
        return min(((-n, int(v)) for v, n in counts.items()), default=(0, None))[1]

    def _facts(self, source, state) -> tuple:
        lap, segment, seen, first, last, types, lengths, _ = state
        used = None if first is None or last is None else first - last
        per = used / len(seen) if used is not None and used > 0 else None
        left = last / per if per else None
        status = "UNKNOWN" if left is None else "CRITICAL" if left < 2 else "WARNING" if left <= 5 else "OK"
        total = self._mode(lengths)
        race = None if total is None else max(0, total - max(seen))
        return source, segment, lap, len(seen), first, last, per, left, self._mode(types), total, race, status

    def frames(self, source, state, pdf):
        laps = pdf["lap_number"].to_numpy()
        fuel, cap = pdf["fuel_l"].to_numpy(dtype="float64"), pdf["fuel_capacity_l"].to_numpy(dtype="float64")
        ok = (fuel > 0) & ~((cap > 0) & (fuel > cap))
        rows, cuts = [], [0, *_changes(laps).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            lap, segment, seen, first, last, types, lengths, open_ = state
            if lap is None or laps[a] != lap:
                if open_:
                    rows.append(self._facts(source, state))
                lap, segment = int(laps[a]), segment + 1
                seen = seen if lap in seen else [*seen, lap]
            good = fuel[a:b][ok[a:b]]
            if len(good):
                first, last = float(good[0]) if first is None else first, float(good[-1])
            types, lengths = dict(types), dict(lengths)
            for column, counts in (("session_type", types), ("race_laps_total", lengths)):
                for v, n in pdf[column].iloc[a:b].value_counts().items():
                    counts[str(int(v))] = counts.get(str(int(v)), 0) + int(n)
            state = [lap, segment, seen, first, last, types, lengths, True]
        return rows, state

    def idle(self, source, state):
        return ([self._facts(source, state)] if state[7] else []), [*state[:7], False]


class Shards(Detector):
    """The frames themselves with the number of their shard: a new one at each lap boundary and every ``flush_s`` seconds."""

    def __init__(self, columns: str, flush_s: float = 30.0) -> None:
        self.output = f"{columns}, shard long"
        self.flush_ms = flush_s * 1000
    start = [None, None, -1, None]  # lap, track, shard, its first millisecond

    def frames(self, source, state, pdf):
        lap, track, shard, began = state
        laps, tracks = pdf["lap_number"].to_numpy(), pdf["track_name"].to_numpy(object)
        ms = pdf[TIME].astype("datetime64[ms]").astype("int64").to_numpy()
        number = np.empty(len(pdf), np.int64)
        cuts = [0, *_changes(laps, tracks).tolist(), len(pdf)]
        for a, b in zip(cuts, cuts[1:]):
            if lap is None or laps[a] != lap or tracks[a] != track:
                lap, track, shard, began = int(laps[a]), tracks[a], shard + 1, int(ms[a])
            while a < b:
                end = min(b, max(a, int(np.searchsorted(ms[a:b], began + self.flush_ms)) + a))
                number[a:end] = shard
                if end < b:
                    shard, began = shard + 1, int(ms[end])
                a = end
        out = pdf.assign(shard=number)
        return out[[c.split()[0] for c in self.output.split(", ")]], [lap, track, shard, began]


def rotation_stream(frames: DataFrame, idle_s: float = IDLE_S, **how) -> DataFrame:
    """Session starts and ends from a stream of frames."""
    return ordered_stream(frames, Rotation(idle_s), **how)


def lap_event_stream(frames: DataFrame, **how) -> DataFrame:
    """The events of ``lap_events`` from a stream of frames, with the lap's first frame, track and segment."""
    return ordered_stream(frames, Laps(), **how)


def corner_exit_stream(placed: DataFrame, cooldown_s: float = COOLDOWN_S, **how) -> DataFrame:
    """The exits of ``corner_exits`` from a stream of placed frames."""
    return ordered_stream(placed, Exits(cooldown_s), **how)


def fuel_stream(frames: DataFrame, idle_s: float = 60.0, **how) -> DataFrame:
    """The facts of ``fuel_by_lap`` from a stream of frames, as each segment ends."""
    return ordered_stream(frames, Fuel(idle_s), **how)


def shard_stream(frames: DataFrame, flush_s: float = 30.0, **how) -> DataFrame:
    """The frames of a stream in order, each with its shard."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frames.schema).replace("`", "")
    return ordered_stream(frames, Shards(columns, flush_s), **how)
