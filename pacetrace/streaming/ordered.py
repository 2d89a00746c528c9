"""Event-time order for stateful detectors: frames wait in keyed state until the watermark has passed them.

A detector is a ``Detector``: plain rules over frames in order and a few scalars of state.  ``ordered_stream`` feeds it, per
source, with frames sorted by ``frame_id`` whatever the order they came in.  The frames that wait are a map state of Arrow
buffers: what comes is only added, as new parts of up to ``HELD_ROWS`` rows, each in entries of at least ``ENTRY_ROWS`` rows of
consecutive time buckets, so that entries grow with the frames, however long a time they span.  A frame is written and read once, but
for entries that the watermark stands in, the rest of which is written again.  In memory are the rows of a flush, or of the few
buckets that the detector is fed with at once.
Frames behind the watermark are dropped and counted (``late_rows_dropped``), repeated frames are taken once.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: The frame's own time; it never falls while ``frame_id`` grows.
TIME = "frame_ts"
BUCKET_MS = 10_000
#: Rows of a source that are gathered before they are written to state, and about as many go to the detector at once.
HELD_ROWS = 100_000
#: Rows of an entry of the state at least, where a part has as many.
ENTRY_ROWS = 1_000


class Detector:
    """Rules over the ordered frames of one source.

    ``output`` is the schema of the events.  State is a JSON-able list; ``start`` is what a new source has.
    """

    output: str = ""
    start: list = []
    #: After so many milliseconds without a frame, by event time or by the clock, ``idle`` is called once.
    idle_ms: int | None = None

    def frames(self, source: str, state: list, pdf: pd.DataFrame) -> tuple[list[tuple] | pd.DataFrame, list]:
        """Events of frames in order, and the state after them."""
        raise NotImplementedError

    def idle(self, source: str, state: list) -> tuple[list[tuple], list]:
        """Events of a source that has fallen silent, and the state after that."""
        return [], state


def _pack(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpack(raw: bytes) -> pa.Table:
    return pa.ipc.open_stream(raw).read_all()


class _Processor(StatefulProcessor):
    """What the two clocks share: the detector's state and its events."""

    def __init__(self, detector: Detector) -> None:
        self.detector = detector
        self.columns = [c.split()[0] for c in detector.output.split(", ")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("detector", "state string, last_frame long, last_ms long")

    def close(self) -> None:
        pass

    def _load(self) -> tuple[list, int, int | None]:
        if not self.state.exists():
            return list(self.detector.start), -1, None
        state, frame, ms = self.state.get()
        return json.loads(state), frame, ms

    def _save(self, state: list, frame: int, ms: int | None) -> None:
        self.state.update((json.dumps(state), frame, ms))

    def _events(self, rows: list[tuple] | pd.DataFrame) -> pd.DataFrame:
        return rows if isinstance(rows, pd.DataFrame) else pd.DataFrame(rows, columns=self.columns).astype(object)


class _EventTime(_Processor):
    def __init__(self, detector: Detector, bucket_ms: int) -> None:
        super().__init__(detector)
        self.bucket_ms = bucket_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.waiting = handle.getMapState("waiting", "bucket long, part long", "rows binary, n long")
        self.parts = handle.getValueState("parts", "n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for pdf in rows:
            pdf = pdf[pdf["frame_id"].notna()]  # a tick only moves the watermark
            if len(pdf):
                held.append(pdf)
                n += len(pdf)
            if n >= HELD_ROWS:
                self._hold(held)
                held, n = [], 0
        if held:
            self._hold(held)
        yield from self._release(key, timerValues)

    def _hold(self, held: list[pd.DataFrame]) -> None:
        """Add frames to those that wait, as a further part."""
        pdf = held[0] if len(held) == 1 else pd.concat(held)
        bucket = self._buckets(pdf[TIME])
        order = np.argsort(bucket, kind="stable")
        bucket = bucket[order]
        table = pa.Table.from_pandas(pdf.iloc[order], preserve_index=False)
        part = self.parts.get()[0] if self.parts.exists() else 0
        for a, b in _entries(bucket):
            self.waiting.updateValue((int(bucket[a]), part), (_pack(table.slice(a, b - a)), b - a))
        self.parts.update((part + 1,))

    def _buckets(self, time: pd.Series) -> np.ndarray:
        return time.astype("datetime64[ms]").astype("int64").to_numpy() // self.bucket_ms

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._release(key, timerValues)

    def _release(self, key, timerValues) -> Iterator[pd.DataFrame]:
        """Feed what lies behind the watermark, bucket after bucket, and ask to be called for the next one."""
        mark = timerValues.getCurrentWatermarkInMs()
        state, last, ms = self._load()
        end = mark // self.bucket_ms  # the first bucket that the watermark hasn't passed
        entries = sorted(self.waiting.keys())
        ready = [e for e in entries if e[0] < end]
        coming = [b for b, _ in entries[len(ready) :]]
        for tables, numbers in self._groups(ready, end, coming):
            pdf = _in_order(tables, numbers, last)
            if len(pdf):
                rows, state = self.detector.frames(key[0], state, pdf)
                # Frames of the last bucket count, as the silence goes on from there.
                last, ms = int(pdf["frame_id"].iloc[-1]), math.ceil(pdf.loc[pdf[_BUCKET] == pdf[_BUCKET].iloc[-1], TIME].max().timestamp() * 1000)
                if len(rows):
                    yield self._events(rows)
        idle = self.detector.idle_ms
        # Silent only if no frame waits that may end the silence in time.
        if idle and ms is not None and mark >= ms + idle and not any(b * self.bucket_ms < ms + idle for b in coming):
            rows, state = self.detector.idle(key[0], state)
            ms = None
            if rows:
                yield self._events(rows)
        if last >= 0:
            self._save(state, last, ms)
        if coming:
            self.handle.registerTimer((min(coming) + 1) * self.bucket_ms)
        elif idle and ms is not None:
            self.handle.registerTimer(ms + idle)

    def _groups(self, ready: list[tuple[int, int]], end: int, coming: list[int]) -> Iterator[tuple[list[pa.Table], list[np.ndarray]]]:
        """Frames of consecutive whole buckets before ``end``, about ``HELD_ROWS`` at a time and part by part, and the bucket of each.

        Entries are taken out of the state; what they have from ``end`` on goes back, and its first bucket into ``coming``.
        """
        held: list[tuple[int, pa.Table, np.ndarray]] = []
        n = 0
        for i, (bucket, part) in enumerate(ready):
            raw, rows = self.waiting.getValue((bucket, part))
            self.waiting.removeKey((bucket, part))
            table = _unpack(raw)
            at = self._buckets(table.column(TIME).to_pandas())
            k = int(np.searchsorted(at, end))
            if k < rows:
                self.waiting.updateValue((int(at[k]), part), (_pack(table.slice(k)), rows - k))
                coming.append(int(at[k]))
            held.append((part, table.slice(0, k), at[:k]))
            n += k
            until = ready[i + 1][0] if i + 1 < len(ready) else end  # no further entry has buckets before it
            if until > bucket and (n >= HELD_ROWS or until == end):
                held.sort(key=lambda h: h[0])
                cuts = [int(np.searchsorted(a, until)) for _, _, a in held]
                yield [t.slice(0, c) for (_, t, _), c in zip(held, cuts)], [a[:c] for (_, _, a), c in zip(held, cuts)]
                held = [(p, t.slice(c), a[c:]) for (p, t, a), c in zip(held, cuts) if c < len(a)]
                n -= sum(cuts)


def _entries(bucket: np.ndarray) -> Iterator[tuple[int, int]]:
    """First row and row after the last of runs of whole buckets, of ``ENTRY_ROWS`` rows or more but for the last."""
    starts, a = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), 0
    while a < len(bucket):
        i = int(np.searchsorted(starts, a + ENTRY_ROWS))
        b = int(starts[i]) if i < len(starts) else len(bucket)
        yield a, b
        a = b


#: Where the bucket of a frame stands while frames are put in order.
_BUCKET = "waiting bucket"


def _in_order(tables: list[pa.Table], numbers: list[np.ndarray], last: int) -> pd.DataFrame:
    """The frames of consecutive buckets, each bucket's by ``frame_id`` and each frame once, as it came first, without those
    that are not beyond the frames of the buckets before and ``last``."""
    pdf = pa.concat_tables(tables, promote_options="permissive").to_pandas()
    bucket = np.concatenate(numbers)
    frame = pdf["frame_id"].to_numpy().astype("int64")
    order = np.lexsort((frame, bucket))  # of equal ones the earlier part stays first
    bucket, frame = bucket[order], frame[order]
    first = np.append(True, bucket[1:] != bucket[:-1])
    once = np.append(True, first[1:] | (frame[1:] != frame[:-1]))
    at = np.flatnonzero(first)
    ends = frame[np.append(at[1:], len(frame)) - 1]
    before = np.maximum.accumulate(np.append(last, ends))[:-1]
    keep = once & (frame > before[np.cumsum(first) - 1])
    return pdf.iloc[order[keep]].reset_index(drop=True).assign(**{_BUCKET: bucket[keep]})


class _Clock(_Processor):
    """Frames as they come, in order inside a micro-batch; silence by the clock of the machine."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, last, ms = self._load()
        for pdf in rows:
            pdf = pdf[pdf["frame_id"].notna() & (pdf["frame_id"] > last)].sort_values("frame_id").drop_duplicates("frame_id")
            if len(pdf):
                out, state = self.detector.frames(key[0], state, pdf.reset_index(drop=True))
                last = int(pdf["frame_id"].iloc[-1])
                if len(out):
                    yield self._events(out)
        if last >= 0:
            ms = timerValues.getCurrentProcessingTimeInMs()
            self._save(state, last, ms)
            if self.detector.idle_ms:
                self.handle.registerTimer(ms + self.detector.idle_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, last, ms = self._load()
        if ms is not None and expiredTimerInfo.getExpiryTimeInMs() >= ms + self.detector.idle_ms:  # no frame since it was set
            rows, state = self.detector.idle(key[0], state)
            self._save(state, last, None)
            if rows:
                yield self._events(rows)


def ordered_stream(frames: DataFrame, detector: Detector, delay: str = "10 seconds", bucket_ms: int = BUCKET_MS, by_clock: bool = False) -> DataFrame:
    """The detector's events from a stream of frames that may be out of order by up to ``delay``.

    Needs ``source_id``, ``frame_id``, ``frame_ts`` (a timestamp that grows with ``frame_id``) and the detector's columns.
    Rows without ``frame_id`` are ticks: they move the watermark when all sources are silent.  With ``by_clock`` nothing
    waits: frames are taken as they come and idle time is that of the machine's clock.  State is kept in RocksDB.
    """
    frames.sparkSession.conf.set(STORE, ROCKSDB)
    stamped = frames.withColumn(TIME, F.col(TIME).cast("timestamp"))
    if by_clock:
        return stamped.groupBy("source_id").transformWithStateInPandas(_Clock(detector), detector.output, "Append", "ProcessingTime")
    marked = stamped.withWatermark(TIME, delay)
    return marked.groupBy("source_id").transformWithStateInPandas(_EventTime(detector, bucket_ms), detector.output, "Append", "EventTime")
