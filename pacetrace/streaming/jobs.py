"""Streaming jobs: watermarks, the session sink and the comparison of completed laps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from ..functions.ranges import range_join
from ..functions.storage import materialise
from .ordered import ROCKSDB, STORE
from .shards import read_shards

FLUSH = "30 seconds"
#: A completed lap whose frames are not all written after so long is analysed with those that are.
WAIT_MS = 10_000
#: Frame numbers under which laps are listed to find the lap of a frame.
SPAN_FRAMES = 16_384


def with_arrival_watermark(frames: DataFrame, arrival: str = "arrival_ts", delay: str = "10 seconds") -> DataFrame:
    """Watermark on arrival time.  A zone-free column is cast first, since watermarks need an instant."""
    return frames.withColumn(arrival, F.col(arrival).cast("timestamp")).withWatermark(arrival, delay)


def late_rows_dropped(query: StreamingQuery) -> int:
    """Rows dropped behind the watermark so far: counted, not silently lost."""
    return sum(int(op.get("numRowsDroppedByWatermark", 0)) for p in query.recentProgress for op in p["stateOperators"])


def sessionise(frames: DataFrame, idle: str = "5 seconds", arrival: str = "arrival_ts") -> DataFrame:
    """Idle-gap sessions of each source on a watermarked stream."""
    return frames.groupBy("source_id", F.session_window(arrival, idle).alias("w")).agg(
        F.count(F.lit(1)).alias("frames"), F.min("frame_id").alias("first_frame"), F.max("frame_id").alias("last_frame")).select(
        "source_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "frames", "first_frame", "last_frame")


READY = "session_id string, segment_index int, lap_number int, track_name string, lap_time_s double, start_frame long, next_start long, complete boolean"


class _Pending(StatefulProcessor):
    """Completed laps of a source that wait for their frames to be written, and how far the source is written."""

    def __init__(self, wait_ms: int) -> None:
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.written = handle.getValueState("written", "flushed_to long")
        self.laps = handle.getMapState("laps", "next_start long", "segment_index int, lap_number int, track_name string, lap_time_s double, start_frame long, due long")

    def close(self) -> None:
        pass

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        due = timerValues.getCurrentProcessingTimeInMs() + self.wait_ms
        to = self.written.get()[0] if self.written.exists() else -1
        for pdf in rows:
            flushed = pdf["flushed_to"].dropna()
            to = max(to, int(flushed.max())) if len(flushed) else to
            for r in pdf[pdf["next_start"].notna()].itertuples():
                lap_time = None if pd.isna(r.lap_time_s) else float(r.lap_time_s)
                self.laps.updateValue((int(r.next_start),), (int(r.segment_index), int(r.lap_number), r.track_name, lap_time, int(r.start_frame), due))
                self.handle.registerTimer(due)
        if to >= 0:
            self.written.update((to,))
        yield from self._take(key, lambda next_start, _: next_start - 1 <= to, True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        yield from self._take(key, lambda _, due: due <= now, False)

    def _take(self, key, ready: Callable[[int, int], bool], complete: bool) -> Iterator[pd.DataFrame]:
        out = []
        for (next_start,), lap in list(self.laps.iterator()):
            if ready(next_start, lap[5]):
                self.laps.removeKey((next_start,))
                out.append((key[0], *lap[:5], next_start, complete))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in READY.split(", ")])


def laps_to_analyse(lap_events: DataFrame, notices: DataFrame, wait_ms: int = WAIT_MS) -> DataFrame:
    """Two streams, lap events and flush notices, as one of laps that can be read: as soon as all their frames are written,
    or ``wait_ms`` after their event with ``complete`` false.  Either clock moves on without another event of the source."""
    lap_events.sparkSession.conf.set(STORE, ROCKSDB)
    done = lap_events.filter("event = 'lap_completed'").select(
        "source_id", F.col("frame_id").alias("next_start"), "segment_index", "lap_number", "track_name", "lap_time_s", "start_frame",
        F.lit(None).cast("long").alias("flushed_to"))
    none = {f.name: F.lit(None).cast(f.dataType).alias(f.name) for f in done.schema}
    told = notices.select(*(F.col(c) if c in ("source_id", "flushed_to") else none[c] for c in done.columns))
    return done.unionByName(told).groupBy("source_id").transformWithStateInPandas(_Pending(wait_ms), READY, "Append", "ProcessingTime")


def completed_lap_handler(
    analyse: Callable[[DataFrame, DataFrame], DataFrame], root: str, schema: StructType, out: str
) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` handler: ``analyse(frames, laps)`` of the laps of a batch, from the frames of a shard sink.

    The batch's sources become a filter on partitions and its frame range one on row groups, so only their shards are read,
    and each frame gets the segment of its lap from the event.  Each batch overwrites its own folder, so a replayed batch
    gives the same result once.
    """

    def handle(laps: DataFrame, batch_id: int) -> None:
        spark = laps.sparkSession
        laps = materialise(laps)
        lo, hi, sources = laps.agg(F.min("start_frame"), F.max("next_start"), F.collect_set("session_id")).first()  # of one batch's laps
        if sources:
            frames = read_shards(spark, root, schema).filter(
                F.col("source_id").isin(sources) & (F.col("frame_id") >= lo) & (F.col("frame_id") < hi))
            span = laps.select(F.col("session_id").alias("source_id"), "session_id", "segment_index", "start_frame", "next_start")
            # By source and frame range: a frame meets the laps around it, not all of its source's.
            met = range_join(frames.drop("session_id"), span, ["source_id"], "frame_id", "start_frame", "next_start", include_hi=False, bucket_m=SPAN_FRAMES)
            met = met.drop("start_frame", "next_start")
            analyse(met, laps).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    return handle
