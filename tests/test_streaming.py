"""Streams: order by event time, late frames, silence, shards under a pointer, and laps that wait for their frames."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacetrace.streaming import detectors as dt
from pacetrace.streaming import jobs, live, ordered
from pacetrace.streaming import shards as sh

SCHEMA = (
    "source_id string, frame_id long, frame_ts timestamp, session_time_s double, arrival_s double, track_name string, vehicle_name string, "
    "lap_number int, lap_time_s double, lap_distance_m double, corner_id int, corner_end_m double, fuel_l double, fuel_capacity_l double, session_type int, race_laps_total int"
)
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def drive(seed=1, n=600, source="a"):
    """Frames of one source: laps of 100 m, corners, silences, a change of track and of car."""
    g = np.random.default_rng(seed)
    clock = np.cumsum(np.where(g.random(n) < 0.01, 7.0, 0.25))
    distance = np.cumsum(g.uniform(0.2, 1.5, n))
    lap = (distance // 100).astype(int)
    here = distance % 100
    corner = np.where((here > 20) & (here < 40), 0, np.where((here >= 40) & (here < 55), 1, np.where((here > 70) & (here < 90), 2, -1)))
    return pd.DataFrame({
        "source_id": source, "frame_id": np.arange(n), "frame_ts": pd.to_datetime((clock * 1e6).round().astype("int64"), unit="us"), "session_time_s": clock, "arrival_s": clock,
        "track_name": np.where(np.arange(n) < n // 2, "one", "two"), "vehicle_name": np.where(np.arange(n) < n // 3, "x", "y"), "lap_number": lap,
        "lap_time_s": here / 10, "lap_distance_m": here, "corner_id": [None if c < 0 else int(c) for c in corner], "corner_end_m": [None if c < 0 else (40.0, 55.0, 90.0)[c] for c in corner],
        "fuel_l": np.where(g.random(n) < 0.05, 0.0, 80 - distance / 40), "fuel_capacity_l": 100.0, "session_type": g.integers(9, 12, n), "race_laps_total": 20,
    })[NAMES]


AS = {"string": str, "long": int, "int": int, "double": float, "timestamp": lambda v: v.to_pydatetime()}
KINDS = [AS[c.split()[1]] for c in SCHEMA.split(", ")]


def frame(spark, pdf):
    rows = [tuple(None if pd.isna(v) else k(v) for k, v in zip(KINDS, r)) for r in pdf.astype(object).itertuples(index=False)]
    return spark.createDataFrame(rows, SCHEMA)


def files(spark, folder, batches):
    """One file a batch, in order."""
    for pdf in batches:
        frame(spark, pdf).coalesce(1).write.mode("append").parquet(str(folder))
        time.sleep(0.05)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(folder))


def tick(seconds):
    row = dict.fromkeys(NAMES)
    return pd.DataFrame([row | {"source_id": "", "frame_ts": pd.Timestamp(int(seconds * 1e6), unit="us")}])[NAMES]


def drained(stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    return q, sorted(tuple(r) for r in stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out").collect())


def in_pieces(detector, pdf, sizes):
    events, state, at = [], list(detector.start), 0
    while at < len(pdf):
        n = int(next(sizes))
        out, state = detector.frames("a", state, pdf.iloc[at : at + n].reset_index(drop=True))
        events += [tuple(r) for r in out.itertuples(index=False)] if isinstance(out, pd.DataFrame) else out
        at += n
    return events + detector.idle("a", state)[0]


@pytest.mark.parametrize("make", [live.Rotation, live.Laps, live.Exits, live.Fuel, lambda: live.Shards("frame_id long", 3.0)])
def test_events_do_not_depend_on_how_frames_are_cut(make):
    pdf = drive()
    g = np.random.default_rng(3)
    whole = in_pieces(make(), pdf, iter([len(pdf)]))
    assert len(whole) > 5
    for top in (2, 7, 90):
        assert in_pieces(make(), pdf, iter(g.integers(1, top + 1, 10_000))) == whole


def test_disorder_late_and_repeated_frames(spark, tmp_path):
    pdf = drive(n=300)
    end = float(pdf.session_time_s.max())
    g = np.random.default_rng(5)
    part = np.clip(np.floor(np.arange(300) / 100 + g.uniform(-0.4, 0.4, 300)), 0, 2)
    late = pdf.iloc[[20]].assign(lap_number=99)
    batches = [pdf[part == i].sample(frac=1, random_state=i) for i in range(3)]
    batches[1] = pd.concat([batches[1], batches[1].iloc[:30]])  # sent twice
    stream = files(spark, tmp_path / "in", [*batches, tick(end + 500), late, tick(end + 600)])
    q, got = drained(live.lap_event_stream(stream, delay="60 seconds"), tmp_path)
    want = in_pieces(live.Laps(), pdf, iter([300]))
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(got, key=key) == sorted(want, key=key)
    assert jobs.late_rows_dropped(q) == 1


def test_exits_start_anew_on_another_track(spark):
    pdf = drive(seed=4)
    batch = dt.corner_exits(frame(spark, pdf), chunk_rows=64).select("frame_id", "exited_corner").collect()
    stream = [(e[1], e[4]) for e in in_pieces(live.Exits(), pdf, iter([50] * 100))]
    assert sorted(map(tuple, batch)) == sorted(stream) and stream
    first_two = int(pdf[(pdf.track_name == "two") & (pdf.lap_number > pdf.lap_number[300])].frame_id.iloc[0])
    assert not [f for f, _ in stream if 300 <= f < first_two]  # silent until a lap is completed there


def wait_for(check, seconds=60):
    end = time.time() + seconds
    while time.time() < end:
        if check():
            return True
        time.sleep(0.5)
    return False


def test_a_silent_source_ends_its_session_by_the_clock(spark, tmp_path):
    stream = files(spark, tmp_path / "in", [drive(n=20)])
    ends = live.rotation_stream(stream, idle_s=2.0, by_clock=True).filter("event = 'closed' and reason = 'idle'")
    q = ends.writeStream.format("memory").queryName("ends").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    try:
        assert wait_for(lambda: spark.table("ends").filter("frame_id = 19").count() == 1)
    finally:
        q.stop()


def test_shards_are_seen_whole_and_once(spark, tmp_path):
    pdf = drive(n=240)
    stream = files(spark, tmp_path / "in", [pdf[:100], pdf[100:], tick(float(pdf.session_time_s.max()) + 100)])
    shards = live.shard_stream(stream, flush_s=5.0, delay="1 second")
    root, trouble = str(tmp_path / "store"), [1]

    def killed():
        if trouble:
            trouble.pop()
            raise RuntimeError("killed between write and commit")

    def run():
        handler = sh.shard_sink(root, killed)
        shards.writeStream.foreachBatch(handler).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()

    with pytest.raises(Exception):
        run()
    assert sh.read_shards(spark, root, shards.schema).count() == 0 and sh.pointer(spark, root)["batch"] == -1
    run()
    rows = sh.read_shards(spark, root, shards.schema)
    assert [r.frame_id for r in rows.orderBy("frame_id").collect()] == list(range(240))
    per = rows.groupBy("shard").agg(F.count_distinct("lap_number").alias("laps"), (F.max("session_time_s") - F.min("session_time_s")).alias("s")).collect()
    assert all(r.laps == 1 and r.s < 5.0 for r in per) and len(per) > 5
    last = sh.pointer(spark, root)["batch"]
    sh.shard_sink(root)(rows, last)  # a replay of a committed batch adds nothing
    assert sh.read_shards(spark, root, shards.schema).count() == 240
    sh.merge_shards(spark, root, shards.schema)
    now = sh.pointer(spark, root)
    assert len(now["versions"]) == 1 and now["batch"] == last
    assert sh.vacuum_shards(spark, root) >= 2  # the folder of the killed run among them
    assert sh.read_shards(spark, root, shards.schema).count() == 240


def test_entries_of_waiting_frames_grow_with_the_frames_not_with_their_time(monkeypatch):
    """Sparse frames of a long time come mixed in many parts; the watermark stops inside entries, and events stay the same."""
    frames = drive(3, 4000).assign(arrival_s=lambda f: f.session_time_s)
    frames[ordered.TIME] = pd.Timestamp(0) + pd.to_timedelta(np.arange(len(frames)) * 4, "s")  # two or three frames a bucket
    mixed = frames.sample(frac=1, random_state=5)
    monkeypatch.setattr(ordered, "HELD_ROWS", 500)
    monkeypatch.setattr(ordered, "ENTRY_ROWS", 100, raising=False)
    states, processor = States(), ordered._EventTime(live.Rotation(), 10_000)
    processor.init(states)
    assert not list(processor.handleInputRows(("a",), iter([mixed.iloc[i : i + 50] for i in range(0, len(mixed), 50)]), Mark(0)))
    assert len(processor.waiting) <= 2 * len(frames) / 100
    got = []
    for ms in (7_777_000, 7_780_000, 12_345_678, 10**9):
        got += list(processor.handleExpiredTimer(("a",), Mark(ms), None))
        assert all(bucket >= ms // 10_000 for bucket, _ in processor.waiting)
    got = pd.concat(got)
    want = pd.DataFrame(live.Rotation().frames("a", live.Rotation.start, frames)[0])
    assert got.iloc[:-1].to_numpy().tolist() == want.to_numpy().tolist() and got.iloc[-1]["frame_id"] == 3999
    assert not processor.waiting


def test_the_frames_of_a_batch_meet_the_laps_around_them(spark, tmp_path):
    """Not all laps of their source: the join of frames and laps has the range of frame numbers among its keys."""
    frames = spark.range(40_000).select(F.lit("a").alias("source_id"), F.col("id").alias("frame_id"), F.lit(0).cast("long").alias("shard"))
    sh.shard_sink(str(tmp_path / "frames"))(frames, 0)
    laps = spark.range(40).select(
        F.lit("a").alias("session_id"), F.col("id").cast("int").alias("segment_index"), (F.col("id") * 1000).alias("start_frame"), (F.col("id") * 1000 + 900).alias("next_start"))
    plans = []

    def analyse(met, batch):
        plans.append(met._jdf.queryExecution().optimizedPlan().toString())
        return met.groupBy("session_id", "segment_index").agg(F.count("*").alias("n"), F.min("frame_id").alias("lo"), F.max("frame_id").alias("hi"))

    jobs.completed_lap_handler(analyse, str(tmp_path / "frames"), frames.schema, str(tmp_path / "facts"))(laps, 0)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "facts")).select("segment_index", "n", "lo", "hi").collect()))
    assert got == [(i, 900, 1000 * i, 1000 * i + 899) for i in range(40)]
    assert "__rb" in plans[0]


def test_laps_wait_for_their_frames_or_for_the_clock(spark, tmp_path):
    events = spark.createDataFrame(
        [("a", 100, "lap_completed", 1, 9.5, 50, "t", 50, 1), ("a", 150, "lap_completed", 2, 9.0, 50, "t", 100, 2), ("b", 70, "lap_completed", 1, 8.0, 70, "t", 0, 0), ("b", 70, "new_lap", 2, None, None, "t", 70, 1)],
        live.Laps.output)
    events.write.parquet(str(tmp_path / "events"))
    logged = spark.readStream.schema(events.schema).parquet(str(tmp_path / "events"))
    root = str(tmp_path / "store")
    spark.createDataFrame([("a", 99, 100)], sh.NOTICE).write.parquet(f"{root}/notices/batch=0")
    ready = jobs.laps_to_analyse(logged, sh.flush_notices(spark, root), wait_ms=20_000)
    q = ready.writeStream.format("memory").queryName("ready").option("checkpointLocation", str(tmp_path / "c")).trigger(processingTime="500 milliseconds").start()
    seen = lambda: {(r.session_id, r.lap_number, r.complete) for r in spark.table("ready").collect()}
    try:
        assert wait_for(lambda: ("a", 1, True) in seen())
        spark.createDataFrame([("a", 149, 50)], sh.NOTICE).write.parquet(f"{root}/notices/batch=1")
        assert wait_for(lambda: ("a", 2, True) in seen())  # no further event of the source
        assert wait_for(lambda: ("b", 1, False) in seen())  # never written: the clock has run out
        assert len(seen()) == 3
    finally:
        q.stop()


class States:
    """A processor's handle whose states are dictionaries; ``written`` counts the bytes put into map states."""

    class Map(dict):
        def __init__(self, owner):
            self.owner = owner

        def updateValue(self, key, value):
            self.owner.written += len(value[0])
            self[key] = value

        def getValue(self, key):
            return self[key]

        def containsKey(self, key):
            return key in self

        def removeKey(self, key):
            del self[key]

    class Value:
        now = None

        def exists(self):
            return self.now is not None

        def get(self):
            return self.now

        def update(self, value):
            self.now = value

    written = 0

    def getMapState(self, *_):
        return self.Map(self)

    def getValueState(self, *_):
        return self.Value()

    def registerTimer(self, _):
        pass


class Mark:
    def __init__(self, ms):
        self.ms = ms

    def getCurrentWatermarkInMs(self):
        return self.ms


def test_waiting_frames_are_written_to_state_once(monkeypatch):
    """Frames of all buckets come mixed, in many batches and some twice; state grows by what comes, and events stay the same."""
    frames = drive(3, 4000).assign(arrival_s=lambda f: f.session_time_s)
    mixed = pd.concat([frames, frames.iloc[::7]]).sample(frac=1, random_state=5)
    batches = [mixed.iloc[i : i + 50] for i in range(0, len(mixed), 50)]
    monkeypatch.setattr(ordered, "HELD_ROWS", 1000, raising=False)
    whole = []
    for n in (1, 2):  # the first half alone, then all
        states, processor = States(), ordered._EventTime(live.Rotation(), 10_000)
        processor.init(states)
        part = batches[: len(batches) * n // 2]
        assert not list(processor.handleInputRows(("a",), iter(part), Mark(0)))
        whole.append(states.written)
    assert whole[1] < 2.2 * whole[0]
    got = pd.concat(processor.handleExpiredTimer(("a",), Mark(10**9), None))
    want = pd.DataFrame(live.Rotation().frames("a", live.Rotation.start, frames)[0])
    end = got.iloc[-1]
    assert got.iloc[:-1].to_numpy().tolist() == want.to_numpy().tolist() and (end["event"], end["frame_id"], end["reason"]) == ("closed", 3999, "idle")
    assert not processor.waiting
