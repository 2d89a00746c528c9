"""Live detection (inventory rows X1–X9): batch forms with SQL, and streams over the same frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise, scratch_path
from ..operators import resolve as rs
from ..operators import segments as sg
from ..plans import compare as cp
from ..sources.frames import LAP_LENGTH_M, TRACK_ID
from ..streaming import detectors as dt
from ..streaming import jobs, live
from ..streaming import shards as sh
from . import base
from .grid_queries import paired
from .registry import cte, query

EVENT = "source_id frame_id event lap_number ~lap_time_s frame_count"


def live_frames(spark, sf):
    """Frames as they reach a recorder: two event types share a source, so its car changes now and then."""
    f = base.frames(spark, sf)
    return f.withColumn("source_id", F.when(F.col("session_id").isin("click", "view"), F.lit("rig")).otherwise(F.col("session_id"))).withColumn(
        "track_name", F.lit("Ring of Nations")).withColumn("vehicle_name", F.when(F.col("session_id") == "view", F.lit("B")).otherwise(F.lit("A"))).withColumn(
        "arrival_s", F.col("session_time_s"))


cte("c_live", """SELECT *, CASE WHEN session_id IN ('click', 'view') THEN 'rig' ELSE session_id END AS source_id, CASE WHEN session_id = 'view' THEN 'B' ELSE 'A' END AS vehicle_name, session_time_s AS arrival_s FROM c_frames""")
cte("c_rot", """SELECT *, CAST(sum(CASE WHEN pv IS NULL OR vehicle_name <> pv OR session_time_s < pc - 30 OR arrival_s - pc >= 5 THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame_id) AS BIGINT) AS session_no,
  pv IS NULL OR vehicle_name <> pv OR session_time_s < pc - 30 OR arrival_s - pc >= 5 AS is_start FROM (SELECT *, lag(vehicle_name) OVER w AS pv, lag(session_time_s) OVER w AS pc FROM c_live WINDOW w AS (PARTITION BY source_id ORDER BY frame_id))""")


@query("session_rotation", "X1", "source_id frame_id session_no", "SELECT * FROM c_rot")
def _(spark, sf):
    return dt.rotate_sessions(live_frames(spark, sf))


SLICES, FILES = 3, 4
#: Frames may come so much later than their turn: what the slices below can disorder.
DELAY = "1000 seconds"


def frame_ts():
    return F.timestamp_micros(F.round(F.col("session_time_s") * 1e6).cast("long"))


def stream_of(spark, frames, cols, shuffled=False, tick_s=7200):
    """The frames as a file stream: time slices that arrive one after the other, each of ``FILES`` files and a micro-batch.

    With ``shuffled`` a frame may come up to a slice early or late.  The last slice is a tick, long after all frames, as a
    recorder sends them when its sources are silent.
    """
    out = scratch_path(spark, "stream")
    ordered = frames.withColumn("frame_ts", frame_ts()).select(*cols, "frame_ts")
    lo, hi, end = frames.agg(F.min("session_time_s"), F.max("session_time_s"), F.max("session_time_s") + tick_s).first()  # three numbers
    part = (F.col("session_time_s") - lo) / (hi - lo) * SLICES
    if shuffled:
        part = part + F.pmod(F.xxhash64("frame_id", "source_id"), F.lit(1000)) / 1000 * 0.8 - 0.4
    dealt = ordered.withColumn("slice", F.least(F.greatest(F.floor(part), F.lit(0)), F.lit(SLICES - 1)))
    for i in range(SLICES):
        dealt.filter(F.col("slice") == i).drop("slice").repartition(FILES).write.mode("append").parquet(out)
    tick = {"source_id": F.lit(""), "frame_ts": F.timestamp_micros(F.lit(int(end * 1e6)))}
    spark.range(FILES).select(*(tick.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in ordered.schema)).repartition(FILES).write.mode("append").parquet(out)
    return spark.readStream.schema(ordered.schema).option("maxFilesPerTrigger", FILES).parquet(out)


def drain(spark, stream):
    """Run a stream over what is there into a written table and read it back."""
    root = scratch_path(spark, "drain")
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{root}/out").option(
        "checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    batches = sum(p["numInputRows"] > 0 for p in q.recentProgress)
    if batches < SLICES:
        raise RuntimeError(f"the stream ran in {batches} micro-batches, not in {SLICES}")
    if jobs.late_rows_dropped(q):
        raise RuntimeError("frames came later than the watermark allows")
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("session_rotation_stream", "X1", "source_id session_no frame_id vehicle_name", "SELECT * FROM c_rot WHERE is_start")
def _(spark, sf):
    starts = live.rotation_stream(stream_of(spark, live_frames(spark, sf), ROTATION_COLS, shuffled=True), delay=DELAY)
    return drain(spark, starts.filter("event = 'started'"))


ROTATION_COLS = ["source_id", "frame_id", "arrival_s", "session_time_s", "track_name", "vehicle_name"]


@query("session_end_stream", "X1 X9", "source_id session_no frame_id vehicle_name reason",
       """SELECT source_id, session_no, frame_id, vehicle_name, CASE WHEN na IS NULL OR na - arrival_s >= 5 THEN 'idle' WHEN nv <> vehicle_name THEN 'changed' ELSE 'restarted' END AS reason
       FROM (SELECT *, lead(arrival_s) OVER w AS na, lead(vehicle_name) OVER w AS nv, lead(is_start) OVER w AS ns FROM c_rot WINDOW w AS (PARTITION BY source_id ORDER BY frame_id)) WHERE coalesce(ns, TRUE)""")
def _(spark, sf):
    ends = live.rotation_stream(stream_of(spark, live_frames(spark, sf), ROTATION_COLS, shuffled=True), delay=DELAY)
    return drain(spark, ends.filter("event = 'closed'"))


cte("c_levent", """WITH m AS (SELECT session_id, segment_index, min(frame_id) AS st, count(*) AS n, arg_max(lap_time_s, frame_id) AS lt, any_value(lap_number) AS lap FROM c_seg GROUP BY ALL),
  x AS (SELECT *, lead(lap) OVER w AS nl, lead(st) OVER w AS ns FROM m WINDOW w AS (PARTITION BY session_id ORDER BY segment_index))
  SELECT session_id AS source_id, st AS frame_id, 'new_lap' AS event, lap AS lap_number, NULL::DOUBLE AS lap_time_s, NULL::BIGINT AS frame_count FROM x
  UNION ALL SELECT session_id, ns, 'lap_completed', lap, lt, n FROM x WHERE nl > lap""")


def one_track(spark, sf):
    return base.frames(spark, sf).withColumn("source_id", F.col("session_id")).withColumn("track_name", F.lit("Ring of Nations"))


@query("lap_events", "X2", EVENT, "SELECT * FROM c_levent")
def _(spark, sf):
    return dt.lap_events(one_track(spark, sf))


LIVE_COLS = ["source_id", "frame_id", "track_name", "lap_number", "lap_time_s", "session_time_s"]


@query("lap_event_stream", "X2", EVENT, "SELECT * FROM c_levent")
def _(spark, sf):
    return drain(spark, live.lap_event_stream(stream_of(spark, one_track(spark, sf), LIVE_COLS, shuffled=True), delay=DELAY))


def placed(spark, sf):
    f = one_track(spark, sf).withColumn("track_id", F.lit(TRACK_ID))
    c = base.corners(spark, sf)
    ends = c.select("track_id", "corner_id", F.col("s_end_m").alias("corner_end_m"))
    return rs.corner_at(f, rs.corner_buckets(c)).join(ends, ["track_id", "corner_id"], "left").select(
        "source_id", "frame_id", "lap_number", "lap_distance_m", "session_time_s", "corner_id", "corner_end_m")


# The cooldown walks the exits of a source in order.
EXITS = """WITH RECURSIVE f AS (SELECT s.session_id, s.frame_id, s.lap_number, s.segment_index, s.lap_distance_m, s.session_time_s, c.corner_id, c.s_end_m FROM c_seg s LEFT JOIN c_corners c ON lap_distance_m BETWEEN s_start_m AND s_end_m),
  p AS (SELECT *, lag(corner_id) OVER w AS pc, lag(s_end_m) OVER w AS pe, lag(lap_number) OVER w AS pl FROM f WINDOW w AS (PARTITION BY session_id ORDER BY frame_id)),
  q AS (SELECT *, sum(CASE WHEN lap_number > pl THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY frame_id) AS done FROM p),
  x AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY frame_id) AS r FROM q WHERE done >= 1 AND lap_number = pl AND pc IS NOT NULL AND (corner_id IS NULL OR (corner_id <> pc AND lap_distance_m >= pe))),
  nx AS MATERIALIZED (SELECT a.session_id, a.r, (SELECT min(b.r) FROM x b WHERE b.session_id = a.session_id AND b.r > a.r AND b.session_time_s - a.session_time_s >= 8) AS nr FROM x a),
  w AS (SELECT session_id, r FROM x WHERE r = 1 UNION ALL SELECT w.session_id, nx.nr FROM w JOIN nx ON nx.session_id = w.session_id AND nx.r = w.r WHERE nx.nr IS NOT NULL)
  SELECT x.session_id AS source_id, frame_id, lap_number, pc AS exited_corner, CASE WHEN corner_id IS NULL THEN lap_distance_m ELSE pe END AS exit_distance_m FROM x JOIN w USING (session_id, r)"""


@query("corner_exits", "X3", "source_id frame_id lap_number exited_corner ~exit_distance_m", EXITS)
def _(spark, sf):
    return dt.corner_exits(placed(spark, sf))


@query("corner_exit_stream", "X3", "source_id frame_id lap_number exited_corner ~exit_distance_m", EXITS)
def _(spark, sf):
    cols = ["source_id", "frame_id", "lap_number", "lap_distance_m", "session_time_s", "corner_id", "corner_end_m"]
    return drain(spark, live.corner_exit_stream(stream_of(spark, placed(spark, sf), cols, shuffled=True), delay=DELAY))


@query("estimated_distance", "X4", "source_id frame_id is_anchor ~estimated_m",
       """WITH f AS (SELECT session_id AS source_id, frame_id, session_time_s/2e1 AS a, floor(session_time_s/4) AS t, floor(lap_distance_m/2e2)*2e2 AS raw, speed_kph/3.6e0 AS v FROM c_frames),
       p AS (SELECT *, lag(a) OVER w AS pa, lag(t) OVER w AS pt, lag(raw) OVER w AS pr FROM f WINDOW w AS (PARTITION BY source_id ORDER BY frame_id)),
       q AS (SELECT *, max(CASE WHEN t <> pt THEN a END) OVER (PARTITION BY source_id ORDER BY frame_id) AS tick FROM p),
       r AS (SELECT *, pa IS NULL OR a - pa <= 0 OR a - pa > 0.5e0 OR NOT coalesce(a - tick < 0.3e0, FALSE) OR raw <> pr AS is_anchor FROM q),
       g AS (SELECT *, sum(CASE WHEN is_anchor THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY frame_id) AS grp FROM r)
       SELECT source_id, frame_id, is_anchor, first_value(raw) OVER w + sum(CASE WHEN is_anchor THEN 0e0 ELSE v*(a - pa) END) OVER w AS estimated_m FROM g WINDOW w AS (PARTITION BY source_id, grp ORDER BY frame_id)""")
def _(spark, sf):
    f = one_track(spark, sf).select(
        "source_id", "frame_id", (F.col("session_time_s") / 2e1).alias("arrival_s"), F.floor(F.col("session_time_s") / 4).alias("session_time_s"),
        (F.floor(F.col("lap_distance_m") / 2e2) * 2e2).alias("raw_distance_m"), (F.col("speed_kph") / 3.6e0).alias("speed_mps"))
    return dt.estimated_distance(f)


@query("completed_lap_analysis", "X5 X7", "session_id segment_index frames ~max_lap_time_s ~top_speed_kph",
       """SELECT session_id, segment_index, count(*) AS frames, max(lap_time_s) AS max_lap_time_s, max(speed_kph) AS top_speed_kph FROM c_seg JOIN (SELECT session_id, segment_index FROM (
       SELECT session_id, segment_index, lap_number, lead(lap_number) OVER (PARTITION BY session_id ORDER BY segment_index) AS nl FROM c_meas) WHERE nl > lap_number) USING (session_id, segment_index) GROUP BY ALL""")
def _(spark, sf):
    def analyse(frames, laps):
        return frames.groupBy(*sg.LAP).agg(
            F.count(F.lit(1)).alias("frames"), F.max("lap_time_s").alias("max_lap_time_s"), F.max("speed_kph").alias("top_speed_kph"))

    return live_laps(spark, one_track(spark, sf), [*LIVE_COLS, "speed_kph"], analyse)


def live_laps(spark, frames, cols, analyse):
    """Laps as they complete: one job commits shards of the frames, one logs lap events, and the third takes both and analyses
    each lap once its frames are committed.  All run until the stream of frames is used up."""
    root = scratch_path(spark, "live")
    stream = stream_of(spark, frames, cols, shuffled=True)
    shards = live.shard_stream(stream, delay=DELAY)
    sh.start_shard_sink(shards, f"{root}/frames", f"{root}/c1", None).awaitTermination()
    events = live.lap_event_stream(stream, delay=DELAY)
    log = events.writeStream.format("parquet").option("path", f"{root}/events").option("checkpointLocation", f"{root}/c0")
    log.trigger(availableNow=True).start().awaitTermination()
    logged = spark.readStream.schema(events.schema).parquet(f"{root}/events")
    laps = jobs.laps_to_analyse(logged, sh.flush_notices(spark, f"{root}/frames"))
    handler = jobs.completed_lap_handler(analyse, f"{root}/frames", shards.schema, f"{root}/facts")
    # Timers of the machine's clock ask for batches without end; here the streams end, so batches without rows are left out.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        done = laps.writeStream.foreachBatch(handler).option("checkpointLocation", f"{root}/c2").trigger(availableNow=True).start()
    finally:
        spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    done.awaitTermination()
    return spark.read.parquet(f"{root}/facts")


@query("completed_lap_comparison", "X5 A22", "session_id segment_index corner_id phase ~loss_s ~driver_value ~reference_value confidence",
       """SELECT f.* FROM c_facts f JOIN (SELECT session_id, segment_index FROM (SELECT session_id, segment_index, lap_number, lead(lap_number) OVER (PARTITION BY session_id ORDER BY segment_index) AS nl FROM c_meas) WHERE nl > lap_number) USING (session_id, segment_index)""")
def _(spark, sf):
    f, inventory, refs = paired(spark, sf)
    refs = materialise(refs)
    lap = [F.col("session_id") == F.col("ref_session_id"), F.col("segment_index") == F.col("ref_segment_index")]
    columns = [*sg.LAP, "frame_id", "lap_number", "lap_time_s", "lap_distance_m", "speed_kph", "throttle_norm", "brake_norm", "session_time_s"]
    ref_frames = materialise(f.join(refs, lap, "left_semi").select(columns))  # what a driver has on file: the reference laps
    corners = base.corners(spark, sf)

    def analyse(frames, laps):
        """Every lap of the batch against the reference of its track; reference laps come along from their file."""
        far = frames.groupBy(*sg.LAP).agg(F.max("lap_distance_m").alias("max_distance_m"))
        own = laps.select(*sg.LAP, F.lit(TRACK_ID).alias("track_id"), F.col("lap_time_s").alias("duration_s")).join(far, sg.LAP)
        on_file = refs.select(F.col("ref_session_id").alias("session_id"), F.col("ref_segment_index").alias("segment_index"), "track_id",
                              F.col("ref_duration_s").alias("duration_s"), F.col("ref_max_m").alias("max_distance_m"))
        here = own.join(on_file.select(*sg.LAP), sg.LAP, "left_anti").unionByName(on_file)
        drive = frames.select(columns).join(on_file.select(*sg.LAP), sg.LAP, "left_anti").unionByName(ref_frames)
        return cp.compare_laps(drive, here, refs, corners, LAP_LENGTH_M)[1].join(own.select(*sg.LAP), sg.LAP, "left_semi")

    facts = live_laps(spark, one_track(spark, sf), [*LIVE_COLS, "lap_distance_m", "speed_kph", "throttle_norm", "brake_norm"], analyse)
    # A live lap is compared whatever its later status; the SQL knows the facts of eligible laps.
    return facts.join(inventory.filter("status = 'eligible'").select(*sg.LAP), sg.LAP, "left_semi")


@query("fuel_by_lap", "X6", "session_id segment_index laps_completed ~end_l ~per_lap_l ~laps_left fuel_status",
       """WITH g AS (SELECT session_id, segment_index, any_value(lap_number) AS lap, arg_min(fuel_l, frame_id) AS f0, arg_max(fuel_l, frame_id) AS end_l FROM c_seg GROUP BY ALL),
       h AS (SELECT *, first_value(f0) OVER w AS s, (SELECT count(DISTINCT k.lap) FROM g k WHERE k.session_id = g.session_id AND k.segment_index <= g.segment_index) AS laps_completed FROM g WINDOW w AS (PARTITION BY session_id ORDER BY segment_index)),
       i AS (SELECT *, CASE WHEN s - end_l > 0 THEN (s - end_l)/laps_completed END AS per_lap_l FROM h), j AS (SELECT *, end_l/per_lap_l AS laps_left FROM i)
       SELECT *, CASE WHEN laps_left IS NULL THEN 'UNKNOWN' WHEN laps_left < 2 THEN 'CRITICAL' WHEN laps_left <= 5 THEN 'WARNING' ELSE 'OK' END AS fuel_status FROM j""")
def _(spark, sf):
    return dt.fuel_by_lap(base.seg_frames(spark, sf))


@query("live_fuel_stream", "X6", "session_id segment_index laps_completed ~end_l ~per_lap_l ~laps_left fuel_status session_code race_laps_left", """WITH g AS (SELECT session_id, segment_index, any_value(lap_number) AS lap,
         arg_min(fuel_l, frame_id) AS f0, arg_max(fuel_l, frame_id) AS end_l, any_value(session_type) AS session_code FROM c_seg GROUP BY ALL),
       h AS (SELECT *, first_value(f0) OVER w AS s, max(lap) OVER w AS mx, (SELECT count(DISTINCT k.lap) FROM g k WHERE k.session_id = g.session_id AND k.segment_index <= g.segment_index) AS laps_completed FROM g WINDOW w AS (PARTITION BY session_id ORDER BY segment_index)),
       i AS (SELECT *, CASE WHEN s - end_l > 0 THEN (s - end_l)/laps_completed END AS per_lap_l FROM h), j AS (SELECT *, end_l/per_lap_l AS laps_left FROM i)
       SELECT *, greatest(0, 20 - mx)::INT AS race_laps_left, CASE WHEN laps_left IS NULL THEN 'UNKNOWN' WHEN laps_left < 2 THEN 'CRITICAL' WHEN laps_left <= 5 THEN 'WARNING' ELSE 'OK' END AS fuel_status FROM j""")
def _(spark, sf):
    cols = ["source_id", "frame_id", "lap_number", "fuel_l", "fuel_capacity_l", "session_type", "race_laps_total", "session_time_s"]
    facts = live.fuel_stream(stream_of(spark, one_track(spark, sf), cols, shuffled=True), idle_s=600, delay=DELAY)
    return drain(spark, facts).withColumnRenamed("source_id", "session_id")


@query("event_routing", "X8", "mode source_id frame_id event top_n max_words",
       "SELECT m AS mode, source_id, frame_id, event, 3 AS top_n, 35 AS max_words FROM c_levent, (SELECT unnest(['lap', 'all']) AS m) WHERE event = 'lap_completed'")
def _(spark, sf):
    e = dt.lap_events(one_track(spark, sf))
    out = None
    for mode in dt.MODES:
        part = dt.route(e, mode).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("corner_exit_routing", "X8 X3", "mode source_id frame_id event top_n max_words", f"SELECT m AS mode, source_id, frame_id, 'corner_exit' AS event, 1 AS top_n, 20 AS max_words FROM ({EXITS}), (SELECT unnest(['turn', 'all']) AS m)")
def _(spark, sf):
    exits = materialise(dt.corner_exits(placed(spark, sf)).withColumn("event", F.lit("corner_exit")))
    out = None
    for mode in dt.MODES:
        part = dt.route(exits, mode).withColumn("mode", F.lit(mode))
        out = part if out is None else out.unionByName(part)
    return out


@query("idle_sessions_stream", "X9 X1", "source_id frames first_frame last_frame",
       """WITH g AS (SELECT session_id, frame_id, us, CASE WHEN us - lag(us) OVER w < 7200000000 THEN 0 ELSE 1 END AS b FROM (SELECT event_type AS session_id, event_id AS frame_id, us FROM c_raw) WINDOW w AS (PARTITION BY session_id ORDER BY frame_id)),
       h AS (SELECT *, sum(b) OVER (PARTITION BY session_id ORDER BY frame_id) AS s FROM g), k AS (SELECT session_id AS source_id, s, count(*) AS frames, min(frame_id) AS first_frame, max(frame_id) AS last_frame, max(us) AS e FROM h GROUP BY session_id, s)
       SELECT * FROM k WHERE e + 7200000000 < (SELECT max(us) FROM g) - 60000000""")
def _(spark, sf):
    f = one_track(spark, sf).withColumn("arrival_ts", F.timestamp_micros(F.round(F.col("session_time_s") * 864e6).cast("long")))
    s = stream_of(spark, f, ["source_id", "frame_id", "arrival_ts", "session_time_s"]).filter("frame_id IS NOT NULL")
    return drain(spark, jobs.sessionise(jobs.with_arrival_watermark(s, delay="1 minute"), "2 hours"))
