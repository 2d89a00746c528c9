"""Metre grid and time differences (inventory rows A1–A13)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import grid as gr
from ..operators import laps as lp
from ..plans import compare as cp
from ..sources.frames import LAP_LENGTH_M, TRACK_ID
from . import base
from .registry import cte, query

K = "session_id segment_index "


def kept(spark, sf):
    """Segment frames without boundary samples."""
    f = base.seg_frames(spark, sf)
    return gr.strip_boundary(gr.strip_stale(f, F.lit(LAP_LENGTH_M)), F.lit(LAP_LENGTH_M))


def paired(spark, sf):
    """Frames, inventory and reference of the comparison queries.

    The frames are written: a dozen steps read them, and expressions over the bridge's columns would be repeated in each.
    """
    f = materialise(base.seg_frames(spark, sf))
    laps = materialise(lp.classify_laps(f).withColumn("track_id", F.lit(TRACK_ID)))
    return f, laps, cp.fastest_eligible(laps, ["track_id"])


def aligned(spark, sf):
    f, laps, refs = paired(spark, sf)
    pairs = cp.pair_laps(laps.filter("status = 'eligible'"), refs, ["track_id"])
    return cp.align_laps(f, pairs, LAP_LENGTH_M), f, laps, refs


cte("c_own", """SELECT *, unnest(generate_series(CASE WHEN q = 1 THEN 0 ELSE greatest(ceil(x), 0) END::BIGINT,
  CASE WHEN x1 IS NULL THEN own_max ELSE least(ceil(x1) - 1, own_max) END::BIGINT)) AS s FROM c_pts""")


def lerp(a: str, name: str) -> str:
    return f"CASE WHEN q = 1 AND s <= x THEN {a} WHEN x1 IS NULL THEN {a} ELSE {a} + (s - x)/(x1 - x)*({a}1 - {a}) END AS {name}"


@query("metre_grid", "A1", K + "s_m ~speed_kph ~throttle_norm ~brake_norm",
       f"SELECT session_id, segment_index, s::INT AS s_m, {lerp('v', 'speed_kph')}, {lerp('th', 'throttle_norm')}, {lerp('br', 'brake_norm')} FROM c_own")
def _(spark, sf):
    return gr.resample(kept(spark, sf), gr.LAP, ["speed_kph", "throttle_norm", "brake_norm"])


cte("c_hold", """SELECT * EXCLUDE (lap_time_s), floor(lap_time_s*2)/2 AS lap_time_s FROM c_seg""")
cte("c_hold1", """SELECT *, row_number() OVER w AS pos, CASE WHEN lap_time_s = lag(lap_time_s) OVER w THEN 0 ELSE 1 END AS x FROM c_hold
  WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY frame_id)""")
cte("c_hold2", "SELECT *, sum(x) OVER (PARTITION BY session_id, segment_index ORDER BY frame_id) AS g FROM c_hold1")


@query("clock_smoothing", "A2", K + "frame_id ~lap_time_s",
       """WITH r AS (SELECT session_id, segment_index, g, min(pos) AS p0, count(*) AS span, min(lap_time_s) AS v0 FROM c_hold2 GROUP BY session_id, segment_index, g),
       x AS (SELECT *, lead(v0) OVER (PARTITION BY session_id, segment_index ORDER BY g) AS v1 FROM r)
       SELECT h.session_id, h.segment_index, h.frame_id, lap_time_s + coalesce((v1 - lap_time_s)*(pos - p0)/span, 0e0) AS lap_time_s
       FROM c_hold2 h JOIN x USING (session_id, segment_index, g)""")
def _(spark, sf):
    held = base.seg_frames(spark, sf).withColumn("lap_time_s", F.floor(F.col("lap_time_s") * 2) / 2)
    return gr.smooth_clock(held)


@query("neutral_bridging", "A3", K + "frame_id gear",
       """WITH a AS (SELECT *, CASE WHEN gear = lag(gear) OVER w THEN 0 ELSE 1 END AS x, lag(gear) OVER w AS pg FROM c_seg
         WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY frame_id)),
       b AS (SELECT *, sum(x) OVER (PARTITION BY session_id, segment_index ORDER BY frame_id) AS g FROM a),
       r AS (SELECT *, max(g) OVER (PARTITION BY session_id, segment_index) AS gm FROM (SELECT session_id, segment_index, g, count(*) AS n,
         arg_min(pg, frame_id) AS before FROM b GROUP BY session_id, segment_index, g))
       SELECT b.session_id, b.segment_index, b.frame_id, CASE WHEN b.gear = 0 AND n <= 5 AND r.g > 1 AND r.g < gm THEN before ELSE b.gear END AS gear
       FROM b JOIN r USING (session_id, segment_index, g)""")
def _(spark, sf):
    return gr.bridge_neutral(base.seg_frames(spark, sf))


@query("forward_clamp", "A4", K + "s_m ~lap_time_s",
       f"""SELECT session_id, segment_index, s_m, max(z) OVER (PARTITION BY session_id, segment_index ORDER BY s_m) AS lap_time_s FROM (
       SELECT session_id, segment_index, s::INT AS s_m, {lerp('t', 'z')} FROM c_own)""")
def _(spark, sf):
    return gr.forward_clamp(gr.resample(kept(spark, sf), gr.LAP, ["lap_time_s"]))


@query("delta_trace", "A5", K + "s_m ~delta_ms", "SELECT session_id, segment_index, s_m, dt AS delta_ms FROM c_pair0")
def _(spark, sf):
    f, laps, refs = paired(spark, sf)
    pairs = cp.pair_laps(laps.filter("status = 'eligible'"), refs, ["track_id"])
    return cp.paired_grid(f, pairs, LAP_LENGTH_M, ["lap_time_s"])


@query("boxcar_smoothing", "A6", K + "s_m ~speed_kph",
       f"""WITH g AS (SELECT session_id, segment_index, s AS s_m, {lerp('v', 'speed_kph')} FROM c_own),
       c AS (SELECT *, count(*) OVER (PARTITION BY session_id, segment_index) AS n FROM g),
       d AS (SELECT *, sum(speed_kph) OVER (PARTITION BY session_id, segment_index ORDER BY s_m) AS cum, least(20, s_m, n - 1 - s_m) AS r FROM c)
       SELECT session_id, segment_index, s_m::INT AS s_m, (lead(cum, r) OVER w - coalesce(lag(cum, r + 1) OVER w, 0e0))/(2*r + 1) AS speed_kph FROM d
       WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY s_m)""")
def _(spark, sf):
    return gr.boxcar(gr.resample(kept(spark, sf), gr.LAP, ["speed_kph"]), "speed_kph")


@query("lap_alignment", "A7 P8 P9", K + "s_m ~delta_ms ~speed_kph ~ref_speed_kph ~throttle_norm ~ref_throttle_norm ~brake_norm ~ref_brake_norm",
       "SELECT * FROM c_pair")
def _(spark, sf):
    return aligned(spark, sf)[0]


@query("overlap_window", "A8", K + "~overlap_start_m overlap_end_m",
       """SELECT l.session_id, l.segment_index, greatest(l.min_distance_m, r.min_distance_m) AS overlap_start_m,
       least(ceil(l.max_distance_m), ceil(r.max_distance_m))::INT AS overlap_end_m FROM c_meas l JOIN c_ref ON TRUE
       JOIN c_meas r ON r.session_id = ref_session_id AND r.segment_index = ref_segment_index""")
def _(spark, sf):
    f, laps, refs = paired(spark, sf)
    return gr.overlap_window(f, laps.join(refs, "track_id").select(*gr.LAP, *cp.REF))


@query("channel_lookup", "A9", K + "~target_s_m ~speed_kph ~throttle_norm",
       """SELECT session_id, segment_index, target_s_m, CASE WHEN lx IS NULL THEN rv WHEN rx IS NULL THEN lv ELSE lv + (target_s_m - lx)/(rx - lx)*(rv - lv) END AS speed_kph,
       CASE WHEN lx IS NULL THEN rt WHEN rx IS NULL THEN lt ELSE lt + (target_s_m - lx)/(rx - lx)*(rt - lt) END AS throttle_norm FROM (
       SELECT session_id, segment_index, apex_s_m + 0.25e0 AS target_s_m,
         max(CASE WHEN lap_distance_m < apex_s_m + 0.25e0 THEN lap_distance_m END) AS lx, min(CASE WHEN lap_distance_m >= apex_s_m + 0.25e0 THEN lap_distance_m END) AS rx,
         arg_max(speed_kph, lap_distance_m) FILTER (lap_distance_m < apex_s_m + 0.25e0) AS lv, arg_min(speed_kph, lap_distance_m) FILTER (lap_distance_m >= apex_s_m + 0.25e0) AS rv,
         arg_max(throttle_norm, lap_distance_m) FILTER (lap_distance_m < apex_s_m + 0.25e0) AS lt, arg_min(throttle_norm, lap_distance_m) FILTER (lap_distance_m >= apex_s_m + 0.25e0) AS rt
       FROM c_seg, c_corners GROUP BY ALL)""")
def _(spark, sf):
    f = base.seg_frames(spark, sf).withColumn("track_id", F.lit(TRACK_ID))
    targets = base.corners(spark, sf).select("track_id", (F.col("apex_s_m") + 0.25).alias("target_s_m"))
    return gr.lookup(f, targets, ["track_id", *gr.LAP], ["track_id"], ["speed_kph", "throttle_norm"])


@query("sector_distances", "A10", K + "~sector_1_m ~sector_2_m",
       """WITH p AS (SELECT *, lag(lap_time_s) OVER w AS t0, lag(lap_distance_m) OVER w AS d0 FROM c_seg WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY frame_id)),
       q AS (SELECT session_id, segment_index, frame_id, lap_time_s AS t, lap_distance_m AS d, coalesce(t0, lap_time_s) AS t0, coalesce(d0, lap_distance_m) AS d0, s1, cum
         FROM p JOIN c_sect USING (session_id, segment_index))
       SELECT session_id, segment_index, arg_min(d0 + CASE WHEN t0 = t THEN 0 ELSE (s1 - t0)/(t - t0) END*(d - d0), frame_id) FILTER (t >= s1) AS sector_1_m,
       arg_min(d0 + CASE WHEN t0 = t THEN 0 ELSE (cum - t0)/(t - t0) END*(d - d0), frame_id) FILTER (t >= cum) AS sector_2_m FROM q GROUP BY ALL""")
def _(spark, sf):
    from ..operators import segments as sg

    f = base.seg_frames(spark, sf)
    d = sg.durations(sg.segment_measures(f), sg.lap_start_clock(f))
    splits = sg.sector_times(f, d).filter("sector_1_s IS NOT NULL").select(
        *gr.LAP, F.col("sector_1_s").alias("split_1_s"), F.col("sector_2_cum_s").alias("split_2_s"))
    return gr.sector_distances(f, splits)


@query("distance_step", "A11", K + "~median_step_m coarse",
       """WITH s AS (SELECT session_id, segment_index, lap_distance_m - lag(lap_distance_m) OVER (PARTITION BY session_id, segment_index ORDER BY frame_id) AS d FROM c_seg),
       l AS (SELECT session_id, segment_index, list_sort(list(d) FILTER (d > 0)) AS ds FROM s GROUP BY ALL)
       SELECT session_id, segment_index, coalesce(ds[len(ds)//2 + 1], 0e0) AS median_step_m, coalesce(ds[len(ds)//2 + 1], 0e0) > 2 AS coarse FROM l""")
def _(spark, sf):
    return gr.distance_step(base.seg_frames(spark, sf))


@query("monotonic_distance_check", "A12", "session_id frame_id ~wrapped_m ~prev_wrapped_m",
       """SELECT session_id, frame_id, w AS wrapped_m, p AS prev_wrapped_m FROM (SELECT session_id, frame_id, w, lag(w) OVER (PARTITION BY session_id, segment_index
       ORDER BY frame_id) AS p FROM (SELECT *, lap_distance_m - 5e2*floor(lap_distance_m/5e2) AS w FROM c_seg)) WHERE w <= p""")
def _(spark, sf):
    d = F.col("lap_distance_m")
    f = base.seg_frames(spark, sf).withColumn("lap_distance_m", d - 5e2 * F.floor(d / 5e2))
    return gr.backward_steps(f).select(
        "*", F.col("lap_distance_m").alias("wrapped_m"), F.col("prev_distance_m").alias("prev_wrapped_m"))


@query("visible_box", "A13", K + "~min_x ~max_x ~min_z ~max_z",
       """WITH p AS (SELECT session_id, segment_index, lap_distance_m AS x, pos_x_m AS a, pos_z_m AS b, lead(lap_distance_m) OVER w AS x1, lead(pos_x_m) OVER w AS a1,
         lead(pos_z_m) OVER w AS b1, row_number() OVER w AS q, max(ceil(lap_distance_m)) OVER (PARTITION BY session_id, segment_index) AS own_max FROM c_kept
         WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY lap_distance_m, frame_id)),
       c AS (SELECT *, unnest(generate_series(CASE WHEN q = 1 THEN 0 ELSE ceil(x) END::BIGINT, CASE WHEN x1 IS NULL THEN own_max ELSE ceil(x1) - 1 END::BIGINT)) AS s FROM p),
       g AS (SELECT session_id, segment_index, s, """ + lerp("a", "pa") + ", " + lerp("b", "pb") + """ FROM c)
       SELECT session_id, segment_index, min(pa) FILTER (s BETWEEN 500 AND 1500) AS min_x, max(pa) FILTER (s BETWEEN 500 AND 1500) AS max_x,
       min(pb) FILTER (s BETWEEN 500 AND 1500) AS min_z, max(pb) FILTER (s BETWEEN 500 AND 1500) AS max_z FROM g GROUP BY ALL""")
def _(spark, sf):
    g = gr.resample(kept(spark, sf), gr.LAP, ["pos_x_m", "pos_z_m"]).withColumn("track_id", F.lit(TRACK_ID))
    ranges = base.corners(spark, sf).groupBy("track_id").agg(F.lit(1500.2).alias("from_m"), F.lit(499.7).alias("to_m"))
    return gr.visible_box(g, ranges)
