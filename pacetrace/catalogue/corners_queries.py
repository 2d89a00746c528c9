"""Corner channels, rear stability and channel quality (inventory rows C1–C17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import corner_channels as cc
from ..operators import phases as ph
from ..plans import compare as cp
from ..sources.frames import LAP_LENGTH_M, TRACK_ID
from . import base
from .grid_queries import paired
from .registry import cte, query

K = "session_id segment_index "
C = K + "corner_id "


def model_windows(spark, sf, f):
    """Windows straight from the corner model, for the single measurements: entry 40 m early, exit 10 m before the end."""
    laps = f.select(*cc.LAP).distinct().withColumn("track_id", F.lit(TRACK_ID))
    return laps.join(ph.corner_bounds(base.corners(spark, sf)), "track_id").select(
        "*", F.col("apex_s_m").alias("apex_m"), (F.col("s_start_m") - 40).alias("entry_m"),
        (F.col("s_end_m") - 10).alias("exit_m"), F.col("s_end_m").alias("straight_end_m"),
        F.lit("corner_model").alias("window_source"))


def analysed(spark, sf):
    """Frames, eligible laps with their reference, written phases that carry a loss or a gain."""
    f, laps, refs = paired(spark, sf)
    _, facts = cp.compare_laps(f, laps.filter("status = 'eligible'"), refs, base.corners(spark, sf), LAP_LENGTH_M)
    phases = materialise(facts.withColumn("loss_s", F.round("loss_s", 9)).filter("loss_s <> 0"))
    pairs = cp.pair_laps(laps.filter("status = 'eligible'"), refs, ["track_id"])
    return f, laps, pairs, phases


def driver_corners(spark, sf):
    f, laps, pairs, phases = analysed(spark, sf)
    w = materialise(cc.driver_windows(pairs, base.corners(spark, sf), phases))
    return f, laps, pairs, phases, w


cte("c_phases", "SELECT * REPLACE (round(loss_s, 9) AS loss_s) FROM c_facts WHERE round(loss_s, 9) <> 0")
cte("c_win_model", """SELECT l.session_id, l.segment_index, c.*, apex_s_m AS apex_m, s_start_m - 40 AS entry_m, s_end_m - 10 AS exit_m, s_end_m AS straight_end_m,
  'corner_model' AS window_source FROM c_meas l, c_cb c""")
cte("c_win", """SELECT l.session_id, l.segment_index, c.*, p.entry_m, coalesce(p.a, c.apex_s_m) AS apex_m, p.exit_m, greatest(c.s_end_m, coalesce(p.g, 0)) AS straight_end_m,
  CASE WHEN p.g IS NULL THEN 'corner_model' ELSE 'phases' END AS window_source
FROM (SELECT * FROM c_laps WHERE status = 'eligible') l CROSS JOIN c_cb c LEFT JOIN (SELECT session_id, segment_index, corner_id,
  max(phase_distance_m) FILTER (phase = 'entry') AS entry_m, max(driver_apex_distance_m) AS a, max(phase_distance_m) FILTER (phase LIKE 'exit%') AS exit_m, max(gain_end_distance_m) AS g
  FROM c_phases GROUP BY ALL) p ON p.session_id = l.session_id AND p.segment_index = l.segment_index AND p.corner_id = c.corner_id""")


def measured_ctes(win: str, tag: str) -> None:
    """Corner measurements over the windows in ``win``, as subqueries named with ``tag``."""
    cte(f"c_smp{tag}", f"""SELECT f.*, w.corner_id, w.s_start_m, w.s_end_m, w.entry_m, w.apex_m, w.exit_m, w.straight_end_m, w.next_start_m,
      lap_distance_m BETWEEN s_start_m AND s_end_m AS zn, CASE WHEN entry_m < apex_m THEN lap_distance_m BETWEEN entry_m AND apex_m ELSE lap_distance_m BETWEEN s_start_m AND s_end_m END AS bz,
      least(coalesce(exit_m, s_end_m), s_end_m, next_start_m, straight_end_m) AS bnd, greatest(abs(slip_angle_rl_deg), abs(slip_angle_rr_deg)) AS slip,
      abs(lap_distance_m - apex_m) AS ga, abs(lap_distance_m - exit_m) AS gx
      FROM c_seg f JOIN {win} w ON f.session_id = w.session_id AND f.segment_index = w.segment_index AND lap_distance_m BETWEEN s_start_m - 400 AND s_end_m + 400""")
    cte(f"c_steer{tag}", f"""SELECT session_id, segment_index, corner_id, max(n) AS n, count_if(sg <> sg0) AS rev, stddev_pop(rate) AS sd FROM (
      SELECT *, lag(sg) OVER (PARTITION BY session_id, segment_index, corner_id ORDER BY frame_id) AS sg0 FROM (
      SELECT *, sign(st) AS sg, CASE WHEN sp > 0 THEN st/sp END AS rate FROM (
      SELECT *, steering_norm - lag(steering_norm) OVER w AS st, lap_distance_m - lag(lap_distance_m) OVER w AS sp, count(*) OVER (PARTITION BY session_id, segment_index, corner_id) AS n
      FROM c_smp{tag} WHERE zn WINDOW w AS (PARTITION BY session_id, segment_index, corner_id ORDER BY frame_id)) WHERE abs(st) >= 0.02e0)) GROUP BY session_id, segment_index, corner_id""")
    cte(f"c_area{tag}", f"""SELECT session_id, segment_index, corner_id, CASE WHEN count(*) >= 2 THEN coalesce(sum(CASE WHEN sp > 0 THEN (b0 + brake_norm)/2*sp END), 0e0) END AS area FROM (
      SELECT *, lag(brake_norm) OVER w AS b0, lap_distance_m - lag(lap_distance_m) OVER w AS sp FROM c_smp{tag} WHERE entry_m < apex_m AND lap_distance_m BETWEEN entry_m AND apex_m
      WINDOW w AS (PARTITION BY session_id, segment_index, corner_id ORDER BY frame_id)) GROUP BY session_id, segment_index, corner_id""")
    cte(f"c_chan{tag}", f"""WITH g AS (SELECT session_id, segment_index, corner_id, count_if(zn) AS zr, min(gear) FILTER (zn AND gear > 0) AS gear_min,
      arg_min(gear, (ga, frame_id)) FILTER (gear <> 0 AND ga <= 20) AS ga20, arg_min(gear, (gx, frame_id)) FILTER (gear <> 0 AND gx <= 20) AS gx20,
      max(brake_norm) FILTER (bz) AS brake_peak, min(lap_distance_m) FILTER (lap_distance_m > apex_m AND lap_distance_m <= bnd AND brake_norm <= 0.05e0) AS rel,
      max(slip) FILTER (zn) AS slip_max, arg_min(slip, (gx, frame_id)) FILTER (gx <= 5) AS slip_exit, avg(tc_active::INT) FILTER (zn) AS tc_duty, avg(abs_active::INT) FILTER (zn) AS abs_duty,
      arg_min(path_lateral_m, (ga, frame_id)) FILTER (ga <= 5) AS lateral_at_apex_m FROM c_smp{tag} GROUP BY session_id, segment_index, corner_id),
      fb AS (SELECT session_id, segment_index, min(lap_distance_m) AS fb FROM c_seg WHERE brake_norm > 0.05e0 GROUP BY ALL),
      nz AS (SELECT session_id, segment_index, corner_id, count(*) AS nz FROM c_smp{tag} WHERE zn GROUP BY ALL)
      SELECT w.session_id, w.segment_index, w.corner_id, w.corner_pos, w.corner_name, w.apex_s_m, w.apex_m, w.window_source, gear_min::INT AS gear_min, CASE WHEN zr > 0 THEN ga20::INT END AS gear_at_apex,
      CASE WHEN zr > 0 THEN gx20::INT END AS gear_at_exit, brake_peak, area AS brake_area, CASE WHEN brake_peak >= 0.1e0 AND fb <= w.apex_m THEN greatest(0e0, rel - w.apex_m) END AS trail0,
      rel, CASE WHEN nz >= 3 THEN coalesce(rev, 0)::INT END AS steering_reversals, CASE WHEN nz >= 3 THEN sd END AS steering_rate_std, slip_max, slip_exit, tc_duty, abs_duty, lateral_at_apex_m,
      CASE WHEN rel IS NOT NULL AND brake_peak >= 0.1e0 AND fb <= w.apex_m THEN greatest(0e0, rel - w.apex_m) END AS trail_brake_depth_m
      FROM {win} w LEFT JOIN g USING (session_id, segment_index, corner_id) LEFT JOIN c_steer{tag} USING (session_id, segment_index, corner_id)
      LEFT JOIN c_area{tag} USING (session_id, segment_index, corner_id) LEFT JOIN fb USING (session_id, segment_index) LEFT JOIN nz USING (session_id, segment_index, corner_id)""")


measured_ctes("c_win_model", "_m")
measured_ctes("c_win", "_d")

PROFILE = """WITH a AS (SELECT session_id, count(*) AS n, count(tc_active) AS tk, bool_or(tc_active) AS ta, count(abs_active) AS ak, bool_or(abs_active) AS aa,
  max(abs(slip_angle_rl_deg)) AS rl, max(abs(slip_angle_rr_deg)) AS rr FROM c_frames GROUP BY ALL)
SELECT * FROM (SELECT session_id, unnest(['tc_active', 'abs_active', 'slip_angle_rl_deg', 'slip_angle_rr_deg']) AS channel, unnest([
  CASE WHEN tk < n*0.5e0 THEN printf('only %d of %d samples are recorded, so a duty cannot be computed', tk, n) WHEN NOT coalesce(ta, FALSE) THEN 'never active in this session (dead channel or unused)' END,
  CASE WHEN ak < n*0.5e0 THEN printf('only %d of %d samples are recorded, so a duty cannot be computed', ak, n) WHEN NOT coalesce(aa, FALSE) THEN 'never active in this session (dead channel or unused)' END,
  CASE WHEN NOT coalesce(rl <= 60, FALSE) THEN 'not a tyre slip angle: the value wraps or exceeds the sane range' END,
  CASE WHEN NOT coalesce(rr <= 60, FALSE) THEN 'not a tyre slip angle: the value wraps or exceeds the sane range' END]) AS reason FROM a) WHERE reason IS NOT NULL"""
cte("c_refused", PROFILE)


@query("unmeasurable_channels", "C1 P10", "session_id channel reason", "SELECT * FROM c_refused")
def _(spark, sf):
    return cc.unmeasurable_channels(base.frames(spark, sf))


cte("c_slip", """SELECT *, CASE WHEN abs((wheel_ground_vel_lon_rl + wheel_ground_vel_lon_rr)*0.5e0) >= 1e-6 THEN
  degrees(atan2((wheel_ground_vel_lat_rl + wheel_ground_vel_lat_rr)*0.5e0, abs((wheel_ground_vel_lon_rl + wheel_ground_vel_lon_rr)*0.5e0))) END AS rear_slip FROM c_seg""")


@query("rear_slip_series", "C2", "session_id frame_id ~rear_slip_deg", "SELECT session_id, frame_id, rear_slip AS rear_slip_deg FROM c_slip")
def _(spark, sf):
    return base.frames(spark, sf).withColumn("rear_slip_deg", cc.rear_slip_angle())


@query("dead_channels", "C3", "session_id channel reason",
       """SELECT session_id, channel, CASE WHEN channel = 'grip_fraction_rr' THEN 'channel absent from this recording' ELSE 'constant 0.0 in every sample of this recording' END AS reason
       FROM (SELECT DISTINCT session_id FROM c_frames), (SELECT unnest(['grip_fraction_rl', 'grip_fraction_rr']) AS channel)""")
def _(spark, sf):
    return cc.dead_channels(base.frames(spark, sf))


@query("driver_corner_windows", "C4", C + "~entry_m ~apex_m ~exit_m ~straight_end_m ~next_start_m window_source", "SELECT * FROM c_win")
def _(spark, sf):
    f, laps, pairs, phases = analysed(spark, sf)
    return cc.driver_windows(pairs, base.corners(spark, sf), phases)


cte("c_win_ref", """SELECT c.corner_id, p.entry_m, coalesce(p.a, c.apex_s_m) AS apex_m, p.exit_m, coalesce(p.g, c.s_end_m) AS straight_end_m, c.next_start_m,
  CASE WHEN p.g IS NULL THEN 'corner_model' ELSE 'reference_phases' END AS window_source FROM c_cb c LEFT JOIN (SELECT corner_id,
  median(reference_phase_distance_m) FILTER (phase = 'entry') AS entry_m, median(reference_apex_distance_m) AS a, median(reference_phase_distance_m) FILTER (phase LIKE 'exit%') AS exit_m,
  max(gain_end_distance_m) AS g FROM c_phases GROUP BY ALL) p USING (corner_id)""")


@query("reference_corner_windows", "C5", "corner_id ~entry_m ~apex_m ~exit_m ~straight_end_m ~next_start_m window_source", "SELECT * FROM c_win_ref")
def _(spark, sf):
    f, laps, pairs, phases = analysed(spark, sf)
    refs = pairs.filter("is_reference").select("track_id", *cp.REF)
    return cc.reference_windows(refs, base.corners(spark, sf), phases)


def _model(spark, sf):
    f = base.seg_frames(spark, sf)
    return cc.corner_channels(f, model_windows(spark, sf, f))


for _name, _ids, _cols in (
    ("nearest_sample", "C6", "~lateral_at_apex_m ~rear_slip_exit_deg"),
    ("engaged_gear", "C7", "gear_min gear_at_apex gear_at_exit"),
    ("flag_duty", "C8", "~tc_duty ~abs_duty"),
    ("brake_and_trail", "C10 C11", "~brake_peak ~brake_area ~trail_brake_depth_m"),
):
    query(_name, _ids, C + _cols, "SELECT *, slip_exit AS rear_slip_exit_deg FROM c_chan_m")(_model)


@query("steering_stats", "C9", C + "steering_reversals ~steering_rate_std",
       "SELECT * FROM c_chan_m WHERE steering_reversals IS NOT NULL OR session_id IN (SELECT session_id FROM c_frames)")
def _(spark, sf):
    return _model(spark, sf)


@query("corner_channels", "C12", C + "window_source gear_min gear_at_apex gear_at_exit ~brake_peak ~brake_area ~trail_brake_depth_m steering_reversals "
       "~steering_rate_std ~rear_slip_max_deg ~rear_slip_exit_deg ~tc_duty ~abs_duty ~lateral_at_apex_m ~lateral_offset_m",
       """WITH rl AS (SELECT w.session_id, w.segment_index, w.corner_id, arg_min(path_lateral_m, (abs(lap_distance_m - apex_m), frame_id)) AS v FROM c_win w JOIN c_ref ON TRUE
         JOIN c_seg f ON f.session_id = ref_session_id AND f.segment_index = ref_segment_index AND abs(lap_distance_m - apex_m) <= 5 GROUP BY ALL),
       r AS (SELECT session_id, list(channel) AS ch FROM c_refused GROUP BY ALL)
       SELECT d.* EXCLUDE (tc_duty, abs_duty), CASE WHEN NOT coalesce(list_contains(ch, 'tc_active'), FALSE) THEN tc_duty END AS tc_duty, CASE WHEN NOT coalesce(list_contains(ch, 'abs_active'), FALSE) THEN abs_duty END AS abs_duty,
       CASE WHEN NOT coalesce(list_has_any(ch, ['slip_angle_rl_deg', 'slip_angle_rr_deg']), FALSE) THEN slip_max END AS rear_slip_max_deg,
       CASE WHEN NOT coalesce(list_has_any(ch, ['slip_angle_rl_deg', 'slip_angle_rr_deg']), FALSE) THEN slip_exit END AS rear_slip_exit_deg, lateral_at_apex_m - v AS lateral_offset_m
       FROM c_chan_d d LEFT JOIN rl USING (session_id, segment_index, corner_id) LEFT JOIN r USING (session_id)""")
def _(spark, sf):
    f, laps, pairs, phases, w = driver_corners(spark, sf)
    return cc.corner_channels(f, w, cc.unmeasurable_channels(f), pairs)


cte("c_rear", """WITH z AS (SELECT f.*, w.corner_id, w.apex_m, w.s_end_m, CASE WHEN coalesce(entry_m, s_start_m) >= apex_m THEN s_start_m ELSE coalesce(entry_m, s_start_m) END AS fm,
    coalesce(surface_type_rl = 0, TRUE) AS tr FROM c_slip f JOIN c_win w ON f.session_id = w.session_id AND f.segment_index = w.segment_index AND lap_distance_m BETWEEN s_start_m AND s_end_m),
  y AS (SELECT * FROM (SELECT *, bool_or(tr) OVER (PARTITION BY session_id, segment_index, corner_id) AS ht FROM z) WHERE tr OR NOT ht),
  v AS (SELECT session_id, segment_index, corner_id, count(*) AS n, count_if(abs(rear_slip) > 45) AS ins, count_if(ok) AS smp,
    list_sort(list(abs(rear_slip)) FILTER (ok)) AS pk, list_sort(list(abs(rear_slip)) FILTER (ok AND lap_distance_m >= fm AND brake_norm > 0.05e0)) AS bk,
    median(abs(rear_slip)) FILTER (ok AND abs(lap_distance_m - apex_m) <= 15) AS am, count_if(ok AND abs(lap_distance_m - apex_m) <= 15) AS an
    FROM (SELECT *, coalesce(abs(rear_slip) <= 45 AND NOT coalesce(speed_kph < 30, FALSE), FALSE) AS ok FROM y) GROUP BY session_id, segment_index, corner_id)
  SELECT w.session_id, w.segment_index, w.corner_id, CASE WHEN rs IS NULL AND an >= 5 THEN am END AS rear_slip_apex_deg,
    CASE WHEN rs IS NULL AND len(bk) >= 5 THEN bk[round_even(0.95e0*(len(bk)-1), 0)::INT + 1] END AS rear_slip_braking_deg,
    CASE WHEN rs IS NULL THEN pk[round_even(0.95e0*(len(pk)-1), 0)::INT + 1] END AS rear_slip_peak_deg, coalesce(smp/n, 0e0) AS rear_slip_coverage, rs AS slip_reason
  FROM c_win w LEFT JOIN (SELECT *, FALSE AS x FROM v) q USING (session_id, segment_index, corner_id) LEFT JOIN LATERAL (SELECT CASE WHEN q.n IS NULL THEN 'no samples inside the corner window'
    WHEN q.ins/q.n > 0.1e0 THEN 'spin or off-track samples' WHEN q.smp = 0 THEN 'no valid sample' WHEN q.smp/q.n < 0.6e0 THEN 'low coverage' END AS rs) ON TRUE""")


@query("corner_rear_slip", "C13", C + "~rear_slip_apex_deg ~rear_slip_braking_deg ~rear_slip_peak_deg ~rear_slip_coverage slip_reason", "SELECT * FROM c_rear")
def _(spark, sf):
    f, laps, pairs, phases, w = driver_corners(spark, sf)
    return cc.corner_rear_slip(f, w)


cte("c_clean", "SELECT session_id, segment_index, lap_number, duration_s, clean FROM c_laps WHERE status = 'eligible'")
cte("c_gearmode", """SELECT session_id, corner_id, gear_at_apex FROM (SELECT session_id, corner_id, gear_at_apex, row_number() OVER (PARTITION BY session_id, corner_id
  ORDER BY count(*) DESC, min(segment_index)) AS r FROM c_chan_d JOIN c_clean USING (session_id, segment_index) WHERE clean AND gear_at_apex > 0
  GROUP BY session_id, corner_id, gear_at_apex) WHERE r = 1""")
cte("c_rep", """SELECT session_id, corner_id, any_value(corner_name) AS corner_name, any_value(corner_pos) AS corner_pos, any_value(d.apex_s_m) AS apex_s_m, median(trail_brake_depth_m) AS trail_brake_depth_m, median(lateral_at_apex_m) AS lateral_at_apex_m,
  any_value(g.gear_at_apex) AS gear_at_apex FROM c_chan_d d JOIN c_clean USING (session_id, segment_index) LEFT JOIN c_gearmode g USING (session_id, corner_id) WHERE clean GROUP BY session_id, corner_id""")


@query("representative_corners", "C14", "session_id corner_id gear_at_apex ~trail_brake_depth_m ~lateral_at_apex_m", "SELECT * FROM c_rep")
def _(spark, sf):
    f, laps, pairs, phases, w = driver_corners(spark, sf)
    clean = w.join(pairs.filter("clean").select(*cc.LAP), cc.LAP, "left_semi")
    return cc.representative_corners(cc.corner_channels(f, clean))


cte("c_stab", """WITH s AS (SELECT r.*, c.lap_number, c.clean FROM c_rear r JOIN c_clean c USING (session_id, segment_index)),
  b AS (SELECT session_id, corner_id, count_if(clean)::BIGINT AS clean_laps, count_if(clean AND rear_slip_apex_deg IS NOT NULL)::BIGINT AS measured_laps,
    median(rear_slip_apex_deg) FILTER (clean) AS base FROM s GROUP BY ALL),
  t AS (SELECT *, measured_laps > 0 AND measured_laps >= 0.6e0*clean_laps AS ok, greatest(3e0, 1.5e0*base) AS th FROM b),
  f AS (SELECT session_id, corner_id, count(*) AS flagged, arg_max({'a': round(rear_slip_apex_deg, 2), 'b': round(rear_slip_braking_deg, 2), 's': segment_index, 'l': lap_number, 'c': s.clean},
    {'a': round(rear_slip_apex_deg, 2), 'o': -segment_index}) AS w FROM s JOIN t USING (session_id, corner_id) WHERE ok AND rear_slip_apex_deg >= th GROUP BY ALL)
  SELECT session_id, corner_id, CASE WHEN NOT ok THEN 'unknown' WHEN flagged > 0 THEN 'measured_instability' ELSE 'no_detected_instability' END AS state, clean_laps, measured_laps,
    CASE WHEN ok THEN base END AS baseline_deg, CASE WHEN ok THEN th END AS threshold_deg, coalesce(flagged, 0)::BIGINT AS flagged, w.a AS value_deg, w.b AS braking_deg, w.s AS worst_segment,
    w.l AS worst_lap, w.c AS worst_clean, coalesce(w.b >= th, FALSE) AS brake_overlap, CASE WHEN clean_laps = 0 THEN 'no clean lap measured this corner' WHEN measured_laps = 0 THEN 'no valid rear-slip sample on any clean lap'
    WHEN NOT ok THEN printf('measurable on only %d of %d clean laps', measured_laps, clean_laps) END AS reason FROM t LEFT JOIN f USING (session_id, corner_id)""")


@query("rear_stability", "C15", "session_id corner_id state clean_laps measured_laps ~baseline_deg ~threshold_deg flagged ~value_deg ~braking_deg worst_segment brake_overlap reason",
       "SELECT * FROM c_stab")
def _(spark, sf):
    f, laps, pairs, phases, w = driver_corners(spark, sf)
    slips = cc.corner_rear_slip(f, w).join(pairs.select(*cc.LAP, "lap_number", "clean"), cc.LAP)
    return cc.rear_stability(slips, cc.dead_channels(f))


@query("apex_metrics", "C16 P5", C + "corner_name ~apex_at_m ~timing_error_m ~edge_distance_m apex_surface",
       """SELECT session_id, segment_index, corner_id, corner_name, r.d AS apex_at_m, r.d - apex_s_m AS timing_error_m, r.e AS edge_distance_m, r.s AS apex_surface FROM (
       SELECT session_id, segment_index, corner_id, any_value(corner_name) AS corner_name, any_value(apex_s_m) AS apex_s_m, arg_min({'d': raw_lap_distance_m, 'e': track_edge_m - abs(path_lateral_m),
         's': CASE WHEN apex_side = 'left' THEN coalesce(surface_type_fl, surface_type_rl) ELSE coalesce(surface_type_fr, surface_type_rr) END}, (abs(raw_lap_distance_m - apex_s_m), frame_id)) AS r
       FROM c_seg JOIN c_corners ON raw_lap_distance_m BETWEEN s_start_m AND s_end_m GROUP BY session_id, segment_index, corner_id)""")
def _(spark, sf):
    f = base.seg_frames(spark, sf).withColumn("track_id", F.lit(TRACK_ID))
    return cc.apex_metrics(f, base.corners(spark, sf))


@query("apex_input_status", "C17", "session_id status reason",
       """SELECT session_id, CASE WHEN length(session_id) = 5 THEN 'not_configured' WHEN NOT bool_or(k) THEN 'unavailable' ELSE 'ok' END AS status,
       CASE WHEN length(session_id) <> 5 AND NOT bool_or(k) THEN 'missing edge distance inputs' END AS reason FROM (SELECT session_id, session_id <> 'signup' AS k FROM c_frames) GROUP BY session_id""")
def _(spark, sf):
    f = base.frames(spark, sf).withColumn("track_edge_m", F.when(F.col("session_id") != "signup", F.col("track_edge_m")))
    have = f.select("session_id").distinct().withColumn("has_annotations", F.length("session_id") != 5)
    return cc.apex_input_status(f, have)
