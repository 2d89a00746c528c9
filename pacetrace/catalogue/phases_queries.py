"""Corner phases and lap comparison (inventory rows A14–A23)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import phases as ph
from ..plans import compare as cp
from ..sources.frames import LAP_LENGTH_M
from . import base
from .grid_queries import paired
from .registry import cte, query

K = "session_id segment_index "
C = K + "corner_id "


def events(spark, sf):
    f, laps, refs = paired(spark, sf)
    pairs = cp.pair_laps(laps.filter("status = 'eligible'"), refs, ["track_id"])
    return cp.compare_events(f, pairs, base.corners(spark, sf), LAP_LENGTH_M)


def facts(spark, sf):
    f, laps, refs = paired(spark, sf)
    return cp.compare_laps(f, laps.filter("status = 'eligible'"), refs, base.corners(spark, sf), LAP_LENGTH_M)[1]


cte("c_cb", """SELECT *, CAST(trunc(s_start_m) AS INT) AS c_start, CAST(trunc(apex_s_m) AS INT) AS ax, CAST(trunc(s_end_m) AS INT) AS c_end,
  greatest(0, CAST(trunc(s_start_m - 200) AS INT)) AS bs, greatest(0, CAST(trunc(s_start_m - 200) AS INT), CAST(trunc(entry_floor_m) AS INT)) AS ss FROM (
  SELECT *, coalesce(lag(s_end_m) OVER w, 0e0) AS entry_floor_m, CASE WHEN lead(s_start_m) OVER w > s_start_m THEN lead(s_start_m) OVER w END AS exit_ceiling_m,
    coalesce(lead(s_start_m) OVER w, s_end_m) AS next_start_m, lead(s_start_m) OVER w IS NULL AS is_last_corner FROM c_corners WINDOW w AS (ORDER BY corner_pos))""")
cte("c_cell", """SELECT *, least(ax, n - 1) AS ai, least(c_end + 50, n - 1, coalesce(trunc(exit_ceiling_m)::INT, n - 1)) AS xe FROM c_pair p
  JOIN c_cb c ON p.s_m >= c.bs AND p.s_m <= greatest(c.c_end, c.ax) + 50""")
cte("c_walk", """SELECT *, bool_or(s_m >= ss AND throttle_norm >= 0.9e0) OVER w AS was_full, bool_or(s_m >= ss AND ref_throttle_norm >= 0.9e0) OVER w AS r_full,
  bool_or(brake_norm <= 0.05e0) OVER w AS was_free, bool_or(s_m >= ax AND brake_norm > 0.05e0) OVER w AS braked, bool_or(s_m >= ax AND ref_brake_norm > 0.05e0) OVER w AS r_braked,
  bool_or(s_m >= ax AND throttle_norm < 0.95e0) OVER w AS part, bool_or(s_m >= ax AND ref_throttle_norm < 0.95e0) OVER w AS r_part FROM c_cell
  WINDOW w AS (PARTITION BY session_id, segment_index, corner_id ORDER BY s_m)""")
cte("c_ev0", """SELECT session_id, segment_index, corner_id, min(n) AS n, min(ai) AS ai, min(xe) AS xe,
  min(s_m) FILTER (s_m >= ss AND s_m <= ai AND throttle_norm < 0.9e0 AND was_full) AS lift,
  (min({'v': -speed_kph, 's': s_m}) FILTER (s_m >= ss AND s_m <= ai)).s AS peak,
  min(s_m) FILTER (s_m >= ss AND s_m <= ai AND ref_throttle_norm < 0.9e0 AND r_full) AS r_lift,
  (min({'v': -ref_speed_kph, 's': s_m}) FILTER (s_m >= ss AND s_m <= ai)).s AS r_peak,
  min(s_m) FILTER (s_m <= ai AND brake_norm > 0.05e0 AND was_free) AS brake_point_m,
  min(s_m) FILTER (s_m >= ax AND s_m <= xe AND braked AND brake_norm < 0.01e0) AS xb, min(s_m) FILTER (s_m >= ax AND s_m <= xe AND r_braked AND ref_brake_norm < 0.01e0) AS rxb,
  min(s_m) FILTER (s_m >= ax AND s_m <= xe AND part AND throttle_norm >= 0.95e0) AS xt, min(s_m) FILTER (s_m >= ax AND s_m <= xe AND r_part AND ref_throttle_norm >= 0.95e0) AS rxt,
  (min({'v': speed_kph, 's': s_m}) FILTER (s_m BETWEEN c_start AND c_end)) AS mn, (min({'v': ref_speed_kph, 's': s_m}) FILTER (s_m BETWEEN c_start AND c_end)) AS rmn
FROM c_walk GROUP BY session_id, segment_index, corner_id""")
cte("c_ev1", """SELECT e.*, c.* EXCLUDE (corner_id), CASE WHEN ai <= ss THEN greatest(ss, c_start) ELSE coalesce(lift, peak) END AS entry_m,
  CASE WHEN ai <= ss THEN 'zone_start' WHEN lift IS NOT NULL THEN 'throttle_lift' ELSE 'speed_peak' END AS entry_method,
  CASE WHEN ai <= ss THEN greatest(ss, c_start) ELSE coalesce(r_lift, r_peak) END AS r_entry, mn.v AS dmin, mn.s AS dapex, rmn.v AS rmin, rmn.s AS rapex,
  least(c_end, xe) AS xz FROM c_ev0 e JOIN c_cb c USING (corner_id)""")
cte("c_ev", """SELECT *, CASE WHEN is_last_corner THEN n - 2 ELSE lead(entry_m) OVER (PARTITION BY session_id, segment_index ORDER BY corner_pos) END AS straight_end_m FROM c_ev1""")
cte("c_exit", """SELECT session_id, segment_index, corner_id, unnest(CASE WHEN xb IS NOT NULL AND xt IS NOT NULL AND abs(xb - xt) <= 3
    THEN [{'phase': 'exit', 's': round_even((xb + xt)/2, 0)::INT, 'q': 2}]
  WHEN xb IS NOT NULL AND xt IS NOT NULL THEN [{'phase': 'exit_brake', 's': xb::INT, 'q': 2}, {'phase': 'exit_throttle', 's': xt::INT, 'q': 3}]
  ELSE [{'phase': 'exit', 's': coalesce(xb, xt, xz)::INT, 'q': 2}] END) AS x,
  (rxb IS NOT NULL AND rxt IS NOT NULL AND abs(rxb - rxt) > 3) AS rsplit, rxb, rxt,
  CASE WHEN rxb IS NOT NULL AND rxt IS NOT NULL THEN round_even((rxb + rxt)/2, 0)::INT ELSE coalesce(rxb, rxt, xz)::INT END AS rone, straight_end_m FROM c_ev""")
cte("c_facts", """SELECT f.*, c.corner_name, c.corner_pos, c.apex_s_m, c.target_throttle_pct, c.c_end FROM (
  SELECT e.session_id, e.segment_index, e.corner_id, 'minimum_speed' AS phase, 0 AS phase_seq, coalesce((z.delta_ms - a.delta_ms)/1000, (rmin - dmin)/100) AS loss_s, dmin AS driver_value, rmin AS reference_value,
    CASE WHEN abs(rmin - dmin) > 2 THEN 'high' ELSE 'medium' END AS confidence, NULL::DOUBLE AS phase_distance_m, dapex::DOUBLE AS driver_apex_distance_m, rapex::DOUBLE AS reference_apex_distance_m,
    (rapex - dapex)::DOUBLE AS apex_offset_m, straight_end_m::DOUBLE AS gain_end_distance_m, NULL::DOUBLE AS entry_distance_delta_m, NULL::DOUBLE AS exit_distance_delta_m, NULL::DOUBLE AS reference_phase_distance_m
  FROM c_ev e LEFT JOIN c_pair z ON z.session_id = e.session_id AND z.segment_index = e.segment_index AND z.s_m = e.straight_end_m
  LEFT JOIN c_pair a ON a.session_id = e.session_id AND a.segment_index = e.segment_index AND a.s_m = e.dapex WHERE abs(rmin - dmin) > 0.5e0
  UNION ALL SELECT e.session_id, e.segment_index, e.corner_id, 'entry', 1, coalesce(CASE WHEN entry_m < ax THEN (a.delta_ms - p.delta_ms)/1000 END, (p.ref_speed_kph - p.speed_kph)/100), p.speed_kph, p.ref_speed_kph,
    'medium', entry_m::DOUBLE, NULL, NULL, NULL, ax::DOUBLE, (CASE WHEN r_entry < e.n THEN r_entry - entry_m END)::DOUBLE, NULL, (CASE WHEN r_entry < e.n THEN r_entry END)::DOUBLE
  FROM c_ev e JOIN c_pair p ON p.session_id = e.session_id AND p.segment_index = e.segment_index AND p.s_m = e.entry_m
  LEFT JOIN c_pair a ON a.session_id = e.session_id AND a.segment_index = e.segment_index AND a.s_m = e.ax WHERE abs(p.ref_speed_kph - p.speed_kph) > 1
  UNION ALL SELECT session_id, segment_index, corner_id, ph, q, coalesce((zd - pd)/1000, (pr - pv)/100), pv, pr, 'medium', xs::DOUBLE, NULL, NULL, NULL, straight_end_m::DOUBLE, NULL, (rs - xs)::DOUBLE, rs::DOUBLE FROM (
    SELECT e.*, e.x.phase AS ph, e.x.q AS q, e.x.s AS xs, p.speed_kph AS pv, p.ref_speed_kph AS pr, p.delta_ms AS pd, z.delta_ms AS zd,
      CASE WHEN NOT rsplit THEN rone WHEN e.x.phase = 'exit' THEN CASE WHEN abs(rxb - e.x.s) <= abs(rxt - e.x.s) THEN rxb ELSE rxt END WHEN e.x.phase = 'exit_brake' THEN rxb ELSE rxt END AS rs
    FROM c_exit e JOIN c_pair p ON p.session_id = e.session_id AND p.segment_index = e.segment_index AND p.s_m = e.x.s
    LEFT JOIN c_pair z ON z.session_id = e.session_id AND z.segment_index = e.segment_index AND z.s_m = e.straight_end_m) WHERE abs(pr - pv) > 1
) f JOIN c_cb c USING (corner_id)""")


@query("corner_neighbour_bounds", "A14", "corner_id ~entry_floor_m ~exit_ceiling_m ~next_start_m", "SELECT * FROM c_cb")
def _(spark, sf):
    return ph.corner_bounds(base.corners(spark, sf))


@query("entry_point", "A15", C + "entry_m entry_method", "SELECT * FROM c_ev")
def _(spark, sf):
    return events(spark, sf)


@query("brake_point", "A16", C + "brake_point_m", "SELECT * FROM c_ev")
def _(spark, sf):
    return events(spark, sf)


@query("exit_points", "A17", C + "phase exit_m",
       "SELECT session_id, segment_index, corner_id, x.phase AS phase, x.s AS exit_m FROM c_exit")
def _(spark, sf):
    return ph.exit_points(events(spark, sf)).select("*", F.explode("exits").alias("x")).select(
        "session_id", "segment_index", "corner_id", "x.phase", F.col("x.s_m").alias("exit_m"))


@query("straight_end", "A18", C + "straight_end_m", "SELECT * REPLACE (straight_end_m::INT AS straight_end_m) FROM c_ev")
def _(spark, sf):
    return events(spark, sf).withColumn("straight_end_m", F.col("straight_end_m").cast("int"))


@query("corner_minimum_speed", "A19", C + "~driver_min ~reference_min ~speed_delta driver_apex_m reference_apex_m",
       """SELECT session_id, segment_index, corner_id, dmin AS driver_min, rmin AS reference_min, rmin - dmin AS speed_delta, dapex AS driver_apex_m,
       rapex AS reference_apex_m FROM c_ev""")
def _(spark, sf):
    return events(spark, sf).select(
        "session_id", "segment_index", "corner_id", F.col("min_p.speed_kph").alias("driver_min"),
        F.col("ref_min_p.ref_speed_kph").alias("reference_min"),
        (F.col("ref_min_p.ref_speed_kph") - F.col("min_p.speed_kph")).alias("speed_delta"),
        F.col("min_p.s_m").alias("driver_apex_m"), F.col("ref_min_p.s_m").alias("reference_apex_m"))


@query("corner_phase_facts", "A20",
       C + "corner_name phase ~loss_s ~driver_value ~reference_value confidence ~phase_distance_m ~driver_apex_distance_m ~reference_apex_distance_m "
       "~apex_offset_m ~gain_end_distance_m ~entry_distance_delta_m ~exit_distance_delta_m ~reference_phase_distance_m", "SELECT * FROM c_facts")
def _(spark, sf):
    return facts(spark, sf)


@query("ranked_losses_gains", "A21", C + "phase kind rank ~loss_s",
       """SELECT * FROM (SELECT *, CASE WHEN loss_s > 0 THEN 'loss' ELSE 'gain' END AS kind, row_number() OVER (PARTITION BY session_id, segment_index, loss_s > 0
       ORDER BY abs(loss_s) DESC, corner_pos, phase_seq)::INT AS rank FROM (SELECT * REPLACE (round(loss_s, 9) AS loss_s) FROM c_facts) WHERE loss_s <> 0) WHERE rank <= 3""")
def _(spark, sf):
    return ph.ranked_facts(facts(spark, sf))


@query("compare_laps", "A22", K + "guard ~lap_time_delta_s losses gains ~worst_loss_s",
       """WITH g AS (SELECT l.session_id, l.segment_index, l.duration_s - ref_duration_s AS lap_time_delta_s, CASE WHEN a.lo > 400 THEN 'starts late'
         WHEN a.hi < 3200 THEN 'ends early' WHEN l.duration_s/ref_duration_s > 1.15e0 + 1e-9 THEN 'too slow' ELSE 'ok' END AS guard
         FROM c_laps l JOIN c_ref ON TRUE JOIN (SELECT session_id, segment_index, min(lap_distance_m) AS lo, max(lap_distance_m) AS hi FROM c_seg GROUP BY ALL) a
         USING (session_id, segment_index) WHERE status NOT IN ('incomplete')),
       f AS (SELECT session_id, segment_index, count_if(loss_s > 1e-9) AS losses, count_if(loss_s < -1e-9) AS gains, max(loss_s) AS worst_loss_s FROM c_facts JOIN g USING (session_id, segment_index) WHERE guard = 'ok' GROUP BY ALL)
       SELECT session_id, segment_index, guard, lap_time_delta_s, coalesce(losses, 0)::BIGINT AS losses, coalesce(gains, 0)::BIGINT AS gains, worst_loss_s FROM g
       JOIN c_laps USING (session_id, segment_index) LEFT JOIN f USING (session_id, segment_index) WHERE status = 'eligible'""")
def _(spark, sf):
    f, laps, refs = paired(spark, sf)
    guard, fx = cp.compare_laps(
        f, laps.filter("status = 'eligible'"), refs, base.corners(spark, sf), LAP_LENGTH_M, reject_slow=True)
    n = fx.groupBy("session_id", "segment_index").agg(
        F.count_if(F.col("loss_s") > 1e-9).alias("losses"), F.count_if(F.col("loss_s") < -1e-9).alias("gains"),
        F.max("loss_s").alias("worst_loss_s"))
    zero = F.lit(0).cast("long")
    return guard.join(n, ["session_id", "segment_index"], "left").withColumn(
        "lap_time_delta_s", F.col("duration_s") - F.col("ref_duration_s")).withColumn(
        "losses", F.coalesce("losses", zero)).withColumn("gains", F.coalesce("gains", zero))


@query("corner_exit_alert", "A23", C + "phase ~loss_s",
       """SELECT * FROM (SELECT *, max(CASE WHEN phase = 'minimum_speed' THEN loss_s >= 0.1e0 ELSE loss_s >= 0.05e0 END) OVER (PARTITION BY session_id, segment_index, corner_id) AS sp,
       row_number() OVER (PARTITION BY session_id, segment_index, corner_id ORDER BY loss_s DESC, phase_seq) AS rk FROM (SELECT * REPLACE (round(loss_s, 9) AS loss_s) FROM c_facts) WHERE loss_s > 0) WHERE sp AND rk <= 1""")
def _(spark, sf):
    return ph.exit_alert(facts(spark, sf))


@query("corner_exit_alert_window", "A23", C + "phase ~loss_s",
       """SELECT * FROM (SELECT *, max(CASE WHEN phase = 'minimum_speed' THEN loss_s >= 0.1e0 ELSE loss_s >= 0.05e0 END) OVER (PARTITION BY session_id, segment_index, corner_id) AS sp,
       row_number() OVER (PARTITION BY session_id, segment_index, corner_id ORDER BY loss_s DESC, phase_seq) AS rk FROM (SELECT * REPLACE (round(loss_s, 9) AS loss_s) FROM c_facts) WHERE loss_s > 0) JOIN
       (SELECT session_id, segment_index, k.corner_id FROM c_seg JOIN c_corners k ON lap_distance_m <= s_end_m + 150 GROUP BY ALL HAVING count(*) >= 10) USING (session_id, segment_index, corner_id) WHERE sp AND rk <= 3""")
def _(spark, sf):
    f, laps, refs = paired(spark, sf)
    corners = base.corners(spark, sf)
    found = cp.compare_laps(f, laps.filter("status = 'eligible'"), refs, corners, LAP_LENGTH_M)[1]
    return ph.exit_alert(found, 3, f, corners)
