"""Shared inputs of the queries: frames, segments and laps in Spark, and the same as named SQL subqueries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import laps as lp
from ..operators import segments as sg
from ..sources.frames import corners_from_nation, frames_from_events
from .registry import cte

MIN_ROWS = 20  # rows per lap at which the 100-row minimum of full-rate recordings is set for these tables


def frames(spark: SparkSession, sf: str) -> DataFrame:
    return frames_from_events(spark, sf)


def seg_frames(spark: SparkSession, sf: str) -> DataFrame:
    return sg.with_segments(frames_from_events(spark, sf))


def laps(spark: SparkSession, sf: str) -> DataFrame:
    return lp.classify_laps(seg_frames(spark, sf))


def corners(spark: SparkSession, sf: str) -> DataFrame:
    return corners_from_nation(spark, sf)


cte(
    "c_raw",
    """SELECT *, epoch_us(ts) AS us, epoch_us(ts) % 86400000000 AS od, CAST(dayofmonth(ts) AS BIGINT) AS day,
  CAST(regexp_extract(props,'[0-9]+',0) AS INT) AS k, dayofmonth(ts) + length(event_type) AS j FROM events""",
)
cte(
    "c_frames",
    """SELECT event_type AS session_id, event_id AS frame_id, us/864e6 AS session_time_s,
  CAST(CASE WHEN day <= 15 THEN day-1 ELSE day-16 END AS INT) AS lap_number,
  od/864e6 AS lap_time_s, d AS lap_distance_m, d AS raw_lap_distance_m,
  CASE WHEN j % 5 = 0 AND od BETWEEN 43200000000 AND 45792000000 THEN 0e0 ELSE 8e1 + least(value, 2e2) END AS speed_kph,
  k/1e2 AS throttle_norm, greatest(0, 40-k)/4e1 AS brake_norm, k % 8 AS gear, k*1e2 AS engine_rpm,
  ((event_id % 201)-100)/1e2 AS steering_norm, 1e2 - (day-1)*3e0 - od/864e8*3e0 AS fuel_l, 1.1e2 AS fuel_capacity_l,
  ((event_id*7) % 101 - 50)/1e1 AS path_lateral_m, 6e0 + event_id % 5 AS track_edge_m,
  round(5e2*cos(2*pi()*d/4e3), 6) AS pos_x_m, round(5e2*sin(2*pi()*d/4e3), 6) AS pos_z_m,
  j % 7 <> 0 AS lap_valid,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 3e1 + day % 5 END AS last_sector_1_s,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 6.5e1 + day % 7 END AS last_sector_2_s,
  CASE WHEN j % 2 = 0 THEN 9.97e1 + (day % 4)*1e-1 END AS scoring_last_lap_time_s,
  ((event_id % 201)-100)/1e2*3e0 AS wheel_ground_vel_lat_rl, ((event_id % 201)-100)/1e2*3e0 + 5e-1 AS wheel_ground_vel_lat_rr,
  CASE WHEN j % 5 = 0 AND od BETWEEN 43200000000 AND 45792000000 THEN 0e0 ELSE 8e1 + least(value, 2e2) END/3.6e0 AS wheel_ground_vel_lon_rl,
  CASE WHEN j % 5 = 0 AND od BETWEEN 43200000000 AND 45792000000 THEN 0e0 ELSE 8e1 + least(value, 2e2) END/3.6e0 + 1e-1 AS wheel_ground_vel_lon_rr,
  degrees(atan2(((event_id % 201)-100)/1e2*3e0, CASE WHEN j % 5 = 0 AND od BETWEEN 43200000000 AND 45792000000 THEN 0e0 ELSE 8e1 + least(value, 2e2) END/3.6e0)) AS slip_angle_rl_deg,
  degrees(atan2(((event_id % 201)-100)/1e2*2e0, CASE WHEN j % 5 = 0 AND od BETWEEN 43200000000 AND 45792000000 THEN 0e0 ELSE 8e1 + least(value, 2e2) END/3.6e0 + 1e-1)) AS slip_angle_rr_deg,
  0e0 AS grip_fraction_rl, CASE WHEN k % 10 <> 3 THEN k < 10 END AS tc_active, FALSE AS abs_active,
  CAST(event_id % 4 AS INT) AS surface_type_fl, CASE WHEN event_id % 6 <> 0 THEN CAST(event_id % 3 AS INT) END AS surface_type_fr,
  CAST(event_id % 4 AS INT) AS surface_type_rl, CAST(event_id % 2 AS INT) AS surface_type_rr,
  CAST((length(event_type)*3) % 14 AS INT) AS session_type, 20 AS race_laps_total
FROM (SELECT *, od/864e6*4e1*CASE WHEN j % 11 = 0 THEN 7e-1 ELSE 1e0 END AS d FROM c_raw)""",
)
cte(
    "c_chg",
    """SELECT *, CASE WHEN lag(lap_number) OVER (PARTITION BY session_id ORDER BY frame_id) = lap_number THEN 0 ELSE 1 END AS chg
FROM c_frames""",
)
cte(
    "c_seg",
    """SELECT * EXCLUDE (chg), CAST(sum(chg) OVER (PARTITION BY session_id ORDER BY frame_id) - 1 AS INT) AS segment_index
FROM c_chg""",
)
cte(
    "c_seg1",
    """SELECT *, first_value(session_time_s) OVER (PARTITION BY session_id, segment_index ORDER BY frame_id) AS t0,
  row_number() OVER (PARTITION BY session_id, segment_index ORDER BY frame_id) AS rn FROM c_seg""",
)
cte(
    "c_meas",
    """SELECT session_id, segment_index, min(lap_number) AS lap_number, min(frame_id) AS start_frame, max(frame_id) AS end_frame,
  count(*) AS frames, min(t0) AS first_clock_s, arg_max(session_time_s, frame_id) AS last_clock_s,
  coalesce(max(CASE WHEN lap_time_s > 0 THEN lap_time_s END), 0e0) AS max_lap_time_s,
  max(CASE WHEN scoring_last_lap_time_s > 0 THEN scoring_last_lap_time_s END) AS max_scoring_s,
  min(lap_distance_m) AS min_distance_m, max(lap_distance_m) AS max_distance_m,
  arg_max(lap_distance_m, frame_id) AS last_distance_m,
  max(CASE WHEN session_time_s - t0 < 3 THEN speed_kph END) AS entry_peak_kph,
  bool_or(NOT lap_valid) AS any_invalid, bool_and(lap_valid) AS all_valid FROM c_seg1 GROUP BY ALL""",
)
cte(
    "c_start",
    """SELECT session_id, segment_index, d AS lap_start_s FROM (
  SELECT session_id, segment_index, session_time_s - lap_time_s AS d, count(*) OVER (PARTITION BY session_id, segment_index) AS n,
    row_number() OVER (PARTITION BY session_id, segment_index ORDER BY session_time_s - lap_time_s) AS r FROM c_seg)
WHERE r = n // 2 + 1""",
)
cte(
    "c_lead",
    """SELECT m.*, s.lap_start_s, lead(s.lap_start_s) OVER w - s.lap_start_s AS tel, lead(max_scoring_s) OVER w AS sco
FROM c_meas m JOIN c_start s USING (session_id, segment_index) WINDOW w AS (PARTITION BY m.session_id ORDER BY m.segment_index)""",
)
cte(
    "c_dur",
    """SELECT *, CASE WHEN tel > 0 AND max_lap_time_s > 0 AND abs(tel - max_lap_time_s) <= 1 THEN tel
  WHEN sco IS NOT NULL AND max_lap_time_s > 0 AND abs(sco - max_lap_time_s) <= 1 THEN sco ELSE max_lap_time_s END AS duration_s,
  CASE WHEN tel > 0 AND max_lap_time_s > 0 AND abs(tel - max_lap_time_s) <= 1 THEN 'telemetry'
  WHEN sco IS NOT NULL AND max_lap_time_s > 0 AND abs(sco - max_lap_time_s) <= 1 THEN 'scorer' ELSE 'lap_time' END AS duration_source
FROM c_lead""",
)
cte(
    "c_rate",
    """SELECT session_id, median(frames/(last_clock_s - first_clock_s)) AS rate_hz FROM c_meas
WHERE frames >= 2 AND last_clock_s > first_clock_s GROUP BY session_id""",
)
cte(
    "c_yard",
    """SELECT session_id, coalesce(median(CASE WHEN duration_s > 0 AND segment_index > 0 AND segment_index < li THEN duration_s END),
  median(CASE WHEN duration_s > 0 THEN duration_s END), 0e0) AS yardstick_s
FROM (SELECT *, max(segment_index) OVER (PARTITION BY session_id) AS li FROM c_dur) GROUP BY session_id""",
)
cte("c_trust", "SELECT session_id, count(DISTINCT lap_valid) > 1 AS validity_trusted FROM c_frames GROUP BY session_id")
cte(
    "c_run",
    """SELECT *, sum(x) OVER (PARTITION BY session_id, segment_index ORDER BY frame_id) AS g FROM (
  SELECT session_id, segment_index, frame_id, session_time_s, speed_kph < 3 AS below,
    lead(session_time_s) OVER (PARTITION BY session_id, segment_index ORDER BY frame_id) AS nxt,
    CASE WHEN (speed_kph < 3) = lag(speed_kph < 3) OVER (PARTITION BY session_id, segment_index ORDER BY frame_id) THEN 0 ELSE 1 END AS x
  FROM c_seg)""",
)
cte(
    "c_stat",
    """SELECT session_id, segment_index, max(d) AS stationary_s FROM (
  SELECT session_id, segment_index, g, max(coalesce(nxt, session_time_s)) - min(session_time_s) AS d FROM c_run WHERE below GROUP BY ALL)
GROUP BY ALL""",
)
cte(
    "c_all",
    """SELECT d.*, r.rate_hz, y.yardstick_s, v.validity_trusted, coalesce(st.stationary_s, 0e0) AS stationary_s,
  CASE WHEN last_clock_s > first_clock_s THEN frames/((last_clock_s - first_clock_s)*rate_hz) END AS row_rate,
  max(max_distance_m) OVER (PARTITION BY session_id) AS lap_length_m,
  lag(lap_number) OVER w AS prev_lap_number, lead(lap_number) OVER w IS NULL AS is_last
FROM c_dur d LEFT JOIN c_rate r USING (session_id) JOIN c_yard y USING (session_id) JOIN c_trust v USING (session_id)
LEFT JOIN c_stat st USING (session_id, segment_index) WINDOW w AS (PARTITION BY d.session_id ORDER BY d.segment_index)""",
)
cte(
    "c_status",
    """SELECT *, CASE WHEN is_last THEN 'incomplete' WHEN max_distance_m < lap_length_m*0.8e0 THEN 'incomplete'
  WHEN min_distance_m > lap_length_m*0.1e0 THEN 'incomplete'
  WHEN (segment_index = 0 OR (lap_number = 0 AND prev_lap_number <> 0)) AND coalesce(entry_peak_kph, 0) < 100 THEN 'out-lap'
  WHEN rate_hz > 0 AND duration_s > 0 AND (frames < duration_s*rate_hz/2 OR frames > duration_s*rate_hz*2) THEN 'short'
  WHEN abs(row_rate - 1) > 0.1e0 THEN 'short' WHEN validity_trusted AND any_invalid THEN 'invalid'
  WHEN yardstick_s > 0 AND duration_s/yardstick_s < 0.85e0 THEN 'in-lap' WHEN yardstick_s > 0 AND stationary_s >= 1 THEN 'pit-lap'
  WHEN yardstick_s > 0 AND duration_s/yardstick_s > 1.2e0 THEN 'pit-lap' ELSE 'eligible' END AS status,
  CASE WHEN is_last THEN 'final segment of the session' WHEN max_distance_m < lap_length_m*0.8e0 THEN printf('lap ends at %.0f m', max_distance_m)
  WHEN min_distance_m > lap_length_m*0.1e0 THEN printf('lap starts at %.0f m', min_distance_m)
  WHEN (segment_index = 0 OR (lap_number = 0 AND prev_lap_number <> 0)) AND coalesce(entry_peak_kph, 0) < 100 THEN 'first segment of a stint'
  WHEN rate_hz > 0 AND duration_s > 0 AND (frames < duration_s*rate_hz/2 OR frames > duration_s*rate_hz*2) THEN printf('%d frames for a %.3f s lap', frames, duration_s)
  WHEN abs(row_rate - 1) > 0.1e0 THEN printf('%d rows for a %.1f s span at %.0f Hz (%.2fx expected)', frames, last_clock_s-first_clock_s, rate_hz, row_rate)
  WHEN validity_trusted AND any_invalid THEN 'lap marked invalid by the sim'
  WHEN yardstick_s > 0 AND duration_s/yardstick_s < 0.85e0 THEN printf('duration %.2fx the session yardstick', duration_s/yardstick_s)
  WHEN yardstick_s > 0 AND stationary_s >= 1 THEN printf('stopped for %.1f s', stationary_s)
  WHEN yardstick_s > 0 AND duration_s/yardstick_s > 1.2e0 THEN printf('duration %.2fx the session yardstick', duration_s/yardstick_s) ELSE '' END AS reason
FROM c_all""",
)
cte(
    "c_laps",
    """SELECT *, CASE WHEN validity_trusted AND any_invalid THEN FALSE WHEN validity_trusted AND all_valid THEN TRUE END AS valid_flag,
  status = 'eligible' AND duration_s > 0 AND coalesce(duration_s <= 1.05e0 * min(CASE WHEN status = 'eligible' AND duration_s > 0 THEN duration_s END)
    OVER (PARTITION BY session_id), FALSE) AS clean FROM c_status""",
)
cte(
    "c_sect",
    """SELECT session_id, segment_index - 1 AS segment_index, arg_min(last_sector_1_s, frame_id) AS s1, arg_min(last_sector_2_s, frame_id) AS cum
FROM c_seg1 WHERE rn <= 25 AND last_sector_1_s > 0 AND last_sector_2_s > last_sector_1_s GROUP BY ALL""",
)
cte(
    "c_corners",
    """SELECT 'nation-ring' AS track_id, n_nationkey AS corner_pos, n_nationkey AS corner_id, n_name AS corner_name,
  2e1 + n_nationkey*1.55e2 AS s_start_m, 2e1 + n_nationkey*1.55e2 + 6e1 AS apex_s_m, 2e1 + n_nationkey*1.55e2 + 1.1e2 AS s_end_m,
  CASE WHEN n_nationkey % 2 = 0 THEN 'left' ELSE 'right' END AS apex_side,
  CASE WHEN n_nationkey % 3 = 0 THEN 6e1 END AS target_throttle_pct, 4e3 AS lap_length_m FROM nation""",
)

cte("c_len", "SELECT session_id, max(lap_distance_m) AS track_len FROM c_frames GROUP BY ALL")
cte(
    "c_kept",
    """SELECT s.*, row_number() OVER (PARTITION BY s.session_id, segment_index ORDER BY frame_id) AS pos FROM c_seg s
JOIN c_len USING (session_id) WHERE NOT (lap_time_s < 0 AND lap_distance_m > 2e3) AND NOT (lap_time_s < 0.5e0 AND lap_distance_m > 2e3)""",
)
cte(
    "c_plat",
    """SELECT *, sum(x) OVER (PARTITION BY session_id, segment_index ORDER BY pos) AS g FROM (SELECT *, CASE WHEN lap_time_s =
  lag(lap_time_s) OVER (PARTITION BY session_id, segment_index ORDER BY pos) THEN 0 ELSE 1 END AS x FROM c_kept)""",
)
cte(
    "c_platx",
    """SELECT *, lead(v0) OVER (PARTITION BY session_id, segment_index ORDER BY g) AS v1 FROM (
  SELECT session_id, segment_index, g, min(pos) AS p0, count(*) AS span, min(lap_time_s) AS v0 FROM c_plat GROUP BY session_id, segment_index, g)""",
)
cte(
    "c_smooth",
    """SELECT p.* EXCLUDE (lap_time_s, x), p.lap_time_s + coalesce((v1 - v0)*(pos - p0)/span, 0e0) AS lap_time_s
FROM c_plat p JOIN c_platx USING (session_id, segment_index, g)""",
)
cte(
    "c_pts",
    """SELECT session_id, segment_index, frame_id, lap_distance_m AS x, lap_time_s AS t, speed_kph AS v, throttle_norm AS th, brake_norm AS br,
  lead(lap_distance_m) OVER w AS x1, lead(lap_time_s) OVER w AS t1, lead(speed_kph) OVER w AS v1, lead(throttle_norm) OVER w AS th1,
  lead(brake_norm) OVER w AS br1, row_number() OVER w AS q, max(ceil(lap_distance_m)) OVER (PARTITION BY session_id, segment_index) AS own_max
FROM c_smooth WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY lap_distance_m, frame_id)""",
)
cte(
    "c_ref",
    """SELECT session_id AS ref_session_id, segment_index AS ref_segment_index, duration_s AS ref_duration_s, max_distance_m AS ref_max_m FROM c_laps
WHERE status = 'eligible' ORDER BY duration_s, session_id, segment_index LIMIT 1""",
)
# Every lap on a grid long enough for both itself and the reference; the reference on the longest of all.
cte(
    "c_lim",
    """SELECT session_id, segment_index, greatest(own, CASE WHEN session_id = ref_session_id AND segment_index = ref_segment_index THEN mx ELSE rm END) AS hi_m
FROM (SELECT session_id, segment_index, ceil(max_distance_m) AS own, max(ceil(max_distance_m)) OVER () AS mx FROM c_laps), (SELECT *, ceil(ref_max_m) AS rm FROM c_ref)""",
)
cte(
    "c_cells",
    """SELECT *, unnest(generate_series(CASE WHEN q = 1 THEN 0 ELSE greatest(ceil(x), 0) END::BIGINT,
  CASE WHEN x1 IS NULL THEN hi_m ELSE least(ceil(x1) - 1, hi_m) END::BIGINT)) AS s FROM c_pts JOIN c_lim USING (session_id, segment_index)""",
)
cte(
    "c_grid0",
    """SELECT session_id, segment_index, CAST(s AS INT) AS s_m, """
    + ", ".join(
        f"CASE WHEN q = 1 AND s <= x THEN {a} WHEN x1 IS NULL THEN {a} ELSE {a} + (s - x)/(x1 - x)*({a}1 - {a}) END AS {n}"
        for a, n in (("t", "lap_time_raw"), ("v", "speed_kph"), ("th", "throttle_norm"), ("br", "brake_norm"))
    )
    + " FROM c_cells",
)
cte(
    "c_grid",
    """SELECT *, max(lap_time_raw) OVER (PARTITION BY session_id, segment_index ORDER BY s_m) AS lap_time_s FROM c_grid0""",
)
# The reference lap's value at each metre by a window over the metre, and the boxcar by differences of a running sum: no
# join of the grid with itself.
cte(
    "c_pair0",
    """SELECT *, count(*) OVER (PARTITION BY session_id, segment_index) AS n FROM (
  SELECT *, (lap_time_s - ref_lap_time_s)*1000 AS dt FROM (
    SELECT session_id, segment_index, s_m, lap_time_s, speed_kph, throttle_norm, brake_norm, max(CASE WHEN is_ref THEN lap_time_s END) OVER m AS ref_lap_time_s,
      max(CASE WHEN is_ref THEN speed_kph END) OVER m AS ref_speed_kph, max(CASE WHEN is_ref THEN throttle_norm END) OVER m AS ref_throttle_norm,
      max(CASE WHEN is_ref THEN brake_norm END) OVER m AS ref_brake_norm
    FROM (SELECT g.*, session_id = ref_session_id AND segment_index = ref_segment_index AS is_ref FROM c_grid g JOIN (
      SELECT session_id, segment_index FROM c_laps WHERE status = 'eligible') USING (session_id, segment_index) CROSS JOIN c_ref) WINDOW m AS (PARTITION BY s_m))
  WHERE ref_lap_time_s IS NOT NULL)""",
)
cte(
    "c_cum",
    """SELECT *, sum(dt) OVER (PARTITION BY session_id, segment_index ORDER BY s_m) AS cum, least(20, s_m, n - 1 - s_m) AS r FROM c_pair0""",
)
cte(
    "c_pair",
    """SELECT *, (lead(cum, r) OVER w - coalesce(lag(cum, r + 1) OVER w, 0e0))/(2*r + 1) AS delta_ms FROM c_cum
WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY s_m)""",
)
