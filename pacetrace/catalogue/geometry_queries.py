"""Track geometry and corner-model building (inventory rows T1–T19, S15)."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.storage import materialise, scratch_path
from ..operators import corner_channels as cc
from ..operators import geometry as geo
from ..operators import grid as gr
from ..operators import track_model as tm
from ..sources import documents as dc
from ..sources.frames import LAP_LENGTH_M, TRACK_ID
from . import base
from .grid_queries import kept, lerp, paired
from .registry import cte, query

K = "session_id segment_index "
BIN_M = 5.0


def track_frames(spark, sf):
    """All frames on the one track; some stretches lose a side or every sample, to exercise the gap rules."""
    f = base.frames(spark, sf).withColumn("track_id", F.lit(TRACK_ID))
    b = F.floor(F.col("raw_lap_distance_m") / BIN_M)
    gap = ((b % 50) < (b / 50).cast("int") % 14) | ((b % 90 < 6) & (F.col("path_lateral_m") < 0))
    return f.withColumn("raw_lap_distance_m", F.when(~gap, F.col("raw_lap_distance_m")))


cte("c_tf", """SELECT * REPLACE (CASE WHEN NOT ((b % 50) < trunc(b/50)::INT % 14 OR (b % 90 < 6 AND path_lateral_m < 0)) THEN raw_lap_distance_m END AS raw_lap_distance_m)
  FROM (SELECT *, floor(raw_lap_distance_m/5e0)::BIGINT AS b FROM c_frames)""")
cte("c_prof", """SELECT *, CASE WHEN greatest(left_samples, right_samples) = 0 THEN 'missing' WHEN least(left_samples, right_samples) = 0 THEN 'one-sided' WHEN least(left_samples, right_samples) < 3 THEN 'low-sample' ELSE 'complete' END AS status,
  CASE WHEN greatest(left_samples, right_samples) = 0 THEN 0e0 WHEN least(left_samples, right_samples) = 0 THEN 0.5e0 WHEN least(left_samples, right_samples) < 3 THEN 0.75e0 ELSE 1e0 END AS confidence FROM (
  SELECT g.b*5e0 AS s_m, coalesce(l, 0e0) AS left_width_m, coalesce(r, 0e0) AS right_width_m, coalesce(lc, 0)::BIGINT AS left_samples, coalesce(rc, 0)::BIGINT AS right_samples
  FROM (SELECT unnest(generate_series(min(floor(raw_lap_distance_m/5e0))::BIGINT, max(floor(raw_lap_distance_m/5e0))::BIGINT)) AS b FROM c_tf) g LEFT JOIN (
    SELECT floor(raw_lap_distance_m/5e0)::BIGINT AS b, max(abs(track_edge_m)) FILTER (path_lateral_m < 0) AS l, max(abs(track_edge_m)) FILTER (path_lateral_m >= 0) AS r, count_if(path_lateral_m < 0) AS lc,
      count_if(path_lateral_m >= 0) AS rc FROM c_tf WHERE raw_lap_distance_m IS NOT NULL GROUP BY ALL) USING (b))""")


def profile(spark, sf):
    return geo.width_profile(track_frames(spark, sf), BIN_M)


@query("width_profile", "T1", "~s_m ~left_width_m ~right_width_m left_samples right_samples status ~confidence", "SELECT * FROM c_prof")
def _(spark, sf):
    return profile(spark, sf)


cte("c_gap", """SELECT *, row_number() OVER (ORDER BY s_m) AS i, count(*) OVER () AS n FROM c_prof""")
cte("c_gap2", """SELECT *, max(CASE WHEN status <> 'missing' THEN i END) OVER (ORDER BY s_m) AS ai, min(CASE WHEN status <> 'missing' THEN i END) OVER (ORDER BY s_m ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS zi FROM c_gap""")
cte("c_gap3", """SELECT g.*, CASE WHEN g.status <> 'missing' THEN CASE WHEN g.left_samples > 0 THEN g.left_width_m END WHEN coalesce(zi, g.n + 1) - coalesce(ai, 0) - 1 <= 10 THEN
    coalesce(la + (g.i - coalesce(ai, 0))/(coalesce(zi, g.n + 1) - coalesce(ai, 0))*(lz - la), la, lz) END AS fl,
  CASE WHEN g.status <> 'missing' THEN CASE WHEN g.right_samples > 0 THEN g.right_width_m END WHEN coalesce(zi, g.n + 1) - coalesce(ai, 0) - 1 <= 10 THEN
    coalesce(ra + (g.i - coalesce(ai, 0))/(coalesce(zi, g.n + 1) - coalesce(ai, 0))*(rz - ra), ra, rz) END AS fr
  FROM c_gap2 g LEFT JOIN (SELECT i AS ai, CASE WHEN left_samples > 0 THEN left_width_m END AS la, CASE WHEN right_samples > 0 THEN right_width_m END AS ra FROM c_gap) USING (ai)
  LEFT JOIN (SELECT i AS zi, CASE WHEN left_samples > 0 THEN left_width_m END AS lz, CASE WHEN right_samples > 0 THEN right_width_m END AS rz FROM c_gap) USING (zi)""")
cte("c_smp", """SELECT *, CASE WHEN status = 'missing' AND fl IS NULL AND fr IS NULL THEN 0e0 ELSE coalesce(avg(fl) OVER w, 0e0) END AS left_smooth_m,
  CASE WHEN status = 'missing' AND fl IS NULL AND fr IS NULL THEN 0e0 ELSE coalesce(avg(fr) OVER w, 0e0) END AS right_smooth_m FROM c_gap3 WINDOW w AS (ORDER BY s_m ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)""")


@query("profile_smoothing", "T2", "~s_m ~left_smooth_m ~right_smooth_m", "SELECT * FROM c_smp")
def _(spark, sf):
    return geo.smooth_profile(profile(spark, sf))


cte("c_side2", """SELECT *, CASE WHEN left_width_m <= 0 AND right_width_m > 0 THEN 'left' WHEN right_width_m <= 0 AND left_width_m > 0 THEN 'right' END AS side,
  CASE WHEN left_width_m > 0 AND right_width_m > 0 THEN left_width_m + right_width_m END AS tot, row_number() OVER (ORDER BY s_m) AS i FROM c_prof""")
cte("c_side3", """SELECT *, sum(ch) OVER (ORDER BY s_m) AS run FROM (SELECT *, CASE WHEN side IS DISTINCT FROM lag(side) OVER (ORDER BY s_m) THEN 1 ELSE 0 END AS ch FROM c_side2)""")
cte("c_inf", """SELECT s_m, CASE WHEN ok THEN side END AS inferred_side, CASE WHEN ok THEN wd END AS inferred_width_m, CASE WHEN ok THEN 0.35e0 END AS inferred_confidence, left_width_m, right_width_m, status, confidence FROM (
  SELECT a.*, m - CASE WHEN side = 'left' THEN right_width_m ELSE left_width_m END AS wd, side IS NOT NULL AND len_ <= 10 AND k >= 2 AND m - CASE WHEN side = 'left' THEN right_width_m ELSE left_width_m END > 0 AS ok
  FROM (SELECT *, count(*) OVER (PARTITION BY run) AS len_ FROM c_side3) a LEFT JOIN LATERAL (SELECT median(tot) AS m, count(tot) AS k FROM c_side2 b WHERE b.i BETWEEN a.i - 10 AND a.i + 10 AND b.i <> a.i) ON TRUE)""")


@query("one_sided_inference", "T3", "~s_m inferred_side ~inferred_width_m ~inferred_confidence", "SELECT * FROM c_inf")
def _(spark, sf):
    return geo.infer_one_sided(profile(spark, sf))


cte("c_path", "SELECT floor(raw_lap_distance_m/5e0)*5e0 AS s_m, avg(pos_x_m) AS x_m, avg(pos_z_m) AS z_m, count(*) AS samples FROM c_frames GROUP BY ALL")


def path(spark, sf):
    f = base.frames(spark, sf).withColumn("track_id", F.lit(TRACK_ID))
    return geo.centre_path(f, BIN_M)


@query("centre_path", "T4", "~s_m ~x_m ~z_m samples", "SELECT * FROM c_path")
def _(spark, sf):
    return path(spark, sf)


cte("c_bnd", """SELECT p.*, w.lw, w.rw, w.s_m IS NOT NULL AS matched, x_m + nx*lw AS left_x, z_m + nz*lw AS left_z, x_m - nx*rw AS right_x, z_m - nz*rw AS right_z FROM (
  SELECT *, CASE WHEN sqrt(dx*dx + dz*dz) >= 1e-12 THEN -dz/sqrt(dx*dx + dz*dz) ELSE 0e0 END AS nx, CASE WHEN sqrt(dx*dx + dz*dz) >= 1e-12 THEN dx/sqrt(dx*dx + dz*dz) ELSE 0e0 END AS nz FROM (
  SELECT *, coalesce(lead(x_m) OVER w, x_m) - coalesce(lag(x_m) OVER w, x_m) AS dx, coalesce(lead(z_m) OVER w, z_m) - coalesce(lag(z_m) OVER w, z_m) AS dz FROM c_path WINDOW w AS (ORDER BY s_m))) p
  LEFT JOIN (SELECT s_m, CASE WHEN inferred_side = 'left' THEN inferred_width_m ELSE left_width_m END AS lw, CASE WHEN inferred_side = 'right' THEN inferred_width_m ELSE right_width_m END AS rw FROM c_inf) w ON w.s_m + CASE WHEN w.s_m % 35 = 0 THEN 2.5e-1 ELSE 0e0 END = p.s_m""")


def edges(spark, sf):
    p = geo.infer_one_sided(profile(spark, sf))
    # Some bins stand between the path's points and match none of them.
    p = p.withColumn("s_m", F.col("s_m") + F.when(F.col("s_m") % 35 == 0, 2.5e-1).otherwise(0e0))
    width = lambda s: F.when(F.col("inferred_side") == s, F.col("inferred_width_m")).otherwise(F.col(f"{s}_width_m"))
    return geo.boundaries(path(spark, sf), p.select("track_id", "s_m", "inferred_side", "inferred_width_m", "left_width_m", "right_width_m"), width("left"), width("right"))


@query("track_boundaries", "T5", "~s_m matched ~left_x ~left_z ~right_x ~right_z", "SELECT * FROM c_bnd")
def _(spark, sf):
    return edges(spark, sf)


@query("boundary_smoothing", "T6", "~s_m ~left_x_smooth ~left_z_smooth",
       """WITH b AS (SELECT * FROM c_bnd WHERE matched), c AS (SELECT *, sum(CASE WHEN lw = 0 OR s_m - ps > 10 OR pl = 0 THEN 1 ELSE 0 END) OVER (ORDER BY s_m) AS part, row_number() OVER (ORDER BY s_m) AS i FROM (
         SELECT *, lag(s_m) OVER (ORDER BY s_m) AS ps, lag(lw) OVER (ORDER BY s_m) AS pl FROM b)),
       m AS (SELECT a.s_m, any_value(a.left_x) AS x, any_value(a.left_z) AS z, any_value(a.lw) AS lw, count(*)::DOUBLE AS n, sum(q.s_m - a.s_m) AS t1, sum(pow(q.s_m - a.s_m, 2)) AS t2, sum(pow(q.s_m - a.s_m, 3)) AS t3, sum(pow(q.s_m - a.s_m, 4)) AS t4,
         sum(q.left_x) AS y, sum((q.s_m - a.s_m)*q.left_x) AS ty, sum(pow(q.s_m - a.s_m, 2)*q.left_x) AS t2y, sum(q.left_z) AS u, sum((q.s_m - a.s_m)*q.left_z) AS tu, sum(pow(q.s_m - a.s_m, 2)*q.left_z) AS t2u
         FROM c a JOIN c q ON q.part = a.part AND q.i BETWEEN a.i - 4 AND a.i + 4 GROUP BY a.s_m),
       d AS (SELECT *, n*(t2*t4 - t3*t3) - t1*(t1*t4 - t2*t3) + t2*(t1*t3 - t2*t2) AS det FROM m)
       SELECT s_m, CASE WHEN n >= 3 AND abs(det) >= 1e-9 AND lw <> 0 THEN (y*(t2*t4 - t3*t3) - t1*(ty*t4 - t3*t2y) + t2*(ty*t3 - t2*t2y))/det ELSE x END AS left_x_smooth,
       CASE WHEN n >= 3 AND abs(det) >= 1e-9 AND lw <> 0 THEN (u*(t2*t4 - t3*t3) - t1*(tu*t4 - t3*t2u) + t2*(tu*t3 - t2*t2u))/det ELSE z END AS left_z_smooth FROM d""")
def _(spark, sf):
    e = edges(spark, sf).filter("matched")
    return geo.smooth_boundary(e, "lw", ["left_x", "left_z"], 4, BIN_M)


POLY = """WITH p AS (SELECT {k}, lap_distance_m, pos_x_m AS x, pos_z_m AS y, lag(pos_x_m) OVER w AS x0, lag(pos_z_m) OVER w AS y0 FROM {src} WINDOW w AS (PARTITION BY {k} ORDER BY lap_distance_m)),
  c AS (SELECT *, coalesce(sqrt((x - x0)*(x - x0) + (y - y0)*(y - y0)), 0e0) AS d FROM p),
  u AS (SELECT *, sum(d) OVER (PARTITION BY {k} ORDER BY lap_distance_m) AS cum FROM c), t AS (SELECT *, max(cum) OVER (PARTITION BY {k}) AS total, cum - d AS cum0 FROM u),
  e AS (SELECT {k}, 0 AS i, x, y FROM t WHERE x0 IS NULL UNION ALL SELECT {k}, i::INT, x0 + (i/({n} - 1)*total - cum0)/d*(x - x0), y0 + (i/({n} - 1)*total - cum0)/d*(y - y0) FROM (
    SELECT *, unnest(generate_series(greatest(1, floor(cum0/(total/({n} - 1))))::BIGINT, least({n} - 2, ceil(cum/(total/({n} - 1))))::BIGINT)) AS i FROM t WHERE x0 IS NOT NULL AND d > 0)
    WHERE i/({n} - 1)*total > cum0 AND i/({n} - 1)*total <= cum
    UNION ALL SELECT {k}, {n} - 1, arg_max(x, lap_distance_m), arg_max(y, lap_distance_m) FROM t GROUP BY {k} HAVING max(total) > 0)"""


@query("polyline_resample", "T7", K + "i ~x ~y", POLY.format(k="session_id, segment_index", src="c_seg", n=50) + " SELECT * FROM e")
def _(spark, sf):
    p = base.seg_frames(spark, sf).select(*gr.LAP, "frame_id", F.col("pos_x_m").alias("x"), F.col("pos_z_m").alias("y"))
    return geo.resample_polyline(p, gr.LAP, "frame_id", 50, 1000)


def _outline_inputs(spark, sf):
    f = base.seg_frames(spark, sf).withColumn("track_id", F.lit(TRACK_ID))
    laps = f.groupBy("track_id", *gr.LAP, "lap_number").agg(F.max("lap_time_s").alias("lap_time_s"), F.count(F.lit(1)).alias("n")).filter(
        f"lap_number >= 1 AND lap_time_s >= 60 AND n >= {base.MIN_ROWS}")
    return f.select(*gr.LAP, "frame_id", F.col("pos_x_m").alias("x"), F.col("pos_z_m").alias("y")), laps


cte("c_five", """SELECT session_id, segment_index FROM (SELECT session_id, segment_index, max(lap_time_s) AS t FROM c_seg GROUP BY ALL HAVING min(lap_number) >= 1 AND max(lap_time_s) >= 60 AND count(*) >= 20) ORDER BY t, session_id, segment_index LIMIT 5""")
cte("c_fivep", "SELECT * FROM c_seg JOIN c_five USING (session_id, segment_index)")
cte("c_ring", POLY.format(k="session_id, segment_index", src="c_fivep", n=100) + " SELECT i, median(x) AS x, median(y) AS y, count(*) AS laps FROM e GROUP BY i HAVING count(*) >= 2")


def ring(spark, sf):
    pts, laps = _outline_inputs(spark, sf)
    return geo.median_outline(pts, laps, ["track_id"], n=100)


@query("median_outline", "T8", "i ~x ~y laps", "SELECT * FROM c_ring")
def _(spark, sf):
    return ring(spark, sf)


cte("c_wrap", """SELECT *, coalesce(lead(x) OVER w, first_value(x) OVER w) AS xn, coalesce(lead(y) OVER w, first_value(y) OVER w) AS yn, coalesce(lag(x) OVER w, arg_max(x, i) OVER ()) AS xp, coalesce(lag(y) OVER w, arg_max(y, i) OVER ()) AS yp FROM c_ring WINDOW w AS (ORDER BY i)""")


@query("ring_boundaries", "T9", "i ~left_x ~left_y ~right_x ~right_y",
       """SELECT i, x + dy/h*5 AS left_x, y - dx/h*5 AS left_y, x - dy/h*5 AS right_x, y + dx/h*5 AS right_y FROM (SELECT *, xn - xp AS dx, yn - yp AS dy, sqrt((xn - xp)*(xn - xp) + (yn - yp)*(yn - yp)) AS h FROM c_wrap)""")
def _(spark, sf):
    return geo.ring_boundaries(ring(spark, sf), ["track_id"])


@query("baked_turns", "T10", "corner_id ~x ~y ~out_x ~out_y ~tan_x ~tan_y",
       """WITH r AS (SELECT * FROM c_seg JOIN c_ref ON session_id = ref_session_id AND segment_index = ref_segment_index),
       t AS (SELECT corner_id, apex_s_m, unnest([-2e0, 0e0, 2e0]) AS o FROM c_corners), l AS (SELECT corner_id, o, max(lap_distance_m) FILTER (lap_distance_m < apex_s_m + o) AS lx, min(lap_distance_m) FILTER (lap_distance_m >= apex_s_m + o) AS rx, any_value(apex_s_m + o) AS s,
         arg_max(pos_x_m, lap_distance_m) FILTER (lap_distance_m < apex_s_m + o) AS la, arg_min(pos_x_m, lap_distance_m) FILTER (lap_distance_m >= apex_s_m + o) AS ra, arg_max(pos_z_m, lap_distance_m) FILTER (lap_distance_m < apex_s_m + o) AS lb,
         arg_min(pos_z_m, lap_distance_m) FILTER (lap_distance_m >= apex_s_m + o) AS rb FROM t, r GROUP BY corner_id, o),
       v AS (SELECT corner_id, o, CASE WHEN lx IS NULL THEN ra WHEN rx IS NULL THEN la ELSE la + (s - lx)/(rx - lx)*(ra - la) END AS a, CASE WHEN lx IS NULL THEN rb WHEN rx IS NULL THEN lb ELSE lb + (s - lx)/(rx - lx)*(rb - lb) END AS b FROM l),
       p AS (SELECT corner_id, max(a) FILTER (o = 0) AS x, max(b) FILTER (o = 0) AS y, max(a) FILTER (o = 2) - max(a) FILTER (o = -2) AS dx, max(b) FILTER (o = 2) - max(b) FILTER (o = -2) AS dy FROM v GROUP BY corner_id),
       q AS (SELECT *, dx/coalesce(nullif(sqrt(dx*dx + dy*dy), 0), 1) AS tx, dy/coalesce(nullif(sqrt(dx*dx + dy*dy), 0), 1) AS ty FROM p),
       ins AS (SELECT corner_id, count_if((w.y > q.y + tx*25) <> (w.yn > q.y + tx*25) AND q.x - ty*25 < w.x + (q.y + tx*25 - w.y)*(w.xn - w.x)/nullif(w.yn - w.y, 0)) % 2 = 1 AS li, count_if((w.y > q.y - tx*25) <> (w.yn > q.y - tx*25) AND q.x + ty*25 < w.x + (q.y - tx*25 - w.y)*(w.xn - w.x)/nullif(w.yn - w.y, 0)) % 2 = 1 AS ri
         FROM q, c_wrap w GROUP BY corner_id)
       SELECT corner_id, round(x, 3) AS x, round(y, 3) AS y, round(CASE WHEN li AND NOT ri THEN ty ELSE -ty END, 4) AS out_x, round(CASE WHEN li AND NOT ri THEN -tx ELSE tx END, 4) AS out_y, round(tx, 4) AS tan_x, round(ty, 4) AS tan_y FROM q JOIN ins USING (corner_id)""")
def _(spark, sf):
    f, laps, refs = paired(spark, sf)
    r = refs.select("track_id", F.col("ref_session_id").alias("session_id"), F.col("ref_segment_index").alias("segment_index"))
    return geo.baked_turns(f.join(r, gr.LAP), base.corners(spark, sf), materialise(ring(spark, sf)))


@query("ring_length", "T11", "~length_m", "SELECT sum(sqrt((xn - x)*(xn - x) + (yn - y)*(yn - y))) AS length_m FROM c_wrap")
def _(spark, sf):
    return geo.ring_length(ring(spark, sf), ["track_id"])


def lap_grids(spark, sf):
    return materialise(gr.resample(kept(spark, sf), gr.LAP, ["speed_kph", "throttle_norm", "brake_norm"]))


def _strongest_first(candidates: str) -> str:
    """SQL of the greedy choice, one candidate of a lap at a time: kept ones are a list of structs."""
    near = "list_filter(kept, lambda k: abs(k.apex - c.apex) < 60)"
    apart = "greatest(k.s0, c.s0) - least(k.s1, c.s1) - 1 >= 3 AND CASE WHEN c.s0 >= k.s0 THEN c.op ELSE k.op END <= least(k.s1, c.s1) + 1"
    wider = "{'apex': k.apex, 'ms': k.ms, 'pr': k.pr, 's0': least(k.s0, c.s0), 's1': greatest(k.s1, c.s1), 'op': CASE WHEN c.s0 < k.s0 THEN c.op ELSE k.op END}"
    return f"""WITH RECURSIVE c AS (SELECT *, row_number() OVER (PARTITION BY session_id, segment_index ORDER BY pr DESC, ms, apex) AS r FROM {candidates}),
  k AS (SELECT DISTINCT session_id, segment_index, 0::BIGINT AS r, []::STRUCT(apex INT, ms DOUBLE, pr DOUBLE, s0 DOUBLE, s1 DOUBLE, op DOUBLE)[] AS kept FROM c
    UNION ALL SELECT k.session_id, k.segment_index, c.r, CASE WHEN len({near}) > 0 AND len(list_filter({near}, lambda k: {apart})) = 0
      THEN list_transform(kept, lambda k: CASE WHEN abs(k.apex - c.apex) < 60 THEN {wider} ELSE k END)
      ELSE list_append(kept, {{'apex': c.apex, 'ms': c.ms, 'pr': c.pr, 's0': c.s0, 's1': c.s1, 'op': c.op}}) END
    FROM k JOIN c ON c.session_id = k.session_id AND c.segment_index = k.segment_index AND c.r = k.r + 1)
  SELECT session_id, segment_index, z.* FROM (SELECT session_id, segment_index, unnest(kept) AS z FROM (SELECT session_id, segment_index, arg_max(kept, r) AS kept FROM k GROUP BY ALL))"""


def _separated(zones: str) -> str:
    return f"""SELECT session_id, segment_index, apex, ms, pr, CASE WHEN pe > s0 THEN least(apex - 1, floor((pa + apex)/2)) ELSE s0 END::DOUBLE AS s0,
  CASE WHEN s1 > ns THEN greatest(apex + 1, floor((apex + na)/2)) ELSE s1 END::DOUBLE AS s1 FROM (
  SELECT *, lead(apex) OVER w AS na, lead(s0) OVER w AS ns, lag(apex) OVER w AS pa, lag(s1) OVER w AS pe FROM {zones} WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY apex))"""


_W = "PARTITION BY session_id, segment_index ORDER BY s_m"
cte("c_mgrid", f"SELECT session_id, segment_index, s::INT AS s_m, {lerp('v', 'speed')}, {lerp('th', 'th')}, {lerp('br', 'br')} FROM (SELECT * FROM c_own)")
cte("c_sp", f"""SELECT *, min(v) OVER ({_W} ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING) AS low, max(v) OVER ({_W} ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING) AS lp,
  max(v) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 80 FOLLOWING) AS rp, v >= lag(v) OVER ({_W}) - 1 AS down_ok, v <= lead(v) OVER ({_W}) + 1 AS up_ok FROM (
  SELECT session_id, segment_index, s_m, round(avg(speed) OVER ({_W} ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 9) AS v, count(*) OVER (PARTITION BY session_id, segment_index) AS n FROM c_mgrid)""")
cte("c_sp_cand", "SELECT session_id, segment_index, s_m AS apex, v AS ms, least(lp - v, rp - v) AS pr, 0e0 AS s0, 0e0 AS s1, 1e9 AS op FROM c_sp WHERE s_m >= 8 AND s_m < n - 8 AND v <= low AND least(lp - v, rp - v) >= 2.5e0")
cte("c_sp_kept", _strongest_first("c_sp_cand"))
cte("c_sp_zone", """WITH a AS (SELECT k.*, greatest(0, apex - 120) AS lo, least(last_m, apex + 120) AS hi FROM c_sp_kept k JOIN (SELECT session_id, segment_index, max(n) - 1 AS last_m FROM c_sp GROUP BY ALL) USING (session_id, segment_index)),
  x AS (SELECT a.*, s_m AS s, down_ok, up_ok, max(s_m) FILTER (s_m < apex AND s_m > lo AND NOT down_ok AND apex - s_m > 12) OVER z AS stop_lo, min(s_m) FILTER (s_m > apex AND s_m < hi AND NOT up_ok AND s_m - apex > 12) OVER z AS stop_hi
    FROM a JOIN c_sp g ON g.session_id = a.session_id AND g.segment_index = a.segment_index AND s_m BETWEEN lo AND hi WINDOW z AS (PARTITION BY a.session_id, a.segment_index, apex))
  SELECT session_id, segment_index, apex, any_value(ms) AS ms, any_value(pr) AS pr, least(coalesce(min(s) FILTER (s < apex AND s > lo AND down_ok AND s > coalesce(stop_lo, -1)), any_value(lo)), apex - 1)::DOUBLE AS s0,
    greatest(coalesce(max(s) FILTER (s > apex AND s < hi AND up_ok AND s < coalesce(stop_hi, 1000000000)), any_value(hi)), apex + 1)::DOUBLE AS s1 FROM x GROUP BY session_id, segment_index, apex""")
cte("c_pd", f"""SELECT *, br >= 0.15e0 AS bon, th < 0.9e0 AND br < 0.15e0 AS lon, lag(br >= 0.15e0) OVER ({_W}) AS bp, lag(th < 0.9e0 AND br < 0.15e0) OVER ({_W}) AS lpv,
  max(CASE WHEN br >= 0.15e0 THEN s_m END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_on, max(CASE WHEN br <= 0 THEN s_m END) OVER ({_W}) AS last_free,
  coalesce(max(CASE WHEN th < 0.95e0 THEN s_m END) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) + 1 AS op,
  coalesce(max(speed) OVER ({_W} ROWS BETWEEN 80 PRECEDING AND 1 PRECEDING), speed) AS lp, coalesce(max(speed) OVER ({_W} ROWS BETWEEN 1 FOLLOWING AND 80 FOLLOWING), speed) AS rp FROM c_mgrid""")
cte("c_pd_zone", f"""WITH b AS (SELECT *, sum(CASE WHEN bon AND NOT coalesce(bp, FALSE) AND (last_on IS NULL OR coalesce(last_free > last_on, FALSE)) THEN 1 ELSE 0 END) OVER ({_W}) AS bz,
    sum(CASE WHEN lon AND NOT coalesce(lpv, FALSE) THEN 1 ELSE 0 END) OVER ({_W}) AS lz FROM c_pd),
  u AS (SELECT session_id, segment_index, min(s_m) AS s0, max(s_m) AS s1, 1 AS braked FROM b WHERE bon GROUP BY session_id, segment_index, bz HAVING max(s_m) - min(s_m) >= 5
    UNION ALL SELECT session_id, segment_index, min(s_m), max(s_m), 0 FROM b WHERE lon GROUP BY session_id, segment_index, lz HAVING max(s_m) - min(s_m) >= 5),
  q AS (SELECT *, max(s1) OVER (PARTITION BY session_id, segment_index ORDER BY s0, s1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM u),
  p AS (SELECT *, sum(CASE WHEN coalesce(s0 - reach > 2, TRUE) THEN 1 ELSE 0 END) OVER (PARTITION BY session_id, segment_index ORDER BY s0, s1 ROWS UNBOUNDED PRECEDING) AS zone FROM q)
  SELECT session_id, segment_index, zone, min(s0) AS z0, max(s1) AS z1, max(braked) AS braked FROM p GROUP BY ALL""")
cte("c_pd_cand", """SELECT session_id, segment_index, a.s AS apex, a.v AS ms, least(a.l - a.v, a.r - a.v) AS pr, z0::DOUBLE AS s0, z1::DOUBLE AS s1, op::DOUBLE AS op FROM (
  SELECT z.session_id, z.segment_index, z0, z1, braked, min({'v': speed, 's': s_m, 'l': lp, 'r': rp}) AS a, min(th) AS low, min(op) FILTER (s_m = z0) AS op FROM c_pd_zone z JOIN c_pd g ON g.session_id = z.session_id AND g.segment_index = z.segment_index AND s_m BETWEEN z0 AND z1
  GROUP BY z.session_id, z.segment_index, zone, z0, z1, braked) WHERE CASE WHEN braked = 1 THEN a.l - a.v >= 10 ELSE a.l - a.v >= 10 OR low <= 0.3e0 OR (low <= 0.5e0 AND a.l - a.v >= 3) END""")
cte("c_pd_kept", _strongest_first("c_pd_cand"))
cte("c_pd_sep", _separated("c_pd_kept"))
cte("c_pedal", """WITH t AS (SELECT *, coalesce(lead(s0) OVER (PARTITION BY session_id, segment_index ORDER BY apex) - 1, last_m) AS top FROM c_pd_sep JOIN (SELECT session_id, segment_index, max(s_m) AS last_m FROM c_mgrid GROUP BY ALL) USING (session_id, segment_index)),
  e AS (SELECT t.session_id, t.segment_index, apex, any_value(ms) AS ms, any_value(pr) AS pr, any_value(s0) AS s0, coalesce(min(s_m) FILTER (g.th >= 0.9e0), any_value(s1)) AS s1 FROM t LEFT JOIN c_mgrid g ON g.session_id = t.session_id AND g.segment_index = t.segment_index
    AND s_m BETWEEN s1 + 1 AND top GROUP BY t.session_id, t.segment_index, apex),
  f AS (SELECT *, coalesce(lag(s1) OVER (PARTITION BY session_id, segment_index ORDER BY apex) + 1, 0) AS lo FROM e)
  SELECT f.session_id, f.segment_index, apex, any_value(ms) AS ms, any_value(pr) AS pr, CASE WHEN any_value(s0) - 1 < any_value(lo) THEN any_value(s0) ELSE coalesce(max(s_m) FILTER (g.th >= 0.98e0) + 1, any_value(lo)) END AS s0, any_value(s1) AS s1
  FROM f LEFT JOIN c_mgrid g ON g.session_id = f.session_id AND g.segment_index = f.segment_index AND s_m BETWEEN lo AND s0 - 1 GROUP BY f.session_id, f.segment_index, apex""")
_CORNER = "SELECT session_id, segment_index, apex AS apex_m, ms AS min_speed, pr AS prominence, s0 AS s_start_m, s1 AS s_end_m FROM "


@query("corners_from_pedals", "T12", K + "apex_m ~min_speed ~prominence ~s_start_m ~s_end_m", _CORNER + "c_pedal")
def _(spark, sf):
    return tm.detect_from_pedals(lap_grids(spark, sf))


@query("corners_from_speed", "T13", K + "apex_m ~min_speed ~prominence ~s_start_m ~s_end_m", _CORNER + f"({_separated('c_sp_zone')})")
def _(spark, sf):
    return tm.detect_from_speed(lap_grids(spark, sf))


@query("model_assembly", "T16", K + "corner_id corner_name ~s_start_m ~apex_s_m ~s_end_m apex_side",
       """SELECT session_id, segment_index, 't' || i AS corner_id, 'turn ' || i AS corner_name, round(s0, 1) AS s_start_m, apex::DOUBLE AS apex_s_m, round(s1, 1) AS s_end_m, 'right' AS apex_side
       FROM (SELECT *, row_number() OVER (PARTITION BY session_id, segment_index ORDER BY apex) AS i FROM c_pedal)""")
def _(spark, sf):
    return tm.assemble_model(tm.detect_from_pedals(lap_grids(spark, sf)))


def candidates(spark, sf):
    """Candidates per region track: the orders' dates give apexes along the lap."""
    o = spark.read.parquet(f"{sf}/supplier.parquet")
    apex = F.floor((F.col("s_suppkey") * 37 % 4000)).cast("int")
    return o.select(F.concat(F.lit("r"), (F.col("s_suppkey") % 5).cast("string")).alias("track_id"), F.col("s_suppkey").alias("candidate"), apex.alias("apex_m"),
                    (apex - 3e1 - F.col("s_nationkey") / 3).alias("s_start_m"), (apex + 4e1 + F.col("s_nationkey") / 7).alias("s_end_m"))


def curated(spark, sf):
    c = base.corners(spark, sf)
    return c.withColumn("track_id", F.concat(F.lit("r"), (F.col("corner_pos") % 5).cast("string")))


# Greedy nearest-first claiming as a recursive walk over the ranked pairs of each track.
cte("c_cand", """SELECT 'r' || (s_suppkey % 5) AS track_id, s_suppkey AS candidate, (s_suppkey*37 % 4000)::INT AS apex_m, (s_suppkey*37 % 4000) - 3e1 - s_nationkey/3 AS s_start_m, (s_suppkey*37 % 4000) + 4e1 + s_nationkey/7 AS s_end_m FROM supplier""")
cte("c_mpair", """SELECT 'r' || (corner_pos % 5) AS track_id, corner_pos, candidate, abs(apex_m - apex_s_m) AS gap, row_number() OVER (PARTITION BY 'r' || (corner_pos % 5) ORDER BY abs(apex_m - apex_s_m), corner_pos, candidate) AS r
  FROM c_corners c JOIN c_cand d ON d.track_id = 'r' || (corner_pos % 5) AND abs(apex_m - apex_s_m) <= 150 WHERE corner_pos % 8 <> 5""")
MATCH = """WITH RECURSIVE mp AS MATERIALIZED (SELECT * FROM c_mpair), w AS (SELECT track_id, 0::BIGINT AS r, []::INT[] AS cs, []::BIGINT[] AS ds, []::BIGINT[] AS taken FROM mp GROUP BY track_id
  UNION ALL SELECT w.track_id, p.r, CASE WHEN free THEN list_append(cs, p.corner_pos) ELSE cs END, CASE WHEN free THEN list_append(ds, p.candidate) ELSE ds END, CASE WHEN free THEN list_append(taken, p.r) ELSE taken END
  FROM w JOIN (SELECT * FROM mp) p ON p.track_id = w.track_id AND p.r = w.r + 1, LATERAL (SELECT NOT list_contains(w.cs, p.corner_pos) AND NOT list_contains(w.ds, p.candidate) AS free)),
  l AS (SELECT track_id, unnest(taken) AS r FROM (SELECT track_id, arg_max(taken, r) AS taken FROM w GROUP BY track_id)), mt AS (SELECT corner_pos, candidate, gap FROM mp JOIN l USING (track_id, r))"""


@query("corner_matching", "T14", "track_id corner_pos candidate ~gap", MATCH + " SELECT 'r' || (c.corner_pos % 5) AS track_id, c.corner_pos, candidate, gap FROM c_corners c LEFT JOIN mt USING (corner_pos)")
def _(spark, sf):
    return tm.match_corners(curated(spark, sf), candidates(spark, sf), F.col("corner_pos") % 8 == 5)


@query("corner_refresh", "T15", "corner_pos ~s_start_m ~apex_s_m ~s_end_m ~target_throttle_pct",
       MATCH + """ SELECT c.corner_pos, coalesce(round(d.s_start_m, 1), c.s_start_m) AS s_start_m, coalesce(d.apex_m::DOUBLE, c.apex_s_m) AS apex_s_m, coalesce(round(d.s_end_m, 1), c.s_end_m) AS s_end_m, target_throttle_pct
       FROM c_corners c LEFT JOIN mt USING (corner_pos) LEFT JOIN c_cand d USING (candidate)""")
def _(spark, sf):
    cand = candidates(spark, sf)
    return tm.refresh_corners(tm.match_corners(curated(spark, sf), cand, F.col("corner_pos") % 8 == 5), cand)


def recorded(spark, sf):
    """A recorded map: the ring turned by a quarter lap, mirrored in y."""
    r = ring(spark, sf)
    return r, r.select("track_id", F.pmod(F.col("i") + 30, F.lit(100)).alias("i"), (F.col("x") + 0.3).alias("x"), (-F.col("y")).alias("y"), (F.pmod(F.col("i") + 30, F.lit(100)) * 4e1).alias("distance_m"))


cte("c_rec", "SELECT (i + 30) % 100 AS i, x + 0.3e0 AS x, -y AS y, ((i + 30) % 100)*4e1 AS distance_m FROM c_ring")
cte("c_align", """SELECT arg_min(r.i, (sqrt(pow(r.x - s.x, 2) + pow(r.y + s.y, 2)), r.i)) AS shift, count(*) AS points, min(sqrt(pow(r.x - s.x, 2) + pow(r.y + s.y, 2))) AS start_offset_m, max(distance_m) AS len,
  arg_min(distance_m, (sqrt(pow(r.x - s.x, 2) + pow(r.y + s.y, 2)), r.i)) - arg_min(distance_m, r.i) AS along FROM c_rec r, (SELECT * FROM c_ring WHERE i = 0) s""")


@query("start_alignment", "T17", "i i_rotated ~start_offset_m ~axis_offset_m ~point_spacing_m",
       """SELECT i, ((i - shift) % points + points) % points AS i_rotated, start_offset_m, least(along - len*floor(along/len), len - (along - len*floor(along/len))) AS axis_offset_m, len/points AS point_spacing_m FROM c_rec, c_align""")
def _(spark, sf):
    r, rec = recorded(spark, sf)
    a = materialise(geo.start_alignment(rec, r))
    return geo.rotate_ring(rec, a).join(a, "track_id")


cte("c_fitp", "SELECT session_id, frame_id, pos_x_m AS x, pos_z_m AS y, pos_x_m*1.5e0 - pos_z_m*0.5e0 + steering_norm AS u, pos_x_m*0.5e0 + pos_z_m*1.5e0 + 7 AS v FROM c_frames")
cte("c_fit", """SELECT session_id, sqrt(avg(pow(u - mu, 2) + pow(v - mv, 2)))/sqrt(avg(pow(x - mx, 2) + pow(y - my, 2))) AS scale, atan2(sum((x - mx)*(v - mv) - (y - my)*(u - mu)), sum((x - mx)*(u - mu) + (y - my)*(v - mv))) AS rot,
  any_value(mx) AS mx, any_value(my) AS my, any_value(mu) AS mu, any_value(mv) AS mv FROM c_fitp JOIN (SELECT session_id, avg(x) AS mx, avg(y) AS my, avg(u) AS mu, avg(v) AS mv FROM c_fitp GROUP BY ALL) USING (session_id) GROUP BY session_id""")


def _fit_points(spark, sf):
    f = base.frames(spark, sf)
    return f.select("session_id", "frame_id", F.col("pos_x_m").alias("x"), F.col("pos_z_m").alias("y"),
                    (F.col("pos_x_m") * 1.5 - F.col("pos_z_m") * 0.5 + F.col("steering_norm")).alias("u"), (F.col("pos_x_m") * 0.5 + F.col("pos_z_m") * 1.5 + 7).alias("v"))


@query("similarity_fit", "T18", "session_id frame_id ~fit_x ~fit_y ~scale ~rotation_rad",
       """SELECT session_id, frame_id, scale*(x*cos(rot) - y*sin(rot)) + mu - scale*(mx*cos(rot) - my*sin(rot)) AS fit_x, scale*(x*sin(rot) + y*cos(rot)) + mv - scale*(mx*sin(rot) + my*cos(rot)) AS fit_y, scale, rot AS rotation_rad
       FROM c_fitp JOIN c_fit USING (session_id)""")
def _(spark, sf):
    p = _fit_points(spark, sf)
    return geo.apply_similarity(p, geo.similarity_fit(p, ["session_id"]), ["session_id"])


@query("heat_table", "T19", K + "s_m ~heat",
       f"""WITH g AS (SELECT session_id, segment_index, s AS s_m, {lerp('v', 'v')} FROM (SELECT * FROM c_own)),
       h AS (SELECT *, lead(v, 1) OVER w AS m, lead(v, 2) OVER w AS e, min(v) OVER (PARTITION BY session_id, segment_index) AS lo, max(v) OVER (PARTITION BY session_id, segment_index) AS hi FROM (SELECT session_id, segment_index, s_m, v FROM g)
         WINDOW w AS (PARTITION BY session_id, segment_index ORDER BY s_m))
       SELECT session_id, segment_index, s_m::INT AS s_m, greatest(0e0, least(1e0, (m - CASE WHEN hi <= lo THEN 0 ELSE lo END)/(CASE WHEN hi <= lo THEN 1 ELSE hi END - CASE WHEN hi <= lo THEN 0 ELSE lo END))) AS heat FROM h WHERE s_m % 2 = 0 AND e IS NOT NULL""")
def _(spark, sf):
    g = gr.resample(kept(spark, sf), gr.LAP, ["speed_kph", "pos_x_m", "pos_z_m"])
    return geo.heat_table(g, "speed_kph", True)


@query("profile_export_summary", "S15", "track_id samples missing_bins one_sided_bins low_sample_bins complete_bins",
       """SELECT 'nation-ring' AS track_id, count(*) AS samples, count_if(status = 'missing')::BIGINT AS missing_bins, count_if(status = 'one-sided')::BIGINT AS one_sided_bins, count_if(status = 'low-sample')::BIGINT AS low_sample_bins,
       count_if(status = 'complete')::BIGINT AS complete_bins FROM c_prof""")
def _(spark, sf):
    return geo.export_summary(profile(spark, sf))


def document(spark, rows, heads, order):
    """Rows written as one document per track, and read back from there with the fields of its head."""
    out = scratch_path(spark, "documents")
    dc.write_documents(rows, heads, "track_id", order, out, "items")
    item = T.StructType([f for f in rows.schema if f.name != "track_id"])
    head = [f for f in heads.schema if f.name != "track_id"]
    docs = spark.read.schema(T.StructType([*head, T.StructField("items", T.ArrayType(item))])).option("multiLine", True).json(f"{out}/track_id=*/*.txt")
    named = docs.withColumn("track_id", F.regexp_extract(F.col("_metadata.file_path"), "track_id=([^/]+)/", 1))
    return named.select("track_id", *(f.name for f in head), F.posexplode("items").alias("pos", "item")).select("track_id", *(f.name for f in head), F.col("pos").cast("long").alias("pos"), "item.*")


def counted(rows):
    return rows.groupBy("track_id").agg(F.count(F.lit(1)).alias("n_samples"))


@query("width_profile_document", "S15", "track_id missing_bins complete_bins pos ~s_m ~left_width_m ~right_width_m left_samples right_samples status ~confidence",
       """SELECT *, 'nation-ring' AS track_id, count(*) FILTER (status = 'missing') OVER () AS missing_bins, count(*) FILTER (status = 'complete') OVER () AS complete_bins, row_number() OVER (ORDER BY s_m) - 1 AS pos FROM c_prof""")
def _(spark, sf):
    rows = materialise(profile(spark, sf).select("track_id", "s_m", "left_width_m", "right_width_m", "left_samples", "right_samples", "status", "confidence"))
    return document(spark, rows, geo.export_summary(rows), ["s_m"])


@query("centre_path_document", "S15", "track_id n_samples pos ~s_m ~x_m ~z_m samples", "SELECT *, 'nation-ring' AS track_id, count(*) OVER () AS n_samples, row_number() OVER (ORDER BY s_m) - 1 AS pos FROM c_path")
def _(spark, sf):
    rows = materialise(path(spark, sf).select("track_id", "s_m", "x_m", "z_m", "samples"))
    return document(spark, rows, counted(rows), ["s_m"])


@query("boundaries_document", "S15", "track_id n_samples pos ~s_m matched ~left_x ~left_z ~right_x ~right_z", "SELECT *, 'nation-ring' AS track_id, count(*) OVER () AS n_samples, row_number() OVER (ORDER BY s_m) - 1 AS pos FROM c_bnd")
def _(spark, sf):
    rows = materialise(edges(spark, sf).select("track_id", "s_m", "matched", "left_x", "left_z", "right_x", "right_z"))
    return document(spark, rows, counted(rows), ["s_m"])


@query("apex_metrics_document", "S15", "track_id n_samples pos session_id segment_index corner_id ~apex_at_m ~edge_distance_m",
       """SELECT *, 'nation-ring' AS track_id, count(*) OVER () AS n_samples, row_number() OVER (ORDER BY session_id, segment_index, corner_id) - 1 AS pos FROM (SELECT session_id, segment_index, corner_id, r.d AS apex_at_m, r.e AS edge_distance_m FROM (
       SELECT session_id, segment_index, corner_id, arg_min({'d': raw_lap_distance_m, 'e': track_edge_m - abs(path_lateral_m)}, (abs(raw_lap_distance_m - apex_s_m), frame_id)) AS r
       FROM c_seg JOIN c_corners ON raw_lap_distance_m BETWEEN s_start_m AND s_end_m GROUP BY session_id, segment_index, corner_id))""")
def _(spark, sf):
    f = base.seg_frames(spark, sf).withColumn("track_id", F.lit(TRACK_ID))
    rows = materialise(cc.apex_metrics(f, base.corners(spark, sf)).select(F.lit(TRACK_ID).alias("track_id"), *gr.LAP, "corner_id", "apex_at_m", "edge_distance_m"))
    return document(spark, rows, counted(rows), [*gr.LAP, "corner_id"])
