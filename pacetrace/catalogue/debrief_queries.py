"""Session-level aggregation and ranking (inventory rows G1–G20, S14)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import laps as lp
from ..operators import phases as ph
from ..operators import session_stats as st
from ..plans import compare as cp
from ..plans.debrief import debrief, reference_corner_channels
from ..sources import documents as dc
from ..sources.frames import LAP_LENGTH_M, TRACK_ID
from . import base
from .corners_queries import analysed
from .grid_queries import paired
from .registry import cte, query

K = "session_id segment_index "
C = "session_id corner_id "


def clean_facts(spark, sf):
    """Lap facts and phases of the analysed laps, with their clean flag."""
    f, laps, pairs, phases = analysed(spark, sf)
    info = pairs.select(*lp.LAP, "track_id", "lap_number", "clean", *cp.REF, F.col("duration_s").alias("lap_time_s"),
                        (F.col("duration_s") - F.col("ref_duration_s")).alias("delta_s"))
    return f, laps, info, phases.join(info.select(*lp.LAP, "clean"), lp.LAP)


def full(spark, sf):
    f, laps, _refs = paired(spark, sf)
    return debrief(f, laps, base.corners(spark, sf), LAP_LENGTH_M, base.MIN_ROWS)


cte("c_cph", "SELECT p.* FROM c_phases p JOIN c_clean USING (session_id, segment_index) WHERE clean")
cte("c_env_pts", """SELECT f.session_id, f.segment_index, lap_distance_m AS x, speed_kph AS v, lead(lap_distance_m) OVER w AS x1, lead(speed_kph) OVER w AS v1,
  count(*) OVER (PARTITION BY f.session_id, f.segment_index) AS n, row_number() OVER w AS q FROM c_seg f JOIN c_laps l USING (session_id, segment_index)
  WHERE clean AND lap_distance_m BETWEEN 0 AND 4e3 WINDOW w AS (PARTITION BY f.session_id, f.segment_index ORDER BY lap_distance_m, speed_kph)""")
cte("c_env", """WITH e AS (SELECT session_id, unnest(generate_series(floor(x)::BIGINT + 1, floor(x1)::BIGINT)) AS k, x, x1, v, v1 FROM c_env_pts WHERE n >= 20 AND x1 IS NOT NULL),
  g AS (SELECT session_id, k, max(v + (v1 - v)*(k - x)/(x1 - x)) AS v FROM e GROUP BY ALL),
  h AS (SELECT session_id, k, least(v, coalesce(CASE WHEN lead(k) OVER w = k + 1 THEN lead(v) OVER w END, 0e0)) AS e FROM g WINDOW w AS (PARTITION BY session_id ORDER BY k))
  SELECT session_id, coalesce(sum(CASE WHEN e > 1 THEN 1/(e/3.6e0) END), 0e0) AS envelope_s, 4000 - count_if(e > 1)::BIGINT AS uncovered_bins,
    any_value(u) AS laps_used FROM h JOIN (SELECT session_id, count(DISTINCT segment_index) AS u FROM c_env_pts WHERE n >= 20 GROUP BY ALL) USING (session_id) WHERE k < 4000 GROUP BY session_id""")


@query("speed_envelope", "G1", "session_id ~envelope_s uncovered_bins laps_used", "SELECT * FROM c_env")
def _(spark, sf):
    f = base.seg_frames(spark, sf)
    clean = materialise(lp.classify_laps(f)).filter("clean").select(*lp.LAP)
    return st.speed_envelope(f.join(clean, lp.LAP, "left_semi"), LAP_LENGTH_M, base.MIN_ROWS)


cte("c_pace", """SELECT session_id, count(*) AS clean_laps, min(duration_s) AS best_lap_s, median(duration_s) AS median_lap_s, max(duration_s) AS worst_clean_lap_s,
  max(duration_s) - min(duration_s) AS spread_s, stddev_pop(duration_s) AS std_dev_s, any_value(coalesce(envelope_s, 0e0)) AS envelope_lap_s,
  greatest(0e0, min(duration_s) - any_value(coalesce(envelope_s, 0e0))) AS time_available_s, avg(duration_s - ref_duration_s) AS mean_gap_s
  FROM c_clean LEFT JOIN c_env USING (session_id) JOIN c_ref ON TRUE WHERE clean GROUP BY session_id""")


@query("lap_pace", "G2", "session_id clean_laps ~best_lap_s ~median_lap_s ~worst_clean_lap_s ~spread_s ~std_dev_s ~envelope_lap_s ~time_available_s ~mean_gap_s",
       "SELECT * FROM c_pace")
def _(spark, sf):
    f, laps, refs = paired(spark, sf)
    pairs = cp.pair_laps(laps.filter("status = 'eligible'"), refs, ["track_id"])
    info = pairs.withColumn("lap_time_s", F.col("duration_s")).withColumn("delta_s", F.col("duration_s") - F.col("ref_duration_s"))
    clean = laps.filter("clean").select(*lp.LAP)
    return st.lap_pace(info, st.speed_envelope(f.join(clean, lp.LAP, "left_semi"), LAP_LENGTH_M, base.MIN_ROWS))


@query("phase_spreads", "G3 G6", C + "phase samples ~mean ~best ~worst ~spread ~std_dev ~point_spread_m",
       """SELECT session_id, corner_id, phase, count(*) AS samples, avg(driver_value) AS mean, max(driver_value) AS best, min(driver_value) AS worst, max(driver_value) - min(driver_value) AS spread,
       stddev_pop(driver_value) AS std_dev, CASE WHEN count(phase_distance_m) >= 2 THEN max(phase_distance_m) - min(phase_distance_m) END AS point_spread_m FROM c_cph GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, sf):
    return st.phase_spreads(clean_facts(spark, sf)[3].filter("clean"))


@query("recurring_losses", "G4 G6", C + "phase ~mean_loss_s laps laps_affected",
       """SELECT session_id, corner_id, phase, avg(loss_s) AS mean_loss_s, count(*) AS laps, count_if(loss_s > 0.05e0)::BIGINT AS laps_affected FROM c_cph GROUP BY ALL HAVING avg(loss_s) > 0""")
def _(spark, sf):
    return st.recurring_losses(clean_facts(spark, sf)[3].filter("clean"))


@query("inconsistent_corners", "G5 G6", C + "samples ~mean_loss_s ~best_loss_s ~worst_loss_s ~spread_s",
       """SELECT session_id, corner_id, count(*) AS samples, avg(loss_s) AS mean_loss_s, min(loss_s) AS best_loss_s, max(loss_s) AS worst_loss_s, max(loss_s) - min(loss_s) AS spread_s
       FROM c_cph WHERE phase = 'minimum_speed' GROUP BY ALL HAVING count(*) >= 2""")
def _(spark, sf):
    return st.inconsistent_corners(clean_facts(spark, sf)[3].filter("clean"))


cte("c_prio", """WITH p AS (SELECT session_id, corner_id, phase, avg(loss_s) AS ml, count(*) AS n, count_if(loss_s > 0.05e0)::BIGINT AS af, max(loss_s) AS hi, min(loss_s) AS lo, avg(driver_value) AS dv, avg(reference_value) AS rv,
    min((segment_index, CASE phase WHEN 'entry' THEN 0 WHEN 'minimum_speed' THEN 1 WHEN 'exit_brake' THEN 2 WHEN 'exit' THEN 3 ELSE 4 END)) AS seen, any_value(corner_name) AS corner_name, any_value(corner_pos) AS corner_pos FROM c_cph GROUP BY session_id, corner_id, phase),
  h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, corner_id ORDER BY round(ml, 9) DESC, seen) AS r FROM p) WHERE r = 1),
  b AS (SELECT h.*, coalesce(m.n, h.n) AS bn, coalesce(m.af, h.af) AS baf, CASE WHEN coalesce(m.n, h.n) >= 2 THEN coalesce(m.hi, h.hi) - coalesce(m.lo, h.lo) ELSE 0e0 END AS spread_s
    FROM h LEFT JOIN (SELECT * FROM p WHERE phase = 'minimum_speed') m USING (session_id, corner_id))
  SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, corner_pos)::INT AS rank, CASE WHEN mean_gap_s > 0 THEN least(1e0, recurring_loss_s/mean_gap_s) ELSE 0e0 END AS share_of_gap FROM (
  SELECT session_id, corner_id, corner_name, corner_pos, phase, CASE WHEN ml >= 0.1e0 AND af/n >= 0.6e0 AND spread_s >= 0.2e0 THEN 'both' WHEN ml >= 0.1e0 AND af/n >= 0.6e0 THEN 'recurring' ELSE 'inconsistent' END AS kind,
    greatest(0e0, ml) AS recurring_loss_s, spread_s, greatest(0e0, ml) + 0.35e0*spread_s AS score, bn AS laps, baf AS laps_affected, round(dv, 1) AS driver_value, round(rv, 1) AS reference_value
  FROM b WHERE ml >= 0.02e0 OR spread_s >= 0.1e0) LEFT JOIN (SELECT session_id, mean_gap_s FROM c_pace) USING (session_id)""")


@query("priorities", "G7 G8", C + "rank phase kind ~recurring_loss_s ~spread_s ~share_of_gap ~score laps laps_affected ~driver_value ~reference_value", "SELECT * FROM c_prio")
def _(spark, sf):
    f, laps, info, phases = clean_facts(spark, sf)
    gaps = info.filter("clean").groupBy("session_id").agg(F.avg("delta_s").alias("mean_gap_s"))
    return st.priorities(phases.filter("clean"), gaps)


@query("suggested_changes", "G9", C + "rank phase suggestion")
def _(spark, sf):
    d = full(spark, sf)
    return st.suggested_changes(d.clean_phases, d.priorities, d.representative, d.reference_channels, d.rear)


cte("c_win_refs", """SELECT s.session_id, -1 AS segment_index, c.*, p.entry_m, coalesce(p.a, c.apex_s_m) AS apex_m, p.exit_m, coalesce(p.g, c.s_end_m) AS straight_end_m, 'r' AS window_source
  FROM (SELECT DISTINCT session_id FROM c_clean) s CROSS JOIN c_cb c LEFT JOIN (SELECT session_id, corner_id, median(reference_phase_distance_m) FILTER (phase = 'entry') AS entry_m, median(reference_apex_distance_m) AS a,
    median(reference_phase_distance_m) FILTER (phase LIKE 'exit%') AS exit_m, max(gain_end_distance_m) AS g FROM c_phases GROUP BY ALL) p ON p.session_id = s.session_id AND p.corner_id = c.corner_id""")
cte("c_refchan", """SELECT w.session_id, w.corner_id, (SELECT arg_min(gear, (abs(lap_distance_m - w.apex_m), frame_id)) FROM c_seg JOIN c_ref ON session_id = ref_session_id AND segment_index = ref_segment_index
    WHERE gear <> 0 AND abs(lap_distance_m - w.apex_m) <= 20 AND EXISTS (SELECT 1 FROM c_seg z JOIN c_ref ON z.session_id = ref_session_id AND z.segment_index = ref_segment_index WHERE z.lap_distance_m BETWEEN w.s_start_m AND w.s_end_m))::INT AS ref_gear,
  (SELECT arg_min(path_lateral_m, (abs(lap_distance_m - w.apex_m), frame_id)) FROM c_seg JOIN c_ref ON session_id = ref_session_id AND segment_index = ref_segment_index WHERE abs(lap_distance_m - w.apex_m) <= 5) AS ref_lateral FROM c_win_refs w""")


def _nth(c):
    return f"{c} || CASE WHEN {c} % 100 BETWEEN 10 AND 20 THEN 'th' WHEN {c} % 10 = 1 THEN 'st' WHEN {c} % 10 = 2 THEN 'nd' WHEN {c} % 10 = 3 THEN 'rd' ELSE 'th' END"


@query("next_targets", "G10", C + "target_no rank ~recurring_loss_s measure caveat",
       f"""WITH t AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rank)::INT AS target_no FROM c_prio WHERE rank = 1 OR recurring_loss_s >= 0.1e0),
       j AS (SELECT t.*, g.gear_at_apex AS g, r.ref_gear AS rg, s.state, s.threshold_deg, s.value_deg, s.brake_overlap,
         CASE phase WHEN 'entry' THEN 'at the braking point' WHEN 'exit_brake' THEN 'at the brake release' WHEN 'exit_throttle' THEN 'onto the straight' WHEN 'exit' THEN 'onto the straight' ELSE 'at the apex' END AS place
         FROM t LEFT JOIN c_rep g USING (session_id, corner_id) LEFT JOIN c_refchan r USING (session_id, corner_id) LEFT JOIN c_stab s USING (session_id, corner_id) WHERE target_no <= 3),
       m AS (SELECT *, concat_ws('; ', CASE WHEN driver_value < reference_value THEN printf('%.1f km/h %s, against %.1f today', reference_value, place, driver_value) END,
         CASE WHEN g > 0 AND rg > 0 AND g <> rg THEN {_nth("rg")} || ' gear at the apex, against ' || {_nth("g")} || ' today' END) AS usual FROM j)
       SELECT session_id, corner_id, target_no, rank, recurring_loss_s, CASE WHEN state = 'measured_instability' THEN printf('peak rear slip under %.1f deg at the apex%s, against %.1f deg today, while matching the reference brake point',
         threshold_deg, CASE WHEN brake_overlap THEN ' with the brake applied' ELSE '' END, value_deg) WHEN usual <> '' THEN usual ELSE printf('no more than %.3f s lost here', recurring_loss_s) END AS measure,
       CASE state WHEN 'measured_instability' THEN 'stabilise the rear first' WHEN 'unknown' THEN 'rear stability was not measurable: a controlled test' ELSE '' END AS caveat FROM m""")
def _(spark, sf):
    d = full(spark, sf)
    return st.next_targets(d.priorities, d.representative, d.reference_channels, d.rear)


@query("corner_table", "G11", C + "~min_speed ~ref_min_speed gear_at_apex ref_gear ~line_offset_m rank",
       """SELECT session_id, corner_id, ms AS min_speed, rs AS ref_min_speed, gear_at_apex, ref_gear, lateral_at_apex_m - ref_lateral AS line_offset_m, rank FROM c_rep LEFT JOIN (SELECT session_id, corner_id, avg(driver_value) AS ms, avg(reference_value) AS rs
       FROM c_cph WHERE phase = 'minimum_speed' GROUP BY ALL) USING (session_id, corner_id) LEFT JOIN c_refchan USING (session_id, corner_id) LEFT JOIN (SELECT session_id, corner_id, rank FROM c_prio) USING (session_id, corner_id)""")
def _(spark, sf):
    d = full(spark, sf)
    return st.corner_table(d.clean_phases, d.representative, d.reference_channels, d.priorities)


cte("c_detail", """SELECT p.session_id, p.segment_index, p.corner_id, p.driver_value AS min_speed, p.reference_value AS ref_min_speed, CASE WHEN gear_at_apex > 0 THEN gear_at_apex END AS gear, brake_peak, trail_brake_depth_m, p.loss_s
  FROM c_cph p LEFT JOIN c_chan_d USING (session_id, segment_index, corner_id) WHERE phase = 'minimum_speed'""")


@query("corner_lap_detail", "G12", K + "corner_id ~min_speed ~ref_min_speed gear ~brake_peak ~trail_brake_depth_m ~loss_s ~speed_spread ~loss_spread ~median_speed",
       """SELECT * FROM c_detail JOIN (SELECT session_id, corner_id, max(min_speed) - min(min_speed) AS speed_spread, max(loss_s) - min(loss_s) AS loss_spread, median(min_speed) AS median_speed FROM c_detail GROUP BY ALL) USING (session_id, corner_id)""")
def _(spark, sf):
    d = full(spark, sf)
    detail = st.corner_lap_detail(d.clean_phases, d.channels)
    return detail.join(st.corner_detail_spreads(detail), st.CORNER)


@query("excluded_laps", "G13", K + "lap_number ~duration_s status reason", "SELECT * FROM c_laps WHERE status <> 'eligible'")
def _(spark, sf):
    f, laps, refs = paired(spark, sf)
    pairs = cp.pair_laps(laps.filter("status = 'eligible'"), refs, ["track_id"])
    from ..operators import grid as gr

    guard = ph.comparison_guard(gr.strip_stale(f, F.lit(LAP_LENGTH_M)), pairs, LAP_LENGTH_M, False)
    return st.excluded_laps(laps, guard)


@query("session_facts", "G14", "session_id segments eligible_laps analysed_laps clean_laps phase_facts ~mean_loss_s priorities ~best_lap_s ~envelope_lap_s measured_corners",
       """SELECT * FROM (SELECT session_id, count(*) AS segments, count_if(status = 'eligible')::BIGINT AS eligible_laps, count_if(status = 'eligible')::BIGINT AS analysed_laps, count_if(clean)::BIGINT AS clean_laps FROM c_laps GROUP BY ALL)
       JOIN (SELECT session_id, count(*) AS phase_facts, avg(loss_s) AS mean_loss_s FROM c_phases GROUP BY ALL) USING (session_id) LEFT JOIN (SELECT session_id, count(*) AS priorities FROM c_prio GROUP BY ALL) USING (session_id)
       LEFT JOIN (SELECT session_id, best_lap_s, envelope_lap_s FROM c_pace) USING (session_id) LEFT JOIN (SELECT session_id, count_if(state <> 'unknown')::BIGINT AS measured_corners FROM c_stab GROUP BY ALL) USING (session_id)""")
def _(spark, sf):
    d = full(spark, sf)
    one = F.count(F.lit(1))
    inv = d.inventory.groupBy("session_id").agg(
        one.alias("segments"), F.count_if(F.col("status") == "eligible").alias("eligible_laps"), F.count_if("clean").alias("clean_laps"))
    laps = d.laps.groupBy("session_id").agg(one.alias("analysed_laps"))
    ph_ = d.phases.groupBy("session_id").agg(one.alias("phase_facts"), F.avg("loss_s").alias("mean_loss_s"))
    pr = d.priorities.groupBy("session_id").agg(one.alias("priorities"))
    rear = d.rear.groupBy("session_id").agg(F.count_if(F.col("state") != "unknown").alias("measured_corners"))
    out = inv.join(laps, "session_id").join(ph_, "session_id").join(pr, "session_id", "left")
    return out.join(d.pace.select("session_id", "best_lap_s", "envelope_lap_s"), "session_id", "left").join(rear, "session_id", "left")


@query("lap_table", "G15", K + "lap_number ~lap_time_s ~delta_s ~vs_best_s clean",
       """SELECT session_id, segment_index, lap_number, duration_s AS lap_time_s, duration_s - ref_duration_s AS delta_s, duration_s - min(CASE WHEN clean THEN duration_s END) OVER (PARTITION BY session_id) AS vs_best_s, clean
       FROM c_clean JOIN c_ref ON TRUE""")
def _(spark, sf):
    f, laps, refs = paired(spark, sf)
    j = laps.filter("status = 'eligible'").join(refs, "track_id")
    return st.lap_table(j.withColumn("lap_time_s", F.col("duration_s")).withColumn("delta_s", F.col("duration_s") - F.col("ref_duration_s")))


cte("c_reply", """SELECT conv_id, turn, text || printf(' You lost %.2f s and 1:%02d.135 in %d laps', conv_id/7, turn*7, conv_id) || CASE WHEN conv_id % 3 = 0 THEN '?' WHEN conv_id % 3 = 1 THEN ' w(12)' ELSE ', ok.' END AS reply,
  printf('gap %.3f s, lap 1:%02d.135, %d laps', conv_id/7, turn*7 % 21, conv_id + turn % 2) AS facts FROM conversations""")


@query("reply_check", "G16", "conv_id turn invented words questions annotated truncated too_long",
       r"""WITH t AS (SELECT *, regexp_extract_all(reply, '\d+:\d{2}\.\d{3}|\d+(?:[.,]\d+)?') AS rt, regexp_extract_all(facts, '\d+:\d{2}\.\d{3}|\d+(?:[.,]\d+)?') AS ft FROM c_reply),
       k AS (SELECT *, [CASE WHEN contains(x, ':') THEN split_part(x, ':', 1)::DOUBLE*60 + split_part(x, ':', 2)::DOUBLE ELSE replace(x, ',', '.')::DOUBLE END FOR x IN ft] AS known FROM t),
       u AS (SELECT conv_id, turn, known, unnest(list_distinct(rt)) AS tok FROM k),
       v AS (SELECT *, CASE WHEN contains(tok, ':') THEN split_part(tok, ':', 1)::DOUBLE*60 + split_part(tok, ':', 2)::DOUBLE ELSE replace(tok, ',', '.')::DOUBLE END AS val, CASE WHEN contains(tok, '.') THEN length(split_part(tok, '.', 2)) ELSE 0 END AS dg FROM u),
       w AS (SELECT *, len(list_filter(known, lambda q: CASE WHEN contains(tok, ':') THEN abs(q - val) < 0.0005e0 ELSE abs(round_even(q*pow(10e0, dg), 0)/pow(10e0, dg) - val) < pow(10e0, -dg - 6) END)) > 0 AS ok FROM v),
       z AS (SELECT conv_id, turn, array_to_string(list_sort(list(tok)), ', ') AS bad FROM w WHERE NOT ok GROUP BY conv_id, turn)
       SELECT r.conv_id, r.turn, coalesce(bad, '') AS invented, len([x FOR x IN regexp_split_to_array(trim(reply), '\s+') IF x <> ''])::INT AS words, (length(reply) - length(replace(reply, '?', '')))::INT AS questions,
       regexp_matches(reply, '\w\(\d+\)') OR contains(reply, 'Count:') AS annotated, reply <> '' AND right(reply, 1) NOT IN ('.', '?', '!', '"', '''') AND NOT suffix(reply, ').') AS truncated,
       len([x FOR x IN regexp_split_to_array(trim(reply), '\s+') IF x <> '']) > 160 AS too_long FROM c_reply r LEFT JOIN z USING (conv_id, turn)""")
def _(spark, sf):
    c = spark.read.parquet(f"{sf}/conversations.parquet")
    k, t = F.col("conv_id"), F.col("turn")
    tail = F.when(k % 3 == 0, "?").when(k % 3 == 1, " w(12)").otherwise(", ok.")
    reply = F.concat("text", F.format_string(" You lost %.2f s and 1:%02d.135 in %d laps", k / 7, t * 7, k), tail)
    facts = F.format_string("gap %.3f s, lap 1:%02d.135, %d laps", k / 7, t * 7 % 21, k + t % 2)
    return st.reply_warnings(c.select("conv_id", "turn", reply.alias("reply"), facts.alias("facts")))


@query("meta_output_filter", "G17", "doc_id meta",
       """SELECT doc_id, t = '' OR t LIKE '-%' OR t LIKE '–%' OR t LIKE '%:' OR regexp_matches(lower(t), '^(let me|i will|as a rule|as a race engineer|sure,|sure\\.|here is|coaching note:|this seems|below is)') AS meta
       FROM (SELECT doc_id, regexp_replace(CASE doc_id % 5 WHEN 0 THEN 'Sure, ' ELSE '' END || text || CASE doc_id % 7 WHEN 0 THEN ':' ELSE ' ' END, '^\\s+|\\s+$', '', 'g') AS t FROM documents)""")
def _(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    text = F.concat(F.when(F.col("doc_id") % 5 == 0, "Sure, ").otherwise(""), "text", F.when(F.col("doc_id") % 7 == 0, ":").otherwise(" "))
    return d.select("doc_id", st.is_meta_output(text).alias("meta"))


cte("c_fuel", """SELECT *, CASE WHEN left_ IS NULL THEN 'UNKNOWN' WHEN left_ < 2 THEN 'CRITICAL' WHEN left_ <= 5 THEN 'WARNING' ELSE 'OK' END AS fuel_status, CASE WHEN session_type = 'race' THEN greatest(0, 20 - mx) END AS race_laps_left FROM (
  SELECT *, CASE WHEN a - b > 0 THEN b/((a - b)/n) END AS left_, CASE WHEN a - b > 0 THEN (a - b)/n END AS per_lap_l, CASE WHEN code BETWEEN 10 AND 13 THEN 'race' WHEN code BETWEEN 5 AND 8 THEN 'quali' WHEN code BETWEEN 0 AND 4 OR code = 9 THEN 'practice' ELSE 'unknown' END AS session_type FROM (
  SELECT session_id, arg_min(fuel_l, frame_id) FILTER (fuel_l > 0 AND fuel_l <= cap) AS a, arg_max(fuel_l, frame_id) FILTER (fuel_l > 0 AND fuel_l <= cap) AS b, count(DISTINCT lap_number) AS n, max(lap_number) AS mx, min(session_type) AS code
  FROM (SELECT *, CASE WHEN frame_id % 40 = 0 THEN 5e0 ELSE fuel_capacity_l END AS cap FROM c_frames) GROUP BY session_id))""")


def _fuel(spark, sf):
    f = base.frames(spark, sf).withColumn("fuel_capacity_l", F.when(F.col("frame_id") % 40 == 0, 5.0).otherwise(F.col("fuel_capacity_l")))
    return st.fuel_facts(f)


@query("fuel_facts", "G18 G19", "session_id session_type ~start_l ~end_l ~used_l laps_completed ~per_lap_l ~laps_left race_laps_left fuel_status",
       "SELECT *, a AS start_l, b AS end_l, a - b AS used_l, n AS laps_completed, left_ AS laps_left FROM c_fuel")
def _(spark, sf):
    return _fuel(spark, sf)


@query("fuel_calls", "G20", "session_id fuel_status ~laps_left race_laps_left",
       "SELECT *, left_ AS laps_left FROM c_fuel WHERE session_type = 'race' AND (fuel_status IN ('WARNING', 'CRITICAL') OR race_laps_left - left_ <= 3)")
def _(spark, sf):
    return st.fuel_calls(_fuel(spark, sf))


@query("fact_payload", "S14", K + "losses gains ~first_loss",
       """SELECT session_id, segment_index, least(3, count_if(l > 0))::INT AS losses, least(3, count_if(l < 0))::INT AS gains, round(max(CASE WHEN l > 0 THEN l END), 3) AS first_loss
       FROM (SELECT *, round(loss_s, 9) AS l FROM c_facts) WHERE l <> 0 GROUP BY ALL""")
def _(spark, sf):
    f, laps, pairs, phases = analysed(spark, sf)
    p = dc.lap_payload(ph.ranked_facts(phases, None))
    losses, gains = "array<struct<loss_s:double>>", "array<struct<loss_s:double>>"
    doc = F.from_json("payload", f"struct<top_losses:{losses},top_gains:{gains}>")
    return p.withColumn("d", doc).withColumn("losses", F.size("d.top_losses")).withColumn("gains", F.size("d.top_gains")).withColumn(
        "first_loss", F.get(F.col("d.top_losses.loss_s"), F.lit(0)))
