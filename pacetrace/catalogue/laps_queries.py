"""Segments, measurements, classification and lap finders (inventory rows L1–L25)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.storage import scratch_path
from ..operators import laps as lp
from ..operators import segments as sg
from ..sources import lap_files as lf
from ..sources import sessions as ss
from . import base
from .registry import cte, query

K = "session_id segment_index "


@query("lap_segments", "L1", K + "lap_number start_frame next_start_frame",
       """SELECT session_id, segment_index, lap_number, start_frame,
       lead(start_frame) OVER (PARTITION BY session_id ORDER BY segment_index) AS next_start_frame FROM c_meas""")
def _(spark, sf):
    return sg.build_segments(base.frames(spark, sf))


@query("lap_start_clock", "L2", K + "~lap_start_s", "SELECT * FROM c_start")
def _(spark, sf):
    return sg.lap_start_clock(base.seg_frames(spark, sf))


@query("lap_duration", "L3", K + "~duration_s duration_source", "SELECT * FROM c_dur")
def _(spark, sf):
    f = base.seg_frames(spark, sf)
    return sg.durations(sg.segment_measures(f), sg.lap_start_clock(f))


# Laps as files of their own: every third with its time in the footer, every second one with a time in its name.
LAP_FILE = "CASE WHEN segment_index % 2 = 0 THEN 'session_' || session_id || '-' || segment_index || '_time_1.3' || segment_index % 10 || '.5' || segment_index % 7 || '0' ELSE 'session_' || session_id || '-' || segment_index END"
cte("c_files", f"""SELECT *, {LAP_FILE} AS file, CASE WHEN segment_index % 3 = 0 THEN max_lap_time_s + 0.25e0 END AS recorded_s, CASE WHEN segment_index % 2 = 0 THEN 90 + segment_index % 10 + (5e2 + 1e1*(segment_index % 7))/1e3 END AS named_s FROM c_meas""")


def lap_files(spark, sf):
    """Frames of the lap files, and their footers."""
    f = base.seg_frames(spark, sf)
    m = sg.segment_measures(f).select(*sg.LAP, F.when(F.col("segment_index") % 3 == 0, F.col("max_lap_time_s") + 0.25).alias("recorded_s"), F.expr(LAP_FILE).alias("stem"))
    cols = ["frame_id", "session_time_s", "lap_number", "lap_time_s", "lap_distance_m", "speed_kph", "scoring_last_lap_time_s", "lap_valid"]
    folder = scratch_path(spark, "laps")
    named = f.join(m, sg.LAP).withColumn("name", F.concat("stem", F.lit(".parquet")))
    lf.write_lap_files(named.select(*sg.LAP, *cols, "recorded_s", "name"), folder, sg.LAP, "name", "recorded_s").count()
    schema = named.select(*cols).drop("frame_id").schema
    return sg.with_segments(ss.read_sessions(spark, folder, schema)), lf.read_footers(spark, folder)


@query("recorded_lap_duration", "L3", K + "~duration_s duration_source",
       """SELECT file AS session_id, 0 AS segment_index, CASE WHEN recorded_s IS NOT NULL THEN recorded_s WHEN own THEN max_scoring_s ELSE max_lap_time_s END AS duration_s,
       CASE WHEN recorded_s IS NOT NULL THEN 'explicit' WHEN own THEN 'own_scorer' ELSE 'lap_time' END AS duration_source FROM (SELECT *, coalesce(max_lap_time_s > 0 AND abs(max_scoring_s - max_lap_time_s) <= 1, FALSE) AS own FROM c_files)""")
def _(spark, sf):
    f, footers = lap_files(spark, sf)
    measures = sg.segment_measures(f).join(lf.recorded_times(footers), "session_id", "left")
    return sg.durations(measures, sg.lap_start_clock(f), same_segment_scoring=True)


@query("lap_viewer_file_time", "L16", K + "~duration_s duration_source",
       """WITH m AS (SELECT session_id, segment_index, max(lap_time_s) AS mt FROM c_seg JOIN (SELECT session_id, segment_index, max(lap_distance_m) AS l FROM c_seg GROUP BY ALL) USING (session_id, segment_index)
         WHERE NOT (lap_time_s < 0.5e0 AND lap_distance_m > l*0.5e0) GROUP BY ALL)
       SELECT file AS session_id, 0 AS segment_index, coalesce(named_s, greatest(mt, 0e0)) AS duration_s, CASE WHEN named_s IS NOT NULL THEN 'file_name' ELSE 'lap_time' END AS duration_source FROM c_files JOIN m USING (session_id, segment_index)""")
def _(spark, sf):
    f, footers = lap_files(spark, sf)
    return lp.viewer_flags(f, lf.file_times(footers))


@query("sample_rate", "L4", "session_id ~rate_hz", "SELECT * FROM c_rate")
def _(spark, sf):
    return sg.sample_rate(sg.segment_measures(base.seg_frames(spark, sf)))


@query("stationary_time", "L5", K + "~stationary_s", "SELECT * FROM c_stat")
def _(spark, sf):
    return sg.stationary_seconds(base.seg_frames(spark, sf))


@query("entry_peak_speed", "L6", K + "~entry_peak_kph", "SELECT * FROM c_meas")
def _(spark, sf):
    return sg.segment_measures(base.seg_frames(spark, sf))


@query("row_rate", "L7", K + "frames ~row_rate", "SELECT * FROM c_all")
def _(spark, sf):
    m = sg.segment_measures(base.seg_frames(spark, sf))
    return sg.row_rate(m, sg.sample_rate(m))


@query("yardstick", "L8", "session_id ~yardstick_s", "SELECT * FROM c_yard")
def _(spark, sf):
    f = base.seg_frames(spark, sf)
    return sg.yardstick(sg.durations(sg.segment_measures(f), sg.lap_start_clock(f)))


@query("validity_trust", "L9", "session_id validity_trusted", "SELECT * FROM c_trust")
def _(spark, sf):
    return sg.validity_trust(sg.segment_measures(base.seg_frames(spark, sf)))


@query("sector_times", "L10", K + "~sector_1_s ~sector_2_s ~sector_3_s",
       """SELECT d.session_id, d.segment_index, s1 AS sector_1_s, cum - s1 AS sector_2_s, duration_s - cum AS sector_3_s
       FROM c_dur d LEFT JOIN c_sect s USING (session_id, segment_index)""")
def _(spark, sf):
    f = base.seg_frames(spark, sf)
    return sg.sector_times(f, sg.durations(sg.segment_measures(f), sg.lap_start_clock(f)))


@query("lap_coverage", "L11", K + "~lap_length_m coverage_failure",
       """SELECT *, CASE WHEN max_distance_m < lap_length_m*0.8e0 THEN printf('lap ends at %.0f m', max_distance_m)
       WHEN min_distance_m > lap_length_m*0.1e0 THEN printf('lap starts at %.0f m', min_distance_m) END AS coverage_failure FROM c_all""")
def _(spark, sf):
    return sg.coverage(sg.segment_measures(base.seg_frames(spark, sf)))


@query("lap_inventory", "L12 L13 L14",
       K + "lap_number start_frame end_frame frames ~duration_s status reason valid_flag clean", "SELECT * FROM c_laps")
def _(spark, sf):
    return base.laps(spark, sf)


@query("lap_inventory_counts", "L14", "session_id segments eligible_laps clean_laps debrief_ready",
       """SELECT session_id, count(*) AS segments, count_if(status = 'eligible')::BIGINT AS eligible_laps, count_if(clean)::BIGINT AS clean_laps,
       count_if(status = 'eligible') >= 5 AS debrief_ready FROM c_laps GROUP BY ALL""")
def _(spark, sf):
    return lp.inventory_counts(base.laps(spark, sf))


@query("lap_summary", "L15", K + "lap_number frames ~duration_s ~sector_1_s ~sector_2_s ~sector_3_s all_valid",
       """SELECT session_id, segment_index, lap_number, frames, all_valid, CASE WHEN i THEN duration_s END AS duration_s, CASE WHEN i THEN s1 END AS sector_1_s,
       CASE WHEN i THEN cum - s1 END AS sector_2_s, CASE WHEN i THEN duration_s - cum END AS sector_3_s FROM (
       SELECT d.*, s.s1, s.cum, segment_index > 0 AND segment_index < max(segment_index) OVER (PARTITION BY session_id) AS i
       FROM c_dur d LEFT JOIN c_sect s USING (session_id, segment_index))""")
def _(spark, sf):
    return lp.lap_summary(base.seg_frames(spark, sf))


@query("lap_viewer_flags", "L16 P9", K + "~duration_s ~min_distance_m ~max_distance_m partial rolling fastest",
       """WITH tl AS (SELECT session_id, max(lap_distance_m) AS l FROM c_frames GROUP BY ALL),
       m AS (SELECT session_id, segment_index, min(lap_distance_m) AS min_distance_m, max(lap_distance_m) AS max_distance_m,
         max(lap_time_s) AS mt, max(scoring_last_lap_time_s) AS ms, max(l) AS l
         FROM c_seg JOIN tl USING (session_id) WHERE NOT (lap_time_s < 0.5e0 AND lap_distance_m > l*0.5e0) GROUP BY ALL),
       x AS (SELECT m.*, lead(lap_start_s) OVER w - lap_start_s AS tel, lead(ms) OVER w AS sco FROM m JOIN c_start USING (session_id, segment_index)
         WINDOW w AS (PARTITION BY m.session_id ORDER BY m.segment_index)),
       d AS (SELECT *, CASE WHEN tel > 0 AND abs(tel - mt) <= 1 THEN tel WHEN sco IS NOT NULL AND abs(sco - mt) <= 1 THEN sco ELSE mt END AS duration_s FROM x),
       c AS (SELECT session_id, list_sort(list(duration_s)) AS ds FROM d WHERE max_distance_m >= l*0.95e0 AND abs(min_distance_m) <= 50 GROUP BY ALL),
       e AS (SELECT d.*, coalesce(ds[len(ds)//2 + 1], 0e0) AS med FROM d LEFT JOIN c USING (session_id)),
       f AS (SELECT *, max_distance_m < l*0.95e0 OR (med > 0 AND duration_s < med*0.5e0) OR (med > 0 AND duration_s/med > 1.15e0 + 1e-9) AS partial,
         abs(min_distance_m) > 50 AS rolling FROM e)
       SELECT *, NOT partial AND NOT rolling AND row_number() OVER (PARTITION BY session_id ORDER BY CASE WHEN NOT partial AND NOT rolling THEN duration_s END NULLS LAST,
         segment_index) = 1 AS fastest FROM f""")
def _(spark, sf):
    return lp.viewer_flags(base.seg_frames(spark, sf))


COMPLETE = """SELECT d.*, row_number() OVER (PARTITION BY session_id ORDER BY frames, segment_index) AS r, count(*) OVER (PARTITION BY session_id) AS n
  FROM c_dur d WHERE lap_number >= 1 AND frames >= 20 AND duration_s > 60 AND abs(last_clock_s - first_clock_s - duration_s) <= greatest(3e0, duration_s*0.05e0)
  AND min_distance_m BETWEEN -50 AND 100 AND last_distance_m >= max_distance_m - 200 AND max_distance_m > 1000"""
COMPLETE = f"""SELECT * FROM (SELECT *, max(CASE WHEN r = n//2 + 1 THEN frames END) OVER (PARTITION BY session_id) AS typical_frames FROM ({COMPLETE}))
  WHERE frames >= 0.95e0 * typical_frames"""


@query("complete_laps", "L17", K + "lap_number frames typical_frames ~duration_s", COMPLETE)
def _(spark, sf):
    return lp.complete_laps(base.seg_frames(spark, sf), min_rows=base.MIN_ROWS)


def _current_references(laps):
    """Stand-in catalogue of earlier references: two per session, one fast and one slow."""
    return laps.groupBy("session_id").agg(
        F.min("duration_s").alias("a"), (F.max("duration_s") + 5e-1).alias("b")
    ).select("session_id", F.explode(F.array("a", "b")).alias("reference_s")).select(
        F.lit("nation-ring").alias("track_id"), F.col("session_id").alias("car"), "reference_s"
    )


@query("fastest_reference", "L18", "track_id car session_id segment_index ~duration_s",
       f"""WITH c AS ({COMPLETE}), cur AS (SELECT session_id, max(duration_s) + 5e-1 AS h FROM c_laps GROUP BY ALL)
       SELECT 'nation-ring' AS track_id, session_id AS car, session_id, segment_index, duration_s FROM (
       SELECT c.*, row_number() OVER (PARTITION BY session_id ORDER BY duration_s, segment_index) AS q FROM c) JOIN cur USING (session_id)
       WHERE q = 1 AND duration_s < h""")
def _(spark, sf):
    f = base.seg_frames(spark, sf)
    cand = lp.complete_laps(f, min_rows=base.MIN_ROWS).withColumn("track_id", F.lit("nation-ring")).withColumn(
        "car", F.col("session_id"))
    current = _current_references(lp.classify_laps(f)).groupBy("track_id", "car").agg(
        F.max("reference_s").alias("reference_s"))
    return lp.fastest_references(cand, current)[0]


@query("superseded_references", "L18", "track_id car ~reference_s",
       f"""WITH c AS ({COMPLETE}), cur AS (SELECT session_id, max(duration_s) + 5e-1 AS h FROM c_laps GROUP BY ALL)
       SELECT 'nation-ring' AS track_id, session_id AS car, h AS reference_s FROM cur JOIN (SELECT session_id, min(duration_s) AS b FROM c GROUP BY ALL)
       USING (session_id) WHERE b < h""")
def _(spark, sf):
    f = base.seg_frames(spark, sf)
    cand = lp.complete_laps(f, min_rows=base.MIN_ROWS).withColumn("track_id", F.lit("nation-ring")).withColumn(
        "car", F.col("session_id"))
    current = _current_references(lp.classify_laps(f)).groupBy("track_id", "car").agg(
        F.max("reference_s").alias("reference_s"))
    return lp.fastest_references(cand, current)[1]


@query("reference_change_audit", "L19", "name change allowed",
       """WITH b AS (SELECT s_name AS name, s_nationkey AS dg FROM supplier WHERE s_suppkey % 9 <> 0),
       a AS (SELECT s_name AS name, CASE WHEN s_suppkey % 25 = 0 THEN -1 ELSE s_nationkey END AS dg FROM supplier WHERE s_suppkey % 7 <> 0),
       c AS (SELECT name, CASE WHEN b.dg IS NULL THEN 'added' WHEN a.dg IS NULL THEN 'removed' WHEN a.dg <> b.dg THEN 'modified' END AS change FROM b FULL JOIN a USING (name))
       SELECT name, change, name LIKE 'Supplier#00000000%' AND change <> 'modified' AND (change <> 'added' OR count(*) OVER (PARTITION BY change) <= 1) AS allowed
       FROM c WHERE change IS NOT NULL""")
def _(spark, sf):
    s = spark.read.parquet(f"{sf}/supplier.parquet")
    before = s.filter("s_suppkey % 9 <> 0").select(F.col("s_name").alias("name"), F.col("s_nationkey").alias("digest"))
    after = s.filter("s_suppkey % 7 <> 0").select(
        F.col("s_name").alias("name"),
        F.when(F.col("s_suppkey") % 25 == 0, -1).otherwise(F.col("s_nationkey")).alias("digest"),
    )
    return lp.reference_change_audit(before, after, F.col("name").startswith("Supplier#00000000"))


@query("reference_validation", "L20", "name one_segment time_ok rate_ok has_origin origins",
       """WITH r AS (SELECT session_id AS car, 'ref_' || session_id || '_' || segment_index AS name, frames, max_lap_time_s, rate_hz,
         CASE WHEN segment_index % 4 = 0 THEN duration_s + 2 ELSE duration_s END AS rs FROM c_laps WHERE clean)
       SELECT name, TRUE AS one_segment, abs(max_lap_time_s - rs) <= 1.5e0 AS time_ok, abs(frames/(rs*rate_hz) - 1) <= 0.1e0 AS rate_ok,
       o > 0 AS has_origin, o AS origins FROM (SELECT r.*, (SELECT count(*) FROM c_laps l WHERE l.session_id = r.car AND l.status = 'eligible'
         AND abs(l.duration_s - r.rs) <= 0.005e0) AS o FROM r)""")
def _(spark, sf):
    from ..functions.storage import materialise

    laps = materialise(base.laps(spark, sf)).withColumn("track_id", F.lit("nation-ring")).withColumn(
        "car", F.col("session_id"))
    refs = laps.filter("clean").select(
        "track_id", "car",
        F.concat_ws("_", F.lit("ref"), "session_id", "segment_index").alias("name"),
        F.lit(1).alias("segments"), "frames", "max_lap_time_s", "rate_hz",
        F.when(F.col("segment_index") % 4 == 0, F.col("duration_s") + 2).otherwise(F.col("duration_s")).alias("reference_s"),
    )
    return lp.validate_references(refs, laps.filter("status = 'eligible'"))


#: Faults put into the records of a session, by the remainder of the segment's number: statuses first.
FAULTS = ("eligible", "short", "pit-lap", "invalid", "in-lap", "out-lap", "incomplete", "clean flag", "reason", "frame range", "none")


@query("classification_audit", "L21", K + "fault flagged",
       f"""WITH f AS (SELECT *, ({list(FAULTS)})[1 + segment_index % {len(FAULTS)}] AS fault FROM c_laps)
       SELECT session_id, segment_index, fault, CASE WHEN fault IN ('clean flag', 'frame range') THEN TRUE WHEN fault = 'reason' THEN status <> 'eligible' WHEN fault = 'none' THEN FALSE ELSE fault <> status END AS flagged FROM f""")
def _(spark, sf):
    from ..functions.storage import materialise

    f = base.seg_frames(spark, sf)
    laps = materialise(lp.classify_laps(f))
    fault = F.element_at(F.array(*map(F.lit, FAULTS)), 1 + F.col("segment_index") % len(FAULTS))
    bent = laps.withColumn("fault", fault).withColumns({
        "status": F.when(F.col("fault").isin(*FAULTS[:7]), F.col("fault")).otherwise(F.col("status")),
        "clean": (F.col("fault") == "clean flag") != F.col("clean"),
        "reason": F.when(F.col("fault") != "reason", F.col("reason")).otherwise(F.lit("")),
        "start_frame": F.col("start_frame") + (F.col("fault") == "frame range").cast("int"),
    })
    bad = lp.audit_classification(f, bent).select("session_id", "segment_index", F.lit(True).alias("found"))
    return bent.join(bad, ["session_id", "segment_index"], "left").withColumn("flagged", F.coalesce("found", F.lit(False)))


@query("lap_number_summary", "L22", "session_id lap_number frames ~max_lap_time_s ~max_distance_m ~max_speed_kph complete",
       """SELECT session_id, lap_number, count(*) AS frames, max(lap_time_s) AS max_lap_time_s, max(lap_distance_m) AS max_distance_m,
       max(speed_kph) AS max_speed_kph, max(lap_time_s) > 60 AS complete FROM c_frames GROUP BY ALL""")
def _(spark, sf):
    return lp.lap_number_summary(base.frames(spark, sf))


@query("fastest_laps", "L22", "session_id lap_number ~max_lap_time_s",
       """SELECT session_id, lap_number, max(lap_time_s) AS max_lap_time_s FROM c_frames GROUP BY ALL HAVING max(lap_time_s) > 60
       ORDER BY 3, 1, 2 LIMIT 10""")
def _(spark, sf):
    return lp.fastest_laps(lp.lap_number_summary(base.frames(spark, sf)), 10)


@query("ghost_lap_filter", "L23", K + "frames ~duration_s", "SELECT * FROM c_dur WHERE frames >= 50 AND duration_s > 0")
def _(spark, sf):
    f = base.seg_frames(spark, sf)
    return lp.without_ghosts(sg.durations(sg.segment_measures(f), sg.lap_start_clock(f)))


@query("slow_lap_guard", "L24", K + "slow",
       """SELECT session_id, segment_index, duration_s > 0 AND r > 0 AND duration_s/r > 1.15e0 + 1e-9 AS slow FROM c_laps
       JOIN (SELECT session_id, min(CASE WHEN duration_s > 0 THEN duration_s END) AS r FROM c_laps GROUP BY ALL) USING (session_id)""")
def _(spark, sf):
    f = base.seg_frames(spark, sf)
    d = sg.durations(sg.segment_measures(f), sg.lap_start_clock(f))
    best = d.filter("duration_s > 0").groupBy("session_id").agg(F.min("duration_s").alias("best_s"))
    return d.join(best, "session_id").withColumn("slow", lp.is_slow(F.col("duration_s"), F.col("best_s")))


@query("segment_lookup", "L25", "session_id lap_number segment_index found",
       """SELECT session_id, w AS lap_number, coalesce(min(segment_index), 0) AS segment_index, min(segment_index) IS NOT NULL AS found
       FROM (SELECT DISTINCT session_id, lap_number * 2 AS w FROM c_frames) LEFT JOIN c_meas m USING (session_id)
       WHERE m.lap_number = w OR NOT EXISTS (SELECT 1 FROM c_meas x WHERE x.session_id = m.session_id AND x.lap_number = w) GROUP BY ALL"""
       .replace("min(segment_index)", "min(CASE WHEN m.lap_number = w THEN segment_index END)"))
def _(spark, sf):
    f = base.frames(spark, sf)
    wanted = f.select("session_id", (F.col("lap_number") * 2).alias("lap_number")).distinct()
    return lp.segment_for_lap(sg.build_segments(f), wanted)
