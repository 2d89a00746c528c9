"""Lap classification, inventories, lap finders and reference-lap upkeep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_join
from . import segments as sg
from .segments import LAP

# Fixed values of the classification.
MIN_ELIGIBLE_LAPS = 5
IN_LAP_RATIO = 0.85
PIT_LAP_RATIO = 1.20
CLEAN_LAP_RATIO = 1.05
RACING_START_SPEED_KPH = 100.0
PIT_STOP_MIN_S = 1.0
FRAME_INTEGRITY_FACTOR = 2.0
ROW_RATE_TOLERANCE = 0.10
SLOW_LAP_RATIO = 1.15


def measured_laps(seg_frames: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    """All inputs of the classification, one row per segment.

    ``sidecar`` (session_id, sample_rate_hz) overrides the derived sample rate where it has one.
    """
    d = sg.durations(sg.segment_measures(seg_frames), sg.lap_start_clock(seg_frames))
    d = d.join(sg.stationary_seconds(seg_frames), LAP, "left")
    # The session's rate, yardstick and flag trust as windows over its laps: one shuffle of the lap table.
    ws = Window.partitionBy("session_id")
    w = ws.orderBy("segment_index")
    span = F.col("last_clock_s") - F.col("first_clock_s")
    timed = (F.col("frames") >= 2) & (span > 0)
    positive = F.col("duration_s") > 0
    d = (
        d.withColumn("prev_lap_number", F.lag("lap_number").over(w))
        .withColumn("is_last", F.lead("lap_number").over(w).isNull())
        .withColumn("stationary_s", F.coalesce("stationary_s", F.lit(0.0)))
        .withColumn("rate_hz", F.percentile(F.when(timed, F.col("frames") / span), 0.5).over(ws))
    )
    if sidecar is not None:
        d = d.join(sidecar.select("session_id", "sample_rate_hz"), "session_id", "left").withColumn(
            "rate_hz", F.coalesce("sample_rate_hz", "rate_hz")
        )
    interior = positive & (F.col("segment_index") > 0) & ~F.col("is_last")
    return (
        sg.coverage(d)
        .withColumn("row_rate", sg.row_rate_ratio())
        .withColumn("yardstick_s", sg.yardstick_of(interior, positive, ws))
        .withColumn(
            "validity_trusted",
            F.coalesce(F.min("valid_lo").over(ws) != F.max("valid_hi").over(ws), F.lit(False)),
        )
    )


def classify(measured: DataFrame) -> DataFrame:
    """Status and reason of every segment; the first rule that matches wins."""
    dur, frames, rate = F.col("duration_s"), F.col("frames"), F.col("rate_hz")
    expected = dur * rate
    span = F.col("last_clock_s") - F.col("first_clock_s")
    ratio = dur / F.col("yardstick_s")
    stint_start = (F.col("segment_index") == 0) | ((F.col("lap_number") == 0) & (F.col("prev_lap_number") != 0))
    judged = F.col("yardstick_s") > 0
    band_reason = F.format_string("duration %.2fx the session yardstick", ratio)
    rules: list[tuple[Column, str, Column]] = [
        (F.col("is_last"), "incomplete", F.lit("final segment of the session")),
        (F.col("coverage_failure").isNotNull(), "incomplete", F.col("coverage_failure")),
        (
            stint_start & (F.coalesce(F.col("entry_peak_kph"), F.lit(0.0)) < RACING_START_SPEED_KPH),
            "out-lap",
            F.lit("first segment of a stint"),
        ),
        (
            (rate > 0)
            & (dur > 0)
            & ((frames < expected / FRAME_INTEGRITY_FACTOR) | (frames > expected * FRAME_INTEGRITY_FACTOR)),
            "short",
            F.format_string("%d frames for a %.3f s lap", frames, dur),
        ),
        (
            F.abs(F.col("row_rate") - 1.0) > ROW_RATE_TOLERANCE,
            "short",
            F.format_string(
                "%d rows for a %.1f s span at %.0f Hz (%.2fx expected)", frames, span, rate, F.col("row_rate")
            ),
        ),
        (
            F.col("validity_trusted") & F.col("any_invalid"),
            "invalid",
            F.lit("lap marked invalid by the sim"),
        ),
        (judged & (ratio < IN_LAP_RATIO), "in-lap", band_reason),
        (
            judged & (F.col("stationary_s") >= PIT_STOP_MIN_S),
            "pit-lap",
            F.format_string("stopped for %.1f s", "stationary_s"),
        ),
        (judged & (ratio > PIT_LAP_RATIO), "pit-lap", band_reason),
    ]
    verdict = F.struct(F.lit("eligible").alias("status"), F.lit("").alias("reason"))
    for cond, status, reason in reversed(rules):
        verdict = F.when(
            F.coalesce(cond, F.lit(False)), F.struct(F.lit(status).alias("status"), reason.alias("reason"))
        ).otherwise(verdict)
    eligible = F.col("status") == "eligible"
    best = F.min(F.when(eligible & (dur > 0), dur)).over(Window.partitionBy("session_id"))
    return (
        measured.withColumn("v", verdict)
        .withColumn("status", F.col("v.status"))
        .withColumn("reason", F.col("v.reason"))
        .withColumn(
            "valid_flag",
            F.when(F.col("validity_trusted") & F.col("any_invalid"), F.lit(False)).when(
                F.col("validity_trusted") & F.col("all_valid"), F.lit(True)
            ),
        )
        .withColumn("clean", F.coalesce(eligible & (dur > 0) & (dur <= best * CLEAN_LAP_RATIO), F.lit(False)))
        .drop("v")
    )


def classify_laps(seg_frames: DataFrame, sidecar: DataFrame | None = None) -> DataFrame:
    return classify(measured_laps(seg_frames, sidecar))


def inventory_counts(laps: DataFrame) -> DataFrame:
    """Eligible and clean counts per session, and whether a debrief is possible."""
    return (
        laps.groupBy("session_id")
        .agg(
            F.count(F.lit(1)).alias("segments"),
            F.count_if(F.col("status") == "eligible").alias("eligible_laps"),
            F.count_if(F.col("clean")).alias("clean_laps"),
        )
        .withColumn("debrief_ready", F.col("eligible_laps") >= MIN_ELIGIBLE_LAPS)
    )


def lap_summary(seg_frames: DataFrame) -> DataFrame:
    """Frames, duration, sectors and validity per lap; first and last segment show no times."""
    m = sg.segment_measures(seg_frames)
    d = sg.durations(m, sg.lap_start_clock(seg_frames))
    s = sg.sector_times(seg_frames, d)
    w = Window.partitionBy("session_id")
    inner = (F.col("segment_index") > 0) & (F.col("segment_index") < F.max("segment_index").over(w))
    times = ["duration_s", "sector_1_s", "sector_2_s", "sector_3_s"]
    shown = {c: F.when(F.col("inner_lap"), F.col(c)) for c in times}
    return s.withColumn("inner_lap", inner).withColumns(shown)


def viewer_flags(seg_frames: DataFrame, file_times: DataFrame | None = None) -> DataFrame:
    """Partial, rolling-start and fastest flags on rows without stale lap-boundary samples.

    ``file_times(session_id, file_time_s)``: times in file names; that of a file with one lap wins over both clocks.
    """
    lengths = seg_frames.groupBy("session_id").agg(F.max("lap_distance_m").alias("track_len"))
    t, d = F.col("lap_time_s"), F.col("lap_distance_m")
    stale = (t < 0.5) & (d > F.col("track_len") * 0.5)
    cleaned = seg_frames.join(lengths, "session_id").filter(~F.coalesce(stale, F.lit(False)))
    m = cleaned.groupBy(*LAP).agg(
        F.coalesce(F.min("lap_distance_m"), F.lit(0.0)).alias("min_distance_m"),
        F.coalesce(F.max("lap_distance_m"), F.lit(0.0)).alias("max_distance_m"),
        F.greatest(F.max("lap_time_s"), F.lit(0.0)).alias("max_lap_time_s"),
        F.max("scoring_last_lap_time_s").alias("max_scoring_s"),
        F.max("track_len").alias("track_len"),
    )
    durs = sg.durations(m, sg.lap_start_clock(seg_frames))
    ws = Window.partitionBy("session_id")
    if file_times is not None:
        named = (F.count(F.lit(1)).over(ws) == 1) & F.col("file_time_s").isNotNull()
        durs = durs.join(file_times, "session_id", "left").withColumn("duration_s", F.when(named, F.col("file_time_s")).otherwise(F.col("duration_s")))
        durs = durs.withColumn("duration_source", F.when(named, F.lit("file_name")).otherwise(F.col("duration_source"))).drop("file_time_s")
    full = (F.col("max_distance_m") >= F.col("track_len") * 0.95) & (F.abs("min_distance_m") <= 50)
    candidate = full & (F.col("duration_s") > 0)
    by_time = Window.partitionBy("session_id").orderBy(F.when(candidate, F.col("duration_s")).asc_nulls_last())
    med = F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("duration_s"))).over(ws)
    d2 = (
        durs.withColumn("candidate", candidate)
        .withColumn("n", F.count_if("candidate").over(ws))
        .withColumn("rn", F.when(F.col("candidate"), F.row_number().over(by_time)))
        .withColumn("median_s", F.coalesce(med, F.lit(0.0)))
    )
    partial = (
        (F.col("max_distance_m") < F.col("track_len") * 0.95)
        | ((F.col("median_s") > 0) & (F.col("duration_s") > 0) & (F.col("duration_s") < F.col("median_s") * 0.5))
        | ((F.col("median_s") > 0) & is_slow(F.col("duration_s"), F.col("median_s")))
    )
    star = Window.partitionBy("session_id").orderBy(
        F.when(F.col("usable"), F.col("duration_s")).asc_nulls_last(), "segment_index"
    )
    return (
        d2.withColumn("partial", partial)
        .withColumn("rolling", F.abs("min_distance_m") > 50)
        .withColumn("usable", ~F.col("partial") & ~F.col("rolling") & (F.col("duration_s") > 0))
        .withColumn("fastest", F.col("usable") & (F.row_number().over(star) == 1))
    )


def is_slow(lap_s: Column, reference_s: Column) -> Column:
    """Lap implausibly slower than its reference (pit stop, safety car)."""
    return F.coalesce(
        (lap_s > 0) & (reference_s > 0) & (lap_s / reference_s > SLOW_LAP_RATIO + 1e-9), F.lit(False)
    )


def complete_laps(seg_frames: DataFrame, min_rows: int = 100, min_duration_s: float = 60.0) -> DataFrame:
    """Laps that are complete enough to serve as a reference."""
    m = sg.segment_measures(seg_frames)
    d = sg.durations(m, sg.lap_start_clock(seg_frames))
    tail = seg_frames.groupBy(*LAP).agg(F.max_by("lap_distance_m", "frame_id").alias("last_distance_m"))
    span = F.col("last_clock_s") - F.col("first_clock_s")
    ok = (
        (F.col("lap_number") >= 1)
        & (F.col("frames") >= min_rows)
        & (F.col("duration_s") > min_duration_s)
        & (F.abs(span - F.col("duration_s")) <= F.greatest(F.lit(3.0), F.col("duration_s") * 0.05))
        & F.col("min_distance_m").between(-50, 100)
        & (F.col("last_distance_m") >= F.col("max_distance_m") - 200)
        & (F.col("max_distance_m") > 1000)
    )
    found = d.join(tail, LAP).filter(ok)
    w = Window.partitionBy("session_id")
    ranked = found.withColumn(
        "rn", F.row_number().over(Window.partitionBy("session_id").orderBy("frames", "segment_index"))
    ).withColumn("n", F.count(F.lit(1)).over(w))
    typical = F.max(F.when(F.col("rn") == F.floor(F.col("n") / 2) + 1, F.col("frames"))).over(w)
    return ranked.withColumn("typical_frames", typical).filter(F.col("frames") >= 0.95 * F.col("typical_frames"))


def fastest_references(candidates: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fastest complete lap per (track, car) that beats the current reference, and the superseded rows.

    Pairs without a new faster lap keep their rows.
    """
    w = Window.partitionBy("track_id", "car").orderBy("duration_s", "session_id", "segment_index")
    best = candidates.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")
    held = current.groupBy("track_id", "car").agg(F.min("reference_s").alias("held_s"))
    winners = best.join(held, ["track_id", "car"], "left").filter(
        F.col("held_s").isNull() | (F.col("duration_s") < F.col("held_s"))
    )
    old = current.join(winners.select("track_id", "car", "duration_s"), ["track_id", "car"]).filter(
        F.col("reference_s") > F.col("duration_s")
    )
    return winners, old


def reference_change_audit(before: DataFrame, after: DataFrame, prefix: Column) -> DataFrame:
    """Differences of two reference snapshots (name, digest), with the changes that are not allowed flagged."""
    joined = before.select("name", F.col("digest").alias("old_digest")).join(
        after.select("name", F.col("digest").alias("new_digest")), "name", "full_outer"
    )
    change = (
        F.when(F.col("old_digest").isNull(), "added")
        .when(F.col("new_digest").isNull(), "removed")
        .when(F.col("old_digest") != F.col("new_digest"), "modified")
    )
    c = joined.withColumn("change", change).filter(F.col("change").isNotNull()).withColumn("in_target", prefix)
    kinds = c.groupBy("change").agg(F.count(F.lit(1)).alias("n"))  # three rows at most
    allowed = F.col("in_target") & (F.col("change") != "modified") & ((F.col("change") != "added") | (F.col("n") <= 1))
    return c.join(F.broadcast(kinds), "change").withColumn("allowed", allowed).drop("n")


def validate_references(references: DataFrame, laps: DataFrame) -> DataFrame:
    """Checks of stored reference laps; ``laps`` supplies possible origins of the same track and car."""
    key = ["track_id", "car"]
    around = references.select(*key, "name", "reference_s", (F.col("reference_s") - 0.006).alias("lo"), (F.col("reference_s") + 0.006).alias("hi"))
    near = range_join(laps.select(*key, F.col("duration_s").alias("origin_s")), around, key, "origin_s", "lo", "hi", bucket_m=0.05)
    origins = near.filter(F.abs(F.col("reference_s") - F.col("origin_s")) <= 0.005).groupBy(*key, "name").agg(F.count(F.lit(1)).alias("origins"))
    g = references.join(origins, [*key, "name"], "left").withColumn("origins", F.coalesce("origins", F.lit(0).cast("long")))
    return (
        g.withColumn("one_segment", F.col("segments") == 1)
        .withColumn("time_ok", F.abs(F.col("max_lap_time_s") - F.col("reference_s")) <= 1.5)
        .withColumn(
            "rate_ok", F.abs(F.col("frames") / (F.col("reference_s") * F.col("rate_hz")) - 1.0) <= 0.10
        )
        .withColumn("has_origin", F.col("origins") > 0)
    )


def lap_number_summary(frames: DataFrame) -> DataFrame:
    """Per lap number: rows, time, distance; complete when the lap clock passed a minute."""
    return frames.groupBy("session_id", "lap_number").agg(
        F.count(F.lit(1)).alias("frames"),
        F.max("lap_time_s").alias("max_lap_time_s"),
        F.max("lap_distance_m").alias("max_distance_m"),
        F.max("speed_kph").alias("max_speed_kph"),
        (F.max("lap_time_s") > 60).alias("complete"),
    )


def fastest_laps(summary: DataFrame, n: int) -> DataFrame:
    return summary.filter("complete").orderBy("max_lap_time_s", "session_id", "lap_number").limit(n)


def without_ghosts(laps: DataFrame, min_frames: int = 50) -> DataFrame:
    """Laps worth analysing: enough frames and a positive time."""
    return laps.filter((F.col("frames") >= min_frames) & (F.col("duration_s") > 0))


def segment_for_lap(segments: DataFrame, wanted: DataFrame) -> DataFrame:
    """First segment with the wanted lap number, else the first segment of the session."""
    hit = (
        wanted.join(segments, ["session_id", "lap_number"], "left")
        .groupBy("session_id", "lap_number")
        .agg(F.min("segment_index").alias("segment_index"))
    )
    return hit.withColumn("found", F.col("segment_index").isNotNull()).withColumn(
        "segment_index", F.coalesce("segment_index", F.lit(0))
    )


def audit_classification(seg_frames: DataFrame, laps: DataFrame) -> DataFrame:
    """Records of ``laps`` that the frames do not bear out, with the ``faults`` found: one row per bad record.

    Only what the record claims is taken from it: frame range, status, reason, clean flag.  All evidence comes from the
    frames.  Every status has its ground, and a record is right when its ground holds and none of higher rank does; an
    eligible record needs that none holds at all.  Records without a segment, and segments without a record, are bad too.
    """
    m = measured_laps(seg_frames)
    w = Window.partitionBy("session_id")
    longest = F.max("max_distance_m").over(w)
    span = F.col("last_clock_s") - F.col("first_clock_s")
    nominal, ratio = F.col("duration_s") * F.col("rate_hz"), F.col("duration_s") / F.col("yardstick_s")
    opens_stint = (F.col("segment_index") == 0) | ((F.col("lap_number") == 0) & (F.col("prev_lap_number") != 0))
    grounds = {
        "incomplete": F.col("is_last") | (F.col("max_distance_m") < 0.8 * longest) | (F.col("min_distance_m") > 0.1 * longest),
        "out-lap": opens_stint & ~F.coalesce(F.col("entry_peak_kph") >= RACING_START_SPEED_KPH, F.lit(False)),
        "short": ((nominal > 0) & ~(F.col("frames") / nominal).between(1 / FRAME_INTEGRITY_FACTOR, FRAME_INTEGRITY_FACTOR))
        | (F.abs(F.col("frames") / (span * F.col("rate_hz")) - 1) > ROW_RATE_TOLERANCE),
        "invalid": F.col("validity_trusted") & F.col("any_invalid"),
        "in-lap": (F.col("yardstick_s") > 0) & (ratio < IN_LAP_RATIO),
        "pit-lap": (F.col("yardstick_s") > 0) & ((F.col("stationary_s") >= PIT_STOP_MIN_S) | (ratio > PIT_LAP_RATIO)),
    }
    holds = F.array(*[F.when(F.coalesce(g, F.lit(False)), F.lit(status)) for status, g in grounds.items()])
    m = m.withColumn("held", F.array_compact(holds)).withColumn("sound", F.size("held") == 0)
    fastest = F.min(F.when(F.col("sound") & (F.col("duration_s") > 0), F.col("duration_s"))).over(w)
    m = m.withColumn("quick", F.coalesce(F.col("sound") & (F.col("duration_s") > 0) & (F.col("duration_s") <= CLEAN_LAP_RATIO * fastest), F.lit(False)))
    seen = m.select(*LAP, "held", "sound", "quick", F.col("start_frame").alias("first_frame"), F.col("end_frame").alias("final_frame"), F.lit(True).alias("real"))
    claims = laps.select(*LAP, "status", "reason", "clean", "start_frame", "end_frame", F.lit(True).alias("claimed"))
    j = claims.join(seen, LAP, "full_outer")
    right = F.when(F.col("status") == "eligible", F.col("sound")).otherwise(F.get("held", F.lit(0)) == F.col("status"))
    checks = {
        "no such segment": F.col("real").isNull(),
        "no record": F.col("claimed").isNull(),
        "status": ~F.coalesce(right, F.lit(False)),
        "clean flag": ~F.col("clean").eqNullSafe(F.col("quick")),
        "reason": (F.coalesce("reason", F.lit("")) == "") != (F.col("status") == "eligible"),
        "frame range": ~F.col("start_frame").eqNullSafe(F.col("first_frame")) | ~F.col("end_frame").eqNullSafe(F.col("final_frame")),
    }
    faults = F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks.items()]))
    return j.withColumn("faults", faults).filter(F.size("faults") > 0).select(*LAP, "status", "faults")
