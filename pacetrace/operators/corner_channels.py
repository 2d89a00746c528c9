"""What a lap did inside each corner: gears, brakes, steering, aids, line, rear slip, and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK_ROWS, kth_values, scan
from ..functions.ranges import range_join
from ..functions.storage import materialise
from .phases import corner_bounds
from .segments import LAP

LAP_CORNER = [*LAP, "corner_id"]

# Fixed values of the measurements.
SAMPLE_TOLERANCE_M = 5.0
GEAR_TOLERANCE_M = 20.0
STEERING_STEP = 0.02
BRAKE_ON = 0.05
TRAIL_MIN_BRAKE_PEAK = 0.10
FLAG_SLIP_MAX_DEG = 60.0
SLIP_SANE_MAX_DEG = 45.0
MIN_SPEED_KPH = 30.0
APEX_HALF_WINDOW_M = 15.0
PEAK_PERCENTILE = 0.95
MIN_COVERAGE = 0.6
MIN_SAMPLES = 5
MAX_INSANE_SHARE = 0.10
INSTABILITY_MIN_DEG = 3.0
INSTABILITY_BASELINE_FACTOR = 1.5

FLAG_CHANNELS = ("tc_active", "abs_active")
SLIP_CHANNELS = ("slip_angle_rl_deg", "slip_angle_rr_deg")
GRIP_CHANNELS = ("grip_fraction_rl", "grip_fraction_rr")
GROUND_CHANNELS = (
    "wheel_ground_vel_lat_rl", "wheel_ground_vel_lon_rl", "wheel_ground_vel_lat_rr", "wheel_ground_vel_lon_rr",
)


def _finite(c: Column) -> Column:
    return F.when(~F.isnan(c), c)


def unmeasurable_channels(frames: DataFrame) -> DataFrame:
    """Aid flags and slip angles a session cannot support, with the reason: (session_id, channel, reason)."""
    present = set(frames.columns)
    aggs, reasons = [F.count(F.lit(1)).alias("rows")], []
    for c in FLAG_CHANNELS:
        if c in present:
            aggs += [F.count(c).alias(f"{c}_known"), F.max(c).alias(f"{c}_any")]
            few = F.col(f"{c}_known") < F.col("rows") * 0.5
            text = F.format_string(
                "only %d of %d samples are recorded, so a duty cannot be computed", f"{c}_known", "rows"
            )
            reason = F.when(few, text).when(
                ~F.coalesce(F.col(f"{c}_any"), F.lit(False)), "never active in this session (dead channel or unused)"
            )
        else:
            reason = F.lit("channel absent from this recording")
        reasons.append((c, reason))
    for c in SLIP_CHANNELS:
        if c in present:
            aggs.append(F.max(F.abs(_finite(F.col(c)))).alias(f"{c}_max"))
            ok = F.coalesce(F.col(f"{c}_max") <= FLAG_SLIP_MAX_DEG, F.lit(False))
            reason = F.when(~ok, "not a tyre slip angle: the value wraps or exceeds the sane range")
        else:
            reason = F.lit("channel absent from this recording")
        reasons.append((c, reason))
    return _unpivot_reasons(frames.groupBy("session_id").agg(*aggs), reasons)


def dead_channels(frames: DataFrame) -> DataFrame:
    """Rear-grip channels that carry no signal: (session_id, channel, reason)."""
    present = set(frames.columns)
    aggs, reasons = [F.count(F.lit(1)).alias("rows")], []
    for c in (*GRIP_CHANNELS, *GROUND_CHANNELS):
        if c not in present:
            reasons.append((c, F.lit("channel absent from this recording")))
            continue
        v = _finite(F.col(c).cast("double"))
        aggs += [F.max(F.abs(v)).alias(f"{c}_abs"), F.min(v).alias(f"{c}_lo"), F.max(v).alias(f"{c}_hi")]
        silent = F.col(f"{c}_abs") < 1e-6
        if c in GRIP_CHANNELS:
            silent = silent & (F.col(f"{c}_lo") == F.col(f"{c}_hi"))
        reasons.append(
            (c, F.when(F.col(f"{c}_abs").isNull(), "no usable samples in this recording").when(
                silent, "constant 0.0 in every sample of this recording"))
        )
    return _unpivot_reasons(frames.groupBy("session_id").agg(*aggs), reasons)


def _unpivot_reasons(per_session: DataFrame, reasons: Sequence[tuple[str, Column]]) -> DataFrame:
    items = F.array(*[F.struct(F.lit(c).alias("channel"), r.cast("string").alias("reason")) for c, r in reasons])
    return (
        per_session.select("session_id", F.explode(items).alias("i"))
        .select("session_id", "i.channel", "i.reason")
        .filter(F.col("reason").isNotNull())
    )


def rear_slip_angle() -> Column:
    """Signed rear slip angle in degrees from the ground velocities of both rear wheels."""
    lat = [_finite(F.col(f"wheel_ground_vel_lat_{w}")) for w in ("rl", "rr")]
    lon = [_finite(F.col(f"wheel_ground_vel_lon_{w}")) for w in ("rl", "rr")]
    mean_lat, mean_lon = (lat[0] + lat[1]) * 0.5, (lon[0] + lon[1]) * 0.5
    return F.when(F.abs(mean_lon) >= 1e-6, F.degrees(F.atan2(mean_lat, F.abs(mean_lon))))


def driver_windows(laps: DataFrame, corners: DataFrame, phases: DataFrame) -> DataFrame:
    """Window of each corner on each lap, from the lap's phases where detected, else from the model.

    ``laps`` has LAP and ``track_id``; the furthest exit and the furthest straight end count.
    """
    is_exit = F.col("phase").isin("exit", "exit_brake", "exit_throttle")
    found = phases.groupBy(*LAP_CORNER).agg(
        F.max(F.when(F.col("phase") == "entry", F.col("phase_distance_m"))).alias("entry_m"),
        F.max(F.when(F.col("phase") == "minimum_speed", F.col("driver_apex_distance_m"))).alias("found_apex_m"),
        F.max(F.when(is_exit, F.col("phase_distance_m"))).alias("exit_m"),
        F.max("gain_end_distance_m").alias("found_end_m"),
        F.lit("phases").alias("found_source"),
    )
    base = laps.select(*LAP, "track_id").join(corner_bounds(corners), "track_id")
    return (
        base.join(found, LAP_CORNER, "left")
        .withColumn("apex_m", F.coalesce("found_apex_m", "apex_s_m"))
        .withColumn("straight_end_m", F.greatest("s_end_m", "found_end_m"))
        .withColumn("window_source", F.coalesce("found_source", F.lit("corner_model")))
    )


def reference_windows(references: DataFrame, corners: DataFrame, phases: DataFrame) -> DataFrame:
    """Windows of the reference lap, read off the comparisons: medians, and the furthest straight end."""
    is_exit = F.col("phase").isin("exit", "exit_brake", "exit_throttle")
    ref_s = F.col("reference_phase_distance_m")
    by = [c for c in references.columns if c in phases.columns] + ["corner_id"]
    # One row per value and measure; the two middle values of each measure give its median, whatever the number of laps.
    values = F.array(
        F.struct(F.lit("entry_m").alias("m"), F.when(F.col("phase") == "entry", ref_s).alias("v")),
        F.struct(F.lit("found_apex_m").alias("m"), F.when(F.col("phase") == "minimum_speed", F.col("reference_apex_distance_m")).alias("v")),
        F.struct(F.lit("exit_m").alias("m"), F.when(is_exit, ref_s).alias("v")),
    )
    each = phases.select(*by, F.inline(values))
    middle = kth_values(each, [*by, "m"], "v", {"low": F.floor((F.col("n") - 1) / 2), "high": F.floor(F.col("n") / 2)})
    medians = middle.groupBy(*by).agg(*[F.max(F.when(F.col("m") == c, (F.col("low") + F.col("high")) / 2)).alias(c) for c in ("entry_m", "found_apex_m", "exit_m")])
    furthest = phases.groupBy(*by).agg(F.max("gain_end_distance_m").alias("found_end_m"), F.lit("reference_phases").alias("found_source"))
    found = furthest.join(medians, by, "left")
    base = references.join(corner_bounds(corners), "track_id")
    return (
        base.join(found, by, "left")
        .withColumn("apex_m", F.coalesce("found_apex_m", "apex_s_m"))
        .withColumn("straight_end_m", F.coalesce("found_end_m", "s_end_m"))
        .withColumn("window_source", F.coalesce("found_source", F.lit("corner_model")))
    )


def _nearest(value: Column, at: Column, tolerance: float, cond: Column | None = None) -> Column:
    """Value of the sample nearest ``at``; the earlier sample wins a tie.  An aggregate."""
    gap = F.abs(F.col("lap_distance_m") - at)
    ok = gap <= tolerance if cond is None else (gap <= tolerance) & cond
    return F.min(F.when(ok, F.struct(gap.alias("g"), F.col("frame_id").alias("o"), value.alias("v"))))["v"]


def corner_samples(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Frames paired with the corner windows that may need them (a margin around zone, apex and exit)."""
    spans = windows.withColumn(
        "w_lo", F.least("s_start_m", "entry_m", F.col("apex_m") - GEAR_TOLERANCE_M, F.col("exit_m") - GEAR_TOLERANCE_M)
    ).withColumn(
        "w_hi", F.greatest("s_end_m", F.col("apex_m") + GEAR_TOLERANCE_M, F.col("exit_m") + GEAR_TOLERANCE_M)
    )
    cols = [
        *LAP_CORNER, "w_lo", "w_hi", "s_start_m", "s_end_m", "entry_m", "apex_m", "exit_m", "straight_end_m", "next_start_m",
    ]
    return range_join(frames, spans.select(*cols), LAP, "lap_distance_m", "w_lo", "w_hi")


def _in(lo: str, hi: str) -> Column:
    return (F.col("lap_distance_m") >= F.col(lo)) & (F.col("lap_distance_m") <= F.col(hi))


IN_ZONE = ("s_start_m", "s_end_m")


def steering_stats(samples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Direction changes and spread of the per-metre steering rate in each corner zone."""
    zone = samples.filter(_in(*IN_ZONE)).select(*LAP_CORNER, "frame_id", "lap_distance_m", "steering_norm")
    count = zone.groupBy(*LAP_CORNER).agg(F.count(F.lit(1)).alias("n"))
    s = scan(zone, LAP_CORNER, "frame_id", prev={"v0": "steering_norm", "d0": "lap_distance_m"}, chunk_rows=chunk_rows)
    step, span = F.col("steering_norm") - F.col("v0"), F.col("lap_distance_m") - F.col("d0")
    kept = s.filter(F.abs(step) >= STEERING_STEP).select(
        *LAP_CORNER, "frame_id", F.signum(step).alias("sign"), F.when(span > 0, step / span).alias("rate")
    )
    turned = scan(kept, LAP_CORNER, "frame_id", prev={"sign0": "sign"}, chunk_rows=chunk_rows)
    stats = turned.groupBy(*LAP_CORNER).agg(
        F.count_if(F.col("sign") != F.col("sign0")).alias("r"), F.stddev_pop("rate").alias("sd")
    )
    enough = F.col("n") >= 3
    return count.join(stats, LAP_CORNER, "left").select(
        *LAP_CORNER,
        F.when(enough, F.coalesce("r", F.lit(0))).cast("int").alias("steering_reversals"),
        F.when(enough, F.col("sd")).alias("steering_rate_std"),
    )


def brake_area(samples: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Trapezoid area of brake pressure over distance from a detected entry to the apex."""
    used = samples.filter((F.col("entry_m") < F.col("apex_m")) & _in("entry_m", "apex_m"))
    s = scan(
        used.select(*LAP_CORNER, "frame_id", "lap_distance_m", "brake_norm"),
        LAP_CORNER, "frame_id", prev={"b0": "brake_norm", "d0": "lap_distance_m"}, chunk_rows=chunk_rows,
    )
    span = F.col("lap_distance_m") - F.col("d0")
    piece = F.when(span > 0, (F.col("b0") + F.col("brake_norm")) / 2.0 * span)
    return s.groupBy(*LAP_CORNER).agg(F.count(F.lit(1)).alias("n"), F.sum(piece).alias("a")).select(
        *LAP_CORNER, F.when(F.col("n") >= 2, F.coalesce("a", F.lit(0.0))).alias("brake_area")
    )


def reference_lateral(windows: DataFrame, pairs: DataFrame, frames: DataFrame) -> DataFrame:
    """The reference lap's lateral position nearest to each driver apex, within 5 m."""
    refs = pairs.select(*LAP, "ref_session_id", "ref_segment_index")
    ref_keys = refs.select(
        F.col("ref_session_id").alias("session_id"), F.col("ref_segment_index").alias("segment_index")
    ).distinct()
    ref_frames = frames.join(ref_keys, LAP, "left_semi").select(
        F.col("session_id").alias("ref_session_id"), F.col("segment_index").alias("ref_segment_index"),
        "frame_id", "lap_distance_m", "path_lateral_m",
    )
    apexes = windows.select(*LAP_CORNER, "apex_m").join(refs, LAP).select(
        "ref_session_id", "ref_segment_index", *LAP_CORNER, "apex_m",
        (F.col("apex_m") - SAMPLE_TOLERANCE_M).alias("a_lo"), (F.col("apex_m") + SAMPLE_TOLERANCE_M).alias("a_hi"),
    )
    near = range_join(ref_frames, apexes, ["ref_session_id", "ref_segment_index"], "lap_distance_m", "a_lo", "a_hi")
    return near.groupBy(*LAP_CORNER).agg(
        _nearest(F.col("path_lateral_m"), F.col("apex_m"), SAMPLE_TOLERANCE_M).alias("ref_lateral_m")
    )


def corner_channels(
    frames: DataFrame, windows: DataFrame, refused: DataFrame | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """All channel facts per lap and corner.

    ``refused`` (session_id, channel) blanks channels the session cannot support; ``pairs`` names each lap's
    reference for the line offset.
    """
    # Read-only peak of the wheels' recorded slip: the larger side counts.
    slip = F.greatest(F.abs(F.coalesce("slip_angle_rl_deg", F.lit(0.0))), F.abs(F.coalesce("slip_angle_rr_deg", F.lit(0.0))))
    used = [*LAP, "frame_id", "lap_distance_m", "gear", "brake_norm", "steering_norm", "tc_active", "abs_active",
            "path_lateral_m", "slip_angle_rl_deg", "slip_angle_rr_deg"]
    # Read by the aggregation and by the ordered steps: the range join runs once.
    s = materialise(corner_samples(frames.select(*used), windows))
    zone = _in(*IN_ZONE)
    entry_ok = F.col("entry_m") < F.col("apex_m")
    brake_in = F.when(F.coalesce(entry_ok, F.lit(False)), _in("entry_m", "apex_m")).otherwise(zone)
    bound = F.least(F.coalesce("exit_m", "s_end_m"), "s_end_m", "next_start_m", "straight_end_m")
    d, brake, gear = F.col("lap_distance_m"), F.col("brake_norm"), F.col("gear")
    released = (d > F.col("apex_m")) & (d <= bound) & (brake <= BRAKE_ON)
    engaged = gear > 0
    known = lambda c: F.when(zone, F.col(c).cast("double"))
    g = s.groupBy(*LAP_CORNER).agg(
        F.count_if(zone).alias("zone_rows"),
        F.min(F.when(zone & engaged, gear)).cast("int").alias("gear_min"),
        _nearest(gear, F.col("apex_m"), GEAR_TOLERANCE_M, gear != 0).cast("int").alias("gear_at_apex"),
        _nearest(gear, F.col("exit_m"), GEAR_TOLERANCE_M, gear != 0).cast("int").alias("gear_at_exit"),
        F.max(F.when(brake_in, brake)).alias("brake_peak"),
        F.min(F.when(released, d)).alias("release_m"),
        F.max(F.when(zone, slip)).alias("rear_slip_max_deg"),
        _nearest(slip, F.col("exit_m"), SAMPLE_TOLERANCE_M).alias("rear_slip_exit_deg"),
        F.avg(known("tc_active")).alias("tc_duty"),
        F.avg(known("abs_active")).alias("abs_duty"),
        _nearest(F.col("path_lateral_m"), F.col("apex_m"), SAMPLE_TOLERANCE_M).alias("lateral_at_apex_m"),
    )
    first_brake = frames.groupBy(*LAP).agg(F.min(F.when(brake > BRAKE_ON, d)).alias("first_brake_m"))
    keep = ["track_id", "corner_pos", "corner_name", "apex_s_m", "apex_m", "entry_m", "exit_m", "window_source"]
    out = (
        windows.select(*LAP_CORNER, *keep)
        .join(g, LAP_CORNER, "left")
        .join(steering_stats(s), LAP_CORNER, "left")
        .join(brake_area(s), LAP_CORNER, "left")
        .join(first_brake, LAP, "left")
    )
    in_zone = F.coalesce(F.col("zone_rows"), F.lit(0)) > 0
    trail = F.when(
        (F.col("brake_peak") >= TRAIL_MIN_BRAKE_PEAK) & (F.col("first_brake_m") <= F.col("apex_m")),
        F.greatest(F.lit(0.0), F.col("release_m") - F.col("apex_m")),
    )
    out = (
        out.withColumn("gear_at_apex", F.when(in_zone, F.col("gear_at_apex")))
        .withColumn("gear_at_exit", F.when(in_zone, F.col("gear_at_exit")))
        .withColumn("trail_brake_depth_m", F.when(F.col("release_m").isNotNull(), trail))
    )
    if pairs is not None:
        out = out.join(reference_lateral(windows, pairs, frames), LAP_CORNER, "left").withColumn(
            "lateral_offset_m", F.col("lateral_at_apex_m") - F.col("ref_lateral_m")
        )
    if refused is not None:
        r = refused.groupBy("session_id").agg(F.collect_set("channel").alias("refused"))
        out = out.join(r, "session_id", "left")
        blank = {
            "tc_duty": ["tc_active"], "abs_duty": ["abs_active"],
            "rear_slip_max_deg": SLIP_CHANNELS, "rear_slip_exit_deg": SLIP_CHANNELS,
        }
        for c, names in blank.items():
            hit = F.coalesce(F.arrays_overlap("refused", F.array(*[F.lit(n) for n in names])), F.lit(False))
            out = out.withColumn(c, F.when(~hit, F.col(c)))
        out = out.drop("refused")
    return out


def corner_rear_slip(frames: DataFrame, windows: DataFrame) -> DataFrame:
    """Apex, braking and peak rear slip per lap and corner, refused where the samples cannot carry it."""
    f = frames.withColumn("slip", rear_slip_angle()).select(
        *LAP, "frame_id", "lap_distance_m", "slip", "speed_kph", "brake_norm", "surface_type_rl"
    )
    entry = F.coalesce(F.col("entry_m"), F.col("s_start_m"))
    w = windows.withColumn("from_m", F.when(entry >= F.col("apex_m"), F.col("s_start_m")).otherwise(entry)).select(
        *LAP_CORNER, "s_start_m", "s_end_m", "apex_m", "from_m"
    )
    # Read by both counts and by the order statistics: the range join runs once.
    z = materialise(range_join(f, w, LAP, "lap_distance_m", "s_start_m", "s_end_m"))
    clean_surface = F.coalesce(F.col("surface_type_rl") == 0, F.lit(True))
    tracks = z.groupBy(*LAP_CORNER).agg(F.max(clean_surface).alias("has_track"))
    z = z.join(tracks, LAP_CORNER).filter(~F.col("has_track") | clean_surface)
    mag = F.abs(F.col("slip"))
    insane = mag > SLIP_SANE_MAX_DEG
    valid = (mag <= SLIP_SANE_MAX_DEG) & ~F.coalesce(F.col("speed_kph") < MIN_SPEED_KPH, F.lit(False))
    gap = F.abs(F.col("lap_distance_m") - F.col("apex_m"))
    braking = (F.col("lap_distance_m") >= F.col("from_m")) & (F.col("brake_norm") > BRAKE_ON)
    z = z.withColumn("mag", mag).withColumn("valid", F.coalesce(valid, F.lit(False)))
    sums = z.groupBy(*LAP_CORNER).agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(insane).alias("insane"), F.count_if("valid").alias("samples")
    )
    kinds = F.filter(
        F.array(
            F.lit("peak"),
            F.when(gap <= APEX_HALF_WINDOW_M, F.lit("apex")),
            F.when(braking, F.lit("braking")),
        ),
        lambda k: k.isNotNull(),
    )
    sets = z.filter("valid").select(*LAP_CORNER, "mag", F.explode(kinds).alias("kind"))
    n = F.col("n")
    stats = kth_values(
        sets, [*LAP_CORNER, "kind"], "mag",
        {"lower": F.floor((n - 1) / 2), "upper": F.floor(n / 2), "p95": F.bround(PEAK_PERCENTILE * (n - 1))},
    )

    def of(kind: str, value: Column, least: int = 1) -> Column:
        return F.max(F.when((F.col("kind") == kind) & (n >= least), value))

    stats = stats.groupBy(*LAP_CORNER).agg(
        of("apex", (F.col("lower") + F.col("upper")) / 2, MIN_SAMPLES).alias("apex_deg"),
        of("braking", F.col("p95"), MIN_SAMPLES).alias("braking_deg"),
        of("peak", F.col("p95")).alias("peak_deg"),
    )
    coverage = F.col("samples") / F.col("rows")
    refused = (
        F.when(F.col("insane") / F.col("rows") > MAX_INSANE_SHARE, "spin or off-track samples")
        .when(F.col("samples") == 0, "no valid sample")
        .when(coverage < MIN_COVERAGE, "low coverage")
    )
    out = windows.select(*LAP_CORNER).join(sums, LAP_CORNER, "left").join(stats, LAP_CORNER, "left")
    out = out.withColumn("slip_reason", F.when(F.col("rows").isNull(), "no samples inside the corner window").otherwise(refused))
    ok = F.col("slip_reason").isNull()
    return out.select(
        *LAP_CORNER,
        F.when(ok, F.col("apex_deg")).alias("rear_slip_apex_deg"),
        F.when(ok, F.col("braking_deg")).alias("rear_slip_braking_deg"),
        F.when(ok, F.col("peak_deg")).alias("rear_slip_peak_deg"),
        F.coalesce(coverage, F.lit(0.0)).alias("rear_slip_coverage"),
        "slip_reason",
    )


def representative_corners(channels: DataFrame, by: Sequence[str] = ("session_id",)) -> DataFrame:
    """Dominant gears (the earlier seen wins a tie), median trail and line per corner."""
    keys = [*by, "corner_id"]

    def dominant(c: str) -> DataFrame:
        counted = channels.filter(F.col(c) > 0).groupBy(*keys, c).agg(
            F.count(F.lit(1)).alias("n"), F.min("segment_index").alias("first_seen")
        )
        return counted.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("first_seen")).alias("f"), F.col(c))).getField(c).alias(c))

    mid = channels.groupBy(*keys).agg(
        F.min("corner_name").alias("corner_name"),
        F.min("corner_pos").alias("corner_pos"),
        F.min("apex_s_m").alias("apex_s_m"),
        F.percentile("trail_brake_depth_m", 0.5).alias("trail_brake_depth_m"),
        F.percentile("lateral_at_apex_m", 0.5).alias("lateral_at_apex_m"),
    )
    return mid.join(dominant("gear_at_apex"), keys, "left").join(dominant("gear_at_exit"), keys, "left")


def rear_stability(slips: DataFrame, dead: DataFrame | None = None) -> DataFrame:
    """State of each corner: measured instability, none detected, or unknown with a reason.

    ``slips``: LAP_CORNER, lap_number, clean, rear_slip_apex_deg, rear_slip_braking_deg, for all analysed laps.
    """
    keys = ["session_id", "corner_id"]
    apex = F.col("rear_slip_apex_deg")
    base = slips.groupBy(*keys).agg(
        F.count_if("clean").alias("clean_laps"),
        F.count_if(F.col("clean") & apex.isNotNull()).alias("measured_laps"),
        F.percentile(F.when(F.col("clean"), apex), 0.5).alias("baseline"),
    )
    measured = (F.col("measured_laps") > 0) & (F.col("measured_laps") >= MIN_COVERAGE * F.col("clean_laps"))
    base = base.withColumn("measured", measured).withColumn(
        "threshold_deg",
        F.when(measured, F.greatest(F.lit(INSTABILITY_MIN_DEG), INSTABILITY_BASELINE_FACTOR * F.col("baseline"))),
    )
    item = F.struct(
        F.round(apex, 2).alias("apex_deg"), (-F.col("segment_index")).alias("o"),
        F.round("rear_slip_braking_deg", 2).alias("braking_deg"), "segment_index", "lap_number", "clean",
    )
    # Only flagged laps of one corner are listed: a short list by definition of the threshold.
    flagged = (
        slips.join(base.select(*keys, "threshold_deg"), keys)
        .filter(apex >= F.col("threshold_deg"))
        .groupBy(*keys)
        .agg(F.max(item).alias("worst"), F.count(F.lit(1)).alias("flagged"))
    )
    out = base.join(flagged, keys, "left")
    if dead is not None:
        d = dead.filter("channel = 'wheel_ground_vel_lat_rl'").select("session_id", F.col("reason").alias("dead_reason"))
        out = out.join(d, "session_id", "left")
    else:
        out = out.withColumn("dead_reason", F.lit(None).cast("string"))
    reason = (
        F.when(F.col("clean_laps") == 0, F.coalesce("dead_reason", F.lit("no clean lap measured this corner")))
        .when(F.col("measured_laps") == 0, F.coalesce("dead_reason", F.lit("no valid rear-slip sample on any clean lap")))
        .when(
            ~F.col("measured"),
            F.format_string("measurable on only %d of %d clean laps", "measured_laps", "clean_laps"),
        )
    )
    has_flag = F.coalesce(F.col("flagged"), F.lit(0)) > 0
    return out.select(
        *keys,
        F.when(~F.col("measured"), "unknown").when(has_flag, "measured_instability")
        .otherwise("no_detected_instability").alias("state"),
        "clean_laps", "measured_laps",
        F.when(F.col("measured"), F.col("baseline")).alias("baseline_deg"),
        "threshold_deg",
        F.coalesce("flagged", F.lit(0).cast("long")).alias("flagged"),
        F.col("worst.apex_deg").alias("value_deg"),
        F.col("worst.braking_deg").alias("braking_deg"),
        F.col("worst.segment_index").alias("worst_segment"),
        F.col("worst.lap_number").alias("worst_lap"),
        F.col("worst.clean").alias("worst_clean"),
        F.coalesce(F.col("worst.braking_deg") >= F.col("threshold_deg"), F.lit(False)).alias("brake_overlap"),
        reason.alias("reason"),
    )


def apex_metrics(frames: DataFrame, corners: DataFrame) -> DataFrame:
    """Row nearest each apex by raw distance inside the zone: edge distance, timing error, surface.

    The surface is that of the apex-side wheel, front before rear.
    """
    zone = corners.select("track_id", "corner_id", "corner_name", "s_start_m", "apex_s_m", "s_end_m", "apex_side")
    z = range_join(frames, zone, ["track_id"], "raw_lap_distance_m", "s_start_m", "s_end_m")
    def side(prefix: str, kind: str) -> Column:
        names = {w: f"{prefix}_{w}" for w in ("fl", "rl", "fr", "rr")}
        if not set(names.values()) <= set(frames.columns):
            return F.lit(None).cast(kind)
        left = F.coalesce(names["fl"], names["rl"])
        return F.when(F.col("apex_side") == "left", left).otherwise(F.coalesce(names["fr"], names["rr"]))

    recorded = _finite(F.col("distance_to_track_edge_m")) if "distance_to_track_edge_m" in frames.columns else F.lit(None)
    edge = F.coalesce(recorded.cast("double"), F.col("track_edge_m") - F.abs("path_lateral_m"))
    gap = F.abs(F.col("raw_lap_distance_m") - F.col("apex_s_m"))
    row = F.struct(
        gap.alias("g"), F.col("frame_id").alias("o"), F.col("raw_lap_distance_m").alias("at_m"),
        edge.alias("edge_m"), side("surface_type", "int").alias("surface"),
        side("terrain_name", "string").alias("terrain"), F.col("path_lateral_m").alias("lateral_m"),
    )
    return z.groupBy(*LAP, "corner_id", "corner_name", "apex_s_m", "apex_side").agg(F.min(row).alias("r")).select(
        *LAP_CORNER, "corner_name", "apex_side",
        F.col("r.at_m").alias("apex_at_m"),
        (F.col("r.at_m") - F.col("apex_s_m")).alias("timing_error_m"),
        F.col("r.edge_m").alias("edge_distance_m"),
        F.col("r.surface").alias("apex_surface"),
        F.col("r.terrain").alias("apex_terrain"),
    )


def apex_input_status(frames: DataFrame, annotated: DataFrame) -> DataFrame:
    """Per session: whether apex metrics can be computed, and why not.

    ``annotated``: session_id, has_annotations.
    """
    present = set(frames.columns)

    def seen(*names: str) -> Column:
        """Every named channel has at least one sample in the session."""
        have = F.lit(all(n in present for n in names))
        for n in (n for n in names if n in present):
            have = have & (F.count(n) > 0)
        return have

    edge = seen("distance_to_track_edge_m") | seen("path_lateral_m", "track_edge_m")
    why = F.when(~seen("raw_lap_distance_m"), "missing raw_lap_distance_m").when(~edge, "missing edge distance inputs")
    j = frames.groupBy("session_id").agg(why.alias("why")).join(annotated, "session_id", "left")
    configured = F.coalesce("has_annotations", F.lit(False))
    return j.select(
        "session_id",
        F.when(~configured, "not_configured").when(F.col("why").isNotNull(), "unavailable").otherwise("ok").alias("status"),
        F.when(configured, F.col("why")).alias("reason"),
    )
