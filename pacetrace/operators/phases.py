"""Corner phases on the metre grid: entry, brake and exit points, minimum speed, and what each phase costs.

Every "first time the pedal …" rule is turned into a local event on the lap's grid (a crossing at one metre),
so that a corner's answer is a conditional minimum over its window: one range join and one aggregation for all
laps and corners together.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_join
from .laps import is_slow
from .segments import LAP

# Fixed values of the detection (pedals are 0–1).
THROTTLE_LIFT = 0.9
BRAKE_APPLY = 0.05
BRAKE_OFF = 0.01
THROTTLE_FULL = 0.95
EXIT_MERGE_M = 3
EXIT_PAST_END_M = 50
LOOK_BACK_M = 200.0
MIN_SPEED_DELTA_KPH = 0.5
PHASE_SPEED_DELTA_KPH = 1.0
HIGH_CONFIDENCE_KPH = 2.0
COVERAGE_START_MAX = 0.10
COVERAGE_END_MIN = 0.80

PHASE_ORDER = ("minimum_speed", "entry", "exit_brake", "exit_throttle", "exit")


def corner_bounds(corners: DataFrame) -> DataFrame:
    """Search bounds of each corner: not before the previous corner ends, not past the next one's start."""
    w = Window.partitionBy("track_id").orderBy("corner_pos")
    nxt = F.lead("s_start_m").over(w)
    to_int = lambda c: c.cast("int")  # noqa: E731  truncation toward zero
    return (
        corners.withColumn("entry_floor_m", F.coalesce(F.lag("s_end_m").over(w), F.lit(0.0)))
        .withColumn("exit_ceiling_m", F.when(nxt > F.col("s_start_m"), nxt))
        .withColumn("next_start_m", F.coalesce(nxt, F.col("s_end_m")))
        .withColumn("is_last_corner", nxt.isNull())
        .withColumn("c_start", to_int(F.col("s_start_m")))
        .withColumn("c_apex", to_int(F.col("apex_s_m")))
        .withColumn("c_end", to_int(F.col("s_end_m")))
        .withColumn("brake_from", F.greatest(F.lit(0), to_int(F.col("s_start_m") - LOOK_BACK_M)))
        .withColumn("entry_from", F.greatest("brake_from", to_int(F.col("entry_floor_m"))))
    )


def pedal_events(grid: DataFrame, keys: Sequence[str] = tuple(LAP), prefix: str = "") -> DataFrame:
    """Mark on each metre the pedal crossings that start at it."""
    thr, brk = F.col(prefix + "throttle_norm"), F.col(prefix + "brake_norm")
    w = Window.partitionBy(*keys).orderBy("s_m")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    decisive = F.when((brk > BRAKE_APPLY) | (brk < BRAKE_OFF), F.struct(F.col("s_m"), (brk > BRAKE_APPLY).alias("on")))
    return (
        grid.withColumns({"__t": F.lag(thr).over(w), "__b": F.lag(brk).over(w), "__d": F.last(decisive, True).over(past)})
        .withColumn(prefix + "lift", (thr < THROTTLE_LIFT) & (F.col("__t") >= THROTTLE_LIFT))
        .withColumn(prefix + "full", (thr >= THROTTLE_FULL) & (F.col("__t") < THROTTLE_FULL))
        .withColumn(prefix + "brake_on", (brk > BRAKE_APPLY) & (F.col("__b") <= BRAKE_APPLY))
        .withColumn(prefix + "released_from", F.when((brk < BRAKE_OFF) & F.col("__d.on"), F.col("__d.s_m")))
        .drop("__t", "__b", "__d")
    )


def _first_max(value: Column, s: Column, cond: Column) -> Column:
    return F.max(F.when(cond, F.struct(value.alias("v"), (-s).alias("neg"))))


def corner_events(paired: DataFrame, bounds: DataFrame) -> DataFrame:
    """Phase points of driver and reference, one row per lap and corner.

    ``paired`` is the aligned grid of :mod:`pacetrace.plans.compare` with ``track_id``, both sides' pedal
    events and the smoothed ``delta_ms``.
    """
    w = Window.partitionBy(*LAP).orderBy("s_m")
    ahead = [F.lead(c, k).over(w).alias(f"{c}{k}") for k in (1, 2) for c in ("speed_kph", "ref_speed_kph", "delta_ms")]
    # In the order of the leads, so that one window step answers both.
    n_cells = F.count(F.lit(1)).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).cast("int")
    # The values at a metre and at the two after it travel as one column: the joined rows stay narrow enough
    # for the compiled join to be optimised by the JVM.
    point = F.struct(
        "s_m", "speed_kph", "ref_speed_kph", "delta_ms",
        *[f"{c}{k}" for k in (1, 2) for c in ("speed_kph", "ref_speed_kph", "delta_ms")],
    )
    flags = ["lift", "full", "brake_on", "released_from", "ref_lift", "ref_full", "ref_released_from"]
    end_delta = F.max(F.when(F.col("s_m") == F.col("n") - 2, F.col("delta_ms"))).over(Window.partitionBy(*LAP))
    pedals = F.col("ref_throttle_norm").isNotNull() | F.col("ref_brake_norm").isNotNull()
    pedals_start = pedals & ~F.coalesce(F.lag(pedals).over(w), F.lit(False))
    grid = paired.select("*", *ahead, n_cells.alias("n"), pedals_start.alias("ref_pedals_start")).select(
        *LAP, "track_id", F.col("s_m").cast("double").alias("s_x"), "n", end_delta.alias("end_delta_ms"), point.alias("pt"), *flags,
        pedals.alias("ref_has_pedals"), "ref_pedals_start",
    )
    need = ["track_id", "corner_pos", "brake_from", "entry_from", "exit_ceiling_m", "c_start", "c_apex", "c_end"]
    window = bounds.select(*need).withColumn("w_lo", F.col("brake_from").cast("double")).withColumn(
        "w_hi", (F.greatest("c_end", "c_apex") + EXIT_PAST_END_M).cast("double")
    )
    cells = range_join(grid, window, ["track_id"], "s_x", "w_lo", "w_hi")

    point, n = F.col("pt"), F.col("n")
    s, speed, ref_speed, delta = (point[c] for c in ("s_m", "speed_kph", "ref_speed_kph", "delta_ms"))
    apex_in = F.least(F.col("c_apex"), n - 1)
    exit_to = F.least(F.col("c_end") + EXIT_PAST_END_M, n - 1, F.coalesce(F.col("exit_ceiling_m").cast("int"), n - 1))
    in_entry = s.between(F.col("entry_from"), apex_in)
    after_entry = (s - 1 >= F.col("entry_from")) & (s <= apex_in)
    in_exit = (s >= F.col("c_apex")) & (s <= exit_to)
    in_zone = s.between(F.col("c_start"), F.col("c_end"))

    zone_at, exit_zone_at = F.greatest("entry_from", "c_start"), F.least(F.col("c_end"), exit_to)
    braking = (s - 1 >= F.col("brake_from")) & (s <= apex_in)
    throttling = (s - 1 >= F.col("c_apex")) & in_exit
    # Metres that answer no question below stay out of the sort.  The first metre of the window keeps its corner, and with
    # the metres where the reference's pedals begin it tells whether there are any in the window.
    cells = cells.filter(
        (s == F.col("brake_from")) | F.col("ref_pedals_start") | in_entry | in_zone
        | (s == zone_at) | (s == exit_zone_at) | (s == F.col("c_apex"))
        | (F.col("brake_on") & braking) | ((F.col("full") | F.col("ref_full")) & throttling)
        | (in_exit & ((F.col("released_from") >= F.col("c_apex")) | (F.col("ref_released_from") >= F.col("c_apex"))))
    )

    def at(pos: Column) -> Column:
        return F.max(F.when(s == pos, point))

    def first(cond: Column, what: Column = point) -> Column:
        return F.min(F.when(cond, what))

    agg = [
        F.max("n").alias("n"),
        F.max("end_delta_ms").alias("end_delta_ms"),
        first(F.col("lift") & after_entry).alias("lift_p"),
        F.max(F.when(in_entry, F.struct(speed.alias("v"), (-s).alias("neg"), point.alias("p")))).alias("peak_p"),
        at(zone_at).alias("zone_p"),
        first(F.col("brake_on") & braking, s).alias("brake_point_m"),
        first((F.col("released_from") >= F.col("c_apex")) & in_exit).alias("exit_brake_p"),
        first(F.col("full") & throttling).alias("exit_throttle_p"),
        at(exit_zone_at).alias("exit_zone_p"),
        F.max(exit_zone_at).alias("exit_zone_m"),
        F.min(F.when(in_zone, F.struct(speed.alias("speed_kph"), s.alias("s_m"), delta.alias("delta_ms")))).alias("min_p"),
        F.min(F.when(in_zone, F.struct(ref_speed.alias("ref_speed_kph"), s.alias("s_m")))).alias("ref_min_p"),
        F.max(F.when(s == F.col("c_apex"), delta)).alias("apex_delta_ms"),
        first(F.col("ref_lift") & after_entry, s).alias("ref_lift_m"),
        _first_max(ref_speed, s, in_entry).alias("ref_peak"),
        first((F.col("ref_released_from") >= F.col("c_apex")) & in_exit, s).alias("ref_exit_brake_m"),
        first(F.col("ref_full") & throttling, s).alias("ref_exit_throttle_m"),
        F.max("ref_has_pedals").alias("ref_pedals"),
    ]
    e = cells.groupBy(*LAP, "track_id", "corner_pos").agg(*agg).join(bounds, ["track_id", "corner_pos"])

    flat = F.least(F.col("c_apex"), F.col("n") - 1) <= F.col("entry_from")
    zone_start = F.greatest("entry_from", "c_start")
    e = (
        e.withColumn("entry_p", F.when(flat, F.col("zone_p")).otherwise(F.coalesce("lift_p", "peak_p.p")))
        .withColumn("entry_m", F.when(flat, zone_start).otherwise(F.coalesce(F.col("lift_p.s_m"), -F.col("peak_p.neg"))))
        .withColumn(
            "entry_method",
            F.when(flat, "zone_start").when(F.col("lift_p").isNotNull(), "throttle_lift").otherwise("speed_peak"),
        )
        .withColumn(
            "ref_entry_m",
            F.when(
                F.col("ref_pedals"),
                F.when(flat, zone_start).otherwise(F.coalesce(F.col("ref_lift_m"), -F.col("ref_peak.neg"))),
            ),
        )
        .withColumn("ref_entry_m", F.when(F.col("ref_entry_m") < F.col("n"), F.col("ref_entry_m")))
    )
    # The straight after a corner ends at the next corner's entry, whose search floor is this corner's end.
    wl = Window.partitionBy(*LAP).orderBy("corner_pos")
    return (
        e.withColumn(
            "straight_end_m",
            F.when(F.col("is_last_corner"), F.greatest(F.col("n") - 2, F.lit(0))).otherwise(F.lead("entry_m").over(wl)),
        )
        .withColumn(
            "straight_end_delta_ms",
            F.when(F.col("is_last_corner"), F.col("end_delta_ms")).otherwise(F.lead("entry_p.delta_ms").over(wl)),
        )
        .drop("lift_p", "peak_p", "zone_p", "ref_peak", "ref_lift_m", "end_delta_ms")
    )


def _midpoint(a: Column, b: Column) -> Column:
    return F.bround((a + b) / 2).cast("int")


def exit_points(events: DataFrame) -> DataFrame:
    """Exit phases per lap and corner: ``exits`` is an array of (phase, s_m, speed, ref speed, delta)."""
    b, t, z = F.col("exit_brake_p"), F.col("exit_throttle_p"), F.col("exit_zone_p")

    def phase(name: str, p: Column, step: Column | None = None, pos: Column | None = None) -> Column:
        def pick(c: str) -> Column:
            if step is None:
                return p[c]
            return F.when(step == 0, p[c]).when(step == 1, p[c + "1"]).otherwise(p[c + "2"])

        return F.struct(
            F.lit(name).alias("phase"),
            (p["s_m"] if pos is None else pos).alias("s_m"),
            pick("speed_kph").alias("speed_kph"),
            pick("ref_speed_kph").alias("ref_speed_kph"),
            pick("delta_ms").alias("delta_ms"),
        )

    lo = F.when(b["s_m"] <= t["s_m"], b).otherwise(t)
    mid = _midpoint(b["s_m"], t["s_m"])
    merged = phase("exit", lo, mid - lo["s_m"], mid)
    both = b.isNotNull() & t.isNotNull()
    exits = (
        F.when(both & (F.abs(b["s_m"] - t["s_m"]) <= EXIT_MERGE_M), F.array(merged))
        .when(both, F.array(phase("exit_brake", b), phase("exit_throttle", t)))
        .when(b.isNotNull(), F.array(phase("exit", b)))
        .when(t.isNotNull(), F.array(phase("exit", t)))
        .otherwise(F.array(phase("exit", z, None, F.col("exit_zone_m"))))
    )
    rb, rt = F.col("ref_exit_brake_m"), F.col("ref_exit_throttle_m")
    ref_both = rb.isNotNull() & rt.isNotNull()
    ref_split = ref_both & (F.abs(rb - rt) > EXIT_MERGE_M)
    ref_single = F.when(ref_both, _midpoint(rb, rt)).otherwise(F.coalesce(rb, rt, F.col("exit_zone_m")))
    return (
        events.withColumn("exits", exits)
        .withColumn("ref_split", ref_split)
        .withColumn("ref_exit_m", F.when(F.col("ref_pedals") & ~ref_split, ref_single))
    )


def corner_phase_facts(events: DataFrame) -> DataFrame:
    """One row per lap, corner and phase whose speed difference is worth a statement.

    ``loss_s`` is the time lost from the phase point to the end of its window, positive for a loss.
    """
    e = exit_points(events)
    sec = lambda c: c / 1000.0
    none_d = F.lit(None).cast("double")

    def fact(phase, seq, loss, driver, reference, confidence, **opt) -> Column:
        names = (
            "phase_distance_m", "driver_apex_distance_m", "reference_apex_distance_m", "apex_offset_m",
            "gain_end_distance_m", "entry_distance_delta_m", "exit_distance_delta_m", "reference_phase_distance_m",
        )
        return F.struct(
            phase.alias("phase"), F.lit(seq).alias("phase_seq"), loss.alias("loss_s"), driver.alias("driver_value"),
            reference.alias("reference_value"), confidence.alias("confidence"),
            *[(opt[k].cast("double") if k in opt else none_d).alias(k) for k in names],
        )

    se, se_delta = F.col("straight_end_m"), F.col("straight_end_delta_ms")
    dv, rv = F.col("min_p.speed_kph"), F.col("ref_min_p.ref_speed_kph")
    gap = rv - dv
    minimum = F.when(
        F.abs(gap) > MIN_SPEED_DELTA_KPH,
        fact(
            F.lit("minimum_speed"), 0, F.coalesce(sec(se_delta - F.col("min_p.delta_ms")), gap / 100.0), dv, rv,
            F.when(F.abs(gap) > HIGH_CONFIDENCE_KPH, "high").otherwise("medium"),
            driver_apex_distance_m=F.col("min_p.s_m"), reference_apex_distance_m=F.col("ref_min_p.s_m"),
            apex_offset_m=F.col("ref_min_p.s_m") - F.col("min_p.s_m"), gain_end_distance_m=se,
        ),
    )
    ev, er = F.col("entry_p.speed_kph"), F.col("entry_p.ref_speed_kph")
    in_order = F.when(F.col("entry_m") < F.col("c_apex"), sec(F.col("apex_delta_ms") - F.col("entry_p.delta_ms")))
    entry = F.when(
        F.abs(er - ev) > PHASE_SPEED_DELTA_KPH,
        fact(
            F.lit("entry"), 1, F.coalesce(in_order, (er - ev) / 100.0), ev, er, F.lit("medium"),
            phase_distance_m=F.col("entry_m"), gain_end_distance_m=F.col("c_apex"),
            entry_distance_delta_m=F.col("ref_entry_m") - F.col("entry_m"),
            reference_phase_distance_m=F.col("ref_entry_m"),
        ),
    )

    def exit_fact(i: int) -> Column:
        x = F.get(F.col("exits"), F.lit(i))
        xv, xr = x["speed_kph"], x["ref_speed_kph"]
        nearest = F.when(
            F.abs(F.col("ref_exit_brake_m") - x["s_m"]) <= F.abs(F.col("ref_exit_throttle_m") - x["s_m"]),
            F.col("ref_exit_brake_m"),
        ).otherwise(F.col("ref_exit_throttle_m"))
        ref = F.when(
            F.col("ref_pedals"),
            F.when(~F.col("ref_split"), F.col("ref_exit_m"))
            .when(x["phase"] == "exit", nearest)
            .when(x["phase"] == "exit_brake", F.col("ref_exit_brake_m"))
            .otherwise(F.col("ref_exit_throttle_m")),
        )
        return F.when(
            F.abs(xr - xv) > PHASE_SPEED_DELTA_KPH,
            fact(
                x["phase"], 2 + i, F.coalesce(sec(se_delta - x["delta_ms"]), (xr - xv) / 100.0), xv, xr,
                F.lit("medium"), phase_distance_m=x["s_m"], gain_end_distance_m=se,
                exit_distance_delta_m=ref - x["s_m"], reference_phase_distance_m=ref,
            ),
        )

    facts = F.filter(F.array(minimum, entry, exit_fact(0), exit_fact(1)), lambda f: f.isNotNull())
    return e.select(
        *LAP, "track_id", "corner_pos", "corner_id", "corner_name", "apex_s_m", "target_throttle_pct",
        F.explode(facts).alias("f"),
    ).select(
        *LAP, "track_id", "corner_pos", "corner_id", "corner_name", "apex_s_m", "target_throttle_pct", "f.*",
        F.lit("km/h").alias("unit"),
    )


def ranked_facts(facts: DataFrame, n: int | None = 3) -> DataFrame:
    """Largest losses and gains of each lap; ties (to a nanosecond) keep corner and phase order."""
    f = facts.withColumn("loss_s", F.round("loss_s", 9)).filter(F.col("loss_s") != 0).withColumn("kind", F.when(F.col("loss_s") > 0, "loss").otherwise("gain"))
    w = Window.partitionBy(*LAP, "kind").orderBy(F.desc(F.abs("loss_s")), "corner_pos", "phase_seq")
    f = f.withColumn("rank", F.row_number().over(w))
    return f if n is None else f.filter(F.col("rank") <= n)


def comparison_guard(frames: DataFrame, pairs: DataFrame, lap_length_m: float, reject_slow: bool) -> DataFrame:
    """Whether each paired lap can be compared, as a status instead of an error.

    ``frames`` are the lap's rows without stale boundary samples.
    """
    spread = frames.groupBy(*LAP).agg(F.min("lap_distance_m").alias("near_m"), F.max("lap_distance_m").alias("far_m"))
    j = pairs.join(spread, LAP, "left")
    status = (
        F.when(F.col("near_m").isNull(), "no frames")
        .when(F.col("near_m") > lap_length_m * COVERAGE_START_MAX, "starts late")
        .when(F.col("far_m") < lap_length_m * COVERAGE_END_MIN, "ends early")
    )
    if reject_slow:
        status = status.when(is_slow(F.col("duration_s"), F.col("ref_duration_s")), "too slow")
    return j.withColumn("guard", F.coalesce(status, F.lit("ok")))


# Fixed values of the exit alert: how far past a corner's end it looks, and the frames it needs up to there.
EXIT_WINDOW_M = 150.0
EXIT_FRAMES = 10


def exit_alert(facts: DataFrame, top_n: int = 1, frames: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """Losses of one corner worth a word right after it.

    A corner speaks when any of its phases loses at least 0.1 s (minimum speed) or 0.05 s (others); then its
    largest losses are kept.  With ``frames`` and ``ends(corner_id, s_end_m)`` it also needs ``EXIT_FRAMES`` frames of its lap
    up to ``EXIT_WINDOW_M`` past its end: the distance of a lap's tenth frame decides for all its corners.
    """
    if frames is not None:
        nearest = Window.partitionBy(*LAP).orderBy("lap_distance_m")
        nth = frames.select(*LAP, "lap_distance_m").withColumn("n", F.row_number().over(nearest)).filter(F.col("n") <= EXIT_FRAMES)
        enough = nth.filter(F.col("n") == EXIT_FRAMES).select(*LAP, F.col("lap_distance_m").alias("enough_m"))
        window = ends.select("corner_id", (F.col("s_end_m") + EXIT_WINDOW_M).alias("window_m"))
        facts = facts.join(enough, LAP).join(window, "corner_id").filter("enough_m <= window_m").drop("enough_m", "window_m")
    floor = F.when(F.col("phase") == "minimum_speed", 0.1).otherwise(0.05)
    corner = Window.partitionBy(*LAP, "corner_pos")
    ranked = corner.orderBy(F.desc("loss_s"), "phase_seq")
    return (
        facts.withColumn("loss_s", F.round("loss_s", 9))
        .filter(F.col("loss_s") > 0)
        .withColumn("speaks", F.max(F.col("loss_s") >= floor).over(corner))
        .withColumn("rank", F.row_number().over(ranked))
        .filter(F.col("speaks") & (F.col("rank") <= top_n))
    )
