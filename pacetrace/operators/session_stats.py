"""Session-level tables: envelope, consistency, priorities, advice, targets, fuel and reply checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import fuel_session_type
from .segments import LAP

# Fixed values of the rankings.
AFFECTED_LOSS_S = 0.05
SPREAD_WEIGHT = 0.35
MIN_RECURRING_S = 0.02
MIN_SPREAD_S = 0.10
RECURRING_S = 0.10
ERRATIC_S = 0.20
CONSISTENT_SHARE = 0.6
MIN_DISTANCE_M = 3.0
MAX_DISTANCE_M = 60.0
MIN_SPEED_KPH = 1.0
MIN_TRAIL_M = 5.0
MAX_TARGETS = 3
MIN_TARGET_LOSS_S = 0.10
MAX_REPLY_WORDS = 160
PHASE_RANK = {"entry": 0, "minimum_speed": 1, "exit_brake": 2, "exit": 3, "exit_throttle": 4}
PHASE_PLACE = {
    "minimum_speed": "at the apex", "entry": "at the braking point", "exit_brake": "at the brake release",
    "exit_throttle": "onto the straight", "exit": "onto the straight",
}
CLAUSE_ORDER = {
    "minimum_speed": ("min_speed", "gear", "trail", "entry", "exit_speed"),
    "entry": ("entry", "min_speed", "gear", "trail", "exit_speed"),
    "exit_brake": ("exit", "exit_speed", "trail", "gear", "entry"),
    "exit_throttle": ("exit", "exit_speed", "gear", "trail", "entry"),
    "exit": ("exit", "exit_speed", "trail", "gear", "entry"),
}
META_PREFIXES = (
    "let me", "i will", "as a rule", "as a race engineer", "sure,", "sure.", "here is", "coaching note:", "this seems", "below is",
)

CORNER = ["session_id", "corner_id"]
PHASE = [*CORNER, "phase"]


def phase_rank() -> Column:
    rank = F.lit(len(PHASE_RANK))
    for name, i in PHASE_RANK.items():
        rank = F.when(F.col("phase") == name, i).otherwise(rank)
    return rank


def speed_envelope(frames: DataFrame, lap_length_m: float, min_points: int = 100) -> DataFrame:
    """Theoretical lap per session: the fastest speed of the given laps at every metre, integrated.

    ``frames`` are the rows of the clean laps.  Between two samples the speed is linear; nothing is
    extrapolated, and of equal distances the slower first sample counts.
    """
    pts = frames.filter(F.col("speed_kph").isNotNull() & F.col("lap_distance_m").between(0.0, lap_length_m))
    # Samples by whole metre: the edge g lies between the last sample before it and the first at or after it.
    x, v = F.col("lap_distance_m").cast("double"), F.col("speed_kph").cast("double")
    sample = F.struct(x.alias("x"), v.alias("v"))
    b = pts.groupBy(*LAP, F.floor(x).cast("long").alias("b")).agg(
        F.min(sample).alias("head"), F.max(sample).alias("tail"), F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(*LAP).orderBy("b")
    b = b.withColumn("prev", F.lag("tail").over(w)).withColumn("prev_b", F.lag("b").over(w)).withColumn(
        "points", F.sum("c").over(Window.partitionBy(*LAP))).filter(F.col("points") >= min_points)
    on_edge = F.col("head.x") == F.col("b")
    first = F.when(on_edge, F.col("b")).otherwise(F.col("b") + 1)
    lo = F.coalesce(F.col("prev_b") + 1, first)
    cells = b.withColumn("lo", lo).filter(F.col("lo") <= F.col("b")).withColumn("k", F.explode(F.sequence("lo", "b")))
    share = (F.col("k") - F.col("prev.x")) / (F.col("head.x") - F.col("prev.x"))
    value = F.when(F.col("prev").isNull(), F.col("head.v")).otherwise(
        F.col("prev.v") + (F.col("head.v") - F.col("prev.v")) * share)
    best = cells.withColumn("v", value).groupBy("session_id", "k").agg(F.max("v").alias("v"))
    bins = int(lap_length_m)
    ws = Window.partitionBy("session_id").orderBy("k")
    nxt = F.when(F.lead("k").over(ws) == F.col("k") + 1, F.lead("v").over(ws))
    edge = F.least(F.col("v"), F.coalesce("nxt", F.lit(0.0)))
    per = best.withColumn("nxt", nxt).filter(F.col("k") < bins).withColumn("edge", edge)
    used = b.groupBy("session_id").agg(F.count_distinct("segment_index").alias("laps_used"))
    return per.groupBy("session_id").agg(
        F.coalesce(F.sum(F.when(F.col("edge") > 1.0, 1.0 / (F.col("edge") / 3.6))), F.lit(0.0)).alias("envelope_s"),
        (F.lit(bins) - F.count_if(F.col("edge") > 1.0)).alias("uncovered_bins"),
    ).join(used, "session_id")


def lap_pace(laps: DataFrame, envelope: DataFrame) -> DataFrame:
    """Lap-to-lap pace over the clean laps (``lap_time_s``, ``delta_s``); deviation is that of the population."""
    g = laps.filter("clean").groupBy("session_id").agg(
        F.count(F.lit(1)).alias("clean_laps"), F.min("lap_time_s").alias("best_lap_s"),
        F.percentile("lap_time_s", 0.5).alias("median_lap_s"), F.max("lap_time_s").alias("worst_clean_lap_s"),
        (F.max("lap_time_s") - F.min("lap_time_s")).alias("spread_s"), F.stddev_pop("lap_time_s").alias("std_dev_s"),
        F.avg("delta_s").alias("mean_gap_s"))
    e = envelope.select("session_id", F.col("envelope_s").alias("envelope_lap_s"))
    return g.join(e, "session_id", "left").withColumn("envelope_lap_s", F.coalesce("envelope_lap_s", F.lit(0.0))).withColumn(
        "time_available_s", F.greatest(F.lit(0.0), F.col("best_lap_s") - F.col("envelope_lap_s")))


def phase_spreads(phases: DataFrame) -> DataFrame:
    """Spread of the driver's own value per corner phase, over at least two laps."""
    p = F.col("phase_distance_m")
    return phases.groupBy(*PHASE).agg(
        F.min("corner_name").alias("corner_name"), F.count(F.lit(1)).alias("samples"), F.avg("driver_value").alias("mean"),
        F.max("driver_value").alias("best"), F.min("driver_value").alias("worst"),
        (F.max("driver_value") - F.min("driver_value")).alias("spread"), F.stddev_pop("driver_value").alias("std_dev"),
        F.when(F.count(p) >= 2, F.max(p) - F.min(p)).alias("point_spread_m"),
    ).filter("samples >= 2")


def recurring_losses(phases: DataFrame) -> DataFrame:
    return phases.groupBy(*PHASE).agg(
        F.min("corner_name").alias("corner_name"), F.avg("loss_s").alias("mean_loss_s"), F.count(F.lit(1)).alias("laps"),
        F.count_if(F.col("loss_s") > AFFECTED_LOSS_S).alias("laps_affected"),
    ).filter("mean_loss_s > 0")


def inconsistent_corners(phases: DataFrame) -> DataFrame:
    """Spread in seconds of each corner's minimum-speed loss, whose windows do not overlap."""
    return phases.filter("phase = 'minimum_speed'").groupBy(*CORNER).agg(
        F.min("corner_name").alias("corner_name"), F.count(F.lit(1)).alias("samples"), F.avg("loss_s").alias("mean_loss_s"),
        F.min("loss_s").alias("best_loss_s"), F.max("loss_s").alias("worst_loss_s"),
        (F.max("loss_s") - F.min("loss_s")).alias("spread_s"),
    ).filter("samples >= 2")


def loss_kind(recurring: Column, spread: Column, laps: Column, affected: Column) -> Column:
    is_recurring = (recurring >= RECURRING_S) & (laps > 0) & (affected / laps >= CONSISTENT_SHARE)
    is_erratic = spread >= ERRATIC_S
    return F.when(is_recurring & is_erratic, "both").when(is_recurring, "recurring").otherwise("inconsistent")


def priorities(phases: DataFrame, gaps: DataFrame) -> DataFrame:
    """One ranked opportunity per session and corner.  ``phases``: clean laps only; ``gaps``: session_id, mean_gap_s."""
    per = phases.groupBy(*PHASE).agg(
        F.avg("loss_s").alias("mean_loss"), F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("loss_s") > AFFECTED_LOSS_S).alias("affected"), F.max("loss_s").alias("hi"), F.min("loss_s").alias("lo"),
        F.avg("driver_value").alias("dv"), F.avg("reference_value").alias("rv"),
        F.min(F.struct("segment_index", phase_rank().alias("p"))).alias("seen"),
        F.min("corner_name").alias("corner_name"), F.min("apex_s_m").alias("apex_s_m"), F.min("corner_pos").alias("corner_pos"),
    )
    # Means are compared to a nanosecond so that equal phases fall back to the order they were seen in.
    rank = Window.partitionBy(*CORNER).orderBy(F.desc(F.round("mean_loss", 9)), "seen")
    per = per.withColumn("r", F.row_number().over(rank))
    item = F.struct("phase", "mean_loss", "n", "affected", "hi", "lo", "dv", "rv")
    c = per.groupBy(*CORNER).agg(
        F.min("corner_name").alias("corner_name"), F.min("apex_s_m").alias("apex_s_m"), F.min("corner_pos").alias("corner_pos"),
        F.max(F.when(F.col("r") == 1, item)).alias("head"), F.max(F.when(F.col("phase") == "minimum_speed", item)).alias("low"))
    c = c.withColumn("base", F.coalesce("low", "head"))
    recurring = F.greatest(F.lit(0.0), F.col("head.mean_loss"))
    spread = F.when(F.col("base.n") >= 2, F.col("base.hi") - F.col("base.lo")).otherwise(0.0)
    c = c.withColumn("spread_s", spread).filter((F.col("head.mean_loss") >= MIN_RECURRING_S) | (F.col("spread_s") >= MIN_SPREAD_S))
    c = c.select(
        *CORNER, "corner_name", "apex_s_m", "corner_pos", F.col("head.phase").alias("phase"),
        loss_kind(F.col("head.mean_loss"), F.col("spread_s"), F.col("head.n"), F.col("head.affected")).alias("kind"),
        recurring.alias("recurring_loss_s"), "spread_s", (recurring + SPREAD_WEIGHT * F.col("spread_s")).alias("score"),
        F.col("base.n").alias("laps"), F.col("base.affected").alias("laps_affected"),
        F.round("head.dv", 1).alias("driver_value"), F.round("head.rv", 1).alias("reference_value"))
    w = Window.partitionBy("session_id").orderBy(F.desc(F.round("score", 9)), "corner_pos")
    gap = F.col("mean_gap_s")
    return (
        c.withColumn("rank", F.row_number().over(w)).join(gaps, "session_id", "left")
        .withColumn("share_of_gap", F.when(gap > 0, F.least(F.lit(1.0), F.col("recurring_loss_s") / gap)).otherwise(0.0))
    )


# The texts of the advice.
ADVICE = {
    "min_speed": "carry %.0f km/h more minimum speed",
    "exit_speed": "carry %.0f km/h more speed onto the straight",
    "entry": "brake %.0f m later",
    "exit_brake": "hold the brake %.0f m longer",
    "exit_throttle": "back on the throttle %.0f m earlier",
    "exit": "get back on the throttle %.0f m earlier",
    "trail": "hold the brake %.0f m past the apex",
    "nothing": "losing %.1f s here with no single measurable cause — watch this corner on the data",
}


def _ordinal(n: Column) -> Column:
    suffix = (
        F.when((n % 100).between(10, 20), "th").when(n % 10 == 1, "st").when(n % 10 == 2, "nd").when(n % 10 == 3, "rd").otherwise("th"))
    return F.concat(n.cast("string"), suffix)


def suggested_changes(
    phases: DataFrame, ranked: DataFrame, driver: DataFrame, reference: DataFrame, rear: DataFrame
) -> DataFrame:
    """Text advice per priority from measured deltas: at most two clauses, in the order of the costliest phase.

    ``driver``/``reference``: gear_at_apex and trail_brake_depth_m per session and corner; ``rear``: rear stability.
    """
    def plausible(c: str) -> Column:
        return F.when(F.abs(c).between(MIN_DISTANCE_M, MAX_DISTANCE_M), F.col(c))

    def deficit(cond: Column) -> Column:
        return F.avg(F.when(cond, F.col("reference_value"))) - F.avg(F.when(cond, F.col("driver_value")))

    def middle(kind: str, c: str) -> Column:
        return F.percentile(F.when(F.col("phase") == kind, plausible(c)), 0.5)

    facts = phases.groupBy(*CORNER).agg(
        deficit(F.col("phase") == "minimum_speed").alias("low_deficit"), deficit(F.col("phase").startswith("exit")).alias("exit_deficit"),
        middle("entry", "entry_distance_delta_m").alias("entry_d"),
        *[middle(k, "exit_distance_delta_m").alias(f"{k}_d") for k in ("exit_brake", "exit_throttle", "exit")])
    d = driver.select(*CORNER, F.col("gear_at_apex").alias("g_mine"), F.col("trail_brake_depth_m").alias("t_mine"))
    r = reference.select(*CORNER, F.col("gear_at_apex").alias("g_ref"), F.col("trail_brake_depth_m").alias("t_ref"))
    s = rear.select(*CORNER, "state", "brake_overlap", "value_deg", F.col("braking_deg").alias("rear_braking_deg"), "baseline_deg",
                    "worst_segment", "worst_lap", "worst_clean")
    j = ranked.join(facts, CORNER).join(d, CORNER, "left").join(r, CORNER, "left").join(s, CORNER, "left")

    def text(fmt: str, c: str, cond: Column) -> Column:
        return F.when(cond, F.format_string(fmt, F.rint(c)))

    gear_word = F.when(F.col("g_mine") > F.col("g_ref"), "lower").otherwise("higher")
    clauses = {
        "min_speed": text(ADVICE["min_speed"], "low_deficit", F.col("low_deficit") >= MIN_SPEED_KPH),
        "exit_speed": text(ADVICE["exit_speed"], "exit_deficit", F.col("exit_deficit") >= MIN_SPEED_KPH),
        "entry": text(ADVICE["entry"], "entry_d", F.col("entry_d") > 0),
        "exit": F.coalesce(
            text(ADVICE["exit_brake"], "exit_brake_d", F.col("exit_brake_d") > 0),
            text(ADVICE["exit_throttle"], "exit_throttle_d", F.col("exit_throttle_d") > 0),
            text(ADVICE["exit"], "exit_d", F.col("exit_d") > 0)),
        "gear": F.when(
            (F.col("g_mine") > 0) & (F.col("g_ref") > 0) & (F.col("g_mine") != F.col("g_ref")),
            F.concat(F.lit("one gear "), gear_word, F.lit(" at the apex ("), _ordinal(F.col("g_ref")), F.lit(", not "), _ordinal(F.col("g_mine")), F.lit(")"))),
        "trail": F.when(
            F.col("t_ref") - F.col("t_mine") >= MIN_TRAIL_M,
            F.format_string(ADVICE["trail"], F.rint(F.col("t_ref") - F.col("t_mine")))),
    }
    clauses["exit_speed"] = F.when(clauses["min_speed"].isNull(), clauses["exit_speed"])
    sliding = F.coalesce(F.col("state") == "measured_instability", F.lit(False))
    settle = sliding & F.coalesce("brake_overlap", F.lit(False))
    for name in ("entry", "exit", "trail", "min_speed", "exit_speed"):
        clauses[name] = F.when(~settle, clauses[name])
    where = F.concat(
        F.format_string(" on segment %d (lap %d)", "worst_segment", "worst_lap"),
        F.when(~F.col("worst_clean"), ", a lap excluded as not clean").otherwise(""))
    unstable = F.when(
        settle,
        F.concat(F.lit("the rear slid under braking"), where, F.format_string(
            ": %.2f deg at the apex, %.2f deg on the brake, clean baseline %.2f deg: release the brake a little earlier, settle the car, then measure again",
            "value_deg", "rear_braking_deg", "baseline_deg")),
    ).when(
        sliding,
        F.concat(F.lit("the rear slipped"), where, F.format_string(
            ": %.2f deg at the apex, clean baseline %.2f deg, with the brake released before it: watch the rear with the usual change",
            "value_deg", "baseline_deg")),
    )
    ordered = F.array(*[clauses[n] for n in CLAUSE_ORDER["minimum_speed"]])
    for phase, names in CLAUSE_ORDER.items():
        ordered = F.when(F.col("phase") == phase, F.array(*[clauses[n] for n in names])).otherwise(ordered)
    j = j.withColumn("__all", F.array_compact(F.concat(F.array(unstable), ordered)))
    opening = lambda c: F.substring_index(c, " ", 2)
    unique = F.filter("__all", lambda c, i: ~F.exists(F.slice("__all", F.lit(1), i), lambda k: opening(k) == opening(c)))
    chosen = F.slice(unique, 1, 2)
    fallback = F.format_string(ADVICE["nothing"], "recurring_loss_s")
    return j.withColumn("suggestion", F.when(F.size(chosen) > 0, F.array_join(chosen, " and ")).otherwise(fallback)).select(
        *ranked.columns, "suggestion")


def next_targets(ranked: DataFrame, driver: DataFrame, reference: DataFrame, rear: DataFrame) -> DataFrame:
    """Up to three targets per session with the number to hit; from the second on only losses of 0.1 s or more."""
    w = Window.partitionBy("session_id").orderBy("rank")
    t = ranked.filter((F.col("rank") == 1) | (F.col("recurring_loss_s") >= MIN_TARGET_LOSS_S)).withColumn(
        "target_no", F.row_number().over(w)).filter(F.col("target_no") <= MAX_TARGETS)
    g = lambda df, n: df.select(*CORNER, F.col("gear_at_apex").alias(n))
    s = rear.select(*CORNER, "state", "threshold_deg", "value_deg", "brake_overlap")
    t = t.join(g(driver, "g_mine"), CORNER, "left").join(g(reference, "g_ref"), CORNER, "left").join(s, CORNER, "left")
    place = F.lit("at the apex")
    for phase, words in PHASE_PLACE.items():
        place = F.when(F.col("phase") == phase, words).otherwise(place)
    speed = F.when(
        F.col("driver_value") < F.col("reference_value"),
        F.format_string("%.1f km/h %s, against %.1f today", "reference_value", place, "driver_value"))
    gear = F.when(
        (F.col("g_mine") > 0) & (F.col("g_ref") > 0) & (F.col("g_mine") != F.col("g_ref")),
        F.concat(_ordinal(F.col("g_ref")), F.lit(" gear at the apex, against "), _ordinal(F.col("g_mine")), F.lit(" today")))
    measure = F.concat_ws("; ", speed, gear)
    usual = F.when(measure != "", measure).otherwise(F.format_string("no more than %.3f s lost here", "recurring_loss_s"))
    sliding = F.coalesce(F.col("state") == "measured_instability", F.lit(False))
    braking = F.when(F.col("brake_overlap"), " with the brake applied").otherwise("")
    stable = F.format_string(
        "peak rear slip under %.1f deg at the apex%s, against %.1f deg today, while matching the reference brake point",
        "threshold_deg", braking, "value_deg")
    caveat = F.when(sliding, "stabilise the rear first").when(
        F.col("state") == "unknown", "rear stability was not measurable: a controlled test").otherwise("")
    return t.withColumn("measure", F.when(sliding, stable).otherwise(usual)).withColumn("caveat", caveat)


def corner_table(phases: DataFrame, driver: DataFrame, reference: DataFrame, ranked: DataFrame) -> DataFrame:
    """Driver against reference per corner: mean minimum speeds, gears, line offset, rank."""
    low = phases.filter("phase = 'minimum_speed'").groupBy(*CORNER).agg(
        F.avg("driver_value").alias("min_speed"), F.avg("reference_value").alias("ref_min_speed"))
    r = reference.select(*CORNER, F.col("gear_at_apex").alias("ref_gear"), F.col("lateral_at_apex_m").alias("ref_lateral"))
    return (
        driver.join(low, CORNER, "left").join(r, CORNER, "left").join(ranked.select(*CORNER, "rank"), CORNER, "left")
        .withColumn("line_offset_m", F.col("lateral_at_apex_m") - F.col("ref_lateral"))
    )


def corner_lap_detail(phases: DataFrame, channels: DataFrame) -> DataFrame:
    """Minimum speed, gear, brake, trail and loss per clean lap and corner."""
    c = channels.select(*LAP, "corner_id", F.when(F.col("gear_at_apex") > 0, F.col("gear_at_apex")).alias("gear"), "brake_peak", "trail_brake_depth_m")
    return phases.filter("phase = 'minimum_speed'").select(
        *LAP, "corner_id", F.col("driver_value").alias("min_speed"), F.col("reference_value").alias("ref_min_speed"), "loss_s",
    ).join(c, [*LAP, "corner_id"], "left")


def corner_detail_spreads(detail: DataFrame) -> DataFrame:
    return detail.groupBy(*CORNER).agg(
        (F.max("min_speed") - F.min("min_speed")).alias("speed_spread"), (F.max("loss_s") - F.min("loss_s")).alias("loss_spread"),
        F.percentile("min_speed", 0.5).alias("median_speed"))


def excluded_laps(laps: DataFrame, guard: DataFrame) -> DataFrame:
    """Every segment that was not analysed, with the reason."""
    cols = [*LAP, "lap_number", "duration_s", "status", "reason"]
    partial = guard.filter("guard <> 'ok'").withColumn("status", F.lit("unanalysable")).withColumn("reason", F.col("guard"))
    return laps.filter("status <> 'eligible'").select(*cols).unionByName(partial.select(*cols))


def lap_table(laps: DataFrame) -> DataFrame:
    """Lap times against the reference and against the session's best clean lap."""
    best = F.min(F.when(F.col("clean"), F.col("lap_time_s"))).over(Window.partitionBy("session_id"))
    return laps.withColumn("vs_best_s", F.col("lap_time_s") - best)


NUMBER = r"\d+:\d{2}\.\d{3}|\d+(?:[.,]\d+)?"


def _number_value(token: Column) -> Column:
    minutes = F.substring_index(token, ":", 1).try_cast("double") * 60 + F.substring_index(token, ":", -1).try_cast("double")
    return F.when(token.contains(":"), minutes).otherwise(F.replace(token, F.lit(","), F.lit(".")).try_cast("double"))


def reply_warnings(rows: DataFrame) -> DataFrame:
    """Problems of each (reply, facts) row: ungrounded numbers, length, question count, annotation, truncation."""
    tokens = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    known = F.filter(F.transform(tokens(F.col("facts")), _number_value), lambda v: v.isNotNull())
    r = rows.withColumn("__known", known)

    def grounded(t: Column) -> Column:
        value = _number_value(t)
        digits = F.when(t.contains("."), F.length(F.substring_index(t, ".", -1))).otherwise(0)
        scale = F.pow(F.lit(10.0), digits)
        clock = F.exists("__known", lambda k: F.abs(k - value) < 0.0005)
        plain = F.exists("__known", lambda k: F.abs(F.rint(k * scale) / scale - value) < F.pow(F.lit(10.0), -digits - 6))
        return F.when(t.contains(":"), clock).otherwise(plain)

    invented = F.array_sort(F.array_distinct(F.filter(tokens(F.col("reply")), lambda t: ~grounded(t))))
    reply = F.col("reply")
    last = F.substring(reply, -1, 1)
    return r.select(
        *rows.columns,
        F.array_join(invented, ", ").alias("invented"),
        F.size(F.filter(F.split(F.trim(reply), r"\s+"), lambda x: x != "")).alias("words"),
        (F.length(reply) - F.length(F.replace(reply, F.lit("?"), F.lit("")))).alias("questions"),
        (reply.rlike(r"\w\(\d+\)") | reply.contains("Count:")).alias("annotated"),
        ((reply != "") & ~last.isin(".", "?", "!", '"', "'") & ~reply.endswith(").")).alias("truncated"),
    ).withColumn("too_long", F.col("words") > MAX_REPLY_WORDS)


def is_meta_output(text: Column) -> Column:
    """Text that is leaked reasoning instead of something to say."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    low = F.lower(t)
    hit = (t == "") | t.startswith("-") | t.startswith("–") | t.endswith(":")
    for p in META_PREFIXES:
        hit = hit | low.startswith(p)
    return hit


def fuel_facts(frames: DataFrame, by: Sequence[str] = ("session_id",), mapping: str = "label") -> DataFrame:
    """Fuel use, laps left and status; ties of the modal session type take the smaller code."""
    fuel, cap = F.col("fuel_l"), F.col("fuel_capacity_l")
    ok = (fuel > 0) & ~F.coalesce((cap > 0) & (fuel > cap), F.lit(False))
    order = F.when(ok, F.col("frame_id"))
    g = frames.groupBy(*by).agg(
        F.min_by("fuel_l", order).alias("start_l"), F.max_by("fuel_l", order).alias("end_l"),
        F.count_if(ok).alias("valid"), F.count_distinct("lap_number").alias("laps_completed"),
        F.max("lap_number").alias("current_lap"), F.mode("session_type", True).alias("session_code"),
        F.mode("race_laps_total", True).alias("race_laps_total"))
    g = g.withColumn("start_l", F.when(F.col("valid") > 0, F.col("start_l"))).withColumn("end_l", F.when(F.col("valid") > 0, F.col("end_l")))
    g = g.withColumn("used_l", F.col("start_l") - F.col("end_l"))
    g = g.withColumn("per_lap_l", F.when((F.col("used_l") > 0) & (F.col("laps_completed") > 0), F.col("used_l") / F.col("laps_completed")))
    g = g.withColumn("laps_left", F.when(F.col("per_lap_l") > 0, F.col("end_l") / F.col("per_lap_l")))
    g = g.withColumn("session_type", fuel_session_type(F.col("session_code"), mapping))
    left = F.greatest(F.lit(0), F.col("race_laps_total") - F.col("current_lap"))
    return g.withColumn("race_laps_left", F.when(F.col("session_type") == "race", left)).withColumn("fuel_status", fuel_status(F.col("laps_left")))


def fuel_status(laps_left: Column) -> Column:
    return F.when(laps_left.isNull(), "UNKNOWN").when(laps_left < 2, "CRITICAL").when(laps_left <= 5, "WARNING").otherwise("OK")


def fuel_calls(facts: DataFrame) -> DataFrame:
    """Races whose fuel state is worth a call."""
    close = F.coalesce(F.col("race_laps_left") - F.col("laps_left") <= 3, F.lit(False))
    return facts.filter((F.col("session_type") == "race") & (F.col("fuel_status").isin("WARNING", "CRITICAL") | close))
