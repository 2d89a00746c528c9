"""Building a corner model from a reference lap: detection, matching with curated corners, assembly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranges import range_join
from ..functions.storage import materialise
from .segments import LAP

# Fixed values of the detection.
MIN_BRAKE = 0.15
MAX_THROTTLE = 0.90
MIN_EVENT_M = 5
MAX_GAP_M = 2
PROMINENCE_M = 80
MIN_DROP_KPH = 10.0
HARD_LIFT = 0.30
SIGNIFICANT_LIFT = 0.50
MIN_DROP_LIFT_KPH = 3.0
MIN_SEPARATION_M = 60
WOT = 0.95
WOT_GAP_M = 3
ENTRY_THROTTLE = 0.98
LOCAL_RADIUS_M = 8
MIN_PROMINENCE_KPH = 2.5
ZONE_THRESHOLD_KPH = 1.0
ZONE_HALF_WIDTH_M = 120
ZONE_CORE_M = 12
MAX_MATCH_M = 150.0


def _along():
    """The metres of a lap in order."""
    return Window.partitionBy(*LAP).orderBy("s_m")


def _zones(grid: DataFrame, flag: Column, kind: str, merge_released: bool) -> DataFrame:
    """Runs of ``flag`` along the lap: (s0, s1, kind).  Braking runs join when the pedal never reached zero between them."""
    g = grid.withColumn("on", flag).withColumn("prev_on", F.lag("on").over(_along()))
    # A new zone starts where the flag rises; when joining, only if the brake touched zero since the last one.
    rise = F.col("on") & ~F.coalesce("prev_on", F.lit(False))
    if merge_released:
        upto = _along().rowsBetween(Window.unboundedPreceding, 0)
        g = g.withColumn("last_on", F.last(F.when(F.col("on"), F.col("s_m")), True).over(_along().rowsBetween(Window.unboundedPreceding, -1)))
        g = g.withColumn("last_free", F.last(F.when(F.col("brake_norm") <= 0, F.col("s_m")), True).over(upto))
        rise = rise & (F.col("last_on").isNull() | F.coalesce(F.col("last_free") > F.col("last_on"), F.lit(False)))
    g = g.withColumn("z", F.sum(rise.cast("int")).over(_along()))
    return g.filter("on").groupBy(*LAP, "z").agg(F.min("s_m").alias("s0"), F.max("s_m").alias("s1")).filter(
        F.col("s1") - F.col("s0") >= MIN_EVENT_M).select(*LAP, "s0", "s1", F.lit(kind).alias("kind"))


def pedal_candidates(grid: DataFrame) -> DataFrame:
    """Corner candidates from brake and lift zones; the apex is the first speed minimum of a zone."""
    brake = _zones(grid, F.col("brake_norm") >= MIN_BRAKE, "brake", True)
    lift = _zones(grid, (F.col("throttle_norm") < MAX_THROTTLE) & (F.col("brake_norm") < MIN_BRAKE), "lift", False)
    wz = Window.partitionBy(*LAP).orderBy("s0", "s1")
    z = brake.unionByName(lift).withColumn("reach", F.max("s1").over(wz.rowsBetween(Window.unboundedPreceding, -1)))
    z = z.withColumn("zone", F.sum(F.coalesce(F.col("s0") - F.col("reach") > MAX_GAP_M, F.lit(True)).cast("int")).over(wz))
    z = z.groupBy(*LAP, "zone").agg(
        F.min("s0").cast("double").alias("z_lo"), F.max("s1").cast("double").alias("z_hi"), F.max((F.col("kind") == "brake").cast("int")).alias("braked"))
    left = F.max("speed_kph").over(_along().rowsBetween(-PROMINENCE_M, -1))
    right = F.max("speed_kph").over(_along().rowsBetween(1, PROMINENCE_M))
    g = grid.withColumn("lp", F.coalesce(left, "speed_kph")).withColumn("rp", F.coalesce(right, "speed_kph")).withColumn("s_x", F.col("s_m").cast("double"))
    at = F.struct("speed_kph", "s_m", "lp", "rp")
    c = range_join(g, z, LAP, "s_x", "z_lo", "z_hi").groupBy(*LAP, "zone", "z_lo", "z_hi", "braked").agg(
        F.min(at).alias("a"), F.min("throttle_norm").alias("low_throttle"))
    drop = F.col("a.lp") - F.col("a.speed_kph")
    lifted = (drop >= MIN_DROP_KPH) | (F.col("low_throttle") <= HARD_LIFT) | (
        (F.col("low_throttle") <= SIGNIFICANT_LIFT) & (drop >= MIN_DROP_LIFT_KPH))
    ok = F.when(F.col("braked") == 1, drop >= MIN_DROP_KPH).otherwise(lifted)
    return c.filter(ok).select(
        *LAP, F.col("a.s_m").alias("apex_m"), F.col("a.speed_kph").alias("min_speed"),
        F.least(F.col("a.lp") - F.col("a.speed_kph"), F.col("a.rp") - F.col("a.speed_kph")).alias("prominence"),
        F.col("z_lo").alias("s_start_m"), F.col("z_hi").alias("s_end_m"))


def merge_close(candidates: DataFrame, grid: DataFrame | None, min_separation_m: int = MIN_SEPARATION_M) -> DataFrame:
    """Keep the most prominent of candidates closer than ``min_separation_m``, unless the throttle was wide open between them."""
    if grid is None:
        c = candidates.withColumn("open_from", F.lit(1e9))
    else:
        closed = F.last(F.when(F.col("throttle_norm") < WOT, F.col("s_m")), True).over(_along().rowsBetween(Window.unboundedPreceding, -1))
        o = grid.select(*LAP, F.col("s_m").cast("double").alias("s_start_m"), (F.coalesce(closed, F.lit(-1)) + 1).cast("double").alias("open_from"))
        c = candidates.join(o, [*LAP, "s_start_m"])
    # Rounds of local winners: what is stronger than everything within twice the separation can't touch another winner's
    # neighbours, so all of them are settled at once; a lap needs as many rounds as its longest chain of weaker neighbours.
    own = [*LAP, "apex_m", "min_speed", "prominence", "s_start_m", "s_end_m", "open_from"]
    reach = Window.partitionBy(*LAP).orderBy("apex_m").rangeBetween(-2 * min_separation_m, 2 * min_separation_m)
    rank = F.struct("prominence", (-F.col("min_speed")).alias("v"), (-F.col("apex_m")).alias("a"))
    left, kept = materialise(c.select(*own)), None
    near = Window.partitionBy(*LAP).orderBy("apex_m").rangeBetween(1 - min_separation_m, min_separation_m - 1)
    while grid is None and not left.isEmpty():  # no throttle keeps neighbours apart: whoever is near a winner has lost
        ranked = left.withColumn("wins", rank == F.max(rank).over(near))
        settled = materialise(ranked.withColumn("met", F.bool_or("wins").over(near)))
        wins, left = settled.filter("wins").select(*own), settled.filter("NOT met").select(*own)
        kept = wins if kept is None else kept.unionByName(wins)
    while not left.isEmpty():
        settled = materialise(left.withColumn("wins", rank == F.max(rank).over(reach)))
        wins, left = settled.filter("wins").drop("wins"), settled.filter("NOT wins").drop("wins")
        if kept is None:
            kept = materialise(wins)
            continue
        met = wins.join(kept.select(*LAP, *(F.col(n).alias(f"k_{n}") for n in own[2:])), LAP).filter(F.abs(F.col("apex_m") - F.col("k_apex_m")) < min_separation_m)
        end, start = F.least("k_s_end_m", "s_end_m"), F.greatest("k_s_start_m", "s_start_m")
        # ``open_from``: since where the throttle has been wide open up to the later zone's start.
        later = F.when(F.col("s_start_m") >= F.col("k_s_start_m"), F.col("open_from")).otherwise(F.col("k_open_from"))
        met = met.withColumn("apart", (start - end - 1 >= WOT_GAP_M) & (later <= end + 1))
        lost = met.groupBy(*LAP, "apex_m").agg(F.bool_or("apart").alias("apart")).filter("NOT apart").drop("apart")
        # Losers widen the winners that they were near to; each winner meets one loser a round at most.
        wide = met.join(lost, [*LAP, "apex_m"]).select(
            *LAP, F.col("k_apex_m").alias("apex_m"), F.col("s_start_m").alias("l_start"), F.col("s_end_m").alias("l_end"), F.col("open_from").alias("l_open"))
        earlier = F.coalesce(F.col("l_start") < F.col("s_start_m"), F.lit(False))
        widened = kept.join(wide, [*LAP, "apex_m"], "left").select(
            *LAP, "apex_m", "min_speed", "prominence", F.when(earlier, F.col("l_start")).otherwise(F.col("s_start_m")).alias("s_start_m"),
            F.greatest("s_end_m", "l_end").alias("s_end_m"), F.when(earlier, F.col("l_open")).otherwise(F.col("open_from")).alias("open_from"))
        kept = materialise(widened.unionByName(wins.join(lost, [*LAP, "apex_m"], "left_anti").select(*own)))
    return (left if kept is None else kept).drop("open_from")


def separate_zones(candidates: DataFrame) -> DataFrame:
    """Overlapping neighbours meet half-way between their apexes."""
    w = Window.partitionBy(*LAP).orderBy("apex_m")
    nxt_apex, nxt_start = F.lead("apex_m").over(w), F.lead("s_start_m").over(w)
    prv_apex, prv_end = F.lag("apex_m").over(w), F.lag("s_end_m").over(w)
    mid_next, mid_prev = F.floor((F.col("apex_m") + nxt_apex) / 2), F.floor((prv_apex + F.col("apex_m")) / 2)
    end = F.when(F.col("s_end_m") > nxt_start, F.greatest(F.col("apex_m") + 1, mid_next)).otherwise(F.col("s_end_m"))
    start = F.when(prv_end > F.col("s_start_m"), F.least(F.col("apex_m") - 1, mid_prev)).otherwise(F.col("s_start_m"))
    return candidates.withColumn("e", end.cast("double")).withColumn("s", start.cast("double")).withColumn("s_end_m", F.col("e")).withColumn(
        "s_start_m", F.col("s")).drop("e", "s")


def backfill(candidates: DataFrame, grid: DataFrame) -> DataFrame:
    """Extend each zone back to the last full-throttle metre and forward to the first open one, within its neighbours."""
    w = Window.partitionBy(*LAP).orderBy("apex_m")
    last = grid.groupBy(*LAP).agg(F.max("s_m").alias("last_m"))
    g = grid.select(*LAP, F.col("s_m").cast("double").alias("s_x"), "throttle_norm")
    c = candidates.join(last, LAP).withColumn("top", F.coalesce(F.lead("s_start_m").over(w) - 1, F.col("last_m")).cast("double")).withColumn("from_m", F.col("s_end_m") + 1)
    ends = range_join(g, c.select(*LAP, "apex_m", "from_m", "top"), LAP, "s_x", "from_m", "top").filter(
        F.col("throttle_norm") >= MAX_THROTTLE).groupBy(*LAP, "apex_m").agg(F.min("s_x").alias("new_end"))
    c = c.join(ends, [*LAP, "apex_m"], "left").withColumn("s_end_m", F.coalesce("new_end", "s_end_m"))
    c = c.withColumn("floor_m", F.coalesce(F.lag("s_end_m").over(w) + 1, F.lit(0.0))).withColumn("to_m", F.col("s_start_m") - 1)
    opens = range_join(g, c.select(*LAP, "apex_m", "floor_m", "to_m"), LAP, "s_x", "floor_m", "to_m").filter(
        F.col("throttle_norm") >= ENTRY_THROTTLE).groupBy(*LAP, "apex_m").agg(F.max("s_x").alias("open_m"))
    c = c.join(opens, [*LAP, "apex_m"], "left")
    start = F.when(F.col("to_m") < F.col("floor_m"), F.col("s_start_m")).otherwise(F.coalesce(F.col("open_m") + 1, F.col("floor_m")))
    return c.withColumn("s_start_m", start).select(*candidates.columns)


def detect_from_pedals(grid: DataFrame, min_separation_m: int = MIN_SEPARATION_M) -> DataFrame:
    """Corners of each lap from its pedal traces on the metre grid."""
    merged = materialise(merge_close(pedal_candidates(grid), grid, min_separation_m))
    return backfill(separate_zones(merged), grid)


def detect_from_speed(grid: DataFrame, min_separation_m: int = MIN_SEPARATION_M) -> DataFrame:
    """Corners of each lap from speed minima alone."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*LAP))
    # Rounded, so that the order of summation doesn't decide which of two equal speeds is the lower.
    g = grid.withColumn("v", F.round(F.avg("speed_kph").over(_along().rowsBetween(-2, 2)), 9)).withColumn("n", n)
    low = F.min("v").over(_along().rowsBetween(-LOCAL_RADIUS_M, LOCAL_RADIUS_M))
    lp, rp = F.max("v").over(_along().rowsBetween(-PROMINENCE_M, -1)), F.max("v").over(_along().rowsBetween(1, PROMINENCE_M))
    g = g.withColumn("low", low).withColumn("lp", lp).withColumn("rp", rp).withColumn(
        "down_ok", F.col("v") >= F.lag("v").over(_along()) - ZONE_THRESHOLD_KPH).withColumn("up_ok", F.col("v") <= F.lead("v").over(_along()) + ZONE_THRESHOLD_KPH)
    inner = (F.col("s_m") >= LOCAL_RADIUS_M) & (F.col("s_m") < F.col("n") - LOCAL_RADIUS_M)
    prominence = F.least(F.col("lp") - F.col("v"), F.col("rp") - F.col("v"))
    c = g.filter(inner & (F.col("v") <= F.col("low"))).withColumn("prominence", prominence).filter(
        F.col("prominence") >= MIN_PROMINENCE_KPH).select(
        *LAP, F.col("s_m").alias("apex_m"), F.col("v").alias("min_speed"), "prominence", F.lit(0.0).alias("s_start_m"), F.lit(0.0).alias("s_end_m"))
    kept = materialise(merge_close(c, None, min_separation_m))
    # Walk outwards from the apex while the speed rises; beyond the core the first fall ends the zone.
    last = g.groupBy(*LAP).agg((F.max("n") - 1).alias("last_m"))
    a = kept.join(last, LAP).withColumn("lo", F.greatest(F.lit(0), F.col("apex_m") - ZONE_HALF_WIDTH_M).cast("double")).withColumn(
        "hi", F.least(F.col("last_m"), F.col("apex_m") + ZONE_HALF_WIDTH_M).cast("double"))
    cells = range_join(
        g.select(*LAP, "s_m", F.col("s_m").cast("double").alias("s_x"), "down_ok", "up_ok"),
        a.select(*LAP, "apex_m", "lo", "hi"), LAP, "s_x", "lo", "hi")
    s, apex = F.col("s_m"), F.col("apex_m")
    before, after = (s < apex) & (s > F.col("lo")), (s > apex) & (s < F.col("hi"))
    by = Window.partitionBy(*LAP, "apex_m")
    cells = cells.withColumn("stop_lo", F.max(F.when(before & ~F.col("down_ok") & (apex - s > ZONE_CORE_M), s)).over(by)).withColumn(
        "stop_hi", F.min(F.when(after & ~F.col("up_ok") & (s - apex > ZONE_CORE_M), s)).over(by))
    zone = cells.groupBy(*LAP, "apex_m").agg(
        F.min(F.when(before & F.col("down_ok") & (s > F.coalesce("stop_lo", F.lit(-1))), s)).alias("st"),
        F.max(F.when(after & F.col("up_ok") & (s < F.coalesce("stop_hi", F.lit(1 << 30))), s)).alias("en"))
    z = a.join(zone, [*LAP, "apex_m"], "left")
    start = F.least(F.coalesce("st", "lo"), F.col("apex_m") - 1).cast("double")
    end = F.greatest(F.coalesce("en", "hi"), F.col("apex_m") + 1).cast("double")
    return separate_zones(z.withColumn("s_start_m", start).withColumn("s_end_m", end).select(*kept.columns))


def match_corners(corners: DataFrame, candidates: DataFrame, preserved: Column | None = None) -> DataFrame:
    """Curated corners with the candidate each one claims, if any: nearest pairs first, one to one.

    ``candidates``: track_id, candidate, apex_m, s_start_m, s_end_m.  ``preserved`` corners claim nothing.
    """
    open_ = corners if preserved is None else corners.filter(~preserved)
    near = open_.select("track_id", "corner_pos", "apex_s_m", (F.col("apex_s_m") - MAX_MATCH_M).alias("m_lo"), (F.col("apex_s_m") + MAX_MATCH_M).alias("m_hi"))
    cand = candidates.select("track_id", "candidate", F.col("apex_m").cast("double").alias("cand_apex_m"))
    pairs = range_join(cand, near, ["track_id"], "cand_apex_m", "m_lo", "m_hi").select(
        "track_id", "corner_pos", "candidate", F.abs(F.col("cand_apex_m") - F.col("apex_s_m")).alias("gap"))
    # Rounds of pairs that are each other's nearest: what a claim of all pairs, nearest first, would take, without an order
    # over a whole track.
    left, claimed = materialise(pairs), None
    rank = F.struct("gap", "corner_pos", "candidate")
    while not left.isEmpty():
        best = left.groupBy("track_id", "corner_pos").agg(F.min(rank).alias("r")).select("track_id", "r.*")
        mine = left.groupBy("track_id", "candidate").agg(F.min(rank).alias("r")).select("track_id", "r.corner_pos", "r.candidate")
        mutual = materialise(best.join(mine, ["track_id", "corner_pos", "candidate"]).select(*pairs.columns))
        claimed = mutual if claimed is None else claimed.unionByName(mutual)
        left = materialise(left.join(mutual.select("track_id", "corner_pos"), ["track_id", "corner_pos"], "left_anti").join(
            mutual.select("track_id", "candidate"), ["track_id", "candidate"], "left_anti").select(*pairs.columns))
    claimed = left if claimed is None else claimed
    return corners.join(claimed, ["track_id", "corner_pos"], "left")


def refresh_corners(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """Matched corners take the candidate's geometry; everything else stays as curated."""
    c = candidates.select(
        "track_id", "candidate", F.round("s_start_m", 1).alias("new_start"), F.round(F.col("apex_m").cast("double"), 1).alias("new_apex"),
        F.round("s_end_m", 1).alias("new_end"))
    return (
        matched.join(c, ["track_id", "candidate"], "left")
        .withColumn("s_start_m", F.coalesce("new_start", "s_start_m")).withColumn("apex_s_m", F.coalesce("new_apex", "apex_s_m"))
        .withColumn("s_end_m", F.coalesce("new_end", "s_end_m")).drop("new_start", "new_apex", "new_end")
    )


def assemble_model(candidates: DataFrame, apex_side: str = "right") -> DataFrame:
    """Corner rows of a new model: t1, t2, … along the lap, rounded for output."""
    w = Window.partitionBy(*LAP).orderBy("apex_m")
    i = F.row_number().over(w)
    return candidates.select(
        *LAP, F.concat(F.lit("t"), i.cast("string")).alias("corner_id"), F.concat(F.lit("turn "), i.cast("string")).alias("corner_name"),
        F.round("s_start_m", 1).alias("s_start_m"), F.round(F.col("apex_m").cast("double"), 1).alias("apex_s_m"),
        F.round("s_end_m", 1).alias("s_end_m"), F.lit(apex_side).alias("apex_side"), F.lit("default_cli_option").alias("apex_side_source"))
