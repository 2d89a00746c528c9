"""Lap segments: contiguous runs of one lap number, their clocks, durations and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK_ROWS, kth_value, run_pieces, runs, tag_runs
from ..functions.storage import materialise

SESSION = ["session_id"]
LAP = ["session_id", "segment_index"]

# Fixed values of the measurements.
PIT_STOP_SPEED_KPH = 3.0
START_WINDOW_S = 3.0
DURATION_TOLERANCE_S = 1.0
SETTLE_FRAMES = 25


def build_segments(frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per contiguous run of ``lap_number``; frame ranges are half-open."""
    return runs(frames, SESSION, "frame_id", "lap_number", chunk_rows=chunk_rows).select(
        "session_id",
        F.col("run_index").alias("segment_index"),
        F.col("run_value").alias("lap_number"),
        F.col("run_start").alias("start_frame"),
        F.col("next_start").alias("next_start_frame"),
    )


def with_segments(frames: DataFrame, chunk_rows: int = CHUNK_ROWS, written: bool = True) -> DataFrame:
    """Frames with ``segment_index`` and the clock of the segment's first row.

    Only three columns pass through the ordered step; the wide frames meet the result in one equi join on
    (session, chunk), which is a broadcast join whenever the written piece table is small.
    """
    pieces = run_pieces(
        frames, SESSION, "frame_id", "lap_number", {"first_clock_s": "session_time_s"}, chunk_rows
    )
    if written:
        pieces = materialise(pieces)
    return tag_runs(
        frames,
        pieces,
        SESSION,
        "frame_id",
        {"run_index": "segment_index", "first_clock_s": "segment_first_clock_s"},
        chunk_rows,
    )


def lap_start_clock(seg_frames: DataFrame) -> DataFrame:
    """Upper median of (session clock − lap clock) per segment.

    The clocks can differ on every row, so the order statistic never sorts a lap in one task.
    """
    diff = F.col("session_time_s") - F.col("lap_time_s")
    return kth_value(seg_frames, LAP, diff, F.floor(F.col("n") / 2), "lap_start_s").drop("n")


def stationary_seconds(seg_frames: DataFrame, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Longest stretch below pit-lane speed; a stretch ends at the first sample after it."""
    below = F.coalesce(F.col("speed_kph") < PIT_STOP_SPEED_KPH, F.lit(False))
    stretch = runs(seg_frames, LAP, "frame_id", below, {"clock": "session_time_s"}, chunk_rows)
    w = Window.partitionBy(*LAP).orderBy("run_start")
    slow = stretch.withColumn("until", F.lead("clock").over(w)).filter("run_value")
    # Only laps with a slow stretch need their last clock, for a stretch that is still open at the end.
    last = (
        seg_frames.join(slow.filter("until IS NULL").select(*LAP), LAP, "left_semi")
        .groupBy(*LAP)
        .agg(F.max("session_time_s").alias("last_clock"))
    )
    return (
        slow.join(last, LAP, "left")
        .groupBy(*LAP)
        .agg(F.max(F.coalesce("until", "last_clock") - F.col("clock")).alias("stationary_s"))
    )


def segment_measures(seg_frames: DataFrame) -> DataFrame:
    """Everything about a segment that one partial aggregation can answer."""
    optional = set(seg_frames.columns)

    def positive_max(name: str) -> Column:
        if name not in optional:
            return F.lit(None).cast("double")
        return F.max(F.when((F.col(name) > 0) & ~F.isnan(F.col(name).cast("double")), F.col(name)))

    in_window = F.col("session_time_s") - F.col("segment_first_clock_s") < START_WINDOW_S
    valid = F.col("lap_valid") if "lap_valid" in optional else F.lit(None).cast("boolean")
    return seg_frames.groupBy(*LAP).agg(
        F.min("lap_number").alias("lap_number"),
        F.min("frame_id").alias("start_frame"),
        F.max("frame_id").alias("end_frame"),
        F.count(F.lit(1)).alias("frames"),
        F.min("segment_first_clock_s").alias("first_clock_s"),
        F.max_by("session_time_s", "frame_id").alias("last_clock_s"),
        F.coalesce(positive_max("lap_time_s"), F.lit(0.0)).alias("max_lap_time_s"),
        positive_max("scoring_last_lap_time_s").alias("max_scoring_s"),
        F.min("lap_distance_m").alias("min_distance_m"),
        F.max("lap_distance_m").alias("max_distance_m"),
        F.max(F.when(in_window, F.col("speed_kph"))).alias("entry_peak_kph"),
        F.bool_or(~valid).alias("any_invalid"),
        (F.bool_and(F.coalesce(valid, F.lit(False)))).alias("all_valid"),
        F.min(valid.cast("int")).alias("valid_lo"),
        F.max(valid.cast("int")).alias("valid_hi"),
    )


def plausible(candidate: Column, fallback: Column) -> Column:
    return F.coalesce((fallback > 0) & (F.abs(candidate - fallback) <= DURATION_TOLERANCE_S), F.lit(False))


def durations(measures: DataFrame, starts: DataFrame, same_segment_scoring: bool = False) -> DataFrame:
    """Authoritative duration of every segment and the source it came from.

    An explicit time (a column ``authoritative_lap_time_s`` on ``measures``) wins; then the difference of
    consecutive lap-start clocks, then the scorer's time seen in the next segment, then the lap clock.
    """
    w = Window.partitionBy("session_id").orderBy("segment_index")
    m = measures.join(starts, LAP, "left")
    m = m.withColumn("telemetry_s", F.lead("lap_start_s").over(w) - F.col("lap_start_s")).withColumn(
        "scorer_s", F.lead("max_scoring_s").over(w)
    )
    fallback = F.col("max_lap_time_s")
    explicit = (
        F.col("authoritative_lap_time_s") if "authoritative_lap_time_s" in measures.columns else F.lit(None)
    ).cast("double")
    steps = [
        (explicit > 0, explicit, "explicit"),
        ((F.col("telemetry_s") > 0) & plausible(F.col("telemetry_s"), fallback), F.col("telemetry_s"), "telemetry"),
        (plausible(F.col("scorer_s"), fallback), F.col("scorer_s"), "scorer"),
    ]
    if same_segment_scoring:
        steps.append((plausible(F.col("max_scoring_s"), fallback), F.col("max_scoring_s"), "own_scorer"))
    value, source = fallback, F.lit("lap_time")
    for cond, expr, label in reversed(steps):
        ok = F.coalesce(cond, F.lit(False))
        value = F.when(ok, expr).otherwise(value)
        source = F.when(ok, F.lit(label)).otherwise(source)
    return m.withColumn("duration_s", value).withColumn("duration_source", source).drop("telemetry_s", "scorer_s")


def sample_rate(measures: DataFrame) -> DataFrame:
    """Median over segments of rows per second of clock span."""
    span = F.col("last_clock_s") - F.col("first_clock_s")
    return (
        measures.filter((F.col("frames") >= 2) & (span > 0))
        .groupBy("session_id")
        .agg(F.percentile(F.col("frames") / span, 0.5).alias("rate_hz"))
    )


def row_rate_ratio() -> Column:
    span = F.col("last_clock_s") - F.col("first_clock_s")
    return F.when((F.col("rate_hz") > 0) & (span > 0), F.col("frames") / (span * F.col("rate_hz")))


def row_rate(measures: DataFrame, rates: DataFrame) -> DataFrame:
    """Rows per expected row over the clock span of each segment."""
    return measures.join(rates, "session_id", "left").withColumn("row_rate", row_rate_ratio())


def yardstick_of(interior: Column, positive: Column, over=None) -> Column:
    """Median interior duration, else median of all; an aggregate, or a window function with ``over``."""
    parts = [F.percentile(F.when(cond, F.col("duration_s")), 0.5) for cond in (interior, positive)]
    return F.coalesce(*[p.over(over) if over is not None else p for p in parts], F.lit(0.0))


def yardstick(durs: DataFrame) -> DataFrame:
    """Median duration of the interior segments; of all segments when none is interior."""
    w = Window.partitionBy("session_id")
    d = durs.withColumn("last_index", F.max("segment_index").over(w))
    positive = F.col("duration_s") > 0
    interior = positive & (F.col("segment_index") > 0) & (F.col("segment_index") < F.col("last_index"))
    return d.groupBy("session_id").agg(yardstick_of(interior, positive).alias("yardstick_s"))


def validity_trust(measures: DataFrame) -> DataFrame:
    """The validity flag counts only when it takes both values somewhere in the session."""
    return measures.groupBy("session_id").agg(
        F.coalesce(F.min("valid_lo") != F.max("valid_hi"), F.lit(False)).alias("validity_trusted")
    )


def coverage(measures: DataFrame) -> DataFrame:
    """Distance coverage of each segment against the longest distance of its session."""
    w = Window.partitionBy("session_id")
    m = measures.withColumn("lap_length_m", F.coalesce(F.max("max_distance_m").over(w), F.lit(0.0)))
    length = F.col("lap_length_m")
    failure = (
        F.when(length <= 0, F.lit(None))
        .when(F.col("max_distance_m").isNull(), F.lit("no distance samples"))
        .when(
            F.col("max_distance_m") < length * 0.80,
            F.format_string("lap ends at %.0f m", "max_distance_m"),
        )
        .when(
            F.col("min_distance_m") > length * 0.10,
            F.format_string("lap starts at %.0f m", "min_distance_m"),
        )
    )
    return m.withColumn("coverage_failure", failure)


def sector_times(seg_frames: DataFrame, durs: DataFrame) -> DataFrame:
    """Sector times of a lap, read from the first settled pair in the next segment's first rows."""
    w = Window.partitionBy(*LAP).orderBy("frame_id")
    pair = F.struct(
        F.col("last_sector_1_s").cast("double").alias("s1"), F.col("last_sector_2_s").cast("double").alias("cum")
    )
    settled = (F.col("last_sector_1_s") > 0) & (F.col("last_sector_2_s") > F.col("last_sector_1_s"))
    # The rank filter runs as a per-task top-k before the shuffle, so a long lap does not travel whole.
    head = (
        seg_frames.select(*LAP, "frame_id", "last_sector_1_s", "last_sector_2_s")
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= SETTLE_FRAMES)
        .filter(settled)
        .groupBy(*LAP)
        .agg(F.min_by(pair, "frame_id").alias("p"))
        .select("session_id", (F.col("segment_index") - 1).cast("int").alias("segment_index"), "p")
    )
    return durs.join(head, LAP, "left").select(
        *LAP,
        "lap_number",
        "frames",
        "duration_s",
        F.col("p.s1").alias("sector_1_s"),
        (F.col("p.cum") - F.col("p.s1")).alias("sector_2_s"),
        (F.col("duration_s") - F.col("p.cum")).alias("sector_3_s"),
        F.col("p.cum").alias("sector_2_cum_s"),
        "all_valid",
        F.col("duration_s").isNotNull().alias("has_duration"),
    )
