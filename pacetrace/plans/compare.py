"""Lap comparison: every driver lap against the reference lap of its track."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import grid as gr
from ..operators import phases as ph
from ..operators.segments import LAP

REF = ["ref_session_id", "ref_segment_index"]


def fastest_eligible(laps: DataFrame, by: list[str]) -> DataFrame:
    """Reference lap per ``by`` (e.g. track): the fastest eligible lap."""
    best = F.min(
        F.struct("duration_s", "session_id", "segment_index", "max_distance_m")
    ).alias("r")
    return laps.filter("status = 'eligible'").groupBy(*by).agg(best).select(
        *by,
        F.col("r.session_id").alias("ref_session_id"),
        F.col("r.segment_index").alias("ref_segment_index"),
        F.col("r.duration_s").alias("ref_duration_s"),
        F.col("r.max_distance_m").alias("ref_max_m"),
    )


def pair_laps(laps: DataFrame, references: DataFrame, by: list[str]) -> DataFrame:
    """Laps with their reference; ``grid_end_m`` is the last metre both grids must reach."""
    p = laps.join(references, by)
    own = F.ceil("max_distance_m")
    is_ref = (F.col("session_id") == F.col("ref_session_id")) & (F.col("segment_index") == F.col("ref_segment_index"))
    longest = p.groupBy(*REF).agg(F.max(own).alias("longest"))
    return p.join(longest, REF).withColumn(
        "grid_end_m", F.greatest(own, F.when(is_ref, F.col("longest")).otherwise(F.ceil("ref_max_m"))).cast("int")
    ).withColumn("is_reference", is_ref).drop("longest")


def lap_grids(
    seg_frames: DataFrame, pairs: DataFrame, lap_length_m: float, channels=gr.GRID_CHANNELS
) -> DataFrame:
    """Metre grids of all paired laps, on ranges long enough for the pair."""
    f = seg_frames.join(pairs.select(*LAP, "grid_end_m"), LAP)
    f = gr.strip_boundary(gr.strip_stale(f, F.lit(lap_length_m)), F.lit(lap_length_m))
    return gr.lap_grid(f, channels, limit="grid_end_m")


def paired_grid(
    seg_frames: DataFrame, pairs: DataFrame, lap_length_m: float, channels=gr.GRID_CHANNELS, prepare=lambda g: g
) -> DataFrame:
    """Driver and reference channels side by side per metre, with the raw time difference.

    The reference side is gridded from the reference laps' frames alone and written (a few thousand rows per
    track), so Spark knows its size, broadcasts it when small, and the driver grid keeps its partitioning.  ``prepare`` adds per-lap columns.
    """
    driver = prepare(lap_grids(seg_frames, pairs, lap_length_m, channels)).join(
        pairs.select(*LAP, *REF, "track_id"), LAP
    )
    refs = materialise(prepare(lap_grids(seg_frames, pairs.filter("is_reference"), lap_length_m, channels)))
    names = [c for c in refs.columns if c not in LAP]
    refs = refs.select(F.col("session_id").alias(REF[0]), F.col("segment_index").alias(REF[1]), *names)
    return gr.delta_trace(driver, refs, REF)


def align_laps(
    seg_frames: DataFrame, pairs: DataFrame, lap_length_m: float, prepare=lambda g: g
) -> DataFrame:
    """The six alignment steps for all laps at once: strip, smooth, resample, clamp, difference, boxcar."""
    return gr.boxcar(paired_grid(seg_frames, pairs, lap_length_m, prepare=prepare), "delta_ms")


def compare_events(seg_frames: DataFrame, pairs: DataFrame, corners: DataFrame, lap_length_m: float) -> DataFrame:
    """Phase points of every paired lap against its track's reference."""
    aligned = align_laps(seg_frames, pairs, lap_length_m, prepare=ph.pedal_events)
    return ph.corner_events(aligned, ph.corner_bounds(corners))


def compare_laps(
    seg_frames: DataFrame,
    laps: DataFrame,
    references: DataFrame,
    corners: DataFrame,
    lap_length_m: float,
    reject_slow: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Guard status of every lap, and the phase facts of those that pass it."""
    pairs = pair_laps(laps, references, ["track_id"])
    stripped = gr.strip_stale(seg_frames, F.lit(lap_length_m))
    guard = materialise(ph.comparison_guard(stripped, pairs, lap_length_m, reject_slow))
    good = pair_laps(guard.filter("guard = 'ok'").select(*laps.columns), references, ["track_id"])
    return guard, ph.corner_phase_facts(compare_events(seg_frames, good, corners, lap_length_m))
