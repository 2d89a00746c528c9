"""Whole-session debrief for all sessions in one set of plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.storage import materialise
from ..operators import corner_channels as cc
from ..operators import session_stats as st
from ..operators.segments import LAP
from . import compare as cp


@dataclass
class Debrief:
    """Tables of the debrief; the small fact tables are written, the rest are plans over them."""

    inventory: DataFrame
    guard: DataFrame
    laps: DataFrame
    phases: DataFrame
    clean_phases: DataFrame
    windows: DataFrame
    channels: DataFrame
    reference_channels: DataFrame
    representative: DataFrame
    rear: DataFrame
    pace: DataFrame
    priorities: DataFrame


def lap_phases(facts: DataFrame) -> DataFrame:
    """Facts with a loss or a gain (to a nanosecond)."""
    return facts.withColumn("loss_s", F.round("loss_s", 9)).filter("loss_s <> 0")


def reference_corner_channels(seg_frames: DataFrame, pairs: DataFrame, corners: DataFrame, phases: DataFrame) -> DataFrame:
    """Channel facts of the reference lap, in windows read off each session's comparisons.

    The reference lap is listed once per session that uses it, under ``segment_index`` −1.
    """
    users = pairs.select("session_id", "track_id", *cp.REF).distinct()
    windows = cc.reference_windows(users, corners, phases.join(users.select("session_id", *cp.REF), "session_id"))
    windows = windows.withColumn("segment_index", F.lit(-1))
    source = seg_frames.withColumnRenamed("session_id", cp.REF[0]).withColumnRenamed("segment_index", cp.REF[1])
    frames = source.join(users.drop("track_id"), cp.REF).withColumn("segment_index", F.lit(-1))
    return cc.corner_channels(frames.select(*seg_frames.columns), windows)


def debrief(
    seg_frames: DataFrame, inventory: DataFrame, corners: DataFrame, lap_length_m: float, min_points: int = 100
) -> Debrief:
    """Every table of the debrief.  ``inventory``: classified laps with ``track_id``, written."""
    refs = cp.fastest_eligible(inventory, ["track_id"])
    eligible = inventory.filter("status = 'eligible'")
    guard, facts = cp.compare_laps(seg_frames, eligible, refs, corners, lap_length_m)
    good = cp.pair_laps(guard.filter("guard = 'ok'").select(*inventory.columns), refs, ["track_id"])
    laps = materialise(good.select(
        *LAP, "track_id", "lap_number", "clean", *cp.REF, F.col("duration_s").alias("lap_time_s"),
        (F.col("duration_s") - F.col("ref_duration_s")).alias("delta_s")))
    phases = materialise(lap_phases(facts).join(laps.select(*LAP, "clean"), LAP))
    clean_phases = phases.filter("clean")
    windows = materialise(cc.driver_windows(laps, corners, phases))
    refused = cc.unmeasurable_channels(seg_frames)
    channels = materialise(cc.corner_channels(seg_frames, windows, refused, laps))
    reference = materialise(reference_corner_channels(seg_frames, laps, corners, phases))
    clean_laps = laps.filter("clean").select(*LAP)
    representative = cc.representative_corners(channels.join(clean_laps, LAP, "left_semi"))
    slips = cc.corner_rear_slip(seg_frames, windows).join(laps.select(*LAP, "lap_number", "clean"), LAP)
    rear = materialise(cc.rear_stability(slips, cc.dead_channels(seg_frames)))
    # The envelope uses every clean lap of the inventory, analysed or not.
    clean = inventory.filter("clean").select(*LAP)
    envelope = st.speed_envelope(seg_frames.join(clean, LAP, "left_semi"), lap_length_m, min_points)
    pace = materialise(st.lap_pace(laps, envelope))
    ranked = materialise(st.priorities(clean_phases, pace.select("session_id", "mean_gap_s")))
    return Debrief(
        inventory, guard, laps, phases, clean_phases, windows, channels, reference, representative, rear, pace, ranked)
