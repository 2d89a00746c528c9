"""Bridge from the supplied ``events``/``nation`` tables to telemetry frames and track corners.

One recording per event type, one lap per calendar day, a day scaled to 100 s and 4000 m.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAP_LENGTH_M = 4000.0
TRACK_ID = "nation-ring"

_DAY_US = 86_400_000_000


def frames_from_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frame table: one row per sample, ordered by ``frame_id`` inside ``session_id``."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast(ts AS TIMESTAMP_NTZ))")
    day = F.dayofmonth("ts")
    of_day = F.col("us") % _DAY_US
    k = F.regexp_extract("props", "[0-9]+", 0).cast("int")
    e = e.select(
        "*", us.alias("us"), day.alias("day"), k.alias("k"), (day + F.length("event_type")).alias("j")
    )
    lap_time = of_day / 864e6
    # Some days cover only part of the track, so that their laps are incomplete.
    dist = lap_time * 4e1 * F.when(F.col("j") % 11 == 0, 7e-1).otherwise(1e0)
    stop = (F.col("j") % 5 == 0) & of_day.between(43_200_000_000, 45_792_000_000)
    speed = F.when(stop, F.lit(0e0)).otherwise(8e1 + F.least(F.col("value"), F.lit(2e2)))
    steer = ((F.col("event_id") % 201) - 100) / 1e2
    angle = 2 * F.pi() * dist / 4e3
    unsettled = F.col("event_id") % 3 == 0
    return e.select(
        F.col("event_type").alias("session_id"),
        F.col("event_id").alias("frame_id"),
        (F.col("us") / 864e6).alias("session_time_s"),
        F.when(F.col("day") <= 15, F.col("day") - 1).otherwise(F.col("day") - 16).cast("int").alias("lap_number"),
        lap_time.alias("lap_time_s"),
        dist.alias("lap_distance_m"),
        dist.alias("raw_lap_distance_m"),
        speed.alias("speed_kph"),
        (F.col("k") / 1e2).alias("throttle_norm"),
        (F.greatest(F.lit(0), 40 - F.col("k")) / 4e1).alias("brake_norm"),
        (F.col("k") % 8).alias("gear"),
        (F.col("k") * 1e2).alias("engine_rpm"),
        steer.alias("steering_norm"),
        (1e2 - (F.col("day") - 1) * 3e0 - of_day / 864e8 * 3e0).alias("fuel_l"),
        F.lit(1.1e2).alias("fuel_capacity_l"),
        (((F.col("event_id") * 7) % 101 - 50) / 1e1).alias("path_lateral_m"),
        (6e0 + F.col("event_id") % 5).alias("track_edge_m"),
        F.round(5e2 * F.cos(angle), 6).alias("pos_x_m"),
        F.round(5e2 * F.sin(angle), 6).alias("pos_z_m"),
        (F.col("j") % 7 != 0).alias("lap_valid"),
        F.when(unsettled, F.lit(None)).otherwise(3e1 + F.col("day") % 5).cast("double").alias("last_sector_1_s"),
        F.when(unsettled, F.lit(None)).otherwise(6.5e1 + F.col("day") % 7).cast("double").alias("last_sector_2_s"),
        F.when(F.col("j") % 2 == 0, 9.97e1 + (F.col("day") % 4) * 1e-1).alias("scoring_last_lap_time_s"),
        (steer * 3e0).alias("wheel_ground_vel_lat_rl"),
        (steer * 3e0 + 5e-1).alias("wheel_ground_vel_lat_rr"),
        (speed / 3.6e0).alias("wheel_ground_vel_lon_rl"),
        (speed / 3.6e0 + 1e-1).alias("wheel_ground_vel_lon_rr"),
        F.degrees(F.atan2(steer * 3e0, speed / 3.6e0)).alias("slip_angle_rl_deg"),
        F.degrees(F.atan2(steer * 2e0, speed / 3.6e0 + 1e-1)).alias("slip_angle_rr_deg"),
        F.lit(0e0).alias("grip_fraction_rl"),
        F.when(F.col("k") % 10 != 3, F.col("k") < 10).alias("tc_active"),
        F.lit(False).alias("abs_active"),
        (F.col("event_id") % 4).cast("int").alias("surface_type_fl"),
        F.when(F.col("event_id") % 6 != 0, (F.col("event_id") % 3).cast("int")).alias("surface_type_fr"),
        (F.col("event_id") % 4).cast("int").alias("surface_type_rl"),
        (F.col("event_id") % 2).cast("int").alias("surface_type_rr"),
        ((F.length("event_type") * 3) % 14).cast("int").alias("session_type"),
        F.lit(20).alias("race_laps_total"),
    )


def corners_from_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Track model rows: one corner per nation, 155 m apart, in lap order."""
    n = spark.read.parquet(f"{sf_dir}/nation.parquet")
    start = 2e1 + F.col("n_nationkey") * 1.55e2
    return n.select(
        F.lit(TRACK_ID).alias("track_id"),
        F.col("n_nationkey").cast("int").alias("corner_pos"),
        F.col("n_nationkey").cast("int").alias("corner_id"),
        F.col("n_name").alias("corner_name"),
        start.alias("s_start_m"),
        (start + 6e1).alias("apex_s_m"),
        (start + 1.1e2).alias("s_end_m"),
        F.when(F.col("n_nationkey") % 2 == 0, "left").otherwise("right").alias("apex_side"),
        F.when(F.col("n_nationkey") % 3 == 0, F.lit(6e1)).alias("target_throttle_pct"),
        F.lit(LAP_LENGTH_M).alias("lap_length_m"),
    )
