"""Session recordings on disk: sharded reads, sidecars, sinks, compaction and file-name dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The recording schema (float channels are widened to double on read).
FRAME_SCHEMA = T.StructType(
    [T.StructField("session_time_s", T.DoubleType()), T.StructField("lap_number", T.IntegerType())]
    + [T.StructField(n, T.FloatType()) for n in (
        "lap_distance_m", "lap_time_s", "speed_kph", "throttle_norm", "brake_norm", "steering_norm", "engine_rpm")]
    + [T.StructField("gear", T.ByteType()), T.StructField("lap_valid", T.BooleanType())]
    + [T.StructField(n, T.FloatType()) for n in (
        "pos_x_m", "pos_y_m", "pos_z_m", "last_sector_1_s", "last_sector_2_s",
        "slip_angle_fl_deg", "slip_angle_fr_deg", "slip_angle_rl_deg", "slip_angle_rr_deg")]
    + [T.StructField(n, T.BooleanType()) for n in ("abs_active", "tc_active")]
    + [T.StructField(n, T.FloatType()) for n in (
        "raw_lap_distance_m", "path_lateral_m", "track_edge_m", "distance_to_track_edge_m")]
    + [T.StructField(f"surface_type_{w}", T.ByteType()) for w in ("fl", "fr", "rl", "rr")]
    + [T.StructField(f"terrain_name_{w}", T.StringType()) for w in ("fl", "fr", "rl", "rr")]
    + [T.StructField(n, T.FloatType()) for n in ("fuel_l", "fuel_capacity_l", "session_time_remaining_s")]
    + [T.StructField("session_type", T.ByteType()), T.StructField("race_laps_total", T.IntegerType())]
    + [T.StructField(n, T.FloatType()) for n in (
        "scoring_lap_start_et_s", "scoring_last_lap_time_s", "scoring_time_into_lap_s")]
    + [T.StructField("scoring_total_laps", T.IntegerType())]
    + [T.StructField(n, T.FloatType()) for n in (
        "grip_fraction_rl", "grip_fraction_rr", "wheel_ground_vel_lat_rl", "wheel_ground_vel_lon_rl",
        "wheel_ground_vel_lat_rr", "wheel_ground_vel_lon_rr", "yaw_rate_radps")]
)

SIDECAR_SCHEMA = (
    "schema_version string, recorder_version string, started_utc string, ended_utc string, sim string, track string, "
    "vehicle_name string, setup_file_guess string, session_type_label string, sample_rate_hz double, row_count long, "
    "lap_count long, in_progress boolean, recovered boolean"
)

# The patterns of file names.
STEM = r"(session_[^/]+?)(?:\.part\d+)?\.parquet"
PART = r"\.part(\d+)\.parquet"
REFERENCE_TIME = r"_time_(\d+)\.(\d+)\.(\d+)\.parquet$"
TRACK_IN_NAME = r"(?i)_\d{8}T\d{6}Z_(.+)_lmu[._]"


def widen(df: DataFrame) -> DataFrame:
    """Floats to doubles, NaN to NULL."""
    out = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, (T.FloatType, T.DoubleType)):
            d = c.cast("double")
            c = F.when(~F.isnan(d), d).alias(f.name)
        out.append(c)
    return df.select(*out)


def read_sessions(spark: SparkSession, paths: str | Sequence[str], schema: T.StructType | None = FRAME_SCHEMA) -> DataFrame:
    """All shards of all sessions under ``paths`` as frames with ``session_id`` and a dense ``frame_id``.

    Shards follow their numeric part; the row order inside a file is the file's own.  The ordinal is the
    file's offset (a running sum over the small file table) plus the row index, so no session is sorted.
    """
    reader = spark.read.schema(schema) if schema is not None else spark.read
    raw = reader.parquet(*([paths] if isinstance(paths, str) else paths))
    path = F.col("_metadata.file_path")
    f = raw.select(
        "*", path.alias("__file"), F.col("_metadata.row_index").alias("__row"),
        F.regexp_extract(path, STEM, 1).alias("session_id"),
        F.coalesce(F.regexp_extract(path, PART, 1).try_cast("int"), F.lit(0)).alias("__part"),
    )
    files = f.groupBy("session_id", "__part", "__file").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("session_id").orderBy("__part", "__file").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("session_id", "__file", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("__offset"))
    framed = f.join(offsets, ["session_id", "__file"]).withColumn("frame_id", F.col("__offset") + F.col("__row"))
    return widen(framed.select("session_id", "frame_id", *raw.columns))


def channel_presence(frames: DataFrame) -> DataFrame:
    """Per session and channel, whether any sample exists: keeps "absent" apart from "all zero"."""
    names = [c for c in frames.columns if c not in ("session_id", "frame_id")]
    items = F.array(*[F.struct(F.lit(c).alias("channel"), (F.count(c) > 0).alias("present")) for c in names])
    return frames.groupBy("session_id").agg(items.alias("i")).select("session_id", F.explode("i").alias("i")).select("session_id", "i.*")


def select_present(frames: DataFrame, wanted: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Only the wanted columns that exist, and the names that do not; Spark prunes the scan accordingly."""
    have = [c for c in wanted if c in frames.columns]
    return frames.select("session_id", "frame_id", *have), [c for c in wanted if c not in frames.columns]


def read_sidecars(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Sidecar documents keyed by session stem; an unreadable one gives NULL fields, not a failure."""
    docs = spark.read.schema(SIDECAR_SCHEMA).option("multiLine", True).option("mode", "PERMISSIVE").json(paths)
    return docs.select(F.regexp_extract("_metadata.file_path", r"(session_[^/]+?)\.json", 1).alias("session_id"), "*")


def corpus_overview(frames: DataFrame, sidecars: DataFrame) -> DataFrame:
    """One row per session: rows, laps, duration and flags, oldest first."""
    g = frames.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("lap_number").alias("laps"))
    rate = F.when(F.col("sample_rate_hz") > 0, F.col("sample_rate_hz")).otherwise(F.lit(50.0))
    known = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)).otherwise(F.lit("?"))
    flags = F.concat_ws(
        ",", F.when(F.col("in_progress"), "in_progress"), F.when(F.col("recovered"), "recovered"))
    return (
        g.join(sidecars, "session_id", "left")
        .select(
            "session_id", known("started_utc").alias("started_utc"), known("sim").alias("sim"), known("track").alias("track"),
            known("vehicle_name").alias("vehicle"), "rows", "laps", (F.col("rows") / rate).alias("duration_s"),
            F.when(flags == "", F.lit("-")).otherwise(flags).alias("flags"),
        )
        .orderBy("started_utc", "session_id")
    )


def reference_time(name: Column) -> Column:
    """Lap time in seconds from a reference file name, NULL for other names."""
    part = lambda i: F.regexp_extract(name, REFERENCE_TIME, i)
    seconds = part(1).try_cast("int") * 60 + part(2).try_cast("int") + part(3).try_cast("int") / 1000
    return F.when(part(1) != "", seconds)


def track_name_from_file(name: Column) -> Column:
    """Readable track name from a session file name; only the first letter of each word changes."""
    slug = F.regexp_extract(name, TRACK_IN_NAME, 1)
    words = F.transform(F.split(slug, "-"), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2))))
    return F.when(slug != "", F.array_join(words, " "))


def write_session_tables(frames: DataFrame, info: DataFrame, path: str) -> None:
    """Frames as Snappy Parquet by session, and one metadata row per session with final counts."""
    data = frames.repartition("session_id", F.floor(F.col("frame_id") / 1_000_000)).sortWithinPartitions("session_id", "frame_id")
    data.write.mode("overwrite").partitionBy("session_id").option("compression", "snappy").parquet(f"{path}/frames")
    counts = frames.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("row_count"), F.count_distinct("lap_number").alias("lap_count"))
    info.join(counts, "session_id").withColumn("in_progress", F.lit(False)).write.mode("overwrite").json(f"{path}/sessions")


def compact_shards(spark: SparkSession, paths: Sequence[str], sidecars: DataFrame, out: str, schema=FRAME_SCHEMA) -> DataFrame:
    """Merge leftover shards per session in part order and settle their metadata.

    A sidecar left in progress is stamped recovered; a missing one is rebuilt from the name; a finished one
    stays as it is.  Returns the metadata rows.
    """
    frames = read_sessions(spark, paths, schema)
    frames.repartition("session_id", F.floor(F.col("frame_id") / 1_000_000)).sortWithinPartitions("session_id", "frame_id").write.mode(
        "overwrite").partitionBy("session_id").parquet(out)
    counts = frames.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct("lap_number").alias("laps"))
    j = counts.join(sidecars.withColumn("has_sidecar", F.lit(True)), "session_id", "left")
    bits = F.split("session_id", "_", 5)
    started = F.get(bits, F.lit(1))
    iso = F.date_format(F.try_to_timestamp(started, F.lit("yyyyMMdd'T'HHmmss'Z'")), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    missing, open_ = F.col("has_sidecar").isNull(), F.coalesce("in_progress", F.lit(False))
    pick = lambda rebuilt, kept: F.when(missing, rebuilt).otherwise(kept)
    settled = missing | open_
    return j.select(
        "session_id",
        pick(F.coalesce(iso, started, F.lit("unknown")), F.col("started_utc")).alias("started_utc"),
        pick(F.lit("unknown"), F.when(open_, F.coalesce("ended_utc", F.lit("unknown"))).otherwise(F.col("ended_utc"))).alias("ended_utc"),
        pick(F.coalesce(F.get(bits, F.lit(3)), F.lit("unknown")), F.col("sim")).alias("sim"),
        pick(F.coalesce(F.get(bits, F.lit(2)), F.lit("unknown")), F.col("track")).alias("track"),
        pick(F.lit(50.0), F.col("sample_rate_hz")).alias("sample_rate_hz"),
        F.when(settled, F.col("rows")).otherwise(F.col("row_count")).alias("row_count"),
        F.when(settled, F.col("laps")).otherwise(F.col("lap_count")).alias("lap_count"),
        F.when(settled, F.lit(False)).otherwise(F.col("in_progress")).alias("in_progress"),
        F.when(settled, F.lit(True)).otherwise(F.col("recovered")).alias("recovered"),
    )


def lap_snapshot(frames: DataFrame, session_id: str, lap_number: int) -> DataFrame:
    """One lap over all shards written so far; both filters reach the scan."""
    return frames.filter((F.col("session_id") == session_id) & (F.col("lap_number") == lap_number))
