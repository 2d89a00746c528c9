"""Dimension resolution (cars, reference laps, track models) and position lookups on the corner model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ordered import CHUNK_ROWS, scan
from ..functions.scalars import track_slug, vehicle_slug

MIN_STRAIGHT_AHEAD_M = 50.0
BUCKET_M = 100.0


def canonical_cars(vehicles: DataFrame) -> DataFrame:
    """Both ways to reach the canonical car: (vehicle_name, car_slug, canonical)."""
    return vehicles.filter(~F.col("vehicle_name").startswith("_") & (F.coalesce("canonical", F.lit("")) != "")).select(
        "vehicle_name", vehicle_slug(F.col("vehicle_name")).alias("car_slug"), "canonical"
    )


def with_canonical(sessions: DataFrame, cars: DataFrame) -> DataFrame:
    """Add the canonical car of each session's vehicle, and the vehicle's own slug."""
    by_name = cars.groupBy("vehicle_name").agg(F.min("canonical").alias("canonical"))
    return sessions.join(by_name, "vehicle_name", "left").withColumn("vehicle_slug", vehicle_slug(F.col("vehicle_name")))


def _best_by_priority(sessions: DataFrame, candidates: DataFrame, order: list[str]) -> DataFrame:
    """Best candidate per session: same car, then same canonical car, then car-agnostic.

    Each level first keeps its best candidate per join key, so no session ever meets all candidates of a track.
    ``candidates``: track_slug, car_id (empty when agnostic), canonical, name and the ``order`` columns.
    """
    pick = F.min(F.struct(*order, "name"))

    def level(keys: list[str], source: DataFrame, out: str) -> DataFrame:
        return source.groupBy("track_slug", *keys).agg(pick.alias(out))

    exact = level(["car_id"], candidates.filter("car_id <> ''"), "p0").withColumnRenamed("car_id", "vehicle_slug")
    same = level(["canonical"], candidates.filter("car_id <> '' AND canonical IS NOT NULL"), "p1")
    generic = level([], candidates.filter("car_id = ''"), "p2")
    any_car = level([], candidates, "p_any")
    j = (
        sessions.withColumn("track_slug", track_slug(F.col("track_name")))
        .join(exact, ["track_slug", "vehicle_slug"], "left")
        .join(same, ["track_slug", "canonical"], "left")
        .join(generic, "track_slug", "left")
        .join(any_car, "track_slug", "left")
    )
    no_vehicle = F.coalesce(F.col("vehicle_name"), F.lit("")) == ""
    found = F.when(no_vehicle, F.col("p_any")).otherwise(F.coalesce("p0", "p1", "p2"))
    priority = (
        F.when(no_vehicle, F.lit(None)).when(F.col("p0").isNotNull(), 0).when(F.col("p1").isNotNull(), 1)
        .when(F.col("p2").isNotNull(), 2)
    )
    return j.withColumn("match", found).withColumn("priority", priority.cast("int")).drop("p0", "p1", "p2", "p_any")


def _with_candidate_car(candidates: DataFrame, cars: DataFrame) -> DataFrame:
    by_slug = cars.groupBy(F.col("car_slug").alias("car_id")).agg(F.min("canonical").alias("canonical"))
    return candidates.join(by_slug, "car_id", "left")


def resolve_reference(sessions: DataFrame, references: DataFrame, cars: DataFrame) -> DataFrame:
    """Reference lap of each session: exact track, best car priority, then the fastest by full time."""
    m = _best_by_priority(with_canonical(sessions, cars), _with_candidate_car(references, cars), ["reference_s"])
    return m.withColumn("reference_name", F.col("match.name")).withColumn("reference_s", F.col("match.reference_s")).drop("match")


def resolve_track_model(sessions: DataFrame, models: DataFrame, cars: DataFrame) -> DataFrame:
    """Track model of each session: exact track, best car priority, then the first by name."""
    m = _best_by_priority(with_canonical(sessions, cars), _with_candidate_car(models, cars), [])
    return m.withColumn("model_name", F.col("match.name")).drop("match")


def debrief_inputs(sessions: DataFrame, references: DataFrame, models: DataFrame, cars: DataFrame) -> DataFrame:
    """Inputs of a session's debrief, or the reason they are missing.

    ``references`` may carry ``authoritative_s`` (recorded) and ``derived_s`` (from its frames); the recorded
    time wins, then the time in the name, then the derived one.
    """
    ref = resolve_reference(sessions, references, cars)
    times = references.select(F.col("name").alias("reference_name"), "authoritative_s", "derived_s")
    model = resolve_track_model(sessions, models, cars).select("session_id", "model_name")
    j = ref.join(times, "reference_name", "left").join(model, "session_id", "left")
    positive = lambda c: F.when(F.col(c) > 0, F.col(c))
    j = j.withColumn("reference_s", F.coalesce(positive("authoritative_s"), positive("reference_s"), positive("derived_s")))
    status = (
        F.when(F.coalesce("track_name", F.lit("")) == "", "no track name")
        .when(F.col("reference_name").isNull(), "no reference lap")
        .when(F.col("model_name").isNull(), "no coaching model")
        .when(F.col("reference_s").isNull(), "reference has no usable duration")
        .otherwise("ok")
    )
    return j.withColumn("status", status)


def corner_buckets(corners: DataFrame, straights: DataFrame | None = None) -> DataFrame:
    """Corner model by 100 m bucket: (track_id, bucket, zones, starts, next_start_m, straights).

    ``zones`` are the corner pieces touching the bucket in model order (a corner that wraps over the finish
    line gives two), ``starts`` the corner starts inside it and ``next_start_m`` the first start after it.
    A few entries per bucket, so positions look up their corner with one equi join and no fan-out.
    """
    cut = lambda c: F.floor(c / BUCKET_M).cast("long")
    wraps = F.col("s_start_m") > F.col("s_end_m")
    far = F.greatest(F.col("lap_length_m"), F.col("s_start_m")) + BUCKET_M
    spans = F.when(
        wraps,
        F.array(F.struct(F.col("s_start_m").alias("lo"), far.alias("hi")), F.struct(F.lit(0.0).alias("lo"), F.col("s_end_m").alias("hi"))),
    ).otherwise(F.array(F.struct(F.col("s_start_m").alias("lo"), F.col("s_end_m").alias("hi"))))
    pieces = corners.withColumn("span", F.explode(spans)).withColumn("bucket", F.explode(F.sequence(cut(F.col("span.lo")), cut(F.col("span.hi")))))
    zones = pieces.groupBy("track_id", "bucket").agg(
        F.array_sort(F.collect_list(F.struct("corner_pos", "corner_id", "span.lo", "span.hi"))).alias("zones")
    )
    lengths = corners.groupBy("track_id").agg(F.max("lap_length_m").alias("lap_length_m"))
    spine = lengths.select("track_id", F.explode(F.sequence(F.lit(0).cast("long"), cut(F.col("lap_length_m")) + 1)).alias("bucket"))
    starts = corners.groupBy("track_id", cut(F.col("s_start_m")).alias("bucket")).agg(
        F.array_sort(F.collect_set("s_start_m")).alias("starts"), F.min("s_start_m").alias("first_start")
    )
    after = Window.partitionBy("track_id").orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    table = (
        spine.join(zones, ["track_id", "bucket"], "left").join(starts, ["track_id", "bucket"], "left")
        .withColumn("next_start_m", F.last("first_start", True).over(after))
    )
    if straights is None:
        return table.withColumn("straights", F.lit(None).cast("array<struct<lo:double,hi:double>>")).withColumn("has_straights", F.lit(False))
    s = straights.withColumn("bucket", F.explode(F.sequence(cut(F.col("s_start_m")), cut(F.col("s_end_m")))))
    s = s.groupBy("track_id", "bucket").agg(
        F.collect_list(F.struct(F.col("s_start_m").alias("lo"), F.col("s_end_m").alias("hi"))).alias("straights")
    )
    have = straights.select("track_id").distinct().withColumn("has_straights", F.lit(True))
    return table.join(s, ["track_id", "bucket"], "left").join(have, "track_id", "left").withColumn(
        "has_straights", F.coalesce("has_straights", F.lit(False)))


def corner_at(frames: DataFrame, buckets: DataFrame, x: str = "lap_distance_m") -> DataFrame:
    """Frames with the first corner that holds them, the distance to the next corner start, and speech safety."""
    d = F.col(x)
    f = frames.withColumn("bucket", F.floor(d / BUCKET_M).cast("long")).join(buckets, ["track_id", "bucket"], "left")
    inside = F.get(F.filter("zones", lambda z: (d >= z["lo"]) & (d <= z["hi"])), F.lit(0))
    ahead = F.coalesce(F.get(F.filter("starts", lambda s: s > d), F.lit(0)), F.col("next_start_m")) - d
    f = f.withColumn("corner_id", inside["corner_id"]).withColumn("next_corner_m", ahead)
    on_straight = F.coalesce(F.exists("straights", lambda s: (d >= s["lo"]) & (d <= s["hi"])), F.lit(False))
    clear = F.coalesce(F.col("next_corner_m") >= MIN_STRAIGHT_AHEAD_M, F.lit(True))
    safe = F.col("corner_id").isNull() & clear & (~F.coalesce("has_straights", F.lit(False)) | on_straight)
    return f.withColumn("safe", safe).drop("bucket", "zones", "starts", "next_start_m", "straights", "has_straights")


def hold_until_safe(frames: DataFrame, trigger: Column, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Each trigger row with the first later frame that is safe; ``frames`` come from :func:`corner_at`."""
    f = scan(
        frames, ["session_id"], "frame_id", fill_back={"spoken_frame_id": F.when(F.col("safe"), F.col("frame_id"))},
        chunk_rows=chunk_rows,
    )
    return f.filter(trigger)
