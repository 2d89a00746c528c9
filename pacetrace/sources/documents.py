"""JSON and CSV documents: track models, vehicle catalogues, apex annotations, delta-best files, fact payloads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TRACK_MODEL_SCHEMA = """schema_version string, track_id string, layout_id string, lap_length_m double,
corners array<struct<id: string, name: string, short_name: string, s_start_m: double, apex_s_m: double, s_end_m: double,
  apex_side: string, target_throttle_pct: double>>,
straight_zones array<struct<id: string, s_start_m: double, s_end_m: double>>"""
VEHICLE_SCHEMA = "map<string,struct<brand:string,model:string,car_class:string,slug:string>>"
MIN_DELTA_ROWS = 10


def read_track_models(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Track model documents with their file name."""
    return spark.read.schema(TRACK_MODEL_SCHEMA).option("multiLine", True).json(paths).withColumn(
        "file_name", F.col("_metadata.file_name"))


def model_corners(models: DataFrame) -> DataFrame:
    """Corners of the documents, one row each; a blank short name counts as none."""
    c = models.select("track_id", "layout_id", "lap_length_m", F.posexplode("corners").alias("corner_pos", "c"))
    short = F.trim("c.short_name")
    return c.select(
        "track_id", "layout_id", "lap_length_m", "corner_pos", F.col("c.id").alias("corner_id"), F.col("c.name").alias("name"),
        F.when(short != "", short).alias("short_name"), F.coalesce(F.when(short != "", short), F.col("c.name")).alias("corner_name"),
        "c.s_start_m", "c.apex_s_m", "c.s_end_m", "c.apex_side", "c.target_throttle_pct",
    )


def model_straights(models: DataFrame) -> DataFrame:
    """Straight zones of the documents, one row each; a zone that doesn't start before its end is left to the violations."""
    z = models.select("track_id", "layout_id", F.explode("straight_zones").alias("z"))
    return z.select("track_id", "layout_id", F.col("z.id").alias("straight_id"), "z.s_start_m", "z.s_end_m").filter("s_start_m < s_end_m")


def model_violations(models: DataFrame) -> DataFrame:
    """Rules a track model breaks: (file_name, item, rule).  An end before its start is a wrap corner, not an error."""
    head = F.array_compact(F.array(
        F.when(~F.col("schema_version").eqNullSafe("1"), "unsupported schema_version"),
        *[F.when(F.col(c).isNull(), f"missing {c}") for c in ("track_id", "layout_id", "lap_length_m", "corners")],
        F.when(F.col("lap_length_m") <= 0, "lap_length_m must be positive"),
    ))

    def corner_rules(c: Column) -> Column:
        thr = c["target_throttle_pct"]
        return F.array_compact(F.array(
            *[F.when(c[n].isNull(), f"missing {n}") for n in ("id", "name", "s_start_m", "apex_s_m", "s_end_m", "apex_side")],
            F.when(~c["apex_side"].isin("left", "right"), "apex_side must be left or right"),
            F.when(c["s_end_m"] <= 0, "s_end_m must be positive"),
            F.when((thr < 0) | (thr > 100), "target_throttle_pct must be 0-100"),
        ))

    def zone_rules(z: Column) -> Column:
        return F.array_compact(F.array(
            *[F.when(z[n].isNull(), f"missing {n}") for n in ("id", "s_start_m", "s_end_m")],
            F.when(z["s_start_m"] >= z["s_end_m"], "s_start_m must be < s_end_m"),
        ))

    def tagged(name: str, rules: Column) -> Column:
        return F.transform(rules, lambda r: F.struct(F.lit(name).alias("item"), r.alias("rule")))

    corners = F.flatten(F.transform(F.coalesce("corners", F.array()), lambda c, i: F.transform(
        corner_rules(c), lambda r: F.struct(F.concat(F.lit("corner "), i.cast("string")).alias("item"), r.alias("rule")))))
    zones = F.flatten(F.transform(F.coalesce("straight_zones", F.array()), lambda z, i: F.transform(
        zone_rules(z), lambda r: F.struct(F.concat(F.lit("straight "), i.cast("string")).alias("item"), r.alias("rule")))))
    return models.select("file_name", F.explode(F.concat(tagged("model", head), corners, zones)).alias("v")).select("file_name", "v.*")


def read_vehicle_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue entries (vehicle_name, brand, model, car_class, canonical); keys starting ``_`` are notes."""
    text = spark.read.option("wholetext", True).text(path)
    entries = text.select(F.explode(F.from_json("value", VEHICLE_SCHEMA)).alias("vehicle_name", "e"))
    return entries.filter(~F.col("vehicle_name").startswith("_")).select(
        "vehicle_name", "e.brand", "e.model", "e.car_class", F.col("e.slug").alias("canonical"))


def read_delta_best(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """Delta-best files as samples with a derived, smoothed speed; files with under ten valid rows give none.

    A file is one lap of a few thousand short lines and is read whole, so that its lines keep their order.
    """
    files = spark.read.option("wholetext", True).text(paths).select(F.col("_metadata.file_path").alias("file_path"), "value")
    t = files.select("file_path", F.posexplode(F.split("value", "\\r?\\n")).alias("line", "v")).withColumn("v", F.trim("v"))
    cols = F.split("v", ",")
    rows = t.filter((F.col("v") != "") & ~F.col("v").startswith("#")).select(
        "file_path", "line", F.get(cols, F.lit(0)).try_cast("double").alias("distance_m"), F.get(cols, F.lit(1)).try_cast("double").alias("lap_time_s"))
    return delta_best_speed(rows.filter("distance_m IS NOT NULL AND lap_time_s IS NOT NULL"), ["file_path"], "line")


def delta_best_speed(rows: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Speed from consecutive samples, then a three-tap mean with repeated edges."""
    w = Window.partitionBy(*keys).orderBy(order)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    dt = F.greatest(F.col("lap_time_s") - F.lag("lap_time_s").over(w), F.lit(1e-3))
    raw = (F.col("distance_m") - F.lag("distance_m").over(w)) / dt * 3.6
    r = rows.withColumn("n", n).filter(F.col("n") >= MIN_DELTA_ROWS).withColumn("raw", raw)
    r = r.withColumn("raw", F.coalesce("raw", F.lead("raw").over(w)))
    mean = (F.coalesce(F.lag("raw").over(w), F.col("raw")) + F.col("raw") + F.coalesce(F.lead("raw").over(w), F.col("raw"))) / 3
    return r.withColumn("speed_kph", mean).drop("raw", "n")


def annotation_errors(corners: DataFrame) -> DataFrame:
    """Errors of apex annotation corners per row: (corner_pos, errors)."""
    uses = F.count(F.lit(1)).over(Window.partitionBy("track_id", "corner_id"))
    first = F.row_number().over(Window.partitionBy("track_id", "corner_id").orderBy("corner_pos"))
    empty = lambda c: F.coalesce(F.trim(F.col(c)), F.lit("")) == ""
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    errors = F.array_compact(F.array(
        F.when(empty("corner_id"), "id is required"),
        F.when(empty("corner_name"), "name is required"),
        *[F.when(bad(c), f"{c} must be a number") for c in ("s_start_m", "apex_s_m", "s_end_m")],
        F.when(~empty("corner_id") & (uses > 1) & (first > 1), F.concat(F.lit("duplicate corner id: "), F.col("corner_id"))),
        F.when(~F.coalesce(F.col("apex_side").isin("left", "right"), F.lit(False)), 'apex_side must be "left" or "right"'),
        F.when(F.col("s_start_m") >= F.col("apex_s_m"), "s_start_m must be less than apex_s_m"),
        F.when(F.col("apex_s_m") >= F.col("s_end_m"), "apex_s_m must be less than s_end_m"),
    ))
    return corners.withColumn("errors", errors)


def phase_payload() -> Column:
    """One corner-phase fact as a struct rounded for output; absent optional values vanish in the JSON."""
    r = lambda c, d: F.round(c, d).alias(c)
    return F.struct(
        "corner_id", "corner_name", F.col("apex_s_m").alias("apex_distance_m"), "phase", r("loss_s", 3), r("driver_value", 1),
        r("reference_value", 1), "unit", "confidence",
        *[r(c, 1) for c in (
            "phase_distance_m", "driver_apex_distance_m", "reference_apex_distance_m", "apex_offset_m", "gain_end_distance_m",
            "entry_distance_delta_m", "exit_distance_delta_m", "reference_phase_distance_m")],
        "target_throttle_pct",
    )


def lap_payload(facts: DataFrame, n: int = 3) -> DataFrame:
    """JSON summary per lap with its largest losses and gains.

    ``facts`` are ranked (kind, rank); at most ``n`` per kind are collected for a lap.
    """
    from ..operators.segments import LAP

    def top(kind: str) -> Column:
        item = F.struct("rank", phase_payload().alias("f"))
        listed = F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("rank") <= n), item)))
        return F.transform(listed, lambda x: x["f"]).alias(f"top_{'losses' if kind == 'loss' else 'gains'}")

    doc = facts.groupBy(*LAP, "track_id").agg(top("loss"), top("gain"))
    return doc.withColumn(
        "payload",
        F.to_json(F.struct(F.lit("lap_coaching_summary").alias("type"), "track_id", "top_losses", "top_gains"), {"ignoreNullFields": "true"}),
    )


def write_documents(rows: DataFrame, heads: DataFrame, by: str, order: Sequence[str], path: str, items: str = "samples") -> None:
    """One JSON document per value of ``by``: the fields of its row in ``heads``, then ``rows`` in order as the list ``items``.

    A document is written line by line by one task as its rows come out of the sort, so its length is not bound by memory,
    and no row passes the driver.  Values of ``by`` without rows give an empty list.
    """
    fields = lambda df: F.to_json(F.struct(*(c for c in df.columns if c != by)), {"ignoreNullFields": "false"})
    first = F.row_number().over(Window.partitionBy(by).orderBy(*order)) == 1
    keys = [f"__{i}" for i in range(len(order))]
    body = rows.select(by, F.lit(1).alias("__part"), *(F.col(c).alias(k) for c, k in zip(order, keys)),
                       F.concat(F.when(first, "").otherwise(","), fields(rows)).alias("value"))
    none = [F.lit(None).cast(body.schema[k].dataType).alias(k) for k in keys]
    open_ = fields(heads)
    head = heads.select(by, F.lit(0).alias("__part"), *none, F.concat(F.substr(open_, F.lit(1), F.length(open_) - 1), F.lit(f',"{items}":[')).alias("value"))
    tail = heads.select(by, F.lit(2).alias("__part"), *none, F.lit("]}").alias("value"))
    lines = body.unionByName(head).unionByName(tail).repartition(by).sortWithinPartitions(by, "__part", *keys)
    lines.select(by, "value").write.partitionBy(by).text(path)
