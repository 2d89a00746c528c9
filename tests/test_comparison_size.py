"""What keeps the comparison's cost in proportion to the frames: written frames, few window steps, few sorted metres."""

import random

import pytest
from pyspark.sql import functions as F

from pacetrace.catalogue.grid_queries import paired
from pacetrace.operators import corner_channels as cc
from pacetrace.operators import grid as gr
from pacetrace.operators import phases as ph


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Two days of one source, as the bridge reads them."""
    d = str(tmp_path_factory.mktemp("events"))
    rows = spark.range(400).select(
        F.col("id").alias("event_id"), F.timestamp_seconds(1704067200 + F.col("id") * 432).cast("timestamp_ntz").alias("ts"),
        F.lit("view").alias("event_type"), (F.col("id") % 90).cast("double").alias("value"), F.format_string('{"k": %d}', F.col("id") % 100).alias("props"))
    rows.write.parquet(f"{d}/events.parquet")
    return d


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def windows(df):
    return sum(line.lstrip(" :+-").startswith("Window [") for line in plan(df).splitlines())


def test_frames_are_written_once(spark, sf):
    f, _, _ = paired(spark, sf)
    assert f.inputFiles() and not any("events.parquet" in name for name in f.inputFiles())
    assert f.count() == 400


def test_rear_slip_joins_windows_once(spark, sf):
    f, laps, _ = paired(spark, sf)
    w = laps.select("session_id", "segment_index").crossJoin(
        spark.createDataFrame([(1, 100.0, 200.0, 150.0, 110.0)], "corner_id int, s_start_m double, s_end_m double, apex_m double, entry_m double"))
    assert "__rb" not in plan(cc.corner_rear_slip(f, w))


def lap(spark, pedals):
    """One lap of 400 metres; ``pedals`` lists the metres at which the reference has them (None: all)."""
    rnd = random.Random(5)
    rows = []
    for s in range(400):
        seen = pedals is None or s in pedals
        rows.append(("a", 0, "t", s, 100 + 50 * rnd.random(), rnd.choice([0.0, 0.5, 1.0]), rnd.choice([0.0, 0.03, 0.5]), 100 + 50 * rnd.random(),
                     rnd.choice([0.0, 0.5, 1.0]) if seen else None, rnd.choice([0.0, 0.03, 0.5]) if seen else None, 10 * rnd.random()))
    grid = spark.createDataFrame(
        rows, "session_id string, segment_index int, track_id string, s_m int, speed_kph double, throttle_norm double, brake_norm double, "
        "ref_speed_kph double, ref_throttle_norm double, ref_brake_norm double, delta_ms double")
    return rows, ph.pedal_events(ph.pedal_events(grid), prefix="ref_")


def bounds(spark):
    c = spark.createDataFrame(
        [("t", 0, 0, "one", 40.0, 70.0, 110.0), ("t", 1, 1, "two", 250.0, 290.0, 340.0)],
        "track_id string, corner_pos int, corner_id int, corner_name string, s_start_m double, apex_s_m double, s_end_m double")
    return ph.corner_bounds(c.withColumn("target_throttle_pct", F.lit(60.0)))


def test_window_steps(spark):
    _, grid = lap(spark, None)
    assert windows(grid) == 2  # one a side
    assert windows(gr.boxcar(grid, "delta_ms")) <= 4
    assert windows(gr.resample(grid.withColumnRenamed("s_m", "frame_id").withColumn("lap_distance_m", F.col("frame_id") * 1.0),
                               gr.LAP, ["speed_kph"], distance="lap_distance_m")) <= 1


def test_corner_events_against_a_loop(spark):
    rows, grid = lap(spark, None)
    got = {r["corner_pos"]: r for r in ph.corner_events(grid, bounds(spark)).collect()}
    speed, thr, brk = ([r[i] for r in rows] for i in (4, 5, 6))
    for pos, floor, start, apex, end, ceiling in ((0, 0, 40, 70, 110, 250), (1, 110, 250, 290, 340, 399)):
        back = max(0, start - 200)
        entry_from = max(back, floor)
        lift = [s for s in range(entry_from + 1, apex + 1) if thr[s] < 0.9 <= thr[s - 1]]
        brake = [s for s in range(back + 1, apex + 1) if brk[s] > 0.05 >= brk[s - 1]]
        full = [s for s in range(apex + 1, min(end + 50, 399, ceiling) + 1) if thr[s] >= 0.95 > thr[s - 1]]
        low = min((speed[s], s) for s in range(start, end + 1))
        e = got[pos]
        assert e["n"] == 400
        assert e["entry_m"] == lift[0] and e["brake_point_m"] == brake[0]
        assert e["exit_throttle_p"]["s_m"] == full[0] and (e["min_p"]["speed_kph"], e["min_p"]["s_m"]) == low
        assert e["apex_delta_ms"] == rows[apex][10] and e["exit_zone_m"] == end and e["exit_zone_p"]["s_m"] == end
    assert got[1]["straight_end_delta_ms"] == rows[398][10]


def test_reference_pedals_outside_of_the_questions_count(spark):
    _, grid = lap(spark, {380, 381})  # past the second corner's end, inside its window
    got = {r["corner_pos"]: r["ref_pedals"] for r in ph.corner_events(grid, bounds(spark)).collect()}
    assert got == {0: False, 1: True}


def test_metres_without_an_answer_stay_out_of_the_sort(spark):
    _, grid = lap(spark, None)
    text = plan(ph.corner_events(grid, bounds(spark)))
    assert "ref_pedals_start" in text  # the condition that keeps them out
