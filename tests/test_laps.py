"""Lap classification on built sessions, checked by hand and by the independent auditor."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacetrace.functions.storage import materialise
from pacetrace.operators import laps as lp
from pacetrace.operators import segments as sg
from pacetrace.operators import session_stats as st

RATE = 10


def session(name, specs):
    """Frames of a session from lap specs (lap_number, duration_s, frames, covered_m, stop_s, start_speed, valid)."""
    parts, clock, frame = [], 100.0, 0
    for lap, duration, frames, covered, stop, start_speed, valid in specs:
        t = np.arange(frames) * duration / frames
        speed = np.where(t < 3, start_speed, 200.0)
        speed = np.where(t >= duration - stop, 0.0, speed) if stop else speed
        parts.append(pd.DataFrame({
            "session_id": name, "frame_id": frame + np.arange(frames), "session_time_s": clock + t, "lap_number": lap, "lap_time_s": t,
            "lap_distance_m": covered * t / duration, "speed_kph": speed, "lap_valid": valid}))
        clock, frame = clock + duration, frame + frames
    return pd.concat(parts)


def ok(lap, duration=90.0):
    return (lap, duration, int(duration * RATE), 4000.0, 0.0, 200.0, True)


SPECS = [
    (0, 90.0, 900, 4000.0, 0.0, 40.0, True), ok(1), ok(2, 91.0), (3, 90.0, 300, 4000.0, 0.0, 200.0, True),
    (4, 90.0, 900, 4000.0, 0.0, 200.0, False), (5, 60.0, 600, 4000.0, 0.0, 200.0, True), (6, 92.0, 920, 4000.0, 4.0, 200.0, True),
    (7, 120.0, 1200, 4000.0, 0.0, 200.0, True), (8, 90.0, 900, 2000.0, 0.0, 200.0, True), ok(9, 97.0), ok(10), ok(11)]
WANT = ["out-lap", "eligible", "eligible", "short", "invalid", "in-lap", "pit-lap", "pit-lap", "incomplete", "eligible", "eligible", "incomplete"]


@pytest.fixture(scope="module")
def framed(spark):
    pdf = pd.concat([session("hand", SPECS), session("restart", [ok(0), ok(1), (0, 90.0, 900, 4000.0, 0.0, 30.0, True), ok(1), ok(1 + 1)])])
    return sg.with_segments(spark.createDataFrame(pdf), chunk_rows=128).persist()


def test_statuses(framed):
    laps = lp.classify_laps(framed).toPandas().sort_values(["session_id", "segment_index"])
    hand = laps[laps["session_id"] == "hand"]
    assert hand["status"].tolist() == WANT
    assert hand["clean"].tolist() == [s == "eligible" and d <= 90 * 1.05 for s, d in zip(WANT, hand["duration_s"])]
    restart = laps[laps["session_id"] == "restart"]
    # The counter restarts without merging two stints; the slow stint start is an out-lap.
    assert restart["lap_number"].tolist() == [0, 1, 0, 1, 2]
    assert restart["status"].tolist() == ["eligible", "eligible", "out-lap", "eligible", "incomplete"]


def test_durations_prefer_the_lap_start_clock(framed):
    d = sg.durations(sg.segment_measures(framed), sg.lap_start_clock(framed)).filter("session_id = 'hand'").orderBy("segment_index").collect()
    assert [round(r["duration_s"], 6) for r in d[:3]] == [90.0, 90.0, 91.0]
    assert d[-1]["duration_source"] == "lap_time"


def test_auditor_agrees_and_finds_injected_faults(framed):
    laps = materialise(lp.classify_laps(framed))
    assert lp.audit_classification(framed, laps).count() == 0
    for wrong in sorted(set(WANT)):
        bent = laps.withColumn("reason", F.when(F.lit(wrong) == "eligible", F.lit("")).otherwise(F.lit("x"))).withColumn("status", F.lit(wrong))
        found = {(r.session_id, r.segment_index) for r in lp.audit_classification(framed, bent).filter("array_contains(faults, 'status')").collect()}
        assert found == {(r.session_id, r.segment_index) for r in laps.filter(F.col("status") != wrong).collect()}, wrong
    every = laps.count()
    for column, value, fault, count in (
        ("clean", ~F.col("clean"), "clean flag", every), ("reason", F.lit(""), "reason", laps.filter("status <> 'eligible'").count()),
        ("start_frame", F.col("start_frame") + 1, "frame range", every), ("end_frame", F.col("end_frame") - 1, "frame range", every),
    ):
        bad = lp.audit_classification(framed, laps.withColumn(column, value))
        assert bad.filter(F.array_contains("faults", fault)).count() == count, column
    assert lp.audit_classification(framed, laps.filter("session_id <> 'hand' OR segment_index <> 2")).count() == 1


def test_random_sessions_pass_the_auditor(spark):
    rng = np.random.default_rng(20260101)
    parts = []
    for s in range(8):
        specs = [(lap, float(rng.uniform(50, 130)), int(rng.uniform(200, 1300)), float(rng.choice([4000, 4000, 3000, 1000])),
                  float(rng.choice([0, 0, 2])), float(rng.choice([200, 50])), bool(rng.random() < 0.8)) for lap in range(int(rng.integers(4, 10)))]
        parts.append(session(f"r{s}", specs))
    f = sg.with_segments(spark.createDataFrame(pd.concat(parts)), chunk_rows=500)
    laps = materialise(lp.classify_laps(f))
    assert lp.audit_classification(f, laps).count() == 0


def test_envelope_of_two_half_fast_laps(spark):
    x = np.arange(201) * 5.0
    laps = [pd.DataFrame({"session_id": "e", "segment_index": i, "frame_id": np.arange(201), "lap_distance_m": x,
                          "speed_kph": np.where((x < 500) == (i == 0), 200.0, 100.0)}) for i in (0, 1)]
    r = st.speed_envelope(spark.createDataFrame(pd.concat(laps)), 1000.0).collect()[0]
    assert abs(r["envelope_s"] - 18.0) < 0.5 and r["uncovered_bins"] == 0 and r["laps_used"] == 2


def test_kind_of_loss(spark):
    rows = [(0.2, 0.3, 10, 8, "both"), (0.2, 0.1, 10, 6, "recurring"), (0.2, 0.3, 10, 5, "inconsistent"), (0.05, 0.3, 10, 10, "inconsistent")]
    df = spark.createDataFrame(rows, "r double, s double, n int, a int, want string")
    got = df.select(st.loss_kind(F.col("r"), F.col("s"), F.col("n"), F.col("a")).alias("k"), "want").collect()
    assert all(g["k"] == g["want"] for g in got)
