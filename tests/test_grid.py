"""Metre grid steps against direct loops on random laps with repeated and unsorted distances."""

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pacetrace.operators import grid as gr
from pacetrace.operators import phases as ph
from pacetrace.operators.segments import LAP


def interp(xs, ys, x):
    if x <= xs[0]:
        return ys[0]
    if x >= xs[-1]:
        return ys[-1]
    lo = max(i for i in range(len(xs)) if xs[i] <= x)
    hi = lo + 1
    return ys[lo] + (x - xs[lo]) / (xs[hi] - xs[lo]) * (ys[hi] - ys[lo])


def random_laps(seed, laps=6, rows=40):
    rng = np.random.default_rng(seed)
    parts = []
    for i in range(laps):
        d = np.round(rng.uniform(-3, 60, rows) * 2) / 2
        parts.append(pd.DataFrame({
            "session_id": "s", "segment_index": i, "frame_id": np.arange(rows) + 1000 * i, "lap_distance_m": d,
            "lap_time_s": np.repeat(np.sort(rng.uniform(0, 90, rows // 4)), 4), "gear": rng.choice([0, 0, 0, 3, 4], rows), "v": rng.uniform(50, 250, rows)}))
    return pd.concat(parts)


def test_resample(spark):
    pdf = random_laps(1)
    got = gr.resample(spark.createDataFrame(pdf), LAP, ["v"]).toPandas()
    for i, lap in pdf.groupby("segment_index"):
        s = lap.sort_values(["lap_distance_m", "frame_id"])
        xs, ys = s["lap_distance_m"].tolist(), s["v"].tolist()
        cells = got[got["segment_index"] == i].sort_values("s_m")
        assert cells["s_m"].tolist() == list(range(math.ceil(max(xs)) + 1))
        np.testing.assert_allclose(cells["v"], [interp(xs, ys, g) for g in cells["s_m"]])


def test_resample_limit_and_exclusive_end(spark):
    pdf = random_laps(2, laps=2).assign(limit=80)
    df = spark.createDataFrame(pdf)
    assert gr.resample(df, LAP, ["v"], limit="limit").groupBy("segment_index").count().select("count").distinct().collect()[0][0] == 81
    assert gr.resample(df, LAP, ["v"], limit="limit", include_last=False).count() == 160


def test_clock_and_gear_runs_cross_chunks(spark):
    pdf = random_laps(3)
    df = spark.createDataFrame(pdf)
    clock = gr.smooth_clock(df, chunk_rows=7).toPandas().sort_values(["segment_index", "frame_id"])
    gear = gr.bridge_neutral(df, chunk_rows=7).toPandas().sort_values(["segment_index", "frame_id"])
    for i, lap in pdf.groupby("segment_index"):
        t, g = lap["lap_time_s"].tolist(), lap["gear"].tolist()
        runs, start = [], 0
        for j in range(1, len(t) + 1):
            if j == len(t) or t[j] != t[start]:
                runs.append((start, j))
                start = j
        want = list(t)
        for a, b in runs:
            if b < len(t):
                for k in range(a, b):
                    want[k] = t[a] + (t[b] - t[a]) * (k - a) / (b - a)
        np.testing.assert_allclose(clock[clock["segment_index"] == i]["lap_time_s"], want)
        bridged, j = list(g), 0
        while j < len(g):
            e = j
            while e < len(g) and g[e] == 0:
                e += 1
            if e > j:
                if e - j <= 5 and j > 0 and e < len(g):
                    bridged[j:e] = [bridged[j - 1]] * (e - j)
                j = e
            else:
                j += 1
        assert gear[gear["segment_index"] == i]["gear"].tolist() == bridged


def test_boxcar_shrinks_at_both_ends(spark):
    rng = np.random.default_rng(4)
    parts = [pd.DataFrame({"session_id": "s", "segment_index": i, "s_m": np.arange(n), "v": rng.normal(size=n)}) for i, n in enumerate((1, 5, 41, 100))]
    pdf = pd.concat(parts)
    pdf.iloc[60, 3] = np.nan
    got = gr.boxcar(spark.createDataFrame(pdf), "v").toPandas()
    for i, lap in pdf.groupby("segment_index"):
        v = lap["v"].to_numpy()
        n = len(v)
        want = []
        for k in range(n):
            r = min(20, k, n - 1 - k)
            w = v[k - r: k + r + 1]
            w = w[np.isfinite(w)]
            want.append(w.mean() if len(w) else v[k])
        np.testing.assert_allclose(got[got["segment_index"] == i].sort_values("s_m")["v"], want, atol=1e-12)


def test_pedal_events_against_a_walk(spark):
    """Brake release and full throttle after an apex, found by walking forward."""
    rng = np.random.default_rng(6)
    n = 300
    thr = np.clip(np.convolve(rng.uniform(0, 1.3, n), np.ones(5) / 5, "same"), 0, 1)
    brk = np.clip(np.convolve(rng.uniform(-0.2, 0.3, n), np.ones(9) / 9, "same"), 0, 1)
    pdf = pd.DataFrame({"session_id": "s", "segment_index": 0, "s_m": np.arange(n), "throttle_norm": thr, "brake_norm": brk})
    e = ph.pedal_events(spark.createDataFrame(pdf)).toPandas().sort_values("s_m")
    for apex in range(0, n - 40, 7):
        end = apex + 60
        braking = part = False
        release = full = None
        for i in range(apex, min(end, n - 1) + 1):
            braking = braking or brk[i] > 0.05
            if release is None and braking and brk[i] < 0.01:
                release = i
            part = part or thr[i] < 0.95
            if full is None and part and thr[i] >= 0.95:
                full = i
        w = e[(e["s_m"] >= apex) & (e["s_m"] <= end)]
        r = w[w["released_from"] >= apex]["s_m"]
        f = w[w["full"].fillna(False).astype(bool) & (w["s_m"] - 1 >= apex)]["s_m"]
        assert (r.min() if len(r) else None) == release
        assert (f.min() if len(f) else None) == full


def test_exit_points_merge_half_even(spark):
    def point(s):
        return None if s is None else (s, *([float(s)] * 3), *([s + 1.0] * 3), *([s + 2.0] * 3))

    p = "struct<s_m:int,speed_kph:double,ref_speed_kph:double,delta_ms:double,speed_kph1:double,ref_speed_kph1:double,delta_ms1:double,speed_kph2:double,ref_speed_kph2:double,delta_ms2:double>"
    rows = [(1, point(100), point(103)), (2, point(101), point(100)), (3, point(100), point(104)), (4, None, point(90)), (5, None, None)]
    df = spark.createDataFrame(rows, f"i int, exit_brake_p {p}, exit_throttle_p {p}").withColumns({
        "exit_zone_p": F.lit(None).cast(p), "exit_zone_m": F.lit(70), "ref_exit_brake_m": F.lit(99), "ref_exit_throttle_m": F.lit(None).cast("int"), "ref_pedals": F.lit(True)})
    got = {r["i"]: [(x["phase"], x["s_m"], x["speed_kph"]) for x in r["exits"]] for r in ph.exit_points(df).collect()}
    assert got == {1: [("exit", 102, 102.0)], 2: [("exit", 100, 100.0)], 3: [("exit_brake", 100, 100.0), ("exit_throttle", 104, 104.0)],
                   4: [("exit", 90, 90.0)], 5: [("exit", 70, None)]}
