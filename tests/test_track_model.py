"""Corner detection and matching on small built laps."""

import numpy as np
import pandas as pd

from pacetrace.operators import geometry as geo
from pacetrace.operators import track_model as tm


def lap(corners, n=1200, seed=None):
    """Metre grid with a braking zone, a speed dip and a lift around every (start, apex, end)."""
    s = np.arange(n)
    speed, thr, brk = np.full(n, 200.0), np.ones(n), np.zeros(n)
    for a, m, b in corners:
        speed[a:m] = np.linspace(200, 90, m - a, endpoint=False)
        speed[m:b] = np.linspace(90, 200, b - m)
        brk[a:m] = 0.8
        thr[a:b] = 0.2
    return pd.DataFrame({"session_id": "s", "segment_index": 0 if seed is None else seed, "s_m": s, "speed_kph": speed, "throttle_norm": thr, "brake_norm": brk})


def test_two_corners_from_pedals(spark):
    g = spark.createDataFrame(lap([(200, 260, 330), (700, 740, 800)]))
    got = tm.detect_from_pedals(g).toPandas().sort_values("apex_m")
    assert got["apex_m"].tolist() == [260, 740]
    # The zone opens at the first metre off full throttle and ends where the throttle is back.
    assert got["s_start_m"].tolist() == [200.0, 700.0]
    assert got["s_end_m"].tolist() == [330.0, 800.0]


def test_close_candidates_merge_unless_wide_open_between(spark):
    joined = lap([(200, 230, 240), (242, 262, 290)])
    split = lap([(200, 230, 240), (246, 262, 290)])
    assert len(tm.detect_from_pedals(spark.createDataFrame(joined)).toPandas()) == 1
    assert len(tm.detect_from_pedals(spark.createDataFrame(split)).toPandas()) == 2


def test_detection_invariants_on_random_laps(spark):
    rng = np.random.default_rng(8)
    laps = []
    for i in range(4):
        starts = np.sort(rng.choice(np.arange(100, 1000, 60), 6, replace=False))
        laps.append(lap([(int(a), int(a + rng.integers(15, 30)), int(a + rng.integers(35, 58))) for a in starts], seed=i))
    g = spark.createDataFrame(pd.concat(laps)).persist()
    for found in (tm.detect_from_pedals(g).toPandas(), tm.detect_from_speed(g).toPandas()):
        assert len(found) > 0
        for _, c in found.sort_values("apex_m").groupby("segment_index"):
            assert (c["s_start_m"] <= c["apex_m"]).all() and (c["apex_m"] <= c["s_end_m"]).all()
            assert (c["s_end_m"].to_numpy()[:-1] <= c["s_start_m"].to_numpy()[1:] + 1).all()


def test_nearest_pair_is_claimed_first(spark):
    corners = spark.createDataFrame([("t", 0, 3310.0), ("t", 1, 3404.0), ("t", 2, 100.0)], "track_id string, corner_pos int, apex_s_m double")
    cand = spark.createDataFrame([("t", 7, 3385, 3380.0, 3390.0)], "track_id string, candidate long, apex_m int, s_start_m double, s_end_m double")
    got = {r["corner_pos"]: r["candidate"] for r in tm.match_corners(corners, cand).collect()}
    assert got == {0: None, 1: 7, 2: None}


def test_polyline_and_ring(spark):
    pts = spark.createDataFrame([("a", 0, 0.0, 0.0), ("a", 1, 4.0, 0.0), ("a", 2, 4.0, 0.0), ("a", 3, 4.0, 4.0), ("b", 0, 1.0, 1.0), ("b", 1, 1.0, 1.0)],
                                "k string, o long, x double, y double")
    got = geo.resample_polyline(pts, ["k"], "o", 5, chunk_rows=2).toPandas().sort_values(["k", "i"])
    assert got[got["k"] == "a"][["x", "y"]].values.tolist() == [[0, 0], [2, 0], [4, 0], [4, 2], [4, 4]]
    assert got[got["k"] == "b"][["i", "x", "y"]].values.tolist() == [[0, 1, 1]]
    ring = spark.createDataFrame([("t", 0, 0.0, 0.0), ("t", 1, 10.0, 0.0), ("t", 2, 10.0, 10.0), ("t", 3, 0.0, 10.0)], "track_id string, i int, x double, y double")
    assert geo.ring_length(ring, ["track_id"]).collect()[0]["length_m"] == 40.0
    p = spark.createDataFrame([("t", 1, 5.0, 5.0), ("t", 2, 11.0, 5.0), ("t", 3, -1.0, 5.0)], "track_id string, p int, px double, py double")
    inside = {r["p"]: r["inside"] for r in geo.inside_ring(p, geo.ring_edges(ring, ["track_id"]), ["track_id"], "px", "py").collect()}
    assert inside == {1: True, 2: False, 3: False}
