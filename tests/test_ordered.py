"""Chunked ordered operations against pandas, with chunks small enough to cross many borders."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pacetrace.functions.ordered import kth_values, run_pieces, runs, scan, tag_runs
from pacetrace.functions.ranges import range_join


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    n = 400
    return pd.DataFrame({
        "k": rng.choice(["a", "a", "a", "b"], n), "o": np.sort(rng.choice(3000, n, replace=False)),
        "v": rng.integers(0, 3, n), "x": np.where(rng.random(n) < 0.4, np.nan, rng.random(n)),
    })


def test_scan_matches_pandas(spark, rows):
    df = spark.createDataFrame(rows).withColumn("x", F.when(~F.isnan("x"), F.col("x")))
    got = scan(df, ["k"], "o", prev={"pv": "v"}, following={"nv": "v"}, sums={"sv": "v"}, maxima={"mv": "o"},
               fill={"fx": "x"}, fill_back={"bx": "x"}, chunk_rows=97).toPandas().sort_values(["k", "o"]).reset_index(drop=True)
    want = rows.sort_values(["k", "o"]).reset_index(drop=True)
    g = want.groupby("k")
    for name, series in {
        "pv": g["v"].shift(), "nv": g["v"].shift(-1), "sv": g["v"].cumsum(), "mv": g["o"].cummax(), "fx": g["x"].ffill(),
        "bx": g["x"].transform(lambda s: s.shift(-1).bfill()),
    }.items():
        np.testing.assert_allclose(got[name].astype(float), series.astype(float), err_msg=name)


def test_runs_and_tags(spark, rows):
    df = spark.createDataFrame(rows)
    want = rows.sort_values(["k", "o"]).copy()
    want["run"] = want.groupby("k")["v"].transform(lambda s: (s != s.shift()).cumsum() - 1)
    pieces = run_pieces(df, ["k"], "o", "v", {"start_x": "o"}, chunk_rows=97)
    got = tag_runs(df, pieces, ["k"], "o", {"run_index": "run", "start_x": "s0"}, chunk_rows=97).toPandas().sort_values(["k", "o"])
    assert got["run"].tolist() == want["run"].tolist()
    assert got["s0"].tolist() == want.groupby(["k", "run"])["o"].transform("min").tolist()
    r = runs(df, ["k"], "o", "v", chunk_rows=97).toPandas()
    assert len(r) == want.groupby(["k", "run"]).ngroups
    assert r.sort_values(["k", "run_index"])["run_start"].tolist() == want.groupby(["k", "run"])["o"].min().tolist()


def test_order_statistics(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.choice(["a", "b", "c"], 500), "v": np.round(rng.normal(size=500), 2)})
    n = F.col("n")
    got = kth_values(spark.createDataFrame(pdf), ["k"], "v", {"lo": F.lit(0), "mid": F.floor(n / 2), "hi": n - 1}, buckets=8).toPandas().set_index("k")
    for k, s in pdf.groupby("k")["v"]:
        v = np.sort(s.to_numpy())
        assert (got.loc[k, "lo"], got.loc[k, "mid"], got.loc[k, "hi"], got.loc[k, "n"]) == (v[0], v[len(v) // 2], v[-1], len(v))


def test_range_join_ends(spark):
    pts = spark.createDataFrame([("t", x) for x in (0.0, 99.9, 100.0, 250.0, 300.0)], "k string, x double")
    iv = spark.createDataFrame([("t", 1, 99.9, 250.0), ("t", 2, 300.0, 300.0), ("u", 3, 0.0, 500.0)], "k string, i int, lo double, hi double")
    inc = {tuple(r) for r in range_join(pts, iv, ["k"], "x", "lo", "hi").select("x", "i").collect()}
    assert inc == {(99.9, 1), (100.0, 1), (250.0, 1), (300.0, 2)}
    exc = {tuple(r) for r in range_join(pts, iv, ["k"], "x", "lo", "hi", include_hi=False).select("x", "i").collect()}
    assert exc == {(99.9, 1), (100.0, 1)}
