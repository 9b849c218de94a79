"""Focal statistics by prefix sums against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonlark.functions.geo import haversine
from seasonlark.operators import spatial
from seasonlark.operators.focal import focal_grid


def brute(cells, radius, res, north, kind):
    i, j, v = (np.array(x) for x in zip(*cells, strict=True))
    lat, lon = north - (i + 0.5) * res, j * res
    out = {}
    for a in set(zip(i.tolist(), j.tolist(), strict=True)):
        near = v[haversine(a[1] * res, north - (a[0] + 0.5) * res, lon, lat) <= radius]
        if kind == "stddev":
            out[a] = (len(near), near.std())
        else:
            p = np.unique(near, return_counts=True)[1] / len(near)
            out[a] = (len(near), min(max(-(p * np.log2(p)).sum(), 0.0), 1.0))
    return out


def check(spark, cells, radius, res, north, kind):
    df = spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in cells], "i int, j int, v double").repartition(3)
    rows = focal_grid(df, radius, "v", kind, res, north).collect()
    got, want = {(r.i, r.j): (r.n, r.stat) for r in rows}, brute(cells, radius, res, north, kind)
    assert len(rows) == len(got) and got.keys() == want.keys()
    for k, (n, x) in want.items():
        assert got[k][0] == n and math.isclose(got[k][1], x, rel_tol=1e-7, abs_tol=1e-7), (k, got[k], n, x)


@pytest.mark.parametrize("kind", ["stddev", "entropy"])
@pytest.mark.parametrize("radius", [1_000.0, 300_000.0, 1_234_567.0, 9_000_000.0])
def test_globe_equals_all_pairs(spark, kind, radius):
    """Poles, the dateline, radii below a cell and wider than a hemisphere's cap."""
    rng = np.random.default_rng(int(radius))
    every = [(i, j) for i in range(72) for j in range(144)]
    at = [every[k] for k in rng.choice(len(every), 900, replace=False)]
    at += [(i, j) for i in (0, 71) for j in range(0, 144, 9)] + [(30, 0), (30, 143), (31, 0)]
    at = sorted(set(at))
    cells = [(i, j, float(rng.integers(0, 3)) if kind == "entropy" else 1000 + rng.normal()) for i, j in at]
    check(spark, cells, radius, 2.5, 90.0, kind)


def test_many_tiles_and_a_dense_window(spark):
    rng = np.random.default_rng(8)
    cells = [(i, (7190 + j) % 7200, rng.normal() * 5) for i in range(700, 740) for j in range(40)]
    check(spark, cells, 45_000.0, 0.05, 90.0, "stddev")


def test_same_as_pairs_of_points(spark):
    rows = [(k, k // 15, k % 15, 5 - 0.05 * (k // 15), -60 + 0.05 * (k % 15), float((k * 37) % 101)) for k in range(225)]
    df = spark.createDataFrame(rows, "id long, i int, j int, lat double, lon double, v double")
    for kind, value in (("stddev", F.col("v")), ("entropy", F.col("id") % 3)):
        x = df.withColumn("v", value)
        old = {r.id: r.stat for r in spatial.focal_stat(x, 20_000.0, "id", "lon", "lat", "v", kind).collect()}
        new = {r.i * 15 + r.j: r.stat for r in focal_grid(x, 20_000.0, "v", kind, 0.05, 5.025).collect()}
        assert old.keys() == new.keys() and all(math.isclose(old[k], new[k], abs_tol=1e-9) for k in old)


def test_odd_cells(spark):
    schema = "i int, j int, v double, tile int, strip string"
    rows = [(3, 4, 1.0, 0, "x"), (3, 4, 5.0, 0, "x"), (3, 4, None, 0, None), (3, 5, float("nan"), 0, None), (None, 5, 1.0, 0, None), (3, None, 1.0, 0, None), (3, 148, 9.0, 1, "")]
    got = focal_grid(spark.createDataFrame(rows, schema), 1000.0, "v", "stddev", 2.5, 90.0).collect()
    assert [(r.i, r.j, r.n) for r in got] == [(3, 4, 3)] and math.isclose(got[0].stat, np.std([1, 5, 9]))
    assert focal_grid(spark.createDataFrame([], schema), 1000.0, "v", "entropy", 2.5, 90.0).collect() == []
    same = [(i, j, 7.3, 0, "") for i in range(5) for j in range(5)]
    assert {r.stat for r in focal_grid(spark.createDataFrame(same, schema), 900_000.0, "v", "stddev", 2.5, 90.0).collect()} == {0.0}
    with pytest.raises(ValueError, match="circle"):
        focal_grid(spark.createDataFrame(same, schema), 1000.0, "v", "stddev", 0.7, 90.0)
    with pytest.raises(Exception, match="pole"):
        focal_grid(spark.createDataFrame([(72, 0, 1.0, 0, "")], schema), 1000.0, "v", "stddev", 2.5, 90.0).collect()
