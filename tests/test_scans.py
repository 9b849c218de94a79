"""Scans, sampled gaps, preparation and grids: defined results of odd rows."""

import math
from datetime import date, datetime

import numpy as np
from pyspark.sql import functions as F

from seasonlark.operators import attribution, clean, evaluate
from seasonlark.sources import scans


def test_product_flags(spark):
    df = spark.createDataFrame([(1, -1.0), (1, None), (1, 3.0), (2, -2.0), (2, None), (3, 0.0), (3, 4.0)], "k int, v double")
    water = spark.createDataFrame([(1, 0), (2, 0), (3, 0), (3, 1)], "k int, water int")
    get = lambda **kw: sorted((r.k, r.v) for r in scans.product_scan(df, ["k"], "v", **kw).na.fill(-9.0).collect())
    assert get(clamp_to_min=True, fill_with_min=True, water=water) == [(1, 3.0), (1, 3.0), (1, 3.0), (2, -9.0), (2, -9.0)]
    assert get(fill_with_min=True) == [(1, -1.0), (1, 3.0), (1, 3.0), (2, -9.0), (2, -2.0), (3, 0.0), (3, 4.0)]
    assert get(clamp_to_min=True) == [(1, -9.0), (1, 3.0), (1, 3.0), (2, -9.0), (2, -9.0), (3, 4.0), (3, 4.0)]
    assert len(get()) == 7 and scans.product_scan(df.limit(0), ["k"], "v", clamp_to_min=True).count() == 0


def test_product_scan_sorts_no_observations(spark):
    """Sorted rows of a task grew with the table; hashed groups are those of its keys."""
    df = spark.createDataFrame([(1, -1.0), (1, 3.0)], "k int, v double")
    water = spark.createDataFrame([(1, 0)], "k int, water int")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for clamp in (True, False):
            out = scans.product_scan(df, ["k"], "v", clamp_to_min=clamp, fill_with_min=True, water=water)
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("ShuffledHashJoin") == 2 and "Sort" not in plan.replace("SortAggregate", "")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_reflectance_needs_good_quality_of_its_day(spark):
    day = lambda n: date(2000, 1, n)
    bands = spark.createDataFrame([(1, day(1), 5.0, 3.0), (1, day(5), 5.0, 3.0), (1, day(6), 5.0, 3.0), (2, day(1), 1.0, -1.0), (None, day(1), 1.0, 1.0)], "k int, day date, nir double, red double")
    quality = spark.createDataFrame([(1, day(1), 0), (1, day(1), 9), (1, day(5), None), (1, day(6), 0), (2, day(1), 1)], "k int, day date, q int")
    got = scans.reflectance_scan(bands, quality, ["k"], "day", "nir", "red", ["q"], 1, "2000-01-01", "2000-01-31", 4).collect()
    assert sorted((r.k, r.day.day, r.nirv) for r in got if r.k == 1) == [(1, 1, (0.25 - 0.08) * 5)] and [r.nirv for r in got if r.k == 2] == [None] and len(got) == 2


def test_cloud_and_class_scans(spark):
    d = date(2010, 1, 1)
    a = spark.createDataFrame([(1, d, 1, 1024), (1, d, 0, 0), (2, d, 1, 1024), (3, d, None, 0)], "k int, day date, n_obs int, state int")
    b = spark.createDataFrame([(1, d, 2, 0), (3, d, 1, 0), (1, date(2020, 1, 1), 1, 1024)], "k int, day date, n_obs int, state int")
    got = scans.cloud_scan(a, b, ["k"], "day", "2010-01-01", "2020-01-01").collect()
    assert [(r.k, r.cloud) for r in got] == [(1, 0.5)]
    c = spark.createDataFrame([(1, 1999, 3), (1, 2000, 3), (1, 2001, None), (1, 2002, 5)], "k int, year int, c int")
    assert sorted(((r.year, r.c) for r in scans.class_scan(c, ["k"], "year", "c", 2000, 2001, {3: 7}).collect())) == [(2000, 7), (2001, None)]


def test_climate_scan_is_timed_at_the_middle(spark):
    t = lambda m: datetime(2000, m, 1)
    df = spark.createDataFrame([(0, 0, t(1), t(2), 1.0, 3.0), (1, 1, t(1), t(2), 3.0, None), (9, 0, t(1), t(2), 0.0, 0.0)], "x int, y int, a timestamp, b timestamp, lo double, hi double")
    water = spark.createDataFrame([(0, 0, 0), (4, 0, 1)], "cx long, cy long, water int")
    (got,) = scans.climate_scan(df, "x", "y", 2, "a", "b", ["lo", "hi"], "lo", "hi", water).collect()
    assert (got.cx, got.cy, got.lo, got.hi, got.tmmean) == (0, 0, 2.0, 3.0, 2.5)
    assert math.isclose(got.t, 15.5 / 365.25 * 2 * math.pi)


def test_gap_sites_and_their_agreement(spark):
    gaps = spark.createDataFrame([(i, j, float(j), float(i)) for i in range(6) for j in range(6)], "i long, j long, lon double, lat double")
    boxes = {"a": (0.0, 0.0, 2.0, 5.0, 7), "b": (2.0, 0.0, 5.0, 5.0, 100), "c": (50.0, 0.0, 60.0, 5.0, 3)}
    sites = evaluate.sampled_in_boxes(gaps, "lon", "lat", boxes).collect()
    assert {b: sum(s.box == b for s in sites) for b in boxes} == {"a": 7, "b": 24, "c": 0}
    days = [date(2018, m, d) for m in range(1, 7) for d in (1, 9, 16)]
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=18), rng.normal(size=18)
    make = lambda v, bad: spark.createDataFrame([(1, 3, t, -999.0 if k == bad else float(z)) for k, (t, z) in enumerate(zip(days, v, strict=True))], "i long, j long, date date, value double")
    got = {(r.i, r.j): (r.n, r.r) for r in evaluate.gap_eval(gaps, make(x, 0), make(y, 5), {"b": boxes["b"]}).collect()}
    keep = [k for k, t in enumerate(days) if t.day in (1, 16) and k not in (0, 5)]
    assert len(got) == 24 and got[1, 3][0] == 10 and math.isclose(got[1, 3][1], np.corrcoef(x[keep], y[keep])[0, 1]) and got[0, 3] == (0, None)


def test_standard_year_and_regressions(spark):
    a = spark.createDataFrame([(1, date(2001, 1, 1), None), (1, date(2002, 1, 1), 5.0), (1, date(2003, 1, 1), 6.0), (1, date(2004, 12, 31), 9.0)], "k int, d date, v double")
    assert [(r.doy, r.v) for r in evaluate.on_standard_year(a, ["k"], "d", "v").collect()] == [(1, 5.0)]
    rows = [(float(k), None if k == 3 else 2.0 * k + (k % 2), 1.0) for k in range(9)]
    got = {(r.x, r.y): r for r in evaluate.leafout_regressions(spark.createDataFrame(rows, "a double, b double, c double"), [("a", "b"), ("c", "b")]).collect()}
    x, y = (np.array(z) for z in zip(*[(r[0], r[1]) for r in rows if r[1] is not None], strict=True))
    slope, icpt = np.polyfit(x, y, 1)
    r2 = np.corrcoef(x, y)[0, 1] ** 2
    one = got["a", "b"]
    assert one.n == 8 and np.allclose([one.slope, one.intercept, one.r2, one.f], [slope, icpt, r2, r2 / (1 - r2) * 6]) and 0 < one.f_p < 1e-6
    assert got["c", "b"].slope is None and got["c", "b"].f is None


def test_prepared_rows(spark):
    cells = [(i * 10 + j, (j + 0.5), (i + 0.5), float(i * j % 7) if (i, j) != (4, 4) else None) for i in range(10) for j in range(10)]
    response = spark.createDataFrame(cells, "key long, x double, y_ double, asy double")
    grid = lambda f: spark.createDataFrame([(i, j, float(f(i, j))) for i in range(10) for j in range(10) if (i, j) != (0, 0)], "i long, j long, value double")
    whole, part = attribution.prepare(response, "asy", {"u": grid(lambda i, j: i + 2 * j), "v": grid(lambda i, j: (i * j) ** 0.5)}, 1.0, 0.0, 0.0)
    rows = whole.collect()
    # bilinear needs all four corners: the last row and column have none beyond, the first cell none of its own
    assert 0 < len(rows) <= 98 and all(abs(sum(r[c] for r in rows)) < 1e-6 and math.isclose(np.std([r[c] for r in rows], ddof=1), 1.0) for c in ("asy", "u", "v"))
    assert part.columns == whole.columns and 0 < part.count() < len(rows)


def test_grid_keeps_its_numbers(spark):
    axes = {"a": [1, 2, 3], "b": ["x", "y"]}
    every = {(r.a, r.b): r.param_id for r in attribution.parameter_grid(spark, axes).collect()}
    done = spark.createDataFrame([(1, "x", 0.1), (1, "x", 0.2), (3, "y", 0.0)], "a long, b string, score double")
    rest = {(r.a, r.b): r.param_id for r in attribution.parameter_grid(spark, axes, done).collect()}
    assert sorted(every.values()) == list(range(1, 7)) and rest == {k: v for k, v in every.items() if k not in ((1, "x"), (3, "y"))}


def test_flux_rules(spark):
    df = spark.createDataFrame([("FLX_1", 0.1, True, "CRO", 1.0), ("FLX_1", 0.1, False, None, 2.0), ("FLUXNET-CH4_2", 0.9, True, "ENF", 3.0), (None, 0.9, None, "WAT", 4.0)], "f string, q double, m boolean, g string, v double")
    day = df.withColumn("d", F.lit("2000-01-01").cast("date"))
    assert sorted(r.v for r in clean.flux_filter(day, "v", "q", "d", main=F.col("m"), file="f").collect()) == [2.0, 4.0]
    assert sorted(r.v for r in clean.flux_filter(day, "v", "q", "d").collect()) == [3.0, 4.0]
    assert sorted(r.v for r in clean.usable_sites(df, "g").collect()) == [2.0, 3.0]
