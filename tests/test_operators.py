"""Operators against numpy or brute force on small inputs, and their edge cases."""

import itertools
import math
from datetime import date, datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonlark.functions import geo, seasons
from seasonlark.functions.tails import f_upper, t_two_sided
from seasonlark.graph import connected_components
from seasonlark.operators import asynchrony, attribution, clean, cluster, eof, evaluate, harmonic, masks, pairs, series, spatial, stats
from seasonlark.sources import tables


def test_tails_match_tables():
    assert np.allclose(t_two_sided([2.228, 1.96, 63.657, 0], [10, 1e6, 1, 3]), [0.05, 0.05, 0.01, 1], atol=2e-4)
    assert np.allclose(f_upper([4.10, 2.71, 161.4], [2, 5, 1], [10, 20, 1]), [0.05, 0.05, 0.05], atol=2e-4)
    assert np.isnan(t_two_sided(np.nan, 3)) and f_upper(np.inf, 2, 3) == 0
    assert abs(stats.studentised_range_sf(3.88, 3, 10) - 0.05) < 1e-3


def test_closed_forms_equal_curves():
    rng = np.random.default_rng(0)
    day = np.arange(1, 366) * 2 * np.pi / 365
    basis = np.stack([np.sin(day), np.cos(day), np.sin(2 * day), np.cos(2 * day)])
    a, b = rng.normal(size=4), rng.normal(size=4)
    x, y = a @ basis, b @ basis
    cos = a @ b / np.sqrt(a @ a * (b @ b))
    z = lambda v, d: (v - v.mean()) / v.std(ddof=d)
    for d in (0, 1):
        assert math.isclose(np.linalg.norm(z(x, d) - z(y, d)), math.sqrt(2 * (365 - d) * (1 - cos)), rel_tol=1e-9)
    assert math.isclose(np.corrcoef(x, y)[0, 1] ** 2, cos**2, rel_tol=1e-9)


def test_curve_columns(spark):
    rows = [(1.0, 2.0, 0.5, -1.0, 2.0, 1.0, 0.0, 0.5), (0.0, 0.0, 0.0, 0.0, 1.0, 1.0, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double, f double, g double, h double")
    left, right = [F.col(c) for c in "abcd"], [F.col(c) for c in "efgh"]
    got = df.select(seasons.curve_distance(left, right).alias("x"), seasons.curve_r2(left, right).alias("y")).collect()
    v, w = np.array(rows[0][:4]), np.array(rows[0][4:])
    cos = v @ w / np.sqrt(v @ v * (w @ w))
    assert math.isclose(got[0].x, math.sqrt(728 * (1 - cos))) and math.isclose(got[0].y, cos**2)
    assert got[1].x is None and got[1].y is None and got[2].x == 0


def test_distances(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0, 1.0), (179.9, 10.0, -179.9, 10.0), (5.0, None, 1.0, 1.0), (1.0, 1.0, 1.0, 1.0)], "a double, b double, c double, d double")
    cols = [F.col(c) for c in "abcd"]
    out = df.select(geo.haversine_m(*cols).alias("h"), geo.vincenty_m(*cols).alias("v")).collect()
    assert math.isclose(out[0].h, geo.DEGREE_M, rel_tol=1e-9) and math.isclose(out[0].v, 110574.39, rel_tol=1e-6)
    assert out[1].h < 22_000 and out[2].h is None and out[3].h == 0 and out[3].v == 0


def test_harmonic_fit_and_permutations(spark):
    rng = np.random.default_rng(1)
    start = datetime(2010, 1, 1)
    rows = []
    for p in range(3):
        for k in range(60):
            d = start + timedelta(days=int(11 * k))
            t = 2 * np.pi * (d - datetime(2000, 1, 1)).total_seconds() / (365.25 * 86400)
            rows.append((p, d, float(3 + (0.1 * t + 2 * np.sin(t) + 0.5 * np.cos(2 * t)) * (p > 0) + rng.normal(0, 0.3)), float(t)))
    rows += [(7, start, 1.0, 0.0), (8, start, None, 0.0)]
    df = spark.createDataFrame(rows, "p int, ts timestamp, v double, t double")
    fit, fitted = harmonic.harmonic_fit(df, ["p"], "ts", "v")
    got = {r.p: r for r in fit.collect()}
    for p in range(3):
        own = np.array([(r[3], r[2]) for r in rows if r[0] == p])
        t = own[:, 0]
        x = np.stack([np.ones_like(t), t, np.sin(t), np.cos(t), np.sin(2 * t), np.cos(2 * t)], axis=1)
        beta, *_ = np.linalg.lstsq(x, own[:, 1], rcond=None)
        r2 = (x @ beta).var() / own[:, 1].var()
        assert np.allclose([got[p][c] for c in ("constant", "t", "sin_1", "cos_1", "sin_2", "cos_2")], beta, rtol=1e-5, atol=1e-6)
        assert math.isclose(got[p].r2, r2, rel_tol=1e-6)
    assert got[7].sin_1 is None or math.isnan(got[7].sin_1)
    assert 8 not in got and fitted.where("p = 1").count() == 60
    test = {r.p: r for r in harmonic.harmonic_permutation_test(df.where("p < 3"), ["p"], "ts", "v", n_perm=20, max_p=0.001).collect()}
    assert test[1].fails == 0 and test[1].significant == 1 and test[0].fails > 0
    moves = harmonic.permute_time(df.where("p = 0"), "ts", 3).collect()
    assert len(moves) == 180 and all(len({m.ts_perm for m in moves if m.seed == s}) == 60 for s in range(3))


def test_neighbours_match_brute_force_everywhere(spark):
    rng = np.random.default_rng(2)
    pts = [(i, float(rng.uniform(-180, 180)), float(np.degrees(np.arcsin(rng.uniform(-1, 1))))) for i in range(250)]
    pts += [(900, 180.0, 10.0), (901, -180.0, 10.0), (902, 0.0, 90.0), (903, 120.0, 89.9), (904, 5.0, -90.0), (905, None, 1.0)]
    df = spark.createDataFrame(pts, "id int, lon double, lat double")

    def dist(a, b):
        p, q = np.radians(a[1:]), np.radians(b[1:])
        h = math.sin((q[1] - p[1]) / 2) ** 2 + math.cos(p[1]) * math.cos(q[1]) * math.sin((q[0] - p[0]) / 2) ** 2
        return 2 * geo.EARTH_M * math.asin(math.sqrt(min(1, h)))

    good = [p for p in pts if p[1] is not None]
    for radius in (300_000.0, 2_500_000.0):
        want = {(a[0], b[0]) for a, b in itertools.product(good, good) if dist(a, b) <= radius}
        got = [(r.id, r.n_id) for r in spatial.neighbour_pairs(df, radius, [], "id", "lon", "lat", []).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_asynchrony_gate_and_landscapes(spark):
    rng = np.random.default_rng(3)
    rows = []
    for kind in ("low", "high"):
        for i in range(15):
            for j in range(15):
                b = np.array([2.0, 1, 1, 0.5]) + rng.uniform(-0.05, 0.05, 4)
                if kind == "high":
                    b = b + np.array([0.2 * i, -0.2 * j, 0.1 * i, 0.05 * j])
                rows.append((kind, i * 15 + j, -60 + 0.05 * j, 5 - 0.05 * i, *map(float, b)))
    rows.append(("low", 999, -60.0, 5.0, None, 1.0, 1.0, 1.0))
    df = spark.createDataFrame(rows, "kind string, pixel_id int, lon double, lat double, sin_1 double, cos_1 double, sin_2 double, cos_2 double")
    out = {(r.kind, r.pixel_id): r for r in asynchrony.asynchrony(df, 25_000.0, ["kind"]).collect()}
    assert out["low", 999].asynch is None and out["low", 999].asynch_n is None
    mean = lambda k: np.mean([r.asynch for (kind, _), r in out.items() if kind == k and r.asynch is not None])
    assert mean("high") > 3 * abs(mean("low"))
    for (kind, p), r in list(out.items())[:40]:
        if r.asynch_n is None:
            continue
        own = [x for x in rows if x[0] == kind and x[4] is not None]
        me = next(x for x in own if x[1] == p)
        xs, ys = [], []
        for o in own:
            a, b = np.radians([me[2], me[3]]), np.radians([o[2], o[3]])
            h = math.sin((b[1] - a[1]) / 2) ** 2 + math.cos(a[1]) * math.cos(b[1]) * math.sin((b[0] - a[0]) / 2) ** 2
            d = 2 * geo.EARTH_M * math.asin(math.sqrt(h))
            if d <= 25_000:
                u, v = np.array(me[4:]), np.array(o[4:])
                xs.append(d)
                ys.append(math.sqrt(max(0, 728 * (1 - u @ v / math.sqrt(u @ u * (v @ v))))))
        assert len(xs) == r.asynch_n
        if len(xs) < 30:
            assert r.asynch is None and r.asynch_pval is None
            continue
        x, y = np.array(xs), np.array(ys)
        slope, icpt = np.polyfit(x, y, 1)
        se = math.sqrt(((y - icpt - slope * x) ** 2).sum() / (len(x) - 2) / ((x - x.mean()) ** 2).sum())
        p_value = float(t_two_sided(slope / se, len(x) - 2))
        assert math.isclose(r.asynch_pval, p_value, rel_tol=1e-4, abs_tol=1e-12)
        assert math.isclose(r.asynch, slope * (p_value < 0.01), rel_tol=1e-5, abs_tol=1e-15)


def test_simple_ols_edges(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("b", 1.0, 2.0), ("b", 1.0, 3.0), ("c", 1.0, 5.0), ("c", 2.0, 5.0), ("c", 3.0, 5.0), ("d", None, 1.0)], "g string, x double, y double")
    out = {r.g: r for r in asynchrony.simple_ols(df, ["g"], F.col("x"), F.col("y")).collect()}
    assert out["a"].slope is None and out["b"].slope is None and out["c"].slope == 0 and out["c"].r2 is None and out["d"].n == 0
    zero = asynchrony.simple_ols(df.where("g = 'c'"), [], F.col("x"), F.col("y"), intercept=False).first()
    assert math.isclose(zero.slope, 30 / 14) and math.isclose(zero.r2, 1 - (75 - 30 * 30 / 14) / 75)


def test_matrix_pairs(spark):
    m = spark.createDataFrame([("a", 0.0, 1.0, 2.0), ("b", 1.0, 0.0, 3.0), ("c", 2.0, 3.5, 0.0)], "k string, a double, b double, c double")
    assert {(r.i, r.j): r.d for r in pairs.matrix_to_pairs(m, "k").collect()} == {("b", "a"): 1.0, ("c", "a"): 2.0, ("c", "b"): 3.5}
    assert [(r.i, r.j) for r in pairs.asymmetric_pairs(m, "k").collect()] == [("c", "b")]
    ids = spark.createDataFrame([("a",), ("c",), ("z",)], "k string")
    assert pairs.restrict_pairs(pairs.matrix_to_pairs(m, "k"), ids, "k").count() == 1
    assert {(r.k, r.side) for r in pairs.key_differences(m, ids, "k").collect()} == {("b", "a"), ("z", "b")}


def test_eof_equals_svd(spark):
    rng = np.random.default_rng(5)
    b = rng.normal(size=(60, 4)) * [3, 1, 0.5, 0.2]
    lat = rng.uniform(-60, 60, 60)
    df = spark.createDataFrame([(i, float(lat[i]), *map(float, b[i])) for i in range(60)], "id int, lat double, sin_1 double, cos_1 double, sin_2 double, cos_2 double")
    bands, modes = eof.eof(df, ["id"])
    day = np.arange(1, 366) * 2 * np.pi / 365
    curves = np.stack([np.sin(day), np.cos(day), np.sin(2 * day), np.cos(2 * day)], axis=1) @ b.T
    curves = (curves - curves.mean(axis=0)) / curves.std(axis=0)
    s = np.linalg.svd(curves * np.sqrt(np.cos(np.radians(lat))), full_matrices=False)
    share = s[1] ** 2 / (s[1] ** 2).sum()
    assert np.allclose([m["share"] for m in modes], share[:4])
    got = {r.id: [r[f"eof{k}"] for k in range(4)] for r in bands.collect()}
    for k in range(4):
        pc = s[0][:, k]
        want = [np.corrcoef(curves[:, i], pc)[0, 1] for i in range(60)]
        own = np.array([got[i][k] for i in range(60)])
        assert np.allclose(np.abs(own), np.abs(want), atol=1e-8)


def brute_dbscan(pts, eps, least):
    near = [{j for j, q in enumerate(pts) if math.dist(p, q) <= eps} for p in pts]
    core = [len(n) >= least for n in near]
    comp, label = list(range(len(pts))), 0
    for _ in pts:
        for i in range(len(pts)):
            if core[i]:
                comp[i] = min([comp[j] for j in near[i] if core[j]])
    number = {c: k + 1 for k, c in enumerate(sorted({comp[i] for i in range(len(pts)) if core[i]}))}
    return [number[comp[i]] if core[i] else min([number[comp[j]] for j in near[i] if core[j]], default=0) for i in range(len(pts))]


def test_dbscan(spark):
    rng = np.random.default_rng(6)
    pts = np.round(np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (3, 0), (0, 4))] + [rng.uniform(-3, 6, (25, 2))]), 3)
    df = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(pts)], "id int, x double, y double")
    got = {r.id: r.label for r in cluster.dbscan(df, "id", "x", "y", 0.4, 5).collect()}
    assert [got[i] for i in range(len(pts))] == brute_dbscan(pts.tolist(), 0.4, 5)
    assert cluster.dbscan(df.limit(0), "id", "x", "y", 0.4, 5).count() == 0
    assert {r.label for r in cluster.dbscan(df.limit(1), "id", "x", "y", 0.4, 5).collect()} == {0}


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(5, 5), (None, 3)]
    out = {r.id: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert out == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_modality_and_peaks(spark):
    rows = [(1, 0.0, 1.0, 0.0, 0.0, 0.0), (2, 0.0, 0.2, 0.0, 1.0, 0.0), (3, 0.0, 0.0, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "id int, constant double, sin_1 double, cos_1 double, sin_2 double, cos_2 double")
    out = {r.id: r for r in series.modality(df, ["id"]).collect()}
    assert out[1].npeaks == 1 and out[1].modality == 1 and out[2].npeaks == 2 and 0 < out[2].modality < 1
    assert out[3].npeaks == 0 and out[3].modality == 1
    s = spark.createDataFrame([(i, float(v)) for i, v in enumerate([0, 2, 2, 2, 1, 3, 0, 5])], "i int, v double")
    assert [(r.peak, r.height) for r in series.find_peaks(s, [], "i", "v").orderBy("peak").collect()] == [(2, 2.0), (5, 3.0)]


def test_circular_time(spark):
    df = spark.createDataFrame([(1, 364, date(2020, 12, 31)), (10, 200, date(2021, 12, 31))], "a int, b int, d date")
    out = df.select(seasons.doy_diff(F.col("a"), F.col("b")).alias("x"), seasons.doy_to_radians(F.col("d")).alias("r")).collect()
    assert [r.x for r in out] == [2, 175] and all(math.isclose(r.r, 2 * math.pi) for r in out)


def test_masks_with_nothing(spark):
    parts = spark.createDataFrame([(1, None, 2, 0.9, 1), (2, 0.9, 2, 0.9, 1), (3, 0.9, 1, 0.9, None), (4, 5.0, 1, 0.9, 1)], "p int, evenness double, land int, availability double, significant int")
    assert {r.p: r.ok for r in masks.overall_mask(parts).collect()} == {1: 0, 2: 1, 3: 0, 4: 1}
    assert {r.p: r.ok for r in masks.overall_mask(parts, strict=True).collect()} == {1: 0, 2: 1, 3: 0, 4: 0}


def test_clean(spark):
    df = spark.createDataFrame([("a", -1.0), ("a", 2.0), ("a", 5.0), ("a", None), ("b", -3.0), ("b", 0.0)], "k string, v double")
    vals = lambda **kw: sorted((r.k, r.v if r.v is not None else -99) for r in clean.clamp_nonpositive(df, ["k"], "v", **kw).collect())
    assert vals() == [("a", -99), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", -99), ("b", -99)]
    assert vals(mode="drop") == [("a", 2.0), ("a", 5.0)]
    assert vals(fill_missing=True) == [("a", 2.0), ("a", 2.0), ("a", 2.0), ("a", 5.0), ("b", -99), ("b", -99)]
    assert vals(mode="drop", fill_missing=True) == [("a", 2.0), ("a", 2.0), ("a", 5.0)]
    null = clean.null_sentinels(spark.createDataFrame([(-9999.0,), (float("nan"),), (1.0,)], "v double"), {"v": [-9999.0]}).collect()
    assert [r.v for r in null] == [None, None, 1.0]


def test_tiles_and_files(spark):
    meta = spark.createDataFrame([(4, 4, 2, 4, 0.5, 10.0, -0.5, 50.0)], "width int, height int, per_row int, total int, x_step double, x0 double, y_step double, y0 double")
    tiles = spark.createDataFrame([(n, "b", [float(n * 100 + k) for k in range(16)]) for n in range(4)] + [(3, "c", [-9999.0] * 16)], "patch_n int, band string, values array<double>")
    out = tables.tiles_to_pixels(tiles, meta, margin=1).collect()
    assert len(out) == 20 and all(r.value is None for r in out if r.band == "c")
    one = next(r for r in out if r.patch_n == 3 and r.band == "b" and r.value == 305.0)
    assert (one.row, one.col, one.lon, one.lat) == (2, 2, 11.25, 48.75)
    names = spark.createDataFrame([("sif_201502a.nc",), ("sif_201512b.nc",), ("x",)], "f string")
    got = names.select(tables.half_month(F.col("f")).alias("h")).collect()
    assert (got[0].h.start, got[0].h.end) == (date(2015, 2, 1), date(2015, 2, 16)) and (got[1].h.start, got[1].h.end) == (date(2015, 12, 16), date(2016, 1, 1)) and got[2].h is None


def test_forest_attribution(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 3))
    df = spark.createDataFrame([(i, float(2 * a + b), float(a), float(b), float(c)) for i, (a, b, c) in enumerate(x)], "k int, y double, a double, b double, c double")
    split = attribution.stratified_split(df, "k", "y", 0.6)
    assert split.where("train = 1").count() == 180
    model = attribution.fit_forest(split.where("train = 1"), "y", ["a", "b", "c"], trees=15, mtry=2, depth=6)
    test = split.where("train = 0")
    assert attribution.scores(attribution.predict(model, test, ["a", "b", "c"], "y"), "y").first().r2 > 0.7
    imp = {r.variable: r.importance for r in attribution.permutation_importance(model, test, "k", "y", ["a", "b", "c"]).collect()}
    assert imp["a"] > imp["b"] > imp["c"]
    shap = attribution.shap_sample(model, test.limit(20), df, "k", ["a", "b", "c"], nsim=4)
    phi = {r.variable: r.importance for r in attribution.shap_importance(shap).collect()}
    assert phi["a"] > phi["b"] > phi["c"]
    assert shap.groupBy("k").count().count() == 20
    pd = attribution.partial_dependence(model, test, "k", ["a", "b", "c"], "a", 5).orderBy("at").collect()
    assert pd[0].mean < pd[-1].mean


def test_tower_and_leafout(spark):
    days = [date(2010, 1, 1) + timedelta(days=i) for i in range(730)]
    daily = spark.createDataFrame([("s", d, float(5 + 3 * math.sin(2 * math.pi * d.timetuple().tm_yday / 365))) for d in days], "site string, date date, flux double")
    sites = spark.createDataFrame([("s", 3, 3), ("lost", 90, 90)], "site string, i bigint, j bigint")
    cells = spark.createDataFrame([(3, 3, None, None, None, None, None), (3, 4, 1.0, 2.0, 0.0, 0.0, 0.0)], "i bigint, j bigint, constant double, sin_1 double, cos_1 double, sin_2 double, cos_2 double")
    out = evaluate.tower_eval(sites, daily, cells).collect()
    assert [(r.site, r.ring, r.n_days) for r in out] == [("s", 1, 729)] and out[0].r2 > 0.95 and out[0].f_p < 1e-6
    curves = spark.createDataFrame([(k, 0.0, math.sin(k / 3), math.cos(k / 3), 0.0, 0.0) for k in range(6)], "site int, constant double, sin_1 double, cos_1 double, sin_2 double, cos_2 double")
    obs = spark.createDataFrame([(k, 100.0 - 10 * k) for k in range(6)], "site int, doy double")
    met, reg = evaluate.leafout_eval(obs, curves, "site", "doy")
    assert met.count() == 6 and reg.first().n == 6


@pytest.mark.parametrize("kind", ["stddev", "entropy"])
def test_focal_on_empty(spark, kind):
    df = spark.createDataFrame([], "id int, lon double, lat double, v double")
    assert spatial.focal_stat(df, 1000.0, "id", "lon", "lat", "v", kind).count() == 0


def test_shapley_values_on_a_grid_are_those_of_the_join(spark, monkeypatch):
    """Variables of few values: the same draws and the same sums, without a row per draw in a shuffle."""
    from pyspark.sql import functions as F

    from seasonlark.operators import attribution

    rows = spark.range(400).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 5 % 11 / 10).alias("b"), (F.col("id") * 3 % 4).cast("double").alias("c"))
    rows = rows.withColumn("y", F.col("a") * F.col("b") - F.col("c")).localCheckpoint()
    model = attribution.fit_forest(rows, "y", ["a", "b", "c"], trees=8, mtry=2, depth=4)
    of = lambda: {(r.k, r.variable): r.phi for r in attribution.shap_sample(model, rows.where("k < 90"), rows, "k", ["a", "b", "c"], nsim=6).collect()}
    got = of()
    plan = attribution.shap_sample(model, rows.where("k < 90"), rows, "k", ["a", "b", "c"], nsim=6)._jdf.queryExecution().toString()
    assert "Exchange" not in plan
    monkeypatch.setattr(attribution, "GRID", 10)
    want = of()
    assert got.keys() == want.keys() and len(got) == 270
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9 and any(abs(v) > 0.1 for v in got.values())


def test_pairs_of_a_few_large_groups_are_dealt_out(spark):
    """A group's pairs used to meet in the one task of its key."""
    from pyspark.sql import functions as F

    from seasonlark.operators import pairs

    df = spark.range(400).select("id", F.lit(1).alias("g"), F.col("id").cast("double").alias("v"))
    t = pairs.pair_table(df, ["g"], "id", {"d": (["v"], pairs.euclid)})
    sizes = t.groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in sizes) == 400 * 399 // 2
    assert len(sizes) == 4 and max(r["count"] for r in sizes) < 400 * 399 // 3
    assert t.where("i <= j or abs(d - (i - j)) > 1e-9").isEmpty() and t.distinct().count() == 400 * 399 // 2


def test_importance_numbers_rows_once(spark, monkeypatch):
    """Grid and forest score alike, and rows are numbered once for all variables."""
    from pyspark.sql import functions as F

    from seasonlark.operators import attribution, stats

    rows = spark.range(300).select(F.col("id").alias("k"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") * 5 % 11 / 10).alias("b"))
    rows = rows.withColumn("y", F.col("a") * 2 - F.col("b")).localCheckpoint()
    model = attribution.fit_forest(rows, "y", ["a", "b"], trees=8, mtry=2, depth=4)
    calls = []
    monkeypatch.setattr(attribution, "numbered", lambda *a: calls.append(1) or stats.numbered(*a))
    of = lambda: {r.variable: r.importance for r in attribution.permutation_importance(model, rows, "k", "y", ["a", "b"], repeats=2).collect()}
    got = of()
    assert len(calls) == 1
    monkeypatch.setattr(attribution, "GRID", 10)
    want = of()
    base = attribution.predict(model, rows, ["a", "b"], "y").agg(F.avg(F.col("error") * F.col("error"))).first()[0]
    for x in ("a", "b"):
        moved = rows.drop(x).join(stats.permutations(rows, [], "k", x, 2, salt=x), "k")
        plain = attribution.predict(model, moved, ["a", "b"], "y").agg(F.avg(F.col("error") * F.col("error"))).first()[0] - base
        assert abs(got[x] - want[x]) < 1e-9 and abs(got[x] - plain) < 1e-9
