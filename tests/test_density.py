"""Keyed density clusters, footprints and the isoclimate regressions against plain loops."""

import itertools
import math

import numpy as np
import pytest

from seasonlark.functions import geo
from seasonlark.operators import density as D
from seasonlark.operators import isoclimate as I
from test_matrix_regression import loop


def brute_dbscan(pts, eps, least):
    n = len(pts)
    near = [[b for b in range(n) if (pts[a][0] - pts[b][0]) ** 2 + (pts[a][1] - pts[b][1]) ** 2 <= eps * eps] for a in range(n)]
    core = [len(x) >= least for x in near]
    label, now = [0] * n, 0
    for a in range(n):
        if core[a] and not label[a]:
            now += 1
            todo = [a]
            while todo:
                b = todo.pop()
                if not label[b]:
                    label[b] = now
                    todo += [c for c in near[b] if core[c]]
    return [label[a] if core[a] else min((label[b] for b in near[a] if core[b]), default=0) for a in range(n)]


@pytest.mark.parametrize("chunk", [D.CHUNK, 40])
def test_many_clusterings_at_once(spark, monkeypatch, chunk):
    monkeypatch.setattr(D, "CHUNK", chunk)
    rng = np.random.default_rng(6)
    pts = np.round(np.concatenate([rng.normal(c, 0.3, (30, 2)) for c in ((0, 0), (3, 0), (0, 4))] + [rng.uniform(-3, 6, (25, 2))]), 1).tolist()
    pts += [[1.5, 0.0]] * 9
    params = {"a": (0.4, 5.0), "b": (0.9, 12.0), "c": (0.1, 2.0), "d": (2.0, 300.0)}
    rows = [(g, k, x, y, e, m) for g, (e, m) in params.items() for k, (x, y) in enumerate(pts)] + [("a", 900, None, 1.0, 0.4, 5.0)]
    df = spark.createDataFrame(rows, "g string, id int, x double, y double, e double, m double")
    got = {(r.g, r.id): r.label for r in D.dbscan(df, "id", "x", "y", "e", "m", by="g").collect()}
    assert len(got) == len(rows) and got["a", 900] == 0
    for g, (e, m) in params.items():
        assert [got[g, k] for k in range(len(pts))] == brute_dbscan(pts, e, m), g


def brute_closing(cells, r):
    disc = [(a, b) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r]
    wide = {(i + a, j + b) for i, j in cells for a, b in disc}
    return {(i, j) for i, j in wide if all((i + a, j + b) in wide for a, b in disc)}


def test_closing(spark):
    rng = np.random.default_rng(1)
    sets = {(g, r): {tuple(map(int, c)) for c in rng.integers(-9, 12, (40, 2))} for g, r in (("a", 1), ("b", 2), ("c", 4), ("d", 0))} | {("e", 3): {(0, 0)}}
    df = spark.createDataFrame([(g, r, i, j) for (g, r), c in sets.items() for i, j in c for _ in range(2)], "g string, r int, i int, j int")
    got = {}
    for row in D.run_cells(D.closing(df, ["g"], "i", "j", "r")).collect():
        got.setdefault(row.g, set()).add((row.i, row.j))
    assert got == {g: brute_closing(c, r) for (g, r), c in sets.items()}


def test_points_in_cells(spark):
    cells = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 3, 5), ("b", -2, 2)], "g string, i int, j int")
    rows = D.points_in_cells(cells, "g", 600, 0.5, 10.0, 20.0).collect()
    at = lambda r: (math.floor((20.0 - r.y) / 0.5), math.floor((r.x - 10.0) / 0.5))
    counts = {k: sum(1 for r in rows if r.g == "a" and at(r) == k) for k in ((0, 0), (0, 1), (3, 5))}
    assert sum(counts.values()) == 600 and all(abs(n - 200) < 50 for n in counts.values())
    assert {at(r) for r in rows if r.g == "b"} == {(-2, 2)} and len(rows) == 1200


def world():
    """A 24 x 24 grid with two peaks of asynchrony, curves and climate, some cells without."""
    rng = np.random.default_rng(8)
    n = 24
    i, j = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
    value = np.exp(-((i - 6) ** 2 + (j - 6) ** 2) / 20) + np.exp(-((i - 16) ** 2 + (j - 15) ** 2) / 30) + rng.uniform(0, 0.05, (n, n))
    coef, env = rng.normal(size=(n, n, 4)) + 1, rng.normal(size=(n, n, 2))
    return n, value, coef, env, {(6, 6), (7, 6), (16, 14)}


def test_isoclimate_against_plain_loop(spark):
    n, value, coef, env, gone = world()
    res, x0, y0 = 0.5, -60.0, 10.0
    grid = [(i, j, x0 + (j + 0.5) * res, y0 - (i + 0.5) * res) for i in range(n) for j in range(n)]
    asynchrony = spark.createDataFrame([(*g, float(value[g[0], g[1]])) for g in grid], "i int, j int, lon double, lat double, v double")
    names = ["sin_1", "cos_1", "sin_2", "cos_2"]
    coeffs = spark.createDataFrame([(i, j, *([None] * 4 if (i, j) in gone else map(float, coef[i, j]))) for i, j, _, _ in grid], "i int, j int, " + ", ".join(f"{c} double" for c in names))
    climate = spark.createDataFrame([(i, j, *map(float, env[i, j])) for i, j, _, _ in grid], "i int, j int, ppt double, tmp double")
    axes = [1.0, 0.75, 9.0], [0.3, 0.15, 30.0], [2.0, 1.0, 0.5]
    params = I.parameter_sets(spark, *axes)
    assert params.count() == 27 and I.parameter_sets(spark, *axes, done=params.limit(5)).count() == 22
    out = I.isoclimate(asynchrony, coeffs, climate, params, "v", ["ppt", "tmp"], res, x0, y0, percentile=0.8, min_area_km2=20_000.0, n_points=40, nperm=39).collect()
    by = {}
    for r in out:
        by.setdefault(r.param_id, []).append(r)
    assert set(by) == set(range(1, 28))
    cut = np.percentile(value, 80)
    top = [g for g in grid if value[g[0], g[1]] >= cut]
    fitted = 0
    for k, (e, m, a) in enumerate(itertools.product(*axes), 1):
        labels = brute_dbscan([(g[2], g[3]) for g in top], e, m * n)
        prints = {c: brute_closing({(g[0], g[1]) for g, x in zip(top, labels, strict=True) if x == c}, max(1, round(1 / a / res))) for c in set(labels) - {0}}
        area = lambda c: sum((math.pi / 180 * 6371.008 * res) ** 2 * math.cos(math.radians(y0 - (i + 0.5) * res)) for i, _ in c)
        big = {c: cells for c, cells in prints.items() if area(cells) >= 20_000}
        rows = by[k]
        assert {r.n_dropped for r in rows} == {len(prints) - len(big)}
        if not big:
            assert [(r.region, r.failure, r.r2) for r in rows] == [(None, "no regions", None)]
            continue
        assert {r.region: r.n_cells for r in rows} == {c: len(v) for c, v in big.items()}
        for r in rows:
            assert math.isclose(r.area_km2, area(big[r.region]), rel_tol=1e-9) and math.isclose(r.mean_lat, np.mean([y0 - (i + 0.5) * res for i, _ in big[r.region]]))
            cells = spark.createDataFrame([(f"{k}-{r.region}", i, j) for i, j in sorted(big[r.region])], "g string, i int, j int") if k in (1, 10) else None
            if cells is None:
                continue
            pts = [(p.x, p.y, math.floor((y0 - p.y) / res), math.floor((p.x - x0) / res)) for p in D.points_in_cells(cells, "g", 120, res, x0, y0).orderBy("draw").collect()]
            pts = [p for p in pts if p[2:] not in gone and 0 <= p[2] < n and 0 <= p[3] < n][:40]
            c = np.array([coef[p[2], p[3]] for p in pts])
            z = np.array([env[p[2], p[3]] for p in pts])
            z, unit = (z - z.mean(0)) / z.std(0), c / np.linalg.norm(c, axis=1)[:, None]
            x, y = (np.array([p[q] for p in pts]) for q in (0, 1))
            p, q = np.meshgrid(np.arange(len(pts)), np.arange(len(pts)), indexing="ij")
            clim = np.linalg.norm(z[:, None] - z[None], axis=2)
            b, t, pv, r2, f, fp = loop(np.sqrt(730 * np.maximum(1 - unit @ unit.T, 0)), [clim, geo.vincenty(x[p], y[p], x[q], y[q])], 39)
            assert r.n == len(pts) and np.allclose([r.clim_dist, r.geo_dist, r.clim_dist_t, r.geo_dist_t, r.r2, r.f], [b[1], b[2], t[1], t[2], r2, f], rtol=1e-5)
            assert np.allclose([r.clim_dist_p, r.geo_dist_p, r.f_p], [pv[1], pv[2], fp]) and math.isclose(r.mean_clim_dist, clim[np.tril_indices(len(pts))].mean(), rel_tol=1e-9)
            fitted += 1
    assert fitted >= 2 and any(len(v) > 1 for v in by.values())


