"""Matrix regressions against plain loops over the same permutations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonlark.functions import geo, shuffles
from seasonlark.operators import flowering, pairs, stats
from seasonlark.operators import matrix_regression as R


@pytest.mark.parametrize("n", [1, 2, 3, 7, 26, 100, 1000, 4097])
def test_permutations_are_bijections(n):
    for key in (0, 1, 2**32 - 1):
        assert sorted(shuffles.permuted(n, key)) == list(range(n))


def test_permutations_are_even():
    seen = np.zeros((5, 5))
    for key in range(5000):
        seen[np.arange(5), shuffles.permuted(5, (key * stats.PERM_STEP) & shuffles.MASK)] += 1
    assert ((seen - 1000) ** 2 / 1000).sum() < 45  # 16 degrees of freedom
    assert len({tuple(shuffles.permuted(4, k)) for k in range(1000)}) == 24


@pytest.mark.parametrize("kind", ["string", "double", "bigint"])
def test_dealt_values(spark, kind):
    rows = [(g, i, float(i)) for g, n in (("a", 40), ("b", 3), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, i int, v double").withColumn("i", F.col("i").cast(kind))
    out = stats.permutations(df, ["g"], "i", "v", 6).collect()
    by = {}
    for r in out:
        by.setdefault((r.g, r.perm), []).append((r.i, r.v))
    assert len(by) == 18
    for (g, _), got in by.items():
        n = {"a": 40, "b": 3, "c": 1}[g]
        assert len({i for i, _ in got}) == n and sorted(v for _, v in got) == [float(i) for i in range(n)]
    assert len({tuple(v for _, v in sorted(by["a", p])) for p in range(6)}) == 6


def loop(y, xs, nperm, standardise=True, intercept=True, seed=0):
    low = np.tril_indices(len(y), -1)
    z = (lambda v: (v - v.mean()) / v.std()) if standardise else (lambda v: v)
    x = np.stack([*([np.ones(len(low[0]))] if intercept else []), *[z(m[low]) for m in xs]], axis=1)

    def fit(v):
        b, *_ = np.linalg.lstsq(x, v, rcond=None)
        sse, left = ((v - x @ b) ** 2).sum(), len(v) - x.shape[1]
        tss = ((v - v.mean()) ** 2).sum() if intercept else (v**2).sum()
        return b, b / np.sqrt(sse / left * np.diag(np.linalg.inv(x.T @ x))), 1 - sse / tss, (tss - sse) / len(xs) / (sse / left)

    b, t, r2, f = fit(z(y[low]))
    hits, f_hits = np.ones(len(b)), 1
    for order in R.permutation_orders(len(y), seed, 1, nperm + 1):
        _, tp, _, fp = fit(z(y[np.ix_(order, order)][low]))
        hits += np.abs(tp) >= np.abs(t) * R.TIE
        f_hits += fp >= f * R.TIE
    return b, t, hits / (nperm + 1), r2, f, f_hits / (nperm + 1)


def agree(row, names, want, skip=0):
    b, t, p, r2, f, fp = want
    got = [[row[n] for n in names], [row[f"{n}_t"] for n in names], [row[f"{n}_p"] for n in names]]
    for g, w in zip(got, (b, t, p), strict=True):
        assert np.allclose(g[skip:], w[skip:], rtol=1e-6, atol=1e-9)
    assert np.allclose([row.r2, row.f, row.f_p], [r2, f, fp], rtol=1e-6) and row.failure is None


@pytest.mark.parametrize(("standardise", "intercept"), [(True, True), (True, False), (False, True), (False, False)])
def test_given_pairs(spark, monkeypatch, standardise, intercept):
    monkeypatch.setattr(R, "TILE", 5)
    monkeypatch.setattr(R, "WORK", 3000)
    rng = np.random.default_rng(4)
    n = 14
    m = [np.abs(np.subtract.outer(v, v)) for v in rng.normal(size=(2, n))]
    y = 1 + m[0] * 0.8 + m[1] * 0.2 + np.abs(rng.normal(0, 0.3, (n, n)))
    y = (y + y.T) / 2
    low = np.tril_indices(n, -1)
    rows = [("g", f"s{i:02d}", f"s{j:02d}", float(y[i, j]), float(m[1][i, j]), float(m[0][i, j])) for i, j in zip(*low, strict=True)]
    odd = [("tiny", "a", "b", 1.0, 2.0, 3.0), *[("gap", a, b, 1.0 + k, 2.0 * k * k, 1.0) for k, (a, b) in enumerate([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d")])]]
    odd += [("null", a, b, None if k == 3 else 1.0 + k, 2.0 * k * k, k % 3 + 0.5) for k, (a, b) in enumerate([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")])]
    odd += [("flat", a, b, 1.0, 2.0 * k * k, k % 3 + 0.5) for k, (a, b) in enumerate([("a", "b"), ("a", "c"), ("b", "c"), ("a", "d"), ("b", "d"), ("c", "d")])]
    df = spark.createDataFrame(rows + odd, "g string, i string, j string, y double, x1 double, x2 double")
    out = {r.g: r for r in pairs.mmrr(df, "g", "y", ["x1", "x2"], nperm=99, standardise=standardise, intercept=intercept).collect()}
    names = [*(["intercept"] if intercept else []), "x1", "x2"]
    want = loop(y, [m[1], m[0]], 99, standardise, intercept)
    agree(out["g"], names, want, skip=int(standardise and intercept))
    if standardise and intercept:
        assert (out["g"].intercept, out["g"].intercept_t, out["g"].intercept_p) == (0, 0, 1)
    assert {g: r.failure for g, r in out.items() if g != "g"} == {"tiny": "too few pairs", "gap": "missing distances", "null": "missing distances", "flat": "no spread"}
    assert all(out[g].r2 is None and out[g].x1_p is None for g in ("tiny", "gap", "null", "flat"))


@pytest.mark.parametrize("held", [R.HELD, 3])
def test_members_of_uneven_groups(spark, monkeypatch, held):
    monkeypatch.setattr(R, "TILE", 7)
    monkeypatch.setattr(R, "HELD", held)
    monkeypatch.setattr(R, "WORK", 2500)
    rng = np.random.default_rng(6)
    rows, want = [], {}
    for g, n in (("large", 31), ("small", 9)):
        doy, lon, lat = rng.integers(1, 366, n).astype(float), rng.uniform(-70, -60, n), rng.uniform(-5, 5, n)
        env, curve = rng.normal(size=(n, 2)), rng.normal(size=(n, 4)) + np.array([2, 0, 0, 0])
        rows += [(g, k, *map(float, (doy[k], lon[k], lat[k], *env[k], *curve[k]))) for k in range(n)]
        d = np.abs(np.subtract.outer(doy, doy))
        unit = curve / np.linalg.norm(curve, axis=1)[:, None]
        a, b = np.meshgrid(np.arange(n), np.arange(n), indexing="ij")
        xs = [geo.vincenty(lon[a], lat[a], lon[b], lat[b]), np.linalg.norm(env[:, None] - env[None], axis=2), np.sqrt(730 * np.maximum(1 - unit @ unit.T, 0))]
        want[g] = loop(np.minimum(d, 365 - d), xs, 149)
    rows += [("one", 0, *[1.0] * 9), *[("none", k, None, *[1.0] * 8) for k in range(4)], *[("same", k, 5.0, *[float(k * k % 7 + 1)] * 8) for k in range(6)], (("large"), None, *[3.0] * 9)]
    cols = ["doy", "lon", "lat", "e1", "e2", "c1", "c2", "c3", "c4"]
    df = spark.createDataFrame(rows, "g string, k int, " + ", ".join(f"{c} double" for c in cols))
    y = R.Distance("doy", "circular", ("doy",), 365)
    xs = [R.Distance("geo", "geodesic", ("lon", "lat")), R.Distance("env", "euclid", ("e1", "e2")), R.Distance("lsp", "curve", ("c1", "c2", "c3", "c4"))]
    out = {r.g: r for r in R.mmrr_members(df, "g", "k", y, xs, nperm=149).collect()}
    for g in want:
        agree(out[g], ["intercept", "geo", "env", "lsp"], want[g], skip=1)
    assert out["large"].n == 31 and out["one"].n == 1 and out["none"].n == 0
    assert {g: out[g].failure for g in ("one", "none", "same")} == {"one": "fewer than two members", "none": "fewer than two members", "same": "no spread"}
    assert math.isclose(out["large"].intercept_p, 1)


def test_flowering_keeps_failed_taxa(spark):
    rng = np.random.default_rng(9)
    grid = [(i, j, *map(float, rng.normal(size=4)), *map(float, rng.normal(size=2))) for i in range(6) for j in range(6)]
    cols = ["sin_1", "cos_1", "sin_2", "cos_2", "e1", "e2"]
    gone = {(0, 0), (3, 3)}
    coeffs = spark.createDataFrame([(i, j, *([None] * 4 if (i, j) in gone else v[:4])) for i, j, *v in grid], "i long, j long, " + ", ".join(f"{c} double" for c in cols[:4]))
    climate = spark.createDataFrame([(i, j, *v[4:]) for i, j, *v in grid if (i, j) != (5, 5)], "i long, j long, e1 double, e2 double")
    rows = [("whole", k, float(rng.uniform(0, 5)), float(-rng.uniform(0, 5)), int(rng.integers(1, 366))) for k in range(20)]
    rows += [("dry", k, 5.5 if k == 2 else 0.5 + k, -5.5 if k == 2 else -1.5, 30 * k) for k in range(5)]
    rows += [("lone", 1, 0.5, -0.5, 100), ("lone", 2, 3.5, -3.5, 120), ("lone", 3, 4.5, -4.5, 140), ("unasked", 1, 1.0, -1.0, 3)]
    obs = spark.createDataFrame(rows, "t string, k int, lon double, lat double, doy int")
    taxa = spark.createDataFrame([("whole",), ("dry",), ("lone",), ("absent",)], "t string")
    out = {r.t: r for r in flowering.flowering_regression(obs, coeffs, climate, "t", "k", "lon", "lat", "doy", ["e1", "e2"], 1.0, 0.0, 0.0, taxa=taxa, nperm=49).collect()}
    assert set(out) == {"whole", "dry", "lone", "absent"}
    assert out["whole"].failure is None and out["whole"].lsp_p >= 0.02
    kept = [r for r in rows if r[0] == "whole" and (int(-r[3]), int(r[2])) not in gone]
    assert out["whole"].n == len(kept) and math.isclose(out["whole"].pct_miss, 1 - len(kept) / 20)
    cells = {(i, j): v for i, j, *v in grid}
    lon, lat, doy = (np.array([r[c] for r in kept], float) for c in (2, 3, 4))
    own = np.array([cells[int(-r[3]), int(r[2])] for r in kept])
    a, b = np.meshgrid(np.arange(len(kept)), np.arange(len(kept)), indexing="ij")
    unit, env = own[:, :4] / np.linalg.norm(own[:, :4], axis=1)[:, None], (own[:, 4:] - own[:, 4:].mean(0)) / own[:, 4:].std(0)
    d = np.abs(np.subtract.outer(doy, doy))
    xs = [geo.vincenty(lon[a], lat[a], lon[b], lat[b]), np.linalg.norm(env[:, None] - env[None], axis=2), np.sqrt(730 * np.maximum(1 - unit @ unit.T, 0))]
    agree(out["whole"], ["intercept", "geo", "env", "lsp"], loop(np.minimum(d, 365 - d), xs, 49), skip=1)
    assert (out["dry"].failure, out["lone"].failure, out["absent"].failure) == ("missing distances", "fewer than two members", "fewer than two members")
    assert out["lone"].n == 1 and math.isclose(out["lone"].pct_miss, 2 / 3) and out["absent"].pct_miss is None
    filled = flowering.flowering_regression(obs, coeffs, climate, "t", "k", "lon", "lat", "doy", ["e1", "e2"], 1.0, 0.0, 0.0, nperm=9, fill_tol=2).where("t = 'whole'").first()
    assert filled.n == 20 and filled.pct_miss == 0


def test_wide_features_and_few_held_tiles(spark, monkeypatch):
    """Genetic distances come from arrays of allele counts; tiles, batches and slots are many and the group's vectors go to few tasks."""
    for name, value in {"TILE": 4, "HELD": 3, "WORK": 900, "SLOTS": 5, "HOLD": 2}.items():
        monkeypatch.setattr(R, name, value)
    rng = np.random.default_rng(11)
    n = 19
    counts, at = rng.integers(0, 4, (n, 6)), rng.normal(size=(n, 2))
    rows = [(1, f"s{k:02d}", *map(float, at[k]), [float(c) for c in counts[k]]) for k in range(n)]
    rows += [(2, f"s{k}", 1.0 * k, 2.0 * k * k, [float("nan")] * 6 if k == 2 else [1.0 * k] * 6) for k in range(5)]
    df = spark.createDataFrame(rows, "g int, k string, x double, y double, v array<double>")
    xs = [R.Distance("x", "euclid", ("x",)), R.Distance("y", "euclid", ("y",))]
    out = {r.g: r for r in R.mmrr_members(df, "g", "k", R.Distance("gen", "euclid", ("v",)), xs, nperm=99, wide="v").collect()}
    gen = np.linalg.norm(counts[:, None] - counts[None], axis=2)
    agree(out[1], ["intercept", "x", "y"], loop(gen, [np.abs(np.subtract.outer(c, c)) for c in at.T], 99), skip=1)
    assert (out[2].failure, out[2].n) == ("missing distances", 5)


def test_isolation_makes_no_pair_table(spark, monkeypatch):
    """Allele counts give the distances that the pair table had; a sample without genotypes leaves the model empty."""
    rng = np.random.default_rng(3)
    genes = spark.createDataFrame([(k, int(locus), int(rng.integers(-1, 3))) for k in range(12) for locus in range(5) for _ in range(2)], "id int, locus int, allele int")
    want = {(r.i, r.j): r.d for r in pairs.allele_distance(genes, "id", "locus", "allele", -1).collect()}
    own, dims = pairs.allele_counts(genes, "id", "locus", "allele", -1)
    vec = {r.s: np.array(r.v) for r in own.collect()}
    assert all(len(v) == dims for v in vec.values())
    assert all(math.isclose(d, np.linalg.norm(vec[i] - vec[j]), rel_tol=1e-12) for (i, j), d in want.items())
    grid = [(i, j, *map(float, rng.normal(size=6))) for i in range(4) for j in range(4)]
    coeffs = spark.createDataFrame([g[:6] for g in grid], "i long, j long, sin_1 double, cos_1 double, sin_2 double, cos_2 double")
    climate = spark.createDataFrame([(*g[:2], *g[6:]) for g in grid], "i long, j long, e1 double, e2 double")
    samples = spark.createDataFrame([(k, float(rng.uniform(0, 4)), float(-rng.uniform(0, 4))) for k in range(13)], "id int, lon double, lat double")
    from seasonlark.operators import genetics

    run = lambda s: genetics.genetic_isolation(s, genes, coeffs, climate, "id", "lon", "lat", "locus", "allele", ["e1", "e2"], 1.0, 0.0, 0.0, missing=-1, nperm=19).first()
    assert not hasattr(genetics, "pair_table")
    assert run(samples.where("id < 12")).failure is None
    assert (run(samples).failure, run(samples).n) == ("missing distances", 13)
