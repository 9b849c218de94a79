import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import types as T

from seasonlark.llm import polar_whitening as P

SF = "/root/testdata/sf0.01"


def brute(rows, top=4):
    """(key -> [(deviation, values)]) and shares, with exact covariances of fractions."""
    kept = [(k, [math.floor(256 * float(c)) for c in v]) for k, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    xs = sorted({tuple(x) for _, x in kept})
    n, d = len(xs), len(xs[0])
    s = [sum(x[i] for x in xs) for i in range(d)]
    y = np.array([[n * a - b for a, b in zip(x, s)] for x in xs], object)
    cov = np.array([[float(Fraction(int((y[:, i] * y[:, j]).sum()), n**3)) for j in range(d)] for i in range(d)])
    e, v = np.linalg.eigh(cov)
    e, v = e[::-1][:top], v[:, ::-1][:, :top]
    out = {}
    for k, x in kept:
        c = [n * a - b for a, b in zip(x, s)]
        out.setdefault(k, []).append((sum(a * a for a in c), (np.array(c, float) / n) @ v / np.sqrt(e)))
    return n, out, e / np.trace(cov)


def held(rows, got, top=4):
    n, want, share = brute(rows, top)
    assert {r.n for r in got} == {n}
    assert sorted({r.component for r in got}) == list(range(1, min(top, len(share)) + 1))
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-8
    sign = {}
    by = {}
    for r in got:
        assert math.isclose(r.explained, share[r.component - 1], rel_tol=1e-9)
        by.setdefault(r.vec_id, []).append(r)
    assert set(by) == set(want)
    for k, rs in by.items():
        assert len(rs) == len(want[k]) * len(share)
        assert {r.deviation for r in rs} == {dev for dev, _ in want[k]}
        for r in rs if len(want[k]) == 1 else []:
            w = want[k][0][1][r.component - 1]
            if abs(w) > 1e-6:
                sign.setdefault(r.component, math.copysign(1, r.whitened * w))
                assert math.isclose(r.whitened * sign[r.component], w, rel_tol=1e-6, abs_tol=1e-7)


def test_query_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    held(rows, P.op12_polar_whitening(spark, SF).collect())


def frame(spark, rows):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("x", T.StringType())])
    return spark.createDataFrame([(k, v, "clash") for k, v in rows], schema)


def test_odd_rows(spark):
    rnd = random.Random(4)
    rows = [(k, [rnd.gauss(0, s) for s in (3, 2, 1, 0.5, 0.2)]) for k in range(60)]
    same = [0.1, -0.2, 0.3, -0.4, 0.5]
    rows += [(k, same) for k in range(100, 300)] + [(None, [9.0, 1.0, 1.0, 1.0, -0.001]), (7, same)]
    odd = [(400, None), (401, []), (402, [1.0, None, 2.0, 3.0, 4.0]), (403, [1.0, float("nan"), 0.0, 0.0, 0.0]), (404, [float("inf"), 0.0, 0.0, 0.0, 0.0])]
    held(rows, P.whitened(frame(spark, rows + odd + [(405, [1.0, 2.0])])).collect())
    assert P.whitened(frame(spark, odd)).collect() == [] and P.whitened(frame(spark, rows).limit(0)).columns[0] == "vec_id"


def test_large_numbers_stay_exact(spark):
    rnd = random.Random(5)
    rows = [(k, [rnd.choice([1e9, -1e9, 1.0]) * rnd.random(), 1e12 + k, rnd.random()]) for k in range(40)]
    n, want, share = brute(rows)
    got = P.whitened(frame(spark, rows)).collect()
    for r in got:
        dev = want[r.vec_id][0][0]
        assert r.deviation == (dev if dev < 2**63 else None)
    assert math.isclose(next(r.explained for r in got if r.component == 1), share[0], rel_tol=1e-9)


@pytest.mark.parametrize("rows", [[(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 5.0]), (3, [1.0, 2.0])]])
def test_dimensions_without_variance(spark, rows):
    got = {(r.vec_id, r.component): r for r in P.whitened(frame(spark, rows)).collect()}
    assert len(got) == 2 * len(rows) and all(got[k, 2].whitened is None for k, _ in rows)
    if len(rows) == 3:
        assert sorted(abs(got[k, 1].whitened) for k, _ in rows) == pytest.approx([1, 1, 1])


def test_covariance_from_variances():
    rnd = np.random.default_rng(0)
    x = rnd.integers(-50, 90, (30, 4))
    s = x.sum(axis=0)
    q = x - s // 30
    squares = list(P._polar_squares(4, [int(v) for v in s // 30])(x))
    assert squares[:4] == (q * q).sum(axis=0).tolist()
    assert np.allclose(P.polarised_covariance(30, [int(v) for v in s - 30 * (s // 30)], [int(v) for v in squares]), np.cov(x.T, bias=True), rtol=1e-13)
