"""Coverings, point and region joins, drawn points and GeoJSON against plain loops."""

import json
import math
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonlark.functions.geo import hex_cell
from seasonlark.operators import polygons as P
from seasonlark.sources.geojson import read_geojson

RINGS = "name string, rings array<array<struct<x:double,y:double>>>"


def star(rng, cx, cy, size, n):
    ang = np.sort(rng.uniform(0, 2 * np.pi, n))
    rad = size * rng.uniform(0.3, 1, n)
    return [(float(cx + a * math.cos(t)), float(cy + a * math.sin(t))) for a, t in zip(rad, ang, strict=True)]


def holds(rings, x, y):
    odd = False
    for ring in rings:
        for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True):
            if min(y1, y2) <= y < max(y1, y2) and x1 + (y - y1) / (y2 - y1) * (x2 - x1) <= x:
                odd = not odd
    return odd


def shapes():
    rng = np.random.default_rng(3)
    out = {f"s{k}": [star(rng, *rng.uniform(-10, 10, 2), 10 ** rng.uniform(-1.5, 1), int(rng.integers(3, 40)))] for k in range(25)}
    out["holed"] = [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)], [(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)]]
    out["two"] = [[(-9.0, -9.0), (-7.0, -9.0), (-8.0, -6.5)], [(-5.0, -5.0), (-4.0, -5.0), (-4.0, -4.0), (-5.0, -4.0)]]
    return out


def frame(spark, shapes):
    return spark.createDataFrame(list(shapes.items()), RINGS)


def test_points_in_polygons(spark):
    rng = np.random.default_rng(1)
    s = shapes()
    pts = [(k, float(x), float(y)) for k, (x, y) in enumerate(rng.uniform(-12, 12, (1500, 2)))]
    pts += [(2000 + k, x, y) for k, (x, y) in enumerate([(0.0, 0.0), (8.0, 8.0), (4.0, 4.0), (2.0, 3.0), (0.0, 4.0), (-4.0, -4.5)])] + [(3000, None, 1.0), (2002, 4.0, 4.0)]
    df = spark.createDataFrame(pts, "id int, x double, y double")
    out = P.points_in_polygons(df, frame(spark, s | {"none": [], "gone": None}), "id", "x", "y", "name", rings="rings")
    assert "BroadcastNestedLoopJoin" not in out._jdf.queryExecution().toString() and "Cartesian" not in out._jdf.queryExecution().toString()
    got = sorted(map(tuple, out.collect()))
    assert got == sorted({(i, n) for i, x, y in pts for n, r in s.items() if x is not None and holds(r, x, y)})


def crosses(a, b):
    side = lambda p, q, r: np.sign((q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0]))
    (p, q), (r, s) = a, b
    box = all(max(p[c], q[c]) >= min(r[c], s[c]) and max(r[c], s[c]) >= min(p[c], q[c]) for c in (0, 1))
    return box and side(p, q, r) * side(p, q, s) <= 0 and side(r, s, p) * side(r, s, q) <= 0


def test_regions_and_hexagons(spark):
    s = shapes()
    q, r = F.col("q"), F.col("r")
    # hexagons of about 1.5 degrees
    hexes = spark.range(-9, 10).select(F.col("id").alias("q")).join(spark.range(-9, 10).select(F.col("id").alias("r"))).withColumn("h", F.concat_ws("_", "q", "r")).select("h", P.hexagon(q, r, 100_000.0).alias("rings"))
    out = P.polygon_pairs(frame(spark, s), hexes, "name", "rings", "h", "rings")
    got = set(map(tuple, out.collect()))
    seg = lambda rings: [e for ring in rings for e in zip(ring, ring[1:] + ring[:1], strict=True)]
    want = set()
    for h in hexes.collect():
        hr = [[(v.x, v.y) for v in ring] for ring in h.rings]
        for n, rings in s.items():
            if any(crosses(a, b) for a in seg(rings) for b in seg(hr)) or any(holds(rings, *ring[0]) for ring in hr) or any(holds(hr, *ring[0]) for ring in rings):
                want.add((n, h.h))
    assert got == want and len(want) > 100


def test_hexagon_holds_its_points(spark):
    rng = np.random.default_rng(2)
    pts = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(rng.uniform(-20, 20, (60, 2)))], "id int, x double, y double")
    own = pts.withColumn("h", hex_cell(F.col("x"), F.col("y"), 300_000.0))
    polys = own.select("h").distinct().select(F.concat_ws("_", "h.q", "h.r").alias("name"), P.hexagon(F.col("h.q"), F.col("h.r"), 300_000.0).alias("rings"))
    got = {r.id: r.name for r in P.points_in_polygons(pts, polys, "id", "x", "y", "name", rings="rings").collect()}
    same = sum(got.get(r.id) == f"{r.h.q}_{r.h.r}" for r in own.collect())
    assert same >= 58  # edges are straight in degrees here and on the plane there


def test_drawn_points_fill_every_region_evenly(spark):
    s = shapes() | {"sliver": [[(0.0, 0.0), (10.0, 10.0), (10.0, 10.004)]]}
    out = P.random_points_in(frame(spark, s | {"gone": None}), "name", "rings", 400, seed=5)
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r.name, []).append((r.x, r.y))
        assert holds(s[r.name], r.x, r.y)
    assert set(by) == set(s) and {len(v) for v in by.values()} == {400}
    assert sorted(r.draw for r in rows if r.name == "holed") == list(range(1, 401))
    assert sorted(map(tuple, rows)) == sorted(map(tuple, P.random_points_in(frame(spark, s), "name", "rings", 400, seed=5).collect()))
    # the holed square in twelve unit-area-equal parts: sixteen squares of side 2, four of them the hole
    counts = np.zeros((4, 4))
    for x, y in by["holed"]:
        counts[int(x // 2), int(y // 2)] += 1
    assert counts[1:3, 1:3].sum() == 0
    ring = counts[np.array([[not (0 < i < 3 and 0 < j < 3) for j in range(4)] for i in range(4)])]
    assert ((ring - 400 / 12) ** 2 / (400 / 12)).sum() < 31.3  # chi-square, 11 degrees of freedom, p = 0.001


def test_region_without_area_is_an_error_only_if_it_has_edges(spark):
    line = {"line": [[(0.0, 0.0), (1.0, 1.0)]]}
    with pytest.raises(RuntimeError, match="line"):
        P.random_points_in(frame(spark, line), "name", "rings", 5, max_rounds=2)


def test_geojson(spark):
    s = shapes()
    close = lambda ring: [list(v) for v in [*ring, ring[0]]]
    feats = [
        {"type": "Feature", "properties": {"n": "holed", "k": 3}, "geometry": {"type": "Polygon", "coordinates": [close(r) for r in s["holed"]]}},
        {"type": "Feature", "properties": {"n": "two"}, "geometry": {"type": "MultiPolygon", "coordinates": [[close(r)] for r in s["two"]]}},
        {"type": "Feature", "properties": {"n": "spot"}, "geometry": {"type": "Point", "coordinates": [4.0, 1.0]}},
        {"type": "Feature", "properties": None, "geometry": None},
    ]
    base = f"/tmp/spark-tests-{uuid.uuid4().hex}"
    spark.createDataFrame([(json.dumps({"type": "FeatureCollection", "features": feats}),)], "v string").coalesce(1).write.text(base + "a")
    spark.createDataFrame([(json.dumps(f),) for f in feats] + [("no json",)], "v string").write.text(base + "b")
    for path, lines in ((base + "a", False), (base + "b", True)):
        got = read_geojson(spark, path, lines)
        assert got.count() == 4
        polys = got.where("rings is not null").select(F.col("properties")["n"].alias("n"), "rings")
        pts = spark.createDataFrame([(1, 4.0, 4.0), (2, 1.0, 1.0), (3, -4.5, -4.5), (4, -8.0, -8.0), (5, -6.0, -6.0)], "id int, x double, y double")
        assert sorted(map(tuple, P.points_in_polygons(pts, polys, "id", "x", "y", "n", rings="rings").collect())) == [(2, "holed"), (3, "two"), (4, "two")]
        assert got.where("type = 'Point'").select("x", "y").first() == (4.0, 1.0)
