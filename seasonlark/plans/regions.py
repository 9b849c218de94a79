"""Queries over regions: polygons, hexagons, clusters and their footprints, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonlark.functions.geo import hex_cell
from seasonlark.operators import isoclimate, polygons
from seasonlark.plans import fixtures as X
from seasonlark.plans.regressions import climate, gappy_coeffs, sightings
from seasonlark.plans.registry import _q, r

#: Corners of each nation's region and of its hole, as offsets from its own corner.
OUTER, HOLE = [(0.0, 0.0), (0.3, 0.05), (0.25, 0.35), (0.02, 0.3)], [(0.1, 0.1), (0.18, 0.12), (0.15, 0.2)]
EDGE_M = 5000.0


def regions(spark, d):
    """Each nation as a region with a hole on the grid."""
    k = F.col("n_nationkey")
    at = lambda p: F.struct((-60 + 0.02 * k + p[0]).alias("x"), (4.3 + 0.1 * (k % 4) + p[1]).alias("y"))
    return X.table(spark, d, "nation").select(k.alias("region"), F.array(*[F.array(*[at(p) for p in ring]) for ring in (OUTER, HOLE)]).alias("rings"))


def hexagons(spark, d):
    """The hexagons that hold a customer."""
    at = sightings(spark, d).select(hex_cell(F.col("lon"), F.col("lat"), EDGE_M).alias("h")).distinct()
    return at.select(F.col("h").alias("hex"), polygons.hexagon(F.col("h.q"), F.col("h.r"), EDGE_M).alias("rings"))


def _edge_rows() -> str:
    return ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, ring in enumerate((OUTER, HOLE)) for a, b in zip(ring, ring[1:] + ring[:1], strict=True))


_SIGHT = "o AS (SELECT c_custkey AS id, -60 + 0.05 * (c_custkey % 15) + 0.003 * (c_custkey % 7) + 0.0011 AS lon, 5 - 0.05 * ((c_custkey // 15) % 15) - 0.002 * (c_custkey % 11) - 0.0007 AS lat FROM customer)"
_EDGES = f"""pe AS (SELECT n_nationkey AS region, ring, -60 + 0.02 * n_nationkey + x1 AS x1, 4.3 + 0.1 * (n_nationkey % 4) + y1 AS y1, -60 + 0.02 * n_nationkey + x2 AS x2, 4.3 + 0.1 * (n_nationkey % 4) + y2 AS y2
FROM nation, (VALUES {_edge_rows()}) v(ring, x1, y1, x2, y2))"""
_LEFT = "least(e.y1, e.y2) <= p.y AND p.y < greatest(e.y1, e.y2) AND e.x1 + (p.y - e.y1) / (e.y2 - e.y1) * (e.x2 - e.x1) <= p.x"
_CORNERS = ", ".join(f"({k})" for k in range(6))
_HEX = f"""xy AS (SELECT (sqrt(3) / 3 * radians(lon) * 6371008.0 - sin(radians(lat)) * 6371008.0 / 3) / {EDGE_M} AS q, 2.0 / 3 * sin(radians(lat)) * 6371008.0 / {EDGE_M} AS r FROM o),
z AS (SELECT q, r, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs FROM xy),
f AS (SELECT *, abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) AS fq, abs(rr - r) > abs(rs + q + r) AS fr FROM z),
hx AS (SELECT DISTINCT CAST(CASE WHEN fq THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT fq AND fr THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM f),
hc AS (SELECT q, r, k, degrees(({EDGE_M} * sqrt(3) * (q + r / 2.0) + {EDGE_M} * cos(radians(60 * k + 30))) / 6371008.0) AS x, degrees(asin(({EDGE_M} * 1.5 * r + {EDGE_M} * sin(radians(60 * k + 30))) / 6371008.0)) AS y FROM hx, (VALUES {_CORNERS}) c(k)),
he AS (SELECT a.q, a.r, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM hc a JOIN hc b ON b.q = a.q AND b.r = a.r AND b.k = (a.k + 1) % 6)"""


def _turn(e: str, p: str, n: int) -> str:
    return f"sign(({e}.x2 - {e}.x1) * ({p}.y{n} - {e}.y1) - ({e}.y2 - {e}.y1) * ({p}.x{n} - {e}.x1))"


_MEET = f"""hit AS (SELECT DISTINCT a.region, b.q, b.r FROM pe a JOIN he b ON greatest(a.x1, a.x2) >= least(b.x1, b.x2) AND greatest(b.x1, b.x2) >= least(a.x1, a.x2) AND greatest(a.y1, a.y2) >= least(b.y1, b.y2) AND greatest(b.y1, b.y2) >= least(a.y1, a.y2)
  AND {_turn("a", "b", 1)} * {_turn("a", "b", 2)} <= 0 AND {_turn("b", "a", 1)} * {_turn("b", "a", 2)} <= 0),
held AS (SELECT e.region, p.q, p.r FROM pe e JOIN hc p ON p.k = 0 AND {_LEFT} GROUP BY ALL HAVING count(*) % 2 = 1),
holds AS (SELECT p.region, e.q, e.r FROM he e JOIN (SELECT region, ring, first(x1) AS x, first(y1) AS y FROM (SELECT DISTINCT ON (region, ring) region, ring, x1, y1 FROM pe ORDER BY region, ring, x1) GROUP BY ALL) p ON {_LEFT} GROUP BY p.region, p.ring, e.q, e.r HAVING count(*) % 2 = 1)"""


@_q(f"WITH {_SIGHT}, {_EDGES}, {_HEX}, {_MEET}, every AS (SELECT * FROM hit UNION SELECT * FROM held UNION SELECT * FROM holds) SELECT region, count(*) AS n, CAST(sum(q) AS BIGINT) AS q, CAST(sum(r) AS BIGINT) AS r FROM every GROUP BY region")
def j8_region_hexagons(spark, d):
    met = polygons.polygon_pairs(regions(spark, d), hexagons(spark, d), "region", "rings", "hex", "rings")
    return met.groupBy(F.col("a").alias("region")).agg(F.count("*").alias("n"), F.sum("b.q").alias("q"), F.sum("b.r").alias("r"))


@_q(f"WITH {_SIGHT}, {_EDGES}, p AS (SELECT id, lon AS x, lat AS y FROM o) SELECT p.id, e.region FROM pe e JOIN p ON {_LEFT} GROUP BY ALL HAVING count(*) % 2 = 1")
def j7_points_in_holed_regions(spark, d):
    return polygons.points_in_polygons(sightings(spark, d), regions(spark, d), "obs", "lon", "lat", "region", rings="rings").withColumnRenamed("obs", "id")


@_q("SELECT n_nationkey AS region, CAST(1000 AS BIGINT) AS n, CAST(1000 AS BIGINT) AS inside, true AS central FROM nation")
def t5_random_points(spark, d):
    """1000 points in each region; how many a join finds inside it, and whether their mean is where the region's centre is (within 0.01)."""
    own = regions(spark, d)
    drawn = polygons.random_points_in(own, "region", "rings", 1000, seed=1)
    back = polygons.points_in_polygons(drawn.select(F.struct("region", "draw").alias("k"), "x", "y"), own, "k", "x", "y", "region", rings="rings").where(F.col("k.region") == F.col("region"))
    n = drawn.groupBy("region").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    # by the shoelace formula, the hole taken off
    area = lambda ring: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 2
    part = lambda ring, c: sum((a[c] + b[c]) * (a[0] * b[1] - b[0] * a[1]) for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) / 6
    cx, cy = ((part(OUTER, c) - part(HOLE, c)) / (area(OUTER) - area(HOLE)) for c in (0, 1))
    k = F.col("region")
    near = (F.abs(F.col("mx") - (-60 + 0.02 * k + cx)) < 0.01) & (F.abs(F.col("my") - (4.3 + 0.1 * (k % 4) + cy)) < 0.01)
    return n.join(back.groupBy("region").agg(F.count("*").alias("inside")), "region").select("region", "n", "inside", near.alias("central"))


#: Clustering parameters: reach in degrees, least neighbours as a multiple of the grid's rows, and one over the footprints' radius.
EPS, LEAST, ALPHA = (0.06, 0.08, 0.11), (0.6, 0.45, 0.3), (20.0, 10.0, 20 / 3)


def _discs() -> str:
    return ", ".join(f"({r}, {a}, {b})" for r in (1, 2, 3) for a in range(-r, r + 1) for b in range(-r, r + 1) if a * a + b * b <= r * r)


_SETS = ", ".join(f"({k}, {e}::DOUBLE, {m}::DOUBLE, {round(20 / a)})" for k, (e, m, a) in enumerate(((e, m, a) for e in EPS for m in LEAST for a in ALPHA), 1))
_REGIONS = f"""WITH RECURSIVE {X.COEFFS}, sets(param_id, eps, least, r) AS (VALUES {_SETS}), kinds AS (SELECT DISTINCT eps, least FROM sets), disc(r, da, db) AS (VALUES {_discs()}),
top AS (SELECT pixel_id AS k, i, j, lon, lat FROM coef WHERE constant >= (SELECT quantile_cont(constant, 0.5) FROM coef)),
near AS (SELECT eps, least, a.k, b.k AS k2 FROM kinds, top a, top b WHERE power(a.lon - b.lon, 2) + power(a.lat - b.lat, 2) <= eps * eps),
core AS (SELECT eps, least, k FROM near GROUP BY ALL HAVING count(*) >= least * 15),
reach AS (SELECT eps, least, k, k AS root FROM core UNION SELECT eps, least, near.k2, reach.root FROM reach JOIN near USING (eps, least, k) JOIN core c USING (eps, least) WHERE c.k = near.k2),
lab AS (SELECT eps, least, k, dense_rank() OVER (PARTITION BY eps, least ORDER BY min(root)) AS label FROM reach GROUP BY eps, least, k),
edge AS (SELECT near.eps, near.least, near.k, min(label) AS label FROM near JOIN lab ON lab.eps = near.eps AND lab.least = near.least AND lab.k = near.k2 GROUP BY ALL),
own AS (SELECT eps, least, k, coalesce(lab.label, edge.label) AS label FROM edge LEFT JOIN lab USING (eps, least, k)),
cl AS (SELECT s.param_id, s.r, own.label, t.i, t.j FROM own JOIN top t USING (k) JOIN sets s USING (eps, least)),
wide AS (SELECT DISTINCT param_id, cl.r, label, i + da AS i, j + db AS j FROM cl JOIN disc ON disc.r = cl.r),
shut AS (SELECT param_id, label, i + da AS i, j + db AS j FROM wide w JOIN disc ON disc.r = w.r GROUP BY ALL HAVING count(*) = any_value((SELECT count(*) FROM disc d WHERE d.r = w.r))),
ar AS (SELECT param_id, label, count(*) AS n_cells, sum(power(pi() / 180 * 6371.008 * 0.05, 2) * cos(radians(5.025 - (i + 0.5) * 0.05))) AS area, avg(5.025 - (i + 0.5) * 0.05) AS lat FROM shut GROUP BY ALL)
SELECT s.param_id, a.label AS region, a.n_cells, round(a.area, 3) AS area_km2, round(a.lat, 6) AS mean_lat, coalesce((SELECT count(*) FROM ar d WHERE d.param_id = s.param_id AND d.area < 300), 0) AS n_dropped
FROM sets s LEFT JOIN (SELECT * FROM ar WHERE area >= 300) a ON a.param_id = s.param_id"""


def _isoclimate(spark, d, **more):
    grid = X.simple_coeffs(spark, d)
    params = isoclimate.parameter_sets(spark, list(EPS), list(LEAST), list(ALPHA))
    return isoclimate.isoclimate(grid, gappy_coeffs(spark, d), climate(spark, d), params, "constant", ["e1", "e2"], 0.05, -60.025, 5.025, percentile=0.5, min_area_km2=300.0, **more)


@_q(_REGIONS)
def m15_isoclimate_regions(spark, d):
    grid = X.simple_coeffs(spark, d)
    params = isoclimate.parameter_sets(spark, list(EPS), list(LEAST), list(ALPHA))
    cells, dropped = isoclimate.regions(grid, params, "constant", 0.05, 5.025, 0.5, 300.0)
    about = cells.groupBy("param_id", "region").agg(F.first("n_cells").alias("n_cells"), r(F.first("area_km2"), 3).alias("area_km2"), r(F.avg(5.025 - (F.col("i") + 0.5) * 0.05)).alias("mean_lat"))
    return params.select("param_id").join(about, "param_id", "left").join(dropped, "param_id", "left").na.fill(0, ["n_dropped"])


@_q()
def m15_isoclimate(spark, d):
    """All 27 parameter sets with 1000 points a region and 499 permutations; held against a plain loop in the tests."""
    return _isoclimate(spark, d)
