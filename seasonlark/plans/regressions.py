"""Queries over groups of points: matrix regressions of taxa and of clusters, with the SQL they are held against."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonlark.operators import cluster, flowering, genetics
from seasonlark.plans import fixtures as X
from seasonlark.plans.registry import _q, r

#: Closed form of a regression on three standardised regressors from their correlations (table c: m, a1-a3 with y, c12, c13, c23).
FIT3 = """SELECT *, b1 / sqrt(s2 * i11) AS t1, b2 / sqrt(s2 * i22) AS t2, b3 / sqrt(s2 * i33) AS t3, r2 / 3 / s2 AS f FROM (
SELECT *, (1 - r2) / (m - 4) AS s2 FROM (SELECT *, b1 * a1 + b2 * a2 + b3 * a3 AS r2 FROM (
SELECT *, i11 * a1 + i12 * a2 + i13 * a3 AS b1, i12 * a1 + i22 * a2 + i23 * a3 AS b2, i13 * a1 + i23 * a2 + i33 * a3 AS b3 FROM (
SELECT *, (1 - c23 * c23) / d AS i11, (c13 * c23 - c12) / d AS i12, (c12 * c23 - c13) / d AS i13, (1 - c13 * c13) / d AS i22, (c12 * c13 - c23) / d AS i23, (1 - c12 * c12) / d AS i33
FROM (SELECT *, 1 + 2 * c12 * c13 * c23 - c12 * c12 - c13 * c13 - c23 * c23 AS d FROM c)))))"""

_COS = "(a.sin_1 * b.sin_1 + a.cos_1 * b.cos_1 + a.sin_2 * b.sin_2 + a.cos_2 * b.cos_2) / sqrt((a.sin_1 * a.sin_1 + a.cos_1 * a.cos_1 + a.sin_2 * a.sin_2 + a.cos_2 * a.cos_2) * (b.sin_1 * b.sin_1 + b.cos_1 * b.cos_1 + b.sin_2 * b.sin_2 + b.cos_2 * b.cos_2))"


def sightings(spark, d):
    """Customers as dated observations of taxa (their nations) on the grid."""
    k = F.col("c_custkey")
    return X.table(spark, d, "customer").select(
        F.col("c_nationkey").alias("taxon"), k.alias("obs"), (-60 + 0.05 * (k % 15) + 0.003 * (k % 7) + 0.0011).alias("lon"),
        (5 - 0.05 * (F.floor(k / 15) % 15) - 0.002 * (k % 11) - 0.0007).alias("lat"), (1 + (k * 97 + F.col("c_nationkey") * 13) % 365).alias("doy"),
    )


def climate(spark, d):
    """Two climate variables per grid cell, from order lines."""
    p = F.col("l_partkey") % 225
    return X.table(spark, d, "lineitem").groupBy(F.floor(p / 15).alias("i"), (p % 15).alias("j")).agg(F.avg("l_quantity").alias("e1"), F.avg("l_extendedprice").alias("e2"))


def gappy_coeffs(spark, d):
    c = X.simple_coeffs(spark, d)
    return c.withColumns({h: F.when(F.col("pixel_id") % 11 != 0, F.col(h)) for h in ("sin_1", "cos_1", "sin_2", "cos_2")})


CLIMATE = "clim AS (SELECT (l_partkey % 225) // 15 AS i, (l_partkey % 225) % 15 AS j, avg(l_quantity) AS e1, avg(l_extendedprice) AS e2 FROM lineitem GROUP BY ALL)"
_FLOWERING = f"""WITH {X.COEFFS}, {CLIMATE},
o AS (SELECT c_nationkey AS taxon, c_custkey AS obs, -60 + 0.05 * (c_custkey % 15) + 0.003 * (c_custkey % 7) + 0.0011 AS lon, 5 - 0.05 * ((c_custkey // 15) % 15) - 0.002 * (c_custkey % 11) - 0.0007 AS lat, 1 + (c_custkey * 97 + c_nationkey * 13) % 365 AS doy FROM customer),
h AS (SELECT o.*, k.pixel_id, k.sin_1, k.cos_1, k.sin_2, k.cos_2, clim.e1, clim.e2 FROM o LEFT JOIN (SELECT * FROM coef WHERE pixel_id % 11 <> 0) k ON k.i = floor((5 - o.lat) / 0.05) AND k.j = floor((o.lon + 60) / 0.05) LEFT JOIN clim ON clim.i = floor((5 - o.lat) / 0.05) AND clim.j = floor((o.lon + 60) / 0.05)),
z AS (SELECT *, (e1 - avg(e1) OVER w) / stddev_pop(e1) OVER w AS z1, (e2 - avg(e2) OVER w) / stddev_pop(e2) OVER w AS z2 FROM h WHERE pixel_id IS NOT NULL WINDOW w AS (PARTITION BY taxon)),
p AS (SELECT a.taxon, least(abs(a.doy - b.doy), 365 - abs(a.doy - b.doy)) AS y, {X.HAV} AS g, sqrt(power(a.z1 - b.z1, 2) + power(a.z2 - b.z2, 2)) AS e, sqrt(730.0::DOUBLE * greatest(1 - {_COS}, 0)) AS l FROM z a JOIN z b ON a.taxon = b.taxon AND a.obs > b.obs),
c AS (SELECT taxon, count(*) AS m, corr(y, g) AS a1, corr(y, e) AS a2, corr(y, l) AS a3, corr(g, e) AS c12, corr(g, l) AS c13, corr(e, l) AS c23 FROM p GROUP BY taxon), f AS ({FIT3}),
n AS (SELECT taxon, count(pixel_id) AS n, avg(CAST(pixel_id IS NULL AS INT)) AS pct_miss FROM h GROUP BY taxon)
SELECT n.taxon, n.n, round(n.pct_miss, 6) AS pct_miss, round(r2, 6) AS r2, round(b1, 6) AS geo, round(t1, 4) AS geo_t, round(b2, 6) AS env, round(t2, 4) AS env_t, round(b3, 6) AS lsp, round(t3, 4) AS lsp_t, round(f, 4) AS f FROM n LEFT JOIN f ON f.taxon = n.taxon"""


@_q(_FLOWERING)
def m20_flowering(spark, d):
    """All 14,999 permutations run; SQL is held against what does not depend on them, the tests against the rest."""
    out = flowering.flowering_regression(sightings(spark, d), gappy_coeffs(spark, d), climate(spark, d), "taxon", "obs", "lon", "lat", "doy", ["e1", "e2"], 0.05, -60.0, 5.0, geo="haversine")
    out = out.where("failure is not null or least(geo_p, env_p, lsp_p, f_p) > 0")
    return out.select("taxon", "n", *[r(c).alias(c) for c in ("pct_miss", "r2", "geo", "env", "lsp")], *[r(c, 4).alias(c) for c in ("geo_t", "env_t", "lsp_t", "f")])


_GENETIC = f"""WITH {X.COEFFS}, {CLIMATE}, {X.POINTS},
h AS (SELECT pts.id, pts.lon, pts.lat, k.pixel_id, k.sin_1, k.cos_1, k.sin_2, k.cos_2, clim.e1, clim.e2 FROM pts LEFT JOIN (SELECT * FROM coef WHERE pixel_id % 11 <> 0) k ON k.i = floor((5 - pts.lat) / 0.05) AND k.j = floor((pts.lon + 60) / 0.05) LEFT JOIN clim ON clim.i = floor((5 - pts.lat) / 0.05) AND clim.j = floor((pts.lon + 60) / 0.05)),
s AS (SELECT *, (e1 - avg(e1) OVER ()) / stddev_pop(e1) OVER () AS z1, (e2 - avg(e2) OVER ()) / stddev_pop(e2) OVER () AS z2 FROM h), z AS (SELECT * FROM s WHERE pixel_id IS NOT NULL),
al AS (SELECT l_suppkey AS id, l_linenumber AS locus, l_partkey % 5 AS allele, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL), ks AS (SELECT DISTINCT locus, allele FROM al),
fu AS (SELECT x.id, ks.locus, ks.allele, coalesce(al.n, 0) AS n FROM (SELECT DISTINCT id FROM al) x CROSS JOIN ks LEFT JOIN al ON al.id = x.id AND al.locus = ks.locus AND al.allele = ks.allele),
gd AS (SELECT a.id AS i, b.id AS j, sqrt(sum((a.n - b.n) * (a.n - b.n))) AS y FROM fu a JOIN fu b ON a.locus = b.locus AND a.allele = b.allele AND a.id > b.id GROUP BY ALL),
p AS (SELECT gd.y, {X.HAV} AS g, sqrt(power(a.z1 - b.z1, 2) + power(a.z2 - b.z2, 2)) AS e, sqrt(730.0::DOUBLE * greatest(1 - {_COS}, 0)) AS l FROM z a JOIN z b ON a.id > b.id JOIN gd ON gd.i = a.id AND gd.j = b.id),
c AS (SELECT count(*) AS m, corr(y, g) AS a1, corr(y, e) AS a2, corr(y, l) AS a3, corr(g, e) AS c12, corr(g, l) AS c13, corr(e, l) AS c23 FROM p), f AS ({FIT3})
SELECT (SELECT count(*) FROM z) AS n, (SELECT round(avg(CAST(pixel_id IS NULL AS INT)), 6) FROM h) AS pct_miss, round(r2, 6) AS r2, round(b1, 6) AS geo, round(t1, 4) AS geo_t, round(b2, 6) AS env, round(t2, 4) AS env_t, round(b3, 6) AS lsp, round(t3, 4) AS lsp_t, round(f, 4) AS f FROM f"""


@_q(_GENETIC)
def m21_genetic_isolation(spark, d):
    """999 permutations run; SQL is held against what does not depend on them."""
    genes = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("id"), F.col("l_linenumber").alias("locus"), (F.col("l_partkey") % 5).alias("allele"))
    out = genetics.genetic_isolation(X.points(spark, d), genes, gappy_coeffs(spark, d), climate(spark, d), "id", "lon", "lat", "locus", "allele", ["e1", "e2"], 0.05, -60.0, 5.0, missing=0, geo="haversine")
    out = out.where("failure is null and lsp_p > 0")
    return out.select("n", *[r(c).alias(c) for c in ("pct_miss", "r2", "geo", "env", "lsp")], *[r(c, 4).alias(c) for c in ("geo_t", "env_t", "lsp_t", "f")])


@_q()
def m11_distance_row_clusters(spark, d):
    """Three clusters of the rows of every taxon's matrix of distances of flowering days."""
    gap = lambda a, b: F.least(F.abs(a[0] - b[0]), 365 - F.abs(a[0] - b[0])).cast("double")
    return cluster.cluster_member_rows(sightings(spark, d), "taxon", "obs", ["doy"], gap, 3).withColumn("inertia", r("inertia", 3))


@_q()
def m23_harvest_agreement(spark, d):
    """Clusters of users' hours of the day against the weekday that they are seen on first, 1000 permutations."""
    own = X.table(spark, d, "events").groupBy("user_id").agg(F.dayofweek(F.min("ts")).alias("region"))
    n = X.table(spark, d, "events").groupBy("user_id", F.hour("ts").alias("day")).agg(F.count("*").cast("double").alias("value"))
    return cluster.harvest_agreement(n.join(own, "user_id"), "user_id", "region", "day", "value").select(r("jaccard").alias("jaccard"), r("p").alias("p"), r("least").alias("least"), r("most").alias("most"))
