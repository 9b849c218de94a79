"""Registered queries of product scans and evaluations, with their SQL."""

from __future__ import annotations

from math import pi

from pyspark.sql import functions as F

from seasonlark.operators import attribution, clean, evaluate
from seasonlark.plans import fixtures as X
from seasonlark.plans.registry import _q, r
from seasonlark.sources import scans

# lineitem as a product: a supplier is a pixel, prices around 0, every 13th unknown
_PRODUCT = "p AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day, CASE WHEN l_partkey % 13 <> 0 THEN l_extendedprice - 20000 END AS v FROM lineitem)"
_WATER = "w AS (SELECT s_suppkey AS k FROM supplier WHERE s_nationkey <> 3)"


def _water(spark, d):
    return X.table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") == 3).cast("int").alias("water"))


@_q(f"""WITH {_PRODUCT}, {_WATER}, m AS (SELECT k, min(v) FILTER (v > 0) AS m FROM p GROUP BY ALL)
SELECT k, count(*) AS n, round(avg(coalesce(CASE WHEN v <= 0 THEN m ELSE v END, m)), 4) AS clamped, round(avg(coalesce(v, m)), 4) AS filled, round(avg(v), 4) AS plain
FROM p JOIN m USING (k) JOIN w USING (k) GROUP BY ALL""")
def s2_product_scan(spark, d):
    """The same product under three settings of its flags."""
    v = F.when(F.col("l_partkey") % 13 != 0, F.col("l_extendedprice") - 20000)
    df = X.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), v.alias("v"))
    water = _water(spark, d)
    mean = lambda name, **flags: scans.product_scan(df, ["k"], "v", water=water, **flags).groupBy("k").agg(F.count("*").alias("n"), r(F.avg("v"), 4).alias(name))
    out = mean("clamped", clamp_to_min=True, fill_with_min=True)
    return out.join(mean("filled", fill_with_min=True).drop("n"), "k").join(mean("plain").drop("n"), "k")


@_q(f"""WITH {_WATER}, b AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day, l_extendedprice AS nir, l_quantity * 1000 AS red FROM lineitem
WHERE CAST(l_shipdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1997-12-31' AND date_diff('day', DATE '1993-01-01', CAST(l_shipdate AS DATE)) % 4 = 0),
q AS (SELECT DISTINCT l_suppkey AS k, CAST(l_shipdate AS DATE) AS day FROM lineitem WHERE l_linenumber % 4 <= 1 AND l_partkey % 3 <= 1)
SELECT k, count(*) AS n, round(avg(((nir - red) / nullif(nir + red, 0) - 0.08) * nir), 4) AS nirv FROM b JOIN w USING (k) JOIN q USING (k, day) GROUP BY ALL""")
def j1_reflectance_scan(spark, d):
    li = X.table(spark, d, "lineitem")
    at = [F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("day")]
    bands = li.select(*at, F.col("l_extendedprice").alias("nir"), (F.col("l_quantity") * 1000).alias("red"))
    quality = li.select(*at, (F.col("l_linenumber") % 4).alias("q1"), (F.col("l_partkey") % 3).alias("q2"))
    out = scans.reflectance_scan(bands, quality, ["k"], "day", "nir", "red", ["q1", "q2"], 1, "1993-01-01", "1997-12-31", 4, _water(spark, d))
    return out.groupBy("k").agg(F.count("*").alias("n"), r(F.avg("nirv"), 4).alias("nirv"))


@_q(f"""WITH m AS (SELECT date_trunc('month', o_orderdate) AS a, o_custkey % 30 AS x, o_custkey % 20 AS y, o_totalprice AS lo, o_totalprice + o_custkey % 11 AS hi FROM orders),
c AS (SELECT epoch_ms(CAST(floor((epoch_ms(CAST(a AS TIMESTAMP)) + epoch_ms(CAST(a + INTERVAL 1 MONTH AS TIMESTAMP))) / 2) AS BIGINT)) AS ts, CAST(floor(x / 5.0) AS BIGINT) AS cx, CAST(floor(y / 5.0) AS BIGINT) AS cy, avg(lo) AS tmmn, avg(hi) AS tmmx FROM m GROUP BY ALL)
SELECT cx, cy, year(ts) AS year, count(*) AS n, round(avg((tmmn + tmmx) / 2), 4) AS tmmean, round(avg((epoch_ms(ts) - 946684800000) / (365.25 * 86400000.0) * {2 * pi}), 6) AS t FROM c WHERE cx <> 2 GROUP BY ALL""")
def s3_climate_scan(spark, d):
    month = F.date_trunc("month", F.col("o_orderdate").cast("timestamp"))
    lo = F.col("o_totalprice")
    df = X.table(spark, d, "orders").select(
        (F.col("o_custkey") % 30).alias("x"), (F.col("o_custkey") % 20).alias("y"), month.alias("start"), F.add_months(month, 1).cast("timestamp").alias("end"),
        lo.alias("tmmn"), (lo + F.col("o_custkey") % 11).alias("tmmx"),
    )
    water = df.select(F.floor(F.col("x") / 5).alias("cx"), F.floor(F.col("y") / 5).alias("cy")).distinct().withColumn("water", (F.col("cx") == 2).cast("int"))
    out = scans.climate_scan(df, "x", "y", 5, "start", "end", ["tmmn", "tmmx"], "tmmn", "tmmx", water)
    return out.groupBy("cx", "cy", F.year("ts").alias("year")).agg(F.count("*").alias("n"), r(F.avg("tmmean"), 4).alias("tmmean"), r(F.avg("t")).alias("t"))


@_q("""WITH s AS (SELECT l_linenumber % 2 AS sensor, l_suppkey % 20 AS k, CAST(l_shipdate AS DATE) AS day, avg((l_partkey * 41 >> 10) & 1) AS c FROM lineitem
WHERE CAST(l_shipdate AS DATE) >= DATE '1993-06-01' AND CAST(l_shipdate AS DATE) < DATE '1997-06-01' AND l_quantity - 2 > 0 GROUP BY ALL)
SELECT a.k, count(*) AS n, round(avg((a.c + b.c) / 2), 6) AS cloud FROM s a JOIN s b ON a.k = b.k AND a.day = b.day AND a.sensor = 0 AND b.sensor = 1 GROUP BY ALL""")
def s4_cloud_scan(spark, d):
    obs = X.table(spark, d, "lineitem").select(
        (F.col("l_linenumber") % 2).alias("sensor"), (F.col("l_suppkey") % 20).alias("k"), F.to_date("l_shipdate").alias("day"),
        (F.col("l_quantity") - 2).alias("n_obs"), (F.col("l_partkey") * 41).alias("state"),
    )
    out = scans.cloud_scan(obs.where("sensor = 0"), obs.where("sensor = 1"), ["k"], "day", "1993-06-01", "1997-06-01")
    return out.groupBy("k").agg(F.count("*").alias("n"), r(F.avg("cloud")).alias("cloud"))


@_q(f"WITH {X.LANDCOVER} SELECT CAST(year AS INT) AS year, CASE class WHEN 3 THEN 4 WHEN 9 THEN 8 ELSE class END AS class, count(*) AS n FROM lc WHERE year BETWEEN 1994 AND 1996 GROUP BY ALL")
def s5_class_scan(spark, d):
    return scans.class_scan(X.landcover(spark, d), ["pixel_id"], "year", "class", 1994, 1996, {3: 4, 9: 8}).groupBy("year", "class").agg(F.count("*").alias("n"))


@_q("""WITH p AS (SELECT o_custkey % 5 AS k, CAST(o_orderdate AS DATE) AS day, o_totalprice AS v, o_orderstatus AS s, o_orderkey FROM orders),
d AS (SELECT k, s, day, max(v) AS v FROM p GROUP BY ALL), f AS (SELECT k, s, dayofyear(day) AS doy, arg_min(v, day) AS v FROM d WHERE dayofyear(day) <= 365 GROUP BY ALL)
SELECT a.k, count(*) AS n, round(corr(a.v, b.v), 6) AS r FROM f a JOIN f b ON a.k = b.k AND a.doy = b.doy AND a.s = 'F' AND b.s = 'O' GROUP BY ALL""")
def j10_standard_year(spark, d):
    days = X.table(spark, d, "orders").groupBy((F.col("o_custkey") % 5).alias("k"), F.col("o_orderstatus").alias("s"), F.to_date("o_orderdate").alias("day")).agg(F.max("o_totalprice").alias("v"))
    out = evaluate.aligned_by_day(days.where("s = 'F'"), days.where("s = 'O'"), ["k"], "day", "v")
    return out.groupBy("k").agg(F.count("*").alias("n"), r(F.corr("a", "b")).alias("r"))


_MET = """m AS (SELECT site, CASE WHEN site % 7 <> 0 THEN six END AS six_leaf, first_leaf, sos FROM (SELECT c_custkey % 400 AS site, avg(c_acctbal) AS six,
avg(c_custkey % 60 + c_acctbal / 500) AS first_leaf, avg(c_nationkey + c_acctbal / 900) AS sos FROM customer GROUP BY ALL))"""


@_q(f"""WITH {_MET}, l AS (SELECT 'sos' AS x, 'first_leaf' AS y, sos AS u, first_leaf AS v FROM m UNION ALL SELECT 'six_leaf', 'first_leaf', six_leaf, first_leaf FROM m UNION ALL SELECT 'sos', 'six_leaf', sos, six_leaf FROM m),
g AS (SELECT x, y, regr_count(v, u) AS n, regr_slope(v, u) AS slope, regr_intercept(v, u) AS intercept, regr_r2(v, u) AS r2 FROM l GROUP BY ALL), t AS (SELECT *, r2 * (n - 2) / (1 - r2) AS f FROM g)
SELECT x, y, n, round(slope, 8) AS slope, round(intercept, 4) AS intercept, round(r2, 6) AS r2, round(f, 4) AS f, round({X.t_tail_sql("sqrt(f)", "(n - 2)")}, 5) AS f_p FROM t""")
def a23_leafout_regressions(spark, d):
    site = F.col("c_custkey") % 400
    m = X.table(spark, d, "customer").groupBy(site.alias("site")).agg(
        F.avg("c_acctbal").alias("six_leaf"), F.avg(F.col("c_custkey") % 60 + F.col("c_acctbal") / 500).alias("first_leaf"), F.avg(F.col("c_nationkey") + F.col("c_acctbal") / 900).alias("sos"),
    ).withColumn("six_leaf", F.when(F.col("site") % 7 != 0, F.col("six_leaf")))
    out = evaluate.leafout_regressions(m, [("sos", "first_leaf"), ("six_leaf", "first_leaf"), ("sos", "six_leaf")])
    return out.select("x", "y", "n", r("slope", 8).alias("slope"), r("intercept", 4).alias("intercept"), r("r2").alias("r2"), r("f", 4).alias("f"), r("f_p", 5).alias("f_p"))


_GRID = """o AS (SELECT CAST(o_custkey % 300 // 20 AS BIGINT) AS i, CAST(o_custkey % 20 AS BIGINT) AS j, CAST(o_orderdate AS DATE) AS day, o_totalprice AS v, o_orderkey AS k FROM orders),
pa AS (SELECT i, j, day, CASE WHEN sum(k) % 9 <> 0 THEN avg(v) END AS v FROM o GROUP BY ALL), pb AS (SELECT i, j, day, avg(v + k % 1000 * 90) AS v FROM o GROUP BY ALL)"""
_BOXES = {"north": (-60.0, 4.5, -59.0, 5.0, 12), "south": (-60.0, 4.0, -59.4, 4.5, 8), "none": (10.0, 10.0, 11.0, 11.0, 5)}


@_q(f"""WITH {_GRID}, g AS (SELECT DISTINCT i, j, -60 + 0.05 * j AS lon, 5 - 0.05 * i AS lat FROM o WHERE (i * 7 + j) % 3 <> 0),
bx(box, w, s, e, n, lim) AS (VALUES {", ".join(f"('{b}', {w}, {s}, {e}, {n}, {k})" for b, (w, s, e, n, k) in _BOXES.items())}),
site AS (SELECT box, i, j FROM g JOIN bx ON lon BETWEEN w AND e AND lat BETWEEN s AND n QUALIFY row_number() OVER (PARTITION BY box ORDER BY md5(concat('0-', i, '-', j)), i, j) <= lim),
pr AS (SELECT pa.i, pa.j, pa.v AS a, pb.v AS b FROM pa JOIN pb USING (i, j, day) WHERE dayofmonth(day) IN (1, 16) AND pa.v IS NOT NULL),
mo AS (SELECT i, j, count(*) AS n, corr(a, b) AS r FROM pr GROUP BY ALL)
SELECT box, site.i, site.j, coalesce(n, 0) AS n, CASE WHEN n > 1 THEN round(r, 6) END AS r FROM site LEFT JOIN mo ON mo.i = site.i AND mo.j = site.j""")
def m26_gap_agreement(spark, d):
    c = F.col("o_custkey")
    o = X.table(spark, d, "orders").select(
        F.floor(c % 300 / 20).alias("i"), (c % 20).cast("bigint").alias("j"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("k"),
    )
    a = o.groupBy("i", "j", "date").agg(F.when(F.sum("k") % 9 != 0, F.avg("v")).otherwise(-999.0).alias("value"))
    b = o.groupBy("i", "j", "date").agg(F.avg(F.col("v") + F.col("k") % 1000 * 90).alias("value"))
    gaps = o.select("i", "j").distinct().where((F.col("i") * 7 + F.col("j")) % 3 != 0)
    gaps = gaps.withColumns({"lon": -60 + 0.05 * F.col("j"), "lat": 5 - 0.05 * F.col("i")})
    return evaluate.gap_eval(gaps, a, b, _BOXES).withColumn("r", r("r"))


@_q("""SELECT l_returnflag AS site, count(*) AS n, round(avg(l_extendedprice), 4) AS gpp FROM lineitem
WHERE (l_linenumber > 2 OR l_quantity / 50.0 >= 0.71) AND l_linenumber <> 7 AND l_partkey % 9 <> 4 AND l_suppkey % 11 <> 5 GROUP BY ALL""")
def p21_site_filters(spark, d):
    """Quality at main sites only, no methane files, no excluded cover."""
    df = X.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("site"), F.when(F.col("l_linenumber") == 7, -9999.0).otherwise(F.col("l_extendedprice")).alias("gpp"), (F.col("l_quantity") / 50.0).alias("qc"),
        F.to_date("l_shipdate").alias("day"), (F.col("l_linenumber") <= 2).alias("main"), F.concat(F.lit("FLUXNET-"), F.when(F.col("l_partkey") % 9 == 4, "CH4_1.zip").otherwise("1.zip")).alias("file"),
        F.when(F.col("l_suppkey") % 11 == 5, "CRO").otherwise("ENF").alias("igbp"),
    )
    days = clean.flux_filter(clean.usable_sites(df, "igbp"), "gpp", "qc", "day", 0.71, main=F.col("main"), file="file")
    return days.groupBy("site").agg(F.count("*").alias("n"), r(F.avg("gpp"), 4).alias("gpp"))


@_q("""WITH g AS (SELECT eps, CAST(nation AS BIGINT) AS nation, row_number() OVER (ORDER BY md5(concat(eps, '-', nation))) AS param_id FROM (VALUES (1), (2), (3)) e(eps), range(0, 25) n(nation))
SELECT eps, nation, param_id FROM g WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_suppkey % 40 + 1 = eps AND s_nationkey = nation)""")
def u4_grid_minus_done(spark, d):
    """Parameter sets that no supplier stands for yet."""
    done = X.table(spark, d, "supplier").select((F.col("s_suppkey") % 40 + 1).alias("eps"), F.col("s_nationkey").alias("nation"))
    grid = attribution.parameter_grid(spark, {"eps": [1, 2, 3], "nation": list(range(25))}, done)
    return grid.withColumn("param_id", F.col("param_id").cast("bigint"))
