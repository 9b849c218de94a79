"""All registered queries of the library proper, each with SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonlark.functions import seasons
from seasonlark.functions.geo import hex_cell
from seasonlark.functions.shuffles import MASK, permuted_sql
from seasonlark.operators import asynchrony, attribution, clean, cluster, eof, evaluate, focal, harmonic, masks, pairs, polygons, series, spatial, stats
from seasonlark.operators.matrix_regression import TIE as mmrr_tie
from seasonlark.operators.matrix_regression import Distance, mmrr_members
from seasonlark.plans import fixtures as X
from seasonlark.scratch import materialise
from seasonlark.sources import scans, tables

QUERIES: dict = {}
SQL: dict[str, str] = {}


def _q(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def r(c, n=6):
    return F.round(c, n)


@_q("""SELECT o_orderstatus AS status, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders
WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1993-01-01' AND DATE '1996-12-31' AND date_diff('day', DATE '1993-01-01', CAST(o_orderdate AS DATE)) % 8 = 0 GROUP BY ALL""")
def s1_day_step(spark, d):
    df = clean.day_step_filter(X.table(spark, d, "orders"), "o_orderdate", "1993-01-01", "1996-12-31", 8)
    return df.groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@_q("""SELECT l_partkey % 225 AS pixel_id, count(*) AS n, round(avg(((b2 - b1) / nullif(b2 + b1, 0) - 0.08) * b2), 4) AS nirv
FROM (SELECT *, l_extendedprice AS b2, l_quantity * 1000 AS b1 FROM lineitem) WHERE l_linenumber % 4 <= 1 AND l_suppkey % 4 <= 1 GROUP BY ALL""")
def p1_nirv_quality(spark, d):
    df = X.table(spark, d, "lineitem").withColumns({"q1": F.col("l_linenumber") % 4, "q2": F.col("l_suppkey") % 4})
    df = clean.qa_filter(df, ["q1", "q2"], 1)
    return df.groupBy((F.col("l_partkey") % 225).alias("pixel_id")).agg(F.count("*").alias("n"), r(F.avg(clean.nirv(F.col("l_extendedprice"), F.col("l_quantity") * 1000)), 4).alias("nirv"))


@_q("""WITH m AS (SELECT c_nationkey, min(CASE WHEN c_acctbal > 0 THEN c_acctbal END) AS least FROM customer GROUP BY ALL)
SELECT c.c_nationkey AS nation, count(*) AS n, round(sum(CASE WHEN c_acctbal <= 0 THEN least ELSE c_acctbal END), 2) AS total FROM customer c JOIN m USING (c_nationkey) GROUP BY ALL""")
def p4_clamp(spark, d):
    df = clean.clamp_nonpositive(X.table(spark, d, "customer"), ["c_nationkey"], "c_acctbal")
    return df.groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("n"), r(F.sum("c_acctbal"), 2).alias("total"))


@_q("""WITH s AS (SELECT user_id, event_type, CAST(ts AS DATE) AS t, avg(value) AS v, sum((CAST(round(value * 100) AS BIGINT) >> 10) & 1) AS bits FROM events WHERE event_type IN ('click', 'view') GROUP BY ALL)
SELECT a.user_id % 100 AS g, count(*) AS n, round(avg((a.v + b.v) / 2), 6) AS mean, CAST(sum(a.bits + b.bits) AS BIGINT) AS bits FROM s a JOIN s b ON a.user_id = b.user_id AND a.t = b.t AND a.event_type = 'click' AND b.event_type = 'view' GROUP BY ALL""")
def j2_two_sensors(spark, d):
    bit = clean.bit_flag(F.round(F.col("value") * 100), 10)
    s = X.table(spark, d, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("t")).agg(F.avg("value").alias("v"), F.sum(bit).alias("bits"))
    a, b = (s.where(F.col("event_type") == k).select("user_id", "t", F.col("v").alias(f"v{k}"), F.col("bits").alias(f"b{k}")) for k in ("click", "view"))
    return a.join(b, ["user_id", "t"]).groupBy((F.col("user_id") % 100).alias("g")).agg(F.count("*").alias("n"), r(F.avg((F.col("vclick") + F.col("vview")) / 2)).alias("mean"), F.sum(F.col("bclick") + F.col("bview")).alias("bits"))


@_q(f"WITH {X.PIXELS} SELECT CAST(floor(j / 3) AS BIGINT) AS cx, CAST(floor(i / 3) AS BIGINT) AS cy, round(avg(value), 4) AS value FROM pix GROUP BY ALL")
def p11_resample_mean(spark, d):
    return spatial.resample_mean(X.pixel_obs(spark, d), [], "j", "i", 3, ["value"]).withColumn("value", r("value", 4))


@_q(f"""WITH {X.LANDCOVER}, n AS (SELECT CAST(floor((pixel_id % 15) / 3) AS BIGINT) AS cx, CAST(floor((pixel_id // 15) / 3) AS BIGINT) AS cy, class, count(*) AS n FROM lc GROUP BY ALL)
SELECT cx, cy, class FROM n QUALIFY row_number() OVER (PARTITION BY cx, cy ORDER BY n DESC, class) = 1""")
def p12_resample_mode(spark, d):
    lc = X.landcover(spark, d).withColumns({"x": F.col("pixel_id") % 15, "y": F.floor(F.col("pixel_id") / 15)})
    return spatial.resample_mode(lc, [], "x", "y", 3, "class")


@_q(f"""WITH {X.LANDCOVER} SELECT pixel_id, CAST(bool_and(class IN (1, 2, 3, 4, 5, 6, 7, 8, 12, 13, 14)) AS INT) + CAST(bool_and(class IN (1, 2, 3, 4, 5, 6, 7, 8)) AS INT) AS land,
CAST(sum(CASE WHEN class = 12 THEN 2 WHEN class = 14 THEN 1 ELSE 0 END) AS BIGINT) AS remapped FROM lc GROUP BY ALL""")
def a9_always_class(spark, d):
    lc = X.landcover(spark, d)
    land = masks.always_class(lc, ["pixel_id"], "class", list(range(1, 9)), [12, 13, 14])
    return land.join(lc.groupBy("pixel_id").agg(F.sum(masks.remap(F.col("class"), {12: 2, 14: 1})).cast("bigint").alias("remapped")), "pixel_id")


_STRUCT = {1: [1, 2, 3, 4, 5], 2: [6, 7], 3: [8, 9], 4: [10], 5: [12, 14]}


@_q(f"""WITH {X.LANDCOVER}, s AS (SELECT pixel_id, CASE WHEN class BETWEEN 1 AND 5 THEN 1 WHEN class IN (6, 7) THEN 2 WHEN class IN (8, 9) THEN 3 WHEN class = 10 THEN 4 WHEN class IN (12, 14) THEN 5 END AS cls FROM lc),
n AS (SELECT pixel_id, cls, count(*) AS n FROM s WHERE cls IS NOT NULL GROUP BY ALL) SELECT pixel_id, cls AS mode FROM n QUALIFY row_number() OVER (PARTITION BY pixel_id ORDER BY n DESC, cls) = 1""")
def a10_modal_structure(spark, d):
    lc = X.landcover(spark, d).withColumn("cls", masks.structure_class(F.col("class"), _STRUCT))
    return masks.modal_class(lc, ["pixel_id"], "cls")


_DAYS = "[31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]"
_AVAIL = f"{X.PIXELS}, av AS (SELECT pixel_id, month(date) AS month, greatest(least(count(value) / 7.0 / ({_DAYS}[month(date)] / 4.0), 1.0), 0.0001) AS prop FROM pix GROUP BY pixel_id, month(date))"


def _avail(spark, d):
    return masks.monthly_availability(X.pixel_obs(spark, d), ["pixel_id"], "date", "value", 7.0, 4)


@_q(f"WITH {_AVAIL} SELECT pixel_id, CAST(month AS INT) AS month, round(prop, 8) AS prop FROM av")
def a5_monthly_availability(spark, d):
    return _avail(spark, d).withColumn("prop", r("prop", 8))


@_q(f"WITH {_AVAIL}, m AS (SELECT pixel_id, CASE WHEN count(DISTINCT month) = 12 THEN min(prop) ELSE 0 END AS low FROM av GROUP BY ALL) SELECT pixel_id, round(low, 8) AS min_prop, CAST(low >= 0.02 AS INT) AS ok FROM m")
def a6_min_month(spark, d):
    return masks.min_month_mask(_avail(spark, d), ["pixel_id"], 0.02).withColumn("min_prop", r("min_prop", 8))


@_q(f"""WITH {_AVAIL}, p AS (SELECT pixel_id, prop / sum(prop) OVER (PARTITION BY pixel_id) AS p, count(*) OVER (PARTITION BY pixel_id) AS n FROM av)
SELECT pixel_id, round(-sum(p * ln(p)) / ln(12), 8) AS evenness FROM p WHERE n = 12 GROUP BY ALL""")
def a7_evenness(spark, d):
    return masks.pielou_evenness(_avail(spark, d), ["pixel_id"]).withColumn("evenness", r("evenness", 8))


_MASK = f"""{_AVAIL}, p AS (SELECT pixel_id, prop / sum(prop) OVER (PARTITION BY pixel_id) AS p, count(*) OVER (PARTITION BY pixel_id) AS n FROM av),
ev AS (SELECT pixel_id, -sum(p * ln(p)) / ln(12) AS evenness FROM p WHERE n = 12 GROUP BY ALL), ab AS (SELECT pixel_id, count(value) / 100.0 AS availability FROM pix GROUP BY ALL)"""


@_q(f"""WITH {_MASK}, {X.LANDCOVER}, lnd AS (SELECT pixel_id, CAST(bool_and(class <> 0) AS INT) + CAST(bool_and(class <= 8 AND class > 0) AS INT) AS land FROM lc GROUP BY ALL)
SELECT lnd.pixel_id, round(availability, 6) AS availability, CAST(coalesce(least(greatest(coalesce(evenness, 0), 0), 1) >= 0.8 AND land > 0 AND availability >= 0.5 AND lnd.pixel_id % 7 <> 0, false) AS INT) AS ok
FROM lnd LEFT JOIN ev USING (pixel_id) LEFT JOIN ab USING (pixel_id)""")
def p15_overall_mask(spark, d):
    obs = X.pixel_obs(spark, d)
    parts = masks.always_class(X.landcover(spark, d), ["pixel_id"], "class", list(range(1, 9)), list(range(9, 17)))
    parts = parts.join(masks.pielou_evenness(_avail(spark, d), ["pixel_id"]), "pixel_id", "left").join(masks.availability(obs, ["pixel_id"], "value", 100), "pixel_id", "left")
    out = masks.overall_mask(parts.withColumn("significant", (F.col("pixel_id") % 7 != 0).cast("int")))
    return out.select("pixel_id", r("availability").alias("availability"), "ok")


@_q(f"""WITH {_MASK}, {X.LANDCOVER}, lnd AS (SELECT pixel_id, CAST(bool_and(class <> 0) AS INT) + CAST(bool_and(class <= 8 AND class > 0) AS INT) AS land FROM lc WHERE year >= 1997 GROUP BY ALL)
SELECT lnd.pixel_id, CAST(land AS INT) AS land, CAST(coalesce(least(greatest(coalesce(evenness, 0), 0), 1) >= 0.5 AND land > 1 AND availability >= 0.3 AND lnd.pixel_id % 7 <> 0, false) AS INT) AS ok
FROM lnd LEFT JOIN ev USING (pixel_id) LEFT JOIN ab USING (pixel_id)""")
def p15_strict_mask(spark, d):
    """Natural cover alone, judged on the last years."""
    cover = scans.class_scan(X.landcover(spark, d), ["pixel_id"], "year", "class", 1997, 9999)
    parts = masks.always_class(cover, ["pixel_id"], "class", list(range(1, 9)), list(range(9, 17)))
    parts = parts.join(masks.pielou_evenness(_avail(spark, d), ["pixel_id"]), "pixel_id", "left").join(masks.availability(X.pixel_obs(spark, d), ["pixel_id"], "value", 100), "pixel_id", "left")
    out = masks.overall_mask(parts.withColumn("significant", (F.col("pixel_id") % 7 != 0).cast("int")), True, 0.5, 0.3)
    return out.select("pixel_id", F.col("land").cast("int").alias("land"), "ok")


def _gram_schmidt(order: list[str]) -> str:
    """Residuals of y and the later regressors on each regressor in turn, by pixel; needs seven observations."""
    t = "2 * pi() * (epoch_ms(ts) - epoch_ms(TIMESTAMP '2000-01-01')) / (365.25 * 86400e3)"
    first = {"t": "t", "s1": "sin(t)", "c1": "cos(t)", "s2": "sin(2 * t)", "c2": "cos(2 * t)"}
    sql = [f"WITH {X.PIXELS}, g AS (SELECT pixel_id, value AS y, {t} AS t, count(*) OVER (PARTITION BY pixel_id) AS n FROM pix)", "z0 AS (SELECT pixel_id, y AS y0, y, " + ", ".join(f"{first[k]} AS {k}" for k in order) + " FROM g WHERE n >= 10)"]
    for i, k in enumerate(order):
        rest = ["y", *order[i + 1 :]] if i < len(order) - 1 else ["y"]
        slopes = ", ".join(f"regr_slope({c}, {k}) OVER w AS b_{c}, regr_intercept({c}, {k}) OVER w AS a_{c}" for c in rest)
        sql.append(f"m{i} AS (SELECT *, {slopes} FROM z{i} WINDOW w AS (PARTITION BY pixel_id))")
        sql.append(f"z{i + 1} AS (SELECT pixel_id, y0, " + ", ".join(f"{c} - a_{c} - b_{c} * {k} AS {c}" for c in rest) + (", b_y AS beta" if i == len(order) - 1 else "") + f" FROM m{i})")
    return ", ".join(sql)


@_q(_gram_schmidt(["t", "c1", "s1", "c2", "s2"]) + " SELECT pixel_id, count(*) AS n, round(1 - var_pop(y) / var_pop(y0), 6) AS r2, round(max(beta), 3) AS sin_2 FROM z5 GROUP BY ALL")
def m1_harmonic_fit(spark, d):
    fit, _ = harmonic.harmonic_fit(X.pixel_obs(spark, d), ["pixel_id"], "ts", "value")
    return fit.where("n >= 10").select("pixel_id", "n", r("r2").alias("r2"), r("sin_2", 3).alias("sin_2"))


@_q()
def m2_harmonic_permutation(spark, d):
    return harmonic.harmonic_permutation_test(X.pixel_obs(spark, d), ["pixel_id"], "ts", "value", n_perm=20)


_CD = "sqrt(2.0 * 364 * greatest(1 - (a.sin_1*b.sin_1 + a.cos_1*b.cos_1 + a.sin_2*b.sin_2 + a.cos_2*b.cos_2) / sqrt((a.sin_1*a.sin_1 + a.cos_1*a.cos_1 + a.sin_2*a.sin_2 + a.cos_2*a.cos_2) * (b.sin_1*b.sin_1 + b.cos_1*b.cos_1 + b.sin_2*b.sin_2 + b.cos_2*b.cos_2)), 0))"


@_q(f"""WITH {X.COEFFS}, p AS (SELECT a.pixel_id, {X.HAV} AS dist, {_CD} AS gap FROM coef a JOIN coef b ON {X.HAV} <= 20000)
SELECT pixel_id, count(*) AS n, CASE WHEN count(*) >= 30 THEN round(regr_r2(gap, dist), 5) END AS r2 FROM p GROUP BY ALL""")
def a17_asynchrony(spark, d):
    out = asynchrony.asynchrony(X.simple_coeffs(spark, d), 20_000.0)
    return out.select("pixel_id", F.col("asynch_n").alias("n"), r("asynch_r2", 5).alias("r2"))


@_q(f"WITH {X.COEFFS} SELECT a.pixel_id, round(stddev_pop(b.constant), 5) AS stat FROM coef a JOIN coef b ON {X.HAV} <= 20000 GROUP BY ALL")
def j15_focal_deviation(spark, d):
    out = focal.focal_grid(X.simple_coeffs(spark, d), 20_000.0, "constant", "stddev", 0.05, 5.025)
    return out.select((F.col("i") * 15 + F.col("j")).alias("pixel_id"), r("stat", 5).alias("stat"))


@_q(f"""WITH {X.COEFFS}, n AS (SELECT a.pixel_id, b.pixel_id % 3 AS c, count(*) AS n FROM coef a JOIN coef b ON {X.HAV} <= 8000 GROUP BY ALL), p AS (SELECT pixel_id, n / sum(n) OVER (PARTITION BY pixel_id) AS p FROM n)
SELECT pixel_id, round(greatest(least(-sum(p * log2(p)), 1.0), 0.0), 6) AS stat FROM p GROUP BY ALL""")
def a11_focal_entropy(spark, d):
    pix = X.simple_coeffs(spark, d).withColumn("cls", F.col("pixel_id") % 3)
    out = focal.focal_grid(pix, 8_000.0, "cls", "entropy", 0.05, 5.025)
    return out.select((F.col("i") * 15 + F.col("j")).alias("pixel_id"), r("stat").alias("stat"))


_GLOBE = """globe AS (SELECT c_custkey * 30011 % 64800 // 360 AS i, c_custkey * 30011 % 360 AS j, avg(c_acctbal) AS v FROM customer GROUP BY ALL),
g AS (SELECT i, j, v, 90 - (i + 0.5) AS lat, j * 1.0 AS lon FROM globe)"""


@_q(f"WITH {_GLOBE} SELECT a.i, a.j, count(*) AS n, round(stddev_pop(b.v), 4) AS stat FROM g a JOIN g b ON {X.HAV} <= 700000 GROUP BY ALL")
def a12_focal_globe(spark, d):
    p = F.col("c_custkey") * 30011 % 64800
    cells = X.table(spark, d, "customer").select(F.floor(p / 360).cast("bigint").alias("i"), (p % 360).alias("j"), "c_acctbal")
    cells = cells.groupBy("i", "j").agg(F.avg("c_acctbal").alias("v"))
    return focal.focal_grid(cells, 700_000.0, "v", "stddev", 1.0, 90.0).withColumn("stat", r("stat", 4))


@_q("""WITH m AS (SELECT l_partkey AS k, l_linenumber AS level, avg(l_extendedprice) AS v FROM lineitem GROUP BY ALL)
SELECT a.level AS level_a, b.level AS level_b, round(regr_r2(b.v, a.v), 6) AS r2, regr_count(b.v, a.v) AS n FROM m a JOIN m b ON a.k = b.k AND a.level < b.level GROUP BY ALL""")
def a19_map_r2(spark, d):
    m = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k"), F.col("l_linenumber").alias("level")).agg(F.avg("l_extendedprice").alias("v"))
    out = asynchrony.map_r2(m.withColumn("one", F.lit(1)), ["k"], ["one"], "level", "v").drop("one")
    return out.withColumns({"r2": r("r2"), "n": F.col("n").cast("bigint")})


@_q("""WITH m AS (SELECT l_partkey AS k, avg(l_extendedprice) AS a, avg(l_quantity) AS b FROM lineitem GROUP BY ALL) SELECT k, round((a - avg(a) OVER ()) / stddev_pop(a) OVER () - (b - avg(b) OVER ()) / stddev_pop(b) OVER (), 6) AS diff FROM m""")
def a20_zscore_difference(spark, d):
    m = X.table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_extendedprice").alias("a"), F.avg("l_quantity").alias("b"))
    return asynchrony.zscore_difference(m, ["k"], "a", "b").withColumn("diff", r("diff"))


@_q(f"""WITH {X.COEFFS} SELECT b.pixel_id AS a, a.pixel_id AS b, round(power((a.sin_1*b.sin_1 + a.cos_1*b.cos_1 + a.sin_2*b.sin_2 + a.cos_2*b.cos_2), 2) / ((a.sin_1*a.sin_1 + a.cos_1*a.cos_1 + a.sin_2*a.sin_2 + a.cos_2*a.cos_2) * (b.sin_1*b.sin_1 + b.cos_1*b.cos_1 + b.sin_2*b.sin_2 + b.cos_2*b.cos_2)), 5) AS r2
FROM coef a JOIN coef b ON a.i = b.i AND a.pixel_id > b.pixel_id""")
def a21_curve_r2(spark, d):
    h = asynchrony.HARMONICS
    c = X.simple_coeffs(spark, d).withColumnRenamed("i", "row")
    return pairs.pair_table(c, ["row"], "pixel_id", {"r2": (h, seasons.curve_r2)}).select(F.col("j").alias("a"), F.col("i").alias("b"), r("r2", 5).alias("r2"))


@_q(f"""WITH {X.cell_means_sql(3)}, {X.POINTS}, spot AS (SELECT id, CAST(floor((5 + 0.025 - lat) / 0.05) AS INT) AS i, CAST(floor((lon + 60 + 0.025) / 0.05) AS INT) AS j FROM pts)
SELECT spot.id, c.i AS cell_i, c.j AS cell_j, CAST(greatest(abs(c.i - spot.i), abs(c.j - spot.j)) AS INT) AS ring FROM spot JOIN cells c ON c.value IS NOT NULL AND abs(c.i - spot.i) <= 2 AND abs(c.j - spot.j) <= 2
QUALIFY row_number() OVER (PARTITION BY spot.id ORDER BY greatest(abs(c.i - spot.i), abs(c.j - spot.j)), md5(concat('0-', c.i, '-', c.j)), c.i, c.j) = 1""")
def j6_nearest_valid(spark, d):
    at = spatial.with_cell(X.points(spark, d), "lon", "lat", 0.05, -60.025, 5.025).select("id", "i", "j")
    out = spatial.nearest_valid(at, X.cell_means(spark, d, 3), "id", "value")
    return out.where("ring is not null").select("id", F.col("cell_i").cast("int").alias("cell_i"), F.col("cell_j").cast("int").alias("cell_j"), "ring")


@_q(f"""WITH {X.POINTS}, t AS (SELECT r_regionkey AS poly, -60.0 + 0.1 * r_regionkey AS x1, 4.25 AS y1, -59.7 + 0.1 * r_regionkey AS x2, 4.31 AS y2, -59.81 + 0.1 * r_regionkey AS x3, 5.01 AS y3 FROM region),
s AS (SELECT id, poly, (x2 - x1) * (lat - y1) - (y2 - y1) * (lon - x1) > 0 AS a, (x3 - x2) * (lat - y2) - (y3 - y2) * (lon - x2) > 0 AS b, (x1 - x3) * (lat - y3) - (y1 - y3) * (lon - x3) > 0 AS c FROM pts, t)
SELECT id, CAST(poly AS INT) AS poly FROM s WHERE a = b AND b = c""")
def j7_points_in_polygons(spark, d):
    k = F.col("r_regionkey") * 0.1
    v = lambda x, y: F.struct((F.lit(x) + k).alias("x"), F.lit(y).alias("y"))
    polys = X.table(spark, d, "region").select(F.col("r_regionkey").cast("int").alias("poly"), F.array(v(-60.0, 4.25), v(-59.7, 4.31), v(-59.81, 5.01)).alias("ring"))
    return polygons.points_in_polygons(X.points(spark, d), polys, "id", "lon", "lat", "poly", "ring")


@_q(f"""WITH {X.cell_means_sql()}, {X.POINTS}, f AS (SELECT id, (lon + 60.025) / 0.05 - 0.5 AS fx, (5.025 - lat) / 0.05 - 0.5 AS fy FROM pts), g AS (SELECT id, fx - floor(fx) AS wx, fy - floor(fy) AS wy, floor(fx) AS j0, floor(fy) AS i0 FROM f),
m AS (SELECT id, (CASE WHEN a = 1 THEN wy ELSE 1 - wy END) * (CASE WHEN b = 1 THEN wx ELSE 1 - wx END) AS w, c.value FROM g CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) o(a, b) LEFT JOIN cells c ON c.i = i0 + a AND c.j = j0 + b)
SELECT id, CASE WHEN count(value) = 4 THEN round(sum(w * value), 3) END AS value FROM m GROUP BY ALL""")
def j14_bilinear(spark, d):
    pts = X.points(spark, d).withColumn("south", -F.col("lat"))
    return spatial.align_bilinear(pts, X.cell_means(spark, d), "id", "lon", "south", "value", 0.05, -60.025, -5.025).withColumn("value", r("value", 3))


@_q(f"""WITH {X.cell_means_sql(4)}, m AS (SELECT g.i, g.j, sum(c.value / sqrt((c.i - g.i) * (c.i - g.i) + (c.j - g.j) * (c.j - g.j))) / sum(1 / sqrt((c.i - g.i) * (c.i - g.i) + (c.j - g.j) * (c.j - g.j))) AS v
FROM cells g JOIN cells c ON g.value IS NULL AND c.value IS NOT NULL AND c.i - g.i BETWEEN -2 AND 1 AND c.j - g.j BETWEEN -2 AND 1 GROUP BY ALL)
SELECT pixel_id, round(coalesce(cells.value, v), 3) AS value FROM cells LEFT JOIN m USING (i, j)""")
def w7_tolerance_fill(spark, d):
    return spatial.tolerance_fill(X.cell_means(spark, d, 4), "value", 2).select("pixel_id", r("value", 3).alias("value"))


@_q("""SELECT r_name AS zone, round(1 - avg(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(c_acctbal > 0 AS INT) END), 6) AS building, round(1 - avg(CASE WHEN c_mktsegment = 'MACHINERY' THEN CAST(c_acctbal > 0 AS INT) END), 6) AS machinery
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def a25_zonal_mean(spark, d):
    c = X.table(spark, d, "customer").join(F.broadcast(X.table(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(X.table(spark, d, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    c = c.select(F.col("r_name").alias("zone"), F.lower("c_mktsegment").alias("layer"), (F.col("c_acctbal") > 0).cast("int").alias("v")).where(F.col("layer").isin("building", "machinery"))
    return spatial.zonal_mean(c, "zone", "layer", "v").select("zone", r("building").alias("building"), r("machinery").alias("machinery"))


@_q("""WITH m AS (SELECT DISTINCT l_orderkey AS k, l_suppkey % 40 AS cell FROM lineitem), a AS (SELECT cell, avg(v) AS mean, count(*) AS n, avg(CAST(v <= 0 AS INT)) AS s0, avg(CAST(v > 0 AND v < 2 AS INT)) AS s1, avg(CAST(v >= 2 AS INT)) AS s2 FROM m JOIN (SELECT o_orderkey AS k, o_custkey % 4 AS v FROM orders) USING (k) GROUP BY ALL)
SELECT cell, round(mean, 6) AS mean, n, round(s0, 6) AS share_0, round(s1, 6) AS share_1, round(s2, 6) AS share_2, round(n / max(n) OVER (), 6) AS scaled FROM a""")
def a26_bin_summary(spark, d):
    feats = X.table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 4).alias("v"))
    cells = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), (F.col("l_suppkey") % 40).alias("cell"))
    out = spatial.bin_summary(feats, cells, "k", "cell", "v")
    return out.select("cell", "n", *[r(c).alias(c) for c in ("mean", "share_0", "share_1", "share_2", "scaled")])


_ZP = f"{X.POINTS}, z AS (SELECT id, grp, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS a, (b - avg(b) OVER w) / stddev_pop(b) OVER w AS b FROM pts WINDOW w AS (PARTITION BY grp))"


@_q(f"WITH {_ZP} SELECT x.grp, x.id AS i, y.id AS j, round(sqrt((x.a - y.a) * (x.a - y.a) + (x.b - y.b) * (x.b - y.b)), 6) AS dist FROM z x JOIN z y ON x.grp = y.grp AND x.id > y.id")
def m6_env_distance(spark, d):
    return pairs.env_distance(X.points(spark, d), ["grp"], "id", ["a", "b"]).withColumn("dist", r("dist"))


_FIT2 = """(SELECT *, x1 / e AS x1_t, x2 / e AS x2_t, r2 / 2 / ((1 - r2) / (m - 3)) AS f FROM (SELECT *, sqrt((1 - r2) / (m - 3) / (1 - c * c)) AS e
FROM (SELECT *, (a - b * c) / (1 - c * c) AS x1, (b - a * c) / (1 - c * c) AS x2, (a * a + b * b - 2 * a * b * c) / (1 - c * c) AS r2 FROM c)))"""
_MMRR = f"""WITH RECURSIVE {X.POINTS}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CAST(id AS VARCHAR)) - 1 AS spot, count(*) OVER (PARTITION BY grp) AS total FROM pts),
base AS (SELECT s.perm, o.grp, o.spot AS place, o.spot, o.total, (s.perm * CAST({stats.PERM_STEP} AS BIGINT)) & {MASK} AS key FROM o, range(1, 1000) s(perm)), {permuted_sql("base", "spot", "total", "key", "perm, grp, place")},
dealt AS (SELECT perm, grp, place, pl FROM walk WHERE done UNION ALL SELECT 0, grp, spot, spot FROM o),
who AS (SELECT d.perm, d.grp, d.place, o.a FROM dealt d JOIN o ON o.grp = d.grp AND o.spot = d.pl),
p AS (SELECT u.perm, u.grp, abs(u.a - v.a) AS y, abs(x.b - z.b) AS x1, abs(x.lon - z.lon) AS x2 FROM who u JOIN who v ON v.perm = u.perm AND v.grp = u.grp AND v.place < u.place JOIN o x ON x.grp = u.grp AND x.spot = u.place JOIN o z ON z.grp = v.grp AND z.spot = v.place),
c AS (SELECT perm, grp, count(*) AS m, corr(y, x1) AS a, corr(y, x2) AS b, corr(x1, x2) AS c FROM p GROUP BY perm, grp),
f AS (SELECT * FROM {_FIT2}), t AS (SELECT * FROM f WHERE perm = 0)
SELECT t.grp, round(t.x1, 6) AS x1, round(t.x2, 6) AS x2, round(t.r2, 6) AS r2, round(t.x1_t, 5) AS x1_t, round(t.x2_t, 5) AS x2_t, round(t.f, 5) AS f,
round(avg(CAST(abs(f.x1_t) >= abs(t.x1_t) * {mmrr_tie} AS INT)), 6) AS x1_p, round(avg(CAST(abs(f.x2_t) >= abs(t.x2_t) * {mmrr_tie} AS INT)), 6) AS x2_p, round(avg(CAST(f.f >= t.f * {mmrr_tie} AS INT)), 6) AS f_p
FROM t JOIN f ON f.grp = t.grp GROUP BY ALL"""


@_q(_MMRR)
def m7_mmrr(spark, d):
    # the order of members, and with it what a permutation deals, is that of their ids as text
    points = X.points(spark, d).withColumn("id", F.col("id").cast("string"))
    y, *xs = (Distance(name, "euclid", (c,)) for name, c in (("y", "a"), ("x1", "b"), ("x2", "lon")))
    out = mmrr_members(points, "grp", "id", y, xs, nperm=999)
    return out.select("grp", *[r(c).alias(c) for c in ("x1", "x2", "r2", "x1_p", "x2_p", "f_p")], *[r(c, 5).alias(c) for c in ("x1_t", "x2_t", "f")])


@_q("""WITH n AS (SELECT l_suppkey % 30 AS s, l_linenumber AS locus, l_partkey % 5 AS allele, CAST(count(*) AS DOUBLE) AS n FROM lineitem WHERE l_partkey % 5 <> 0 GROUP BY ALL), k AS (SELECT DISTINCT locus, allele FROM n), s AS (SELECT DISTINCT s FROM n),
f AS (SELECT s.s, k.locus, k.allele, coalesce(n.n, 0) AS n FROM s CROSS JOIN k LEFT JOIN n ON n.s = s.s AND n.locus = k.locus AND n.allele = k.allele)
SELECT a.s AS i, b.s AS j, round(sqrt(sum((a.n - b.n) * (a.n - b.n))), 6) AS d FROM f a JOIN f b ON a.locus = b.locus AND a.allele = b.allele AND a.s > b.s GROUP BY ALL""")
def m22_allele_distance(spark, d):
    g = X.table(spark, d, "lineitem").select((F.col("l_suppkey") % 30).alias("s"), F.col("l_linenumber").alias("locus"), (F.col("l_partkey") % 5).alias("allele"))
    return pairs.allele_distance(g, "s", "locus", "allele", missing=0).withColumn("d", r("d"))


@_q(f"""WITH {X.HOURLY}, c AS (SELECT s.g, s.h FROM ser s JOIN ser l ON l.g = s.g AND l.h = (s.h + 7) % 24 WHERE s.v = (SELECT min(v) FROM ser x WHERE x.g = s.g) QUALIFY row_number() OVER (PARTITION BY s.g ORDER BY l.v - s.v DESC, s.h) = 1)
SELECT ser.g, ser.h, CAST((ser.h - c.h + 24) % 24 AS BIGINT) AS pos FROM ser JOIN c ON c.g = ser.g""")
def w1_rotate(spark, d):
    return series.rotate_to_min(X.hourly(spark, d), ["g"], "h", "v").select("g", "h", F.col("pos").cast("bigint").alias("pos"))


@_q(f"""WITH {X.HOURLY}, s AS (SELECT g, h, v, CASE WHEN v = lag(v) OVER w THEN 0 ELSE 1 END AS st FROM ser WINDOW w AS (PARTITION BY g ORDER BY h)), u AS (SELECT g, h, v, sum(st) OVER (PARTITION BY g ORDER BY h) AS run FROM s), f AS (SELECT g, run, min(h) AS a, max(h) AS b, min(v) AS v FROM u GROUP BY ALL),
n AS (SELECT *, lag(v) OVER w AS p, lead(v) OVER w AS q FROM f WINDOW w AS (PARTITION BY g ORDER BY run)) SELECT g, CAST(floor((a + b) / 2) AS INT) AS peak, round(v, 5) AS height FROM n WHERE v > p AND v > q""")
def w2_peaks(spark, d):
    return series.find_peaks(X.hourly(spark, d), ["g"], "h", "v").withColumn("height", r("height", 5))


@_q(f"WITH {X.HOURLY}, l AS (SELECT g, v, lag(v) OVER (PARTITION BY g ORDER BY h) AS p FROM ser) SELECT g, round(abs(corr(v, p)), 6) AS acf FROM l WHERE p IS NOT NULL GROUP BY ALL")
def w3_autocorrelation(spark, d):
    return series.lag1_autocorr(X.hourly(spark, d), ["g"], "h", "v").withColumn("acf", r("acf"))


@_q(f"WITH {X.HOURLY}, m AS (SELECT g, quantile_cont(v, 0.5) AS m FROM ser GROUP BY ALL) SELECT g, min(CASE WHEN v > m THEN h END) AS sos FROM ser JOIN m USING (g) GROUP BY ALL")
def w5_start_of_season(spark, d):
    return series.start_of_season(X.hourly(spark, d), ["g"], "h", "v")


@_q(f"""WITH {X.HOURLY}, n AS (SELECT g, h, CAST(floor(v) AS BIGINT) AS n FROM ser WHERE floor(v) > 0), t AS (SELECT g, sum(n) AS t FROM n GROUP BY ALL)
SELECT n.g, CAST(k AS INT) AS k, round(sum(n * exp(-power((k * 0.5 - h) / 2.0, 2) / 2)) / (any_value(t.t) * 2.0 * sqrt(2 * pi())), 8) AS density FROM n JOIN t USING (g), range(0, 47) r(k) GROUP BY ALL""")
def m18_density(spark, d):
    h = X.hourly(spark, d).withColumn("n", F.floor("v")).where("n > 0")
    return series.kde(h, ["g"], "h", "n", 2.0, 0.0, 23.0, 0.5).select("g", "k", r("density", 8).alias("density"))


@_q()
def m18_peak_test(spark, d):
    h = X.hourly(spark, d).withColumn("n", F.floor("v"))
    return series.significant_peaks(series.peak_test(h, ["g"], "h", "n", bw=2.0, n_perm=100, weeks=24))


@_q("""WITH e AS (SELECT o_custkey % 30 AS c, CAST(floor(dayofyear(o_orderdate) / 7) AS INT) AS week FROM orders), n AS (SELECT c, week, count(*) AS n FROM e GROUP BY ALL)
SELECT f.c, CAST(f.week AS INT) AS week, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT c, w.week FROM e, range(0, 53) w(week)) f LEFT JOIN n ON n.c = f.c AND n.week = f.week""")
def m39_weekly_counts(spark, d):
    o = X.table(spark, d, "orders").select((F.col("o_custkey") % 30).alias("c"), seasons.week_bin(F.dayofyear("o_orderdate")).alias("week"))
    return series.weekly_counts(o, ["c"], "week")


@_q(f"""WITH {X.COEFFS}, s AS (SELECT pixel_id, day, constant + sin_1 * sin(w) + cos_1 * cos(w) + sin_2 * sin(2 * w) + cos_2 * cos(2 * w) AS v
  FROM (SELECT *, (day + 1) * (2 * pi() / 365) AS w FROM coef, range(0, 365) x(day))),
z AS (SELECT pixel_id, day, (v - min(v) OVER p) / (max(v) OVER p - min(v) OVER p) AS v FROM s WINDOW p AS (PARTITION BY pixel_id)),
k AS (SELECT a.pixel_id, a.v FROM z a JOIN z b ON b.pixel_id = a.pixel_id AND b.day = (a.day + 1) % 365 JOIN z c ON c.pixel_id = a.pixel_id AND c.day = (a.day + 364) % 365 WHERE a.v > b.v AND a.v > c.v)
SELECT pixel_id, count(*) AS npeaks, CASE WHEN count(*) = 2 THEN round(max(v) - min(v), 5) ELSE 1.0 END AS modality FROM k GROUP BY ALL""")
def m24_modality(spark, d):
    return series.modality(X.simple_coeffs(spark, d), ["pixel_id"]).withColumn("modality", r("modality", 5))


@_q("""WITH p AS (SELECT p_partkey AS k, p_brand AS brand, (p_partkey * 7919 % 1009) / 1009.0 AS p FROM part), q AS (SELECT k, brand, p, rank() OVER (PARTITION BY brand ORDER BY p) + count(*) OVER (PARTITION BY brand, p) - 1 AS rk, count(*) OVER (PARTITION BY brand) AS m FROM p)
SELECT k, round(least(min(p * m / rk) OVER (PARTITION BY brand ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 8) AS p_bh FROM q""")
def w6_bh_adjust(spark, d):
    p = X.table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_brand").alias("brand"), (F.col("p_partkey") * 7919 % 1009 / 1009.0).alias("p"))
    return stats.bh_adjust(p, "p", ["brand"]).select("k", r("p_bh", 8).alias("p_bh"))


@_q("""WITH g AS (SELECT c_mktsegment AS g, count(*) AS n, avg(c_acctbal) AS m, var_pop(c_acctbal) AS v FROM customer GROUP BY ALL), t AS (SELECT count(*) AS k, sum(n) AS n, sum(n * m) AS s, sum(n * m * m) AS ss, sum(n * v) AS w FROM g)
SELECT round(f, 5) AS f, CAST(d1 AS BIGINT) AS df_between, CAST(d2 AS BIGINT) AS df_within, round("""
    + X.f_tail_sql("f", "d1", "d2")
    + """, 6) AS p FROM (SELECT ((ss - s * s / n) / (k - 1)) / (w / (n - k)) AS f, k - 1 AS d1, n - k AS d2 FROM t)""")
def a28_anova(spark, d):
    return stats.anova(X.table(spark, d, "customer"), "c_mktsegment", "c_acctbal").select(r("f", 5).alias("f"), "df_between", "df_within", r("p").alias("p"))


@_q()
def a28_tukey(spark, d):
    return stats.tukey_hsd(X.table(spark, d, "customer"), "c_mktsegment", "c_acctbal").withColumns({c: r(c, 5) for c in ("diff", "q", "p")})


@_q("""WITH c AS (SELECT label AS e, vec_id * 7 % 10 AS f, count(*) AS n FROM embeddings GROUP BY ALL), b AS (SELECT sum(n * (n - 1) / 2) AS b FROM c), x AS (SELECT sum(n * (n - 1) / 2) AS x FROM (SELECT e, sum(n) AS n FROM c GROUP BY ALL)), y AS (SELECT sum(n * (n - 1) / 2) AS y FROM (SELECT f, sum(n) AS n FROM c GROUP BY ALL))
SELECT round(b / (x + y - b), 8) AS jaccard FROM b, x, y""")
def a29_pair_jaccard(spark, d):
    e = X.table(spark, d, "embeddings").select(F.col("label").alias("e"), (F.col("vec_id") * 7 % 10).alias("f"))
    return cluster.pair_jaccard(e, "e", "f").withColumn("jaccard", r("jaccard", 8))


_SLOPE = f"""WITH RECURSIVE b AS (SELECT c_nationkey AS k, avg(c_custkey % 97) AS x, avg(c_acctbal) AS y FROM customer GROUP BY ALL),
i AS (SELECT *, row_number() OVER (ORDER BY md5(CAST(k AS VARCHAR)), k) - 1 AS i, count(*) OVER () AS n FROM b),
base AS (SELECT s.perm, i.x, i.i AS spot, i.n AS total, (s.perm * CAST({stats.PERM_STEP} AS BIGINT)) & {MASK} AS key FROM i, range(0, 1000) s(perm)), {permuted_sql("base", "spot", "total", "key", "perm, x")},
n AS (SELECT w.perm, regr_slope(i.y, w.x) AS s FROM walk w JOIN i ON i.i = w.pl WHERE w.done GROUP BY ALL), t AS (SELECT regr_slope(y, x) AS s FROM b)
SELECT round(t.s, 6) AS slope, round(avg(CAST(n.s >= t.s AS INT)), 6) AS p FROM n, t GROUP BY t.s"""


@_q(_SLOPE)
def m16_permutation_slope(spark, d):
    b = X.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("k")).agg(F.avg(F.col("c_custkey") % 97).alias("x"), F.avg("c_acctbal").alias("y"))
    return stats.permutation_slope_test(b, "k", "x", "y", 1000).select(r("slope").alias("slope"), r("p").alias("p"))


@_q(f"""WITH RECURSIVE {X.POINTS}, near AS (SELECT a.id AS k, b.id AS k2 FROM pts a JOIN pts b ON pow(a.b / 10 - b.b / 10, 2) + pow(a.a / 1000 - b.a / 1000, 2) <= 0.8::DOUBLE * 0.8::DOUBLE),
core AS (SELECT k FROM near GROUP BY k HAVING count(*) >= 4),
reach AS (SELECT k, k AS root FROM core UNION SELECT near.k2, reach.root FROM reach JOIN near USING (k) JOIN core c ON c.k = near.k2),
lab AS (SELECT k, dense_rank() OVER (ORDER BY min(root)) AS label FROM reach GROUP BY k),
edge AS (SELECT near.k, min(label) AS label FROM near JOIN lab ON lab.k = near.k2 GROUP BY near.k)
SELECT id, CAST(coalesce(lab.label, edge.label, 0) AS INT) AS label FROM pts LEFT JOIN lab ON lab.k = id LEFT JOIN edge ON edge.k = id""")
def m13_dbscan(spark, d):
    pts = X.points(spark, d).withColumn("y", F.col("a") / 1000)
    return cluster.dbscan(pts.withColumn("x", F.col("b") / 10), "id", "x", "y", 0.8, 4)


@_q(f"""WITH {X.PIXELS}, c AS (SELECT DISTINCT pixel_id % 4 AS label, i, j FROM pix) SELECT label, count(*) AS n_cells, round(sum(power(pi() / 180 * 6371.008 * 0.05, 2) * cos(radians(5.025 - (i + 0.5) * 0.05))), 4) AS area_km2 FROM c GROUP BY ALL""")
def m40_cell_areas(spark, d):
    c = X.pixel_obs(spark, d).select((F.col("pixel_id") % 4).alias("label"), "i", "j").distinct()
    return cluster.cell_areas(c, "label", 0.05, 5.025).withColumn("area_km2", r("area_km2", 4))


_DISC = "(VALUES " + ", ".join(f"({a}, {b})" for a in range(-2, 3) for b in range(-2, 3) if a * a + b * b <= 4) + ") o(a, b)"


@_q(f"""WITH {X.PIXELS}, c AS (SELECT DISTINCT p % 3 AS label, p // 15 AS i, p % 15 AS j FROM (SELECT o_custkey % 112 * 2 AS p FROM orders)), w AS (SELECT DISTINCT label, i + a AS i, j + b AS j FROM c, {_DISC}), h AS (SELECT label, i + a AS i, j + b AS j, count(*) AS n FROM w, {_DISC} GROUP BY ALL)
SELECT label, CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j FROM h WHERE n = 13""")
def m14_footprint(spark, d):
    # every other cell of the grid has a member
    p = F.col("o_custkey") % 112 * 2
    c = X.table(spark, d, "orders").select((p % 3).alias("label"), F.floor(p / 15).alias("i"), (p % 15).alias("j"))
    return cluster.footprint(c, "label", "i", "j", 2, 0.05, 5.025)


@_q(f"""WITH {X.POINTS}, p AS (SELECT id, radians(lon) * 6371008.0 AS x, sin(radians(lat)) * 6371008.0 AS y FROM pts), q AS (SELECT id, (sqrt(3) / 3 * x - y / 3) / 5000 AS q, (2.0 / 3 * y) / 5000 AS r FROM p), z AS (SELECT id, round_even(q, 0) AS rq, round_even(r, 0) AS rr, round_even(-q - r, 0) AS rs, q, r FROM q),
f AS (SELECT *, abs(rq - q) > abs(rr - r) AND abs(rq - q) > abs(rs + q + r) AS fq, abs(rr - r) > abs(rs + q + r) AS fr FROM z)
SELECT id, CAST(CASE WHEN fq THEN -rr - rs ELSE rq END AS BIGINT) AS q, CAST(CASE WHEN NOT fq AND fr THEN -rq - rs ELSE rr END AS BIGINT) AS r FROM f""")
def m17_hex_cells(spark, d):
    return X.points(spark, d).select("id", hex_cell(F.col("lon"), F.col("lat"), 5000.0).alias("h")).select("id", "h.q", "h.r")


@_q("WITH c AS (SELECT quantile_cont(c_acctbal, 0.95) AS c FROM customer) SELECT c_custkey, c_acctbal FROM customer, c WHERE c_acctbal >= c")
def p22_percentile_filter(spark, d):
    return clean.percentile_filter(X.table(spark, d, "customer"), "c_acctbal", 0.95).select("c_custkey", "c_acctbal")


@_q("""WITH c AS (SELECT quantile_cont(p_retailprice, 0.25) AS a, quantile_cont(p_retailprice, 0.5) AS b, quantile_cont(p_retailprice, 0.75) AS c FROM part), s AS (SELECT p_partkey, CAST(p_retailprice > a AS INT) + CAST(p_retailprice > b AS INT) + CAST(p_retailprice > c AS INT) AS s FROM part, c)
SELECT p_partkey, CAST(row_number() OVER (PARTITION BY s ORDER BY md5(concat('0-', p_partkey)), p_partkey) <= round(count(*) OVER (PARTITION BY s) * 0.6) AS INT) AS train FROM s""")
def t6_stratified_split(spark, d):
    return attribution.stratified_split(X.table(spark, d, "part"), "p_partkey", "p_retailprice", 0.6).select("p_partkey", "train")


@_q("""WITH e AS (SELECT min(p_retailprice) AS a, max(p_retailprice) AS b FROM part), s AS (SELECT p_partkey, coalesce(least(floor((p_retailprice - a) / ((b - a) / 5)), 4), 0) AS s FROM part, e)
SELECT p_partkey, CAST(s AS BIGINT) AS stratum FROM s QUALIFY row_number() OVER (PARTITION BY s ORDER BY md5(concat('0-', p_partkey)), p_partkey) <= round(count(*) OVER (PARTITION BY s) * 0.25)""")
def t7_stratified_sample(spark, d):
    return attribution.stratified_sample(X.table(spark, d, "part"), "p_partkey", "p_retailprice").select("p_partkey", F.col("stratum").cast("bigint").alias("stratum"))


@_q("SELECT p_partkey, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 6) AS price, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 6) AS size FROM part")
def a33_standardise(spark, d):
    p = X.table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return attribution.standardise(p, ["price", "size"]).select("p_partkey", r("price").alias("price"), r("size").alias("size"))


@_q("""SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'rmse' ELSE o_orderpriority END AS variable, round(max(CASE WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN sqrt(v) ELSE v END END), 4) AS f_1, round(max(CASE WHEN o_orderstatus = 'O' THEN CASE WHEN o_orderpriority = '1-URGENT' THEN sqrt(v) ELSE v END END), 4) AS o_1
FROM (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus IN ('F', 'O') GROUP BY ALL) GROUP BY 1""")
def a31_summary_pivot(spark, d):
    t = X.table(spark, d, "orders").where(F.col("o_orderstatus").isin("F", "O")).groupBy(F.lower("o_orderstatus").alias("ds"), F.lit(1).alias("rad"), F.col("o_orderpriority").alias("variable")).agg(F.avg("o_totalprice").alias("v"))
    out = attribution.model_summary_pivot(t, "ds", "rad", "variable", "v", error="1-URGENT")
    return out.select("variable", r("f_1", 4).alias("f_1"), r("o_1", 4).alias("o_1"))


@_q("""WITH a AS (SELECT l_partkey AS k, avg(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_partkey AS k, avg(l_extendedprice) AS v FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
SELECT coalesce(a.k, b.k) AS k, round(a.v, 4) AS v_a, round(b.v, 4) AS v_r FROM a FULL OUTER JOIN b ON a.k = b.k""")
def j12_merge_evals(spark, d):
    a, b = (X.table(spark, d, "lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_partkey").alias("k")).agg(F.avg("l_extendedprice").alias("v")) for f in ("A", "R"))
    return evaluate.merge_evals(a, b, ["k"], ["v"], ("a", "r")).select("k", r("v_a", 4).alias("v_a"), r("v_r", 4).alias("v_r"))


@_q("""SELECT o_custkey AS id, o_orderkey, o_totalprice AS len FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1""")
def a32_longest(spark, d):
    return evaluate.longest_per_id(X.table(spark, d, "orders").select(F.col("o_custkey").alias("id"), "o_orderkey", F.col("o_totalprice").alias("len")), "id", "len")


@_q("""WITH s AS (SELECT user_id % 50 AS site, CAST(ts AS DATE) AS date, event_type, avg(value) AS v FROM events WHERE day(ts) IN (1, 16) GROUP BY ALL), p AS (SELECT a.site, a.v AS a, b.v AS b FROM s a JOIN s b ON a.site = b.site AND a.date = b.date AND a.event_type = 'click' AND b.event_type = 'view')
SELECT round(sum(a * b) / sum(b * b), 6) AS slope, round(1 - sum((a - sl * b) * (a - sl * b)) / sum(a * a), 6) AS r2, count(*) AS n FROM p, (SELECT sum(a * b) / sum(b * b) AS sl FROM p)""")
def a30_product_agreement(spark, d):
    s = X.table(spark, d, "events").groupBy((F.col("user_id") % 50).alias("site"), F.to_date("ts").alias("date"), "event_type").agg(F.avg("value").alias("v"))
    p = evaluate.half_month_pairs(s.where("event_type = 'click'"), s.where("event_type = 'view'"), ["site"], "date", "v")
    return evaluate.product_agreement(p, "site")[1].select(r("slope").alias("slope"), r("r2").alias("r2"), F.col("n").cast("bigint").alias("n"))


@_q(f"""WITH {X.POINTS}, {X.PIXELS}, g AS (SELECT DISTINCT CAST(j AS BIGINT) AS j, CAST(i AS BIGINT) AS i FROM pix), f AS (SELECT lon AS x, -lat AS y FROM pts)
SELECT i, j FROM g WHERE NOT EXISTS (SELECT 1 FROM f WHERE g.i BETWEEN floor((y - 0.02 + 5.025) / 0.05) AND ceil((y + 0.02 + 5.025) / 0.05) - 1 AND g.j BETWEEN floor((x - 0.02 + 60.025) / 0.05) AND ceil((x + 0.02 + 60.025) / 0.05) - 1)""")
def m26_coverage_gaps(spark, d):
    grid = X.pixel_obs(spark, d).select(F.col("i").cast("bigint").alias("i"), F.col("j").cast("bigint").alias("j")).distinct()
    f = X.points(spark, d).select(F.array("lon").alias("lon"), F.array(-F.col("lat")).alias("lat"))
    return evaluate.coverage_gaps(grid, f, -60.025, -5.025, 0.05, 0.02)


@_q(f"""WITH {X.PIXELS}, p AS (SELECT round(-60 + 0.05 * (k % 15), 3) AS x, round(5 - 0.05 * (k // 15), 3) AS y, avg(v) AS v FROM (SELECT o_custkey % 75 * 3 AS k, o_totalprice AS v FROM orders) GROUP BY ALL), b AS (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM p),
sx AS (SELECT min(d) AS s FROM (SELECT round(x - lag(x) OVER (ORDER BY x), 3) AS d FROM (SELECT DISTINCT x FROM p)) WHERE d > 0), sy AS (SELECT min(d) AS s FROM (SELECT round(y - lag(y) OVER (ORDER BY y), 3) AS d FROM (SELECT DISTINCT y FROM p)) WHERE d > 0),
c AS (SELECT round(x0 + j * sx.s, 3) AS x, round(y0 + i * sy.s, 3) AS y FROM b, sx, sy, range(0, 15) i(i), range(0, 15) j(j) WHERE round(x0 + j * sx.s, 3) <= x1 AND round(y0 + i * sy.s, 3) <= y1) SELECT CAST(c.x AS DOUBLE) AS x, CAST(c.y AS DOUBLE) AS y, round(p.v, 3) AS value FROM c LEFT JOIN p ON p.x = c.x AND p.y = c.y""")
def s12_grid_from_points(spark, d):
    # every third cell of the grid has points
    k = F.col("o_custkey") % 75 * 3
    p = X.table(spark, d, "orders").select((-60 + 0.05 * (k % 15)).alias("lon"), (5 - 0.05 * F.floor(k / 15)).alias("lat"), F.col("o_totalprice").alias("value"))
    return tables.grid_from_points(p, "lon", "lat", "value").select("x", "y", r("value", 3).alias("value"))


@_q("SELECT o_orderstatus AS status, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) GROUP BY ALL")
def s14_resume(spark, d):
    done = X.table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"))
    return tables.resume(X.table(spark, d, "orders"), done, ["o_custkey"]).groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n"))


@_q("SELECT c_custkey, c_nationkey FROM customer QUALIFY count(*) OVER (PARTITION BY c_nationkey) >= 50 AND row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 20")
def p18_quota(spark, d):
    return clean.capped_groups(X.table(spark, d, "customer"), "c_nationkey", [F.desc("c_acctbal"), F.col("c_custkey")], 50, 20).select("c_custkey", "c_nationkey")


@_q("WITH c AS (SELECT quantile_cont(c_acctbal, 0.05) AS a, quantile_cont(c_acctbal, 0.95) AS b FROM customer) SELECT c_custkey, round(greatest(least((c_acctbal - a) / (b - a), 1), 0), 8) AS v FROM customer, c")
def w11_percentile_clip(spark, d):
    return series.percentile_clip(X.table(spark, d, "customer").select("c_custkey", F.col("c_acctbal").alias("v")), "v", 0.05, 0.95).withColumn("v", r("v", 8))


@_q()
def m8_eof(spark, d):
    bands, _ = eof.eof(X.simple_coeffs(spark, d), ["pixel_id"])
    return bands.select("pixel_id", *[r(f"eof{k}", 5).alias(f"eof{k}") for k in range(4)])


@_q()
def m10_kmeans(spark, d):
    out, _, _ = cluster.kmeans(X.simple_coeffs(spark, d), asynchrony.HARMONICS, 4)
    return cluster.relabel_by(out, "label", "lat").select("pixel_id", "label")


_RF = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _forest(spark, d):
    rows = X.table(spark, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("k"), "l_extendedprice", *[F.col(c).cast("double").alias(c) for c in _RF])
    rows = attribution.standardise(rows, ["l_extendedprice", *_RF])
    # read many times: by the fit, the counts and the scores
    split = materialise(attribution.stratified_split(materialise(rows, "rows"), "k", "l_extendedprice", 0.6), "split")
    train, test = split.where("train = 1"), split.where("train = 0")
    return attribution.fit_forest(train, "l_extendedprice", _RF, trees=50, mtry=2, depth=8), test


@_q()
def m31_permutation_importance(spark, d):
    model, test = _forest(spark, d)
    return attribution.permutation_importance(model, test, "k", "l_extendedprice", _RF)


@_q()
def m32_shap(spark, d):
    model, test = _forest(spark, d)
    return attribution.shap_importance(attribution.shap_sample(model, test, test, "k", _RF))
