"""Registered queries of cleaning, selection, season and result-table operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from seasonlark.functions import seasons
from seasonlark.functions.geo import dms_to_degrees
from seasonlark.operators import asynchrony, clean, masks, records, series, spatial, stats
from seasonlark.plans import fixtures as X
from seasonlark.plans.registry import _CD, _q, r
from seasonlark.scratch import new_path
from seasonlark.sources import tables
from seasonlark.steps import Steps


@_q("SELECT l_orderkey AS parcel FROM lineitem GROUP BY ALL HAVING max(CAST(l_quantity >= 50 AS INT)) = 0")
def p5_never_flagged(spark, d):
    df = X.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("parcel"), (F.col("l_quantity") >= 50).cast("int").alias("water"))
    return clean.never_flagged(df, ["parcel"], "water")


@_q(f"WITH {X.POINTS} SELECT id FROM pts WHERE lon BETWEEN -59.8 AND -59.5 AND lat BETWEEN 4.5 AND 4.9")
def p17_bounding_box(spark, d):
    return clean.bounding_box(X.points(spark, d), "lon", "lat", (-59.8, 4.5, -59.5, 4.9)).select("id")


@_q(f"WITH {X.LANDCOVER} SELECT CAST(class % 3 AS BIGINT) AS variable, count(*) AS n FROM lc WHERE class % 3 = 2 OR pixel_id % 4 <> 0 GROUP BY ALL")
def p16_apply_mask(spark, d):
    lc = X.landcover(spark, d).withColumn("variable", (F.col("class") % 3).cast("bigint"))
    mask = lc.select("pixel_id", (F.col("pixel_id") % 4 != 0).cast("int").alias("ok"))
    return masks.apply_mask(lc, mask, ["pixel_id"], "variable", [0, 1]).groupBy("variable").agg(F.count("*").alias("n"))


@_q("SELECT CAST(l_linenumber - 2 AS BIGINT) AS doy, count(*) AS n FROM lineitem WHERE l_linenumber >= 2 AND l_quantity < 12 GROUP BY ALL")
def p19_sample_size(spark, d):
    df = X.table(spark, d, "lineitem").select((F.col("l_linenumber") - 2).cast("bigint").alias("doy"), "l_quantity")
    return clean.sample_size_filter(df, "doy", "l_quantity", 12).groupBy("doy").agg(F.count("*").alias("n"))


@_q("""SELECT l_returnflag AS site, count(*) AS n, round(avg(l_extendedprice), 4) AS gpp FROM lineitem
WHERE l_quantity / 50.0 >= 0.71 AND l_linenumber <> 7 AND CAST(l_shipdate AS DATE) BETWEEN DATE '1994-01-01' AND DATE '1996-12-31' GROUP BY ALL""")
def p21_flux_filter(spark, d):
    df = X.table(spark, d, "lineitem").select(
        F.col("l_returnflag").alias("site"), F.when(F.col("l_linenumber") == 7, -9999.0).otherwise(F.col("l_extendedprice")).alias("gpp"),
        (F.col("l_quantity") / 50.0).alias("qc"), F.to_date("l_shipdate").alias("day"),
    )
    days = clean.flux_filter(df, "gpp", "qc", "day", 0.71, between=("1994-01-01", "1996-12-31"))
    return days.groupBy("site").agg(F.count("*").alias("n"), r(F.avg("gpp"), 4).alias("gpp"))


@_q(f"WITH {X.POINTS} SELECT grp, round(min(lat), 6) AS lat_min, round(max(lat), 6) AS lat_max FROM pts GROUP BY grp HAVING min(lat) <= 4.8 AND max(lat) >= 4.9")
def p26_extreme_range(spark, d):
    out = clean.extreme_range(X.points(spark, d), "grp", "lat", 4.8, 4.9)
    return out.select("grp", r("lat_min").alias("lat_min"), r("lat_max").alias("lat_max"))


@_q("""SELECT CAST(o_orderdate AS DATE) AS day, round(avg(-(o_orderkey % 90 + (o_custkey % 60) / 60.0 + (o_orderkey % 60) / 3600.0)), 6) AS lon FROM orders GROUP BY ALL""")
def p24_dms(spark, d):
    deg, minutes, seconds = (c.cast("double") for c in (F.col("o_orderkey") % 90, F.col("o_custkey") % 60, F.col("o_orderkey") % 60))
    df = X.table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day"), dms_to_degrees(deg, minutes, seconds).alias("lon"))
    return df.groupBy("day").agg(r(F.avg("lon")).alias("lon"))


@_q("SELECT c_nationkey AS nation, round(avg((c_acctbal + (c_acctbal + c_custkey % 10)) / 2), 4) AS tmean FROM customer GROUP BY ALL")
def p10_mean_temperature(spark, d):
    c = F.col("c_acctbal")
    return X.table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(r(F.avg(records.mean_temperature(c, c + F.col("c_custkey") % 10)), 4).alias("tmean"))


@_q("SELECT DISTINCT o_orderpriority AS taxon, o_custkey AS id FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')")
def p20_select_taxa(spark, d):
    df = X.table(spark, d, "orders").select(F.col("o_orderpriority").alias("taxon"), F.col("o_custkey").alias("id"))
    return records.select_taxa(df, "taxon", ["1-URGENT", "2-HIGH"], "id")


@_q("SELECT CASE WHEN trim(source) = 'web' THEN 'site' ELSE trim(source) END AS source, count(*) AS n FROM documents GROUP BY ALL")
def p25_repair_key(spark, d):
    df = X.table(spark, d, "documents").select(F.concat(F.lit("  "), "source", F.lit(" ")).alias("source"))
    return df.groupBy(records.repair_key(F.col("source"), {"web": "site"}).alias("source")).agg(F.count("*").alias("n"))


@_q("""SELECT c_custkey AS id, count(o_orderkey) AS n FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') o ON o_custkey = c_custkey GROUP BY ALL""")
def j13_attributes(spark, d):
    o = X.table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), "o_orderkey")
    met = records.with_attributes(o, X.table(spark, d, "customer").select(F.col("c_custkey").alias("id")), ["id"], "right")
    return met.groupBy("id").agg(F.count("o_orderkey").alias("n"))


@_q(f"WITH {X.POINTS} SELECT grp, count(*) AS n, round(avg(lon), 8) AS lon, round(avg(lat), 8) AS lat FROM pts GROUP BY ALL")
def a24_group_centroid(spark, d):
    return records.group_centroid(X.points(spark, d), "grp", "lon", "lat").withColumns({c: r(c, 8) for c in ("lon", "lat")})


@_q("SELECT l_returnflag AS flag, round(avg(CAST(l_linenumber % 5 = 0 AS INT)), 8) AS missing_a, round(avg(CAST(l_quantity > 40 AS INT)), 8) AS missing_b FROM lineitem GROUP BY ALL")
def a34_share_missing(spark, d):
    df = X.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("flag"), F.when(F.col("l_linenumber") % 5 != 0, 1).alias("a"), F.when(F.col("l_quantity") <= 40, 1).alias("b"))
    out = records.share_missing(df, ["flag"], ["a", "b"])
    return out.withColumns({c: r(c, 8) for c in ("missing_a", "missing_b")})


@_q("SELECT key, count(*) AS n FROM (SELECT o_custkey AS key FROM orders UNION ALL SELECT c_custkey FROM customer) GROUP BY ALL")
def u1_checked_union(spark, d):
    a = X.table(spark, d, "orders").select(F.lit("o").alias("kind"), F.col("o_custkey").alias("key"))
    b = X.table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.lit("c").alias("kind"))
    return records.checked_union([a, b]).groupBy("key").agg(F.count("*").alias("n"))


@_q("SELECT l_partkey % 225 AS cell, min(l_orderkey * 10 + l_linenumber) AS first FROM lineitem GROUP BY ALL")
def u3_distinct(spark, d):
    df = X.table(spark, d, "lineitem").select((F.col("l_partkey") % 225).alias("cell"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("first"))
    return records.distinct_by(df, ["cell"], ["first"])


@_q("""WITH c AS (SELECT c_nationkey AS label, c_custkey AS id, c_acctbal AS a, CAST(c_custkey % 97 AS DOUBLE) AS b FROM customer),
m AS (SELECT label, avg(a) AS ma, avg(b) AS mb FROM c GROUP BY ALL), g AS (SELECT label, id, sqrt((a - ma) * (a - ma) + (b - mb) * (b - mb)) AS dist FROM c JOIN m USING (label))
SELECT label, id, round(dist, 5) AS dist, row_number() OVER (PARTITION BY label ORDER BY dist, id) AS rank FROM g QUALIFY rank <= 50""")
def t2_nearest_to_centre(spark, d):
    df = X.table(spark, d, "customer").select(F.col("c_nationkey").alias("label"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("a"), (F.col("c_custkey") % 97).cast("double").alias("b"))
    out = records.nearest_to_centre(df, "label", ["a", "b"], 50, "id")
    return out.select("label", "id", r("dist", 5).alias("dist"), F.col("rank").cast("bigint").alias("rank"))


@_q(f"""WITH {X.PIXELS}, cells AS (SELECT DISTINCT pixel_id, i, j, lat, lon FROM pix),
nb AS (SELECT a.pixel_id, a.i, count(b.pixel_id) AS n FROM cells a LEFT JOIN cells b ON {X.HAV} <= 12000 GROUP BY ALL) SELECT i, max(n) AS expected FROM nb GROUP BY ALL""")
def a18_expected_neighbours(spark, d):
    cells = X.pixel_obs(spark, d).select("pixel_id", "i", "lat", "lon").distinct()
    near = spatial.neighbour_pairs(cells, 12000.0, [], "pixel_id", "lon", "lat", [])
    return records.expected_neighbours(cells, near, "pixel_id", "i")


_P = "((s_suppkey * 7919) % 10007) / 10007.0"


@_q(f"""WITH f AS (SELECT s_nationkey AS cell, s_acctbal AS slope, {_P} AS r2, pow({_P}, 3) AS p FROM supplier),
k AS (SELECT *, count(*) OVER (PARTITION BY cell) AS m, rank() OVER (PARTITION BY cell ORDER BY p DESC) AS up FROM f),
b AS (SELECT *, least(min(p * m / (m - up + 1)) OVER (PARTITION BY cell ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1) AS adj FROM k)
SELECT cell, count(*) AS n, round(avg(slope), 4) AS slope, round(avg(r2), 6) AS r2, round(avg(CAST(p <= 0.05 AS INT)), 6) AS share, round(avg(CAST(adj <= 0.05 AS INT)), 6) AS share_adjusted FROM b GROUP BY ALL""")
def a27_hex_summary(spark, d):
    u = (F.col("s_suppkey") * 7919) % 10007 / 10007.0
    fits = X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("cell"), F.col("s_acctbal").alias("slope"), u.alias("r2"), F.pow(u, F.lit(3)).alias("p"))
    out = records.hex_summary(fits, "cell", "slope", "r2", "p")
    return out.withColumns({"slope": r("slope", 4), "r2": r("r2"), "share": r("share"), "share_adjusted": r("share_adjusted")})


@_q(f"SELECT s_nationkey AS nation, CAST(sum(CAST(p <= 0.05 / m AS INT)) AS BIGINT) AS significant FROM (SELECT s_nationkey, {_P} * 0.02 AS p, count(*) OVER () AS m FROM supplier) GROUP BY ALL")
def a36_bonferroni(spark, d):
    u = (F.col("s_suppkey") * 7919) % 10007 / 10007.0 * 0.02
    out = stats.bonferroni(X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), u.alias("p")), "p")
    return out.groupBy("nation").agg(F.sum("significant").cast("bigint").alias("significant"))


@_q("SELECT k, min(day) AS day FROM (SELECT o_custkey % 20 AS k, CAST(o_orderdate AS DATE) AS day FROM orders) GROUP BY k, dayofyear(day)")
def w8_first_per_doy(spark, d):
    df = X.table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("k"), F.to_date("o_orderdate").alias("day")).distinct()
    return series.first_per_doy(df, ["k"], "day")


@_q(f"""WITH {X.COEFFS}, o AS (SELECT pixel_id, value, least(dayofyear(date), 365) * (2 * pi() / 365) AS w FROM pix)
SELECT pixel_id, count(*) AS n, round(avg(value / 10000.0), 6) AS raw, round(avg(constant + sin_1 * sin(w) + cos_1 * cos(w) + sin_2 * sin(2 * w) + cos_2 * cos(2 * w)), 5) AS fitted FROM o JOIN coef USING (pixel_id) GROUP BY ALL""")
def m38_raw_vs_fitted(spark, d):
    coeffs = X.simple_coeffs(spark, d).drop("i", "j", "lat", "lon")
    out = series.raw_vs_fitted(X.pixel_obs(spark, d), coeffs, ["pixel_id"], "date", "value")
    return out.groupBy("pixel_id").agg(F.count("*").alias("n"), r(F.avg("raw")).alias("raw"), r(F.avg("fitted"), 5).alias("fitted"))


@_q(f"""WITH {X.HOURLY}, s AS (SELECT g, h, v, max(v) OVER (PARTITION BY g ORDER BY h ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS m FROM ser),
f AS (SELECT g, CAST(min(h) AS BIGINT) AS first_peak FROM s WHERE v = m GROUP BY g) SELECT g, first_peak, row_number() OVER (ORDER BY first_peak, g) AS rank FROM f""")
def w14_order_by_first_peak(spark, d):
    out = series.order_by_first_peak(X.hourly(spark, d), "g", "h", "v", 2)
    return out.select("g", F.col("first_peak").cast("bigint").alias("first_peak"), F.col("rank").cast("bigint").alias("rank"))


@_q(f"""WITH {X.PIXELS}, c AS (SELECT DISTINCT j AS x, i AS y FROM pix), l AS (SELECT DISTINCT x, 7.0 + x % 3 AS line_y FROM c),
m AS (SELECT c.x, y, line_y, CAST(abs(y - line_y) <= 3 AS INT) AS inside FROM c JOIN l USING (x)),
k AS (SELECT x, y, CASE WHEN inside = 1 THEN 1 - row_number() OVER (PARTITION BY x, inside ORDER BY y DESC) / (count(*) OVER (PARTITION BY x, inside) + 1.0) WHEN y > line_y THEN 1.0 ELSE 0.0 END AS w FROM m)
SELECT x, y, round(w, 6) AS w, round(w * (x + y) / 28.0 + (1 - w) * (1 - (x + y) / 28.0), 6) AS e FROM k""")
def w13_season_ramp(spark, d):
    cells = X.pixel_obs(spark, d).select(F.col("j").alias("x"), F.col("i").alias("y")).distinct()
    line = cells.select("x", (F.col("x") % 3 + 7.0).alias("line_y")).distinct()
    ramp = series.season_ramp(cells, line, 3.0).withColumn("e", (F.col("x") + F.col("y")) / 28.0)
    return series.fold(ramp, "w", ["e"]).select("x", "y", r("w").alias("w"), r("e").alias("e"))


@_q("SELECT s_nationkey AS nation, s_suppkey AS id FROM supplier QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) <= 3")
def t3_first_per_key(spark, d):
    df = X.table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"), F.col("s_suppkey").alias("id"), "s_acctbal")
    return spatial.first_per_key(df, "nation", 3, F.desc("s_acctbal"), F.col("id")).select("nation", "id")


@_q("SELECT regexp_extract(url, 'https?://([^/]+)', 1) AS host, count(*) AS n FROM pages GROUP BY ALL")
def s9_key_from_name(spark, d):
    return X.table(spark, d, "pages").groupBy(tables.key_from_name(F.col("url"), "https?://([^/]+)").alias("host")).agg(F.count("*").alias("n"))


@_q(f"""WITH {X.COEFFS}, a AS (SELECT * FROM coef), b AS (SELECT * FROM coef)
SELECT a.pixel_id AS a, b.pixel_id AS b, round(sqrt(365 * pow(a.constant - b.constant, 2) + 365 / 2.0 * (pow(a.sin_1 - b.sin_1, 2) + pow(a.cos_1 - b.cos_1, 2) + pow(a.sin_2 - b.sin_2, 2) + pow(a.cos_2 - b.cos_2, 2))), 5) AS dist
FROM a JOIN b ON a.i = b.i AND a.j <> b.j""")
def f7_raw_curve_distance(spark, d):
    names = ["sin_1", "cos_1", "sin_2", "cos_2"]
    c = X.simple_coeffs(spark, d)
    a = c.select("i", F.col("pixel_id").alias("a"), *[F.col(n).alias(f"a_{n}") for n in ["constant", *names]])
    b = c.select("i", F.col("pixel_id").alias("b"), *[F.col(n).alias(f"b_{n}") for n in ["constant", *names]])
    dist = seasons.raw_curve_distance(F.col("a_constant"), [F.col(f"a_{n}") for n in names], F.col("b_constant"), [F.col(f"b_{n}") for n in names])
    return a.join(b, "i").where("a <> b").select("a", "b", r(dist, 5).alias("dist"))


def _radii_sql() -> str:
    n = "regr_count(gap, dist)"
    sums = f"{n} AS n, regr_slope(gap, dist) AS slope, regr_r2(gap, dist) AS r2"
    error = "sqrt(greatest(regr_syy(gap, dist) - regr_slope(gap, dist) * regr_sxy(gap, dist), 0) / nullif(n_2, 0) / regr_sxx(gap, dist))".replace("n_2", f"({n} - 2)")
    return f"""WITH {X.COEFFS}, v AS (SELECT 'all' AS variable, * FROM coef UNION ALL SELECT 'upper', * FROM coef WHERE i < 9),
p AS (SELECT a.variable, a.pixel_id, {X.HAV} AS dist, {_CD} AS gap FROM v a JOIN v b ON a.variable = b.variable AND {X.HAV} <= 25000),
f AS (SELECT variable, pixel_id, radius_m, {sums}, regr_slope(gap, dist) / {error} AS t FROM p JOIN (VALUES (10000.0), (18000.0), (25000.0)) x(radius_m) ON dist <= radius_m GROUP BY ALL),
q AS (SELECT *, {X.t_tail_sql('t', '(n - 2)')} AS pv FROM f WHERE n >= 30)
SELECT f.variable, f.pixel_id, CAST(f.radius_m AS DOUBLE) AS radius_m, f.n, CASE WHEN q.pv < 0.01 THEN round(q.slope * 1000, 4) WHEN q.pv IS NOT NULL THEN 0.0 END AS asynch, round(q.r2, 5) AS r2, round(q.pv, 6) AS p
FROM f LEFT JOIN q USING (variable, pixel_id, radius_m)"""


@_q(_radii_sql())
def m5_asynchrony_radii(spark, d):
    c = X.simple_coeffs(spark, d)
    both = c.withColumn("variable", F.lit("all")).unionByName(c.where("i < 9").withColumn("variable", F.lit("upper")))
    out = asynchrony.asynchrony_radii(both, [10_000.0, 18_000.0, 25_000.0], ["variable"])
    return out.select("variable", "pixel_id", "radius_m", F.col("asynch_n").alias("n"), r(F.col("asynch") * 1000, 4).alias("asynch"), r("asynch_r2", 5).alias("r2"), r("asynch_pval").alias("p"))


@_q(f"""WITH {X.COEFFS}, {X.POINTS}, h AS (SELECT id, CAST(floor((5 - lat) / 0.05) AS INT) AS i, CAST(floor((lon + 60) / 0.05) AS INT) AS j FROM pts),
s AS (SELECT id, CAST(day AS INT) AS day, constant + sin_1 * sin(w) + cos_1 * cos(w) + sin_2 * sin(2 * w) + cos_2 * cos(2 * w) AS v
  FROM (SELECT h.id, coef.*, day, (day + 1) * (2 * pi() / 365) AS w FROM h LEFT JOIN coef USING (i, j), range(0, 365) x(day)))
SELECT id, count(v) AS n, round(max(z), 5) AS high, round(min(z), 5) AS low, round(avg(z * day), 3) AS moment
FROM (SELECT *, (v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0) AS z FROM s WINDOW w AS (PARTITION BY id)) GROUP BY id""")
def m4_curves_at_points(spark, d):
    out = series.curves_at_points(X.points(spark, d), X.simple_coeffs(spark, d), "id", "lon", "lat", 0.05, -60.0, 5.0, standardise=True)
    return out.groupBy("id").agg(F.count("value").alias("n"), r(F.max("value"), 5).alias("high"), r(F.min("value"), 5).alias("low"), r(F.avg(F.col("value") * F.col("day")), 3).alias("moment"))


@_q(f"WITH {X.COEFFS} SELECT pixel_id, round(constant, 6) AS constant, round(sin_1, 6) AS sin_1, round(cos_1, 6) AS cos_1 FROM coef")
def s15_stored_step(spark, d):
    steps = Steps(spark, new_path(spark, "steps"))
    build = lambda: X.simple_coeffs(spark, d)
    for _ in range(2):
        out = steps.get("coefficients", build, [f"{d}/orders.parquet"], {"harmonics": 2})
    return out.select("pixel_id", *[r(c).alias(c) for c in ("constant", "sin_1", "cos_1")])
