"""Pixels, series and points that the registered queries derive from the given tables."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def pixel_obs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as observations of a 15 x 15 grid."""
    p = F.col("o_custkey") % 225
    row, col = F.floor(p / 15).cast("int"), (p % 15).cast("int")
    return table(spark, d, "orders").select(
        p.alias("pixel_id"), row.alias("i"), col.alias("j"), (5 - 0.05 * row).alias("lat"), (-60 + 0.05 * col).alias("lon"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.to_date("o_orderdate").alias("date"), F.col("o_totalprice").alias("value"), "o_orderkey",
    )


PIXELS = """pix AS (
  SELECT o_custkey % 225 AS pixel_id, CAST((o_custkey % 225) // 15 AS INT) AS i, CAST((o_custkey % 225) % 15 AS INT) AS j,
         5 - 0.05 * ((o_custkey % 225) // 15) AS lat, -60 + 0.05 * ((o_custkey % 225) % 15) AS lon,
         o_orderdate AS ts, CAST(o_orderdate AS DATE) AS date, o_totalprice AS value, o_orderkey FROM orders)"""


def simple_coeffs(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients as means of value times sine and cosine of the day of year, per pixel."""
    w = F.dayofyear("date") * (2 * pi / 365)
    v = F.col("value") / 1000
    means = {"constant": v} | {f"{n}_{k}": v * f(k * w) for k in (1, 2) for n, f in (("sin", F.sin), ("cos", F.cos))}
    return pixel_obs(spark, d).groupBy("pixel_id", "i", "j", "lat", "lon").agg(*[F.avg(c).alias(n) for n, c in means.items()])


_W = "dayofyear(date) * (2 * pi() / 365)"
COEFFS = f"""{PIXELS}, coef AS (
  SELECT pixel_id, i, j, lat, lon, avg(value / 1000) AS constant, avg(value / 1000 * sin({_W})) AS sin_1, avg(value / 1000 * cos({_W})) AS cos_1,
         avg(value / 1000 * sin(2 * {_W})) AS sin_2, avg(value / 1000 * cos(2 * {_W})) AS cos_2 FROM pix GROUP BY ALL)"""

HAV = "2 * 6371008.0 * asin(sqrt(least(1.0, power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2))))"


def hourly(spark: SparkSession, d: str) -> DataFrame:
    """Mean event value per user group and hour of day, hours without events 0."""
    e = table(spark, d, "events").select((F.col("user_id") % 20).alias("g"), F.hour(F.col("ts").cast("timestamp")).alias("h"), "value")
    agg = e.groupBy("g", "h").agg(F.round(F.avg("value"), 6).alias("v"))
    frame = e.select("g").distinct().withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(23))))
    return frame.join(agg, ["g", "h"], "left").na.fill({"v": 0.0})


HOURLY = """ev AS (SELECT user_id % 20 AS g, hour(ts) AS h, value FROM events),
frame AS (SELECT g, CAST(h AS INT) AS h FROM (SELECT DISTINCT g FROM ev), range(0, 24) r(h)),
ser AS (SELECT frame.g, frame.h, coalesce(a.v, 0) AS v FROM frame LEFT JOIN (SELECT g, h, round(avg(value), 6) AS v FROM ev GROUP BY ALL) a ON a.g = frame.g AND a.h = frame.h)"""


def landcover(spark: SparkSession, d: str) -> DataFrame:
    """One class per pixel and year."""
    year = F.year("l_shipdate")
    c = table(spark, d, "lineitem").select((F.col("l_partkey") % 225).alias("pixel_id"), year.alias("year"), (F.col("l_partkey") + year).alias("s"))
    return c.groupBy("pixel_id", "year").agg((F.min("s") % 17).cast("int").alias("class"))


LANDCOVER = "lc AS (SELECT l_partkey % 225 AS pixel_id, year(l_shipdate) AS year, CAST(min(l_partkey + year(l_shipdate)) % 17 AS INT) AS class FROM lineitem GROUP BY ALL)"


def points(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as points on the grid with two covariates."""
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("id"), (F.col("s_nationkey") % 5).alias("grp"), (-60 + 0.05 * (k % 15) + 0.003 * (k % 7) + 0.0011).alias("lon"), (5 - 0.05 * (F.floor(k / 15) % 15) - 0.002 * (k % 11) - 0.0007).alias("lat"), F.col("s_acctbal").alias("a"), (k * 37 % 101).cast("double").alias("b"))


POINTS = "pts AS (SELECT s_suppkey AS id, s_nationkey % 5 AS grp, -60 + 0.05 * (s_suppkey % 15) + 0.003 * (s_suppkey % 7) + 0.0011 AS lon, 5 - 0.05 * ((s_suppkey // 15) % 15) - 0.002 * (s_suppkey % 11) - 0.0007 AS lat, s_acctbal AS a, CAST(s_suppkey * 37 % 101 AS DOUBLE) AS b FROM supplier)"


def cell_means(spark: SparkSession, d: str, gap: int = 0) -> DataFrame:
    """Mean value per grid cell; every ``gap``-th pixel is null."""
    m = pixel_obs(spark, d).groupBy("pixel_id", "i", "j").agg(F.avg("value").alias("value"))
    return m.withColumn("value", F.when(F.col("pixel_id") % gap != 0, F.col("value"))) if gap else m


def cell_means_sql(gap: int = 0) -> str:
    v = f"CASE WHEN pixel_id % {gap} <> 0 THEN avg(value) END" if gap else "avg(value)"
    return f"{PIXELS}, cells AS (SELECT pixel_id, i, j, {v} AS value FROM pix GROUP BY pixel_id, i, j)"


def _simpson(f: str, low: str, high: str, steps: int) -> str:
    """Simpson's rule over the variable ``u`` of the SQL expression ``f``."""
    u = f"({low} + ({high} - ({low})) * k / {steps}.0)"
    weight = f"(CASE WHEN k = 0 OR k = {steps} THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END)"
    return f"(({high} - ({low})) / {3 * steps}.0 * list_sum(list_transform(range(0, {steps + 1}), lambda k: {weight} * {f.replace('@u', u)})))"


def t_tail_sql(t: str, df: str, steps: int = 2000) -> str:
    """Two-sided tail of Student's t, integrated over the angle whose tangent is t / sqrt(df)."""
    return f"(2 * exp(lgamma(({df} + 1) / 2.0) - lgamma({df} / 2.0)) / sqrt(pi()) * {_simpson(f'pow(cos(@u), {df} - 1)', f'atan(abs({t}) / sqrt({df}))', 'pi() / 2', steps)})"


def f_tail_sql(f: str, d1: str, d2: str, steps: int = 4000) -> str:
    """Upper tail of the F distribution, integrated over the angle whose squared sine is d2 / (d2 + d1 f)."""
    scale = f"2 * exp(lgamma(({d1} + {d2}) / 2.0) - lgamma({d1} / 2.0) - lgamma({d2} / 2.0))"
    return f"({scale} * {_simpson(f'pow(sin(@u), {d2} - 1) * pow(cos(@u), {d1} - 1)', '0', f'asin(sqrt({d2} / ({d2} + {d1} * ({f}))))', steps)})"
