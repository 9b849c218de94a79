"""Evaluations against towers, leaf-out dates and other products."""

from __future__ import annotations

from math import pi

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.functions.seasons import DAYS
from seasonlark.functions.tails import f_sf
from seasonlark.operators.asynchrony import simple_ols
from seasonlark.operators.clean import null_sentinels
from seasonlark.operators.harmonic import ols
from seasonlark.operators.series import curve_series, minmax_within, start_of_season
from seasonlark.operators.spatial import nearest_valid


def longest_per_id(df: DataFrame, key: str, length: str) -> DataFrame:
    """The row with the longest series of each id; all columns break ties."""
    order = [F.desc(length), *[F.col(c).asc_nulls_first() for c in df.columns if c not in (key, length)]]
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where("__r = 1").drop("__r")


def merge_evals(a: DataFrame, b: DataFrame, keys: list[str], values: list[str], suffixes: tuple[str, str]) -> DataFrame:
    """Full outer join of two evaluations; null keys match."""
    left = a.select(*keys, *[F.col(v).alias(f"{v}_{suffixes[0]}") for v in values])
    right = b.select(*[F.col(k).alias(f"__{k}") for k in keys], *[F.col(v).alias(f"{v}_{suffixes[1]}") for v in values])
    on = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    met = left.join(right, on, "full_outer")
    return met.select(*[F.coalesce(k, f"__{k}").alias(k) for k in keys], *[c for c in left.columns + right.columns if c not in keys and not c.startswith("__")])


def half_month_pairs(a: DataFrame, b: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """Values of two products on the 1st and 16th of months; both null where either is."""
    pick = lambda d, n: d.where(F.dayofmonth(date).isin(1, 16)).select(*keys, date, F.col(value).alias(n))
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    return pick(a, "a").join(pick(b, "b"), [*keys, date]).withColumns({"a": F.when(both, F.col("a")), "b": F.when(both, F.col("b"))})


def product_agreement(pairs: DataFrame, site: str) -> tuple[DataFrame, DataFrame]:
    """Per-site correlation, and the pooled regression of a on b through the origin with uncentred r2."""
    return pairs.groupBy(site).agg(F.corr("a", "b").alias("r"), F.count(F.when(F.col("a").isNotNull(), 1)).alias("n")), simple_ols(pairs, [], F.col("b"), F.col("a"), intercept=False)


def coverage_gaps(grid: DataFrame, footprints: DataFrame, x0: float, y0: float, res: float, buffer: float = 0.15) -> DataFrame:
    """Cells ``(i, j)`` never within ``buffer`` of a footprint's centre, bounds rounded outwards.

    footprints: lon, lat arrays of vertices; rows with a null in either are left out.
    """
    mean = lambda c: F.aggregate(c, F.lit(0.0), lambda a, v: a + v) / F.size(c)
    whole = ~F.exists("lon", lambda v: v.isNull()) & ~F.exists("lat", lambda v: v.isNull())
    at = footprints.where(whole & (F.size("lon") > 0)).select(mean("lon").alias("x"), mean("lat").alias("y"))
    lo = lambda c, o: F.floor((F.col(c) - buffer - o) / res)
    hi = lambda c, o: F.ceil((F.col(c) + buffer - o) / res)
    marked = at.select(F.explode(F.sequence(lo("y", y0), hi("y", y0) - 1)).alias("i"), F.sequence(lo("x", x0), hi("x", x0) - 1).alias("js")).select("i", F.explode("js").alias("j")).distinct()
    return grid.join(marked, ["i", "j"], "left_anti")


def tower_eval(sites: DataFrame, daily: DataFrame, cells: DataFrame, max_ring: int = 2, seed: int = 0) -> DataFrame:
    """``(site, dist, r2, n_days, f_p, ring)`` of each tower against the nearest cell with a curve.

    daily: site, date, flux; sites: site, i, j; cells: i, j and coefficients.  The tower fit has scaled
    time and annual and semi-annual terms and no intercept; the prediction adds the time
    coefficient as a constant, as published.  Both yearly curves are scaled to [0, 1].
    """
    t = daily.where(F.col("flux").isNotNull()).withColumn("__d", F.datediff("date", F.lit("2000-01-01")))
    t = minmax_within(t, ["site"], "__d")
    doy = F.dayofyear("date")
    xs = {"t": F.col("__d")} | {f"{f}_{k}": getattr(F, f)(doy * (2 * pi * k / DAYS)) for k in (1, 2) for f in ("sin", "cos")}
    fit = ols(t, ["site"], F.col("flux"), xs)
    sizes = t.groupBy("site").agg((F.max(F.datediff("date", F.lit("2000-01-01"))) - F.min(F.datediff("date", F.lit("2000-01-01")))).alias("n_days"))
    tower = fit.select("site", F.col("t").alias("constant"), "sin_1", "cos_1", "sin_2", "cos_2")
    at = nearest_valid(sites, cells.withColumn("__v", F.col("sin_1")), "site", "__v", max_ring, seed).where("ring is not null")
    own = at.select("site", "ring", F.col("cell_i").alias("i"), F.col("cell_j").alias("j")).join(cells, ["i", "j"]).select("site", "ring", "constant", "sin_1", "cos_1", "sin_2", "cos_2")
    a = minmax_within(curve_series(tower.na.drop(), ["site"]), ["site"], "value").withColumnRenamed("value", "a")
    b = minmax_within(curve_series(own, ["site", "ring"]), ["site"], "value").withColumnRenamed("value", "b")
    agg = a.join(b, ["site", "day"]).groupBy("site", "ring").agg(F.sqrt(F.sum(F.pow(F.col("a") - F.col("b"), 2.0))).alias("dist"), F.pow(F.corr("a", "b"), F.lit(2.0)).alias("r2"))
    f = (F.col("r2") / 5) / ((1 - F.col("r2")) / (F.col("n") - 5))
    p = fit.select("site", f_sf(f, F.lit(5.0), (F.col("n") - 5).cast("double")).alias("f_p"))
    return agg.join(sizes, "site").join(p, "site").select("site", "dist", "r2", "n_days", "f_p", "ring")


def leafout_eval(sites: DataFrame, coeffs: DataFrame, site: str, observed: str) -> tuple[DataFrame, DataFrame]:
    """Start of season of each site's curve beside its mean observed day, and the regression of one on the other."""
    curve = curve_series(coeffs, [site])
    sos = start_of_season(curve, [site], "day", "value")
    mean = sites.groupBy(site).agg(F.avg(observed).alias("observed"))
    met = sos.join(mean, site)
    return met, simple_ols(met, [], F.col("sos"), F.col("observed"))


def on_standard_year(df: DataFrame, keys: list[str], date: str, value: str, days: int = 365) -> DataFrame:
    """``(keys, doy, value)``: the first known value of each day of the year, for days 1 to ``days``; days without one are left out."""
    known = df.where(F.col(value).isNotNull() & (F.dayofyear(date) <= days))
    return known.groupBy(*keys, F.dayofyear(date).alias("doy")).agg(F.min_by(value, date).alias(value))


def aligned_by_day(a: DataFrame, b: DataFrame, keys: list[str], date: str, value: str) -> DataFrame:
    """``(keys, doy, a, b)``: two series on a standard year, days that both know."""
    one, two = (on_standard_year(d, keys, date, value).withColumnRenamed(value, n) for d, n in ((a, "a"), (b, "b")))
    return one.join(two, [*keys, "doy"])


def leafout_regressions(met: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """``(x, y, n, slope, intercept, r2, f, f_p)`` of y on x for each pair of columns, rows with a null in either left out; one job for all pairs.

    With one predictor F is the square of the slope's t, and their p-values are one.
    """
    pair = F.explode(F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y"), F.col(x).cast("double").alias("u"), F.col(y).cast("double").alias("v")) for x, y in pairs]))
    long = met.select(pair.alias("p")).select("p.*")
    out = simple_ols(long, ["x", "y"], F.col("u"), F.col("v"))
    return out.select("x", "y", "n", "slope", "intercept", "r2", F.pow("t", F.lit(2.0)).alias("f"), F.col("p").alias("f_p"))


def sampled_in_boxes(cells: DataFrame, lon: str, lat: str, boxes: dict[str, tuple[float, float, float, float, int]], seed: int = 0) -> DataFrame:
    """``(box, cells' columns)``: from each box (west, south, east, north, n) the first n cells by a hash of their place; all, if it has fewer."""
    inside = [F.when(F.col(lon).between(w, e) & F.col(lat).between(s, n), F.struct(F.lit(name).alias("box"), F.lit(k).alias("k"))) for name, (w, s, e, n, k) in boxes.items()]
    dealt = cells.withColumn("__b", F.explode(F.array_compact(F.array(*inside)))).select("__b.box", "__b.k", *cells.columns)
    order = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col("i").cast("string"), F.col("j").cast("string")).cast("binary"))
    most = max(b[-1] for b in boxes.values())
    ranked = dealt.withColumn("__r", F.row_number().over(W.partitionBy("box").orderBy(order, "i", "j"))).where(F.col("__r") <= most)
    return ranked.where(F.col("__r") <= F.col("k")).drop("__r", "k")


def gap_eval(gaps: DataFrame, a: DataFrame, b: DataFrame, boxes: dict, lon: str = "lon", lat: str = "lat", sentinel: float = -999.0, seed: int = 0) -> DataFrame:
    """``(box, i, j, n, r)``: correlation of two products at cells drawn among coverage gaps, over the 1st and 16th of months where both are known.

    gaps: i, j, lon, lat; a, b: i, j, date, value.  A site without two common days or with a constant series has a null r.
    """
    sites = sampled_in_boxes(gaps.select("i", "j", lon, lat), lon, lat, boxes, seed).select("box", "i", "j")
    at = lambda d: null_sentinels(d.select("i", "j", "date", "value"), {"value": [sentinel]}).join(F.broadcast(sites.select("i", "j").distinct()), ["i", "j"])
    pairs = half_month_pairs(at(a), at(b), ["i", "j"], "date", "value").where("a is not null")
    moments = pairs.groupBy("i", "j").agg(F.count("*").alias("n"), F.corr("a", "b").alias("r"))
    return sites.join(moments, ["i", "j"], "left").select("box", "i", "j", F.coalesce("n", F.lit(0)).alias("n"), F.nanvl("r", F.lit(None).cast("double")).alias("r"))
