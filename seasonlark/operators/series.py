"""Circular and annual series: rotation, peaks, seasons, densities, modality."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.functions.seasons import DAYS, curve_value
from seasonlark.operators.order import percentiles
from seasonlark.operators.spatial import nearest_cell
from seasonlark.operators.stats import permutations


def minmax_within(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rescale to [0, 1] within keys; null where all values are equal."""
    part = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    lo, hi = F.min(value).over(part), F.max(value).over(part)
    return df.withColumn(value, (F.col(value) - lo) / F.nullif(hi - lo, F.lit(0.0)))


def percentile_clip(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """Rescale between two exact percentiles, which are selected first, and clip to [0, 1]; null where they are equal."""
    a, b = (F.lit(x).cast("double") for x in percentiles(df, value, [low, high]))
    v = (F.col(value) - a) / F.nullif(b - a, F.lit(0.0))
    return df.withColumn(value, F.when(v.isNotNull(), F.greatest(F.least(v, F.lit(1.0)), F.lit(0.0))))


def rotate_to_min(df: DataFrame, keys: list[str], idx: str, value: str, nsteps: int = 7) -> DataFrame:
    """Add ``pos``: the index counted from the series' minimum around the circle.

    Of several minima the one before the largest rise over ``nsteps`` counts, then the first.
    Indexes run from 0 without gaps.
    """
    part = W.partitionBy(*keys)
    sized = df.withColumns({"__n": F.count("*").over(part), "__lo": F.min(value).over(part)})
    later = sized.select(*keys, F.pmod(F.col(idx) - nsteps, F.col("__n")).alias(idx), F.col(value).alias("__later"))
    lows = sized.where(F.col(value) == F.col("__lo")).join(later, [*keys, idx])
    cut = lows.groupBy(*keys).agg(F.max_by(idx, F.struct((F.col("__later") - F.col(value)).alias("rise"), (-F.col(idx)).alias("first"))).alias("__cut"))
    return sized.join(cut, keys).withColumn("pos", F.pmod(F.col(idx) - F.col("__cut"), F.col("__n"))).drop("__n", "__lo", "__cut")


def find_peaks(df: DataFrame, keys: list[str], idx: str, value: str, min_height: float | None = None) -> DataFrame:
    """``(keys, peak, height)``: interior local maxima, plateaus at their middle (rounded down)."""
    part = W.partitionBy(*keys).orderBy(idx) if keys else W.partitionBy(F.lit(1)).orderBy(idx)
    step = F.coalesce((F.col(value) != F.lag(value).over(part)).cast("int"), F.lit(1))
    runs = df.withColumn("__s", step).withColumn("__run", F.sum("__s").over(part))
    flat = runs.groupBy(*keys, "__run").agg(F.min(idx).alias("__a"), F.max(idx).alias("__b"), F.first(value).alias("height"))
    seq = W.partitionBy(*keys).orderBy("__run") if keys else W.partitionBy(F.lit(1)).orderBy("__run")
    out = flat.withColumns({"__p": F.lag("height").over(seq), "__q": F.lead("height").over(seq)})
    out = out.where((F.col("height") > F.col("__p")) & (F.col("height") > F.col("__q")))
    if min_height is not None:
        out = out.where(F.col("height") >= min_height)
    return out.select(*keys, F.floor((F.col("__a") + F.col("__b")) / 2).cast("int").alias("peak"), "height")


def lag1_autocorr(df: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    """Absolute correlation of each value with the one before."""
    part = W.partitionBy(*keys).orderBy(idx) if keys else W.partitionBy(F.lit(1)).orderBy(idx)
    return df.withColumn("__v", F.lag(value).over(part)).where("__v is not null").groupBy(*keys).agg(F.abs(F.corr(value, "__v")).alias("acf"))


def start_of_season(df: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    """First index whose value exceeds the series' median."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    return df.join(med, keys).groupBy(*keys).agg(F.min(F.when(F.col(value) > F.col("__m"), F.col(idx))).alias("sos"))


def first_per_doy(df: DataFrame, keys: list[str], date: str) -> DataFrame:
    """The first row of each day of the year."""
    part = W.partitionBy(*keys, F.dayofyear(date)).orderBy(date)
    return df.withColumn("__r", F.row_number().over(part)).where("__r = 1").drop("__r")


def kde(hist: DataFrame, keys: list[str], x: str, n: str, bw: float, lo: float, hi: float, step: float) -> DataFrame:
    """Gaussian kernel density of counts on a regular grid ``(keys, k, at, density)``; the grid is exploded beside each count."""
    at = F.explode(F.sequence(F.lit(0), F.lit(int(round((hi - lo) / step)))))
    u = (F.col("at") - F.col(x)) / bw
    total = hist.groupBy(*keys).agg(F.sum(n).alias("__t"))
    spread = hist.where(F.col(n) > 0).select(*keys, x, n, at.alias("k")).withColumn("at", lo + F.col("k") * step)
    agg = spread.groupBy(*keys, "k", "at").agg(F.sum(F.col(n) * F.exp(-u * u / 2)).alias("__d"))
    return agg.join(total, keys).select(*keys, "k", "at", (F.col("__d") / (F.col("__t") * (bw * math.sqrt(2 * math.pi)))).alias("density"))


def peak_test(hist: DataFrame, keys: list[str], week: str, n: str, bw: float = 5.0, min_height: float = 0.6, n_perm: int = 100, weeks: int = 53) -> DataFrame:
    """``(keys, npeaks, acf, p)``: peaks of the rotated, rescaled density at least ``min_height`` high; share of permuted series with as much autocorrelation."""
    turned = rotate_to_min(hist, keys, week, n)
    dens = minmax_within(kde(turned, keys, "pos", n, bw, 0.0, weeks - 1.0, 0.1), keys, "density")
    peaks = find_peaks(dens, keys, "k", "density", min_height).groupBy(*keys).agg(F.count("*").alias("npeaks"))
    acf = lag1_autocorr(turned, keys, "pos", n)
    null = lag1_autocorr(permutations(turned, keys, "pos", n, n_perm), [*keys, "perm"], "pos", n).withColumnRenamed("acf", "__a")
    p = null.join(acf, keys).groupBy(*keys).agg(F.avg((F.col("__a") >= F.col("acf")).cast("double")).alias("p"))
    return acf.join(p, keys, "left").join(peaks, keys, "left").select(*keys, F.coalesce("npeaks", F.lit(0)).alias("npeaks"), "acf", "p")


def significant_peaks(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """Peak counts of taxa whose p passes Bonferroni over all taxa; 0 for others."""
    n = tests.agg(F.count("*").alias("__m"))
    keep = F.col("p") <= F.lit(alpha) / F.col("__m")
    return tests.join(F.broadcast(n)).withColumn("signif_npeaks", F.when(keep, F.col("npeaks")).otherwise(0)).drop("__m")


def curve_series(coeffs: DataFrame, keys: list[str], days: int = DAYS) -> DataFrame:
    """``(keys, day, value)``: fitted curves, day from 0."""
    long = coeffs.withColumn("day", F.explode(F.sequence(F.lit(0), F.lit(days - 1))))
    return long.select(*keys, "day", curve_value(F.col("day") + 1, *[F.col(c) for c in ("constant", "sin_1", "cos_1", "sin_2", "cos_2")]).alias("value"))


def curves_at_points(points: DataFrame, coeffs: DataFrame, key: str, lon: str, lat: str, res: float, x0: float, y0: float, standardise: bool = False, days: int = DAYS) -> DataFrame:
    """``(key, day, value)``: the fitted curve of the cell that holds each point, day from 0; null where the cell has none.

    coeffs: a row per cell ``(i, j)``.  standardise: less its mean and divided by its deviation (of
    a population) over the days; null for a flat curve.
    """
    names = ("constant", "sin_1", "cos_1", "sin_2", "cos_2")
    held = nearest_cell(points.select(key, lon, lat), coeffs.select("i", "j", *names), lon, lat, res, x0, y0)
    out = curve_series(held, [key], days)
    if standardise:
        w = W.partitionBy(key)
        out = out.withColumn("value", (F.col("value") - F.avg("value").over(w)) / F.nullif(F.stddev_pop("value").over(w), F.lit(0.0)))
    return out


def daily_frames(coeffs: DataFrame, keys: list[str]) -> DataFrame:
    """Fitted curves scaled to [0, 1] per pixel."""
    return minmax_within(curve_series(coeffs, keys), keys, "value")


def modality(coeffs: DataFrame, keys: list[str]) -> DataFrame:
    """``(keys, npeaks, modality)``: height difference of the two peaks of the scaled and rotated curve; 1 with fewer than two."""
    turned = rotate_to_min(daily_frames(coeffs, keys), keys, "day", "value")
    peaks = find_peaks(turned, keys, "pos", "value").groupBy(*keys).agg(F.count("*").alias("npeaks"), (F.max("height") - F.min("height")).alias("gap"))
    return coeffs.select(*keys).join(peaks, keys, "left").select(*keys, F.coalesce("npeaks", F.lit(0)).alias("npeaks"), F.when(F.col("npeaks") == 2, F.col("gap")).otherwise(1.0).alias("modality"))


def raw_vs_fitted(obs: DataFrame, coeffs: DataFrame, keys: list[str], date: str, value: str, scale: float = 10000.0) -> DataFrame:
    """Observations (divided by ``scale``) beside the fitted curve of their day; leap days count as 365."""
    doy = F.least(F.dayofyear(date), F.lit(DAYS))
    met = obs.select(*keys, date, (F.col(value) / scale).alias("raw"), doy.alias("doy")).join(coeffs, keys)
    return met.select(*keys, date, "doy", "raw", curve_value(F.col("doy"), *[F.col(c) for c in ("constant", "sin_1", "cos_1", "sin_2", "cos_2")]).alias("fitted"))


def weekly_counts(df: DataFrame, keys: list[str], week: str, weeks: int = 53) -> DataFrame:
    """Counts per week, 0 for weeks without rows."""
    n = df.groupBy(*keys, week).agg(F.count("*").alias("n"))
    frame = n.select(*keys).distinct().withColumn(week, F.explode(F.sequence(F.lit(0), F.lit(weeks - 1))))
    return frame.join(n.withColumn(week, F.col(week).cast("int")), [*keys, week], "left").na.fill({"n": 0})


def order_by_first_peak(df: DataFrame, key: str, idx: str, value: str, order: int = 40) -> DataFrame:
    """``(key, first_peak, rank)``: keys ranked by the first index that is a maximum among ``order`` neighbours on both sides."""
    near = W.partitionBy(key).orderBy(idx).rowsBetween(-order, order)
    sized = df.withColumns({"__m": F.max(value).over(near), "__n": F.count("*").over(near)})
    first = sized.where(F.col(value) == F.col("__m")).groupBy(key).agg(F.min(idx).alias("first_peak"))
    return first.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(1)).orderBy("first_peak", key)))


def season_ramp(cells: DataFrame, line: DataFrame, half_width: float) -> DataFrame:
    """Weights per longitude: 1 north of a band around a line, 0 south, and equal steps by rank between.

    cells: x, y; line: x, line_y.  The nearest line point in longitude counts (smaller x on ties).
    """
    if line.limit(100_001).count() > 100_000:
        raise ValueError("the line has more points than a broadcast should carry")
    xs = cells.select("x").distinct()
    near = xs.join(F.broadcast(line.select(F.col("x").alias("lx"), "line_y"))).groupBy("x").agg(F.min_by("line_y", F.struct(F.abs(F.col("x") - F.col("lx")), "lx")).alias("line_y"))
    met = cells.join(near, "x").withColumn("__in", (F.abs(F.col("y") - F.col("line_y")) <= half_width).cast("int"))
    part = W.partitionBy("x", "__in")
    rank = F.row_number().over(part.orderBy(F.desc("y")))
    n = F.count("*").over(part)
    w = F.when(F.col("__in") == 1, 1 - rank / (n + 1)).when(F.col("y") > F.col("line_y"), 1.0).otherwise(0.0)
    return met.select("x", "y", w.alias("w"))


def fold(bands: DataFrame, weight: str, cols: list[str]) -> DataFrame:
    """w e + (1 - w)(1 - e): turn the southern season around."""
    return bands.withColumns({c: F.col(weight) * F.col(c) + (1 - F.col(weight)) * (1 - F.col(c)) for c in cols})
