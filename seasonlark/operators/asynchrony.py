"""Simple regressions per key, the asynchrony metric, and comparisons of its maps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlark.functions.seasons import curve_distance
from seasonlark.functions.tails import t_sf
from seasonlark.operators.spatial import neighbour_pairs

HARMONICS = ["sin_1", "cos_1", "sin_2", "cos_2"]


def simple_ols(df: DataFrame, keys: list[str], x: Column, y: Column, intercept: bool = True) -> DataFrame:
    """``(keys, n, slope, intercept, r2, t, p)`` per key; null where it cannot be computed.

    Without intercept r2 is uncentred.  One grouped aggregate; p needs a batch of two numbers per key.
    """
    base = df.select(*keys, x.cast("double").alias("__x"), y.cast("double").alias("__y"))
    if intercept:
        agg = base.groupBy(*keys).agg(
            F.regr_count("__y", "__x").alias("n"),
            F.regr_slope("__y", "__x").alias("slope"),
            F.regr_intercept("__y", "__x").alias("intercept"),
            F.regr_sxx("__y", "__x").alias("sxx"),
            F.regr_syy("__y", "__x").alias("syy"),
            F.regr_sxy("__y", "__x").alias("sxy"),
        )
        r2 = F.when(F.col("syy") > 0, F.least(F.pow("sxy", F.lit(2.0)) / (F.col("sxx") * F.nullif("syy", F.lit(0.0))), F.lit(1.0)))
        agg = agg.withColumn("r2", F.when(F.col("sxx") > 0, r2)).withColumn("df", F.col("n") - 2)
        sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
    else:
        ok = F.col("__x").isNotNull() & F.col("__y").isNotNull()
        s = lambda c: F.sum(F.when(ok, c))
        agg = base.groupBy(*keys).agg(F.count(F.when(ok, 1)).alias("n"), s(F.col("__x") * F.col("__x")).alias("sxx"), s(F.col("__x") * F.col("__y")).alias("sxy"), s(F.col("__y") * F.col("__y")).alias("syy"))
        agg = agg.withColumn("slope", F.col("sxy") / F.nullif("sxx", F.lit(0.0))).withColumn("intercept", F.lit(0.0)).withColumn("df", F.col("n") - 1)
        sse = F.greatest(F.col("syy") - F.col("slope") * F.col("sxy"), F.lit(0.0))
        agg = agg.withColumn("r2", F.when(F.col("slope").isNotNull(), 1 - sse / F.nullif("syy", F.lit(0.0))))
    error = F.sqrt(sse / F.nullif(F.greatest("df", F.lit(0)), F.lit(0)) / F.nullif("sxx", F.lit(0.0)))
    out = agg.withColumn("t", F.when(error > 0, F.col("slope") / F.nullif(error, F.lit(0.0))))
    return out.withColumn("p", t_sf(F.col("t"), F.col("df").cast("double"))).select(*keys, "n", "slope", "intercept", "r2", "t", "p")


def asynchrony_radii(coeffs: DataFrame, radii_m: list[float], keys: list[str] | None = None, key: str = "pixel_id", lon: str = "lon", lat: str = "lat", min_n: int = 30, alpha: float = 0.01, ddof: int = 1, include_self: bool = True) -> DataFrame:
    """``(keys, pixel, radius_m, asynch, asynch_r2, asynch_pval, asynch_n)`` per focal pixel and radius.

    Slope of curve distance on distance in metres over the neighbours, the focal pixel among
    them; 0 where not significant; null metrics (n stays) below ``min_n``.  Pixels without
    coefficients neither appear as neighbours nor get a number.  Neighbours are met once, within the
    largest radius; a pair counts for every radius that holds it and is summed before it moves.
    Variables are keys, so one job serves them all.
    """
    keys = keys or []
    b = [F.col(c) for c in HARMONICS]
    usable = (b[0] * b[0] + b[1] * b[1] + b[2] * b[2] + b[3] * b[3]) > 0
    valid = coeffs.where(usable)
    near = neighbour_pairs(valid, max(radii_m), keys, key, lon, lat, HARMONICS)
    if not include_self:
        near = near.where(F.col(key) != F.col(f"n_{key}"))
    gap = curve_distance(b, [F.col(f"n_{c}") for c in HARMONICS], ddof)
    radii = F.array(*[F.lit(float(x)) for x in sorted(set(radii_m))])
    paired = near.select(*keys, key, "dist_m", gap.alias("gap"))
    held = paired.withColumn("radius_m", F.explode(F.filter(radii, lambda x: x >= F.col("dist_m"))))
    own = [*keys, key, "radius_m"]
    fit = simple_ols(held, own, F.col("dist_m"), F.col("gap"))
    enough = F.col("n") >= min_n
    out = fit.select(
        *own,
        F.when(enough & F.col("p").isNotNull(), F.when(F.col("p") < alpha, F.col("slope")).otherwise(0.0)).alias("asynch"),
        F.when(enough, F.col("r2")).alias("asynch_r2"),
        F.when(enough, F.col("p")).alias("asynch_pval"),
        F.col("n").alias("asynch_n"),
    )
    return coeffs.select(*keys, key).distinct().withColumn("radius_m", F.explode(radii)).join(out, own, "left")


def asynchrony(coeffs: DataFrame, radius_m: float, keys: list[str] | None = None, **options) -> DataFrame:
    """``asynchrony_radii`` for one radius, without its column."""
    return asynchrony_radii(coeffs, [radius_m], keys, **options).drop("radius_m")


def map_r2(maps: DataFrame, keys: list[str], by: list[str], level: str, value: str) -> DataFrame:
    """R-squared between the maps of every two levels (radii), per ``by`` (variable)."""
    a = maps.select(*keys, *by, F.col(level).alias("level_a"), F.col(value).alias("__a"))
    b = maps.select(*keys, *by, F.col(level).alias("level_b"), F.col(value).alias("__b"))
    both = a.join(b, [*keys, *by]).where("level_a < level_b")
    return both.groupBy(*by, "level_a", "level_b").agg(F.regr_r2("__b", "__a").alias("r2"), F.regr_count("__b", "__a").alias("n"))


def zscore_difference(maps: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """``(keys, diff)``: difference of the two columns' z-scores over rows with both."""
    both = maps.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    stats = both.agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate((a, b)) for n, f in (("m", F.avg), ("s", F.stddev_pop))])
    z = [(F.col(c) - F.col(f"__m{i}")) / F.nullif(f"__s{i}", F.lit(0.0)) for i, c in enumerate((a, b))]
    return both.join(F.broadcast(stats)).select(*keys, (z[0] - z[1]).alias("diff"))
