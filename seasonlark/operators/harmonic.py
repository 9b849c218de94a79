"""Harmonic regression per key from additive moments, and its permutation test."""

from __future__ import annotations

from functools import reduce
from math import pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.functions.seasons import time_radians


def regressors(t: Column, n_freq: int = 2, trend: bool = True, intercept: bool = True) -> dict[str, Column]:
    """Named regressors: constant, t, then sine and cosine of each frequency."""
    out = {"constant": F.lit(1.0)} if intercept else {}
    if trend:
        out["t"] = t
    for f in range(1, n_freq + 1):
        out[f"sin_{f}"], out[f"cos_{f}"] = F.sin(f * t), F.cos(f * t)
    return out


def ols(df: DataFrame, keys: list[str], y: Column, xs: dict[str, Column]) -> DataFrame:
    """Multiple least squares per key: one double per regressor, r2 (share of variance fitted), rmse and n.

    Sums of products are combined before the shuffle, so its size does not depend on the number of
    observations; small batches of normal equations are then solved together.  Rows with a null
    anywhere are left out.  Singular or too few observations give null coefficients, n stays.
    """
    names = list(xs)
    k = len(names)
    base = df.select(*keys, y.cast("double").alias("__y"), *[c.cast("double").alias(f"__x{i}") for i, c in enumerate(xs.values())]).na.drop(subset=["__y", *[f"__x{i}" for i in range(k)]])
    sums = [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")) for i in range(k) for j in range(i, k)]
    sums += [F.sum(F.col(f"__x{i}") * F.col("__y")) for i in range(k)] + [F.sum("__y"), F.sum(F.col("__y") * F.col("__y"))]
    moments = base.groupBy(*keys).agg(F.count("*").alias("n"), F.array(*sums).alias("m"))
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in moments.select(*keys).schema) + ", " if keys else ""
    has_const = "constant" in names

    def solve(frames):
        up = np.triu_indices(k)
        for f in frames:
            if not len(f):
                continue
            m, n = np.array(f["m"].tolist(), float), f["n"].to_numpy(float)
            a = np.zeros((len(f), k, k))
            a[:, up[0], up[1]] = m[:, : len(up[0])]
            a[:, up[1], up[0]] = m[:, : len(up[0])]
            b, sy, syy = m[:, -k - 2 : -2], m[:, -2], m[:, -1]
            scale = np.sqrt(np.maximum(np.einsum("nii->ni", a), 1e-300))
            a /= scale[:, :, None] * scale[:, None, :]
            ok = (n >= k) & (np.linalg.cond(np.where(np.isfinite(a), a, 0)) < 1e14)
            beta = np.full((len(f), k), np.nan)
            if ok.any():
                beta[ok] = np.linalg.solve(a[ok], (b / scale)[ok][:, :, None])[:, :, 0] / scale[ok]
            fitted = (beta * b).sum(axis=1)
            sse = np.maximum(syy - fitted, 0)
            sst = syy - sy * sy / n if has_const else syy
            with np.errstate(all="ignore"):
                r2 = np.where(sst > 1e-12 * np.maximum(syy, 1e-300), 1 - sse / sst, np.nan)
            out = f.drop(columns="m").copy()
            for i, name in enumerate(names):
                out[name] = beta[:, i]
            out["r2"], out["rmse"] = r2, np.sqrt(sse / n)
            yield out[[*keys, *names, "r2", "rmse", "n"]]

    return moments.mapInPandas(solve, key_types + ", ".join(f"`{x}` double" for x in names) + ", r2 double, rmse double, n bigint")


def harmonic_fit(df: DataFrame, keys: list[str], ts: str, value: str, n_freq: int = 2, trend: bool = True, intercept: bool = True) -> tuple[DataFrame, DataFrame]:
    """``(summary, fitted)``: coefficients with r2, rmse, n, mean, phase, amplitude, t_max and HSV colour; and the fitted series.

    The trend is fitted and kept in the summary, but seasonal curves leave it out.  t is
    centred per key while fitting, since it is far from 0; the constant is given for t itself.
    """
    t = time_radians(F.col(ts))
    mean = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.avg(t).alias("__t0"), F.avg(value).alias("mean"))
    timed = df.select(*keys, ts, value, t.alias("__t")).join(mean, keys)
    xs = regressors(F.col("__t"), n_freq, trend, intercept)
    if trend and intercept:
        xs["t"] = F.col("__t") - F.col("__t0")
    fit = ols(timed, keys, F.col(value), xs)
    summary = fit.join(mean, keys)
    if trend and intercept:
        summary = summary.withColumn("constant", F.col("constant") - F.col("t") * F.col("__t0"))
    summary = summary.withColumn("phase", F.atan2("sin_1", "cos_1")).withColumn("amplitude", F.hypot("sin_1", "cos_1"))
    parts = [F.col(f"__c_{name}") * c for name, c in regressors(F.col("__t"), n_freq, trend, intercept).items()]
    coef = summary.select(*keys, *[F.col(c).alias(f"__c_{c}") for c in regressors(F.lit(0.0), n_freq, trend, intercept)])
    fitted = df.select(*keys, ts, value, t.alias("__t")).join(coef, keys).withColumn("fitted", reduce(lambda a, b: a + b, parts))
    peak = fitted.groupBy(*keys).agg(F.pmod(F.max_by("__t", "fitted"), F.lit(2 * pi)).alias("t_max"))
    summary = summary.join(peak, keys, "left").drop("__t0")
    return summary, fitted.select(*keys, ts, value, "fitted")


def hsv_to_rgb(h: Column, s: Column, v: Column) -> Column:
    """Colour of hue, saturation and value in [0, 1] as a struct of r, g, b."""
    i = F.floor(h * 6).cast("int")
    f = h * 6 - i
    p, q, t = v * (1 - s), v * (1 - f * s), v * (1 - (1 - f) * s)
    six = F.pmod(i, F.lit(6))
    pick = lambda a: F.get(F.array(*a), six)
    return F.struct(pick([v, q, p, p, t, v]).alias("r"), pick([t, v, v, q, p, p]).alias("g"), pick([p, p, t, v, v, q]).alias("b"))


def permute_time(times: DataFrame, ts: str, seeds: int) -> DataFrame:
    """``(seed, ts, ts_perm)``: for each seed one permutation of the distinct times, shared by all keys.

    Ranks in time order meet ranks in order of md5(seed-rank).
    """
    dates = times.select(ts).distinct().withColumn("i", F.row_number().over(W.orderBy(ts)))
    seeded = dates.crossJoin(F.broadcast(times.sparkSession.range(seeds).withColumnRenamed("id", "seed")))
    order = W.partitionBy("seed").orderBy(F.md5(F.concat_ws("-", "seed", "i")), "i")
    drawn = seeded.withColumn("j", F.row_number().over(order))
    return drawn.select("seed", F.col(ts), F.col("j").alias("i")).join(dates.select(F.col(ts).alias("ts_perm"), "i"), "i").drop("i")


def harmonic_permutation_test(df: DataFrame, keys: list[str], ts: str, value: str, n_perm: int = 20, max_p: float = 0.001, n_freq: int = 2) -> DataFrame:
    """``(keys, r2, fails, perm_p, significant)``: fails counts permutations whose r2 is at least the true one, perm_p = fails / n_perm."""
    true, _ = harmonic_fit(df, keys, ts, value, n_freq)
    moves = permute_time(df, ts, n_perm)
    moved = df.select(*keys, ts, value).join(F.broadcast(moves), ts)
    t = time_radians(F.col("ts_perm"))
    xs = regressors(t - F.lit(2 * pi * 10), n_freq)
    xs.update({n: c for n, c in regressors(t, n_freq).items() if n.startswith(("sin", "cos"))})
    null = ols(moved, [*keys, "seed"], F.col(value), xs).select(*keys, F.col("r2").alias("r2_perm"))
    hits = true.select(*keys, "r2").join(null, keys)
    out = hits.groupBy(*keys, "r2").agg(F.sum((F.col("r2_perm") >= F.col("r2")).cast("int")).alias("fails"))
    return out.withColumn("perm_p", F.col("fails") / n_perm).withColumn("significant", (F.col("perm_p") <= max_p).cast("int"))
