"""Gridded and point tables: resampling, neighbours, nearest cells, polygons, bins."""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.functions.geo import DEGREE_M, EARTH_M, cell_index, haversine_m
from seasonlark.operators.masks import modal_class


def with_cell(df: DataFrame, lon: str, lat: str, res: float, x0: float, y0: float, n_cols: int | None = None) -> DataFrame:
    """Add row i (southwards from ``y0``), column j (eastwards from ``x0``) and, given ``n_cols``, pixel_id."""
    out = df.withColumns({"i": cell_index(F.col(lat), y0, res, -1), "j": cell_index(F.col(lon), x0, res)})
    return out.withColumn("pixel_id", F.col("i") * n_cols + F.col("j")) if n_cols else out


def resample_mean(df: DataFrame, keys: list[str], x: str, y: str, res: float, values: list[str]) -> DataFrame:
    """Means of the fine cells inside each coarse cell ``(cx, cy)``."""
    return df.groupBy(*keys, F.floor(F.col(x) / res).alias("cx"), F.floor(F.col(y) / res).alias("cy")).agg(*[F.avg(v).alias(v) for v in values])


def resample_mode(df: DataFrame, keys: list[str], x: str, y: str, res: float, cls: str) -> DataFrame:
    """Modal class of each coarse cell, the smallest on ties."""
    cells = df.select(*keys, F.floor(F.col(x) / res).alias("cx"), F.floor(F.col(y) / res).alias("cy"), cls)
    return modal_class(cells, [*keys, "cx", "cy"], cls, cls)


def neighbour_pairs(points: DataFrame, radius_m: float, keys: list[str], key: str, lon: str, lat: str, cols: list[str]) -> DataFrame:
    """All ordered pairs of points of a group within ``radius_m``, self included: focal columns, and the others' as ``n_*``, ``dist_m``.

    Points lie in latitude bands as high as the radius, and bands in longitude bins at least as
    wide as the radius there; each point serves the bins around its own in three bands, so an
    equi-join on (group, band, bin) meets every pair once.  Longitudes wrap; polar bands are one bin.
    """
    high = radius_m / DEGREE_M * 1.000001
    band = lambda c: F.floor((c + 90) / high).cast("bigint")
    edge = lambda b: F.least(F.greatest(F.abs(b * high - 90), F.abs((b + 1) * high - 90)), F.lit(90.0))
    # widest reach in longitude of a radius around any point of the band
    reach = F.degrees(F.asin(F.least(F.lit(1.0), F.lit(math.sin(min(radius_m / EARTH_M, math.pi / 2))) / F.greatest(F.cos(F.radians(edge(F.col("__band")))), F.lit(1e-9)))))
    bins = F.greatest(F.lit(1), F.floor(360 / (reach * 1.000001)).cast("bigint"))
    place = lambda c: F.least(F.floor(F.pmod(c + 180, F.lit(360.0)) / (360.0 / F.col("__bins"))).cast("bigint"), F.col("__bins") - 1)
    base = points.where(F.col(lon).isNotNull() & F.col(lat).isNotNull()).select(*keys, key, lon, lat, *[c for c in cols if c not in (key, lon, lat, *keys)])
    focal = base.withColumn("__band", band(F.col(lat))).withColumn("__bins", bins).withColumn("__bin", place(F.col(lon))).drop("__bins")
    own = [c for c in base.columns if c not in keys]
    other = base.select(*keys, *[F.col(c).alias(f"n_{c}") for c in own])
    other = other.withColumn("__own", band(F.col(f"n_{lat}"))).withColumn("__band", F.explode(F.sequence(F.col("__own") - 1, F.col("__own") + 1))).withColumn("__bins", bins)
    spread = F.when(F.col("__bins") <= 2, F.sequence(F.lit(0).cast("bigint"), F.col("__bins") - 1)).otherwise(
        F.transform(F.array(*[F.lit(x).cast("bigint") for x in (-1, 0, 1)]), lambda d: F.pmod(place(F.col(f"n_{lon}")) + d, F.col("__bins")))
    )
    other = other.withColumn("__bin", F.explode(F.array_distinct(spread))).drop("__own", "__bins")
    met = focal.join(other, [*keys, "__band", "__bin"]).drop("__band", "__bin")
    return met.withColumn("dist_m", haversine_m(F.col(lon), F.col(lat), F.col(f"n_{lon}"), F.col(f"n_{lat}"))).where(F.col("dist_m") <= radius_m)


def focal_stat(points: DataFrame, radius_m: float, key: str, lon: str, lat: str, value: str, kind: str) -> DataFrame:
    """``(key, stat)``: population standard deviation (``stddev``) or class entropy in bits, clamped to [0, 1] (``entropy``), within a radius."""
    near = neighbour_pairs(points.where(F.col(value).isNotNull()), radius_m, [], key, lon, lat, [value])
    if kind == "stddev":
        return near.groupBy(key).agg(F.stddev_pop(f"n_{value}").alias("stat"))
    n = near.groupBy(key, f"n_{value}").count()
    agg = n.groupBy(key).agg(F.sum("count").alias("s"), F.sum(F.col("count") * F.log2("count")).alias("cl"))
    return agg.select(key, F.greatest(F.least(F.log2("s") - F.col("cl") / F.col("s"), F.lit(1.0)), F.lit(0.0)).alias("stat"))


def nearest_cell(points: DataFrame, grid: DataFrame, lon: str, lat: str, res: float, x0: float, y0: float) -> DataFrame:
    """Points with the columns of the cell that holds them; left join on the cell's row and column."""
    return with_cell(points, lon, lat, res, x0, y0).join(grid, ["i", "j"], "left")


def nearest_valid(points: DataFrame, grid: DataFrame, key: str, value: str, max_ring: int = 2, seed: int = 0) -> DataFrame:
    """The value of the nearest ring of cells around each point that has one; within a ring the cell of least md5; null if none.

    points: key, i, j; grid: i, j, value.
    """
    offsets = [(a, b) for a in range(-max_ring, max_ring + 1) for b in range(-max_ring, max_ring + 1)]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(max(abs(a), abs(b))).alias("ring")) for a, b in offsets]))
    tried = points.select(key, "i", "j", step.alias("o")).select(key, "o.ring", (F.col("i") + F.col("o.di")).alias("i"), (F.col("j") + F.col("o.dj")).alias("j"))
    met = tried.join(grid.where(F.col(value).isNotNull()).select("i", "j", value), ["i", "j"])
    order = F.struct("ring", F.md5(F.concat_ws("-", F.lit(str(seed)), "i", "j")), "i", "j")
    best = met.groupBy(key).agg(F.min_by(F.struct("i", "j", "ring", value), order).alias("b"))
    return points.select(key).join(best, key, "left").select(key, "b.ring", F.col("b.i").alias("cell_i"), F.col("b.j").alias("cell_j"), f"b.{value}")


def align_bilinear(dst: DataFrame, src: DataFrame, key: str, x: str, y: str, value: str, res: float, x0: float, y0: float) -> DataFrame:
    """Bilinear value of a source grid at points; null if any of the four cell centres around is missing.

    src: i, j, value, with cell (i, j) centred at x0 + (j + 0.5) res, y0 + (i + 0.5) res.
    """
    fx, fy = (F.col(x) - x0) / res - 0.5, (F.col(y) - y0) / res - 0.5
    base = dst.select(key, (fx - F.floor(fx)).alias("wx"), (fy - F.floor(fy)).alias("wy"), F.floor(fx).alias("j0"), F.floor(fy).alias("i0"))
    corner = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (0, 1) for b in (0, 1)]))
    four = base.select(key, "wx", "wy", "i0", "j0", corner.alias("c"))
    w = F.when(F.col("c.a") == 1, F.col("wy")).otherwise(1 - F.col("wy")) * F.when(F.col("c.b") == 1, F.col("wx")).otherwise(1 - F.col("wx"))
    four = four.select(key, w.alias("w"), (F.col("i0") + F.col("c.a")).alias("i"), (F.col("j0") + F.col("c.b")).alias("j"))
    met = four.join(src.select("i", "j", value), ["i", "j"], "left")
    agg = met.groupBy(key).agg(F.count(value).alias("n"), F.sum(F.col("w") * F.col(value)).alias("v"))
    return agg.select(key, F.when(F.col("n") == 4, F.col("v")).alias(value))


def tolerance_fill_bands(grid: DataFrame, values: list[str], tol: int) -> DataFrame:
    """Fill null cells of every band by inverse distances from cells valid in that band, in the window [-tol, tol) of rows and columns; others stay null.

    Only cells with a gap travel: they are exploded over the window and joined to the grid once for all bands.
    """
    offsets = [(a, b) for a in range(-tol, tol) for b in range(-tol, tol) if a or b]
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("di"), F.lit(b).alias("dj"), F.lit(1 / math.hypot(a, b)).alias("w")) for a, b in offsets]))
    gap = lambda c: F.col(c).isNull()
    some = functools.reduce(lambda x, y: x | y, map(gap, values))
    near = grid.where(some).select(F.col("i").alias("gi"), F.col("j").alias("gj"), step.alias("o"))
    near = near.select("gi", "gj", (F.col("gi") + F.col("o.di")).alias("i"), (F.col("gj") + F.col("o.dj")).alias("j"), "o.w")
    met = near.join(grid.where(~functools.reduce(lambda x, y: x & y, map(gap, values))).select("i", "j", *values), ["i", "j"])
    means = [(F.sum(F.col("w") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(f"__new_{c}") for c in values]
    new = met.groupBy(F.col("gi").alias("i"), F.col("gj").alias("j")).agg(*means)
    return grid.join(new, ["i", "j"], "left").withColumns({c: F.coalesce(c, f"__new_{c}") for c in values}).drop(*[f"__new_{c}" for c in values])


def tolerance_fill(grid: DataFrame, value: str, tol: int) -> DataFrame:
    """``tolerance_fill_bands`` of one band."""
    return tolerance_fill_bands(grid, [value], tol)


def zonal_mean(df: DataFrame, zone: str, layer: str, value: str) -> DataFrame:
    """``(zone, one column per layer)``: share masked, 1 - mean, as a pivot."""
    return df.groupBy(zone).pivot(layer).agg(1 - F.avg(value))


def bin_summary(features: DataFrame, cells: DataFrame, key: str, cell: str, metric: str) -> DataFrame:
    """Mean, count, count scaled by its largest, and shares of classes 0, 1 and 2 or more, per cell that features meet.

    features: key and metric; cells: key and cell, the cell sets of the features.
    """
    met = cells.distinct().join(features, key)
    share = lambda c: F.avg(c.cast("double"))
    m = F.col(metric)
    agg = met.groupBy(cell).agg(F.avg(m).alias("mean"), F.count("*").alias("n"), share(m <= 0).alias("share_0"), share((m > 0) & (m < 2)).alias("share_1"), share(m >= 2).alias("share_2"))
    top = agg.agg(F.max("n").alias("__top"))
    return agg.join(F.broadcast(top)).withColumn("scaled", F.col("n") / F.col("__top")).drop("__top")


def first_per_key(df: DataFrame, key: str, n: int, *order: Column | str) -> DataFrame:
    """The first ``n`` rows of each key (quota, sample by a hash order, or nearest members by distance)."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*order))).where(F.col("__r") <= n).drop("__r")
