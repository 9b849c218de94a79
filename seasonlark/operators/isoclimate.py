"""Seasonal against climatic distance inside regions of high asynchrony, for a whole grid of clustering parameters in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlark.operators.asynchrony import HARMONICS
from seasonlark.operators.cluster import cell_areas
from seasonlark.operators.clean import percentile_filter
from seasonlark.operators.density import closing, dbscan, points_in_cells, run_cells
from seasonlark.operators.matrix_regression import Distance, mmrr_members
from seasonlark.operators.pairs import standardise_within
from seasonlark.operators.spatial import first_per_key, with_cell
from seasonlark.scratch import materialise


def parameter_sets(spark, eps: list[float], min_samples: list[float], alphas: list[float], done: DataFrame | None = None) -> DataFrame:
    """``(param_id, eps, min_samples, alpha)``: every combination, numbered from 1, less those whose values are in ``done``."""
    rows = [(k, float(e), float(m), float(a)) for k, (e, m, a) in enumerate(((e, m, a) for e in eps for m in min_samples for a in alphas), 1)]
    out = spark.createDataFrame(rows, "param_id int, eps double, min_samples double, alpha double")
    return out.join(done.select("eps", "min_samples", "alpha"), ["eps", "min_samples", "alpha"], "left_anti") if done is not None else out


def regions(asynchrony: DataFrame, params: DataFrame, value: str, res: float, y0: float, percentile: float = 0.95, min_area_km2: float = 756.25) -> tuple[DataFrame, DataFrame]:
    """``(cells, dropped)``: per parameter set and cluster the cells ``(i, j)`` of its footprint, and per set how many footprints were too small.

    asynchrony: a row per cell ``(i, j, lon, lat)``.  Cells at or above the percentile are clustered by density once per (eps,
    min_samples), where ``min_samples`` is a multiple of the grid's rows; footprints close a cluster with a disc of 1 / alpha degrees.
    """
    rows = asynchrony.agg(F.max("i") - F.min("i") + 1).first()[0] or 0
    top = materialise(percentile_filter(asynchrony, value, percentile).select("i", "j", "lon", "lat"), "top")
    kinds = params.select("eps", "min_samples").distinct().withColumn("kind", F.concat_ws("/", "eps", "min_samples"))
    # each clustering needs all the points: parameters are few
    every = top.join(F.broadcast(kinds)).withColumn("least", F.col("min_samples") * rows).withColumn("cell", F.struct("i", "j"))
    every = every.withColumn("k", F.col("i").cast("bigint") * (1 << 32) + F.col("j"))
    labels = dbscan(every, "k", "lon", "lat", "eps", "least", by="kind").where("label > 0")
    cells = labels.select("kind", "label", F.floor(F.col("k") / (1 << 32)).alias("i"), F.pmod("k", F.lit(1 << 32)).alias("j"))
    sets = params.withColumn("kind", F.concat_ws("/", "eps", "min_samples")).withColumn("r", F.greatest(F.lit(1), F.round(1 / F.col("alpha") / res)).cast("bigint"))
    spread = materialise(cells.join(F.broadcast(sets.select("kind", "param_id", "r")), "kind").select("param_id", F.col("label").alias("region"), "r", "i", "j"), "clusters")
    closed = materialise(run_cells(closing(spread, ["param_id", "region"], "i", "j", "r")), "footprints")
    areas = cell_areas(closed.withColumn("__g", F.struct("param_id", "region")), "__g", res, y0)
    big = areas.where(F.col("area_km2") >= min_area_km2).select("__g.param_id", "__g.region", "n_cells", "area_km2")
    dropped = areas.groupBy("__g.param_id").agg(F.sum((F.col("area_km2") < min_area_km2).cast("bigint")).alias("n_dropped"))
    return closed.join(big, ["param_id", "region"]), dropped


def isoclimate(
    asynchrony: DataFrame, coeffs: DataFrame, climate: DataFrame, params: DataFrame, value: str, env: list[str], res: float, x0: float, y0: float,
    percentile: float = 0.95, min_area_km2: float = 756.25, n_points: int = 1000, nperm: int = 499, geo: str = "geodesic", seed: int = 0,
) -> DataFrame:
    """Matrix regressions of seasonal on climatic and geographic distances among points drawn in every region of every parameter set.

    Three times ``n_points`` are drawn in each footprint, those without a curve or climate left out, and the first
    ``n_points`` kept.  Climate is standardised among a region's points.  Returns per parameter set and region its parameters,
    ``n_cells``, ``area_km2``, ``mean_lat``, means of ``env`` over the footprint, ``mean_clim_dist``, the regression's columns
    (intercept, clim_dist, geo_dist with t and p), ``n_dropped`` and ``failure``.  A set without regions has one row with a
    null region and its reason; a region without a model keeps its row.
    """
    spark = asynchrony.sparkSession
    # grids are small beside the observations that they may be made from, and each is read several times
    asynchrony = materialise(asynchrony.select("i", "j", "lon", "lat", value), "asynchrony")
    coeffs = materialise(coeffs.select("i", "j", *HARMONICS), "coeffs")
    climate = materialise(climate.select("i", "j", *env), "climate")
    cells, dropped = regions(asynchrony, params, value, res, y0, percentile, min_area_km2)
    cells = materialise(cells.withColumn("g", F.concat_ws("-", "param_id", "region")), "regions")
    lat = y0 - (F.col("i") + 0.5) * res
    about = cells.join(climate.select("i", "j", *env), ["i", "j"], "left").groupBy("g", "param_id", "region", "n_cells", "area_km2").agg(F.avg(lat).alias("mean_lat"), *[F.avg(c).alias(f"mean_{c}") for c in env])
    points = with_cell(points_in_cells(cells, "g", 3 * n_points, res, x0, y0, seed), "x", "y", res, x0, y0)
    some = F.greatest(*[F.abs(c) for c in HARMONICS]) > 0
    met = points.join(coeffs.select("i", "j", *HARMONICS).na.drop().where(some), ["i", "j"]).join(climate.select("i", "j", *env).na.drop(), ["i", "j"])
    kept = standardise_within(first_per_key(met, "g", n_points, "draw"), ["g"], env).na.fill(float("nan"), env)
    xs = [Distance("clim_dist", "euclid", tuple(env)), Distance("geo_dist", geo, ("x", "y"))]
    fitted = mmrr_members(kept, "g", "draw", Distance("seas", "curve", tuple(HARMONICS)), xs, nperm, seed, means=True)
    # a matrix's lower triangle with its diagonal of zeros
    own_zero = (F.col("n") - 1) / (F.col("n") + 1)
    fitted = fitted.withColumn("mean_clim_dist", F.col("clim_dist_mean") * own_zero).drop("clim_dist_mean", "geo_dist_mean", "seas_mean")
    out = about.join(fitted, "g", "left").drop("g")
    out = params.join(out, "param_id", "left").join(dropped, "param_id", "left").na.fill(0, ["n_dropped"])
    why = F.when(F.col("region").isNull(), "no regions").when(F.col("n").isNull(), "no points with data").otherwise(F.col("failure"))
    return out.withColumn("failure", why).withColumn("n", F.coalesce("n", F.lit(0)))
