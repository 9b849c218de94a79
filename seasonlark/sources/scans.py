"""Scans of observation products with their masks and flags: what an analysis reads before it fits anything.

Every scan keeps to column expressions and equi-joins on (pixel, time), so date ranges and columns reach the files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlark.functions.seasons import mid_time, time_radians
from seasonlark.operators.clean import bit_flag, clamp_nonpositive, day_step_filter, min_positive, never_flagged, nirv, qa_filter, with_group_value
from seasonlark.operators.records import mean_temperature
from seasonlark.operators.spatial import resample_mean


def without_water(df: DataFrame, keys: list[str], water: DataFrame, flag: str, dealt: bool = False) -> DataFrame:
    """Rows of keys that ``water`` (keys, flag, any number of years) knows and never flags.

    dealt: the rows already lie by their keys, so a task hashes its part of the mask and does not sort its rows.
    """
    land = never_flagged(water, keys, flag)
    return df.join(land.hint("shuffle_hash") if dealt else land, keys, "left_semi")


def product_scan(
    df: DataFrame, keys: list[str], value: str, clamp_to_min: bool = False, fill_with_min: bool = False,
    water: DataFrame | None = None, flag: str = "water",
) -> DataFrame:
    """A product with its three flags: values at or below 0 raised to the pixel's smallest positive one, nulls filled with it, water pixels left out.

    Without a positive value in a pixel its clamped values are null.
    """
    if clamp_to_min:
        df = clamp_nonpositive(df, keys, value, "clamp", fill_with_min)
    elif fill_with_min:
        df = with_group_value(df, min_positive(df, keys, value, "__least"), keys).withColumn(value, F.coalesce(value, "__least")).drop("__least")
    return df if water is None else without_water(df, keys, water, flag, dealt=clamp_to_min or fill_with_min)


def reflectance_scan(
    bands: DataFrame, quality: DataFrame, keys: list[str], date: str, nir: str, red: str, qa: list[str], max_qa: int,
    start: str, end: str, step: int, water: DataFrame | None = None, flag: str = "water",
) -> DataFrame:
    """``(keys, date, nirv)`` of every ``step``-th day whose quality bands, joined on keys and date, all are at most ``max_qa``."""
    days = day_step_filter(bands, date, start, end, step).select(*keys, date, nir, red)
    good = qa_filter(day_step_filter(quality, date, start, end, step), qa, max_qa).select(*keys, date).distinct()
    if water is not None:
        days = without_water(days, keys, water, flag)
    return days.join(good, [*keys, date], "left_semi").select(*keys, date, nirv(F.col(nir), F.col(red)).alias("nirv"))


def climate_scan(df: DataFrame, x: str, y: str, res: float, start: str, end: str, values: list[str], tmin: str, tmax: str, water: DataFrame | None = None, flag: str = "water") -> DataFrame:
    """``(cx, cy, ts, t, values, tmmean)``: means of the fine cells of each coarse cell and interval, at the interval's middle, which is ``t`` as an angle.

    water: cx, cy and the flag.
    """
    timed = df.withColumn("ts", mid_time(F.col(start), F.col(end)))
    out = resample_mean(timed, ["ts"], x, y, res, values)
    if water is not None:
        out = without_water(out, ["cx", "cy"], water, flag)
    return out.withColumns({"t": time_radians(F.col("ts")), "tmmean": mean_temperature(F.col(tmin), F.col(tmax))})


def _cloud(sensor: DataFrame, keys: list[str], date: str, start: str, end: str, n_obs: str, state: str, bit: int) -> DataFrame:
    seen = sensor.where((F.col(date) >= F.to_date(F.lit(start))) & (F.col(date) < F.to_date(F.lit(end))) & (F.col(n_obs) > 0))
    return seen.groupBy(*keys, date).agg(F.avg(bit_flag(F.col(state), bit)).alias("cloud"))


def cloud_scan(a: DataFrame, b: DataFrame, keys: list[str], date: str, start: str, end: str, n_obs: str = "n_obs", state: str = "state", bit: int = 10) -> DataFrame:
    """``(keys, date, cloud)``: mean of two sensors' cloud bits on days from ``start`` to before ``end`` that both have observed; other days are lost, as published."""
    one, two = (_cloud(s, keys, date, start, end, n_obs, state, bit) for s in (a, b))
    met = one.withColumnRenamed("cloud", "__a").join(two, [*keys, date])
    return met.select(*keys, date, ((F.col("__a") + F.col("cloud")) / 2).alias("cloud"))


def class_scan(df: DataFrame, keys: list[str], year: str, cls: str, first: int, last: int, remap: dict[int, int] | None = None) -> DataFrame:
    """``(keys, year, cls)`` of the years ``first`` to ``last``, both inclusive, classes renamed where ``remap`` names them."""
    c: Column = F.col(cls)
    if remap:
        named = F.create_map(*[F.lit(v) for kv in remap.items() for v in kv])
        c = F.coalesce(F.get(F.map_values(F.map_filter(named, lambda k, _: k == F.col(cls))), F.lit(0)), c)
    return df.where(F.col(year).between(first, last)).select(*keys, year, c.alias(cls))
