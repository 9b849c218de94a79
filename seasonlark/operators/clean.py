"""Cleaning of observation tables: day steps, masks, sentinels, non-positive values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlark.operators.order import percentiles


def day_step_filter(df: DataFrame, date: str, start: str, end: str, step: int) -> DataFrame:
    """Rows on every ``step``-th calendar day from ``start`` to ``end``, both inclusive (a pushed-down range and a remainder)."""
    d = F.to_date(F.col(date))
    lo, hi = F.to_date(F.lit(start)), F.to_date(F.lit(end))
    return df.where((F.col(date) >= lo) & (d <= hi) & (F.date_diff(d, lo) % step == 0))


def nirv(nir: Column, red: Column, soil: float = 0.08) -> Column:
    """Near-infrared reflectance of vegetation; null where the bands sum to 0."""
    return ((nir - red) / F.nullif(nir + red, F.lit(0.0)) - soil) * nir


def qa_filter(df: DataFrame, cols: list[str], max_val: int) -> DataFrame:
    """Rows whose quality bands all are known and at most ``max_val``."""
    for c in cols:
        df = df.where(F.col(c) <= max_val)
    return df


def null_sentinels(df: DataFrame, sentinels: dict[str, list[float]]) -> DataFrame:
    """Nodata values and NaN become null."""
    return df.withColumns({c: F.when(F.col(c).isin(vals) | F.isnan(F.col(c).cast("double")), None).otherwise(F.col(c)) for c, vals in sentinels.items()})


def min_positive(df: DataFrame, keys: list[str], value: str, out: str = "min_pos") -> DataFrame:
    """Smallest positive value of each group; null if it has none."""
    return df.groupBy(*keys).agg(F.min(F.when(F.col(value) > 0, F.col(value))).alias(out))


def with_group_value(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with the columns of their group, of which there is a row a key: a task hashes its groups and does not sort its rows."""
    return df.join(groups.hint("shuffle_hash"), keys, "left")


def clamp_nonpositive(df: DataFrame, keys: list[str], value: str, mode: str = "clamp", fill_missing: bool = False) -> DataFrame:
    """Values at or below 0 become the group's smallest positive value (``clamp``) or go (``drop``); then nulls may be filled with it.

    A group without positive values has nothing to clamp to, and its values become null.
    """
    if mode not in ("clamp", "drop"):
        raise ValueError(mode)
    v = F.col(value)
    least = min_positive(df, keys, value, "__least")
    if mode == "drop":
        df = df.where((v > 0) | v.isNull()) if fill_missing else df.where(v > 0)
    if mode == "drop" and not fill_missing:
        return df
    joined = with_group_value(df, least, keys)
    new = F.when(v <= 0, F.col("__least")).otherwise(v) if mode == "clamp" else v
    if fill_missing:
        new = F.coalesce(new, F.col("__least"))
    return joined.withColumn(value, new).drop("__least")


def bit_flag(value: Column, bit: int) -> Column:
    """One bit of an integer, 0 or 1."""
    return F.getbit(value.cast("bigint"), F.lit(bit)).cast("int")


def never_flagged(df: DataFrame, keys: list[str], flag: str) -> DataFrame:
    """Keys whose flag is 0 in every row (water mask)."""
    return df.groupBy(*keys).agg(F.max(flag).alias("__f")).where(F.coalesce("__f", F.lit(0)) == 0).select(*keys)


def percentile_filter(df: DataFrame, value: str, share: float) -> DataFrame:
    """Rows at or above an exact percentile (linear interpolation) of the column, which is selected first; nulls and NaN are left out."""
    cut = percentiles(df, value, [share])[0]
    return df.where(~F.isnan(F.col(value).cast("double")) & (F.col(value) >= F.lit(cut).cast("double")))


def bounding_box(df: DataFrame, lon: str, lat: str, box: tuple[float, float, float, float]) -> DataFrame:
    """Rows inside (west, south, east, north), edges included."""
    w, s, e, n = box
    return df.where(F.col(lon).between(w, e) & F.col(lat).between(s, n))


def capped_groups(df: DataFrame, key: str, order: list, least: int, most: int) -> DataFrame:
    """Rows of groups with at least ``least`` rows, the first ``most`` of each by ``order`` (the reference's quota)."""
    from pyspark.sql import Window as W

    n = F.count("*").over(W.partitionBy(key))
    rank = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return df.withColumns({"__n": n, "__r": rank}).where((F.col("__n") >= least) & (F.col("__r") <= most)).drop("__n", "__r")


def sample_size_filter(df: DataFrame, doy: str, size: str, limit: int = 5, keep_small: bool = True) -> DataFrame:
    """Non-negative days whose sample size is below the limit (as published), or not below it."""
    ok = F.col(size) < limit
    return df.where((F.col(doy) >= 0) & (ok if keep_small else ~ok))


def flux_filter(
    df: DataFrame, response: str, qc: str, date: str, min_qc: float = 0.7, sentinel: float = -9999.0, between: tuple[str, str] | None = None,
    main: Column | None = None, file: str | None = None, methane: str = "FLUXNET-CH4_",
) -> DataFrame:
    """Flux days with a response, in a date range if one is given, and of good quality.

    main: where quality counts (only main sites publish it comparably); everywhere if None.
    file: column of file names; files of the methane network are left out.
    """
    good = F.col(qc) >= min_qc
    out = df.where((good if main is None else ~F.coalesce(main, F.lit(False)) | good) & (F.col(response) != sentinel))
    if file:
        out = out.where(~F.coalesce(F.contains(F.col(file), F.lit(methane)), F.lit(False)))
    return out.where(F.col(date).between(*between)) if between else out


def usable_sites(df: DataFrame, igbp: str, dropped: tuple[str, ...] = ("WAT", "URB", "CRO")) -> DataFrame:
    """Results of sites whose cover is not water, built-up or cropland; an unknown cover stays."""
    return df.where(~F.coalesce(F.col(igbp).isin(*dropped), F.lit(False)))


def extreme_range(df: DataFrame, key: str, lat: str, south: float = -10.0, north: float = 10.0) -> DataFrame:
    """Keys that reach from at most ``south`` to at least ``north``."""
    return df.groupBy(key).agg(F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max")).where((F.col("lat_min") <= south) & (F.col("lat_max") >= north))
