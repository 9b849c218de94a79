"""Availability, evenness, class and overall masks per pixel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Days of each month, February always 28.
MONTH_DAYS = [31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]


def monthly_availability(df: DataFrame, keys: list[str], date: str, value: str, n_years: float, step: int) -> DataFrame:
    """Share of possible dates with a value, per key and month, clamped to [0.0001, 1]."""
    days = F.array(*map(F.lit, MONTH_DAYS))
    n = df.groupBy(*keys, F.month(date).alias("month")).agg(F.count(value).alias("n"))
    share = F.col("n") / n_years / (F.get(days, F.col("month") - 1) / step)
    return n.select(*keys, "month", F.greatest(F.least(share, F.lit(1.0)), F.lit(1e-4)).alias("prop"))


def min_month_mask(avail: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """Whether every month reaches ``least``; an absent month counts as 0."""
    agg = avail.groupBy(*keys).agg(F.count_distinct("month").alias("months"), F.min("prop").alias("low"))
    low = F.when(F.col("months") == 12, F.col("low")).otherwise(0.0)
    return agg.select(*keys, low.alias("min_prop"), (low >= least).cast("int").alias("ok"))


def pielou_evenness(avail: DataFrame, keys: list[str]) -> DataFrame:
    """Evenness of the monthly shares over ln 12, for keys with all twelve months (one aggregate: H = ln S - sum(p ln p) / S)."""
    p = F.col("prop")
    agg = avail.groupBy(*keys).agg(F.sum(p).alias("s"), F.sum(p * F.log(p)).alias("pl"), F.count("*").alias("n")).where("n = 12")
    return agg.select(*keys, ((F.log("s") - F.col("pl") / F.col("s")) / F.log(F.lit(12.0))).alias("evenness"))


def availability(df: DataFrame, keys: list[str], value: str, n_dates: int) -> DataFrame:
    """Share of all dates with a value."""
    return df.groupBy(*keys).agg((F.count(value) / n_dates).alias("availability"))


def remap(value: Column, table: dict[int, int], default: int = 0) -> Column:
    """Classes to classes; others and null to the default."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.get(F.array(F.try_element_at(F.create_map(*pairs), value)), F.lit(0)), F.lit(default))


def always_class(df: DataFrame, keys: list[str], cls: str, natural: list[int], farmed: list[int]) -> DataFrame:
    """0: changing or neither; 1: always natural or farmed; 2: always natural."""
    nat, both = F.col(cls).isin(natural), F.col(cls).isin(natural + farmed)
    return df.groupBy(*keys).agg((F.bool_and(F.coalesce(both, F.lit(False))).cast("int") + F.bool_and(F.coalesce(nat, F.lit(False))).cast("int")).alias("land"))


def modal_class(df: DataFrame, keys: list[str], cls: str, out: str = "mode") -> DataFrame:
    """Most frequent class, the smallest on ties; counts are summed before they meet."""
    n = df.where(F.col(cls).isNotNull()).groupBy(*keys, cls).count()
    return n.groupBy(*keys).agg(F.max_by(cls, F.struct("count", (-F.col(cls)).alias("s"))).alias(out))


def structure_class(cls: Column, groups: dict[int, list[int]]) -> Column:
    """Classes to structure groups; null for others."""
    out = F.lit(None).cast("int")
    for g, members in groups.items():
        out = F.when(cls.isin(members), g).otherwise(out)
    return out


def overall_mask(parts: DataFrame, strict: bool = False, min_evenness: float = 0.8, min_availability: float = 0.5) -> DataFrame:
    """Add ``ok``: enough evenness and availability, land class above 0 (1 if strict), significant fit.

    Missing evenness counts as 0, and evenness is clamped to [0, 1]; any other missing part masks.
    """
    even = F.greatest(F.least(F.coalesce("evenness", F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    ok = (even >= min_evenness) & (F.col("land") > (1 if strict else 0)) & (F.col("availability") >= min_availability) & (F.col("significant") == 1)
    return parts.withColumn("ok", F.coalesce(ok, F.lit(False)).cast("int"))


def apply_mask(df: DataFrame, mask: DataFrame, keys: list[str], variable: str, masked: list[str]) -> DataFrame:
    """Drop masked pixels of some variables; rows of other variables stay."""
    ok = mask.where("ok = 1").select(*keys, F.lit(1).alias("__ok")).distinct()
    return df.join(ok, keys, "left").where(~F.col(variable).isin(masked) | F.col("__ok").isNotNull()).drop("__ok")
