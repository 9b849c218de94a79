"""Circular time and harmonics."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Length of the year of the harmonic basis, in days.
YEAR_DAYS = 365.25
DAYS = 365


def doy_diff(a: Column, b: Column, length: int = DAYS) -> Column:
    """Distance of two days of the year around the year's end."""
    d = F.abs(a - b)
    return F.least(d, length - d)


def doy_to_radians(date: Column) -> Column:
    """Angle of a date in its own year, leap years by their own length."""
    days = F.dayofyear(F.make_date(F.year(date), F.lit(12), F.lit(31)))
    return F.dayofyear(date) * (2 * pi) / days


def years_since_2000(ts: Column) -> Column:
    """Years of 365.25 days since 2000-01-01 UTC."""
    return (F.unix_millis(ts.cast("timestamp")) - 946684800000) / (YEAR_DAYS * 86400e3)


def time_radians(ts: Column) -> Column:
    """Years since 2000 as an angle, one turn a year."""
    return years_since_2000(ts) * (2 * pi)


def mid_time(start: Column, end: Column) -> Column:
    """The instant half way between two."""
    a, b = F.unix_millis(start.cast("timestamp")), F.unix_millis(end.cast("timestamp"))
    return F.timestamp_millis(F.floor(a + (b - a) / 2))


def week_bin(doy: Column) -> Column:
    """Week of the year, from 0."""
    return F.floor(doy / 7).cast("int")


def curve_value(day: Column, const: Column, sin1: Column, cos1: Column, sin2: Column, cos2: Column) -> Column:
    """Fitted seasonal curve at day 1 to 365; a trend term is not part of it."""
    w = day * (2 * pi / DAYS)
    return const + sin1 * F.sin(w) + cos1 * F.cos(w) + sin2 * F.sin(2 * w) + cos2 * F.cos(2 * w)


def cosim(a: list[Column], b: list[Column]) -> Column:
    """Cosine of two coefficient vectors; null if either is zero."""
    dot = sum((x * y for x, y in zip(a[1:], b[1:], strict=True)), a[0] * b[0])
    na, nb = (sum((x * x for x in v[1:]), v[0] * v[0]) for v in (a, b))
    return dot / F.nullif(F.sqrt(na * nb), F.lit(0.0))


def curve_distance(a: list[Column], b: list[Column], ddof: int = 1) -> Column:
    """Distance of two standardised curves of 365 days, from their harmonics alone (closed form)."""
    gap = 1 - cosim(a, b)
    return F.sqrt(2.0 * (DAYS - ddof) * F.when(gap < 0, 0.0).otherwise(gap))


def raw_curve_distance(const_a: Column, a: list[Column], const_b: Column, b: list[Column]) -> Column:
    """Distance of two curves as they are."""
    gap = sum(((x - y) * (x - y) for x, y in zip(a, b, strict=True)), F.lit(0.0))
    return F.sqrt(DAYS * (const_a - const_b) * (const_a - const_b) + DAYS / 2 * gap)


def curve_r2(a: list[Column], b: list[Column]) -> Column:
    """R-squared of two fitted curves."""
    return F.pow(cosim(a, b), 2)
