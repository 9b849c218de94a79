"""Distances on the sphere and on the WGS84 ellipsoid, and grid cells."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M = 6_371_008.0
#: Metres of a degree of latitude on that sphere.
DEGREE_M = EARTH_M * np.pi / 180


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle distance in metres; null if any coordinate is."""
    dlat, dlon = F.radians(lat2 - lat1), F.radians(lon2 - lon1)
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(h > 1, 1.0).otherwise(h)))


def haversine(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Great-circle distances in metres, inside tasks."""
    a, b = np.radians(lat1), np.radians(lat2)
    h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH_M * np.arcsin(np.sqrt(np.minimum(h, 1.0)))


def vincenty(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Inverse geodesic on WGS84 in metres (Vincenty 1975); nan where it does not converge (near antipodes)."""
    a, f = 6378137.0, 1 / 298.257223563
    b = (1 - f) * a
    u1, u2 = np.arctan((1 - f) * np.tan(np.radians(lat1))), np.arctan((1 - f) * np.tan(np.radians(lat2)))
    su1, cu1, su2, cu2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    gap = np.radians(lon2 - lon1)
    lam = gap.copy()
    with np.errstate(all="ignore"):
        for _ in range(200):
            ss = np.hypot(cu2 * np.sin(lam), cu1 * su2 - su1 * cu2 * np.cos(lam))
            cs = su1 * su2 + cu1 * cu2 * np.cos(lam)
            sigma = np.arctan2(ss, cs)
            sa = np.where(ss == 0, 0, cu1 * cu2 * np.sin(lam) / ss)
            c2a = 1 - sa**2
            cm = np.where(c2a == 0, 0, cs - 2 * su1 * su2 / c2a)
            c = f / 16 * c2a * (4 + f * (4 - 3 * c2a))
            new = gap + (1 - c) * f * sa * (sigma + c * ss * (cm + c * cs * (2 * cm**2 - 1)))
            moved = np.abs(new - lam)
            lam = new
            if not (moved > 1e-12).any():
                break
        u = c2a * (a**2 - b**2) / b**2
        big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        sm = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        ds = sm * ss * (cm + sm / 4 * (cs * (2 * cm**2 - 1) - sm / 6 * cm * (4 * ss**2 - 3) * (4 * cm**2 - 3)))
        return np.where(moved > 1e-9, np.nan, b * big * (sigma - ds))


@F.pandas_udf(T.DoubleType())
def vincenty_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """The geodesic distance of columns in metres; null for null coordinates and where it does not converge."""
    return pd.Series(vincenty(*(c.to_numpy(float) for c in (lon1, lat1, lon2, lat2))), index=lon1.index)


def cell_index(value: Column, origin: float, step: float, sign: int = 1) -> Column:
    """Number of the cell of width ``step`` that holds ``value``, counted from ``origin`` upwards (sign 1) or downwards (-1)."""
    return F.floor(sign * (value - F.lit(origin)) / step).cast("bigint")


def dms_to_degrees(deg: Column, minutes: Column, seconds: Column, sign: int = -1) -> Column:
    """Degrees, minutes and seconds as decimal degrees; missing seconds count as 0."""
    return sign * (deg + minutes / 60 + F.coalesce(F.nanvl(seconds.cast("double"), F.lit(0.0)), F.lit(0.0)) / 3600)


def hex_cell(lon: Column, lat: Column, edge_m: float) -> Column:
    """``(q, r)`` axial index of the hexagon of the given edge on a cylindrical equal-area plane."""
    x = F.radians(lon) * EARTH_M
    y = F.sin(F.radians(lat)) * EARTH_M
    q = (np.sqrt(3) / 3 * x - y / 3) / edge_m
    r = (2.0 / 3 * y) / edge_m
    rq, rr, rs = F.rint(q), F.rint(r), F.rint(-q - r)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs + q + r)
    fix_q = (dq > dr) & (dq > ds)
    return F.struct(
        F.when(fix_q, -rr - rs).otherwise(rq).cast("bigint").alias("q"),
        F.when(~fix_q & (dr > ds), -rq - rs).otherwise(rr).cast("bigint").alias("r"),
    )
