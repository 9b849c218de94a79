"""Principal modes of fitted curves from their small moment matrix."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlark.operators.asynchrony import HARMONICS


def eof(coeffs: DataFrame, keys: list[str], lat: str | None = "lat", weight: str | None = "sqrt_cos", n: int = 4) -> tuple[DataFrame, list[dict]]:
    """``(pixels, modes)``: per pixel the correlation with each mode; per mode its share of variance and its PC over 365 days.

    A standardised curve is its unit coefficient vector, so the data's covariance is a 4 x 4 sum
    over pixels: one aggregate, an eigenproblem on the driver, one projection.  Signs are fixed by
    the largest loading.
    """
    b = [F.col(c) for c in HARMONICS]
    norm = F.sqrt(sum((x * x for x in b[1:]), b[0] * b[0]))
    unit = coeffs.where(norm > 0).withColumns({f"__q{i}": x / norm for i, x in enumerate(b)})
    cos = F.cos(F.radians(F.col(lat))) if lat else F.lit(1.0)
    w2 = {None: F.lit(1.0), "cos": F.pow(cos, 2.0), "sqrt_cos": cos}[weight]
    m = unit.agg(*[F.sum(w2 * F.col(f"__q{i}") * F.col(f"__q{j}")) for i in range(4) for j in range(4)]).first()
    mat = np.array([x or 0.0 for x in m], float).reshape(4, 4)
    val, vec = np.linalg.eigh(mat)
    val, vec = val[::-1], vec[:, ::-1]
    vec = vec * np.where(vec[np.abs(vec).argmax(axis=0), range(4)] < 0, -1, 1)
    share = val / val.sum() if val.sum() > 0 else val
    day = np.arange(1, 366) * 2 * np.pi / 365
    basis = np.stack([np.sin(day), np.cos(day), np.sin(2 * day), np.cos(2 * day)], axis=1) * np.sqrt(2)
    modes = [{"mode": k, "share": float(share[k]), "pc": (basis @ vec[:, k]).tolist(), "vector": vec[:, k].tolist()} for k in range(n)]
    cols = [sum((F.col(f"__q{i}") * float(vec[i, k]) for i in range(1, 4)), F.col("__q0") * float(vec[0, k])).alias(f"eof{k}") for k in range(n)]
    return unit.select(*keys, *cols), modes


def rescale(bands: DataFrame, cols: list[str]) -> DataFrame:
    """Each column to [0, 1] over the whole table."""
    ends = bands.agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate(cols) for n, f in (("a", F.min), ("b", F.max))])
    out = bands.join(F.broadcast(ends))
    return out.withColumns({c: (F.col(c) - F.col(f"__a{i}")) / F.nullif(F.col(f"__b{i}") - F.col(f"__a{i}"), F.lit(0.0)) for i, c in enumerate(cols)}).drop(*ends.columns)
