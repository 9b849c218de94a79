"""Focal statistics of a regular longitude-latitude grid within a great-circle radius, by prefix sums along rows.

The cells of a row within the radius of a cell are a run of columns as wide as the chord between
the two latitudes, so a row's part of a focal sum is a difference of two prefix sums: a cell costs as many
look-ups as the radius spans rows, where pairs cost the square of that.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlark.functions.geo import DEGREE_M, EARTH_M, haversine

#: A tile is at least so many rows and columns, so that small radii don't make many small tasks.
LEAST_ROWS, LEAST_COLS = 16, 64
#: Shares of a tile's variance below this are noise of the prefix sums.
NOISE = 1e-13


class _Grid:
    """Rows southwards from ``north``, columns eastwards around the whole circle of latitude, and the tiles they are dealt in."""

    def __init__(self, res: float, north: float, radius_m: float):
        self.res, self.north, self.radius_m = res, north, radius_m
        self.n_cols = round(360 / res)
        if abs(self.n_cols * res - 360) > 1e-6:
            raise ValueError("cells must divide the circle of latitude")
        self.reach = int(radius_m / DEGREE_M / res + 1e-9)
        self.height = max(self.reach, LEAST_ROWS)

    def lat(self, i: np.ndarray) -> np.ndarray:
        return self.north - (i + 0.5) * self.res

    def half_chords(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Columns to either side of row ``i``'s cells that lie within the radius in each of ``rows``; -1 for none."""
        a, b = (np.radians(self.lat(x)) for x in (np.array(i), rows))
        rest = math.sin(min(self.radius_m / EARTH_M / 2, math.pi / 2)) ** 2 - np.sin((a - b) / 2) ** 2
        flat = np.cos(a) * np.cos(b)
        with np.errstate(all="ignore"):
            turn = 2 * np.degrees(np.arcsin(np.sqrt(np.clip(rest / flat, 0, 1)))) / self.res
        w = np.clip(np.nan_to_num(turn), 0, self.n_cols // 2 + 1).astype(np.int64)
        near = lambda k: haversine(0.0, self.lat(np.array(i)), k * self.res, self.lat(rows)) <= self.radius_m
        # rounding may put the last column on either side: distances decide
        w = np.where((w > 0) & ~near(w), w - 1, w)
        w = np.where((2 * (w + 1) <= self.n_cols) & near(w + 1), w + 1, w)
        return np.where(near(np.zeros_like(w)), w, -1)


def _dealt(cells: DataFrame, grid: _Grid) -> DataFrame:
    """Cells copied to every tile whose own cells may reach them: up to three strips of rows, up to three tiles of columns in each."""
    i, j = F.col("i").cast("bigint"), F.col("j").cast("bigint")
    strips = F.sequence(F.floor((i - grid.reach) / grid.height), F.floor((i + grid.reach) / grid.height))
    out = cells.withColumn("strip", F.explode(strips))
    edge = lambda k: F.lit(grid.north) - (k + 0.5) * grid.res
    top, foot = edge(F.col("strip") * grid.height - grid.reach), edge((F.col("strip") + 1) * grid.height - 1 + grid.reach)
    flat = F.cos(F.radians(F.least(F.lit(90.0), F.greatest(F.abs(top), F.abs(foot)))))
    sine, half = math.sin(min(grid.radius_m / EARTH_M / 2, math.pi / 2)), grid.n_cols // 2 + 1
    # columns to either side that a circle around any cell of the strip may reach, and one for rounding
    wide = F.least(F.lit(half), F.floor(F.degrees(2 * F.asin(F.least(F.lit(1.0), sine / flat))) / grid.res).cast("bigint") + 2)
    out = out.withColumn("__w", F.when(F.lit(sine) >= flat, F.lit(half)).otherwise(wide).cast("bigint"))
    tiles = F.greatest(F.lit(1).cast("bigint"), F.floor(F.lit(grid.n_cols) / F.greatest(F.col("__w"), F.lit(LEAST_COLS))).cast("bigint"))
    place = lambda k: F.floor(F.pmod(k, F.lit(grid.n_cols)) * F.col("__t") / grid.n_cols).cast("bigint")
    out = out.withColumn("__t", tiles)
    return out.withColumn("tile", F.explode(F.array_distinct(F.array(place(j - F.col("__w")), place(j), place(j + F.col("__w")))))).drop("__w").withColumnRenamed("__t", "tiles")


def _sums(grid: _Grid, own: tuple[int, int, int, int], frame: pd.DataFrame, columns: list[np.ndarray]) -> np.ndarray:
    """Focal sums of each of ``columns`` (a value a row of ``frame``) for the cells of the tile ``own`` (first and last row, first and last column)."""
    r0, r1, c0, c1 = own
    i, j = frame["i"].to_numpy(np.int64), frame["j"].to_numpy(np.int64) % grid.n_cols
    n, across = grid.n_cols, c1 - c0 + 1
    low = r0 - grid.reach
    out = np.zeros((len(columns), r1 - r0 + 1, across))
    by_row = pd.Series(np.arange(len(i))).groupby(i).indices
    chords = {a: grid.half_chords(a, np.arange(a - grid.reach, a + grid.reach + 1)) for a in range(r0, r1 + 1)}
    for b in range(low, r1 + grid.reach + 1):
        if b not in by_row:
            continue
        at = by_row[b]
        served = [(a, int(chords[a][b - a + grid.reach])) for a in range(max(r0, b - grid.reach), min(r1, b + grid.reach) + 1)]
        w_max = max(w for _, w in served)
        if w_max < 0:
            continue
        # columns from c0 - w_max to c1 + w_max around the circle; a cell may lie there more than once
        span = across + 2 * w_max
        lines = np.zeros((len(columns), span + 1))
        off = (j[at] - (c0 - w_max)) % n
        for k in range(-(-span // n)):
            inside = off + k * n < span
            for x, col in zip(lines, columns, strict=True):
                np.add.at(x, off[inside] + k * n + 1, col[at][inside])
        lines = lines.cumsum(axis=1)
        for a, w in served:
            if w < 0:
                continue
            if 2 * w + 1 >= n:
                out[:, a - r0] += np.array([c[at].sum() for c in columns])[:, None]
            else:
                lo = w_max - w
                out[:, a - r0] += lines[:, lo + 2 * w + 1 : lo + 2 * w + 1 + across] - lines[:, lo : lo + across]
    return out


def _tile_of(grid: _Grid, strip: int, tile: int, tiles: int) -> tuple[int, int, int, int]:
    first = lambda t: -(-t * grid.n_cols // tiles)
    return strip * grid.height, (strip + 1) * grid.height - 1, first(tile), first(tile + 1) - 1


def _per_tile(grid: _Grid, stat: Callable[[_Grid, tuple, pd.DataFrame], np.ndarray]) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def of_tile(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        own = _tile_of(grid, int(key[0]), int(key[1]), int(frame["tiles"].iloc[0]))
        r0, r1, c0, c1 = own
        here = frame["i"].between(r0, r1) & (frame["j"] % grid.n_cols).between(c0, c1)
        cells = frame.loc[here, ["i", "j"]].drop_duplicates()
        if cells.empty:
            return pd.DataFrame({"i": [], "j": [], "n": [], "stat": []})
        n, values = stat(grid, own, frame)
        at = (cells["i"].to_numpy(np.int64) - r0, cells["j"].to_numpy(np.int64) % grid.n_cols - c0)
        return pd.DataFrame({"i": cells["i"], "j": cells["j"], "n": np.rint(n[at]).astype(np.int64), "stat": values[at]})

    return of_tile


def _deviation(grid: _Grid, own: tuple, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n, s, q = (frame[c].to_numpy(float) for c in ("n", "s", "q"))
    mean = s.sum() / n.sum()
    # moments around the tile's mean: q was taken around each cell's own
    gap = s / n - mean
    around = q + n * gap**2
    count, total, square = _sums(grid, own, frame, [n, n * gap, around])
    with np.errstate(all="ignore"):
        var = square / count - (total / count) ** 2
    var = np.where(var < NOISE * (around.sum() / n.sum()), 0.0, var)
    return count, np.sqrt(var)


def _entropy(grid: _Grid, own: tuple, frame: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    n = frame["n"].to_numpy(float)
    count, logs = None, None
    for k in sorted(frame["cls"].unique()):
        (c,) = _sums(grid, own, frame, [np.where(frame["cls"] == k, n, 0.0)])
        c = np.rint(c)
        part = np.where(c > 0, c * np.log2(np.maximum(c, 1)), 0.0)
        count, logs = (c, part) if count is None else (count + c, logs + part)
    with np.errstate(all="ignore"):
        bits = np.log2(count) - logs / count
    return count, np.clip(bits, 0.0, 1.0)


def focal_grid(cells: DataFrame, radius_m: float, value: str, kind: str, res: float, north: float) -> DataFrame:
    """``(i, j, n, stat)`` for every cell with a value: population standard deviation (``stddev``) or class entropy in bits,
    clamped to [0, 1] (``entropy``), of the ``n`` values within ``radius_m`` of its centre, its own included.

    cells: i (row, southwards, its centre at latitude north - (i + 0.5) res), j (column, eastwards from any meridian; the
    circle has 360 / res columns and closes) and a value.  Several values of a cell all count; null and NaN values and cells without
    an index don't.  Latitudes beyond a pole are an error.  A task holds one tile of cells and its halo: some 3 x 3 radii,
    or whole rows where a circle around the pole needs them.
    """
    if kind not in ("stddev", "entropy"):
        raise ValueError(kind)
    grid = _Grid(res, north, radius_m)
    v = F.col(value)
    known = cells.where(v.isNotNull() & F.col("i").isNotNull() & F.col("j").isNotNull())
    known = known.select(_checked(F.col("i").cast("bigint"), grid).alias("i"), F.pmod(F.col("j").cast("bigint"), F.lit(grid.n_cols)).alias("j"), v.alias("v"))
    if kind == "stddev":
        v = F.col("v").cast("double")
        moments = known.where(~F.isnan(v)).groupBy("i", "j").agg(F.count(v).alias("n"), F.avg(v).alias("__m"), F.var_pop(v).alias("__q"))
        rows, stat = moments.select("i", "j", "n", (F.col("n") * F.col("__m")).alias("s"), (F.col("n") * F.col("__q")).alias("q")), _deviation
    else:
        rows, stat = known.groupBy("i", "j", F.col("v").alias("cls")).agg(F.count("*").alias("n")), _entropy
    return _dealt(rows, grid).groupBy("strip", "tile").applyInPandas(_per_tile(grid, stat), "i long, j long, n long, stat double")


def _checked(i: Column, grid: _Grid) -> Column:
    lat = F.lit(grid.north) - (i + 0.5) * grid.res
    return F.when(F.abs(lat) <= 90, i).otherwise(F.raise_error(F.lit("row beyond a pole")).cast("bigint"))
