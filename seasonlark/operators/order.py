"""Exact order statistics and exact shares of strata without sorting a table or holding a column in one task.

Percentiles are selected by narrowing brackets: approximate percentiles of the rows between two
values propose closer ones, counts decide whether the wanted rank lies there, and the last few
rows are sorted.  Shares are selected by a histogram of hashes: only the bin that the share ends in is sorted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Relative error of a proposal is one part in this many; each round narrows a bracket by about a quarter of it.
ACCURACY = 1000
#: Brackets of at most so many rows are sorted.
FEW = 5000
#: Thresholds of at most so many strata are sent to every task.
MOST_SENT = 100_000
#: Hexadecimal digits of a hash that make a bin.
DIGITS = 4


@dataclass
class _Bracket:
    """Values from ``low`` to ``high`` (ends included, None: open) hold the 0-based ``rank`` of the column; ``below`` rows lie under ``low``."""

    rank: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    rows: int = 0

    def holds(self, v: Column) -> Column:
        out = v.isNotNull()
        if self.low is not None:
            out &= v >= self.low
        return out if self.high is None else out & (v <= self.high)


def _proposed(rows: DataFrame, v: Column, todo: list[_Bracket]) -> list[tuple[float, float]]:
    """Values that should lie just under and just over each wanted rank."""
    cols = []
    for k, b in enumerate(todo):
        at = (b.rank - b.below + 0.5) / b.rows
        ends = [max(0.0, at - 2 / ACCURACY), min(1.0, at + 2 / ACCURACY)]
        cols.append(F.percentile_approx(F.when(b.holds(v), v), ends, ACCURACY).alias(f"c{k}"))
    return [tuple(x) for x in rows.agg(*cols).first()]


def _counted(rows: DataFrame, v: Column, todo: list[_Bracket], ends: list[tuple[float, float]]) -> list[tuple[int, int, int]]:
    """Rows of each bracket under the first end, between the ends and over the second."""
    cols = []
    for k, (b, (lo, hi)) in enumerate(zip(todo, ends, strict=True)):
        inside = b.holds(v)
        cols += [F.count_if(inside & c).alias(f"{n}{k}") for n, c in (("u", v < lo), ("m", (v >= lo) & (v <= hi)), ("o", v > hi))]
    got = rows.agg(*cols).first()
    return [(got[f"u{k}"], got[f"m{k}"], got[f"o{k}"]) for k in range(len(todo))]


def order_statistics(df: DataFrame, value: str, ranks: list[int]) -> list[float]:
    """The values at 0-based ``ranks`` of a numeric column, nulls and NaN left out; IndexError for a rank that it has not.

    A round is two aggregates over the column for all ranks together.  Brackets that a proposal misses
    move to the side that counts point at, so the result is exact whatever the proposals are worth.
    """
    v = F.col("__v")
    rows = df.select(F.col(value).cast("double").alias("__v")).where(v.isNotNull() & ~F.isnan(v))
    n = rows.count()
    if any(not 0 <= r < n for r in ranks):
        raise IndexError(f"ranks {ranks} of {n} rows")
    brackets = {r: _Bracket(r, rows=n) for r in ranks}
    while todo := [b for b in brackets.values() if b.rows > FEW and (b.low is None or b.low != b.high)]:
        ends = _proposed(rows, v, todo)
        for b, (lo, hi), (under, middle, over) in zip(todo, ends, _counted(rows, v, todo, ends), strict=True):
            at = b.rank - b.below
            if at < under:
                b.high, b.rows = _below(rows, v, b, lo), under
            elif at < under + middle:
                b.low, b.high, b.below, b.rows = lo, hi, b.below + under, middle
            else:
                b.low, b.below, b.rows = _above(rows, v, b, hi), b.below + under + middle, over
    return _read(rows, v, [brackets[r] for r in ranks])


def _below(rows: DataFrame, v: Column, b: _Bracket, end: float) -> float:
    return rows.agg(F.max(F.when(b.holds(v) & (v < end), v))).first()[0]


def _above(rows: DataFrame, v: Column, b: _Bracket, end: float) -> float:
    return rows.agg(F.min(F.when(b.holds(v) & (v > end), v))).first()[0]


def _read(rows: DataFrame, v: Column, brackets: list[_Bracket]) -> list[float]:
    """The wanted value of every bracket: its only one, or one of few rows in order."""
    small = [b for b in brackets if b.low is None or b.low != b.high]
    found = {b.rank: b.low for b in brackets}
    if small:
        kept = [F.element_at(F.sort_array(F.collect_list(F.when(b.holds(v), v))), b.rank - b.below + 1).alias(f"c{k}") for k, b in enumerate(small)]
        found |= {b.rank: x for b, x in zip(small, rows.agg(*kept).first(), strict=True)}
    return [found[b.rank] for b in brackets]


def percentiles(df: DataFrame, value: str, shares: list[float]) -> list[float | None]:
    """Exact percentiles with linear interpolation between neighbours; nulls and NaN are left out, None for a column of nothing else."""
    v = F.col(value).cast("double")
    n = df.where(v.isNotNull() & ~F.isnan(v)).count()
    if not n:
        return [None] * len(shares)
    spots = [(n - 1) * s for s in shares]
    wanted = sorted({r for s in spots for r in (int(s), min(int(s) + 1, n - 1))})
    at = dict(zip(wanted, order_statistics(df, value, wanted), strict=True))
    mixed = lambda s: at[int(s)] if s == int(s) else (int(s) + 1 - s) * at[int(s)] + (s - int(s)) * at[int(s) + 1]
    return [mixed(s) for s in spots]


def hash_shares(df: DataFrame, strata: str, key: str, share: float, seed: int = 0, n_strata: int | None = None) -> DataFrame:
    """Add ``taken`` (boolean): whether a row is among the first round(rows * share) of its stratum by md5 of the seed and the key.

    Bins of hashes are counted per stratum, the bin that the share ends in is sorted, and the hash there
    decides for all rows, which stay where they are: no stratum is gathered, however few there are.
    Rows of one key stand or fall together, so a repeated key may carry a share beyond its number.
    Given ``n_strata``, a bound on the number of strata, their thresholds (a row each) go to every task; else they are joined.
    """
    sent = F.broadcast if n_strata is not None and n_strata <= MOST_SENT else lambda t: t
    h = F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary"))
    rows = df.withColumn("__h", h)
    part = F.substring("__h", 1, DIGITS).alias("__bin")
    hashes = rows.select(F.col(strata).alias("__of"), "__h", part)
    bins = hashes.groupBy("__of", "__bin").agg(F.count("*").alias("__n"))
    of, upto = W.partitionBy("__of"), W.partitionBy("__of").orderBy("__bin")
    bins = bins.withColumns({"__upto": F.sum("__n").over(upto), "__want": F.round(F.sum("__n").over(of) * share)})
    last = bins.where((F.col("__want") > F.col("__upto") - F.col("__n")) & (F.col("__want") <= F.col("__upto")))
    last = last.select(F.col("__of").alias("__s"), F.col("__bin").alias("__b"), (F.col("__want") - F.col("__upto") + F.col("__n")).alias("__rest"))
    # one row a stratum and bin: the share ends in one bin of each
    inside = hashes.join(sent(last), F.col("__of").eqNullSafe(F.col("__s")) & (F.col("__bin") == F.col("__b")))
    ranked = inside.withColumn("__r", F.row_number().over(W.partitionBy("__of", "__bin").orderBy("__h")))
    cut = ranked.where(F.col("__r") == F.col("__rest")).select(F.col("__of").alias("__s"), F.col("__h").alias("__cut"))
    met = rows.join(sent(cut), F.col(strata).eqNullSafe(F.col("__s")), "left")
    return met.withColumn("taken", F.coalesce(F.col("__h") <= F.col("__cut"), F.lit(False))).drop("__h", "__s", "__cut")
