"""Multiple tests, analysis of variance and permutation slopes."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.functions.shuffles import MASK, permuted_column
from seasonlark.functions.tails import f_sf


def bh_adjust(df: DataFrame, p: str, by: list[str] | None = None, out: str = "p_bh") -> DataFrame:
    """Benjamini-Hochberg adjusted p-values within ``by``; null p stays null and does not count.

    Equal p-values share the largest rank, so the whole needs counts per distinct p only
    before they are put back by a join.
    """
    by = by or []
    n = df.where(F.col(p).isNotNull()).groupBy(*by, p).agg(F.count("*").alias("__c"))
    part = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    up = part.orderBy(p).rowsBetween(W.unboundedPreceding, 0)
    down = part.orderBy(F.desc(p)).rowsBetween(W.unboundedPreceding, 0)
    ranked = n.withColumn("__rank", F.sum("__c").over(up)).withColumn("__m", F.sum("__c").over(part))
    adj = ranked.withColumn(out, F.least(F.min(F.col(p) * F.col("__m") / F.col("__rank")).over(down), F.lit(1.0)))
    return df.join(adj.select(*by, p, out), [*by, p], "left")


def bonferroni(df: DataFrame, p: str, alpha: float = 0.05, m: int | None = None, out: str = "significant") -> DataFrame:
    """Whether p is at most alpha over the number of tests (rows with a p, or ``m``)."""
    if m is not None:
        return df.withColumn(out, (F.col(p) <= alpha / m).cast("int"))
    n = df.agg(F.count(p).alias("__m"))
    return df.join(F.broadcast(n)).withColumn(out, (F.col(p) <= F.lit(alpha) / F.col("__m")).cast("int")).drop("__m")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One row: F, its degrees of freedom and p of a one-way analysis of variance."""
    g = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("ss"), F.sum(F.col("n") * F.col("v")).alias("within"))
    out = t.select((F.col("k") - 1).alias("df_between"), (F.col("n") - F.col("k")).alias("df_within"), (F.col("ss") - F.col("s") * F.col("s") / F.col("n")).alias("between"), "within")
    out = out.withColumn("f", (F.col("between") / F.nullif("df_between", F.lit(0))) / F.nullif(F.col("within") / F.nullif("df_within", F.lit(0)), F.lit(0.0)))
    return out.select("f", "df_between", "df_within", f_sf(F.col("f"), F.col("df_between").cast("double"), F.col("df_within").cast("double")).alias("p"))


def studentised_range_sf(q: float, k: int, df: float) -> float:
    """P(Q >= q) of the studentised range of k means, by numerical integration."""
    erf = np.vectorize(math.erf)
    phi = lambda z: np.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    cdf = lambda z: (1 + erf(z / math.sqrt(2))) / 2
    z = np.linspace(-8, 8, 801)

    def range_cdf(w: float) -> float:
        return float(k * np.trapezoid(phi(z) * np.maximum(cdf(z) - cdf(z - w), 0) ** (k - 1), z))

    spread = 8 / math.sqrt(2 * df)
    s = np.linspace(max(1e-6, 1 - spread), 1 + spread, 161)
    logd = (df / 2) * math.log(df / 2) - math.lgamma(df / 2) + math.log(2) + (df - 1) * np.log(s) - df * s * s / 2
    return min(1.0, max(0.0, 1 - float(np.trapezoid(np.exp(logd) * np.array([range_cdf(q * x) for x in s]), s))))


def tukey_hsd(df: DataFrame, group: str, value: str) -> DataFrame:
    """``(a, b, diff, q, p)`` for every two groups (Tukey-Kramer); groups are few, pairs are of their means."""
    g = df.where(F.col(value).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    t = g.agg(F.sum(F.col("n") * F.col("v")).alias("w"), (F.sum("n") - F.count("*")).alias("dfw"), F.count("*").alias("k"))
    a, b = (g.select(F.col(group).alias(x), F.col("n").alias(f"n{x}"), F.col("m").alias(f"m{x}")) for x in "ab")
    both = a.join(b, F.col("a") < F.col("b")).join(F.broadcast(t))
    q = F.abs(F.col("ma") - F.col("mb")) / F.sqrt(F.col("w") / F.col("dfw") / 2 * (1 / F.col("na") + 1 / F.col("nb")))

    @F.pandas_udf("double")
    def sf(q: pd.Series, k: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([studentised_range_sf(x, int(y), z) if x == x else None for x, y, z in zip(q, k, d, strict=True)], dtype="float64")

    return both.select("a", "b", (F.col("mb") - F.col("ma")).alias("diff"), q.alias("q"), "k", "dfw").withColumn("p", sf("q", "k", F.col("dfw").cast("double"))).drop("k", "dfw")


def numbered(df: DataFrame, keys: list[str], part: str, order: list, out: str) -> DataFrame:
    """Add the row number from 1 within ``keys`` by (part, order): counted inside each part, plus the rows of the parts before.

    Parts are ranges of the order, so no task sorts a whole group; their counts are few.
    """
    sizes = df.groupBy(*keys, part).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over((W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))).orderBy(part).rowsBetween(W.unboundedPreceding, -1))
    starts = sizes.select(*keys, part, F.coalesce(before, F.lit(0)).alias("__before"))
    inside = df.withColumn("__in", F.row_number().over(W.partitionBy(*keys, part).orderBy(*order)))
    return inside.join(starts, [*keys, part]).withColumn(out, F.col("__in") + F.col("__before")).drop("__in", "__before")


#: Keys of successive permutations lie this far apart.
PERM_STEP = 0x3C6EF372


def permutations(df: DataFrame, keys: list[str], index: str, value: str, n: int, salt: str = "") -> DataFrame:
    """``(keys, perm, index, value)``: for each of ``n`` permutations the values dealt anew within a group.

    Rows are numbered once, by md5 of the index (of any type; it should be unique in its group); a permutation
    then computes where each row's value goes, and one equi-join on (keys, place) deals it.
    """
    base = df.select(*keys, index, value)
    base = base.withColumn("__h", F.coalesce(F.md5(F.col(index).cast("string").cast("binary")), F.lit(""))).withColumn("__part", F.substring("__h", 1, 3))
    base = numbered(base, keys, "__part", [F.col("__h"), F.col(index)], "__i").withColumn("__i", F.col("__i") - 1).drop("__part", "__h")
    sizes = df.groupBy(*keys).agg(F.count("*").alias("__n"))
    many = (base.join(sizes, keys) if keys else base.join(F.broadcast(sizes))).select(*keys, value, "__i", "__n", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("perm"))
    key = (F.lit(zlib.crc32(salt.encode())) + F.col("perm").cast("bigint") * PERM_STEP).bitwiseAND(F.lit(MASK))
    many = many.select(*keys, "perm", value, permuted_column("__i", "__n", key).alias("__i"))
    return many.join(base.select(*keys, index, "__i"), [*keys, "__i"]).select(*keys, "perm", index, value)


def permutation_slope_test(df: DataFrame, index: str, x: str, y: str, n: int = 1000) -> DataFrame:
    """One row: slope of y on x and the share of permuted slopes at least as large."""
    true = df.agg(F.regr_slope(y, x).alias("slope"))
    moved = permutations(df, [], index, x, n).join(df.select(index, y), index)
    null = moved.groupBy("perm").agg(F.regr_slope(y, x).alias("__s"))
    return null.join(F.broadcast(true)).groupBy("slope").agg(F.avg((F.col("__s") >= F.col("slope")).cast("double")).alias("p"))
