"""Selection, repair, merging and summaries of result tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.operators.stats import bh_adjust


def mean_temperature(low: Column, high: Column) -> Column:
    """Mean of the daily extremes; null where one is missing."""
    return (low + high) / 2


def select_taxa(df: DataFrame, taxon: str, wanted: list[str], id_: str) -> DataFrame:
    """Distinct ids of the wanted genera or families."""
    return df.where(F.col(taxon).isin(wanted)).select(taxon, id_).distinct()


def repair_key(key: Column, replaced: dict[str, str]) -> Column:
    """A key without outer white space, known wrong ones replaced."""
    out = F.trim(key)
    for wrong, right in replaced.items():
        out = F.when(F.trim(key) == wrong, F.lit(right)).otherwise(out)
    return out


def with_attributes(df: DataFrame, attributes: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """A left or right merge of an attribute table; of several rows of a key the merge keeps all."""
    if how not in ("left", "right"):
        raise ValueError(how)
    return df.join(attributes, keys, how)


def group_centroid(df: DataFrame, key: str, lon: str, lat: str) -> DataFrame:
    """``(key, n, lon, lat)``: count and mean place of each group."""
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(lon).alias(lon), F.avg(lat).alias(lat))


def share_missing(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Share of rows without a value, per group and column."""
    return df.groupBy(*keys).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"missing_{c}") for c in cols])


def checked_union(frames: list[DataFrame]) -> DataFrame:
    """All rows of tables of the same columns, whatever their order; other columns are an error."""
    for f in frames[1:]:
        if set(f.columns) != set(frames[0].columns):
            raise ValueError(f"columns differ: {sorted(set(f.columns) ^ set(frames[0].columns))}")
    return reduce(lambda a, b: a.unionByName(b), frames)


def distinct_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key by ``order``."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("__r = 1").drop("__r")


def write_sorted(df: DataFrame, path: str, order: list, form: str = "csv") -> None:
    """A table in global order: files in order, rows in order inside them (a range partition, no single task)."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).format(form).save(path)


def expected_neighbours(cells: DataFrame, neighbours: DataFrame, key: str, row: str) -> DataFrame:
    """``(row, expected)``: the greatest neighbour count of a row of the grid, which a pixel far from gaps has."""
    n = neighbours.groupBy(key).agg(F.count("*").alias("__n"))
    return cells.join(n, key, "left").groupBy(row).agg(F.max(F.coalesce("__n", F.lit(0))).alias("expected"))


def nearest_to_centre(df: DataFrame, label: str, cols: list[str], k: int, key: str) -> DataFrame:
    """The k members nearest to the mean of their cluster, with their rank."""
    centre = df.groupBy(label).agg(*[F.avg(c).alias(f"__{c}") for c in cols])
    gap = sum(((F.col(c) - F.col(f"__{c}")) * (F.col(c) - F.col(f"__{c}")) for c in cols), F.lit(0.0))
    met = df.join(centre, label).withColumn("dist", F.sqrt(gap))
    rank = F.row_number().over(W.partitionBy(label).orderBy("dist", key))
    return met.withColumn("rank", rank).where(F.col("rank") <= k).select(label, key, "dist", "rank")


def hex_summary(fits: DataFrame, cell: str, slope: str, r2: str, p: str, alpha: float = 0.05) -> DataFrame:
    """``(cell, n, slope, r2, share, share_adjusted)``: means of fits in a cell, and shares with p up to alpha before and after adjusting inside the cell."""
    adjusted = bh_adjust(fits, p, [cell], "__adj")
    return adjusted.groupBy(cell).agg(
        F.count("*").alias("n"),
        F.avg(slope).alias("slope"),
        F.avg(r2).alias("r2"),
        F.avg((F.col(p) <= alpha).cast("double")).alias("share"),
        F.avg((F.col("__adj") <= alpha).cast("double")).alias("share_adjusted"),
    )
