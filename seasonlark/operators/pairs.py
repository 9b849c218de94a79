"""Pair tables, which grow with the square of a group; their regression is in ``matrix_regression``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.operators.matrix_regression import mmrr  # noqa: F401  (a pair table is its input)


#: Members of one whole table are dealt into so many blocks; every two blocks meet under a key of their own.
BLOCKS = 32


def _met(a: DataFrame, b: DataFrame, i: str = "i", j: str = "j", group: list[str] | None = None) -> DataFrame:
    """All rows of ``a`` beside all of ``b`` (of their group) with i > j, as an equi-join on pairs of blocks, so no task holds them all."""
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(BLOCKS)).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1)))
    left = a.withColumn("__bi", own(i)).withColumn("__bj", other)
    right = b.withColumn("__bj", own(j)).withColumn("__bi", other)
    at = [*(group or []), "__bi", "__bj"]
    # few bytes give many rows, so the number of partitions is kept
    slots = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return left.repartition(slots, *at).join(right.repartition(slots, *at), at).where(F.col(i) > F.col(j)).drop("__bi", "__bj")


def pair_table(df: DataFrame, group: list[str], key: str, metrics: dict[str, tuple[list[str], object]]) -> DataFrame:
    """``(group, i, j, metrics)`` for every two members of a group with i > j: the reference's pairwise distance matrix.

    metrics: name -> (columns, function of the columns' two versions).
    """
    cols = list(dict.fromkeys(c for cs, _ in metrics.values() for c in cs))
    a = df.select(*group, F.col(key).alias("i"), *[F.col(c).alias(f"a_{c}") for c in cols])
    b = df.select(*group, F.col(key).alias("j"), *[F.col(c).alias(f"b_{c}") for c in cols])
    met = _met(a, b, group=group)
    return met.select(*group, "i", "j", *[f([F.col(f"a_{c}") for c in cs], [F.col(f"b_{c}") for c in cs]).alias(name) for name, (cs, f) in metrics.items()])


def euclid(a: list[Column], b: list[Column]) -> Column:
    """Euclidean distance over columns; columns null on either side are left out."""
    return F.sqrt(sum((F.coalesce((x - y) * (x - y), F.lit(0.0)) for x, y in zip(a, b, strict=True)), F.lit(0.0)))


def standardise_within(df: DataFrame, group: list[str], cols: list[str], ddof: int = 0) -> DataFrame:
    """Z-scores within a group; null where the spread is 0."""
    part = W.partitionBy(*group) if group else W.partitionBy(F.lit(1))
    sd = F.stddev_pop if ddof == 0 else F.stddev_samp
    return df.withColumns({c: (F.col(c) - F.avg(c).over(part)) / F.nullif(sd(c).over(part), F.lit(0.0)) for c in cols})


def env_distance(df: DataFrame, group: list[str], key: str, cols: list[str]) -> DataFrame:
    """Euclidean distance over variables standardised among the points of a group."""
    return pair_table(standardise_within(df, group, cols), group, key, {"dist": (cols, euclid)})


def matrix_to_pairs(matrix: DataFrame, key: str) -> DataFrame:
    """A wide square matrix (key column and one column per key) as ``(i, j, d)`` with i > j; the lower triangle counts."""
    long = matrix.unpivot([key], [c for c in matrix.columns if c != key], "j", "d").withColumnRenamed(key, "i")
    return long.where(F.col("i") > F.col("j")).select("i", "j", F.col("d").cast("double").alias("d"))


def asymmetric_pairs(matrix: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """Pairs whose two entries differ, and non-zero diagonals: empty for a proper distance matrix."""
    long = matrix.unpivot([key], [c for c in matrix.columns if c != key], "j", "d").withColumnRenamed(key, "i")
    both = long.groupBy(F.greatest("i", "j").alias("i"), F.least("i", "j").alias("j")).agg(F.min("d").alias("lo"), F.max("d").alias("hi"))
    return both.where((F.col("hi") - F.col("lo") > tolerance) | ((F.col("i") == F.col("j")) & (F.abs("hi") > tolerance)))


def restrict_pairs(pairs: DataFrame, valid: DataFrame, key: str) -> DataFrame:
    """Pairs both of whose members are valid."""
    ids = valid.select(F.col(key).alias("__v")).distinct()
    return pairs.join(ids, F.col("i") == F.col("__v"), "left_semi").join(ids, F.col("j") == F.col("__v"), "left_semi")


def key_differences(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys on one side only, with the side; empty if the key sets agree."""
    left, right = a.select(key).distinct(), b.select(key).distinct()
    return left.exceptAll(right).withColumn("side", F.lit("a")).unionAll(right.exceptAll(left).withColumn("side", F.lit("b")))


def allele_distance(genotypes: DataFrame, sample: str, locus: str, allele: str, missing: int = -9) -> DataFrame:
    """``(i, j, d)``: Euclidean distance of samples' allele counts; missing alleles count nowhere.

    d^2 = |a|^2 + |b|^2 - 2 a.b, so only samples that share an allele meet in the join.
    """
    n = genotypes.where(F.col(allele) != missing).groupBy(F.col(sample).alias("s"), locus, allele).agg(F.count("*").cast("double").alias("n"))
    norm = n.groupBy("s").agg(F.sum(F.col("n") * F.col("n")).alias("q"))
    a, b = n.select(F.col("s").alias("i"), locus, allele, F.col("n").alias("na")), n.select(F.col("s").alias("j"), locus, allele, F.col("n").alias("nb"))
    dot = a.join(b, [locus, allele]).where("i > j").groupBy("i", "j").agg(F.sum(F.col("na") * F.col("nb")).alias("dot"))
    pairs = _met(norm.select(F.col("s").alias("i"), F.col("q").alias("qi")), norm.select(F.col("s").alias("j"), F.col("q").alias("qj")))
    out = pairs.join(dot, ["i", "j"], "left")
    return out.select("i", "j", F.sqrt(F.greatest(F.col("qi") + F.col("qj") - 2 * F.coalesce("dot", F.lit(0.0)), F.lit(0.0))).alias("d"))


def allele_counts(genotypes: DataFrame, sample: str, locus: str, allele: str, missing: int = -9) -> tuple[DataFrame, int]:
    """``(s, v)``: every sample's counts of all alleles as an array, and its length; the Euclidean distances of arrays are those of ``allele_distance``."""
    n = genotypes.where(F.col(allele) != missing).groupBy(F.col(sample).alias("s"), locus, allele).agg(F.count("*").cast("double").alias("n"))
    kinds = n.select(locus, allele).distinct()
    full = n.select("s").distinct().join(kinds).join(n, ["s", locus, allele], "left").na.fill(0.0, ["n"])
    rows = full.groupBy("s").agg(F.sort_array(F.collect_list(F.struct(locus, allele, "n"))).alias("v")).select("s", F.col("v.n").alias("v"))
    return rows, kinds.count()
