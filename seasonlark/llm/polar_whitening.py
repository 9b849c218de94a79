"""Embedding whitening by polarisation.

Entries become integers, so every sum is exact.  The variance of each dimension and of the
sum of every two dimensions is aggregated from squared centred values; half of what the
variance of a sum exceeds the two variances by is the covariance.  The matrix so
assembled has as many rows as a vector has entries, whatever the table holds, and is
decomposed on the driver; projections run in tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlark.scratch import materialise

#: Numbers in an entry's unit.
SCALE = 256
COMPONENTS = 4
#: Squares up to this size can be summed over a batch in 64 bits.
SAFE = 1 << 23
LIMB = 1 << 32


@dataclass(frozen=True)
class Whitening:
    """Fitted on ``n`` distinct vectors with sums ``total`` by dimension; columns of ``vectors`` are unit eigenvectors, ``values`` fall."""

    n: int
    total: tuple[int, ...]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integer_vectors(df: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """Rows with ``x``, the entries as floor(256 c) in 64 bits; without rows whose vector is null, empty or holds null or non-finite entries.

    Entries beyond 64 bits are held at the end of their range.  Rows of another length than ``dim`` (by default
    the most frequent, the longer on ties) are no vectors of the same space and are left out as well.
    """
    c = lambda e: e.cast("double")
    fine = F.forall(vector, lambda e: e.isNotNull() & ~F.isnan(c(e)) & (F.abs(c(e)) < float("inf")))
    good = df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fine)
    if dim is None:
        sizes = good.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = sizes.d if sizes else 0
    return good.where(F.size(vector) == dim).withColumn("x", F.transform(vector, lambda e: F.floor(c(e) * SCALE)))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    a = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return a.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _exact_sums(distinct: DataFrame, dim: int, width: int, terms) -> list[int]:
    """Exact sums over all rows of the ``width`` integers that ``terms`` gives for a matrix of vectors.

    A task sends one row a sum, as a high and a low part, and Spark adds the parts.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [0] * width
        for b in batches:
            for s in range(0, b.num_rows, 1 << 12):
                for k, v in enumerate(terms(_matrix(b.column(0).slice(s, 1 << 12), dim))):
                    out[k] += int(v)
        parts = [divmod(v, LIMB) for v in out]
        tops = [divmod(h, LIMB) for h, _ in parts]
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(width), pa.int32()), "top": pa.array([t for t, _ in tops], pa.int64()), "high": pa.array([h for _, h in tops], pa.int64()), "low": pa.array([v for _, v in parts], pa.int64())})

    sums = distinct.select("x").mapInArrow(partial, "k int, top bigint, high bigint, low bigint").groupBy("k").agg(F.sum("top").alias("top"), F.sum("high").alias("high"), F.sum("low").alias("low"))
    out = [0] * width
    for r in sums.collect():
        out[r.k] = (r.top * LIMB + r.high) * LIMB + r.low
    return out


def _plain_sums(x: np.ndarray):
    return x.sum(axis=0) if np.abs(x.astype(float)).max(initial=0) < 2**50 else x.astype(object).sum(axis=0)


def _polar_squares(dim: int, floors: list[int]):
    """Squares of q = x - floor(mean) summed for every dimension, then for q_i + q_j of every two i < j."""

    def squares(x: np.ndarray) -> Iterator:
        near = np.abs(x.astype(float) - np.array(floors, float)).max(initial=0) < SAFE
        q = x - np.array(floors, np.int64) if near else x.astype(object) - np.array(floors, object)
        yield from (q * q).sum(axis=0)
        for i in range(dim - 1):
            both = q[:, i + 1 :] + q[:, i : i + 1]
            yield from (both * both).sum(axis=0)

    return squares


def polarised_covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """Covariances (divisor n) as correctly rounded quotients of integers.

    ``squares`` are sums of q^2 with n q - r the n-fold centred value, so n^2 sum q^2 - n r^2 is the exact sum of its squares.
    """
    d = len(rest)
    single = [n * n * squares[i] - n * rest[i] * rest[i] for i in range(d)]
    cov, k = np.zeros((d, d)), d
    for i in range(d):
        cov[i, i] = single[i] / n**3
        for j in range(i + 1, d):
            pair = n * n * squares[k] - n * (rest[i] + rest[j]) ** 2
            cov[i, j] = cov[j, i] = (pair - single[i] - single[j]) / (2 * n**3)
            k += 1
    return cov


def fit(distinct: DataFrame, dim: int) -> Whitening | None:
    """The whitening of a table of distinct integer vectors ``x``; None for an empty one."""
    n = distinct.count()
    if not n:
        return None
    total = _exact_sums(distinct, dim, dim, _plain_sums)
    floors = [s // n for s in total]
    squares = _exact_sums(distinct, dim, dim * (dim + 1) // 2, _polar_squares(dim, floors))
    cov = polarised_covariance(n, [s - n * f for s, f in zip(total, floors, strict=True)], squares)
    values, vectors = np.linalg.eigh(cov)
    order = np.argsort(-values, kind="stable")
    return Whitening(n, tuple(total), values[order], vectors[:, order], float(np.trace(cov)))


def transform(rows: DataFrame, keep: list[str], model: Whitening, components: int = COMPONENTS) -> DataFrame:
    """``(keep, deviation, z)``: sum over dimensions of (n x - S)^2 and the first whitened values of each row with ``x``.

    deviation is exact, and null beyond 64 bits; a component without variance has null values.
    """
    dim, n = len(model.total), model.n
    top = min(components, dim)
    live = model.values[:top] > max(model.trace, 0) * 1e-12
    root = np.sqrt(np.where(live, model.values[:top], 1.0))
    schema = rows.select(*keep).schema

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.array(model.total, object)
        for b in batches:
            x = _matrix(b.column(len(keep)), dim)
            small = n * np.abs(x.astype(float)).max(initial=0) + max(abs(s) for s in model.total) < 2**62
            y = n * x - total.astype(np.int64) if small else n * x.astype(object) - total
            near = y.astype(float)
            exact = (np.square(near).sum(axis=1) < 2**62) & small
            dev = [int(v) for v in np.square(np.where(exact[:, None], y, 0)).sum(axis=1)] if small else [0] * len(x)
            dev = [v if e else _fitting(r) for v, e, r in zip(dev, exact, y, strict=True)]
            z = (near / n) @ model.vectors[:, :top] / root
            z[:, ~live] = np.nan
            cells = pa.array(z.ravel(), pa.float64(), from_pandas=True)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * top), cells)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(dev, pa.int64()), lists], [*keep, "deviation", "z"])

    out = schema.add("deviation", "long").add("z", T.ArrayType(T.DoubleType()))
    return rows.select(*keep, "x").mapInArrow(apply, out)


def _fitting(row) -> int | None:
    v = sum(int(a) ** 2 for a in row)
    return v if v < 1 << 63 else None


def identity_error(distinct: DataFrame, model: Whitening, components: int = COMPONENTS) -> float:
    """Largest absolute entry of the whitened values' covariance less the identity, over the vectors fitted on."""
    top = min(components, len(model.total))
    z = transform(distinct, [], model, components).select(*[F.col("z")[k].alias(f"z{k}") for k in range(top)])
    pairs = [(a, b) for a in range(top) for b in range(a, top)]
    got = z.agg(*[F.covar_pop(f"z{a}", f"z{b}").alias(f"c{a}_{b}") for a, b in pairs]).first()
    return max((abs(got[f"c{a}_{b}"] - (a == b)) for a, b in pairs if got[f"c{a}_{b}"] is not None), default=0.0)


def whitened(df: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` per usable row and component.

    The fit counts each distinct vector once, however many rows have it.  Rows without a usable
    vector (null, empty, null or non-finite entries, another length) give none; keys may be null or repeat.
    """
    spark = df.sparkSession
    rows = materialise(integer_vectors(df, vector).select(F.col(key).alias("key"), "x"), "vectors")
    distinct = materialise(rows.select("x").distinct(), "distinct_vectors")
    first = distinct.select(F.size("x").alias("d")).first()
    model = fit(distinct, first.d) if first else None
    if model is None:
        return spark.createDataFrame([], rows.select(F.col("key").alias(key)).schema.add("component", "integer").add("n", "long").add("deviation", "long").add("whitened", "double").add("explained", "double").add("identity_error", "double"))
    shares = [float(v / model.trace) if model.trace else 0.0 for v in model.values[:components]]
    long = transform(rows, ["key"], model, components).select(F.col("key").alias(key), "deviation", F.posexplode("z").alias("pos", "whitened"))
    share = F.get(F.array(*[F.lit(s) for s in shares]), F.col("pos"))
    return long.select(key, (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"), "deviation", "whitened", share.alias("explained"), F.lit(identity_error(distinct, model, components)).alias("identity_error"))


def op12_polar_whitening(spark, sf_dir: str) -> DataFrame:
    """The first four whitened components of every embedding."""
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
