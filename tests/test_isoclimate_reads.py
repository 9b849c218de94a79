import pytest
from pyspark.sql import functions as F

from seasonlark.operators.asynchrony import HARMONICS
from seasonlark.operators.isoclimate import isoclimate, parameter_sets
from seasonlark.operators.matrix_regression import Distance, mmrr_members


def _counting(spark, table):
    """The table, with an accumulator that counts the rows which are computed for it."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    return table.mapInArrow(count, table.schema), seen


def test_each_grid_is_computed_once(spark):
    cell = spark.range(64).select(F.floor(F.col("id") / 8).alias("i"), (F.col("id") % 8).alias("j"))
    at = cell.select("i", "j", (F.col("j") * 0.05 + 0.025).alias("lon"), (-F.col("i") * 0.05 - 0.025).alias("lat"), (F.col("i") * 8 + F.col("j")).cast("double").alias("constant"))
    wave = cell.select("i", "j", *[F.sin(F.col("i") * (k + 1) + F.col("j")).alias(h) for k, h in enumerate(HARMONICS)])
    warm = cell.select("i", "j", F.cos("i").alias("e1"), F.cos(F.col("j") * 2.0).alias("e2"))
    grids, seen = zip(*[_counting(spark, t.repartition(2).cache()) for t in (at, wave, warm)], strict=True)
    out = isoclimate(*grids, parameter_sets(spark, [0.06], [0.3], [20.0]), "constant", ["e1", "e2"], 0.05, 0.0, 0.0, percentile=0.5, min_area_km2=1.0, n_points=20, nperm=9).collect()
    assert [r.n for r in out] == [20] and out[0].failure is None
    assert [s.value for s in seen] == [64, 64, 64]


def test_members_are_computed_once_and_groups_without_one_stay(spark):
    rows = [("a", k, float(k % 5), float(k)) for k in range(12)] + [("b", 1, None, 1.0), ("b", None, 1.0, 1.0), (None, 1, 1.0, 2.0), (None, 2, 2.0, 2.0), ("c", 1, 1.0, 1.0)]
    members, seen = _counting(spark, spark.createDataFrame(rows, "g string, k int, y double, x double"))
    out = {r.g: r for r in mmrr_members(members, "g", "k", Distance("y", "euclid", ("y",)), [Distance("x", "euclid", ("x",))], 9).collect()}
    assert seen.value == len(rows)
    assert {g: r.n for g, r in out.items()} == {"a": 12, "b": 0, None: 0, "c": 1}
    assert out["a"].failure is None and out["a"].r2 == pytest.approx(out["a"].r2)
    assert all(out[g].failure == "fewer than two members" for g in ("b", None, "c"))
