"""Tables in and out, and small operators, on files and rows that each test writes itself."""

import colorsys
import json
from datetime import date

import numpy as np
from pyspark.sql import functions as F

from seasonlark.operators import attribution, cluster, eof, harmonic, records
from seasonlark.sources import tables


def test_csv_with_file_names(spark, tmp_path):
    for name, body in (("a.csv", "k,v\n1,2.5\n2,\n"), ("b.csv", "k,v\n3,x\n")):
        (tmp_path / name).write_text(body)
    got = sorted((r.file_name, r.k, r.v) for r in tables.read_csv(spark, str(tmp_path), "k int, v double").collect())
    assert got == [("a.csv", 1, 2.5), ("a.csv", 2, None), ("b.csv", 3, None)]


def test_tile_metadata_and_pixels(spark, tmp_path):
    meta = {"patchDimensions": [4, 3], "patchesPerRow": 2, "totalPatches": 4, "projection": {"affine": {"doubleMatrix": [0.5, 0.0, -10.0, 0.0, -0.5, 20.0]}}}
    (tmp_path / "mixer.json").write_text(json.dumps(meta, indent=1))
    m = tables.read_tile_meta(spark, str(tmp_path / "mixer.json"))
    assert tuple(m.first()) == (4, 3, 2, 4, 0.5, -10.0, -0.5, 20.0)
    tiles = spark.createDataFrame([(n, "b", [float(100 * n + k) if k != 5 else -9999.0 for k in range(12)]) for n in range(4)], "patch_n int, band string, values array<double>")
    got = {(r.row, r.col): r for r in tables.tiles_to_pixels(tiles, m).collect()}
    assert len(got) == 48 and got[0, 0].value == 0 and got[3, 4].value == 300 and got[1, 1].value is None
    assert (got[3, 4].lon, got[3, 4].lat) == (-10 + 4.5 * 0.5, 20 - 3.5 * 0.5)
    inner = {(r.row, r.col): r.value for r in tables.tiles_to_pixels(tiles, m, margin=1).collect()}
    assert inner == {(n // 2, 2 * (n % 2) + c): (None if c == 0 else 100.0 * n + 6) for n in range(4) for c in range(2)}


def test_tiles_are_numbered_over_files(spark):
    rows = [("f2", 0), ("f1", 1), ("f10", 0), ("f1", 0), ("f2", 1)]
    got = tables.number_tiles(spark.createDataFrame(rows, "file string, pos int").repartition(3), "file", "pos", 2).collect()
    assert {(r.file, r.pos): (r.patch_n, r.patch_i, r.patch_j) for r in got} == {
        ("f1", 0): (0, 0, 0), ("f1", 1): (1, 0, 1), ("f10", 0): (2, 1, 0), ("f2", 0): (3, 1, 1), ("f2", 1): (4, 2, 0),
    }


def test_mosaic_and_sorted_sinks(spark, tmp_path):
    px = spark.createDataFrame([("nirv", 1, 50, 0.5, 3), ("nirv", 2, 50, 0.7, 4), ("sif", 1, 100, None, 5)], "variable string, layer int, radius int, value double, row int")
    tables.write_mosaic(px, str(tmp_path / "mosaic"))
    back = spark.read.parquet(str(tmp_path / "mosaic"))
    assert sorted((r.variable, r.layer, r.radius, r.row) for r in back.collect()) == [("nirv", 1, 50, 3), ("nirv", 2, 50, 4), ("sif", 1, 100, 5)]
    assert [r.row for r in back.where("variable = 'sif'").collect()] == [5]
    df = spark.range(1000).select(((F.col("id") * 7919) % 1000).alias("x"), (F.col("id") % 3).alias("y"))
    records.write_sorted(df, str(tmp_path / "sorted"), [F.col("y").desc(), F.col("x")])
    lines = [line for f in sorted((tmp_path / "sorted").glob("part-*.csv")) for line in f.read_text().splitlines() if line != "x,y"]
    assert [tuple(map(int, line.split(","))) for line in lines] == sorted(((r.x, r.y) for r in df.collect()), key=lambda t: (-t[1], t[0]))


def test_band_stack_and_site_series(spark):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "i int, j int, v double")
    b = spark.createDataFrame([(0, 1, 5.0), (1, 1, 6.0)], "i int, j int, v double")
    got = tables.band_stack({"a": a, "b": b}, ["i", "j"], "v")
    assert got.columns == ["i", "j", "a", "b"] and sorted(map(tuple, got.collect())) == [(0, 0, 1.0, None), (0, 1, 2.0, 5.0), (1, 1, None, 6.0)]
    d1, d2 = date(2001, 1, 1), date(2001, 1, 9)
    obs = spark.createDataFrame([(0, 0, d1, 1.0), (0, 1, d1, 3.0), (0, 1, d2, None), (9, 9, d1, 50.0)], "i int, j int, date date, v double")
    cells = spark.createDataFrame([("s", 0, 0), ("s", 0, 1), ("s", 0, 1), ("t", 0, 1)], "site string, i int, j int")
    series = tables.site_series(obs, cells, "site", ["i", "j"], "date", "v").collect()
    assert {(r.site, r.date): r.v for r in series} == {("s", d1): 2.0, ("t", d1): 3.0, ("s", d2): None, ("t", d2): None}


def test_colours_equal_the_standard_library(spark):
    rows = [(h / 12, s / 2, v / 3) for h in range(12) for s in range(3) for v in range(4)]
    got = spark.createDataFrame(rows, "h double, s double, v double").select("h", "s", "v", harmonic.hsv_to_rgb(F.col("h"), F.col("s"), F.col("v")).alias("c")).collect()
    assert all(np.allclose(tuple(r.c), colorsys.hsv_to_rgb(r.h, r.s, r.v)) for r in got)


def test_rescale_mixture_and_scree(spark):
    rng = np.random.default_rng(1)
    pts = [(float(x), float(y), g) for g, (cx, cy) in enumerate([(0, 0), (10, 0), (0, 10)]) for x, y in rng.normal(size=(40, 2)) * 0.3 + (cx, cy)]
    df = spark.createDataFrame(pts, "x double, y double, g int")
    r = eof.rescale(df, ["x", "y"]).agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
    assert tuple(r) == (0.0, 1.0, 0.0, 1.0)
    assert eof.rescale(df.withColumn("x", F.lit(1.0)), ["x"]).where("x is not null").count() == 0
    mixed = cluster.gmm(df, ["x", "y"], 3, seed=2)
    assert mixed.groupBy("g").agg(F.countDistinct("label").alias("n")).agg(F.max("n")).first()[0] == 1 and mixed.agg(F.min("probability")).first()[0] > 0.5
    steps = [x.inertia for x in cluster.scree(df, ["x", "y"], 4).orderBy("k").collect()]
    a = np.array([p[:2] for p in pts])
    assert np.isclose(steps[0], ((a - a.mean(0)) ** 2).sum()) and steps[2] < 0.05 * steps[0]
    own = {r.g: r.inertia for r in cluster.inertia(df, "g", ["x", "y"]).collect()}
    for g in range(3):
        p = a[[q[2] == g for q in pts]]
        assert np.isclose(own[g], ((p - p.mean(0)) ** 2).sum())


def test_predominance_tuning_and_boruta(spark):
    shap = spark.createDataFrame([(1, "a", -3.0), (1, "b", 1.0), (2, "a", 0.0), (2, "b", 0.0), (3, "a", None), (3, "b", 2.0)], "k int, variable string, phi double")
    assert {r.k: r.top for r in attribution.predominance(shap, "k").collect()} == {1: "a", 2: "b", 3: "b"}
    assert {r.k: r.norm_diff for r in attribution.predominance(shap, "k", "a", "b").collect()} == {1: -0.5, 2: None, 3: None}
    rng = np.random.default_rng(3)
    rows = [(k, float(u), float(v), float(3 * u + 0.05 * rng.normal())) for k, (u, v) in enumerate(rng.uniform(size=(300, 2)))]
    df = spark.createDataFrame(rows, "k long, u double, v double, y double")
    tuned = attribution.tune_forest(df.where("k < 200"), df.where("k >= 200"), "y", ["u", "v"], [{"trees": 3, "depth": 1, "mtry": 2}, {"trees": 10, "depth": 6, "mtry": 2}]).collect()
    assert len(tuned) == 2 and tuned[0].rmse < tuned[1].rmse and tuned[1].gain == 0 and tuned[0].gain > 20 and "6" in tuned[0].setting
    hits = {r.variable: r for r in attribution.boruta(df, "k", "y", ["u", "v"], rounds=5, trees=10).collect()}
    assert hits["u"].hits == 5 and hits["u"].confirmed == 1 and hits["v"].confirmed == 0
