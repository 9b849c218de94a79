"""Tables in and out: tiles, file names, rasterising, stacking, resuming."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.operators.stats import numbered


def read_csv(spark: SparkSession, paths, schema: str) -> DataFrame:
    """CSV files with a header, an explicit schema and the file name as ``file_name``."""
    return spark.read.schema(schema).csv(paths, header=True).withColumn("file_name", F.col("_metadata.file_name"))


def read_tile_meta(spark: SparkSession, path: str) -> DataFrame:
    """Tile-set metadata (a JSON document): patch size, patches per row, total, origin and steps."""
    raw = spark.read.json(path, multiLine=True)
    a = F.col("projection.affine.doubleMatrix")
    return raw.select(
        F.get("patchDimensions", F.lit(0)).cast("int").alias("width"), F.get("patchDimensions", F.lit(1)).cast("int").alias("height"), F.col("patchesPerRow").cast("int").alias("per_row"),
        F.col("totalPatches").cast("int").alias("total"), F.get(a, F.lit(0)).alias("x_step"), F.get(a, F.lit(2)).alias("x0"), F.get(a, F.lit(4)).alias("y_step"), F.get(a, F.lit(5)).alias("y0"),
    )


def key_from_name(name: Column, pattern: str, group: int = 1) -> Column:
    """A key in a file name; null where the pattern does not match."""
    return F.nullif(F.regexp_extract(name, pattern, group), F.lit(""))


def half_month(name: Column, pattern: str = r"(\d{4})(\d{2})([ab])") -> Column:
    """Struct of start and end date of the half month coded in a file name: a is 1st to 16th, b is 16th to the next month's 1st."""
    y, m, h = (F.regexp_extract(name, pattern, i) for i in (1, 2, 3))
    first = F.try_to_timestamp(F.concat(y, F.lit("-"), m, F.lit("-01"))).cast("date")
    return F.when(h == "a", F.struct(first.alias("start"), F.date_add(first, 15).alias("end"))).when(h == "b", F.struct(F.date_add(first, 15).alias("start"), F.add_months(first, 1).alias("end")))


def number_tiles(files: DataFrame, file: str, position: str, per_row: int) -> DataFrame:
    """Row-major tile numbers over files in name order: patch_n, patch_i, patch_j.  Tiles are counted file by file, not in one task."""
    out = numbered(files, [], file, [F.col(position)], "patch_n").withColumn("patch_n", (F.col("patch_n") - 1).cast("int"))
    return out.withColumns({"patch_i": F.floor(F.col("patch_n") / per_row).cast("int"), "patch_j": (F.col("patch_n") % per_row).cast("int")})


def tiles_to_pixels(tiles: DataFrame, meta: DataFrame, margin: int = 0, nodata: float | None = -9999.0) -> DataFrame:
    """``(patch_n, band, row, col, lon, lat, value)`` of tile arrays in row-major order, margins cut off, nodata null, centres of cells."""
    met = tiles.join(F.broadcast(meta)).select("*", F.posexplode("values").alias("pos", "value")).drop("values")
    r, c = F.floor(F.col("pos") / F.col("width")).cast("int"), (F.col("pos") % F.col("width")).cast("int")
    inner = met.withColumns({"row": r - margin, "col": c - margin})
    w, h = F.col("width") - 2 * margin, F.col("height") - 2 * margin
    inner = inner.where(F.col("row").between(0, h - 1) & F.col("col").between(0, w - 1))
    gi = F.floor(F.col("patch_n") / F.col("per_row")) * h + F.col("row")
    gj = (F.col("patch_n") % F.col("per_row")) * w + F.col("col")
    value = F.when(F.isnan("value") | (F.col("value") == (nodata if nodata is not None else float("nan"))), None).otherwise(F.col("value"))
    return inner.select("patch_n", "band", gi.cast("int").alias("row"), gj.cast("int").alias("col"), (F.col("x0") + (gj + 0.5) * F.col("x_step")).alias("lon"), (F.col("y0") + (gi + 0.5) * F.col("y_step")).alias("lat"), value.alias("value"))


def write_mosaic(pixels: DataFrame, path: str, by: tuple[str, ...] = ("variable", "layer", "radius")) -> None:
    """All tiles of all layers as one table, partitioned by layer."""
    pixels.write.mode("overwrite").partitionBy(*by).parquet(path)


def grid_step(points: DataFrame, coord: str, dp: int = 3) -> DataFrame:
    """Smallest positive step between distinct rounded coordinates, one row."""
    xs = points.select(F.round(F.col(coord), dp).alias("x")).where("x is not null").distinct()
    step = F.round(F.col("x") - F.lag("x").over(W.orderBy("x")), dp)
    return xs.select("x", step.alias("d")).agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.min(F.when(F.col("d") > 0, F.col("d"))).alias("step"))


def grid_from_points(points: DataFrame, x: str, y: str, value: str, dp: int = 3) -> DataFrame:
    """Values on the dense grid that their coordinates span, null where no point lies; cells are generated in parallel by row."""
    gx, gy = grid_step(points, x, dp), grid_step(points, y, dp)
    n = lambda g: F.round((F.col(f"{g}.hi") - F.col(f"{g}.lo")) / F.col(f"{g}.step")).cast("int")
    frame = gx.alias("gx").join(gy.alias("gy"))
    rows = frame.select(F.explode(F.sequence(F.lit(0), n("gy"))).alias("i"), "gx.*", F.col("gy.lo").alias("ylo"), F.col("gy.step").alias("ystep"), n("gx").alias("nx"))
    cells = rows.select(F.explode(F.sequence(F.lit(0), "nx")).alias("j"), "i", F.col("lo"), F.col("step"), "ylo", "ystep")
    cells = cells.select("i", "j", F.round(F.col("lo") + F.col("j") * F.col("step"), dp).alias("x"), F.round(F.col("ylo") + F.col("i") * F.col("ystep"), dp).alias("y"))
    own = points.groupBy(F.round(F.col(x), dp).alias("x"), F.round(F.col(y), dp).alias("y")).agg(F.avg(value).alias(value))
    return cells.join(own, ["x", "y"], "left")


def band_stack(grids: dict[str, DataFrame], keys: list[str], value: str) -> DataFrame:
    """Several grids as one table with a column per band, in order; cells of any grid appear."""
    out = None
    for name, g in grids.items():
        one = g.select(*keys, F.col(value).alias(name))
        out = one if out is None else out.join(one, keys, "full_outer")
    return out


def resume(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose keys are not in the result table yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def site_series(obs: DataFrame, cells: DataFrame, site: str, keys: list[str], date: str, value: str) -> DataFrame:
    """Mean series of the cells around each site."""
    return obs.join(cells.select(site, *keys).distinct(), keys).groupBy(site, date).agg(F.avg(value).alias(value))
