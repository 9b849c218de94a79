"""GeoJSON features as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_GEOMETRY = "struct<type:string,coordinates:string>"
_FEATURE = f"struct<type:string,properties:map<string,string>,geometry:{_GEOMETRY}>"


def _rings(kind: Column, coordinates: Column) -> Column:
    """All rings of a (multi-)polygon; null for other geometries."""
    one = F.from_json(coordinates, "array<array<array<double>>>")
    many = F.flatten(F.from_json(coordinates, "array<array<array<array<double>>>>"))
    point = lambda v: F.struct(F.get(v, F.lit(0)).alias("x"), F.get(v, F.lit(1)).alias("y"))
    return F.transform(F.when(kind == "Polygon", one).when(kind == "MultiPolygon", many), lambda ring: F.transform(ring, point))


def read_geojson(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``(properties, type, rings, x, y)`` per feature; rings of polygons and multi-polygons (holes included), x and y of points.

    A file holds a feature collection or one feature; with ``lines`` each line is one feature, and large files are
    split among tasks.  A feature without a geometry, or of another kind, has null rings and coordinates; text that is no JSON gives no row.
    """
    text = spark.read.text(path, wholetext=not lines)
    doc = F.from_json("value", f"struct<type:string,features:array<{_FEATURE}>,properties:map<string,string>,geometry:{_GEOMETRY}>")
    each = F.when(F.col("d.type") == "FeatureCollection", F.col("d.features")).when(F.col("d.type") == "Feature", F.array(F.struct("d.type", "d.properties", "d.geometry")))
    f = text.select(doc.alias("d")).select(F.explode(each).alias("f"))
    kind, coordinates = F.col("f.geometry.type"), F.col("f.geometry.coordinates")
    point = F.when(kind == "Point", F.from_json(coordinates, "array<double>"))
    return f.select("f.properties", kind.alias("type"), _rings(kind, coordinates).alias("rings"), F.get(point, F.lit(0)).alias("x"), F.get(point, F.lit(1)).alias("y"))
