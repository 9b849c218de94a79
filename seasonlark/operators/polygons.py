"""Polygons against points and against each other, by cell coverings.

A polygon is a column of rings, ``array<array<struct<x, y>>>``, whose inside is what an odd number of rings enclose,
so holes and multi-polygons need no special care.  Each polygon is covered by square cells of a
side (a power of two) that its own box holds some sixteen times.  Cells that no edge touches lie wholly inside
or outside; a scan line through each row of cells tells which.  Joins are equi-joins on cells, and the
exact test runs on cells that an edge touches, against the edges of that row of cells alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.functions.geo import EARTH_M
from seasonlark.scratch import materialise

#: Cells that the longer side of a polygon's box holds, at most.
ACROSS = 16


def as_rings(vertices: str) -> Column:
    """The rings of a polygon given as one ring of vertices."""
    return F.array(F.col(vertices))


def edges(polygons: DataFrame, name: str, rings: str) -> DataFrame:
    """``(name, x1, y1, x2, y2)``: every edge, each ring closed; edges of no length and with missing vertices are left out."""
    ring = polygons.select(F.col(name).alias("name"), F.explode(rings).alias("v")).withColumn("n", F.size("v"))
    both = ring.select("name", "v", "n", F.posexplode("v").alias("at", "a")).withColumn("b", F.get("v", F.pmod(F.col("at") + 1, F.col("n"))))
    out = both.select("name", F.col("a.x").cast("double").alias("x1"), F.col("a.y").cast("double").alias("y1"), F.col("b.x").cast("double").alias("x2"), F.col("b.y").cast("double").alias("y2"))
    return out.na.drop().where("x1 <> x2 or y1 <> y2")


def with_side(edge: DataFrame) -> DataFrame:
    """Edges with ``side``, the cell side of their polygon."""
    far = F.greatest(*[F.max(F.greatest(f"{a}1", f"{a}2")) - F.min(F.least(f"{a}1", f"{a}2")) for a in "xy"])
    side = F.pow(F.lit(2.0), F.ceil(F.log2(F.greatest(far, F.lit(1e-9)) / ACROSS)))
    return edge.join(edge.groupBy("name").agg(side.alias("side")), "name")


def _rows(edge: DataFrame) -> DataFrame:
    """Edges once per row of cells ``ci`` that they touch."""
    at = lambda y: F.floor(y / F.col("side")).cast("bigint")
    return edge.withColumn("ci", F.explode(F.sequence(at(F.least("y1", "y2")), at(F.greatest("y1", "y2")))))


def _touched(row: DataFrame) -> DataFrame:
    """Row-wise edges once per cell ``cj`` of the row that they touch."""
    low, high = F.col("ci") * F.col("side"), (F.col("ci") + 1) * F.col("side")
    x_at = lambda y: F.when(F.col("y1") == F.col("y2"), F.lit(None)).otherwise(F.col("x1") + (y - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    # the ends of the edge's part in this row
    first, last = F.greatest(F.least("y1", "y2"), low), F.least(F.greatest("y1", "y2"), high)
    xa, xb = F.coalesce(x_at(first), F.col("x1")), F.coalesce(x_at(last), F.col("x2"))
    # a cell more on either side where rounding could hide a touch
    slack = F.abs(xa) * 1e-12 + F.abs(xb) * 1e-12 + F.col("side") * 1e-9
    cell = lambda x: F.floor(x / F.col("side")).cast("bigint")
    return row.withColumn("cj", F.explode(F.sequence(cell(F.least(xa, xb) - slack), cell(F.greatest(xa, xb) + slack))))


def covering(edge: DataFrame) -> DataFrame:
    """``(name, side, ci, cj, inside)``: the cells that edges (with ``side``) touch, and those wholly inside (``inside``)."""
    touched = _touched(_rows(edge)).select("name", "side", "ci", "cj").distinct()
    mid = (F.col("ci") + 0.5) * F.col("side")
    crossing = _rows(edge).where((F.least("y1", "y2") <= mid) & (mid < F.greatest("y1", "y2")))
    crossing = crossing.withColumn("x", F.col("x1") + (mid - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")))
    spans = crossing.groupBy("name", "side", "ci").agg(F.array_sort(F.collect_list("x")).alias("x"))
    spans = spans.withColumn("k", F.explode(F.expr("sequence(0, size(x) div 2 - 1)"))).select("name", "side", "ci", F.get("x", F.col("k") * 2).alias("a"), F.get("x", F.col("k") * 2 + 1).alias("b"))
    first, last = F.ceil(F.col("a") / F.col("side") - 0.5), F.ceil(F.col("b") / F.col("side") - 0.5) - 1
    filled = spans.withColumns({"first": first, "last": last}).where("first <= last").select("name", "side", "ci", F.explode(F.sequence("first", "last")).alias("cj"))
    inner = filled.join(touched, ["name", "side", "ci", "cj"], "left_anti")
    return touched.withColumn("inside", F.lit(False)).unionByName(inner.withColumn("inside", F.lit(True)))


def points_in_polygons(points: DataFrame, polygons: DataFrame, key: str, x: str, y: str, name: str, vertices: str | None = None, rings: str | None = None) -> DataFrame:
    """``(key, name)`` for every polygon that holds a point; polygons by one ring of ``vertices`` or by ``rings``.

    A point on an edge counts as inside if a ray to the left crosses an odd number of edges, each with its lower
    end and without its upper.  Polygons of any number and size take part; keys may repeat, equal rows give one.
    """
    shape = polygons.select(name, (F.col(rings) if rings else as_rings(vertices)).alias("rings"))
    edge = materialise(with_side(edges(shape, name, "rings")), "edges")
    cells = materialise(covering(edge), "covering")
    sides = edge.agg(F.collect_set("side").alias("s")).first().s
    place = points.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).na.drop(subset=["x", "y"]).distinct()
    spread = place.withColumn("side", F.explode(F.array(*[F.lit(s) for s in sides]).cast("array<double>")))
    spread = spread.withColumns({"ci": F.floor(F.col("y") / F.col("side")).cast("bigint"), "cj": F.floor(F.col("x") / F.col("side")).cast("bigint")})
    met = spread.join(cells, ["side", "ci", "cj"])
    held = met.where("inside").select("key", "name")
    # exact only where an edge touches the cell, against the edges of its row
    near = met.where("not inside").join(_rows(edge), ["name", "side", "ci"])
    left = (F.least("y1", "y2") <= F.col("y")) & (F.col("y") < F.greatest("y1", "y2")) & (F.col("x1") + (F.col("y") - F.col("y1")) / (F.col("y2") - F.col("y1")) * (F.col("x2") - F.col("x1")) <= F.col("x"))
    odd = near.groupBy("key", "x", "y", "name").agg((F.sum(left.cast("int")) % 2).alias("odd")).where("odd = 1").select("key", "name")
    return held.unionByName(odd).distinct().select(F.col("key").alias(key), F.col("name").alias(name))


def polygon_pairs(a: DataFrame, b: DataFrame, name_a: str, rings_a: str, name_b: str, rings_b: str) -> DataFrame:
    """``(a, b)`` for every two polygons of two tables that meet, touching included.

    Either edges cross, found among the edges that share a cell, or one holds a whole ring of the other, found by a vertex a ring.
    """
    a, b = materialise(a.select(name_a, rings_a), "regions"), materialise(b.select(name_b, rings_b), "regions")
    ea, eb = (materialise(edges(t, n, c), "edges") for t, n, c in ((a, name_a, rings_a), (b, name_b, rings_b)))
    length = F.greatest(F.abs(F.col("x1") - F.col("x2")), F.abs(F.col("y1") - F.col("y2")))
    side = ea.drop("name").unionByName(eb.drop("name")).agg(F.pow(F.lit(2.0), F.ceil(F.log2(F.avg(length))))).first()[0] or 1.0
    cut = lambda e, s: _touched(_rows(e.withColumn("side", F.lit(side)))).select("ci", "cj", *[F.col(c).alias(f"{s}{c}") for c in ("name", "x1", "y1", "x2", "y2")])
    met = cut(ea, "a").join(cut(eb, "b"), ["ci", "cj"])

    def side_of(p: str, qx: str, qy: str) -> Column:
        return F.signum((F.col(f"{p}x2") - F.col(f"{p}x1")) * (F.col(qy) - F.col(f"{p}y1")) - (F.col(f"{p}y2") - F.col(f"{p}y1")) * (F.col(qx) - F.col(f"{p}x1")))

    overlap = F.lit(True)
    for c in "xy":
        overlap = overlap & (F.greatest(f"a{c}1", f"a{c}2") >= F.least(f"b{c}1", f"b{c}2")) & (F.greatest(f"b{c}1", f"b{c}2") >= F.least(f"a{c}1", f"a{c}2"))
    crossing = overlap & (side_of("a", "bx1", "by1") * side_of("a", "bx2", "by2") <= 0) & (side_of("b", "ax1", "ay1") * side_of("b", "ax2", "ay2") <= 0)
    out = met.where(crossing).select(F.col("aname").alias("a"), F.col("bname").alias("b")).distinct()
    for t, n, c, other, on, oc in ((a, name_a, rings_a, b, name_b, rings_b), (b, name_b, rings_b, a, name_a, rings_a)):
        first = t.select(F.col(n).alias("k"), F.explode(c).alias("v")).select("k", F.get("v", F.lit(0)).alias("p")).select("k", "p.x", "p.y")
        held = points_in_polygons(first, other.select(F.col(on).alias("o"), F.col(oc).alias("r")), "k", "x", "y", "o", rings="r")
        out = out.unionByName(held.select(*(F.col(k).alias(s) for k, s in ((("k", "a"), ("o", "b")) if t is a else (("o", "a"), ("k", "b"))))))
    return out.distinct()


def random_points_in(regions: DataFrame, name: str, rings: str, n: int, seed: int = 0, max_rounds: int = 30) -> DataFrame:
    """``(name, draw, x, y)``: exactly ``n`` seeded points in each region, uniform over it, draw from 1.

    Cells of a region's covering are drawn evenly and a point within; points outside are left out.  Each
    round draws for the regions still short, all at once, by the share of points that were inside so far.  Regions
    without an area (no edges) give none; one that stays short after ``max_rounds`` is an error.
    """
    edge = materialise(with_side(edges(regions, name, rings)), "edges")
    cells = covering(edge)
    cells = materialise(cells.withColumn("cell", F.row_number().over(W.partitionBy("name").orderBy("ci", "cj")) - 1).withColumn("n_cells", F.count("*").over(W.partitionBy("name"))), "covering")
    short = cells.select("name", "n_cells").distinct().withColumns({"got": F.lit(0).cast("bigint"), "tried": F.lit(0).cast("bigint")})
    shape = regions.select(F.col(name).alias("o"), F.col(rings).alias("r"))
    found = None
    for turn in range(max_rounds):
        u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(turn), F.lit(k), "name", "i"), F.lit(1 << 52)) / float(1 << 52)  # noqa: B023, E731
        rate = F.when(F.col("tried") > 0, F.greatest((F.col("got") + 1) / F.col("tried"), F.lit(1e-4))).otherwise(0.6)
        want = F.ceil((n - F.col("got")) / rate * 1.2).cast("bigint") + 8
        drawn = short.withColumn("want", want).withColumn("i", F.explode(F.sequence(F.lit(1).cast("bigint"), "want")))
        drawn = drawn.withColumn("cell", F.floor(u(0) * F.col("n_cells"))).join(cells.select("name", "cell", "side", "ci", "cj", "inside"), ["name", "cell"])
        drawn = materialise(drawn.select("name", "i", "inside", ((F.col("cj") + u(1)) * F.col("side")).alias("x"), ((F.col("ci") + u(2)) * F.col("side")).alias("y")), "drawn")
        near = points_in_polygons(drawn.where("not inside").select(F.struct("name", "i").alias("k"), "x", "y"), shape, "k", "x", "y", "o", rings="r").where(F.col("k.name") == F.col("o"))
        good = drawn.where("inside").select("name", "i").unionByName(near.select("k.name", "k.i"))
        good = drawn.join(good, ["name", "i"]).select("name", F.lit(turn).alias("turn"), "i", "x", "y")
        found = materialise(good if found is None else found.unionByName(good), "found")
        tried = drawn.groupBy("name").agg(F.count("*").alias("__t"))
        counts = found.groupBy("name").agg(F.count("*").alias("__g"))
        short = short.join(tried, "name").join(counts, "name", "left").select("name", "n_cells", F.coalesce("__g", F.lit(0)).cast("bigint").alias("got"), (F.col("tried") + F.col("__t")).alias("tried"))
        short = materialise(short.where(F.col("got") < n), "short")
        if short.isEmpty():
            break
    else:
        raise RuntimeError(f"regions stayed short of points: {[r.name for r in short.limit(10).collect()]}")
    order = W.partitionBy("name").orderBy("turn", "i")
    return found.withColumn("draw", F.row_number().over(order)).where(F.col("draw") <= n).select(F.col("name").alias(name), "draw", "x", "y")


def hexagon(q: Column, r: Column, edge_m: float) -> Column:
    """Rings of the hexagon ``(q, r)`` of ``functions.geo.hex_cell``, in degrees."""
    x, y = edge_m * math.sqrt(3) * (q + r / 2), edge_m * 1.5 * r
    corner = lambda k: F.struct(
        F.degrees((x + edge_m * math.cos(math.radians(60 * k + 30))) / EARTH_M).alias("x"),
        F.degrees(F.asin(F.greatest(F.least((y + edge_m * math.sin(math.radians(60 * k + 30))) / EARTH_M, F.lit(1.0)), F.lit(-1.0)))).alias("y"),
    )
    return F.array(F.array(*[corner(k) for k in range(6)]))
