"""Density clusters and footprints of many groups at once.

Neighbour pairs are never rows.  Points that share coordinates are one site with a weight; sites lie in square blocks
as wide as eps, and a task holds one block's sites and those of the eight around it, counts neighbours there and
returns per site a flag, then per local cluster one edge a member.  Footprints work on runs of cells in rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlark.graph import connected_components
from seasonlark.scratch import materialise

#: Distances that a task computes at a time.
CHUNK = 1 << 22


def _near(x, y, px, py, eps: float):
    """Rows of booleans, some points at a time: which of (x, y) lie within eps of each of (px, py)."""
    step = max(1, CHUNK // max(1, len(x)))
    for s in range(0, len(px), step):
        yield s, np.square(x[None] - px[s : s + step, None]) + np.square(y[None] - py[s : s + step, None]) <= eps * eps


def _spread(sites: DataFrame) -> DataFrame:
    """Sites for their own block and the eight around it; ``own`` in the first."""
    step = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])).alias("d")
    out = sites.select("*", step)
    block = {f"b{c}": F.floor(F.col(c) / F.col("eps")).cast("bigint") + F.col(f"d.{s}") for c, s in (("x", "a"), ("y", "b"))}
    out = out.withColumns(block).withColumn("own", (F.col("d.a") == 0) & (F.col("d.b") == 0)).drop("d")
    # blocks are small in bytes and long in work, so their number of partitions is kept
    return out.repartition(int(sites.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "bx", "by")


def _local_clusters(x, y, core, eps: float) -> np.ndarray:
    """For each core point the first core point of its cluster here; -1 for others."""
    at = np.flatnonzero(core)
    cx, cy, root = x[at], y[at], np.full(len(at), -1)
    for k in range(len(at)):
        if root[k] >= 0:
            continue
        root[k], front = k, np.array([k])
        while len(front):
            reached = np.zeros(len(at), bool)
            for _, hit in _near(cx, cy, cx[front], cy[front], eps):
                reached |= hit.any(axis=0)
            front = np.flatnonzero(reached & (root < 0))
            root[front] = k
    out = np.full(len(x), -1)
    out[at] = at[root] if len(at) else root
    return out


def dbscan(df: DataFrame, key: str, x: str, y: str, eps: float | str, min_samples: float | str, by: str | None = None) -> DataFrame:
    """``([by,] key, label)``: density clusters from 1, 0 for noise; the point itself counts.

    With ``by`` every value of that column is a clustering of its own, and ``eps`` and ``min_samples`` may name columns with its
    parameters.  Core points within eps share a cluster; a border point takes the smallest label among its core
    neighbours.  Labels are numbered by the smallest key of their core points.  Rows without coordinates are noise.
    """
    number = lambda v: (F.col(v) if isinstance(v, str) else F.lit(v)).cast("double")
    group = F.col(by) if by else F.lit(0)
    base = df.select(group.alias("g"), F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), number(eps).alias("eps"), number(min_samples).alias("least"))
    base = materialise(base.where(~F.isnan("x") & ~F.isnan("y") | F.col("x").isNull() | F.col("y").isNull()), "points")
    sites = materialise(base.where("x is not null and y is not null").groupBy("g", "eps", "least", "x", "y").agg(F.min("k").alias("rep"), F.count("*").alias("w")), "sites")
    g_type, k_type = (base.schema[c].dataType for c in ("g", "k"))

    def cores(part: pd.DataFrame) -> pd.DataFrame:
        own = part["own"].to_numpy(bool)
        xs, ys, w = (part[c].to_numpy(float) for c in ("x", "y", "w"))
        n = np.empty(own.sum())
        for s, hit in _near(xs, ys, xs[own], ys[own], part["eps"].iloc[0]):
            n[s : s + len(hit)] = hit @ w
        return pd.DataFrame({"g": part["g"][own], "rep": part["rep"][own], "core": n >= part["least"].iloc[0]})

    flags = _spread(sites).groupBy("g", "bx", "by").applyInPandas(cores, T.StructType([T.StructField("g", g_type), T.StructField("rep", k_type), T.StructField("core", T.BooleanType())]))
    sites = materialise(sites.join(flags, ["g", "rep"]), "flagged")

    def links(part: pd.DataFrame) -> pd.DataFrame:
        own, core = part["own"].to_numpy(bool), part["core"].to_numpy(bool)
        xs, ys, rep = part["x"].to_numpy(float), part["y"].to_numpy(float), part["rep"].to_numpy()
        root = _local_clusters(xs, ys, core, part["eps"].iloc[0])
        here = np.isin(root, np.unique(root[own & core])) & core
        pairs = [(rep[a], rep[b], True) for a, b in zip(np.flatnonzero(here), root[here], strict=True)]
        edge = np.flatnonzero(own & ~core)
        at = np.flatnonzero(core)
        for s, hit in _near(xs[at], ys[at], xs[edge], ys[edge], part["eps"].iloc[0]):
            p, q = np.nonzero(hit)
            pairs += {(rep[edge[s + a]], rep[root[at[b]]], False) for a, b in zip(p, q, strict=True)}
        return pd.DataFrame([(part["g"].iloc[0], *p) for p in pairs], columns=["g", "a", "b", "core"])

    schema = T.StructType([T.StructField("g", g_type), T.StructField("a", k_type), T.StructField("b", k_type), T.StructField("core", T.BooleanType())])
    link = materialise(_spread(sites).groupBy("g", "bx", "by").applyInPandas(links, schema), "links")
    node = lambda c: F.struct("g", F.col(c).alias("k"))
    comp = connected_components(link.where("core and a <> b").select(node("a").alias("a"), node("b").alias("b")), "a", "b")
    core = sites.where("core").select("g", "rep", node("rep").alias("node"))
    root = core.join(comp, core["node"] == comp["id"], "left").select("g", "rep", F.coalesce("component", "node")["k"].alias("root"))
    number = root.select("g", "root").distinct().withColumn("label", F.row_number().over(W.partitionBy("g").orderBy("root")))
    labelled = materialise(root.join(number, ["g", "root"]).select("g", "rep", "label"), "labelled")
    border = link.where("not core").select("g", F.col("a").alias("site"), F.col("b").alias("rep")).join(labelled, ["g", "rep"]).groupBy("g", "site").agg(F.min("label").alias("label"))
    found = labelled.unionByName(border.withColumnRenamed("site", "rep"))
    placed = sites.join(found, ["g", "rep"]).select("g", "x", "y", "label")
    out = base.select("g", "k", "x", "y").join(placed, ["g", "x", "y"], "left").select(F.col("g").alias(by or "__g"), F.col("k").alias(key), F.coalesce("label", F.lit(0)).alias("label"))
    return out if by else out.drop("__g")


def cell_runs(cells: DataFrame, keys: list[str], i: str, j: str) -> DataFrame:
    """``(keys, i, a, b)``: longest runs of adjacent cells in rows."""
    base = cells.select(*keys, F.col(i).cast("bigint").alias("i"), F.col(j).cast("bigint").alias("j")).distinct()
    island = F.col("j") - F.row_number().over(W.partitionBy(*keys, "i").orderBy("j"))
    return base.withColumn("__r", island).groupBy(*keys, "i", "__r").agg(F.min("j").alias("a"), F.max("j").alias("b")).drop("__r")


def _covered(spans: DataFrame, keys: list[str], depth) -> DataFrame:
    """Longest runs that at least ``depth`` of the spans ``(keys, i, a, b)`` cover."""
    event = F.explode(F.array(F.struct(F.col("a").alias("at"), F.lit(1).alias("d")), F.struct((F.col("b") + 1).alias("at"), F.lit(-1).alias("d")))).alias("e")
    extra = [c for c in spans.columns if c not in (*keys, "i", "a", "b")]
    steps = spans.select(*keys, *extra, "i", event).groupBy(*keys, *extra, "i", "e.at").agg(F.sum("e.d").alias("d"))
    w = W.partitionBy(*keys, "i").orderBy("at")
    on = steps.withColumn("on", F.sum("d").over(w.rowsBetween(W.unboundedPreceding, 0)) >= depth)
    turns = on.withColumn("before", F.coalesce(F.lag("on").over(w), F.lit(False))).where("`on` <> before")
    return turns.withColumn("b", F.lead("at").over(w) - 1).where("`on`").select(*keys, *extra, "i", F.col("at").alias("a"), "b")


def closing(cells: DataFrame, keys: list[str], i: str, j: str, radius: str) -> DataFrame:
    """``(keys, i, a, b)``: the runs of each group's morphological closing with a disc; ``radius`` names a column, one value a group.

    A row of the disc is a chord: runs grow by it in every row of the dilation and shrink by it in the
    erosion, whose cells are those that all 2 r + 1 rows still cover.  The work grows with runs times radius.
    """
    size = cells.select(*keys, F.col(radius).cast("bigint").alias("r")).distinct()
    runs = cell_runs(cells, keys, i, j).join(size, keys)
    dy = F.explode(F.sequence(-F.col("r"), F.col("r")))
    chord = F.floor(F.sqrt((F.col("r") * F.col("r") - F.col("dy") * F.col("dy")).cast("double")))
    move = lambda t, sign: t.withColumn("dy", dy).withColumn("h", chord).select(*keys, "r", (F.col("i") + F.col("dy")).alias("i"), (F.col("a") - sign * F.col("h")).alias("a"), (F.col("b") + sign * F.col("h")).alias("b"))
    wide = _covered(move(runs, 1), keys, F.lit(1))
    return _covered(move(wide, -1).where("a <= b"), keys, 2 * F.col("r") + 1).drop("r")


def run_cells(runs: DataFrame) -> DataFrame:
    """The cells ``j`` of runs."""
    return runs.withColumn("j", F.explode(F.sequence("a", "b"))).drop("a", "b")


def points_in_cells(cells: DataFrame, group: str, n: int, res: float, x0: float, y0: float, seed: int = 0) -> DataFrame:
    """``(group, draw, x, y)``: ``n`` seeded points in each group's cells ``(i, j)``, uniform over them; rows count southwards from ``y0``."""
    part = W.partitionBy(group)
    numbered = cells.select(group, "i", "j").distinct().withColumns({"cell": F.row_number().over(part.orderBy("i", "j")) - 1, "__n": F.count("*").over(part)})
    drawn = numbered.select(group, F.col("__n")).distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(n))))
    u = lambda k: F.pmod(F.xxhash64(F.lit(seed), F.lit(k), group, "draw"), F.lit(1 << 52)) / float(1 << 52)
    at = drawn.withColumn("cell", F.floor(u(0) * F.col("__n"))).join(numbered.drop("__n"), [group, "cell"])
    return at.select(group, "draw", (x0 + (F.col("j") + u(1)) * res).alias("x"), (y0 - (F.col("i") + u(2)) * res).alias("y"))
