"""Random-forest attribution: preparation, splits, importance, Shapley values, dependence."""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlark.functions.shuffles import MASK, permuted_column
from seasonlark.operators.order import hash_shares, percentiles
from seasonlark.operators.spatial import align_bilinear
from seasonlark.operators.stats import PERM_STEP, numbered, permutations
from seasonlark.scratch import materialise

#: Points of the grid of all variables' values that are scored once each, where there are no more.
GRID = 500_000


def standardise(df: DataFrame, cols: list[str]) -> DataFrame:
    """Complete cases, z-scored with the sample deviation; constant columns become null."""
    rows = df.na.drop(subset=cols)
    stats = rows.agg(*[f(c).alias(f"__{n}{i}") for i, c in enumerate(cols) for n, f in (("m", F.avg), ("s", F.stddev_samp))])
    out = rows.join(F.broadcast(stats))
    return out.withColumns({c: (F.col(c) - F.col(f"__m{i}")) / F.nullif(f"__s{i}", F.lit(0.0)) for i, c in enumerate(cols)}).drop(*stats.columns)


def stratified_split(df: DataFrame, key: str, y: str, share: float, seed: int = 0, strata: int = 4) -> DataFrame:
    """Add ``train``: the given share of each quantile stratum of y, by a hash of the key.

    The strata's ends are exact percentiles, selected first; rows without y are a stratum of their own.
    """
    cuts = percentiles(df, y, [i / strata for i in range(1, strata)])
    band = df.withColumn("__band", sum(((F.col(y) > F.lit(c).cast("double")).cast("int") for c in cuts), F.lit(0)))
    return hash_shares(band, "__band", key, share, seed, strata + 1).withColumn("train", F.col("taken").cast("int")).drop("__band", "taken")


def stratified_sample(df: DataFrame, key: str, y: str, n_strata: int = 5, share: float = 0.25, seed: int = 0) -> DataFrame:
    """The given share of each of ``n_strata`` equally wide strata of y, by a hash of the key."""
    ends = df.agg(F.min(y).alias("__a"), F.max(y).alias("__b"))
    s = F.least(F.floor((F.col(y) - F.col("__a")) / F.nullif((F.col("__b") - F.col("__a")) / n_strata, F.lit(0.0))), F.lit(n_strata - 1))
    band = df.join(F.broadcast(ends)).withColumn("stratum", F.coalesce(s, F.lit(0))).drop("__a", "__b")
    return hash_shares(band, "stratum", key, share, seed, n_strata).where("taken").drop("taken")


def _assembled(df: DataFrame, xs: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=xs, outputCol="features").transform(df)


def fit_forest(train: DataFrame, y: str, xs: list[str], trees: int = 300, mtry: int = 5, share: float = 0.8, depth: int = 12, min_node: int = 1, seed: int = 0) -> RandomForestRegressionModel:
    """Forest without replacement; Spark has no out-of-bag error, so judge it on held-out rows."""
    rf = RandomForestRegressor(labelCol=y, featuresCol="features", numTrees=trees, featureSubsetStrategy=str(min(mtry, len(xs))), subsamplingRate=share, bootstrap=False, maxDepth=depth, minInstancesPerNode=min_node, seed=seed)
    return rf.fit(_assembled(train, xs))


def predict(model, df: DataFrame, xs: list[str], y: str | None = None) -> DataFrame:
    """Rows with ``prediction`` and, given y, ``error`` = prediction - observation."""
    out = model.transform(_assembled(df, xs)).drop("features")
    return out.withColumn("error", F.col("prediction") - F.col(y)) if y else out


def scores(predicted: DataFrame, y: str) -> DataFrame:
    """One row: rmse and r2."""
    sse = F.sum(F.pow(F.col("prediction") - F.col(y), 2.0))
    return predicted.agg(F.sqrt(sse / F.count("*")).alias("rmse"), (1 - sse / (F.var_pop(y) * F.count("*"))).alias("r2"))


def tune_forest(train: DataFrame, test: DataFrame, y: str, xs: list[str], grid: list[dict], top: int = 50) -> DataFrame:
    """Settings in order of held-out error with the gain over the first setting, in percent."""
    rows = []
    for g in grid:
        r = scores(predict(fit_forest(train, y, xs, **g), test, xs, y), y).first()
        rows.append((str(sorted(g.items())), float(r.rmse), float(r.r2)))
    first = rows[0][1]
    out = [(s, e, r, 100 * (first - e) / first if first else 0.0) for s, e, r in rows]
    return train.sparkSession.createDataFrame(out, "setting string, rmse double, r2 double, gain double").orderBy("rmse", "setting").limit(top)


def permutation_importance(model, test: DataFrame, key: str, y: str, xs: list[str], repeats: int = 1) -> DataFrame:
    """``(variable, importance)``: rise of the squared error when a column is dealt anew; all columns are scored in one job."""
    hashed = test.select(key, y, *[F.col(x).cast("double").alias(x) for x in xs]).withColumn("__h", F.coalesce(F.md5(F.col(key).cast("string").cast("binary")), F.lit("")))
    rows = numbered(hashed.withColumn("__part", F.substring("__h", 1, 3)), [], "__part", [F.col("__h"), F.col(key)], "__i")
    # numbered once for all variables, and joined once to all their values at new places
    rows = materialise(rows.select((F.col("__i") - 1).cast("bigint").alias("__i"), y, *xs), "numbered")
    moves = F.array(*[F.struct(F.lit(x).alias("variable"), F.lit(zlib.crc32(x.encode())).cast("bigint").alias("salt"), F.col(x).alias("value")) for x in xs])
    moved = rows.select("__i", F.explode(moves).alias("m")).withColumn("perm", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    deal = (F.col("m.salt") + F.col("perm").cast("bigint") * PERM_STEP).bitwiseAND(F.lit(MASK))
    moved = moved.select("m.variable", "m.value", permuted_column("__i", F.lit(rows.count()).cast("bigint"), deal).alias("__i"))
    dealt = moved.join(rows, "__i").select("variable", y, *[F.when(F.col("variable") == x, F.col("value")).otherwise(F.col(x)).alias(x) for x in xs])
    every = dealt.unionByName(rows.select(F.lit("").alias("variable"), y, *xs))
    values = _grid_values(rows, rows, xs)
    if values is None:
        scored = predict(model, every, xs)
    else:
        points = predict(model, _grid(rows.sparkSession, xs, values), xs).select(*xs, "prediction")
        scored = every.join(F.broadcast(points), xs)
    error = F.col("prediction") - F.col(y)
    mse = scored.groupBy("variable").agg(F.avg(error * error).alias("mse"))
    true = mse.where("variable = ''").select(F.col("mse").alias("__t"))
    return mse.where("variable <> ''").join(F.broadcast(true)).select("variable", (F.col("mse") - F.col("__t")).alias("importance"))


def shap_sample(model, df: DataFrame, background: DataFrame, key: str, xs: list[str], nsim: int = 10, seed: int = 0) -> DataFrame:
    """Monte-Carlo Shapley values ``(key, variable, phi)``.

    Each row, variable and draw meets one background row (by rank) and one random order of the
    variables (by hash); two vectors that differ in the variable alone are scored in one job.
    """
    n = background.count()
    h = lambda *c: F.xxhash64(F.lit(seed), *c)
    place = lambda name: h(F.col(key).cast("string"), F.col("sim"), F.lit("order"), name)
    values = _grid_values(df, background, xs)
    if values is not None:
        return _shap_on_grid(model, df, background, key, xs, nsim, n, h, values)
    # numbered by hash, range by range
    bg = background.select(*[F.col(x).alias(f"__b_{x}") for x in xs]).withColumn("__h", h(*[F.col(f"__b_{x}") for x in xs])).withColumn("__part", F.shiftright("__h", 54))
    bg = numbered(bg, [], "__part", [F.col("__h"), *[F.col(f"__b_{x}") for x in xs]], "__rank").drop("__h", "__part")
    base = df.select(key, *xs).withColumn("variable", F.explode(F.array(*map(F.lit, xs)))).withColumn("sim", F.explode(F.sequence(F.lit(0), F.lit(nsim - 1))))
    base = base.withColumn("__rank", (F.pmod(h(F.col(key).cast("string"), F.col("variable"), F.col("sim")), F.lit(n)) + 1).cast("int")).join(bg, "__rank")
    own = place(F.col("variable"))
    both = base.withColumn("side", F.explode(F.array(F.lit(1), F.lit(-1))))
    mixed = {x: F.when(F.col("variable") == x, F.when(F.col("side") == 1, F.col(x)).otherwise(F.col(f"__b_{x}"))).when(place(F.lit(x)) < own, F.col(x)).otherwise(F.col(f"__b_{x}")) for x in xs}
    scored = predict(model, both.select(key, "variable", "side", *[c.alias(x) for x, c in mixed.items()]), xs)
    return scored.groupBy(key, "variable").agg((F.sum(F.col("side") * F.col("prediction")) / nsim).alias("phi"))


def _grid_values(df: DataFrame, background: DataFrame, xs: list[str]) -> list[list[float]] | None:
    """The values of each variable in rising order if their product has at most GRID points, else None (as with nulls or NaN)."""
    both = df.select(*[F.col(x).cast("double").alias(x) for x in xs]).unionAll(background.select(*[F.col(x).cast("double").alias(x) for x in xs]))
    odd = F.sum(sum((F.coalesce(F.isnan(x) | F.col(x).isNull(), F.lit(True)).cast("int") for x in xs), F.lit(0)))
    got = both.agg(odd.alias("odd"), *[F.approx_count_distinct(x, 0.05).alias(x) for x in xs]).first()
    if got["odd"] is None or got["odd"] or math.prod(float(got[x]) for x in xs) > 2 * GRID:
        return None
    sets = both.agg(*[F.sort_array(F.collect_set(x)).alias(x) for x in xs]).first()
    values = [list(sets[x]) for x in xs]
    return values if math.prod(map(len, values)) <= GRID else None


def _grid(spark, xs: list[str], values: list[list[float]]) -> DataFrame:
    """``(id, xs)``: all points of the grid of values, the last variable's changing first."""
    step, out = 1, {}
    for x, v in reversed(list(zip(xs, values, strict=True))):
        out[x] = F.element_at(F.array(*[F.lit(u) for u in v]), (F.pmod(F.floor(F.col("id") / step), F.lit(len(v))) + 1).cast("int"))
        step *= len(v)
    return spark.range(step).select("id", *[out[x].alias(x) for x in xs])


def _shap_on_grid(model, df: DataFrame, background: DataFrame, key: str, xs: list[str], nsim: int, n: int, h, values: list[list[float]]) -> DataFrame:
    """The same draws where variables have few values: every point of their grid is scored once, and background rows of one vector, which have
    successive ranks, are a range of ranks; so nothing is joined and nothing of the size of rows times draws is shuffled."""
    sizes = [len(v) for v in values]
    steps = [math.prod(sizes[f + 1 :]) for f in range(len(xs))]
    of = lambda f: (F.array_position(F.array(*[F.lit(v) for v in values[f]]), F.col(xs[f]).cast("double")) - 1).cast("int")
    grid = _grid(df.sparkSession, xs, values)
    scored = np.zeros(math.prod(sizes))
    for r in predict(model, grid, xs).select("id", "prediction").toLocalIterator():
        scored[r.id] = r.prediction
    kinds = background.groupBy(*xs).agg(F.count("*").alias("__n")).withColumn("__h", h(*[F.col(x) for x in xs]))
    order = kinds.select("__n", F.shiftright("__h", 54).alias("__part"), "__h", *xs).orderBy("__part", "__h", *xs).collect()
    ends = np.cumsum([r["__n"] for r in order])
    codes = np.array([[values[f].index(r[x]) for f, x in enumerate(xs)] for r in order], np.int64)
    steps, k = np.array(steps, np.int64), len(xs)

    def phi(frames):
        for batch in frames:
            b = batch.num_rows
            if not b:
                continue
            flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False)
            own = flat("own").reshape(b, 1, 1, k).astype(np.int64)
            bg = codes[np.searchsorted(ends, flat("rank").reshape(b, nsim, k))]
            spot = flat("order").reshape(b, nsim, k)
            # row, draw, variable that is explained, variable
            first = spot[:, :, None, :] < spot[:, :, :, None]
            mixed = np.where(first, own, bg) * steps
            one = np.arange(k)
            rest = mixed.sum(axis=3) - mixed[:, :, one, one]
            plus, minus = rest + own[:, :, 0, :] * steps, rest + bg[:, :, one, one] * steps
            out = (scored[plus] - scored[minus]).sum(axis=1) / nsim
            names = pa.array(np.tile(np.array(xs, object), b))
            yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(np.repeat(np.arange(b), k))), names, pa.array(out.ravel())], names=[key, "variable", "phi"])

    draw = lambda s, x: (F.pmod(h(F.col(key).cast("string"), F.lit(x), F.lit(s)), F.lit(n)) + 1).cast("int")
    turn = lambda s, x: h(F.col(key).cast("string"), F.lit(s), F.lit("order"), F.lit(x))
    every = lambda f: F.array(*[f(s, x) for s in range(nsim) for x in xs])
    rows = df.select(key, F.array(*[of(f) for f in range(k)]).alias("own"), every(draw).alias("rank"), every(turn).alias("order"))
    schema = T.StructType([df.schema[key], T.StructField("variable", T.StringType()), T.StructField("phi", T.DoubleType())])
    return rows.mapInArrow(phi, schema)


def shap_importance(shap: DataFrame) -> DataFrame:
    """``(variable, importance)``: sum of absolute values."""
    return shap.groupBy("variable").agg(F.sum(F.abs("phi")).alias("importance"))


def predominance(shap: DataFrame, key: str, a: str | None = None, b: str | None = None) -> DataFrame:
    """Per row the variable of largest |phi|, or for two variables (|b| - |a|) / (|b| + |a|)."""
    if a is None or b is None:
        return shap.where("phi is not null").groupBy(key).agg(F.max_by("variable", F.struct(F.abs("phi").alias("p"), "variable")).alias("top"))
    v = lambda n: F.max(F.when(F.col("variable") == n, F.abs("phi")))
    return shap.groupBy(key).agg(v(a).alias("a"), v(b).alias("b")).select(key, ((F.col("b") - F.col("a")) / F.nullif(F.col("b") + F.col("a"), F.lit(0.0))).alias("norm_diff"))


def boruta(df: DataFrame, key: str, y: str, xs: list[str], rounds: int = 10, trees: int = 30, alpha: float = 0.05, seed: int = 0) -> DataFrame:
    """``(variable, hits, p)``: rounds in which a variable's importance beats every shadow's, and the binomial tail of that."""
    hits = dict.fromkeys(xs, 0)
    for r in range(rounds):
        rows = df.select(key, y, *xs)
        for x in xs:
            rows = rows.join(permutations(df.select(key, x), [], key, x, 1, salt=f"{seed}-{r}-{x}").select(key, F.col(x).alias(f"shadow_{x}")), key)
        every = [*xs, *[f"shadow_{x}" for x in xs]]
        imp = fit_forest(rows, y, every, trees=trees, depth=6, seed=seed + r).featureImportances.toArray()
        best = max(imp[len(xs) :])
        for i, x in enumerate(xs):
            hits[x] += imp[i] > best
    tail = lambda k: sum(math.comb(rounds, i) for i in range(k, rounds + 1)) / 2**rounds
    return df.sparkSession.createDataFrame([(x, int(k), float(tail(k)), int(tail(k) <= alpha)) for x, k in hits.items()], "variable string, hits int, p double, confirmed int")


def partial_dependence(model, df: DataFrame, key: str, xs: list[str], variable: str, n: int = 10) -> DataFrame:
    """``(at, mean)``: mean prediction with the variable set to each of n equal steps of its range."""
    ends = df.agg(F.min(variable).alias("__a"), F.max(variable).alias("__b"))
    rows = df.select(key, *xs).join(F.broadcast(ends)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = rows.withColumn(variable, F.col("__a") + F.col("k") * (F.col("__b") - F.col("__a")) / (n - 1)).drop("__a", "__b")
    return predict(model, rows, xs).groupBy(F.col(variable).alias("at")).agg(F.avg("prediction").alias("mean"))


def model_summary_pivot(tables: DataFrame, dataset: str, radius: str, variable: str, value: str, error: str = "mse") -> DataFrame:
    """Variables by (dataset, radius); the error row becomes its root."""
    v = F.when(F.col(variable) == error, F.sqrt(F.col(value))).otherwise(F.col(value))
    name = F.when(F.col(variable) == error, F.lit("rmse")).otherwise(F.col(variable))
    return tables.withColumns({"__v": v, "__n": name, "__c": F.concat_ws("_", dataset, radius)}).groupBy(F.col("__n").alias(variable)).pivot("__c").agg(F.first("__v"))


def prepare(response: DataFrame, y: str, covariates: dict[str, DataFrame], res: float, x0: float, y0: float, n_strata: int = 5, share: float = 0.25, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """Rows for a forest and a stratified sample of them: covariates aligned to the response's cells, complete cases, z-scores.

    response: key, x, y_ (cell centres) and ``y``; a cell without a response is out whatever its covariates are.
    covariates: name to grid (i, j, value) of cells ``res`` wide from (x0, y0), drawn to the cells' centres bilinearly.
    """
    rows = response.where(F.col(y).isNotNull()).select("key", "x", "y_", y)
    cells = rows.select("key", "x", "y_")
    for name, grid in covariates.items():
        drawn = align_bilinear(cells, grid.withColumnRenamed("value", name), "key", "x", "y_", name, res, x0, y0)
        rows = rows.join(drawn, "key", "left")
    whole = standardise(rows, [y, *covariates])
    return whole, stratified_sample(whole, "key", y, n_strata, share, seed).drop("stratum")


def parameter_grid(spark, axes: dict[str, list], done: DataFrame | None = None) -> DataFrame:
    """The product of parameter values, numbered in an order that looks random but repeats, without rows that ``done`` has.

    Numbers belong to the whole grid, so a parameter set keeps its number as others finish.
    """
    out = None
    for name, values in axes.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(F.broadcast(one))
    order = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in axes]))
    out = out.withColumn("param_id", F.row_number().over(W.orderBy(order)))
    return out if done is None else out.join(done.select(*axes).distinct(), list(axes), "left_anti")
