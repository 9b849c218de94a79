"""Quality classifier: a sparse ensemble of conjunctive rules.

Shallow trees are grown on statistics of labelled texts; every path from a root to a node
is a rule (a conjunction of comparisons).  A lasso logistic regression on the rules' truth
values gives most of them weight zero.  What is left is compiled into one Spark column
expression, so scoring a corpus is a projection without Python, joins or shuffles.
"""

from __future__ import annotations

import math
import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlark.llm.docstats import with_stats
from seasonlark.scratch import materialise

#: At most so many labelled rows are used for the fit, those with the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000
THRESHOLD = 0.7
SEED = 11


def _share(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0)).cast("double")


#: The statistics that rules may test; none of them looks at ids, languages, sources or labels.
FEATURES: dict[str, Column] = {}


def features() -> dict[str, Column]:
    """Name and expression of each statistic over the columns of ``with_stats``."""
    if not FEATURES:
        FEATURES.update(
            {
                "log_words": F.log1p(F.col("n_words")).cast("double"),
                "word_length": _share("word_chars", "n_words"),
                "symbol_share": _share("n_symbols", "n_chars_all"),
                "pipe_share": _share("n_pipes", "n_words"),
                "upper_share": F.coalesce(F.get("chars", F.lit(0)) / F.nullif(F.get("chars", F.lit(0)) + F.get("chars", F.lit(1)), F.lit(0)), F.lit(0.0)),
                "digit_share": F.coalesce(F.get("chars", F.lit(2)) / F.nullif(F.col("n_chars_all"), F.lit(0)), F.lit(0.0)),
                "other_share": F.coalesce(F.get("chars", F.lit(5)) / F.nullif(F.col("n_chars_all"), F.lit(0)), F.lit(0.0)),
                "repeat_share": _share("n_repeat_words", "n_words"),
                "distinct_share": _share("n_distinct_words", "n_words"),
                "dup_line_share": _share("n_dup_lines", "n_lines"),
                "common_share": _share("n_common", "n_words"),
                "line_words": _share("n_words", "n_lines"),
            }
        )
    return FEATURES


def tree_rules(debug: str, names: list[str]) -> list[tuple[tuple[str, str, float], ...]]:
    """Every path of every tree in a forest's printed form as a tuple of (feature, operator, cut), without repeats."""
    rules, path = {}, []
    for line in debug.splitlines():
        m = re.match(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\deE]+)\)", line)
        if not m:
            if line.strip().startswith("Tree"):
                path = []
            continue
        depth = len(m[1])
        path = [x for x in path if x[0] < depth] + [(depth, (names[int(m[3])], m[4], float(m[5])))]
        tightest: dict[tuple[str, str], float] = {}
        for _, (name, op, cut) in path:
            old = tightest.get((name, op))
            tightest[name, op] = cut if old is None else (min if op == "<=" else max)(old, cut)
        rules[tuple(sorted((n, o, c) for (n, o), c in tightest.items()))] = None
    return list(rules)


def rule_column(rule: tuple[tuple[str, str, float], ...]) -> Column:
    """The conjunction as a boolean column."""
    out = F.lit(True)
    for name, op, cut in rule:
        out &= F.col(name) <= cut if op == "<=" else F.col(name) > cut
    return out


def fit_rules(train: DataFrame, label: str, names: list[str], trees: int = 12, depth: int = 3, lasso: float = 0.003) -> tuple[float, list]:
    """(intercept, [(weight, rule)]) of the rules that the lasso keeps.

    train: one row per labelled text, few enough for one machine.  With one class only there
    are no rules, and the intercept is that class's smoothed log-odds; with no rows it is 0.
    """
    counts = {int(r[0]): r[1] for r in train.groupBy(label).count().collect()}
    ones, zeros = counts.get(1, 0), counts.get(0, 0)
    prior = math.log((ones + 1) / (zeros + 1))
    if not ones or not zeros:
        return prior, []
    rows = train.select(F.col(label).cast("double").alias("label"), *names)
    grown = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=SEED, featureSubsetStrategy="sqrt", minInstancesPerNode=3).fit(
        rows.select("label", array_to_vector(F.array(*names)).alias("features"))
    )
    rules = tree_rules(grown.toDebugString, names)
    if not rules:
        return prior, []
    truth = F.array(*[rule_column(r).cast("double") for r in rules])
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=80, standardization=True).fit(rows.select("label", array_to_vector(truth).alias("features")))
    return float(model.intercept), [(float(w), r) for w, r in zip(model.coefficients.toArray(), rules, strict=True) if w]


def score_column(intercept: float, weighted: list) -> Column:
    """The ensemble as one column expression: the probability of label 1."""
    z = F.lit(intercept)
    for w, rule in weighted:
        z = z + F.when(rule_column(rule), w).otherwise(0.0)
    return 1 / (1 + F.exp(-z))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs``.

    Only labels of rows whose crc32(doc_id) mod 4 is not 2 are learnt from; the others are
    held out.  Null and empty texts are scored by their statistics (all 0).  A null id is
    never held out and never learnt from.  Repeated rows are scored alike; of a repeated
    or contradicting label the larger counts; null labels are ignored.  An empty table
    gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    own = features()
    stats = materialise(with_stats(base).select("doc_id", *[c.alias(n) for n, c in own.items()]), "quality-stats")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).alias("__label"))
    train = stats.where(~held).join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_TRAINING_ROWS)
    train = materialise(train.coalesce(2), "quality-train")
    intercept, weighted = fit_rules(train, "__label", list(own))
    scored = stats.select("doc_id", held.alias("held_out"), score_column(intercept, weighted).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the classifier accepts; rows with a null id have no score to join and stay."""
    bad = quality_scores(docs.where(F.col(doc_id).isNotNull()), labels, doc_id, text).where("predicted = 0").select(F.col("doc_id").alias("__bad")).distinct()
    return docs.join(bad, F.col(doc_id) == F.col("__bad"), "left_anti")


def op1_rule_ensemble(spark, sf_dir: str) -> DataFrame:
    """Quality score of every document."""
    return quality_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
