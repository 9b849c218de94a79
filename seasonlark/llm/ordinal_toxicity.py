"""Toxicity severity by cumulative-link ordinal regression on sparse words.

P(grade > j) = sigmoid(w.x - theta_j): one weight vector shared by all ordered thresholds,
with x the presence of words in the whole text.  Labels only say toxic or not, so the
grades of the toxic training texts are told apart by how many distinct marker words (high
smoothed log-odds) they hold: below the median is grade 1, from it on grade 2.  The fit is a
proximal gradient descent with a lasso over weights of at least zero (harmless words must
not make up for an insult, however long the text), so few words keep a weight; scoring
looks up those words only and needs no shuffle.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlark.scratch import materialise

#: At most so many labelled texts are used for the fit, those with the smallest hash of their id.
MAX_TRAINING_ROWS = 20_000
MIN_TEXTS, MAX_TERMS = 3, 200_000
MARKER_LOG_ODDS = 2.0
#: The lasso's weight is LASSO_TEXTS / n: a word needs about so many telling texts to keep a weight.
LASSO_TEXTS, ROUNDS = 1.2, 400
#: What is left of the lasso when the chosen words are fitted again, so that they aren't shrunk.
RELAXED_TEXTS = 0.1
TOXIC = 0.3
_WORD = re.compile(r"\w+")


def words(text: str | None) -> set[str]:
    """Distinct lower-case runs of word characters of the whole text."""
    return set(_WORD.findall((text or "").lower()))


def grades(toxic: np.ndarray, row: np.ndarray, col: np.ndarray, size: int) -> np.ndarray:
    """0 for clean texts; 1 or 2 for toxic ones by their number of distinct markers."""
    hot = toxic[row] == 1
    a, b = np.bincount(col[hot], minlength=size), np.bincount(col[~hot], minlength=size)
    odds = np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((1 - toxic).sum() + 1))
    marks = np.bincount(row, (odds >= MARKER_LOG_ODDS)[col] & hot, len(toxic))
    own = marks[(toxic == 1) & (marks > 0)]
    cut = max(2.0, float(np.median(own))) if len(own) else 2.0
    return np.where(toxic == 0, 0, np.where(marks >= cut, 2, 1))


def fit_ordinal(grade: np.ndarray, row: np.ndarray, col: np.ndarray, size: int, n_grades: int = 3, lasso_texts: float = LASSO_TEXTS, rounds: int = ROUNDS):
    """(weights, thresholds) of the cumulative-link model on presence features (row, col)."""
    n = len(grade)
    lasso = lasso_texts / max(1, n)
    sig = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    above = np.stack([(grade > j).astype(float) for j in range(n_grades - 1)])
    share = np.clip(above.mean(axis=1), 1 / (n + 2), 1 - 1 / (n + 2)) if n else np.full(n_grades - 1, 0.5)
    theta = np.sort(-np.log(share / (1 - share)))
    theta += np.arange(n_grades - 1) * 1e-3
    w = np.zeros(size)
    if not n or grade.max(initial=0) == 0:
        return w, theta
    # squared gradients scale each step, since words differ much in how often they occur
    gw, gt = np.full(size, 1e-8), np.full(n_grades - 1, 1e-8)
    for step in range(rounds):
        z = np.bincount(row, w[col], n)
        edges = np.concatenate([np.ones((1, n)), sig(z - theta[:, None]), np.zeros((1, n))])
        lik = np.maximum(edges[grade, np.arange(n)] - edges[grade + 1, np.arange(n)], 1e-9)
        slope = edges * (1 - edges)
        dz = -(slope[grade, np.arange(n)] - slope[grade + 1, np.arange(n)]) / lik / n
        dt = np.array([(np.where(grade == j + 1, slope[j + 1] / lik, 0) - np.where(grade == j, slope[j + 1] / lik, 0)).sum() / n for j in range(n_grades - 1)])
        g = np.bincount(col, dz[row], size)
        gw, gt = 0.9 * gw + 0.1 * g * g, 0.9 * gt + 0.1 * dt * dt
        rate = 0.08 / (1 + step / 60)
        w = w - rate * g / np.sqrt(gw)
        w = np.maximum(w - rate * lasso / np.sqrt(gw), 0)
        theta = np.sort(theta - rate * dt / np.sqrt(gt))
    return w, theta


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> tuple[dict[str, float], list[float]]:
    """(weight of each word that keeps one, thresholds) from a bounded sample of labelled texts."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def distinct_words(texts: pd.Series) -> pd.Series:
        return pd.Series([sorted(words(t)) for t in texts], dtype=object)

    known = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).alias("y"))
    picked = docs.select(F.col(doc_id).alias("__id")).distinct().join(known, "__id").orderBy(F.xxhash64("__id"), "__id").limit(MAX_TRAINING_ROWS)
    picked = materialise(picked, "toxic-sample")
    sample = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(F.broadcast(picked), "__id")
    sample = materialise(sample.select("__id", "y", distinct_words("__text").alias("ws")), "toxic-words")
    kept = sample.select(F.explode("ws").alias("w")).groupBy("w").count().where(F.col("count") >= MIN_TEXTS).orderBy(F.desc("count"), "w").limit(MAX_TERMS)
    index = {r.w: i for i, r in enumerate(kept.collect())}
    y, row, col = [], [], []
    for r in sample.orderBy("__id", F.xxhash64("ws")).toLocalIterator():
        own = [index[w] for w in r.ws if w in index]
        row += [len(y)] * len(own)
        col += own
        y.append(int(r.y))
    toxic, row, col = np.array(y, np.int64), np.array(row, np.int64), np.array(col, np.int64)
    grade = grades(toxic, row, col, len(index))
    w, _ = fit_ordinal(grade, row, col, len(index))
    chosen = np.flatnonzero(w)
    own = np.isin(col, chosen)
    w2, theta = fit_ordinal(grade, row[own], np.searchsorted(chosen, col[own]), len(chosen), lasso_texts=RELAXED_TEXTS)
    strong = dict(zip(chosen.tolist(), w2.tolist(), strict=True))
    return {t: strong[i] for t, i in index.items() if strong.get(i)}, theta.tolist()


def severity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> DataFrame:
    """``(doc_id, severity, p_toxic, grade, is_toxic)`` per row: expected grade (0 to 2), P(grade > 0), likeliest grade.

    Null and empty texts hold no words and get the base rate.  Repeated rows and null ids are
    scored like others.  Without any toxic label everything is clean.  An empty table gives no
    rows; other columns are ignored.
    """
    weights, theta = fit(docs, labels, doc_id, text, label)

    @F.pandas_udf("double")
    def margin(texts: pd.Series) -> pd.Series:
        keys = weights.keys()
        return pd.Series([sum(map(weights.__getitem__, keys & words(t))) for t in texts], dtype="float64")

    out = docs.select(F.col(doc_id).alias("doc_id"), margin(F.col(text)).alias("z"))
    over = [1 / (1 + F.exp(F.lit(t) - F.col("z"))) for t in theta]
    out = out.select("doc_id", F.array(*over).alias("over")).select(
        "doc_id",
        F.aggregate("over", F.lit(0.0), lambda a, x: a + x).alias("severity"),
        F.get("over", F.lit(0)).alias("p_toxic"),
        F.size(F.filter("over", lambda x: x >= 0.5)).alias("grade"),
    )
    return out.withColumn("is_toxic", (F.col("p_toxic") >= TOXIC).cast("int"))


def op4_ordinal_toxicity(spark, sf_dir: str) -> DataFrame:
    """Expected toxicity grade of every document."""
    return severity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
