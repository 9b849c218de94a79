"""Order statistics and shares against numpy and plain Python."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seasonlark.operators import attribution, clean, order, series


def frame(spark, xs):
    return spark.createDataFrame([(None if x is None else float(x),) for x in xs], "v double").repartition(3)


@pytest.mark.parametrize("kind", ["normal", "ties", "powers", "constant", "outlier"])
def test_percentiles_equal_numpy(spark, monkeypatch, kind):
    monkeypatch.setattr(order, "FEW", 20)
    monkeypatch.setattr(order, "ACCURACY", 50)
    rng = np.random.default_rng(3)
    x = {
        "normal": rng.normal(size=4000), "ties": rng.integers(0, 5, 4000).astype(float), "powers": 10.0 ** rng.uniform(-300, 300, 3000),
        "constant": np.full(500, 2.5), "outlier": np.r_[rng.normal(size=2000), 1e300, -1e300],
    }[kind]
    shares = [0.0, 0.05, 0.25, 0.5, 0.95, 1.0]
    got = order.percentiles(frame(spark, [*x, None, float("nan")]), "v", shares)
    assert np.allclose(got, np.percentile(x, [100 * s for s in shares]), rtol=1e-12, atol=0)


def test_wrong_proposals_do_not_change_the_result(spark, monkeypatch):
    monkeypatch.setattr(order, "FEW", 5)
    x = np.random.default_rng(4).permutation(1000).astype(float)
    for side in (0, 1):
        calls, true = [], order._proposed

        def misled(rows, v, todo, side=side, calls=calls, true=true):
            calls.append(1)
            return true(rows, v, todo) if len(calls) > 1 else [((900.0, 910.0), (10.0, 20.0))[side]] * len(todo)

        monkeypatch.setattr(order, "_proposed", misled)
        assert order.order_statistics(frame(spark, x), "v", [500, 3]) == [500.0, 3.0]
        monkeypatch.setattr(order, "_proposed", true)


def test_percentiles_of_nothing(spark):
    assert order.percentiles(frame(spark, []), "v", [0.5]) == [None] == order.percentiles(frame(spark, [None, float("nan")]), "v", [0.5])
    assert order.percentiles(frame(spark, [7.0]), "v", [0.0, 0.3, 1.0]) == [7.0] * 3
    with pytest.raises(IndexError):
        order.order_statistics(frame(spark, [1.0]), "v", [1])
    assert clean.percentile_filter(frame(spark, [None]), "v", 0.5).count() == 0
    assert [r.v for r in series.percentile_clip(frame(spark, [None, 3.0]), "v", 0.1, 0.9).collect()] == [None, None]


def test_shares_equal_ranks(spark):
    rows = [(k, None if k % 7 == 0 else k % 3) for k in range(2000)]
    got = {r.k: r.taken for r in order.hash_shares(spark.createDataFrame(rows, "k long, s int"), "s", "k", 0.3, seed=5).collect()}
    for s in (None, 0, 1, 2):
        keys = sorted((k for k, t in rows if t == s), key=lambda k: hashlib.md5(f"5-{k}".encode()).hexdigest())
        want = set(keys[: int(len(keys) * 0.3 + 0.5)])
        assert {k for k in keys if got[k]} == want


def test_shares_of_odd_tables(spark):
    empty = spark.createDataFrame([], "k long, s int")
    assert order.hash_shares(empty, "s", "k", 0.5).count() == 0
    same = spark.createDataFrame([(1, 0)] * 10 + [(None, 1)] * 3, "k long, s int")
    got = order.hash_shares(same, "s", "k", 0.5)
    assert got.count() == 13 and {r.s: r.n for r in got.where("taken").groupBy("s").agg(F.count("*").alias("n")).collect()} == {0: 10, 1: 3}
    for share, n in ((0.0, 0), (1.0, 13)):
        assert order.hash_shares(same, "s", "k", share).where("taken").count() == n


def test_split_moves_no_rows_by_stratum(spark):
    df = spark.range(5000).select(F.col("id").alias("k"), (F.col("id") % 97).cast("double").alias("y"))
    out = attribution.stratified_split(df, "k", "y", 0.6)
    share = out.groupBy("train").count().collect()
    assert abs({r.train: r["count"] for r in share}[1] - 3000) <= 4
    sample = attribution.stratified_sample(df, "k", "y", 5, 0.25)
    assert sample.columns == ["k", "y", "stratum"] and abs(sample.count() - 1250) <= 5


def test_thresholds_are_sent_only_under_a_bound(spark, capsys):
    df = spark.range(100).select(F.col("id").alias("k"), (F.col("id") % 2).alias("s"))
    order.hash_shares(df, "s", "k", 0.5, n_strata=2).explain()
    assert capsys.readouterr().out.count("BroadcastHashJoin") == 2
