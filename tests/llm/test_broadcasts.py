"""Tables that Spark sizes too low, after an explode or by their compressed files, must not go through the driver."""

import numpy as np
import pytest

from seasonlark.llm import piece_lattice, similar_texts, simhash_anchors


def stored(spark, tmp_path, rows, schema):
    """The rows as a small file, whose size Spark knows."""
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "rows"))
    return spark.read.parquet(str(tmp_path / "rows"))


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_visits_are_not_broadcast(spark, tmp_path):
    fps = np.random.default_rng(3).integers(-(2**63), 2**63 - 1, 300).tolist()
    fps += [x ^ 5 for x in fps[:40]]
    nodes = stored(spark, tmp_path, [(x, i) for i, x in enumerate(fps)], "fp bigint, rep bigint")
    links = simhash_anchors.fingerprint_links(nodes)
    assert "BroadcastExchange" not in plan(links) and "SortMergeJoin" in plan(links)
    assert {(min(r), max(r)) for r in links.collect()} == {(i, 300 + i) for i in range(40)}


def test_texts_are_not_broadcast(spark, monkeypatch):
    made = []
    keep = similar_texts.materialise
    monkeypatch.setattr(similar_texts, "materialise", lambda df, tag: (made.append((tag, df)), keep(df, tag))[1])
    marked = spark.createDataFrame([(i, f"one two three four five {'six ' * (i // 2)}") for i in range(6)], "key bigint, text string")
    got = similar_texts._links(spark.createDataFrame([(0, 1), (1, 4), (2, 3)], "a bigint, b bigint"), marked, 0.8)
    assert "BroadcastExchange" not in plan(dict(made)["links"])
    assert sorted(map(tuple, got.collect())) == [(0, 1), (2, 3)]


@pytest.mark.parametrize("frequent", [0, 1000])
def test_rare_chunks_are_not_broadcast(spark, tmp_path, frequent):
    docs = stored(spark, tmp_path, [(i, f"word{i} is word{i + 1}") for i in range(20)], "doc_id bigint, text string")
    coded = piece_lattice.encode(docs, piece_lattice.model_path(), frequent=frequent)
    # the only broadcast is that of the piece table
    assert plan(coded).count("BroadcastExchange") <= 1 and "SortMergeJoin" in plan(coded)
    assert coded.count() == 20
