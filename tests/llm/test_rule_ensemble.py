import zlib

from seasonlark.llm import rule_ensemble as R

SCHEMA = "doc_id bigint, text string, score string, predicted int, log_words string"


def test_held_out_accuracy_and_contract(spark):
    sf = "/root/testdata/sf0.01"
    out = R.op1_rule_ensemble(spark, sf).collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    assert len(held) > 60 and sum(p == y for p, y in held) >= 0.97 * len(held)


def test_tree_paths_are_all_nodes():
    text = """Model
  Tree 0 (weight 1.0):
    If (feature 0 <= 0.5)
     If (feature 1 <= 2.0)
      Predict: 0.0
     Else (feature 1 > 2.0)
      Predict: 1.0
    Else (feature 0 > 0.5)
     Predict: 1.0
"""
    rules = R.tree_rules(text, ["a", "b"])
    assert set(rules) == {(("a", "<=", 0.5),), (("a", "<=", 0.5), ("b", "<=", 2.0)), (("a", "<=", 0.5), ("b", ">", 2.0)), (("a", ">", 0.5),)}


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", "s", 1, "l"), (1, None, "s", 1, "l"), (1, None, "s", 1, "l"), (2, "", "s", 1, "l"), (3, "x " * 9000, None, None, None)], SCHEMA)
    for rows in ([], [(1, 1), (2, None), (9, 0)], [(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)]):
        labels = spark.createDataFrame(rows, "doc_id bigint, quality int")
        out = R.quality_scores(docs, labels).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
        assert not any(r.held_out for r in out if r.doc_id is None)
    assert R.quality_scores(docs.limit(0), labels).count() == 0
    assert R.keep_good(docs, labels).columns == docs.columns
