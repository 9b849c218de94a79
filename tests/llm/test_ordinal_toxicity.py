import numpy as np

from seasonlark.llm import ordinal_toxicity as O

SCHEMA = "doc_id bigint, text string, z double, over string, grade string"


def test_thresholds_are_ordered_and_order_the_grades():
    rng = np.random.default_rng(1)
    n = 3000
    x = rng.random((n, 5)) < 0.3
    z = x @ np.array([3.0, 2.0, 0, 0, 1.0]) + rng.logistic(size=n)
    grade = (z > 2).astype(int) + (z > 4)
    row, col = np.nonzero(x)
    w, theta = O.fit_ordinal(grade, row, col, 5, lasso_texts=0.1)
    assert theta[0] < theta[1] and np.allclose(theta, [2, 4], atol=0.5)
    assert np.allclose(w, [3, 2, 0, 0, 1], atol=0.5)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    out = O.severity(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    toxic, clean = [r.is_toxic for r in out if r.toxic == 1], [r.is_toxic for r in out if r.toxic == 0]
    assert sum(toxic) >= 0.85 * len(toxic) and sum(clean) <= 0.01 * len(clean)
    assert all(0 <= r.severity <= 2 and 0 <= r.grade <= 2 for r in out)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "bad bad", 1.0, "o", "g"), (1, None, 1.0, "o", "g"), (1, None, 1.0, "o", "g"), (2, "", 1.0, "o", "g"), (3, "x " * 30000, None, None, None)], SCHEMA)
    for rows in ([], [(1, 0), (2, None), (None, 1), (77, 1)], [(1, 1), (1, 0), (2, 0), (3, 1)]):
        out = O.severity(docs, spark.createDataFrame(rows, "doc_id bigint, toxic int")).collect()
        assert len(out) == 5 and all(0 <= r.severity <= 2 for r in out)
    assert O.severity(docs.limit(0), spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")).count() == 0


def test_query_covers_every_document(spark):
    sf = "/root/testdata/sf0.01"
    out = O.op4_ordinal_toxicity(spark, sf)
    assert out.count() == spark.read.parquet(f"{sf}/documents.parquet").count()
