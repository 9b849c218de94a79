import hashlib

import duckdb
import numpy as np

from seasonlark.llm import substring_cover as S

SCHEMA = "doc_id bigint, text string, k int, shared string, tag string"


def brute(rows, window=20):
    seen, out = set(), {}
    docs = [(i, (t or "").encode().split()) for i, t in rows]
    for i, w in sorted(docs, key=lambda x: x[0]):
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key in seen:
                gone[p : p + window] = [True] * window
            seen.add(key)
        out[i] = (len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode())
    return out


def test_cover_is_a_difference_cover():
    assert {(a - b) % S.PERIOD for a in S.COVER for b in S.COVER} == set(range(S.PERIOD))


def test_matches_brute_force_on_planted_runs(spark):
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(400)]
    pick = lambda n: [vocab[i] for i in rng.integers(0, 400, n)]
    runs = [pick(n) for n in (19, 20, 21, 33, 52, 80)]
    rows = []
    for i in range(120):
        parts = []
        for _ in range(rng.integers(0, 5)):
            parts += pick(rng.integers(0, 40))
            if rng.random() < 0.7:
                r = runs[rng.integers(0, len(runs))]
                a = rng.integers(0, 3)
                parts += r[a : len(r) - rng.integers(0, 3)]
        rows.append((i, " ".join(parts)))
    rows += [(200, rows[3][1]), (201, rows[3][1]), (202, "x " * 300), (203, "x\t" * 300 + "y"), (204, None), (205, ""), (206, "é ü  a\r\nb"), (207, "ab " * 20)]
    out = S.dedup_substrings(spark.createDataFrame([(*r, 1, "s", "t") for r in rows], SCHEMA).repartition(5)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out} == brute(rows)


def test_nulls_and_repeated_rows(spark):
    run = " ".join(f"a{i}" for i in range(25))
    rows = [(None, run), (1, run), (1, run), (2, "b " + run + " c"), (2, "other"), (3, None), (4, "new " * 25), (4, "new " * 25)]
    out = S.dedup_substrings(spark.createDataFrame([(*r, 1, "s", "t") for r in rows], SCHEMA)).collect()
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed) for r in out)
    assert got == [(0, 25, 0), (1, 25, 25), (1, 25, 25), (2, 1, 0), (2, 27, 25), (3, 0, 0), (4, 25, 24), (4, 25, 24)]
    assert S.dedup_substrings(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_matches_sql_and_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in S.op6_substring_cover(spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert out == {i: (n, g, hashlib.sha256(t.encode()).hexdigest()) for i, (n, g, t) in brute(rows).items()}
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{sf}/documents.parquet')")
    assert out == {r[0]: r[1:] for r in con.sql(S.OP6_SQL).fetchall()}


def test_many_rows_without_an_id(spark):
    rng = np.random.default_rng(8)
    texts = [" ".join(f"v{i}" for i in rng.integers(0, 5000, 60)) for _ in range(30)]
    rows = [(None, t) for t in texts for _ in range(4)] + [(None, "z " * 40)] * 3 + [(i, t + " end") for i, t in enumerate(texts)]
    out = S.dedup_substrings(spark.createDataFrame([(*r, 1, "s", "t") for r in rows], SCHEMA).repartition(6)).collect()
    blank = sorted((r.n_words, r.n_removed) for r in out if r.doc_id is None)
    assert blank == [(40, 39)] * 3 + [(60, 0)] * 120
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept) for r in out if r.doc_id is not None} == {i: (61, 60, "end") for i in range(30)}
