import math
import random
import re
from collections import Counter

import duckdb
import pytest

from seasonlark.llm import term_pipeline as P

SF = "/root/testdata/sf0.01"
RUN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def words(text):
    return RUN.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, top=20):
    bags = [(i, Counter(words(t))) for i, t in docs]
    live = [(i, b) for i, b in bags if b]
    n, total = len(live), sum(sum(b.values()) for _, b in live)
    df = Counter(t for _, b in live for t in b)
    wanted = {}
    for i, t in set(items):
        wanted.setdefault(i, Counter()).update(words(t))
    out = []
    for i, q in wanted.items():
        scored = []
        for d, b in live:
            m = 75 + 25 * sum(b.values()) * n // total
            s = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * b[t] // (1000 * b[t] + 12 * m)) for t, k in q.items() if t in b)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want = con.sql(P.OP13_SQL).fetchall()
    out = P.op13_term_pipeline(spark, SF)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert got(out) == sorted(want, key=repr)


def texts(rnd, n):
    pool = [f"w{k}" for k in range(60)] + ["É", "é", "naïve", "X1", "ß", "日本"]
    return [" ".join(rnd.choices(pool, weights=[1 / (k + 1) for k in range(len(pool))], k=rnd.choice([1, 3, 20, 80]))) for _ in range(n)]


@pytest.mark.parametrize("shipped", [P.SHIPPED_TERMS, 3])
def test_against_brute_force(spark, monkeypatch, shipped):
    monkeypatch.setattr(P, "SHIPPED_TERMS", shipped)
    monkeypatch.setattr(P, "BLOCK_DOCS", 150)
    monkeypatch.setattr(P, "BUNDLE_ITEMS", 4)
    rnd = random.Random(shipped)
    docs = list(enumerate(texts(rnd, 700)))
    docs += [(1000 + k, docs[3][1]) for k in range(300)] + [(5, "w1 W1"), (5, "w1 W1"), (None, "w2 w2"), (6, None), (7, ""), (8, "... -- !!")]
    items = list(enumerate(texts(rnd, 12))) + [(50, None), (51, "nowhere"), (52, docs[3][1]), (0, "w59 w59"), (52, docs[3][1])]
    d = spark.createDataFrame([(i, t, "c", 1) for i, t in docs], "doc_id long, text string, item_id string, n int")
    q = spark.createDataFrame([(i, t, 3) for i, t in items], "item_id long, text string, score int")
    assert got(P.ranked_search(d, q)) == brute(docs, items)
    assert got(P.ranked_search(d, q, top=3, owners=2)) == brute(docs, items, 3)


def test_empty_tables_and_one_long_text(spark):
    d = spark.createDataFrame([(1, "alpha " * 300_000 + "beta"), (2, "beta gamma"), (3, "delta")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "Beta beta")], "item_id long, text string")
    rows = [(1, "alpha " * 300_000 + "beta"), (2, "beta gamma"), (3, "delta")]
    assert got(P.ranked_search(d, q)) == brute(rows, [(1, "Beta beta")])
    assert got(P.ranked_search(d.limit(0), q)) == [] and got(P.ranked_search(d, q.limit(0))) == []


def test_owner_cuts():
    assert P._owner([(10, 5), (8, 5), (3, 10), (1, 20)], 4) == [8, 3, 1]
    assert P._owner([], 4) == []
