import re
from collections import Counter

import numpy as np

from seasonlark.llm import latent_decontamination as L

SCHEMA = "doc_id bigint, text string, item_id string, terms string, cosine int"


def plain_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_bit_parallel_lcs():
    rng = np.random.default_rng(0)
    for _ in range(300):
        a, b = rng.integers(0, 6, rng.integers(1, 90)).tolist(), rng.integers(0, 6, rng.integers(0, 200)).tolist()
        assert L.lcs_length(a, b) == plain_lcs(a, b)


def test_sketch_spans_the_leading_directions(spark):
    rng = np.random.default_rng(4)
    docs = [(i, rng.integers(0, 40, 300).tolist()) for i in range(30)]
    coded = spark.createDataFrame(docs, "doc_id bigint, terms array<int>")
    idf = np.concatenate([[0], rng.uniform(0.5, 2, 39)])
    rows = []
    for _, ts in docs:
        blocks = [ts[i : i + L.STRIDE] for i in range(0, 300, L.STRIDE)]
        for i in range(len(blocks)):
            tf = np.bincount(blocks[i] + (blocks[i + 1] if i + 1 < len(blocks) else []), minlength=40) * idf
            rows.append(tf / np.linalg.norm(tf))
    a = np.array(rows)
    items = np.zeros((1, 40))
    v = L.right_singular_vectors(coded, idf, items, rank=39)
    assert np.allclose(np.abs(v.T @ v), np.eye(v.shape[1]), atol=1e-4)
    assert np.linalg.norm(a - a @ v @ v.T) < 1e-2 * np.linalg.norm(a)


def test_planted_items_and_paraphrases(spark):
    rng = np.random.default_rng(7)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(3000)])
    pick = lambda n: rng.choice(vocab, n).tolist()
    items = [(i, pick(int(rng.integers(16, 60)))) for i in range(30)]
    docs, want = [], set()
    for d in range(300):
        words = pick(int(rng.integers(5, 500)))
        if d % 4 == 0:
            i, own = items[int(rng.integers(0, 30))]
            own = list(own)
            if d % 8 == 0:  # a paraphrase: some words changed, some put in
                for j in rng.choice(len(own), len(own) // 8, replace=False):
                    own[j] = "changed"
                own.insert(5, "inserted")
            at = int(rng.integers(0, len(words) + 1))
            words[at:at] = own
            want.add((d, i))
        docs.append((d, " ".join(words).upper() if d % 3 == 0 else ", ".join(words), "i", "t", 1))
    got = L.contaminated(spark.createDataFrame(docs, SCHEMA).repartition(3), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)


def test_odd_rows(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta"), (2, None), (3, ""), (None, "one two three four five six seven eight nine")], "item_id bigint, text string")
    hit = "x " * 40 + "alpha beta gamma delta epsilon zeta eta theta"
    docs = spark.createDataFrame([(1, hit, "i", "t", 1), (1, hit, None, None, None), (None, hit, "i", "t", 1), (2, None, "i", "t", 1), (3, "", "i", "t", 1), (4, "w " * 20000, "i", "t", 1), (5, "One two; three four five six seven eight nine", "i", "t", 1)], SCHEMA)
    got = Counter((r.doc_id, r.item_id) for r in L.contaminated(docs, bench).collect())
    assert got == {(1, 1): 2, (None, 1): 1, (5, None): 1}
    assert L.drop_contaminated(docs, bench).count() == 4
    assert L.contaminated(docs.limit(0), bench).count() == 0 and L.contaminated(docs, bench.limit(0)).count() == 0


def test_query_finds_every_exact_passage(spark):
    sf = "/root/testdata/sf0.01"
    norm = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    docs = [(r.doc_id, norm(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r.item_id, norm(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    exact = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r.doc_id, r.item_id) for r in L.op2_latent_decontamination(spark, sf).collect()}
    assert exact and exact <= got and len(got - exact) <= 2


def test_more_items_than_directions(spark):
    """Every one of 1024 items is found in a text that holds it whole, though the latent space has 112 directions."""
    rng = np.random.default_rng(12)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), 5)) for _ in range(2500)])
    share = 1 / np.arange(1, len(vocab) + 1)
    pick = lambda n: rng.choice(vocab, n, p=share / share.sum()).tolist()
    items = [(i, pick(int(rng.integers(16, 100)))) for i in range(1024)]
    docs = []
    for i, own in items:
        words = pick(int(rng.integers(60, 200)))
        at = int(rng.integers(0, len(words)))
        docs.append((i, " ".join([*words[:at], *own, *words[at:]])))
    got = L.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string").repartition(4), spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")).collect()
    assert {i for i, _ in items} == {r.item_id for r in got if r.doc_id == r.item_id}


def test_items_of_common_terms(spark):
    """An item that a third of the texts hold makes its own terms common, and is found in all of them."""
    rng = np.random.default_rng(13)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)])
    pick = lambda n: rng.choice(vocab, n).tolist()
    items = [(i, pick(25)) for i in range(5)]
    items[1] = (1, [*items[0][1][:20], *pick(20)])  # shares most of its beginning with the hot one
    docs, want = [], set()
    for d in range(300):
        words = pick(int(rng.integers(30, 150)))
        if d % 3 == 0 or d < 12:
            i = d // 3 % 5 if d < 12 else 0
            at = int(rng.integers(0, len(words)))
            words[at:at] = items[i][1]
            want.add((d, i))
        docs.append((d, " ".join(words)))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id bigint, text string")
    table = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    got = L.contaminated(table, bench).collect()
    assert want <= {(r.doc_id, r.item_id) for r in got}
    assert not {d for d, _ in want} & {r.doc_id for r in L.drop_contaminated(table, bench).collect()}


def test_the_latent_space_finds_paraphrases(spark, monkeypatch):
    """Three of ten words replaced: at least nine of ten are found, fewer without the cosine, and nothing in other texts either way."""
    rng = np.random.default_rng(11)
    weight = 1 / np.arange(1, 4001)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(4000)])
    pick = lambda n: rng.choice(vocab, n, p=weight / weight.sum()).tolist()
    items = [(i, pick(int(rng.integers(14, 40)))) for i in range(60)]
    docs, want = [], set()
    for d in range(400):
        words = pick(int(rng.integers(60, 400)))
        if d < 60:
            own = [f"other{rng.integers(10**6)}" if rng.random() < 0.3 else w for w in items[d][1]]
            at = int(rng.integers(0, len(words)))
            words = [*words[:at], *own, *words[at:]]
            want.add((d, d))
        docs.append((d, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    bench = spark.createDataFrame([(i, " ".join(ws)) for i, ws in items], "item_id long, text string")
    find = lambda: {(r.doc_id, r.item_id) for r in L.contaminated(table, bench).collect()}
    with_cosine = find()
    monkeypatch.setattr(L, "LATENT_COSINE", 5.0)
    without = find()
    assert len(with_cosine & want) >= 54 and with_cosine <= want
    assert without < with_cosine and len(without) < 54
