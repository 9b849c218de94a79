import numpy as np

import corpus_pipeline as C
from seasonlark.llm import similar_texts as S


def grams(text):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def similar(a, b):
    return not (a or b) or len(a & b) >= 0.8 * len(a | b)


def brute_components(rows):
    sets = [(i, grams(t)) for i, t in rows]
    comp, changed = {i: i for i, _ in sets}, True
    links = [(i, j) for k, (i, a) in enumerate(sets) for j, b in sets[k + 1 :] if similar(a, b)]
    while changed:
        changed = False
        for i, j in links:
            lo = min(comp[i], comp[j])
            if comp[i] != lo or comp[j] != lo:
                comp[i] = comp[j] = lo
                changed = True
    return comp, links


def test_stage_drops_texts_of_similarity_over_the_threshold(spark):
    """Copies with a few words changed differ in more than 2 bits of a fingerprint, and are near-duplicates."""
    rng = np.random.default_rng(8)
    vocab = np.array(["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)])
    rows = [(900, None), (901, ""), (902, "one two"), (903, "ONE two"), (904, "one two three")]
    for d in range(60):
        words = rng.choice(vocab, int(rng.integers(60, 400)))
        rows.append((d, " ".join(words)))
        for c, share in ((100, 0.01), (200, 0.015), (300, 0.05)):
            own = words.copy()
            at = rng.random(len(own)) < share
            own[at] = rng.choice(vocab, int(at.sum()))
            rows.append((d + c, " ".join(own)))
    comp, links = brute_components(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in S.similar_components(docs).collect()}
    assert len(links) > 60 and got == comp
    kept = {r.doc_id for r in C.near_duplicates(spark, docs, "").collect()}
    assert kept == {i for i, c in comp.items() if i == c}


def test_chains_and_unlike_members_of_one_bucket(spark):
    """Links that do not touch a bucket's first node count as well."""
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(words[i * 12 : i * 12 + 150])) for i in range(12)] + [(50 + i, " ".join([*words[:150], *(f"t{i}_{j}" for j in range(4 * i))])) for i in range(14)]
    comp, _ = brute_components(rows)
    assert {r.doc_id: r.component_id for r in S.similar_components(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()} == comp


def test_edge_tables(spark):
    schema = "doc_id bigint, text string"
    assert S.similar_components(spark.createDataFrame([], schema)).count() == 0
    odd = spark.createDataFrame([(None, None), (None, "a b c"), (1, "a b c"), (1, "a b c")], schema)
    got = sorted(r.doc_id or -1 for r in S.similar_components(odd).where("component_id = 1").collect())
    assert got == [-1, 1, 1] and S.keep_one_of_each(odd).count() == 4


def test_all_pairs_of_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    comp, _ = brute_components([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: r.component_id for r in S.similar_components(docs).collect()} == comp
