import numpy as np
import pytest
import xxhash

from seasonlark.llm import simhash_anchors as S

SCHEMA = "doc_id bigint, text string, fp int, anchor string, component string"


def brute_fp(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    grams = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))]
    hs = [xxhash.xxh64(g, seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(rows):
    fps = [(i, brute_fp(t)) for i, t in rows]
    comp = {i: i for i, _ in fps}
    changed = True
    while changed:
        changed = False
        for i, a in fps:
            for j, b in fps:
                if (a ^ b).bit_count() <= 2 and comp[j] < comp[i]:
                    comp[i], changed = comp[j], True
    return {i: (f"{f:016x}", comp[i]) for i, f in fps}


def test_golay_code_is_perfect():
    cosets = S._cosets(0)
    assert len(cosets) == 2048 and all((o == 0).sum() == 1 for _, o in cosets)


def test_every_close_pair_shares_an_anchor():
    rng = np.random.default_rng(1)
    x = rng.integers(-(2**63), 2**63 - 1, 300, dtype=np.int64)
    for bits in (0, 1, 2):
        y = x.copy()
        for _ in range(bits):
            y ^= np.left_shift(np.int64(1), rng.integers(0, 64, len(x)))
        for home, visits in zip(S.home_anchor(x), S.visited_anchors(y, 2), strict=True):
            assert home in visits


def test_components_match_brute_force(spark):
    base = "one two three four five six seven eight nine ten eleven twelve " * 40
    rows = [(7, base), (3, base), (9, base + "tail"), (4, None), (5, ""), (6, " \n"), (8, "ONE"), (2, "one"), (10, "é x one two"), (11, "w " * 5000)]
    rng = np.random.default_rng(3)
    vocab = [f"w{i}" for i in range(50)]
    for i in range(20, 60):
        words = [vocab[j] for j in rng.integers(0, 50, 300)]
        rows += [(i, " ".join(words)), (i + 100, " ".join([*words[:-1], "x"]))]
    out = S.near_duplicate_components(spark.createDataFrame([(*r, 1, "a", "c") for r in rows], SCHEMA)).collect()
    want = brute_components(rows)
    assert {r.doc_id: (f"{r.fp & (2**64 - 1):016x}", r.component_id) for r in out} == want
    assert any(c != i for i, (_, c) in want.items() if i >= 100)


def test_edge_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert S.near_duplicate_components(empty).count() == 0
    odd = spark.createDataFrame([(None, None, 1, None, None), (None, "a b c", 1, None, None), (1, "a b c", 2, "x", "y"), (1, "a b c", 2, "x", "y")], SCHEMA)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.component_id) for r in S.near_duplicate_components(odd).collect() if r.component_id is not None)
    assert got == [(-1, 1), (1, 1), (1, 1)]
    assert S.keep_one_of_each(odd).count() == 4


@pytest.mark.parametrize("table", ["sf0.001"])
def test_query_against_brute_force(spark, table):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"/root/testdata/{table}/documents.parquet").collect()]
    out = S.op5_simhash_anchors(spark, f"/root/testdata/{table}").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in out} == brute_components(rows)
