import hashlib
import re

import pytest
import sentencepiece

import corpus_pipeline as C
from seasonlark.llm import piece_lattice, rule_ensemble
from test_similar_texts import brute_components
from test_substring_cover import brute


@pytest.fixture(scope="module")
def steps(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in C.STAGES:
        df = stage(spark, out[-1], sf)
        assert name == C.STAGES[-1][0] or df.columns == docs.columns
        out.append(spark.createDataFrame(df.collect(), df.schema))
    return [{r.doc_id: r for r in d.collect()} for d in out]


def test_quality(spark, steps):
    before, after = steps[0], steps[1]
    sf = "/root/testdata/sf0.001"
    bad = {r.doc_id for r in rule_ensemble.op1_rule_ensemble(spark, sf).where("predicted = 0").collect()}
    assert after == {i: r for i, r in before.items() if i not in bad} and bad


def test_near_duplicates(steps):
    comps, links = brute_components([(i, r.text) for i, r in steps[1].items()])
    assert set(steps[2]) == {i for i, c in comps.items() if i == c} and links


def test_repeated_runs(steps):
    want = brute([(i, r.text) for i, r in steps[2].items()])
    for i, r in steps[3].items():
        assert r.text == (want[i][2] if want[i][1] else steps[2][i].text) and r.n_chars == len(r.text)
    assert set(steps[3]) == set(steps[2]) and any(w[1] for w in want.values())


def test_decontamination(spark, steps):
    norm = lambda t: f" {' '.join(re.findall(r'\w+', t.lower()))} "
    items = [norm(r.text) for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").collect()]
    exact = {i for i, r in steps[3].items() if any(x in norm(r.text) for x in items)}
    gone = set(steps[3]) - set(steps[4])
    assert exact <= gone and len(gone - exact) <= 2


def test_tokens(steps):
    sp = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.model_path())
    assert set(steps[5]) == set(steps[4])
    for i, r in steps[5].items():
        assert r.ids == sp.encode(steps[4][i].text) and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(steps[4][i].text.encode()).hexdigest()


def test_run(spark, steps):
    assert {r.doc_id: r.n_tokens for r in C.run(spark, "/root/testdata/sf0.001").collect()} == {i: r.n_tokens for i, r in steps[5].items()}


ODD = [
    (None, None, "en", "web", 0, "x"),
    (None, "", "en", None, None, "x"),
    (3, None, None, "web", 0, "x"),
    (4, "", "en", "web", 0, "x"),
    (5, "one two three " * 4000, "en", "web", 56000, "x"),
    (5, "one two three " * 4000, "en", "web", 56000, "x"),
    (6, "é 日本 ▁ <|endoftext|> \x00 " * 30, "fr", "web", 600, None),
]


@pytest.mark.parametrize("name, stage", C.STAGES)
def test_stages_take_odd_rows(spark, name, stage):
    """Nulls in any column, empty and long texts, repeated rows, no rows, and columns named like the operators' own."""
    sf = "/root/testdata/sf0.001"
    rows = spark.createDataFrame(ODD, "doc_id bigint, text string, lang string, source string, n_chars bigint, key string")
    out = stage(spark, rows, sf)
    last = name == C.STAGES[-1][0]
    assert last or out.columns == rows.columns
    got = out.collect()
    assert len(got) <= len(ODD) and {r.doc_id for r in got} <= {None, 3, 4, 5, 6}
    if last:
        sp = sentencepiece.SentencePieceProcessor(model_file=piece_lattice.model_path())
        assert sorted(len(r.ids) for r in got) == sorted(len(sp.encode(r[1] or "")) for r in ODD)
    assert stage(spark, rows.limit(0), sf).count() == 0
