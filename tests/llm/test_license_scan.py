import re

import pytest

from seasonlark.llm import license_scan as S

SCHEMA = "doc_id bigint, text string, family string, paragraph int, confirmed string"


@pytest.fixture(scope="module")
def model(spark):
    return S.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_families_and_unknown(model):
    for family, ts in S.TEMPLATES.items():
        for t in ts:
            got = model.predict([f"See here. {t} Thanks to all of you."])[0]
            assert got[0] == family and got[2] >= S.CONFIRM_SHARE, (t, got)
    for t in ["the cat sat on the mat under the table", "", "use this file and copy the source of this work", "version 2 of the software is free to use in all forms", "public domain of the law"]:
        name, _, share = model.predict([t])[0]
        assert name == "unknown" or share < S.CONFIRM_SHARE, (t, name, share)


def test_query_finds_every_notice(spark):
    sf = "/root/testdata/sf0.1"
    want = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC", "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0", "Released under the MIT License.": "MIT"}
    truth = {(r.doc_id, i): f for r in spark.read.parquet(f"{sf}/documents.parquet").collect() for i, line in enumerate(r.text.split("\n")) for t, f in want.items() if t in line}
    got = {(r.doc_id, r.paragraph): r.family for r in S.op8_license_scan(spark, sf).where("confirmed").collect()}
    assert truth.items() <= got.items()
    extra = {k: v for k, v in got.items() if k not in truth}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(re.search("licen|copyright|rights|permi", texts[d].split("\n")[i], re.I) for d, i in extra)


def test_odd_rows(spark, model):
    note = "x\nReleased under the MIT License.\n"
    docs = spark.createDataFrame([(None, note, "f", 1, "c"), (1, note, None, None, None), (1, note, "f", 1, "c"), (2, None, "f", 1, "c"), (3, "", "f", 1, "c"), (4, "w " * 50000, "f", 1, "c")], SCHEMA)
    out = S.scan(docs, model=model).collect()
    assert sorted((r.doc_id or 0, r.paragraph, r.family, r.confirmed) for r in out) == [(0, 1, "MIT", True), (1, 1, "MIT", True), (1, 1, "MIT", True)]
    assert S.scan(docs.limit(0)).count() == 0


def test_wrapped_notices_are_confirmed(spark):
    """Notices wrapped at 80 columns, the usual form of a licence, and ordinary texts wrapped alike."""
    import textwrap

    prose = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id < 60").collect()]
    rows, want = [], {}
    for k, (family, ts) in enumerate(S.TEMPLATES.items()):
        for v, t in enumerate(ts):
            if len(t.split()) > 14:
                i = 100 * k + v
                rows.append((i, "\n".join([prose[k][:200], "", *textwrap.wrap(t, 80), "", prose[k + 20][:200]])))
                want[i] = family
    rows += [(10_000 + i, "\n".join(textwrap.wrap(t, 80))) for i, t in enumerate(prose)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    out = S.scan(docs, model=S.train(spark.createDataFrame([(t,) for t in prose], "text string"))).where("confirmed").collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.family)
    assert len(want) > 5 and sum(want[i] in got.get(i, ()) for i in want) >= 0.9 * len(want)
    held = [i for i, t in rows if i >= 10_000 and any(len(x & S.pairs(t)) >= 0.6 * len(x) for ps in S.PAIRS.values() for x in ps)]
    assert {i for i in got if i >= 10_000} <= set(held)
