"""Steps that once cost most of the pipeline's time do less, with the same results."""

import numpy as np
import xxhash
from pyspark.sql import functions as F

from seasonlark.llm import docstats, similar_texts

TEXTS = [None, "", " \n\t", "a", "A b", "a b c d", "a b c d e", "A b C d e a b c d e", "é \x85 x　y z \x1c w É", "one two three four five six " * 9]


def brute(text, words=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))} if w else set()


def test_shingles_are_hashed_together(monkeypatch):
    calls = []
    keep = xxhash.xxh64_intdigest
    monkeypatch.setattr(xxhash, "xxh64_intdigest", lambda *a: (calls.append(1), keep(*a))[1])
    sets = [similar_texts.shingles(t) for t in TEXTS]
    assert not calls
    for a, x in zip(sets, TEXTS, strict=True):
        assert len(a) == len(brute(x)) and (np.diff(a.astype(object)) > 0).all()
        for b, y in zip(sets, TEXTS, strict=True):
            assert len(np.intersect1d(a, b)) == len(brute(x) & brute(y))


def test_long_texts_are_hashed_apart(monkeypatch):
    want = [similar_texts.shingles(t) for t in TEXTS]
    monkeypatch.setattr(similar_texts, "HASHED_BYTES", 5)
    assert all((a == b).all() for a, b in zip(similar_texts.shingle_sets(TEXTS), want, strict=True))


def test_classes_are_counted_in_what_letters_leave(spark):
    odd = ["ÀÉ é ß ǅ ʰ 日本 ١٢ 12 ½ Ⅷ | || <a> #*$%&", " \t\r\n\x0b\x0c ", "the THE der la the", None]
    df = docstats.with_stats(spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "doc_id int, text string"))
    plan = df.select("chars", "n_pipes")._jdf.queryExecution().optimizedPlan().toString()
    assert r"\p{Nd}" in plan and "__rest" in plan.split(r"\p{Nd}")[0].rsplit("regexp_replace", 1)[1]
    got = df.withColumn("total", F.aggregate("commons", F.lit(0).cast("bigint"), lambda a, x: a + x)).orderBy("doc_id").collect()
    for t, r in zip(odd, got, strict=True):
        t = t or ""
        upper = sum(c in "ÀÉTHE" for c in t)
        letters, digits = sum(c.isalpha() for c in t), sum(c.isdecimal() for c in t)
        space, signs = sum(c in " \t\n\r\x0b\x0c" for c in t), sum(c in "#*$%&|<>" for c in t)
        assert r.chars == [upper, letters - upper, digits, space, signs, len(t) - letters - digits - space - signs]
        assert r.n_pipes == t.count("|") and r.n_common == r.total
