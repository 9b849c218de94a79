import math
import re
from collections import Counter

from seasonlark.llm import divergence_rules as D
from seasonlark.llm.docstats import ALL_COMMON, COMMON

SCHEMA = "doc_id bigint, text string, lang string, n_words int, chars string, h int, kept string"


def base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    hit = [False] * len(words)
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            hit[i : i + 3] = [True] * 3
    seen, dups = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dups += line in seen
            seen.add(line)
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, sum(hit), n < 50 or 100 * sum(hit) > 50 * n


def test_base_counts(spark):
    texts = [None, "", " \n\t", "a b c a b c a b c", "x\ny\nx\n\n \n \nx", "é|ü <a> 𝔘𝔘 b", "a b c d\n" * 40, "w " * 3000, " ".join(f"w{i}" for i in range(60)), "a\x0bb\x0cc\x1cd\xa0e f g"]
    rows = [(i, t, "en", 1, "c", 2, "k") for i, t in enumerate(texts)] + [(None, texts[5], None, 1, "c", 2, "k"), (5, texts[5], "xx", 1, "c", 2, "k")]
    out = D.quality_rules(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(out) == len(rows)
    for r in out:
        text = texts[5 if r.doc_id is None else r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text)
        assert not (r.base_failed and r.kept)
    assert D.quality_rules(spark.createDataFrame([], SCHEMA)).count() == 0


def distance(p, q):
    t = sum(p)
    p = [x / t for x in p]
    kl = lambda a: sum(x * math.log2(x / ((x + y) / 2)) for x, y in a if x > 0)
    return math.sqrt(max(0, (kl(list(zip(p, q))) + kl(list(zip(q, p)))) / 2))


def test_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}

    def hists(text):
        words = Counter(re.findall(r"[^\x20\x09-\x0D]+", text))
        up = sum(c.isupper() for c in text)
        letters, digits = sum(c.isalpha() for c in text), sum(c.isdecimal() for c in text)
        space, sym = len(re.findall(r"[\x20\x09-\x0D]", text)), len(re.findall(r"[#*$%&|<>]", text))
        return [up, letters - up, digits, space, sym, len(text) - letters - digits - space - sym], words

    refs = {}
    for lang in COMMON:
        own = [hists(d.text) for d in docs.values() if d.lang == lang and not base(d.text)[-1]]
        if own:
            chars = [sum(c[i] / sum(c) for c, _ in own) / len(own) for i in range(6)]
            words = [sum(w[x] / sum(w.values()) for _, w in own) / len(own) for x in COMMON[lang]]
            refs[lang] = (chars, [*words, max(0, 1 - sum(words))])
    verdicts = Counter()
    for r in D.op3_divergence_rules(spark, sf).collect():
        b = base(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == b
        kept = not b[-1]
        if kept:
            c, w = hists(docs[r.doc_id].text)
            char = min(distance(c, q[0]) for q in refs.values())
            word = min(distance([*(w[x] for x in COMMON[lg]), b[0] - sum(w[x] for x in COMMON[lg])], q[1]) for lg, q in refs.items())
            kept = not (char > D.MAX_CHAR_DISTANCE or char > D.DOUBTFUL_CHAR_DISTANCE and word > D.MAX_WORD_DISTANCE)
        assert r.kept == kept
        verdicts[r.base_failed, r.kept] += 1
    assert len(verdicts) == 3 and set(ALL_COMMON) >= set(COMMON["en"])


def test_clean_texts_are_kept_and_junk_is_not(spark):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = D.op3_divergence_rules(spark, sf).join(labels, "doc_id").where("not base_failed").collect()
    good, bad = [r.kept for r in rows if r.quality == 1], [r.kept for r in rows if r.quality == 0]
    assert all(good) and sum(bad) <= 0.15 * len(bad)


def test_plan_has_no_python(spark):
    plan = D.op3_divergence_rules(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
