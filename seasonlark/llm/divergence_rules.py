"""Quality rules from distribution divergence, in SQL expressions only.

A text's histogram of character classes and its histogram of common words are compared
with references by Jensen-Shannon distance.  The references are the pooled histograms of
all texts of a language that pass the base rules, so they follow the corpus.  Texts below
the minimum length fail the base rules and are not judged by distance, since a short
histogram is far from anything by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seasonlark.llm.docstats import ALL_COMMON, COMMON, with_stats
from seasonlark.scratch import materialise

MIN_WORDS = 50
#: A text is far from every language if its characters are, or if they are doubtful and its words are far too.
MAX_CHAR_DISTANCE = 0.25
DOUBTFUL_CHAR_DISTANCE = 0.12
MAX_WORD_DISTANCE = 0.285


def base_failed() -> Column:
    """Too few words, or more than half of them in word windows that repeat."""
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def js_distance(counts: list[Column], reference: list[float]) -> Column:
    """Jensen-Shannon distance (base 2, 0 to 1) of counts to reference shares; null if the counts sum to 0."""
    total = sum(counts[1:], counts[0]).cast("double")
    terms = []
    for c, q in zip(counts, reference, strict=True):
        p = c / F.nullif(total, F.lit(0.0))
        m = (p + q) / 2
        terms.append(F.when(p > 0, p * F.log2(p / m)).otherwise(F.when(p.isNull(), F.lit(None)).otherwise(0.0)))
        if q > 0:
            terms.append(q * F.log2(q / m))
    return F.sqrt(F.greatest(sum(terms[1:], terms[0]) / 2, F.lit(0.0)))


def _bins(lang: str) -> list[Column]:
    """Counts of a language's common words, then of all its other words."""
    own = [F.get("commons", F.lit(ALL_COMMON.index(w))) for w in COMMON[lang]]
    return [*own, F.col("n_words") - sum(own[1:], own[0])]


def references(stats: DataFrame, lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """For each known language, shares of character classes and of common words over all its texts that pass the base rules.

    One grouped sum; the result has at most one row per language of COMMON.
    """
    rows = stats.where(~base_failed() & F.col(lang).isin(list(COMMON)))
    sums = [F.sum(F.get("chars", F.lit(i)) / F.col("n_chars_all")).alias(f"c{i}") for i in range(6)]
    sums += [F.sum(F.get("commons", F.lit(i)) / F.col("n_words")).alias(f"w{i}") for i in range(len(ALL_COMMON))]
    out = {}
    for r in rows.groupBy(lang).agg(F.count("*").alias("n"), *sums).collect():
        n, name = r["n"], r[lang]
        words = [r[f"w{ALL_COMMON.index(w)}"] / n for w in COMMON[name]]
        out[name] = {"chars": [r[f"c{i}"] / n for i in range(6)], "words": [*words, max(0.0, 1 - sum(words))]}
    return out


def judge(
    stats: DataFrame, refs: dict, max_char: float = MAX_CHAR_DISTANCE, doubtful_char: float = DOUBTFUL_CHAR_DISTANCE, max_word: float = MAX_WORD_DISTANCE
) -> DataFrame:
    """Add base_failed, char_distance, word_distance (each to the nearest language) and kept.

    A text may be in a language other than its label or in several, so the nearest
    reference counts.  Without any reference only the base rules decide.
    """
    chars = [F.get("chars", F.lit(i)) for i in range(6)]
    near = lambda cols: F.least(*cols) if len(cols) > 1 else (cols[0] if cols else F.lit(None).cast("double"))
    out = stats.withColumns(
        {
            "base_failed": base_failed(),
            "char_distance": near([js_distance(chars, r["chars"]) for r in refs.values()]),
            "word_distance": near([js_distance(_bins(lang), r["words"]) for lang, r in refs.items()]),
        }
    )
    far = (F.col("char_distance") > max_char) | (F.col("char_distance") > doubtful_char) & (F.col("word_distance") > max_word)
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality_rules(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, char_distance, word_distance)``.

    One row per input row, repeated rows and null ids included; null and empty texts have no
    words and fail the base rules; a null or unknown language is judged like any other.
    An empty table gives no rows; other columns are ignored.
    """
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    stats = materialise(with_stats(base).select("doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_all", "chars", "commons"), "stats")
    out = judge(stats, references(stats))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")


def op3_divergence_rules(spark, sf_dir: str) -> DataFrame:
    """Base counts and verdict of every document."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
