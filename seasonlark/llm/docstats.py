"""Statistics of whole texts as column expressions; nothing here leaves the JVM.

Words are maximal runs of characters other than space and U+0009 to U+000D.  Arrays stay
inside one row, so no step of this module shuffles.  A null text counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOLS = r"[#*$%&|<>]"
#: Frequent function words of each language.
COMMON = {
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "with", "as", "was", "on", "be", "by", "this", "are", "from", "or"],
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "au", "plus", "pas"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "del", "se", "las", "por", "un", "para", "con", "no", "una", "su", "al", "es"],
}
ALL_COMMON = sorted({w for ws in COMMON.values() for w in ws})
#: Character classes, in the order of the ``chars`` histogram.
CLASSES = ["upper", "letter", "digit", "space", "symbol", "other"]


def _removed(text: Column, pattern: str) -> Column:
    """Code points of ``text`` that the pattern matches."""
    return (F.length(text) - F.length(F.regexp_replace(text, pattern + "+", ""))).cast("bigint")


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)


def with_stats(docs: DataFrame, text: str = "text", repeat_window: int = 3) -> DataFrame:
    """Replace the text by its statistics.

    Adds n_chars_all, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words,
    n_distinct_words, n_pipes, chars (histogram over CLASSES), commons (counts of
    ALL_COMMON, lower-case forms) and n_common (their sum).  Columns of ``docs`` with these names are replaced.
    Word windows are compared by 64-bit hashes within one text.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    step = docs.withColumn("__t", t).drop(text)
    step = step.withColumn("__words", F.array_remove(F.split("__t", SPACE + "+"), ""))
    k = repeat_window
    spots = F.when(F.size("__words") >= k, F.sequence(F.lit(0), F.size("__words") - k)).otherwise(F.array().cast("array<int>"))
    grams = F.transform(spots, lambda i: F.struct(F.xxhash64(*[F.get("__words", i + j) for j in range(k)]).alias("h"), i.alias("i")))
    lines = F.filter(F.split("__t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    step = (
        step.withColumn("__grams", F.sort_array(grams))
        .withColumn("__hits", F.filter("__words", lambda w: w.isin(ALL_COMMON)))
        .withColumn("__lines", lines)
    )
    seen = F.filter(
        "__grams",
        lambda g, j: (g["h"] == F.get("__grams", j - 1)["h"]) | (g["h"] == F.get("__grams", j + 1)["h"]),
    )
    step = step.withColumn("__at", F.sort_array(F.transform(seen, lambda g: g["i"])))
    covered = F.transform("__at", lambda p, j: F.least(F.lit(k), F.coalesce(F.get("__at", j + 1) - p, F.lit(k))).cast("bigint"))
    # letters and space are most of a text, so the other classes are counted in what these leave
    step = step.withColumn("__signs", F.regexp_replace("__t", r"\p{L}+", "")).withColumn("__rest", F.regexp_replace("__signs", SPACE + "+", ""))
    step = step.withColumns(
        {
            "n_chars_all": F.length("__t").cast("bigint"),
            "n_words": F.size("__words").cast("bigint"),
            "n_distinct_words": F.size(F.array_distinct("__words")).cast("bigint"),
            "__space": (F.length("__signs") - F.length("__rest")).cast("bigint"),
            "n_symbols": _removed(F.col("__rest"), SYMBOLS),
            "n_pipes": _removed(F.col("__rest"), r"\|"),
            "__upper": _removed(F.col("__t"), r"\p{Lu}"),
            "__letters": (F.length("__t") - F.length("__signs")).cast("bigint"),
            "__digits": _removed(F.col("__rest"), r"\p{Nd}"),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "n_repeat_words": _total(covered),
            "n_common": F.size("__hits").cast("bigint"),
            "commons": F.array(*[(F.size("__hits") - F.size(F.array_remove("__hits", w))).cast("bigint") for w in ALL_COMMON]),
        }
    )
    step = step.withColumn("word_chars", F.col("n_chars_all") - F.col("__space"))
    rest = F.col("n_chars_all") - F.col("__letters") - F.col("__digits") - F.col("__space") - F.col("n_symbols")
    step = step.withColumn("chars", F.array(F.col("__upper"), F.col("__letters") - F.col("__upper"), F.col("__digits"), F.col("__space"), F.col("n_symbols"), rest))
    return step.drop(*[c for c in step.columns if c.startswith("__")])
