"""Exact removal of repeated word runs, found through difference-cover anchors.

Any run of ``window`` equal words in two places contains an anchor at the same offset
in both: anchors are short windows that start where ``position mod period`` is in a
difference cover, and any two residues are brought into the cover by one common shift
smaller than the period.  So only anchors are dealt out and counted.  Windows that hold
an anchor seen in another place are extended to their full length and grouped by a 96-bit
key of their words; the smallest document of each group keeps its first such window, which
the document itself then knows by 64 of these bits.
Groups are reduced by counts and minima alone, so a passage that a third of all
documents share costs one row per task after the map-side combine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlark.llm.ragged import hashes
from seasonlark.scratch import materialise, release

#: A perfect difference set: every residue mod PERIOD is a difference of two members.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Stands for a null id inside the job: it sorts first, as null does.
NO_ID = -(2**63)

_M1, _M2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_FIN = np.uint64(0xBF58476D1CE4E5B9)


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after another, and each text's number of words.

    Words are maximal runs of bytes other than space, tab, line feed, vertical tab, form feed, carriage return.
    """
    raw = np.frombuffer(b" ".join([*texts, b""]), np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    inside = ~_SPACE[raw]
    edge = np.diff(inside, prepend=False)
    first = np.flatnonzero(edge & inside)
    n = np.diff(np.searchsorted(first, ends), prepend=0)
    # the words' own bytes laid end to end
    kept = raw[inside]
    starts = np.cumsum(inside)[first] - 1
    return hashes(kept, starts, np.diff(starts, append=len(kept))), n


def rolling(h: np.ndarray, n: int, mult: np.uint64) -> np.ndarray:
    """Mixed polynomial hash of every n consecutive values."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for i in range(n):
        out *= mult
        out += h[i : i + m]
    out ^= out >> np.uint64(31)
    out *= _FIN
    return out ^ out >> np.uint64(29)


class Batch:
    """Word hashes of a batch of texts laid end to end; no text is cut."""

    def __init__(self, texts, window: int):
        self.window = window
        self.texts = [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]
        self.h, self.n = word_hashes(self.texts)
        self.first = np.concatenate([[0], np.cumsum(self.n)]).astype(np.int64)
        total = int(self.first[-1])
        self.doc = np.repeat(np.arange(len(self.n)), self.n)
        self.pos = np.arange(total) - self.first[self.doc]
        self.left = self.n[self.doc] - self.pos

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(place in the batch, hash) of each anchor of documents long enough to hold a window."""
        size = self.window - PERIOD + 1
        h = rolling(self.h, size, _M1)
        at = np.flatnonzero((self.left[: len(h)] >= size) & (self.n[self.doc[: len(h)]] >= self.window) & np.isin(self.pos[: len(h)] % PERIOD, COVER))
        return at, h[at]

    def candidates(self, shared: list) -> np.ndarray:
        """Places where windows start that hold an anchor which occurs elsewhere too.

        shared: for each text, the anchor hashes that other documents have as well.
        """
        at, h = self.anchors()
        if not len(at):
            return at
        doc = self.doc[at]
        order = np.lexsort((h, doc))
        again = np.zeros(len(at), bool)
        same = (doc[order][1:] == doc[order][:-1]) & (h[order][1:] == h[order][:-1])
        again[order[1:]] = same
        again[order[:-1]] |= same
        cuts = np.searchsorted(doc, np.arange(len(self.n) + 1))
        for i, s in enumerate(shared):
            if s is not None and len(s) and cuts[i] < cuts[i + 1]:
                part = slice(cuts[i], cuts[i + 1])
                again[part] |= np.isin(h[part], np.asarray(s, np.int64).view(np.uint64))
        near = np.zeros(len(self.h) + 1, np.int64)
        hits = at[again]
        np.add.at(near, np.maximum(hits - (PERIOD - 1), self.first[self.doc[hits]]), 1)
        np.add.at(near, hits + 1, -1)
        return np.flatnonzero((np.cumsum(near)[:-1] > 0) & (self.left >= self.window))

    def keys(self, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """96-bit keys of the windows at the given places."""
        k2 = rolling(self.h ^ self.h >> np.uint64(17), self.window, _M2)[starts] >> np.uint64(32)
        return rolling(self.h, self.window, _M1)[starts].view(np.int64), k2.astype(np.int64)

    def first_in_doc(self, starts: np.ndarray, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Whether each start is the first of its key in its own document."""
        order = np.lexsort((starts, k2, k1, self.doc[starts]))
        d, a, b = self.doc[starts][order], k1[order], k2[order]
        out = np.ones(len(starts), bool)
        out[order[1:]] = (d[1:] != d[:-1]) | (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        return out


def _split(frames: Iterator[pd.DataFrame], chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Cut frames so that each holds about ``chars`` characters of text, or a single text."""
    for f in frames:
        size = f["text"].str.len().fillna(0).cumsum().to_numpy()
        part = (size // chars).astype(int)
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(f)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield f.iloc[a:b]


def shared_anchors(docs: DataFrame, window: int = 20) -> DataFrame:
    """``(k, r, shared)``: for each document key, the hashes of its anchors that another document has as well."""

    def emit(frames):
        seen: set[int] = set()
        for f in _split(frames):
            # of rows without an id, a task names each text once
            blank = (f["k"] == NO_ID).to_numpy()
            again = blank & (f["r"].duplicated() | f["r"].isin(seen)).to_numpy()
            seen.update(f["r"].to_numpy()[blank].tolist())
            f = f[~again]
            b = Batch(f["text"], window)
            at, h = b.anchors()
            doc = b.doc[at]
            order = np.lexsort((h, doc))
            doc, h = doc[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            doc = doc[new]
            yield pd.DataFrame({"h": h[new].view(np.int64), "k": f["k"].to_numpy(np.int64)[doc], "r": f["r"].to_numpy(np.int64)[doc]})

    rows = docs.select("k", "r", "text").mapInPandas(emit, "h bigint, k bigint, r bigint")
    common = rows.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    # dealt as plain rows, which are smaller than one-element sets combined before
    return rows.join(common, "h").select("k", "r", "h").repartition("k", "r").groupBy("k", "r").agg(F.collect_set("h").alias("shared"))


def dedup_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = 20, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove from each text the words covered by a window that also starts earlier.

    Returns ``(doc_id, n_words, n_removed, kept, *carry)``: one row per input row; ``kept`` has
    the words that stay, joined by one space; the columns named in ``carry`` come along.  A null text has no words.  Ids order the
    documents, null first; rows that share an id stand at the same place, so none of them
    loses words to another.  Texts shorter
    than the window stay as they are.  An empty table gives no rows; other columns are ignored.
    """
    if window < PERIOD + 2:
        raise ValueError(f"window must be at least {PERIOD + 2} words")
    key, words = F.coalesce(F.col(doc_id).cast("bigint"), F.lit(NO_ID)).alias("k"), F.col(text).alias("text")
    # rows without an id are told apart by their texts
    part = F.when(F.col(doc_id).isNull(), F.xxhash64(F.col(text))).otherwise(F.lit(0)).alias("r")
    shared = materialise(shared_anchors(docs.select(key, part, words), window), "anchors")
    release(docs.sparkSession)
    own = {f"carry{i}": F.col(c) for i, c in enumerate(carry)}
    base = docs.select(key, part, words, *[c.alias(n) for n, c in own.items()])
    marked = base.join(shared, ["k", "r"], "left")
    carried = list(own)
    types = {n: f.dataType.simpleString() for n, f in zip(own, (docs.select(*carry).schema if carry else []), strict=True)}

    def windows(frames):
        for f in _split(frames):
            b = Batch(f["text"], window)
            at = b.candidates(list(f["shared"]))
            k1, k2 = b.keys(at)
            own = b.first_in_doc(at, k1, k2)
            at, k1, k2 = at[own], k1[own], k2[own]
            yield pd.DataFrame({"k1": k1, "k2": k2, "k": f["k"].to_numpy(np.int64)[b.doc[at]]})

    rows = marked.mapInPandas(windows, "k1 bigint, k2 bigint, k bigint")
    earliest = rows.groupBy("k1", "k2").agg(F.min("k").alias("k"))
    # no row comes before those without an id, so these lose none of their windows to others
    others = earliest.where(F.col("k") != NO_ID).select("k", F.when(F.col("k") == NO_ID, F.col("k")).otherwise(F.lit(0)).alias("r"), "k1")
    firsts = others.repartition("k", "r").groupBy("k", "r").agg(F.collect_list("k1").alias("firsts"))

    def strip(frames):
        for f in _split(frames):
            b = Batch(f["text"], window)
            at = b.candidates(list(f["shared"]))
            k1, k2 = b.keys(at)
            cuts = np.searchsorted(b.doc[at], np.arange(len(b.n) + 1))
            again = ~b.first_in_doc(at, k1, k2)
            for i, (k, s) in enumerate(zip(f["k"].tolist(), f["firsts"], strict=True)):
                if cuts[i] < cuts[i + 1] and k != NO_ID:
                    part = slice(cuts[i], cuts[i + 1])
                    again[part] |= ~np.isin(k1[part], np.asarray([] if s is None else s, np.int64))
            hits = at[again]
            cover = np.zeros(len(b.h) + 1, np.int64)
            np.add.at(cover, hits, 1)
            np.add.at(cover, hits + window, -1)
            gone = np.cumsum(cover)[:-1] > 0
            kept, removed = [], []
            for i, t in enumerate(b.texts):
                g, ws = gone[b.first[i] : b.first[i + 1]], t.split()
                removed.append(int(g.sum()))
                kept.append(b" ".join([w for w, x in zip(ws, g.tolist(), strict=True) if not x] if removed[-1] else ws).decode("utf-8", "surrogatepass"))
            out = pd.DataFrame({"k": f["k"].to_numpy(np.int64), "n_words": b.n, "n_removed": np.array(removed, np.int64), "kept": kept})
            for c in carried:
                out[c] = f[c].to_numpy()
            yield out

    schema = "k bigint, n_words bigint, n_removed bigint, kept string" + "".join(f", {n} {t}" for n, t in types.items())
    out = marked.join(firsts, ["k", "r"], "left").mapInPandas(strip, schema)
    return out.select(F.nullif("k", F.lit(NO_ID)).alias("doc_id"), "n_words", "n_removed", "kept", *[F.col(n).alias(c) for n, c in zip(own, carry, strict=True)])


def op6_substring_cover(spark, sf_dir: str) -> DataFrame:
    """Words kept of every document, as a digest."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


#: DuckDB: windows as joined words; practical on small tables only.
OP6_SQL = r"""
WITH w AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents)
), g AS (
  SELECT doc_id, pos, string_agg(w, ' ') OVER x AS key, count(*) OVER x AS n
  FROM w WINDOW x AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), r AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY key ORDER BY doc_id, pos) AS rank FROM g WHERE n = 20
), c AS (
  SELECT w.doc_id, w.pos, w.w, coalesce(max(CASE WHEN r.rank > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY w.doc_id ORDER BY w.pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) AS gone
  FROM w LEFT JOIN r ON r.doc_id = w.doc_id AND r.pos = w.pos
), k AS (
  SELECT doc_id, count(*) AS n_words, sum(gone) AS n_removed, string_agg(w, ' ' ORDER BY pos) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(k.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(k.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k ON k.doc_id = d.doc_id
"""
