"""Near-duplicates by exact similarity of their sets of word shingles.

Two texts are near-duplicates where the Jaccard similarity of their sets of five-word
shingles is at least 0.8.  SimHash anchors propose first: sets whose fingerprints differ in
at most two bits, which is what copies with few changes do, become one component at once.
Fingerprints cannot find the rest: pairs near the threshold differ in some 10 of 64 bits, often in
15, and within 15 bits of a field lies half the corpus.  Those candidates come from bands of
minimum hashes (a pair of similarity 0.8 shares one of ``BANDS`` with probability 0.9996).
Whatever proposes a pair, the shingles themselves decide.

Texts of equal shingle sets are one node.  In a bucket each component that the anchors left is
held against the largest one's first node; what that links is one component, and only members outside the
bucket's largest component are then held against all others.  No link that joins
components is left out, and a group of near copies costs what its members cost.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlark.graph import connected_components
from seasonlark.llm.simhash_anchors import fingerprint_links, fingerprint_of
from seasonlark.llm.substring_cover import rolling, word_hashes
from seasonlark.scratch import materialise

WORDS, LEAST = 5, 0.8
BANDS, ROWS = 20, 5
#: Sets whose fingerprints differ in at most so many bits are compared by the anchors' means.
ANCHOR_BITS = 2
STARS = 1
SEED = 42
#: Bytes of texts that are hashed at a time, at some 50 bytes of memory each; a longer text alone.
HASHED_BYTES = 250_000
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.random.default_rng(31).integers(1, 2**63, (2, BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: Iterable[str | None], words: int = WORDS) -> Iterator[np.ndarray]:
    """Each text's sorted distinct 64-bit hashes of its shingles; a text of fewer words is one shingle, one without words has none.

    Texts are hashed together, some ``HASHED_BYTES`` at a time.
    """
    raw, size = [], 0
    for t in texts:
        raw.append((t or "").encode("utf-8", "surrogatepass").lower())
        size += len(raw[-1])
        if size >= HASHED_BYTES:
            yield from _hashed(raw, words)
            raw, size = [], 0
    if raw:
        yield from _hashed(raw, words)


def _hashed(raw: list[bytes], words: int) -> Iterator[np.ndarray]:
    h, n = word_hashes(raw)
    grams = rolling(h, words, _M)
    ends = np.cumsum(n)
    for first, end in zip((ends - n).tolist(), ends.tolist(), strict=True):
        yield np.unique(grams[first : end - words + 1] if end - first >= words else rolling(h[first:end], end - first, _M) if end > first else grams[:0])


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """The same of one text."""
    return next(shingle_sets([text], words))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Share of two sorted distinct arrays' members that both have; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def band_keys(h: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band of minimum hashes; none for an empty set."""
    if not len(h):
        return []
    low = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(h), 256):
        x = h[i : i + 256, None] * _MIX[0]
        x += _MIX[1]
        np.minimum(low, x.min(axis=0), out=low)
    rows = (low >> np.uint64(32)).astype(np.uint32).reshape(BANDS, ROWS)
    return [int(np.uint64(xxhash.xxh64_intdigest(r.tobytes(), b)).astype(np.int64)) for b, r in enumerate(rows)]


def _mark(frames):
    for f in frames:
        hs = list(shingle_sets(f["text"]))
        out = f[["doc_id", "text"]].copy()
        out["doc_id"] = out["doc_id"].astype("Int64")
        out["key"] = np.array([xxhash.xxh64_intdigest(h.tobytes(), SEED) for h in hs], np.uint64).view(np.int64)
        out["fp"] = np.array([fingerprint_of(h) for h in hs], np.int64)
        out["n"] = [len(h) for h in hs]
        out["bands"] = [band_keys(h) for h in hs]
        yield out


def _links(pairs: DataFrame, marked: DataFrame, least: float) -> DataFrame:
    """Those of the pairs of nodes ``(a, b)`` whose texts are similar enough."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    texts = materialise(marked.select("key", "text").join(wanted, "key", "left_semi").dropDuplicates(["key"]), "texts")
    # texts are sized by their compressed files, so they could be broadcast at many times the threshold
    side = lambda x: texts.select(F.col("key").alias(x), F.col("text").alias(f"text_{x}")).hint("merge")
    both = pairs.join(side("a"), "a").join(side("b"), "b")

    def confirm(frames):
        for f in frames:
            texts = dict(zip(f["a"], f["text_a"], strict=True)) | dict(zip(f["b"], f["text_b"], strict=True))
            known = dict(zip(texts, shingle_sets(texts.values()), strict=True))
            keep = [jaccard(known[a], known[b]) >= least for a, b in zip(f["a"], f["b"], strict=True)]
            yield f.loc[keep, ["a", "b"]]

    return materialise(both.mapInPandas(confirm, "a bigint, b bigint"), "links")


def _pairs(members: DataFrame, others: DataFrame, least: float) -> DataFrame:
    """Distinct pairs of nodes in one bucket, of different components and of sizes that can be similar enough."""
    x = members.select("band", F.col("key").alias("x"), F.col("n").alias("nx"), F.col("component").alias("cx"))
    y = others.select("band", F.col("key").alias("y"), F.col("n").alias("ny"), F.col("component").alias("cy"))
    can = F.least("nx", "ny") >= least * F.greatest("nx", "ny")
    return x.join(y, "band").where((F.col("cx") != F.col("cy")) & can).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _anchored(nodes: DataFrame) -> DataFrame:
    """Pairs of nodes ``(a, b)`` whose fingerprints meet at an anchor; of equal fingerprints the first node meets the others."""
    first = nodes.groupBy("fp").agg(F.min("key").alias("rep"))
    near = fingerprint_links(first, ANCHOR_BITS)
    same = nodes.join(first, "fp").where("key <> rep").select(F.col("rep").alias("a"), F.col("key").alias("b"))
    return near.unionAll(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(links: DataFrame, comps: DataFrame | None = None) -> DataFrame:
    """``(key, component)`` of nodes that links join, with the components known before; these stand in for the links they came from."""
    if comps is not None:
        links = links.unionAll(comps.where("key <> component").select(F.col("component").alias("a"), F.col("key").alias("b")))
    return connected_components(links, "a", "b").withColumnRenamed("id", "key")


def _members(buckets: DataFrame, comps: DataFrame) -> DataFrame:
    """Rows of the buckets with their node's component so far, but those of buckets that are one component."""
    named = materialise(buckets.join(comps, "key", "left").withColumn("component", F.coalesce("component", "key")), "members")
    split = named.groupBy("band").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("band")
    return named.join(split, "band", "left_semi")


def similar_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """``(doc_id, component_id)`` per document; component_id is the smallest doc_id reachable over similar texts.

    Null and wordless texts are alike.  A row with a null id joins the component of its
    text (null if no member has an id); repeated rows stay; an empty table gives no rows.
    """
    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    marked = materialise(base.mapInPandas(_mark, "doc_id bigint, text string, key bigint, fp bigint, n bigint, bands array<bigint>"), "shingled")
    nodes = marked.groupBy("key").agg(F.first("n").alias("n"), F.first("bands").alias("bands"))
    buckets = nodes.select(F.explode("bands").alias("band"), "key", "n")
    full = buckets.groupBy("band").count().where("count > 1").select("band")
    buckets = materialise(buckets.join(full, "band", "left_semi"), "buckets")
    anchored = materialise(_anchored(marked.select("key", "fp").distinct()), "anchored")
    comps = _joined(_links(anchored, marked, least))
    members = _members(buckets, comps)
    for _ in range(STARS):
        sizes = members.groupBy("band", "component").agg(F.count("*").alias("size"), F.min(F.struct("key", "n")).alias("first"))
        # each component but the largest meets the first node of the largest
        heads = sizes.groupBy("band").agg(F.max(F.struct("size", "component", "first")).alias("top")).select("band", F.col("top.first.key").alias("key"), F.col("top.first.n").alias("n"), F.col("top.component").alias("component"))
        comps = _joined(_links(_pairs(members, heads, least), marked, least), comps)
        members = _members(buckets, comps)
    sizes = members.groupBy("band", "component").count()
    top = sizes.groupBy("band").agg(F.max(F.struct("count", "component")).alias("top")).select("band", F.col("top.component").alias("main"))
    rest = members.join(top, "band").where("component <> main").drop("main")
    comps = _joined(_links(_pairs(rest, members, least), marked, least), comps)
    named = marked.groupBy("key").agg(F.min("doc_id").alias("rep")).join(comps, "key", "left").withColumn("component", F.coalesce("component", "key"))
    least_id = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    ids = named.join(least_id, "component").select("key", "component_id")
    return marked.select("doc_id", "key").join(ids, "key").select("doc_id", "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` whose id names its component; rows without an id all stay, as do rows that repeat a survivor's id."""
    comps = similar_components(docs.where(F.col(doc_id).isNotNull()), doc_id, text, least)
    gone = comps.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("bigint") == F.col("__gone"), "left_anti")
