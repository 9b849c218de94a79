"""SimHash near-duplicates by anchor-point covering.

Each text gets a 64-bit fingerprint.  Two 23-bit fields of it are covered by the
perfect binary Golay code: every 23-bit value lies within three bits of exactly one
codeword.  A fingerprint's *home* is the pair of its two nearest codewords; it also
visits every pair of codewords whose distances exceed the covering radius by at most
the threshold in sum.  If two fingerprints differ in at most ``max_bits`` bits, the one
visits the home of the other, so an equi-join of homes and visits meets every link,
and each link once.  Equal fingerprints are one node; links join nodes, never copies.
"""

from __future__ import annotations

from functools import cache
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seasonlark.graph import connected_components
from seasonlark.scratch import materialise

RADIUS, FIELD = 3, 23
#: Generator polynomial of the binary Golay code [23, 12, 7].
GOLAY = 0b110001110101
SHINGLE_SEED = 42


def _syndromes(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials modulo the generator."""
    x = x.astype(np.int64).copy()
    for bit in range(FIELD - 1, FIELD - 13, -1):
        x ^= np.where(x >> bit & 1, GOLAY << (bit - 11), 0)
    return x


@cache
def _cosets(extra: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each syndrome, the error patterns of weight up to RADIUS + extra and what each has above RADIUS."""
    pats = np.array([sum(1 << i for i in c) for w in range(RADIUS + extra + 1) for c in combinations(range(FIELD), w)], np.int64)
    over = np.array([max(0, int(p).bit_count() - RADIUS) for p in pats], np.int64)
    syn = _syndromes(pats)
    order = np.argsort(syn, kind="stable")
    cuts = np.searchsorted(syn[order], np.arange(1, 1 << 11))
    return list(zip(np.split(pats[order], cuts), np.split(over[order], cuts), strict=True))


@cache
def _nearest() -> np.ndarray:
    return np.array([p[o == 0][0] for p, o in _cosets(0)], np.int64)


def _fields(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = (1 << FIELD) - 1
    return fp & mask, fp >> FIELD & mask


def home_anchor(fp: np.ndarray) -> np.ndarray:
    """The one anchor within the covering radius of each fingerprint (int64)."""
    a, b = _fields(fp)
    near = _nearest()
    return (a ^ near[_syndromes(a)]) | (b ^ near[_syndromes(b)]) << FIELD


def visited_anchors(fp: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """All anchors within covering radius plus threshold of each fingerprint, its home among them."""
    a, b = _fields(fp)
    cosets = _cosets(max_bits)
    out = []
    for x, y, s, t in zip(a.tolist(), b.tolist(), _syndromes(a).tolist(), _syndromes(b).tolist(), strict=True):
        (p, op), (q, oq) = cosets[s], cosets[t]
        i, j = np.nonzero(op[:, None] + oq[None, :] <= max_bits)
        out.append((x ^ p[i]) | (y ^ q[j]) << FIELD)
    return out


def text_fingerprint(text: str | None, words: int = 3) -> int:
    """Signed 64-bit SimHash of one text; 0 for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return 0
    grams = [b" ".join(w)] if len(w) < words else list(map(b" ".join, zip(*(w[i:] for i in range(words)), strict=False)))
    digest = xxhash.xxh64_intdigest
    return fingerprint_of(np.fromiter((digest(g, SHINGLE_SEED) for g in grams), np.uint64, len(grams)))


def fingerprint_of(h: np.ndarray) -> int:
    """Signed 64-bit number of the bits that over half of the hashes set; 0 without hashes."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(h), 4096):
        votes += np.unpackbits(h[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * votes > len(h), bitorder="little").view(np.int64)[0])


def with_fingerprint(docs: DataFrame, text: str, words: int = 3, out: str = "fp") -> DataFrame:
    """Add the fingerprint (bigint) of a text column; null and wordless texts get 0."""

    @F.pandas_udf(T.LongType())
    def fingerprint(texts: pd.Series) -> pd.Series:
        return pd.Series([text_fingerprint(x, words) for x in texts], dtype="int64")

    return docs.withColumn(out, fingerprint(F.col(text)))


def fingerprint_links(nodes: DataFrame, max_bits: int = 2) -> DataFrame:
    """Links ``(a, b)`` between ``rep`` values of distinct fingerprints ``(fp, rep)`` that differ in at most ``max_bits`` bits."""

    @F.pandas_udf(T.LongType())
    def home(fp: pd.Series) -> pd.Series:
        return pd.Series(home_anchor(fp.to_numpy(np.int64)))

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def visits(fp: pd.Series) -> pd.Series:
        return pd.Series(visited_anchors(fp.to_numpy(np.int64), max_bits), dtype=object)

    homes = nodes.select(home("fp").alias("anchor"), F.col("fp").alias("fp_a"), F.col("rep").alias("a"))
    visitors = nodes.select(F.explode(visits("fp")).alias("anchor"), F.col("fp").alias("fp_b"), F.col("rep").alias("b"))
    near = F.bit_count(F.col("fp_a").bitwiseXOR(F.col("fp_b"))) <= max_bits
    # Spark sizes an explode as its input, so the visits, hundreds a fingerprint, would be broadcast
    return homes.join(visitors.hint("merge"), "anchor").where((F.col("fp_a") < F.col("fp_b")) & near).select("a", "b")


def near_duplicate_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """``(doc_id, fp, component_id)`` per document; component_id is the smallest doc_id reachable over links.

    Null and wordless texts have fingerprint 0 and link like any other.  A row with a
    null id joins the component of its fingerprint (null if no member has an id).
    Repeated rows stay, each with its component.  An empty table gives no rows, and
    columns other than the two named are ignored.
    """
    marked = materialise(with_fingerprint(docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text")), "text", words).select("doc_id", "fp"), "fingerprints")
    nodes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    comps = connected_components(fingerprint_links(nodes.where("rep is not null"), max_bits), "a", "b")
    named = nodes.join(comps.withColumnRenamed("id", "rep"), "rep", "left").select(F.col("fp").alias("node_fp"), F.coalesce("component", "rep").alias("component_id"))
    return marked.join(named, F.col("fp") == F.col("node_fp")).select("doc_id", "fp", "component_id")


def keep_one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """The rows of ``docs`` whose id names its component: one document of each group of near-duplicates.

    Rows without an id have nothing to be told apart by and all stay.  Of rows that
    repeat the id of a survivor, all stay.
    """
    comps = near_duplicate_components(docs.where(F.col(doc_id).isNotNull()), doc_id, text, words, max_bits)
    gone = comps.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    return docs.join(gone, F.col(doc_id).cast("bigint") == F.col("__gone"), "left_anti")


def op5_simhash_anchors(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicate_components(docs)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
