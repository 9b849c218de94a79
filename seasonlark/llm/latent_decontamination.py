"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into overlapping passages of words; every word lies in some passage.
Passages become TF-IDF rows over the terms of the benchmark (a query has no other
coordinates).  A randomised decomposition of all passages of the corpus, stacked with the
benchmark's own rows, gives the latent directions: each task multiplies its sparse rows
with a random test matrix and back again, so a single pass and a sum of small matrices
yield the sketch A'A Omega, and a Nystroem step turns that into right singular vectors.
Passages whose latent cosine to an item reaches the threshold are candidates; the longest
common subsequence of words, the item's informative terms and its ending decide.  A passage whose
cosine is high needs less of each: replaced words break the order and take terms away, but
leave a paraphrase near its item, where unrelated texts with as many common words are not.

The latent space has fewer directions than the benchmark may have items, so an item can lie
outside it.  Windows of blocks that hold any run of the item's length are therefore candidates
too wherever they have as many of the item's terms as the decision asks for: no text of the
item's length that would be accepted is lost, whatever the rank.  An item whose terms are all
common has no latent row (its cosine is 0) and is searched by its words in the same way.

No join, no pairing of documents and no text leaves its task; what is gathered is bounded by
the benchmark, which is taken in blocks of ``MAX_ITEMS`` items.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonlark.scratch import materialise

STRIDE = 32
RANK, OVERSAMPLE = 112, 16
COSINE = 0.3
#: Share of an item's words that must appear in order: alone, or along with terms and ending.
LCS_ALONE, LCS_BACKED = 0.8, 0.6
TERM_SHARE, ANSWER_WORDS, ANSWER_SHARE = 0.6, 6, 0.5
#: What a passage near an item in the latent space needs of the same instead.
LATENT_COSINE, LATENT_LCS, LATENT_TERMS, LATENT_ANSWER = 0.4, 0.5, 0.4, 0.33
#: Terms in more than this share of blocks carry no weight.
COMMON_SHARE = 0.05
MAX_ITEMS = 1024
SLICES, FAN_IN, LEVELS = 16, 32, 4
_TOKEN = re.compile(r"\w+")


#: For texts of ASCII alone: word characters in lower case, all others a space.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() or chr(i) == "_" else " " for i in range(128)}


def tokens(text: str | None) -> list[str]:
    """Lower-case runs of word characters."""
    text = text or ""
    return text.translate(_ASCII).split() if text.isascii() else _TOKEN.findall(text.lower())


def lcs_length(item: list[int], region: list[int]) -> int:
    """Length of the longest common subsequence, one machine word at a time (bit-parallel)."""
    places: dict[int, int] = {}
    for i, x in enumerate(item):
        places[x] = places.get(x, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for y in region:
        if u := v & places.get(y, 0):
            v = ((v + u) | (v - u)) & full
    return len(item) - v.bit_count()


def _chunks(frames: Iterator[pd.DataFrame], words: int = 400_000):
    """(ids of documents, their term arrays end to end, first word of each) in pieces of about so many words."""
    for f in frames:
        doc, terms = f["doc_id"].to_numpy(), f["terms"].to_numpy()
        n = np.array([len(t) for t in terms], np.int64)
        part = (np.cumsum(n) - n) // words
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(n)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a and n[a:b].sum():
                yield doc[a:b], np.concatenate([np.asarray(t, np.int64) for t in terms[a:b]]), np.concatenate([[0], np.cumsum(n[a:b])])


def _blocks(first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each word its block; for each block its document and its number within it."""
    n = np.diff(first)
    count = -(-n // STRIDE)
    start = np.concatenate([[0], np.cumsum(count)])
    doc = np.repeat(np.arange(len(n)), n)
    pos = np.arange(first[-1]) - first[doc]
    owner = np.repeat(np.arange(len(n)), count)
    return start[doc] + pos // STRIDE, owner, np.arange(start[-1]) - start[owner]


def _rows(terms: np.ndarray, first: np.ndarray, idf: np.ndarray):
    """Sparse unit rows of passages (two blocks each): (row, term, value), and document and block of every row."""
    block, owner, number = _blocks(first)
    use = idf[terms] > 0
    b, t = block[use], terms[use]
    back = number[b] > 0
    row = np.concatenate([b, b[back] - 1])
    code, tf = np.unique(row * len(idf) + np.concatenate([t, t[back]]), return_counts=True)
    row, t = code // len(idf), code % len(idf)
    val = tf * idf[t]
    norm = np.sqrt(np.bincount(row, val * val, len(owner)))
    return row, t, val / norm[row], owner, number


def _project(row: np.ndarray, t: np.ndarray, val: np.ndarray, n: int, basis: np.ndarray) -> np.ndarray:
    """Sparse rows times a dense matrix; entries are sorted by row, and the j-th entries of all rows are added together."""
    out = np.zeros((n, basis.shape[1]), np.float32)
    if not len(row):
        return out
    val = val.astype(np.float32)
    heads = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    sizes = np.diff(np.append(heads, len(row)))
    order = np.argsort(-sizes, kind="stable")
    heads, sizes = heads[order], sizes[order]
    acc = np.zeros((len(heads), basis.shape[1]), np.float32)
    for j in range(int(sizes[0])):
        live = int(np.searchsorted(-sizes, -j, side="left"))
        at = heads[:live] + j
        acc[:live] += basis[t[at]] * val[at, None]
    out[row[heads]] = acc
    return out


def _project_back(row: np.ndarray, t: np.ndarray, val: np.ndarray, y: np.ndarray, acc: np.ndarray) -> None:
    """Add the transpose of the sparse rows times ``y`` to ``acc``, term by term."""
    order = np.argsort(t, kind="stable")
    row, t, val = row[order], t[order], val[order].astype(np.float32)
    heads = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
    for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(t)], strict=True):
        acc[t[a]] += val[a:b] @ y[row[a:b]]


def _item_rows(items: list[list[int]], idf: np.ndarray) -> np.ndarray:
    out = np.zeros((len(items), len(idf)))
    for i, ts in enumerate(items):
        np.add.at(out[i], ts, idf[ts])
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def _test_matrix(n: int, k: int) -> np.ndarray:
    return np.random.default_rng(20).standard_normal((n, k)).astype(np.float32)


def term_weights(coded: DataFrame, size: int) -> np.ndarray:
    """IDF of each term over all blocks of the corpus; 0 for absent codes and for common terms."""

    def count(frames):
        seen, blocks = np.zeros(size, np.int64), 0
        for _, terms, first in _chunks(frames):
            block, owner, _ = _blocks(first)
            seen += np.bincount(np.unique(block * size + terms) % size, minlength=size)
            blocks += len(owner)
        t = np.flatnonzero(seen)
        yield pd.DataFrame({"term": np.append(t, -1), "n": np.append(seen[t], blocks)})

    found = dict(coded.mapInPandas(count, "term bigint, n bigint").groupBy("term").agg(F.sum("n")).collect())
    blocks = found.pop(-1, 0)
    df = np.zeros(size)
    df[list(found)] = list(found.values())
    idf = np.log((1 + blocks) / (1 + df))
    idf[df > max(COMMON_SHARE * blocks, 20)] = 0
    idf[0] = 0
    return np.maximum(idf, 0)


def right_singular_vectors(coded: DataFrame, idf: np.ndarray, items: np.ndarray, rank: int = RANK) -> np.ndarray:
    """Leading right singular vectors (terms x rank) of all passages stacked with the items' rows."""
    size = len(idf)
    k = min(rank + OVERSAMPLE, size)

    def sketch(frames):
        omega, acc = _test_matrix(size, k), np.zeros((size, k), np.float32)
        rows = 0
        for _, terms, first in _chunks(frames):
            row, t, val, owner, _ = _rows(terms, first, idf)
            if not len(row):
                continue
            y = _project(row, t, val, len(owner), omega)
            _project_back(row, t, val, y, acc)
            rows += len(np.unique(row))
        if rows:
            for s, part in enumerate(np.array_split(acc, SLICES)):
                yield pd.DataFrame({"slice": [s], "part": [part.tobytes()], "rows": [rows]})

    def add(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(p, np.float32) for p in group["part"]], axis=0, dtype=np.float64).astype(np.float32)
        return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": [total.tobytes()], "rows": [group["rows"].sum()], "g": group["g"].iloc[:1]})

    schema = "slice int, part binary, rows bigint"
    summed = coded.mapInPandas(sketch, schema).withColumn("g", F.spark_partition_id().cast("bigint"))
    # a call adds at most FAN_IN parts, with up to FAN_IN ** LEVELS tasks
    for _ in range(LEVELS):
        summed = summed.withColumn("g", F.floor(F.col("g") / FAN_IN)).groupBy("slice", "g").applyInPandas(add, f"{schema}, g bigint")
    summed = summed.orderBy("slice").collect()
    omega = _test_matrix(size, k).astype(float)
    y, rows = np.zeros((size, k)), 0
    if summed:
        y, rows = np.concatenate([np.frombuffer(r.part, np.float32) for r in summed]).reshape(size, k).astype(float), summed[0].rows
    # the items weigh as much as all passages, so that no item is lost among the corpus' topics
    y = y + max(1.0, rows / max(1, len(items))) * (items.T @ (items @ omega))
    shift = 1e-6 * np.linalg.norm(y) + 1e-12
    y = y + shift * omega
    small = omega.T @ y
    w, u = np.linalg.eigh((small + small.T) / 2)
    good = w > 1e-9 * max(w.max(), 1e-30)
    left, _, _ = np.linalg.svd(y @ (u[:, good] / np.sqrt(w[good])), full_matrices=False)
    return left[:, :rank].astype(np.float32)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """``(doc_id, item_id, cosine, lcs_share, term_share, answer_share)`` of documents that hold a benchmark item.

    One row per document and item found (the best place counts).  Null and wordless texts and
    items match nothing; repeated documents are each reported; a null doc_id is reported as
    null.  Empty tables give no rows; other columns are ignored.
    """
    known = [(r[0], tokens(r[1])) for r in benchmark.select(F.col(item_id).cast("bigint"), item_text).where(F.col(item_text).isNotNull()).distinct().orderBy(item_id, item_text).toLocalIterator()]
    known = [x for x in known if x[1]]
    parts = [_search(docs, known[i : i + MAX_ITEMS], doc_id, text) for i in range(0, len(known), MAX_ITEMS)]
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, cosine double, lcs_share double, term_share double, answer_share double")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _search(docs: DataFrame, known: list, doc_id: str, text: str) -> DataFrame:
    vocab = {w: i + 1 for i, w in enumerate(sorted({w for _, ws in known for w in ws}))}
    size = len(vocab) + 1
    coded_items = [[vocab[w] for w in ws] for _, ws in known]
    ids = [i for i, _ in known]

    def code(frames):
        get = vocab.get
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "terms": [np.array([get(w, 0) for w in tokens(t)], np.int32) for t in f["text"]]})

    base = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    coded = materialise(base.mapInPandas(code, "doc_id bigint, terms array<int>"), "terms")
    idf = term_weights(coded, size)
    items = _item_rows(coded_items, idf)
    basis = right_singular_vectors(coded, idf, items)
    queries = (items @ basis).astype(np.float32)
    norm = np.linalg.norm(queries, axis=1, keepdims=True)
    queries /= np.where(norm > 0, norm, 1)
    # no item's cosine to a passage exceeds the sum of its terms' largest weights in any item
    limit = np.abs(queries @ basis.T).max(axis=0).astype(np.float64)
    rare = [np.unique([t for t in ts if idf[t] > 0]) for ts in coded_items]
    # what each term counts for each item, what a window must reach, and its number of blocks
    counts, need = np.zeros((size, len(known)), np.float32), np.full(len(known), np.inf, np.float32)
    span = np.array([max(2, -(-(len(ts) - 1) // STRIDE) + 1) for ts in coded_items])
    for q, own in enumerate(rare):
        if len(own):
            counts[own, q] = 1
            need[q] = TERM_SHARE * len(own) - 1e-3
        else:  # all of its terms are common, as where many texts hold it: its words themselves are looked for
            np.add.at(counts[:, q], coded_items[q], 1)
            need[q] = LCS_BACKED * len(coded_items[q]) - 1e-3
    counted = counts.any(axis=1)

    def windows(terms, block, owner):
        """Blocks by items: whether the window that starts at the block has enough of the item's terms."""
        use = counted[terms]
        code = np.unique(block[use] * size + terms[use])
        own = _project(code // size, code % size, np.ones(len(code), np.float32), len(owner), counts)
        total, out = own.copy(), np.zeros(own.shape, bool)
        for n in range(2, int(span.max()) + 1):
            j = n - 1
            total[:-j] += own[j:] * (owner[j:] == owner[:-j])[:, None]
            at = span == n
            out[:, at] = total[:, at] >= need[at]
        return out

    def search(frames):
        for doc, terms, first in _chunks(frames):
            row, t, val, owner, number = _rows(terms, first, idf)
            held = windows(terms, _blocks(first)[0], owner)
            hope = (np.bincount(row, val * limit[t], len(owner)) >= COSINE - 1e-4) | held.any(axis=1)
            use = hope[row]
            near = np.zeros((len(owner), len(queries)), np.float32)
            near[hope] = _project(row[use], t[use], val[use], len(owner), basis)[hope] @ queries.T
            best: dict[tuple[int, int], tuple] = {}
            for r, q in zip(*np.nonzero((near >= COSINE) | held), strict=True):
                d, item = int(owner[r]), coded_items[q]
                at = int(number[r]) * STRIDE
                region = terms[first[d] + max(0, at - len(item)) : min(first[d + 1], first[d] + at + int(span[q]) * STRIDE + len(item))]
                found = lcs_length(item, region.tolist()) / len(item)
                if found < LATENT_LCS or (found < LCS_BACKED and near[r, q] < LATENT_COSINE):
                    continue
                shared = float(np.isin(rare[q], region).mean()) if len(rare[q]) else 1.0
                tail = item[-ANSWER_WORDS:]
                answer = lcs_length(tail, region.tolist()) / len(tail)
                worded = shared >= TERM_SHARE and found >= LCS_BACKED and (found >= LCS_ALONE or answer >= ANSWER_SHARE)
                if worded or (near[r, q] >= LATENT_COSINE and shared >= LATENT_TERMS and answer >= LATENT_ANSWER):
                    new = (found, float(near[r, q]), shared, answer)
                    best[d, int(q)] = max(best.get((d, int(q)), new), new)
            rows = [(doc[d], ids[q], c, f, s, a) for (d, q), (f, c, s, a) in best.items()]
            out = pd.DataFrame(rows, columns=["doc_id", "item_id", "cosine", "lcs_share", "term_share", "answer_share"])
            out["doc_id"] = out["doc_id"].astype("Int64")
            out["item_id"] = out["item_id"].astype("Int64")
            yield out

    return coded.mapInPandas(search, "doc_id bigint, item_id bigint, cosine double, lcs_share double, term_share double, answer_share double")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id have nothing to be named by and stay."""
    bad = contaminated(docs.where(F.col(doc_id).isNotNull()), benchmark, doc_id, text).select(F.col("doc_id").alias("__leak")).distinct()
    return docs.join(bad, F.col(doc_id).cast("bigint") == F.col("__leak"), "left_anti")


def op2_latent_decontamination(spark, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items."""
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
