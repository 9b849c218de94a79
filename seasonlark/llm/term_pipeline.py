"""Ranked lexical search by pipelined term partitioning.

Query terms belong to a few owners, the rarest terms to the first.  Documents lie in
blocks and items in bundles; a bundle carries, per block, each item's accumulators (the
documents met so far and their integer scores) from owner to owner.  At an owner it is
cogrouped with the postings of that owner's terms, which add their contributions.  After an
owner a document is let go only if it cannot come among the first of its block any more: if as
many others stand higher by more than all later owners can add.  The last owner leaves the first
of each block, and of those the first of all are taken.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seasonlark.scratch import materialise, new_path

TOP = 20
OWNERS = 4
#: Most items of a bundle and documents of a block: a task holds one bundle's accumulators in one block.
BUNDLE_ITEMS, BLOCK_DOCS = 256, 16_384
#: Blocks that a small table is dealt into at least, as long as they have 512 documents.
LEAST_BLOCKS = 64
#: Query terms that are shipped to tasks to drop other terms early; beyond, a join alone drops them.
SHIPPED_TERMS = 500_000

#: Every byte as itself if part of a term, A-Z in lower case, and as a space if not.
_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """Terms of a text in order: maximal runs of ASCII letters and digits and of all other characters beyond ASCII."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_BYTES).split()


def bags(docs: DataFrame, keys: list[str], text: str, only: frozenset[bytes] | None = None) -> DataFrame:
    """``(keys, n, terms, tfs)`` per row: its number of terms, and distinct terms (of ``only``, if given) with their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, ends, terms, tfs = [], [0], [], []
            for t in b.column(len(keys)):
                words = terms_of(t.as_py())
                bag = Counter(words if only is None else filter(only.__contains__, words))
                n.append(len(words))
                terms.extend(bag)
                tfs.extend(bag.values())
                ends.append(len(terms))
            ends = pa.array(ends, pa.int32())
            flat = pa.array(terms, pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays(
                [*(b.column(i) for i in range(len(keys))), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, flat), pa.ListArray.from_arrays(ends, pa.array(tfs, pa.int32()))], [*keys, "n", "terms", "tfs"]
            )

    rows = docs.select(*keys, F.col(text).cast("string").alias("__text"))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(count, f"{head}, n bigint, terms array<string>, tfs array<int>")


def _add_owner(items: pa.Table, postings: pa.Table, top: int) -> pa.Table:
    """Accumulators of a bundle's items in one block after one owner's postings.

    Scores are 64-bit integers in an array over the block's documents that the owner or the accumulators know.
    """
    whole = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    held, held_ids, held_scores = (whole(items[c]) for c in ("rows", "ids", "scores"))
    ends = held.offsets.to_numpy() - (held.offsets[0].as_py() if len(held) else 0)
    flat = held.flatten().to_numpy()
    before = held_scores.flatten().to_numpy()
    known, first, at = np.unique(np.concatenate([postings["row"].to_numpy(), flat]), return_index=True, return_inverse=True)
    ids = pa.concat_arrays([whole(postings["doc_id"]), held_ids.flatten()]).take(pa.array(first))
    here, there = at[: postings.num_rows], at[postings.num_rows :]
    tno = postings["tno"].to_numpy()
    order = np.argsort(tno, kind="stable")
    tno, here, gain = tno[order], here[order], postings["gain"].to_numpy().astype(np.int64)[order]
    plain = ids.to_numpy(zero_copy_only=False) if pa.types.is_integer(ids.type) and not ids.null_count else None
    out_rows, out_ids, out_scores, out_ends = [], [], [], [0]
    for k, (terms, weights, rest) in enumerate(zip(items["tnos"].to_pylist(), items["weights"].to_pylist(), items["rest"].to_pylist(), strict=True)):
        score = np.zeros(len(known), np.int64)
        score[there[ends[k] : ends[k + 1]]] = before[ends[k] : ends[k + 1]]
        for t, w in zip(terms or [], weights or [], strict=True):
            a, b = np.searchsorted(tno, [t, t + 1])
            score[here[a:b]] += w * gain[a:b]
        keep = np.flatnonzero(score)
        if len(keep) > top:
            edge = np.partition(score[keep], -top)[-top]
            keep = keep[score[keep] + rest >= edge]
            if not rest and plain is not None:
                keep = keep[np.lexsort((plain[keep], -score[keep]))[:top]]
        out_rows.append(known[keep])
        out_ids.append(keep)
        out_scores.append(score[keep])
        out_ends.append(out_ends[-1] + len(keep))
    ends = pa.array(out_ends, pa.int32())
    join = lambda xs: np.concatenate(xs) if xs else np.zeros(0, np.int64)
    lists = [pa.ListArray.from_arrays(ends, v) for v in (pa.array(join(out_rows)), ids.take(pa.array(join(out_ids))), pa.array(join(out_scores)))]
    return pa.table([items["bundle"], items["block"], items["item"], *lists], names=["bundle", "block", "item", "rows", "ids", "scores"])


def _item_terms(items: DataFrame, key: str, text: str) -> DataFrame:
    """``(item, item_id, term, qtf)``: items numbered, each with its distinct terms and their counts; rows of one id are one item."""
    words = bags(items.select(key, text).distinct(), [key], text).select(key, F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    sums = words.groupBy(key, F.col("t.terms").alias("term")).agg(F.sum("t.tfs").alias("qtf"))
    whole = sums.groupBy(key).agg(F.collect_list(F.struct("term", "qtf")).alias("t")).withColumn("item", F.monotonically_increasing_id())
    return materialise(whole.select("item", F.col(key).alias("item_id"), F.explode("t").alias("t")).select("item", "item_id", "t.term", "t.qtf"), "item_terms")


def _owner(weight_volume: list[tuple[int, int]], owners: int) -> list[int]:
    """Least weight of every owner but the last, so that owners, from the rarest terms on, hold about as many postings each."""
    total, run, cuts = sum(v for _, v in weight_volume), 0, []
    for w, v in sorted(weight_volume, reverse=True):
        run += v
        while len(cuts) < owners - 1 and run * owners >= total * (len(cuts) + 1):
            cuts.append(w)
    return cuts


def ranked_search(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", top: int = TOP, owners: int = OWNERS) -> DataFrame:
    """``(item_id, rank, doc_id, score)``: the ``top`` highest scores above 0 of each item, equal ones by ascending doc_id.

    Each row of ``docs`` is a document, so repeated rows are ranked each; a null id comes after all others of its score.
    Null and empty texts have no terms and are found by nothing.  Rows of ``items`` that share an id are one item with all their distinct
    texts' terms; items without terms, or with none that a document holds, have no result.  Either table may be empty;
    other columns are ignored.
    """
    spark = docs.sparkSession
    wanted = _item_terms(items, item_id, item_text)
    vocabulary = wanted.select("term").distinct()
    shipped = None
    if vocabulary.limit(SHIPPED_TERMS + 1).count() <= SHIPPED_TERMS:
        shipped = frozenset(r.term.encode() for r in vocabulary.collect())
    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = materialise(bags(numbered, ["row", "doc_id"], "text", shipped), "bags")
    size = found.where("n > 0").agg(F.count("*").alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = size.docs, size.terms or 1
    n_items = wanted.select("item").distinct().count()
    bundles = max(1, -(-n_items // BUNDLE_ITEMS))
    blocks = max(1, -(-n_docs // BLOCK_DOCS), min(LEAST_BLOCKS, n_docs // 512))

    length = F.expr(f"75L + (25L * n * {n_docs}L) div {n_terms}L")
    long = found.select("row", "doc_id", length.alias("m"), F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
    long = long.select("row", "doc_id", F.col("t.terms").alias("term"), F.expr("cast((1000000000L * t.tfs) div (1000L * t.tfs + 12L * m) as int)").alias("gain"))
    seen = long if shipped is not None else long.join(vocabulary, "term", "left_semi")
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2.0 * F.col("df") + 1)))
    stats = seen.groupBy("term").agg(F.count("*").alias("df"), F.max("gain").alias("most"))
    stats = materialise(stats.withColumn("weight", weight).where("weight > 0").withColumn("tno", F.monotonically_increasing_id()), "terms")
    cuts = _owner([(r.weight, r.v) for r in stats.groupBy("weight").agg(F.sum("df").alias("v")).collect()], owners)
    owner = F.lit(len(cuts))
    for k in range(len(cuts) - 1, -1, -1):
        owner = F.when(F.col("weight") >= cuts[k], k).otherwise(owner)
    bundle = F.pmod(F.xxhash64("item"), F.lit(bundles)).cast("int").alias("bundle")
    uses = materialise(wanted.join(stats, "term").select("item", bundle, "term", "tno", owner.cast("int").alias("owner"), (F.col("qtf") * F.col("weight")).alias("weight"), "most"), "uses")

    path = new_path(spark, "postings")
    block = F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int").alias("block")
    long.join(uses.select("term", "tno", "bundle", "owner").distinct(), "term").select("bundle", block, "row", "doc_id", "tno", "gain", "owner").write.partitionBy("owner").parquet(path)
    id_type = docs.schema[doc_id].dataType.simpleString()
    postings = spark.read.schema(f"bundle int, block int, row bigint, doc_id {id_type}, tno bigint, gain int, owner int").parquet(path)
    at = F.col("owner")
    per_item = materialise(
        uses.groupBy("item", "bundle").agg(
            *[F.collect_list(F.when(at == k, F.struct("tno", "weight"))).alias(f"t{k}") for k in range(owners)],
            *[F.sum(F.when(at > k, F.col("weight") * F.col("most")).otherwise(F.lit(0))).alias(f"rest{k}") for k in range(owners)],
        ), "items"
    )
    state = per_item.select("bundle", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "item").withColumns({"rows": F.expr("cast(array() as array<bigint>)"), "ids": F.expr(f"cast(array() as array<{id_type}>)"), "scores": F.expr("cast(array() as array<bigint>)")})
    for k in range(owners):
        own = per_item.select("item", F.transform(f"t{k}", lambda t: t["tno"]).alias("tnos"), F.transform(f"t{k}", lambda t: t["weight"]).alias("weights"), F.col(f"rest{k}").alias("rest"))
        left = state.join(own, "item").groupBy("bundle", "block")
        right = postings.where(F.col("owner") == k).drop("owner").groupBy("bundle", "block")
        state = left.cogroup(right).applyInArrow(lambda a, b: _add_owner(a, b, top), f"bundle int, block int, item bigint, rows array<bigint>, ids array<{id_type}>, scores array<bigint>")
    best = state.select("item", F.explode(F.arrays_zip("rows", "ids", "scores")).alias("d")).select("item", F.col("d.ids").alias("doc_id"), F.col("d.scores").alias("score"), F.col("d.rows").alias("row"))
    order = W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last(), "row")
    best = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return best.join(wanted.select("item", "item_id").distinct(), "item").select(F.col("item_id").alias(item_id), "rank", "doc_id", "score")


def op13_term_pipeline(spark, sf_dir: str) -> DataFrame:
    """The 20 highest-ranking documents of every benchmark item."""
    return ranked_search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\\x{80}-\\x{10FFFF}]+')"
OP13_SQL = f"""WITH q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, n, unnest(ts) AS t FROM (SELECT doc_id, {_TERMS} AS ts, CAST(len({_TERMS}) AS BIGINT) AS n FROM documents)),
s AS (SELECT count(DISTINCT doc_id) AS docs, count(*) AS terms FROM d),
p AS (SELECT doc_id, n, t, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY ALL),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, s GROUP BY t, docs),
c AS (SELECT q.item_id, p.doc_id, CAST(sum(q.qtf * w.w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score FROM q JOIN p USING (t) JOIN w USING (t), s GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER o AS INT) AS rank, doc_id, score FROM c WHERE score > 0 WINDOW o AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY row_number() OVER o <= 20"""
