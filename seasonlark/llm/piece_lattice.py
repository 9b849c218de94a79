"""SentencePiece encoding and decoding on a relational lattice.

Each distinct chunk becomes a small lattice: its substrings of bounded length are exploded,
equi-joined to the piece table and grouped by the chunk again; a higher-order aggregate
folds the edges into the encoding.  Two folds are given.  ``viterbi`` keeps the best
path by summed scores, which is the answer for unigram models.  ``merge`` takes, again and
again, the best-scored edge over exactly two neighbouring symbols, the leftmost on ties; that
is the answer for BPE models such as the public one, where the Viterbi path is not.

Chunks are cut where no piece can cross, so a text's encoding is the sum of its chunks'.  The
most frequent chunks are folded once and every worker reads their ids, a table of bounded size, from
the shared folder; a document's other chunks are folded under the document's own key and meet its ids there.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlark.llm.ragged import ChunkTable, hashes, spread, sums, text_bytes
from seasonlark.scratch import materialise, remove

META = "▁"
#: At most so many of the most frequent chunks, of at most so many bytes each, are in the table of every task.
FREQUENT = 2_000_000
FREQUENT_BYTES = 64
#: A task counts so many distinct chunks before it passes their counts on.
COUNTED = 1_000_000
#: A task holds the edges of so many chunks at once, some 2 KB each.
CHUNKS_A_PARTITION = 20_000
#: Rows of the table that a worker reads at a time.
READ_ROWS = 20_000
#: Boundaries of chunks up to this length are bits of one bigint, of longer ones bits of an array of them.
WORD_CHARS = 61
_SIGN = -(2**63)


class Model:
    """The piece table of a SentencePiece model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = sp.get_piece_size()
        # inside, a space stands for the meta symbol
        self.pieces = {sp.id_to_piece(i).replace(META, " "): (i, sp.get_score(i)) for i in range(self.size) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))}
        self.byte_base = sp.piece_to_id("<0x00>")
        if [sp.piece_to_id(f"<0x{i:02X}>") for i in range(256)] != list(range(self.byte_base, self.byte_base + 256)):
            raise ValueError("byte pieces must be consecutive")
        self.longest = max(map(len, self.pieces))
        self.decoded = [bytes([i - self.byte_base]) if sp.is_byte(i) else b"" if sp.is_control(i) else b" \xe2\x81\x87 " if sp.is_unknown(i) else sp.id_to_piece(i).replace(META, " ").encode() for i in range(self.size)]
        self.chunk = self._chunk_pattern()

    def _chunk_pattern(self) -> str:
        """Cuts where no piece crosses: between letters and other characters and around digits, or else before spaces only."""
        kind = lambda c: "S" if c == " " else "N" if re.match(r"\d", c) else "L" if re.match(r"[^\W\d_]", c) else "P"
        odd = {x for p in self.pieces for a, b in zip(p, p[1:], strict=False) for x, y in ((a, b), (b, a)) if kind(x) == "L" and kind(y) == "P"}
        extra = "".join(map(re.escape, sorted(odd)))
        letter = rf"(?:(?![{extra}])[^\W\d_])" if odd else r"[^\W\d_]"
        fine = rf" *(?:{letter}+|(?:[^\w ]|[_{extra}])+)| +|\d"
        if all(re.fullmatch(fine, p) for p in self.pieces) and not any(re.fullmatch(rf"[{PLAIN}]", c) for c in odd):
            return fine
        plain = r" *[^ ]+| +"
        if not all(re.fullmatch(plain, p) for p in self.pieces):
            raise ValueError("pieces cross spaces")
        return plain


#: Letters whose words are cut by their bytes.
PLAIN = "A-Za-zÀ-ÖØ-öø-ÿ"
_LETTER, _DIGIT, _OTHER, _SPACE = range(4)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[32] = _SPACE


@cache
def _finder(pattern: str):
    return re.compile(pattern).findall


def chunk_starts(raw: np.ndarray, cuts: np.ndarray, pattern: str) -> np.ndarray:
    """Where the chunks of texts begin, given their bytes and the offsets of the texts.

    Words of ASCII and of letters from U+00C0 to U+00FF are cut by their bytes; a word with any
    other character is cut by the pattern itself.
    """
    if not len(raw):
        return np.empty(0, np.int64)
    kind = _KINDS[raw]
    before = np.empty_like(kind)
    before[0], before[1:] = _OTHER, kind[:-1]
    word = (kind == _SPACE) & (before != _SPACE)
    word[cuts[:-1][cuts[:-1] < len(raw)]] = True
    if r"\d" not in pattern:
        return np.nonzero(word)[0]
    start = word | (kind == _DIGIT) | (kind != before) & (before != _SPACE)
    high = raw >= 128
    # control characters but line feed and tab are left to the pattern as well
    odd = (raw < 32) & (raw != 10) & (raw != 9) | (raw == 127)
    if high.any():
        lead = raw == 0xC3
        follows = np.concatenate([[False], lead[:-1]])
        odd |= high & ~lead & ~(follows & (raw != 0x97) & (raw != 0xB7))
    if odd.any():
        words = np.nonzero(word)[0]
        ends = np.append(words[1:], len(raw))
        slow = np.nonzero(np.logical_or.reduceat(odd, words))[0]
        find = _finder(pattern)
        for a, b in zip(words[slow].tolist(), ends[slow].tolist(), strict=True):
            start[a:b] = False
            at = a
            for chunk in find(raw[a:b].tobytes().decode("utf-8", "surrogatepass")):
                start[at] = True
                at += len(chunk.encode("utf-8", "surrogatepass"))
    return np.nonzero(start)[0]


def prepared(texts: pa.Array) -> pa.Array:
    """Texts as the model reads them: a space of their own first, and the meta symbol is a space; empty ones stay empty."""
    texts = pc.replace_substring(texts.cast(pa.large_utf8()), META, " ")
    led = pc.binary_join_element_wise(pa.scalar(" ", pa.large_utf8()), texts, pa.scalar("", pa.large_utf8()))
    return pc.if_else(pc.equal(pc.binary_length(texts), 0), texts, led)


def chunks_of(text: str | None, pattern: str) -> list[str]:
    """The chunks of one text."""
    raw, cuts = text_bytes(prepared(pa.array([text or ""], pa.large_utf8())))
    starts = chunk_starts(raw, cuts, pattern)
    return [x.tobytes().decode("utf-8", "surrogatepass") for x in np.split(raw, starts[1:])] if len(starts) else []


def _slices(batch: pa.RecordBatch, most: int = 250_000):
    """Parts of a batch with some bytes of text each, so that long texts do not add up."""
    size = start = 0
    for i, n in enumerate(pc.binary_length(batch.column("text")).to_pylist()):
        size += n
        if size >= most:
            yield batch.slice(start, i + 1 - start)
            start, size = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def _strings(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """Byte ranges as a string array."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw[spread(starts, lengths)]))).cast(pa.utf8())


def chunk_counts(texts: DataFrame, pattern: str) -> DataFrame:
    """``(chunk, n)`` over the column ``text``, summed within tasks before the shuffle.

    Chunks met once in all texts and those too long for the table that is sent to every task are
    left out; a row without a chunk counts all chunks.
    """

    def count(batches):
        table, n, every = ChunkTable(np.dtype("<u2")), np.zeros(0, np.int64), 0

        def counted():
            chunks = _strings(table.bytes, table.at[: table.size], table.length[: table.size].astype(np.int64))
            # in order, neighbours share their beginnings and the shuffle is smaller
            order = pc.sort_indices(chunks)
            return pa.RecordBatch.from_arrays([chunks.take(order), pa.array(n, pa.int64()).take(order)], ["chunk", "n"])

        for batch in batches:
            for part in _slices(batch):
                raw, cuts = text_bytes(prepared(part.column("text")))
                starts = chunk_starts(raw, cuts, pattern)
                if not len(starts):
                    continue
                lengths = np.diff(starts, append=len(raw))
                h, first, times = np.unique(hashes(raw, starts, lengths), return_index=True, return_counts=True)
                short = lengths[first] <= FREQUENT_BYTES
                every += len(starts)
                h, first, times = h[short], first[short], times[short]
                entries = table.find(h)
                new = np.nonzero(entries < 0)[0]
                at = first[new]
                entries[new] = table.add(h[new], raw[spread(starts[at], lengths[at])], lengths[at], np.empty(0, np.uint16), np.zeros(len(new), np.int64))
                n = np.concatenate([n, np.zeros(table.size - len(n), np.int64)])
                n[entries] += times
                if table.size > COUNTED:
                    yield counted()
                    table, n = ChunkTable(np.dtype("<u2")), np.zeros(0, np.int64)
        yield counted()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.utf8()), pa.array([every], pa.int64())], ["chunk", "n"])

    return texts.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "chunk string, n bigint").groupBy("chunk").agg(F.sum("n").alias("n")).where("chunk is null or n > 1")


def _byte_ids(char: Column, byte_base: int) -> Column:
    codes = F.regexp_extract_all(F.hex(F.encode(char, "UTF-8")), F.lit("(..)"), F.lit(1))
    return F.transform(codes, lambda h: F.conv(h, 16, 10).cast("int") + byte_base)


def _shift(x: int, i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(x).cast("bigint"), i)


def _bit(i: Column) -> Column:
    return _shift(1, i)


def _merge_fold(edges: Column, n: Column) -> Column:
    """Boundaries that remain, as bits of a bigint, when no edge over two neighbouring symbols is left.

    edges come best first, with the bits of their ends and of what lies between them.  One
    pass takes every edge that fits when its turn comes.  Only an edge that can be part of a
    better one may make an earlier edge fit; its ``over`` is the sign, which ends the pass, and
    the next pass starts from the best edge.
    """

    def take(cuts, e):
        fits = (cuts.bitwiseAND(e["ends"].bitwiseOR(F.lit(_SIGN))) == e["ends"]) & (F.bit_count(cuts.bitwiseAND(e["inner"])) == 1)
        return F.when(fits, cuts.bitwiseXOR(cuts.bitwiseAND(e["inner"])).bitwiseOR(e["over"])).otherwise(cuts)

    start = (_shift(2, n) - 1).bitwiseOR(F.lit(_SIGN))
    one_pass = lambda s: F.aggregate(edges, s.bitwiseAND(F.lit(~_SIGN)), take)
    return F.aggregate(F.sequence(F.lit(1), n), start, lambda s, _: F.when(s < 0, one_pass(s)).otherwise(s), lambda s: s.bitwiseAND(F.lit(~_SIGN)))


_BITS = 32


def _window(cuts: Column, s: Column) -> Column:
    """33 boundaries from ``s`` on as bits of a bigint, out of an array of 32 boundaries each."""
    q, r = F.shiftright(s, 5), s.bitwiseAND(F.lit(_BITS - 1))
    return F.call_function("shiftright", F.get(cuts, q), r).bitwiseOR(F.call_function("shiftleft", F.get(cuts, q + 1), F.lit(_BITS) - r)).bitwiseAND(F.lit(2**33 - 1))


def _merge_fold_long(edges: Column, n: Column) -> Column:
    """The same fold over an array of boundaries, for chunks of any length and edges of up to 32 characters."""
    low = F.lit(2**_BITS - 1)

    def take(state, e):
        cuts, s = state["cuts"], e["s"]
        inner, ends = _bit(e["len"]) - 2, _bit(e["len"]) + 1
        window = _window(cuts, s)
        fits = ~state["over"] & (window.bitwiseAND(ends) == ends) & (F.bit_count(window.bitwiseAND(inner)) == 1)
        q, r = F.shiftright(s, 5), s.bitwiseAND(F.lit(_BITS - 1))
        here = F.get(cuts, q).bitwiseAND(F.bitwise_not(F.call_function("shiftleft", inner, r).bitwiseAND(low)))
        there = F.get(cuts, q + 1).bitwiseAND(F.bitwise_not(F.call_function("shiftright", inner, F.lit(_BITS) - r)))
        new = F.concat(F.slice(cuts, 1, q), F.array(here, there), F.slice(cuts, q + 3, F.size(cuts)))
        return F.when(fits, F.struct(new.alias("cuts"), e["again"].alias("over"))).otherwise(state)

    # boundaries 0 to n, and one word more so that every window has two
    words = F.transform(F.sequence(F.lit(0), F.floor(n / _BITS).cast("int") + 1), lambda i: _bit(F.greatest(F.lit(0), F.least(F.lit(_BITS), n + 1 - i * _BITS))) - 1)
    start = F.struct(words.alias("cuts"), F.lit(True).alias("over"))
    one_pass = lambda s: F.aggregate(edges, F.struct(s["cuts"].alias("cuts"), F.lit(False).alias("over")), take)
    return F.aggregate(F.sequence(F.lit(1), n), start, lambda s, _: F.when(s["over"], one_pass(s)).otherwise(s), lambda s: s["cuts"])


def _viterbi_fold(edges: Column, n: Column) -> Column:
    """The boundaries of the path with the highest sum of scores, ascending; edges come ordered by their end."""
    blank = F.struct(F.lit(None).cast("double").alias("score"), F.lit(0).alias("from"))
    first = F.struct(F.lit(0.0).alias("score"), F.lit(0).alias("from"))
    start = F.transform(F.sequence(F.lit(0), n), lambda i: F.when(i == 0, first).otherwise(blank))

    def relax(best, e):
        end = e["s"] + e["len"]
        total = F.get(best, e["s"])["score"] + e["score"]
        new = F.struct(total.alias("score"), e["s"].alias("from"))
        old = F.get(best, end)["score"]
        better = total.isNotNull() & (old.isNull() | (total > old))
        return F.when(better, F.concat(F.slice(best, 1, end), F.array(new), F.slice(best, end + 2, F.size(best)))).otherwise(best)

    best = F.aggregate(edges, start, relax)
    walk = lambda path, _: F.when(F.get(path["cuts"], F.lit(0)) == 0, path).otherwise(
        F.struct(path["best"].alias("best"), F.concat(F.array(F.get(path["best"], F.get(path["cuts"], F.lit(0)))["from"]), path["cuts"]).alias("cuts"))
    )
    return F.aggregate(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), F.struct(best.alias("best"), F.array(n).alias("cuts")), walk, lambda p: p["cuts"])


def piece_table(spark: SparkSession, pieces: dict[str, tuple[int, float]], fold: str = "merge") -> DataFrame:
    """``(h, p, place, id, score, again)``: h is the piece's xxhash64, place its order by descending score.

    again: with another piece or character it makes up a piece of no lower score, so merging it
    may let a better edge fit.
    """
    place = {score: i for i, score in enumerate(sorted({score for _, score in pieces.values()}, reverse=True))}
    again = set()
    for p, (_, score) in pieces.items() if fold == "merge" else ():
        for c in range(1, len(p)):
            a, b = p[:c], p[c:]
            if (len(a) == 1 or a in pieces) and (len(b) == 1 or b in pieces):
                again.update(x for x in (a, b) if len(x) > 1 and pieces[x][1] <= score)
    h = {p: int(np.uint64(xxhash.xxh64_intdigest(p.encode(), 42)).astype(np.int64)) for p in pieces}
    if len(set(h.values())) < len(pieces):
        raise ValueError("two pieces of one hash")
    rows = zip(*((h[p], p, place[s], i, float(s), p in again) for p, (i, s) in pieces.items()), strict=True)
    kinds = (pa.int64(), pa.utf8(), pa.int64(), pa.int32(), pa.float64(), pa.bool_())
    # Arrow columns need no Python workers; rows would be unpickled by a second set of them in every executor
    return spark.createDataFrame(pa.table([pa.array(x, k) for x, k in zip(rows, kinds, strict=True)], ["h", "p", "place", "id", "score", "again"]))


class _Packing:
    """An edge as one bigint that sorts by its piece's place and then by its start: place, start, length, again, id."""

    def __init__(self, places: int, ids: int):
        self.id_bits = ids.bit_length()
        self.s_bits = 63 - places.bit_length() - 6 - 1 - self.id_bits

    def pack(self, place: Column, s: Column, length: Column, again: Column, id_: Column) -> Column:
        out = F.shiftleft(place, self.s_bits).bitwiseOR(s.cast("bigint"))
        out = F.shiftleft(F.shiftleft(out, 6).bitwiseOR(length.cast("bigint")), 1).bitwiseOR(again.cast("bigint"))
        return F.shiftleft(out, self.id_bits).bitwiseOR(id_.cast("bigint"))

    def _part(self, e: Column, low: int, bits: int) -> Column:
        return F.shiftright(e, low).bitwiseAND(F.lit((1 << bits) - 1)).cast("int")

    def id(self, e: Column) -> Column:
        """Zero for no piece, else the id and one."""
        return self._part(e, 0, self.id_bits)

    def again(self, e: Column) -> Column:
        return self._part(e, self.id_bits, 1)

    def len(self, e: Column) -> Column:
        return self._part(e, self.id_bits + 1, 6)

    def s(self, e: Column) -> Column:
        return self._part(e, self.id_bits + 7, self.s_bits)


def _edges(hit: DataFrame, own: list[str], edge: Column) -> DataFrame:
    """``(*own, edges)``: the edges of each chunk in order.

    An edge is a column before it is collected: an aggregate on objects interprets its argument
    row by row, while a projection is compiled.
    """
    return hit.select(*own, edge.alias("edge")).groupBy(*own).agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def encode_chunks(chunks: DataFrame, pieces: DataFrame, longest: int, byte_base: int, fold: str = "merge", keys: tuple[str, ...] = ()) -> DataFrame:
    """``(*keys, chunk, ids)`` of distinct chunks (under their keys) by the lattice.

    chunks: columns ``keys`` and ``chunk``, dealt by one of them; explode and the broadcast of
    the piece table (its size is the vocabulary's) keep that partitioning, so grouping the
    edges by chunk moves nothing.  Substrings meet pieces by hash and must equal them.  Characters
    without a piece become byte pieces; for the Viterbi fold they weigh as the worst piece less ten.
    """
    if longest > _BITS:
        raise ValueError("pieces of more than 32 characters")
    own = [*keys, "chunk"]
    spots = chunks.select(*own, F.length("chunk").alias("n")).select(*own, "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("s"))
    spans = spots.select(*own, "s", F.explode(F.sequence(F.lit(1), F.least(F.lit(longest), F.col("n") - F.col("s")))).alias("len"))
    subs = spans.select(*own, "s", "len", F.expr("substring(chunk, s + 1, len)").alias("piece")).withColumn("h", F.xxhash64("piece"))
    hit = subs.join(F.broadcast(pieces), "h", "left").withColumn("id", F.when(F.col("piece") == F.col("p"), F.col("id")))
    # a character without a piece keeps an edge of its own, without an id
    hit = hit.where(F.col("id").isNotNull() | (F.col("len") == 1))
    if fold == "viterbi":
        worst = pieces.agg(F.min("score")).first()[0]
        edge = F.struct((F.col("s") + F.col("len")).alias("order"), "s", "len", F.when(F.col("id").isNotNull(), F.col("score")).otherwise(float(worst) - 10.0).alias("score"), "id")
        grouped = _edges(hit, own, edge)
        grouped = grouped.withColumn("cuts", _viterbi_fold(F.col("edges"), F.length("chunk")))
        hops = F.transform("cuts", lambda x, i: F.struct(x.alias("s"), (F.get("cuts", i + 1) - x).alias("len")))
        grouped = grouped.withColumn("hops", hops)
        used = F.filter("edges", lambda e: F.col("hops").isNotNull() & F.array_contains("hops", F.struct(e["s"].alias("s"), e["len"].alias("len"))))
        tokens = F.sort_array(F.transform(used, lambda e: F.struct(e["s"].alias("s"), (F.coalesce(e["id"], F.lit(-1)) + 1).alias("id"))))
    else:
        top = pieces.agg(F.max("place"), F.max("id")).first()
        pk = _Packing(int(top[0]), int(top[1]) + 1)
        none = F.lit(0).cast("bigint")
        found = F.col("id").isNotNull()
        packed = pk.pack(F.when(found, F.col("place")).otherwise(none), F.col("s"), F.col("len"), F.when(found & F.col("again"), 1).otherwise(0), F.when(found, F.col("id") + 1).otherwise(0))
        end = F.col("s") + F.col("len")
        # the bits mean something for short chunks only
        edge = F.struct(
            packed.alias("e"),
            _bit(F.col("s")).bitwiseOR(_bit(end)).alias("ends"),
            F.when(end <= WORD_CHARS, _bit(end) - _shift(2, F.col("s"))).otherwise(none).alias("inner"),
            F.when(found & F.col("again"), F.lit(_SIGN)).otherwise(none).alias("over"),
        )
        grouped = _edges(hit, own, edge).withColumn("n", F.length("chunk"))
        short = F.col("n") <= WORD_CHARS
        multi = F.filter("edges", lambda e: e["inner"] != 0)
        spans = F.transform(F.filter("edges", lambda e: pk.len(e["e"]) > 1), lambda e: F.struct(pk.s(e["e"]).alias("s"), pk.len(e["e"]).alias("len"), (pk.again(e["e"]) == 1).alias("again")))
        grouped = grouped.withColumn("multi", F.when(short, multi)).withColumn("spans", F.when(~short, spans))
        grouped = grouped.withColumn("cuts", F.when(F.col("multi").isNotNull(), _merge_fold(F.col("multi"), F.col("n")))).withColumn("wide", F.when(F.col("spans").isNotNull(), _merge_fold_long(F.col("spans"), F.col("n"))))
        c = F.col("cuts")
        on_path = lambda e: c.bitwiseAND(e["ends"].bitwiseOR(e["inner"])) == e["ends"]
        on_wide = lambda e: _window(F.col("wide"), pk.s(e["e"])).bitwiseAND(_shift(2, pk.len(e["e"])) - 1) == _bit(pk.len(e["e"])) + 1
        # named twice, so that the optimizer does not move the fold into the lambda
        used = F.when(c.isNotNull(), F.filter("edges", on_path)).otherwise(F.filter("edges", on_wide))
        # starts above ids, so the tokens sort as numbers
        tokens = F.sort_array(F.transform(used, lambda e: F.shiftleft(pk.s(e["e"]).cast("bigint"), 32).bitwiseOR(pk.id(e["e"]).cast("bigint"))))
        tokens = F.transform(tokens, lambda x: F.struct(F.shiftright(x, 32).cast("int").alias("s"), x.bitwiseAND(F.lit(2**32 - 1)).cast("int").alias("id")))
    spelt = lambda x: F.when(x["id"] > 0, F.array(x["id"] - 1)).otherwise(_byte_ids(F.substring(F.col("chunk"), x["s"] + 1, F.lit(1)), byte_base))
    done = grouped.withColumn("tokens", tokens)
    t = F.col("tokens")
    plain = F.forall(t, lambda x: x["id"] > 0)
    return done.select(*own, F.when(plain, F.transform(t, lambda x: x["id"] - 1)).otherwise(F.flatten(F.transform(t, spelt))).alias("ids"))


def frequent_chunks(counts: DataFrame, most: int) -> tuple[DataFrame, int]:
    """Chunks whose count reaches the least class of counts that leaves at most ``most`` of them, and how many other chunks texts hold.

    Classes are steps of the count's logarithm, so the driver sees some hundred numbers.
    """
    step = F.floor(F.log2("n") * 8).cast("int")
    rows = counts.groupBy(F.col("chunk").isNull().alias("every"), step.alias("step")).agg(F.count("*").alias("chunks"), F.sum("n").alias("n")).collect()
    least, total = None, 0
    for r in sorted((r for r in rows if not r.every), key=lambda r: -r.step):
        if total + r.chunks > most:
            break
        total, least = total + r.chunks, r.step
    spare = sum(r.n for r in rows if r.every) - sum(r.n for r in rows if not r.every and least is not None and r.step >= least)
    kept = counts.where(F.col("chunk").isNotNull() & ((step >= least) if least is not None else F.lit(False)))
    return kept.select("chunk"), spare


def encode(docs: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", fold: str = "merge", frequent: int = FREQUENT) -> DataFrame:
    """``(doc_id, ids)``: the token ids of each whole text, one row per input row.

    Null and empty texts have no ids.  Repeated rows and null ids stay; an empty table gives no
    rows; other columns are ignored; the id keeps its type.
    """
    spark = docs.sparkSession
    model = Model(model_file)
    kind = np.dtype("<u2" if model.size <= 1 << 16 else "<u4")
    pieces = piece_table(spark, model.pieces, fold)
    # the same in every scan; rows of the same id and text share their chunks
    base = docs.select(F.xxhash64(F.col(doc_id), F.col(text)).alias("k"), F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    counts = materialise(chunk_counts(base, model.chunk), "chunks")
    top, spare = frequent_chunks(counts, frequent)
    n = top.count()
    folded = materialise(encode_chunks(top.repartition(max(1, -(-n // CHUNKS_A_PARTITION)), "chunk"), pieces, model.longest, model.byte_base, fold), "lattice")
    remove(counts)
    held = _published(folded, kind)
    pattern = model.chunk

    def parts(batches):
        """Texts with their chunks' entries in the table, -1 for those it does not hold."""
        table = held()
        for batch in batches:
            for part in _slices(batch):
                raw, cuts = text_bytes(prepared(part.column("text")))
                starts = chunk_starts(raw, cuts, pattern)
                lengths = np.diff(starts, append=len(raw)) if len(starts) else starts
                entries = table.find(hashes(raw, starts, lengths))
                hit = np.nonzero(entries >= 0)[0]
                entries[hit[~table.same(entries[hit], raw, starts[hit], lengths[hit])]] = -1
                yield table, part, raw, starts, lengths, entries, np.searchsorted(starts, cuts)

    def rare(batches):
        """The chunks that the table lacks, one row a text; a task names a text once."""
        seen: set[int] = set()
        for _, part, raw, starts, lengths, entries, cuts in parts(batches):
            k = part.column("k").to_pylist()
            fresh = np.zeros(len(k), bool)
            for i, x in enumerate(k):
                fresh[i] = x not in seen
                seen.add(x)
            at = np.nonzero(entries < 0)[0]
            doc = np.searchsorted(cuts, at, side="right") - 1
            at, doc = at[fresh[doc]], doc[fresh[doc]]
            some, n = np.unique(doc, return_counts=True)
            offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("k").take(pa.array(some)), pa.ListArray.from_arrays(offsets, _strings(raw, starts[at], lengths[at]))], ["k", "chunks"])

    def zipped(batches):
        for batch in batches:
            texts = batch.column("text")
            packed = pa.array([zstandard.compress(x.as_buffer(), 3) if len(x.as_buffer()) else b"" for x in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), packed], ["k", "doc_id", "text"])

    def unzipped(batches):
        for batch in batches:
            raw = (x.as_buffer() for x in batch.column("text"))
            texts = pa.array([zstandard.decompress(x) if len(x) else b"" for x in raw], pa.large_binary()).cast(pa.large_utf8())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), texts, batch.column("own")], ["doc_id", "text", "own"])

    def assemble(batches):
        for table, part, raw, starts, lengths, entries, cuts in parts(unzipped(batches)):
            known = entries >= 0
            ids, n = table.gather(entries[known])
            lists = []
            at = np.nonzero(~known)[0]
            if len(at):
                doc = np.searchsorted(cuts, at, side="right") - 1
                own = {int(i): {r["chunk"]: r["ids"] for r in part.column("own")[int(i)].as_py()} for i in np.unique(doc)}
                lists = [own[d][c] for d, c in zip(doc.tolist(), _strings(raw, starts[at], lengths[at]).to_pylist(), strict=True)]
            each = np.zeros(len(entries), np.int64)
            each[known], each[at] = n, [len(x) for x in lists]
            ends = np.concatenate([[0], np.cumsum(each)])
            out = np.empty(ends[-1], np.int32)
            out[spread(ends[:-1][known], n)] = ids
            if len(at):
                out[spread(ends[at], each[at])] = np.fromiter((i for x in lists for i in x), np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(ends[cuts].astype(np.int32), pa.array(out))], ["doc_id", "ids"])

    deal = max(1, -(-spare // CHUNKS_A_PARTITION))
    scattered = base.select("k", "text").mapInArrow(rare, "k bigint, chunks array<string>").repartition(deal, "k").dropDuplicates(["k"])
    scattered = scattered.select("k", F.explode(F.array_distinct("chunks")).alias("chunk"))
    own = encode_chunks(scattered, pieces, model.longest, model.byte_base, fold, ("k",)).groupBy("k").agg(F.collect_list(F.struct("chunk", "ids")).alias("own"))
    id_type = base.schema["doc_id"].dataType.simpleString()
    texts = base.mapInArrow(zipped, f"k bigint, doc_id {id_type}, text binary")
    # own comes from explodes, which Spark sizes as their input
    return texts.join(own.hint("merge"), "k", "left").select("doc_id", "text", "own").mapInArrow(assemble, f"doc_id {id_type}, ids array<int>")


def _published(folded: DataFrame, kind: np.dtype) -> Callable[[], ChunkTable]:
    """How a worker gets the lookup table of chunks and their ids: from the files of ``folded``, which nothing but workers opens.

    Where Arrow does not know the shared folder's address the table goes through the driver as a broadcast.
    """
    files = tuple(folded.inputFiles())
    try:
        for f in files[:1]:
            pyarrow.fs.FileSystem.from_uri(f)
        room = tuple(folded.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("chunk")), F.lit(0)), F.coalesce(F.sum(F.size("ids")), F.lit(0))).first())
        return lambda: _read_table(files, kind, room)
    except (pa.ArrowException, OSError):
        known = folded.sparkSession.sparkContext.broadcast(_table(folded.toArrow().to_batches(), ChunkTable(kind)).state())
        remove(folded)
        return lambda: ChunkTable.of(known.value)


#: The table that this worker has read last, by its files.
_held: dict[tuple[str, ...], ChunkTable] = {}


def _read_table(files: tuple[str, ...], kind: np.dtype, room: tuple[int, int, int]) -> ChunkTable:
    """The table of these Parquet files, some rows at a time, into room for so many chunks, bytes and ids; a Python worker reads it once and keeps no other."""

    def batches():
        for f in files:
            fs, path = pyarrow.fs.FileSystem.from_uri(f)
            with fs.open_input_file(path) as source:
                yield from pq.ParquetFile(source).iter_batches(READ_ROWS, columns=["chunk", "ids"], use_threads=False)

    if files not in _held:
        _held.clear()
        table = ChunkTable(kind)
        table.reserve(*room)
        _held[files] = _table(batches(), table)
        pa.default_memory_pool().release_unused()
    return _held[files]


def _table(batches: Iterable[pa.RecordBatch], table: ChunkTable) -> ChunkTable:
    """The lookup table with chunks and their ids added."""
    for batch in batches:
        if batch.num_rows:
            raw, cuts = text_bytes(batch.column("chunk"))
            ids, starts = batch.column("ids"), cuts[:-1]
            lengths = np.diff(cuts)
            h, first = np.unique(hashes(raw, starts, lengths), return_index=True)
            # of chunks with one hash the first is found, the others go the rare chunks' way
            fresh = table.find(h) < 0
            h, first = h[fresh], first[fresh]
            offsets = ids.offsets.to_numpy()
            n = np.diff(offsets)[first].astype(np.int64)
            flat = ids.values.to_numpy(zero_copy_only=False)[spread(offsets[:-1][first].astype(np.int64), n)].astype(table.kind)
            table.add(h, raw[spread(starts[first], lengths[first])], lengths[first], flat, n)
    return table


def decode_column(ids: Column, model: Model) -> Column:
    """The text of an array of ids: each piece's bytes in hexadecimal, looked up by position, joined and read as UTF-8."""
    # one folded literal: an array of as many literals would burden the optimizer
    table = F.split(F.lit(" ".join(b.hex() for b in model.decoded)), " ")
    whole = F.decode(F.unhex(F.array_join(F.transform(ids, lambda i: F.get(table, i)), "")), "UTF-8")
    return F.regexp_replace(whole, "^ ", "")


def decode(coded: DataFrame, model_file: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Add the decoded text of an id array; null ids give null, no ids the empty text."""
    return coded.withColumn(out, decode_column(F.col(ids), Model(model_file)))


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_piece_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document as a digest, and the digest of the text that they decode to."""
    path = model_path()
    coded = encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return decode(coded, path).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.crc32(F.array_join("ids", " ")).alias("ids_crc32"), F.sha2(F.col("text").cast("binary"), 256).alias("decoded_sha256"))
