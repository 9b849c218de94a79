"""Token ids in sorted-string-table shards.

A shard holds documents in ascending id order.  Its parts, all little-endian:

* data blocks: entries of (shared u8, rest u8, key bytes, ids u32, id bytes), where a key
  repeats only what differs from the key before; the first of a block is whole; a CRC-32
  ends the block;
* sparse index: for each block its first key, offset, length, ids before it in the shard;
* Bloom filter over the keys;
* footer of fixed length: places and lengths of index and filter, counts, id width, CRC-32, magic.

A key is one byte (0: null id, 1: an id) and the id big-endian with its sign bit turned, so
bytes order as ids do, null first.  A lookup reads footer, filter and index, and then one block.
Ids take two bytes each where the vocabulary allows, else four.
"""

from __future__ import annotations

import bisect
import os
import re
import struct
import uuid
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonlark.llm.ragged import ChunkTable, hashes, spread, sums, text_bytes
from seasonlark.scratch import materialise, new_path

MAGIC = b"SLTOKSST"
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOT = struct.Struct("<QQQQQQBI8s")
_INDEX = struct.Struct("<B9sQQQQ")
#: Distinct chunks whose ids a worker remembers at most; it starts afresh beyond.
CACHE_WORDS = 1_500_000


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (int(doc_id) + (1 << 63)) & (2**64 - 1))


def id_of(key: bytes) -> int | None:
    return None if key[:1] == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh64_intdigest(key)
    a, b = h & 0xFFFFFFFF, h >> 32 | 1
    return [(a + i * b) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries, which must come in ascending key order, to a stream."""

    def __init__(self, out, width: int):
        self.out, self.width = out, width
        self.at = self.docs = self.ids = 0
        self.block, self.block_first, self.block_ids, self.last = bytearray(), b"", 0, b""
        self.index, self.keys = [], []

    def add(self, key: bytes, values: bytes) -> None:
        if key < self.last:
            raise ValueError("keys must ascend")
        if not self.block:
            self.block_first, self.block_ids, shared = key, self.ids, 0
        else:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        n = len(values) // self.width
        self.block += struct.pack("<BB", shared, len(key) - shared) + key[shared:] + struct.pack("<I", n) + values
        self.keys.append(xxhash.xxh64_intdigest(key))
        self.last, self.docs, self.ids = key, self.docs + 1, self.ids + n
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            raw = bytes(self.block) + struct.pack("<I", zlib.crc32(self.block))
            self.index.append(_INDEX.pack(len(self.block_first), self.block_first, self.at, len(raw), self.block_ids, 0))
            self.out.write(raw)
            self.at += len(raw)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(self.index)
        bits = max(64, self.docs * BLOOM_BITS)
        h = np.array(self.keys, np.uint64)
        a, b = h & np.uint64(0xFFFFFFFF), h >> np.uint64(32) | np.uint64(1)
        flags = np.zeros(bits + -bits % 8, bool)
        for i in range(BLOOM_HASHES):
            flags[((a + np.uint64(i) * b) % np.uint64(bits)).astype(np.int64)] = True
        bloom = np.packbits(flags, bitorder="little").tobytes()
        self.out.write(index + bloom)
        self.out.write(_FOOT.pack(self.at, len(index), self.at + len(index), bits, self.docs, self.ids, self.width, zlib.crc32(index + bloom), MAGIC))


class ShardReader:
    """Reads one shard: all entries in order, or those of a key."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(size - _FOOT.size)
        index_at, index_len, bloom_at, self.bits, self.docs, self.ids, self.width, crc, magic = _FOOT.unpack(source.read(_FOOT.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        source.seek(index_at)
        raw = source.read(size - _FOOT.size - index_at)
        if zlib.crc32(raw) != crc:
            raise ValueError("damaged index")
        self.bloom = raw[bloom_at - index_at :]
        rows = [_INDEX.unpack_from(raw, i) for i in range(0, index_len, _INDEX.size)]
        self.firsts = [r[1][: r[0]] for r in rows]
        self.blocks = [(r[2], r[3], r[4]) for r in rows]

    def block(self, i: int):
        """Entries (key, ids before it in the shard, id bytes) of block i."""
        at, length, before = self.blocks[i]
        self.source.seek(at)
        raw = self.source.read(length)
        if zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
            raise ValueError("damaged block")
        p, key = 0, b""
        while p < length - 4:
            shared, rest = raw[p], raw[p + 1]
            key = key[:shared] + raw[p + 2 : p + 2 + rest]
            p += 2 + rest
            n = struct.unpack_from("<I", raw, p)[0]
            p += 4
            yield key, before, raw[p : p + n * self.width]
            p += n * self.width
            before += n

    def __iter__(self):
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, key: bytes) -> list[bytes]:
        """Id bytes of every entry of a key."""
        if not all(self.bloom[j >> 3] >> (j & 7) & 1 for j in _bloom_places(key, self.bits)):
            return []
        out, i = [], max(0, bisect.bisect_left(self.firsts, key) - 1)
        while i < len(self.blocks) and self.firsts[i] <= key:
            out += [v for k, _, v in self.block(i) if k == key]
            i += 1
        return out


class Encoder:
    """Encodes whole texts with the tokenizers library, chunks that were met before from memory.

    The vocabulary's pre-tokenizer starts a new piece at every single space and at every
    single line feed between other characters, and inside such a word wherever letters, digits
    and other characters meet, so such texts are the sum of these chunks.  A word with an
    apostrophe or a character beyond Latin-1 letters is one chunk.  A text with any other white
    space is encoded in one go, and so is a text that holds an added token's string, which the
    library takes out before it splits.
    """

    _odd = re.compile(r"\s\s|[^\S \n]")

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.type = np.dtype("<u2" if self.tok.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.type).tobytes()
        (self.line,) = self.tok.encode("\n", add_special_tokens=False).ids
        self.known = ChunkTable(self.type)

    def _whole(self, texts: pa.Array, raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
        """Which texts the library has to take in one go."""
        kind = _KINDS[raw]
        space = (kind == _SPACE) | (kind == _LINE)
        twice = space.copy()
        twice[1:] &= space[:-1]
        twice[cuts[:-1][cuts[:-1] < len(raw)]] = False
        whole = sums(twice | (kind == _WHITE), cuts) > 0
        for token in self.added:
            whole |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        # white space beyond ASCII begins with one of these bytes
        for i in np.nonzero(~whole & (sums(np.isin(raw, _WIDE_SPACE), cuts) > 0))[0].tolist():
            whole[i] = bool(self._odd.search(texts[i].as_py()))
        return whole

    def _learn(self, h: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, listed: bool = True) -> np.ndarray:
        """Encode new chunks, line feeds between them, and return their entries."""
        words = [raw[a : a + n].tobytes().decode() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        lists = ["\n".join(words[i : i + 64]) for i in range(0, len(words), 64)]
        ids = []
        for i in range(0, len(lists), 64):
            for e in self.tok.encode_batch_fast(lists[i : i + 64], add_special_tokens=False):
                ids += e.ids
                ids.append(self.line)
        flat = np.array(ids, np.uint32)
        ends = np.nonzero(flat == self.line)[0]
        n = np.diff(ends, prepend=-1) - 1
        return self.known.add(h, raw[spread(starts, lengths)], lengths, flat[flat != self.line].astype(self.type), n, listed)

    def _ids(self, raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the chunks that begin at ``starts``, and how many each has."""
        lengths = np.diff(starts, append=len(raw))
        h = hashes(raw, starts, lengths)
        line = raw[starts] == 10
        entries = self.known.find(h)
        entries[line] = 0
        new = np.nonzero(entries < 0)[0]
        if len(new):
            _, first = np.unique(h[new], return_index=True)
            first = new[first]
            self._learn(h[first], raw, starts[first], lengths[first])
            entries[new] = self.known.find(h[new])
        odd = np.nonzero(~line & ~self.known.same(entries, raw, starts, lengths))[0]
        if len(odd):
            entries[odd] = self._learn(h[odd], raw, starts[odd], lengths[odd], listed=False)
        return self.known.gather(entries)

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Id bytes of each text with the end id."""
        texts = pa.array(texts, pa.large_utf8()) if isinstance(texts, list) else texts.cast(pa.large_utf8())
        if not self.known.size or self.known.size > CACHE_WORDS:
            self.known = ChunkTable(self.type)
            # entry 0 is the line feed, which parts the words of a list
            self.known.add(np.zeros(1, np.uint64), np.array([10], np.uint8), np.ones(1, np.int64), np.array([self.line], self.type), np.ones(1, np.int64), listed=False)
        raw, cuts = text_bytes(texts)
        whole = self._whole(texts, raw, cuts)
        out: list[bytes] = [b""] * len(texts)
        at = np.nonzero(whole)[0].tolist()
        for i in range(0, len(at), 64):
            some = at[i : i + 64]
            for j, e in zip(some, self.tok.encode_batch_fast(texts.take(pa.array(some)).to_pylist(), add_special_tokens=False), strict=True):
                out[j] = np.array(e.ids, self.type).tobytes()
        rest = np.nonzero(~whole)[0]
        if len(rest):
            raw, cuts = text_bytes(texts.take(pa.array(rest)) if len(at) else texts)
            starts = _chunk_starts(raw, cuts)
            if len(starts):
                ids, n = self._ids(raw, starts)
                total = np.concatenate([[0], np.cumsum(n)])
                ends = total[np.searchsorted(starts, cuts)]
                for i, a, b in zip(rest.tolist(), ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                    out[i] = ids[a:b].tobytes()
        return [x + self.end for x in out]


_LETTER, _DIGIT, _OTHER, _SPACE, _LINE, _WHITE = range(6)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
_KINDS[48:58] = _DIGIT
_KINDS[32], _KINDS[10] = _SPACE, _LINE
_KINDS[[9, 11, 12, 13, 28, 29, 30, 31]] = _WHITE
#: First bytes of white space beyond ASCII in UTF-8.
_WIDE_SPACE = np.array([0xC2, 0xE1, 0xE2, 0xE3], np.uint8)


def _chunk_starts(raw: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where the chunks of texts begin that hold single spaces and line feeds only."""
    if not len(raw):
        return np.empty(0, np.int64)
    kind = _KINDS[raw]
    before = np.empty_like(kind)
    before[0], before[1:] = _LINE, kind[:-1]
    start = (kind == _SPACE) | (kind == _LINE) | (before == _LINE)
    start[cuts[:-1][cuts[:-1] < len(raw)]] = True
    words = np.nonzero(start)[0]
    # beyond ASCII only the letters from U+00C0 to U+00FF but U+00D7 and U+00F7 are split off: C3 and one more byte
    odd = (raw == 39) | (raw < 32) & (kind == _OTHER) | (raw == 127)
    high = raw >= 128
    if high.any():
        lead = raw == 0xC3
        follows = np.concatenate([[False], lead[:-1]])
        odd |= high & ~lead & ~(follows & (raw != 0x97) & (raw != 0xB7))
    inner = (kind != before) & (before != _SPACE) & ~start
    if odd.any():
        inner &= ~np.repeat(np.logical_or.reduceat(odd, words), np.diff(words, append=len(raw)))
    return np.nonzero(start | inner)[0]


@cache
def encoder(path: str, end_id: int) -> Encoder:
    """One encoder for all tasks of a Python worker."""
    return Encoder(path, end_id)


def _slices(sizes: np.ndarray, most: int = 4_000_000):
    """Ranges of about so many bytes."""
    start = size = 0
    for i, n in enumerate(sizes.tolist()):
        size += n
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def write_shards(docs: DataFrame, folder: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Encode every text, write shards under ``folder`` and return their manifest.

    Manifest: (shard, path, n_docs, n_ids), one row per file, shards in ascending id order.
    Each attempt of a task writes a file of its own name; only those of finished tasks are
    listed, so lost executors leave no half-written shard in the result.  Null texts are
    empty, null ids come first, repeated ids stay side by side.
    """

    def write(batches):
        enc = fs = stream = writer = path = None
        first = None
        for f in batches:
            if not f.num_rows:
                continue
            if writer is None:
                enc = encoder(tokenizer, end_id)
                fs, base = pyarrow.fs.FileSystem.from_uri(folder)
                fs.create_dir(base, recursive=True)
                path = f"{base}/{uuid.uuid4().hex}.sst"
                stream = fs.open_output_stream(path)
                writer = ShardWriter(stream, enc.type.itemsize)
                first = f.column("rank")[0].as_py()
            texts, keys = f.column("text"), f.column("id").to_pylist()
            for a, b in _slices(pc.binary_length(texts).to_numpy(zero_copy_only=False)):
                for k, v in zip(keys[a:b], enc.encode(texts.slice(a, b - a)), strict=True):
                    writer.add(key_of(k), v)
        if writer is not None:
            writer.close()
            stream.close()
            row = [[first], [path], [writer.docs], [writer.ids]]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["shard", "path", "n_docs", "n_ids"])

    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = base.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), F.xxhash64("text"))
    ordered = ordered.withColumn("rank", F.spark_partition_id())
    return materialise(ordered.mapInArrow(write, "shard int, path string, n_docs bigint, n_ids bigint"), "manifest")


def _shard_list(manifest: DataFrame) -> list[tuple[str, int]]:
    """(path, ids before the shard) in order; one entry per file."""
    out, before = [], 0
    for r in manifest.orderBy("shard").collect():
        out.append((r.path, before))
        before += r.n_ids
    return out


def read_shards(spark: SparkSession, manifest: DataFrame, folder: str, ids: bool = True) -> DataFrame:
    """Every document of the shards: ``(doc_id, start, n_tokens, ids_crc32[, ids])``.

    start counts the ids of all documents before; ids_crc32 is over the ids as unsigned
    32-bit little-endian integers, end id included.  Order among repeated ids is by a hash
    of their text.
    """
    shards = _shard_list(manifest)
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * ids

    def read(frames):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for f in frames:
            for path, before in zip(f["path"], f["before"], strict=True):
                with fs.open_input_file(path) as source:
                    shard = ShardReader(source)
                    kind = np.dtype("<u2" if shard.width == 2 else "<u4")
                    for i in range(len(shard.blocks)):
                        rows = [(id_of(k), before + at, np.frombuffer(v, kind).astype("<u4")) for k, at, v in shard.block(i)]
                        out = pd.DataFrame(
                            {
                                "doc_id": pd.array([r[0] for r in rows], "Int64"),
                                "start": [r[1] for r in rows],
                                "n_tokens": [len(r[2]) for r in rows],
                                "ids_crc32": [zlib.crc32(r[2].tobytes()) for r in rows],
                            }
                        )
                        if ids:
                            out["ids"] = [r[2].astype(np.int32) for r in rows]
                        yield out

    files = spark.createDataFrame(shards, "path string, before bigint")
    return files.repartition(max(1, len(shards)), "path").mapInPandas(read, schema)


def lookup(spark: SparkSession, manifest: DataFrame, folder: str, keys: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """``(doc_id, ids)`` of each key that some shard holds, by filter, sparse index and one block each.

    Keys are dealt to the shards whose range holds them, and each shard is opened once a task.
    """

    def bounds(frames):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for f in frames:
            for path in f["path"]:
                with fs.open_input_file(path) as source:
                    s = ShardReader(source)
                    last = [k for k, _, _ in s.block(len(s.blocks) - 1)][-1]
                    yield pd.DataFrame({"path": [path], "low": [s.firsts[0]], "high": [last]})

    ranges = manifest.select("path").mapInPandas(bounds, "path string, low binary, high binary").collect()

    def deal(frames):
        for f in frames:
            rows = [(None if pd.isna(k) else int(k), r["path"]) for k in f["doc_id"] for r in ranges if r["low"] <= key_of(None if pd.isna(k) else int(k)) <= r["high"]]
            yield pd.DataFrame({"doc_id": pd.array([r[0] for r in rows], "Int64"), "path": [r[1] for r in rows]})

    def find(frames):
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        for f in frames:
            for path, own in f.groupby("path"):
                with fs.open_input_file(path) as source:
                    s = ShardReader(source)
                    kind = np.dtype("<u2" if s.width == 2 else "<u4")
                    hits = [(k, np.frombuffer(v, kind).astype(np.int32)) for k in (None if pd.isna(x) else int(x) for x in own["doc_id"]) for v in s.get(key_of(k))]
                yield pd.DataFrame({"doc_id": pd.array([h[0] for h in hits], "Int64"), "ids": [h[1] for h in hits]})

    dealt = keys.select(F.col(doc_id).cast("bigint").alias("doc_id")).distinct().mapInPandas(deal, "doc_id bigint, path string")
    return dealt.repartition("path").mapInPandas(find, "doc_id bigint, ids array<int>")


def op9_token_shards(spark, sf_dir: str) -> DataFrame:
    """Write every document's ids to shards and report what the files hold."""
    import public_tokenizers

    folder = new_path(spark, "shards")
    manifest = write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_shards(spark, manifest, folder, ids=False)
