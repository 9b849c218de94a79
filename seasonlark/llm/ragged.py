"""Chunks of whole Arrow batches as byte ranges of one buffer, and a table that maps them to ids.

Tokenisers cut texts into millions of short chunks.  Here a chunk is a start and a length in
the batch's own bytes, so hashing, looking up and gathering are numpy operations over
the whole batch and no chunk becomes a Python string unless it is new.  Hashes only
propose: every hit is compared byte by byte before its ids are used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: Longest chunk, in bytes, that the vectorised hash takes; longer ones are hashed one by one.
HASHED_BYTES = 512
_MULTIPLIERS = np.random.default_rng(20).integers(1, 2**63, HASHED_BYTES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and the offsets of its members in them."""
    texts = texts.cast(pa.large_utf8())
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    cuts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8)[cuts[0] : cuts[-1]] if data is not None and cuts[-1] > cuts[0] else np.empty(0, np.uint8)
    return raw, cuts - cuts[0]


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions of all ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def hashes(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of every chunk; the chunks are all of ``raw`` in order, none empty."""
    if not len(starts):
        return np.empty(0, np.uint64)
    place = np.arange(len(raw)) - np.repeat(starts, lengths)
    factor = _MULTIPLIERS[np.minimum(place, HASHED_BYTES - 1)]
    factor *= raw + np.uint64(1)
    out = np.add.reduceat(factor, starts)
    for i in np.nonzero(lengths > HASHED_BYTES)[0].tolist():
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + lengths[i]].tobytes())
    # the sum's low bits are weak where the last bytes are even
    return (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) ^ lengths.astype(np.uint64)


class ChunkTable:
    """Chunks with their ids: hash, bytes and ids in flat arrays under one open-addressing index."""

    def __init__(self, kind: np.dtype, slots: int = 1 << 16):
        self.kind = np.dtype(kind)
        self.size = 0
        self.hash = np.empty(1024, np.uint64)
        self.at, self.length = np.empty(1024, np.int64), np.empty(1024, np.int32)
        self.id_at, self.n_ids = np.empty(1024, np.int64), np.empty(1024, np.int32)
        self.bytes, self.n_bytes = np.empty(1 << 14, np.uint8), 0
        self.ids, self.all_ids = np.empty(1 << 14, self.kind), 0
        self.slots = np.full(slots, -1, np.int32)

    def _slot(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - (len(self.slots).bit_length() - 1))).astype(np.int64)

    def _claim(self, entries: np.ndarray) -> None:
        """Give every entry the first free slot from its own on."""
        mask = len(self.slots) - 1
        at = self._slot(self.hash[entries])
        while len(entries):
            free = self.slots[at] < 0
            self.slots[at[free]] = entries[free]
            lost = self.slots[at] != entries
            entries, at = entries[lost], (at[lost] + 1) & mask

    def find(self, h: np.ndarray) -> np.ndarray:
        """The entry of each hash, or -1."""
        if not self.size:
            return np.full(len(h), -1, np.int32)
        mask = len(self.slots) - 1
        at = self._slot(h)
        out = self.slots[at]
        open_ = np.nonzero((out >= 0) & (self.hash[out] != h))[0]
        while len(open_):
            at[open_] = (at[open_] + 1) & mask
            got = self.slots[at[open_]]
            out[open_] = got
            open_ = open_[(got >= 0) & (self.hash[got] != h[open_])]
        return out

    def _room(self, name: str, need: int) -> None:
        old = getattr(self, name)
        if need > len(old):
            new = np.empty(max(need, 2 * len(old)), old.dtype)
            new[: len(old)] = old
            setattr(self, name, new)

    def add(self, h: np.ndarray, raw: np.ndarray, lengths: np.ndarray, ids: np.ndarray, n_ids: np.ndarray, listed: bool = True) -> np.ndarray:
        """Append chunks of distinct new hashes with their ids and return their entries; unlisted ones are never found."""
        n, first = len(h), self.size
        for name in ("hash", "at", "length", "id_at", "n_ids"):
            self._room(name, first + n)
        new = slice(first, first + n)
        self.hash[new], self.length[new], self.n_ids[new] = h, lengths, n_ids
        self.at[new] = self.n_bytes + np.cumsum(lengths) - lengths
        self.id_at[new] = self.all_ids + np.cumsum(n_ids) - n_ids
        self._room("bytes", self.n_bytes + len(raw))
        self.bytes[self.n_bytes : self.n_bytes + len(raw)] = raw
        self._room("ids", self.all_ids + len(ids))
        self.ids[self.all_ids : self.all_ids + len(ids)] = ids
        self.size, self.n_bytes, self.all_ids = first + n, self.n_bytes + len(raw), self.all_ids + len(ids)
        entries = np.arange(first, first + n, dtype=np.int32)
        if listed:
            if 3 * self.size > 2 * len(self.slots):
                kept = self.slots[self.slots >= 0]
                self.slots = np.full(1 << int(3 * self.size // 2).bit_length(), -1, np.int32)
                self._claim(kept)
            self._claim(entries)
        return entries

    def reserve(self, chunks: int, n_bytes: int, ids: int) -> None:
        """Room for so many chunks, bytes and ids in all, so that adding them copies nothing."""
        for names, n in ((("hash", "at", "length", "id_at", "n_ids"), chunks), (("bytes",), n_bytes), (("ids",), ids)):
            for name in names:
                setattr(self, name, np.empty(n, getattr(self, name).dtype))
        self.slots = np.full(max(len(self.slots), 1 << int(3 * chunks // 2).bit_length()), -1, np.int32)

    def same(self, entries: np.ndarray, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Whether each chunk has just the bytes of its entry (entries >= 0)."""
        ok = self.length[entries] == lengths
        if not len(entries):
            return ok
        shared = np.where(ok, lengths, 0)
        rows = np.nonzero(shared)[0]
        n = shared[rows]
        equal = raw[spread(starts[rows], n)] == self.bytes[spread(self.at[entries[rows]], n)]
        if not equal.all():
            ok[rows] &= np.logical_and.reduceat(equal, np.cumsum(n) - n)
        return ok

    def gather(self, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all entries, one after another, and how many each has."""
        n = self.n_ids[entries].astype(np.int64)
        return self.ids[spread(self.id_at[entries], n)], n

    def state(self) -> dict:
        """What to broadcast of a table of listed chunks: places and index follow from it."""
        n = {k: getattr(self, k)[: self.size].astype(np.uint32 if getattr(self, k)[: self.size].max(initial=0) >> 16 else np.uint16) for k in ("length", "n_ids")}
        return {"hash": self.hash[: self.size], **n, "bytes": self.bytes[: self.n_bytes], "ids": self.ids[: self.all_ids]}

    @classmethod
    def of(cls, state: dict) -> ChunkTable:
        """The table of a state; a Python worker builds it once and keeps it there instead of the state's arrays."""
        if "table" not in state:
            table = cls(state["ids"].dtype)
            table.add(state["hash"], state["bytes"], state["length"].astype(np.int64), state["ids"], state["n_ids"].astype(np.int64))
            state.clear()
            state["table"] = table
        return state["table"]


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` between neighbouring cuts; nothing between equal cuts is 0."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return total[cuts[1:]] - total[cuts[:-1]]
