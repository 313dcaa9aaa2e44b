"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut by the tokenizer's pattern.  Tier 1: a minimal perfect hash over the vocabulary resolves a pre-token that
is a whole entry; the entry's own bytes settle whether it is.  Tier 2: all other pre-tokens are merged bottom up, with a
heap of adjacent pairs over a linked list of bytes, in O(n log n).  A bounded memo in front of both holds what a task
has resolved before.

The driver reads the rank file and broadcasts it with the hash: its size is that of the vocabulary, not of the data.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Pre-tokens that a task remembers before it forgets them all, and characters of one: longer ones are encoded anew.
MEMO, MEMO_CHARS = 400_000, 64


def load_ranks(path: str) -> list[bytes]:
    """The entries of a rank file in order of their ids, which have to be 0, 1, 2 ..."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file.read().splitlines() if line]
    ranks = {int(b): base64.b64decode(a) for a, b in pairs}
    if sorted(ranks) != list(range(len(pairs))):
        raise ValueError("ids are not 0, 1, 2 ...")
    return [ranks[i] for i in range(len(ranks))]


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys on n slots, one displacement a bucket of about three keys."""

    def __init__(self, keys: list[bytes]):
        self.n, self.buckets = len(keys), max(1, len(keys) // 3)
        groups: dict[int, list[tuple[int, int, int]]] = {}
        for i, key in enumerate(keys):
            bucket, a, b = self._parts(key)
            groups.setdefault(bucket, []).append((a, b, i))
        self.shift, self.slots = [0] * self.buckets, [-1] * self.n
        free = None
        for bucket, group in sorted(groups.items(), key=lambda x: -len(x[1])):
            if len(group) == 1:  # the last buckets take what is left: a negative shift names the slot
                free = free or iter([i for i, x in enumerate(self.slots) if x < 0])
                slot = next(free)
                self.shift[bucket], self.slots[slot] = -slot - 1, group[0][2]
                continue
            d = 0
            while True:
                at = [self._slot(a, b, d) for a, b, _ in group]
                if len(set(at)) == len(at) and all(self.slots[x] < 0 for x in at):
                    break
                d += 1
                if d > 10_000_000:
                    raise ValueError("keys repeat")
            self.shift[bucket] = d
            for x, (_, _, i) in zip(at, group, strict=True):
                self.slots[x] = i

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, h >> 32 & 0xFFFFFFFF, h >> 64

    def _slot(self, a: int, b: int, d: int) -> int:
        x = (b ^ a * (2 * d + 1)) * 0xFF51AFD7ED558CCD & 0xFFFFFFFFFFFFFFFF
        return (x ^ x >> 33) % self.n

    def find(self, key: bytes) -> int:
        """The id of ``key`` if it is a key; some other key's id if not."""
        h = xxhash.xxh3_128_intdigest(key)
        d = self.shift[(h & 0xFFFFFFFF) % self.buckets]
        if d < 0:
            return self.slots[-d - 1]
        return self.slots[self._slot(h >> 32 & 0xFFFFFFFF, h >> 64, d)]


class Codec:
    """Encodes and decodes with one vocabulary; ``pattern`` cuts texts."""

    def __init__(self, entries: list[bytes], pattern: str, hashed: PerfectHash | None = None):
        self.entries, self.pattern = entries, pattern
        self.hashed = hashed or PerfectHash(entries)
        self.ranks = {x: i for i, x in enumerate(entries)}  # for the merges; whole pre-tokens go by the perfect hash
        self.kept: Encoder | None = None

    def __reduce__(self):
        return Codec, (self.entries, self.pattern, self.hashed)

    def whole(self, piece: bytes) -> int:
        """The id of a pre-token that is an entry, or -1."""
        i = self.hashed.find(piece)
        return i if self.entries[i] == piece else -1

    def merge(self, piece: bytes) -> list[int]:
        """Ids of ``piece`` by merging, always the pair of the lowest rank, of equal ones the leftmost."""
        n, rank, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        end, before, after = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := rank(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = pop(heap)
            j = after[i] if end[i] else n
            if j >= n or end[j] != stop:  # one of the two has been merged since
                continue
            end[i], end[j] = stop, 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := rank(piece[i : end[k]])) is not None:
                    push(heap, (r, i, end[k]))
            k = before[i]
            if k >= 0 and (r := rank(piece[k:stop])) is not None:
                push(heap, (r, k, stop))
        out, i = [], 0
        while i < n:
            out.append(rank(piece[i : end[i]]))
            i = after[i]
        if None in out:
            raise ValueError("the vocabulary lacks a byte")
        return out

    def pieces(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: itself if it is an entry, else what merging gives."""
        i = self.whole(piece)
        return [i] if i >= 0 else self.merge(piece)

    def encoder(self) -> Encoder:
        return Encoder(self)

    def shared_encoder(self) -> Encoder:
        """One encoder for all tasks that a worker process runs with this codec: its memo, which is bounded, goes on."""
        if self.kept is None:
            self.kept = Encoder(self)
        return self.kept

    def decode(self, ids) -> bytes:
        return b"".join(map(self.entries.__getitem__, ids))


class Memo(dict):
    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, token: str) -> bytes:
        ids = self.codec.pieces(token.encode())
        out = struct.pack(f"<{len(ids)}I", *ids)
        if len(token) <= MEMO_CHARS:
            if len(self) >= MEMO:
                self.clear()
            self[token] = out
        return out


class Encoder:
    def __init__(self, codec: Codec):
        self.cut, self.memo = regex.compile(codec.pattern).findall, Memo(codec)

    def __call__(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return b"".join(map(self.memo.__getitem__, self.cut(text)))


def _shared(docs: DataFrame, path: str, pattern: str):
    return docs.sparkSession.sparkContext.broadcast(Codec(load_ranks(path), pattern))


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``id_col`` and ``ids`` (array of long) of each row.  Null text counts as empty and has no ids.

    Repeated rows come out repeated; a very long text is encoded whole; other columns are not read and may have any name;
    an empty table gives an empty result.
    """
    held, kind = _shared(docs, path, pattern), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = held.value.shared_encoder()
        for batch in batches:
            raw = [code(x.as_py() or "") for x in batch.column(1)]
            ids = pa.array(np.frombuffer(b"".join(raw), dtype="<u4").astype(np.int64))
            ends = pa.array(np.cumsum([0, *(len(x) // 4 for x in raw)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, ids)], ["_id", "ids"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, ids array<bigint>").withColumnRenamed("_id", id_col)


def decode(coded: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``id_col`` and ``bytes`` of each row of ids.  Null ids give no bytes; an id outside the vocabulary fails.

    Repeated rows come out repeated; a very long list is decoded whole; other columns are not read and may have any name;
    an empty table gives an empty result.
    """
    held, kind = _shared(coded, path, pattern), dict(coded.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.decode(x.as_py() or ()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["_id", "bytes"])

    return coded.select(F.col(id_col).alias("_id"), F.col(ids).alias("_ids")).mapInArrow(run, f"_id {kind}, bytes binary").withColumnRenamed("_id", id_col)


def digest(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a document: ``id_col, n_tokens, ids_sha256, decoded_sha256``; nothing is shuffled.

    The ids are those of an encoder without special tokens; their bytes are decoded from the ids alone.  Null text
    counts as empty: no tokens.  Repeated rows come out repeated; other columns are not read; an empty table gives an
    empty result.  Memory: one text at a time, its ids, and the memo.
    """
    held, kind = _shared(docs, path, pattern), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = held.value
        code = codec.shared_encoder()
        for batch in batches:
            n, ids, texts = [], [], []
            for x in batch.column(1):
                raw = code(x.as_py() or "")
                n.append(len(raw) // 4)
                ids.append(hashlib.sha256(raw).hexdigest())
                texts.append(hashlib.sha256(codec.decode(np.frombuffer(raw, dtype="<u4").tolist())).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("_id", id_col)
