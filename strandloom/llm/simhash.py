"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints within radius r share a variant if each emits all variants within half of r.  The radius here is odd,
3, and rounding its half up would cost 2,081 variants a fingerprint.  Instead the bits are cut into ``blocks``: two
fingerprints that differ in 3 bits differ inside one of the blocks at least, so with that block left out they differ in
2 bits at most, and variants within radius 1 of what is left meet.  A fingerprint emits blocks x (1 + 64 - 64 / blocks)
variants, 196 for four blocks, and keys keep 48 bits, so unrelated fingerprints seldom meet.

Fingerprints are distinct before they emit.  Variants are shuffled and sorted; a task streams over its variants, and
inside one verifies by the full distance.  It emits a star for each linked group, never all pairs.  A variant can hold
no more than 49 x 2^16 distinct fingerprints, whatever the input.  Stars are deduplicated and contracted to components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialize
from strandloom.operators.curate import row_hash
from strandloom.operators.graph import components

SHINGLE, RADIUS, SEED, BLOCKS = 3, 3, 42, 4
#: Bytes of a text that are split into words at a time.
CHUNK = 1 << 20


def _chunks(raw: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a part at a time; cuts fall on white space."""
    at = 0
    while len(raw) - at > CHUNK:
        cut = max(raw.rfind(c, at, at + CHUNK) for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f"))
        if cut <= at:  # one word longer than a part
            cut = min((x for c in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f") if (x := raw.find(c, at + 1)) > 0), default=len(raw))
        yield raw[at:cut].split()
        at = cut
    yield raw[at:].split()


def fingerprint(text: str, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit fingerprint: a bit is set if it is in over half of the shingles' hashes.  No words: zero."""
    hash_of, counts, n = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), 0
    kept: list[bytes] = []
    for words in _chunks(text.encode().lower()):
        words = kept + words
        if len(words) >= shingle:
            ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[: len(words) - shingle] + 1))
            joined = b" ".join(words)
            hashes = np.array([hash_of(joined[a:b], seed) for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)], dtype=np.uint64)
            for i in range(0, len(hashes), 1 << 14):
                counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            n += len(hashes)
            words = words[len(words) - shingle + 1 :]
        kept = words
    if not n and kept:
        n, h = 1, hash_of(b" ".join(kept), seed)
        counts += np.unpackbits(np.array([h], dtype=np.uint64).view(np.uint8), bitorder="little")
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``_id`` and ``fp`` (the fingerprint's bits as a signed long) of each row; null text counts as empty."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.array([fingerprint(x.as_py() or "") for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], ["_id", "fp"])

    return docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """``key, fp`` for each variant of each fingerprint in ``fps`` (column ``fp``).

    A block that is left out holds its own number in the key, so keys of different blocks meet by chance only, and
    verification settles that.
    """
    width = 64 // blocks
    steps = []
    for b in range(blocks):
        out = ((1 << width) - 1) << (b * width)
        mark = (b + 1) << (b * width)
        steps += [F.struct(F.lit(_signed(~out & (1 << 64) - 1)).alias("keep"), F.lit(_signed(mark ^ flip)).alias("flip")) for flip in [0, *(1 << i for i in range(64) if not out >> i & 1)]]
    return fps.select("fp", F.explode(F.array(*steps)).alias("s")).select(F.col("fp").bitwiseAND(F.col("s.keep")).bitwiseXOR(F.col("s.flip")).alias("key"), "fp")


def link(group: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Stars over the linked groups among distinct fingerprints: (smallest, other).

    A search outward from any fingerprint; what it reaches is compared no more, so a group of near copies costs about
    its size, and no pair is kept.
    """
    out, rest = [], np.sort(group)
    while len(rest):
        root, rest = rest[0], rest[1:]
        front, found = np.array([root], dtype=rest.dtype), []
        while len(front) and len(rest):
            step, front = front[:64], front[64:]
            near = (np.bitwise_count(rest[None, :] ^ step[:, None]) <= radius).any(axis=0)
            if near.any():
                found.append(rest[near])
                front, rest = np.concatenate([front, rest[near]]), rest[~near]
        out += [(root, x) for part in found for x in part]
    return out


def _collide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stars of every variant; rows come sorted by variant."""
    key, fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)

    def stars(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sizes = np.diff(np.append(starts, len(key)))
        two = starts[sizes == 2]
        two = two[np.bitwise_count(fp[two] ^ fp[two + 1]) <= RADIUS]
        pairs = [np.stack([fp[two], fp[two + 1]], axis=1)]
        for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
            if found := link(np.unique(fp[s : s + n])):
                pairs.append(np.array(found, dtype=np.uint64))
        pairs = np.concatenate(pairs).view(np.int64)
        pairs.sort(axis=1)
        pairs = np.unique(pairs[pairs[:, 0] != pairs[:, 1]], axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["a", "b"])

    for batch in batches:
        key, fp = np.concatenate([key, batch.column(0).to_numpy()]), np.concatenate([fp, batch.column(1).to_numpy().view(np.uint64)])
        if len(key) < 100_000 or key[0] == key[-1]:
            continue
        cut = np.searchsorted(key, key[-1])  # the last variant may go on in the next batch
        yield stars(key[:cut], fp[:cut])
        key, fp = key[cut:], fp[cut:]
    if len(key):
        yield stars(key, fp)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One row a document: ``id_col, fingerprint, component_id``.

    Fingerprints that differ in 3 bits or fewer are linked; ``component_id`` is the smallest identifier reachable by
    links, the document itself included.  Documents without words have fingerprint zero and are linked like others.
    Null text counts as empty; null identifiers are never the smallest unless a component has no other, then the
    component is null.  A very long text is hashed shingle by shingle, whole.  Repeated rows come out repeated, other
    columns are not read, an empty table gives an empty result.
    """
    rows = materialize(fingerprints(docs, id_col, text), "fingerprints")
    final = _components(materialize(rows.groupBy("fp").agg(F.min("_id").alias("first")), "fingerprint-set"), blocks)
    out = rows.join(final, "fp")  # two tables on storage: both get an exchange, and a hot fingerprint can be split
    return out.select(F.col("_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("least").alias("component_id"))


def _components(known: DataFrame, blocks: int) -> DataFrame:
    """``fp, least`` for every fingerprint of ``known`` (``fp, first``): the smallest ``first`` of its component, written.

    One row a fingerprint: a component may hold a third of them, so what they are joined to is written first and both
    sides of each join are exchanged.
    """
    found = variants(known.select("fp"), blocks).repartition("key").sortWithinPartitions("key").mapInArrow(_collide, "a long, b long")
    own = materialize(known.join(components(found).withColumnRenamed("node", "fp"), "fp"), "rooted")
    least = materialize(own.groupBy("root").agg(F.min("first").alias("least")), "least")
    linked = own.join(least, "root").select(F.col("fp").alias("_fp"), "least")
    return materialize(known.join(linked, F.col("fp") == F.col("_fp"), "left").select("fp", F.when(F.col("_fp").isNull(), F.col("first")).otherwise(F.col("least")).alias("least")), "fingerprint-components")


def representatives(docs: DataFrame, id_col: str = "doc_id", text: str = "text", blocks: int = BLOCKS) -> DataFrame:
    """One row of ``docs`` for each component of its fingerprints, with all its own columns: the smallest identifier's.

    Null text counts as empty.  A null identifier comes after all others.  Rows that share the identifier but not the
    fingerprint are judged by themselves; of rows that share both, that with the smallest hash of its columns stays, so
    repeated rows leave one.  Columns may have any names and types.  An empty table gives an empty result.

    A row is named by 128 bits of hash over all its columns.  Each fingerprint keeps its best row, each component the
    best of those, and the rows are met by that name; copies of a row are combined before they are shuffled.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at, body = (f"_c{names.index(x)}" for x in (id_col, text))
    a, b = (row_hash(plain, plain.columns, seed) for seed in (1, 2))
    named = plain.select(F.struct(F.col(at).isNull().alias("none"), F.col(at).alias("id"), a.alias("a"), b.alias("b")).alias("_by"), F.col(body).alias("_text"))
    best = fingerprints(named, "_by", "_text").groupBy("fp").agg(F.min("_id").alias("first"))
    final = _components(materialize(best, "fingerprint-set"), blocks)
    stay = materialize(final.select("least.a", "least.b").distinct(), "representatives")
    rows = plain.select(a.alias("_a"), b.alias("_b"), F.struct(*plain.columns).alias("_row")).groupBy("_a", "_b").agg(F.first("_row").alias("_row"))
    kept = rows.join(stay, (F.col("_a") == F.col("a")) & (F.col("_b") == F.col("b")), "left_semi")
    return kept.select(*[F.col(f"_row._c{i}").alias(n) for i, n in enumerate(names)])
