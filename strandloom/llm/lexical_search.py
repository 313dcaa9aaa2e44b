"""Ranked lexical search over a tiered index.

The index is a table with one row for each block of documents: the block's terms, and for each tier the postings of every
term, those with the highest impact first.  With each tier goes a residual bound for each term: the largest impact of a
posting that lies lower.  Every block is built and searched in the task that reads it, so nothing is grouped by term and a
term that stands in every document is no task's burden.

A search goes twice over the index:

1. The first tier alone gives each item a threshold: the tenth largest of the partial scores of all blocks, which no true
   tenth score is below.
2. Each block adds up an item's first tier.  A document's score is at most what was seen of it plus the residual bounds of
   the terms it was not seen with.  Where that is below the threshold for all of the block, this is a proof that the block
   has nothing for the item; where it isn't, the pair of item and block falls through to the next tier, and so on to the
   last, where scores are exact.

Scores are 64-bit integers throughout.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialize, pack, unpack
from strandloom.operators.ranking import top_k_per_group
from strandloom.storage import scratch

#: Documents and bytes of text of a block; one longer text is a block of its own.
BLOCK_DOCS, BLOCK_BYTES = 2048, 8 << 20
#: The part of a term's postings in a block that the first and the second tier hold together with those before; no tier is
#: cut before the first ``LEAST`` postings.
CUTS, LEAST = (8, 2), 16
#: Distinct terms of the items that are searched together; their vocabulary is what a task holds of them.
MOST_TERMS = 500_000
K = 10

#: ASCII but letters and digits separates terms; of the rest A-Z is lower-cased.
_TERMS = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def split_terms(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """For each term of the texts, in order: the place of its text, and the term.  Null texts have none."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, raw = texts.buffers()
    lowered = pa.Array.from_buffers(texts.type, len(texts), [None, ends, pa.py_buffer((raw or b"") and raw.to_pybytes().translate(_TERMS))], offset=texts.offset)
    words = pc.ascii_split_whitespace(lowered)
    owner, flat = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False)), words.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    return owner[there.to_numpy(zero_copy_only=False)], flat.filter(there)


def _list(values: pa.Array) -> pa.Array:
    """One row that holds all values."""
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _packed(values: np.ndarray) -> pa.Array:
    """One row of packed 32-bit integers."""
    return pa.array([pack(values.astype(np.int32))], pa.binary())


def _ints(column: pa.Array, row: int) -> np.ndarray:
    return unpack(column[row].as_py(), np.int32)


def _words(column: pa.Array, row: int) -> pa.Array:
    raw = unpack(column[row].as_py(), np.uint8).tobytes()
    return pa.array(raw.split(b"\n"), pa.binary()).cast(pa.string())


_BLOCK = "ids array<long>, lengths array<long>, terms binary, ends binary, places binary, tfs binary"


def _block(ids: pa.Array, texts: pa.Array) -> pa.RecordBatch | None:
    """One row: the identifiers and lengths of the documents that have a term, and each term's postings."""
    owner, flat = split_terms(texts)
    if not len(flat):
        return None
    lengths = np.bincount(owner, minlength=len(ids))
    having = lengths > 0
    owner = (np.cumsum(having) - 1)[owner]
    n, coded = int(having.sum()), flat.dictionary_encode()
    keys, tfs = np.unique(coded.indices.to_numpy().astype(np.int64) * n + owner, return_counts=True)
    ends = np.cumsum(np.bincount(keys // n, minlength=len(coded.dictionary)))
    names = pa.array([pack(np.frombuffer(b"\n".join(coded.dictionary.cast(pa.large_binary()).to_pylist()), dtype=np.uint8))], pa.binary())
    columns = [_list(ids.filter(pa.array(having))), _list(pa.array(lengths[having], pa.int64())), names, *map(_packed, (ends, keys % n, tfs))]
    return pa.RecordBatch.from_arrays(columns, ["ids", "lengths", "terms", "ends", "places", "tfs"])


def blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Postings with term frequencies, one row a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.columns
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            start = held = 0
            for i, size in enumerate(sizes):
                if i > start and (i - start >= BLOCK_DOCS or held + size > BLOCK_BYTES):
                    if (out := _block(ids.slice(start, i - start), texts.slice(start, i - start))) is not None:
                        yield out
                    start, held = i, 0
                held += size
            if len(sizes) > start and (out := _block(ids.slice(start), texts.slice(start))) is not None:
                yield out

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text).alias("_text")).mapInArrow(run, _BLOCK)


_TIERS = len(CUTS) + 1
_INDEX = "ids array<long>, terms binary, " + ", ".join(f"{x}{k} binary" for k in range(_TIERS) for x in ("ends", "places", "factors", "rest"))


@dataclass(frozen=True)
class Index:
    """A tiered index: ``rows``, one a block; the number of documents with a term; the number of all their terms."""

    rows: DataFrame
    documents: int
    length: int


def build(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> Index:
    """Index every document.  What is written is the index alone; documents without a term are not part of it."""
    with scratch(docs.sparkSession):
        held = materialize(blocks(docs, id_col, text), "search-blocks")
        size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
        total = held.agg(F.sum(F.size("ids")).alias("n"), F.sum(size).alias("l")).first()
        n, length = total["n"] or 0, total["l"] or 0
        return Index(materialize(held.mapInArrow(_tiered(n, length), _INDEX), "search-index", outlives=True), n, length)


def _tiered(n: int, length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                ids, lengths, terms = batch.column("ids")[row].values, batch.column("lengths")[row].values, batch.column("terms").slice(row, 1)
                # Python integers: the product can leave 64 bits on a large corpus
                m = np.array([10 + 90 * x * n // length for x in lengths.to_pylist()], dtype=np.int64)
                ends, places, tfs = (_ints(batch.column(x), row).astype(np.int64) for x in ("ends", "places", "tfs"))
                factors = 1_000_000_000 * tfs // (1000 * tfs + 8 * m[places])
                sizes = np.diff(ends, prepend=0)
                term = np.repeat(np.arange(len(sizes)), sizes)
                order = np.lexsort((places, -factors, term))
                places, factors = places[order], factors[order]
                starts = ends - sizes
                rank = np.arange(len(term)) - starts[term]
                cuts = [np.minimum(sizes, np.maximum(LEAST, -(-sizes // part))) for part in CUTS] + [sizes]
                tier = sum((rank >= c[term]).astype(np.int8) for c in cuts)
                out = [_list(ids), terms]
                for k, cut in enumerate(cuts):
                    here = tier == k
                    below = np.where(cut < sizes, factors[np.minimum(starts + cut, len(factors) - 1)], 0)
                    out += [_packed(x) for x in (np.cumsum(np.bincount(term[here], minlength=len(sizes))), places[here], factors[here], below)]
                yield pa.RecordBatch.from_arrays(out, [x.split()[0] for x in _INDEX.split(", ")])

    return run


@dataclass(frozen=True)
class Items:
    """Items that are searched together: each one's distinct terms as places in the vocabulary, and the weight of each."""

    vocabulary: pa.Array
    of: list[np.ndarray]
    weights: np.ndarray


class Block:
    """A block of the index, with what ``items`` ask of it.  A tier is unpacked when it is first read."""

    def __init__(self, batch: pa.RecordBatch, row: int, items: Items):
        self.batch, self.row, self.ids = batch, row, batch.column("ids")[row].values
        self.at = pc.fill_null(pc.index_in(items.vocabulary, _words(batch.column("terms"), row)), -1).to_numpy(zero_copy_only=False)
        self.weights, self.read = items.weights, {}

    def tier(self, k: int) -> tuple[np.ndarray, ...]:
        """End of each term's postings, their documents and factors, and each term's residual bound."""
        if k not in self.read:
            self.read[k] = tuple(_ints(self.batch.column(f"{x}{k}"), self.row) for x in ("ends", "places", "factors", "rest"))
        return self.read[k]

    def _add(self, tier: int, terms: np.ndarray, into: np.ndarray, less: np.ndarray | None = None) -> None:
        """Add the weighted impacts of a tier, each less its term's residual bound."""
        ends, places, factors, _ = self.tier(tier)
        for t in terms:
            at = self.at[t]
            start, end = ends[at - 1] if at else 0, ends[at]
            if end > start:
                into[places[start:end]] += self.weights[t] * (factors[start:end].astype(np.int64) - (0 if less is None else less[at]))

    def first(self, terms: np.ndarray) -> np.ndarray:
        """Partial scores of the block's documents by the first tier."""
        out = np.zeros(len(self.ids), dtype=np.int64)
        self._add(0, terms[self.at[terms] >= 0], out)
        return out

    def scores(self, terms: np.ndarray, least: int) -> tuple[np.ndarray | None, int]:
        """Exact scores, or None where no document reaches ``least``, and how many tiers that took."""
        terms = terms[self.at[terms] >= 0]
        for tier in range(_TIERS - 1):
            rest = self.tier(tier)[3]
            most = np.full(len(self.ids), int((self.weights[terms] * rest[self.at[terms]].astype(np.int64)).sum()), dtype=np.int64)
            for k in range(tier + 1):
                self._add(k, terms, most, rest)
            if not len(most) or most.max() < max(least, 1):
                return None, tier + 1
        out = np.zeros(len(self.ids), dtype=np.int64)
        for k in range(_TIERS):
            self._add(k, terms, out)
        return out, _TIERS


def _best(scores: np.ndarray, ids: pa.Array, k: int, least: int) -> tuple[np.ndarray, list[int | None]]:
    """The ``k`` largest scores of ``least`` or more, and whose they are; equal ones by identifier, null last."""
    at = np.flatnonzero(scores >= max(least, 1))
    if len(at) > k:
        at = at[scores[at] >= np.partition(scores[at], -k)[-k]]
    missing = ids.is_null().to_numpy(zero_copy_only=False)[at]
    at = at[np.lexsort((pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)[at], missing, -scores[at]))][:k]
    return scores[at], ids.take(pa.array(at)).to_pylist()


def thresholds(index: Index, items: Items, k: int = K) -> DataFrame:
    """``item, least``: the ``k``-th largest partial score of the first tier; items with fewer have no row."""
    spark = index.rows.sparkSession
    held = spark.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = held.value
        best = np.zeros((len(items.of), k), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, items)
                for i, terms in enumerate(items.of):
                    found = block.first(terms)
                    found = found[found > best[i, 0]]
                    if len(found):
                        best[i] = np.sort(np.concatenate((best[i], found)))[-k:]
        item, place = np.nonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(best[item, place], pa.int64()), pa.array(place, pa.int32())], ["item", "part", "place"])

    parts = index.rows.select("ids", "terms", "ends0", "places0", "factors0", "rest0").mapInArrow(run, "item int, part long, place int")
    # a row of a task says which place it has there, so equal rows of two tasks are told apart by the task
    ranked = top_k_per_group(parts.withColumn("task", F.spark_partition_id()), ["item"], [F.desc("part")], k)
    return ranked.filter(F.col("rank") == k).select("item", F.col("part").alias("least"))


def ranked(index: Index, items: Items, least: dict[int, int], k: int = K) -> DataFrame:
    """``item, rank, doc_id, score``: the ``k`` best of each item, from those blocks that could not be ruled out."""
    held = index.rows.sparkSession.sparkContext.broadcast((items, np.array([least.get(i, 1) for i in range(len(items.of))], dtype=np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, bar = held.value
        bar, found = bar.copy(), [(np.zeros(0, dtype=np.int64), [])] * len(items.of)
        for batch in batches:
            for row in range(batch.num_rows):
                block = Block(batch, row, items)
                for i, terms in enumerate(items.of):
                    scores, _ = block.scores(terms, bar[i])
                    if scores is None:
                        continue
                    new, whose = _best(scores, block.ids, k, bar[i])
                    both, ids = np.concatenate((found[i][0], new)), found[i][1] + whose
                    found[i] = _best(both, pa.array(ids, pa.int64()), k, 1)
                    if len(found[i][0]) == k:
                        bar[i] = max(bar[i], found[i][0][-1])
        sizes = [len(x) for x, _ in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(found)), sizes), pa.int32()), pa.array([d for _, ids in found for d in ids], pa.int64()), pa.array([int(s) for x, _ in found for s in x], pa.int64()),
             pa.array([j for n in sizes for j in range(n)], pa.int32())], ["item", "doc_id", "score", "place"],
        )

    parts = index.rows.mapInArrow(run, "item int, doc_id long, score long, place int").withColumn("task", F.spark_partition_id())
    return top_k_per_group(parts, ["item"], [F.desc("score"), F.asc_nulls_last("doc_id")], k).select("item", "rank", "doc_id", "score")


def weigh(index: Index, of: list[list[str]]) -> Items:
    """``of`` (each item's distinct terms) with weights by the documents that hold a term; terms in no document go."""
    words = pa.array(sorted({t for x in of for t in x}), pa.string())
    held = index.rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(held.value), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                at = pc.index_in(held.value, _words(batch.column("terms"), row))
                here = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
                sizes = sum(np.diff(_ints(batch.column(f"ends{k}"), row), prepend=0) for k in range(_TIERS))
                count[here] += sizes[at.drop_null().to_numpy()]
        term = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(term, pa.int32()), pa.array(count[term], pa.int64())], ["term", "df"])

    counted = index.rows.select("terms", *[f"ends{k}" for k in range(_TIERS)]).mapInArrow(run, "term int, df long")
    df = {r[0]: r[1] for r in counted.groupBy("term").agg(F.sum("df")).collect()}  # at most MOST_TERMS rows, or one item's
    known = {words[t].as_py(): i for i, t in enumerate(sorted(df))}
    weights = np.array([math.floor(1000 * math.log((2 * index.documents + 2) / (2 * df[t] + 1))) for t in sorted(df)], dtype=np.int64)
    return Items(words.take(pa.array(sorted(df), pa.int32())), [np.array(sorted(known[t] for t in x if t in known), dtype=np.int64) for x in of], weights)


def _chunks(queries: DataFrame, id_col: str, text: str) -> Iterator[list[tuple[object, list[str]]]]:
    """Items with their distinct terms, as many at a time as have ``MOST_TERMS`` terms together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for i in range(batch.num_rows):
                terms.append(split_terms(batch.column(1).slice(i, 1))[1].unique().to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(terms, pa.list_(pa.string()))], ["_id", "terms"])

    kind = queries.schema[id_col].dataType.simpleString()
    held, size = [], 0
    for r in queries.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).mapInArrow(run, f"_id {kind}, terms array<string>").toLocalIterator():
        if held and size + len(r[1]) > MOST_TERMS:
            yield held
            held, size = [], 0
        held.append((r[0], r[1]))
        size += len(r[1])
    if held:
        yield held


def search(index: Index, queries: DataFrame, id_col: str = "item_id", text: str = "text", k: int = K) -> DataFrame:
    """``id_col, rank, doc_id, score``: the ``k`` documents with the highest score above 0 of each query, all if fewer.

    Equal scores are ordered by ascending identifier, null identifiers last.  Null and empty queries, and those without a
    known term, have no row; each row of ``queries`` is answered, so repeated ones are answered twice.  Repeated rows of the
    documents are documents of their own and count in all statistics.  Other columns are not read and may have any name.
    Very long texts are blocks of their own.  Queries are taken in chunks of ``MOST_TERMS`` terms, one long query alone, and
    one chunk is what the driver and a task hold; each chunk reads the index three times, the first two times in part.
    """
    spark, parts = queries.sparkSession, []
    kind = queries.schema[id_col].dataType.simpleString()
    for chunk in _chunks(queries, id_col, text):
        items = weigh(index, [terms for _, terms in chunk])
        least = {r[0]: r[1] for r in thresholds(index, items, k).collect()}  # one row an item of the chunk
        found = materialize(ranked(index, items, least, k), "search-answers", outlives=True)
        named = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(chunk)], f"item int, _id {kind}")
        parts.append(found.join(F.broadcast(named), "item").select(F.col("_id").alias(id_col), "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], f"`{id_col}` {kind}, rank int, doc_id long, score long")
