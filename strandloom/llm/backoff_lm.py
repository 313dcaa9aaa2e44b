"""Language-model scoring: Katz backoff over bigrams.

Counts are discounted by Good-Turing up to ``DISCOUNTED``; what that frees goes to the words not seen after a context, in
the shares that the shorter model gives them, by a backoff weight that makes each context's probabilities sum to one.  The
recursion ends at single words, where the freed mass is the probability of the unknown word.

Everything that grows with the corpus is a partitioned table:

* ``blocks``: the texts as numbers of words, some megabytes of text a row;
* ``words``: each training word with its count and number.  Numbers are ranks by falling count, so the count of a number
  follows from a list with one entry for each distinct count (at most the root of twice the tokens);
* ``bigrams``: training counts by bucket, with the backoff weight of each context.  A context is in one bucket, but one
  with more than a quarter of a bucket's tokens is spread over all of them by its followers, and its weight is added up
  over the buckets; at most four times as many contexts as buckets can be that frequent.

A block asks each bucket for the bigrams it holds, every one once, however often it occurs, so what is shuffled are
sorted, packed lists of distinct bigrams and the counts that come back.  Its tokens are then scored where they are.  A
bucket's lists are compressed bytes until a task reads them, one row after the other.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import materialize, pack, unpack
from strandloom.operators.curate import number_rows
from strandloom.storage import scratch

#: Counts up to this one are discounted.
DISCOUNTED = 5
#: Bytes of text of a block; one longer text is a block of its own.
BLOCK_BYTES = 10 << 20
#: Tokens a bucket while there are at most ``MANY`` buckets, and the most there are beyond that.
BUCKET, LARGE_BUCKET, MANY = 1 << 19, 1 << 21, 1 << 11
#: Remainder of crc32(identifier) by FOLDS that is kept away from training.
FOLDS, HELD_OUT = 5, 1
#: The end of a text, as a word: no word holds a line break.
END = "\n"

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def held_out(id_col: str) -> Column:
    """Whether a document is kept away from training; a null identifier counts as an empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(FOLDS)) == HELD_OUT


def pack_rising(values: np.ndarray) -> bytes:
    return pack(np.diff(values, prepend=0))


def unpack_rising(raw: bytes) -> np.ndarray:
    return np.cumsum(unpack(raw))


def tokens_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of each text the end of its tokens, the tokens as places in a list of words, and that list; its last is ``END``."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, ends, raw = texts.buffers()
    lowered = pa.Array.from_buffers(texts.type, len(texts), [None, ends, pa.py_buffer((raw or b"") and raw.to_pybytes().translate(_LOWER))], offset=texts.offset)
    words = pc.ascii_split_whitespace(lowered)
    owner, flat = np.repeat(np.arange(len(texts)), pc.list_value_length(words).to_numpy(zero_copy_only=False)), words.flatten()
    there = pc.greater(pc.binary_length(flat), 0)
    owner, coded = owner[there.to_numpy(zero_copy_only=False)], flat.filter(there).dictionary_encode()
    sizes = np.bincount(owner, minlength=len(texts))
    tokens = np.insert(coded.indices.to_numpy().astype(np.int32), np.cumsum(sizes), len(coded.dictionary))
    return np.cumsum(sizes + 1), tokens, pa.concat_arrays([coded.dictionary.cast(pa.string()), pa.array([END])])


def _one(values: pa.Array | np.ndarray, kind: pa.DataType) -> pa.Array:
    """One row that holds all values."""
    values = pa.array(values, kind) if isinstance(values, np.ndarray) else values
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def encode(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``block, ids, held, ends, tokens, words, counts``: texts as numbers local to a block, with the counts of its training words."""
    kind = docs.schema[id_col].dataType.simpleString()

    def block(at: int, parts: list[tuple[pa.Array, pa.Array, pa.Array]]) -> pa.RecordBatch:
        ids, texts, held = (pa.concat_arrays(x) for x in zip(*parts, strict=True))
        ends, tokens, words = tokens_of(texts)
        train = np.repeat(~held.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))
        counts = np.bincount(tokens[train], minlength=len(words))
        lists = [_one(ids, ids.type), _one(held, pa.bool_()), _one(ends, pa.int64()), pa.array([pack(tokens)], pa.binary()), _one(words, pa.string()), _one(counts, pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists], ["block", "ids", "held", "ends", "tokens", "words", "counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            sizes = pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(sizes):
                if size and size + n > BLOCK_BYTES:
                    yield block(at, [*parts, tuple(c.slice(start, i - start) for c in batch.columns)])
                    at, parts, size, start = at + 1, [], 0, i
                size += n
            parts.append(tuple(c.slice(start) for c in batch.columns))
        if sum(len(p[0]) for p in parts):
            yield block(at, parts)

    rows = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), held_out(id_col).alias("_held"))
    return rows.mapInArrow(run, f"block long, ids array<{kind}>, held array<boolean>, ends array<long>, tokens binary, words array<string>, counts array<long>")


def discounts(seen: list[int]) -> list[float]:
    """Factors of the counts 1 to ``DISCOUNTED`` from the numbers of types with the counts 1 to ``DISCOUNTED`` + 1.

    Katz's factors; where the numbers have gaps or do not fall, from a line through their logarithms; and where that falls
    too slowly, half an occurrence less.
    """

    def katz(n: list[float]) -> list[float] | None:
        if min(n[:-1], default=0) <= 0:
            return None
        far = len(n) * n[-1] / n[0]
        out = [((r + 1) * n[r] / (r * n[r - 1]) - far) / (1 - far) if far < 1 else 0.0 for r in range(1, len(n))]
        return out if all(0 < d < 1 for d in out) else None

    if out := katz([float(x) for x in seen]):
        return out
    there = [(np.log(r), np.log(x)) for r, x in enumerate(seen, 1) if x > 0]
    if len(there) > 1:
        slope, level = np.polyfit(*zip(*there, strict=True), 1)
        if slope < -1 and (out := katz([float(np.exp(level + slope * np.log(r))) for r in range(1, len(seen) + 1)])):
            return out
    return [1 - 0.5 / r for r in range(1, len(seen))]


@dataclass(frozen=True)
class Unigrams:
    """What a task knows of single words: the counts, and where the numbers of each begin."""

    tokens: int
    types: int
    texts: int
    starts: np.ndarray
    counts: np.ndarray
    factors: np.ndarray

    @property
    def start(self) -> int:
        """The context at the beginning of a text, as a number after those of the words."""
        return self.types

    @property
    def unknown(self) -> int:
        return self.types + 1

    def count(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts of words, or of contexts; 0 for the unknown word."""
        if not len(self.starts):
            return np.zeros(len(numbers), dtype=np.int64)
        at = np.searchsorted(self.starts, np.minimum(numbers, self.types - 1), side="right") - 1
        return np.where(numbers < self.types, self.counts[at], np.where(numbers == self.start, self.texts, 0))

    def probability(self, words: np.ndarray) -> np.ndarray:
        """Discounted shares; the unknown word has what they leave."""
        few = self.counts <= DISCOUNTED
        sizes = np.diff(self.starts, append=self.types)
        freed = float((sizes * self.counts * (1 - self.factors[np.minimum(self.counts, DISCOUNTED + 1)]))[few].sum())
        total = self.tokens + (freed == 0)
        c = self.count(words)
        return np.where(c > 0, c * self.factors[np.minimum(c, DISCOUNTED + 1)], freed or 1.0) / total


def _factors(seen: list[int]) -> np.ndarray:
    """Discounts by count, from 0; the last stands for all larger counts."""
    return np.array([0.0, *discounts(seen), 1.0])


@dataclass(frozen=True)
class Layout:
    """How bigrams are dealt: the number of buckets, and the number below which a context is spread over all of them."""

    buckets: int
    hot: int
    base: int

    def spread(self, contexts: np.ndarray, start: int) -> np.ndarray:
        return (contexts < self.hot) | (contexts == start)

    def bucket(self, keys: np.ndarray, start: int) -> np.ndarray:
        contexts = keys // self.base
        x = np.where(self.spread(contexts, start), keys, contexts).astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) % np.uint64(self.buckets)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """``words``: ``word, n, number``.  ``bigrams``: a row a bucket.  ``hot``: contexts that are spread, with weight and total."""

    words: DataFrame
    bigrams: DataFrame
    unigrams: Unigrams
    layout: Layout
    factors: np.ndarray
    hot: tuple[np.ndarray, np.ndarray, np.ndarray]


def vocabulary(blocks: DataFrame) -> tuple[DataFrame, Unigrams]:
    """The training words with count and number, and what tasks have to know of them."""
    rows = blocks.select(F.inline(F.arrays_zip(F.col("words").alias("word"), F.col("counts").alias("n"))))
    counted = rows.filter("n > 0").groupBy("word").agg(F.sum("n").alias("n"))
    words = materialize(number_rows(counted, [F.desc("n"), F.asc("word")], "number").select("word", "n", (F.col("number") - 1).alias("number")), "lm-words")
    runs = words.groupBy("n").agg(F.count(F.lit(1)).alias("types")).orderBy(F.desc("n")).collect()  # distinct counts: at most the root of twice the tokens
    texts = blocks.agg(F.sum(F.size(F.filter("held", lambda x: ~x)))).first()[0] or 0
    counts, types = np.array([r["n"] for r in runs], dtype=np.int64), np.array([r["types"] for r in runs], dtype=np.int64)
    by = dict(zip(counts.tolist(), types.tolist(), strict=True))
    factors = _factors([by.get(r, 0) for r in range(1, DISCOUNTED + 2)])
    return words, Unigrams(int((counts * types).sum()), int(types.sum()), texts, np.cumsum(types) - types, counts, factors)


def numbered(blocks: DataFrame, words: DataFrame) -> DataFrame:
    """``block, ids, held, ends, tokens``: the tokens by their numbers in the whole vocabulary, -1 for a word outside it."""
    asked = blocks.select(F.col("block").alias("_block"), F.posexplode("words").alias("place", "word"))
    known = asked.join(words.select("word", "number"), "word").select("_block", "place", "number")
    kind = blocks.schema["ids"].dataType.simpleString()

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        local = unpack(left["tokens"][0].as_py(), np.int32)
        numbers = np.full(int(left["size"][0].as_py()), -1, dtype=np.int64)
        numbers[right["place"].to_numpy()] = right["number"].to_numpy()
        return left.drop_columns(["size"]).set_column(left.column_names.index("tokens"), "tokens", pa.array([pack(numbers[local])], pa.binary()))

    rows = blocks.select("block", "ids", "held", "ends", "tokens", F.size("words").alias("size"))
    return rows.groupBy("block").cogroup(known.groupBy("_block")).applyInArrow(run, f"block long, ids {kind}, held array<boolean>, ends array<long>, tokens binary")


def _keys(tokens: np.ndarray, ends: np.ndarray, uni: Unigrams, base: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each token its bigram as one number, and whether its context is known."""
    before = np.roll(tokens, 1)
    before[ends[:-1]] = uni.start
    before[:1] = uni.start
    return before * base + np.where(tokens < 0, uni.unknown, tokens), before >= 0


def _by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The buckets that occur, and the places of each, rising."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return found, np.split(order, first[1:])[: len(found)]


def _asked(rows: DataFrame, uni: Unigrams, layout: Layout, training: bool) -> DataFrame:
    """``bucket, block, keys, counts``: the distinct bigrams of each block, by bucket; of training texts, with counts, or of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, ends, held, raw in zip(*(batch.column(c) for c in ("block", "ends", "held", "tokens")), strict=True):
                ends = ends.values.to_numpy()
                keys, use = _keys(unpack(raw.as_py()), ends, uni, layout.base)
                if training:
                    use &= np.repeat(~held.values.to_numpy(zero_copy_only=False), np.diff(ends, prepend=0))
                keys, counts = np.unique(keys[use], return_counts=True)
                found, parts = _by_bucket(layout.bucket(keys, uni.start))
                packed = [pa.array([pack_rising(keys[x]) for x in parts], pa.binary()), pa.array([pack(counts[x]) if training else None for x in parts], pa.binary())]
                yield pa.RecordBatch.from_arrays([pa.array(found), pa.array([at.as_py()] * len(found), pa.int64()), *packed], ["bucket", "block", "keys", "counts"])

    return rows.select("block", "ends", "held", "tokens").mapInArrow(run, "bucket long, block long, keys binary, counts binary")


def fit(blocks: DataFrame, rows: DataFrame, words: DataFrame, uni: Unigrams) -> Model:
    """The model of the training texts of ``blocks``; ``rows`` are those by the numbers of ``words``."""
    total = blocks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    buckets = max(1, min(-(-total // BUCKET), MANY), -(-total // LARGE_BUCKET))
    hot = int(np.searchsorted(-uni.counts, -(total / (4 * buckets)), side="right"))
    layout = Layout(buckets, int(uni.starts[hot]) if hot < len(uni.starts) else uni.types, uni.types + 2)
    if layout.base**2 >= 1 << 63:
        raise ValueError("more than three billion words: a bigram is no 64-bit number")

    def count(table: pa.Table) -> pa.Table:
        keys = np.concatenate([unpack_rising(x.as_py()) for x in table["keys"]])
        keys, at = np.unique(keys, return_inverse=True)
        counts = np.zeros(len(keys), dtype=np.int64)
        np.add.at(counts, at, np.concatenate([unpack(x.as_py()) for x in table["counts"]]))
        few = np.bincount(np.minimum(counts, DISCOUNTED + 2), minlength=DISCOUNTED + 3)[1 : DISCOUNTED + 2]
        return pa.table([table["bucket"].slice(0, 1), pa.array([pack_rising(keys)], pa.binary()), pa.array([pack(counts)], pa.binary()), _one(few, pa.int64())], ["bucket", "keys", "counts", "few"])

    counted = materialize(_asked(rows, uni, layout, True).groupBy("bucket").applyInArrow(count, "bucket long, keys binary, counts binary, few array<long>"), "lm-counts", large_rows=True)
    few = counted.select(*[F.sum(F.get("few", F.lit(r))).alias(f"n{r}") for r in range(DISCOUNTED + 1)]).first()
    factors = _factors([x or 0 for x in few])
    schema = "bucket long, keys binary, counts binary, backoff binary, totals binary, contexts array<long>, sums array<double>, lower array<double>, freed array<boolean>"
    weighed = materialize(counted.drop("few").mapInArrow(_weigh(uni, layout, factors), schema), "lm-bigrams", large_rows=True)
    spread = weighed.select(F.inline(F.arrays_zip("contexts", "sums", "lower", "freed")))
    sums = spread.groupBy("contexts").agg(F.sum("sums").alias("s"), F.sum("lower").alias("l"), F.bool_or("freed").alias("f")).orderBy("contexts").collect()  # at most 4 a bucket
    at = np.array([r["contexts"] for r in sums], dtype=np.int64)
    weights, totals = _weights(uni.count(at), *(np.array([r[c] for r in sums], dtype=k) for c, k in (("s", float), ("l", float), ("f", bool))))
    return Model(words, weighed.select("bucket", "keys", "counts", "backoff", "totals"), uni, layout, factors, (at, weights, totals))


def _weights(counts: np.ndarray, sums: np.ndarray, lower: np.ndarray, freed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Backoff weights and totals of contexts: their counts, discounted sums, the sums of their followers' shares among single
    words, and whether anything was discounted.  Where nothing was, one occurrence more is left to what was not seen."""
    totals = counts + ~freed
    return (totals - sums) / totals / (1 - lower), totals


def _weigh(uni: Unigrams, layout: Layout, factors: np.ndarray):
    """Adds to each bucket the weights and totals of its contexts, and the sums of those that are spread over all buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, counts = unpack_rising(batch["keys"][i].as_py()), unpack(batch["counts"][i].as_py())
                contexts, starts = np.unique(keys // layout.base, return_index=True)
                sums = np.add.reduceat(counts * factors[np.minimum(counts, DISCOUNTED + 1)], starts)
                lower = np.add.reduceat(uni.probability(keys % layout.base), starts)
                freed = np.logical_or.reduceat(counts <= DISCOUNTED, starts)
                weights, totals = _weights(uni.count(contexts), sums, lower, freed)
                spread = layout.spread(contexts, uni.start)
                weights[spread] = np.nan  # known when all buckets are added up
                packed = [pa.array([pack(x)], pa.binary()) for x in (weights, totals)]
                lists = [_one(x[spread], kind) for x, kind in ((contexts, pa.int64()), (sums, pa.float64()), (lower, pa.float64()), (freed, pa.bool_()))]
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *packed, *lists], [*batch.schema.names, "backoff", "totals", "contexts", "sums", "lower", "freed"])

    return run


def _answers(rows: DataFrame, model: Model) -> DataFrame:
    """``block, bucket, counts, backoff``: of each bigram a block asked for its training count, negative where its context has
    one occurrence more in total, and the backoff weight of those never seen (NaN for contexts that are spread, 1 for unknown ones)."""
    uni, base = model.unigrams, model.layout.base

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows:
            known, counts, backoff, totals = (f(left[c][0].as_py()) for c, f in (("keys", unpack_rising), ("counts", unpack), ("backoff", lambda x: unpack(x, np.float64)), ("totals", unpack)))
            contexts = np.unique(known // base)
            more = totals > uni.count(contexts)
        out = []
        for raw in right["keys"]:
            keys = unpack_rising(raw.as_py())
            if not left.num_rows:
                out.append((pack(np.zeros(len(keys), dtype=np.int64)), pack(np.ones(len(keys)))))
                continue
            at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
            found = np.where(known[at] == keys, counts[at], 0)
            c = np.minimum(np.searchsorted(contexts, keys // base), len(contexts) - 1)
            there = contexts[c] == keys // base
            out.append((pack(np.where(there & more[c], -found, found)), pack(np.where(there, backoff[c], 1.0)[found == 0])))
        return pa.table([right["block"], right["bucket"], pa.array([x for x, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["block", "bucket", "counts", "backoff"])

    asked = _asked(rows, uni, model.layout, False).drop("counts")
    return model.bigrams.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(run, "block long, bucket long, counts binary, backoff binary")


def evaluate(rows: DataFrame, model: Model) -> DataFrame:
    """``id, held_out, n_tokens, n_known, base_score, score`` of every text of ``rows``."""
    uni, layout, factors, (hot, hot_weights, hot_totals) = model.unigrams, model.layout, model.factors, model.hot

    def shorter(words: np.ndarray) -> np.ndarray:
        return np.log10(uni.probability(words))

    def longer(keys: np.ndarray, answers: pa.Table) -> np.ndarray:
        """Of distinct bigrams, by rising number."""
        places = dict(zip(*_by_bucket(layout.bucket(keys, uni.start)), strict=True))
        counts, backoff = np.zeros(len(keys), dtype=np.int64), np.ones(len(keys))
        for b, c, w in zip(*(answers[x] for x in ("bucket", "counts", "backoff")), strict=True):
            at = places[b.as_py()]
            counts[at] = unpack(c.as_py())
            backoff[at[counts[at] == 0]] = unpack(w.as_py(), np.float64)
        contexts = keys // layout.base
        totals = uni.count(contexts) + (counts < 0)
        if len(hot):
            at = np.minimum(np.searchsorted(hot, contexts), len(hot) - 1)
            spread = hot[at] == contexts
            totals, backoff = np.where(spread, hot_totals[at], totals), np.where(spread, hot_weights[at], backoff)
        counts = np.abs(counts)
        with np.errstate(divide="ignore", invalid="ignore"):
            seen = counts * factors[np.minimum(counts, DISCOUNTED + 1)] / totals
        return np.where(counts > 0, np.log10(np.where(counts > 0, seen, 1.0)), np.log10(backoff) + shorter(keys % layout.base))

    def run(left: pa.Table, answers: pa.Table) -> pa.Table:
        ends, tokens = left["ends"][0].values.to_numpy(), unpack(left["tokens"][0].as_py())
        starts = ends - np.diff(ends, prepend=0)
        keys, use = _keys(tokens, ends, uni, layout.base)
        distinct, at = np.unique(keys[use], return_inverse=True)
        logs = shorter(np.where(tokens < 0, uni.unknown, tokens))
        logs[use] = longer(distinct, answers)[at]
        counts = uni.count(np.where(tokens < 0, uni.unknown, tokens))
        base = np.log10((counts + 0.5) / (uni.tokens + 0.5 * (uni.types + 1)))
        columns = [pa.array(ends - starts, pa.int64()), pa.array(np.add.reduceat((counts > 0).astype(np.int64), starts), pa.int64()), *[pa.array(np.add.reduceat(x, starts)) for x in (base, logs)]]
        return pa.table([left["ids"][0].values, left["held"][0].values, *columns], ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    kind = rows.schema["ids"].dataType.elementType.simpleString()
    return rows.groupBy("block").cogroup(_answers(rows, model).groupBy("block")).applyInArrow(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``id_col, held_out, n_tokens, n_known, train_tokens, base_score, score``.

    The model learns from the documents that :func:`held_out` does not keep away, and scores all.  A text's tokens are its
    words, A-Z lower-cased, and one end; null and empty texts have the end alone.  ``score`` is the base-10 logarithm of
    the model's probability of the tokens, ``base_score`` that of single words with half an occurrence more each.  Without
    any training text every token is unknown and both are zero.  Repeated rows come out repeated and, if they train,
    count as often.  A very long text is a block of its own.  Other columns are not read and may have any name; an empty
    table gives an empty result.
    """
    with scratch(docs.sparkSession):
        with scratch(docs.sparkSession):
            blocks = materialize(encode(docs, id_col, text), "lm-blocks", large_rows=True)
            words, uni = vocabulary(blocks)
            rows = materialize(numbered(blocks, words), "lm-numbered", outlives=True, large_rows=True)
            sizes = blocks.select("ends")
            model = fit(sizes, rows, words, uni)
            model = replace(model, bigrams=materialize(model.bigrams, "lm-model", outlives=True, large_rows=True))
        out = materialize(evaluate(rows, model), "lm-scores", outlives=True)
    return out.select(F.col("id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(uni.tokens).cast("long").alias("train_tokens"), "base_score", "score")
