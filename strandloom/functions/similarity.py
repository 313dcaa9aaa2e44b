"""Similarity kernels over strings and vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import let

#: Bits of a word of the bit-parallel form: a sum of two words and a carry has to fit into a signed long.
WORD_BITS = 62


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _zero() -> Column:
    return F.lit(0).cast("long")


def _ones(n: Column) -> Column:
    """A word whose lowest ``n`` bits are set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), n.cast("int")) - 1


def place_masks(s: Column) -> Column:
    """For each character of ``s``, the bits of its places, in words: precompute it where one text meets many."""

    def build(chars: Column) -> Column:
        words = F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.size(chars) / WORD_BITS).cast("int")) - 1)
        bit = lambda c, w: F.aggregate(
            F.sequence(F.lit(0), F.lit(WORD_BITS - 1)), _zero(),
            lambda acc, i: F.when(F.coalesce(F.get(chars, w * WORD_BITS + i) == c, F.lit(False)), acc.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i))).otherwise(acc),
        )
        known = F.array_distinct(chars)
        return F.map_from_arrays(known, F.transform(known, lambda c: F.transform(words, lambda w: bit(c, w))))

    return let(_chars(s), build)


def lcs_length(masks: Column, length: Column, other: Column) -> Column:
    """Length of the longest common subsequence of a text, given by its masks and length, and another: any lengths, any characters."""
    chars = _chars(other)
    full = _ones(F.least(length, F.lit(WORD_BITS)))

    def one_word(v: Column, c: Column) -> Column:
        m = F.coalesce(F.get(F.try_element_at(masks, c), F.lit(0)), _zero())
        hit = v.bitwiseAND(m)
        return (v + hit).bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(full)

    words = F.ceil(length / WORD_BITS).cast("int")
    tops = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(1), words) - 1), lambda w: _ones(F.least(F.greatest(length - w * WORD_BITS, F.lit(0)), F.lit(WORD_BITS))))
    start = F.struct(_zero().alias("carry"), F.array().cast("array<bigint>").alias("out"))

    def many_words(vs: Column, c: Column) -> Column:
        def step(acc: Column, w: Column) -> Column:
            v, m = F.get(vs, w), F.get(F.try_element_at(masks, c), w)
            total = v + v.bitwiseAND(m) + acc["carry"]
            kept = total.bitwiseOR(v.bitwiseAND(F.bitwise_not(m))).bitwiseAND(F.get(tops, w))
            return F.struct(F.shiftright(total, WORD_BITS).alias("carry"), F.array_append(acc["out"], kept).alias("out"))

        moved = F.aggregate(F.sequence(F.lit(0), F.size(vs) - 1), start, step, lambda acc: acc["out"])
        return F.when(F.try_element_at(masks, c).isNull(), vs).otherwise(moved)  # a character without a place changes nothing

    short = length - F.bit_count(F.aggregate(chars, full, one_word))
    long = length - F.aggregate(F.aggregate(chars, tops, many_words), F.lit(0), lambda acc, v: acc + F.bit_count(v))
    return F.when(length <= WORD_BITS, short).otherwise(long)


def indel_ratio(a: Column, b: Column, masks: Column | None = None) -> Column:
    """``2 * LCS / (len a + len b)`` of two texts; 1 for two empty ones."""
    n = F.length(a) + F.length(b)
    ratio = lambda m: 2 * lcs_length(m, F.length(a), b) / n
    return F.when(n == 0, 1.0).otherwise(let(place_masks(a), ratio) if masks is None else ratio(masks))


def lcs_bound(counts_a: Column, counts_b: Column) -> Column:
    """An upper bound on the common subsequence from two arrays of residue counts."""
    return F.aggregate(F.zip_with(counts_a, counts_b, lambda x, y: F.least(x, y)), F.lit(0), lambda a, x: a + x)


#: Left texts whose masks a task keeps.
KEPT = 4096


def bit_masks(x: str) -> dict[str, int]:
    """For each character the bits of its places."""
    out: dict[str, int] = {}
    for i, c in enumerate(x):
        out[c] = out.get(c, 0) | 1 << i
    return out


def common_length(masks: dict[str, int], n: int, y: str) -> int:
    """Length of the longest common subsequence of a text of ``n`` characters, given by its masks, and ``y``."""
    v = full = (1 << n) - 1
    for c in y:
        if u := v & masks.get(c, 0):
            v = ((v + u) | (v - u)) & full
    return n - v.bit_count()


def long_indel_ratio(a: Column, b: Column) -> Column:
    """:func:`indel_ratio` by Python integers as bit vectors, in Arrow batches: some ten times as fast a pair as the expression."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        held: dict[str, dict[str, int]] = {}

        def masks(x: str) -> dict[str, int]:
            out = held.get(x)
            if out is None:
                if len(held) >= KEPT:
                    held.clear()
                out = held[x] = bit_masks(x)
            return out

        def one(x: str, y: str) -> float:
            return 2 * common_length(masks(x), len(x), y) / (len(x) + len(y)) if x or y else 1.0

        for left, right in parts:
            yield pd.Series([None if x is None or y is None else one(x, y) for x, y in zip(left, right, strict=True)], dtype="float64")

    return run(a, b)


def indel_distances(s: Column, pivots: list[str]) -> Column:
    """The Indel distance of a text to each of a few others: characters to delete and insert, which is a metric."""

    @F.pandas_udf("array<int>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = [(bit_masks(x), len(x)) for x in pivots]
        for texts in parts:
            yield pd.Series([None if t is None else [n + len(t) - 2 * common_length(m, n, t) for m, n in held] for t in texts], dtype=object)

    return run(s)


def bigram_tokens(s: Column, most: float) -> Column:
    """Pairs of neighbouring characters, each with which occurrence of the pair it is, so a list without repeats.

    Texts shorter than ``1 / most`` also list their characters.
    """

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        def one(t: str) -> list[str]:
            seen: dict[str, int] = {}
            out = []
            for i in range(len(t) - 1):
                gram = t[i : i + 2]
                seen[gram] = seen.get(gram, 0) + 1
                out.append(f"{gram}{seen[gram]}")
            return out + (sorted(set(t)) if len(t) * most < 1 else [])

        for texts in parts:
            yield pd.Series([None if t is None else one(t) for t in texts], dtype=object)

    return run(s)


def local_score(x: str, y: str) -> int:
    """Best local alignment: +1 a match, -1 a mismatch or a gap."""
    if not x or not y:
        return 0
    other, best, places = np.frombuffer(y.encode("utf-32-le"), dtype=np.uint32), 0, np.arange(len(y) + 1)
    row = np.zeros(len(y) + 1, dtype=np.int64)
    for c in x:
        new = np.zeros_like(row)
        new[1:] = np.maximum(0, np.maximum(row[:-1] + np.where(other == ord(c), 1, -1), row[1:] - 1))
        new = np.maximum.accumulate(new + places) - places  # gaps to the right cost one each
        row = np.maximum(new, 0)
        best = max(best, int(row.max()))
    return best


def local_similarity(a: Column, b: Column) -> Column:
    """Best local alignment score over the longer length."""

    @F.pandas_udf("double")
    def run(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for left, right in pairs:
            yield pd.Series([None if x is None or y is None else local_score(x, y) / max(len(x), len(y), 1) for x, y in zip(left, right, strict=True)], dtype="float64")

    return run(a, b)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is all zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def rbf(a: Column, b: Column, sigma: float = 2.0) -> Column:
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double"), 2)), F.lit(0.0), lambda acc, x: acc + x)
    return F.exp(-gap / (2 * sigma * sigma))


def composite_kernel(bio_a: Column, bio_b: Column, mix_a: Column, mix_b: Column, alpha: float = 0.6, sigma: float = 2.0) -> Column:
    return alpha * rbf(bio_a, bio_b, sigma) + (1 - alpha) * F.coalesce(cosine(mix_a, mix_b), F.lit(0.0))


def standardize(df: DataFrame, columns: list[str], out: str = "z") -> DataFrame:
    """``df`` with an array of z-scores over population deviations; a constant column gives zeros.

    The means and deviations are one row, read back as literals.
    """
    stats = df.agg(*[f(c).alias(f"{k}{i}") for i, c in enumerate(columns) for k, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    parts = [(F.col(c) - F.lit(stats[f"m{i}"])) / F.lit(stats[f"s{i}"] or 1.0) for i, c in enumerate(columns)]
    return df.withColumn(out, F.array(*parts))


def scaled_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: F.pow(x - y, 2)), F.lit(0.0), lambda acc, x: acc + x))
