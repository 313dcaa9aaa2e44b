"""Similarity joins over sequences: bounds that lose nothing, and bit-parallel verification.

An Indel ratio is bounded from above by lengths, by residue counts and by pivots: the Indel distance is a metric, so two
sequences are at least as far apart as their distances to any third one differ.  All bounds are conditions of a shuffle
join on lengths and on buckets of the distance to the first pivot.  What passes is verified in Arrow batches by integers
as bit vectors, which is some ten times as fast a pair as the same steps as an expression.

A local alignment score over a share of the longer text forces that many common pairs of neighbouring characters, so a
screen by local similarity is a join on the rarest of them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import RESIDUES, residue_count
from strandloom.functions.similarity import bigram_tokens, bit_masks, common_length, indel_distances, lcs_bound, local_similarity, long_indel_ratio
from strandloom.operators.curate import number_rows, own_key
from strandloom.operators.ranking import top_k_per_group
from strandloom.storage import materialize

#: Pivots of a join, among how many distinct sequences they are looked for, and the longest that is one.
PIVOTS, POOL, LONGEST_PIVOT = 12, 400, 1000


def _counts(s: Column) -> Column:
    """Of each residue, then of all other characters together."""
    return F.array(*[residue_count(s, r) for r in RESIDUES], F.length(F.translate(s, RESIDUES, "")))


def choose_pivots(df: DataFrame, sequence: str, n: int = PIVOTS) -> list[str]:
    """Up to ``n`` sequences far from each other, that which tells most apart first.

    They are looked for among the ``POOL`` distinct ones with the smallest hashes.  Any choice gives right results: it only
    decides how many pairs are left to verify.
    """
    s = F.col("s")
    rows = df.select(F.col(sequence).alias("s")).filter(F.length(s).between(1, LONGEST_PIVOT)).distinct().orderBy(F.xxhash64(s), s).limit(POOL).collect()
    pool = [r["s"] for r in rows]
    if not pool:
        return []
    away = lambda x: np.array([len(x) + len(y) - 2 * common_length(m, len(x), y) for m in [bit_masks(x)] for y in pool])
    chosen, near, spread = [], np.full(len(pool), np.iinfo(np.int64).max), []
    at = int(np.argmax([len(x) for x in pool]))
    while len(chosen) < min(n, len(pool)):
        d = away(pool[at])
        chosen.append(pool[at])
        spread.append(float(np.std(d - np.abs(np.array([len(y) for y in pool]) - len(pool[at])))))
        near = np.minimum(near, d)
        if near.max() <= 0:
            break
        at = int(np.argmax(near))
    return [chosen[i] for i in np.argsort(-np.array(spread), kind="stable")]


def _prepared(df: DataFrame, key: str, sequence: str, side: str, pivots: list[str]) -> DataFrame:
    """Distinct sequences with what comparing them needs; each stands for its smallest key."""
    s = F.col("s")
    distinct = df.groupBy(F.col(sequence).alias("s")).agg(F.min(key).alias("key")).filter("s is not null")
    far = indel_distances(s, pivots) if pivots else F.array().cast("array<int>")
    out = distinct.select(F.col("key").alias(f"{side}_key"), s.alias(f"{side}_s"), F.length(s).alias(f"{side}_n"), _counts(s).alias(f"{side}_counts"), far.alias("_far"))
    return out.withColumns({f"{side}_p{i}": F.get("_far", F.lit(i)) for i in range(len(pivots))}).drop("_far")


def least_length(n: Column, threshold: float | Column) -> Column:
    """The shortest partner that can reach ``threshold``: 2 min / (a + b) >= t."""
    return F.ceil(n * (threshold / (2 - threshold)) - 1e-9).cast("int")


def most_length(n: Column, threshold: float | Column) -> Column:
    return F.floor(n * ((2 - threshold) / threshold) + 1e-9).cast("int")


#: Parts into which the sequences of one length are dealt: each is met by a copy of the other side.
SALTS = 8


def _salted(left: DataFrame, right: DataFrame, salts: int) -> tuple[DataFrame, DataFrame]:
    """Most sequences may have one length: its work is spread over ``salts`` tasks."""
    return left.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))), right.withColumn("_salt", F.pmod(F.xxhash64("b_s"), F.lit(salts)).cast("int"))


def _can_reach(pivots: int, threshold: Column) -> Column:
    """Whether counts and pivots allow a ratio of ``threshold``; cheap tests come first."""
    total = F.col("a_n") + F.col("b_n")
    apart = [F.abs(F.col(f"a_p{i}") - F.col(f"b_p{i}")) for i in range(pivots)]
    tests = [total - x >= threshold * total - 1e-9 for x in apart]
    return reduce(lambda x, y: x & y, [*tests, 2 * lcs_bound(F.col("a_counts"), F.col("b_counts")) >= threshold * total - 1e-9])


def candidate_pairs(df: DataFrame, key: str, sequence: str, threshold: float, pivots: list[str] | None = None, salts: int = SALTS) -> DataFrame:
    """Pairs of distinct sequences that no bound rules out, with both sides' columns: what :func:`similar_pairs` verifies.

    A sequence meets only lengths that can reach the threshold, and of each length only those buckets of the distance to
    the first pivot that the triangle inequality allows: one side is exploded over them, so the join is an equi-join.
    """
    pivots = choose_pivots(df, sequence) if pivots is None else pivots
    left, right = _prepared(df, key, sequence, "a", pivots), _prepared(df, key, sequence, "b", pivots)
    left = left.withColumn("_n", F.explode(F.sequence(F.greatest(F.lit(0), least_length(F.col("a_n"), threshold)), F.col("a_n"))))
    right = right.withColumn("_n", F.col("b_n"))
    on = ["_n", "_salt"]
    if pivots:
        width = F.greatest(F.lit(1), F.floor(2 * (1 - threshold) * F.col("_n")).cast("int"))
        reach = (1 - threshold) * (F.col("a_n") + F.col("_n")) + 1e-9
        place = lambda d: F.floor(d / width).cast("int")
        left = left.withColumn("_bucket", F.explode(F.sequence(place(F.col("a_p0") - reach), place(F.col("a_p0") + reach))))
        right = right.withColumn("_bucket", place(F.col("b_p0")))
        on.append("_bucket")
    left, right = _salted(left, right, salts)
    hit = reduce(lambda x, y: x & y, [left[c] == right[c] for c in on]) & ((F.col("a_n") > F.col("b_n")) | (F.col("a_s") < F.col("b_s")))
    return left.join(right, hit & _can_reach(len(pivots), F.lit(threshold)))


def similar_pairs(df: DataFrame, key: str, sequence: str, threshold: float, salts: int = SALTS) -> DataFrame:
    """``a, b, similarity`` for pairs of distinct sequences with an Indel ratio of ``threshold`` or more, a < b.

    Only :func:`candidate_pairs` are verified.  Copies stand for themselves once: a key is the smallest of its sequence.
    """
    met = candidate_pairs(df, key, sequence, threshold, salts=salts)
    return met.select(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b"), long_indel_ratio(F.col("a_s"), F.col("b_s")).alias("similarity")).filter(F.col("similarity") >= threshold)


#: Lengths of one class differ by less than this factor.  References of a class and bucket that a sequence meets first.
CLASS, FIRST = 1.1, 4


def _class(n: Column) -> Column:
    return F.floor(F.log(n + 1.0) / math.log(CLASS)).cast("int")


def _scored(met: DataFrame) -> DataFrame:
    best = met.select("a_s", "b_key", long_indel_ratio(F.col("a_s"), F.col("b_s")).alias("sim")).groupBy("a_s")
    return best.agg(F.max("sim").alias("sim"), F.min_by("b_key", F.struct((-F.col("sim")).alias("far"), "b_key")).alias("ref"))


def _in_window(window: float | None) -> Column:
    if window is None:
        return F.lit(True)
    return F.col("b_n").between(least_length(F.col("a_n"), window), most_length(F.col("a_n"), window))


def _nearest(left: DataFrame, right: DataFrame, pivots: int, window: float | None) -> DataFrame:
    """``a_s, sim, ref`` from rows of ``left`` with ``bar``, a ratio that their best one is known to reach (0: nothing is known)."""
    far = right.agg(F.max("b_n")).first()[0]
    bar, n = F.col("bar"), F.col("a_n")
    low = F.when(bar > 0, least_length(n, bar)).otherwise(0)
    high = F.when(bar > 0, F.least(most_length(n, bar), F.lit(far))).otherwise(F.lit(far))
    if window is not None:
        low, high = F.greatest(low, least_length(n, window)), F.least(high, most_length(n, window))
    left = left.withColumns({"_low": low, "_high": high}).filter("_low <= _high").withColumn("_c", F.explode(F.sequence(_class(F.col("_low")), _class(F.col("_high")))))
    left, right = _salted(left, right.withColumn("_c", _class(F.col("b_n"))), SALTS)
    hit = (left["_c"] == right["_c"]) & (left["_salt"] == right["_salt"]) & F.col("b_n").between(F.col("_low"), F.col("_high"))
    return _scored(left.join(right, hit & _can_reach(pivots, bar)))


def nearest_reference(df: DataFrame, reference: DataFrame, key: str, sequence: str, ref_key: str, ref_sequence: str, window: float | None = 0.8) -> DataFrame:
    """For each row of ``df``: the largest Indel ratio to a reference, and which one (the smallest key on ties).

    With a ``window`` only references whose length can reach that ratio count: ratios below it may be under-reported,
    0 where there is none, but none at or above it is missed.  ``None`` takes every reference.  Equal sequences are
    compared once.

    A sequence first meets a few references of its length and of its distance to a pivot.  The best of them is a bar: of
    all others only those are verified whose lengths, counts and pivots allow to reach it.
    """
    pivots = choose_pivots(reference, ref_sequence)
    left, right = _prepared(df, key, sequence, "a", pivots), materialize(_prepared(reference, ref_key, ref_sequence, "b", pivots), "references")
    if pivots:
        left, some = materialize(left, "compared"), right.withColumns({"_c": _class(F.col("b_n")), "_bucket": F.floor(F.col("b_p0") / 8)})
        some = top_k_per_group(some, ["_c", "_bucket"], [F.xxhash64("b_s"), F.col("b_s")], FIRST)
        near = left.withColumns({"_c": _class(F.col("a_n")), "_bucket": F.floor(F.col("a_p0") / 8)})
        first = _scored(near.join(some, (near["_c"] == some["_c"]) & (near["_bucket"] == some["_bucket"]) & _in_window(window)))
        left = left.join(first.select("a_s", F.col("sim").alias("bar")), "a_s", "left").fillna(0.0, ["bar"])
    else:
        left = left.withColumn("bar", F.lit(0.0))
    best = _nearest(left, right, len(pivots), window)
    out = df.join(best, own_key(sequence) == own_key("a_s"), "left")
    return out.select(*df.columns, F.coalesce(F.col("sim"), F.lit(0.0)).alias("max_reference_similarity"), F.col("ref").alias("nearest_reference"))


def novelty_gate(scored: DataFrame, similarity: str = "max_reference_similarity", most: float = 0.80) -> DataFrame:
    """Adds the novelty flag; the similarity is compared as it is, not rounded."""
    return scored.withColumn("passes_novelty_rule_le80", F.col(similarity) <= most)


def threshold_matches(df: DataFrame, reference: DataFrame, key: str, sequence: str, ref_key: str, ref_sequence: str, threshold: float = 0.80) -> DataFrame:
    """Rows whose largest similarity to the reference is over ``threshold``, with it and whose it is; the threshold is the bar."""
    pivots = choose_pivots(reference, ref_sequence)
    left, right = _prepared(df, key, sequence, "a", pivots).withColumn("bar", F.lit(float(threshold))), _prepared(reference, ref_key, ref_sequence, "b", pivots)
    best = _nearest(left, right, len(pivots), threshold).filter(F.col("sim") > threshold)
    return df.join(best, own_key(sequence) == own_key("a_s")).select(*df.columns, F.col("sim").alias("max_reference_similarity"), F.col("ref").alias("nearest_reference"))


def _seeded(texts: DataFrame, order: DataFrame, most: float, side: str) -> DataFrame:
    """Texts with their tokens by rising number, and exploded over those of them that a partner has to share one of."""
    held = texts.select(F.col("s"), F.explode(bigram_tokens(F.col("s"), most)).alias("token")).join(order, "token")
    held = held.groupBy("s").agg(F.sort_array(F.collect_list("number")).alias("tokens"))
    n = F.length("s")
    short = F.when(n * most < 1, F.size("tokens")).otherwise(F.size("tokens") - F.floor(n * most + 1e-9).cast("int") + 1)
    held = held.select(F.col("s").alias(f"{side}_s"), n.alias(f"{side}_n"), F.col("tokens").alias(f"{side}_tokens"), F.slice("tokens", 1, short).alias(f"{side}_first"))
    return held.withColumn("_seed", F.explode(f"{side}_first"))


def local_pairs(df: DataFrame, known: DataFrame, sequence: str, known_sequence: str, most: float = 0.60, salts: int = SALTS) -> DataFrame:
    """``a_s, b_s, similarity``: distinct texts of both sides with a local similarity over ``most``, which lies between 0 and 1.

    A score is matches less mismatches and gaps, and matches without a gap between them share pairs of neighbouring
    characters: a score of at least ``x`` takes ``x - 1`` common pairs.  ``x`` is more than ``most`` times the longer
    text, so of a text's pairs, in one order for all texts, one of the first ``pairs - most * length + 1`` is among those
    first ones of any partner.  The order is by rising frequency: the seeds of the join are the rarest pairs of a text, and
    one that is common all the same is dealt over ``salts`` tasks.  Two texts meet at their first common seed only, and
    are aligned if they have enough pairs in common.  Texts shorter than ``1 / most`` meet at characters.  Null and empty
    texts are similar to nothing.
    """
    a, b = (x.select(F.col(c).alias("s")).filter("s <> ''").distinct() for x, c in ((df, sequence), (known, known_sequence)))
    tokens = a.union(b).select(F.explode(bigram_tokens(F.col("s"), most)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    order = materialize(number_rows(tokens, [F.col("n"), F.col("token")], "number").select("token", "number"), "seeds")
    left, right = _seeded(a, order, most, "a"), _seeded(b, order, most, "b")
    left, right = _salted(left, right, salts)
    longer = F.greatest("a_n", "b_n")
    met = left.join(
        right, (left["_seed"] == right["_seed"]) & (left["_salt"] == right["_salt"]) & (F.least("a_n", "b_n") > most * longer)
        & (F.get(F.array_intersect("a_first", "b_first"), F.lit(0)) == left["_seed"]) & (F.size(F.array_intersect("a_tokens", "b_tokens")) >= F.floor(longer * most + 1e-9)),
    )
    return met.select("a_s", "b_s", local_similarity(F.col("a_s"), F.col("b_s")).alias("similarity")).filter(F.col("similarity") > most)


def local_screen(df: DataFrame, known: DataFrame, sequence: str, known_sequence: str, most: float = 0.60) -> DataFrame:
    """Rows without a local similarity over ``most`` to any of a known set; null texts stay."""
    close = local_pairs(df, known, sequence, known_sequence, most).select("a_s").distinct()
    return df.join(close, own_key(sequence) == own_key("a_s"), "left_anti")


def edit_distances(queries: DataFrame, rows: DataFrame, sequence: str, salts: int = SALTS) -> DataFrame:
    """``x, y, distance``: the edit distance of each distinct stated text to every other distinct one; null texts have none.

    Every query meets every row, which is what is asked for, in parts: rows are dealt over ``salts`` parts by hash, and a query
    has a copy in each.
    """
    text = lambda df, name: df.select(F.col(sequence).alias(name)).filter(F.col(name).isNotNull()).distinct()
    left = text(queries, "x").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = text(rows, "y").withColumn("_part", F.pmod(F.xxhash64("y"), F.lit(salts)).cast("int"))
    return left.join(right, (left["_part"] == right["_part"]) & (F.col("x") != F.col("y"))).select("x", "y", F.levenshtein("x", "y").alias("distance"))


#: Query rows that a task of ``cosine_pairs`` meets at a time, and rows that it meets them with.
QUERY_BLOCK, ROW_BLOCK = 1_000, 4_000
#: Pairs that leave such a task at a time, about.
OUT_ROWS = 32_000


def _block_rows(rows: DataFrame, key: str, vector: str, size: int, label: str) -> DataFrame:
    """One row for each block of up to ``size`` rows of a task: its keys, and its vectors end to end, at unit length."""
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                keys, vectors = (c.slice(start, size) for c in batch.columns)
                x = np.array([[0.0 if v is None else v for v in row] for row in vectors.to_pylist()], dtype=np.float64)
                length = np.sqrt((x * x).sum(axis=1, keepdims=True))
                x = np.divide(x, length, out=np.full_like(x, np.nan), where=length > 0)
                one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
                yield pa.RecordBatch.from_arrays([one(keys), one(pa.array(x.reshape(-1)))], [f"{label}_keys", f"{label}_x"])

    held = rows.filter(F.col(vector).isNotNull()).select(F.col(key).alias("_key"), F.col(vector).alias("_vector"))
    return held.mapInArrow(run, f"{label}_keys array<{kind}>, {label}_x array<double>")


def cosine_pairs(df: DataFrame, key: str, vector: str, queries: DataFrame, least: float | None = None, block: int = QUERY_BLOCK, row_block: int = ROW_BLOCK, digits: int | None = None) -> DataFrame:
    """``query, other, similarity``: the cosine of each stated query row to every other row, or to those of ``least`` or more.

    Null where a vector is all zero; rows without a vector have none.  Vectors of one length are packed into blocks at
    unit length; blocks of both sides meet by an equi-join on the number of the query block, and a pair of blocks is one
    matrix product in a task.  The row side is sent once for each query block, so its cost is rows times blocks, and with
    ``least`` only what reaches it leaves the task.  A row's pair with itself is left out and values are rounded to
    ``digits``, halves away from zero, before they leave the task, where both are done for a whole block at a time.
    """
    kind = df.schema[key].dataType.simpleString()
    q = materialize(number_rows(_block_rows(queries, key, vector, block, "q"), [F.get("q_keys", F.lit(0))], "_at"), "query-blocks")
    blocks = q.count()
    rows = _block_rows(df, key, vector, row_block, "r").withColumn("_at", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(blocks).cast("long")) if blocks else F.array().cast("array<long>")))
    met = rows.join(q, "_at").drop("_at")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                rk, rx, qk, qx = (batch.column(c)[at].values for c in ("r_keys", "r_x", "q_keys", "q_x"))
                width = len(rx) // max(1, len(rk))
                product = qx.to_numpy().reshape(len(qk), width) @ rx.to_numpy().reshape(len(rk), width).T
                named = qk.is_valid().to_numpy(zero_copy_only=False)[:, None] & rk.is_valid().to_numpy(zero_copy_only=False)[None, :]
                use = named if least is None else named & (product >= least)
                for i in np.flatnonzero(pc.is_in(rk, value_set=qk, skip_nulls=True).to_numpy(zero_copy_only=False)):  # rows that are queries of the block
                    use[pc.equal(qk, rk[int(i)]).fill_null(True).to_numpy(zero_copy_only=False), i] = False
                if digits is not None:
                    product = np.copysign(np.floor(np.abs(product) * 10.0**digits + 0.5), product) / 10.0**digits + 0.0
                at_once = max(1, OUT_ROWS // max(1, len(rk)))
                for j in range(0, len(qk), at_once):  # some queries at a time: what leaves has a bounded size
                    query, other = np.nonzero(use[j : j + at_once])
                    values = product[j : j + at_once][use[j : j + at_once]]
                    yield pa.RecordBatch.from_arrays([qk.take(pa.array(query + j)), rk.take(pa.array(other)), pa.array(values, mask=np.isnan(values))], ["query", "other", "similarity"])

    return met.mapInArrow(run, f"query {kind}, other {kind}, similarity double")
