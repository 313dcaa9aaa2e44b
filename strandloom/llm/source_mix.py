"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is cut into blocks by a hash of the document identifier; their number follows the source's words, so a block
stays far smaller than a shard.  Its target, in words, becomes whole passes over the source plus a remainder; the
remainder is met by the first blocks of a seeded permutation and, inside the one block where it ends, by the first
documents in seeded order.  So each source has an exact quota of block draws.

The draws are dealt to output shards by recursion: a node that serves ``n`` shards with known source quotas gives its
left half a vector drawn from the multivariate hypergeometric distribution and the rest to its right half.  A leaf
holds, for each source, how many draws it gets; leaves take disjoint runs of the source's permuted draws.  Nodes hold
only the sources that have draws left.  The driver grows the top of the tree, some tens of nodes; tasks grow the
subtrees below and write the runs.  Inside a shard rows are ordered by a seeded hash, which is a local shuffle.

Only counts leave the executors: the driver sees one row a source.  Blocks, runs and draws stay distributed, and every
join is by equality.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandloom.llm.common import materialize, word_count
from strandloom.operators.curate import running_sums

#: Weights of the sources in code point order of their names, null last, repeating.
WEIGHTS = (5.0, 2.0, 1.0)
#: A target stops at so many times its source's size.
MOST = 3.0
#: Words of a block: so many, fewer where all words make less than ``BLOCKS`` of them, more beyond ``MOST_BLOCKS``.
WORDS_A_BLOCK, BLOCKS, MOST_BLOCKS = 4_000_000, 4096, 100_000_000
#: Blocks that a source has at least.
LEAST_BLOCKS = 64
#: Output shards: one for so many words, and so many at least.
WORDS_A_SHARD, SHARDS = 32_000_000, 64
SEED = 20240
#: The driver holds one row a source.
MAX_SOURCES = 1_000_000
#: The driver grows the tree to so many nodes, or until they hold so many counts.
TOP, TOP_COUNTS = 64, 4_000_000
#: Partitions that shards are dealt to at most: beyond, one holds several shards, one after the other.
MOST_PARTS = 65_536
#: A task grows so many shards at least: starting one costs more than a small subtree.
SHARDS_A_TASK = 1024


def targets(sizes: Sequence[int], weights: Sequence[float] = WEIGHTS, most: float = MOST) -> list[float]:
    """Targets of the sources, in order, that share the sum of ``sizes`` by weight.

    A target stops at ``most`` times its source's size; the excess is shared by weight among the others, again and
    again until none is above.  Sources of size zero get zero.
    """
    n = len(sizes)
    w = [float(weights[i % len(weights)]) for i in range(n)]
    total, out, free = float(sum(sizes)), [0.0] * n, set(range(n))
    while free:
        left, weight = total - sum(out[i] for i in range(n) if i not in free), sum(w[j] for j in free)
        share = {i: left * w[i] / weight for i in free}
        over = {i for i in free if share[i] > most * sizes[i]}
        if not over:
            for i in free:
                out[i] = share[i]
            break
        for i in over:
            out[i] = most * sizes[i]
        free -= over
    return out


class Node(NamedTuple):
    """Shards ``lo`` to ``hi`` with, for each source that has any, its number, its draws and the first of them."""

    lo: int
    hi: int
    source: np.ndarray
    count: np.ndarray
    start: np.ndarray


def root(quotas: Sequence[int], shards: int) -> Node:
    count = np.asarray(quotas, dtype=np.int64)
    held = np.flatnonzero(count)
    return Node(0, shards, held, count[held], np.zeros(len(held), dtype=np.int64))


def split(node: Node, total: int, shards: int, seed: int) -> tuple[Node, Node]:
    """Both halves of a node.  Its generator is seeded by its own place, so any task can grow a subtree anew.

    Shards differ by one draw at most: the first ``i`` of them hold ``total * i // shards`` draws.
    """
    mid = (node.lo + node.hi) // 2
    key = hashlib.sha256(f"{seed}/{node.lo}/{node.hi}".encode()).digest()
    rng = np.random.Generator(np.random.PCG64(int.from_bytes(key[:8], "little")))
    need = total * mid // shards - total * node.lo // shards
    left = rng.multivariate_hypergeometric(node.count, need, method="marginals") if len(node.count) else node.count
    right, some = node.count - left, left > 0
    rest = right > 0
    return Node(node.lo, mid, node.source[some], left[some], node.start[some]), Node(mid, node.hi, node.source[rest], right[rest], (node.start + left)[rest])


def leaves(node: Node, total: int, shards: int, seed: int) -> Iterator[Node]:
    """The leaves under a node, depth first: memory holds one path."""
    todo = [node]
    while todo:
        node = todo.pop()
        if node.hi - node.lo == 1:
            yield node
        else:
            todo += reversed(split(node, total, shards, seed))


def top(node: Node, total: int, shards: int, seed: int) -> list[Node]:
    """The nodes at which tasks go on: widest first, up to ``TOP`` of them or ``TOP_COUNTS`` counts."""
    out = [node]
    while len(out) < TOP and sum(len(n.count) for n in out) < TOP_COUNTS:
        at = max(range(len(out)), key=lambda i: out[i].hi - out[i].lo)
        if out[at].hi - out[at].lo == 1:
            break
        out[at : at + 1] = split(out[at], total, shards, seed)
    return out


def split_tree(quotas: Sequence[int], shards: int, seed: int = SEED) -> np.ndarray:
    """How many draws of each source every shard gets, as an array (shards, sources): for small trees and tests."""
    out, total = np.zeros((shards, len(quotas)), dtype=np.int64), int(sum(quotas))
    for leaf in leaves(root(quotas, shards), total, shards, seed):
        out[leaf.lo, leaf.source] = leaf.count
    return out


def runs(spark, quotas: Sequence[int], shards: int, seed: int = SEED) -> DataFrame:
    """``_at, _shard, _from, _count``: the run of draws that a shard gets of the source with number ``_at``.

    One row for each source that a shard takes anything of, so no more rows than draws.
    """
    total = int(sum(quotas))
    nodes = top(root(quotas, shards), total, shards, seed)
    rows = [(n.lo, n.hi, n.source.astype(np.int64).tobytes(), n.count.tobytes(), n.start.tobytes()) for n in nodes]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, *held in zip(*[batch.column(i).to_pylist() for i in range(5)], strict=True):
                for leaf in leaves(Node(lo, hi, *[np.frombuffer(x, dtype=np.int64) for x in held]), total, shards, seed):
                    yield pa.RecordBatch.from_arrays([pa.array(leaf.source), pa.array(np.full(len(leaf.source), leaf.lo)), pa.array(leaf.start), pa.array(leaf.count)], ["_at", "_shard", "_from", "_count"])

    tasks = min(len(rows), -(-shards // SHARDS_A_TASK))
    frame = spark.createDataFrame(rows, "lo long, hi long, source binary, count binary, start binary").repartition(tasks)
    return frame.mapInArrow(grow, "_at long, _shard long, _from long, _count long")


def _same(a: str, b: str, *columns: str):
    """Null-safe equality of the columns of two aliased frames."""
    hit = F.lit(True)
    for c in columns:
        hit = hit & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return hit


def _key(seed: int):
    """What orders the documents of a block."""
    return F.struct(F.xxhash64(F.lit(seed + 2), "_id").alias("hash"), F.col("_id").alias("id"))


def _block(seed: int):
    return F.pmod(F.xxhash64(F.lit(seed), "_id"), F.col("_blocks"))


class Plan(NamedTuple):
    """What is decided before any text is moved.

    ``sizes``: ``_id, _name, size`` of each document.  ``sources``: ``_at, _name, _blocks, source_size, target``, one row
    a source, in order.  ``placed``: for each block of a source ``_at, _block, words, _place`` (in the permutation),
    ``_passes`` (whole passes), ``_left`` (words of the remainder still wanted when the block comes) and ``_last`` (the
    last key that the remainder takes from it, where it ends inside).  ``quotas``: draws of each source, in order.
    """

    sizes: DataFrame
    sources: DataFrame
    placed: DataFrame
    quotas: list[int]
    words: int


def plan(docs: DataFrame, weights: Sequence[float] = WEIGHTS, most: float = MOST, blocks: int | None = None, seed: int = SEED) -> Plan:
    """The plan of ``docs`` (columns ``_id, _text, _name``).  Each source has ``blocks`` blocks, or as its words say."""
    spark = docs.sparkSession
    sizes = materialize(docs.select("_id", "_name", word_count(F.col("_text")).alias("size")), "mix-sizes")
    found = sizes.groupBy("_name").agg(F.sum("size").alias("words")).limit(MAX_SOURCES + 1).collect()  # one row a source
    if len(found) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    order = sorted(found, key=lambda r: (r["_name"] is None, r["_name"] or ""))
    total = sum(r["words"] for r in order)
    a_block = max(1, min(WORDS_A_BLOCK, total // BLOCKS), total // MOST_BLOCKS)
    held = []
    for i, (r, t) in enumerate(zip(order, targets([r["words"] for r in order], weights, most), strict=True)):
        passes = int(min(t // r["words"], most)) if r["words"] else 0
        held.append((i, r["_name"], blocks or max(LEAST_BLOCKS, r["words"] // a_block), r["words"], t, passes, max(0.0, t - passes * r["words"]) if passes < most else 0.0))
    known = materialize(spark.createDataFrame(held, "_at long, _name string, _blocks long, source_size long, target double, _passes int, _rest double"), "mix-sources")
    sized = sizes.alias("a").join(known.alias("s"), _same("a", "s", "_name")).select("_id", "size", "_at", _block(seed).alias("_block"), _key(seed).alias("_key"))
    by_block = sized.groupBy("_at", "_block").agg(F.sum("size").alias("words"))
    # A large source has up to a hundred million blocks: places and totals run over range partitions, not over a source.
    by_block = by_block.withColumns({"_order": F.struct("_at", F.xxhash64(F.lit(seed + 1), "_block").alias("h"), "_block"), "_one": F.lit(1)})
    ranged = running_sums(by_block, F.col("_order"), {"_sum": "words", "_row": "_one"})
    first = ranged.groupBy("_at").agg(F.min(F.col("_sum") - F.col("words")).alias("_words_before"), F.min(F.col("_row") - 1).alias("_rows_before"))  # one row a source
    placed = ranged.join(first, "_at").withColumn("_place", (F.col("_row") - 1 - F.col("_rows_before")).cast("long"))
    placed = placed.withColumn("_left", F.col("words") - (F.col("_sum") - F.col("_words_before")))
    placed = placed.join(known.select("_at", "_passes", "_rest"), "_at").select("_at", "_block", "words", "_place", "_passes", (F.col("_rest") + F.col("_left")).alias("_left"))
    placed = materialize(placed, "mix-blocks")
    # The remainder ends inside one block a source: documents in seeded order until half of the next is over the mark.
    edge = placed.filter((F.col("_left") > 0) & (F.col("_left") < F.col("words"))).select("_at", "_block", "_left")
    before = F.coalesce(F.sum("size").over(Window.partitionBy("_at", "_block").orderBy("_key", "size").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = sized.join(edge, ["_at", "_block"]).withColumn("_before", before).filter(F.col("_before") + F.col("size") / 2 <= F.col("_left")).groupBy("_at", "_block").agg(F.max("_key").alias("_last"))
    placed = materialize(placed.join(last, ["_at", "_block"], "left"), "mix-plan")
    quota = {r["_at"]: int(r["k"]) for r in placed.groupBy("_at").agg(F.sum(_draws()).alias("k")).collect()}
    return Plan(sizes, known, placed, [quota.get(i, 0) for i in range(len(order))], total)


def _draws():
    """How often a block is drawn: its whole passes and, where the remainder takes any of it, once more."""
    return F.col("_passes") + (F.col("_left") > 0).cast("int")


def _extra(key):
    """Whether the remainder takes a document: its whole block, or the block up to the last key."""
    return F.coalesce((F.col("_left") > 0) & ((F.col("_left") >= F.col("words")) | (key <= F.col("_last"))), F.lit(False))


def _dealt(docs: DataFrame, planned: Plan, shards: int | None, seed: int) -> DataFrame:
    """The rows of ``docs`` (``_id, _text, _name`` and more), once for each draw, with ``_shard`` and ``_order``.

    A shard's runs are unrolled into draws, a row a draw; draws are numbered pass by pass, and since only the first
    blocks of a pass are drawn in the last of them, numbers are dense and name a block.  Draws are few and are written
    first, so Spark knows their size when it picks the join: the texts are shuffled once more only where it is large.
    """
    shards = shards or max(SHARDS, planned.words // WORDS_A_SHARD)
    given = runs(docs.sparkSession, planned.quotas, shards, seed)
    given = given.select("_at", "_shard", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_count") - 1)).alias("_number"))
    whole = planned.placed.groupBy("_at").agg(F.count(F.lit(1)).alias("_n"))
    drawn = planned.placed.filter(_draws() > 0).join(whole, "_at").withColumn("_pass", F.explode(F.sequence(F.lit(0), _draws() - 1)))
    drawn = drawn.withColumn("_number", F.col("_pass") * F.col("_n") + F.col("_place"))
    draws = materialize(drawn.join(given, ["_at", "_number"]).select("_at", "_block", "words", "_left", "_last", "_passes", "_pass", "_shard"), "mix-draws")
    names = planned.sources.select("_at", F.col("_name").alias("_of"), "_blocks")
    placed = docs.join(names, F.col("_name").eqNullSafe(F.col("_of"))).withColumn("_block", _block(seed))
    rows = placed.join(draws, ["_at", "_block"]).filter((F.col("_pass") < F.col("_passes")) | _extra(_key(seed)))
    rows = rows.select(*docs.columns, "_shard", F.xxhash64(F.lit(seed + 3), "_id", "_pass").alias("_order"))
    parts = min(shards, MOST_PARTS)
    return rows.repartitionById(parts, (F.col("_shard") % parts).cast("int")).sortWithinPartitions("_shard", "_order")


def mixture(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, seed: int = SEED, **how) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, size, source_size, target, taken``.

    ``size`` is its number of words (null text: 0), ``target`` its source's share, ``taken`` the words of it that the
    mix takes, each repeat counted, never over ``most`` times its size.  The mix is made for it: rows are dealt to their
    shards with their texts and shuffled there, and ``taken`` counts what arrives.  A null source is a source, the last
    in order.  Documents without words or draws take nothing; a very long one is dealt whole.  Rows that repeat an identifier are taken together.
    Columns that are not named are not read.  An empty table gives an empty result.  The same rows, weights and seed give
    the same answer.
    """
    docs = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"), F.col(source).cast("string").alias("_name"))
    planned = plan(docs, seed=seed, **how)
    dealt = materialize(_dealt(docs, planned, shards, seed).select("_id", "_name", word_count(F.col("_text")).alias("size")), "mix-dealt")
    # Rows with one identifier, source and size cannot be told apart: each takes an equal part of their draws.
    same = ("_id", "_name", "size")
    drawn, rows = dealt.groupBy(*same).agg(F.count(F.lit(1)).alias("_drawn")), planned.sizes.groupBy(*same).agg(F.count(F.lit(1)).alias("_rows"))
    each = rows.alias("r").join(drawn.alias("d"), _same("r", "d", *same), "left").select("r.*", F.coalesce("_drawn", F.lit(0)).alias("_drawn"))
    each = each.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows")))
    both = each.alias("a").join(planned.sources.alias("b"), _same("a", "b", "_name"))
    return both.select(F.col("a._id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("_drawn") / F.col("_rows")).cast("long").alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", shards: int | None = None, seed: int = SEED, places: bool = True, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as it is drawn, with ``mix_shard`` and ``mix_order``.

    The draws of a source, in permuted order and pass after pass, are cut into runs, one for each shard; the splitting
    tree says how long each run is.  Runs are disjoint and cover every draw.  Rows are partitioned by shard and ordered
    by a seeded hash inside it.  Without a number of ``shards`` it follows the words, so a shard's size has a bound.

    Without ``places`` only the columns of ``docs`` come out; they may have any names and types.  A null text has no
    words, a null source is a source, rows that repeat an identifier are drawn together, and documents of a block are
    drawn with it even if they have no words.  A table without words or rows gives an empty result.
    """
    names = docs.columns
    at, body, of = (names.index(x) for x in (id_col, text, source))
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))]).withColumns({"_id": F.col(f"_c{at}"), "_text": F.col(f"_c{body}"), "_name": F.col(f"_c{of}").cast("string")})
    planned = plan(plain.select("_id", "_text", "_name"), seed=seed, **how)
    slim = plain.select("_id", "_name", *[f"_c{i}" for i in range(len(names))])
    out = _dealt(slim, planned, shards, seed)
    own = [F.col(f"_c{i}").alias(n) for i, n in enumerate(names)]
    return out.select(*own, F.col("_shard").alias("mix_shard"), F.col("_order").alias("mix_order")) if places else out.select(*own)
