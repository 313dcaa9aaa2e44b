"""Random forests fitted level by level: tasks count, the driver holds the trees.

Values are cut into bins by exact quantiles of all rows, and rows with equal bins and label become one with a count.  A row's
weight in a tree is a Poisson draw by its count from a hash of seed, row and tree, so a forest does not depend on
partitioning.  A level is one pass over the rows: a task takes them through the trees so far and adds up weights by node,
drawn feature, bin and class; the sums of some nodes of a tree meet in one task, which finds the best cut of each.  The
driver gets a row a node, tasks hold a million rows of some bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.curate import running_sums
from strandloom.storage import materialize

#: Bins of a feature; copies of a row that are drawn at once, so that a draw fits a byte.
BINS, COPIES = 32, 64
#: Rows counted at once, rows taken through a tree at once, nodes of a tree whose sums meet in one task.
ROWS, TURN, NODES = 1 << 20, 1 << 15, 256
#: What a cut has to gain: less is rounding.
LEAST_GAIN = 1e-12


@dataclass
class Forest:
    """Trees as arrays: feature (-1 in a leaf), threshold, children, and the share of class 1."""

    trees: list[dict[str, np.ndarray]]


def matrix(arrays: pa.Array) -> np.ndarray:
    """Arrays of numbers, all of one length, as rows."""
    flat = arrays.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    sizes = arrays.value_lengths().to_numpy(zero_copy_only=False)
    if arrays.null_count or np.isnan(x).any() or (len(sizes) and (sizes != sizes[0]).any()):
        raise ValueError("features have to be arrays of one length without nulls or NaN")
    return x.reshape(len(arrays), -1) if len(arrays) else np.zeros((0, 0))


def _packed(rows: np.ndarray) -> pa.Array:
    """Rows of bytes as binary values."""
    n, width = rows.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, max(width, 1), dtype=np.int32)[: n + 1]), pa.py_buffer(np.ascontiguousarray(rows))])


def _unpacked(values: pa.Array, width: int) -> np.ndarray:
    _, ends, raw = values.buffers()
    at = np.frombuffer(ends, dtype=np.int32)[values.offset] if len(values) else 0
    return np.frombuffer(raw or b"", dtype=np.uint8)[at : at + len(values) * width].reshape(len(values), width)


def bin_cuts(rows: DataFrame, total: int, bins: int = BINS) -> list[np.ndarray]:
    """Of each feature the thresholds between its bins, halfway between neighbouring values.

    A feature of few values has a bin for each.  Else bins are quantiles of all rows, where a value that many rows share
    counts as one bin's rows at most: the others are told apart by the bins it would have taken.
    """
    by = rows.select(F.posexplode("features").alias("f", "v")).groupBy("f", "v").agg(F.count(F.lit(1)).alias("n"))
    counted = by.select(F.struct("f", "v").alias("o"), F.least("n", F.lit(math.ceil(total / bins))).alias("e"), F.lit(1).alias("one"))
    run = running_sums(counted, F.col("o"), {"upto": "e", "place": "one"}).withColumn("from", F.col("upto") - F.col("e"))
    whole = run.groupBy(F.col("o.f").alias("g")).agg(F.sum("e").alias("all"), F.min("from").alias("start"), F.count(F.lit(1)).alias("values"), F.min("place").alias("first"))  # one row a feature
    at = F.when(F.col("values") <= bins, F.col("place") - F.col("first")).otherwise(F.floor((F.col("from") - F.col("start")) * bins / F.col("all")))
    ends = run.join(F.broadcast(whole), F.col("o.f") == F.col("g")).groupBy("g", at.alias("b")).agg(F.min("o.v").alias("lo"), F.max("o.v").alias("hi")).collect()  # a row a bin
    out = []
    for f in range(max((r["g"] for r in ends), default=-1) + 1):
        own = sorted((r["b"], r["lo"], r["hi"]) for r in ends if r["g"] == f)
        hi, lo = np.array([r[2] for r in own[:-1]], dtype=float), np.array([r[1] for r in own[1:]], dtype=float)
        middle = hi + (lo - hi) / 2
        out.append(np.where(middle < lo, middle, hi))
    return out


def to_bins(x: np.ndarray, cuts: Sequence[np.ndarray], kind: type = np.uint8) -> np.ndarray:
    """Of each value the number of thresholds below it."""
    out = np.empty((len(x), len(cuts)), dtype=kind)
    for f, cut in enumerate(cuts):
        out[:, f] = np.searchsorted(cut, x[:, f], side="left")
    return out


def _mixed(z: np.ndarray) -> np.ndarray:
    """The finalizer of SplitMix64."""
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def _poisson(most: int) -> tuple[np.ndarray, np.ndarray]:
    """Distribution functions for means 1 to ``most``, one after the other and each raised by its place, and where each begins."""
    tables = []
    for mean in range(1, most + 1):
        up = np.cumsum(np.exp([k * math.log(mean) - mean - math.lgamma(k + 1) for k in range(256)]))
        tables.append(mean - 1 + np.minimum(up[: int(np.searchsorted(up, 1 - 1e-15)) + 1], 1.0))
        tables[-1][-1] = mean
    return np.concatenate(tables), np.cumsum([0, *map(len, tables[:-1])])


_POISSON = _poisson(COPIES)


def bag_weights(hashes: np.ndarray, copies: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """How often each row, of 1 to ``COPIES`` copies, is in the bag of each tree: (rows, trees), as bytes."""
    cdf, start = _POISSON
    own = _mixed(hashes.astype(np.int64).view(np.uint64) ^ _mixed(np.array([seed], dtype=np.int64).view(np.uint64)))
    out = np.empty((len(hashes), trees), dtype=np.uint8)
    for t in range(trees):
        u = (_mixed(own + np.uint64((t + 1) * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(12)) * 2.0**-52
        at = np.searchsorted(cdf, copies - 1 + u, side="right")
        out[:, t] = at - start[copies - 1]
    return out


def instances(rows: DataFrame, cuts: Sequence[np.ndarray], classes: np.ndarray, trees: int, seed: int) -> DataFrame:
    """``bins, label, weights``: each distinct row in bytes, with its class's place and its weight in each tree; written."""

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                y = np.searchsorted(classes, batch.column("label").to_numpy()).astype(np.int32)
                yield pa.RecordBatch.from_arrays([_packed(to_bins(matrix(batch.column("features")), cuts)), pa.array(y)], ["bins", "label"])

    def drawn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = bag_weights(batch.column("hash").to_numpy(), batch.column("n").to_numpy(), trees, seed)
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("label"), _packed(weights)], ["bins", "label", "weights"])

    own = rows.mapInArrow(binned, "bins binary, label int").groupBy("bins", "label").agg(F.count(F.lit(1)).alias("all"))
    parts = own.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("all") - 1) / COPIES))))
    each = parts.select("bins", "label", F.least(F.lit(COPIES), F.col("all") - F.col("part") * COPIES).cast("long").alias("n"), F.xxhash64("bins", "label", "part").alias("hash"))
    return materialize(each.mapInArrow(drawn, "bins binary, label int, weights binary"), "bags")


def level_sums(x: np.ndarray, y: np.ndarray, w: np.ndarray, routes: Sequence[tuple[np.ndarray, np.ndarray, np.ndarray]], drawn: np.ndarray, classes: int) -> np.ndarray:
    """Of one tree's open nodes the weights by drawn feature, bin and class: (nodes, features, bins, classes).

    ``routes`` has of each level above the feature and the bin that split its open nodes, and of each side the place of the child among
    the next level's open nodes.  Behind the last of them is a place for rows that have come to a leaf.
    """
    width, (nodes, most) = x.shape[1], drawn.shape
    flat, size, features = x.reshape(-1), nodes * BINS * classes, np.ascontiguousarray(drawn.T)
    out, keys, weights, held = np.zeros((most, size)), [], [], 0

    def add() -> None:
        nonlocal held
        weight = np.concatenate(weights)
        for j in range(most):
            out[j] += np.bincount(np.concatenate([k[j] for k in keys]), weight, size)
        keys.clear(), weights.clear()
        held = 0

    for i in range(0, len(x), TURN):
        at = np.flatnonzero(w[i : i + TURN]) + i
        base, s = at * width, np.zeros(len(at), dtype=np.intp)
        for level, (feature, cut, child) in enumerate(routes, 1):
            s = child.take(2 * s + (flat.take(base + feature.take(s)) > cut.take(s)))
            if level % 4 == 0 or level == len(routes):
                on = np.flatnonzero(s < (nodes if level == len(routes) else len(routes[level][0]) - 1))
                if len(on) < len(s):
                    at, base, s = at.take(on), base.take(on), s.take(on)
        place = s * (BINS * classes) + y.take(at)
        block = np.empty((most, len(at)), dtype=np.intp)
        for j in range(most):
            np.multiply(flat.take(base + features[j].take(s)), classes, out=block[j], dtype=np.intp)
            block[j] += place
        keys.append(block)
        weights.append(w.take(at).astype(np.float64))
        held += len(at)
        if held >= size:
            add()
    if held:
        add()
    return out.reshape(most, nodes, BINS, classes).swapaxes(0, 1)


def best_cuts(counts: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node the drawn feature (-1: none gains) and bin of the largest fall of Gini impurity, and the counts by class of both sides."""
    left = np.cumsum(counts, axis=2)
    whole = left[:, :1, -1:, :]
    right = whole - left

    def purity(side: np.ndarray) -> np.ndarray:
        heavy = side * weights
        return np.divide((heavy**2).sum(axis=-1), total := heavy.sum(axis=-1), out=np.zeros(side.shape[:-1]), where=total > 0)

    all_of = (whole * weights).sum(axis=-1)
    gain = (purity(left) + purity(right) - purity(whole)) / np.maximum(all_of, 1e-300)
    gain[(left.sum(axis=-1) == 0) | (right.sum(axis=-1) == 0)] = 0.0
    flat = gain.reshape(len(gain), -1)
    spot, node = flat.argmax(axis=1), np.arange(len(flat))
    feature, cut = np.divmod(spot, counts.shape[2])
    good = flat[node, spot] > LEAST_GAIN
    return np.where(good, feature, -1), cut, np.where(good[:, None], left[node, feature, cut], whole[:, 0, 0]), np.where(good[:, None], right[node, feature, cut], 0)


def _planes(values: np.ndarray) -> bytes:
    """Lowest bytes first, then the next ones: those that are nothing lie together, which a shuffle compresses."""
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def _of_planes(raw: np.ndarray, kind: type) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _written(counts: np.ndarray) -> tuple[int, bytes]:
    """Counts as bytes: all of them in two or eight each, or gaps between places and counts where most are nothing."""
    flat = np.ascontiguousarray(counts).reshape(-1)
    there = np.flatnonzero(flat)
    if len(there) * 8 < len(flat):
        return 0, _planes(np.diff(there, prepend=0).astype(np.uint32)) + _planes(flat[there].astype(np.int64))
    kind = np.uint16 if flat.max() < 1 << 16 else np.int64
    return np.dtype(kind).itemsize, _planes(flat.astype(kind))


def _add(out: np.ndarray, size: int, raw: bytes) -> None:
    data = np.frombuffer(raw, dtype=np.uint8)
    if size:
        out += _of_planes(data, np.uint16 if size == 2 else np.int64)
    else:
        n = len(data) // 12 * 4
        out[np.cumsum(_of_planes(data[:n], np.uint32), dtype=np.int64)] += _of_planes(data[n:], np.int64)


def _counter(held, width: int, trees: int, classes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The pass over the rows: ``tree, part, nodes, size, sums`` for each million of them."""

    def sums(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> Iterator[pa.RecordBatch]:
        for t, (routes, drawn) in held.value.items():
            counts = level_sums(x, y, w[t], routes, drawn, classes)
            for part in range(0, len(counts), NODES):
                piece = counts[part : part + NODES]
                size, raw = _written(piece)
                numbers = {"tree": t, "part": part, "nodes": len(piece), "size": size}
                yield pa.RecordBatch.from_pydict({k: pa.array([v], pa.int32()) for k, v in numbers.items()} | {"sums": pa.array([raw], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y, w, n = np.empty((ROWS, width), dtype=np.uint8), np.empty(ROWS, dtype=np.uint8), np.empty((trees, ROWS), dtype=np.uint8), 0
        for batch in batches:
            i = 0
            while i < batch.num_rows:
                part = batch.slice(i, ROWS - n)
                m = part.num_rows
                x[n : n + m], y[n : n + m], w[:, n : n + m] = _unpacked(part.column("bins"), width), part.column("label").to_numpy(), _unpacked(part.column("weights"), trees).T
                i, n = i + m, n + m
                if n == ROWS:
                    yield from sums(x, y, w)
                    n = 0
        if n:
            yield from sums(x[:n], y[:n], w[:, :n])

    return run


def _chooser(most: int, classes: int, weights: np.ndarray) -> Callable:
    """Adds up what the pass gives of some nodes of a tree: ``tree, node, feature, cut, left, right``, a row a node."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        counts = np.zeros(table.column("nodes")[0].as_py() * most * BINS * classes, dtype=np.int64)
        for size, raw in zip(table.column("size").to_pylist(), table.column("sums"), strict=True):
            _add(counts, size, raw.as_buffer())
        feature, cut, left, right = best_cuts(counts.reshape(-1, most, BINS, classes), weights)
        n, lists = len(feature), lambda v: pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1) * classes, pa.int32()), pa.array(v.reshape(-1), pa.int64()))
        part = key[1].as_py()
        return pa.table({"tree": pa.array(np.full(n, key[0].as_py()), pa.int32()), "node": pa.array(np.arange(part, part + n), pa.int32()), "feature": pa.array(feature, pa.int32()), "cut": pa.array(cut, pa.int32()), "left": lists(left), "right": lists(right)})

    return run


def fit(rows: DataFrame, trees: int, depth: int, balanced: bool, seed: int) -> Forest:
    """A forest on ``features, label``, which are read some times and should be written; labels are numbers.

    Each node draws the square root of the features, rounded up.  A node of one class, or that no cut makes purer, is a leaf.
    """
    sizes = {r[0]: r[1] for r in rows.groupBy("label").count().collect()}  # one row a class
    if not sizes or None in sizes:
        raise ValueError("a forest needs rows, and a label for each")
    classes = np.array(sorted(sizes))
    total = sum(sizes.values())
    weights = np.array([total / (len(classes) * sizes[c]) if balanced else 1.0 for c in classes.tolist()])
    cuts = bin_cuts(rows, total)
    width, spark = len(cuts), rows.sparkSession
    most = math.ceil(math.sqrt(width))
    held = instances(rows, cuts, classes, trees, seed)
    kinds = "tree int, node int, feature int, cut int, left array<long>, right array<long>"

    # nodes of each tree, the routes through its levels, and the nodes of the level at hand that may be split
    out = [{"feature": [-1], "threshold": [0.0], "left": [0], "right": [0], "counts": [np.zeros(len(classes))]} for _ in range(trees)]
    routes, open_ = [[] for _ in range(trees)], [[0] for _ in range(trees)]
    for level in range(depth):
        drawn = {t: np.argsort(np.random.default_rng([seed % 2**63, t, level]).random((len(open_[t]), width)), axis=1, kind="stable")[:, :most] for t in range(trees) if open_[t]}
        if not drawn:
            break
        sent = spark.sparkContext.broadcast({t: (routes[t], d) for t, d in drawn.items()})
        sums = held.mapInArrow(_counter(sent, width, trees, len(classes)), "tree int, part int, nodes int, size int, sums binary")
        found = sums.groupBy("tree", "part").applyInArrow(_chooser(most, len(classes), weights), kinds).toArrow().sort_by([("tree", "ascending"), ("node", "ascending")])
        sent.destroy()
        tree, feature, cut = (found.column(c).to_numpy() for c in ("tree", "feature", "cut"))
        left, right = (found.column(c).combine_chunks().flatten().to_numpy().reshape(-1, len(classes)) for c in ("left", "right"))
        for t, picks in drawn.items():
            nodes, own, following = out[t], np.flatnonzero(tree == t), []
            split, bound = np.zeros(len(picks) + 1, dtype=np.intp), np.full(len(picks) + 1, BINS, dtype=np.uint8)
            child = np.full(2 * len(picks) + 2, -1, dtype=np.intp)
            for slot, (node, i) in enumerate(zip(open_[t], own, strict=True)):
                if level == 0:
                    nodes["counts"][node] = left[i] + right[i]
                if feature[i] < 0:
                    continue
                f = int(picks[slot, feature[i]])
                split[slot], bound[slot] = f, cut[i]
                nodes["feature"][node], nodes["threshold"][node] = f, cuts[f][cut[i]]
                for side, counts in enumerate((left[i], right[i])):
                    nodes["left" if side == 0 else "right"][node] = at = len(nodes["feature"])
                    for column, value in (("feature", -1), ("threshold", 0.0), ("left", 0), ("right", 0), ("counts", counts)):
                        nodes[column].append(value)
                    if (counts > 0).sum() > 1:
                        child[2 * slot + side] = len(following)
                        following.append(at)
            child[child < 0] = len(following)
            routes[t].append((split, bound, child))
            open_[t] = following
    ones = classes == 1
    for nodes in out:
        heavy = np.array(nodes.pop("counts")) * weights
        whole = heavy.sum(axis=1)
        nodes["share"] = np.divide(heavy[:, ones].sum(axis=1), whole, out=np.zeros(len(whole)), where=whole > 0)
    return Forest([{k: np.array(v) for k, v in nodes.items()} for nodes in out])


@dataclass
class Paths:
    """A forest to be walked: thresholds of each feature, and of each tree its depth, splits, children and shares.

    A split is a feature times 2**32 plus the place of its threshold; a leaf leads to itself.
    """

    cuts: list[np.ndarray]
    trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]


def paths(trees: Sequence[dict[str, np.ndarray]]) -> Paths:
    width = max(int(t["feature"].max()) for t in trees) + 1
    feature, threshold = (np.concatenate([t[c] for t in trees]) for c in ("feature", "threshold"))
    cuts = [np.unique(threshold[feature == f]) for f in range(width)]
    out = []
    for t in trees:
        inner, split = t["feature"] >= 0, np.full(len(t["feature"]), (1 << 32) - 1, dtype=np.int64)
        for f, cut in enumerate(cuts):
            own = t["feature"] == f
            split[own] = (f << 32) + np.searchsorted(cut, t["threshold"][own])
        here = np.arange(len(split))
        child = np.stack([np.where(inner, t["left"], here), np.where(inner, t["right"], here)], axis=1).astype(np.intp).reshape(-1)
        depth, level = 0, np.array([0]) if inner[0] else np.array([], dtype=int)
        while len(level):
            depth, level = depth + 1, np.concatenate([t["left"][level], t["right"][level]]).astype(int)
            level = level[inner[level]]
        out.append((depth, split, child, np.asarray(t["share"], dtype=float)))
    return Paths(cuts, out)


def walk(forest: Paths, x: np.ndarray) -> np.ndarray:
    """Class-1 share of each row in each tree: (rows, trees)."""
    width = len(forest.cuts)
    flat = to_bins(x, forest.cuts, np.min_scalar_type(max(map(len, forest.cuts), default=0))).reshape(-1)
    out, base = np.empty((len(forest.trees), len(x))), np.arange(len(x)) * width
    for k, (depth, split, child, share) in enumerate(forest.trees):
        at = np.zeros(len(x), dtype=np.intp)
        for _ in range(depth):
            code = split.take(at)
            at = child.take(2 * at + (flat.take(base + (code >> 32)) > (code & 0xFFFFFFFF)))
        out[k] = share.take(at)
    return out.T
