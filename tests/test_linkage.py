"""Spanning forests and their cuts, splits and folds by runs, ancestors by doubling."""

import random
from fractions import Fraction
from math import prod

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandloom.operators import forest, graph


def kruskal(edges):
    """The forest by a sorted list and one root a node."""
    root, out = {}, set()

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for w, a, b in sorted({(-w, min(a, b), max(a, b)) for a, b, w in edges if a != b and w is not None}):
        if find(a) != find(b):
            root[find(a)] = find(b)
            out.add((a, b, -w))
    return out, {x: find(x) for x in list(root)}


def groups(pairs):
    by = {}
    for node, root in pairs:
        by.setdefault(root, set()).add(node)
    return {frozenset(x) for x in by.values()}


def random_edges(seed, nodes, n):
    rng = random.Random(seed)
    hub = [(0, rng.randrange(nodes), rng.choice([0.6, 0.7, 0.85])) for _ in range(nodes // 3)]
    return hub + [(rng.randrange(nodes), rng.randrange(nodes), rng.choice([0.6, 0.65, 0.7, 0.75, 0.8, 0.9, 1.0, None])) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_is_kruskals_and_its_cuts_are_those_of_all_edges(spark, seed):
    edges = random_edges(seed, 120, 150)
    df = spark.createDataFrame(edges, "a long, b long, similarity double")
    got = forest.spanning_forest(df).collect()
    want, roots = kruskal(edges)
    assert {(r.a, r.b, r.similarity) for r in got} == want and len(got) == len(want)
    assert len(got) == len(roots) - len(set(roots.values()))  # nodes minus components
    levels = (0.8, 0.7, 0.6)
    for t, found in forest.cuts(forest.spanning_forest(df), levels).items():
        _, held = kruskal([(a, b, w) for a, b, w in edges if w is not None and w >= t])
        want_groups = groups(held.items()) | {frozenset([x]) for x in roots if x not in held}
        assert groups((r.node, r.root) for r in found.collect()) == want_groups


def test_rounds_are_logarithmic(spark):
    n = 3000
    path = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"), (F.xxhash64("id") % 1000 / 1000.0).alias("similarity"))
    got = forest.spanning_forest(path).agg(F.count(F.lit(1)).alias("n"), F.max("round").alias("rounds")).first()
    assert got.n == n and got.rounds <= 12
    rising = path.withColumn("similarity", F.col("a") / 1.0)  # every component's best edge is the next one: one round
    assert forest.spanning_forest(rising).agg(F.max("round")).first()[0] == 1


def test_empty_forest(spark):
    none = spark.createDataFrame([(1, 1, 0.9), (None, 2, 0.9)], "a long, b long, similarity double")
    found = forest.spanning_forest(none)
    assert found.count() == 0 and forest.cuts(found, (0.5,))[0.5].count() == 0


def splits_one_by_one(runs, shares):
    total = sum(n * m for n, m in runs)
    want, have, out = {k: total * Fraction(str(x)) for k, x in shares.items()}, dict.fromkeys(shares, 0), []
    for n, m in runs:
        for _ in range(m):
            best = min(want, key=lambda k: sum(abs(have[j] + (n if j == k else 0) - want[j]) for j in want))
            have[best] += n
            out.append(best)
    return out


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=6), st.sampled_from([{"train": 0.8, "validation": 0.1, "test": 0.1}, {"a": 0.5, "b": 0.5}, {"x": 0.2, "y": 0.3, "z": 0.5}]))
def test_runs_of_splits_equal_one_by_one(sizes, shares):
    runs = sorted(sizes.items(), reverse=True)
    assert [k for parts in graph.split_runs(runs, shares) for k, m in parts for _ in range(m)] == splits_one_by_one(runs, shares)


def test_fifty_million_singletons_are_a_few_steps():
    (parts,) = graph.split_runs([(1, 50_000_000)], {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert parts == [("train", 40_000_000), ("validation", 5_000_000), ("test", 5_000_000)]
    (cycles,) = graph.fold_runs([((1, 0), 50_000_000)], 5)
    assert cycles == [([0, 1, 2, 3, 4], 50_000_000)]


def folds_one_by_one(runs, folds):
    width = len(runs[0][0]) if runs else 0
    totals = [sum(v[y] * m for v, m in runs) for y in range(width)]
    scale = [prod(t * t for z, t in enumerate(totals) if z != y and t) for y in range(width)]
    have, out = [[0] * width for _ in range(folds)], []
    for v, m in runs:
        for _ in range(m):
            cost = lambda i: sum(((h + g) ** 2 - h**2) * w for h, g, w in zip(have[i], v, scale, strict=True))  # noqa: B023, E731
            best = min(range(folds), key=lambda i: (cost(i), i))
            have[best] = [h + g for h, g in zip(have[best], v, strict=True)]
            out.append(best)
    return out


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.tuples(st.integers(0, 9), st.integers(0, 9)).filter(any), st.integers(1, 25), max_size=6), st.integers(1, 6))
def test_runs_of_folds_equal_one_by_one(vectors, folds):
    runs = sorted(vectors.items(), key=lambda x: (-sum(x[0]), x[0]))
    got = [cycle[i % len(cycle)] for parts in graph.fold_runs(runs, folds) for cycle, m in parts for i in range(m)]
    assert got == folds_one_by_one(runs, folds)


def test_splits_and_folds_of_tables(spark):
    rng = random.Random(4)
    rows = [(i, f"c{int(rng.paretovariate(0.7)) % 90}", rng.choice([0, 1, None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "k long, c string, y long")
    split = graph.clustered_split(df, "c").collect()
    assert len(split) == len(rows) and len({r.c for r in split}) == len({(r.c, r.split) for r in split})
    sizes = {}
    for _, c, _ in rows:
        sizes[c] = sizes.get(c, 0) + 1
    import hashlib

    order = sorted(sizes, key=lambda c: (-sizes[c], hashlib.sha256(f"42{c}".encode()).hexdigest()))
    want = splits_one_by_one([(sizes[c], 1) for c in order], {"train": 0.8, "validation": 0.1, "test": 0.1})
    assert {r.c: r.split for r in split} == dict(zip(order, want, strict=True))
    folds = graph.grouped_folds(df, "c", "y").collect()
    assert len(folds) == len(rows) and len({(r.c, r.fold) for r in folds}) == len(sizes)
    assert graph.clustered_split(df.limit(0), "c").count() == graph.grouped_folds(df.limit(0), "c", "y").count() == 0


def ancestors(parents):
    out = set()
    for n in parents:
        at, d, met = n, 0, set()
        while at is not None and at not in met:
            met.add(at)
            out.add((n, at, d))
            at, d = parents.get(at), d + 1
    return out


def test_ancestors_of_chains_trees_cycles_and_lost_parents(spark):
    rng = random.Random(2)
    parents = {i: rng.choice([None, rng.randrange(i)]) if i else None for i in range(60)}
    parents |= {100: 101, 101: 102, 102: 100, 103: 100, 104: 103, 110: 110, 111: 110, 120: 999, 121: 120}
    df = spark.createDataFrame([*parents.items(), (121, 120), (None, 3)], "n long, p long")
    got = [tuple(r) for r in graph.trace(df, "n", "p").select("n", "ancestor", "depth").collect()]
    assert len(got) == len(set(got)) and set(got) == ancestors(parents)
    assert graph.trace(df.limit(0), "n", "p").count() == 0


def test_long_chain_and_many_short_ones(spark):
    chain = spark.range(10_000).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"))
    got = graph.trace(chain, "n", "p").agg(F.count(F.lit(1)).alias("n"), F.max("depth").alias("d")).first()
    assert (got.n, got.d) == (10_000 * 10_001 // 2, 9_999)
    short = spark.range(2_000_000).select(F.col("id").alias("n"), F.when(F.col("id") % 2 == 1, F.col("id") - 1).alias("p"))
    assert graph.trace(short, "n", "p").count() == 3_000_000
