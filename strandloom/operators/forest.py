"""Single linkage at any threshold: a spanning forest of the similarity graph, and its cuts.

Two nodes are in one cluster at a threshold if a path of edges at or above it joins them.  A maximum spanning forest has
such a path wherever the whole graph has one, and holds fewer edges than nodes, so clusters at every threshold are
components of a part of the forest.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.graph import components
from strandloom.storage import materialize, scratch


def spanning_forest(edges: DataFrame, weight: str = "similarity") -> DataFrame:
    """``a, b, weight, round``: the maximum spanning forest of edges ``a, b, weight`` (any direction, repeats allowed).

    Boruvka's rounds: every component takes its best edge to another one (largest weight, then smallest ends, so the order
    is total and no cycle can close), and the components that these edges join become one.  At least every second
    component goes in a round, so rounds are logarithmic in the nodes; of parallel edges between two components only the
    best goes on.  Best edges are map-side minima, so a hub or a component with a third of all nodes is no single task's
    work, and edges meet the names of their components in joins of written tables, which adaptive execution can split.
    Loops, null ends and null weights are no edges.
    """
    with scratch(edges.sparkSession):
        rows = edges.filter(f"a <> b and {weight} is not null").select(F.struct((-F.col(weight)).alias("far"), F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).alias("e"))
        live = materialize(rows.select(F.col("e.a").alias("ca"), F.col("e.b").alias("cb"), "e").groupBy("ca", "cb").agg(F.min("e").alias("e")), "forest-live")
        turns: list[DataFrame] = []
        while not live.isEmpty():
            ends = live.select(F.col("ca").alias("c"), "ca", "cb", "e").union(live.select(F.col("cb").alias("c"), "ca", "cb", "e"))
            best = ends.groupBy("c").agg(F.min(F.struct("e", "ca", "cb")).alias("m")).select("m.*").distinct()
            best = materialize(best, "forest-best")
            turns.append(best.select("e.a", "e.b", (-F.col("e.far")).alias(weight), F.lit(len(turns) + 1).alias("round")))
            names = components(best.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
            moved = live.join(names.select(F.col("node").alias("ca"), F.col("root").alias("ra")), "ca").join(names.select(F.col("node").alias("cb"), F.col("root").alias("rb")), "cb")
            moved = moved.filter("ra <> rb").groupBy(F.least("ra", "rb").alias("ca"), F.greatest("ra", "rb").alias("cb")).agg(F.min("e").alias("e"))
            live = materialize(moved, "forest-live")
        none = live.select("e.a", "e.b", (-F.col("e.far")).alias(weight), F.lit(0).alias("round"))
        return materialize(reduce(DataFrame.union, turns, none), "forest", outlives=True)


def cuts(forest: DataFrame, thresholds: Sequence[float], weight: str = "similarity") -> dict[float, DataFrame]:
    """For each threshold ``node, root``: the components of the edges at or above it; root is one of a component's nodes.

    The highest threshold comes first, and each lower one starts from its components, so every edge is looked at once.
    All nodes of the forest have a row at each threshold.
    """
    with scratch(forest.sparkSession):
        nodes = forest.select(F.col("a").alias("node")).union(forest.select(F.col("b").alias("node"))).distinct()
        held, above, out = materialize(nodes.select("node", F.col("node").alias("root")), "cut", outlives=True), None, {}
        for t in sorted(set(thresholds), reverse=True):
            new = forest.filter(F.col(weight) >= t) if above is None else forest.filter((F.col(weight) >= t) & (F.col(weight) < above))
            name = lambda end: held.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))  # noqa: E731, B023
            moved = new.select("a", "b").join(name("a"), "a").join(name("b"), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
            joined = components(moved).select(F.col("node").alias("root"), F.col("root").alias("_root"))
            held, above = materialize(held.join(joined, "root", "left").select("node", F.coalesce("_root", "root").alias("root")), "cut", outlives=True), t
            out[t] = held
        return out
