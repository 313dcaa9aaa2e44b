"""Graphs: connected components, clusters, splits, folds and lineage."""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction
from functools import reduce
from math import prod

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandloom.operators.aggregate import quantiles
from strandloom.operators.curate import number_rows
from strandloom.operators.similar import similar_pairs
from strandloom.storage import materialize, scratch


def _contract(edges: DataFrame, turn: int) -> tuple[DataFrame, DataFrame]:
    """Where every node of ``edges`` points to, and the edges between what is left.

    A node points to the least of itself and its neighbours, in the natural order in turn 0 and in the order of a
    hash of its own in every other turn.
    """
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if turn:
        place = lambda c: F.struct(F.xxhash64(F.lit(turn), F.col(c)).alias("at"), F.col(c).alias("node"))
        to = F.least(F.min(place("b")), F.min(place("a")))["node"]
    else:
        to = F.least(F.min("b"), F.min("a"))
    points = materialize(both.groupBy(F.col("a").alias("node")).agg(to.alias("to")), "points")
    moved = edges.join(points.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").join(points.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
    return points, materialize(moved.filter("ta <> tb").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (columns ``a, b``, any order, repeats allowed); root is one node of its component.

    In each turn a node points to the least of itself and its neighbours, edges move to what their ends point to, and
    loops and repeats go.  The first turn takes the natural order, which settles stars around their smallest node; each
    later turn orders nodes by a new hash.  In a random order about half of a path's nodes are nobody's least
    neighbour, so the turns are logarithmic in the number of nodes, whatever their names; and the largest node of a
    component always goes, so they end.  A hub is reduced by map-side minima; its edges meet the pointers, which come
    from storage, in a plain shuffle join, which adaptive skew handling can split.

    The pointers are then composed from the last turn to the first: each step is one join of two written tables, and
    since tables shrink from turn to turn, all steps together cost about as much as the first.  Nulls are no nodes.
    """
    with scratch(edges.sparkSession):
        edges = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
        turns: list[DataFrame] = []
        while not edges.isEmpty():
            points, edges = _contract(edges, len(turns))
            turns.append(points)
        roots = turns.pop().withColumnRenamed("to", "root") if turns else edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        while turns:
            later = roots.select(F.col("node").alias("to"), F.col("root").alias("_root"))  # a node without edges stays where it is
            roots = turns.pop().join(later, "to", "left").select("node", F.coalesce("_root", "to").alias("root"))
            roots = materialize(roots, "roots") if turns else roots
        return materialize(roots, "roots", outlives=True)


def clusters(nodes: DataFrame, edges: DataFrame, key: str) -> DataFrame:
    """``key, root, cluster_size`` for every node; root is the smallest key of its cluster, a node without edges its own.

    ``edges`` has columns ``a`` and ``b``.  A cluster may hold a third of all nodes: what its nodes are joined to is
    written first, so both sides of a join are exchanged and a hot root can be split.
    """
    return named_clusters(nodes, components(edges.select("a", "b")), key)


def named_clusters(nodes: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """:func:`clusters` from components that are known: ``found`` has ``node, root``."""
    least = materialize(found.groupBy("root").agg(F.min("node").alias("least")), "least")
    named = found.join(least, "root").select(F.col("node").alias(key), F.col("least").alias("_least"))
    out = materialize(nodes.select(key).distinct().join(named, key, "left").select(key, F.coalesce("_least", key).alias("root")), "clustered")
    sizes = materialize(out.groupBy("root").agg(F.count(F.lit(1)).alias("cluster_size")), "sizes")
    return out.join(sizes, "root").select(key, "root", "cluster_size")


def similarity_clusters(df: DataFrame, key: str, sequence: str, thresholds: Sequence[float] = (0.8, 0.7, 0.6)) -> DataFrame:
    """Single-linkage clusters at each threshold: ``key, cluster_id, threshold, cluster_size, cluster_method``.

    Pairs are computed once, at the lowest threshold, and one spanning forest of them is cut at all thresholds.  Equal
    sequences are always together.  Clusters are numbered by their smallest key.
    """
    from strandloom.operators.forest import cuts, spanning_forest

    first = df.groupBy(sequence).agg(F.min(key).alias("b"))
    copies = df.select(F.col(key).alias("a"), sequence).join(first, sequence).filter("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    forest = spanning_forest(similar_pairs(df, key, sequence, min(thresholds)).unionByName(copies))
    out = None
    for t, found in cuts(forest, thresholds).items():
        part = number_clusters(named_clusters(df, found, key), f"indel_{round(t * 100)}")
        part = part.withColumn("threshold", F.lit(float(t))).withColumn("cluster_method", F.lit("indel_single_linkage"))
        out = part if out is None else out.unionByName(part)
    return out


def number_clusters(df: DataFrame, prefix: str, root: str = "root") -> DataFrame:
    """``df`` with ``cluster_id``: the prefix and the cluster's place in the order of roots, from one."""
    order = number_rows(df.select(root).distinct(), [F.col(root)], "_at")
    return df.join(order, root).withColumn("cluster_id", F.format_string(f"{prefix}_%06d", F.col("_at"))).drop("_at", root)


def cluster_statistics(df: DataFrame, cluster: str = "cluster_id") -> DataFrame:
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count(F.lit(1)).alias("clusters"), F.max("n").alias("largest"), F.count_if(F.col("n") > 1).alias("multi_member"))


def representatives(df: DataFrame, cluster: str, key: str) -> DataFrame:
    """One row a cluster: the key whose SHA-256 is smallest."""
    text = F.col(key).cast("string")
    return df.groupBy(cluster).agg(F.min_by(key, F.sha2(text, 256)).alias("representative"))


def split_runs(runs: list[tuple[int, int]], shares: dict[str, float]) -> list[list[tuple[str, int]]]:
    """Greedy assignment of clusters to splits, for runs of equal ones: ``runs`` has size and number, the largest size first.

    Each cluster goes to the split that leaves the smallest total deviation from the targets, the first one on ties.  That
    is a closed form: a split stays the choice as long as one more cluster fits below its target, and once all targets are
    reached the first split takes the rest; in between, each split is the choice at most once.  So a run takes a few
    steps, however many clusters it has.  Sums are exact.  Returns, for each run, splits and how many clusters each takes, in order.
    """
    total = sum(n * m for n, m in runs)
    want = {k: total * Fraction(str(x)) for k, x in shares.items()}
    have, out = dict.fromkeys(shares, 0), []
    for n, left in runs:
        parts: list[tuple[str, int]] = []
        while left:
            best = min(want, key=lambda k: abs(have[k] + n - want[k]) - abs(have[k] - want[k]))  # noqa: B023
            if have[best] + n <= want[best]:
                taken = min(left, int((want[best] - have[best]) // n))
            else:
                taken = left if all(have[k] >= want[k] for k in want) else 1
            have[best] += taken * n
            left -= taken
            parts.append((best, taken))
        out.append(parts)
    return out


def clustered_split(df: DataFrame, cluster: str, seed: int = 42, shares: dict[str, float] | None = None) -> DataFrame:
    """``df`` with ``split``: whole clusters, by default eight tenths train, one validation, one test.

    Clusters are taken by falling size, those of one size in the order of a hash.  The driver holds one row a distinct
    size (at most the root of twice the rows); a cluster's place in its run is a global row number.
    """
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("_n"))
    placed = number_rows(sizes, [F.desc("_n"), F.sha2(F.concat(F.lit(str(seed)), F.col(cluster).cast("string")), 256), F.col(cluster)], "_at")
    placed = materialize(placed, "placed")
    runs = [(r[0], r[1]) for r in placed.groupBy("_n").count().orderBy(F.desc("_n")).collect()]
    rows, at = [], 1
    for (n, _), parts in zip(runs, split_runs(runs, shares or {"train": 0.8, "validation": 0.1, "test": 0.1}), strict=True):
        for split, m in parts:
            rows.append((n, at, at + m - 1, split))
            at += m
    plan = df.sparkSession.createDataFrame(rows, "_n long, _from long, _to long, split string")
    named = placed.join(plan, (placed["_n"] == plan["_n"]) & F.col("_at").between(F.col("_from"), F.col("_to"))).select(cluster, "split")
    return df.join(named, cluster)


def fold_runs(runs: list[tuple[tuple[int, ...], int]], folds: int) -> list[list[tuple[list[int], int]]]:
    """Greedy assignment of groups to folds, for runs of groups with equal label counts: ``runs`` has counts and number.

    A group goes to the fold where the squared shares of its labels grow least, the first one on ties.  For equal groups
    that is the fold of the least potential, which then rises by a constant: folds within that constant of the lowest take
    turns in a fixed order until they reach the next one.  Returns, for each run, cycles of folds and how many groups each
    cycle serves, in order; exact integers throughout.
    """
    width = len(runs[0][0]) if runs else 0
    totals = [sum(v[y] * m for v, m in runs) for y in range(width)]
    scale = [prod(t * t for z, t in enumerate(totals) if z != y and t) for y in range(width)]
    have, out = [[0] * width for _ in range(folds)], []
    for vector, left in runs:
        at = [(sum(h * g * w for h, g, w in zip(have[i], vector, scale, strict=True)), i) for i in range(folds)]
        step = sum(g * g * w for g, w in zip(vector, scale, strict=True))
        parts: list[tuple[list[int], int]] = []
        while left:
            at.sort()
            turn = [x for x in at if x < (at[0][0] + step, at[0][1])] or at
            last, others = turn[-1], at[len(turn):]
            cycles = -(-left // len(turn))
            for o in others:  # the last of the cycle still comes before the fold outside
                gap = o[0] - last[0]
                cycles = min(cycles, gap // step + (1 if gap % step or last[1] < o[1] else 0))
            taken = min(left, cycles * len(turn))
            parts.append(([i for _, i in turn], taken))
            for j, (p, i) in enumerate(turn):
                n = taken // len(turn) + (j < taken % len(turn))
                at[j] = (p + n * step, i)
                have[i] = [h + n * g for h, g in zip(have[i], vector, strict=True)]
            left -= taken
        out.append(parts)
    return out


def grouped_folds(df: DataFrame, group: str, label: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """``df`` with ``fold``: no group is in two folds, and each label's rows are spread as evenly as groups allow.

    Groups are taken by falling size, then by their label counts, then by a hash.  The driver holds the labels and one row
    for each distinct vector of label counts; a group's place in its run is a global row number.
    """
    labels = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    counts = F.array(*[F.count_if(F.col(label).eqNullSafe(F.lit(y))) for y in labels]) if labels else F.array(F.count(F.lit(1)))
    rows = df.groupBy(group).agg(counts.alias("_v"), F.count(F.lit(1)).alias("_n"))
    order = [F.desc("_n"), F.col("_v"), F.sha2(F.concat(F.lit(str(seed)), F.col(group).cast("string")), 256), F.col(group)]
    placed = materialize(number_rows(rows, order, "_at"), "placed")
    runs = [(tuple(r["_v"]), r["count"]) for r in placed.groupBy("_n", "_v").count().orderBy(F.desc("_n"), "_v").collect()]
    plan, at = [], 1
    for (vector, _), parts in zip(runs, fold_runs(runs, folds), strict=True):
        for cycle, m in parts:
            plan.append((list(vector), at, at + m - 1, cycle))
            at += m
    plan = df.sparkSession.createDataFrame(plan, "_v array<long>, _from long, _to long, _cycle array<int>")
    fold = F.get("_cycle", ((F.col("_at") - F.col("_from")) % F.size("_cycle")).cast("int"))
    named = placed.join(plan, (placed["_v"] == plan["_v"]) & F.col("_at").between(F.col("_from"), F.col("_to"))).select(group, fold.alias("fold"))
    return df.join(named, group)


def lineage_depth(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """``node, ancestor, depth, complete`` by pointer jumping: each round doubles how far a node sees.

    ``complete`` is false where the chain leaves the table or runs into a cycle.
    """
    state = nodes.select(F.col(node).alias("n"), F.col(parent).alias("to"), F.when(F.col(parent).isNull(), 0).otherwise(1).cast("long").alias("d"))
    state = materialize(state.withColumn("last", F.coalesce("to", "n")), "lineage")
    total, rounds = state.count(), 0
    while (1 << rounds) <= max(1, total):
        ahead = state.select(F.col("n").alias("m"), F.col("to").alias("next"), F.col("d").alias("more"), F.col("last").alias("mlast"), F.lit(True).alias("known"))
        moved = state.join(ahead, F.col("to") == F.col("m"), "left")
        gone = F.col("known").isNotNull()
        state = materialize(moved.select("n", F.when(gone, F.col("next")).otherwise(F.col("to")).alias("to"), (F.col("d") + F.when(gone, F.col("more")).otherwise(0)).alias("d"), F.when(gone, F.col("mlast")).otherwise(F.col("last")).alias("last")), "lineage")
        rounds += 1
        if state.filter("to is not null").join(state.select(F.col("n").alias("m")), F.col("to") == F.col("m"), "left_semi").isEmpty():
            break
    return state.select(F.col("n").alias(node), F.col("last").alias("ancestor"), F.col("d").alias("depth"), F.col("to").isNull().alias("complete"))


def lineage_summary(depths: DataFrame) -> DataFrame:
    """One row from :func:`lineage_depth`: broken chains, and the least, median, mean and largest depth of whole ones below the roots."""
    below = depths.filter("complete and depth > 0")
    whole = below.agg(F.count(F.lit(1)).alias("unbroken"), F.min("depth").alias("least"), F.round(F.avg("depth"), 4).alias("mean"), F.max("depth").alias("largest"))
    middle = quantiles(below, None, "depth", [0.5]).select(F.round(F.col("q")[0], 4).alias("median"))
    broken = depths.agg(F.count_if(~F.col("complete")).alias("broken"))
    return whole.join(F.broadcast(broken)).join(F.broadcast(middle), how="left")  # single rows


def ancestry_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``rule, item`` for every breach of a lineage's rules; empty if it is sound.

    ``nodes``: ``sequence_id, parent_id, seed_id, generation``; ``edges``: ``parent_id, child_id, seed_id, generation``.
    """
    n = nodes.select("sequence_id", "parent_id", "seed_id", "generation")
    seeds = n.filter("parent_id is null and generation = 0").select(F.col("sequence_id").alias("seed_id")).distinct()
    c = n.select(F.col("sequence_id").alias("child_id"), F.col("parent_id").alias("c_parent"), F.col("seed_id").alias("c_seed"), F.col("generation").alias("c_gen"))
    p = n.select(F.col("sequence_id").alias("parent_id"), F.col("seed_id").alias("p_seed"), F.col("generation").alias("p_gen"))
    known = edges.join(c, "child_id").join(p, "parent_id")
    rule = lambda name, df, item: df.select(F.lit(name).alias("rule"), F.col(item).cast("string").alias("item"))
    parts = [
        rule("duplicate_node", n.groupBy("sequence_id").count().filter("count > 1"), "sequence_id"),
        rule("root_not_generation_0", n.filter("parent_id is null and generation <> 0"), "sequence_id"),
        rule("unknown_seed", n.join(seeds, "seed_id", "left_anti"), "sequence_id"),
        rule("edge_unknown_parent", edges.join(p, "parent_id", "left_anti"), "child_id"),
        rule("edge_unknown_child", edges.join(c, "child_id", "left_anti"), "child_id"),
        rule("several_parents", edges.groupBy("child_id").count().filter("count > 1"), "child_id"),
        rule("parent_disagrees", known.filter(~F.col("c_parent").eqNullSafe(F.col("parent_id"))), "child_id"),
        rule("generation_disagrees", known.filter(~F.col("generation").eqNullSafe(F.col("c_gen"))), "child_id"),
        rule("generation_not_increasing", known.filter("p_gen >= c_gen"), "child_id"),
        rule("crosses_seeds", known.filter(~F.col("p_seed").eqNullSafe(F.col("c_seed")) | ~F.col("seed_id").eqNullSafe(F.col("c_seed"))), "child_id"),
        rule("missing_edge", n.filter("parent_id is not null").join(edges.select(F.col("child_id").alias("sequence_id")), "sequence_id", "left_anti"), "sequence_id"),
        rule("extra_edge", edges.join(n.filter("parent_id is not null").select(F.col("sequence_id").alias("child_id")), "child_id", "left_anti"), "child_id"),
    ]
    return reduce(DataFrame.unionByName, parts)


def trace(nodes: DataFrame, node: str, parent: str) -> DataFrame:
    """All ancestors of every node with their distance: ``node, ancestor, depth``, from the node itself at 0 upwards.

    A jump table doubles its reach in each round: it leads from a node to its ancestor 1, 2, 4, ... steps up.  What a node
    sees at distances from one power of two to the next is what the node at the end of its jump has seen so far, so every
    row of the result is made once, in a number of rounds that is logarithmic in the longest chain.  A parent outside the
    table ends a chain.  Where a chain runs into a cycle, each ancestor is listed once, at its smallest distance.  Null
    nodes have no row; repeated rows count once.
    """
    with scratch(nodes.sparkSession):
        steps = materialize(nodes.filter(F.col(node).isNotNull()).select(F.col(node).alias("n"), F.col(parent).alias("to")).distinct(), "trace-steps")
        seen = materialize(steps.select("n", F.col("n").alias("ancestor"), F.lit(0).cast("long").alias("depth")).distinct(), "trace")
        most, jumps = seen.count(), [steps.filter("to is not null")]
        while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= most:
            ahead = jumps[-1].select(F.col("n").alias("to"), F.col("to").alias("next"))
            jumps.append(materialize(jumps[-1].join(ahead, "to").select("n", F.col("next").alias("to")).distinct(), "trace-jump"))
        endless = None if jumps[-1].isEmpty() else materialize(jumps[-1].select("n").distinct(), "trace-endless")
        parts = [seen]
        for k, jump in enumerate(jumps[:-1]):
            sound = jump if endless is None else jump.join(endless, "n", "left_anti")
            parts.append(materialize(_ahead(sound, reduce(DataFrame.union, parts), 1 << k), "trace"))
        if endless is not None:
            held = materialize(seen.join(endless, "n", "left_semi"), "trace")
            n = 0
            for k, jump in enumerate(jumps):
                more = held.union(_ahead(jump.join(endless, "n", "left_semi"), held, 1 << k)).groupBy("n", "ancestor").agg(F.min("depth").alias("depth"))
                before, held = n, materialize(more, "trace")
                n = held.count()
                if n == before:
                    break
            parts.append(held.filter("depth > 0"))
        return materialize(reduce(DataFrame.union, parts).withColumnRenamed("n", node), "traced", outlives=True)


def _ahead(jump: DataFrame, seen: DataFrame, by: int) -> DataFrame:
    """What nodes see beyond a jump of ``by`` steps: all that its end sees, or the end alone if it is outside the table."""
    beyond = seen.select(F.col("n").alias("to"), "ancestor", "depth")
    return jump.join(beyond, "to", "left").select("n", F.coalesce("ancestor", "to").alias("ancestor"), (F.coalesce("depth", F.lit(0)) + by).alias("depth"))
