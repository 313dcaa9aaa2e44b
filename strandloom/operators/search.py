"""Search by mutation: children, memoised evaluation, generations.

Randomness is a hash of seed, parent, generation and child number, so a generation is one DataFrame step that gives the
same children in any partitioning.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.biophysics import boman_index, fitness, gravy, hydrophobic_moment, net_charge, synthesis_reason, synthesizable
from strandloom.functions.sequence import LONGEST, RESIDUES, SHORTEST, canonical, sequence_id
from strandloom.operators.curate import first_wins
from strandloom.operators.ranking import top_k, top_k_per_group
from strandloom.storage import materialize


def _uniform(*parts: Column) -> Column:
    """A number in [0, 1) from a hash."""
    return F.pmod(F.xxhash64(*parts), F.lit(1 << 53)) / float(1 << 53)


def mutate(parents: DataFrame, key: str, sequence: str, children: int, seed: int, generation: int, p: tuple[float, float, float] = (0.70, 0.15, 0.15)) -> DataFrame:
    """``parents`` with ``child, mutation_type, position, delta``: ``children`` rows for each parent.

    A substitution always changes the residue.  At the longest or shortest length what would leave the bounds becomes a
    substitution.
    """
    if min(p) < 0 or not sum(p) > 0 or any(x != x or x == float("inf") for x in p):
        raise ValueError("probabilities have to be finite and not negative, one of them positive")
    rows = parents.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(children - 1))))
    draw = lambda name: _uniform(F.lit(seed), F.lit(generation), F.col(key), F.col("_k"), F.lit(name))
    s, n = F.col(sequence), F.length(sequence)
    can_insert, can_delete = n < LONGEST, n > SHORTEST
    ws, wi, wd = F.lit(float(p[0])), F.when(can_insert, float(p[1])).otherwise(0.0), F.when(can_delete, float(p[2])).otherwise(0.0)
    x = draw("kind") * (ws + wi + wd)
    kind = F.when(ws + wi + wd == 0, "sub").when(x < ws, "sub").when(x < ws + wi, "ins").otherwise("del")
    rows = rows.withColumn("mutation_type", kind)
    at = F.floor(draw("at") * (n + F.when(F.col("mutation_type") == "ins", 1).otherwise(0))).cast("int")
    rows = rows.withColumn("position", at)
    old = F.substring(s, F.col("position") + 1, F.lit(1))
    others = F.replace(F.lit(RESIDUES), old, F.lit(""))
    new = F.when(F.col("mutation_type") == "sub", F.substring(others, F.floor(draw("to") * 19).cast("int") + 1, F.lit(1))).otherwise(F.substring(F.lit(RESIDUES), F.floor(draw("to") * 20).cast("int") + 1, F.lit(1)))
    head, tail = F.substring(s, F.lit(1), F.col("position")), F.substring(s, F.col("position") + 1, n)
    cut = F.substring(s, F.col("position") + 2, n)
    child = F.when(F.col("mutation_type") == "sub", F.concat(head, new, cut)).when(F.col("mutation_type") == "ins", F.concat(head, new, tail)).otherwise(F.concat(head, cut))
    spot = F.col("position").cast("string")
    delta = F.when(F.col("mutation_type") == "sub", F.concat(old, spot, new)).when(F.col("mutation_type") == "ins", F.concat(F.lit("ins_"), spot, F.lit("_"), new)).otherwise(F.concat(F.lit("del_"), spot, F.lit("_"), old))
    return rows.withColumn("child", child).withColumn("delta", delta).drop("_k")


def default_score(sequence: Column) -> Column:
    """The analytic fitness of a sequence: a struct."""
    ok = synthesizable(synthesis_reason(sequence))
    return fitness(net_charge(sequence), hydrophobic_moment(sequence), boman_index(sequence), gravy(sequence), ok)


@dataclass
class Evaluator:
    """Scores distinct sequences once: invalid and reference sequences are rejected, known scores are looked up.

    ``score`` maps a sequence column to a struct with ``composite_fitness``; ``counts`` is the ledger.
    """

    score: Callable[[Column], Column] = default_score
    reference: DataFrame | None = None
    scored: DataFrame | None = None
    counts: dict[str, int] = field(default_factory=lambda: {"requests": 0, "unique_calls": 0, "cache_hits": 0, "rejections": 0})

    def evaluate(self, df: DataFrame, sequence: str) -> DataFrame:
        """``df`` with ``status`` (scored, cached or rejected) and ``composite_fitness``; also updates ledger and memory."""
        good = canonical(F.col(sequence)) & F.length(sequence).between(SHORTEST, LONGEST)
        rows = df.withColumn("_good", good)
        if self.reference is not None:
            ref = self.reference.select(F.col(self.reference.columns[0]).alias("_r")).distinct().withColumn("_in", F.lit(True))
            rows = rows.join(ref, F.col(sequence) == F.col("_r"), "left").withColumn("_good", F.col("_good") & F.col("_in").isNull()).drop("_r", "_in")
        known = self.scored
        wanted = rows.filter("_good").select(F.col(sequence).alias("_s")).distinct()
        fresh = wanted if known is None else wanted.join(known, wanted["_s"] == known["scored_sequence"], "left_anti")
        new = materialize(fresh.select(F.col("_s").alias("scored_sequence"), self.score(F.col("_s"))["composite_fitness"].alias("composite_fitness")), "scored")
        memory = new.withColumn("_new", F.lit(True))
        if known is not None:
            memory = memory.unionByName(known.withColumn("_new", F.lit(False)))
        out = rows.join(memory, F.col(sequence) == F.col("scored_sequence"), "left")
        status = F.when(~F.col("_good"), "rejected").when(F.col("_new"), "scored").otherwise("cached")
        out = materialize(out.withColumn("status", status).drop("_good", "_new", "scored_sequence"), "evaluated")
        seen = out.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "rejected").alias("bad"), F.count_if(F.col("status") == "cached").alias("old")).first()
        fresh_n = new.count()
        self.scored = new if known is None else materialize(known.unionByName(new), "memory")
        for k, v in (("requests", seen["n"]), ("unique_calls", fresh_n), ("cache_hits", seen["n"] - seen["bad"] - fresh_n), ("rejections", seen["bad"])):
            self.counts[k] += v
        return out


def evolve(seeds: DataFrame, evaluator: Evaluator, generations: int = 14, budget: int = 3500, stagnation: int = 5, children: int = 4, per_family: int = 20, beam: int | None = None, seed: int = 42, tournament: int = 3) -> tuple[DataFrame, DataFrame, list[dict]]:
    """``(nodes, edges, history)`` of a search from ``seeds`` (``sequence_id, sequence, family``).

    A generation mutates its parents, drops children that equal their parent, evaluates, and keeps the best ``per_family``
    of each family (with ``beam``: also the best ``beam`` of all; then children that were scored before stay, otherwise
    they go).  It stops at the generation, budget of scored sequences, or after ``stagnation`` generations without news.
    The last generation is cut to the budget by score order.  The loop is the driver's; every generation is written.
    """
    start = evaluator.evaluate(seeds, "sequence").filter("status <> 'rejected'")
    columns = ["sequence_id", "sequence", "family", "parent_id", "seed_id", "generation", "mutation_type", "position", "delta", "composite_fitness"]
    nodes = start.withColumns({"parent_id": F.lit(None).cast("string"), "seed_id": F.col("sequence_id"), "generation": F.lit(0), "mutation_type": F.lit("seed"), "position": F.lit(-1), "delta": F.lit("")}).select(*columns)
    nodes = materialize(nodes, "nodes")
    edges, history, parents, still = None, [], nodes, 0
    order = [F.desc("composite_fitness"), F.asc("sequence")]
    for g in range(1, generations + 1):
        left = budget - evaluator.counts["unique_calls"]
        if left <= 0 or still >= stagnation:
            break
        if beam is None and tournament > 1:  # of each drawn group of the family the best breeds
            group = F.pmod(F.xxhash64(F.lit(seed), F.lit(g), "sequence_id"), F.greatest(F.lit(1), F.lit(-(-per_family // tournament))))
            breeding = top_k_per_group(parents.withColumn("_t", group), ["family", "_t"], order, 1, "_r").drop("_t", "_r")
        else:
            breeding = parents
        kids = mutate(breeding.select("sequence_id", "sequence", "family", "seed_id", F.col("composite_fitness").alias("parent_fitness")), "sequence_id", "sequence", children, seed, g).filter("child <> sequence")
        kids = kids.withColumn("child_id", F.concat(sequence_id(F.col("child")), F.lit(f"_g{g}")))
        kids = first_wins(kids, ["child"], ["sequence_id", "position", "delta"])
        kids = top_k(kids, [F.xxhash64(F.lit(seed), "child"), F.asc("child")], left)
        scored = evaluator.evaluate(kids, "child").filter("status <> 'rejected'")
        fresh = scored if beam is not None else scored.filter("status = 'scored'")
        fresh = materialize(fresh.join(nodes.select(F.col("sequence").alias("child")), "child", "left_anti"), "children")
        made = fresh.select(F.col("child_id").alias("sequence_id"), F.col("child").alias("sequence"), "family", F.col("sequence_id").alias("parent_id"), "seed_id", F.lit(g).alias("generation"), "mutation_type", "position", "delta", "composite_fitness")
        step = fresh.select(F.col("sequence_id").alias("parent_id"), "child_id", "seed_id", F.lit(g).alias("generation"), "mutation_type", "position", "delta", F.round(F.col("composite_fitness") - F.col("parent_fitness"), 4).alias("fitness_delta"))
        edges = materialize(step if edges is None else edges.unionByName(step), "steps")
        nodes = materialize(nodes.unionByName(made), "nodes")
        pool = parents.select(*columns).unionByName(made)
        best = top_k_per_group(pool, ["family"], order, per_family, "_r").drop("_r")
        parents = materialize(best if beam is None else top_k(best, order, beam), "parents")
        seen = parents.agg(F.round(F.avg("composite_fitness"), 4).alias("mean"), F.round(F.max("composite_fitness"), 4).alias("max"), F.count_distinct("family").alias("families")).first()
        news = made.count()
        still = 0 if news else still + 1
        history.append({"generation": g, "new": news, "mean_fitness": seen["mean"], "max_fitness": seen["max"], "active_families": seen["families"]})
    empty = "parent_id string, child_id string, seed_id string, generation int, mutation_type string, position int, delta string, fitness_delta double"
    return nodes, seeds.sparkSession.createDataFrame([], empty) if edges is None else edges, history


def parent_echoes(df: DataFrame, child: str, parent: str) -> DataFrame:
    """Rows whose child is not its parent."""
    return df.filter(~F.col(child).eqNullSafe(F.col(parent)))


