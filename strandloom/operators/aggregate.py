"""Aggregations: merges with provenance, audits, histograms, overlaps, quantiles and metrics."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.curate import running_sums


def sorted_set(column: str) -> Column:
    """The distinct values, sorted; nulls are left out."""
    return F.array_sort(F.collect_set(column))


def merge_domains(df: DataFrame, key: str, domain: str, identifier: str, model: str | None, order: Sequence[str]) -> DataFrame:
    """One row a key: its domains, identifiers and models, sorted and distinct, their count, the first domain, and all other columns of its first row."""
    rest = [c for c in df.columns if c not in (key, domain, identifier, model)]
    first = F.min_by(F.struct(*[F.col(c) for c in rest]), F.struct(*order)).alias("_first")
    sets = [sorted_set(domain).alias("contributing_domains"), sorted_set(identifier).alias("contributing_candidate_ids")] + ([sorted_set(model).alias("contributing_models")] if model else [])
    out = df.groupBy(key).agg(*sets, *([first] if rest else []))
    out = out.withColumn("domain_count", F.size("contributing_domains")).withColumn("primary_domain", F.get("contributing_domains", F.lit(0)))
    return out.select("*", *[F.col("_first")[c].alias(c) for c in rest]).drop("_first") if rest else out


def domain_overlap(merged: DataFrame, domains: str = "contributing_domains") -> DataFrame:
    """For each domain, how many keys it has and how many only it has."""
    flat = merged.select(F.explode(domains).alias("domain"), (F.size(domains) == 1).alias("alone"))
    return flat.groupBy("domain").agg(F.count(F.lit(1)).alias("n_sequences"), F.count_if("alone").alias("n_exclusive"))


def source_overlap(df: DataFrame, source: str, key: str) -> DataFrame:
    """For each ordered pair of sources: keys in both, and Jaccard similarity to six digits.

    Keys are first reduced to their set of sources, and equal sets are counted, so a pair costs what there are of
    distinct sets, not what there are of keys.
    """
    pairs = df.select(F.col(source).alias("_source"), F.col(key).alias("_key")).distinct()
    sets = pairs.groupBy("_key").agg(F.array_sort(F.collect_set("_source")).alias("_set")).groupBy("_set").agg(F.count(F.lit(1)).alias("n"))
    sizes = sets.select(F.explode("_set").alias("x"), "n").groupBy("x").agg(F.sum("n").alias("size"))
    both = sets.select(F.explode("_set").alias("a"), "_set", "n").select("a", F.explode("_set").alias("b"), "n").groupBy("a", "b").agg(F.sum("n").alias("shared"))
    names = sizes.select(F.col("x").alias("a"), F.col("size").alias("na"))
    others = sizes.select(F.col("x").alias("b"), F.col("size").alias("nb"))
    grid = names.join(others)  # one row a pair of sources: sources are few, and every pair is asked for
    return grid.join(both, ["a", "b"], "left").select(F.col("a").alias("source_a"), F.col("b").alias("source_b"), F.coalesce("shared", F.lit(0)).alias("shared"), F.round(F.coalesce("shared", F.lit(0)) / (F.col("na") + F.col("nb") - F.coalesce("shared", F.lit(0))), 6).alias("jaccard"))


def exact_minimum(df: DataFrame, key: str, value: str, species: str, order: str) -> DataFrame:
    """For each key the smallest value, and the species of the observation that has it (the first on ties)."""
    known = df.filter(F.col(value).isNotNull())
    return known.groupBy(key).agg(F.min(value).alias(f"best_{value}"), F.min_by(F.col(species), F.struct(value, order)).alias(f"best_{species}"))


def conditional_counts(df: DataFrame, key: str, **rules: Column) -> DataFrame:
    return df.groupBy(key).agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])


def joined_sets(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """Sorted distinct values of columns, joined by ``;``."""
    return df.groupBy(key).agg(*[F.array_join(sorted_set(c), ";").alias(c) for c in columns])


def label_agreement(df: DataFrame, key: str, label: str) -> DataFrame:
    """For each key with a label: the label if all agree, else null, and whether they conflict."""
    seen = df.filter(F.col(label).isNotNull()).groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count(F.lit(1)).alias("observations"))
    agree = F.col("_lo") == F.col("_hi")
    return seen.select(key, F.when(agree, F.col("_lo")).alias(label), (~agree).alias("conflict"), "observations")


def motif_library(df: DataFrame, key: str, motifs: Column, charge, least: int = 3, salts: int = 32) -> DataFrame:
    """Motifs of at least ``least`` keys, the most widespread first: occurrences, mean charge, number of keys and the first five of them.

    Occurrences are counted for each motif and key first, so a key's repeats stay in its own task.  Keys are then ranked
    inside ``salts`` parts of a motif, and only the first five of a part are collected.  ``charge`` maps a motif column to
    its charge, taken once a motif.  Order: falling number of keys, falling occurrences, motif.
    """
    pairs = df.select(key, F.explode(motifs).alias("motif_sequence")).groupBy("motif_sequence", key).agg(F.count(F.lit(1)).alias("n"))
    part = pairs.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(salts)))
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy("motif_sequence", "_salt").orderBy(key)))
    first = F.slice(F.array_sort(F.collect_list(F.when(F.col("_r") <= 5, F.col(key)))), 1, 5)  # five a part are collected
    out = part.groupBy("motif_sequence").agg(F.sum("n").alias("frequency"), F.count(F.lit(1)).alias("associated_seq_count"), first.alias("ids")).filter(F.col("associated_seq_count") >= least)
    out = out.select("motif_sequence", "frequency", F.round(charge(F.col("motif_sequence")), 6).alias("mean_charge"), "associated_seq_count", F.array_join("ids", ";").alias("example_sequence_ids"))
    return out.orderBy(F.desc("associated_seq_count"), F.desc("frequency"), "motif_sequence")


def descriptor_summary(df: DataFrame, columns: Sequence[str], digits: int = 6) -> DataFrame:
    """One row a column: smallest, largest, mean and population deviation, in one pass."""
    long = df.unpivot([], [F.col(c).cast("double").alias(c) for c in columns], "descriptor", "value")
    r = lambda x: F.round(x, digits)
    return long.groupBy("descriptor").agg(r(F.min("value")).alias("minimum"), r(F.max("value")).alias("maximum"), r(F.avg("value")).alias("mean"), r(F.stddev_pop("value")).alias("std"))


def quantiles(df: DataFrame, group: str | None, value: str, shares: Sequence[float]) -> DataFrame:
    """``group`` (if any) and an array ``q``: exact quantiles by linear interpolation, one for each of ``shares``.

    Equal values are counted first, and their counts get running totals over range partitions, so no buffer holds a
    group's values and a value that many rows share is one row.  Nulls are left out.
    """
    named = F.col(group) if group else F.lit(0)
    by = df.filter(F.col(value).isNotNull()).groupBy(named.alias("_g"), F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    run = running_sums(by.withColumn("_o", F.struct("_g", "_v")), F.col("_o"), {"_upto": "_c"}).drop("_o")
    run = run.withColumn("_from", F.col("_upto") - F.col("_c"))
    whole = run.groupBy(F.col("_g").alias("_h")).agg(F.sum("_c").alias("_n"), F.min("_from").alias("_start"))  # one row a group
    spots = F.array(*[F.struct(F.lit(i).alias("i"), (F.lit(float(p)) * (F.col("_n") - 1)).alias("at")) for i, p in enumerate(shares)])
    met = run.join(whole, F.struct("_g") == F.struct("_h")).withColumn("_p", F.explode(F.filter(spots, lambda x: (F.floor(x["at"]) < F.col("_upto") - F.col("_start")) & (F.ceil(x["at"]) >= F.col("_from") - F.col("_start")))))
    inside = lambda x: (x >= F.col("_from") - F.col("_start")) & (x < F.col("_upto") - F.col("_start"))
    ends = met.groupBy("_g", F.col("_p.i").alias("i"), F.col("_p.at").alias("at")).agg(F.max(F.when(inside(F.floor("_p.at")), F.col("_v"))).alias("lo"), F.max(F.when(inside(F.ceil("_p.at")), F.col("_v"))).alias("hi"))
    each = ends.select("_g", "i", (F.col("lo") + (F.col("at") - F.floor("at")) * (F.col("hi") - F.col("lo"))).alias("q"))
    out = each.groupBy("_g").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))  # a number for each share
    return out.withColumnRenamed("_g", group) if group else out.select("q")


def quantile_table(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles by linear interpolation for each group."""
    q = quantiles(df, group, value, (0.25, 0.5, 0.75))
    return q.select(group, *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q25", "q50", "q75"))])


def group_summary(df: DataFrame, group: str, key: str, value: str, flag: Column) -> DataFrame:
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct(key).alias("distinct_keys"), F.round(F.avg(value), 4).alias("mean_value"), F.count_if(flag).alias("flagged"))


def value_counts(df: DataFrame, column: str, top: int | None = None) -> DataFrame:
    """Values by falling count, ties by value."""
    out = df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column)
    return out if top is None else out.limit(top)


def missingness(df: DataFrame, name: str) -> DataFrame:
    """For each column: rows, and how many are null or blank.  A null counts as missing."""
    counts = df.agg(F.count(F.lit(1)).alias("rows"), *[F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"m{i}") for i, c in enumerate(df.columns)])
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"m{i}").alias("missing")) for i, c in enumerate(df.columns)])
    return counts.select(F.lit(name).alias("table_name"), "rows", F.explode(pairs).alias("p")).select("table_name", "p.column_name", "rows", "p.missing")


def predicate_counts(df: DataFrame, group: str, **rules: Column) -> DataFrame:
    """Long counts: one row for each group and predicate."""
    wide = df.groupBy(group).agg(*[F.count_if(F.coalesce(r, F.lit(False))).alias(n) for n, r in rules.items()])
    return wide.unpivot([group], list(rules), "predicate", "n")


def residue_histogram(df: DataFrame, sequence: str) -> DataFrame:
    """Occurrences of each character, counted in the row before they are shuffled."""
    chars = F.filter(F.split(sequence, ""), lambda c: c != "")
    return df.select(F.explode(chars).alias("residue")).groupBy("residue").agg(F.count(F.lit(1)).alias("n"))


def validity_summary(df: DataFrame, sequence: str, reason: Column) -> DataFrame:
    """Counts of all, valid, distinct and repeated sequences, and the valid share."""
    r = df.select(F.col(sequence).alias("s"), (reason == "ok").alias("ok"))
    out = r.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok").alias("valid"), F.count_distinct("s").alias("unique_sequences"))
    return out.select("total", "valid", "unique_sequences", (F.col("total") - F.col("unique_sequences")).alias("duplicates"), F.round(F.col("valid") / F.nullif(F.col("total"), F.lit(0)), 4).alias("valid_rate"))


def leakage(df: DataFrame, cluster: str, split: str) -> DataFrame:
    """Clusters that are in more than one split."""
    return df.groupBy(cluster).agg(F.count_distinct(split).alias("splits")).filter("splits > 1")


def ingestion_audit(df: DataFrame, domain: str, sequence: str, reference_hit: Column, canonical: Column) -> DataFrame:
    n = F.length(sequence)
    return df.groupBy(domain).agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(sequence).alias("unique_sequences"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.every(canonical).alias("all_canonical"), F.count_if(reference_hit).alias("reference_matches"),
    )


def shannon_entropy(df: DataFrame, label: str) -> DataFrame:
    """Entropy of a label's distribution, in nats, from its counts."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).cast("double").alias("n"))
    sums = counts.agg(F.sum("n").alias("t"), F.sum(F.col("n") * F.ln("n")).alias("nln"))
    return sums.select(F.round(F.ln("t") - F.col("nln") / F.col("t"), 6).alias("entropy"))


def mean_pairwise_distance(df: DataFrame, sequence: str, order: str, sample: int = 50) -> DataFrame:
    """Mean edit distance over all pairs of the first ``sample`` rows by ``order``; the sample is the feature."""
    first = df.select(sequence, order).orderBy(order).limit(sample).agg(F.array_sort(F.collect_list(F.struct(order, sequence))).alias("x"))
    pairs = first.select(F.posexplode("x").alias("i", "a"), "x").select("a", F.explode(F.slice("x", F.col("i") + 2, sample)).alias("b"))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg(F.levenshtein(F.col("a")[sequence], F.col("b")[sequence])), 4).alias("mean_distance"))


def tail_risk(df: DataFrame, value: str, share: float = 0.10) -> DataFrame:
    """The ``share`` quantile and the mean of what is at or below it."""
    q = quantiles(df, None, value, [share]).select(F.col("q")[0].alias("q"))  # one row
    return df.join(F.broadcast(q)).filter(F.col(value) <= F.col("q")).agg(F.round(F.max("q"), 4).alias("quantile"), F.round(F.avg(value), 4).alias("tail_mean"))


def metrics(df: DataFrame, label: str, score: str, order: str) -> DataFrame:
    """Area under the ROC curve (ties half), average precision and Brier score.

    Scores are reduced to one row a distinct score, which get running totals over range partitions.
    """
    by = df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("double")).alias("p"), F.count(F.lit(1)).cast("double").alias("n"), F.sum(F.pow(F.col(score) - F.col(label), 2)).alias("b"))
    run = running_sums(by, F.desc("s"), {"tp": "p", "all": "n"}).withColumn("neg", F.col("n") - F.col("p"))
    run = run.withColumn("before", F.col("tp") - F.col("p"))
    out = run.agg(F.sum("p").alias("positives"), F.sum("neg").alias("negatives"), F.sum(F.col("neg") * (F.col("before") + F.col("p") / 2)).alias("pairs"), F.sum(F.col("p") * F.col("tp") / F.col("all")).alias("ap"), F.sum("b").alias("squares"), F.sum("n").alias("total"))
    return out.select(F.round(F.col("pairs") / (F.col("positives") * F.col("negatives")), 6).alias("roc_auc"), F.round(F.col("ap") / F.col("positives"), 6).alias("average_precision"), F.round(F.col("squares") / F.col("total"), 6).alias("brier"))


def strategy_metrics(chosen: DataFrame, strategy: str, sequence: str = "sequence", domain: str = "primary_domain", quality: str = "lcb_quality", amp: str = "pred_amp_probability", tox: str = "pred_toxicity_risk", can_synthesize: str = "synthesizable", similarity: str = "max_reference_similarity", rank: str = "rank") -> DataFrame:
    """One row for each selection strategy of ``chosen``: means, entropy of domains, distance and shares, by strategy.

    The mean edit distance is over all pairs of the first fifty rows by ``rank``.
    """
    part = lambda c: F.avg(c.cast("double"))
    whole = chosen.groupBy(strategy).agg(
        F.round(F.avg(quality), 4).alias("mean_lcb_quality"), F.round(F.avg(amp), 4).alias("mean_amp_prob"), F.round(F.avg(tox), 4).alias("mean_toxicity_risk"),
        F.round(part(F.col(can_synthesize)), 4).alias("synthesizable_fraction"), F.round(part(F.col(similarity) <= 0.80), 4).alias("novelty_le80_fraction"),
    )
    counts = chosen.groupBy(strategy, domain).agg(F.count(F.lit(1)).cast("double").alias("n"))
    mixed = counts.groupBy(strategy).agg((F.ln(F.sum("n")) - F.sum(F.col("n") * F.ln("n")) / F.sum("n")).alias("h")).select(strategy, F.round("h", 3).alias("domain_entropy"))
    first = chosen.filter(F.col(rank) <= 50).groupBy(strategy).agg(F.array_sort(F.collect_list(F.struct(rank, sequence))).alias("x"))  # fifty rows a strategy
    pairs = first.select(strategy, F.posexplode("x").alias("i", "a"), "x").select(strategy, "a", F.explode(F.slice("x", F.col("i") + 2, 50)).alias("b"))
    apart = pairs.groupBy(strategy).agg(F.round(F.avg(F.levenshtein(F.col("a")[sequence], F.col("b")[sequence])), 2).alias("mean_pairwise_distance"))
    return whole.join(mixed, strategy).join(apart, strategy, "left")


def ledger(df: DataFrame, cached: Column, accepted: Column, hit: Column) -> DataFrame:
    """Counters of an evaluation log: requests, unique evaluations, cache hits, rejections, and hit rate."""
    out = df.agg(F.count(F.lit(1)).alias("requests"), F.count_if(accepted & ~cached).alias("unique_calls"), F.count_if(cached).alias("cache_hits"), F.count_if(~accepted).alias("rejections"), F.count_if(hit).alias("hits"))
    return out.withColumn("hit_rate", F.round(F.col("hits") / F.nullif(F.col("requests"), F.lit(0)), 4))


def history(df: DataFrame, generation: str, fitness: str, family: str) -> DataFrame:
    return df.groupBy(generation).agg(F.round(F.avg(fitness), 4).alias("mean_fitness"), F.round(F.max(fitness), 4).alias("max_fitness"), F.count_distinct(family).alias("active_families"))


def _log_factorial(n: Column) -> Column:
    """ln(n!): a table below 16, Stirling's series from there on, whose error is below 1e-13."""
    small = F.array(*[F.lit(math.lgamma(i + 1)) for i in range(16)])
    x = F.greatest(n, F.lit(16)).cast("double")
    series = (1 / (12 * x)) * (1 - (1 / (x * x)) * (1 / 30.0 - (1 / (x * x)) * (1 / 105.0 - 1 / (140.0 * x * x))))
    return F.when(n < 16, F.get(small, n.cast("int"))).otherwise((x + 0.5) * F.ln(x) - x + 0.5 * math.log(2 * math.pi) + series)


def hypergeometric_tail(df: DataFrame, population: str, hits: str, draws: str, least: str) -> DataFrame:
    """``df`` with P(X >= least) for draws without replacement: the first term from log binomials, each other from the one before it."""
    log_choose = lambda n, k: _log_factorial(n) - _log_factorial(k) - _log_factorial(n - k)
    n, k, d = (F.col(c).cast("long") for c in (population, hits, draws))
    lo, hi = F.greatest(F.col(least).cast("long"), d + k - n, F.lit(0)), F.least(k, d)

    def step(acc: Column, x: Column) -> Column:
        ratio = (k - x).cast("double") * (d - x) / ((x + 1).cast("double") * (n - k - d + x + 1))
        return F.struct((acc["sum"] + F.exp(acc["log"])).alias("sum"), F.when(x < hi, acc["log"] + F.ln(ratio)).otherwise(0.0).alias("log"))

    first = log_choose(k, lo) + log_choose(n - k, d - lo) - log_choose(n, d)
    start = F.struct(F.lit(0.0).alias("sum"), F.when(lo <= hi, first).otherwise(0.0).alias("log"))
    total = F.aggregate(F.sequence(lo, F.greatest(lo, hi)), start, step, lambda acc: acc["sum"])
    return df.withColumn("tail_probability", F.round(F.when(lo <= hi, total).otherwise(0.0), 6))
