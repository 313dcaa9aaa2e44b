"""Ranking, top-k, backfill and set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.operators.curate import number_rows


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows: each task keeps ``k``."""
    return df.orderBy(*order).limit(k)


def top_k_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int, rank: str = "rank", salts: int = 16) -> DataFrame:
    """The first ``k`` rows of each group with their rank.

    Rows are first ranked inside ``salts`` parts of a group; at most ``k`` of each part go on, so a group with a third of
    all rows is no single task's work.
    """
    salt = F.pmod(F.xxhash64(*[c for c, t in df.dtypes if not t.startswith("map")]), F.lit(salts))
    part = df.withColumn("_salt", salt)
    part = part.withColumn("_r", F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy(*order))).filter(F.col("_r") <= k).drop("_r", "_salt")
    return part.withColumn(rank, F.row_number().over(Window.partitionBy(*groups).orderBy(*order))).filter(F.col(rank) <= k)


def two_level_top_k(df: DataFrame, group: str, order: Sequence[Column], per_group: int, total: int) -> DataFrame:
    """The first of each group, then the first of all."""
    return top_k(top_k_per_group(df, [group], order, per_group), order, total)


def backfill(chosen: DataFrame, pool: DataFrame, key: str, n: int, order: Sequence[str]) -> DataFrame:
    """``chosen``, then rows of ``pool`` that are not in it, by ``order``, up to ``n`` rows."""
    have = chosen.withColumn("_tier", F.lit(0))
    more = pool.join(chosen.select(key), key, "left_anti").withColumn("_tier", F.lit(1))
    both = have.unionByName(more, allowMissingColumns=True)
    return both.orderBy("_tier", *order).limit(n).drop("_tier")


def assign_ranks(df: DataFrame, order: Sequence[Column], start: int = 1, rank: str = "rank") -> DataFrame:
    out = number_rows(df, order, rank)
    return out.withColumn(rank, F.col(rank) + (start - 1))


def nested_prefix(df: DataFrame, rank: str = "portfolio_rank", k: int = 50, flag: str = "is_nested") -> DataFrame:
    return df.withColumn(flag, F.col(rank) <= k)


def contiguous(df: DataFrame, index: str) -> DataFrame:
    """One row: whether ``index`` is exactly 1..n."""
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.min(index).alias("lo"), F.max(index).alias("hi"), F.count_distinct(index).alias("d"))
    return r.select("rows", ((F.col("rows") == 0) | (F.col("lo") == 1) & (F.col("hi") == F.col("rows")) & (F.col("d") == F.col("rows"))).alias("contiguous"))


def balanced_sample(df: DataFrame, label: str, key: str, seed: int = 42) -> DataFrame:
    """As many rows of each label as the rarest has, those with the smallest seeded hashes.

    All rows are numbered at once, in range partitions by label and hash; a null label is a label.
    """
    order = [F.col(label), F.xxhash64(F.lit(seed), F.col(key).cast("string")), F.col(key)]
    held = number_rows(df, order, "_at")
    spans = held.groupBy(F.col(label).alias("_label")).agg(F.min("_at").alias("_from"), F.count(F.lit(1)).alias("_n"))  # one row a label
    least = spans.agg(F.min("_n").alias("_least"))
    near = held.join(spans.join(F.broadcast(least)), F.struct(label) == F.struct("_label")).filter(F.col("_at") - F.col("_from") < F.col("_least"))
    return near.select(*df.columns)


def first_of_largest(df: DataFrame, group: str, order: Sequence[Column], groups: int = 5, k: int = 4) -> DataFrame:
    """The first ``k`` rows of each of the ``groups`` largest groups (ties by group)."""
    sizes = df.groupBy(F.col(group).alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    top = F.broadcast(top_k(sizes, [F.desc("_n"), F.asc("_g")], groups).select("_g"))  # ``groups`` rows
    return top_k_per_group(df.join(top, F.col(group) == F.col("_g"), "left_semi"), [group], order, k)


def coverage_gap(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys that are missing from or extra in ``found``."""
    a, b = expected.select(key).distinct(), found.select(key).distinct()
    return a.exceptAll(b).withColumn("problem", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("problem", F.lit("extra")))


def intersection_size(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key)).agg(F.count(F.lit(1)).alias("shared"))


def is_subset(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """One row: how many rows of ``a`` are not in ``b``."""
    return a.join(b.select(key).distinct(), key, "left_anti").agg(F.count(F.lit(1)).alias("outside"))
