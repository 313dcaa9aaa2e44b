"""Verification: every rule is a query of violations; a result is sound if all of them are empty."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.functions.sequence import LONGEST, SHORTEST, canonical, ranked_header
from strandloom.operators.similar import nearest_reference, similar_pairs


def rule_counts(rules: dict[str, DataFrame]) -> DataFrame:
    """``rule, violations``: one row a rule."""
    counted = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(name).alias("rule"), "violations") for name, df in rules.items()]
    return reduce(DataFrame.unionByName, counted)


def require(counts: DataFrame) -> None:
    """Raises with the rules that are broken."""
    broken = {r["rule"]: r["violations"] for r in counts.filter("violations > 0").collect()}  # one row a rule
    if broken:
        raise ValueError(f"broken rules: {broken}")


def size_rule(df: DataFrame, n: int) -> DataFrame:
    """One row if ``df`` has not exactly ``n`` rows."""
    return df.agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") != n)


def library_rules(library: DataFrame, sequence: str, n: int) -> dict[str, DataFrame]:
    s = F.col(sequence)
    return {
        "library_size": size_rule(library, n), "library_repeats": library.groupBy(sequence).count().filter("count > 1"), "library_alphabet": library.filter(~canonical(F.coalesce(s, F.lit("")))),
        "library_length": library.filter(~F.coalesce(F.length(s).between(SHORTEST, LONGEST), F.lit(False))),
    }


def submission_rules(library: DataFrame, top: DataFrame, reference: DataFrame, sequence: str, n: int, k: int, domains: Sequence[str] = (), header: str | None = None, rank: str | None = None, most: float = 0.80, key: str | None = None) -> dict[str, DataFrame]:
    """Rules of a library and its ranked top list: sizes, repeats, alphabet, lengths, subset, reference overlap, headers, similarity."""
    rules = library_rules(library, sequence, n) | {
        "top_size": size_rule(top, k), "top_repeats": top.groupBy(sequence).count().filter("count > 1"), "top_not_in_library": top.join(library.select(sequence).distinct(), sequence, "left_anti"),
        "reference_overlap": library.join(reference.select(sequence).distinct(), sequence, "left_semi"),
    }
    if header and rank:
        rules["top_header"] = top.filter(~F.coalesce(ranked_header(F.col(header), F.col(rank), domains), F.lit(False)))
    if key:
        rules["top_too_near_reference"] = nearest_reference(top, reference, key, sequence, key, sequence, most).filter(F.col("max_reference_similarity") > most)
        rules["top_too_near_each_other"] = similar_pairs(top, key, sequence, most).filter(F.col("similarity") > most)
    return rules


def atoms(column: Column, kind: str) -> Column:
    """A value as text that tells any two values apart: doubles exactly, nulls and types by marks."""
    if kind in ("double", "float"):
        text = F.concat(F.lit("f:"), column.cast("double").cast("string"))  # the shortest text that gives the same double back
    else:
        text = F.concat(F.lit(f"{kind}:"), column.cast("string"))
    return F.coalesce(text, F.lit("null"))


def fingerprint(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Rows and an order-aware digest of all values: one row.

    Each row's digest covers its values, its column names and its place in ``order`` by value, so rows can be digested
    apart; the sum of their digests does not depend on partitioning.
    """
    kinds = dict(df.dtypes)
    names = sorted(df.columns)
    text = F.concat_ws("\x1f", *[F.concat(F.lit(f"{c}="), atoms(F.col(c), kinds[c])) for c in names])
    place = F.concat_ws("\x1e", *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in order])
    h = F.sha2(F.concat(place, F.lit("\x1d"), text), 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    out = df.agg(F.count(F.lit(1)).alias("rows"), *[part(i).alias(f"p{i}") for i in range(8)])
    return out.select("rows", F.lit(",".join(f"{c}:{kinds[c]}" for c in names)).alias("schema"), F.sha2(F.concat_ws(",", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(8)]), 256).alias("sha256"))


def same_values(a: DataFrame, b: DataFrame, order: Sequence[str]) -> bool:
    return fingerprint(a, order).first() == fingerprint(b, order).first()


def membership_disclosure(members: DataFrame, provenance: DataFrame, key: str, sequence: str, columns: Sequence[str]) -> DataFrame:
    """Training members by the digest of their sequence, with where they came from."""
    known = members.select(key, F.sha2(sequence, 256).alias("sequence_sha256"))
    return provenance.join(known, key).select("sequence_sha256", *columns)
