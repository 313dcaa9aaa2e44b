"""Curation: canonical records, links of observations, flags and role views."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandloom.functions.sequence import sequence_id, validity
from strandloom.storage import materialize


def row_hash(df: DataFrame, names: Sequence[str], seed: int = 0) -> Column:
    """A 64-bit hash of the named columns of a row; nulls count, and maps, which have no hash, are hashed as text."""
    parts = []
    for name in names:
        kind, c = df.schema[name].dataType.simpleString(), F.col(f"`{name}`")
        parts += [c.cast("string") if "map<" in kind or "variant" in kind else c, c.isNull()]
    return F.xxhash64(F.lit(seed), *parts)


def first_wins(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row a key: the first by ``order``.

    The least row is found by map-side minima, so a key that holds a third of all rows costs no more than another.
    Nulls in ``order`` come first; a null key is a key.  Rows that tie are settled by a hash of their columns.
    """
    rest = [c for c in df.columns if c not in keys]
    by = F.struct(*[F.col(c) for c in order], row_hash(df, rest)) if rest else F.lit(0)
    best = df.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in rest]), by).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def best_of(df: DataFrame, keys: Sequence[str], score: str, ties: Sequence[str] = ()) -> DataFrame:
    """One row a key: the highest ``score``, ties by the smallest of ``ties``."""
    return first_wins(df.withColumn("_neg", -F.col(score).cast("double")), keys, ["_neg", *ties]).drop("_neg")


def canonicalize(records: DataFrame, sequence: str = "sequence", metadata: str | None = None, order: Sequence[str] = ("source_ord", "record_ord")) -> DataFrame:
    """Valid or not, one row a normalised sequence: its identifier and the validity flags of its first record."""
    flags = validity(F.col(sequence), F.col(metadata) if metadata else None)
    flat = records.withColumn("_v", flags).select("*", "_v.*").drop("_v").filter(F.col("sequence_normalized") != "")
    flat = flat.withColumn("sequence_id", sequence_id(F.col("sequence_normalized")))
    return first_wins(flat, ["sequence_id"], order)


def provenance(records: DataFrame, sequence: str = "sequence", columns: Sequence[str] = ()) -> DataFrame:
    """One row for each appearance of a sequence in an input, none collapsed."""
    s = F.upper(F.regexp_replace(F.coalesce(F.col(sequence), F.lit("")), r"\s+", ""))
    return records.select(sequence_id(s).alias("sequence_id"), s.alias("sequence_normalized"), F.col(sequence).alias("original_sequence"), *columns)


def own_key(column: str) -> Column:
    """Equal for equal values, and for two nulls.  No aggregate is partitioned by it: a join on it exchanges both of its
    sides, so adaptive execution can split a hot key though the other side has one row a key."""
    return F.struct(F.col(column).alias("k"))


def flag_reference(df: DataFrame, reference: DataFrame, key: str, flag: str = "challenge_exact_overlap") -> DataFrame:
    """``df`` with whether its key is in ``reference``.  The reference is made distinct; Spark picks the join by size."""
    seen = reference.select(F.col(key).alias("_k")).filter("_k is not null").distinct().withColumn("_hit", F.lit(True))
    return df.join(seen, own_key(key) == own_key("_k"), "left").withColumn(flag, F.coalesce("_hit", F.lit(False))).drop("_k", "_hit")


def eligible(df: DataFrame, valid: str = "valid_for_challenge", overlap: str = "challenge_exact_overlap") -> DataFrame:
    return df.filter(F.col(valid) & ~F.col(overlap))


def quarantine(df: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not in ``reference``; a row with a null key is in none."""
    seen = reference.select(F.col(key).alias("_k")).filter("_k is not null").distinct()
    return df.join(seen, own_key(key) == own_key("_k"), "left_anti")


def link(observations: DataFrame, sequences: DataFrame, key: str, identifier: str = "sequence_id") -> DataFrame:
    """Observations with the identifier of their sequence, an empty one where there is none."""
    known = first_wins(sequences.select(F.col(key).alias("_k"), F.col(identifier).cast("string").alias("_i")).filter("_k is not null"), ["_k"], ["_i"])
    joined = observations.drop(identifier).join(known, own_key(key) == own_key("_k"), "left")
    return joined.withColumn(identifier, F.coalesce("_i", F.lit(""))).drop("_k", "_i")


def fill_from(observations: DataFrame, lookup: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """``value`` of each observation, from ``lookup`` by ``key`` where it is null or empty; the last duplicate there wins."""
    last = lookup.groupBy(F.col(key).alias("_k")).agg(F.max_by(F.col(value), F.col(order)).alias("_v")).filter("_k is not null")
    joined = observations.join(last, own_key(key) == own_key("_k"), "left")
    return joined.withColumn(value, F.coalesce(F.nullif(F.col(value), F.lit("")), F.col("_v"))).drop("_k", "_v")


def many_to_one(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """A join that fails if a key is repeated on the right."""
    rest = [c for c in right.columns if c != key]
    one = right.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.first(F.struct(*rest)).alias("_row")).filter("_k is not null")
    fail = F.raise_error(F.lit(f"{key} repeats on the right")).cast(one.schema["_row"].dataType)
    checked = one.select("_k", F.when(F.col("_n") == 1, F.col("_row")).otherwise(fail).alias("_row"))
    joined = left.join(checked, own_key(key) == own_key("_k"), how)
    return joined.select(*left.columns, *[F.col("_row")[c].alias(c) for c in rest])


def with_defaults(df: DataFrame, other: DataFrame, key: str, defaults: dict[str, object]) -> DataFrame:
    """A left join whose missing values take defaults."""
    out = df.join(other.select(key, *defaults), key, "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def annotate(provenance_: DataFrame, rules: dict[str, Sequence[str]], key: str = "sequence_id", text: str = "metadata_text") -> DataFrame:
    """For each key, whether any of its texts holds a word of each rule, as booleans."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    has = lambda words: F.bool_or(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)))
    return provenance_.groupBy(key).agg(*[has(words).alias(name) for name, words in rules.items()])


def role_view(sequences: DataFrame, splits: DataFrame, columns: Sequence[str], version: str, key: str = "sequence_id") -> DataFrame:
    """A projection for one consumer with split, cluster and data version."""
    return with_defaults(sequences, splits, key, {"split": "unassigned", "cluster_id": ""}).select(key, *columns, "split", "cluster_id", F.lit(version).alias("data_version"))


def candidate_record(df: DataFrame, **constants) -> DataFrame:
    """``df`` with the columns that a candidate table needs, those it lacks from constants."""
    return df.withColumns({k: F.lit(v) for k, v in constants.items() if k not in df.columns})


def in_values(column: Column, allowed: Sequence[str]) -> Column:
    """Whether a ``;``-joined set holds allowed values only; an empty set holds none and fails."""
    parts = F.filter(F.split(F.coalesce(column, F.lit("")), ";"), lambda x: x != "")
    return (F.size(parts) > 0) & (F.size(F.array_except(parts, F.array(*map(F.lit, allowed)))) == 0)


def positive_finite(column: Column) -> Column:
    """Text or number as a finite positive double, else null."""
    x = column.cast("string").try_cast("double")
    return F.when((x > 0) & (x < float("inf")), x)


def rankable(valid: Column, can_synthesize: Column, novel: Column, similarity: Column, most: float = 0.80) -> Column:
    return F.coalesce(valid & can_synthesize & novel & similarity.between(0, most), F.lit(False))


def consistent_flag(df: DataFrame, flag: str = "passes_novelty_rule_le80", similarity: str = "max_reference_similarity", most: float = 0.80) -> DataFrame:
    """``df``; a row whose flag disagrees with its similarity is an error when it is read."""
    agrees = F.col(flag).eqNullSafe(F.col(similarity) <= most)
    return df.withColumn(flag, F.when(agrees, F.col(flag)).otherwise(F.raise_error(F.lit("flag and similarity disagree")).cast("boolean")))


def strict_boolean(column: Column) -> Column:
    """True, False, 1, 0 and their texts; anything else is an error."""
    text = F.lower(F.trim(column.cast("string")))
    return F.when(text.isin("true", "1", "1.0"), True).when(text.isin("false", "0", "0.0"), False).otherwise(F.raise_error(F.concat(F.lit("not a boolean: "), F.coalesce(text, F.lit("null")))).cast("boolean"))


def reject_reasons(df: DataFrame, rules: Sequence[tuple[str, Column]], out: str = "reason") -> DataFrame:
    """``df`` with the name of the first rule that holds, else ``accepted``."""
    value = None
    for name, rule in rules:
        value = F.when(F.coalesce(rule, F.lit(True)), name) if value is None else value.when(F.coalesce(rule, F.lit(True)), name)
    return df.withColumn(out, value.otherwise("accepted"))


def stable_order(df: DataFrame, score: str, tie: str, index: str = "position") -> DataFrame:
    """All rows by descending score, then by ``tie``, with their position from 1.

    Positions are numbered inside range partitions and shifted by the partitions' counts, so no task holds all rows.
    Scores that are null or not finite are errors.
    """
    x = F.col(score).cast("double")
    good = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ranged = df.withColumn(score, F.when(good, F.col(score)).otherwise(F.raise_error(F.lit(f"{score} has to be finite")).cast(dict(df.dtypes)[score])))
    return number_rows(ranged, [F.col(score).desc(), F.col(tie).asc()], index)


def number_rows(df: DataFrame, order: Sequence[Column], index: str) -> DataFrame:
    """``df`` sorted by ``order`` with its row number from 1, without one task for all rows."""
    held = materialize(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "numbered")
    sizes = held.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_i").alias("_from"))  # one row a partition
    shifts = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = held.join(F.broadcast(shifts.select("_p", "_from", "_before")), "_p")
    return out.withColumn(index, F.col("_before") + F.col("_i") - F.col("_from") + 1).drop("_p", "_i", "_from", "_before")


def running_sums(df: DataFrame, order: Column, columns: dict[str, str]) -> DataFrame:
    """``df`` with running totals ``columns`` (new name to summed column) in the order of one distinct column.

    Totals run inside range partitions and are shifted by the totals of those before, so no task holds all rows.
    """
    held = materialize(df.repartitionByRange(order).withColumn("_p", F.spark_partition_id()), "ranged")
    shifts = held.groupBy("_p").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in columns.items()])  # one row a partition
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    shifts = shifts.select("_p", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in columns])
    inside = Window.partitionBy("_p").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = held.withColumns({f"_w_{n}": F.sum(c).over(inside) for n, c in columns.items()}).join(F.broadcast(shifts), "_p")
    return out.select(*df.columns, *[(F.col(f"_w_{n}") + F.col(f"_b_{n}")).alias(n) for n in columns])
