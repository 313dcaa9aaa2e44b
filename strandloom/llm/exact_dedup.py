"""Exact deduplication by skew-safe combining.

Three combines, each of which groups by the whole normalised text beside its digest, so two texts are only ever
merged when their contents are equal:

1. locally: every row of a task has the task's salt, so the map-side half of the first aggregation leaves one row for
   each text of a task;
2. by digest and salt: a group of copies, however large, is spread over ``salts`` reducers;
3. by digest: at most ``salts`` winners a text are left to combine.

Every document then learns its group by joining its digest to the winners.  That join carries identifiers and digests
only; a hot digest on its left side is split by adaptive skew handling, because both sides are plain shuffles.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandloom.operators.curate import row_hash

#: Reducers over which the copies of one text are spread.
SALTS = 16


def digests(docs: DataFrame, text: str = "text", norm: bool = True) -> DataFrame:
    """``docs`` with ``_sha`` (hex SHA-256 of the normalised text) and, if ``norm``, ``_norm`` (that text).

    The normalised text has A-Z lower-cased; null counts as empty.
    """
    schema = T.StructType([*docs.schema.fields, T.StructField("_sha", T.StringType())] + [T.StructField("_norm", T.StringType())] * norm)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lowered = pc.ascii_lower(pc.fill_null(batch.column(batch.schema.get_field_index(text)), ""))
            raw = lowered.cast(pa.large_binary() if pa.types.is_large_string(lowered.type) else pa.binary())
            sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in raw], pa.string())
            names = [*batch.schema.names, "_sha", *["_norm"] * norm]
            yield pa.RecordBatch.from_arrays([*batch.columns, sha, *[lowered] * norm], names)

    return docs.mapInArrow(run, schema)


def _salt(salts: int):
    """The salt of a task: all its copies of a text have one, so they are combined before they are sent."""
    return F.pmod(F.spark_partition_id(), F.lit(salts))


def winners(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each distinct text: ``_sha, keep_id, group_size``.  Fails if two different texts share a digest."""
    rows = digests(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text").drop("_text")
    merged = rows.withColumn("_salt", _salt(salts)).groupBy("_sha", "_salt", "_norm").agg(F.max("_id").alias("_id"), F.count(F.lit(1)).alias("_n"))
    whole = merged.groupBy("_sha", "_norm").agg(F.max("_id").alias("keep_id"), F.sum("_n").alias("group_size"))
    one = whole.groupBy("_sha").agg(F.max("keep_id").alias("keep_id"), F.max("group_size").alias("group_size"), F.count(F.lit(1)).alias("_texts"))
    return one.select("_sha", "keep_id", F.when(F.col("_texts") == 1, F.col("group_size")).otherwise(F.raise_error(F.lit("two texts share one digest"))).cast("long").alias("group_size"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty, so null and empty texts are one
    group.  Of equal texts the row with the largest identifier stays; null identifiers come before all others.  Rows
    that repeat both identifier and text come out repeated, each counts in ``group_size``, and all of them are kept if
    theirs is the largest identifier.  A very long text is compared whole; a task holds a few of them.  Other columns of
    ``docs`` are not read and may have any name.  An empty table gives an empty result.
    """
    ids = digests(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), "_text", norm=False).select("_id", "_sha")
    best = winners(docs, id_col, text, salts)
    # The key is the binary digest on both sides, so both get an exchange of their own and a hot digest can be split.
    joined = ids.withColumn("_key", F.unhex("_sha")).join(best.select(F.unhex("_sha").alias("_key"), "keep_id", "group_size"), "_key")
    return joined.select(F.col("_id").alias(id_col), "keep_id", "group_size", F.col("_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("_sha").alias("text_sha256"))


def surviving(docs: DataFrame, id_col: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One whole row of ``docs`` for each distinct text, with all its own columns: that with the largest identifier.

    Texts are equal as in :func:`exact_dedup`: null and empty texts are one group, of which one row stays, with its text
    as it was.  Null identifiers come before all others.  Of rows that share identifier and text that with the largest
    hash of its columns stays, so repeated rows leave one.  A very long text is shuffled and compared whole.  Columns may
    have any names and types.  An empty table gives an empty result.
    """
    names = docs.columns
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at, body = (f"_c{names.index(x)}" for x in (id_col, text))
    rest = [c for c in plain.columns if c != body]
    order = F.struct(F.col(at).alias("id"), row_hash(plain, plain.columns).alias("hash"))
    rows = _without_capitals(plain.withColumn("_by", order), body)
    salted = rows.select("_sha", _salt(salts).alias("_salt"), "_norm", F.struct("_caps", *rest).alias("_row"), "_by")
    merged = salted.groupBy("_sha", "_salt", "_norm").agg(F.max_by("_row", "_by").alias("_row"), F.max("_by").alias("_by"))
    whole = merged.groupBy("_sha", "_norm").agg(F.max_by("_row", "_by").alias("_row"))
    back = _with_capitals(whole.select("_norm", "_row.*"), body, plain.schema)
    return back.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])


def _without_capitals(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` without ``text``, but with ``_sha, _norm`` and ``_caps``, a bit for each byte of the text that was lowered.

    So a text goes through a shuffle once, as what it is compared by.  ``_caps`` is empty where nothing was lowered, and
    null for a null text.
    """
    kept = [f for f in docs.schema.fields if f.name != text]
    schema = T.StructType([*kept, T.StructField("_sha", T.StringType()), T.StructField("_norm", T.StringType()), T.StructField("_caps", T.BinaryType())])

    def caps(raw: pa.Scalar, low: pa.Scalar) -> bytes | None:
        if not raw.is_valid:
            return None
        changed = np.frombuffer(raw.as_buffer(), dtype=np.uint8) != np.frombuffer(low.as_buffer(), dtype=np.uint8)
        return np.packbits(changed).tobytes() if changed.any() else b""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index(text))
            lowered = pc.ascii_lower(pc.fill_null(raw, ""))
            sha = pa.array([hashlib.sha256(x.as_buffer()).hexdigest() for x in lowered], pa.string())
            bits = pa.array([caps(x, y) for x, y in zip(raw, lowered, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in kept], sha, lowered, bits], schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _with_capitals(rows: DataFrame, text: str, schema: T.StructType) -> DataFrame:
    """The columns of ``schema``, with ``text`` made again from ``_norm`` and ``_caps``."""

    def whole(low: pa.Scalar, bits: pa.Scalar) -> bytes | None:
        if not bits.is_valid:
            return None
        out = np.frombuffer(low.as_buffer(), dtype=np.uint8)
        mask = np.frombuffer(bits.as_buffer(), dtype=np.uint8)
        return (out - 32 * np.unpackbits(mask, count=len(out))).tobytes() if len(mask) else out.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([whole(x, y) for x, y in zip(batch.column("_norm"), batch.column("_caps"), strict=True)], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([texts if f.name == text else batch.column(f.name) for f in schema.fields], schema.fieldNames())

    return rows.mapInArrow(run, schema)
