"""What the operators of this package share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.storage import materialize, shared_dir, table

__all__ = ["SPACE", "WORD", "ascii_lower", "materialize", "pack", "read", "shared_dir", "table", "unpack", "word_count"]

#: The white space that ends a word, and a word, as Java regular expressions.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


#: A session setting: into how many partitions ``read`` deals a table, by a full shuffle; unset, tables are read as they are.
#: For many cores over few files of one row group each, which no split divides.
DEAL = "strandloom.read.partitions"


def read(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of an input table, dealt over partitions only where the session asks for it (``DEAL``)."""
    rows, parts = table(spark, sf_dir, name).select(*columns), spark.conf.get(DEAL, None)
    return rows.repartition(int(parts)) if parts else rows


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other character as it is.  For short strings: it looks up each character."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def word_count(text: Column) -> Column:
    """Number of words; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def pack(values: np.ndarray) -> bytes:
    """Integers or doubles as compressed planes of bytes; ``unpack`` needs the type."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return len(values).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(raw: bytes, kind: type = np.int64) -> np.ndarray:
    n, width = int.from_bytes(raw[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, dtype=kind)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=n * width, codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(width, n).T).reshape(-1).view(kind)
