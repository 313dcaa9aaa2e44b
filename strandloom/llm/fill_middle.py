"""Fill-in-the-middle transformation by a two-pass streaming matcher.

A text is cut into units (a run of ASCII letters, or any other single character).  The first pass over its matches only
counts them; the cut ranks follow from the count and from a hash of the identifier; the second pass moves a lazy match
iterator to both ranks and keeps two offsets.  No list of units ever exists: beside the text itself, memory is a counter
and one match, however long the text is.

The hash, the form and the way back are Column expressions; only the matcher runs in Python.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = re.compile(r"[A-Za-z]+|[^A-Za-z]")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of a hundred texts, how many are transformed, and how many of those begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
SEED = "1:"
#: Bytes of text whose outputs a task holds at once.
PART_BYTES = 4 << 20


def count_units(text: str) -> int:
    """First pass: the number of units."""
    return sum(1 for _ in UNIT.finditer(text))


def offsets(text: str, low: int, high: int) -> tuple[int, int]:
    """Second pass: where the units of ranks ``low`` and ``high`` (from one, in this order) end; rank zero ends at the start."""
    units, ends, passed, end = UNIT.finditer(text), [], 0, 0
    for rank in (low, high):
        if rank > passed:
            end = next(islice(units, rank - passed - 1, None)).end()
            passed = rank
        ends.append(end)
    return ends[0], ends[1]


def draws(id_col: str, seed: str = SEED) -> list[Column]:
    """Four integers of 32 bits from the SHA-256 of ``seed`` and the identifier; a null identifier counts as empty."""
    digest = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def parts_of(batch: pa.RecordBatch, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in slices of at most so many bytes of its second column; a longer text is a slice of its own."""
    ends, start = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rate: int = RATE, suffix_first: int = SUFFIX_FIRST, seed: str = SEED) -> DataFrame:
    """One row for each row of ``docs``: ``id_col, n`` (units), ``form, prefix_chars, middle_chars, output``; nothing is shuffled.

    ``form`` is ``psm`` or ``spm``, or ``plain`` where the text is empty, holds one of the three marks or is not drawn;
    then the output is the text and the lengths are null.  Null texts count as empty, null identifiers as empty strings.
    Cuts depend on identifier and text alone, so repeated rows come out repeated and equal.  A very long text is matched
    twice and copied once.  Other columns are not read and may have any name; an empty table gives an empty result.
    """
    body, (h1, h2, h3, h4) = F.coalesce(F.col(text), F.lit("")), draws(id_col, seed)
    marked = F.greatest(*[F.instr(body, m) for m in (PREFIX, SUFFIX, MIDDLE)]) > 0
    form = F.when((body == "") | marked | (h3 % 100 >= rate), "plain").when(h4 % 100 < suffix_first, "spm").otherwise("psm")
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts_of(whole)):
            ids, texts, forms, first, second = batch.columns
            counts, heads, middles, outputs = [], [], [], []
            for held, shape, a, b in zip(texts, forms.to_pylist(), first.to_pylist(), second.to_pylist(), strict=True):
                t = held.as_py()
                n = count_units(t)
                counts.append(n)
                if shape == "plain":
                    heads.append(None)
                    middles.append(None)
                    outputs.append(t)
                    continue
                i, j = offsets(t, *sorted((a % (n + 1), b % (n + 1))))
                heads.append(i)
                middles.append(j - i)
                parts = (PREFIX, t[:i], SUFFIX, t[j:]) if shape == "psm" else (SUFFIX, t[j:], PREFIX, t[:i])
                outputs.append("".join((*parts, MIDDLE, t[i:j])))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), forms, pa.array(heads, pa.int64()), pa.array(middles, pa.int64()), pa.array(outputs, texts.type)],
                ["_id", "n", "form", "prefix_chars", "middle_chars", "output"],
            )

    rows = docs.select(F.col(id_col).alias("_id"), body.alias("_text"), form.alias("_form"), h1.alias("_a"), h2.alias("_b"))
    return rows.mapInArrow(run, f"_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string").withColumnRenamed("_id", id_col)


def restored(output: Column, form: Column) -> Column:
    """The text that an output of this form was made from.

    A transformed text holds no mark, and a mark cannot overlap another one, so the first two marks after the leading one
    are those that were put there.
    """
    rest = F.substr(output, F.lit(len(PREFIX) + 1))
    psm, spm = F.split(rest, f"{SUFFIX}|{MIDDLE}"), F.split(rest, f"{PREFIX}|{MIDDLE}")
    return F.when(form == "psm", F.concat(psm[0], psm[2], psm[1])).when(form == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(output)


def digest(rows: DataFrame) -> DataFrame:
    """Rows of :func:`fill_middle` with digests of the output and of what is rebuilt from it, instead of the output."""
    sha = lambda c: F.sha2(c, 256)
    out = rows.withColumn("restored_sha256", sha(restored(F.col("output"), F.col("form")))).withColumn("output_sha256", sha(F.col("output")))
    return out.drop("output")
