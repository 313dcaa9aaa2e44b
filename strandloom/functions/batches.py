"""Sums over the residues of many sequences at once, in Arrow batches: what expressions would compute residue by residue.

Each function of sequences returns a Column of unrounded doubles, null where the text is null, empty or holds anything but residues.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

RESIDUES = "ACDEFGHIKLMNPQRSTVWY"
#: Codes of bytes that are no residues: those that begin a character, and those inside one.
_OTHER, _INSIDE = 254, 255
_CODES = np.full(256, _OTHER, dtype=np.uint8)
_CODES[0x80:0xC0] = _INSIDE
_CODES[np.frombuffer(RESIDUES.encode(), dtype=np.uint8)] = np.arange(len(RESIDUES))
#: Letters of residues, of either case, as upper-case ones; zero for all else.
_LETTERS = np.zeros(256, dtype=np.uint8)
for _text in (RESIDUES, RESIDUES.lower()):
    _LETTERS[np.frombuffer(_text.encode(), dtype=np.uint8)] = np.frombuffer(RESIDUES.encode(), dtype=np.uint8)
#: Characters that are looked at at once; a longer sequence is looked at alone.
PART = 1 << 18


def _pieces(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The bytes of some texts, and the lengths of these texts in bytes; null counts as empty."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, ends, raw = texts.buffers()
    at = np.frombuffer(ends, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data, i = np.frombuffer(raw or b"", dtype=np.uint8), 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(at, at[i] + PART, side="right")) - 1)
        yield data[at[i] : at[j]], np.diff(at[i : j + 1])
        i = j


def _parts(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of the bytes of some texts, and the lengths of these texts in bytes; null counts as empty."""
    for data, sizes in _pieces(texts):
        yield _CODES[data], sizes


def _counts(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Of each residue a row: how often it occurs in each text."""
    cells = np.repeat(np.arange(len(sizes)) * len(RESIDUES), sizes)
    known = codes < len(RESIDUES)
    return np.bincount(cells[known] + codes[known], minlength=len(sizes) * len(RESIDUES)).reshape(len(sizes), -1).T


def _of_residues(f: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> Callable[[Column], Column]:
    """A Column function from one on the codes and lengths of sequences."""

    def run(texts: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for codes, sizes in _parts(texts):
            wrong = np.concatenate([[0], np.cumsum(codes >= len(RESIDUES))])
            ends = np.cumsum(sizes)
            good = (sizes > 0) & (wrong[ends] == wrong[ends - sizes])
            values = np.full(len(sizes), np.nan)
            if good.any():
                values[good] = f(codes[np.repeat(good, sizes)], sizes[good])
            out.append(values)
        return pa.array(np.concatenate(out), pa.float64(), from_pandas=True)

    return F.arrow_udf(run, DoubleType())


def residues_only(s: Column) -> Column:
    """The residue letters of a text, of either case, as upper-case ones; null stays null."""

    def run(texts: pa.Array) -> pa.Array:
        letters, lengths = [np.zeros(0, dtype=np.uint8)], [np.zeros(1, dtype=np.int64)]
        for data, sizes in _pieces(texts):
            upper = _LETTERS[data]
            kept = upper > 0
            before, ends = np.concatenate([[0], np.cumsum(kept)]), np.cumsum(sizes)
            letters.append(upper[kept])
            lengths.append(before[ends] - before[ends - sizes])
        ends = np.cumsum(np.concatenate(lengths)).astype(np.int32)
        out = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(ends), pa.py_buffer(np.concatenate(letters))])
        return pc.if_else(texts.is_valid(), out, pa.scalar(None, pa.string()))

    return F.arrow_udf(run, StringType())(s)


def fractions(s: Column) -> Column:
    """Of each residue its share of the characters of a text, whatever else it holds, as an array; zeros if it is empty."""

    def run(texts: pa.Array) -> pa.Array:
        rows = [np.zeros((0, len(RESIDUES)))]
        for codes, sizes in _parts(texts):
            inside = np.concatenate([[0], np.cumsum(codes == _INSIDE)])
            ends = np.cumsum(sizes)
            rows.append((_counts(codes, sizes) / np.maximum(sizes - (inside[ends] - inside[ends - sizes]), 1)).T)
        flat = np.concatenate(rows).reshape(-1)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1) * len(RESIDUES), pa.int32()), pa.array(flat, pa.float64()))

    return F.arrow_udf(run, ArrayType(DoubleType()))(s)


def linear(s: Column, scale: Mapping[str, float], start: float = 0.0) -> Column:
    """Sum of a scale over all residues."""

    def total(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        counts, out = _counts(codes, sizes), np.full(len(sizes), start)
        for residue, value in scale.items():
            if value:
                out = out + counts[RESIDUES.index(residue)] * float(value)
        return out

    return _of_residues(total)(s)


def root(s: Column, ends: tuple[float, float], plus: Mapping[str, float], minus: Mapping[str, float], lo: float, hi: float, least: float, steps: int) -> Column:
    """By bisection, where a charge falls below ``least``; from the acid constants of the chain's ends and of residues."""

    def search(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        counts = _counts(codes, sizes)
        up = [(1.0, ends[0]), *[(counts[RESIDUES.index(r)], p) for r, p in plus.items()]]
        down = [(1.0, ends[1]), *[(counts[RESIDUES.index(r)], p) for r, p in minus.items()]]
        low, high = np.full(len(sizes), lo), np.full(len(sizes), hi)
        for _ in range(steps):
            mid = (low + high) / 2
            protons = 10.0**mid
            charge = sum(n / (1 + protons * 10.0**-p) for n, p in up) - sum(n / (1 + 10.0**p / protons) for n, p in down)
            more = charge >= least
            low, high = np.where(more, mid, low), np.where(more, high, mid)
        return (low + high) / 2

    return _of_residues(search)(s)


def moment(s: Column, scale: Mapping[str, float], degrees: float, window: int) -> Column:
    """The largest mean vector of a window, with so many degrees a residue; a shorter sequence is one window."""
    values = np.array([float(scale[r]) for r in RESIDUES])
    turns = [math.radians(degrees * j) for j in range(window)]

    def largest(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        h, w = values[codes], np.minimum(sizes, window)
        spots = sizes - w + 1
        first = np.cumsum(spots) - spots
        at = np.arange(spots.sum()) + np.repeat(np.cumsum(sizes) - sizes - first, spots)
        width = np.repeat(w, spots)
        x, y = np.zeros(len(at)), np.zeros(len(at))
        for j, turn in enumerate(turns):
            one = np.where(j < width, h[np.minimum(at + j, len(h) - 1)], 0.0)
            x += one * math.cos(turn)
            y += one * math.sin(turn)
        return np.maximum.reduceat(np.sqrt(x * x + y * y) / width, first)

    return _of_residues(largest)(s)


def pairs(s: Column, table: Sequence[float]) -> Column:
    """Sum of a table of 400 values over adjacent residues; zero for a single one."""
    values = np.array(table, dtype=np.float64)

    def total(codes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        wide = codes.astype(np.int64)
        each = np.append(values[wide[:-1] * len(RESIDUES) + wide[1:]], 0.0)
        each[np.cumsum(sizes) - 1] = 0.0  # a sequence's last residue has no next one
        return np.add.reduceat(each, np.cumsum(sizes) - sizes)

    return _of_residues(total)(s)
