"""URL filters by a Bloom filter cascade.

A rule is a host and the start of a path.  The keys of a url are its host and every parent domain that has no more
labels than some rule's host, each with every start of its path whose length some rule has; a rule fits exactly if it is
one of these keys.  So a url has a few keys, however many labels its host has.  The keys of all urls are
the complete key universe, and a cascade makes membership in the listed keys exact on it:

* level 1 holds the listed keys;
* level 2 holds the universe's keys that pass level 1 though they are not listed;
* level 3 holds the listed keys that pass level 2 by mistake, and so on until a level makes no mistake.

A key is listed if the first level that rejects it has an even number, or if it passes all of an odd number of levels.
Level 1 is sized so that its false positives are about as many as the listed keys, whatever the universe's size; the
levels together are a few bytes a listed key, and the list is a parameter with a stated bound.  Only levels travel to
the tasks, never the list: keys that pass level 1 come to the driver as hashes, about twice as many as are listed, and
the listed ones among them are taken away there.  Urls are judged without any join.

Pages are read three times, for all lists together: to sketch the universe's size, to find what passes the first levels
by mistake, and to judge.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import ascii_lower

#: (verdict, host, start of the path).
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
#: Hosts that are blocked with their subdomains where no rule fits.
BLOCKED_HOSTS = tuple(f"{name}.example.{end}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for end in ("com", "net", "org"))
#: Listed keys that one filter may hold; the driver builds the levels.
MAX_LISTED = 10_000_000

_M = np.uint64


@dataclass(frozen=True)
class Bloom:
    """Bits under ``hashes`` positions; a key is two 64-bit hashes, and ``salt`` makes the levels independent."""

    bits: np.ndarray
    size: int
    hashes: int
    salt: int

    @staticmethod
    def of(keys: np.ndarray, rate: float, salt: int) -> Bloom:
        size = max(64, math.ceil(-len(keys) * math.log(rate) / math.log(2) ** 2)) if len(keys) else 64
        out = Bloom(np.zeros(-(-size // 64), dtype=np.uint64), size, max(1, round(-math.log2(rate))), salt)
        for at in out._places(keys):
            np.bitwise_or.at(out.bits, (at >> _M(6)).astype(np.int64), _M(1) << (at & _M(63)))
        return out

    def _places(self, keys: np.ndarray) -> Iterator[np.ndarray]:
        with np.errstate(over="ignore"):
            mix = keys[:, 0] ^ (keys[:, 1] * _M(2 * self.salt + 1) + _M(self.salt) * _M(0x9E3779B97F4A7C15))
            for k in range(self.hashes):
                x = mix + _M(k) * (keys[:, 1] | _M(1))
                x = (x ^ (x >> _M(33))) * _M(0xFF51AFD7ED558CCD)
                x = (x ^ (x >> _M(33))) * _M(0xC4CEB9FE1A85EC53)
                yield (x ^ (x >> _M(33))) % _M(self.size)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), dtype=bool)
        for at in self._places(keys):
            out &= (self.bits[(at >> _M(6)).astype(np.int64)] >> (at & _M(63)) & _M(1)).astype(bool)
        return out


@dataclass(frozen=True)
class Cascade:
    """Exact membership in the listed keys for every key of the universe that it was built on."""

    levels: tuple[Bloom, ...]

    def holds(self, keys: np.ndarray) -> np.ndarray:
        out, open_ = np.zeros(len(keys), dtype=bool), np.arange(len(keys))
        for n, level in enumerate(self.levels):
            passed = level.holds(keys[open_])
            out[open_[~passed]] = n % 2 == 1  # rejected by a level of unlisted keys: listed
            open_ = open_[passed]
        out[open_] = len(self.levels) % 2 == 1
        return out


def finish(listed: np.ndarray, first: Bloom, mistakes: np.ndarray) -> Cascade:
    """The cascade whose level 1 is ``first``, given the unlisted keys that pass it."""
    levels, inside, outside = [first], listed, mistakes
    while len(outside):
        if len(levels) > 200:
            raise ValueError("a listed and an unlisted key have the same hashes")
        level = Bloom.of(outside, 0.5, len(levels) + 1)
        levels.append(level)
        inside, outside = outside, inside[level.holds(inside)]  # the next level corrects this one
    return Cascade(tuple(levels))


def _hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("second"), key).alias("b"))


def listed_hashes(keys: Sequence[str]) -> np.ndarray:
    """The two hashes of each distinct key, as :func:`_hashes` makes them, sorted."""
    second = xxhash.xxh64_intdigest(b"second", 42)
    out = np.empty((len(keys), 2), dtype=np.uint64)
    for i, seed in enumerate((42, second)):
        out[:, i] = np.fromiter((xxhash.xxh64_intdigest(k.encode(), seed) for k in keys), dtype=np.uint64, count=len(keys))
    out = out[np.lexsort((out[:, 1], out[:, 0]))]
    return out[np.append(True, (out[1:] != out[:-1]).any(axis=1))] if len(out) else out


def among(keys: np.ndarray, listed: np.ndarray) -> np.ndarray:
    """Which keys are in a sorted list of distinct ones."""
    low, high = (np.searchsorted(listed[:, 0], keys[:, 0], side=x) for x in ("left", "right"))
    found = np.zeros(len(keys), dtype=bool)
    for step in range(int((high - low).max(initial=0))):  # more than once only where first hashes are equal
        open_ = np.flatnonzero(low + step < high)
        found[open_] |= listed[low[open_] + step, 1] == keys[open_, 1]
    return found


def _pairs(a, b) -> np.ndarray:
    return np.stack([np.asarray(a, dtype=np.int64).view(np.uint64), np.asarray(b, dtype=np.int64).view(np.uint64)], axis=1)


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url: empty where it is null or has no ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _keys(host: Column, path: Column, lengths: Sequence[int], most: int) -> Column:
    """All keys of a url: its last 1 to ``most`` labels by path starts.  A path shorter than a length has no such start."""
    labels = F.split(host, r"\.", -1)
    first = F.greatest(F.lit(1), F.size(labels) - most + 1)
    domains = F.transform(F.sequence(first, F.size(labels)), lambda i: F.array_join(F.slice(labels, i, most), "."))
    starts = F.filter(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths]), lambda x: x.isNotNull())
    return F.flatten(F.transform(domains, lambda d: F.transform(starts, lambda p: F.concat(d, p))))


def build(universe: DataFrame, lists: Sequence[Sequence[str]]) -> list[Cascade]:
    """A cascade for each list of keys, exact over ``universe`` (one column ``key``, repeats allowed).

    Two passes over the universe serve all lists: one sketches its size, one finds what passes a first level.
    """
    spark = universe.sparkSession
    if any(len(x) > MAX_LISTED for x in lists):
        raise ValueError(f"more than {MAX_LISTED} listed keys")
    inside = [listed_hashes(keys) for keys in lists]
    size = universe.agg(F.approx_count_distinct("key")).first()[0]
    rate = lambda n: min(0.5, max(1e-9, n / (math.sqrt(2) * max(1, size - n))))
    first = [Bloom.of(keys, rate(len(keys)), 1) for keys in inside]
    held = spark.sparkContext.broadcast(first)

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = _pairs(batch.column(0), batch.column(1))
            for i, level in enumerate(held.value):
                keys = np.unique(every[level.holds(every)], axis=0)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), i), pa.int32()), *[pa.array(keys[:, j].view(np.int64).copy()) for j in (0, 1)]], ["of", "a", "b"])

    passed = universe.select(_hashes(F.col("key")).alias("h")).select("h.*").mapInArrow(passing, "of int, a long, b long").distinct().toPandas()
    out = []
    for i, keys in enumerate(inside):
        part = passed[passed["of"] == i]
        every = _pairs(part["a"], part["b"])
        out.append(finish(keys, first[i], every[~among(every, keys)]))
    return out


def judge(pages: DataFrame, id_col: str = "page_id", url: str = "url", rules: Sequence[tuple[str, str, str]] = RULES, blocked: Sequence[str] = BLOCKED_HOSTS) -> DataFrame:
    """One row a page: ``id_col, host, path, rule, verdict``.

    A rule (verdict, host, path start) fits its host and all subdomains.  Of those that fit, the longest wins (host and
    path start together), of equally long ones that with the longer host; a url has no two rules with the same host and
    path start, so the order of ``rules`` never matters.  A path start that is neither empty nor begins with a slash fits
    no url.  ``rule`` names the rule, else it is null.  Where no rule fits, the
    verdict is block if the host or a parent domain is in ``blocked``, else allow.  A null url or one without ``://`` has
    empty host and path, fits no rule and is allowed.  Repeated rows are judged one by one; other columns are not read;
    an empty table gives an empty result.
    """
    spark = pages.sparkSession
    if len({h + p for _, h, p in rules}) != len(rules):
        raise ValueError("two rules have the same key")
    rules = [(k, h, p) for k, h, p in rules if "/" not in h and p[:1] in ("", "/")]  # no url has another host or path
    host, path = parts(F.col("_url"))
    split = pages.select(F.col(id_col).alias("_id"), F.col(url).alias("_url")).select("_id", host.alias("host"), path.alias("path"))
    lengths = sorted({len(p) for _, _, p in rules})
    most = max((h.count(".") + 1 for h in [*(h for _, h, _ in rules), *blocked]), default=1)  # labels of a listed host
    ruled, bare_hosts = _keys(F.col("host"), F.col("path"), lengths, most), _keys(F.col("host"), F.lit(""), [0], most)
    universe = split.select(F.explode(F.concat(ruled, bare_hosts)).alias("key"))
    kinds = ("allow", "block")
    *verdicts, hosts = build(universe, [*[[h + p for k, h, p in rules if k == kind] for kind in kinds], list(blocked)])
    held = spark.sparkContext.broadcast((dict(zip(kinds, verdicts, strict=True)), hosts))

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_kind, block_list = held.value
        for batch in batches:
            rule, verdict = np.full(batch.num_rows, None, dtype=object), np.full(batch.num_rows, "allow", dtype=object)
            best = [(-1, -1)] * batch.num_rows
            bare = _flat(batch, "bare")
            verdict[bare[0][block_list.holds(bare[2])]] = "block"
            rows, keys, hashes = _flat(batch, "keys")
            for kind, cascade in by_kind.items():
                for i in np.flatnonzero(cascade.holds(hashes)):
                    r, key = rows[i], keys[i].as_py()
                    size = (len(key), key.find("/") % (len(key) + 1))  # a host has no slash
                    if size > best[r]:
                        best[r], rule[r], verdict[r] = size, key, kind
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rule, pa.string()), pa.array(verdict, pa.string())], ["_id", "host", "path", "rule", "verdict"])

    def hashed(keys: Column) -> Column:
        return F.transform(keys, lambda k: F.struct(k.alias("key"), F.xxhash64(k).alias("a"), F.xxhash64(F.lit("second"), k).alias("b")))

    keyed = split.select("_id", "host", "path", hashed(ruled).alias("keys"), hashed(bare_hosts).alias("bare"))
    kind = pages.schema[id_col].dataType.simpleString()
    return keyed.mapInArrow(decide, f"_id {kind}, host string, path string, rule string, verdict string").withColumnRenamed("_id", id_col)


def _flat(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row number, key and hashes of each element of a list column."""
    column = batch.column(batch.schema.get_field_index(name))
    rows = np.repeat(np.arange(batch.num_rows), np.diff(column.offsets.to_numpy()))
    items = column.flatten()
    return rows, items.field("key"), _pairs(items.field("a"), items.field("b"))
