"""Katz backoff: against a plain version, exact normalisation, discounts, edge cases."""

import math
import os
import random
from collections import Counter, defaultdict
from zlib import crc32

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import backoff_lm, queries
from strandloom.llm.common import pack, unpack

HERE = "/root/testdata/sf0.001"
COLUMNS = ["held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def tokens(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w.decode() for w in lowered.encode().split()] + ["\n"]


class Plain:
    """The same model by dictionaries: every text's tokens at once."""

    def __init__(self, texts):
        self.uni, self.bi, self.ctx = Counter(), Counter(), Counter()
        self.followers = defaultdict(set)
        for t in map(tokens, texts):
            self.uni.update(t)
            for h, w in zip(["<start>", *t], t, strict=False):
                self.bi[h, w] += 1
                self.ctx[h] += 1
                self.followers[h].add(w)
        self.n = sum(self.uni.values())
        k = backoff_lm.DISCOUNTED
        freq = lambda c: [sum(x == r for x in c.values()) for r in range(1, k + 2)]
        self.d1, self.d2 = ([0.0, *backoff_lm.discounts(freq(c)), 1.0] for c in (self.uni, self.bi))
        self.k = k + 1
        self.freed = sum(c - self.kept(c, self.d1) for c in self.uni.values() if c < self.k)
        self.weights = {}

    def kept(self, c, d):
        return c * d[min(c, self.k)]

    def single(self, w):
        total = self.n + (self.freed == 0)
        return self.kept(self.uni[w], self.d1) / total if self.uni[w] else (self.freed or 1.0) / total

    def pair(self, h, w):
        if not self.ctx[h]:
            return self.single(w)
        if h not in self.weights:
            counts = {x: self.bi[h, x] for x in self.followers[h]}
            total = self.ctx[h] + (not any(c < self.k for c in counts.values()))
            mass = (total - sum(self.kept(c, self.d2) for c in counts.values())) / total
            self.weights[h] = total, mass / (1 - sum(map(self.single, counts)))
        total, weight = self.weights[h]
        return self.kept(self.bi[h, w], self.d2) / total if self.bi[h, w] else weight * self.single(w)

    def score(self, text):
        t = tokens(text)
        base = sum(math.log10((self.uni[w] + 0.5) / (self.n + 0.5 * (len(self.uni) + 1))) for w in t)
        return len(t), sum(self.uni[w] > 0 for w in t), self.n, base, sum(math.log10(self.pair(h, w)) for h, w in zip(["<start>", *t], t, strict=False))


def is_held(doc_id):
    return crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 1


def plainly(rows):
    model = Plain([t for i, t in rows if not is_held(i)])
    cache = {}
    return [(i, is_held(i), *cache.setdefault(t, model.score(t))) for i, t in rows]


def agree(got, want, key="doc_id"):
    order = lambda r: repr(r[:6]) + f"{r[6]:.6f}"
    found = sorted(((r[key], *[r[c] for c in COLUMNS]) for r in got.collect()), key=order)
    wanted = sorted((tuple(r) for r in want), key=lambda r: repr(r[:5]))
    found.sort(key=lambda r: repr(r[:5]))
    assert [r[:5] for r in found] == [r[:5] for r in wanted]
    close = lambda k: sorted(r[k] for r in found) == pytest.approx(sorted(r[k] for r in wanted), rel=1e-9, abs=1e-9)
    assert close(5) and close(6)
    by = defaultdict(list)
    for r in wanted:
        by[r[:5]].append(r[5:])
    assert all(any(r[5:] == pytest.approx(x, rel=1e-9, abs=1e-9) for x in by[r[:5]]) for r in found)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.8)) % 60}" for _ in range(900)] + ["Éa", "éa", "THE", "the"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60])))) for i in range(n)]


@pytest.mark.parametrize(("bucket", "block"), [(1 << 20, 10 << 20), (900, 3000), (150, 400)])
def test_equals_the_plain_model_with_any_blocks_and_buckets(spark, monkeypatch, bucket, block):
    monkeypatch.setattr(backoff_lm, "BUCKET", bucket)
    monkeypatch.setattr(backoff_lm, "BLOCK_BYTES", block)
    rows = corpus(2, 260) + [(900, None), (901, ""), (902, " \t\n"), (903, "zzz yyy zzz"), (None, "w1 w2"), (904, "a\x1cb w1\x0bw2"), (5, "w1 w1 w1"), (5, "w1 w1 w1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = backoff_lm.score(docs)
    assert sorted(got.columns) == sorted(["doc_id", *COLUMNS])
    agree(got, plainly(rows))


def test_probabilities_of_a_context_sum_to_one():
    model = Plain([t for _, t in corpus(5, 200)])
    for h in ["<start>", "the", "w1", "never seen", *list(model.ctx)[:10]]:
        assert sum(model.pair(h, w) for w in [*model.uni, "<no such word>"]) == pytest.approx(1, abs=1e-12)


def test_always_the_same_word_leaves_something_to_others(spark):
    rows = [(i, "a b") for i in range(60)] + [(100 + i, "a c q") for i in range(60) if is_held(100 + i)]
    agree(backoff_lm.score(spark.createDataFrame(rows, "doc_id long, text string")), plainly(rows))


def test_empty_untrained_and_clashing(spark):
    some = [i for i in range(60) if is_held(i)][:5]
    docs = spark.createDataFrame([(i, "a b", 1.0, 2) for i in some], "block long, tokens string, score double, ends int")
    got = backoff_lm.score(docs, "block", "tokens").collect()
    assert len(got) == 5 and all((r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (True, 3, 0, 0, 0, 0) for r in got)
    assert backoff_lm.score(docs.limit(0), "block", "tokens").count() == 0


def test_very_long_texts(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(f"v{rng.randint(0, 30)}" for _ in range(60_000 if i == 3 else 20))) for i in range(12)]
    agree(backoff_lm.score(spark.createDataFrame(rows, "doc_id long, text string")), plainly(rows))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 1000), min_size=6, max_size=6))
def test_discounts_are_always_shares(seen):
    out = backoff_lm.discounts(seen)
    assert len(out) == 5 and all(0 < d < 1 for d in out)


def test_discounts_are_katz_where_counts_fall():
    n = [1000, 300, 130, 75, 50, 36]
    far = 6 * 36 / 1000
    assert backoff_lm.discounts(n) == pytest.approx([((r + 1) * n[r] / (r * n[r - 1]) - far) / (1 - far) for r in range(1, 6)])


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(-(2**62), 2**62)))
def test_packing_gives_back_what_was_packed(values):
    held = np.array(values, dtype=np.int64)
    assert (unpack(pack(held)) == held).all() and (backoff_lm.unpack_rising(backoff_lm.pack_rising(np.sort(held))) == np.sort(held)).all()


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
def test_query_equals_the_plain_model(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{HERE}/documents.parquet").select("doc_id", "text").collect()]
    got = queries.QUERIES["op13_backoff_lm"](spark, HERE)
    agree(got, plainly(rows))
    held = [r for r in got.collect() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)  # better than single words on what it has not seen


def test_tables_of_large_rows_are_packed_and_written_in_small_groups(spark):
    """A bucket's bigrams are compressed bytes for the JVM, and a writer holds some 16 MB, not a hundred rows."""
    import pyarrow.parquet as pq
    from pyspark.sql import functions as F

    from strandloom.storage import materialize

    docs = spark.createDataFrame([(i, f"a b c{i % 7} d") for i in range(40)], "doc_id long, text string")
    blocks = materialize(backoff_lm.encode(docs), "t")
    words, uni = backoff_lm.vocabulary(blocks)
    model = backoff_lm.fit(blocks.select("ends"), backoff_lm.numbered(blocks, words), words, uni)
    assert {t for c, t in model.bigrams.dtypes if c != "bucket"} == {"binary"}
    noise = spark.range(0, 12, 1, 1).select(F.unhex(F.array_join(F.transform(F.sequence(F.lit(1), F.lit(64_000)), lambda i: F.sha2((F.col("id") * 64_000 + i).cast("string"), 512)), "")).alias("x"))
    (path,) = materialize(noise, "t", large_rows=True).inputFiles()
    assert pq.ParquetFile(path.removeprefix("file://")).num_row_groups > 1
