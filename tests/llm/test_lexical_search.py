"""Ranked search: against brute force, proofs by bounds, edge cases."""

import math
import os
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from strandloom.llm import lexical_search, queries

HERE = "/root/testdata/sf0.001"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def plainly(docs, items, k=10):
    """Scores of every document for every item."""
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                found.append((-score, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k])]
    return sorted(out, key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(5000)] + ["Ñandú", "x2", "日本"]
    return [(i, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 200])))) for i in range(n)]


def test_equals_brute_force_with_blocks_of_any_size(spark, monkeypatch):
    docs = corpus(1, 700)
    items = [(i, docs[7 * i + 3][1][:120]) for i in range(25)] + [(90, None), (91, ""), (92, "unknown-word"), (93, "W1 w1 W1;w2"), (93, "W1 w1 W1;w2"), (94, "ñandú 日本")]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    want = plainly(docs, items)
    for size, most in ((2048, 500_000), (37, 500_000), (64, 60)):
        monkeypatch.setattr(lexical_search, "BLOCK_DOCS", size)
        monkeypatch.setattr(lexical_search, "MOST_TERMS", most)
        got = lexical_search.search(lexical_search.build(d), q)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == want


def test_nulls_ties_repeats_long_texts_and_clashing_names(spark):
    long = "needle " + "hay " * 200_000
    docs = [(5, "needle a"), (3, "needle a"), (3, "needle a"), (None, "needle a"), (9, None), (8, ""), (7, "!!! ..."), (1, long), (2, "b c")] + [(100 + i, f"filler {i}") for i in range(30)]
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "k long, body string, score int, item string")
    q = spark.createDataFrame([("q", "Needle", 2)], "item string, body string, rank int")
    got = lexical_search.search(lexical_search.build(d, "k", "body"), q, "item", "body", k=3).collect()
    assert [tuple(r) for r in got] == sorted(map(tuple, got), key=lambda r: r[1])
    assert [(r[0], r[1], r[2]) for r in got] == [("q", 1, 3), ("q", 2, 3), ("q", 3, 5)]
    assert sorted(map(tuple, got), key=repr) == plainly(docs, [("q", "Needle")], 3)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    q = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert lexical_search.search(lexical_search.build(none), q).count() == 0
    assert lexical_search.search(lexical_search.build(some), q.limit(0)).count() == 0


def test_a_block_without_an_answer_is_proven_so_and_others_fall_through():
    rng = random.Random(3)
    texts = pa.array([" ".join(["common"] * rng.randint(1, 9) + [f"f{rng.randint(0, 50)}"] * 3) for _ in range(500)] + ["rare common"])
    raw = lexical_search._block(pa.array(range(501)), texts)
    (row,) = lexical_search._tiered(501, sum(len(terms(t)) for t in texts.to_pylist()))(iter([raw]))
    items = lexical_search.Items(pa.array(["common", "rare"]), [np.array([0]), np.array([0, 1])], np.array([5, 6000]))
    block = lexical_search.Block(row, 0, items)
    exact, tiers = block.scores(items.of[1], 1)
    assert tiers == 3 and int(exact.argmax()) == 500
    top = int(exact.max())
    assert block.scores(items.of[1], top)[1] == 3  # a tie with the threshold is no proof
    block.read.clear()
    assert block.scores(items.of[1], top + 10_000_000) == (None, 1) and list(block.read) == [0]  # more than the residual bounds could add
    assert block.scores(items.of[0], top) == (None, 1)
    assert (block.first(items.of[1]) <= exact).all()


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    for name in ("documents", "benchmark"):
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{HERE}/{name}.parquet')")
    want = duck.sql(queries.ORACLE_SQL["op12_lexical_search"])
    got = queries.QUERIES["op12_lexical_search"](spark, HERE).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)
