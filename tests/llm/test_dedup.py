"""Exact and near deduplication."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from strandloom.llm import exact_dedup, queries, simhash

ROWS = [(1, "Hello World"), (2, "hello world"), (3, None), (4, ""), (5, "HELLO wörld"), (6, "hello wÖrld"), (None, "hello World"), (2, "hello world"), (7, "x " * 50_000)]


def test_exact(spark):
    docs = spark.createDataFrame(ROWS, "doc_id long, text string").selectExpr("*", "'a' as _sha", "'b' as keep_id")
    rows = exact_dedup.exact_dedup(docs).collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == len(ROWS) and sum(r.doc_id == 2 and r.kept for r in rows) == 2  # repeated rows come out repeated
    assert (by_id[1].keep_id, by_id[1].group_size, by_id[1].kept) == (2, 4, False) and by_id[None].keep_id == 2 and not by_id[None].kept
    assert (by_id[3].keep_id, by_id[4].kept, by_id[4].group_size) == (4, True, 2)
    assert by_id[5].kept and by_id[6].kept  # only A-Z are lower-cased
    assert exact_dedup.exact_dedup(docs.limit(0)).count() == 0


def test_exact_rows_equal_the_sql(spark):
    rows = [(1, "A"), (1, "a"), (2, "b"), (2, "b"), (3, None), (4, ""), (5, "É")]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    want = sorted(duck.execute(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({queries.ORACLE_SQL['op1_exact_dedup']})").fetchall())
    got = exact_dedup.exact_dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert sorted(map(tuple, got.collect())) == want


def test_a_task_sends_one_row_a_text(spark):
    docs = spark.range(1000).selectExpr("id as doc_id", "'same' as text").repartition(3)
    merged = exact_dedup.digests(docs).withColumn("_salt", exact_dedup._salt(16)).groupBy("_sha", "_salt", "_norm").count()
    assert merged.count() == 3


def test_surviving_edges(spark):
    docs = spark.sql("select * from values (1L, 'T', map('a', 1)), (1L, 't', map('a', 2)), (1L, 't', map('a', 2)), (cast(null as long), 'T', null), (2L, null, null), (3L, '', null) as t(doc_id, text, _row)")
    got = sorted(exact_dedup.surviving(docs).collect(), key=lambda r: r.doc_id)
    assert [r.doc_id for r in got] == [1, 3] and got[1].text == "" and got[0].text.lower() == "t" and docs.columns == list(got[0].asDict())
    assert exact_dedup.surviving(docs.limit(0)).count() == 0
    again = sorted(exact_dedup.surviving(docs.repartition(4)).collect(), key=lambda r: r.doc_id)
    assert got == again
    lone = spark.createDataFrame([(None, "x"), (None, "X")], "doc_id long, text string")
    assert exact_dedup.surviving(lone).count() == 1 and {r.kept for r in exact_dedup.exact_dedup(lone).collect()} == {True}


@pytest.mark.parametrize("salts", [1, 5])
def test_exact_hot_group_and_whole_rows(spark, salts):
    rows = [(i, "Same TEXT" if i % 3 == 0 else f"text {i % 50}", f"s{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _norm string").repartition(7)
    best = {}
    for i, t, s in rows:
        best[t.lower()] = max(best.get(t.lower(), (-1, "", "")), (i, t, s))
    assert {(r[0], r[1], r[2]) for r in exact_dedup.surviving(docs, salts=salts).collect()} == set(best.values())
    assert {r.doc_id for r in exact_dedup.exact_dedup(docs, salts=salts).filter("kept").collect()} == {v[0] for v in best.values()}


def brute_fingerprint(text, n=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + n]).encode(), 42) for i in range(max(1, len(words) - n + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints():
    rng = random.Random(0)
    texts = ["", " \n\t", "one", "One  two", "a b c", "a\x0bb\x0cc\xa0d e", "É é A a", *[" ".join(rng.choice(["ab", "Cd", "é", "f"]) for _ in range(rng.randint(1, 60))) for _ in range(40)]]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_long_texts_are_read_whole(monkeypatch):
    text = " ".join(f"w{i % 977}" for i in range(5000)) + "  " + "y" * 3000 + " tail end"
    want = brute_fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 500)
    assert simhash.fingerprint(text) == want


def test_links_against_all_pairs(spark):
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for f in base.tolist():
        for _ in range(6):
            f ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False))
            fps.add(f)
    fps = np.array(sorted(fps), dtype=np.uint64)
    parent = {f: f for f in fps.tolist()}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i, f in enumerate(fps):
        for g in fps[i + 1 :][np.bitwise_count(fps[i + 1 :] ^ f) <= 3].tolist():
            parent[find(g)] = find(int(f))
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.variants(df).repartition(3, "key").sortWithinPartitions("key").mapInArrow(simhash._collide, "a long, b long")
    roots = {r.node: r.root for r in simhash.components(found).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    want = {g for g in groups({f: find(f) for f in parent}) if len(g) > 1}
    assert groups({k % 2**64: v for k, v in roots.items()}) == want


def test_near_duplicates(spark):
    text = " ".join(f"word{i}" for i in range(200))
    rows = [(5, text), (3, text.upper()), (9, text.replace("word7 ", "Word7 ")), (8, None), (2, ""), (4, "completely other words stand in here"), (4, "completely other words stand in here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as fp", "2 as component_id")
    got = sorted((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == [(2, 2), (3, 3), (4, 4), (4, 4), (5, 3), (8, 2), (9, 3)]
    assert sorted(r.doc_id for r in simhash.representatives(docs).collect()) == [2, 3, 4]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_representatives_lose_no_other_text(spark):
    words = " ".join(f"word{i}" for i in range(200))
    other = "completely other words stand in here and go on for a while"
    rows = [(1, words), (5, words.upper()), (5, other), (None, words), (7, other), (7, other), (None, "alone with no number at all"), (None, "alone with no number at all")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "map('k', doc_id) as _a", "1 as fp", "2 as best")
    got = simhash.representatives(docs)
    assert got.columns == docs.columns and got.count() == 3
    assert {(r.doc_id, r.text) for r in got.collect()} == {(1, words), (5, other), (None, "alone with no number at all")}
    assert simhash.representatives(docs.limit(0)).count() == 0


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        words = [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(rng.choice([0, 1, 2, 3, 40, 150]))]
        for _ in range(rng.randint(1, 3)):
            if words and rng.random() < 0.7:
                words[rng.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    fps = {i: brute_fingerprint(t) for i, t in rows}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if group[j] < group[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    group[i], changed = group[j], True
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{fps[i]:016x}", group[i]) for i in fps}


def test_group_of_one_variant_is_linked_as_a_star():
    rng = np.random.default_rng(4)
    near = np.unique(np.uint64(7) ^ (np.uint64(1) << rng.integers(0, 64, 50).astype(np.uint64)))
    stars = simhash.link(near)
    assert len(stars) == len(near) - 1 and len({a for a, _ in stars}) == 1
