"""Source mixing and url filters."""

import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import source_mix, url_filter


def test_targets():
    t = source_mix.targets([100, 1000, 1000], (5, 2, 1))
    assert t[0] == 300 and sum(t) == pytest.approx(2100) and t[1] == pytest.approx(2 * t[2])
    assert source_mix.targets([0, 10], (5, 2)) == [0, 10] and source_mix.targets([], (1,)) == []
    assert source_mix.targets([5, 5, 5, 5], (5, 2, 1)) == pytest.approx([20 * w / 13 for w in (5, 2, 1, 5)])


@pytest.mark.parametrize("shards", [1, 2, 7, 64])
def test_split_tree(shards):
    quotas = [0, 5, 1000, 333]
    out = source_mix.split_tree(quotas, shards)
    assert out.shape == (shards, 4) and (out.sum(axis=0) == quotas).all() and (out >= 0).all()
    assert np.ptp(out.sum(axis=1)) <= 1 and (out == source_mix.split_tree(quotas, shards)).all()


def test_split_tree_follows_the_distribution():
    got = np.array([source_mix.split_tree([30, 70], 2, seed)[0][0] for seed in range(400)])
    assert abs(got.mean() - 15) < 0.5 and abs(got.var() - 50 * 0.3 * 0.7 * 50 / 99) < 1.5


def corpus(spark, n=3000):
    rng = np.random.default_rng(1)
    rows = [(i, "w " * int(rng.integers(0, 60)), None if i % 11 == 0 else "abc"[min(2, int(rng.exponential(0.8)))]) for i in range(n)]
    rows += [(n, None, "a"), (n + 1, "", "b"), (n + 2, "w " * 4000, "c")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).repartition(5)


def test_mixture(spark):
    docs = corpus(spark)
    out = source_mix.mixture(docs, blocks=64).toPandas()
    assert len(out) == 3003
    again = source_mix.mixture(docs.repartition(3), blocks=64).toPandas()
    key = lambda x: x.sort_values("doc_id").taken.tolist()
    assert key(out) == key(again)
    sources = out.merge(docs.select("doc_id", "source").toPandas(), on="doc_id")
    assert ((out.taken % out["size"].clip(lower=1)) == 0).all() and (out.taken <= 3 * out["size"]).all()
    for _, part in sources.groupby("source", dropna=False):
        assert abs(part.taken.sum() - part.target.iloc[0]) <= part["size"].max() / 2 + 1
    assert out.drop_duplicates("target").shape[0] == 4


def counted(rows):
    out = {}
    for r in rows:
        out[r.doc_id] = out.get(r.doc_id, 0) + 1
    return out


def test_mixed_rows_agree_with_the_plan(spark):
    docs = corpus(spark, 800)
    taken = {r.doc_id: r.taken // max(1, r["size"]) for r in source_mix.mixture(docs, blocks=16).collect() if r["size"]}
    rows = source_mix.mixed(docs, shards=8, blocks=16).collect()
    assert {k: v for k, v in counted(rows).items() if k in taken} == {k: v for k, v in taken.items() if v}
    assert {r.mix_shard for r in rows} == set(range(8)) and rows[0].size == "x"
    parts = source_mix.mixed(docs, shards=8, blocks=16).withColumn("p", F.spark_partition_id()).groupBy("p").agg(F.count_distinct("mix_shard").alias("n")).collect()
    assert all(r.n == 1 for r in parts)


def brute_mix(spark, rows, shards=source_mix.SHARDS, blocks=None, seed=source_mix.SEED):
    """Draws of each document and shard, from (id, text, source): every step of the method in plain Python."""
    hashes = spark.createDataFrame([(i,) for i, _, _ in rows], "i long").select("i", *[F.xxhash64(F.lit(seed + k), "i").alias(f"h{k}") for k in (0, 2)]).collect()
    size = {i: len((t or "").split()) for i, t, _ in rows}
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    words = {n: sum(size[i] for i, _, s in rows if s == n) for n in names}
    goal = dict(zip(names, source_mix.targets([words[n] for n in names]), strict=True))
    total = sum(words.values())
    a_block = max(1, min(source_mix.WORDS_A_BLOCK, total // source_mix.BLOCKS), total // source_mix.MOST_BLOCKS)
    parts = {n: blocks or max(source_mix.LEAST_BLOCKS, words[n] // a_block) for n in names}
    of = {i: s for i, _, s in rows}
    by = {r.i: (r.h0 % parts[of[r.i]], (r.h2, r.i)) for r in hashes}
    turn = {r.b: r.h for r in spark.range(max(parts.values())).select(F.col("id").alias("b"), F.xxhash64(F.lit(seed + 1), "id").alias("h")).collect()}
    draws = {}
    for n in names:
        held = {}
        for i, _, s in rows:
            if s == n:
                held.setdefault(by[i][0], []).append(i)
        passes = min(3, int(goal[n] // words[n])) if words[n] else 0
        want = goal[n] - passes * words[n] if passes < 3 else 0
        order = sorted(held, key=lambda b: (turn[b], b))
        draws[n] = [list(held[b]) for _ in range(passes) for b in order]
        for b in order:
            if want <= 0:
                break
            mine, own = sorted(held[b], key=lambda i: by[i][1]), sum(size[i] for i in held[b])
            if own > want:
                ends = np.cumsum([0, *[size[i] for i in mine]])
                fits = [k for k, i in enumerate(mine) if ends[k] + size[i] / 2 <= want]
                mine = mine[: max(fits) + 1] if fits else []
            draws[n].append(mine)
            want -= own
    tree = source_mix.split_tree([len(draws[n]) for n in names], shards, seed)
    out = {}
    for k, n in enumerate(names):
        ends = np.cumsum(tree[:, k])
        for at, block in enumerate(draws[n]):
            for i in block:
                out.setdefault((i, int(np.searchsorted(ends, at, side="right"))), []).append(1)
    return {k: len(v) for k, v in out.items()}, size, words, goal


def test_mix_against_brute_force(spark):
    docs = corpus(spark, 900)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    named = {i: s for i, _, s in rows}
    want, size, words, goal = brute_mix(spark, rows, 7, 32)
    got = {}
    for r in source_mix.mixed(docs, shards=7, blocks=32).collect():
        got[r.doc_id, r.mix_shard] = got.get((r.doc_id, r.mix_shard), 0) + 1
    assert got == want
    times = {}
    for (i, _), n in want.items():
        times[i] = times.get(i, 0) + n
    for r in source_mix.mixture(docs, shards=7, blocks=32).collect():
        source = named[r.doc_id]
        assert (r["size"], r.source_size, r.taken) == (size[r.doc_id], words[source], size[r.doc_id] * times.get(r.doc_id, 0)) and r.target == pytest.approx(goal[source])


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_sizes_and_targets_equal_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    sql = rf"""WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM '{path}'),
        s AS (SELECT source, sum(size) AS words, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS place FROM d GROUP BY source)
        SELECT doc_id, size, words, CASE place % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source FROM d JOIN s USING (source)"""
    want = duckdb.sql(sql).df()
    by = want.drop_duplicates("source").sort_values("source")
    total, free, goal = by.words.sum(), set(by.source), {}
    while free:
        rest = by[by.source.isin(free)]
        share = {r.source: (total - sum(goal.values())) * r.weight / rest.weight.sum() for r in rest.itertuples()}
        over = {r.source: 3.0 * r.words for r in rest.itertuples() if share[r.source] > 3 * r.words}
        goal |= over or share
        free = free - set(over) if over else set()
    got = source_mix.mixture(spark.read.parquet(path)).toPandas().merge(want, on="doc_id", suffixes=("", "_sql"))
    assert len(got) == len(want) and (got["size"] == got.size_sql).all() and (got.source_size == got.words).all()
    assert got.target.tolist() == pytest.approx([goal[s] for s in got.source])
    near = got.groupby("source").agg(taken=("taken", "sum"), target=("target", "first"), top=("size", "max"))
    assert ((near.taken - near.target).abs() <= near.top / 2 + 1).all()


def test_columns_may_have_any_names(spark):
    names = ["words", "_last", "_key", "_block", "_source", "_at", "_id", "_name", "_text", "_shard", "_order", "mix_shard", "_c0", "_left", "_pass", "size", "target", "DOC.ID"]
    docs = corpus(spark, 200).drop("size")
    for n in names:
        docs = docs.withColumn(n, F.struct(F.lit(n).alias("x"), F.create_map(F.lit("k"), F.col("doc_id")).alias("m")))
    out = source_mix.mixed(docs, shards=3, blocks=8, places=False)
    assert out.columns == docs.columns and out.count() > 0
    assert out.filter(f"words.x <> 'words' or _key.m['k'] <> doc_id or `DOC.ID`.x <> 'DOC.ID'").count() == 0
    assert source_mix.mixed(docs, shards=3, blocks=8).columns == [*docs.columns, "mix_shard", "mix_order"]
    assert source_mix.mixture(docs, blocks=8).count() == docs.count()


def test_wide_tree_holds_what_is_left_only():
    import tracemalloc

    quotas, shards = np.random.default_rng(2).integers(0, 700, 1_000).tolist(), 100_000
    total = sum(quotas)
    tracemalloc.start()
    nodes = source_mix.top(source_mix.root(quotas, shards), total, shards, 1)
    got, used = np.zeros(1_000, dtype=np.int64), 0
    for leaf in source_mix.leaves(nodes[7], total, shards, 1):  # one task's subtree
        got[leaf.source] += leaf.count
        used += 1
        assert (total * (leaf.lo + 1) // shards) - (total * leaf.lo // shards) == leaf.count.sum()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(nodes) == source_mix.TOP and used == nodes[7].hi - nodes[7].lo and peak < 20e6
    assert got[nodes[7].source].tolist() == nodes[7].count.tolist() and got.sum() == nodes[7].count.sum()


def test_subtrees_of_tasks_make_the_whole_tree(spark):
    quotas = [0, 50, 1, 700, 33]
    tree = source_mix.split_tree(quotas, 90)
    assert source_mix.TOP < 90
    rows = source_mix.runs(spark, quotas, 90).collect()
    assert {(r._shard, r._at): r._count for r in rows} == {(i, k): tree[i, k] for i, k in zip(*np.nonzero(tree), strict=True)}
    before = np.cumsum(tree, axis=0) - tree
    assert all(r._from == before[r._shard, r._at] for r in rows) and source_mix.runs(spark, [0, 0], 4).count() == 0


def test_mixture_counts_what_is_dealt(spark, monkeypatch):
    docs = corpus(spark, 300)
    whole = {r.doc_id: r.taken for r in source_mix.mixture(docs, shards=4, blocks=16).collect()}
    tree = source_mix.runs
    monkeypatch.setattr(source_mix, "runs", lambda *a: tree(*a).filter("_shard > 0"))
    part = {r.doc_id: r.taken for r in source_mix.mixture(docs, shards=4, blocks=16).collect()}
    assert part.keys() == whole.keys() and all(part[k] <= whole[k] for k in whole) and 0 < sum(part.values()) < sum(whole.values())


def test_mixture_of_repeated_rows(spark):
    docs = corpus(spark, 300).drop("size")
    again = docs.filter("doc_id % 5 = 0").unionByName(docs.filter("doc_id % 10 = 0").withColumn("text", F.lit("w w")))
    docs = docs.unionByName(again)
    times = counted(source_mix.mixed(docs, blocks=16).collect())
    rows = counted(docs.collect())
    out = source_mix.mixture(docs, blocks=16).collect()
    assert len(out) == docs.count() and all(r.taken == r["size"] * times.get(r.doc_id, 0) / rows[r.doc_id] for r in out)


def test_blocks_follow_the_words_of_a_source(spark, monkeypatch):
    docs = corpus(spark, 2000)
    held = lambda: {r._name: (r._blocks, r.source_size) for r in source_mix.plan(docs.selectExpr("doc_id as _id", "text as _text", "source as _name")).sources.collect()}
    monkeypatch.setattr(source_mix, "LEAST_BLOCKS", 2)
    monkeypatch.setattr(source_mix, "BLOCKS", 100)
    few = held()
    assert sum(b for b, _ in few.values()) == pytest.approx(100, abs=5) and all(b == pytest.approx(100 * w / sum(x for _, x in few.values()), abs=2) for b, w in few.values())
    monkeypatch.setattr(source_mix, "WORDS_A_BLOCK", 50)
    assert all(b == w // 50 for b, w in held().values())
    monkeypatch.setattr(source_mix, "MOST_BLOCKS", 30)
    assert sum(b for b, _ in held().values()) <= 30


def test_targets_of_many_sources_take_linear_time():
    t = source_mix.targets([1 + i % 7 for i in range(200_000)])
    assert sum(t) == pytest.approx(sum(1 + i % 7 for i in range(200_000)))


def test_empty_mix(spark):
    docs = corpus(spark, 3).limit(0)
    assert source_mix.mixture(docs).count() == 0 and source_mix.mixed(docs).count() == 0
    blank = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    assert {r.taken for r in source_mix.mixture(blank).collect()} == {0}


def keys(names):
    import xxhash

    h = lambda x, s: xxhash.xxh64_intdigest(x.encode(), s)
    return np.array([[h(n, 1), h(n, 2)] for n in names], dtype=np.uint64).reshape(-1, 2)


@pytest.mark.parametrize("n_listed", [0, 1, 50, 2000])
def test_cascade_is_exact_on_its_universe(n_listed):
    universe = [f"host{i}.example/" for i in range(20_000)]
    listed = universe[:n_listed]
    inside, outside = keys(listed), keys(universe[n_listed:])
    first = url_filter.Bloom.of(inside, 0.05, 1)
    cascade = url_filter.finish(inside, first, outside[first.holds(outside)])
    assert cascade.holds(inside).all() if n_listed else True
    assert not cascade.holds(outside).any()


def decide(url, rules, blocked):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        end = min((i for c in "/?#" if (i := rest.find(c)) >= 0), default=len(rest))
        host, tail = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        stop = min((i for c in "?#" if (i := tail.find(c)) >= 0), default=len(tail))
        path = tail[:stop]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    if fits:
        *_, rule, verdict = max(fits)
        return host, path, rule, verdict
    return host, path, None, "block" if any(host == b or host.endswith("." + b) for b in blocked) else "allow"


URLS = [None, "", "no scheme", "http://", "http://EXAMPLE.com/en/x", "https://a.example.com/en/?q", "http://www.example.com/en/1", "http://deep.www.example.com/en/1#t", "http://x.net/es/1", "http://x.net/fr", "http://x.net/fr/", "ftp://notexample.com/en/",
        "http://spam-farm.example.org/en/1", "http://a.spam-farm.example.org?x=http://example.com/en/", "http://com/", "http://x.com", "http://x.com#/en/", "http://É.net/es/", "http://a..net/fr/", "http://x.com/en/" + "p" * 50_000, "x://y://example.com/en/",
        "http://" + "a." * 30_000 + "www.example.com/en/", "http://" + "." * 30_000 + "net/es/"]


def test_verdicts(spark):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(URLS)] + [(0, None)], "page_id long, url string").withColumn("rule", F.lit(1))
    rows = url_filter.judge(pages).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == decide(URLS[r.page_id], url_filter.RULES, url_filter.BLOCKED_HOSTS), URLS[r.page_id]
    assert url_filter.judge(pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        url_filter.judge(pages, rules=[("allow", "a", "/"), ("block", "a", "/")])


@pytest.mark.parametrize("order", [1, -1])
def test_of_equally_long_rules_the_longer_host_wins(spark, order):
    rules = [("allow", "com", "/en"), ("block", "a.com", "/"), ("block", "b.com", "/"), ("allow", "net", "/x/y"), ("block", "q.net", "/x"), ("allow", "de", ""), ("block", "x.de", "/")][::order]
    urls = ["http://a.com/en", "http://b.com/en/", "http://c.com/en", "http://q.net/x/y", "http://x.de", "http://y.x.de/", "http://a.com/"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(pages, rules=rules).collect():
        assert (r.host, r.path, r.rule, r.verdict) == decide(urls[r.page_id], rules, url_filter.BLOCKED_HOSTS)


def test_parts_take_any_column(spark):
    rows = spark.createDataFrame([("http://A.b/c?d", "x://y/z#"), (None, "none")], "one string, two string")
    got = [tuple(r) for r in rows.select(*url_filter.parts(F.col("one")), *url_filter.parts(F.col("two"))).collect()]
    assert got == [("a.b", "/c", "y", "/z"), ("", "", "", "")]


def test_the_list_does_not_travel(spark, monkeypatch):
    sent = []
    send = type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, x: sent.append(x) or send(self, x))
    pages = spark.createDataFrame([(i, f"http://h{i}.test/p/") for i in range(300)], "page_id long, url string")
    rules = [("block", f"h{i}.test", "/p/") for i in range(0, 300, 7)]
    got = {r.page_id: r.verdict for r in url_filter.judge(pages, rules=rules, blocked=()).collect()}
    assert got == {i: "allow" if i % 7 else "block" for i in range(300)}
    held = lambda x: [x] if isinstance(x, url_filter.Bloom) else [y for part in (x.values() if isinstance(x, dict) else x.levels if isinstance(x, url_filter.Cascade) else x if isinstance(x, list | tuple) else [None]) for y in held(part)] if not isinstance(x, str | bytes | set) and x is not None else [x]
    assert len(sent) == 2 and all(isinstance(y, url_filter.Bloom) for x in sent for y in held(x))


def test_many_rules_against_brute_force(spark):
    rng = np.random.default_rng(6)
    hosts = [f"{a}.{b}.test" for a in "abcdefgh" for b in "xyz"]
    pick = lambda: ("allow" if rng.random() < 0.5 else "block", str(rng.choice(["x.test", "y.test", *hosts])), str(rng.choice(["/", "/p/", "/p/q/"])))
    rules = list({(h, p): (v, h, p) for v, h, p in (pick() for _ in range(40))}.values())
    urls = [f"http://{rng.choice(hosts)}{rng.choice(['', '/', '/p/', '/p/q/', '/p/q/r', '/z'])}" for _ in range(400)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    for r in url_filter.judge(pages, rules=rules, blocked=("b.z.test",)).collect():
        assert (r.host, r.path, r.rule, r.verdict) == decide(urls[r.page_id], rules, ("b.z.test",))


def test_listed_hashes_are_sparks(spark):
    keys = ["a", "", "net/es/", "ünï", "a"]
    got = spark.createDataFrame([(k,) for k in set(keys)], "k string").select(url_filter._hashes(F.col("k")).alias("h")).select("h.*").collect()
    want = url_filter._pairs([r.a for r in got], [r.b for r in got])
    assert sorted(map(tuple, want.tolist())) == list(map(tuple, url_filter.listed_hashes(keys).tolist()))
    assert url_filter.listed_hashes([]).shape == (0, 2)


def test_membership_of_equal_first_hashes():
    listed = np.array([[1, 2], [1, 5], [3, 1]], dtype=np.uint64)
    keys = np.array([[1, 5], [1, 2], [1, 3], [3, 1], [2, 2], [9, 9]], dtype=np.uint64)
    assert url_filter.among(keys, listed).tolist() == [True, True, False, True, False, False]
    assert not url_filter.among(keys, listed[:0]).any()
