"""Quality classifier and quality rules."""

import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandloom.llm import quality_model, quality_rules

HERE = "/root/testdata/sf0.01"
needs_tables = pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")


def test_gradient_learns_the_odd_passage():
    rng = np.random.default_rng(1)
    bags, labels = [], []
    for i in range(200):
        bag = rng.normal(0, 0.3, (rng.integers(1, 6), quality_model.N_FEATURES)).astype(np.float32)
        if i % 2:
            bag[rng.integers(len(bag)), 3] += 3  # one passage tells the class
        bags.append(bag)
        labels.append(i % 2)
    model = quality_model.fit(bags[:150], labels[:150])
    score, _ = model.scores(bags[150:])
    assert ((score > 0.5) == np.array(labels[150:])).mean() > 0.95
    again, _ = quality_model.fit(bags[:150], labels[:150]).scores(bags[150:])
    assert (score == again).all()


def test_gradient_against_differences():
    rng = np.random.default_rng(1)
    bags = [rng.normal(0, 1, (k, quality_model.N_FEATURES)) for k in (1, 5, 3)]
    model = quality_model.fit(bags * 2, [0, 1, 0] * 2, steps=2)
    starts, bag = quality_model.places(np.array([1, 5, 3]))
    x, y, each = np.concatenate(bags), np.array([0.0, 1.0, 0.0]), np.array([0.25, 0.5, 0.25])
    _, mid = model.forward(x, starts, bag)
    assert np.bincount(bag, mid["a"]) == pytest.approx([1, 1, 1])
    grad = model.gradient(x, starts, bag, y, each)

    def loss():
        p, _ = model.forward(x, starts, bag)
        return -(each * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum()

    for name, w in model.weights.items():
        for at in [tuple(rng.integers(0, n) for n in w.shape) for _ in range(4)]:
            held = w[at]
            w[at] = held + 1e-5
            up = loss()
            w[at] = held - 1e-5
            assert grad[name][at] == pytest.approx((up - loss()) / 2e-5, abs=1e-7), name
            w[at] = held


def plain_passages(text):
    """The features of each passage, a word and a character at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return [[0.0] * quality_model.N_FEATURES]
    cuts = [i for i in range(0, len(words), 64) if i == 0 or len(words) - i > 32]
    out = []
    for a, b in zip(cuts, [*cuts[1:], len(words)]):
        part = [w.encode() for w in words[a:b]]
        raw, n = b"".join(part), len(part)
        groups = [*quality_model._CLASSES, bytes(range(97, 123)), bytes(range(65, 91)), bytes(range(128, 256))]
        share = [sum(c in g for c in raw) / len(raw) for g in groups]
        rest = 1 - sum(share)
        again = sum(words[i] == words[i - 1] for i in range(max(a, 1), b))
        shapes = [sum(lo <= len(w) <= hi for w in part) / n for lo, hi in ((0, 1), (2, 3), (4, 8), (13, 10**9))]
        buckets = [sum(zlib.crc32(w.lower()) % quality_model.BUCKETS == k for w in part) / n for k in range(quality_model.BUCKETS)]
        out.append([rest, *share, np.log1p(n), len(raw) / n / 10, len(set(part)) / n, again / n, *shapes, *buckets])
    return out


def plain_score(text, model):
    sigmoid, w = lambda v: 1 / (1 + math.exp(-v)), {k: v.tolist() for k, v in model.weights.items()}
    hidden, marks = [], []
    for row in plain_passages(text):
        x = [(v - m) / s for v, m, s in zip(row, model.mean, model.scale)]
        h = [math.tanh(sum(v * r[k] for v, r in zip(x, w["w1"])) + w["b1"][k]) for k in range(len(w["b1"]))]
        gate = [math.tanh(sum(v * r[k] for v, r in zip(h, w["v"]))) * sigmoid(sum(v * r[k] for v, r in zip(h, w["u"]))) for k in range(len(w["a"]))]
        hidden.append(h)
        marks.append(sum(a * g for a, g in zip(w["a"], gate)))
    e = [math.exp(m - max(marks)) for m in marks]
    z = [sum(a / sum(e) * h[k] for a, h in zip(e, hidden)) for k in range(len(w["c"]))]
    return sigmoid(sum(c * v for c, v in zip(w["c"], z)) + w["d"][0])


@needs_tables
def test_scores_against_a_plain_version(spark):
    docs, labels = spark.read.parquet(f"{HERE}/documents.parquet"), spark.read.parquet(f"{HERE}/labels.parquet")
    model = quality_model.train(docs, labels)
    texts = {r.doc_id: r.text for r in docs.filter("doc_id % 9 = 0").collect()} | {-1: "", -2: " \n", -3: "Ab ab !? ü", -4: "word " * 40_000 + "Junk $$$ " * 500}
    got = quality_model.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.score for r in got} == pytest.approx({i: plain_score(t, model) for i, t in texts.items()}, abs=1e-5)


def test_all_passages_are_learned_from(spark, monkeypatch):
    seen = []
    fit = quality_model.fit
    monkeypatch.setattr(quality_model, "fit", lambda bags, labels: seen.extend(bags) or fit(bags, labels))
    docs = spark.createDataFrame([(i, "word " * 64 * 100) for i in range(20)], "doc_id long, text string")
    quality_model.train(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), sample=3)
    assert [len(b) for b in seen] == [100] * 6


def test_passages_cover_every_word():
    for n in (0, 1, 63, 64, 95, 96, 97, 200):
        out = quality_model.encode(" ".join(["ab"] * n))
        words = np.expm1(out[:, quality_model.N_CLASSES])
        assert round(float(words.sum())) == n and out.shape[1] == quality_model.N_FEATURES


@needs_tables
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{HERE}/documents.parquet"), spark.read.parquet(f"{HERE}/labels.parquet")
    out = quality_model.classify(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert len(out) > 50 and (out.predicted == out.quality).mean() > 0.95 and out.score.between(0, 1).all()


def test_edges_of_classify(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "a b c"), (3, "a b c"), (None, "x")], "doc_id long, text string").withColumn("score", F.lit("taken"))
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_model.classify(docs, none).collect()
    assert len(out) == 5 and {r.score for r in out} == {0.5} and {r.predicted for r in out} == {1}
    odd = spark.createDataFrame([(3, 1), (3, 0), (1, None), (2, 7)], "doc_id long, quality int")
    assert {r.score for r in quality_model.classify(docs, odd).collect()} == {0.5}
    assert quality_model.classify(docs.limit(0), none).count() == 0
    assert quality_model.keep(docs, none).columns == ["doc_id", "text", "score"]
    assert quality_model.score(docs.drop("score"), quality_model.fit([np.zeros((1, quality_model.N_FEATURES)), np.ones((1, quality_model.N_FEATURES))], [0, 1], steps=3)).count() == 5


def base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    seen = {}
    for i in range(len(words) - 4):
        seen.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered)


TEXTS = [None, "", " \n", "one", "a b c d e", "a b c d e a b c d e", "x " * 40, "l1\nl1\n \n \nl2\nl1", "a#b |c| <d> 5%\x0bz", "é ü " * 9, " ".join(map(str, range(300))), "\u00a0a b", "a b c d e f g a b c d e q r s t"]


LONG = " ".join(f"w{i * i % 40_009}" for i in range(120_000)) + "\n" + "日本語 😀 テスト。 " * 50


@pytest.mark.parametrize("collide", [False, True])
def test_base_counts(spark, monkeypatch, collide):
    if collide:  # then words alone tell windows apart
        monkeypatch.setattr(quality_rules, "_window_hash", lambda words: F.lit(7).cast("long"))
    texts = [*TEXTS, "a b c d e f g h a b c d x e a b c d e q", *([] if collide else [LONG])]
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").withColumn("common", F.lit(1))
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality_rules.judge(docs).collect()}
    assert got == {i: base(t) for i, t in enumerate(texts)}
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_classes_count_characters(spark):
    text = "Ab9 日本語😀é x-y #!"
    row = quality_rules.counts(spark.createDataFrame([(1, text, "ja"), (2, None, None)], "doc_id long, text string, lang string")).orderBy("_id").collect()
    assert list(row[0].classes) == [1, 1, 2, 1, 5, 3] and sum(row[0].classes) == row[0].word_chars == 13
    assert list(row[1].classes) == [0] * 6


def test_every_language_has_its_classes(spark):
    """Three hundred words of a language without a list, none repeated, are near their own language."""
    ja = [" ".join(f"日本{chr(0x3042 + (i * k) % 80)}{chr(0x4E00 + i)}語。" for i in range(300)) for k in (1, 7, 11)]
    odd = " ".join(f"#$%{i}&" for i in range(300))
    rows = [(i, t, "ja") for i, t in enumerate(ja * 10)] + [(100, odd, "ja"), (101, ja[0], None), (102, ja[0], None), (103, odd, "xx")]
    got = {r.doc_id: r for r in quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].kept and got[i].word_distance is None and got[i].char_distance < 0.2 for i in range(30)), [(r.kept, r.base_failed, r.char_distance) for r in got.values()][:3]
    assert not got[100].kept and got[101].kept and got[101].char_distance == pytest.approx(0) and got[103].kept


def test_distance_is_linear_in_its_items(spark):
    plan = quality_rules.judge(spark.createDataFrame([(1, "a", "en")], "doc_id long, text string, lang string"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("aggregate(") == 2  # one a distance, and no sum inside of it


def jensen_shannon(p, q):
    p, q = np.array(p, dtype=float) / sum(p), np.array(q, dtype=float)
    m = (p + q) / 2
    part = lambda x: sum(a * np.log2(a / b) for a, b in zip(x, m) if a > 0)
    return np.sqrt(max(0, (part(p) + part(q)) / 2))


@needs_tables
def test_rules_against_numpy(spark):
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    counted = quality_rules.materialize(quality_rules.counts(docs), "test-counts")
    known = {r._of: (r._chars, r._words) for r in quality_rules.references(counted).collect()}
    rows = {r._id: r for r in counted.collect()}
    assert set(known) == set(quality_rules.COMMON)
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    for i, r in rows.items():
        assert (got[i].n_words, got[i].word_chars, got[i].n_repeat_words) == (r.n_words, r.word_chars, r.n_repeat_words)
        assert sum(r.common) == r.n_words
        if r.n_words >= quality_rules.GUARD_WORDS:
            assert got[i].word_distance == pytest.approx(jensen_shannon(r.common, known[r._lang][1]), abs=1e-9)
        if r.word_chars >= quality_rules.GUARD_CHARS:
            assert got[i].char_distance == pytest.approx(jensen_shannon(r.classes, known[r._lang][0]), abs=1e-9)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{HERE}/labels.parquet").collect()}
    good = [got[i].kept for i, q in labels.items() if q == 1 and not got[i].base_failed]
    bad = [got[i].kept for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.15


def test_tables_are_dealt_anew_only_where_the_session_asks(spark, tmp_path):
    from strandloom.llm import common

    spark.range(1000).selectExpr("id as doc_id", "cast(id as string) as text").coalesce(1).write.parquet(str(tmp_path / "one.parquet"))
    exchanges = lambda: common.read(spark, str(tmp_path), "one", "doc_id", "text")._jdf.queryExecution().executedPlan().toString().count("Exchange RoundRobin")
    assert exchanges() == 0
    spark.conf.set(common.DEAL, "6")
    try:
        assert exchanges() == 1 and common.read(spark, str(tmp_path), "one", "doc_id").rdd.getNumPartitions() == 6
    finally:
        spark.conf.unset(common.DEAL)


def test_long_texts_give_a_bounded_number_of_passages():
    bag = np.arange(1000, dtype=np.float32).reshape(-1, 1)
    some = quality_model.evenly(bag, 320)
    assert len(some) == 320 and some[0] == 0 and some[-1] > 990 and (np.diff(some[:, 0]) > 0).all() and quality_model.evenly(bag, 1000) is bag
