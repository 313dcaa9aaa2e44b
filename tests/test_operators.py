"""Operators on small tables."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandloom.functions import sequence, similarity
from strandloom.operators import aggregate, curate, graph, models, ranking, search, select, similar, verify


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_first_wins_and_best(spark):
    df = frame(spark, [("a", 2, "x"), ("a", 1, "y"), ("b", 3, None), (None, 1, "z")], "k string, o int, v string")
    assert {(r.k, r.v) for r in curate.first_wins(df, ["k"], ["o"]).collect()} == {("a", "y"), ("b", None), (None, "z")}
    assert {(r.k, r.o) for r in curate.best_of(df, ["k"], "o").collect()} == {("a", 2), ("b", 3), (None, 1)}


def test_first_wins_of_maps(spark):
    df = spark.sql("select * from values (1, map('a', 1), named_struct('m', map('b', 2))), (1, map('a', 2), null), (2, null, null) as t(k, m, s)")
    assert sorted(r.k for r in curate.first_wins(df, ["k"], ["k"]).collect()) == [1, 2]


def test_merge_domains(spark):
    df = frame(spark, [("ACD", "vae", "v1", 2), ("ACD", "ar", "a1", 1), ("ACE", "ar", "a2", 3)], "s string, d string, i string, o int")
    rows = {r.s: r for r in aggregate.merge_domains(df, "s", "d", "i", None, ["o"]).collect()}
    assert rows["ACD"].domain_count == 2 and rows["ACD"].contributing_candidate_ids == ["a1", "v1"] and rows["ACD"].primary_domain == "ar" and rows["ACD"].o == 1
    over = {r.domain: (r.n_sequences, r.n_exclusive) for r in aggregate.domain_overlap(aggregate.merge_domains(df, "s", "d", "i", None, ["o"])).collect()}
    assert over == {"ar": (2, 1), "vae": (1, 0)}


def test_clusters_and_split(spark):
    df = frame(spark, [("a", "ACDEFGHI"), ("b", "ACDEFGHV"), ("c", "KKKKKKKK"), ("d", "ACDEFGHI")], "k string, s string")
    out = {r.k: r.cluster_id for r in graph.similarity_clusters(df, "k", "s", (0.8,)).collect()}
    assert out["a"] == out["b"] == out["d"] == "indel_80_000001" and out["c"] == "indel_80_000002"
    split = graph.clustered_split(frame(spark, list(out.items()), "k string, cluster_id string"), "cluster_id")
    got = {r.k: r.split for r in split.collect()}
    assert got["a"] == got["b"] and got == {r.k: r.split for r in split.collect()}
    assert aggregate.leakage(split, "cluster_id", "split").count() == 0


def united(edges):
    """Groups by union-find."""
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    return grouped({x: find(x) for x in parent})


def grouped(roots):
    out = {}
    for k, v in roots.items():
        out.setdefault(v, set()).add(k)
    return {frozenset(x) for x in out.values()}


def test_turns_of_components_are_logarithmic(spark, monkeypatch):
    contract, turns = graph._contract, []
    monkeypatch.setattr(graph, "_contract", lambda edges, turn: turns.append(turn) or contract(edges, turn))
    rng = np.random.default_rng(3)
    graphs = {
        "path": [(i, i + 1) for i in range(9_999)], "star": [(0, i) for i in range(1, 3_000)],
        "random": [(int(a), int(b)) for a, b in rng.integers(0, 2_000, (1_500, 2)) if a != b],
    }
    for name, edges in graphs.items():
        turns.clear()
        found = graph.components(frame(spark, edges, "a long, b long"))
        assert grouped({r.node: r.root for r in found.collect()}) == united(edges), name
        assert len(turns) <= {"path": 20, "star": 1, "random": 20}[name]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 0


def test_components_of_a_few_edges(spark):
    found = graph.components(frame(spark, [(3, 1), (1, 3), (1, 1), (5, 4), (4, 2), (None, 2), (7, None)], "a long, b long")).collect()
    assert grouped({r.node: r.root for r in found}) == {frozenset({1, 3}), frozenset({2, 4, 5})}
    assert graph.components(frame(spark, [], "a long, b long")).count() == 0


def common(a, b):
    """Longest common subsequence, a cell at a time."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(new[j], row[j + 1], row[j] + (x == y)))
        row = new
    return row[-1]


def test_indel_ratio_at_any_length(spark):
    rng = np.random.default_rng(11)
    make = lambda n, letters: "".join(rng.choice(list(letters), n))
    pairs = [("", ""), ("", "A"), ("A" * 63, "K" * 63), ("A" * 64, "K" * 64), ("A" * 64, "A" * 64), ("B" * 70, "B" * 70), ("é😀x", "x😀é")]
    pairs += [(make(n, letters), make(m, letters)) for n in (1, 61, 62, 63, 64, 124, 125, 200, 300) for m in (5, 62, 130, 300) for letters in ("AC", "ABCDEFJOUXZ-é")]
    df = frame(spark, [(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    got = {r.i: (r.x, r.y) for r in df.select("i", similarity.indel_ratio(F.col("a"), F.col("b")).alias("x"), similarity.long_indel_ratio(F.col("a"), F.col("b")).alias("y")).collect()}
    for i, (a, b) in enumerate(pairs):
        want = 2 * common(a, b) / (len(a) + len(b)) if a or b else 1.0
        assert got[i] == (pytest.approx(want), pytest.approx(want)) and select.indel(a, b) == pytest.approx(want)


def test_similarity_joins_of_long_and_foreign_texts(spark):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(40):
        base = "".join(rng.choice(list("ACDEFGHBJOUXZ"), rng.integers(55, 140)))
        rows += [(2 * i, base), (2 * i + 1, base[:20] + "W" + base[21:60] + base[63:])]
    df = frame(spark, rows, "k long, s string")
    want = {(i, j): select.indel(a, b) for i, a in rows for j, b in rows if i < j and a != b and select.indel(a, b) >= 0.8}
    got = {(r.a, r.b): r.similarity for r in similar.similar_pairs(df, "k", "s", 0.8).collect()}
    assert len(want) >= 40 and set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    near = {r.k: r.max_reference_similarity for r in similar.nearest_reference(df.filter("k % 2 = 1"), df.filter("k % 2 = 0"), "k", "s", "k", "s").collect()}
    assert all(near[i] == pytest.approx(max(select.indel(a, b) for j, b in rows if j % 2 == 0)) for i, a in rows if i % 2)


def test_similar_pairs_and_nearest(spark):
    rng = np.random.default_rng(5)
    rows = [(i, "".join(rng.choice(list("ACDKW"), rng.integers(6, 12)))) for i in range(60)]
    df = frame(spark, rows, "k long, s string")
    want = {(i, j): select.indel(a, b) for i, a in rows for j, b in rows if i < j and a != b and select.indel(a, b) >= 0.7}
    got = {(r.a, r.b): r.similarity for r in similar.similar_pairs(df, "k", "s", 0.7).collect()}
    assert set(got) == set(want) and all(got[x] == pytest.approx(want[x]) for x in want)
    near = {r.k: r.max_reference_similarity for r in similar.nearest_reference(df.filter("k >= 30"), df.filter("k < 30"), "k", "s", "k", "s", None).collect()}
    assert all(near[i] == pytest.approx(max(select.indel(a, b) for j, b in rows if j < 30)) for i, a in rows if i >= 30)


def test_ranking(spark):
    df = frame(spark, [(g, i) for g in "ab" for i in range(50)], "g string, x int")
    assert {(r.g, r.x, r["rank"]) for r in ranking.top_k_per_group(df, ["g"], [F.desc("x")], 2).collect()} == {("a", 49, 1), ("a", 48, 2), ("b", 49, 1), ("b", 48, 2)}
    ranked = ranking.assign_ranks(df, [F.desc("x"), F.asc("g")], 101).collect()
    assert sorted(r["rank"] for r in ranked) == list(range(101, 201)) and next(r for r in ranked if r["rank"] == 101).x == 49
    assert [r.x for r in ranking.backfill(df.filter("g = 'a' and x = 7").select("x"), df.select("x").distinct(), "x", 3, ["x"]).collect()] == [7, 0, 1]
    assert ranking.contiguous(frame(spark, [(1,), (3,)], "i int"), "i").first()["contiguous"] is False


def test_lineage(spark):
    nodes = frame(spark, [("s", None, "s", 0), ("a", "s", "s", 1), ("b", "a", "s", 2), ("o", "gone", "s", 1)], "sequence_id string, parent_id string, seed_id string, generation int")
    got = {r.sequence_id: (r.ancestor, r.depth, r.complete) for r in graph.lineage_depth(nodes, "sequence_id", "parent_id").collect()}
    assert got["b"] == ("s", 2, True) and got["s"] == ("s", 0, True) and got["o"][2] is False
    sound = nodes.filter("sequence_id <> 'o'")
    edges = sound.filter("parent_id is not null").select("parent_id", F.col("sequence_id").alias("child_id"), "seed_id", "generation")
    assert graph.ancestry_violations(sound, edges).count() == 0
    back = edges.unionByName(frame(spark, [("b", "a", "s", 1)], edges.schema))
    assert {"several_parents", "generation_not_increasing"} <= {r.rule for r in graph.ancestry_violations(sound, back).collect()}
    assert {(r.sequence_id, r.ancestor) for r in graph.trace(sound, "sequence_id", "parent_id").collect()} >= {("b", "s"), ("b", "a")}


def candidates(n=30):
    rng = np.random.default_rng(3)
    return pd.DataFrame({
        "sequence": ["".join(rng.choice(list(sequence.RESIDUES), 20)) for _ in range(n)], "primary_domain": [["ar", "vae", "evo", "dif"][i % 4] for i in range(n)], "lcb_quality": rng.random(n), "pred_amp_probability": rng.random(n), "pred_toxicity_risk": rng.random(n),
        "max_reference_similarity": 0.5, "net_charge_ph7": rng.normal(3, 2, n), "eisenberg_moment": rng.random(n), "length": 20, "isoelectric_point": rng.normal(9, 1, n), "gravy": rng.normal(0, 1, n), "boman_index": rng.normal(0, 1, n), "instability_index": rng.normal(30, 9, n),
    })


def weighed(pdf):
    x = pdf[list(select.KERNEL_COLUMNS)].to_numpy(dtype=float)
    spread = x.std(axis=0)
    return select.Weighed.of(pdf, x.mean(axis=0), np.where(spread > 0, spread, 1))


def kernel_of(x):
    """Similarities by definition: a Gaussian of descriptors and a cosine of compositions, scaled by quality."""
    e = np.exp(np.clip(x.quality, -2, 2))
    one = lambda i, j: 0.6 * np.exp(-((x.bio[i] - x.bio[j]) ** 2).sum() / 8) + 0.4 * (x.mix[i] * x.mix[j]).sum()
    return np.array([[e[i] * e[j] * (one(i, j) if i != j else 1) for j in range(len(e))] for i in range(len(e))])


def test_kernel_is_positive_semidefinite():
    x = weighed(candidates(40))
    s = x.near(x)
    assert np.abs(s - kernel_of(x)).max() < 1e-9 and np.linalg.eigvalsh(s).min() >= -1e-9


def greedy(pdf, k, quota=(1, 60), required=(), most_cosine=1.1, most_indel=None):
    """The determinantal choice by determinants, a candidate at a time."""
    pdf = pdf.sort_values("sequence").reset_index(drop=True)
    x = weighed(pdf)
    L = kernel_of(x) + 1e-4 * np.eye(len(pdf))
    log = lambda at: np.linalg.slogdet(L[np.ix_(at, at)])[1] if at else 0.0
    taken, cov = [], np.zeros(4)
    while len(taken) < k:
        count = pdf.primary_domain.iloc[taken].value_counts().to_dict()
        unmet = {d for d in required if count.get(d, 0) < quota[0]}
        tight = k - len(taken) <= sum(quota[0] - count.get(d, 0) for d in unmet)
        free = [
            i for i in range(len(pdf)) if i not in taken and count.get(pdf.primary_domain[i], 0) < quota[1] and (not tight or pdf.primary_domain[i] in unmet)
            and all(x.mix[i] @ x.mix[t] <= most_cosine and (most_indel is None or select.indel(pdf.sequence[i], pdf.sequence[t]) <= most_indel) for t in taken)
        ]
        best = max(free, key=lambda i: (round(pdf.lcb_quality[i] + 0.5 * (log([*taken, i]) - log(taken)) + 0.3 * (np.log1p(cov + x.use[i]) - np.log1p(cov)).sum(), 9), -i))
        taken.append(best)
        cov = cov + x.use[best]
    return pdf.sequence.iloc[taken].tolist()


@pytest.mark.parametrize("front", [2, 9, 1024])
def test_portfolio_against_determinants(spark, monkeypatch, front):
    monkeypatch.setattr(select, "FRONT", front)
    monkeypatch.setattr(select, "AT_ONCE", 3)
    pdf = candidates(40)
    limits = {"most_cosine": 0.75, "most_indel": 0.5}
    out = select.select_portfolio(spark.createDataFrame(pdf).repartition(4), 8, 4, quota=(1, 3), required=["ar", "vae"], **limits).orderBy("portfolio_rank").toPandas()
    assert out.sequence.tolist() == greedy(pdf, 8, (1, 3), ("ar", "vae"), **limits)
    out = select.select_portfolio(spark.createDataFrame(pdf), 6, 3, quota=(2, 60), required=["dif"], most_cosine=1.1, most_indel=None).orderBy("portfolio_rank").toPandas()
    assert out.sequence.tolist() == greedy(pdf, 6, (2, 60), ("dif",))


def test_few_rows_are_scored_again(spark, monkeypatch):
    monkeypatch.setattr(select, "FRONT", 40)
    report = []
    pdf = candidates(400)
    out = select.select_portfolio(spark.createDataFrame(pdf), 12, 6, most_cosine=1.1, most_indel=None, report=report).orderBy("portfolio_rank").toPandas()
    assert out.sequence.tolist() == greedy(pdf, 12)
    assert len(report) == 12 and sum(r["by_tasks"] + r["by_driver"] for r in report) < 12 * 400 / 3


def test_portfolio_rarely_writes_its_pool(spark, monkeypatch):
    """A front that no longer leads is read anew; bounds are written only where that is not enough."""
    monkeypatch.setattr(select, "FRONT", 40)
    written, real = [], select.materialize
    monkeypatch.setattr(select, "materialize", lambda df, label, **more: written.append(label) or real(df, label, **more))
    pdf = candidates(400)
    out = select.select_portfolio(spark.createDataFrame(pdf), 12, 6, most_cosine=1.1, most_indel=None).orderBy("portfolio_rank").toPandas()
    assert out.sequence.tolist() == greedy(pdf, 12) and written.count("pool") == 1 and written.count("bounds") <= 3, written


def test_portfolio(spark):
    df = spark.createDataFrame(candidates())
    out = select.select_portfolio(df, 8, 4, quota=(1, 3), required=["ar", "vae", "evo", "dif"]).toPandas()
    assert len(out) == 8 and set(out.primary_domain) == {"ar", "vae", "evo", "dif"} and out.primary_domain.value_counts().max() <= 3 and out.is_nested.sum() == 4
    with pytest.raises(ValueError, match="novelty"):
        select.select_portfolio(df.withColumn("max_reference_similarity", F.lit(0.9)), 8, 4)
    with pytest.raises(ValueError, match="missing columns"):
        select.select_portfolio(df.drop("max_reference_similarity"), 8, 4)


def test_mutation_keeps_bounds(spark):
    rng = np.random.default_rng(8)
    rows = [(i, "".join(rng.choice(list(sequence.RESIDUES), n))) for i, n in enumerate([8] * 20 + [50] * 20 + [25] * 20)]
    out = search.mutate(frame(spark, rows, "k long, s string"), "k", "s", 25, 1, 1).collect()
    assert len(out) == 1500
    for r in out:
        assert 8 <= len(r.child) <= 50 and set(r.child) <= set(sequence.RESIDUES) and r.child != "" and abs(len(r.child) - len(r.s)) == (0 if r.mutation_type == "sub" else 1)
        assert r.mutation_type != "sub" or sum(a != b for a, b in zip(r.s, r.child)) == 1
    only = search.mutate(frame(spark, rows[20:40], "k long, s string"), "k", "s", 5, 1, 1, (0.0, 1.0, 0.0))
    assert {r.mutation_type for r in only.collect()} == {"sub"}
    with pytest.raises(ValueError):
        search.mutate(only, "k", "s", 1, 1, 1, (float("nan"), 1, 1))


def test_search_respects_budget(spark):
    seeds = frame(spark, [("s1", "KWKLFKKIGKVLKVL", "a"), ("s2", "GLFDIVKKVVGALGSL", "b")], "sequence_id string, sequence string, family string")
    ev = search.Evaluator()
    nodes, edges, history = search.evolve(seeds, ev, generations=3, budget=8, children=4, per_family=3)
    assert ev.counts["unique_calls"] <= 8 and nodes.count() == edges.count() + 2 and history
    assert graph.ancestry_violations(nodes, edges).count() == 0


def test_motifs_entropy_metrics(spark):
    df = frame(spark, [("a", "KWKW"), ("b", "KWKW"), ("c", "KWKWK"), ("d", "AAAA")], "k string, s string")
    lib = aggregate.motif_library(df, "k", F.filter(sequence.substrings(F.col("s")), sequence.amphipathic), lambda m: F.length(m).cast("double")).collect()
    assert [(r.motif_sequence, r.frequency, r.associated_seq_count, r.example_sequence_ids) for r in lib] == [("KWKW", 3, 3, "a;b;c")]
    assert aggregate.shannon_entropy(df, "k").first()[0] == pytest.approx(np.log(4), abs=1e-6)
    m = aggregate.metrics(frame(spark, [(1, 0.9), (0, 0.1), (1, 0.5), (0, 0.5)], "y int, s double"), "y", "s", "s").first()
    assert m["roc_auc"] == pytest.approx(0.875)


def test_forest_spread_matches_trees(spark):
    rng = np.random.default_rng(0)
    x = rng.random((120, 3))
    df = frame(spark, [(i, [float(v) for v in row], int(row[0] + 0.3 * row[1] > 0.6)) for i, row in enumerate(x)], "k long, x array<double>, y int")
    model = models.train_forest(df, "x", "y", trees=7, depth=4)
    got = {r.k: (r.m, r.s) for r in models.forest_spread(df, model, "x", "m", "s").collect()}
    trees = [models._tree(t) for t in model.trees]
    shares = models.tree_shares(trees, x)
    assert all(got[i] == (pytest.approx(shares[i].mean(), abs=1e-4), pytest.approx(shares[i].std(), abs=1e-4)) for i in range(120))
    parts, score = models.cross_validate(graph.grouped_folds(df.withColumn("g", F.col("k") % 17), "g", "y", 3), "x", "y", "fold", "k", trees=5, depth=3)
    assert parts.count() == 120 and score.first()["roc_auc"] > 0.7


def test_forest_makes_its_features_once(spark):
    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def features(k):
        made.add(1)
        return [float(k % 7), float(k % 5)]

    rows = spark.range(60).select("id", features("id").alias("x"), (F.col("id") % 7 > 3).cast("int").alias("y"))
    model = models.train_forest(rows, "x", "y", trees=3, depth=3, balanced=True)
    assert made.value == 60 and len(model.trees) == 3


def test_forest_is_read_at_once(spark, monkeypatch):
    rng = np.random.default_rng(1)
    df = frame(spark, [(i, [float(v) for v in rng.random(3)], int(rng.random() > 0.5)) for i in range(90)], "k long, x array<double>, y int")
    model = models.train_forest(df, "x", "y", trees=5, depth=5)
    one = [models._tree(t) for t in model.trees]
    for a, b in zip(one, models._trees(model, spark), strict=True):
        assert all(np.array_equal(a[c], b[c]) for c in a)
    monkeypatch.setattr(models, "_tree", None)  # no node is asked for by itself
    assert models.forest_spread(df, model, "x").count() == 90


def test_scorer_interface(spark):
    df = frame(spark, [(1, "ACDK"), (2, "KKRR")], "k long, s string")
    assert models.score_in_batches(df, "k", "s", models.stub_panel(2), "mic_0 double, mic_1 double", 1).count() == 2


def test_verification(spark):
    lib = frame(spark, [("ACDEFGHI",), ("KKKKKKKK",)], "s string")
    rules = verify.submission_rules(lib, lib.limit(1), frame(spark, [("KKKKKKKK",)], "s string"), "s", 2, 1)
    assert {r.rule: r.violations for r in verify.rule_counts(rules).collect()}["reference_overlap"] == 1
    with pytest.raises(ValueError, match="reference_overlap"):
        verify.require(verify.rule_counts(rules))
    a = frame(spark, [(1, 0.1), (2, None)], "k int, v double")
    assert verify.same_values(a, a.repartition(3), ["k"]) and not verify.same_values(a, a.withColumn("v", F.col("v") + 1e-16 * 2), ["k"])


def test_farthest_points(spark):
    df = frame(spark, [(0, 0.0), (1, 1.0), (2, 10.0), (3, 5.0)], "k long, x double")
    assert [r.k for r in select.farthest_points(df, "k", ["x"], 3).orderBy("rank").collect()] == [0, 2, 3]
    assert select.farthest_points(df, "k", ["x"], 9).count() == 4 and select.farthest_points(df.limit(0), "k", ["x"], 3).count() == 0
    rng = np.random.default_rng(2)
    x = rng.integers(0, 6, (60, 2)).astype(float)  # many ties
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    near, chosen = np.linalg.norm(z - z[0], axis=1), [0]
    while len(chosen) < 15:
        at = max((i for i in range(60) if i not in chosen), key=lambda i: (round(near[i], 9), i))
        chosen.append(at)
        near = np.minimum(near, np.linalg.norm(z - z[at], axis=1))
    df = frame(spark, [(i, *map(float, v)) for i, v in enumerate(x)], "k long, x double, y double").repartition(3)
    for front in (1, 4, 1024):
        report = []
        assert [r.k for r in select.farthest_points(df, "k", ["x", "y"], 15, front, report).orderBy("rank").collect()] == chosen
        assert (report[0] == 0) == (front == 1024) and report[0] <= 15


def test_copies_of_a_point_are_one(spark):
    """Copies with other keys fill no front, and are chosen last, by falling key."""
    df = frame(spark, [(10 * c + i, x) for c in range(40) for i, x in enumerate((0.0, 1.0, 10.0, 5.0, 7.0))], "k long, x double")
    report = []
    got = [r.k for r in select.farthest_points(df, "k", ["x"], 7, 8, report).orderBy("rank").collect()]
    assert got == [0, 392, 393, 394, 391, 390, 384] and report == [0]


def test_cosine_pairs_leave_their_tasks_rounded(spark):
    """Rounding and a row's pair with itself are the task's work on a whole block, not an expression's on each pair."""
    df = frame(spark, [(i, [float(i % 5), float(i % 3), 1.0]) for i in range(30)], "k long, v array<double>")
    out = similar.cosine_pairs(df, "k", "v", df.filter("k % 4 = 0"), block=3, row_block=7, digits=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.splitlines()[0].startswith("MapInArrow")
    rows, x = out.collect(), np.array([[i % 5, i % 3, 1.0] for i in range(30)])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    assert len(rows) == 8 * 29 and all(r.query != r.other and r.similarity == pytest.approx(x[r.query] @ x[r.other], abs=5.1e-5) and r.similarity == round(r.similarity, 4) for r in rows)


def test_diverse_greedy_against_a_loop(spark):
    from strandloom.functions.similarity import local_score

    rng = np.random.default_rng(3)
    rows = [("".join(rng.choice(list("ACDK"), 12)), int(rng.integers(0, 9))) for _ in range(70)]
    taken = []
    for s, v in sorted(rows, key=lambda r: (r[1], r[0])):
        if all(local_score(s, t) / max(len(s), len(t)) <= 0.5 for t, _ in taken):
            taken.append((s, v))
    for block in (3, 512):
        out = select.diverse_greedy(frame(spark, rows, "sequence string, v int"), min(8, len(taken)), "v", most=0.5, block=block)
        assert [(r.sequence, r.v) for r in out.orderBy("rank").collect()] == taken[:8]
    with pytest.raises(ValueError, match="can be chosen"):
        select.diverse_greedy(frame(spark, rows, "sequence string, v int"), 71, "v", most=0.5)


def test_quantiles_against_numpy(spark):
    rng = np.random.default_rng(7)
    rows = [("ab"[int(g)], float(v)) for g, v in zip(rng.integers(0, 2, 500), rng.integers(0, 30, 500))] + [("c", 2.5), (None, 1.0), (None, 4.0), ("a", None)]
    df = frame(spark, rows, "g string, v double").repartition(5)
    shares = [0, 0.1, 0.25, 0.5, 0.9, 1]
    got = {r.g: r.q for r in aggregate.quantiles(df, "g", "v", shares).collect()}
    for g in ("a", "b", "c", None):
        assert got[g] == pytest.approx(np.quantile([v for k, v in rows if k == g and v is not None], shares).tolist())
    assert aggregate.quantiles(df, None, "v", [0.3]).first()["q"][0] == pytest.approx(np.quantile([v for _, v in rows if v is not None], 0.3))
    assert aggregate.quantiles(df.limit(0), "g", "v", shares).count() == 0


def test_balanced_sample_takes_the_smallest_hashes(spark):
    df = frame(spark, [(i, [0, 0, 0, 1, None][i % 5]) for i in range(60)], "k long, y int").repartition(4)
    out = ranking.balanced_sample(df, "y", "k")
    hashes = {r.k: (r.y, r.h) for r in df.select("k", "y", F.xxhash64(F.lit(42), F.col("k").cast("string")).alias("h")).collect()}
    want = {k for y in (0, 1, None) for k in sorted((k for k in hashes if hashes[k][0] == y), key=lambda k: hashes[k][1])[:12]}
    assert {r.k for r in out.collect()} == want and out.columns == ["k", "y"]


def test_hot_keys_are_exchanged_on_both_sides(spark):
    """Joins with one row a key on the right leave both sides to exchanges of their own, which adaptive execution may split."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        df, ref = frame(spark, [("a", 1)], "s string, v int"), frame(spark, [("a", "x")], "s string, i string")
        frames = [curate.flag_reference(df, ref, "s"), curate.quarantine(df, ref, "s"), curate.link(df, ref, "s", "i"), curate.fill_from(df.withColumn("i", F.lit("")), ref.withColumn("o", F.lit(1)), "s", "i", "o"), curate.many_to_one(df, ref, "s")]
        for out in frames:
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert plan.count("Exchange hashpartitioning") == 3 and "Join" in plan, plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_draws_match_hypergeometric(spark):
    df = frame(spark, [(i, 0.5, 0.9 if i < 8 else 0.1, 0.1, True) for i in range(100)], "k long, q double, a double, t double, ok boolean")
    p = select.simulate_draws(df, "k", "q", "a", "t", "ok", 25, 20000).first()["prob_at_least_1"]
    want = aggregate.hypergeometric_tail(frame(spark, [(100, 8, 25, 1)], "n int, k int, d int, x int"), "n", "k", "d", "x").first()["tail_probability"]
    assert abs(p - want) < 4 * (want * (1 - want) / 20000) ** 0.5 + 1e-4


def test_hypergeometric_tail_of_large_draws(spark):
    """A loop over log factorials for each term would take 10^9 steps for the last row."""
    rows = [(100, 25, 40, 10), (5000, 40, 3000, 35), (20000, 8000, 6000, 2400), (10, 0, 0, 1), (10, 3, 9, 2)]
    got = aggregate.hypergeometric_tail(frame(spark, rows, "n int, k int, d int, x int"), "n", "k", "d", "x").collect()

    def want(n, k, d, least):
        return sum(math.comb(k, x) * math.comb(n - k, d - x) for x in range(max(least, d + k - n, 0), min(k, d) + 1)) * 10**9 // math.comb(n, d) / 10**9

    for r in got:
        assert abs(r["tail_probability"] - want(r["n"], r["k"], r["d"], r["x"])) < 1e-6


def test_cosine_queries_are_met_in_blocks(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 3))
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(x)], "k long, v array<double>").repartition(3)
    out = similar.cosine_pairs(df, "k", "v", df.filter("k % 2 = 0"), block=7, row_block=11)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    n = x / np.linalg.norm(x, axis=1)[:, None]
    got = {(r.query, r.other): r.similarity for r in out.collect()}
    assert got.keys() == {(a, b) for a in range(0, 60, 2) for b in range(60) if a != b}
    assert all(abs(v - n[a] @ n[b]) < 1e-9 for (a, b), v in got.items())
    high = {(r.query, r.other) for r in similar.cosine_pairs(df, "k", "v", df.filter("k % 2 = 0"), least=0.9).collect()}
    assert high == {p for p, v in got.items() if v >= 0.9}
    none = frame(spark, [(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None)], "k long, v array<double>")
    assert [tuple(r) for r in similar.cosine_pairs(none, "k", "v", none.filter("k <= 1")).collect()] == [(1, 2, None)]
    assert similar.cosine_pairs(none, "k", "v", none.limit(0)).count() == 0
