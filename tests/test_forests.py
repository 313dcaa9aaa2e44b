"""Random forests against plain ones."""

import math
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandloom.functions import batches
from strandloom.operators import models, trees


def made(spark, n=240, parts=3):
    rng = np.random.default_rng(3)
    x = np.round(rng.random((n, 5)) ** 3, 2)
    x[:, 4] = rng.integers(0, 4, n)
    y = (x[:, 0] + x[:, 4] / 4 + 0.4 * rng.random(n) > 0.9).astype(int)
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))]
    return spark.createDataFrame(rows + rows[:50] + rows[:20], "k long, x array<double>, y int").repartition(parts), x, y


def same(a, b):
    return len(a) == len(b) and all(np.array_equal(s[c], t[c]) for s, t in zip(a, b, strict=True) for c in s)


def test_forest_does_not_depend_on_partitions(spark):
    df, _, _ = made(spark)
    one, other = (models._trees(models.train_forest(d, "x", "y", trees=4, depth=4, balanced=True), spark) for d in (df.coalesce(1).orderBy("k"), df.repartition(7)))
    assert same(one, other) and len(one[0]["feature"]) > 5


def plain(x, y, w, cuts, weights, tree, seed, depth):
    """A tree by looking at all rows in each node, level by level."""
    most = math.ceil(math.sqrt(x.shape[1]))
    out, level = [{"rows": np.arange(len(x))}], [0]
    for d in range(depth):
        drawn = np.argsort(np.random.default_rng([seed, tree, d]).random((len(level), x.shape[1])), axis=1, kind="stable")[:, :most]
        following = []
        for node, features in zip(level, drawn, strict=True):
            rows, best = out[node]["rows"], (1e-12, None)
            sums = lambda i: np.array([w[i][y[i] == c].sum() * weights[c] for c in (0, 1)])
            gini = lambda i: (1 - ((sums(i) / sums(i).sum()) ** 2).sum()) * sums(i).sum()
            for f in features:
                for cut in cuts[f]:
                    a, b = rows[x[rows, f] <= cut], rows[x[rows, f] > cut]
                    if w[a].sum() and w[b].sum() and (gain := (gini(rows) - gini(a) - gini(b)) / sums(rows).sum()) > best[0] + 1e-13:
                        best = gain, (f, cut, a, b)
            if best[1]:
                f, cut, a, b = best[1]
                out[node] |= {"feature": f, "threshold": cut, "left": len(out), "right": len(out) + 1}
                out += [{"rows": a}, {"rows": b}]
                following += [len(out) - 2 + i for i, part in enumerate((a, b)) if len({y[r] for r in part if w[r]}) > 1]
        level = following
    for node in out:
        node["share"] = (s := np.array([w[node["rows"]][y[node["rows"]] == c].sum() * weights[c] for c in (0, 1)]))[1] / s.sum()
    return out


def test_forest_is_a_plain_one(spark):
    df, x, y = made(spark)
    got = models.train_forest(df, "x", "y", trees=3, depth=4, balanced=True, seed=7)
    held = df.select(F.col("x").alias("features"), F.col("y").cast("double").alias("label"))
    sizes = {r[0]: r[1] for r in df.groupBy("y").count().collect()}
    cuts = trees.bin_cuts(held, df.count())
    bags = trees.instances(held, cuts, np.array([0.0, 1.0]), 3, 7).collect()
    bins, label, w = (np.array([list(r[c]) if c != "label" else r[c] for r in bags]) for c in ("bins", "label", "weights"))
    places = [np.arange(len(c)) for c in cuts]
    for t, tree in enumerate(got.trees):
        nodes = plain(bins, label, w[:, t].astype(int), places, [310 / (2 * sizes[c]) for c in (0, 1)], t, 7, 4)
        assert tree["feature"].tolist() == [n.get("feature", -1) for n in nodes]
        assert tree["threshold"].tolist() == [cuts[n["feature"]][n["threshold"]] if "feature" in n else 0.0 for n in nodes]
        assert tree["share"] == pytest.approx([n["share"] for n in nodes])
        for row, share in zip(x, models.tree_shares(got.trees, x)[:, t], strict=True):
            at = 0
            while "feature" in nodes[at]:
                at = nodes[at]["left" if row[nodes[at]["feature"]] <= cuts[nodes[at]["feature"]][nodes[at]["threshold"]] else "right"]
            assert share == pytest.approx(nodes[at]["share"])


def test_bins_are_of_all_rows(spark):
    few = spark.range(70).select(F.array((F.col("id") % 7).cast("double"), F.col("id").cast("double"), F.greatest(F.lit(0.0), F.col("id") - 59.0)).alias("features"))
    a, b, c = trees.bin_cuts(few, 70)
    assert a.tolist() == [i + 0.5 for i in range(6)] and c.tolist() == [i + 0.5 for i in range(10)]
    assert len(b) == 31 and np.diff(trees.to_bins(np.arange(70.0)[:, None], [b])[:, 0]).max() == 1
    heavy = spark.range(4000).select(F.array(F.greatest(F.lit(0.0), F.col("id") - 3900.0)).alias("features"))
    assert len(trees.bin_cuts(heavy, 4000)[0]) > 12  # one value of 97 % of all rows leaves bins to the others


def test_bags_are_poisson(spark):
    rng = np.random.default_rng(5)
    for n in (1, 5, 64):
        w = trees.bag_weights(rng.integers(-(2**62), 2**62, 20000), np.full(20000, n), 3, 42).astype(float)
        assert w.mean(axis=0) == pytest.approx(n, rel=0.03) and w.var(axis=0) == pytest.approx(n, rel=0.06) and abs(np.corrcoef(w.T)[0, 1]) < 0.03
        assert (w == n).mean() == pytest.approx(math.exp(n * math.log(n) - n - math.lgamma(n + 1)), abs=0.015)
    rows = spark.range(1000).select(F.array(F.lit(1.0)).alias("features"), F.lit(0.0).alias("label"))
    bags = trees.instances(rows, [np.array([])], np.array([0.0]), 4, 1)
    total = np.array([list(r.weights) for r in bags.collect()]).sum(axis=0)
    assert bags.count() == 16 and all(abs(t - 1000) < 160 for t in total)  # a row of a thousand copies is drawn in parts


def test_rows_are_counted_in_pieces(monkeypatch):
    rng = np.random.default_rng(6)
    x, y, w = rng.integers(0, 32, (40, 4)).astype(np.uint8), rng.integers(0, 2, 40), rng.integers(0, 3, (40, 2)).astype(np.uint8)
    drawn = np.array([[0, 1], [2, 3], [1, 3]])
    # the second level's three nodes: both sides of the first of two, the right one of the other
    routes = [(np.array([0, 0]), np.array([15, 32]), np.array([0, 1, 2, 2])), (np.array([1, 2, 0]), np.array([7, 9, 32]), np.array([0, 1, 3, 2, 3, 3]))]
    want = np.zeros((3, 2, 32, 2), dtype=int)
    for row, c, n in zip(x, y, w[:, 1], strict=True):
        node = (0 if row[1] <= 7 else 1) if row[0] <= 15 else (3 if row[2] <= 9 else 2)
        for j in range(2):
            if node < 3:
                want[node, j, row[drawn[node, j]], c] += n
    for rows, turn, nodes in ((1 << 20, 1 << 15, 256), (7, 3, 2)):
        for k, v in (("ROWS", rows), ("TURN", turn), ("NODES", nodes)):
            monkeypatch.setattr(trees, k, v)
        batch = pa.RecordBatch.from_pydict({"bins": trees._packed(x), "label": pa.array(y, pa.int32()), "weights": trees._packed(w)})
        got = np.zeros((3, 2 * 32 * 2), dtype=np.int64)
        for out in trees._counter(SimpleNamespace(value={1: (routes, drawn)}), 4, 2, 2)([batch.slice(0, 9), batch.slice(9)]):
            (r,) = out.to_pylist()
            trees._add(got[r["part"] : r["part"] + r["nodes"]].reshape(-1), r["size"], r["sums"])
        assert np.array_equal(got.reshape(want.shape), want)


def test_counts_are_written_whole():
    rng = np.random.default_rng(8)
    for most, share, size in ((9, 0.02, 0), (2**40, 0.05, 0), (300, 0.9, 2), (2**40, 0.9, 8), (1, 0.0, 0)):
        counts = np.where(rng.random((6, 2, 32, 2)) < share, rng.integers(1, most + 1, (6, 2, 32, 2)), 0)
        kind, raw = trees._written(counts.astype(float))
        out = np.ones(counts.size, dtype=np.int64)
        trees._add(out, kind, raw)
        assert kind == size and np.array_equal(out - 1, counts.reshape(-1))


def test_what_no_forest_is_fitted_on(spark):
    with pytest.raises(ValueError, match="needs rows"):
        models.train_forest(spark.createDataFrame([], "x array<double>, y int"), "x", "y")
    with pytest.raises(Exception, match="without nulls"):
        models.train_forest(spark.createDataFrame([([1.0, None], 1)], "x array<double>, y int"), "x", "y")


def test_records_are_cut_by_bytes(spark):
    """As the expression that it stands for, whatever the text."""
    texts = ["aBcé ß\x01K", "", None, "😀Yy", "zzzz", "BJOUXZ", "acdefghiklmnpqrstvwyACDEFGHIKLMNPQRSTVWY", "ſKé", "x" * 300000 + "W"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1)
    want = F.upper(F.regexp_replace("t", "[^AC-IK-NP-TVWYac-ik-np-tvwy]", ""))
    assert rows.select(batches.residues_only(F.col("t")).alias("got"), want.alias("want")).filter("not got <=> want").count() == 0
