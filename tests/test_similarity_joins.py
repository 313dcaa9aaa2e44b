"""Similarity joins against brute force: nothing is lost by pivots, counts, lengths or seeds, and most pairs are ruled out."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.functions.similarity import bit_masks, common_length, local_score
from strandloom.operators import similar


def ratio(x, y):
    return 2 * common_length(bit_masks(x), len(x), y) / (len(x) + len(y)) if x or y else 1.0


def family(seed, n, letters="ACDEFGHIKL", longest=60):
    """Texts in families: some random, most of them copies of another with a few edits."""
    rng, out = random.Random(seed), [""]
    for _ in range(n):
        if len(out) > 5 and rng.random() < 0.7:
            x = list(rng.choice(out))
            for _ in range(rng.randint(0, 6)):
                at = rng.randint(0, len(x))
                x[at : at + rng.randint(0, 1)] = rng.choice([[], [rng.choice(letters)]])
            out.append("".join(x))
        else:
            out.append("".join(rng.choice(letters) for _ in range(rng.randint(0, longest))))
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.8), (2, 0.6), (3, 0.95)])
def test_no_pair_is_lost(spark, seed, threshold):
    texts = family(seed, 160)
    df = spark.createDataFrame([*enumerate(texts), (1000, None)], "k long, s string")
    first = {}
    for k, s in enumerate(texts):
        first.setdefault(s, k)
    want = {(min(i, j), max(i, j)) for x, i in first.items() for y, j in first.items() if x < y and ratio(x, y) >= threshold}
    assert {(r.a, r.b) for r in similar.similar_pairs(df, "k", "s", threshold).collect()} == want
    met = similar.candidate_pairs(df, "k", "s", threshold).count()
    unbound = similar.candidate_pairs(df, "k", "s", threshold, pivots=[]).count()
    assert len(want) <= met <= unbound


def test_pivots_rule_out_what_counts_cannot(spark):
    """Anagrams of one another have equal counts; pivots tell them apart."""
    rng = random.Random(7)
    texts = set()
    while len(texts) < 150:
        x = list("AACCDDEEFFGGHHIIKKLL" * 2)
        rng.shuffle(x)
        texts.add("".join(x))
    df = spark.createDataFrame(list(enumerate(sorted(texts))), "k long, s string")
    met, unbound = (similar.candidate_pairs(df, "k", "s", 0.9, pivots=p).count() for p in (None, []))
    assert unbound == 150 * 149 // 2 and met < 0.7 * unbound


@pytest.mark.parametrize("window", [0.8, None])
def test_nearest_is_the_nearest(spark, window):
    texts = family(5, 150)
    df, ref = (spark.createDataFrame([(k, s) for k, s in enumerate(texts) if (k % 3 == 0) == part], "k long, s string") for part in (False, True))
    held = [(s, k) for k, s in enumerate(texts) if k % 3 == 0]
    inside = lambda a, b: window is None or np.ceil(a * window / (2 - window) - 1e-9) <= b <= np.floor(a * (2 - window) / window + 1e-9)
    for r in similar.nearest_reference(df, ref, "k", "s", "k", "s", window).collect():
        found = [(ratio(r.s, s), -k) for s, k in held if inside(len(r.s), len(s))]
        best = max(found, default=(0.0, None))
        assert (r.max_reference_similarity, r.nearest_reference) == (best[0], None if best[1] is None else -best[1])
    near = {r.k: (r.max_reference_similarity, r.nearest_reference) for r in similar.threshold_matches(df, ref, "k", "s", "k", "s", 0.75).collect()}
    want = {k: max((ratio(s, t), -j) for t, j in held) for k, s in enumerate(texts) if k % 3}
    assert near == {k: (x, -j) for k, (x, j) in want.items() if x > 0.75}


def test_empty_sides(spark):
    none = spark.createDataFrame([], "k long, s string")
    some = spark.createDataFrame([(1, "ACDE"), (2, None)], "k long, s string")
    assert similar.similar_pairs(none, "k", "s", 0.8).count() == 0
    assert {(r.k, r.max_reference_similarity) for r in similar.nearest_reference(some, none, "k", "s", "k", "s").collect()} == {(1, 0.0), (2, 0.0)}
    assert similar.nearest_reference(none, some, "k", "s", "k", "s", None).count() == 0
    assert similar.local_pairs(none, some, "s", "s").count() == similar.local_pairs(some, none, "s", "s").count() == 0
    assert similar.local_screen(some, none, "s", "s").count() == 2


@settings(max_examples=200, deadline=None)
@given(*[st.text(alphabet="ab", max_size=12)] * 3)
def test_distances_are_a_metric(x, y, z):
    d = lambda a, b: len(a) + len(b) - 2 * common_length(bit_masks(a), len(a), b)
    assert abs(d(x, z) - d(y, z)) <= d(x, y) and (d(x, y) == 0) == (x == y)


@settings(max_examples=300, deadline=None)
@given(*[st.text(alphabet="abc", max_size=14)] * 2)
def test_a_score_takes_that_many_common_pairs(x, y):
    """The bound that seeds rest on, whatever the two texts."""
    count = lambda t: {g: sum(t[i : i + 2] == g for i in range(len(t) - 1)) for g in {t[i : i + 2] for i in range(len(t) - 1)}}
    a, b = count(x), count(y)
    assert sum(min(n, b.get(g, 0)) for g, n in a.items()) >= local_score(x, y) - 1


@pytest.mark.parametrize(("seed", "most", "letters"), [(1, 0.6, "ACDEFG"), (2, 0.3, "AC"), (3, 0.85, "ACDEFGHIKL"), (4, 0.45, "ABC")])
def test_no_local_pair_is_lost(spark, seed, most, letters):
    texts = sorted(set(family(seed, 150, letters, 24)))
    a, b = texts[::2], texts[1::2] + texts[:20]
    left, right = (spark.createDataFrame([(x,) for x in [*t, None]], "s string") for t in (a, b))
    want = {(x, y) for x in a for y in set(b) if local_score(x, y) > most * max(len(x), len(y), 1)}
    got = similar.local_pairs(left, right, "s", "s", most).collect()
    assert len(got) == len({(r.a_s, r.b_s) for r in got}) and {(r.a_s, r.b_s) for r in got} == want
    kept = {r.s for r in similar.local_screen(left, right, "s", "s", most).collect()}
    assert kept == {x for x in a if x not in {p for p, _ in want}} | {None}
