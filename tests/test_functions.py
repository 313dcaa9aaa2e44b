"""Pinned values of the scalar expressions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from strandloom.functions import assay, biophysics, sequence, similarity
from strandloom.operators import select

RESIDUES = sequence.RESIDUES


def one(spark, value, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(value.alias("x")).first()["x"] if columns else spark.range(1).select(value.alias("x")).first()["x"]


def test_norm_and_ids(spark):
    assert one(spark, sequence.norm(F.lit(" ak k\n"))) == "AKK"
    assert one(spark, sequence.norm(F.lit(None).cast("string"))) == ""
    assert one(spark, sequence.sequence_id(F.lit("AKK"))).startswith("seq_")
    assert one(spark, sequence.fallback_id(F.lit("NaN"), F.lit("AKK"))).startswith("seqsha_")
    assert one(spark, sequence.clean_id(F.lit("a b/c_"), F.lit("x"))) == "a_b_c"
    assert one(spark, sequence.clean_id(F.lit("banana"), F.lit("x"))) == "x"


@pytest.mark.parametrize(("raw", "alphabet", "length"), [("AKBX", False, False), ("ACDEFGHI", True, True), ("ACD", True, False)])
def test_validity(spark, raw, alphabet, length):
    v = one(spark, sequence.validity(F.lit(raw)))
    assert (v["alphabet_valid"], v["length_valid"]) == (alphabet, length)
    assert v["valid_for_challenge"] == (alphabet and length)


def test_validity_of_modified_and_lower(spark):
    v = one(spark, sequence.validity(F.lit("acdefghi"), F.lit("C-terminal AMD, acetylated")))
    assert v["modification_reason"] == "acetyl;amidation (AMD)" and v["has_lowercase_residues"] and not v["valid_for_challenge"]
    assert one(spark, sequence.validity(F.lit("AXBZ")))["invalid_residues"] == "BXZ"


@pytest.mark.parametrize(("s", "reason"), [("AKRKLVWQ", "ok"), ("AAAAAAXX", "invalid_residue"), ("AKRKKLLLLL", "hydrophobic_run"), ("ACDEFGHI", "insufficient_charge"), ("AKRCLVWQ", "warn_unpaired_cys"), ("AKR", "length_out_of_range"), ("AKKKKRVWQ", "polyrepeat"), ("", "invalid_residue")])
def test_synthesis(spark, s, reason):
    assert one(spark, biophysics.synthesis_reason(F.lit(s))) == reason


@pytest.mark.parametrize(("s", "reason"), [("ACDEFGHI", "contains_cysteine"), ("AAADEFGI", "homopolymer_triplet"), ("KAKAKDEF", "positive_cluster_5win"), ("KADEFGKI", "ok"), ("KA", "ok")])
def test_feasibility(spark, s, reason):
    assert one(spark, sequence.feasibility_reason(F.lit(s))) == reason


def test_descriptors(spark):
    assert one(spark, biophysics.boman_index(F.lit("GLFDIVKKVVGALGSL"))) == pytest.approx(-1.01)
    assert one(spark, biophysics.net_charge(F.lit("AKRKLVW"))) > 1
    assert one(spark, biophysics.hydrophobic_moment(F.lit("AKRKLVW"))) > 0
    assert one(spark, biophysics.net_charge(F.lit("KWKLFKKIGKVLKVL"))) > 4
    assert one(spark, biophysics.hydrophobic_moment(F.lit("KWKLFKKIGKVLKVL"))) > 0.5
    assert abs(one(spark, biophysics.net_charge(F.lit("GAGAGAGAGAGAGAGA")))) < 0.5
    for f in (biophysics.net_charge, biophysics.isoelectric_point, biophysics.gravy, biophysics.molecular_weight, biophysics.hydrophobic_moment):
        assert one(spark, f(F.lit("AX"))) is None and one(spark, f(F.lit(""))) is None


def moment(s, window=11):
    parts = [s] if len(s) <= window else [s[i : i + window] for i in range(len(s) - window + 1)]
    side = lambda x, f: sum(biophysics.CONSENSUS[a] * f(math.radians(100 * i)) for i, a in enumerate(x))
    return max(math.hypot(side(x, math.cos), side(x, math.sin)) / len(x) for x in parts)


def test_moment_and_instability_against_loops(spark):
    rng = random.Random(4)
    rows = [("".join(rng.choice(RESIDUES) for _ in range(rng.randint(1, 50))),) for _ in range(40)]
    weights = {a + b: round(rng.uniform(-10, 60), 2) for a in RESIDUES for b in RESIDUES if rng.random() < 0.5}
    df = spark.createDataFrame(rows, "s string").select("s", biophysics.hydrophobic_moment(F.col("s")).alias("m"), biophysics.instability_index(F.col("s"), weights).alias("i"))
    for r in df.collect():
        assert r["m"] == pytest.approx(moment(r["s"]), abs=1e-6)
        assert r["i"] == pytest.approx(10 * sum(weights.get(a + b, 1.0) for a, b in zip(r["s"], r["s"][1:])) / len(r["s"]), abs=1e-6)


def test_feature_vector(spark):
    v = one(spark, biophysics.feature_vector(F.lit("AKRKLVWQ")))
    assert len(v) == 27 and v[20] == 8 and v[26] == 30
    assert one(spark, biophysics.feature_vector(F.lit("AK")))[22] == 7


@pytest.mark.parametrize(("n", "at"), [(14, 0), (15, 1), (22, 1), (23, 2), (30, 2), (31, 3), (40, 3), (41, 4), (50, 4)])
def test_length_bins(spark, n, at):
    assert one(spark, biophysics.niche(F.lit(0.0), F.lit(0.3), F.lit(n)))["l"] == at


def test_quality_fails_closed(spark):
    good = biophysics.bounded_quality(F.lit(0.9), F.lit(0.2), F.lit(0.1), F.lit(16.0), F.lit(2), F.lit(True))
    assert one(spark, good) == pytest.approx(0.9 - 0.1 - 0.1 + 0.1 + 0.05)
    with pytest.raises(Exception, match="quality inputs"):
        one(spark, biophysics.bounded_quality(F.lit(1.2), F.lit(0.2), F.lit(0.1), F.lit(None).cast("double"), F.lit(1), F.lit(True)))


@pytest.mark.parametrize(("text", "numeric", "lower", "upper", "kind"), [("1.5e-2", 0.015, 0.015, 0.015, "="), ("<8", None, None, 8.0, "<"), (">8", 8.0, 8.0, None, ">"), ("16-8", None, 8.0, 16.0, "range"), ("16 - 8", None, 8.0, 16.0, "range"), ("NA", None, None, None, ""), ("", None, None, None, "")])
def test_mic(spark, text, numeric, lower, upper, kind):
    m = one(spark, assay.parse_mic(F.lit(text), F.lit("µM"), F.lit(2000.0)))
    assert (m["mic_value_numeric"], m["mic_lower_bound"], m["mic_upper_bound"], m["mic_qualifier"]) == (numeric, lower, upper, kind)


LABELS = [("99", 1), ("100", 0), ("99±2", None), ("<100", 1), ("<120", None), ("<=99", 1), ("<=100", None), (">100", 0), (">99", None), (">=100", 0), ("NA", None)]


@pytest.mark.parametrize(("text", "label"), LABELS)
def test_hemolysis(spark, text, label):
    assert one(spark, assay.hemolysis_label(F.lit("50% Hemolysis"), F.lit("Human erythrocytes"), F.lit(text), F.lit("uM"), F.lit(2000.0))) == label


def test_hemolysis_units_and_cells(spark):
    call = lambda assay_="50% hemolysis", cell="human erythrocytes", unit="µg/ml", w=2000.0: one(spark, assay.hemolysis_label(F.lit(assay_), F.lit(cell), F.lit("50"), F.lit(unit), F.lit(w)))
    assert call() == 1 and call(unit="") is None and call(assay_="25% hemolysis") is None and call(cell="rabbit erythrocytes") is None and call(w=0.0) is None


def test_organism(spark):
    o = one(spark, sequence.organism(F.lit("  E. coli ATCC 25922, ")))
    assert (o["canonical_species"], o["strain"], o["mapping_status"]) == ("Escherichia coli", "ATCC 25922", "mapped")
    assert one(spark, sequence.organism(F.lit("Bacillus subtilis 168")))["strain"] == "168"
    assert one(spark, sequence.organism(F.lit(None).cast("string")))["mapping_status"] == "review_required"


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_indel_against_dynamic_programming(spark):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("ACDEKW") for _ in range(n))
    rows = [("ACDE", "ACDF"), ("", ""), ("A", ""), *[(word(rng.randint(1, 62)), word(rng.randint(1, 80))) for _ in range(150)]]
    df = spark.createDataFrame(rows, "a string, b string").select("a", "b", similarity.indel_ratio(F.col("a"), F.col("b")).alias("x"), similarity.long_indel_ratio(F.col("a"), F.col("b")).alias("y"))
    for r in df.collect():
        want = 2 * lcs(r["a"], r["b"]) / (len(r["a"]) + len(r["b"])) if r["a"] or r["b"] else 1.0
        assert r["x"] == pytest.approx(want) and r["y"] == pytest.approx(want) and select.indel(r["a"], r["b"]) == pytest.approx(want)


def smith_waterman(a, b):
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(max(0, row[j] + (1 if x == y else -1), row[j + 1] - 1, new[j] - 1))
        row = new
        best = max(best, *row)
    return best


def test_local_alignment(spark):
    rng = random.Random(9)
    for _ in range(200):
        a, b = ("".join(rng.choice("ACK") for _ in range(rng.randint(0, 15))) for _ in "ab")
        assert similarity.local_score(a, b) == smith_waterman(a, b)


def test_tokens_headers_reasons(spark):
    assert one(spark, sequence.tokens(F.lit("AY"), 6)) == [1, 3, 22, 2, 0, 0]
    assert one(spark, sequence.ranked_header(F.lit("rank_007_ar_x1"), F.lit(7), ["ar", "vae"])) is True
    assert one(spark, sequence.ranked_header(F.lit("rank_008_ar_x1"), F.lit(7), ["ar"])) is False
    assert one(spark, sequence.rule_errors(F.lit("ACDEFGH"))) == ["below minimum length"]
    assert one(spark, sequence.rule_errors(F.lit("A" * 51), F.lit(True))) == ["above maximum length", "exact reference match"]
    assert one(spark, sequence.detailed_reason(F.lit("ACDEFGH"))) == "too_short_7"


def test_sums_over_residues_run_in_batches(spark):
    """No expression steps from residue to residue, long sequences are linear, and other characters count in shares only."""
    rows = [("AKRKLVW" * 30_000,), ("",), (None,), ("AKX",), ("ÄAK",), ("W",)]
    df = spark.createDataFrame(rows, "s string")
    s = F.col("s")
    weights = {"AK": 3.0}
    out = df.select(biophysics.feature_vector(s, weights).alias("x"), biophysics.descriptors(s, weights).alias("d"), sequence.residue_fractions(s).alias("r"))
    assert "lambda" not in out._jdf.queryExecution().executedPlan().toString()
    long, empty, null, wrong, wide, one_ = out.collect()
    assert long["d"]["instability_index"] == pytest.approx(10 * (30_000 * 3 + 6 * 30_000 - 1) / 210_000, abs=1e-6)
    assert long["d"]["eisenberg_hydrophobic_moment"] > 0.3 and long["r"][0] == pytest.approx(1 / 7)
    assert empty["r"] == [0.0] * 20 and null["r"] == [None] * 20
    assert all(r["d"][c] is None for r in (empty, null, wrong, wide) for c in ("net_charge_ph7", "isoelectric_point", "eisenberg_hydrophobic_moment", "instability_index"))
    assert wide["r"][0] == pytest.approx(1 / 3) and one_["d"]["instability_index"] == 0.0
