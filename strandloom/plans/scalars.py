"""Queries on values of a row: descriptors, assays, scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import assay, biophysics, sequence
from strandloom.operators import search
from strandloom.plans.registry import (
    BOMAN, CHARGE, GOOD, GRAVY, INSTABILITY, MASS, MOMENTS, PAIR_WEIGHTS, POINTS, SEQ, SYNTHESIS, VALID, canonical_records, count, derived, query, rounded,
)
from strandloom.storage import table


@query(f"""WITH {SEQ}
    SELECT rec_id, {count('KRH')} AS cationic_count, {count('DE')} AS anionic_count, round({count('VILMFW')} / nullif(length(s), 0)::DOUBLE, 4) AS hydrophobic_fraction,
           round({count('FWY')} / nullif(length(s), 0)::DOUBLE, 4) AS aromatic_fraction FROM seq""")
def composition_fractions(spark, sf_dir):
    c = derived(spark, sf_dir).withColumn("c", sequence.composition(F.col("s")))
    return c.select("rec_id", F.col("c.cationic_count").cast("long").alias("cationic_count"), F.col("c.anionic_count").cast("long").alias("anionic_count"), "c.hydrophobic_fraction", "c.aromatic_fraction")


@query(f"""WITH {SEQ} SELECT rec_id, CASE WHEN {GOOD} THEN {MASS} END AS molecular_weight_da, CASE WHEN {GOOD} THEN {CHARGE} END AS net_charge_ph7, CASE
        WHEN {GOOD} THEN round({GRAVY} * length(s), 1) END AS hydropathy_sum FROM seq""")
def linear_descriptors(spark, sf_dir):
    """Weight, charge, and mean hydropathy times length, which has one digit and so no ties in rounding."""
    s = F.col("s")
    return derived(spark, sf_dir).select(
        "rec_id", biophysics.molecular_weight(s).alias("molecular_weight_da"), biophysics.net_charge(s).alias("net_charge_ph7"), F.round(biophysics.gravy(s) * F.length(s), 1).alias("hydropathy_sum")
    )


@query(f"WITH {SEQ} SELECT rec_id, CASE WHEN {GOOD} THEN {BOMAN} END AS boman FROM seq")
def boman(spark, sf_dir):
    return derived(spark, sf_dir).select("rec_id", biophysics.boman_index(F.col("s")).alias("boman"))


@query(f"WITH {SEQ}, {MOMENTS} SELECT rec_id, moment FROM seq LEFT JOIN moments USING (s)")
def hydrophobic_moment(spark, sf_dir):
    return derived(spark, sf_dir).select("rec_id", biophysics.hydrophobic_moment(F.col("s")).alias("moment"))


@query(f"WITH RECURSIVE {SEQ}, {POINTS} SELECT rec_id, point AS isoelectric_point FROM seq LEFT JOIN points USING (s)")
def isoelectric_point(spark, sf_dir):
    return derived(spark, sf_dir).select("rec_id", biophysics.isoelectric_point(F.col("s")).alias("isoelectric_point"))


@query(f"WITH {SEQ} SELECT rec_id, CASE WHEN {GOOD} THEN {INSTABILITY} END AS instability FROM seq")
def instability(spark, sf_dir):
    """With a pair table that a rule makes: the operator takes the table as a parameter."""
    return derived(spark, sf_dir).select("rec_id", biophysics.instability_index(F.col("s"), PAIR_WEIGHTS).alias("instability"))


@query(f"""WITH RECURSIVE {SEQ}, {MOMENTS}, {POINTS}
    SELECT rec_id, {CHARGE} AS net_charge_ph7, point AS isoelectric_point, {MASS} AS molecular_weight_da, moment, {BOMAN} AS boman_index,
           {GRAVY} AS gravy, {INSTABILITY} AS instability_index
    FROM seq JOIN moments USING (s) JOIN points USING (s) WHERE {VALID}""")
def descriptor_table(spark, sf_dir):
    """All seven descriptors of valid records."""
    rows = derived(spark, sf_dir).filter(sequence.first_reason(F.col("s")) == "ok").select("rec_id", biophysics.descriptors(F.col("s"), PAIR_WEIGHTS).alias("d")).select("rec_id", "d.*")
    return rows.withColumnsRenamed({"eisenberg_hydrophobic_moment": "moment", "grand_avg_hydropathy": "gravy"})


@query(f"""WITH RECURSIVE {SEQ}, {MOMENTS}, {POINTS}
    SELECT rec_id, 27 AS size, ({count('Y')} / length(s)::DOUBLE)::FLOAT::DOUBLE AS last_fraction, length(s)::DOUBLE AS length,
           CASE WHEN length(s) < 8 THEN 0 ELSE {CHARGE} END::FLOAT::DOUBLE AS charge, CASE WHEN length(s) < 8 THEN 7 ELSE point END::FLOAT::DOUBLE AS point,
           CASE WHEN length(s) < 8 THEN 0 ELSE {BOMAN} END::FLOAT::DOUBLE AS boman, CASE WHEN length(s) < 8 THEN 30 ELSE {INSTABILITY} END::FLOAT::DOUBLE AS instability
    FROM seq JOIN moments USING (s) JOIN points USING (s)""")
def feature_vectors(spark, sf_dir):
    """Features of canonical records, as the floats they are; a short record takes defaults."""
    rows = canonical_records(spark, sf_dir).select("rec_id", biophysics.feature_vector(F.col("s"), PAIR_WEIGHTS).alias("x"))
    names = {19: "last_fraction", 20: "length", 21: "charge", 22: "point", 25: "boman", 26: "instability"}
    return rows.select("rec_id", F.size("x").alias("size"), *[F.col("x")[i].cast("double").alias(n) for i, n in names.items()])


@query(f"""WITH {SEQ}, {MOMENTS}, f AS (SELECT rec_id, s, length(s) AS n, {CHARGE} AS charge, moment, {BOMAN} AS b FROM seq JOIN moments USING (s))
    SELECT rec_id, CASE WHEN {count('RW')} / n::DOUBLE >= 0.4 THEN 0 WHEN {count('P')} / n::DOUBLE >= 0.15 THEN 1 WHEN moment >= 0.65 THEN 2 WHEN n <= 12 AND charge >= 3 THEN 3
            WHEN moment >= 0.4 THEN 4 WHEN b >= 2.5 THEN 5 WHEN n >= 30 THEN 6 WHEN charge >= 5 THEN 7 WHEN {count('C')} >= 2 THEN 8 ELSE 9 END AS family_id,
        CASE WHEN n <= 25 AND moment >= 0.4 THEN 'all' WHEN n <= 25 THEN 'vae' WHEN charge >= 5 THEN 'ar' WHEN moment >= 0.45 THEN 'diffusion'
            ELSE 'evolution' END AS track FROM f""")
def archetypes(spark, sf_dir):
    s = F.col("s")
    rows = canonical_records(spark, sf_dir).select("rec_id", "s", biophysics.net_charge(s).alias("q"), biophysics.hydrophobic_moment(s).alias("m"), biophysics.boman_index(s).alias("b"))
    family = sequence.archetype(s, F.col("q"), F.col("m"), F.col("b"))["family_id"]
    return rows.select("rec_id", family.alias("family_id"), sequence.generator_track(F.length(s), F.col("m"), F.col("q")).alias("track"))


_MIC_CASE = "CASE event_id % 7 WHEN 0 THEN '<' WHEN 1 THEN '>' WHEN 2 THEN 'range' WHEN 3 THEN '=' WHEN 5 THEN '<' WHEN 6 THEN '=' ELSE '' END"
_MIC_TEXT = {0: "<{n}", 1: "> {n} (ref 3)", 2: "{m} - {n}", 3: "{n}", 4: "NA", 5: "<", 6: "MIC {n}e1"}
_MIC_UNITS = {0: "µM", 1: "ug/ml", 2: "mg / ml", 3: "", 4: "MG/L."}
#: A sequence for each event: its weight converts.
_MIC_SEQUENCE = {0: "ACDEFGHIKL", 1: "KWKLFKKI", 2: "not one"}


@query(f"""WITH e AS (SELECT event_id, (round(abs(value) * 10)::BIGINT) AS n, {_MIC_CASE} AS q,
            CASE event_id % 5 WHEN 0 THEN 'um' WHEN 1 THEN 'ug/ml' WHEN 2 THEN 'mg/ml' WHEN 3 THEN '' ELSE 'mg/l.' END AS u,
            CASE event_id % 3 WHEN 0 THEN 'ACDEFGHIKL' WHEN 1 THEN 'KWKLFKKI' ELSE 'NOTONE' END AS s FROM events),
        w AS (SELECT *, CASE WHEN event_id % 3 < 2 THEN {MASS} END AS mw FROM e),
        f AS (SELECT *, CASE u WHEN 'um' THEN 1.0::DOUBLE WHEN 'ug/ml' THEN 1000.0::DOUBLE / mw WHEN 'mg/l.' THEN 1000.0::DOUBLE / mw
            WHEN 'mg/ml' THEN 1000000.0::DOUBLE / mw END AS f FROM w),
        x AS (SELECT *, CASE event_id % 7 WHEN 1 THEN n WHEN 2 THEN n WHEN 3 THEN n WHEN 6 THEN n * 10 END::DOUBLE AS lo, CASE event_id % 7 WHEN 0 THEN n
            WHEN 2 THEN n + 7 WHEN 3 THEN n WHEN 6 THEN n * 10 END::DOUBLE AS hi FROM f)
    SELECT event_id, q AS mic_qualifier, u AS mic_unit_normalized, lo AS mic_lower_bound, hi AS mic_upper_bound, CASE WHEN q <> 'range' THEN lo END AS mic_value_numeric,
           CASE WHEN q = '=' THEN round(lo * f, 6) END AS "mic_value_uM", round(lo * f, 6) AS "mic_lower_bound_uM", round(hi * f, 6) AS "mic_upper_bound_uM",
           CASE WHEN f IS NOT NULL THEN 'converted' WHEN event_id % 7 NOT IN (4, 5) THEN 'unsupported_or_missing_unit'
               ELSE 'unparseable_value' END AS mic_conversion_status FROM x""")
def mic_parse(spark, sf_dir):
    """Concentration texts of seven shapes in five units, for two sequences and one that has no weight."""
    n, k = F.round(F.abs("value") * 10).cast("long"), F.col("event_id")
    text, unit, s = F.lit(None), F.lit(None), F.lit(None)
    for i, shape in _MIC_TEXT.items():
        parts = [F.lit(x) if x not in ("n", "m") else (n if x == "n" else n + 7).cast("string") for x in shape.replace("{", "\x00").replace("}", "\x00").split("\x00") if x]
        text = F.when(k % 7 == i, F.concat(*parts)).otherwise(text)
    for i, name in _MIC_UNITS.items():
        unit = F.when(k % 5 == i, name).otherwise(unit)
    for i, name in _MIC_SEQUENCE.items():
        s = F.when(k % 3 == i, name).otherwise(s)
    return table(spark, sf_dir, "events").select("event_id", assay.parse_mic_of(text, unit, s).alias("m")).select("event_id", "m.*")


@query("""WITH e AS (SELECT event_id, round(abs(value))::BIGINT AS n, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN '<' WHEN 2 THEN '<=' WHEN 3 THEN '>'
        WHEN 4 THEN '>=' ELSE 'pm' END AS q FROM events)
    SELECT event_id, CASE WHEN event_id % 11 = 0 THEN NULL ELSE CASE q WHEN '' THEN CASE WHEN n < 100 THEN 1 ELSE 0 END WHEN '<' THEN CASE WHEN n <= 100 THEN 1 END
        WHEN '<=' THEN CASE WHEN n < 100 THEN 1 END WHEN 'pm' THEN CASE WHEN n + 5 < 100 THEN 1 WHEN n - 5 >= 100 THEN 0 END ELSE CASE
            WHEN n >= 100 THEN 0 END END END AS label FROM e""")
def hemolysis_label(spark, sf_dir):
    n, k = F.round(F.abs("value")).cast("long").cast("string"), F.col("event_id") % 6
    text = (
        F.when(k == 0, n).when(k == 1, F.concat(F.lit("<"), n)).when(k == 2, F.concat(F.lit("<="), n)).when(k == 3, F.concat(F.lit("> "), n))
        .when(k == 4, F.concat(F.lit(">="), n)).otherwise(F.concat(n, F.lit(" ± 5")))
    )
    cell = F.when(F.col("event_id") % 11 == 0, "Human  platelets").otherwise("Human erythrocytes")
    label = assay.hemolysis_label(F.lit("50%  Hemolysis"), cell, text, F.lit("µM"), F.lit(2000.0))
    return table(spark, sf_dir, "events").select("event_id", label.alias("label"))


@query(f"""WITH {SEQ}, {MOMENTS}, f AS (SELECT rec_id, {CHARGE} AS q, moment AS m, {BOMAN} AS b, {GRAVY} AS g, {SYNTHESIS} IN ('ok', 'warn_unpaired_cys') AS fine
        FROM seq JOIN moments USING (s)),
    t AS (SELECT *, least(1, greatest(0, greatest(0, m - 0.65) + greatest(0, g - 0.2)))::DOUBLE AS tox,
        CASE WHEN q < 1 THEN greatest(0, q) * 0.2 WHEN q <= 6 THEN 0.2 + 0.16 * (q - 1) ELSE greatest(0.5, 1 - (q - 6) * 0.1) END::DOUBLE AS cs,
        CASE WHEN g > 0.3 THEN (g - 0.3) * 1.5 ELSE greatest(0, (-0.8 - g) * 0.8) END::DOUBLE AS gp FROM f),
    a AS (SELECT *, least(1, greatest(0, 0.45 * cs + 0.45 / (1 + exp(-10 * (m - 0.45))) - 0.1 / (1 + exp(-3 * (b - 2.5))) - 0.1 * gp))::DOUBLE AS amp FROM t)
    SELECT rec_id, {rounded('amp - 0.35::DOUBLE * tox - CASE WHEN fine THEN 0 ELSE 0.25 END::DOUBLE', 4)} AS composite_fitness, {rounded('amp', 4)} AS amp_score,
        {rounded('tox', 4)} AS toxicity_risk FROM a""")
def search_fitness(spark, sf_dir):
    return canonical_records(spark, sf_dir).select("rec_id", search.default_score(F.col("s")).alias("f")).select("rec_id", "f.*")


@query(f"""WITH {SEQ}, {MOMENTS}, p AS (SELECT rec_id, least(1, greatest(0, 0.5 * ({GRAVY} - 0.2) * 1.5 + 0.5 * (moment - 0.4) * 2.0))::DOUBLE AS proxy,
        rec_id % 13 / 13.0::DOUBLE AS h FROM seq JOIN moments USING (s))
    SELECT rec_id, round(proxy, 4) AS proxy, {rounded('0.5 * h + 0.5 * round(proxy, 4)', 4)} AS risk, round(0.9 - 0.5 * h - 0.25, 4) AS score FROM p""")
def risk_scores(spark, sf_dir):
    """Membrane disruption, its risk beside a made-up hemolysis score, and the library score."""
    s, h = F.col("s"), F.col("rec_id") % 13 / 13.0
    rows = canonical_records(spark, sf_dir).select("rec_id", F.round(biophysics.disruption_proxy(biophysics.gravy(s), biophysics.hydrophobic_moment(s)), 4).alias("proxy"), h.alias("h"))
    return rows.select("rec_id", "proxy", biophysics.toxicity_risk(F.col("h"), F.col("proxy")).alias("risk"), F.round(biophysics.library_score(F.lit(0.9), F.col("h"), F.lit(0.25)), 4).alias("score"))


@query("""WITH y AS (SELECT p_partkey, p_size / 10.0::DOUBLE AS a, p_partkey % 7 / 2.0::DOUBLE AS b, p_retailprice AS v FROM part)
    SELECT p_partkey, round((pow(10.0::DOUBLE, 6 - a) + pow(10.0::DOUBLE, 6 - b)) / 2, 2) AS concentration, round(exp(least(a, 20)), 4) AS perplexity, v AS checked FROM y""")
def transformed_scores(spark, sf_dir):
    """An ensemble's inverse transform, a perplexity, and a value that is checked for range."""
    a, b = F.col("p_size") / 10.0, F.col("p_partkey") % 7 / 2.0
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(assay.inverse_transform([a, b]), 2).alias("concentration"), F.round(assay.perplexity(a), 4).alias("perplexity"), biophysics.finite_in(F.col("p_retailprice"), 0, 1e9).alias("checked")
    )
