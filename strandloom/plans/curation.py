"""Queries on canonical records: normal forms, validity, screens, deduplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.functions import biophysics, sequence
from strandloom.operators import curate
from strandloom.plans.registry import GOOD, HIT, MOMENTS, SEQ, SYNTHESIS, VALID, derived, query
from strandloom.storage import table

_MODS = "CASE pos % 13 WHEN 0 THEN 'amidat' WHEN 1 THEN 'peg;amidation (AMD)' ELSE '' END"
_LOWER = r"regexp_matches(raw, '\p{Ll}')"
_SOUND = f"({VALID} AND {_MODS} = '' AND NOT {_LOWER})"
_WRONG = f"array_to_string(list_sort(list_distinct(string_split(translate(s, '{sequence.RESIDUES}', ''), ''))), '')"


def _ordered(spark, sf_dir):
    """Records with the order of their source and their own."""
    return derived(spark, sf_dir).withColumns({"source_ord": F.pmod("doc_id", F.lit(3)), "record_ord": F.col("rec_id")})


@query(f"""WITH {SEQ}, c AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id % 3, rec_id) AS r FROM seq WHERE s <> '')
    SELECT source, count(*) AS n_sequences, count(*) FILTER ({_SOUND}) AS n_valid, count(*) FILTER ({HIT}) AS n_overlap, min(length(s)) AS shortest, max(length(s)) AS longest
    FROM c WHERE r = 1 GROUP BY source""")
def curation_summary(spark, sf_dir):
    """Flagship: records to canonical sequences, the first record of each winning; reference flags; summary by source."""
    canon = curate.canonicalize(_ordered(spark, sf_dir).drop("s"), "raw", "meta")
    ref = derived(spark, sf_dir).filter("doc_id % 5 = 0").select(F.col("s").alias("sequence_normalized"))
    flagged = curate.flag_reference(canon, ref, "sequence_normalized")
    return flagged.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_sequences"), F.count_if("valid_for_challenge").alias("n_valid"), F.count_if("challenge_exact_overlap").alias("n_overlap"),
        F.min("length").cast("long").alias("shortest"), F.max("length").cast("long").alias("longest"),
    )


@query(r"""WITH n AS (SELECT p_partkey, upper(regexp_replace(p_name, '\s+', '', 'g')) AS normalized FROM part)
    SELECT *, 'seq_' || substring(sha256(normalized), 1, 16) AS sequence_id FROM n""")
def norm_and_id(spark, sf_dir):
    n = sequence.norm(F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", n.alias("normalized"), sequence.sequence_id(n).alias("sequence_id"))


@query(f"""WITH {SEQ}
    SELECT rec_id, s AS sequence_normalized, length(s) AS length, {_WRONG} = '' AS alphabet_valid, {_LOWER} AS has_lowercase_residues,
           CASE WHEN {_LOWER} THEN 'suspected_d_or_mixed' ELSE 'l_or_unspecified' END AS stereochemistry_status, {_WRONG} AS invalid_residues,
           length(s) BETWEEN 8 AND 50 AS length_valid, CASE WHEN {_MODS} <> '' THEN 'modified' WHEN trim(meta) = '' THEN 'unknown' ELSE 'none_known' END AS modification_status,
           {_MODS} AS modification_reason, {_SOUND} AS valid_for_challenge
    FROM seq""")
def validity_flags(spark, sf_dir):
    v = derived(spark, sf_dir).select("rec_id", sequence.validity(F.col("raw"), F.col("meta")).alias("v")).select("rec_id", "v.*")
    return v.withColumn("length", F.col("length").cast("long"))


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(regexp_extract_all(upper(replace(p_name, ' ', '')), '[^{sequence.RESIDUES}]'))), '') AS invalid_residues FROM part""")
def invalid_residues(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", sequence.invalid_residues(sequence.norm(F.col("p_name"))).alias("invalid_residues"))


_GIVEN = "CASE p_partkey % 6 WHEN 0 THEN NULL WHEN 1 THEN ' ' WHEN 2 THEN 'NaN' WHEN 3 THEN ' none ' ELSE p_type || '#' || p_brand END"


@query(f"""WITH g AS (SELECT *, {_GIVEN} AS g FROM part), t AS (SELECT *, trim(regexp_replace(coalesce(g, ''), '[^A-Za-z0-9_-]', '_', 'g'), '_') AS t FROM g)
    SELECT p_partkey, CASE WHEN t = '' OR contains(lower(t), 'nan') THEN 'x' ELSE t END AS token,
           CASE WHEN g IS NULL OR lower(trim(g)) IN ('', 'nan', 'none') THEN 'seqsha_' || substring(sha256(p_name), 1, 12) ELSE g END AS given,
           CASE WHEN g IS NULL OR lower(trim(g)) IN ('', 'nan', 'none') THEN 'candsha_' || substring(sha256(p_name), 1, 12) ELSE g END AS candidate
    FROM t""")
def identifiers(spark, sf_dir):
    """Given identifiers, some null, blank or empty words, as tokens and with fallbacks."""
    k = F.col("p_partkey") % 6
    given = F.when(k == 0, F.lit(None)).when(k == 1, " ").when(k == 2, "NaN").when(k == 3, " none ").otherwise(F.concat_ws("#", "p_type", "p_brand"))
    t = table(spark, sf_dir, "part").withColumn("g", given.cast("string"))
    fall = lambda prefix: sequence.fallback_id(F.col("g"), F.col("p_name"), prefix)
    return t.select("p_partkey", sequence.clean_id(F.col("g"), F.lit("x")).alias("token"), fall("seqsha_").alias("given"), fall("candsha_").alias("candidate"))


@query(f"""WITH {SEQ}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id % 3, rec_id) AS r FROM seq)
    SELECT s, rec_id, lang, source FROM r WHERE r = 1""")
def first_wins_canonical(spark, sf_dir):
    return curate.first_wins(_ordered(spark, sf_dir), ["s"], ["source_ord", "record_ord"]).select("s", "rec_id", "lang", "source")


@query(f"""WITH {SEQ}
    SELECT rec_id, CASE WHEN s = '' THEN 'empty' WHEN length(s) NOT BETWEEN 8 AND 50 THEN 'length' WHEN NOT {GOOD} THEN 'alphabet' ELSE 'ok' END AS reason,
           CASE WHEN s = '' THEN 'empty' WHEN length(s) < 8 THEN 'too_short_' || length(s) WHEN length(s) > 50 THEN 'too_long_' || length(s)
                WHEN NOT {GOOD} THEN 'invalid_residues_' || {_WRONG} ELSE 'ok' END AS detail,
           concat_ws(';', CASE WHEN NOT {GOOD} THEN 'noncanonical residues' END, CASE WHEN length(s) < 8 THEN 'below minimum length' END,
                     CASE WHEN length(s) > 50 THEN 'above maximum length' END, CASE WHEN {HIT} THEN 'exact reference match' END) AS errors
    FROM seq""")
def rule_reasons(spark, sf_dir):
    """Three rule sets: the first reason, the first with its detail, and all errors."""
    seq, s = derived(spark, sf_dir), F.col("s")
    flagged = curate.flag_reference(seq, seq.filter("doc_id % 5 = 0"), "s", "hit")
    errors = F.array_join(sequence.rule_errors(s, F.col("hit")), ";")
    return flagged.select("rec_id", sequence.first_reason(s).alias("reason"), sequence.detailed_reason(s).alias("detail"), errors.alias("errors"))


@query(f"""WITH {SEQ}, r AS (
        SELECT CASE WHEN NOT {VALID} THEN 'invalid' WHEN doc_id % 7 = 0 THEN 'perplexity' WHEN {HIT} THEN 'reference_overlap' ELSE 'accepted' END AS reason FROM seq)
    SELECT reason, count(*) AS n FROM r GROUP BY reason""")
def reject_reasons(spark, sf_dir):
    seq = derived(spark, sf_dir)
    flagged = curate.flag_reference(seq, seq.filter("doc_id % 5 = 0"), "s", "hit")
    rules = [("invalid", sequence.first_reason(F.col("s")) != "ok"), ("perplexity", F.col("doc_id") % 7 == 0), ("reference_overlap", F.col("hit"))]
    return curate.reject_reasons(flagged, rules).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_ORGANISMS = ("E. coli ATCC 25922", "escherichia coli K-12", "S. aureus", "Pseudomonas aeruginosa, PAO1", "")


@query(r"""WITH o AS (SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN 'E. coli ATCC 25922' WHEN 1 THEN 'escherichia coli K-12' WHEN 2 THEN 'S. aureus'
            WHEN 3 THEN 'Pseudomonas aeruginosa, PAO1' WHEN 4 THEN '' ELSE p_name || ' ' || p_brand END AS o FROM part),
        m AS (SELECT *, trim(o) AS n, string_split_regex(trim(o), '\s+') AS w FROM o)
    SELECT p_partkey, n AS raw_target_organism,
           CASE p_partkey % 7 WHEN 0 THEN 'Escherichia coli' WHEN 1 THEN 'Escherichia coli' WHEN 2 THEN 'Staphylococcus aureus' WHEN 3 THEN 'Pseudomonas aeruginosa'
               WHEN 4 THEN 'unknown' ELSE array_to_string(w[1:2], ' ') END AS canonical_species,
           CASE p_partkey % 7 WHEN 0 THEN 'ATCC 25922' WHEN 1 THEN 'K-12' WHEN 2 THEN 'unknown' WHEN 3 THEN 'PAO1' WHEN 4 THEN 'unknown'
               ELSE coalesce(nullif(array_to_string(w[3:], ' '), ''), 'unknown') END AS strain,
           CASE WHEN p_partkey % 7 = 4 THEN 'review_required' ELSE 'mapped' END AS mapping_status
    FROM m""")
def organism_map(spark, sf_dir):
    k, raw = F.col("p_partkey") % 7, F.concat_ws(" ", "p_name", "p_brand")
    for i, name in enumerate(_ORGANISMS):
        raw = F.when(k == i, name).otherwise(raw)
    return table(spark, sf_dir, "part").select("p_partkey", sequence.organism(raw).alias("o")).select("p_partkey", "o.*")


@query("""SELECT event_id, CASE WHEN event_id % 5 = 0 THEN 'tested_inactive' WHEN event_id % 5 = 1 THEN 'unknown' WHEN event_id % 5 = 2 THEN 'tested_inactive'
        ELSE 'reported' END AS label FROM events""")
def evidence_label(spark, sf_dir):
    k = F.col("event_id") % 5
    raw = F.when(k == 0, "Not active at 100").when(k == 2, "INACTIVE").otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", sequence.evidence_label(raw, F.when(k == 1, "NA").otherwise(F.col("event_type"))).alias("label"))


@query(f"WITH {SEQ}, {MOMENTS} SELECT rec_id, {SYNTHESIS} AS reason FROM seq LEFT JOIN moments USING (s)")
def synthesis_reason(spark, sf_dir):
    return derived(spark, sf_dir).select("rec_id", biophysics.synthesis_reason(F.col("s")).alias("reason"))


@query(f"""WITH {SEQ}, {MOMENTS}, r AS (SELECT {SYNTHESIS} AS reason FROM seq LEFT JOIN moments USING (s)) SELECT reason,
        reason IN ('ok', 'warn_unpaired_cys') AS synthesizable, count(*) AS n FROM r GROUP BY ALL""")
def synthesis_batch(spark, sf_dir):
    """A batch filter: how many records each reason holds, and whether it lets them pass."""
    r = derived(spark, sf_dir).select(biophysics.synthesis_reason(F.col("s")).alias("reason"))
    return r.groupBy("reason", biophysics.synthesizable(F.col("reason")).alias("synthesizable")).agg(F.count(F.lit(1)).alias("n"))


_REPEAT3 = "|".join(f"{r}{{3}}" for r in sequence.RESIDUES)


@query(f"""WITH {SEQ}
    SELECT rec_id, CASE WHEN contains(s, 'C') THEN 'contains_cysteine' WHEN regexp_matches(s, '{_REPEAT3}') THEN 'homopolymer_triplet'
        WHEN length(s) >= 5 AND list_bool_or(list_transform(range(1, length(s) - 3), lambda i: length(translate(substring(s, i, 5), 'KRH', '')) <= 2)) THEN 'positive_cluster_5win'
        ELSE 'ok' END AS reason FROM seq WHERE {GOOD}""")
def feasibility_screen(spark, sf_dir):
    rows = derived(spark, sf_dir).filter(sequence.canonical(F.col("s")))
    return rows.select("rec_id", sequence.feasibility_reason(F.col("s")).alias("reason"))


@query(f"""WITH {SEQ} SELECT rec_id, array_to_string(list_transform(string_split(s, ''), lambda c: (strpos('{sequence.RESIDUES}', c) + 2)::VARCHAR), ' ') AS body,
        length(s) AS n FROM seq WHERE {VALID}""")
def token_ids(spark, sf_dir):
    """Model tokens of valid sequences: what stands between the start and the first end mark, and how many."""
    rows = derived(spark, sf_dir).filter(sequence.first_reason(F.col("s")) == "ok").select("rec_id", sequence.tokens(F.col("s")).alias("t"))
    end = F.array_position("t", 2)
    return rows.select("rec_id", F.array_join(F.slice("t", 2, (end - 2).cast("int")), " ").alias("body"), (end - 2).alias("n"))


@query("""WITH h AS (SELECT p_partkey, p_partkey + 1 AS rank, CASE p_partkey % 5 WHEN 0 THEN 'rank_001_ar_' || p_partkey WHEN 1 THEN 'rank_' || printf('%03d',
        p_partkey + 1) || '_vae_' || p_partkey
            WHEN 2 THEN 'rank_' || printf('%03d', p_partkey + 1) || '_other_x' WHEN 3 THEN 'rank_' || printf('%03d', p_partkey + 1) || '_ar_a b' ELSE 'x' END AS h FROM part)
    SELECT p_partkey, p_partkey % 5 = 1 AND p_partkey < 999 OR h = 'rank_001_ar_0' AS good, replace('a\\b/' || p_partkey, '\\', '/') AS path FROM h""")
def header_checks(spark, sf_dir):
    """Ranked headers, some of another rank, domain or character, and paths with back slashes."""
    k = F.col("p_partkey")
    rank = F.format_string("rank_%03d", k + 1)
    header = (
        F.when(k % 5 == 0, F.concat(F.lit("rank_001_ar_"), k)).when(k % 5 == 1, F.concat(rank, F.lit("_vae_"), k)).when(k % 5 == 2, F.concat(rank, F.lit("_other_x")))
        .when(k % 5 == 3, F.concat(rank, F.lit("_ar_a b"))).otherwise("x")
    )
    good = sequence.ranked_header(header, k + 1, ["ar", "vae"])
    return table(spark, sf_dir, "part").select("p_partkey", good.alias("good"), sequence.forward_slashes(F.concat(F.lit("a\\b/"), k)).alias("path"))


@query("SELECT doc_id, to_json({'doc_id': doc_id, 'lang': lang, 'source': source})::VARCHAR AS raw FROM documents")
def row_json(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.to_json(F.struct("doc_id", "lang", "source")).alias("raw"))


@query(f"""WITH {SEQ}, r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY doc_id % 3, rec_id) AS r FROM seq WHERE s <> '')
    SELECT rec_id, s FROM r WHERE r = 1 AND {_SOUND} AND NOT {HIT}""")
def generation_corpus(spark, sf_dir):
    """Canonical records that are valid and not in the reference."""
    canon = curate.canonicalize(_ordered(spark, sf_dir).drop("s"), "raw", "meta")
    ref = derived(spark, sf_dir).filter("doc_id % 5 = 0").select(F.col("s").alias("sequence_normalized"))
    return curate.eligible(curate.flag_reference(canon, ref, "sequence_normalized")).select("rec_id", F.col("sequence_normalized").alias("s"))


@query(f"""WITH {SEQ} SELECT 'seq_' || substring(sha256(s), 1, 16) AS sequence_id, s AS sequence_normalized, raw AS original_sequence, source, rec_id FROM seq""")
def provenance_rows(spark, sf_dir):
    """A row for each appearance of a sequence, none collapsed."""
    return curate.provenance(derived(spark, sf_dir).drop("s"), "raw", ["source", "rec_id"])


@query(r"""WITH t AS (SELECT p_partkey, p_name, p_brand AS a, p_type AS b FROM part) SELECT p_partkey AS id, p_name AS name, a AS group_a, b AS group_b, 'given' AS model FROM t""")
def candidate_records(spark, sf_dir):
    """Columns found under other names, those that must be there, and constants for those that are not."""
    from strandloom.sources import text

    t = text.resolve_aliases(table(spark, sf_dir, "part"), {"id": ["part_id", "p_partkey"], "name": ["p_name", "p_type"], "group_a": ["p_brand"], "group_b": ["p_type"]})
    t = text.require_columns(curate.candidate_record(t, model="given", name="none"), "id", "name", "group_a", "group_b", "model")
    return t.select("id", "name", "group_a", "group_b", "model")
