"""Queries on niches, portfolios, search, models and verification."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import assay, biophysics, sequence
from strandloom.operators import curate, graph, models, ranking, search, select, verify
from strandloom.plans.registry import CANDIDATES, GOOD, HIT, SEQ, VALID, candidates, derived, query
from strandloom.storage import materialize, table

# Selection -----------------------------------------------------------------------------------------------------------


def _bins(x: str, edges: tuple) -> str:
    return " + ".join(f"CASE WHEN {x} >= {e} THEN 1 ELSE 0 END" for e in edges)


_CELLS = f"""SELECT p_partkey, ({_bins('p_size / 4.0', biophysics.CHARGE_EDGES)})::INTEGER AS c, ({_bins('(p_partkey % 100) / 100.0', biophysics.MOMENT_EDGES)})::INTEGER AS m,
        ({_bins('(8 + p_partkey % 43)', biophysics.LENGTH_EDGES)})::INTEGER AS l, p_retailprice FROM part"""


def _cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") / 4.0).alias("charge"), (k % 100 / 100.0).alias("moment"), (8 + k % 43).alias("length"), "p_retailprice")


@query(f"SELECT p_partkey, c, m, l FROM ({_CELLS})")
def niche_bins(spark, sf_dir):
    return _cells(spark, sf_dir).select("p_partkey", biophysics.niche(F.col("charge"), F.col("moment"), F.col("length")).alias("x")).select("p_partkey", "x.*")


@query(f"SELECT c, m, l, p_partkey FROM (SELECT *, row_number() OVER (PARTITION BY c, m, l ORDER BY p_retailprice DESC, p_partkey) AS r FROM ({_CELLS})) WHERE r = 1")
def niche_elites(spark, sf_dir):
    return select.archive(_cells(spark, sf_dir), "charge", "moment", "length", "p_retailprice", "p_partkey").select("c", "m", "l", "p_partkey")


@query(f"SELECT count(DISTINCT (c, m, l)) AS filled, round(100 * count(DISTINCT (c, m, l)) / 150.0::DOUBLE, 2) AS coverage_percent FROM ({_CELLS})")
def archive_coverage(spark, sf_dir):
    return select.archive_coverage(select.archive(_cells(spark, sf_dir), "charge", "moment", "length", "p_retailprice", "p_partkey"))


@query("""SELECT p_partkey, round(p - 0.5 * t - s + CASE WHEN mic <= 32 THEN 0.2 * (1 - mic / 32) ELSE 0 END + CASE WHEN p_size % 3 > 1 THEN 0.05 ELSE 0 END - CASE
        WHEN p_partkey % 2 = 0 THEN 0 ELSE 0.2 END, 4) AS quality
    FROM (SELECT *, (p_partkey % 97) / 97.0::DOUBLE AS p, (p_size % 10) / 10.0::DOUBLE AS t, (p_partkey % 7) / 70.0::DOUBLE AS s, (p_partkey % 64)::DOUBLE AS mic FROM part)""")
def lcb_quality(spark, sf_dir):
    k, size = F.col("p_partkey"), F.col("p_size")
    quality = biophysics.bounded_quality(k % 97 / 97.0, size % 10 / 10.0, k % 7 / 70.0, (k % 64).cast("double"), size % 3, k % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", quality.alias("quality"))


@query("""WITH RECURSIVE m AS (SELECT avg(p_size) AS a, stddev_pop(p_size) AS b, avg(p_retailprice) AS c, stddev_pop(p_retailprice) AS d FROM part),
    z AS (SELECT p_partkey AS k, (p_size - a) / b AS x, (p_retailprice - c) / d AS y FROM part, m),
    s(i, k, x, y, near, c, cx, cy) AS (
        SELECT 1, k, x, y, 'inf'::DOUBLE, first_value(k) OVER o, first_value(x) OVER o, first_value(y) OVER o FROM z WINDOW o AS (ORDER BY k)
        UNION ALL
        SELECT i + 1, k, x, y, near, first_value(k) OVER o, first_value(x) OVER o, first_value(y) OVER o FROM (
            SELECT i, k, x, y, least(near, round(sqrt(pow(x - cx, 2) + pow(y - cy, 2)), 12)) AS near FROM s WHERE i < 100 AND k <> c)
        WINDOW o AS (ORDER BY near DESC, k DESC))
    SELECT DISTINCT c AS p_partkey, i::INTEGER AS rank FROM s""")
def farthest_points(spark, sf_dir):
    """A hundred parts by max-min distance."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    return select.farthest_points(p, "p_partkey", ["p_size", "p_retailprice"], 100)


@query()
def portfolio(spark, sf_dir):
    """Determinantal selection with quotas and redundancy limits."""
    return select.select_portfolio(candidates(spark, sf_dir), 100, 50).select("sequence", "primary_domain", "portfolio_rank", "is_nested")


@query()
def diverse_choice(spark, sf_dir):
    """Twenty candidates by falling quality, no two alike."""
    rows = candidates(spark, sf_dir).select("sequence", (-F.col("lcb_quality")).alias("score"))
    return select.diverse_greedy(rows, 20, "score")


@query(f"""WITH {SEQ}, {CANDIDATES} SELECT rec_id FROM candidates WHERE synthesizable AND similarity <= 0.8 ORDER BY quality DESC, s LIMIT 50""")
def score_ranked(spark, sf_dir):
    """The fifty best candidates that pass the filters."""
    passes = F.col("synthesizable") & (F.col("max_reference_similarity") <= 0.8)
    return select.best_passing(candidates(spark, sf_dir), passes, [F.desc("lcb_quality"), F.asc("sequence")], 50).select("rec_id")


@query()
def monte_carlo_draws(spark, sf_dir):
    return select.simulate_draws(candidates(spark, sf_dir), "rec_id", "lcb_quality", "pred_amp_probability", "pred_toxicity_risk", "synthesizable")


@query(f"""WITH {SEQ}, {CANDIDATES}, r AS (SELECT s, length(s) % 7 AS family, length(s) AS n, row_number() OVER (PARTITION BY length(s) % 7 ORDER BY length(s) DESC,
        s) <= 5 AS first FROM candidates)
    SELECT s AS sequence, family::INTEGER AS family, CASE WHEN first THEN 0 ELSE 1 END AS tier FROM r ORDER BY tier, n DESC, s LIMIT 50""")
def seed_panel(spark, sf_dir):
    rows = candidates(spark, sf_dir).select("sequence", (F.col("length") % 7).cast("int").alias("family"), "length")
    return select.seed_panel(rows, "family", "length", "sequence").select("sequence", "family", "tier")


@query(f"""WITH {SEQ}, a AS (SELECT s, min(rec_id) AS rec_id FROM seq WHERE doc_id % 10 = 0 GROUP BY s),
        b AS (SELECT s, arg_min(rec_id, (-(rec_id % 97), rec_id)) AS rec_id FROM seq WHERE doc_id % 10 <> 0 AND s NOT IN (SELECT s FROM a) GROUP BY s),
        u AS (SELECT s, 0 AS t, rec_id::DOUBLE AS k, 'scored' AS source_tier FROM a UNION ALL SELECT s, 1, -(rec_id % 97)::DOUBLE, 'filler' FROM b),
        o AS (SELECT s, source_tier, row_number() OVER (ORDER BY t, k, s) AS library_index FROM u)
    SELECT * FROM o WHERE library_index <= 2000""")
def library_assembly(spark, sf_dir):
    """A library of two thousand: scored sequences in input order, then the best fillers."""
    seq = derived(spark, sf_dir).select("s", "rec_id", "doc_id")
    scored = curate.first_wins(seq.filter("doc_id % 10 = 0"), ["s"], ["rec_id"])
    fillers = curate.best_of(seq.filter("doc_id % 10 <> 0").withColumn("score", F.col("rec_id") % 97), ["s"], "score", ["rec_id"])
    return select.assemble_library(scored.withColumn("score", F.lit(0)), fillers, 2000, "s", "rec_id", "score").select("s", "source_tier", "library_index")


# Search and models ---------------------------------------------------------------------------------------------------


@query()
def mutate_children(spark, sf_dir):
    return search.mutate(candidates(spark, sf_dir).select("rec_id", "sequence"), "rec_id", "sequence", 4, 42, 1).select("rec_id", "child", "mutation_type", "position", "delta")


@query(f"""WITH {SEQ}, p AS (SELECT rec_id, s, lag(s) OVER (PARTITION BY doc_id ORDER BY pos) AS parent FROM seq) SELECT rec_id FROM p WHERE s IS DISTINCT FROM parent""")
def parent_echoes(spark, sf_dir):
    """Records that are not the same as the one before."""
    from pyspark.sql import Window

    rows = derived(spark, sf_dir).withColumn("parent", F.lag("s").over(Window.partitionBy("doc_id").orderBy("pos")))
    return search.parent_echoes(rows, "s", "parent").select("rec_id")


def _seeds(spark: SparkSession, sf_dir: str, per_family: int) -> DataFrame:
    s = F.col("sequence")
    rows = candidates(spark, sf_dir).select(sequence.sequence_id(s).alias("sequence_id"), "sequence", F.col("primary_domain").alias("family"))
    return materialize(ranking.top_k_per_group(rows, ["family"], [F.asc("sequence")], per_family, "_r").drop("_r"), "seeds")


@query()
def genetic_search(spark, sf_dir):
    """A search at its production setting: nodes with generation and fitness."""
    nodes, _, _ = search.evolve(_seeds(spark, sf_dir, 12), search.Evaluator())
    return nodes.select("sequence_id", "sequence", "family", "generation", "composite_fitness")


@query()
def beam_search(spark, sf_dir):
    """The beam variant for a comparison at five hundred evaluations: its sound lineage, rule by rule (no rule is broken)."""
    nodes, edges, _ = search.evolve(_seeds(spark, sf_dir, 4), search.Evaluator(), budget=500, beam=20)
    broken = graph.ancestry_violations(nodes, edges).agg(F.count(F.lit(1)).alias("violations"))
    return nodes.groupBy("generation").agg(F.count(F.lit(1)).alias("n"), F.max("composite_fitness").alias("best")).join(F.broadcast(broken))


@query()
def forest_spread(spark, sf_dir):
    """A forest on residue fractions against a quality label: mean and deviation over trees."""
    rows = derived(spark, sf_dir).join(table(spark, sf_dir, "labels").filter("quality is not null"), "doc_id").withColumn("x", sequence.residue_fractions(F.col("s")))
    model = models.train_forest(rows, "x", "quality", balanced=True)
    return models.forest_spread(rows.select("rec_id", "x"), model, "x").drop("x")


_PANEL = "1.0::DOUBLE * (1 + length(s) - length(translate(s, 'DE', ''))) / (1 + length(s) - length(translate(s, 'KR', '')))"


@query(f"""WITH {SEQ}, {CANDIDATES}, p AS (SELECT rec_id, list_transform(range(1, 12), lambda i: round(8.0 * i * ({_PANEL}), 3)) AS m FROM candidates)
    SELECT rec_id, round(list_sum(m) / 11, 2) AS mean_mic, list_min(m) AS min_mic FROM p""")
def panel_scores(spark, sf_dir):
    """A plug-in panel scorer over distinct sequences, summarised by row."""
    names = [f"mic_{i}" for i in range(11)]
    scored = models.score_in_batches(candidates(spark, sf_dir), "rec_id", "sequence", models.stub_panel(), ", ".join(f"{n} double" for n in names))
    out = scored.withColumn("p", assay.panel_summary([F.col(n) for n in names])).select("rec_id", "p.mean_mic", "p.min_mic")
    return out.withColumn("mean_mic", F.round("mean_mic", 2))


@query(f"""WITH {SEQ}, {CANDIDATES} SELECT rec_id, round(exp(length(s) % 7 / 2.0::DOUBLE), 4) AS perplexity, exp(length(s) % 7 / 2.0::DOUBLE) <= 5 AS passes FROM candidates""")
def perplexity_scores(spark, sf_dir):
    """A plug-in likelihood over distinct sequences, and whether its perplexity passes."""
    out = models.perplexity_job(candidates(spark, sf_dir), "rec_id", "sequence", models.stub_likelihood(), 5.0)
    return out.withColumn("perplexity", F.round("perplexity", 4))


@query("""WITH t AS (SELECT p_size, count(*) AS n, 0.8::DOUBLE + p_size / 100.0::DOUBLE AS temperature FROM part GROUP BY p_size),
        c AS (SELECT *, sum(n) OVER (ORDER BY p_size) - n AS start FROM t), b AS (SELECT *, unnest(range(0, n, 16)) AS i FROM c)
    SELECT (start + i)::INTEGER AS first_attempt, least(16, n - i)::INTEGER AS attempts, round(temperature, 4) AS temperature, 0.9::DOUBLE AS top_p, (start + i + 42)::INTEGER AS batch_seed FROM b""")
def sampling_schedule(spark, sf_dir):
    """Batches of a sampler with their temperatures and seeds; a tier for each size of part, an attempt for each part."""
    tiers = table(spark, sf_dir, "part").groupBy("p_size").agg(F.count(F.lit(1)).alias("n")).orderBy("p_size").collect()  # one row a size
    out = models.sampling_schedule(spark, [(r["n"], 0.8 + r["p_size"] / 100.0) for r in tiers], batch=16)
    return out.withColumn("temperature", F.round("temperature", 4))


# Verification --------------------------------------------------------------------------------------------------------


@query(f"""WITH {SEQ}, lib AS (SELECT s FROM seq WHERE doc_id % 5 <> 0), top AS (SELECT rec_id, doc_id, pos, s FROM seq WHERE doc_id % 50 = 1)
    SELECT 'library_size' AS rule, (CASE WHEN (SELECT count(*) FROM lib) = 800 THEN 0 ELSE 1 END)::BIGINT AS violations
    UNION ALL SELECT 'library_repeats', count(*) FROM (SELECT s FROM lib GROUP BY s HAVING count(*) > 1)
    UNION ALL SELECT 'library_alphabet', count(*) FROM lib WHERE NOT {GOOD}
    UNION ALL SELECT 'library_length', count(*) FROM lib WHERE length(s) NOT BETWEEN 8 AND 50
    UNION ALL SELECT 'top_size', (CASE WHEN (SELECT count(*) FROM top) = 20 THEN 0 ELSE 1 END)::BIGINT
    UNION ALL SELECT 'top_repeats', count(*) FROM (SELECT s FROM top GROUP BY s HAVING count(*) > 1)
    UNION ALL SELECT 'top_not_in_library', count(*) FROM top WHERE s NOT IN (SELECT s FROM lib)
    UNION ALL SELECT 'reference_overlap', count(*) FROM lib WHERE {HIT.replace('s IN', 'lib.s IN')}
    UNION ALL SELECT 'top_header', count(*) FROM top WHERE pos % 4 = 3 OR pos >= 999""")
def submission_checks(spark, sf_dir):
    """Rules of a made-up submission; every fourth header names another rank."""
    seq = materialize(derived(spark, sf_dir).select("rec_id", "doc_id", "pos", "s"), "sequences")  # every rule reads it
    header = F.format_string("rank_%03d_ar_%d", F.col("pos") + F.when(F.col("pos") % 4 == 3, 2).otherwise(1), F.col("rec_id"))
    top = seq.filter("doc_id % 50 = 1").withColumn("header", header).withColumn("rank", F.col("pos") + 1)
    rules = verify.submission_rules(seq.filter("doc_id % 5 <> 0"), top, seq.filter("doc_id % 5 = 0"), "s", 800, 20, ["ar"], "header", "rank")
    return verify.rule_counts(rules)


#: A row's text: names, types and values; its digest; sums of the digest's eight parts.
_ATOMS = {"p_brand": "string", "p_name": "string", "p_partkey": "bigint", "p_size": "int", "p_type": "string"}
_ROW = " || chr(31) || ".join(f"'{c}={t}:' || {c}::VARCHAR" for c, t in _ATOMS.items())


@query(f"""WITH h AS (SELECT sha256(p_partkey::VARCHAR || chr(29) || {_ROW}) AS h FROM part),
        p AS (SELECT {', '.join(f"sum(('0x' || substring(h, {1 + 8 * i}, 8))::HUGEINT)::VARCHAR AS p{i}" for i in range(8))}, count(*) AS rows FROM h)
    SELECT rows, '{','.join(f'{c}:{t}' for c, t in _ATOMS.items())}' AS schema, sha256(concat_ws(',', {', '.join(f'p{i}' for i in range(8))})) AS sha256 FROM p""")
def value_fingerprint(spark, sf_dir):
    return verify.fingerprint(table(spark, sf_dir, "part").select(*_ATOMS), ["p_partkey"])


# Checks of results that no SQL gives ---------------------------------------------------------------------------------


@query(f"WITH {SEQ}, {CANDIDATES} SELECT 4 * count(*) AS children, count(*) AS parents, 0::BIGINT AS foreign_residues, 0::BIGINT AS out_of_bounds, 0::BIGINT AS wrong_changes FROM candidates")
def mutation_checks(spark, sf_dir):
    """Children of all candidates: residues, lengths, and one change of the kind and at the place that is named."""
    kids = search.mutate(candidates(spark, sf_dir).select("rec_id", "sequence"), "rec_id", "sequence", 4, 42, 1)
    s, c, at, kind = F.col("sequence"), F.col("child"), F.col("position"), F.col("mutation_type")
    part = lambda x, start, size: F.substring(x, start + 1, size)
    head, long = part(s, F.lit(0), at) == part(c, F.lit(0), at), F.lit(100)
    right = (
        F.when(kind == "sub", head & (part(s, at, F.lit(1)) != part(c, at, F.lit(1))) & (part(s, at + 1, long) == part(c, at + 1, long)))
        .when(kind == "ins", head & (part(s, at, long) == part(c, at + 1, long))).otherwise(head & (part(s, at + 1, long) == part(c, at, long)))
    )
    return kids.agg(
        F.count(F.lit(1)).alias("children"), F.count_distinct("rec_id").alias("parents"), F.count_if(~sequence.canonical(c)).alias("foreign_residues"),
        F.count_if(~F.length(c).between(8, 50)).alias("out_of_bounds"), F.count_if(~right).alias("wrong_changes"),
    )


@query(f"""WITH {SEQ}, {CANDIDATES} SELECT 100::BIGINT AS chosen, 50::BIGINT AS nested, 100::BIGINT AS ranks, 0::BIGINT AS unknown, 0::BIGINT AS too_near,
        (SELECT count(*) FROM (SELECT primary_domain FROM candidates GROUP BY primary_domain)) AS domains, true AS within_quota""")
def portfolio_checks(spark, sf_dir):
    """A portfolio's sizes and ranks, where it comes from, its quotas, and that no two of it are too near."""
    from strandloom.operators.similar import similar_pairs

    rows = candidates(spark, sf_dir)
    out = materialize(select.select_portfolio(rows, 100, 50), "portfolio")
    near = similar_pairs(out, "sequence", "sequence", 0.8).filter("similarity > 0.8").agg(F.count(F.lit(1)).alias("too_near"))
    lost = out.join(rows.filter("max_reference_similarity <= 0.8").select("sequence"), "sequence", "left_anti").agg(F.count(F.lit(1)).alias("unknown"))
    most = out.groupBy("primary_domain").agg(F.count(F.lit(1)).alias("n")).agg((F.max("n") <= 60).alias("within_quota"))
    domains = rows.agg(F.count_distinct("primary_domain").alias("domains"))
    whole = out.agg(F.count(F.lit(1)).alias("chosen"), F.count_if("is_nested").alias("nested"), F.count_distinct("portfolio_rank").alias("ranks"))
    for part in (lost, near, domains, most):
        whole = whole.join(F.broadcast(part))  # single rows
    return whole


@query("SELECT 10000::BIGINT AS n_draws, true AS as_expected, true AS means_agree FROM (SELECT 1)")
def draw_checks(spark, sf_dir):
    """Random draws against what draws without replacement have to give: the hit probability within four deviations."""
    import math

    rows = candidates(spark, sf_dir)
    hit = (F.col("pred_amp_probability") >= 0.70) & F.col("synthesizable")
    known = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("k"), F.avg("lcb_quality").alias("q"), F.stddev_pop("lcb_quality").alias("d")).first()
    n, k = known["n"], known["k"]
    none = math.exp(sum(math.log((n - k - i) / (n - i)) for i in range(25))) if n - k >= 25 else 0.0
    out = select.simulate_draws(rows, "rec_id", "lcb_quality", "pred_amp_probability", "pred_toxicity_risk", "synthesizable")
    spread = 4 * math.sqrt(none * (1 - none) / 10_000) + 1e-4
    near = F.abs(F.col("prob_at_least_1") - (1 - none)) <= spread
    return out.select("n_draws", near.alias("as_expected"), (F.abs(F.col("mean_quality") - known["q"]) <= 4 * known["d"] / math.sqrt(250_000) + 1e-4).alias("means_agree"))


@query("SELECT least(100, count(*)) AS chosen, min(p_partkey) AS first, least(100, count(*)) AS distinct_rows FROM part")
def farthest_checks(spark, sf_dir):
    """How many points are chosen, and where the choice begins."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice")
    out = select.farthest_points(p, "p_partkey", ["p_size", "p_retailprice"], 100)
    return out.agg(F.count(F.lit(1)).alias("chosen"), F.min_by("p_partkey", "rank").alias("first"), F.count_distinct("p_partkey").alias("distinct_rows"))
