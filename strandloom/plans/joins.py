"""Queries on joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandloom.functions import biophysics, sequence
from strandloom.operators import aggregate, curate, verify
from strandloom.plans.registry import CANDIDATES, CHARGE, GOOD, HIT, SEQ, VALID, candidates, canonical_records, derived, query
from strandloom.storage import table

# Joins ---------------------------------------------------------------------------------------------------------------


@query(f"""WITH {SEQ}, k AS (SELECT s, min(rec_id::VARCHAR) AS i FROM seq GROUP BY s), o AS (SELECT event_id, s FROM events LEFT
        JOIN seq ON rec_id = user_id * 1000000 + event_id % 20)
    SELECT event_id, coalesce(i, '') AS sequence_id FROM o LEFT JOIN k USING (s)""")
def assay_link_left(spark, sf_dir):
    """Observations with the identifier of their sequence; many have none, and many the empty one."""
    seq = derived(spark, sf_dir)
    events = table(spark, sf_dir, "events").withColumn("at", F.col("user_id") * 1_000_000 + F.col("event_id") % 20)
    obs = events.join(seq, F.col("at") == F.col("rec_id"), "left").select("event_id", "s")
    return curate.link(obs, seq.select("s", F.col("rec_id").alias("sequence_id")), "s").select("event_id", "sequence_id")


@query(f"""WITH {SEQ}, o AS (SELECT event_id, user_id, CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'GIVEN' END AS v FROM events), l AS (SELECT doc_id,
        arg_max(raw, pos) AS raw FROM seq GROUP BY doc_id)
    SELECT event_id, coalesce(nullif(v, ''), raw) AS v FROM o LEFT JOIN l ON user_id = doc_id""")
def assay_fill(spark, sf_dir):
    """Sequences of observations, by peptide where they are null or empty; the last of a peptide wins."""
    v = F.when(F.col("event_id") % 3 == 0, "").when(F.col("event_id") % 3 == 2, "GIVEN")
    obs = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("doc_id"), v.alias("v"))
    return curate.fill_from(obs, derived(spark, sf_dir).select("doc_id", F.col("raw").alias("v"), "pos"), "doc_id", "v", "pos").select("event_id", "v")


@query("""SELECT event_id, p_name, canonical_species FROM events JOIN part ON p_partkey = user_id JOIN (SELECT DISTINCT p_name,
        array_to_string(string_split(p_name, ' ')[1:2], ' ') AS canonical_species FROM part) USING (p_name)""")
def organism_lookup(spark, sf_dir):
    """Assays with the mapped species of their organism: the mapping is made once a name and joined."""
    part = table(spark, sf_dir, "part")
    names = part.select("p_name").distinct().select("p_name", sequence.organism(F.col("p_name"))["canonical_species"].alias("canonical_species"))
    obs = table(spark, sf_dir, "events").join(part.select("p_partkey", "p_name"), F.col("user_id") == F.col("p_partkey")).select("event_id", "p_name")
    return curate.many_to_one(obs, names, "p_name").select("event_id", "p_name", "canonical_species")


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_totalprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def toxicity_join(spark, sf_dir):
    """Many observations to one record each; a repeated record would be an error."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice")
    return curate.many_to_one(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber"), orders, "l_orderkey")


@query("""SELECT o_orderkey, coalesce(l.n, 0) AS n, o_orderpriority, 'v1' AS data_version, coalesce(l.k, '') AS cluster_id, coalesce(l.sp, 'unassigned') AS split
        FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, min(l_suppkey)::VARCHAR AS k, CASE WHEN l_orderkey % 10 < 8 THEN 'train' ELSE 'test' END AS sp
        FROM lineitem WHERE l_orderkey % 3 > 0 GROUP BY l_orderkey) l ON o_orderkey = l_orderkey""")
def role_views(spark, sf_dir):
    """A projection with split, cluster and version; rows without them take defaults."""
    lines = table(spark, sf_dir, "lineitem").filter("l_orderkey % 3 > 0").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("n"), F.min("l_suppkey").cast("string").alias("cluster_id"))
    splits = lines.withColumn("split", F.when(F.col("o_orderkey") % 10 < 8, "train").otherwise("test"))
    orders = curate.with_defaults(table(spark, sf_dir, "orders"), lines, "o_orderkey", {"n": 0})
    return curate.role_view(orders, splits, ["n", "o_orderpriority"], "v1", "o_orderkey")


@query(f"WITH {SEQ} SELECT rec_id, {HIT} AS overlap FROM seq")
def reference_flag(spark, sf_dir):
    seq = derived(spark, sf_dir)
    return curate.flag_reference(seq, seq.filter("doc_id % 5 = 0"), "s", "overlap").select("rec_id", "overlap")


@query(f"WITH {SEQ} SELECT rec_id FROM seq WHERE doc_id % 5 <> 0 AND NOT {HIT}")
def reference_anti(spark, sf_dir):
    seq = derived(spark, sf_dir)
    return curate.quarantine(seq.filter("doc_id % 5 <> 0"), seq.filter("doc_id % 5 = 0"), "s").select("rec_id")


@query(f"""WITH {SEQ} SELECT sha256(m.s) AS sequence_sha256, seq.source, seq.rec_id FROM seq JOIN (SELECT DISTINCT 'seq_' || substring(sha256(s), 1, 16) AS i, s
        FROM seq WHERE doc_id % 4 = 0 AND {VALID}) m ON m.s = seq.s""")
def membership_disclosure(spark, sf_dir):
    """Training members by digest, with every record they came from."""
    seq = derived(spark, sf_dir).withColumn("sequence_id", sequence.sequence_id(F.col("s")))
    members = seq.filter("doc_id % 4 = 0").filter(sequence.first_reason(F.col("s")) == "ok").select("sequence_id", "s").distinct()
    return verify.membership_disclosure(members, seq.select("sequence_id", "source", "rec_id"), "sequence_id", "s", ["source", "rec_id"])


# Filters -------------------------------------------------------------------------------------------------------------

_DOMAINS = "CASE p_partkey % 5 WHEN 0 THEN 'ar;vae' WHEN 1 THEN 'ar' WHEN 2 THEN 'ar;other' WHEN 3 THEN '' ELSE NULL END"
_VALUES = "CASE p_partkey % 6 WHEN 0 THEN p_size::VARCHAR WHEN 1 THEN '0' WHEN 2 THEN '-3' WHEN 3 THEN 'inf' WHEN 4 THEN 'abc' ELSE NULL END"


@query(f"""SELECT p_partkey, p_partkey % 5 < 2 AS in_domains, CASE WHEN p_partkey % 6 = 0 AND p_size > 0 THEN p_size::DOUBLE END AS mic,
        p_partkey % 3 = 0 AND p_partkey % 2 = 0 AND p_partkey % 10 <= 8 AS rankable, p_partkey % 10 / 10.0 <= 0.8 AS novel, p_partkey % 2 = 0 AS flag FROM part""")
def row_filters(spark, sf_dir):
    """Domain sets, positive numbers, the mask of what can be ranked, a flag that has to agree, and strict booleans."""
    k, sim = F.col("p_partkey"), F.col("p_partkey") % 10 / 10.0
    domains = F.when(k % 5 == 0, "ar;vae").when(k % 5 == 1, "ar").when(k % 5 == 2, "ar;other").when(k % 5 == 3, "")
    values = F.when(k % 6 == 0, F.col("p_size").cast("string")).when(k % 6 == 1, "0").when(k % 6 == 2, "-3").when(k % 6 == 3, "inf").when(k % 6 == 4, "abc")
    rows = table(spark, sf_dir, "part").withColumn("sim", sim).withColumn("novel", F.col("sim") <= 0.8)
    checked = curate.consistent_flag(rows, "novel", "sim")
    return checked.select(
        "p_partkey", curate.in_values(domains, ["ar", "vae"]).alias("in_domains"), curate.positive_finite(values).alias("mic"),
        curate.rankable(k % 3 == 0, k % 2 == 0, F.col("novel"), F.col("sim")).alias("rankable"), "novel", curate.strict_boolean(F.when(k % 2 == 0, " True").otherwise("0")).alias("flag"),
    )


@query(f"""WITH {SEQ}, {CANDIDATES}
    SELECT count(*) FILTER ({CHARGE} BETWEEN 2 AND 8) AS seeds, count(*) FILTER (similarity BETWEEN 0 AND 0.8) AS novel,
        count(*) FILTER (lower(primary_domain) = 'en') AS of_domain FROM candidates""")
def candidate_filters(spark, sf_dir):
    """Plain filters of candidates: charge of seeds, similarity, and a domain in any case."""
    return candidates(spark, sf_dir).agg(
        F.count_if(F.col("net_charge_ph7").between(2, 8)).alias("seeds"), F.count_if(F.col("max_reference_similarity").between(0, 0.8)).alias("novel"), F.count_if(F.lower("primary_domain") == "en").alias("of_domain")
    )


# Aggregates ----------------------------------------------------------------------------------------------------------


@query("SELECT user_id, round(min(value), 6) AS best_value, arg_min(event_type, (value, event_id)) AS best_event_type FROM events WHERE value IS NOT NULL GROUP BY user_id")
def assay_argmin(spark, sf_dir):
    out = aggregate.exact_minimum(table(spark, sf_dir, "events"), "user_id", "value", "event_type", "event_id")
    return out.withColumn("best_value", F.round("best_value", 6))


@query("SELECT user_id, count(*) FILTER (value > 100) AS high, count(*) FILTER (event_type = 'view') AS views FROM events GROUP BY user_id")
def conditional_counts(spark, sf_dir):
    return aggregate.conditional_counts(table(spark, sf_dir, "events"), "user_id", high=F.col("value") > 100, views=F.col("event_type") == "view")


@query("""SELECT user_id, array_to_string(list_sort(list(DISTINCT event_type)), ';') AS event_type, array_to_string(list_sort(list(DISTINCT props)), ';') AS props
        FROM events GROUP BY user_id""")
def joined_sets(spark, sf_dir):
    return aggregate.joined_sets(table(spark, sf_dir, "events"), "user_id", "event_type", "props")


@query("""SELECT p_brand, bool_or(contains(lower(p_name), 'ring') OR contains(lower(p_name), 'bolt')) AS is_metal, bool_or(contains(lower(p_name), 'red')) AS is_red
        FROM part GROUP BY p_brand""")
def annotation_flags(spark, sf_dir):
    return curate.annotate(table(spark, sf_dir, "part"), {"is_metal": ["ring", "bolt"], "is_red": ["red"]}, "p_brand", "p_name")


@query(f"""WITH {SEQ} SELECT s, CASE WHEN min(toxic) = max(toxic) THEN min(toxic) END AS toxic, min(toxic) <> max(toxic) AS conflict, count(*) AS observations
    FROM seq JOIN labels USING (doc_id) WHERE toxic IS NOT NULL GROUP BY s""")
def label_agreement(spark, sf_dir):
    return aggregate.label_agreement(derived(spark, sf_dir).join(table(spark, sf_dir, "labels"), "doc_id"), "s", "toxic")


@query(f"""WITH {SEQ}, m AS (SELECT s, list_sort(list(DISTINCT lang)) AS d, count(DISTINCT rec_id) AS n_ids, min(rec_id) AS f FROM seq GROUP BY s)
    SELECT m.s, array_to_string(d, ';') AS domains, len(d)::INTEGER AS domain_count, d[1] AS primary_domain, n_ids::INTEGER AS n_ids, seq.source FROM m JOIN seq ON f = rec_id""")
def provenance_merge(spark, sf_dir):
    """One row a sequence: sorted domains and identifiers, and the source of its first record."""
    rows = derived(spark, sf_dir).select("s", "lang", "rec_id", "source").withColumn("at", F.col("rec_id"))
    m = aggregate.merge_domains(rows, "s", "lang", "rec_id", None, ["at"])
    return m.select("s", F.array_join("contributing_domains", ";").alias("domains"), "domain_count", "primary_domain", F.size("contributing_candidate_ids").alias("n_ids"), "source")


@query(f"""WITH {SEQ}, m AS (SELECT s, list(DISTINCT lang) AS d FROM seq GROUP BY s), x AS (SELECT unnest(d) AS domain, len(d) = 1 AS one FROM m)
    SELECT domain, count(*) AS n_sequences, count(*) FILTER (one) AS n_exclusive FROM x GROUP BY domain""")
def domain_overlap(spark, sf_dir):
    return aggregate.domain_overlap(aggregate.merge_domains(derived(spark, sf_dir).select("s", "lang", "rec_id"), "s", "lang", "rec_id", None, ["s"]))


@query(f"""WITH {SEQ}, m AS (SELECT s, list(DISTINCT source) AS d FROM seq JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY s),
        x AS (SELECT unnest(d) AS domain, len(d) = 1 AS one FROM m)
    SELECT domain, count(*) AS n_sequences, count(*) FILTER (one) AS n_exclusive FROM x GROUP BY domain""")
def training_overlap(spark, sf_dir):
    """Sources of the training rows, which overlap, and what only one of them has."""
    rows = derived(spark, sf_dir).join(table(spark, sf_dir, "labels").filter("quality = 1"), "doc_id").select("s", "source", "rec_id")
    return aggregate.domain_overlap(aggregate.merge_domains(rows, "s", "source", "rec_id", None, ["s"]))


@query(f"""WITH {SEQ}, d AS (SELECT DISTINCT source, s FROM seq), n AS (SELECT source, count(*) AS n FROM d GROUP BY source), b AS (SELECT x.source AS a,
        y.source AS b, count(*) AS c FROM d x JOIN d y USING (s) GROUP BY ALL)
    SELECT p.source AS source_a, q.source AS source_b, coalesce(c, 0) AS shared, round(coalesce(c, 0) / (p.n + q.n - coalesce(c, 0))::DOUBLE, 6) AS jaccard
    FROM n p CROSS JOIN n q LEFT JOIN b ON p.source = b.a AND q.source = b.b""")
def source_overlap_jaccard(spark, sf_dir):
    return aggregate.source_overlap(derived(spark, sf_dir), "source", "s")


_EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
_MISSING = ", ".join(f"count(*) FILTER (coalesce(trim({c}::VARCHAR), '') = '')" for c in _EVENT_COLUMNS)


@query(f"SELECT 'events' AS table_name, unnest({list(_EVENT_COLUMNS)}) AS column_name, count(*) AS rows, unnest([{_MISSING}]) AS missing FROM events")
def missingness(spark, sf_dir):
    return aggregate.missingness(table(spark, sf_dir, "events"), "events")


@query(f"WITH {SEQ} SELECT residue, count(*) AS n FROM (SELECT unnest(string_split(s, '')) AS residue FROM seq) WHERE residue <> '' GROUP BY residue")
def residue_histogram(spark, sf_dir):
    return aggregate.residue_histogram(derived(spark, sf_dir), "s")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def label_histogram(spark, sf_dir):
    return aggregate.value_counts(table(spark, sf_dir, "events"), "event_type")


@query("""SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 4) AS q25, round(quantile_cont(l_quantity, 0.5), 4) AS q50, round(quantile_cont(l_quantity, 0.75), 4) AS q75
    FROM lineitem GROUP BY l_returnflag""")
def quantile_table(spark, sf_dir):
    return aggregate.quantile_table(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity")


_SUMMARY = "SELECT '{0}' AS descriptor, round(min({0}), 4) AS minimum, round(max({0}), 4) AS maximum, round(avg({0}), 4) AS mean, round(stddev_pop({0}), 4) AS std FROM lineitem"


@query(" UNION ALL ".join(_SUMMARY.format(c) for c in ("l_quantity", "l_discount")))
def descriptor_summary(spark, sf_dir):
    return aggregate.descriptor_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], 4)


@query("""SELECT o_orderpriority, count(*) AS rows, count(DISTINCT o_custkey) AS distinct_keys, round(avg(o_totalprice), 4) AS mean_value,
        count(*) FILTER (o_orderstatus = 'F') AS flagged
    FROM orders GROUP BY o_orderpriority""")
def group_summary(spark, sf_dir):
    return aggregate.group_summary(table(spark, sf_dir, "orders"), "o_orderpriority", "o_custkey", "o_totalprice", F.col("o_orderstatus") == "F")


@query("""SELECT event_type, 'high' AS predicate, count(*) FILTER (value > 50) AS n FROM events GROUP BY event_type
    UNION ALL SELECT event_type, 'odd', count(*) FILTER (user_id % 2 = 1) FROM events GROUP BY event_type""")
def predicate_counts(spark, sf_dir):
    return aggregate.predicate_counts(table(spark, sf_dir, "events"), "event_type", high=F.col("value") > 50, odd=F.col("user_id") % 2 == 1)


@query(f"""WITH {SEQ} SELECT count(*) AS total, count(*) FILTER ({VALID}) AS valid, count(DISTINCT s) AS unique_sequences, count(*) - count(DISTINCT s) AS duplicates,
    round(count(*) FILTER ({VALID}) / count(*)::DOUBLE, 4) AS valid_rate FROM seq""")
def validity_summary(spark, sf_dir):
    return aggregate.validity_summary(derived(spark, sf_dir), "s", sequence.first_reason(F.col("s")))


@query(f"""WITH {SEQ} SELECT lang, count(*) AS rows, count(DISTINCT s) AS unique_sequences, min(length(s)) AS shortest, max(length(s)) AS longest,
        bool_and({GOOD}) AS all_canonical,
    count(*) FILTER ({HIT}) AS reference_matches FROM seq GROUP BY lang""")
def ingestion_audit(spark, sf_dir):
    seq = derived(spark, sf_dir)
    flagged = curate.flag_reference(seq, seq.filter("doc_id % 5 = 0"), "s", "hit")
    return aggregate.ingestion_audit(flagged, "lang", "s", F.col("hit"), sequence.canonical(F.col("s")))


@query("""WITH c AS (SELECT source, count(*)::DOUBLE AS n FROM documents GROUP BY source), t AS (SELECT sum(n) AS t FROM c)
        SELECT round(-sum(n / t * ln(n / t)), 6) AS entropy FROM c, t""")
def shannon_entropy(spark, sf_dir):
    return aggregate.shannon_entropy(table(spark, sf_dir, "documents"), "source")


@query(f"""WITH {SEQ}, f AS (SELECT * FROM seq ORDER BY rec_id LIMIT 50)
    SELECT count(*) AS n_pairs, round(avg(levenshtein(strip_accents(a.s), strip_accents(b.s))), 4) AS mean_distance FROM f a JOIN f b ON a.rec_id < b.rec_id""")
def edit_distance_mean(spark, sf_dir):
    """Mean edit distance of the first fifty records; accents go, since not every engine counts them as characters."""
    plain = F.translate("s", "ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŸÁÍÓÚÑ", "AAACEEEEIIOOUUUYAIOUN")
    return aggregate.mean_pairwise_distance(derived(spark, sf_dir).select("rec_id", plain.alias("s")), "s", "rec_id")


@query("""WITH q AS (SELECT quantile_cont(o_totalprice, 0.1) AS q FROM orders) SELECT round(max(q), 4) AS quantile, round(avg(o_totalprice), 4) AS tail_mean
        FROM orders, q WHERE o_totalprice <= q""")
def tail_risk(spark, sf_dir):
    return aggregate.tail_risk(table(spark, sf_dir, "orders"), "o_totalprice")


@query("""WITH g AS (SELECT p_partkey, p_size AS d, 25 AS k, unnest([1, 5, 10]) AS least FROM part),
        x AS (SELECT *, unnest(range(greatest(least, d + k - 100, 0), least(k, d) + 1)) AS x FROM g),
        t AS (SELECT p_partkey, least, sum(exp(lgamma(k + 1) - lgamma(x + 1) - lgamma(k - x + 1) + lgamma(100 - k + 1) - lgamma(d - x + 1) - lgamma(100 - k - d + x + 1) - (lgamma(101) - lgamma(d + 1) - lgamma(101 - d)))) AS p FROM x GROUP BY ALL)
    SELECT g.p_partkey, g.least, round(coalesce(p, 0), 6) AS tail_probability FROM g LEFT JOIN t USING (p_partkey, least)""")
def hypergeometric_tail(spark, sf_dir):
    """Of 25 hits in 100, at least 1, 5 and 10 in as many draws as a part's size."""
    rows = table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("int").alias("d"), F.lit(100).alias("n"), F.lit(25).alias("k"), F.explode(F.array(*map(F.lit, (1, 5, 10)))).alias("least"))
    return aggregate.hypergeometric_tail(rows, "n", "k", "d", "least").select("p_partkey", "least", "tail_probability")


@query("""WITH d AS (SELECT doc_id, quality AS y, (doc_id * 37 % 101) / 101.0::DOUBLE AS s FROM labels WHERE quality IS NOT NULL),
        g AS (SELECT s, sum(y)::DOUBLE AS p, count(*)::DOUBLE AS n, sum(pow(s - y, 2)) AS b FROM d GROUP BY s),
        w AS (SELECT *, sum(p) OVER (ORDER BY s DESC) AS tp, sum(n) OVER (ORDER BY s DESC) AS al FROM g)
    SELECT round(sum((n - p) * (tp - p + p / 2)) / (sum(p) * sum(n - p)), 6) AS roc_auc, round(sum(p * tp / al) / sum(p), 6) AS average_precision, round(sum(b) /
        sum(n), 6) AS brier FROM w""")
def score_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "labels").filter("quality is not null").select("doc_id", "quality", (F.col("doc_id") * 37 % 101 / 101.0).alias("s"))
    return aggregate.metrics(df, "quality", "s", "doc_id")


_MOTIF = "regexp_matches(m, '[KR].{0,2}[WFLIV]|[WFLIV].{0,2}[KR]')"
_MOTIF_CHARGE = CHARGE.replace("(s)", "(m)").replace("(s,", "(m,")


@query(f"""WITH {SEQ}, v AS (SELECT s, min(rec_id) AS rec_id FROM seq WHERE {VALID} GROUP BY s), k AS (SELECT rec_id, s, unnest(range(4, 9)) AS k FROM v),
        o AS (SELECT rec_id, substring(s, i, k) AS m FROM (SELECT *, unnest(range(1, length(s) - k + 2)) AS i FROM k WHERE length(s) >= k)),
        g AS (SELECT m, count(*) AS frequency, count(DISTINCT rec_id) AS n, list_sort(list(DISTINCT rec_id))[1:5] AS ids FROM o WHERE {_MOTIF} GROUP BY m HAVING
            count(DISTINCT rec_id) >= 3)
    SELECT m AS motif_sequence, frequency, {_MOTIF_CHARGE} AS mean_charge, n AS associated_seq_count, array_to_string(ids, ';') AS example_sequence_ids,
           row_number() OVER (ORDER BY n DESC, frequency DESC, m) AS place FROM g""")
def motif_library(spark, sf_dir):
    """Motifs of the valid sequences, in order."""
    from strandloom.operators.curate import number_rows

    motifs = F.filter(sequence.substrings(F.col("s")), sequence.amphipathic)
    valid = canonical_records(spark, sf_dir).filter(F.length("s").between(8, 50)).groupBy("s").agg(F.min("rec_id").alias("rec_id"))
    out = aggregate.motif_library(valid, "rec_id", motifs, biophysics.net_charge)
    return number_rows(out, [F.desc("associated_seq_count"), F.desc("frequency"), F.asc("motif_sequence")], "place")


@query("""WITH c AS (SELECT event_type AS label, count(*) AS n FROM events GROUP BY event_type)
    SELECT label, n, sum(n) OVER (ORDER BY n DESC, label ROWS UNBOUNDED PRECEDING)::BIGINT AS running FROM c""")
def family_balance(spark, sf_dir):
    """Counts of a label with their running total, over one row a label."""
    counts = aggregate.value_counts(table(spark, sf_dir, "events").select(F.col("event_type").alias("label")), "label")
    return counts.withColumn("running", F.sum("n").over(Window.orderBy(F.desc("n"), "label").rowsBetween(Window.unboundedPreceding, 0)))


@query("""SELECT count(*) AS requests, count(*) FILTER (event_id % 7 <> 0 AND event_id % 3 <> 0) AS unique_calls, count(*) FILTER (event_id % 3 = 0) AS cache_hits,
    count(*) FILTER (event_id % 7 = 0) AS rejections, count(*) FILTER (value > 50) AS hits, round(count(*) FILTER (value > 50) / count(*)::DOUBLE, 4) AS hit_rate FROM events""")
def evaluation_ledger(spark, sf_dir):
    e = F.col("event_id")
    return aggregate.ledger(table(spark, sf_dir, "events"), e % 3 == 0, e % 7 != 0, F.col("value") > 50)


@query("""SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean_fitness, round(max(o_totalprice), 4) AS max_fitness,
        count(DISTINCT o_orderpriority) AS active_families FROM orders GROUP BY o_orderstatus""")
def generation_history(spark, sf_dir):
    return aggregate.history(table(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("""WITH r AS (SELECT *, p_partkey % 3 AS strategy, row_number() OVER (PARTITION BY p_partkey % 3 ORDER BY p_partkey) AS rank FROM part),
        d AS (SELECT strategy, p_brand, count(*)::DOUBLE AS n FROM r GROUP BY ALL),
        e AS (SELECT strategy, round(ln(sum(n)) - sum(n * ln(n)) / sum(n), 3) AS domain_entropy FROM d GROUP BY strategy),
        l AS (SELECT a.strategy, round(avg(levenshtein(a.p_name, b.p_name)), 2) AS mean_pairwise_distance FROM r a JOIN r b ON a.strategy = b.strategy
            AND a.rank < b.rank AND b.rank <= 50 GROUP BY a.strategy)
    SELECT strategy, round(avg(p_retailprice), 4) AS mean_lcb_quality, round(avg(p_size), 4) AS mean_amp_prob, round(avg(p_size % 7), 4) AS mean_toxicity_risk,
        any_value(domain_entropy) AS domain_entropy,
           any_value(mean_pairwise_distance) AS mean_pairwise_distance, round(avg((p_partkey % 4 <> 0)::INTEGER), 4) AS synthesizable_fraction,
               round(avg((p_partkey % 10 <= 8)::INTEGER), 4) AS novelty_le80_fraction
    FROM r JOIN e USING (strategy) JOIN l USING (strategy) GROUP BY strategy""")
def strategy_comparison(spark, sf_dir):
    """Three made-up selections of parts, compared."""
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        (k % 3).alias("strategy"), F.col("p_name").alias("sequence"), F.col("p_brand").alias("primary_domain"), F.col("p_retailprice").alias("lcb_quality"), F.col("p_size").alias("pred_amp_probability"),
        (F.col("p_size") % 7).alias("pred_toxicity_risk"), (k % 4 != 0).alias("synthesizable"), (k % 10 / 10.0).alias("max_reference_similarity"), (F.floor(k / 3) + 1).alias("rank"),
    )
    return aggregate.strategy_metrics(rows, "strategy")
