"""Queries on similarity, clusters, splits and lineage.

The similarity joins take the sentences of every text of ``benchmark``, in normal form: of any length and any characters.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandloom.functions import sequence, similarity
from strandloom.operators import aggregate, forest, graph, select, similar
from strandloom.plans.registry import numbered, query
from strandloom.storage import table


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``k, item_id, s``: the sentences of each benchmark text."""
    piece = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("sz")), r"[.!?\n]+")
    rows = table(spark, sf_dir, "benchmark").select("item_id", F.posexplode(piece).alias("pos", "piece"))
    return rows.select(numbered("item_id", F.col("pos"), 1000).alias("k"), "item_id", sequence.norm(F.col("piece")).alias("s"))


SENTENCES = r"""b AS (SELECT item_id, unnest(range(len(x))) AS pos, unnest(x) AS piece FROM (SELECT item_id,
        regexp_split_to_array(replace(coalesce(text, ''), 'ß', 'sz'), '[.!?\n]+') AS x FROM benchmark)),
    sent AS MATERIALIZED (SELECT item_id * 1000 + pos AS k, item_id, upper(regexp_replace(piece, '\s+', '', 'g')) AS s FROM b)"""
#: Bits of a word of the bit-parallel common subsequence in SQL, and words: enough for texts of 240 characters.
_BITS, _WORDS = 60, 4
_MASK = (
    f"list_transform(range({_WORDS}), lambda w: coalesce(list_sum(list_transform(range(w * {_BITS}, least((w + 1) * {_BITS}, length(s))), "
    f"lambda i: CASE WHEN substring(s, i + 1, 1) = c THEN (1::BIGINT << (i - w * {_BITS})::BIGINT) ELSE 0::BIGINT END)), 0)::BIGINT)"
)
_TOPS = f"list_transform(range({_WORDS}), lambda w: ((1::BIGINT << greatest(0, least({_BITS}, length(s) - w * {_BITS}))::BIGINT) - 1)::BIGINT)"
_FULL = (1 << _BITS) - 1


def _fold(word: int) -> str:
    """The sum of a word with its matches and the carry of the words below."""
    carry = f"(({_fold(word - 1)}) >> {_BITS})" if word else "0"
    return f"(v[{word + 1}] + (v[{word + 1}] & m[{word + 1}]) + {carry})"


_STEP = "[" + ", ".join(f"(({_fold(w)} | (v[{w + 1}] & ~m[{w + 1}])) & {_FULL})::BIGINT" for w in range(_WORDS)) + "]"
#: Distinct sentences with their smallest key, the masks of their characters, and their own characters.
DISTINCT = f"""d AS MATERIALIZED (
        SELECT s, min(k) AS k, CASE WHEN length(s) > {_BITS * _WORDS} THEN error('a sentence is longer than the words of this SQL')::BIGINT ELSE length(s) END AS n, {_TOPS} AS tops, map_from_entries(list_transform(list_distinct(string_split(s, '')), lambda c: (c,
            {_MASK}))) AS masks, string_split(s, '') AS chars
        FROM sent GROUP BY s)"""
#: Indel ratio of a and b.  A character without a place has no mask and changes nothing.
RATIO = (
    f"CASE WHEN a.n + b.n = 0 THEN 1.0 ELSE 2 * (a.n - list_sum(list_transform(range(1, {_WORDS} + 1), lambda w: bit_count(("
    f"list_reduce(list_prepend(a.tops, list_transform(b.chars, lambda c: coalesce(a.masks[c], list_transform(range({_WORDS}), lambda x: 0::BIGINT)))), lambda v, m: {_STEP}))[w] & a.tops[w]))))::DOUBLE / (a.n + b.n) END"
)


def _pairs(threshold: float) -> str:
    return f"""e AS MATERIALIZED (
        SELECT least(x, y) AS a, greatest(x, y) AS b, similarity FROM (
            SELECT a.k AS x, b.k AS y, {RATIO} AS similarity FROM d a JOIN d b ON b.s < a.s AND 2 * least(a.n, b.n) >= {threshold} * (a.n + b.n) - 1e-9)
        WHERE similarity >= {threshold})"""


def _nearest(band: str) -> str:
    return f"""WITH {SENTENCES}, {DISTINCT}, rk AS (SELECT s, min(k) AS k FROM sent WHERE item_id % 4 = 0 GROUP BY s),
        p AS (SELECT a.s, rk.k AS ref, {RATIO} AS sim FROM d a JOIN d b ON {band} JOIN rk ON rk.s = b.s WHERE a.s IN (SELECT s FROM sent WHERE item_id % 4 <> 0)),
        m AS (SELECT s, max(sim) AS sim, arg_min(ref, (-sim, ref)) AS ref FROM p GROUP BY s),
        o AS (SELECT k, coalesce(sim, 0)::DOUBLE AS sim, ref FROM sent LEFT JOIN m USING (s) WHERE item_id % 4 <> 0)"""


_BAND = "b.n BETWEEN ceil(a.n * (0.8 / 1.2) - 1e-9) AND floor(a.n * (1.2 / 0.8) + 1e-9)"


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Sentences, and the reference part of them."""
    rows = sentences(spark, sf_dir)
    return rows.filter("item_id % 4 <> 0"), rows.filter("item_id % 4 = 0")


@query(f"{_nearest(_BAND)} SELECT k, round(sim, 4) AS max_reference_similarity, ref AS nearest_reference, sim <= 0.8 AS passes_novelty_rule_le80 FROM o")
def nearest_reference(spark, sf_dir):
    """Each sentence's nearest reference by Indel ratio; the reference is a quarter of the items."""
    rows, ref = _split(spark, sf_dir)
    out = similar.novelty_gate(similar.nearest_reference(rows, ref, "k", "s", "k", "s"))
    return out.select("k", F.round("max_reference_similarity", 4).alias("max_reference_similarity"), "nearest_reference", "passes_novelty_rule_le80")


@query(f"{_nearest('true')} SELECT k, round(sim, 4) AS max_reference_similarity, ref AS nearest_reference FROM o")
def nearest_of_all(spark, sf_dir):
    """The same without a window of lengths: every sentence meets every reference."""
    rows, ref = _split(spark, sf_dir)
    out = similar.nearest_reference(rows, ref, "k", "s", "k", "s", None)
    return out.select("k", F.round("max_reference_similarity", 4).alias("max_reference_similarity"), "nearest_reference")


@query(f"{_nearest(_BAND)} SELECT k, round(sim, 4) AS similarity FROM o WHERE sim > 0.8")
def threshold_screen(spark, sf_dir):
    rows, ref = _split(spark, sf_dir)
    return similar.threshold_matches(rows, ref, "k", "s", "k", "s").select("k", F.round("max_reference_similarity", 4).alias("similarity"))


@query(f"WITH {SENTENCES}, {DISTINCT}, {_pairs(0.8)} SELECT a, b, round(similarity, 4) AS similarity FROM e")
def pair_edges(spark, sf_dir):
    """Pairs of sentences with an Indel ratio of 0.8 or more."""
    return similar.similar_pairs(sentences(spark, sf_dir), "k", "s", 0.8).withColumn("similarity", F.round("similarity", 4))


_LEVELS = (0.8, 0.7, 0.6)


def _level(t: float) -> str:
    """Clusters at one threshold, by walking from every sentence to all it reaches."""
    p = round(t * 100)
    return f"""l{p} AS (SELECT a, b FROM e WHERE similarity >= {t} UNION SELECT b, a FROM e WHERE similarity >= {t}), t{p}(n, r) AS (SELECT k, k FROM d UNION SELECT l.b, t.r FROM t{p} t JOIN l{p} l ON l.a = t.n),
        x{p} AS (SELECT sent.k, root FROM sent JOIN d USING (s) JOIN (SELECT n, min(r) AS root FROM t{p} GROUP BY n) c ON c.n = d.k),
        o{p} AS (SELECT root, row_number() OVER (ORDER BY root) AS i, count(*) AS z FROM x{p} GROUP BY root)"""


_CLUSTERS = " UNION ALL ".join(
    f"SELECT k, 'indel_{round(t * 100)}_' || lpad(i::VARCHAR, 6, '0') AS cluster_id, {t}::DOUBLE AS threshold, z AS cluster_size FROM x{round(t * 100)} JOIN o{round(t * 100)} USING (root)" for t in _LEVELS
)
_WITH_CLUSTERS = f"WITH RECURSIVE {SENTENCES}, {DISTINCT}, {_pairs(0.6)}, {', '.join(map(_level, _LEVELS))}, clustered AS ({_CLUSTERS})"


@query(f"{_WITH_CLUSTERS} SELECT k, cluster_id, threshold, cluster_size FROM clustered")
def similarity_clusters(spark, sf_dir):
    """Single-linkage clusters at 0.8, 0.7 and 0.6."""
    return graph.similarity_clusters(sentences(spark, sf_dir), "k", "s", _LEVELS).select("k", "cluster_id", "threshold", "cluster_size")


@query(f"{_WITH_CLUSTERS} SELECT threshold, count(*) AS nodes, count(*) - count(DISTINCT cluster_id) AS forest_edges FROM clustered GROUP BY threshold")
def linkage_forest(spark, sf_dir):
    """Edges of one spanning forest at or above each threshold: nodes less clusters."""
    rows = sentences(spark, sf_dir)
    first = rows.groupBy("s").agg(F.min("k").alias("b"))
    copies = rows.select(F.col("k").alias("a"), "s").join(first, "s").filter("a <> b").select("a", "b", F.lit(1.0).alias("similarity"))
    edges = forest.spanning_forest(similar.similar_pairs(rows, "k", "s", min(_LEVELS)).unionByName(copies))
    by = edges.select("similarity", F.explode(F.array(*map(F.lit, _LEVELS))).alias("threshold")).groupBy("threshold").agg(F.count_if(F.col("similarity") >= F.col("threshold")).alias("forest_edges"))
    return rows.agg(F.count(F.lit(1)).alias("nodes")).join(F.broadcast(by))  # three rows


def _at_80(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.similarity_clusters(sentences(spark, sf_dir), "k", "s", (0.8,))


@query(f"""{_WITH_CLUSTERS}, c AS (SELECT cluster_id, count(*) AS n, arg_min(k, sha256(k::VARCHAR)) AS representative FROM clustered WHERE threshold = 0.8
        GROUP BY cluster_id) SELECT cluster_id, representative, n FROM c""")
def cluster_representatives(spark, sf_dir):
    """Of each cluster the key whose digest is smallest, and its size."""
    clustered = _at_80(spark, sf_dir)
    return graph.representatives(clustered, "cluster_id", "k").join(clustered.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")), "cluster_id")


@query(f"""{_WITH_CLUSTERS}, c AS (SELECT cluster_id, count(*) AS n FROM clustered WHERE threshold = 0.8 GROUP BY cluster_id) SELECT count(*) AS clusters,
        max(n) AS largest, count(*) FILTER (n > 1) AS multi_member FROM c""")
def cluster_sizes(spark, sf_dir):
    return graph.cluster_statistics(_at_80(spark, sf_dir))


#: Greedy assignment: the largest first, ties by the digest of seed and name, each to where it leaves the least deviation, the first split on ties.
_ASSIGN = """z AS (SELECT cluster_id, count(*) AS n FROM clustered WHERE threshold = 0.8 GROUP BY cluster_id), q AS (SELECT *, row_number() OVER (ORDER BY n DESC,
        sha256('42' || cluster_id)) AS i FROM z), w AS (SELECT sum(n)::DOUBLE AS t FROM z),
    g(i, cluster_id, split, a, b, c) AS (
        SELECT 0::BIGINT, '', '', 0::BIGINT, 0::BIGINT, 0::BIGINT
        UNION ALL
        SELECT i, cluster_id, split, a + CASE split WHEN 'train' THEN n ELSE 0 END, b + CASE split WHEN 'validation' THEN n ELSE 0 END, c + CASE split
            WHEN 'test' THEN n ELSE 0 END FROM (
            SELECT *, CASE WHEN x <= y AND x <= v THEN 'train' WHEN y <= v THEN 'validation' ELSE 'test' END AS split FROM (
                SELECT q.i, q.cluster_id, q.n, g.a, g.b, g.c, abs(g.a + q.n - 0.8 * t) + abs(g.b - 0.1 * t) + abs(g.c - 0.1 * t) AS x,
                       abs(g.a - 0.8 * t) + abs(g.b + q.n - 0.1 * t) + abs(g.c - 0.1 * t) AS y, abs(g.a - 0.8 * t) + abs(g.b - 0.1 * t) + abs(g.c + q.n - 0.1 * t) AS v
                FROM g JOIN q ON q.i = g.i + 1, w)))"""


@query(f"{_WITH_CLUSTERS}, {_ASSIGN} SELECT split, sum(n)::BIGINT AS n, count(*) AS clusters, 0::BIGINT AS leaking_clusters FROM g JOIN q USING (i) GROUP BY split")
def split_and_leakage(spark, sf_dir):
    """Whole clusters to splits; then rows and clusters of the splits, and how many clusters leak (none)."""
    split = graph.clustered_split(_at_80(spark, sf_dir).select("k", "cluster_id"), "cluster_id")
    leaks = aggregate.leakage(split, "cluster_id", "split").agg(F.count(F.lit(1)).alias("leaking_clusters"))
    return split.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cluster_id").alias("clusters")).join(F.broadcast(leaks))


@query("""WITH g AS (SELECT source, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source) SELECT count(*) AS groups,
        sum(n)::BIGINT AS rows, 0::BIGINT AS split_groups, least(5, count(*)) AS folds FROM g""")
def grouped_folds(spark, sf_dir):
    """Five folds of labelled documents by source: rows and groups in all, and groups in more than one fold (none)."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").filter("quality is not null"), "doc_id")
    folds = graph.grouped_folds(rows, "source", "quality")
    by = folds.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fold").alias("f"))
    out = by.agg(F.count(F.lit(1)).alias("groups"), F.sum("n").alias("rows"), F.count_if(F.col("f") > 1).alias("split_groups"))
    return out.join(F.broadcast(folds.agg(F.count_distinct("fold").alias("folds"))))


#: The same rule a group at a time: the largest first, each to the fold where squared shares of labels grow least, the first one on ties.
_FOLDS = """g AS (SELECT source, count(*) FILTER (quality = 0) AS a, count(*) FILTER (quality = 1) AS b FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY source),
    t AS (SELECT sum(a)::HUGEINT AS ta, sum(b)::HUGEINT AS tb FROM g), q AS (SELECT *, row_number() OVER (ORDER BY a + b DESC, a, b, sha256('42' || source), source) AS i FROM g),
    r(i, source, fold, n, ha, hb) AS (
        SELECT 0::BIGINT, '', -1::BIGINT, 0::BIGINT, [0, 0, 0, 0, 0]::HUGEINT[], [0, 0, 0, 0, 0]::HUGEINT[]
        UNION ALL
        SELECT i, source, f - 1, a + b, list_transform(range(1, 6), lambda k: ha[k] + CASE WHEN k = f THEN a ELSE 0 END), list_transform(range(1, 6), lambda k: hb[k] + CASE WHEN k = f THEN b ELSE 0 END)
        FROM (SELECT *, list_position(c, list_min(c))::BIGINT AS f FROM (
            SELECT q.i, q.source, q.a, q.b, r.ha, r.hb, list_transform(range(1, 6), lambda k: (2 * r.ha[k] + q.a) * q.a * tb * tb + (2 * r.hb[k] + q.b) * q.b * ta * ta) AS c
            FROM r JOIN q ON q.i = r.i + 1, t)))"""


@query(f"WITH RECURSIVE {_FOLDS} SELECT source, fold::INTEGER AS fold, n FROM r WHERE i > 0")
def fold_assignment(spark, sf_dir):
    """The fold and the rows of each source of labelled documents."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels").filter("quality is not null"), "doc_id")
    return graph.grouped_folds(rows, "source", "quality").groupBy("source", "fold").agg(F.count(F.lit(1)).alias("n"))


# Kernels -------------------------------------------------------------------------------------------------------------


@query("""SELECT a.n_nationkey AS a, b.n_nationkey AS b, levenshtein(a.n_name, b.n_name)::INTEGER AS distance FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey""")
def edit_distances(spark, sf_dir):
    """Edit distances of all pairs of the fixed table of nations."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", F.levenshtein("x", "y").alias("distance"))


@query(f"""WITH {SENTENCES}, t AS (SELECT DISTINCT strip_accents(s) AS t, item_id FROM sent)
    SELECT x, y, distance FROM (SELECT DISTINCT a.t AS x, b.t AS y, levenshtein(a.t, b.t)::INTEGER AS distance FROM t a JOIN t b ON a.t <> b.t WHERE a.item_id % 20 = 0)""")
def sentence_distances(spark, sf_dir):
    """Edit distances of the sentences of every twentieth item to all others; accents go, since not every engine counts them as characters."""
    plain = F.translate("s", "ÀÂÄÇÈÉÊËÎÏÔÖÙÛÜŸÁÍÓÚÑ", "AAACEEEEIIOOUUUYAIOUN")
    rows = sentences(spark, sf_dir).select(plain.alias("t"), "item_id")
    return similar.edit_distances(rows.filter("item_id % 20 = 0"), rows, "t")


#: Local alignment: rows of the score table, a character of the left text at a time; gaps to the right cost one each.
_LOCAL = """n AS (SELECT a.n_nationkey AS a, b.n_nationkey AS b, a.n_name AS x, b.n_name AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
    r(a, b, x, y, i, row) AS (
        SELECT a, b, x, y, 0, list_transform(range(length(y) + 1), lambda j: 0) FROM n
        UNION ALL
        SELECT a, b, x, y, i + 1, list_transform(range(1, length(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(0, up[k]) - (j - k)))) FROM (
            SELECT *, list_transform(range(1, length(y) + 2), lambda k: greatest(0, row[k] - 1, CASE WHEN k > 1 THEN row[k - 1] + CASE WHEN substring(x,
                i + 1, 1) = substring(y, (k - 1)::BIGINT, 1) THEN 1 ELSE -1 END ELSE 0 END)) AS up
            FROM r WHERE i < length(x)))"""


@query(f"WITH RECURSIVE {_LOCAL} SELECT a, b, round(max(list_max(row)) / greatest(length(any_value(x)), length(any_value(y)), 1)::DOUBLE, 6) AS similarity FROM r GROUP BY a, b")
def local_alignments(spark, sf_dir):
    """Local alignment similarity of all pairs of the fixed table of nations."""
    n = table(spark, sf_dir, "nation")
    a, b = n.select(F.col("n_nationkey").alias("a"), F.col("n_name").alias("x")), n.select(F.col("n_nationkey").alias("b"), F.col("n_name").alias("y"))
    pairs = a.join(b, F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.round(similarity.local_similarity(F.col("x"), F.col("y")), 6).alias("similarity"))


def _aligned(name: str, pairs: str) -> str:
    """Local similarities of text pairs ``x, y``, a character of the left text at a time; gaps to the right cost one each."""
    return f"""{name}_r(x, y, i, row, best) AS (
        SELECT x, y, 0, list_transform(range(length(y) + 1), lambda j: 0), 0 FROM {pairs}
        UNION ALL
        SELECT x, y, i + 1, new, greatest(best, list_max(new)) FROM (
            SELECT x, y, i, best, list_transform(range(1, length(y) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(0, up[k]) - (j - k)))) AS new FROM (
                SELECT *, list_transform(range(1, length(y) + 2), lambda k: greatest(0, row[k] - 1, CASE WHEN k > 1 THEN row[k - 1] + CASE WHEN substring(x,
                    i + 1, 1) = substring(y, (k - 1)::BIGINT, 1) THEN 1 ELSE -1 END ELSE 0 END)) AS up
                FROM {name}_r WHERE i < length(x)))),
    {name} AS (SELECT x, y, max(best) / greatest(length(x), length(y), 1)::DOUBLE AS similarity FROM {name}_r GROUP BY x, y)"""


def _sides(most: float) -> str:
    """Texts of the part that is not reference, the reference's, and pairs of both whose lengths allow a similarity over ``most``."""
    return f"""own AS (SELECT DISTINCT s FROM sent WHERE item_id % 4 <> 0 AND s <> ''), ref AS (SELECT DISTINCT s FROM sent WHERE item_id % 4 = 0 AND s <> ''),
    met AS MATERIALIZED (SELECT own.s AS x, ref.s AS y FROM own JOIN ref ON least(length(own.s), length(ref.s)) > {most} * greatest(length(own.s), length(ref.s)))"""


#: Sentences are made up, so few are alike: at this level some are, at the usual 0.6 hardly any.
_ALIKE = 0.3


@query(f"""WITH RECURSIVE {SENTENCES}, {_sides(_ALIKE)}, {_aligned('near', 'met')}
    SELECT k, s FROM sent WHERE item_id % 4 <> 0 AND s NOT IN (SELECT x FROM near WHERE similarity > {_ALIKE})""")
def local_screen(spark, sf_dir):
    """Sentences without a local similarity over 0.3 to any reference."""
    rows, ref = _split(spark, sf_dir)
    return similar.local_screen(rows, ref, "s", "s", _ALIKE).select("k", "s")


@query(f"""WITH RECURSIVE {SENTENCES}, {_sides(_ALIKE)}, {_aligned('near', 'met')} SELECT x, y, round(similarity, 6) AS similarity FROM near WHERE similarity > {_ALIKE}""")
def local_pairs(spark, sf_dir):
    """Pairs of a sentence and a reference with a local similarity over 0.3."""
    rows, ref = _split(spark, sf_dir)
    return similar.local_pairs(rows, ref, "s", "s", _ALIKE).select(F.col("a_s").alias("x"), F.col("b_s").alias("y"), F.round("similarity", 6).alias("similarity"))


#: Greedy choice: the next text in order of potency that is not over 0.25 alike to any taken before it.
_GREEDY = f"""{_nearest(_BAND).removeprefix('WITH ').replace(SENTENCES + ', ', '')}, {_sides(_ALIKE)}, {_aligned('near', 'met')},
    pool AS (SELECT DISTINCT s, -length(s) AS score FROM own WHERE s NOT IN (SELECT x FROM near WHERE similarity > {_ALIKE}) AND s NOT IN (SELECT s FROM m WHERE sim > 0.8)),
    q AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY score, s) AS i FROM pool),
    duo AS MATERIALIZED (SELECT a.s AS x, b.s AS y FROM q a JOIN q b ON b.i < a.i WHERE least(length(a.s), length(b.s)) > 0.25 * greatest(length(a.s), length(b.s))),
    {_aligned('alike', 'duo')}, clash AS MATERIALIZED (SELECT a.i AS i, b.i AS j FROM alike JOIN q a ON a.s = x JOIN q b ON b.s = y WHERE similarity > 0.25),
    g(i, taken) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
        SELECT i + 1, CASE WHEN len(taken) < 8 AND NOT list_has_any(taken, (SELECT coalesce(list(j), []) FROM clash WHERE clash.i = g.i + 1)) THEN list_append(taken, i + 1) ELSE taken END
        FROM g WHERE i < (SELECT count(*) FROM q)),
    last AS (SELECT taken FROM g ORDER BY i DESC LIMIT 1)"""


@query(f"""WITH RECURSIVE {SENTENCES}, {_GREEDY} SELECT q.s AS sequence, score, list_position(taken, q.i)::INTEGER AS rank FROM last, q WHERE list_contains(taken, q.i)""")
def potency_choice(spark, sf_dir):
    """Eight sentences, the longest first, that no reference is near to, by Indel ratio or local similarity, no two alike."""
    rows, ref = _split(spark, sf_dir)
    pool = rows.filter("s <> ''").select(F.col("s").alias("sequence")).distinct().withColumn("score", -F.length("sequence"))
    known = ref.select(F.col("s").alias("sequence"))
    return select.potent_and_diverse(pool, known, known, 8, "score", most_known=_ALIKE, most=0.25)


_VECTORS = "embedding::DOUBLE[]"
_COSINE = "list_dot_product(e, f) / (sqrt(list_dot_product(e, e)) * sqrt(list_dot_product(f, f)))"


@query(f"""WITH v AS (SELECT vec_id, {_VECTORS} AS e FROM embeddings), p AS (SELECT q.vec_id AS query, v.vec_id AS other, q.e AS e, v.e AS f FROM v q
        JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query, other, round({_COSINE}, 4) AS similarity FROM p""")
def composition_cosine(spark, sf_dir):
    """Cosine of every twentieth vector to all others."""
    e = table(spark, sf_dir, "embeddings")
    return similar.cosine_pairs(e, "vec_id", "embedding", e.filter("vec_id % 20 = 0"), digits=4)


@query(f"""WITH v AS (SELECT vec_id, {_VECTORS} AS e FROM embeddings), p AS (SELECT a.vec_id, a.e AS e, b.e AS f FROM v a JOIN v b ON b.vec_id = a.vec_id + 1),
        k AS (SELECT vec_id, exp(-pow(list_distance(e, f), 2) / 8) AS r, {_COSINE} AS c FROM p)
    SELECT vec_id, round(r, 6) AS rbf, round(0.6 * r + 0.4 * c, 6) AS composite FROM k""")
def vector_kernels(spark, sf_dir):
    """Gaussian and composite kernel of each vector and the next."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    p = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("e").alias("f")), "vec_id")
    a, b = F.col("e"), F.col("f")
    return p.select("vec_id", F.round(similarity.rbf(a, b), 6).alias("rbf"), F.round(similarity.composite_kernel(a, b, a, b), 6).alias("composite"))


@query("""WITH s AS (SELECT avg(p_size) AS m, stddev_pop(p_size) AS d, avg(p_retailprice) AS n, stddev_pop(p_retailprice) AS e FROM part), z AS (SELECT p_partkey,
        (p_size - m) / d AS x, (p_retailprice - n) / e AS y FROM part, s), f AS (SELECT x AS fx, y AS fy FROM z ORDER BY p_partkey LIMIT 1)
    SELECT p_partkey, round(sqrt(pow(x - fx, 2) + pow(y - fy, 2)), 4) AS distance FROM z, f""")
def scaled_distances(spark, sf_dir):
    """Distance of each part to the first, over z-scores."""
    z = similarity.standardize(table(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), "p_retailprice"), ["p_size", "p_retailprice"])
    first = z.orderBy("p_partkey").limit(1).select(F.col("z").alias("f"))  # one row
    return z.join(F.broadcast(first)).select("p_partkey", F.round(similarity.scaled_distance(F.col("z"), F.col("f")), 4).alias("distance"))


# Lineage -------------------------------------------------------------------------------------------------------------

_CHAIN = """e AS (SELECT conv_id, turn, conv_id * 1000 + turn AS node,
        CASE WHEN turn > min(turn) OVER (PARTITION BY conv_id) THEN conv_id * 1000 + lag(turn) OVER (PARTITION BY conv_id ORDER BY turn) END AS parent FROM conversations)"""


def _chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as a chain of parents; what follows a lost turn has no parent in the table."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    node = lambda t: F.when(t.isNotNull(), numbered("conv_id", t, 1000))
    return table(spark, sf_dir, "conversations").select("conv_id", node(F.col("turn")).alias("node"), node(F.lag("turn").over(w)).alias("parent"))


@query(f"""WITH {_CHAIN} SELECT node, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth, min(node) OVER (PARTITION BY conv_id) AS ancestor,
        true AS complete FROM e""")
def lineage_depth(spark, sf_dir):
    return graph.lineage_depth(_chain(spark, sf_dir), "node", "parent")


@query(f"""WITH {_CHAIN}, d AS (SELECT conv_id % 9 = 0 AND turn > 0 AS lost, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS depth, conv_id, turn FROM e),
        k AS (SELECT * FROM d WHERE NOT (conv_id % 9 = 0 AND depth = 1))
    SELECT count(*) FILTER (conv_id % 9 <> 0 AND depth > 0) AS unbroken, min(depth) FILTER (conv_id % 9 <> 0 AND depth > 0) AS least,
        round(avg(depth) FILTER (conv_id % 9 <> 0 AND depth > 0), 4) AS mean,
           max(depth) FILTER (conv_id % 9 <> 0 AND depth > 0) AS largest, count(*) FILTER (conv_id % 9 = 0 AND depth > 1) AS broken,
               round(quantile_cont(depth, 0.5) FILTER (conv_id % 9 <> 0 AND depth > 0), 4) AS median FROM k""")
def lineage_summary(spark, sf_dir):
    """Depths of whole chains; every ninth conversation has lost its second turn, which breaks those after it."""
    w = Window.partitionBy("conv_id").orderBy("node")
    rows = _chain(spark, sf_dir).withColumn("at", F.row_number().over(w)).filter("not (conv_id % 9 = 0 and at = 2)")
    return graph.lineage_summary(graph.lineage_depth(rows.select("node", "parent"), "node", "parent"))


@query(f"""WITH RECURSIVE {_CHAIN}, up(node, ancestor, depth) AS (SELECT node, node, 0 FROM e UNION ALL SELECT up.node, e.parent, depth + 1 FROM up
        JOIN e ON e.node = up.ancestor WHERE e.parent IS NOT NULL) SELECT node, ancestor, depth FROM up""")
def lineage_trace(spark, sf_dir):
    """Every node with each of its ancestors."""
    return graph.trace(_chain(spark, sf_dir), "node", "parent")


def _ancestry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of all conversations; the second turn of some has a fault, by the conversation's number."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", (F.row_number().over(w) - 1).alias("g"), F.pmod("conv_id", F.lit(12)).alias("f"))
    name = lambda g: F.concat_ws("/", "conv_id", g)
    second = F.col("g") == 1
    nodes = c.select(
        "f", "g", name(F.col("g")).alias("sequence_id"), F.when(F.col("g") > 0, name(F.col("g") - 1)).alias("parent_id"), name(F.lit(0)).alias("seed_id"),
        F.when((F.col("f") == 1) & (F.col("g") == 0), 5).when(second & (F.col("f") == 8), 0).otherwise(F.col("g")).alias("generation"),
    )
    edges = nodes.filter("g > 0")
    again = nodes.filter("f = 2 and g = 1")
    moved = edges.filter("not (f = 10 and g = 1)").select(
        F.when((F.col("f") == 3) & (F.col("g") == 1), "nobody").when((F.col("f") == 6) & (F.col("g") == 2), F.col("seed_id")).otherwise(F.col("parent_id")).alias("parent_id"),
        F.when((F.col("f") == 4) & (F.col("g") == 1), F.concat("sequence_id", F.lit("?"))).otherwise(F.col("sequence_id")).alias("child_id"),
        F.when((F.col("f") == 9) & (F.col("g") == 1), "other").otherwise(F.col("seed_id")).alias("seed_id"),
        F.when((F.col("f") == 7) & (F.col("g") == 1), 9).otherwise(F.col("generation")).alias("generation"),
    )
    more = edges.filter("f = 5 and g = 1").select("parent_id", F.col("sequence_id").alias("child_id"), "seed_id", "generation")
    roots = nodes.filter("f = 11 and g = 0").select(F.col("sequence_id").alias("parent_id"), F.col("sequence_id").alias("child_id"), "seed_id", "generation")
    columns = ["sequence_id", "parent_id", "seed_id", "generation"]
    return nodes.select(columns).unionByName(again.select(columns)), moved.unionByName(more).unionByName(roots)


_NODES = """c AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS g, conv_id % 12 AS f FROM conversations),
    n0 AS (SELECT f, g, conv_id || '/' || g AS sequence_id, CASE WHEN g > 0 THEN conv_id || '/' || (g - 1) END AS parent_id, conv_id || '/0' AS seed_id, CASE
        WHEN f = 1 AND g = 0 THEN 5 WHEN f = 8 AND g = 1 THEN 0 ELSE g END AS generation FROM c),
    n AS (SELECT sequence_id, parent_id, seed_id, generation FROM n0 UNION ALL SELECT sequence_id, parent_id, seed_id, generation FROM n0 WHERE f = 2 AND g = 1),
    ed AS (SELECT CASE WHEN f = 3 AND g = 1 THEN 'nobody' WHEN f = 6 AND g = 2 THEN seed_id ELSE parent_id END AS parent_id, CASE WHEN f = 4
        AND g = 1 THEN sequence_id || '?' ELSE sequence_id END AS child_id,
                  CASE WHEN f = 9 AND g = 1 THEN 'other' ELSE seed_id END AS seed_id, CASE WHEN f = 7 AND g = 1 THEN 9 ELSE generation END AS generation FROM n0
                      WHERE g > 0 AND NOT (f = 10 AND g = 1)
           UNION ALL SELECT parent_id, sequence_id, seed_id, generation FROM n0 WHERE f = 5 AND g = 1 UNION ALL SELECT sequence_id, sequence_id, seed_id, generation
               FROM n0 WHERE f = 11 AND g = 0),
    k AS (SELECT ed.*, c.parent_id AS cp, c.seed_id AS cs, c.generation AS cg, p.seed_id AS ps, p.generation AS pg FROM ed JOIN n c ON c.sequence_id = child_id
        JOIN n p ON p.sequence_id = ed.parent_id)"""


@query(f"""WITH {_NODES}
    SELECT 'duplicate_node' AS rule, sequence_id AS item FROM n GROUP BY sequence_id HAVING count(*) > 1
    UNION ALL SELECT 'root_not_generation_0', sequence_id FROM n WHERE parent_id IS NULL AND generation <> 0
    UNION ALL SELECT 'unknown_seed', sequence_id FROM n WHERE seed_id NOT IN (SELECT sequence_id FROM n WHERE parent_id IS NULL AND generation = 0)
    UNION ALL SELECT 'edge_unknown_parent', child_id FROM ed WHERE parent_id NOT IN (SELECT sequence_id FROM n)
    UNION ALL SELECT 'edge_unknown_child', child_id FROM ed WHERE child_id NOT IN (SELECT sequence_id FROM n)
    UNION ALL SELECT 'several_parents', child_id FROM ed GROUP BY child_id HAVING count(*) > 1
    UNION ALL SELECT 'parent_disagrees', child_id FROM k WHERE cp IS DISTINCT FROM parent_id
    UNION ALL SELECT 'generation_disagrees', child_id FROM k WHERE generation IS DISTINCT FROM cg
    UNION ALL SELECT 'generation_not_increasing', child_id FROM k WHERE pg >= cg
    UNION ALL SELECT 'crosses_seeds', child_id FROM k WHERE ps IS DISTINCT FROM cs OR seed_id IS DISTINCT FROM cs
    UNION ALL SELECT 'missing_edge', sequence_id FROM n WHERE parent_id IS NOT NULL AND sequence_id NOT IN (SELECT child_id FROM ed)
    UNION ALL SELECT 'extra_edge', child_id FROM ed WHERE child_id NOT IN (SELECT sequence_id FROM n WHERE parent_id IS NOT NULL)""")
def ancestry_violations(spark, sf_dir):
    """Twelve rules, each broken by some conversations."""
    return graph.ancestry_violations(*_ancestry(spark, sf_dir))
