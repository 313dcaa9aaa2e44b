"""Queries on ranking, top-k, samples and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandloom.operators import curate, ranking
from strandloom.plans.registry import SEQ, VALID, derived, query
from strandloom.storage import table


def _orders(spark, sf_dir, *columns: str):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", *columns)


def _by_price():
    return [F.desc("o_totalprice"), F.asc("o_orderkey")]


@query("""SELECT * FROM (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC,
        o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3""")
def topk_per_group(spark, sf_dir):
    return ranking.top_k_per_group(_orders(spark, sf_dir, "o_custkey"), ["o_custkey"], _by_price(), 3)


@query("""SELECT o_orderpriority, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
    WHERE r <= 20 ORDER BY o_totalprice DESC, o_orderkey LIMIT 50""")
def two_level_topk(spark, sf_dir):
    return ranking.two_level_top_k(_orders(spark, sf_dir, "o_orderpriority"), "o_orderpriority", _by_price(), 20, 50).drop("rank")


@query("""WITH g AS (SELECT p_brand FROM part GROUP BY p_brand ORDER BY count(*) DESC, p_brand LIMIT 5), r AS (SELECT p_brand, p_partkey,
        row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey)::INTEGER AS rank FROM part)
    SELECT p_brand, p_partkey, rank FROM r WHERE p_brand IN (SELECT p_brand FROM g) AND rank <= 4""")
def largest_families(spark, sf_dir):
    """The first four of each of the five largest families."""
    return ranking.first_of_largest(table(spark, sf_dir, "part").select("p_brand", "p_partkey"), "p_brand", [F.asc("p_partkey")])


@query("SELECT p_partkey FROM (SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 ELSE 1 END AS t FROM part ORDER BY t, p_partkey LIMIT 100)")
def backfill_n(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    return ranking.backfill(p.filter("p_size = 1"), p, "p_partkey", 100, ["p_partkey"]).select("p_partkey")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) + 100 AS rank FROM orders")
def assigned_ranks(spark, sf_dir):
    return ranking.assign_ranks(_orders(spark, sf_dir), _by_price(), 101).select("o_orderkey", "rank")


@query("""WITH r AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS position FROM orders) SELECT o_orderkey, position,
        position <= 50 AS is_nested FROM r""")
def ordered_prefix(spark, sf_dir):
    """All rows in a total order with their position, and the first fifty marked as the nested part."""
    out = curate.stable_order(_orders(spark, sf_dir), "o_totalprice", "o_orderkey")
    return ranking.nested_prefix(out, "position").select("o_orderkey", "position", "is_nested")


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r
        FROM orders) WHERE r = 1""")
def best_per_key(spark, sf_dir):
    return curate.best_of(_orders(spark, sf_dir, "o_custkey"), ["o_custkey"], "o_totalprice", ["o_orderkey"]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT c_custkey, 'missing' AS problem FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
    UNION ALL SELECT DISTINCT o_custkey, 'extra' FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)""")
def coverage_gap(spark, sf_dir):
    return ranking.coverage_gap(table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("""SELECT count(*) = 0 OR (min(event_id + 1 - (SELECT min(event_id) FROM events)) = 1 AND max(event_id + 1 - (SELECT min(event_id) FROM events)) = count(*)
    AND count(DISTINCT event_id) = count(*)) AS contiguous, count(*) AS rows FROM events""")
def contiguous_index(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    first = e.agg(F.min("event_id")).first()[0]
    return ranking.contiguous(e.select((F.col("event_id") - first + 1).alias("i")), "i")


@query(f"""WITH {SEQ}, v AS (SELECT DISTINCT s, doc_id % 2 AS side FROM seq WHERE {VALID})
    SELECT (SELECT count(*) FROM (SELECT s FROM v WHERE side = 0 INTERSECT SELECT s FROM v WHERE side = 1)) AS shared,
           (SELECT count(*) FROM v WHERE side = 0 AND s NOT IN (SELECT s FROM v WHERE side = 1)) AS outside""")
def partition_overlap(spark, sf_dir):
    """Sequences that two halves share, and those of the first that the second lacks."""
    from strandloom.functions import sequence

    v = derived(spark, sf_dir).filter(sequence.first_reason(F.col("s")) == "ok").select("s", F.pmod("doc_id", F.lit(2)).alias("side")).distinct()
    a, b = v.filter("side = 0"), v.filter("side = 1")
    return ranking.intersection_size(a, b, "s").join(F.broadcast(ranking.is_subset(a, b, "s")))  # single rows


@query("""WITH m AS (SELECT quality, min(n) OVER () AS k FROM (SELECT quality, count(*) AS n FROM labels WHERE quality IS NOT NULL GROUP BY quality)) SELECT quality,
        k AS n, k AS distinct_rows FROM m""")
def balanced_pairs(spark, sf_dir):
    """As many rows of each label as the rarest has; which rows is a matter of hashes, tested apart."""
    out = ranking.balanced_sample(table(spark, sf_dir, "labels").filter("quality is not null"), "quality", "doc_id")
    return out.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("doc_id").alias("distinct_rows"))
