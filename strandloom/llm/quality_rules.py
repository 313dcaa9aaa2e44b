"""Quality rules: base counts, and divergence of a document from its language.

Only DataFrame functions.  One pass over the texts takes every count of a document; its small result is written once.
From it come the references, one row of sums for each language, over all documents that pass the base rules: shares of
character classes for every language in the data, shares of common words for those that have a list of them.  A second,
narrow pass joins each document's histograms to the reference of its language and takes Jensen-Shannon distances.

Nothing is exploded: windows of five words are hashed inside the row; only where a hash repeats are windows sorted, and
those whose hash repeats are compared by their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandloom.llm.common import SPACE, materialize

#: Common words by language, the most common first.  Fixed values.
COMMON = {
    "en": "the of and to a in is that it for was on with as be by this are at from",
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas avec",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein als eine",
    "es": "de la que el en y los se del las un por con no una su para es al lo",
}
WORDS = tuple(dict.fromkeys(w for words in COMMON.values() for w in words.split()))
WINDOW = 5
#: A document with fewer words fails; one with fewer than this is not compared to a language.
LEAST_WORDS, GUARD_WORDS, GUARD_CHARS = 10, 100, 300
#: Percent of words in repeated windows above which a document fails.
MOST_REPEATED = 20
#: Largest Jensen-Shannon distances that pass: of character classes and of common words.
MOST_CHARS, MOST_WORDS = 0.26, 0.29
_BLANK = " \t\n\x0b\f\r"
SYMBOLS = r"[#*$%&|<>]"
#: Capitals, digits, punctuation, symbols, characters outside ASCII, all others.
N_CLASSES = 6


def _window_hash(words: list[Column]) -> Column:
    return F.xxhash64(*words)


def _neighbour(held: Column, field: str):
    """Whether an element of a sorted array has the same ``field`` as one beside it."""

    def same(x: Column, i: Column) -> Column:
        before, after = (F.coalesce(F.get(held, at)[field] == x[field], F.lit(False)) for at in (i - 1, i + 1))
        return before | after

    return same


def _with_repeats(rows: DataFrame) -> DataFrame:
    """``rows`` with ``n_repeat_words``, from ``_ws`` and its windows' hashes ``_win``.

    Windows whose hash repeats are sorted by their words, and those whose words repeat are taken in order: each adds the
    words that none before it covers.
    """
    pairs = F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    rows = rows.withColumn("_again", F.size(F.array_distinct("_win")) < F.size("_win"))
    rows = rows.withColumn("_tagged", F.when(F.col("_again"), F.array_sort(pairs)))
    said = lambda x: F.struct(F.concat_ws(" ", *[F.get("_ws", x["i"] + k) for k in range(WINDOW)]).alias("words"), x["i"].alias("i"))
    rows = rows.withColumn("_said", F.array_sort(F.transform(F.filter("_tagged", _neighbour(F.col("_tagged"), "h")), said)))
    places = F.array_sort(F.transform(F.filter("_said", _neighbour(F.col("_said"), "words")), lambda x: x["i"]))
    start = F.struct(F.lit(-WINDOW).alias("last"), F.lit(0).alias("n"))
    total = F.aggregate(places, start, lambda acc, p: F.struct(p.alias("last"), (acc["n"] + F.least(F.lit(WINDOW), p - acc["last"])).alias("n")), lambda acc: acc["n"])
    return rows.withColumn("n_repeat_words", F.when(F.col("_again"), total).otherwise(F.lit(0)).cast("long"))


def counts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``_id, _lang``, the base counts, ``classes`` (characters by class) and ``common`` (counts of ``WORDS``, then of all others)."""
    rows = docs.select(F.col(id_col).alias("_id"), F.col(lang).cast("string").alias("_lang"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    rows = rows.withColumn("_trim", F.btrim("_text", F.lit(_BLANK)))
    rows = rows.withColumn("_ws", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACE)))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.btrim(x, F.lit(_BLANK)) != "")
    n = F.size("_ws")
    windows = F.when(n >= WINDOW, F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: _window_hash([F.get("_ws", i + k) for k in range(WINDOW)]))).otherwise(F.array().cast("array<bigint>"))
    rows = rows.select(
        "_id", "_lang", "_ws", n.cast("long").alias("n_words"), F.array_join("_ws", "").alias("_joined"),
        lines.alias("_lines"), windows.alias("_win"), F.filter("_ws", lambda w: w.isin(*WORDS)).alias("_cw"),
    )
    wide = F.when(F.octet_length("_joined") > F.length("_joined"), F.length(F.regexp_replace("_joined", r"[\x00-\x7F]+", ""))).otherwise(F.lit(0))
    rows = rows.select(
        "_id", "_lang", "_ws", "_win", "n_words", F.length("_joined").cast("long").alias("word_chars"), F.regexp_count("_joined", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_joined", F.lit(r"[A-Z]")).cast("long").alias("_upper"), F.regexp_count("_joined", F.lit(r"[0-9]")).cast("long").alias("_digit"),
        F.regexp_count("_joined", F.lit(r"[.,;:!?'\"()\-]")).cast("long").alias("_punct"), wide.cast("long").alias("_wide"),
        F.transform(F.array(*map(F.lit, WORDS)), lambda w: F.size("_cw") - F.size(F.array_remove("_cw", w))).alias("common"),
    )
    letters = F.col("word_chars") - F.col("_upper") - F.col("_digit") - F.col("_punct") - F.col("n_symbols") - F.col("_wide")
    return _with_repeats(rows).select(
        "_id", "_lang", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.array("_upper", "_digit", "_punct", "n_symbols", "_wide", letters.cast("long")).alias("classes"),
        F.concat("common", F.array((F.col("n_words") - F.aggregate("common", F.lit(0), lambda a, x: a + x)).cast("int"))).cast("array<bigint>").alias("common"),
    )


def failed(n_words: Column, n_repeat: Column) -> Column:
    """The base rule: too few words, or too many of them in repeated windows."""
    return (n_words < LEAST_WORDS) | (100 * n_repeat > MOST_REPEATED * n_words)


def references(counted: DataFrame) -> DataFrame:
    """``_of, _chars, _words``: for each language, null among them, the shares of character classes and of common words over
    all documents that pass the base rules; ``_words`` is null for a language without a list.

    ``counted`` has to be a table that was written: its arrays are read element by element.
    """
    passed = counted.filter(~failed(F.col("n_words"), F.col("n_repeat_words")))
    sums = [F.sum(F.get("classes", F.lit(i))).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(len(WORDS) + 1)]
    shares = lambda key, n, total: F.transform(F.array(*[f"{key}{i}" for i in range(n)]), lambda x: x.cast("double") / F.col(total))
    by = passed.groupBy("_lang").agg(*sums, F.sum("word_chars").alias("_tc"), F.sum("n_words").alias("_tw"))  # passing documents have words
    return by.select(F.col("_lang").alias("_of"), shares("c", N_CLASSES, "_tc").alias("_chars"), F.when(F.col("_lang").isin(*COMMON), shares("w", len(WORDS) + 1, "_tw")).alias("_words"))


def distance(held: Column, total: Column, reference: Column) -> Column:
    """Jensen-Shannon distance (base 2) of an array of counts, whose sum is ``total``, to shares; null where there are none.

    One step an item: sum and shares come as columns.
    """
    part = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(F.lit(0.0))
    terms = F.zip_with(held, reference, lambda x, q: part(x / total, (x / total + q) / 2) + part(q, (x / total + q) / 2))
    return F.when((total > 0) & reference.isNotNull(), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(terms, F.lit(0.0), lambda a, x: a + x) / 2)))


def judge(docs: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang", most_chars: float = MOST_CHARS, most_words: float = MOST_WORDS) -> DataFrame:
    """One row a document: ``id_col, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    char_distance, word_distance``.

    A document is kept if it passes the base rule and is near its language: its distance by character classes is at
    most ``most_chars`` and by common words at most ``most_words``.  Every language in the data has a reference for
    character classes, a null language being one of its own; languages without a list of common words are not compared
    by words.  Histograms of fewer than ``GUARD_CHARS`` characters or ``GUARD_WORDS`` words are not compared, nor are
    those of a language of which no document passes the base rule.  Null text counts as empty and fails the base rule.
    Windows are equal when their words are.  A reference is the mean of what passes the base rule, so where most of a
    language is junk that passes it, the junk is the reference and good documents are the distant ones.  A very long text
    is counted whole, in its row.  Repeated rows come out repeated; other columns are not read; an empty table gives an
    empty result.
    """
    counted = materialize(counts(docs, id_col, text, lang), "quality-counts")
    known = materialize(references(counted), "quality-references")  # one row a language: Spark knows its size
    out = counted.join(known, F.col("_lang").eqNullSafe(F.col("_of")), "left")
    out = out.withColumn("char_distance", F.when(F.col("word_chars") >= GUARD_CHARS, distance(F.col("classes"), F.col("word_chars"), F.col("_chars"))))
    out = out.withColumn("word_distance", F.when(F.col("n_words") >= GUARD_WORDS, distance(F.col("common"), F.col("n_words"), F.col("_words"))))
    near = (F.coalesce("char_distance", F.lit(0.0)) <= most_chars) & (F.coalesce("word_distance", F.lit(0.0)) <= most_words)
    bad = failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.select(F.col("_id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", bad.alias("base_failed"), (~bad & near).alias("kept"), "char_distance", "word_distance")
