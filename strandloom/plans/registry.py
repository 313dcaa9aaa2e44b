"""Registration of queries, and what their SQL shares.

The test tables hold no biological sequences.  ``derived`` cuts every whole text of ``documents`` into its sentences.
Every other one is kept as it is, with lower-case letters, blanks and foreign characters; of the rest only residue
letters are kept.  So records may be empty, short, long, of a bad alphabet, of lower case or described as modified, and
no character of a text is left out.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions import batches, biophysics, sequence
from strandloom.storage import materialize, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL where there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


#: What each application has written of ``derived``, by input folder, and from which files.
_written: dict[tuple[str, str], tuple[tuple[str, ...], DataFrame]] = {}
#: Records of a document: its number times this, plus a place, names one.
MOST_RECORDS = 1_000_000


def numbered(owner: str, place: Column, most: int) -> Column:
    """One number for an owner and a place below ``most``; an error beyond, since two rows would have one."""
    at = F.when(place < most, place).otherwise(F.raise_error(F.lit(f"more than {most} places in one {owner}")).cast("int"))
    return F.col(owner) * most + at


def derived(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``rec_id, doc_id, pos, lang, source, raw, meta, s``: a record for each sentence of each document.

    ``raw`` is the record's text, ``meta`` its free-text description, ``s`` the normal form of ``raw``.  Written once a
    session and set of input files, since some fifty queries read it.  Documents are dealt over tasks before they are cut,
    and ``s`` is written only where it is not ``raw``.
    """
    key, docs = (spark.sparkContext.applicationId, sf_dir), table(spark, sf_dir, "documents")
    files = tuple(sorted(docs.inputFiles()))
    if key not in _written or _written[key][0] != files or not _there(spark, _written[key][1]):
        piece = F.split(F.replace(F.coalesce("text", F.lit("")), F.lit("ß"), F.lit("sz")), r"[.!?\n]+")
        rows = docs.select("doc_id", "lang", "source", "text").repartition("doc_id").select("doc_id", "lang", "source", F.posexplode(piece).alias("pos", "piece"))
        whole = (F.col("doc_id") + F.col("pos")) % 2 == 0
        raw = F.when(whole, F.col("piece")).otherwise(batches.residues_only(F.when(whole, None).otherwise(F.col("piece"))))
        meta = F.when(F.col("pos") % 13 == 0, "C-terminal amidation").when(F.col("pos") % 13 == 1, "PEGylated (AMD)").when(F.col("pos") % 13 == 2, "").otherwise(F.col("source"))
        rows = rows.select(numbered("doc_id", F.col("pos"), MOST_RECORDS).alias("rec_id"), "doc_id", "pos", "lang", "source", raw.alias("raw"), meta.alias("meta"))
        s = sequence.norm(F.col("raw"))
        held = materialize(rows.withColumn("s", F.when(s != F.col("raw"), s)), "derived")
        _written[key] = files, held.withColumn("s", F.coalesce("s", "raw"))
    return _written[key][1]


def _there(spark: SparkSession, df: DataFrame) -> bool:
    """Whether a written table has not been deleted since."""
    files = df.inputFiles()
    if not files:
        return False
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(files[0])
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def canonical_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of residues only, of any length."""
    return derived(spark, sf_dir).filter(sequence.canonical(F.col("s")))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A candidate table: one row for each valid sequence, that of its first record, with descriptors and made-up scores."""
    from strandloom.operators import curate

    rows = curate.first_wins(canonical_records(spark, sf_dir).filter(F.length("s").between(8, 50)).select("s", "rec_id", "doc_id", "lang"), ["s"], ["rec_id"])
    s, k = F.col("s"), F.col("rec_id")
    return rows.select(
        "rec_id", s.alias("sequence"), F.col("lang").alias("primary_domain"), F.length(s).alias("length"), biophysics.net_charge(s).alias("net_charge_ph7"),
        biophysics.hydrophobic_moment(s).alias("eisenberg_moment"), biophysics.isoelectric_point(s).alias("isoelectric_point"), biophysics.gravy(s).alias("gravy"),
        biophysics.boman_index(s).alias("boman_index"), biophysics.instability_index(s, PAIR_WEIGHTS).alias("instability_index"),
        (k % 97 / 97.0).alias("pred_amp_probability"), (k % 89 / 89.0).alias("pred_toxicity_risk"), (k % 9 / 10.0).alias("max_reference_similarity"),
        F.round(k % 97 / 97.0 - k % 89 / 178.0, 4).alias("lcb_quality"), (k % 3 != 0).alias("synthesizable"),
    )


#: A pair table made by a rule: the operator takes the published one as a parameter.
PAIR_WEIGHTS = {a + b: float((7 * i + 13 * j) % 59 - 20) for i, a in enumerate(sequence.RESIDUES) for j, b in enumerate(sequence.RESIDUES)}

# SQL -----------------------------------------------------------------------------------------------------------------

#: The records of ``derived``.
SEQ = r"""pieces AS (
        SELECT doc_id, lang, source, unnest(range(len(x))) AS pos, unnest(x) AS piece
        FROM (SELECT doc_id, lang, source, regexp_split_to_array(replace(coalesce(text, ''), 'ß', 'sz'), '[.!?\n]+') AS x FROM documents)),
    records AS (
        SELECT doc_id * 1000000 + pos AS rec_id, doc_id, pos, lang, source,
               CASE WHEN (doc_id + pos) % 2 = 0 THEN piece ELSE upper(regexp_replace(piece, '[^AC-IK-NP-TVWYac-ik-np-tvwy]', '', 'g')) END AS raw,
               CASE pos % 13 WHEN 0 THEN 'C-terminal amidation' WHEN 1 THEN 'PEGylated (AMD)' WHEN 2 THEN '' ELSE source END AS meta
        FROM pieces),
    seq AS MATERIALIZED (SELECT *, upper(regexp_replace(raw, '\s+', '', 'g')) AS s FROM records)"""
#: Of residues only; a valid sequence; a record whose sequence the reference part holds.
GOOD = f"regexp_matches(s, '^[{sequence.RESIDUES}]+$')"
VALID = f"({GOOD} AND length(s) BETWEEN 8 AND 50)"
HIT = "s IN (SELECT x.s FROM seq x WHERE x.doc_id % 5 = 0)"


def rounded(x: str, digits: int) -> str:
    """Rounding of the decimal that a double prints as, halves away from zero."""
    return f"round(({x})::VARCHAR::DECIMAL(38, 18), {digits})::DOUBLE"


def linear(scale: dict[str, float]) -> str:
    """Sum of a scale over the residues of ``s``."""
    return " + ".join(f"(length(s) - length(replace(s, '{r}', ''))) * ({v}::DOUBLE)" for r, v in scale.items() if v)


def count(residues: str) -> str:
    return f"(length(s) - length(translate(s, '{residues}', '')))"


def charge(ph: str) -> str:
    plus = f"1 / (1 + pow(10.0::DOUBLE, {ph} - 9.69::DOUBLE)) + " + " + ".join(f"{count(r)} * (1 / (1 + pow(10.0::DOUBLE, {ph} - {p}::DOUBLE)))" for r, p in biophysics.POSITIVE.items())
    minus = f"1 / (1 + pow(10.0::DOUBLE, 2.34::DOUBLE - {ph})) + " + " + ".join(f"{count(r)} * (1 / (1 + pow(10.0::DOUBLE, {p}::DOUBLE - {ph})))" for r, p in biophysics.NEGATIVE.items())
    return f"round({plus} - ({minus}), 4)"


CHARGE = charge("7.4::DOUBLE")
MASS = f"round({linear(biophysics.MASS)} + 18.0153::DOUBLE, 4)"
BOMAN = rounded(f"(0.0::DOUBLE + {linear(biophysics.TRANSFER)}) / length(s)", 2)
GRAVY = f"round(({linear(biophysics.HYDROPATHY)}) / length(s), 6)"
_PLACE = f"strpos('{sequence.RESIDUES}', substring(s, i{{}}, 1)) - 1"
INSTABILITY = f"""round(10 * coalesce(list_sum(list_transform(range(1, length(s)),
        lambda i: (7 * ({_PLACE.format('')}) + 13 * ({_PLACE.format(' + 1')})) % 59 - 20)), 0)::DOUBLE / length(s), 6)"""
_SCALE = "[" + ", ".join(f"{biophysics.CONSENSUS[r]}::DOUBLE" for r in sequence.RESIDUES) + "]"
_SIDE = lambda f: f"list_sum(list_transform(range(0, w), lambda j: {_SCALE}[strpos('{sequence.RESIDUES}', substring(s, i + j, 1))] * {f}(radians(100.0 * j))))"
#: Per canonical sequence, the moment: the largest of its windows.
MOMENTS = f"""windows AS (SELECT DISTINCT s, least(length(s), 11) AS w FROM seq WHERE {GOOD}),
    spots AS (SELECT s, w, unnest(range(1, length(s) - w + 2)) AS i FROM windows),
    moments AS MATERIALIZED (SELECT s, round(max(sqrt(pow({_SIDE('cos')}, 2) + pow({_SIDE('sin')}, 2)) / w), 6) AS moment FROM spots GROUP BY s)"""
#: Per canonical sequence, the isoelectric point, by bisection (recursive).
POINTS = f"""d AS (SELECT DISTINCT s FROM seq WHERE {GOOD}), b(s, lo, hi, k) AS (
        SELECT s, 0.0::DOUBLE, 14.0::DOUBLE, 0 FROM d
        UNION ALL
        SELECT s, CASE WHEN up THEN mid ELSE lo END, CASE WHEN up THEN hi ELSE mid END, k + 1
        FROM (SELECT *, {charge('mid')} > 0 AS up FROM (SELECT *, (lo + hi) / 2 AS mid FROM b WHERE k < 50))),
    points AS (SELECT s, round((lo + hi) / 2, 4) AS point FROM b WHERE k = 50)"""
_REPEAT4 = "|".join(f"{r}{{4,}}" for r in sequence.RESIDUES)
#: The first obstacle to synthesis, from ``s`` and its ``moment``.
SYNTHESIS = f"""CASE WHEN NOT {GOOD} THEN 'invalid_residue' WHEN length(s) NOT BETWEEN 8 AND 50 THEN 'length_out_of_range'
        WHEN regexp_matches(s, '[VILFWM]{{5,}}') THEN 'hydrophobic_run' WHEN regexp_matches(s, '{_REPEAT4}') THEN 'polyrepeat'
        WHEN moment > 0.6 AND {CHARGE} < 1 THEN 'aggregation_risk' WHEN {CHARGE} < 1 THEN 'insufficient_charge'
        WHEN {count('C')} = 1 THEN 'warn_unpaired_cys' ELSE 'ok' END"""
#: The first record of each valid sequence, with the made-up scores of ``candidates``.
CANDIDATES = f"""valid AS (SELECT s, min(rec_id) AS rec_id FROM seq WHERE {VALID} GROUP BY s),
    candidates AS (
        SELECT rec_id, s, lang AS primary_domain, length(s) AS length, rec_id % 97 / 97.0::DOUBLE AS amp, rec_id % 89 / 89.0::DOUBLE AS tox,
               rec_id % 9 / 10.0::DOUBLE AS similarity, {rounded('rec_id % 97 / 97.0::DOUBLE - rec_id % 89 / 178.0::DOUBLE', 4)} AS quality, rec_id % 3 <> 0 AS synthesizable
        FROM valid JOIN seq USING (s, rec_id))"""
