"""Sequence text: normal form, identifiers, validity, screens and motifs, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandloom.functions import batches

#: The twenty canonical residues.
RESIDUES = batches.RESIDUES
SHORTEST, LONGEST = 8, 50
#: Words in free text that tell of a modified sequence.  Fixed values.
MODIFIED = ("amidat", "acetyl", "lipid", "glycosyl", "peg", "cycl", "stapl", "dendr", "noncanonical", "peptidomimetic", "terminal mod", "disulfide")
#: Prefixes of organism names and the species they stand for.  Fixed values.
SPECIES = {
    "e. coli": "Escherichia coli",
    "escherichia coli": "Escherichia coli",
    "s. aureus": "Staphylococcus aureus",
    "staphylococcus aureus": "Staphylococcus aureus",
    "p. aeruginosa": "Pseudomonas aeruginosa",
    "pseudomonas aeruginosa": "Pseudomonas aeruginosa",
}


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, though ``use`` may mention it often or inside lambdas."""
    return F.transform(F.array(value), use)[0]


def norm(s: Column) -> Column:
    """Without white space, upper-cased; null becomes empty."""
    return F.upper(F.regexp_replace(F.coalesce(s, F.lit("")), r"\s+", ""))


def sequence_id(s: Column) -> Column:
    return F.concat(F.lit("seq_"), F.substring(F.sha2(s, 256), 1, 16))


def fallback_id(given: Column, s: Column, prefix: str = "seqsha_") -> Column:
    """``given``, or an identifier from the sequence where it is null, blank, ``nan`` or ``none``."""
    blank = given.isNull() | F.lower(F.trim(given)).isin("", "nan", "none")
    return F.when(blank, F.concat(F.lit(prefix), F.substring(F.sha2(s, 256), 1, 12))).otherwise(given)


def clean_id(given: Column, fallback: Column) -> Column:
    """``given`` as a header token: other characters than letters, digits, ``_`` and ``-`` become ``_``; outer ``_`` go."""
    token = F.btrim(F.regexp_replace(F.coalesce(given, F.lit("")), r"[^A-Za-z0-9_-]", "_"), F.lit("_"))
    return F.when((token == "") | F.contains(F.lower(token), F.lit("nan")), fallback).otherwise(token)


def invalid_residues(s: Column) -> Column:
    """The distinct characters of ``s`` that are no residues, sorted, as one string."""
    rest = F.translate(s, RESIDUES, "")
    return F.when(rest == "", F.lit("")).otherwise(F.array_join(F.array_sort(F.array_distinct(F.split(rest, ""))), ""))


def canonical(s: Column) -> Column:
    """Not empty and of residues only."""
    return F.coalesce(s.rlike(f"^[{RESIDUES}]+$"), F.lit(False))


def in_length(n: Column) -> Column:
    return n.between(SHORTEST, LONGEST)


def modifications(meta: Column) -> Column:
    """The words of :data:`MODIFIED` in a text, and ``amidation (AMD)`` for the word ``amd``, joined by ``;``."""
    low = F.lower(F.coalesce(meta, F.lit("")))
    words = [F.when(F.contains(low, F.lit(w)), F.lit(w)) for w in MODIFIED] + [F.when(low.rlike(r"\bamd\b"), F.lit("amidation (AMD)"))]
    return F.array_join(F.array_compact(F.array(*words)), ";")


def validity(raw: Column, meta: Column | None = None) -> Column:
    """A struct of the ten validity flags of a raw sequence with free-text metadata."""
    meta = F.lit("") if meta is None else F.coalesce(meta, F.lit(""))
    s, wrong, mods = norm(raw), invalid_residues(norm(raw)), modifications(meta)
    lower = F.coalesce(raw, F.lit("")).rlike(r"\p{Ll}")
    status = F.when(mods != "", "modified").when(F.trim(meta) == "", "unknown").otherwise("none_known")
    return F.struct(
        s.alias("sequence_normalized"), F.length(s).alias("length"), (wrong == "").alias("alphabet_valid"), lower.alias("has_lowercase_residues"),
        F.when(lower, "suspected_d_or_mixed").otherwise("l_or_unspecified").alias("stereochemistry_status"), wrong.alias("invalid_residues"),
        in_length(F.length(s)).alias("length_valid"), status.alias("modification_status"), mods.alias("modification_reason"),
        ((s != "") & (wrong == "") & in_length(F.length(s)) & (mods == "") & ~lower).alias("valid_for_challenge"),
    )


def first_reason(s: Column, shortest: int = SHORTEST, longest: int = LONGEST) -> Column:
    """Why a sequence is refused, the first that holds of: empty, length, alphabet; else ``ok``."""
    n = F.length(s)
    return F.when(s.isNull() | (s == ""), "empty").when((n < shortest) | (n > longest), "length").when(~canonical(s), "alphabet").otherwise("ok")


def detailed_reason(s: Column) -> Column:
    """As :func:`first_reason`, with the offending length or residues in the reason."""
    n = F.length(s)
    return (
        F.when(s.isNull() | (s == ""), "empty").when(n < SHORTEST, F.concat(F.lit("too_short_"), n)).when(n > LONGEST, F.concat(F.lit("too_long_"), n))
        .when(~canonical(s), F.concat(F.lit("invalid_residues_"), invalid_residues(s))).otherwise("ok")
    )


def rule_errors(s: Column, in_reference: Column | None = None) -> Column:
    """All hard-rule errors of a sequence, as an array; empty if there are none."""
    n = F.length(F.coalesce(s, F.lit("")))
    errors = [
        F.when(~canonical(F.coalesce(s, F.lit(""))), "noncanonical residues"), F.when(n < SHORTEST, "below minimum length"), F.when(n > LONGEST, "above maximum length"),
    ] + ([] if in_reference is None else [F.when(in_reference, "exact reference match")])
    return F.array_compact(F.array(*errors))


def residue_count(s: Column, residues: str) -> Column:
    """How many characters of ``s`` are among ``residues``."""
    return F.length(s) - F.length(F.translate(s, residues, ""))


def composition(s: Column) -> Column:
    """Counts and fractions of residue classes; fractions are rounded to four digits."""
    classes = {"cationic": "KRH", "anionic": "DE", "hydrophobic": "VILMFW", "aromatic": "FWY"}
    n = F.nullif(F.length(s), F.lit(0))
    return F.struct(
        F.length(s).alias("length"), *[residue_count(s, r).alias(f"{k}_count") for k, r in classes.items()],
        *[F.round(residue_count(s, r) / n, 4).alias(f"{k}_fraction") for k, r in classes.items()],
    )


def residue_fractions(s: Column) -> Column:
    """Twenty fractions in the order of :data:`RESIDUES`."""
    return F.when(s.isNull(), F.array_repeat(F.lit(None).cast("double"), len(RESIDUES))).otherwise(batches.fractions(s))


def feasibility_reason(s: Column) -> Column:
    """A stringent screen: no cysteine, no residue three times in a row, fewer than three of K, R, H in any five."""
    cluster = F.when(F.length(s) >= 5, F.exists(F.sequence(F.lit(1), F.length(s) - 4), lambda i: residue_count(F.substring(s, i, F.lit(5)), "KRH") >= 3)).otherwise(False)
    return F.when(F.contains(s, F.lit("C")), "contains_cysteine").when(s.rlike(r"(.)\1\1"), "homopolymer_triplet").when(cluster, "positive_cluster_5win").otherwise("ok")


def substrings(s: Column, shortest: int = 4, longest: int = 8) -> Column:
    """Every substring of those lengths, in order of length, then place, repeats included."""
    one = lambda k: F.when(F.length(s) >= k, F.transform(F.sequence(F.lit(1), F.length(s) - (k - 1)), lambda i: F.substring(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))
    return F.concat(*[one(k) for k in range(shortest, longest + 1)])


def amphipathic(s: Column) -> Column:
    """Whether K or R stands within three places of one of W, F, L, I, V."""
    return s.rlike(r"[KR].{0,2}[WFLIV]|[WFLIV].{0,2}[KR]")


def organism(raw: Column, aliases: dict[str, str] = SPECIES) -> Column:
    """Species, strain and status of a free-text organism name.

    A known prefix gives the species and what follows is the strain; else the first two words are the species.  Both
    sides are trimmed before they are compared.
    """
    name = F.trim(F.coalesce(raw, F.lit("")))
    low, words = F.lower(name), F.split(name, r"\s+")
    species, strain = None, None
    for alias, known in aliases.items():
        hit, rest = F.startswith(low, F.lit(alias)), F.btrim(F.substring(name, len(alias) + 1, 1_000_000), F.lit(" ,"))
        species = F.when(hit, known) if species is None else species.when(hit, known)
        strain = F.when(hit, rest) if strain is None else strain.when(hit, rest)
    species = species.when(name == "", "unknown").otherwise(F.array_join(F.slice(words, 1, 2), " "))
    strain = strain.otherwise(F.array_join(F.slice(words, 3, 1_000_000), " "))
    return F.struct(
        name.alias("raw_target_organism"), species.alias("canonical_species"), F.when(strain == "", "unknown").otherwise(strain).alias("strain"),
        F.when(name == "", "review_required").otherwise("mapped").alias("mapping_status"),
    )


def evidence_label(raw: Column, measurement: Column) -> Column:
    """What an assay row tells: tested inactive, a reported measurement, or nothing."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    return F.when(F.contains(low, F.lit("not active")) | F.contains(low, F.lit("inactive")), "tested_inactive").when(~F.coalesce(measurement, F.lit("")).isin("", "NA"), "reported").otherwise("unknown")


def ranked_header(header: Column, rank: Column, domains: Sequence[str]) -> Column:
    """Whether a header is ``rank_NNN_domain_id`` with its own rank and a known domain."""
    pattern = f"^rank_([0-9]{{3}})_({'|'.join(domains)})_([A-Za-z0-9_-]+)$"
    return header.rlike(pattern) & (F.regexp_extract(header, pattern, 1) == F.lpad(rank.cast("string"), 3, "0"))


def forward_slashes(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def tokens(s: Column, most: int = 52) -> Column:
    """Integer tokens: 1 start, residues from 3 in the order of :data:`RESIDUES`, 2 end, 0 to fill up to ``most``."""
    at = F.transform(F.filter(F.split(s, ""), lambda c: c != ""), lambda c: F.instr(F.lit(RESIDUES), c) + 2)
    body = F.concat(F.array(F.lit(1)), at, F.array(F.lit(2)))
    return F.slice(F.concat(body, F.array_repeat(F.lit(0), most)), 1, most)


def archetype(s: Column, charge: Column, moment: Column, boman: Column) -> Column:
    """Family number and name by the first rule that holds.  Names and thresholds are fixed values."""
    n = F.length(s)
    rules = [
        (residue_count(s, "RW") / n >= 0.40, "Trp_Arg_Rich"), (residue_count(s, "P") / n >= 0.15, "Proline_Rich_Extended"), (moment >= 0.65, "High_Amphipathic_Helical"),
        ((n <= 12) & (charge >= 3), "Short_Ultrashort_Cationic"), (moment >= 0.40, "Moderate_Amphipathic"), (boman >= 2.5, "High_Boman_Protein_Interacting"),
        (n >= 30, "Long_Membranolytic"), (charge >= 5, "Hyper_Cationic"), (residue_count(s, "C") >= 2, "Cysteine_Constrained"), (F.lit(True), "Balanced_Hydrophobic_Cationic"),
    ]
    out = None
    for i, (rule, name) in enumerate(rules):
        value = F.struct(F.lit(i).alias("family_id"), F.lit(name).alias("family_archetype"))
        out = F.when(rule, value) if out is None else out.when(rule, value)
    return out


def generator_track(length: Column, moment: Column, charge: Column) -> Column:
    return (
        F.when((length <= 25) & (moment >= 0.4), "all").when(length <= 25, "vae").when(charge >= 5, "ar").when(moment >= 0.45, "diffusion").otherwise("evolution")
    )
