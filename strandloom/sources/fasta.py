"""FASTA files as DataFrames.  Records are split by the reader, so a file of any size is read in parallel parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.sources.text import file_groups, read_decoded


def _raw(spark: SparkSession, path: str) -> DataFrame:
    """``value, source_file, record_ord``: what stands between the starts of records; files in another encoding are decoded whole."""
    out = None
    for encoding, paths in file_groups(spark, path):
        if encoding == "utf-8":
            part = spark.read.option("wholetext", False).option("lineSep", "\n>").text(paths)
            part = part.select("value", F.input_file_name().alias("source_file"), F.monotonically_increasing_id().alias("record_ord"))
        else:
            part = read_decoded(spark, paths).select(F.posexplode(F.split("text", "\n>")).alias("record_ord", "value"), F.col("path").alias("source_file"))
            part = part.select("value", "source_file", F.col("record_ord").cast("long").alias("record_ord"))
        out = part if out is None else out.unionByName(part)
    return out


def _parsed(spark: SparkSession, path: str) -> DataFrame:
    raw = _raw(spark, path)
    value = F.regexp_replace(F.regexp_replace("value", r"\r", ""), "^\ufeff", "")
    opened = F.startswith(value, F.lit(">"))
    body = F.when(opened, F.substring(value, 2, 2_000_000_000)).otherwise(value)
    parts = F.split(body, "\n", 2)
    return raw.select("source_file", "record_ord", opened.alias("opened"), body.alias("body"), F.get(parts, F.lit(0)).alias("head"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("tail"))


def _first(df: DataFrame) -> DataFrame:
    """Adds ``leads``: whether a row is the first of its file."""
    least = df.groupBy("source_file").agg(F.min("record_ord").alias("_lead"))
    return df.join(least, "source_file").withColumn("leads", F.col("record_ord") == F.col("_lead")).drop("_lead")


def read_fasta(spark: SparkSession, path: str, uppercase: bool = False) -> DataFrame:
    """Tolerant: ``source_file, record_ord, id, header, sequence, malformed``.

    The identifier is the first word of the header; sequence lines are joined without white space.  Lines before the
    first header belong to no record and are counted, by file, as ``malformed``; a file of such lines only has none.
    Files that are not UTF-8 are read in the first encoding that fits.
    """
    rows = _first(_parsed(spark, path))
    stray = F.col("leads") & ~F.col("opened")
    lost = F.size(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != ""))
    bad = rows.groupBy("source_file").agg(F.sum(F.when(stray, lost).otherwise(0)).cast("long").alias("malformed"))
    sequence = F.regexp_replace("tail", r"\s", "")
    out = rows.filter(~stray).join(bad, "source_file")
    return out.select("source_file", "record_ord", F.get(F.split(F.trim("head"), r"\s+"), F.lit(0)).alias("id"), F.trim("head").alias("header"), (F.upper(sequence) if uppercase else sequence).alias("sequence"), "malformed")


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines before the first header of each file, those of files without any record included."""
    rows = _first(_parsed(spark, path))
    lost = F.size(F.filter(F.split("body", "\n"), lambda x: F.trim(x) != ""))
    return rows.groupBy("source_file").agg(F.sum(F.when(F.col("leads") & ~F.col("opened"), lost).otherwise(0)).cast("long").alias("malformed"))


def read_fasta_strict(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_fasta`; text before a header, an empty header and an empty record are errors when they are read."""
    rows = _first(_parsed(spark, path))
    sequence = F.regexp_replace("tail", r"\s", "")
    problem = F.when(F.col("leads") & ~F.col("opened"), "text before the first header").when(F.trim("head") == "", "empty header").when(sequence == "", "empty record")
    checked = F.when(problem.isNull(), sequence).otherwise(F.raise_error(problem))
    return rows.select("source_file", "record_ord", F.get(F.split(F.trim("head"), r"\s+"), F.lit(0)).alias("id"), F.trim("head").alias("header"), checked.alias("sequence"))


def fasta_lines(df: DataFrame, header: str = "header", sequence: str = "sequence") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(header), F.lit("\n"), F.col(sequence)).alias("value"))


def write_fasta(df: DataFrame, path: str, order: str, header: str = "header", sequence: str = "sequence", mode: str = "errorifexists") -> None:
    """Records in order, in range-partitioned files; read in name order they are one sorted file.  Nothing is overwritten unless told."""
    fasta_lines(df.orderBy(order), header, sequence).write.mode(mode).text(path)


def indexed_header(index, given):
    """``seq_00001_id``."""
    return F.format_string("seq_%05d_%s", index, given)


def ranked_header(rank, domain, given):
    """``rank_001_domain_id``."""
    return F.format_string("rank_%03d_%s_%s", rank, domain, given)
