"""``python -m strandloom.validate FILE...``: checks FASTA files; the exit code is 1 if any rule is broken."""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import norm
from strandloom.operators import verify
from strandloom.sources.fasta import malformed_lines, read_fasta


def violations(spark: SparkSession, path: str) -> dict[str, int]:
    """Broken rules of one file: no records, text before a header, and the sequence rules of a library."""
    records = read_fasta(spark, path).withColumn("sequence", norm(F.col("sequence")))
    n = records.count()
    rules = {k: v for k, v in verify.library_rules(records, "sequence", n).items() if k != "library_size"}
    rules["malformed_lines"] = malformed_lines(spark, path).filter("malformed > 0")
    found = {r["rule"]: r["violations"] for r in verify.rule_counts(rules).collect() if r["violations"]}
    return found | ({} if n else {"no_records": 1})


def main(paths: list[str]) -> int:
    spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    bad = False
    for path in paths:
        found = violations(spark, path)
        bad |= bool(found)
        print(path, found or "ok")
    return int(bad)


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
