"""Streams: incremental deduplication, novelty screening and scoring of arriving sequences.

The batch operators run inside ``foreachBatch``; what is known is a Parquet table that every batch appends to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.sequence import norm, sequence_id, validity
from strandloom.operators.similar import nearest_reference, novelty_gate


def canonical_stream(stream: DataFrame, sequence: str, time: str, late: str = "1 hour") -> DataFrame:
    """A stream with identifier and validity flags, each sequence once within the time that rows may be late."""
    flat = stream.withColumn("_v", validity(F.col(sequence))).select("*", "_v.*").drop("_v").withColumn("sequence_id", sequence_id(norm(F.col(sequence))))
    return flat.withWatermark(time, late).dropDuplicatesWithinWatermark(["sequence_id"])


def windowed_counts(stream: DataFrame, time: str, group: str, size: str = "10 minutes", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, late).groupBy(window.alias("window"), group).agg(F.count(F.lit(1)).alias("n"))


def screen_batches(reference: DataFrame, key: str, sequence: str, known_path: str, out_path: str, most: float = 0.80, score: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """What ``foreachBatch`` runs: new sequences are screened against the reference, scored and appended.

    Each batch has a folder of its own, which a second run of the same batch writes anew.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(known_path)
        rows = batch.withColumn(sequence, norm(F.col(sequence))).dropDuplicates([sequence])
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            known = spark.read.parquet(known_path).filter(F.col("batch") != number)
            rows = rows.join(known.select(sequence), sequence, "left_anti")
        found = novelty_gate(nearest_reference(rows, reference, key, sequence, key, sequence, most), most=most)
        found = score(found) if score else found
        found.write.mode("overwrite").parquet(f"{out_path}/batch={number}")
        found.select(sequence).write.mode("overwrite").parquet(f"{known_path}/batch={number}")

    return run
