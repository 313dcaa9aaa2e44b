"""The corpus pipeline: stages that each call one operator of ``strandloom.llm``."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from strandloom.llm import byte_bpe, exact_dedup, quality_model, simhash, source_mix
from strandloom.llm.common import materialize, table
from strandloom.storage import scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject."""
    return quality_model.keep(docs, table(spark, sf_dir, "labels"))


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts the one with the largest identifier."""
    return exact_dedup.surviving(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one row: the smallest identifier's."""
    return simhash.representatives(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix draws them, in shards, shuffled inside each."""
    return source_mix.mixed(docs, places=False)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded bytes, one row for each row of the mix."""
    return byte_bpe.digest(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("quality classifier", quality), ("exact dedup", dedup), ("simhash near dedup", near_dedup), ("source mix", mix), ("byte bpe", encode)]

#: A learned stage has no SQL; tests/llm/test_pipeline.py compares each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again by the next.

    What a stage has written for itself goes when its result is written.
    """
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark):
            docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}", outlives=True)
    return STAGES[-1][1](spark, docs, sf_dir)
