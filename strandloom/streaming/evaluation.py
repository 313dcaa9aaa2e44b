"""A stream of sequences to score: each distinct one is scored once, across batches and restarts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandloom.functions.sequence import canonical
from strandloom.operators.models import Scorer
from strandloom.operators.search import LONGEST, SHORTEST


def score_once(stream: DataFrame, sequence: str, scorer: Callable[[], Scorer], column: str = "composite_fitness") -> DataFrame:
    """``sequence, composite_fitness, requests, called, rejected``: for each batch a row for each sequence in it.

    A sequence's score is its keyed state, so a batch touches the sequences it holds and no other, and a query that starts
    again from its checkpoint goes on with what it knows.  ``scorer`` is a plug-in as in :mod:`strandloom.operators.models`:
    it is made once a task that has something new to score, and gives ``column``.  Sequences of other letters or lengths
    are rejected and never scored.  Rows carry the sequence alone, so a frequent one is many short rows and one state.
    Null sequences are left out.  Run it in append mode: counts are those of the batch.
    """
    s = F.col(sequence)
    rows = stream.select(s.alias("sequence"), F.coalesce(canonical(s) & F.length(s).between(SHORTEST, LONGEST), F.lit(False)).alias("good")).filter("sequence is not null")
    made: list[Scorer] = []

    def step(key: tuple[str, bool], parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (text, good), n = key, sum(len(p) for p in parts)
        called = good and not state.exists
        if called:
            if not made:
                made.append(scorer())
            state.update((float(made[0]([text])[column].iloc[0]),))
        yield pd.DataFrame({"sequence": [text], "composite_fitness": [state.get[0] if good else None], "requests": [n], "called": [called], "rejected": [not good]})

    schema = "sequence string, composite_fitness double, requests long, called boolean, rejected boolean"
    return rows.groupBy("sequence", "good").applyInPandasWithState(step, schema, "fitness double", "append", GroupStateTimeout.NoTimeout)


def ledger(rows: DataFrame) -> DataFrame:
    """Requests, unique calls, cache hits and rejections of what :func:`score_once` has put out so far."""
    n = F.col("requests")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return rows.agg(
        total(n).alias("requests"), total(F.col("called").cast("long")).alias("unique_calls"),
        total(F.when(F.col("rejected"), 0).otherwise(n - F.col("called").cast("long"))).alias("cache_hits"), total(F.when(F.col("rejected"), n).otherwise(0)).alias("rejections"),
    )
