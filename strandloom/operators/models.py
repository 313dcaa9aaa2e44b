"""Model surface: forests with their spread, cross-validation, and batch scorers as plug-ins."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.functions.assay import perplexity
from strandloom.operators.aggregate import metrics
from strandloom.operators.curate import own_key
from strandloom.operators.trees import Forest, fit, matrix, paths, walk
from strandloom.storage import materialize


def train_forest(df: DataFrame, features: str, label: str, trees: int = 50, depth: int = 12, balanced: bool = False, seed: int = 42) -> Forest:
    """A random forest on an array column; ``balanced`` weighs classes inversely to their counts.

    Features and labels are written first, since they are read once for each of classes, cuts and bins.
    """
    held = materialize(df.select(F.col(features).cast("array<double>").alias("features"), F.col(label).cast("double").alias("label")), "instances")
    return fit(held, trees, depth, balanced, seed)


def _tree(tree: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """A tree as arrays: feature (-1 in a leaf), threshold, children, and the share of class 1."""
    return tree


def _trees(model: Forest, spark: SparkSession) -> list[dict[str, np.ndarray]]:
    """What :func:`_tree` gives of each tree."""
    return model.trees


def tree_shares(trees: Sequence[dict[str, np.ndarray]], x: np.ndarray) -> np.ndarray:
    """Class-1 share of each row in each tree: (rows, trees)."""
    return walk(paths(trees), x)


def forest_spread(df: DataFrame, model: Forest, features: str, mean: str = "pred_amp_probability", std: str = "uncertainty_amp_std") -> DataFrame:
    """``df`` with mean and population deviation, over trees, of the class-1 share, rounded to four digits.

    The trees are broadcast: their size is that of the model.
    """
    held = df.sparkSession.sparkContext.broadcast(paths(_trees(model, df.sparkSession)))

    def run(rows: pa.Array) -> pa.Array:
        shares = walk(held.value, matrix(rows)) if len(rows) else np.zeros((0, 1))
        return pa.StructArray.from_arrays([pa.array(shares.mean(axis=1).round(4)), pa.array(shares.std(axis=1).round(4))], ["mean", "std"])

    scored = df.withColumn("_s", F.arrow_udf(run, "mean double, std double")(F.col(features).cast("array<double>")))
    return scored.withColumn(mean, F.col("_s.mean")).withColumn(std, F.col("_s.std")).drop("_s")


def cross_validate(df: DataFrame, features: str, label: str, fold: str, key: str, **forest) -> tuple[DataFrame, DataFrame]:
    """Out-of-fold scores and their metrics; ``fold`` says which rows are scored by the model of the others."""
    folds = sorted(r[0] for r in df.select(fold).distinct().collect())  # one row a fold
    parts = None
    for f in folds:
        model = train_forest(df.filter(F.col(fold) != f), features, label, **forest)
        part = forest_spread(df.filter(F.col(fold) == f), model, features, "score", "spread").select(key, fold, label, "score", "spread")
        parts = part if parts is None else parts.unionByName(part)
    return parts, metrics(parts, label, "score", key)


#: A scorer takes a list of sequences and returns a frame of as many rows.
Scorer = Callable[[list[str]], pd.DataFrame]


def score_in_batches(df: DataFrame, key: str, sequence: str, scorer: Callable[[], Scorer], schema: str, batch: int = 1000) -> DataFrame:
    """``key`` and what a plug-in scorer returns for each sequence.

    ``scorer`` is called once a task and gives the function that scores; external weights are loaded there.  A batch that
    comes back with another number of rows is an error.
    """
    kind = dict(df.dtypes)[key]

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = scorer()
        for part in parts:
            for i in range(0, len(part), batch):
                chunk = part.iloc[i : i + batch]
                out = score(chunk[sequence].tolist())
                if len(out) != len(chunk):
                    raise ValueError(f"{len(out)} scores for {len(chunk)} sequences")
                out = out.reset_index(drop=True)
                out.insert(0, key, chunk[key].to_numpy())
                yield out

    return df.select(key, sequence).mapInPandas(run, f"{key} {kind}, {schema}")


def stub_panel(n: int = 11) -> Callable[[], Scorer]:
    """A stand-in for a concentration panel, for tests: numbers from sequence length and composition, not a model."""

    def make() -> Scorer:
        return lambda seqs: pd.DataFrame({f"mic_{i}": [round(8.0 * (i + 1) * (1 + s.count("D") + s.count("E")) / (1 + s.count("K") + s.count("R")), 3) for s in seqs] for i in range(n)})

    return make


def stub_likelihood() -> Callable[[], Scorer]:
    """A stand-in for a language model: a mean negative log likelihood from the length, for tests."""

    def make() -> Scorer:
        return lambda seqs: pd.DataFrame({"mean_nll": [len(s) % 7 / 2 for s in seqs]})

    return make


def perplexity_job(df: DataFrame, key: str, sequence: str, scorer: Callable[[], Scorer], most: float, batch: int = 3000) -> DataFrame:
    """``key, perplexity, passes`` from a plug-in that gives ``mean_nll``; each distinct sequence is scored once."""
    distinct = df.select(F.col(sequence).alias("_s")).distinct().select("_s", F.col("_s").alias("_text"))
    scored = score_in_batches(distinct, "_s", "_text", scorer, "mean_nll double", batch).select("_s", perplexity(F.col("mean_nll")).alias("perplexity"))
    joined = df.select(key, F.col(sequence).alias("_q")).join(scored, own_key("_q") == own_key("_s"))
    return joined.select(key, "perplexity", (F.col("perplexity") <= most).alias("passes"))


#: Attempts and temperature of each tier of the first sampling run.  Fixed values.
TIERS = ((1225, 0.85), (1400, 1.00), (875, 1.15))


def sampling_schedule(spark, tiers: Sequence[tuple[int, float]] = TIERS, batch: int = 64, seed: int = 42, top_p: float = 0.90) -> DataFrame:
    """``first_attempt, attempts, temperature, top_p, batch_seed``: a row for each batch of a sampler.

    Attempts are numbered over all tiers; a batch belongs to one tier, and its seed is that of the run plus its first
    attempt, so a batch can be drawn anew by itself.
    """
    starts = np.cumsum([0, *[n for n, _ in tiers]])
    rows = spark.createDataFrame([(int(a), n, float(t)) for a, (n, t) in zip(starts, tiers, strict=False)], "start int, n int, temperature double")
    each = rows.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(batch))))
    at = F.col("start") + F.col("i")
    return each.select(at.alias("first_attempt"), F.least(F.lit(batch), F.col("n") - F.col("i")).alias("attempts"), "temperature", F.lit(top_p).alias("top_p"), (at + seed).alias("batch_seed"))
