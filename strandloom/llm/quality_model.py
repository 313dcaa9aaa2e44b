"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of 64 words.  Every passage is encoded (shares of its words by hash bucket, of character
classes, of word shapes, and its repetition) and sent through a small layer; a gated attention unit, learned from document
labels alone, weighs the passages; the weighted sum of their representations is scored.  So a document whose junk is in
one passage can be told by it.

Fitting takes at most ``sample`` labelled documents of each class (a parameter, ``SAMPLE``), those with the smallest
hashes, and of each up to ``passages`` of its passages (a parameter, ``PASSAGES``; 20,000 words), evenly from all of the
text.  Scoring reads every word of every document, in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PASSAGE = 64
#: Labelled documents of each class that the model is fitted on, and passages of each, so what the driver holds is bounded.
SAMPLE, PASSAGES = 1500, 320
#: Hash buckets of words.
BUCKETS = 32
THRESHOLD = 0.3
#: Remainder of crc32(identifier) by HELD_OUT that is kept away from fitting.
HELD_OUT = 5
STEPS, HIDDEN, GATE, RATE, DECAY, SEED = 250, 16, 8, 0.02, 1e-3, 11

#: Characters of each class; the classes not named are letters by case and what lies outside ASCII.
_CLASSES = (b"0123456789", b".,;:", b"!", b"?", b"#*$%&", b"|<>{}[]\\/=+~^_@`", b"'\"()-")
_TABLE = np.zeros(256, dtype=np.uint8)
for _i, _chars in enumerate(_CLASSES):
    _TABLE[np.frombuffer(_chars, dtype=np.uint8)] = _i + 1
_TABLE[ord("a") : ord("z") + 1], _TABLE[ord("A") : ord("Z") + 1], _TABLE[128:] = len(_CLASSES) + 1, len(_CLASSES) + 2, len(_CLASSES) + 3
N_CLASSES = len(_CLASSES) + 4
N_SHAPES = N_CLASSES + 8
N_FEATURES = N_SHAPES + BUCKETS


def encode(text: str) -> np.ndarray:
    """One row of features for each passage; a text without words is one passage of zeros."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return np.zeros((1, N_FEATURES), dtype=np.float32)
    n = len(words)
    starts = np.arange(0, max(1, n - PASSAGE // 2), PASSAGE)  # a short rest belongs to the passage before
    ends = np.append(starts[1:], n)
    size = (ends - starts).astype(np.float32)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    again = np.zeros(n, dtype=np.int64)
    again[1:] = np.fromiter(map(eq, words, words[1:]), dtype=np.int64, count=n - 1)
    chars = _TABLE[np.frombuffer(b"".join(words), dtype=np.uint8)]
    byte_starts = np.concatenate(([0], np.cumsum(lengths)))[starts]
    total = np.add.reduceat(lengths, starts).astype(np.float32)
    out = np.empty((len(starts), N_FEATURES), dtype=np.float32)
    for k in range(N_CLASSES):
        out[:, k] = np.add.reduceat(chars == k, byte_starts, dtype=np.int64) / total
    out[:, N_CLASSES] = np.log1p(size)
    out[:, N_CLASSES + 1] = total / size / 10
    out[:, N_CLASSES + 2] = [len(set(words[a:b])) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)] / size
    out[:, N_CLASSES + 3] = np.add.reduceat(again, starts) / size
    for j, (lo, hi) in enumerate(((0, 1), (2, 3), (4, 8), (13, 1 << 60))):
        out[:, N_CLASSES + 4 + j] = np.add.reduceat((lengths >= lo) & (lengths <= hi), starts, dtype=np.int64) / size
    bucket = np.fromiter(map(crc32, raw.lower().split()), dtype=np.int64, count=n) % BUCKETS
    held = np.bincount(np.repeat(np.arange(len(starts)), ends - starts) * BUCKETS + bucket, minlength=len(starts) * BUCKETS)
    out[:, N_SHAPES:] = held.reshape(-1, BUCKETS) / size[:, None]
    return out


@dataclass
class Model:
    """Weights; ``constant`` is the score of every document where labels of both classes were lacking."""

    mean: np.ndarray
    scale: np.ndarray
    weights: dict[str, np.ndarray]
    constant: float | None = None

    def forward(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray) -> tuple[np.ndarray, dict[str, np.ndarray]]:
        """Probability of label 1 for each bag, and what came before it.  Rows of a bag follow each other from its start."""
        w = self.weights
        h = np.tanh(x @ w["w1"] + w["b1"])
        t, g = np.tanh(h @ w["v"]), 1 / (1 + np.exp(-(h @ w["u"])))
        s = (t * g) @ w["a"]
        e = np.exp(s - np.maximum.reduceat(s, starts)[bag])
        a = e / np.add.reduceat(e, starts)[bag]
        z = np.add.reduceat(a[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"][0], -40, 40)))
        return p, {"h": h, "t": t, "g": g, "a": a, "z": z}

    def gradient(self, x: np.ndarray, starts: np.ndarray, bag: np.ndarray, y: np.ndarray, each: np.ndarray) -> dict[str, np.ndarray]:
        """Of the cross entropy, each bag weighted by ``each``."""
        w = self.weights
        p, m = self.forward(x, starts, bag)
        d = (p - y) * each
        dz = np.outer(d, w["c"])[bag]
        da = (m["h"] * dz).sum(axis=1)
        ds = m["a"] * (da - np.add.reduceat(m["a"] * da, starts)[bag])
        dg = np.outer(ds, w["a"])
        dt, du = dg * m["g"] * (1 - m["t"] ** 2), dg * m["t"] * m["g"] * (1 - m["g"])
        dh = (m["a"][:, None] * dz + dt @ w["v"].T + du @ w["u"].T) * (1 - m["h"] ** 2)
        return {"w1": x.T @ dh, "b1": dh.sum(axis=0), "v": m["h"].T @ dt, "u": m["h"].T @ du, "a": (m["t"] * m["g"]).T @ ds, "c": m["z"].T @ d, "d": np.array([d.sum()])}

    def scores(self, bags: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Score of each bag and the largest attention weight in it."""
        sizes = np.array([len(b) for b in bags])
        if self.constant is not None:
            return np.full(len(bags), self.constant), 1.0 / sizes
        starts, bag = places(sizes)
        p, mid = self.forward((np.concatenate(bags).astype(np.float64) - self.mean) / self.scale, starts, bag)
        return p, np.maximum.reduceat(mid["a"], starts)


def places(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each bag starts, and the bag of each row."""
    return np.concatenate(([0], np.cumsum(sizes)[:-1])), np.repeat(np.arange(len(sizes)), sizes)


def fit(bags: list[np.ndarray], labels: list[int], steps: int = STEPS, seed: int = SEED) -> Model:
    """Adam on the class-balanced cross entropy, all bags in every step."""
    y = np.array(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(N_FEATURES), np.ones(N_FEATURES), {}, (y.sum() + 1) / (len(y) + 2))
    x = np.concatenate(bags).astype(np.float64)
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    x, n = (x - mean) / scale, len(bags)
    starts, bag = places(np.array([len(b) for b in bags]))
    rng = np.random.Generator(np.random.PCG64(seed))
    shapes = {"w1": (N_FEATURES, HIDDEN), "b1": (HIDDEN,), "v": (HIDDEN, GATE), "u": (HIDDEN, GATE), "a": (GATE,), "c": (HIDDEN,), "d": (1,)}
    w = {k: rng.normal(0, 0.3 if len(s) == 1 else s[0] ** -0.5, s) for k, s in shapes.items()}
    model, first, second = Model(mean, scale, w), {k: 0.0 for k in w}, {k: 0.0 for k in w}
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (n - y.sum()))
    for step in range(1, steps + 1):
        grad = model.gradient(x, starts, bag, y, each)
        for k, g in grad.items():
            g = g + DECAY * w[k] * (k != "d")
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    return model


def held_out(id_col: Column, of: int = HELD_OUT) -> Column:
    """Whether crc32 of the identifier, as text, is divisible by ``of``.  A null identifier is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % of == 0, F.lit(True))


def evenly(bag: np.ndarray, most: int) -> np.ndarray:
    """At most ``most`` rows, evenly from the first to the last."""
    return bag if len(bag) <= most else bag[np.arange(most) * len(bag) // most]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, passages: int = PASSAGES) -> Model:
    """The model of labelled documents that are not held out: ``sample`` of each class, ``passages`` of each evenly from its text.

    Documents with labels of both kinds are left out.  Of rows that repeat an identifier one text is learned from.  The
    driver holds ``2 * sample * passages`` rows of features at most, however long the texts are.
    """
    marks = labels.select(F.col(id_col).alias("_id"), F.col(label).cast("int").alias("_y")).filter(F.col("_y").isin(0, 1) & ~held_out(F.col("_id")))
    marks = marks.groupBy("_id").agg(F.min("_y").alias("_y"), F.max("_y").alias("_top")).filter("_y = _top").select("_id", "_y")
    order = (F.xxhash64("_id"), F.col("_id"))
    taken = [r for y in (0, 1) for r in marks.filter(F.col("_y") == y).orderBy(*order).limit(sample).collect()]
    if not taken:
        return fit([], [])
    kind = dict(docs.dtypes)[id_col]
    chosen = F.broadcast(docs.sparkSession.createDataFrame([(r["_id"], r["_y"]) for r in taken], f"_id {kind}, _y int"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [evenly(encode(x.as_py() or ""), passages).tobytes() for x in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(rows, pa.binary())], ["_id", "_y", "bag"])

    known = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")).join(chosen, "_id").select("_id", "_y", "_text")
    bags = known.mapInArrow(run, f"_id {kind}, _y int, bag binary").groupBy("_id").agg(F.first("_y").alias("_y"), F.min("bag").alias("bag"))  # one row an identifier, so the bound holds
    rows = sorted(bags.collect(), key=lambda r: r["_id"])
    return fit([np.frombuffer(r["bag"], dtype=np.float32).reshape(-1, N_FEATURES) for r in rows], [r["_y"] for r in rows])


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with ``score, predicted, n_passages, top_attention``.  Null text counts as empty."""
    names, held = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    plain = docs.toDF(*[f"_c{i}" for i in range(len(names))])
    at = names.index(text)
    schema = T.StructType([*plain.schema.fields, T.StructField("_score", T.DoubleType()), T.StructField("_passages", T.LongType()), T.StructField("_top", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bags, p, top, size = [], [], [], []

            def flush() -> None:
                if bags:
                    a, b = held.value.scores(bags)
                    p.append(a)
                    top.append(b)
                    bags.clear()

            waiting = 0
            for x in batch.column(at):
                bags.append(encode(x.as_py() or ""))
                size.append(len(bags[-1]))
                waiting += size[-1]
                if waiting > 8192:
                    flush()
                    waiting = 0
            flush()
            join = lambda parts: pa.array(np.concatenate(parts) if parts else np.zeros(0))
            yield pa.RecordBatch.from_arrays([*batch.columns, join(p), pa.array(size, pa.int64()), join(top)], schema.fieldNames())

    out = plain.mapInArrow(run, schema)
    return out.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)], F.col("_score").alias("score"), (F.col("_score") >= threshold).cast("int").alias("predicted"), F.col("_passages").alias("n_passages"), F.col("_top").alias("top_attention"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row a document: ``id_col, held_out, score, predicted, n_passages, top_attention``.

    Only texts go into a score.  Null and empty texts are one passage without words and are scored as such.  Labels that
    are null or neither 0 nor 1 are not used; without labels of both classes every document gets the smoothed share of
    label 1.  Repeated rows are scored alike, and so are ties: equal texts have equal scores.  A very long text is scored
    whole; only fitting bounds the passages of a text.  An empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text, label)
    out = score(docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), model, "_id", "_text")
    return out.select(F.col("_id").alias(id_col), held_out(F.col("_id")).alias("held_out"), "score", "predicted", "n_passages", "top_attention")


def keep(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """The rows of ``docs`` whose text is not rejected, with their own columns, of any names and types.

    Null and empty texts are one passage without words and are judged as such, by the model or, without labels of both
    classes, with all others by the smoothed share of label 1.  Null identifiers are never learned from.  Repeated rows
    are judged alike; an empty table gives an empty result.
    """
    names = docs.columns
    out = score(docs, train(docs, labels, id_col, text, label), id_col, text)
    positions = out.toDF(*[f"_c{i}" for i in range(len(names))], "_score", "_predicted", "_passages", "_top").filter("_predicted = 1")
    return positions.select(*[F.col(f"_c{i}").alias(n) for i, n in enumerate(names)])
