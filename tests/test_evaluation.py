"""Scoring a stream once: the ledger equals that of the batch evaluator, also after a restart."""

import random

from strandloom.operators import models, search
from strandloom.streaming import evaluation


def test_ledger_equals_the_batch_evaluator_after_a_restart(spark, tmp_path):
    rng = random.Random(6)
    pool = ["".join(rng.choice("ACDEFGHIKL") for _ in range(rng.choice([5, 8, 20, 60]))) for _ in range(40)] + ["KXKXKXKXKX", "KKKKKKKKKK"]
    batches = [[rng.choice(pool + ["KKKKKKKKKK"] * 30) for _ in range(n)] for n in (150, 1, 80)]
    folder, out, at = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))
    batch = search.Evaluator()
    for i, part in enumerate(batches):
        df = spark.createDataFrame([(s,) for s in [*part, *[None] * (i == 0)]], "s string")
        df.write.mode("append").parquet(folder)
        batch.evaluate(df.filter("s is not null"), "s")
        stream = spark.readStream.schema("s string").parquet(folder)
        scored = evaluation.score_once(stream, "s", models.stub_likelihood(), "mean_nll")
        query = scored.writeStream.format("parquet").option("path", out).option("checkpointLocation", at).outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination()  # each turn is a restart from the checkpoint
    rows = spark.read.parquet(out)
    assert evaluation.ledger(rows).first().asDict() == batch.counts
    held = rows.filter("not rejected").collect()
    assert all(r.composite_fitness == len(r.sequence) % 7 / 2 for r in held) and sum(r.called for r in held) == len({r.sequence for r in held})
    assert evaluation.ledger(rows.limit(0)).first().asDict() == dict.fromkeys(batch.counts, 0)
