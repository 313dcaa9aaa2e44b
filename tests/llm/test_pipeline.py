"""The pipeline's stages against plain versions of what they decide."""

import glob
import hashlib
import os

import duckdb
import numpy as np
import pytest
import tiktoken

import corpus_pipeline
from strandloom.llm import byte_bpe, quality_model, queries, simhash
from test_mix_and_urls import brute_mix, counted
from test_quality import plain_score

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{HERE}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality classifier", "exact dedup", "simhash near dedup", "source mix", "byte bpe"]
    rows = {r.doc_id: r for r in docs.collect()}

    good = stage["quality classifier"](spark, docs, HERE).cache()
    assert good.columns == docs.columns
    model = quality_model.train(docs, spark.read.parquet(f"{HERE}/labels.parquet"))
    score = {i: plain_score(r.text or "", model) for i, r in rows.items()}
    assert all(abs(p - quality_model.THRESHOLD) > 1e-5 for p in score.values())
    assert {r.doc_id for r in good.collect()} == {i for i, p in score.items() if p >= quality_model.THRESHOLD}

    once = stage["exact dedup"](spark, good, HERE).cache()
    best = {}
    for r in good.collect():
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text)
        best[low] = max(best.get(low, -1), r.doc_id)
    kept = {r.doc_id: r for r in once.collect()}
    assert set(kept) == set(best.values()) and all(kept[i] == rows[i] for i in kept)

    apart = stage["simhash near dedup"](spark, once, HERE).cache()
    fps = {i: simhash.fingerprint(r.text) for i, r in kept.items()}
    group = {i: i for i in fps}
    changed = True
    while changed:
        changed = False
        for i in fps:
            for j in fps:
                if group[j] < group[i] and (fps[i] ^ fps[j]).bit_count() <= 3:
                    group[i], changed = group[j], True
    assert {r.doc_id for r in apart.collect()} == {i for i in fps if group[i] == i}

    mix = stage["source mix"](spark, apart, HERE).cache()
    drawn, *_ = brute_mix(spark, [(r.doc_id, r.text, r.source) for r in apart.collect()])
    want = {}
    for (i, _), n in drawn.items():
        want[i] = want.get(i, 0) + n
    assert mix.columns == docs.columns and counted(mix.collect()) == want

    coded = stage["byte bpe"](spark, mix, HERE)
    assert coded.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    sha = lambda raw: hashlib.sha256(raw).hexdigest()
    ranks = byte_bpe.load_ranks(queries.RANKS)
    library = tiktoken.Encoding("own", pat_str=queries.PATTERN, mergeable_ranks={b: i for i, b in enumerate(ranks)}, special_tokens={})
    want = []
    for r in mix.collect():
        ids = library.encode_ordinary(r.text)
        want.append((r.doc_id, len(ids), sha(np.array(ids, dtype="<u4").tobytes()), sha(r.text.encode())))
    assert sorted(map(tuple, coded.collect())) == sorted(want)


def test_run_and_names(spark):
    assert corpus_pipeline.run(spark, HERE).count() > 0
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_their_sql(spark, name):
    duck = duckdb.connect()
    for path in glob.glob(f"{HERE}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    got = queries.QUERIES[name](spark, HERE)
    cursor = duck.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(got.columns)
    assert columns == sorted(names)
    atom = lambda v: "null" if v is None or v != v else repr(round(v, 4)) if isinstance(v, float) else str(v)
    text = lambda rows: sorted("|".join(atom(r[c]) for c in columns) for r in rows)
    assert text(r.asDict() for r in got.collect()) == text(dict(zip(names, r, strict=True)) for r in cursor.fetchall())
