"""Fill-in-the-middle: the streaming matcher, the contract by plain lists, exact round trips, edge cases."""

import hashlib
import os
import re

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import fill_middle, queries

HERE = "/root/testdata/sf0.001"


def plainly(doc_id, text):
    """The transformation by a list of units."""
    t = text or ""
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", t)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    h = sha(f"1:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    low, high = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
    p, m, s = "".join(units[:low]), "".join(units[low:high]), "".join(units[high:])
    if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return doc_id, len(units), "plain", None, None, sha(t), sha(t)
    form = "spm" if h4 % 100 < 20 else "psm"
    out = f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"
    return doc_id, len(units), form, len(p), len(m), sha(out), sha(t)


TEXTS = [None, "", "a", " ", "one two", "<P>", "x<S>y", "<M", "<P <S <M P> S> M>", "<<P" * 9 + "S>", "é日本語 😀 ab\n\t", "a b\x00c\r\n", "ab" * 30_000, ". " * 20_000, "A<", ">B"]


def test_every_text_equals_the_list_version_and_is_restored(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS * 12)] + [(None, "no identifier here"), (None, None), (3, "one two"), (3, "one two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = fill_middle.digest(fill_middle.fill_middle(docs))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "restored_sha256", "output_sha256"]
    found = [(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in got.collect()]
    assert sorted(map(repr, found)) == sorted(repr(plainly(*r)) for r in rows)
    assert {r[2] for r in found} == {"plain", "psm", "spm"}


def test_clashing_columns_and_empty_tables(spark):
    docs = spark.createDataFrame([("k", "a b c", "x", 1)], "_id string, _text string, output string, n int")
    got = fill_middle.fill_middle(docs, "_id", "_text", rate=100).collect()
    assert len(got) == 1 and got[0]._id == "k" and got[0].n == 5 and got[0].form in ("psm", "spm")
    assert fill_middle.digest(fill_middle.fill_middle(docs.limit(0), "_id", "_text")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab <>PSMé\n", max_size=40), st.data())
def test_offsets_are_those_of_the_list(text, data):
    units = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    assert fill_middle.count_units(text) == len(units)
    low, high = sorted(data.draw(st.tuples(*[st.integers(0, len(units))] * 2)))
    assert fill_middle.offsets(text, low, high) == (len("".join(units[:low])), len("".join(units[:high])))


def test_no_unit_list_is_kept():
    import tracemalloc

    text = "ab c. " * 300_000
    tracemalloc.start()
    n = fill_middle.count_units(text)
    fill_middle.offsets(text, n // 3, n - 1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 1_500_000 and peak < 100_000


@pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")
def test_query_equals_its_sql(spark):
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{HERE}/documents.parquet')")
    want = duck.sql(queries.ORACLE_SQL["op11_fill_middle"])
    got = queries.QUERIES["op11_fill_middle"](spark, HERE).select(*want.columns)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_outputs_are_held_for_some_megabytes_of_text():
    import pyarrow as pa

    texts = ["a" * 10, None, "b" * 300, "", "c" * 40, "d" * 70]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(texts)], ["i", "t"])
    parts = list(fill_middle.parts_of(batch, 100))
    assert [p.column(1).to_pylist() for p in parts] == [["a" * 10, None], ["b" * 300], ["", "c" * 40], ["d" * 70]] and not list(fill_middle.parts_of(batch.slice(0, 0)))
