"""Every registered query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from strandloom.plans import catalog

HERE = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(HERE), reason="no test tables")


def canonical(rows, columns):
    def atom(v):
        if v is None or v != v:
            return "null"
        if isinstance(v, bool):
            return str(v)
        return repr(round(float(v), 4) + 0.0) if isinstance(v, int | float) else str(v)

    return sorted("|".join(atom(r[c]) for c in columns) for r in rows)


@pytest.fixture(scope="module")
def duck():
    out = duckdb.connect()
    for path in glob.glob(f"{HERE}/*.parquet"):
        out.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return out


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, HERE)
    cursor = duck.execute(catalog.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    columns = sorted(names)
    assert canonical([r.asDict() for r in df.collect()], columns) == canonical([dict(zip(names, r, strict=True)) for r in cursor.fetchall()], columns)


def test_records_hold_their_normal_form_once(spark):
    """Only where it is not the raw text is the normal form written, and no record is shuffled: documents are, before they are cut."""
    from pyspark.sql import functions as F

    from strandloom.functions import sequence
    from strandloom.plans import registry

    rows = registry.derived(spark, "/root/testdata/sf0.001")
    held = spark.read.parquet(*rows.inputFiles())
    assert held.filter("s = raw").isEmpty() and not held.filter("s is null").isEmpty()
    assert rows.filter(~F.col("s").eqNullSafe(sequence.norm(F.col("raw")))).isEmpty()
    assert rows.count() == held.count() == rows.select("rec_id").distinct().count()
