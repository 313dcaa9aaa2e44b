"""Where intermediate tables go: the shared folder that the session names."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Folders made for local sessions that name none, by application.
_own: dict[str, str] = {}
#: What each open ``scratch`` of an application has to delete.
_scopes: dict[str, list[list[str]]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine (a local master, as in tests) gets a folder of its own; on a cluster
    it is an error, since executors could not read what others write to their own disks.
    """
    held = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not held:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = tempfile.mkdtemp(prefix="strandloom-")
        held = _own[context.applicationId]
    return held.rstrip("/")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/strandloom/{spark.sparkContext.applicationId}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing is written to yet; the innermost ``scratch`` deletes it."""
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    if scopes := _scopes.get(spark.sparkContext.applicationId):
        scopes[-1].append(path)
    return path


#: For tables whose rows are megabytes: a writer looks at the size of what it holds after every row, not first after a hundred.
LARGE_ROWS = {"parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1", "parquet.block.size": str(16 << 20)}


def materialize(df: DataFrame, label: str, outlives: bool = False, large_rows: bool = False) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This cuts lineage: what follows survives the loss of any executor, because the files are on storage that all
    executors share.  Every call gets a folder of its own, below one folder for the application.  A table that
    ``outlives`` the innermost ``scratch`` is left to the one around it.  With ``large_rows`` a task holds some 16 MB of
    what it writes.
    """
    spark = df.sparkSession
    path = f"{_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**(LARGE_ROWS if large_rows else {})).parquet(path)
    if scopes := _scopes.get(spark.sparkContext.applicationId):
        if len(scopes) > outlives:
            scopes[-1 - outlives].append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Delete what this application has written to the shared folder; call it when no result is read any more."""
    _delete(spark, _folder(spark))


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``materialize`` has written inside it: for work whose result is written before."""
    held = _scopes.setdefault(spark.sparkContext.applicationId, [])
    held.append([])
    try:
        yield
    finally:
        for path in held.pop():
            _delete(spark, path)
