"""Text files: bytes decoded with fallbacks, CSV, manifests and file inventories."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.storage import new_path

#: Tried in this order; the last one accepts any bytes.
ENCODINGS = ("utf-8-sig", "utf-8", "cp1252", "latin-1")


def decode_bytes(raw: bytes, encodings: Sequence[str] = ENCODINGS) -> tuple[str, str]:
    for name in encodings:
        try:
            return raw.decode(name), name
        except UnicodeDecodeError:
            continue
    raise UnicodeDecodeError(encodings[-1], raw, 0, 1, "no encoding fits")


def read_decoded(spark: SparkSession, path: str | Sequence[str], encodings: Sequence[str] = ENCODINGS) -> DataFrame:
    """One row a file: ``path, text, encoding``.  Every file is held whole by the task that decodes it."""
    files = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [decode_bytes(x, encodings) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.string())], ["path", "text", "encoding"])

    return files.mapInArrow(run, "path string, text string, encoding string")


def foreign_files(spark: SparkSession, path: str) -> dict[str, str]:
    """Files that are not valid UTF-8, with their encoding.

    All files are scanned in parallel parts for broken characters; only files that hold one are decoded whole.  One entry
    a file.
    """
    seen = spark.read.text(path).groupBy(F.input_file_name().alias("path")).agg(F.bool_or(~F.is_valid_utf8("value")).alias("odd"))
    odd = [r["path"] for r in seen.filter("odd").collect()]
    if not odd:
        return {}
    return {r["path"]: r["encoding"] for r in read_decoded(spark, odd).select("path", "encoding").collect() if not r["encoding"].startswith("utf-8")}


def file_groups(spark: SparkSession, path: str) -> list[tuple[str, list[str]]]:
    """``(encoding, paths)`` of the files at ``path``; a single group is named by ``path`` itself."""
    foreign = {name.removeprefix("file:").lstrip("/"): kind for name, kind in foreign_files(spark, path).items()}
    if not foreign:
        return [("utf-8", [path])]
    groups: dict[str, list[str]] = {}
    for name in spark.read.text(path).inputFiles():
        groups.setdefault(foreign.get(name.removeprefix("file:").lstrip("/"), "utf-8"), []).append(name)
    return sorted(groups.items())


def transcode(spark: SparkSession, paths: Sequence[str]) -> str:
    """A folder of the shared folder that holds the given files in UTF-8, each in a folder of its own."""
    out = new_path(spark, "utf8")
    named = read_decoded(spark, paths).select("text", F.sha2("path", 256).alias("file"))
    named.write.partitionBy("file").option("lineSep", "\n").text(out)
    return f"{out}/file=*"


def read_csv(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """CSV files with a header; quoted fields may hold line breaks and doubled quotes; every column is a string.

    Files that are not UTF-8 are first written again, in the first of ``ENCODINGS`` that fits.
    """
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("inferSchema", False)
    out = None
    for encoding, paths in file_groups(spark, path):
        part = read.csv(paths if encoding == "utf-8" else transcode(spark, paths))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out if limit is None else out.limit(limit)


def ordered_csv(spark: SparkSession, path: str, index: str = "attempt_index") -> DataFrame:
    """:func:`read_csv` with a check that ``index`` is exactly 1..n."""
    out = read_csv(spark, path)
    check_sequence(out, index)
    return out


def check_sequence(df: DataFrame, index: str) -> None:
    """Fails unless ``index`` holds each of 1..n once."""
    n = F.col(index).cast("long")
    r = df.agg(F.count(F.lit(1)).alias("rows"), F.min(n).alias("lo"), F.max(n).alias("hi"), F.count_distinct(n).alias("distinct")).first()
    if r["rows"] and not (r["lo"] == 1 and r["hi"] == r["rows"] == r["distinct"]):
        raise ValueError(f"{index} is not 1..{r['rows']}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document, or one a line."""
    return spark.read.option("multiLine", True).json(path)


def require_columns(df: DataFrame, *columns: str) -> DataFrame:
    """``df``, or an error that names the columns it lacks."""
    lacking = sorted(set(columns) - set(df.columns))
    if lacking:
        raise ValueError(f"missing columns: {lacking}")
    return df


def resolve_aliases(df: DataFrame, aliases: dict[str, Sequence[str]]) -> DataFrame:
    """Adds each wanted column from the first of its other names that there is."""
    for name, others in aliases.items():
        found = next((o for o in others if o in df.columns), None)
        if name not in df.columns and found:
            df = df.withColumn(name, F.col(found))
    return df


def find_view(spark: SparkSession, folder: str, names: Sequence[str]) -> DataFrame:
    """The first of ``names`` in a folder, Parquet before CSV; looked up through Spark's own file systems."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        for end, read in ((".parquet", spark.read.parquet), (".csv", lambda p: read_csv(spark, p))):
            at = hadoop(f"{folder}/{name}{end}")
            if at.getFileSystem(conf).exists(at):
                return read(f"{folder}/{name}{end}")
    raise FileNotFoundError(f"none of {list(names)} in {folder}")


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``path, bytes, sha256`` of every file, by path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def verify_checksums(found: DataFrame, pinned: DataFrame) -> DataFrame:
    """Violations of a pinned manifest (``path, bytes, sha256``): missing, unexpected or changed files."""
    a, b = found.alias("a"), pinned.alias("b")
    both = a.join(b, F.col("a.path") == F.col("b.path"), "full")
    problem = F.when(F.col("a.path").isNull(), "missing").when(F.col("b.path").isNull(), "unexpected").when((F.col("a.bytes") != F.col("b.bytes")) | (F.col("a.sha256") != F.col("b.sha256")), "changed")
    return both.select(F.coalesce("a.path", "b.path").alias("path"), problem.alias("problem")).filter("problem is not null")


def verify_chain(found: DataFrame, links: DataFrame) -> DataFrame:
    """``path, problem`` of a chain of manifests: every artefact is what its manifest says, and so is what it was made from.

    ``found``: ``path, sha256`` of the files.  ``links``: ``path, sha256, parent, parent_sha256`` as recorded; the parent of
    a raw file is null.  Problems: unsafe path, missing, changed, parent missing, parent changed, and parent without a
    record of its own.
    """
    have = found.select(F.col("path").alias("f_path"), F.col("sha256").alias("f_sha"))
    up = found.select(F.col("path").alias("p_path"), F.col("sha256").alias("p_sha"))
    known = links.select(F.col("path").alias("k_path")).distinct()
    rows = links.join(have, F.col("path") == F.col("f_path"), "left").join(up, F.col("parent") == F.col("p_path"), "left").join(known, F.col("parent") == F.col("k_path"), "left")
    unsafe = lambda c: F.startswith(c, F.lit("/")) | c.rlike(r"(^|/)\.\.(/|$)")
    derived = F.col("parent").isNotNull()
    rules = [
        ("unsafe path", unsafe(F.col("path")) | F.coalesce(unsafe(F.col("parent")), F.lit(False))), ("missing", F.col("f_path").isNull()), ("changed", F.col("f_path").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("f_sha"))),
        ("parent missing", derived & F.col("p_path").isNull()), ("parent changed", derived & F.col("p_path").isNotNull() & ~F.col("parent_sha256").eqNullSafe(F.col("p_sha"))),
        ("parent without a record", derived & F.col("k_path").isNull()),
    ]
    problems = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    return rows.select("path", F.explode(problems).alias("problem"))


def fetch_plan(pinned: DataFrame, found: DataFrame) -> DataFrame:
    """``path, url, action`` for each pinned file (``path, url, sha256``): keep, fetch, fetch again, or refuse an unsafe path."""
    have = found.select(F.col("path").alias("_p"), F.col("sha256").alias("_s"))
    rows = pinned.join(have, F.col("path") == F.col("_p"), "left")
    unsafe = F.startswith("path", F.lit("/")) | F.col("path").rlike(r"(^|/)\.\.(/|$)")
    action = F.when(unsafe, "refuse").when(F.col("_p").isNull(), "fetch").when(F.col("sha256") == F.col("_s"), "keep").otherwise("fetch again")
    return rows.select("path", "url", action.alias("action"))


def safe_destination(root: str, relative: str) -> str:
    """A path below ``root``; absolute paths and steps upwards are refused."""
    parts = relative.replace("\\", "/").split("/")
    if relative.startswith("/") or ".." in parts or ":" in parts[0]:
        raise ValueError(f"{relative} leaves the folder")
    return f"{root.rstrip('/')}/{'/'.join(p for p in parts if p not in ('', '.'))}"


def inventory(records: DataFrame, file: str = "source_file", malformed: str = "malformed") -> DataFrame:
    """Records and malformed lines of each file."""
    return records.groupBy(file).agg(F.count(F.lit(1)).alias("record_count"), F.max(malformed).alias("malformed_count"))


def tagged_union(sources: Sequence[tuple[str, DataFrame]], order: str = "record_ord") -> DataFrame:
    """All sources by column name, with ``source_database``, ``source_ord`` and each source's own record order.

    A source may bring ``record_ord``; else its order is that of its partitions and rows.
    """
    out = None
    for i, (name, df) in enumerate(sources):
        if order not in df.columns:
            df = df.withColumn(order, F.monotonically_increasing_id())
        df = df.withColumn("source_database", F.lit(name)).withColumn("source_ord", F.lit(i))
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return out
