"""Queries on sources and sinks: tables are written to the shared folder in a format, and read back by its reader."""

from __future__ import annotations

import io
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandloom.plans.registry import GOOD, SEQ, canonical_records, query
from strandloom.sources import fasta, sinks, text, xlsx
from strandloom.storage import new_path, table


def _put(spark: SparkSession, path: str, raw: bytes) -> None:
    """A small file, through Spark's own file systems."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(raw))
    out.close()


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("string").alias("id"), F.concat(F.lit("µ "), F.col("n_name"), F.lit(' "x"\n;')).alias("note"))


_NOTE = """'µ ' || n_name || ' "x"' || chr(10) || ';'"""


@query(f"SELECT n_nationkey::VARCHAR AS id, {_NOTE} AS note FROM nation")
def csv_round_trip(spark, sf_dir):
    """Quotes and line breaks in fields."""
    path = new_path(spark, "csv")
    sinks.write_csv(_nations(spark, sf_dir), path, ["id", "note"])
    return text.read_csv(spark, path).select("id", "note")


@query(f"SELECT n_nationkey::VARCHAR AS id, {_NOTE} AS note FROM nation")
def csv_foreign_encoding(spark, sf_dir):
    """Half of the files are not UTF-8."""
    path = new_path(spark, "cp1252")
    for i, encoding in enumerate(("ISO-8859-1", "UTF-8")):
        part = _nations(spark, sf_dir).filter(F.col("id").cast("int") % 2 == i)
        part.coalesce(1).write.mode("append").option("header", True).option("escape", '"').option("encoding", encoding).csv(path)
    return text.read_csv(spark, path).select("id", "note")


_SUPPLIERS = "string_agg('µ' || s_name || ' ' || s_acctbal::VARCHAR, chr(10) ORDER BY s_suppkey)"


@query(f"""SELECT 'cp1252' AS encoding, 1::BIGINT AS files, sha256({_SUPPLIERS}) AS sha256, length({_SUPPLIERS}) AS chars FROM supplier UNION ALL
        SELECT 'utf-8-sig', 1, sha256({_SUPPLIERS}), length({_SUPPLIERS}) FROM supplier""")
def decoded_files(spark, sf_dir):
    """Files of all suppliers, decoded by the first encoding that fits."""
    path = new_path(spark, "decoded")
    line = F.concat(F.lit("µ"), "s_name", F.lit(" "), F.col("s_acctbal").cast("string")).alias("line")
    whole = "\n".join(r[0] for r in table(spark, sf_dir, "supplier").orderBy("s_suppkey").select(line).toLocalIterator())  # the files are made here
    _put(spark, f"{path}/a.txt", whole.encode("cp1252"))
    _put(spark, f"{path}/b.txt", whole.encode("utf-8-sig"))
    found = text.read_decoded(spark, path).groupBy("encoding").agg(F.count(F.lit(1)).alias("files"), F.max("text").alias("text"))
    return found.select("encoding", "files", F.sha2("text", 256).alias("sha256"), F.length("text").cast("long").alias("chars"))


@query("SELECT least(7, count(*)) AS rows, 2::BIGINT AS columns FROM nation")
def csv_bounded(spark, sf_dir):
    """A read of seven rows."""
    path = new_path(spark, "csv")
    sinks.write_csv(_nations(spark, sf_dir), path)
    some = text.read_csv(spark, path, 7)
    return some.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(some.columns)).cast("long"))


@query("SELECT row_number() OVER (ORDER BY event_id)::VARCHAR AS attempt_index, event_type FROM events")
def csv_in_order(spark, sf_dir):
    """Rows of a log whose index has to be 1..n."""
    from strandloom.operators.curate import number_rows

    path = new_path(spark, "csv")
    rows = number_rows(table(spark, sf_dir, "events").select("event_id", "event_type"), [F.col("event_id")], "attempt_index")
    sinks.write_csv(rows, path, ["attempt_index", "event_type"])
    return text.ordered_csv(spark, path).select("attempt_index", "event_type")


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", F.concat_ws(" ", F.col("p_partkey").cast("string"), F.col("p_name")).alias("header"), F.replace("p_name", F.lit(" "), F.lit("\n")).alias("sequence"))


@query("""SELECT p_partkey::VARCHAR AS id, p_partkey || ' ' || p_name AS header, replace(p_name, ' ', '') AS sequence,
        upper(replace(p_name, ' ', '')) AS folded, 0::BIGINT AS malformed FROM part""")
def fasta_round_trip(spark, sf_dir):
    """The tolerant reader: sequences over several lines, as they are and in upper case."""
    path = new_path(spark, "fasta")
    fasta.write_fasta(_records(spark, sf_dir), path, "p_partkey")
    upper = fasta.read_fasta(spark, path, uppercase=True).select("header", F.col("sequence").alias("folded"))
    return fasta.read_fasta(spark, path).join(upper, "header").select("id", "header", "sequence", "folded", "malformed")


@query("""SELECT 'seq_' || printf('%05d', p_partkey) || '_' || p_brand AS indexed, 'rank_' || printf('%03d', p_partkey) || '_ar_' || p_brand AS ranked,
        upper(replace(p_name, ' ', '')) AS sequence FROM part""")
def fasta_headers(spark, sf_dir):
    """The strict reader, on indexed headers."""
    path = new_path(spark, "fasta")
    rows = table(spark, sf_dir, "part").select("p_partkey", fasta.indexed_header(F.col("p_partkey"), F.col("p_brand")).alias("header"), F.upper(F.replace("p_name", F.lit(" "), F.lit(""))).alias("sequence"))
    fasta.write_fasta(rows, path, "p_partkey")
    back = fasta.read_fasta_strict(spark, path).withColumn("k", F.split("header", "_")[1].cast("int"))
    return back.select(F.col("header").alias("indexed"), fasta.ranked_header(F.col("k"), F.lit("ar"), F.substring_index("header", "_", -1)).alias("ranked"), "sequence")


@query("SELECT 3::BIGINT AS malformed, 'µx' AS header, 'ACDE' AS sequence")
def fasta_faults(spark, sf_dir):
    """Lines before the first header, in a file that is not UTF-8."""
    path = new_path(spark, "fasta")
    _put(spark, f"{path}/a.fa", "no header\nnone here\n\nnor here\n>µx\nAC\n DE \n".encode("cp1252"))
    lost = fasta.malformed_lines(spark, path).select("malformed")
    return lost.join(F.broadcast(fasta.read_fasta(spark, path).select("header", "sequence")))  # one file, one record


@query("SELECT s_suppkey::VARCHAR AS first, '' AS middle, s_name AS last, row_number() OVER (ORDER BY s_suppkey) - 1 AS record_ord FROM supplier")
def xlsx_records(spark, sf_dir):
    """A workbook of all suppliers with a blank column."""
    path = new_path(spark, "xlsx")
    rows = table(spark, sf_dir, "supplier").orderBy("s_suppkey").select("s_suppkey", "s_name").toLocalIterator()  # the workbook is made here
    cell = lambda ref, value: f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    lines = [f'<row r="1">{cell("A1", "first")}{cell("B1", "middle")}{cell("C1", "last")}</row>']
    lines += [f'<row r="{i + 2}">{cell(f"A{i + 2}", r["s_suppkey"])}{cell(f"C{i + 2}", r["s_name"])}</row>' for i, r in enumerate(rows)]
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as book:
        sheet = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>'
        book.writestr("xl/worksheets/sheet1.xml", sheet)
    _put(spark, f"{path}/a.xlsx", held.getvalue())
    record = lambda name: F.try_element_at("record", F.lit(name)).alias(name)
    return xlsx.read_xlsx(spark, path).select(record("first"), record("middle"), record("last"), "record_ord")


@query("SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_returnflag")
def parquet_round_trip(spark, sf_dir):
    """A compressed table with columns in name order."""
    path = new_path(spark, "zstd")
    sinks.write_parquet(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_quantity"), path)
    return spark.read.parquet(path).groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"))


@query("SELECT p_brand AS name, count(*) AS files, sum(p_retailprice)::DOUBLE AS bytes FROM part GROUP BY p_brand")
def manifest_read(spark, sf_dir):
    """A manifest that is one JSON document: parts by brand."""
    path = new_path(spark, "manifest")
    by = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("name")).agg(F.count(F.lit(1)).alias("files"), F.sum("p_retailprice").alias("bytes"))
    by.agg(F.to_json(F.collect_list(F.struct("name", "files", "bytes"))).alias("value")).write.text(path)  # one row a brand
    return text.read_manifest(spark, path).select("name", "files", "bytes")


#: A file for each size of part, with the names of its parts; every part is in one of them.
_FILES = """f AS (SELECT p_size AS i, 'size-' || p_size AS path, sum(strlen(p_name) + 1)::BIGINT AS bytes, sha256(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS sha256
        FROM part GROUP BY p_size)"""


def _pinned(spark: SparkSession, sf_dir: str, path: str) -> DataFrame:
    """``i, path, bytes, sha256`` of a file for each size of part, which tasks write."""
    rows = table(spark, sf_dir, "part").repartition("p_size").sortWithinPartitions("p_size", "p_partkey")
    rows.select("p_size", F.col("p_name").alias("value")).write.mode("append").partitionBy("p_size").text(path)
    return _named(text.checksums(spark, path).filter(F.col("path").contains("p_size=")))


def _named(files: DataFrame) -> DataFrame:
    i = F.regexp_extract("path", "p_size=([0-9]+)/", 1).cast("int")
    return files.select(i.alias("i"), F.concat(F.lit("size-"), i).alias("path"), "bytes", "sha256")


@query(f"""WITH {_FILES} SELECT path, bytes, sha256, CASE WHEN i % 7 = 0 THEN 'changed' WHEN i % 7 = 1 THEN 'unexpected' ELSE 'ok' END AS problem FROM f
    UNION ALL SELECT 'gone-' || i, NULL, NULL, 'missing' FROM f WHERE i % 7 = 2""")
def pinned_sources(spark, sf_dir):
    """Checksums of files against a pinned manifest with some files changed, some unknown and some gone."""
    found = _pinned(spark, sf_dir, new_path(spark, "pinned"))
    pinned = found.filter("i % 7 <> 1").select("path", "bytes", F.when(F.col("i") % 7 == 0, "other").otherwise(F.col("sha256")).alias("sha256"))
    pinned = pinned.unionByName(found.filter("i % 7 = 2").select(F.concat(F.lit("gone-"), "i").alias("path"), "bytes", "sha256"))
    bad = text.verify_checksums(found.select("path", "bytes", "sha256"), pinned)
    return found.join(bad, "path", "full").select("path", "bytes", "sha256", F.coalesce("problem", F.lit("ok")).alias("problem"))


@query(f"""WITH {_FILES} SELECT path, 'https://example.org/' || path AS url, CASE WHEN i % 7 = 0 THEN 'fetch again' ELSE 'keep' END AS action FROM f
    UNION ALL SELECT 'new/' || path, 'https://example.org/new', 'fetch' FROM f WHERE i % 5 = 1 UNION ALL SELECT '../' || path, 'https://example.org/up', 'refuse' FROM f WHERE i % 5 = 2""")
def fetch_plan(spark, sf_dir):
    """What is left to fetch of a pinned source."""
    found = _pinned(spark, sf_dir, new_path(spark, "pinned"))
    sha = F.when(F.col("i") % 7 == 0, "other").otherwise(F.col("sha256"))
    pinned = found.select("path", F.concat(F.lit("https://example.org/"), "path").alias("url"), sha.alias("sha256"))
    more = lambda rest, at, name: found.filter(f"i % 5 = {rest}").select(F.concat(F.lit(at), "path").alias("path"), F.lit(f"https://example.org/{name}").alias("url"), "sha256")
    return text.fetch_plan(pinned.unionByName(more(1, "new/", "new")).unionByName(more(2, "../", "up")), found)


#: Each file is made from the one before it; some records are of another content, some parents are gone or not recorded.
_LINKS = """f AS (SELECT p_size AS i, 'size-' || p_size AS path, sha256(string_agg(p_name || chr(10), '' ORDER BY p_partkey)) AS sha256 FROM part GROUP BY p_size),
    l AS (SELECT i, CASE WHEN i % 11 = 5 THEN 'lost-' || i WHEN i % 11 = 6 THEN '../' || path ELSE path END AS path, CASE WHEN i % 7 = 3 THEN 'other' ELSE sha256 END AS sha256,
            CASE WHEN i % 4 > 0 THEN 'size-' || (i - 1) END AS parent, CASE WHEN i % 9 = 2 THEN 'other' ELSE (SELECT x.sha256 FROM f x WHERE x.i = f.i - 1) END AS parent_sha256
          FROM f WHERE i % 13 <> 1)"""


@query(f"""WITH {_LINKS}, j AS (SELECT l.*, a.sha256 AS have, b.path AS up, b.sha256 AS up_sha, l.parent IN (SELECT path FROM l) AS recorded FROM l LEFT JOIN f a ON a.path = l.path LEFT JOIN f b ON b.path = l.parent)
    SELECT path, 'unsafe path' AS problem FROM j WHERE starts_with(path, '../') UNION ALL SELECT path, 'missing' FROM j WHERE have IS NULL
    UNION ALL SELECT path, 'changed' FROM j WHERE have IS NOT NULL AND have <> sha256 UNION ALL SELECT path, 'parent missing' FROM j WHERE parent IS NOT NULL AND up IS NULL
    UNION ALL SELECT path, 'parent changed' FROM j WHERE up IS NOT NULL AND up_sha IS DISTINCT FROM parent_sha256 UNION ALL SELECT path, 'parent without a record' FROM j WHERE parent IS NOT NULL AND NOT recorded""")
def manifest_chain(spark, sf_dir):
    """A chain of recorded artefacts: some changed, some lost, some made from what nobody recorded."""
    found = _pinned(spark, sf_dir, new_path(spark, "chain"))
    i, before = F.col("i"), found.select((F.col("i") + 1).alias("i"), F.col("sha256").alias("before"))
    links = found.filter("i % 13 <> 1").join(before, "i", "left").select(
        F.when(i % 11 == 5, F.concat(F.lit("lost-"), i)).when(i % 11 == 6, F.concat(F.lit("../"), "path")).otherwise(F.col("path")).alias("path"),
        F.when(i % 7 == 3, "other").otherwise(F.col("sha256")).alias("sha256"), F.when(i % 4 > 0, F.concat(F.lit("size-"), i - 1)).alias("parent"),
        F.when(i % 9 == 2, "other").otherwise(F.col("before")).alias("parent_sha256"),
    )
    return text.verify_chain(found, links)


@query(f"WITH {_FILES} SELECT path, bytes, sha256, 'pinned' AS source FROM f")
def source_manifest(spark, sf_dir):
    """Files beside what a catalog says of their folder; moved to their place in one step, with a checksum file."""
    staged, final = new_path(spark, "staged"), new_path(spark, "final")
    _pinned(spark, sf_dir, staged)
    sinks.publish(spark, staged, final)
    sums = new_path(spark, "sums")
    sinks.write_checksums(spark, final, sums)
    listed = spark.read.text(sums).select(F.split("value", "  ")[0].alias("listed"), F.regexp_extract("value", "p_size=([0-9]+)/", 1).cast("int").alias("i"))
    files = text.checksums(spark, final).filter(F.col("path").contains("p_size="))
    folder = F.element_at(F.split("path", "/"), -2)
    catalog = files.select(folder.alias("folder"), F.lit("pinned").alias("source")).distinct()
    known = sinks.source_manifest(files, catalog)
    both = known.withColumn("i", F.regexp_extract("path", "p_size=([0-9]+)/", 1).cast("int")).join(listed, "i")
    return both.filter("listed = sha256").select(F.concat(F.lit("size-"), "i").alias("path"), "bytes", "sha256", "source")


@query("""SELECT source_database, count(*) AS record_count, max(malformed)::BIGINT AS malformed_count FROM (
    SELECT 'customers' AS source_database, c_custkey AS k, c_custkey % 3 AS malformed FROM customer UNION ALL SELECT 'suppliers', s_suppkey, s_suppkey % 5
        FROM supplier) GROUP BY source_database""")
def tagged_inventory(spark, sf_dir):
    """Several sources under one another, tagged, and their inventory."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), (F.col("c_custkey") % 3).alias("malformed"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_suppkey") % 5).alias("malformed"))
    return text.inventory(text.tagged_union([("customers", c), ("suppliers", s)]), "source_database").withColumn("malformed_count", F.col("malformed_count").cast("long"))


@query("SELECT n_nationkey, n_name FROM nation")
def view_discovery(spark, sf_dir):
    """The first of several names that a folder has, Parquet before CSV."""
    path = new_path(spark, "views")
    sinks.write_parquet(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), f"{path}/second.parquet")
    sinks.write_csv(table(spark, sf_dir, "region"), f"{path}/second.csv")
    return text.find_view(spark, path, ["first", "second"]).select("n_nationkey", "n_name")


@query("""SELECT count(*) AS rows, count(*) FILTER (value > 50) AS high, count(DISTINCT event_type) AS bars, count(DISTINCT event_type) + 4 AS lines FROM events""")
def run_report(spark, sf_dir):
    """Metrics observed while a table is written, a bar chart, and a report."""
    watched, seen = sinks.measured(table(spark, sf_dir, "events"), "run", rows=F.count(F.lit(1)), high=F.count_if(F.col("value") > 50))
    watched.write.parquet(new_path(spark, "measured"))
    counts = [(r[0], r[1]) for r in table(spark, sf_dir, "events").groupBy("event_type").count().collect()]  # one row a type
    chart, (markdown, _) = sinks.bar_chart("events", counts), sinks.report("events", dict(counts))
    return spark.createDataFrame([(seen.get["rows"], seen.get["high"], chart.count("<rect"), len(markdown.splitlines()))], "rows long, high long, bars long, lines long")


@query(f"""WITH {SEQ}, r AS (SELECT s FROM seq WHERE {GOOD})
    SELECT 'faulty' AS file, 'library_repeats' AS rule, count(*) AS violations FROM (SELECT s FROM r GROUP BY s HAVING count(*) > 1) HAVING count(*) > 0
    UNION ALL SELECT 'faulty', 'library_length', count(*) FROM r WHERE length(s) NOT BETWEEN 8 AND 50 HAVING count(*) > 0""")
def validator(spark, sf_dir):
    """What the command line's checks find in two files: all records of residues, and the valid ones without repeats."""
    from strandloom.validate import violations

    rows = canonical_records(spark, sf_dir).select("rec_id", F.col("rec_id").cast("string").alias("header"), F.col("s").alias("sequence"))
    sound = rows.filter(F.length("sequence").between(8, 50)).groupBy("sequence").agg(F.min("rec_id").alias("rec_id"), F.min("header").alias("header"))
    found = []
    for name, part in (("faulty", rows), ("sound", sound)):
        path = new_path(spark, "validated")
        fasta.write_fasta(part, path, "rec_id")
        found += [(name, rule, n) for rule, n in violations(spark, path).items()]
    return spark.createDataFrame(found, "file string, rule string, violations long")
