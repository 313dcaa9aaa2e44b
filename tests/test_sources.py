"""Sources and sinks on files made here."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from strandloom.sources import fasta, sinks, text, xlsx
from strandloom.streaming import incremental


def test_fasta(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a test > x\nACDE\nFGHI\n>b\nKKKKKKKK\n")
    rows = sorted(fasta.read_fasta(spark, str(tmp_path / "a.fa")).collect(), key=lambda r: r.id)
    assert [(r.id, r.header, r.sequence, r.malformed) for r in rows] == [("a", "a test > x", "ACDEFGHI", 0), ("b", "b", "KKKKKKKK", 0)]
    assert fasta.read_fasta_strict(spark, str(tmp_path / "a.fa")).count() == 2


def test_fasta_without_header(spark, tmp_path):
    (tmp_path / "b.fa").write_text("ACDEFGHI\n>x\nKK\n")
    assert [(r.id, r.malformed) for r in fasta.read_fasta(spark, str(tmp_path / "b.fa")).collect()] == [("x", 1)]
    (tmp_path / "c.fa").write_text("ACDEFGHI\n")
    assert fasta.read_fasta(spark, str(tmp_path / "c.fa")).count() == 0
    assert [r.malformed for r in fasta.malformed_lines(spark, str(tmp_path / "c.fa")).collect()] == [1]
    with pytest.raises(Exception, match="before the first header"):
        fasta.read_fasta_strict(spark, str(tmp_path / "c.fa")).collect()
    (tmp_path / "d.fa").write_text(">x\n>y\nKK\n")
    with pytest.raises(Exception, match="empty record"):
        fasta.read_fasta_strict(spark, str(tmp_path / "d.fa")).collect()


def test_fasta_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(2, "b", "KK"), (1, "a", "AC")], "o int, header string, sequence string")
    fasta.write_fasta(df, str(tmp_path / "out"), "o")
    assert {(r.id, r.sequence) for r in fasta.read_fasta(spark, str(tmp_path / "out")).collect()} == {("a", "AC"), ("b", "KK")}
    assert df.select(fasta.ranked_header(F.col("o"), F.lit("ar"), F.col("header"))).first()[0] == "rank_002_ar_b"


def test_csv_and_encodings(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"first line\nsecond ""line"""\n')
    assert text.read_csv(spark, str(tmp_path / "a.csv")).first()["note"] == 'first line\nsecond "line"'
    (tmp_path / "x.txt").write_bytes("µM".encode("cp1252"))
    (tmp_path / "y.txt").write_bytes(b"\xef\xbb\xbfhi")
    got = {r.path[-5:]: (r.text, r.encoding) for r in text.read_decoded(spark, str(tmp_path / "*.txt")).collect()}
    assert got == {"x.txt": ("µM", "cp1252"), "y.txt": ("hi", "utf-8-sig")}
    with pytest.raises(ValueError):
        text.check_sequence(spark.createDataFrame([(1,), (3,)], "i int"), "i")
    with pytest.raises(ValueError):
        text.safe_destination("/data", "../x")


def test_foreign_files_in_readers(spark, tmp_path):
    folder = tmp_path / "mixed"
    folder.mkdir()
    (folder / "a.csv").write_bytes('id,unit\n1,"µM, ""x""\nnext"\n'.encode("cp1252"))
    (folder / "b.csv").write_bytes("id,unit\n2,µg\n".encode())
    (folder / "c.csv").write_bytes(b"id,unit\n3,\x81\xb5\n")  # no cp1252
    (folder / "d.csv").write_bytes(b"\xef\xbb\xbfid,unit\n4,plain\n")
    assert sorted(text.foreign_files(spark, str(folder)).values()) == ["cp1252", "latin-1"]
    got = {r.id: r.unit for r in text.read_csv(spark, str(folder)).collect()}
    assert got == {"1": 'µM, "x"\nnext', "2": "µg", "3": "\x81µ", "4": "plain"}
    fa = tmp_path / "fa"
    fa.mkdir()
    (fa / "a.fa").write_bytes(">µ one\nAC\nDE\n>two\nKK\n".encode("cp1252"))
    (fa / "b.fa").write_bytes(">é\r\nRR\r\n".encode())
    assert {(r.header, r.sequence) for r in fasta.read_fasta(spark, str(fa)).collect()} == {("µ one", "ACDE"), ("two", "KK"), ("é", "RR")}
    assert fasta.read_fasta_strict(spark, str(fa)).count() == 3


def test_chain_and_plan(spark):
    found = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha256 string")
    links = [("a", "1", None, None), ("b", "2", "a", "1")]
    schema = "path string, sha256 string, parent string, parent_sha256 string"
    assert text.verify_chain(found, spark.createDataFrame(links, schema)).count() == 0
    bad = text.verify_chain(found, spark.createDataFrame([("b", "2", "a", "9")], schema)).collect()
    assert {r.problem for r in bad} == {"parent changed", "parent without a record"}
    plan = text.fetch_plan(found.withColumn("url", F.lit("u")).withColumn("sha256", F.lit("1")), found).collect()
    assert {(r.path, r.action) for r in plan} == {("a", "keep"), ("b", "fetch again")}


def workbook():
    out = io.BytesIO()
    cell = lambda ref, value: f'<c r="{ref}" t="inlineStr"><is><t>{value}</t></is></c>'
    rows = f'<row r="1">{cell("A1", "first")}{cell("B1", "middle")}{cell("C1", "last")}</row><row r="2">{cell("A2", "one")}{cell("C2", "three")}</row>'
    with zipfile.ZipFile(out, "w") as book:
        book.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{rows}</sheetData></worksheet>')
    return out.getvalue()


def test_xlsx(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(workbook())
    want = {"first": "one", "middle": "", "last": "three"}
    assert xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx")).first()["record"] == want
    xlsx.register(spark)
    assert spark.read.format("xlsx").load(str(tmp_path / "a.xlsx")).first()["record"] == want


def long_workbook(path, rows, sheets=1):
    """Sheets of ``rows`` rows, some of whose strings are shared."""
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as book:
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>n</t></si><si><r><t>te</t></r><r><t>xt</t></r></si><si><t>odd</t></si><si><t>even</t></si></sst>')
        for k in range(sheets):
            with book.open(f"xl/worksheets/sheet{k + 1}.xml", "w") as file:
                file.write(f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c></row>'.encode())
                for i in range(rows):
                    file.write(f'<row r="{i + 2}"><c r="A{i + 2}"><v>{i}</v></c><c r="B{i + 2}" t="s"><v>{3 - i % 2}</v></c></row>'.encode())
                file.write(b"</sheetData></worksheet>")


def test_long_sheets_are_pulled_row_by_row(tmp_path):
    import tracemalloc

    path = tmp_path / "long.xlsx"
    long_workbook(path, 200_000)
    tracemalloc.start()
    with open(path, "rb") as file:
        n = sum(1 for _, _, r in xlsx.rows_of(file) if r["text"] == "even")
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 100_000 and peak < 3_000_000


def test_parts_columns_and_sheets(spark, tmp_path):
    path = str(tmp_path / "two.xlsx")
    long_workbook(path, 3000, 2)
    want = {(f"xl/worksheets/sheet{k + 1}.xml", k * 3000 + i, str(i), ("even", "odd")[i % 2]) for k in (0, 1) for i in range(3000)}
    rows = lambda df: [(r.sheet, r.record_ord, r.record["n"], r.record.get("text")) for r in df.collect()]
    for parts in (1, 3):
        got = rows(xlsx.read_xlsx(spark, path, parts))
        assert len(got) == 6000 and set(got) == want
    xlsx.register(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        got = rows(spark.read.format("xlsx").option("parts", 2).option("columns", "n").option("pushdown", "true").load(path).filter("sheet = 'xl/worksheets/sheet2.xml'"))
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    assert set(got) == {(s, i, n, None) for s, i, n, _ in want if s.endswith("2.xml")}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", ["b", "a"])], "b int, a string, c array<string>")
    assert sinks.ordered_columns(df).columns == ["a", "b", "c"] and sinks.ordered_columns(df, ["z", "a"]).first()["z"] is None
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert text.read_csv(spark, str(tmp_path / "csv")).first()["c"] == "b;a"
    sinks.write_parquet(df, str(tmp_path / "staged"))
    sinks.publish(spark, str(tmp_path / "staged"), str(tmp_path / "final"))
    with pytest.raises(FileExistsError):
        sinks.publish(spark, str(tmp_path / "csv"), str(tmp_path / "final"))
    sums = text.checksums(spark, str(tmp_path / "final"))
    assert text.verify_checksums(sums, sums).count() == 0 and text.verify_checksums(sums, sums.limit(0)).count() == sums.count()
    assert "<svg" in sinks.bar_chart("t", [("a", 1)]) and "| a | 1 |" in sinks.report("t", {"a": 1})[0]


def test_stream_screen(spark, tmp_path):
    src, ref = str(tmp_path / "in"), spark.createDataFrame([(1, "ACDEFGHI")], "k long, s string")
    spark.createDataFrame([(5, " acdefghi"), (6, "KKKKKKKK"), (7, "KKKKKKKK")], "k long, s string").write.parquet(src)
    run = incremental.screen_batches(ref, "k", "s", str(tmp_path / "known"), str(tmp_path / "out"))
    stream = spark.readStream.schema("k long, s string").parquet(src)
    q = stream.writeStream.foreachBatch(run).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    run(spark.read.parquet(src), 0)  # a second run of the same batch changes nothing
    got = {r.s: r.passes_novelty_rule_le80 for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {"ACDEFGHI": False, "KKKKKKKK": True}


def test_validator(spark, tmp_path):
    from strandloom.validate import violations

    cases = {">a\nACDEFGHI\n>b\nKKKKKKKK\n": set(), "": {"no_records"}, "ACDEFGHI\n": {"no_records", "malformed_lines"}, ">a\nACD\n>b\nACD\n": {"library_length", "library_repeats"}, ">a\nACDEFGHX\n": {"library_alphabet"}}
    for i, (content, want) in enumerate(cases.items()):
        (tmp_path / f"{i}.fa").write_text(content)
        assert set(violations(spark, str(tmp_path / f"{i}.fa"))) == want, content
