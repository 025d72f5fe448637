"""Workbooks of many rows, sheets and gaps; delimited text of several encodings with broken lines."""

import io
import resource
import zipfile

import pytest
from pyspark.sql import functions as F

from lakeforge.sources import sinks
from lakeforge.sources.files import CORRUPT, Feed, read_feed, with_audit
from lakeforge.sources.workbooks import MAIN, WorkbookReader, Part, column_of, read_workbooks

SPACE = MAIN.strip("{}")


def letters(k):
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(path, sheets, shared=True):
    """Writes rows of cells; None leaves a cell out, numbers are numbers, other texts are shared or inline."""
    strings = {}
    parts = {}
    for k, (_, rows) in enumerate(sheets.items(), 1):
        body = io.StringIO()
        body.write(f'<worksheet xmlns="{SPACE}"><sheetData>')
        for i, row in enumerate(rows, 1):
            if row is None:
                continue
            body.write(f'<row r="{i}">')
            for j, x in enumerate(row):
                at = f'r="{letters(j)}{i}"'
                if isinstance(x, (int, float)):
                    body.write(f"<c {at}><v>{x}</v></c>")
                elif x is not None and shared:
                    body.write(f'<c {at} t="s"><v>{strings.setdefault(x, len(strings))}</v></c>')
                elif x is not None:
                    body.write(f'<c {at} t="inlineStr"><is><t>{x}</t></is></c>')
            body.write("</row>")
        body.write("</sheetData></worksheet>")
        parts[f"xl/worksheets/s{k}.xml"] = body.getvalue()
    names = "".join(f'<sheet name="{n}" sheetId="{k}" r:id="r{k}"/>' for k, n in enumerate(sheets, 1))
    links = "".join(f'<Relationship Id="r{k}" Target="worksheets/s{k}.xml"/>' for k in range(1, len(sheets) + 1))
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{SPACE}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{SPACE}">' + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>hint</t></rPh></si>" for s in strings) + "</sst>")
        for n, x in parts.items():
            z.writestr(n, x)


def test_sheets_gaps_and_columns(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"One": [["id", "name", "city"], [1, "Ayşe", None], None, [2, None, "İzmir"], [], [None, None, None]], "Two": [["id", "city"], [3, "x"]]})
    workbook(tmp_path / "b.xlsx", {"One": [["city", "more", "id", "id"], ["y", "z", 4, 5]]}, shared=False)
    paths = [f"{tmp_path}/a.xlsx", f"file://{tmp_path}/b.xlsx"]
    rows = lambda **o: {tuple(r) for r in read_workbooks(spark, paths, **o).collect()}
    one = {("1", "Ayşe", None, paths[0], "One"), ("2", None, "İzmir", paths[0], "One"), ("4", None, "y", paths[1], "One")}
    assert rows() == rows(sheet="One") == one
    assert rows(sheet="*") == one | {("3", None, "x", paths[0], "Two")}
    assert read_workbooks(spark, paths, "*").rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="no sheet"):
        rows(sheet="Three")


def test_many_rows_within_bounded_memory(spark, tmp_path):
    count = 200_000
    workbook(tmp_path / "big.xlsx", {"S": [["id", "kind", "value"], *([i, f"k{i % 7}", i / 4] for i in range(count))]})
    df = read_workbooks(spark, [f"{tmp_path}/big.xlsx"])
    assert df.agg(F.count("*"), F.countDistinct("id"), F.sum(F.col("value").cast("double"))).first()[:] == (count, count, sum(i / 4 for i in range(count)))
    reader = WorkbookReader(df.schema, [], None)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    sizes = [b.num_rows for b in reader.read(Part(f"{tmp_path}/big.xlsx", None))]
    grown = (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024
    assert sum(sizes) == count and max(sizes) <= 5000 and grown < 80, grown


def test_a_feed_of_workbooks_keeps_each_rows_file(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"S": [["id"], [1]]})
    workbook(tmp_path / "b.xlsx", {"S": [["id"], [2]]})
    feed = Feed("f", "s", str(tmp_path), format="xlsx", sheet="S")
    out = with_audit(read_feed(spark, feed), feed, "b1").collect()
    assert {(r.id, r._source_file.rsplit("/", 1)[1]) for r in out} == {("1", "a.xlsx"), ("2", "b.xlsx")}
    assert len({r._row_hash for r in out}) == 2


@pytest.mark.parametrize("k, name", [(0, "A1"), (25, "Z9"), (26, "AA3"), (701, "ZZ1"), (702, "AAA12")])
def test_columns(k, name):
    assert column_of(name) == k and name.startswith(letters(k))


def test_broken_lines_are_counted_and_kept_apart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_bytes("id;şehir\n1;Muğla\n2\n3;a;b\n4;İzmir\n".encode("windows-1254"))
    feed = Feed("f", "s", str(tmp_path / "in"), delimiter=";", encoding="windows-1254")
    path = str(tmp_path / "out")
    df = with_audit(read_feed(spark, feed), feed, "007")
    assert df.columns[:2] == ["id", "şehir"]
    assert sinks.replace_batch(df, path, "007") == {"rows_read": 4, "rows_written": 2, "rows_rejected": 2}
    assert sinks.replace_batch(df.where("id = '1'"), path, "7")["rows_written"] == 1
    assert {(r._batch_id, r.id, r["şehir"]) for r in sinks.read_table(spark, path).collect()} == {("007", "1", "Muğla"), ("007", "4", "İzmir"), ("7", "1", "Muğla")}
    bad = spark.read.option("recursiveFileLookup", "true").parquet(f"{path}_rejected")
    assert {(r._batch_id, r[CORRUPT]) for r in bad.collect()} == {("007", "2"), ("007", "3;a;b")} and "_source_file" in bad.columns
    assert sinks.replace_batch(df.where("id = '1'"), path, "007")["rows_rejected"] == 0
    assert spark.read.option("recursiveFileLookup", "true").parquet(f"{path}_rejected").where("_batch_id = '007'").count() == 0
    for odd in ("a/b=c", "..", " x"):
        sinks.replace_batch(df.where("id = '1'"), path, odd)
    assert {r._batch_id for r in sinks.read_table(spark, path).select("_batch_id").distinct().collect()} == {"007", "7", "a/b=c", "..", " x"}


def test_two_encodings_in_one_session(spark, tmp_path):
    texts = {"windows-1254": "ığüşöç İĞŞ €", "windows-1251": "Привет €", "iso-8859-1": "é ü ß", "utf-8": "漢字 ığ", "windows-1252": "“quoted” – é"}
    for k, (name, text) in enumerate(texts.items()):
        (tmp_path / f"{k}").mkdir()
        (tmp_path / f"{k}" / "a.csv").write_bytes(f'id,{text[:2].strip()}x\n1,"{text}, q"\n'.encode(name))
    frames = [read_feed(spark, Feed("f", "s", str(tmp_path / f"{k}"), encoding=n)) for k, n in enumerate(texts)]
    for df, text in zip(frames, texts.values(), strict=True):
        assert df.columns == ["id", f"{text[:2].strip()}x", CORRUPT] and df.count() == 1
        assert [r[1] for r in df.collect()] == [f"{text}, q"]
    assert spark.conf.get("spark.sql.legacy.javaCharsets", "false") == "false"
