"""Workbooks: hand-made ones are read, written ones are read again."""

import datetime as dt
import io
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from ledgerline.sources import files, sinks, workbook

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def handmade(path, first_sheet, date1904=False):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr date1904="{int(date1904)}"/><sheets><sheet name="Main &amp; more" sheetId="1" r:id="a"/><sheet name="Empty" sheetId="2" r:id="b"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="a" Target="/xl/worksheets/one.xml"/><Relationship Id="b" Target="worksheets/two.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}"><si><t>code</t></si><si><r><t>ri</t></r><r><t>ch</t></r><rPh><t>no</t></rPh></si><si><t xml:space="preserve"> 007 </t></si></sst>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><numFmts><numFmt numFmtId="170" formatCode="00000"/><numFmt numFmtId="171" formatCode="[$-409]d\\-mmm\\-yy;@"/><numFmt numFmtId="172" formatCode="#,##0.00 &quot;days&quot;"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="172"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/worksheets/one.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{first_sheet}</sheetData></worksheet>')
        z.writestr("xl/worksheets/two.xml", f'<worksheet xmlns="{MAIN}"><sheetData/></worksheet>')
    return f"file://{path}"


SHEET = """<row r="2"><c r="A2" t="s"><v>0</v></c><c r="B2" t="inlineStr"><is><t>code</t></is></c><c r="D2" t="s"><v>1</v></c></row>
<row r="3"><c r="A3" t="s"><v>2</v></c><c r="B3" s="2"><v>42</v></c><c r="D3" s="1"><v>45296</v></c></row>
<row r="4"/><row r="5"><c r="A5"><v>1234567890123</v></c><c r="B5" s="4"><v>1.5</v></c><c r="C5" t="b"><v>1</v></c><c r="D5" s="5"><v>45296.75</v></c><c r="E5"><v>9</v></c></row>
<row r="6"><c r="B6" t="e"><v>#N/A</v></c><c r="C6" t="str"><f>A1</f><v>text</v></c><c r="D6" s="3"><v>1</v></c></row>"""


def test_a_handmade_workbook(spark, tmp_path):
    path = handmade(tmp_path / "a.xlsx", SHEET)
    assert files.excel_info(spark, path) == [{"sheet": "Main & more", "columns": ["code", "code.1", "Unnamed: 2", "rich"], "rows": 3}, {"sheet": "Empty", "columns": [], "rows": 0}]
    rows = [tuple(r) for r in files.read_excel(spark, path).orderBy("_row_pos").collect()]
    assert rows == [(0, " 007 ", "00042", None, "2024-01-05"), (2, "1234567890123", "1.5", "True", "2024-01-05 18:00:00"), (3, None, None, "text", "1900-01-01")]
    assert files.excel_sheets(spark, path) == ["Main & more", "Empty"] and files.read_excel(spark, path, "Empty").count() == 0
    later = handmade(tmp_path / "b.xlsx", SHEET, date1904=True)
    assert files.read_excel(spark, later).filter("_row_pos = 0").first()["rich"] == "2028-01-06"
    with pytest.raises(ValueError, match="no sheet"):
        files.read_excel(spark, path, "Other")
    assert [tuple(r) for r in files.ingest(spark, path, "Main & more").data.select("rich").collect()][0] == ("2024-01-05",)


def test_what_is_written_is_read_again(spark, tmp_path):
    rows = [
        (1, "007", 1.5, Decimal("1.10"), True, dt.date(2024, 2, 29), dt.datetime(2024, 2, 29, 13, 5, 7), 12345678901234567, [1, 2]), (2, " <a> & \"b\"\n\tü𝒜\x01 ", float("nan"), Decimal("12345678901234567.25"), False, dt.date(1850, 1, 1), None, -3, None),
        (3, None, 1e300, None, None, None, dt.datetime(1999, 12, 31, 23, 59, 59), None, []), (4, "", -0.1, Decimal("-7.00"), True, dt.date(1900, 3, 1), None, 0, [3]),
    ]
    df = spark.createDataFrame(rows, "_row int, s string, d double, m decimal(20,2), b boolean, day date, at timestamp_ntz, n bigint, list array<int>").repartitionByRange(3, "_row").sortWithinPartitions("_row")
    path = f"file://{tmp_path}/out.xlsx"
    sinks.export_excel({"Data: one/two?": df, "data_ one_two_": spark.range(3), "Third": spark.range(0)}, path, metadata={"by": "me", "none": None})
    assert [(s["sheet"], s["rows"]) for s in files.excel_info(spark, path)] == [("Summary", 3), ("Data_ one_two_", 4), ("data_ one_two__2", 3), ("Third", 0), ("Metadata", 2)]
    got = [tuple(r) for r in files.read_excel(spark, path, "Data_ one_two_").orderBy("_row_pos").collect()]
    assert got[0] == (0, "1", "007", "1.5", "1.1", "True", "2024-02-29", "2024-02-29 13:05:07", "12345678901234567", '{"v":[1,2]}')
    assert got[1] == (1, "2", " <a> & \"b\"\n\tü𝒜 ", None, "12345678901234567.25", "False", "1850-01-01", None, "-3", None) or got[1][-1] == "{}"
    assert got[2][1:8] == ("3", None, "1e+300", None, None, None, "1999-12-31 23:59:59") and got[3][1:7] == ("4", "", "-0.1", "-7", "True", "1900-03-01")
    assert {tuple(r)[1:] for r in files.read_excel(spark, path, "Summary").collect()} == {("Data: one/two?", "4", "57.14"), ("data_ one_two_", "3", "42.86"), ("Third", "0", "0")}
    assert [tuple(r) for r in files.read_excel(spark, path, "Metadata").collect()] == [(0, "by", "me"), (1, "none", None)]
    with pytest.raises(Exception, match="characters at most"):
        sinks.export_excel({"x": spark.range(1).select(F.repeat(F.lit("x"), 40000).alias("x"))}, path)


def test_many_rows_keep_their_order(spark, tmp_path):
    path = f"file://{tmp_path}/many.xlsx"
    sinks.export(spark.range(0, 9000, 1, 5).selectExpr("id", "concat('row ', id) AS t"), path, "excel")
    back = files.read_excel(spark, path)
    assert back.count() == 9000 and back.filter("_row_pos <> id OR t <> concat('row ', id)").count() == 0


def test_more_rows_than_a_sheet_holds_go_on_in_the_next(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 1001)
    path = f"file://{tmp_path}/long.xlsx"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "300")
    try:
        long = spark.range(0, 2500, 1, 3).selectExpr("id", "concat('row ', id) AS t")
        sinks.export_excel({"It's <long>": long, "It's <long>_2": spark.range(3)}, path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    info = [(s["sheet"], s["rows"]) for s in files.excel_info(spark, path)]
    assert info[0] == ("Summary", 2) and info[-1] == ("It's <long>_2", 3) and sum(n for _, n in info[1:-1]) == 2500 and len(info) >= 5 and all(n <= 1000 for _, n in info)
    back = files.read_excel(spark, path, "It's <long>")
    assert back.count() == 2500 and back.filter("_row_pos <> id OR t <> concat('row ', id)").count() == 0
    assert files.read_excel(spark, path, "It's <long>_2").count() == 3
    with zipfile.ZipFile(tmp_path / "long.xlsx") as book:
        assert book.testzip() is None  # sizes and check sums


def test_a_sheet_is_cut_between_rows_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "PIECE", 64)
    cell = lambda i: f"<c><v>{i}</v></c>" if i % 3 else f"<c t='inlineStr'><is><t><![CDATA[</row><row> {i}]]></t></is></c>"
    rows = "".join(f"<row{f' r=' + chr(34) + str(2 * i) + chr(34) if i in (5, 9) else ''}>{cell(i)}</row>{'<row/>' if i % 4 == 0 else ''}" for i in range(40))
    path = handmade(tmp_path / "cut.xlsx", "<row><c t='inlineStr'><is><t>n</t></is></c></row>" + rows)
    content = (tmp_path / "cut.xlsx").read_bytes()
    book = workbook.Book(content)
    whole = list(book.rows("Main & more"))
    pieces = list(book.cut("Main & more"))
    assert len(pieces) > 10 and [r for at, _, xml in pieces for r in book.cells.rows(io.BytesIO(xml), at)] == whole
    assert [r.n for r in files.read_excel(spark, path).orderBy("_row_pos").collect()] == [v[0] for _, v in whole[1:]]
