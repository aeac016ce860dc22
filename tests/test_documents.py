"""Sheets in the order of their tabs, and the plans of documents read from glyphs and grids."""

import datetime as dt
import io
import zipfile

import pytest
from pyspark.sql import functions as F

from flowpanel import queries
from flowpanel.sources import geometry, readers

SF = "/root/testdata/sf0.001"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(sheets, tabs, late=False, rooted=False):
    """A workbook: parts by name with their rows of (reference or None, value), tabs as part names in order."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        for name, rows in sheets.items():
            cell = lambda ref, v: f'<c{f" r={chr(34)}{ref}{chr(34)}" if ref else ""} ' + (f't="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else f's="{1 if isinstance(v, bool) else 0}"><v>{int(v) if isinstance(v, bool) else v}</v></c>')
            body = "".join(f'<row r="{k}">' + "".join(cell(*c) for c in row) + "</row>" for k, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/{name}.xml", f'<worksheet xmlns="{MAIN}"><sheetData>{body}</sheetData></worksheet>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}"><cellXfs><xf numFmtId="0"/><xf numFmtId="14"/></cellXfs></styleSheet>')
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{REL}"><workbookPr{" date1904=" + chr(34) + "1" + chr(34) if late else ""}/><sheets>' + "".join(f'<sheet name="t{k}" sheetId="{k}" r:id="r{t}"/>' for k, t in enumerate(tabs, 1)) + "</sheets></workbook>")
        z.writestr("xl/chartsheets/chart.xml", "<x/>")
        target = "/xl/worksheets/" if rooted else "worksheets/"
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x">' + "".join(f'<Relationship Id="r{t}" Target="{target}{t}.xml"/>' for t in sheets) + '<Relationship Id="rchart" Target="chartsheets/chart.xml"/></Relationships>')
    return bytearray(buf.getvalue())


def report(nav):
    return [[("C1", "2.1"), ("D1", nav), ("E1", 1)], [("C2", "3.1"), ("D2", 5)]]


@pytest.mark.parametrize("rooted", [False, True])
def test_the_first_tab_is_read_whatever_its_part_is_called(spark, rooted):
    sheets = {"sheet1": report(11), "sheet2": report(22)}
    files = [("a", book(sheets, ["chart", "sheet2", "sheet1"], rooted=rooted)), ("b", book(sheets, ["sheet1", "sheet2"], rooted=rooted)), ("c", book(sheets, ["sheet1"]))]
    grid = readers.read_xlsx(spark.createDataFrame(files, "path string, content binary"))
    got = {r["doc_id"]: r["this"] for r in readers.grid_cells(grid).where("code = '2.1'").collect()}
    assert got == {"a": 22.0, "b": 11.0, "c": 11.0}


def test_cells_without_references_and_days_from_1904(spark):
    rows = [[(None, "x"), (None, 3)], [("C2", True)]]
    for late, first in ((False, dt.date(1899, 12, 31)), (True, dt.date(1904, 1, 2))):
        grid = readers.read_xlsx(spark.createDataFrame([("a", book({"sheet1": rows}, ["sheet1"], late))], "path string, content binary"))
        assert sorted((r["row"], r["col"], r["value_str"], r["value_num"], r["day"]) for r in grid.collect()) == [(1, 1, "x", None, None), (1, 2, None, 3.0, None), (2, 3, None, None, first)]


def test_the_chosen_sheet_and_its_columns(spark):
    """The column with most codes counts, the first on a tie; a sheet whose 2.1 has no number is passed over."""
    cells = [("p", 1, 1, 3, "2.1", None), ("p", 2, 1, 1, "2.1", None), ("p", 2, 1, 4, None, 9.0), ("p", 2, 1, 6, None, 8.0), ("p", 2, 2, 1, "3.1", None), ("p", 2, 2, 2, "3.2", None), ("p", 2, 2, 4, None, 7.0), ("p", 2, 3, 1, "3.1", None), ("p", 2, 3, 4, None, 1.0), ("p", 2, 4, 2, "2.1", None), ("p", 3, 1, 1, "2.1", None), ("p", 3, 1, 2, None, 5.0)]
    grid = spark.createDataFrame([(*c, False, None, None) for c in cells], readers.GRID)
    assert sorted((r["code"], r["this"], r["last"]) for r in readers.grid_cells(grid).collect()) == [("2.1", 9.0, 8.0), ("3.1", 7.0, None)]


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning(")


def test_one_exchange_by_document(spark):
    glyphs = spark.createDataFrame([("d", 1, 10.0, 10.0, 15.0, "2")], "doc_id string, page int, top double, x0 double, x1 double, text string")
    assert exchanges(geometry.parse_glyphs(glyphs)) == 1
    grid = spark.createDataFrame([("p", 1, 1, 1, "2.1", None, False, None, None)], readers.GRID)
    assert exchanges(readers.parse_grids(grid)) == 1


def test_queries_of_documents_deal_out_once_besides_the_ledger(spark):
    ledger = exchanges(queries.ledger(spark, SF))
    for name in ("glyph_filings", "grid_filings"):
        # the grid's query joins its funds, so the ledger stands twice in it
        assert exchanges(queries.QUERIES[name](spark, SF)) <= (1 + (name == "grid_filings")) * (ledger + 1) + 1


def test_pages_keep_apart(spark):
    """Equal heights on two pages are two lines, and a detached value belongs to its own page."""
    rows = [(p, top, x + 5.0 * i, c) for p, top, x, t in ((1, 10.0, 10.0, "2.1"), (1, 10.0, 60.0, "100"), (1, 10.0, 100.0, "50"), (2, 10.0, 10.0, "3.1"), (2, 15.0, 50.0, "2,000"), (2, 15.0, 100.0, "60"), (3, 12.0, 50.0, "3,000"), (3, 12.0, 100.0, "70")) for i, c in enumerate(t)]
    df = spark.createDataFrame([("d", p, top, x, x + 5.0, c) for p, top, x, c in rows], "doc_id string, page int, top double, x0 double, x1 double, text string")
    assert sorted(tuple(r) for r in geometry.cells(df).collect()) == [("d", "2.1", 100.0, 50.0), ("d", "3.1", 2000.0, 60.0)]
    assert geometry.documents(df).first()["text"] == "2.1 100 50\n3.1\n2,000 60\n3,000 70"
    assert geometry.cells(df.where(F.lit(False))).count() == 0
