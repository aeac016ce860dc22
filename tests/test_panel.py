import datetime as dt
import io
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowpanel.functions import parsing
from flowpanel.operators import gates, panel, stats
from flowpanel.plans import build, run
from flowpanel.sources import catalog, geometry, rates, readers, sinks
from flowpanel.streaming import restatements

D = dt.date
SCHEMA = "fund_code string, period_start date, period_end date, nav_begin double, nav_end double, chg_investment double, subscriptions double, redemptions double, chg_flows_net double, chg_distribution double, source string"


def row(fund, start, end, begin=1e11, invest=1e8, subs=5e8, reds=-2e8, source="f_1", off=0.0):
    return (fund, start, end, begin, begin + invest + subs + reds + off, invest, subs, reds, None, None, source)


@pytest.mark.parametrize("token, value", [("302,234,351,773", 302234351773.0), ("(96,819,279)", -96819279.0), ("21,439.31", 21439.31), ("20.54%", 20.54), ("(2,078", -2078.0), ("2,078)", -2078.0), (" 1 000 ", 1000.0), ("n/a", None), ("", None), ("-", None), (None, None)])
def test_numbers(spark, token, value):
    df = spark.createDataFrame([(token,)], "t string").select(parsing.parse_number(F.col("t")).alias("v"))
    assert df.collect()[0]["v"] == value


def test_header_conflict_and_new_year(spark):
    df = spark.createDataFrame([("Từ ngày 28 tháng 12 năm 2023 đến ngày 03 tháng 01 năm 2024 From 28 Dec 2023 to 03 Dec 2024",), ("From 29 Dec to 04 Jan 2025",), ("từ 05/12/2023 đến 11/12/2023",)], "t string")
    got = [r[0] for r in df.select(parsing.header_period(F.col("t"))).collect()]
    assert got[0]["end"] == D(2024, 1, 3) and "2024-12-03" in got[0]["conflict"]
    assert got[1]["start"] == D(2024, 12, 29) and got[1]["conflict"] is None
    assert (got[2]["start"], got[2]["end"]) == (D(2023, 12, 5), D(2023, 12, 11))


def test_quarantine_dedupe_and_breaks(spark):
    rows = [
        row("AAA", D(2023, 1, 2), D(2023, 1, 8)),
        row("AAA", D(2023, 1, 2), D(2023, 1, 8), subs=6e8, source="f_3"),
        row("BBB", D(2023, 1, 2), D(2023, 12, 6)),
        row("CCC", D(2023, 1, 2), D(2023, 1, 8), off=1e6),
        row("DDD", D(2023, 1, 2), D(2023, 1, 8)),
        row("DDD", D(2023, 1, 16), D(2023, 1, 22), begin=5e11),
    ]
    r = build.build(spark.createDataFrame(rows, SCHEMA))
    assert r.panel.count() == 3 and r.superseded.collect()[0]["reason"] == "restatement"
    assert {x["fund_code"]: x["w"] for x in r.quarantine.withColumn("w", gates.reasons(F.col("quarantine_reason"))).collect()} == {"BBB": "period_days", "CCC": "identity"}
    assert ["missed filing between 2023-01-08 and 2023-01-16" in x["detail"] for x in r.continuity_breaks.collect()] == [True]
    assert sum(x["n"] for x in build.audit(r).collect()) == len(rows)
    assert build.build(spark.createDataFrame([], SCHEMA)).panel.count() == 0


def test_absent_legs_are_not_zero(spark):
    rows = [("A", 100.0, None, None, 5.0), ("B", 100.0, None, None, None), ("C", 100.0, 3.0, None, 3.0), ("D", 0.0, 3.0, None, 3.0)]
    df = gates.with_flow_measures(spark.createDataFrame(rows, "f string, nav_begin double, subscriptions double, redemptions double, net_flow double"))
    got = {r["f"]: r for r in df.collect()}
    assert got["A"]["gross_legs_disclosed"] is False and got["A"]["churn_rate"] is None
    assert got["B"]["gross_legs_disclosed"] and got["B"]["churn_rate"] == 0 and got["B"]["flow_asymmetry"] is None
    assert got["C"]["flow_asymmetry"] == 1 and got["D"]["net_flow_rate"] is None and got["D"]["flow_asymmetry"] == 1


def test_asof_day(spark):
    rows = spark.createDataFrame([(D(2023, 1, 2),), (D(2022, 1, 1),), (D(2023, 1, 6),)], "d date")
    series = spark.createDataFrame([(D(2022, 12, 30), 1000.0), (D(2023, 1, 3), 1010.0), (D(2023, 1, 6), 1020.0)], "day date, close double")
    got = {r["d"]: r["c"] for r in panel.asof_days(rows, series, "d", "close", "c").collect()}
    assert got == {D(2023, 1, 2): 1000.0, D(2022, 1, 1): None, D(2023, 1, 6): 1020.0}


def test_text_filing_and_rejects(spark):
    good = "Fund (ABCF)\nTừ ngày 17 tháng 11 năm 2022 đến ngày 21 tháng 11 năm 2022\n1.1 302,234 303,392\n1.2\n1.3 21,439.31 21,517.75\n2.1 312,389 302,234\n3.2.1 80,627 146,183\n3.2.2 (96,819) (198,860)\n6.3 20.54% 20.47%"
    docs = spark.createDataFrame([("a", good, "X", "u"), ("b", "2.1 100 90", None, None), ("c", "nothing", None, None), ("d", "  ", None, None), ("e", None, None, None)], "doc_id string, text string, fund_code string, source string")
    parsed = readers.parse_texts(docs)
    got = {r["doc_id"]: r for r in parsed.collect()}
    a = got["a"]
    assert (a["fund_code"], a["source"], a["nav_begin"], a["redemptions"], a["prior_nav_end"], a["foreign_ownership_pct"], a["chg_investment"]) == ("X", "u", 302234.0, -96819.0, 302234.0, 20.54, None)
    assert a["period_start"] == D(2022, 11, 17) and a["error"] is None
    assert readers.parse_texts(docs.drop("fund_code")).where("doc_id = 'a'").first()["fund_code"] == "ABCF"
    assert "point-in-time" in got["b"]["error"] and "2.1" in got["c"]["error"] and "no text" in got["d"]["error"] and "no text" in got["e"]["error"]
    filings, failures = readers.split_failures(parsed)
    assert filings.count() == 1 and failures.count() == 4
    assert readers.parse_texts(docs.limit(0)).count() == 0


def test_header_lines_are_no_template_lines(spark):
    text = "Fund (ABCF)\n4 Kỳ báo cáo: Từ ngày 17 tháng 11 năm 2022 đến ngày 21 tháng 11 năm 2022\n5 Ngày lập báo cáo: Ngày 22 tháng 11 năm 2022\n2.1 400 300\n3.1 5 6\n4 721.53 (78.44)\n6.2 100 90"
    english = "4 Reporting period: From 17 Nov 2022 to 21 Nov 2022\n5 Reporting Date: 22 Nov 2022\n2.1 0 300\n3.1 5 6\n6.2 1 1"
    docs = spark.createDataFrame([("a", text), ("b", english)], "doc_id string, text string")
    got = {r["doc_id"]: r for r in build.filing_rows(readers.parse_texts(docs)).collect()}
    assert (got["a"]["chg_nav_per_unit"], got["a"]["prior_chg_nav_per_unit"], got["a"]["foreign_share_of_nav"]) == (721.53, -78.44, 25.0)
    assert got["b"]["chg_nav_per_unit"] is None and got["b"]["foreign_share_of_nav"] is None
    assert got["a"]["report_date"] == got["b"]["report_date"] == D(2022, 11, 22)


def golden_text(change="10,171,039,485"):
    """A whole filing as its text layer prints it: labels in both languages between the lines."""
    lines = """Blue Chip Fund (VCBBCF)
    4 Kỳ báo cáo: Từ ngày 17 tháng 11 năm 2022 đến ngày 21 tháng 11 năm 2022
    Reporting period: From 17 Nov 2022 to 21 Nov 2022
    5 Ngày lập báo cáo: Ngày 22 tháng 11 năm 2022
    Reporting Date: 22 Nov 2022
    1
    Net asset value at the beginning
    1.1 302,234,351,773 303,392,880,988
    1.2
    1.3 21,439.31 21,517.75
    2
    2.1 312,389,199,705 302,234,351,773
    2.2
    2.3 22,160.84 21,439.31
    3
    3.1 CHANGE (1,105,852,259)
    3.2 (16,191,553) (52,676,956)
    3.2.1 80,627,726 146,183,850
    3.2.2 (96,819,279) (198,860,806)
    3.3
    4 721.53 (78.44)
    5.1 31,723.28 31,723.28
    5.2 21,439.31 21,439.31
    6.1 2,885,796.11 2,885,796.11
    6.2 63,951,665,866 61,869,477,399
    6.3 20.54% 20.47%   """
    return lines.replace("    ", "").replace("CHANGE", change)


def test_golden_document(spark):
    docs = spark.createDataFrame([("a", golden_text())], "doc_id string, text string")
    parsed = build.filing_rows(readers.parse_texts(docs))
    (got,) = parsed.collect()
    want = {
        "nav_begin": (302234351773, 303392880988), "nav_per_unit_begin": (21439.31, 21517.75), "nav_end": (312389199705, 302234351773), "nav_per_unit_end": (22160.84, 21439.31),
        "chg_investment": (10171039485, -1105852259), "chg_flows_net": (-16191553, -52676956), "subscriptions": (80627726, 146183850), "redemptions": (-96819279, -198860806),
        "chg_distribution": (None, None), "chg_nav_per_unit": (721.53, -78.44), "nav_52w_high": (31723.28, 31723.28), "nav_52w_low": (21439.31, 21439.31),
        "foreign_units": (2885796.11, 2885796.11), "foreign_value": (63951665866, 61869477399), "foreign_ownership_pct": (20.54, 20.47),
    }
    assert {k: (got[k], got[f"prior_{k}"]) for k in want} == want
    assert (got["period_start"], got["period_end"], got["report_date"], got["period_days"]) == (D(2022, 11, 17), D(2022, 11, 21), D(2022, 11, 22), 4)
    assert (got["fund_code"], got["date_conflict"], got["template_variant"], got["error"]) == ("VCBBCF", None, "standard", None)
    assert got["foreign_share_of_nav"] == pytest.approx(20.4717916) and got["gross_return"] == pytest.approx(0.0336545346)
    assert (got["units_begin"], got["units_end"]) == (pytest.approx(14097205.17), pytest.approx(14096451.20))
    (row,) = gates.with_flow_measures(gates.with_proxies(gates.gate(parsed))).collect()
    assert row["identity_residual"] == 0 and row["quarantine_reason"] == ""
    figures = {"delta_units": -753.9657878, "proxy_end": -16708514.30, "proxy_mid": -16436509.85, "proxy_end_error_pct": -3.192784, "proxy_mid_error_pct": -1.512868, "gross_subscription_rate": 0.000266772211, "gross_redemption_rate": 0.000320345052, "net_flow_rate": -0.0000535728428, "churn_rate": 0.000587117262, "flow_asymmetry": -0.091247260}
    assert {k: row[k] for k in figures} == {k: pytest.approx(v, rel=1e-6) for k, v in figures.items()}


def test_golden_document_with_faults(spark):
    texts = [golden_text("0"), golden_text().replace("80,627,726", "8,062,772,600"), golden_text().replace("2.1 312,389,199,705 302,234,351,773", "2.1")]
    parsed = readers.parse_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"))
    filings, failures = readers.split_failures(parsed)
    got = {r["doc_id"]: r for r in gates.gate(gates.with_net_flow(filings)).withColumn("why", gates.reasons(F.col("quarantine_reason"))).collect()}
    assert abs(got[0]["identity_residual"]) > 1e9 and got[0]["why"] == "identity"
    assert got[1]["why"] == "identity,net_flow" and "net line -16,191,553" in got[1]["quarantine_reason"]
    assert [(r["doc_id"], r["error"]) for r in failures.collect()] == [(2, "ParseError: line 2.1 is missing")]


def test_codes_names_and_dates(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first()["x"]
    lit = F.lit
    assert [one(parsing.normalise_code(lit(x))) for x in ("2.10", " 1 ", "")] == ["2.10", "1", None]
    assert [one(parsing.number_code(lit(x))) for x in (6.1, 1.0, 10.0, float("nan"))] == ["6.1", "1", "10", None]
    assert [one(parsing.fund_code(lit(x))) for x in ("(VCBF-BCF)", "(AB)", "(96,819) (Ab)", "x (A1B2C3D) y")] == ["VCBF-BCF", "AB", None, "A1B2C3D"]
    assert one(parsing.header_period(lit("TUẦN TỪ: 21/11/2023 ĐẾN: 27/11/2023")))["start"] == D(2023, 11, 21)
    # the first shape decides even if its date does not exist: then the other language counts
    odd = one(parsing.header_period(lit("Từ ngày 31 tháng 02 năm 2023 đến ngày 03 tháng 03 năm 2023 From 01 Mar 2023 to 03 Mar 2023")))
    assert (odd["start"], odd["end"], odd["conflict"]) == (D(2023, 3, 1), D(2023, 3, 3), None)
    names = {"20260811_VE_BC_Tuan_Ky-so_20260810.xlsx": D(2026, 8, 10), "20260814-VL-NAV-TUAN-TU-11.08.2026-den-14.08.2026.xlsx": D(2026, 8, 14), "X_BC_Weekly_20260713-2.PDF": D(2026, 7, 13), "20260101 report.doc": D(2026, 1, 1), "x.pdf": None}
    assert {n: one(parsing.period_date(lit(n))) for n in names} == names
    assert [one(parsing.any_date(lit(n))) for n in ("a-2023-11-27.pdf", "b 01-07_06_2021_m.pdf", "c20231211.pdf")] == [D(2023, 11, 27), D(2021, 6, 7), D(2023, 12, 11)]
    assert [one(parsing.report_kind(lit(n), "bc_code")) for n in ("DB_BC_Ky_1", "D_bc_ngay_", "D_BC_TUAN_1", "D_BC_THANG_", "x")] == ["period", "daily", "weekly", "unknown", "other"]
    assert one(parsing.cache_name(lit("http://h/a%20b.XLSX?q=1"), lit(b"abc").cast("binary"))) == "a_20b-ba7816bf8f01cfea.xlsx"
    assert one(parsing.cache_name(lit("http://h/"))).startswith("download-")
    base = lit("http://h.test/a/b.html?x#y")
    assert [one(parsing.absolute_url(base, lit(x))) for x in ("c.pdf", "/c.pdf", "//k/c.pdf", "https://z/c.pdf")] == ["http://h.test/a/c.pdf", "http://h.test/c.pdf", "http://k/c.pdf", "https://z/c.pdf"]
    assert [one(parsing.absolute_url(lit(b), lit("c.pdf"))) for b in ("http://h.test", "http://h.test/", "http://h.test/a/")] == ["http://h.test/c.pdf", "http://h.test/c.pdf", "http://h.test/a/c.pdf"]


def test_xlsx_grid(spark):
    cell = lambda ref, v, s="": f'<c r="{ref}"{s}><v>{v}</v></c>'
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>' + cell("C1", "1.1") + cell("D1", "100") + cell("E1", "90") + cell("C2", "2.1") + cell("D2", "110") + cell("E2", "100") + cell("C3", "6.3") + cell("D3", "0.2054", ' s="1"') + "</sheetData></worksheet>"
    styles = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/></cellXfs></styleSheet>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/styles.xml", styles)
    files = spark.createDataFrame([("a", bytearray(buf.getvalue())), ("b", bytearray(b"PK no zip"))], "path string, content binary")
    grid = readers.read_xlsx(files).cache()
    got = {r["code"]: (r["this"], r["last"]) for r in readers.grid_cells(grid).collect()}
    assert got["2.1"] == (110.0, 100.0) and got["1.1"] == (100.0, 90.0) and abs(got["6.3"][0] - 20.54) < 1e-9
    assert grid.where("error is not null").count() == 1


def test_net_slope_is_the_legs_difference(spark):
    rows = [(f"f{i % 3}", i // 3, float(i % 7), float(i * i % 11), float(i % 5)) for i in range(60)]
    df = spark.createDataFrame(rows, "fund_code string, month int, x double, s double, r double").withColumn("n", F.col("s") - F.col("r"))
    n, s, r = (f.coef[0] for f in stats.least_squares(df, ["n", "s", "r"], ["x"], cluster="month", absorb="fund_code"))
    assert abs(n - (s - r)) < 1e-9


def test_detached_values(spark):
    codes = spark.createDataFrame([("d", 1, 100.0, "2.1"), ("d", 1, 108.0, "2.3")], "doc_id string, page int, top double, code string")
    values = spark.createDataFrame([("d", 1, 105.0, 7.0), ("d", 1, 113.0, 8.0), ("d", 1, 140.0, 9.0)], "doc_id string, page int, top double, value double")
    assert {r["value"]: r["code"] for r in geometry.attach_detached(codes, values).collect()} == {7.0: "2.1", 8.0: "2.3"}


def test_bands_join_only_their_neighbour(spark):
    """Bands 10, 11, 12: the third begins a line, for the line began at 10."""
    words = spark.createDataFrame([("d", 1, 30.0, 1.0, 2.0, "a"), ("d", 1, 33.0, 3.0, 4.0, "b"), ("d", 1, 36.0, 5.0, 6.0, "c")], "doc_id string, page int, top double, x0 double, x1 double, text string")
    assert sorted((r["text"], r["line"]) for r in geometry.banded(words).collect()) == [("a", 10), ("b", 10), ("c", 12)]


def test_one_column_and_no_text_layer(spark):
    glyphs = [("d", 1, top, x + 5.0 * i, x + 5.0 * i + 5.0, c) for top, x, t in ((10.0, 10.0, "2.1"), (10.0, 60.0, "100"), (30.0, 10.0, "3.1"), (30.0, 60.0, "(50)")) for i, c in enumerate(t)]
    df = spark.createDataFrame(glyphs, "doc_id string, page int, top double, x0 double, x1 double, text string")
    docs = spark.createDataFrame([("d", "F"), ("scan", "G")], "doc_id string, fund_code string")
    got = {r["doc_id"]: r for r in geometry.parse_glyphs(df, docs).collect()}
    assert (got["d"]["nav_end"], got["d"]["chg_investment"], got["d"]["error"]) == (100.0, -50.0, None)
    assert got["scan"]["error"] == "ParseError: no text"


def workbook(rows, styles=True):
    """A workbook of one sheet from rows of (reference, text, number or None, style)."""
    cells = "".join(f'<c r="{ref}" t="inlineStr"><is><t>{text}</t></is></c>' if text is not None else f'<c r="{ref}" s="{style}"><v>{number}</v></c>' for ref, text, number, style in rows)
    sheet = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{cells}</sheetData></worksheet>'
    formats = '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><cellXfs><xf numFmtId="0"/><xf numFmtId="10"/><xf numFmtId="14"/></cellXfs></styleSheet>'
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/styles.xml", formats)
    return bytearray(buf.getvalue())


def test_files_of_all_kinds(spark):
    book = workbook([("A1", "Reporting Date", None, 0), ("B1", None, 44882, 2), ("C2", None, 2.1, 0), ("D2", None, 110, 0), ("E2", None, 100, 0), ("C3", "3.2.1", None, 0), ("D3", None, 10, 0), ("C4", "6.3", None, 0), ("D4", None, 0.2054, 1), ("C5", None, 1, 0), ("D5", None, 5, 0)])
    files = [("a.pdf", book, "REG"), ("b.xlsx", bytearray(b"PK\x03\x04" + b"\x00" * 50), "B"), ("c.txt", bytearray(golden_text().encode()), None), ("d.pdf", bytearray(b"%PDF-1.4"), "D"), ("e.bin", bytearray(b"??"), "E"), ("f.xlsx", workbook([("A1", "notes", None, 0)]), "F")]
    got = readers.parse_files(spark.createDataFrame(files, "path string, content binary, fund_code string"))
    filings, failures = readers.split_failures(got)
    rows = {r["doc_id"]: r for r in filings.collect()}
    assert set(rows) == {"a.pdf", "c.txt"}
    a = rows["a.pdf"]
    assert (a["fund_code"], a["nav_end"], a["prior_nav_end"], a["subscriptions"], a["report_date"]) == ("REG", 110.0, 100.0, 10.0, D(2022, 11, 17))
    assert abs(a["foreign_ownership_pct"] - 20.54) < 1e-9 and rows["c.txt"]["fund_code"] == "VCBBCF"
    why = {r["doc_id"]: r["error"] for r in failures.collect()}
    assert set(why) == {"b.xlsx", "d.pdf", "e.bin", "f.xlsx"} and all(":" in w for w in why.values())
    assert "2.1" in why["f.xlsx"] and "container" in why["e.bin"]


def test_sitemaps(spark, tmp_path):
    index = spark.createDataFrame([("s", "<loc>https://x/report-sitemap.xml</loc><loc>https://x/post-sitemap.xml</loc><loc>https://x/report-sitemap2.xml</loc>")], "sitemap_url string, body string")
    named, whole = catalog.child_sitemaps(index)
    assert whole and [r[0] for r in named.collect()] == ["https://x/report-sitemap.xml", "https://x/report-sitemap2.xml"]
    part, whole = catalog.child_sitemaps(index, max_pages=1)
    assert not whole and part.count() == 1
    schema = "sitemap_url string, status int, body string"
    pages = catalog.sitemap_pages(spark.createDataFrame([("a", 200, "<loc>u1</loc><loc>u2</loc>"), ("b", 200, "<x:loc>u2</x:loc>")], schema))
    assert sorted(r["url"] for r in pages.collect()) == ["u1", "u2"]
    for bad in (("b", 200, "<urlset/>"), ("b", 500, "<loc>u</loc>")):
        with pytest.raises(ValueError):
            catalog.sitemap_pages(spark.createDataFrame([("a", 200, "<loc>u1</loc>"), bad], schema))
    with pytest.raises(ValueError):
        catalog.child_sitemaps(index.withColumn("body", F.lit("<loc>https://x/post-sitemap.xml</loc>")))
    folder = str(tmp_path / "pages")
    assert not catalog.save_pages(pages, folder, "s", 1, False) and not (tmp_path / "pages").exists()
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    assert catalog.save_pages(pages, folder, "s", 2, True, at)
    saved = spark.read.parquet(folder)
    later = lambda h: F.lit(f"2024-01-0{1 + h // 24} {h % 24:02d}:00:00").cast("timestamp")
    assert catalog.current_pages(saved, "s", later(24)).count() == 2
    assert catalog.current_pages(saved, "s", later(25)) is None and catalog.current_pages(saved, "t", later(1)) is None


def test_report_pages_and_candidates(spark):
    managers = {"d": {"crawler": "report_pages", "status": "verified", "funds": {"dcds": {"code": "DCDS"}, "dcbf": {"code": "DCBF"}, "dcde": {"code": "DCDE"}}}, "new": {"status": "unverified"}}
    funds = catalog.registry(spark, managers)
    urls = ["https://a/r/dcds-bao-cao-tuan-2025/", "https://a/r/bao-cao-ngay-cua-quy-dcds/", "https://a/r/dcbf-bao-cao-ky-2025/", "https://a/r/dcde-bao-cao-tuan-2025/", "https://a/r/etf-bao-cao-tuan-2025/", "https://a/r/dcds-mislabeled-tuan-2025/"]
    chosen = catalog.candidate_pages(spark.createDataFrame([(u,) for u in urls], "url string"), "d", funds).collect()
    assert {(r["page_url"], r["fund_key"]) for r in chosen} == {(urls[0], "dcds"), (urls[3], "dcde"), (urls[5], "dcds")}
    bodies = {urls[0]: '<a href="https://c/DCDS_BC_TUAN_20250116.xlsx">', urls[3]: "nothing", urls[5]: '<a href="https://c/DCDE_BC_TUAN_20250116.xlsx">'}
    rows = spark.createDataFrame([("d", r["page_url"], r["fund_key"], 200, bodies[r["page_url"]]) for r in chosen], "manager_id string, page_url string, fund_key string, status int, body string")
    refs, dead = catalog.discover(managers, {"d": rows}, funds)
    assert [(r["fund_key"], r["url"], r["filename_date"]) for r in refs.collect()] == [("dcde", "https://c/DCDE_BC_TUAN_20250116.xlsx", D(2025, 1, 16)), ("dcds", "https://c/DCDS_BC_TUAN_20250116.xlsx", D(2025, 1, 16))]
    assert sorted(r["reason"][:14] for r in dead.collect()) == ["the page names", "the report pag"]
    with pytest.raises(NotImplementedError):
        catalog.discover(managers, {"new": rows}, funds)
    with pytest.raises(KeyError):
        catalog.manager_config(managers, "other")
    assert catalog.verified(managers) == ["d"]
    assert spark.range(1).select(catalog.form_token(F.lit('<input id="field_csrf_ft" type="hidden" value="t0k">')).alias("x")).first()["x"] == "t0k"


def test_registry_refs_and_manifest(spark, tmp_path):
    (tmp_path / "r.json").write_text('{"managers": {"m": {"status": "verified", "funds": {"f": {"code": "F1", "aliases": ["A"]}}}}}')
    managers = catalog.load_registry(spark, str(tmp_path / "r.json"))
    funds = catalog.registry(spark, managers)
    assert funds.first()["fund_code"] == "F1"
    refs = spark.createDataFrame([("m", "f", "OLD", "u1", None, "t", None, D(2024, 1, 2)), ("m", "g", "G", "u2", None, "t", None, None)], "manager_id string, fund_key string, fund_code string, url string, published date, title string, label string, filename_date date")
    catalog.write_refs(refs, str(tmp_path / "refs"))
    back = catalog.read_refs(spark, str(tmp_path / "refs"))
    assert {r["url"]: r["filename_date"] for r in back.collect()} == {"u1": D(2024, 1, 2), "u2": None}
    for k in range(2):
        sinks.append_manifest(spark.createDataFrame([("u1", f"p{k}")], "url string, path string"), str(tmp_path / "manifest"))
    manifest = readers.read_manifest(spark, str(tmp_path / "manifest"))
    assert manifest.count() == 2
    got, missing = catalog.fetched(back, manifest)
    assert [r["path"] for r in got.collect()] == ["p1"] and [r["url"] for r in missing.collect()] == ["u2"]
    assert {r["url"]: r["fund_code"] for r in catalog.with_codes(back, funds).collect()} == {"u1": "F1", "u2": "G"}


def test_gate_rules(spark):
    ok = dict(fund_code="A", period_start=D(2023, 1, 2), period_end=D(2023, 1, 8), nav_begin=1e9, nav_end=1e9 + 30, chg_investment=10.0, subscriptions=25.0, redemptions=-5.0, chg_flows_net=20.0, chg_distribution=None, source="s", date_conflict="period_end VN 1 vs EN 2")
    rows = [ok, ok | dict(nav_begin=0.0, nav_end=30.0), ok | dict(period_start=None), ok | dict(period_end=None), ok | dict(chg_flows_net=99.0), ok | dict(nav_begin=None), ok | dict(period_end=D(2023, 1, 1)), ok | dict(subscriptions=None, redemptions=None), ok | dict(subscriptions=None, redemptions=None, chg_flows_net=None, nav_end=1e9 + 10)]
    df = spark.createDataFrame([tuple(r[k] for k in ok) for r in rows], SCHEMA.replace("fund_code string, period_start date, period_end date, ", "fund_code string, period_start date, period_end date, ") + ", date_conflict string")
    got = [r["w"] for r in gates.gate(gates.with_net_flow(df)).withColumn("w", gates.reasons(F.col("quarantine_reason"))).collect()]
    assert got == ["", "nav_begin", "", "period_end", "net_flow", "identity,nav_begin", "period_days", "", ""]
    checks = gates.checks(gates.with_net_flow(df))
    assert checks.count() == 2 * len(rows)
    text = gates.report(checks)
    assert "reconcile: 8/9 passed" in text and "FAIL A 2023-01-08 missing: nav_begin" in text
    many = spark.range(40).select(F.col("id").cast("string").alias("fund_code"), F.lit(D(2023, 1, 1)).alias("period_end"), F.lit("c").alias("check"), (F.col("id") < 5).alias("passed"), F.lit(float("nan")).alias("residual"), F.lit("x").alias("detail"))
    (r,) = gates.check_summary(many).collect()
    assert (r["total"], r["n_passed"], r["max_residual"]) == (40, 5, None) and len(r["failures"].split("\n")) == 11 and r["failures"].endswith("and 25 more")
    assert gates.report(many.limit(0)) == "no checks run"


def test_undated_filings_stay(spark):
    rows = [row("A", None, None, source="f_1"), row("A", None, None, source="f_3"), row("A", D(2023, 1, 2), None, source="f_1"), row("A", D(2023, 1, 2), D(2023, 1, 8)), row("A", D(2023, 1, 2), D(2023, 1, 10))]
    kept, gone = panel.overlaps(spark.createDataFrame(rows, SCHEMA))
    assert kept.count() == 4 and [r["period_end"] for r in gone.collect()] == [D(2023, 1, 8)]


def test_macro_joins_need_series(spark):
    df = spark.createDataFrame([("A", D(2023, 1, 2), D(2023, 1, 6), 0.05)], "fund_code string, period_start date, period_end date, gross_return double")
    index = spark.createDataFrame([(D(2022, 12, 30), 1000.0), (D(2023, 1, 3), 1010.0), (D(2023, 1, 6), 1020.0), (D(2023, 1, 7), None)], "day date, close double")
    (r,) = panel.with_market_return(df, index).collect()
    assert (r["index_begin"], r["index_end"], round(r["market_return"], 9), round(r["excess_return"], 9)) == (1000.0, 1020.0, 0.02, 0.03)
    rates_ = spark.createDataFrame([(D(2023, 1, 1), 7.4, "p", "B")], "month date, rate_pct double, provenance string, bank string")
    (r,) = panel.with_deposit_rate(df, rates_).collect()
    assert (r["month"], r["deposit_rate_pct"], r["deposit_rate_provenance"], r["deposit_rate_bank"]) == ("2023-01", 7.4, "p", "B")
    for f, x in ((panel.with_market_return, index), (panel.with_deposit_rate, rates_)):
        with pytest.raises(ValueError):
            f(df, x.limit(0))
    with pytest.raises(TypeError):
        panel.asof_days(df.withColumn("t", F.current_timestamp()), index, "t", "close", "c")


def test_rates_csv(spark, tmp_path):
    put = lambda text: ((tmp_path / "r.csv").write_text(text), str(tmp_path / "r.csv"))[1]
    good = put('month,rate_pct,provenance,bank\n2023-02,7.2,"a ""b"", c",X\n2023-01,x,d,Y\n')
    assert [(r["month"], r["rate_pct"], r["provenance"], r["bank"]) for r in readers.read_rates(spark, good).collect()] == [(D(2023, 1, 1), None, "d", "Y"), (D(2023, 2, 1), 7.2, 'a "b", c', "X")]
    for bad in ("month,rate_pct\n2023-01,1\n", "month,rate_pct,provenance\n2023-01,1, \n", "month,rate_pct,provenance\n2023-01,1,a\n2023-01,2,b\n"):
        with pytest.raises(ValueError):
            readers.read_rates(spark, put(bad))


def test_rate_series_by_priority(spark):
    form = "month date, rate double, bank string, tenor string, source string, n_banks int, snapshot string, provenance string"
    best = spark.createDataFrame([(D(2023, 1, 1), 5.0, "A", "12", "a", 1, "s1", "read"), (D(2023, 4, 1), 5.0, "A", "12", "a", 1, "s2", "read")], form)
    more = spark.createDataFrame([(D(2023, 1, 1), 9.0, "B", "12", "b", 4, None, "mean"), (D(2023, 6, 1), 6.0, "B", "12", "b", 4, None, "mean")], form)
    got = [(r["rate"], r["bank"], r["observed"], r["provenance"]) for r in rates.rate_series([best, more], "2022-12-01", "2023-07-01").orderBy("month").collect()]
    bridged = "bridged between 2023-01 and 2023-04"
    assert got == [(None, None, False, "no earlier rate"), (5.0, "A", True, "read"), (5.0, "A", False, bridged), (5.0, "A", False, bridged), (5.0, "A", True, "read"), (None, None, False, "rate changed between 2023-04 and 2023-06"), (6.0, "B", True, "mean"), (None, None, False, "no later rate than 2023-06")]


def test_feeds(spark):
    payloads = spark.createDataFrame([('{"data": {"rows": [{"id": 3, "shortName": "S", "name": "N"}]}}',)], "json string")
    assert [tuple(r) for r in rates.fund_catalogue(payloads).collect()] == [(3, "S", "N")]
    with pytest.raises(ValueError):
        rates.unit_value_history(spark.createDataFrame([("F", '{"data": [{"x": 1}]}')], "fund_code string, json string"))
    assert rates.unit_value_history(spark.createDataFrame([("F", '{"data": []}')], "fund_code string, json string")).count() == 0
    history = spark.createDataFrame([(dt.datetime(2023, 1, 3), 2.0), (dt.datetime(2023, 1, 2), 1.0), (dt.datetime(2024, 1, 2), 9.0)], "Time timestamp, CLOSE double")
    assert [r["close"] for r in rates.index_series(history, "2023-01-01", "2023-12-31").collect()] == [1.0, 2.0]


def test_exact_quantiles_narrow_to_brackets(spark, monkeypatch):
    df = spark.range(20_000).select(((F.col("id") * 7919) % 20_011).cast("double").alias("x"), (F.col("id") % 3).cast("double").alias("y"), F.lit(None).cast("double").alias("z"))
    want = stats.exact_quantiles(df, ["x", "y", "z"], [0.01, 0.5, 0.99])
    values = [r["x"] for r in df.select("x").collect()]
    assert want["x"] == pytest.approx(list(np.quantile(values, [0.01, 0.5, 0.99]))) and want["y"] == [0.0, 1.0, 2.0] and want["z"] == [None] * 3
    monkeypatch.setattr(stats, "SKETCH", 8)
    monkeypatch.setattr(stats, "MARGIN", 1e-4)  # brackets that miss are looked for again
    assert stats.exact_quantiles(df, ["x", "y", "z"], [0.01, 0.5, 0.99]) == want


def test_bins_keep_ties_together(spark):
    df = spark.createDataFrame([(float(v),) for v in (0, 0, 0, 1, 2, 3, 4, 5, 6, 7)], "x double")
    assert [(r["bin"], r["count"]) for r in stats.quantile_bins(df, "x").groupBy("bin").count().orderBy("bin").collect()] == [(1, 4), (2, 2), (3, 2), (4, 2)]
    assert stats.quantile_bins(df.limit(1), "x").first()["bin"] is None


def by_numpy(y, x, cluster):
    inverse = np.linalg.pinv(x.T @ x)
    b = inverse @ x.T @ y
    u = y - x @ b
    if cluster is None:
        meat, scale = (x * u[:, None]).T @ (x * u[:, None]), len(y) / (len(y) - x.shape[1])
    else:
        groups = np.unique(cluster)
        s = np.array([(x[cluster == g] * u[cluster == g][:, None]).sum(axis=0) for g in groups])
        meat, scale = s.T @ s, len(groups) / (len(groups) - 1) * (len(y) - 1) / (len(y) - x.shape[1])
    return b, np.sqrt(np.diag(inverse @ meat @ inverse) * scale), 1 - u @ u / ((y - y.mean()) @ (y - y.mean()))


def test_least_squares_against_numpy(spark):
    r = np.random.default_rng(3)
    n = 240
    fund, month = np.arange(n) % 6, np.arange(n) // 6
    x1, x2 = r.normal(size=n), r.normal(size=n) + fund
    s, d = 0.012 + 0.3 * x1 + r.normal(size=n) * 0.1, 0.006 + 0.28 * x1 - 0.1 * x2 + r.normal(size=n) * 0.1
    df = spark.createDataFrame([(f"f{f}", D(2020 + int(m) // 12, 1 + int(m) % 12, 28), float(a), float(b), float(p), float(q), float(p - q), bool(f != 5 or m)) for f, m, a, b, p, q in zip(fund, month, x1, x2, s, d)], "fund_code string, period_end date, x1 double, x2 double, gross_subscription_rate double, gross_redemption_rate double, net_flow_rate double, gross_legs_disclosed boolean")
    fits = {f.dependent: f for f in stats.paired_specifications(df, "x1", controls=("x2", "absent"))}
    keep = (fund != 5) | (month > 0)
    mean = lambda v: v - np.array([v[keep & (fund == f)].mean() for f in fund])
    x = np.stack([mean(x1), mean(x2)], axis=1)[keep]
    for name, y in (("gross_subscription_rate", s), ("gross_redemption_rate", d), ("net_flow_rate", s - d)):
        b, se, r2 = by_numpy(mean(y)[keep], x, month[keep])
        f = fits[name]
        assert f.coef == pytest.approx(b) and f.std_err == pytest.approx(se) and f.r2 == pytest.approx(r2) and (f.n_obs, f.n_funds, f.n_clusters) == (n - 1, 6, 40)
    (f,) = stats.least_squares(df, ["net_flow_rate"], ["x1", "x2"])
    b, se, r2 = by_numpy(s - d, np.stack([np.ones(n), x1, x2], axis=1), None)
    assert f.terms == ["const", "x1", "x2"] and f.coef == pytest.approx(b) and f.std_err == pytest.approx(se) and f.r2 == pytest.approx(r2)
    # one row a cluster is the robust case, apart from the corrections
    one = df.withColumn("k", F.monotonically_increasing_id())
    (g,), (h,) = (stats.least_squares(one, ["net_flow_rate"], ["x1"], c, correct=False) for c in ("k", None))
    assert g.std_err == pytest.approx(h.std_err)
    assert stats.compare(spark, list(fits.values()), "x1").count() == 3 and "funds=6" in fits["net_flow_rate"].summary()
    assert stats.flow_performance(df, "net_flow_rate", ["x1"], fund_effects=False).n_clusters == 40
    with pytest.raises(ValueError):
        stats.least_squares(df.limit(1), ["net_flow_rate"], ["x1"])


def test_no_disclosed_rows(spark):
    df = spark.createDataFrame([(0.1, 0.1, 0.0, 0.2, False)], "gross_subscription_rate double, gross_redemption_rate double, net_flow_rate double, churn_rate double, gross_legs_disclosed boolean")
    assert stats.netting_loss(df).count() == 0 and stats.quantile_table(df, "churn_rate").count() == 0


def test_asof_of_a_busy_key(spark):
    left = [("a", dt.datetime(2024, 1, 5, 10), 1), ("a", dt.datetime(2024, 1, 5, 8), 2), ("a", dt.datetime(2024, 1, 1), 3), ("b", dt.datetime(2024, 1, 5), 4), ("a", dt.datetime(2024, 1, 3, 9), 5), (None, dt.datetime(2024, 1, 3), 6)]
    right = [("a", dt.datetime(2024, 1, 2, 9), 1.0, 1), ("a", dt.datetime(2024, 1, 3, 9), 2.0, 2), ("a", dt.datetime(2024, 1, 3, 9), 3.0, 3), ("a", dt.datetime(2024, 1, 5, 9), None, 4), ("a", dt.datetime(2024, 1, 5, 9), 5.0, 5), (None, dt.datetime(2024, 1, 2), 7.0, 6)]
    got = panel.asof_keyed(spark.createDataFrame(left, "k string, ts timestamp, id int"), spark.createDataFrame(right, "k string, ts timestamp, v double, e int"), "k", "ts", "v", "o", "e")
    assert {r["id"]: r["o"] for r in got.collect()} == {1: 5.0, 2: 3.0, 3: None, 4: None, 5: 3.0, 6: 7.0}


def test_restatement_stream(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    put = lambda rows: spark.createDataFrame(rows, SCHEMA).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: restatements.merge_stream(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), build.VALUES[:1]).awaitTermination()
    put([row("A", D(2023, 1, 2), D(2023, 1, 8)), row("B", D(2023, 1, 2), D(2023, 1, 8))])
    run()
    put([row("A", D(2023, 1, 2), D(2023, 1, 8), subs=6e8, source="f_3")])
    run()
    got = restatements.standing(spark, str(tmp_path / "out")).collect()
    assert sorted((r["fund_code"], r["source"]) for r in got) == [("A", "f_3"), ("B", "f_1")]


def test_run_writes_every_output(spark, tmp_path):
    files = spark.createDataFrame([(f"{k}.txt", bytearray(golden_text().replace("17 tháng", f"{k} tháng").replace("17 Nov", f"{k} Nov").encode()), "F") for k in (16, 17)] + [("x.txt", bytearray(b"none"), "F")], "path string, content binary, fund_code string").withColumn("source", F.col("path"))
    got = run.parse_and_build(files)
    parts = {r["part"]: r["n"] for r in build.audit(got.result, got.failures).collect()}
    assert parts == {"panel": 2, "quarantine": 0, "superseded": 0, "failures": 1}
    index = spark.createDataFrame([(D(2022, 11, 1), 1000.0), (D(2022, 11, 20), 1100.0)], "day date, close double")
    paths = run.write_panel(got, str(tmp_path), index)
    assert readers.read_panel(spark, paths["fund_period"]).count() == 2 and readers.read_panel(spark, paths["fund_month"]).count() == 1
    assert readers.read_panel(spark, paths["parse_failures"]).first()["error"].startswith("ParseError")
    assert "reconcile: 2/2 passed" in run.report(spark, got)
