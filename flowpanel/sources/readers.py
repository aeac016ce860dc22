"""Readers: text layers, XLSX grids, glyph tables, rate files, manifests and JSON payloads."""

from __future__ import annotations

import datetime
import functools
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import NBSP, fund_code, header_period, normalise_code, number_code, parse_number, report_date

#: The fixed template and its older variant: line code, field.
FIELDS = {
    "1.1": "nav_begin", "1.3": "nav_per_unit_begin", "2.1": "nav_end", "2.3": "nav_per_unit_end",
    "3.1": "chg_investment", "3.2": "chg_flows_net", "3.2.1": "subscriptions", "3.2.2": "redemptions", "3.3": "chg_distribution",
    "4": "chg_nav_per_unit", "5.1": "nav_52w_high", "5.2": "nav_52w_low", "6.1": "foreign_units", "6.2": "foreign_value", "6.3": "foreign_ownership_pct",
}
ALTERNATE = {
    "1.1": "nav_begin", "1.2": "nav_per_unit_begin", "2.1": "nav_end", "2.2": "nav_per_unit_end",
    "3.1": "chg_investment", "3.2.1": "chg_distribution", "3.2.2": "chg_flows_net",
    "4": "chg_nav_per_unit", "6.1": "foreign_units", "6.2": "foreign_value", "6.3": "foreign_ownership_pct",
}
#: Headings, which never carry values; fields in percent; the lines of which a report of changes has one at least.
SECTIONS = ("1", "2", "3", "5", "6")
PERCENT = ("6.3",)
CHANGES = ("chg_investment", "chg_flows_net", "subscriptions", "redemptions", "chg_distribution")
CODE = r"^\d+(?:\.\d+){0,2}$"
ROW = r"^\s*(\d+(?:\.\d+){0,2})\s+(\S.*?)\s*$"
FIGURE = r"\(?-?\d[\d,]*(?:\.\d+)?\)?%?"
TRAILING = rf"(?:^|\s)({FIGURE})(?:\s+({FIGURE}))?\s*$"

#: Fixed labels of the bilingual header; "4 Kỳ báo cáo: ... năm 2022" is no line 4.
METADATA = r"(?iu)Kỳ báo cáo|Ngày lập báo cáo|Reporting period|Reporting Date|Tên Quỹ|Fund name|Tên Công ty|Fund Management Company|Tên Ngân hàng|Supervisory bank|Đơn vị tính|Currency"


def container(content: Column, path: Column) -> Column:
    """pdf, xlsx or text by the first bytes, then by the name; NULL if it is none of them."""
    head, name = F.hex(F.substring(content, 1, 4)), F.lower(path)
    return F.when(head == "25504446", "pdf").when(head == "504B0304", "xlsx").when(name.endswith(".pdf"), "pdf").when(name.rlike(r"\.(xlsx|xlsm)$"), "xlsx").when(name.endswith(".txt"), "text")


def text_cells(lines: DataFrame) -> DataFrame:
    """doc_id, code, this, last: the first line of each code, its trailing one or two figures; header lines are none."""
    rows = lines.withColumn("line", F.replace("line", F.lit(NBSP), F.lit(" ")))
    rows = rows.select("doc_id", "line_no", F.regexp_extract("line", ROW, 1).alias("code"), F.regexp_extract("line", ROW, 2).alias("rest"))
    rows = rows.where((F.col("code") != "") & ~F.col("code").isin(*SECTIONS) & ~F.col("rest").rlike(METADATA))
    cells = rows.select("doc_id", "line_no", "code", F.nullif(F.regexp_extract("rest", TRAILING, 1), F.lit("")).alias("a"), F.nullif(F.regexp_extract("rest", TRAILING, 2), F.lit("")).alias("b"))
    # of a code's lines the first with a figure: a partial minimum, no window
    first = cells.where("a is not null").groupBy("doc_id", "code").agg(F.min_by(F.struct("a", "b"), "line_no").alias("f"))
    return first.select("doc_id", "code", parse_number(F.col("f.a")).alias("this"), parse_number(F.col("f.b")).alias("last"))


#: All line codes of both variants.
CODES = list(dict.fromkeys([*FIELDS, *ALTERNATE]))


def filings(cells: DataFrame) -> DataFrame:
    """One wide row per document: variant, fields, prior_ fields, and error where it is no filing."""
    at = lambda code, col: F.max(F.when(F.col("code") == code, F.col(col)))
    got = cells.groupBy("doc_id").agg(*[at(c, col).alias(f"{col}:{c}") for c in CODES for col in ("this", "last")])
    return _fields(got, ["doc_id"])


def _fields(got: DataFrame, keep: list[str]) -> DataFrame:
    """The fields from one column for each code and value.

    The older variant has a value at 1.2 and none at 1.3; its lines 3.2.1 and 3.2.2 are the
    distribution and the net flow, and it has no gross legs.
    """
    cell = lambda col, code: F.col(f"`{col}:{code}`") if code else F.lit(None).cast("double")
    alternate = cell("this", "1.2").isNotNull() & cell("this", "1.3").isNull()
    of = {f: c for c, f in FIELDS.items()}, {f: c for c, f in ALTERNATE.items()}
    field = lambda col, f: F.when(alternate, cell(col, of[1].get(f))).otherwise(cell(col, of[0][f]))
    got = got.select(*keep, F.when(alternate, "alt").otherwise("standard").alias("template_variant"), *[field("this", f).alias(f) for f in FIELDS.values()], *[field("last", f).alias(f"prior_{f}") for f in FIELDS.values()])
    error = F.when(F.col("nav_end").isNull(), "line 2.1 is missing").when(F.coalesce(*CHANGES).isNull(), "no line of section 3: a point-in-time report")
    return got.withColumn("error", error)


def _heads(docs: DataFrame, more: list[str]) -> DataFrame:
    """What header texts say: fund, source, dates, and whether there is no text."""
    flat = F.regexp_replace(F.replace("text", F.lit(NBSP), F.lit(" ")), r"\s+", " ")
    given = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    cell = F.col("report_cell") if "report_cell" in docs.columns else F.lit(None).cast("date")
    # the text is flattened once, and the period's parts are taken from a column that stands
    docs = docs.withColumn("flat", flat)
    flat = F.col("flat")
    printed = fund_code(flat)
    head = docs.select("doc_id", header_period(flat).alias("h"), F.coalesce(given("fund_code"), printed).alias("fund_code"), given("source").alias("source"), F.coalesce(report_date(flat), cell).alias("report_date"), (F.coalesce(F.trim("text"), F.lit("")) == "").alias("blank"), *more)
    return head.select("doc_id", "fund_code", "source", "report_date", F.col("h.start").alias("period_start"), F.col("h.end").alias("period_end"), F.col("h.conflict").alias("date_conflict"), "blank", *more)


def _judged(got: DataFrame) -> DataFrame:
    error = F.when(F.col("blank"), "no text").when(F.col("template_variant").isNull(), "line 2.1 is missing").otherwise(F.col("error"))
    return got.withColumn("error", F.when(error.isNotNull(), F.concat(F.lit("ParseError: "), error))).drop("blank")


def headed(docs: DataFrame, cells: DataFrame) -> DataFrame:
    """Filings from the header texts (doc_id, text; fund_code, source and report_cell where
    there are any) and the cells of the same documents. A given fund code precedes the printed one."""
    return _judged(_heads(docs, []).join(filings(cells), "doc_id", "left"))


def headed_rows(docs: DataFrame) -> DataFrame:
    """As headed, for documents whose row has its cells (an array of code, this, last): nothing is
    joined. Rows that stand dealt out by document stay where they are.

    The values become columns by an aggregation, which also keeps the planner from writing
    everything that cells are made of into each later condition on a field.
    """
    more = [c for c in ("fund_code", "source", "report_cell", "broken") if c in docs.columns]
    each = docs.select("doc_id", "text", *more, F.explode_outer("cells").alias("c"))
    at = lambda code, col: F.max(F.when(F.col("c.code") == code, F.col(f"c.{col}")))
    got = each.groupBy("doc_id").agg(*[F.first(c).alias(c) for c in ("text", *more)], F.count("c").alias("n_cells"), *[at(c, col).alias(f"{col}:{c}") for c in CODES for col in ("this", "last")])
    values = ["n_cells", *[f"`{col}:{c}`" for c in CODES for col in ("this", "last")], *(["broken"] if "broken" in more else [])]
    got = _heads(got, values)
    keep = [c for c in got.columns if ":" not in c]
    got = _fields(got, keep).withColumn("template_variant", F.when(F.col("n_cells") > 0, F.col("template_variant")))
    return _judged(got.drop("n_cells"))


def parse_texts(docs: DataFrame) -> DataFrame:
    """Filings of text layers: doc_id, text and, where known, fund_code and source."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\r?\n")).alias("line_no", "line"))
    return headed(docs, text_cells(lines))


def split_failures(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(filings, failures): a document that can't be read ends no run, its reason is kept."""
    return parsed.where("error is null").drop("error"), parsed.where("error is not null").select("doc_id", "fund_code", "source", "error")


GRID = "path string, sheet int, row int, col int, value_str string, value_num double, percent boolean, day date, error string"
_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"

#: Fixed numbers of the built-in formats of days.
_DAYS = {14, 15, 16, 17, 22}


def _elements(z: zipfile.ZipFile, name: str, tag: str, within: str = "") -> Iterator[tuple[ElementTree.Element | None, ElementTree.Element | None]]:
    """The elements of a part, one at a time, as (None, element), and before its elements each
    element around them as (element, None); what has been read is dropped."""
    with z.open(name) as part:
        walk = ElementTree.iterparse(part, events=("start", "end"))
        _, root = next(walk)
        for event, x in walk:
            if event == "start" and x.tag == f"{_NS}{within}":
                yield x, None
            elif event == "end" and x.tag == f"{_NS}{tag}":
                yield None, x
                x.clear()
            if event == "end" and x.tag == f"{_NS}{within or tag}":
                root.clear()


def _sheets(z: zipfile.ZipFile) -> tuple[list[str], bool]:
    """The sheets' parts in the order of the book's tabs, and whether its days count from 1904.
    A book without a list of sheets is read in the order of its parts' numbers."""
    names = set(z.namelist())
    if "xl/workbook.xml" in names and "xl/_rels/workbook.xml.rels" in names:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        said = book.find(f"{_NS}workbookPr")
        late = said is not None and said.get("date1904", "0") in ("1", "true")
        parts = {}
        for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")):
            target = r.get("Target", "")
            parts[r.get("Id")] = target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"xl/{target}")
        # sheets of charts are no worksheets
        return [parts[x.get(_REL)] for x in book.iter(f"{_NS}sheet") if re.search("(^|/)worksheets/", parts.get(x.get(_REL), "")) and parts[x.get(_REL)] in names], late
    return sorted((n for n in names if re.match(r"xl/worksheets/sheet\d+\.xml$", n)), key=lambda n: int(re.search(r"\d+", n)[0])), False


def _grid(content: bytes) -> Iterator[tuple]:
    """Cells of all sheets by the standard library alone: sheet, row, col, text, number, percent, day."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in si.iter(f"{_NS}t")) for _, si in _elements(z, "xl/sharedStrings.xml", "si")]
        styles: list[tuple[bool, bool]] = []  # of each cell format: percent, day
        if "xl/styles.xml" in names:
            root = ElementTree.fromstring(z.read("xl/styles.xml"))
            own = {x.get("numFmtId"): re.sub(r'"[^"]*"|\[[^]]*\]', "", x.get("formatCode", "")) for x in root.iter(f"{_NS}numFmt")}
            formats = root.find(f"{_NS}cellXfs")
            for x in formats if formats is not None else []:
                k = x.get("numFmtId") or "0"
                styles.append((k in ("9", "10") or "%" in own.get(k, ""), int(k) in _DAYS or bool(re.search("[yd]", own.get(k, ""), re.I))))
        sheets, late = _sheets(z)
        first = datetime.date(1904, 1, 1) if late else datetime.date(1899, 12, 30)
        for k, name in enumerate(sheets, 1):
            at = [0, 0]  # cells without a reference follow the one before
            for line, c in _elements(z, name, "c", "row"):
                if line is not None:
                    at = [int(line.get("r") or at[0] + 1), 0]
                else:
                    v, kind, style = c.find(f"{_NS}v"), c.get("t"), int(c.get("s") or 0)
                    if c.get("r"):
                        letters, row = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                        at = [int(row), functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0)]
                    else:
                        at = [at[0], at[1] + 1]
                    text = number = day = None
                    percent = False
                    if kind == "inlineStr":
                        text = "".join(t.text or "" for t in c.iter(f"{_NS}t"))
                    elif v is None or kind == "b":
                        continue
                    elif kind == "s":
                        text = shared[int(v.text)]
                    elif kind == "d":
                        day = datetime.date.fromisoformat(v.text[:10])
                    elif kind in (None, "n"):
                        number, (percent, dated) = float(v.text), styles[style] if style < len(styles) else (False, False)
                        if dated:
                            day, number = first + datetime.timedelta(days=int(number)), None
                    else:
                        text = v.text
                    yield k, *at, text, number, percent, day


def read_xlsx(files: DataFrame) -> DataFrame:
    """Cells of binary files (path, content); a file that can't be read is one row with an error."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for path, content in zip(part["path"], part["content"]):
                try:
                    rows = [(path, *c, None) for c in _grid(content)] or [(path, *[None] * 7, "ParseError: no cells")]
                except Exception as e:  # noqa: BLE001 - any fault of one file is a row of the failures
                    rows = [(path, *[None] * 7, f"{type(e).__name__}: {e}")]
                yield pd.DataFrame(rows, columns=["path", "sheet", "row", "col", "value_str", "value_num", "percent", "day", "error"])

    return files.select("path", "content").mapInPandas(run, GRID)


def _sheet_rows(grid: DataFrame, searched: int) -> DataFrame:
    """path, broken, cells, code_col, cols: one row per file with the cells of its first sheet whose
    code column holds 2.1 with a number beside it (the code column is the one of the first few
    with most codes), where the value columns are those of the first two such numbers.

    One exchange, by file: its sheets are judged one by one and the first that will do is kept.
    """
    code = F.coalesce(normalise_code(F.col("value_str")), number_code(F.col("value_num")))
    cell = F.struct("row", "col", F.when(code.rlike(CODE), code).alias("code"), "value_str", "value_num", "percent", "day")
    sheets = grid.repartition("path").groupBy("path", "sheet").agg(F.array_sort(F.collect_list(F.when(F.col("error").isNull(), cell))).alias("cells"), F.max("error").alias("broken"))

    def judged(k: Column) -> Column:
        own = F.filter("cells", lambda c: (c["col"] == k) & c["code"].isNotNull())
        anchor = F.get(F.filter(own, lambda c: c["code"] == "2.1"), F.lit(0))["row"]
        return F.struct(F.when(anchor.isNotNull(), F.size(F.array_distinct(F.transform(own, lambda c: c["code"])))).alias("n"), (-k).alias("k"), anchor.alias("anchor"))

    best = F.array_max(F.filter(F.transform(F.sequence(F.lit(1), F.lit(searched)), judged), lambda j: j["n"].isNotNull()))
    sheets = sheets.withColumn("best", best)
    numbers = F.filter("cells", lambda c: (c["row"] == F.col("best.anchor")) & (c["col"] > -F.col("best.k")) & c["value_num"].isNotNull())
    sheets = sheets.withColumn("cols", F.when(F.col("best").isNotNull(), F.slice(F.transform(numbers, lambda c: c["col"]), 1, 2)))
    ready = F.when(F.size("cols") > 0, F.col("sheet"))
    got = sheets.groupBy("path").agg(F.max("broken").alias("broken"), F.min_by(F.when(ready.isNotNull(), F.struct("cells", (-F.col("best.k")).alias("code_col"), "cols")), ready).alias("s"))
    return got.select("path", "broken", "s.cells", "s.code_col", "s.cols")


def _grid_documents(grid: DataFrame, searched: int = 6) -> DataFrame:
    """doc_id (path), broken, text (of the chosen sheet, cell by cell), report_cell (the first date
    right of the last cell that says "reporting date" and has one) and cells: of each code's
    first row the numbers in the two value columns. Text cells are no values."""
    rows = _sheet_rows(grid, searched).withColumnRenamed("cells", "all")
    coded = F.filter("all", lambda c: (c["col"] == F.col("code_col")) & c["code"].isNotNull() & ~c["code"].isin(*SECTIONS))
    rows = rows.withColumn("coded", coded)
    first = F.filter("coded", lambda c, i: F.array_position(F.transform("coded", lambda x: x["code"]), c["code"]) == i + 1)

    def read(c: Column) -> Column:
        scale = lambda x: F.when(x["percent"] & c["code"].isin(*PERCENT), 100).otherwise(1)
        at = lambda i: F.get(F.transform(F.filter("all", lambda x: (x["row"] == c["row"]) & (x["col"] == F.get("cols", F.lit(i))) & x["value_num"].isNotNull()), lambda x: x["value_num"] * scale(x)), F.lit(0))
        return F.struct(c["code"].alias("code"), at(0).alias("this"), at(1).alias("last"))

    cells = F.filter(F.transform(first, read), lambda c: c["this"].isNotNull() | c["last"].isNotNull())
    said = F.filter("all", lambda c: F.lower(c["value_str"]).contains("reporting date"))
    after = F.transform(said, lambda s: F.get(F.filter("all", lambda c: (c["row"] == s["row"]) & (c["col"] > s["col"]) & c["day"].isNotNull()), F.lit(0))["day"])
    text = F.array_join(F.transform("all", lambda c: c["value_str"]), "\n")
    return rows.select(F.col("path").alias("doc_id"), "broken", text.alias("text"), F.get(F.reverse(F.array_compact(after)), F.lit(0)).alias("report_cell"), cells.alias("cells"))


def grid_cells(grid: DataFrame, searched: int = 6) -> DataFrame:
    """doc_id (path), code, this, last of the chosen sheets."""
    return _grid_documents(grid, searched).select("doc_id", F.explode_outer("cells").alias("c")).where("c is not null").select("doc_id", "c.*")


def grid_heads(grid: DataFrame, searched: int = 6) -> DataFrame:
    """doc_id (path), text and report_cell of the chosen sheets."""
    return _grid_documents(grid, searched).where("text is not null").select("doc_id", "text", "report_cell")


def parse_grids(grid: DataFrame, funds: DataFrame | None = None) -> DataFrame:
    """Filings of spreadsheets; funds (doc_id, fund_code, source) if the caller knows them."""
    rows = _grid_documents(grid)
    if funds is not None:
        rows = rows.join(funds, "doc_id", "left")
    got = headed_rows(rows)
    # what broke a file precedes what its text lacks
    none = F.when(F.col("error") == "ParseError: no text", "ParseError: no sheet has a line 2.1").otherwise(F.col("error"))
    return got.withColumn("error", F.coalesce("broken", none)).drop("broken")


def parse_files(files: DataFrame, glyphs: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Filings of files of any kind: path, content and, where known, fund_code and source.

    glyphs reads PDF files (path, content) as glyphs; without it they are failures. A file of
    no known kind is one, too. Files are told apart by their bytes, not by their names.
    """
    from . import geometry

    given = [c for c in ("fund_code", "source") if c in files.columns]
    kind = files.withColumn("kind", container(F.col("content"), F.col("path"))).withColumnRenamed("path", "doc_id")
    known = kind.select("doc_id", *given)
    texts = kind.where("kind = 'text'").select("doc_id", F.expr("decode(content, 'UTF-8')").alias("text"), *given)
    books = kind.where("kind = 'xlsx'").select(F.col("doc_id").alias("path"), "content")
    out = parse_texts(texts).unionByName(parse_grids(read_xlsx(books), known if given else None))
    printed = kind.where("kind = 'pdf'")
    if glyphs is not None:
        out = out.unionByName(geometry.parse_glyphs(glyphs(printed.select(F.col("doc_id").alias("path"), "content")), printed.select("doc_id", *given)))
        printed = printed.limit(0)
    why = F.when(F.col("kind") == "pdf", "ParseError: no reader of PDF files is given").otherwise("ParseError: unknown container")
    rest = printed.unionByName(kind.where("kind is null")).select("doc_id", *given, why.alias("error"))
    return out.unionByName(rest, allowMissingColumns=True)


def read_rates(spark: SparkSession, path: str) -> DataFrame:
    """The curated monthly series, all its columns; raises if a column or a provenance is missing
    or a month stands twice."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    if missing := {"month", "rate_pct", "provenance"} - set(df.columns):
        raise ValueError(f"columns are missing: {sorted(missing)}")
    df = df.withColumns({"month": F.to_date(F.concat(F.substring("month", 1, 7), F.lit("-01"))), "rate_pct": F.col("rate_pct").try_cast("double")})
    bad = df.agg(F.count_if(F.coalesce(F.trim("provenance"), F.lit("")) == "").alias("blank"), (F.count("month") - F.countDistinct("month")).alias("twice")).collect()[0]
    if bad["blank"] or bad["twice"]:
        raise ValueError(f"{bad['blank']} rows without provenance, {bad['twice']} months that repeat")
    return df.orderBy("month")


def read_panel(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A published panel again, from CSV (with a header) or Parquet."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The records of all fetches, from folders of JSON lines."""
    return spark.read.json(path)
