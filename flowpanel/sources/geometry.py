"""Filings from the places of glyphs on a page: lines, value columns, cells, detached values.

Glyphs and words are rows doc_id, page, top, x0, x1, text. Both value columns are flush right, so
a column is known by its right edge; a figure is read from the glyphs inside the column's
window in their order, however the words around it were put together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.parsing import parse_number
from .readers import CODE, FIELDS, FIGURE, METADATA, SECTIONS, headed_rows

#: Fixed measures in points: height of a band, gap between clusters of edges, how far a figure may
#: lie from its column, how far below its code a detached line may stand.
BAND, GAP, TOLERANCE, DETACHED = 3.0, 6.0, 20.0, 12.0
#: Space between glyphs that parts two words.
SPACE = 1.5

_FIGURE = f"^{FIGURE}$"
#: The glyphs of figures.
_DIGITS = r"^[0-9,.()%-]$"
LINE = ["doc_id", "page", "line"]


def words_of(glyphs: DataFrame, space: float = SPACE) -> DataFrame:
    """Words from glyphs: those of one height whose gaps are small. Blanks part words. digits: the
    word's glyphs that figures are made of."""
    w = Window.partitionBy("doc_id", "page", "top").orderBy("x0")
    new = (F.col("x0") - F.lag("x1").over(w) > space) | (F.lag("blank").over(w)) | F.col("blank")
    got = glyphs.withColumn("blank", F.trim("text") == "").withColumn("new", F.coalesce(new, F.lit(True)).cast("int")).withColumn("n", F.sum("new").over(w)).where("not blank")
    parts = F.array_sort(F.collect_list(F.struct("x0", "text")))
    digits = F.collect_list(F.when(F.col("text").rlike(_DIGITS), F.struct("x0", "text", "top")))
    got = got.groupBy("doc_id", "page", "top", "n").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.array_join(F.transform(parts, lambda p: p["text"]), "").alias("text"), digits.alias("digits"))
    return got.drop("n")


def banded(words: DataFrame, band: float = BAND) -> DataFrame:
    """words with line: bands of heights, each joined to a line that began in a neighbouring band.

    A run of bands without a gap begins a line in every second band, so the line follows from
    where the run began: one sorted pass over a page."""
    of = words.withColumn("band", F.bround(F.col("top") / band).cast("int"))
    w = Window.partitionBy("doc_id", "page").orderBy("band")
    begins = F.coalesce(F.col("band") - F.lag("band").over(w) > 1, F.lit(True))
    of = of.withColumn("run", F.when(begins, F.col("band"))).withColumn("run", F.last("run", True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return of.withColumn("line", F.col("run") + 2 * F.floor((F.col("band") - F.col("run")) / 2).cast("int")).drop("band", "run")


def page_lines(words: DataFrame) -> DataFrame:
    """doc_id, page, line, top, low, words and digits (from left to right): all lines."""
    has_digits = "digits" in words.columns
    every = F.array_sort(F.collect_list(F.struct("x0", "x1", "text", "top")))
    digits = F.array_sort(F.flatten(F.collect_list("digits"))) if has_digits else F.array().cast("array<struct<x0:double,text:string,top:double>>")
    return banded(words).groupBy(*LINE).agg(every.alias("words"), F.min("top").alias("top"), F.max("top").alias("low"), digits.alias("digits"))


def edge_clusters(values: DataFrame, by: str, x: str, gap: float = GAP) -> DataFrame:
    """Clusters of sorted values whose neighbours lie within gap: by, cluster, n, lo, hi, centre."""
    w = Window.partitionBy(by).orderBy(x)
    new = (F.col(x) - F.lag(x).over(w) > gap).cast("int")
    ids = values.withColumn("_new", F.coalesce(new, F.lit(0))).withColumn("cluster", F.sum("_new").over(w))
    return ids.groupBy(by, "cluster").agg(F.count("*").alias("n"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.avg(x).alias("centre"))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _nearest(x1: Column, edges: Column) -> Column:
    """The place of the nearest edge (from 1), NULL if it is too far."""
    away = F.transform(edges, lambda e: F.abs(x1 - e))
    return F.when(F.array_min(away) <= TOLERANCE, F.array_position(away, F.array_min(away)).cast("int"))


def _edges(rights: Column, n: int = 2) -> Column:
    """The centres of the n largest clusters of right edges, of equals the leftmost, from left to right."""
    empty = F.array().cast("array<struct<n:int,lo:double,hi:double,sum:double>>")
    one = lambda n, lo, hi, total: F.array(F.struct(n.cast("int").alias("n"), lo.alias("lo"), hi.alias("hi"), total.alias("sum")))

    def add(acc: Column, x: Column) -> Column:
        last, size = F.element_at(acc, -1), F.size(acc)
        near = (size > 0) & (x - F.try_element_at(acc, F.lit(-1))["hi"] <= GAP)
        grown = F.concat(F.slice(acc, 1, F.greatest(size - 1, F.lit(0))), one(last["n"] + 1, last["lo"], x, last["sum"] + x))
        return F.when(near, grown).otherwise(F.concat(acc, one(F.lit(1), x, x, x)))

    clusters = F.aggregate(F.array_sort(rights), empty, add)
    top = F.slice(F.array_sort(F.transform(clusters, lambda c: F.struct((-c["n"]).alias("n"), c["lo"].alias("lo"), (c["sum"] / c["n"]).alias("centre")))), 1, n)
    return F.array_sort(F.transform(top, lambda c: c["centre"]))


def _windows(edges: Column, figures: Column) -> Column:
    """left, right of each value column: a window ends at the column's edge and is as wide as its
    widest figure and the tolerance, but does not reach into the column before."""

    def window(e: Column, i: Column) -> Column:
        width = F.array_max(F.transform(F.filter(figures, lambda w: _nearest(w["x1"], edges) == i + 1), lambda w: w["x1"] - w["x0"]))
        left = e - width - TOLERANCE
        before = F.when(i > 0, F.get(edges, i - 1) + 2.0)
        return F.when(width.isNotNull(), F.struct(F.greatest(left, before).alias("left"), (e + 3.0).alias("right")))

    return F.transform(edges, window)


def documents(glyphs: DataFrame) -> DataFrame:
    """doc_id, text (all lines) and cells (code, this, last of the template lines).

    One exchange: glyphs are dealt out by document, and words, bands and lines follow from
    sorted passes inside its pages. A document is then one row with its lines in order, and
    its columns, windows, figures and detached values are worked out on that row.
    """
    lines = page_lines(words_of(glyphs.repartition("doc_id")))
    rows = lines.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "line", "top", "low", "words", "digits"))).alias("every"))
    said = lambda line: F.array_join(F.transform(line["words"], lambda w: w["text"]), " ")
    rows = rows.withColumn("texts", F.transform("every", said))
    # the lines of the template with what stands before and after them on the page; header lines are none
    around = lambda i, k: F.coalesce(F.when(F.get("every", i + k)["page"] == F.get("every", i)["page"], F.get("every", i + k)["digits"]), F.array().cast("array<struct<x0:double,text:string,top:double>>"))

    def template(line: Column, i: Column) -> Column:
        head = F.get(line["words"], F.lit(0))["text"]
        is_code = head.rlike(CODE) & ~head.isin(*SECTIONS)
        figures = lambda first: F.filter(F.slice(line["words"], first, F.greatest(F.size(line["words"]) - first + 1, F.lit(0))), lambda w: w["text"].rlike(_FIGURE))
        # a line's glyphs reach 1.5 points above and below, into the bands beside it at most
        near = F.filter(F.concat(around(i, F.lit(-1)), line["digits"], around(i, F.lit(1))), lambda g: g["top"].between(line["top"] - 1.5, line["low"] + 1.5))
        return F.struct(line["page"].alias("page"), line["line"].alias("line"), line["top"].alias("top"), head.alias("head"), is_code.alias("is_code"), F.get("texts", i).rlike(METADATA).alias("header"), figures(F.lit(2)).alias("later"), F.when(~is_code, figures(F.lit(1))).otherwise(figures(F.lit(2))).alias("figures"), F.when(is_code, near).alias("near"))

    rows = rows.withColumn("lines", F.filter(F.transform("every", template), lambda x: ~x["header"]))
    text = F.array_join("texts", "\n")
    rows = rows.select("doc_id", text.alias("text"), "lines", F.flatten(F.transform("lines", lambda x: x["later"])).alias("later"))
    rows = rows.withColumn("edges", _edges(F.transform("later", lambda w: w["x1"])))
    rows = rows.withColumn("windows", _windows(F.col("edges"), F.col("later")))
    two = F.size("edges") == 2

    def rebuilt(line: Column, k: int) -> Column:
        """The glyphs of figures inside a column's window, in their order."""
        window = F.get("windows", F.lit(k))
        inside = F.filter(line["near"], lambda g: (g["x0"] >= window["left"]) & (g["x0"] < window["right"]))
        return parse_number(F.array_join(F.transform(F.array_sort(inside), lambda g: g["text"]), ""))

    def slot(line: Column, k: int) -> Column:
        """The first figure that stands in a column."""
        return F.get(F.transform(F.filter(line["figures"], lambda w: _nearest(w["x1"], F.col("edges")) == k + 1), lambda w: parse_number(w["text"])), F.lit(0))

    plain = lambda line, k: F.get(F.transform(line["figures"], lambda w: parse_number(w["text"])), F.lit(k))
    value = lambda line, k: F.when(two, F.coalesce(rebuilt(line, k), slot(line, k))).otherwise(plain(line, k))
    read = lambda line: F.struct(line["page"].alias("page"), line["top"].alias("top"), line["head"].alias("code"), F.when(F.size(line["figures"]) > 0, value(line, 0)).alias("this"), F.when(F.size(line["figures"]) > 0, value(line, 1)).alias("last"))
    rows = rows.withColumn("coded", F.transform(F.filter("lines", lambda x: x["is_code"]), read))
    # lines without a code whose figures stand in the value columns belong to the nearest code above
    loose = lambda line: F.struct(line["page"].alias("page"), line["top"].alias("top"), slot(line, 0).alias("this"), slot(line, 1).alias("last"))
    rows = rows.withColumn("loose", F.when(two, F.transform(F.filter("lines", lambda x: ~x["is_code"]), loose)).otherwise(F.array().cast("array<struct<page:int,top:double,this:double,last:double>>")))

    def owner(v: Column) -> Column:
        above = F.filter("coded", lambda c: (c["page"] == v["page"]) & (v["top"] > c["top"]) & (v["top"] - c["top"] <= DETACHED))
        return F.array_max(F.transform(above, lambda c: F.struct(c["top"], c["code"])))["code"]

    found = F.transform(F.filter("loose", lambda v: v["this"].isNotNull() | v["last"].isNotNull()), lambda v: F.struct(owner(v).alias("code"), v["this"].alias("this"), v["last"].alias("last")))
    rows = rows.withColumn("found", F.filter(found, lambda v: v["code"].isin(*FIELDS)))
    rows = rows.withColumn("valued", F.filter("coded", lambda c: c["this"].isNotNull() | c["last"].isNotNull()))

    def cell(code: Column) -> Column:
        first = lambda c: F.get(F.transform(F.filter("found", lambda v: (v["code"] == code) & v[c].isNotNull()), lambda v: v[c]), F.lit(0))
        # the first line of a code counts whole; what it leaves empty is filled
        return _let(F.get(F.filter("valued", lambda v: v["code"] == code), F.lit(0)), lambda v: F.struct(code.alias("code"), *[F.coalesce(v[c], first(c)).alias(c) for c in ("this", "last")]))

    codes = F.array_distinct(F.concat(F.transform("valued", lambda c: c["code"]), F.transform("found", lambda v: v["code"])))
    return rows.select("doc_id", "text", F.transform(codes, cell).alias("cells"))


def cells(glyphs: DataFrame) -> DataFrame:
    """doc_id, code, this, last of the documents' template lines."""
    # outer: a condition on the array would be worked out with all that it is made of
    return documents(glyphs).select("doc_id", F.explode_outer("cells").alias("c")).where("c is not null").select("doc_id", "c.*")


def attach_detached(codes: DataFrame, values: DataFrame, reach: float = DETACHED) -> DataFrame:
    """values with code: that of the nearest code line above, within reach, on its page; others go.

    Lines are matched by page and by bands of the reach, so the join is on equal keys."""
    near = codes.withColumn("band", F.explode(F.array(F.floor(F.col("top") / reach), F.floor(F.col("top") / reach) + 1))).withColumnRenamed("top", "code_top")
    got = values.withColumn("band", F.floor(F.col("top") / reach)).join(near, ["doc_id", "page", "band"])
    dy = F.col("top") - F.col("code_top")
    return got.where((dy > 0) & (dy <= reach)).groupBy(*values.columns).agg(F.max_by("code", F.struct("code_top", "code")).alias("code"))


def text_of(words: DataFrame) -> DataFrame:
    """doc_id, text: the words line by line."""
    lines = page_lines(words).select("doc_id", "page", "line", F.array_join(F.transform("words", lambda x: x["text"]), " ").alias("text"))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line", "text"))), lambda x: x["text"]), "\n").alias("text"))


def parse_glyphs(glyphs: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Filings from glyphs; docs (doc_id and, where known, fund_code and source) lists all
    documents, so that one without a glyph is a failure: it has no text layer."""
    rows = documents(glyphs)
    if docs is not None:
        rows = docs.join(rows, "doc_id", "left")
    return headed_rows(rows)
