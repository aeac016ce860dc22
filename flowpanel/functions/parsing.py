"""Column expressions that turn printed figures, dates, names and links into values."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "


def parse_number(token: Column) -> Column:
    """A printed figure as a double, NULL if it is none: separators, one percent sign at the end,
    brackets at either end for a changed sign. Only digits count: no nan, inf or exponents."""
    plain = F.trim(F.replace(token, F.lit(NBSP), F.lit(" ")))
    plain = F.trim(F.regexp_replace(plain, r"%$", ""))
    changed = plain.startswith("(") | plain.endswith(")")
    digits = F.regexp_replace(F.regexp_replace(plain, r"^\(+|\)+$", ""), r"[, ]", "")
    value = F.when(digits.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), digits.try_cast("double"))
    return F.when(changed, -value).otherwise(value)


def normalise_code(code: Column) -> Column:
    """A line code from a text cell: trimmed, otherwise as it stands ("2.10" is no "2.1"); blanks are NULL."""
    return F.nullif(F.trim(F.replace(code.cast("string"), F.lit(NBSP), F.lit(" "))), F.lit(""))


def number_code(value: Column) -> Column:
    """A line code from a numeric cell: 6.1 is "6.1", 1.0 is "1"; NaN is NULL."""
    return F.when(~F.isnan(value), F.nullif(F.regexp_replace(F.format_string("%.10f", value), r"\.?0+$", ""), F.lit("")))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def english_date(text: Column) -> Column:
    return F.coalesce(F.try_to_date(text, "d MMM yyyy"), F.try_to_date(text, "d MMMM yyyy"))


def _dmy(d: Column, m: Column, y: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")


#: Fixed header shapes: the first that matches decides, even if its date does not exist.
VN_FULL = r"(?iu)từ\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})\s+đến\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
VN_SHORT = r"(?iu)từ\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+đến\s+ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
VN_SLASH = r"(?iu)từ\s*:?\s*(\d{1,2})/(\d{1,2})/(\d{4})\s*đến\s*:?\s*(\d{1,2})/(\d{1,2})/(\d{4})"
EN_FULL = r"(?iu)from\s+(\d{1,2}\s+[\p{L}\d_]{3,}\s+\d{4})\s+to\s+(\d{1,2}\s+[\p{L}\d_]{3,}\s+\d{4})"
EN_SHORT = r"(?iu)from\s+(\d{1,2}\s+[\p{L}\d_]{3,})\s+to\s+(\d{1,2}\s+[\p{L}\d_]{3,}\s+\d{4})"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body over value, which is worked out once however often body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _both(start: Column, end: Column) -> Column:
    """struct(s, e) if both dates exist."""
    return _let(F.struct(start.alias("s"), end.alias("e")), lambda p: F.when(p["s"].isNotNull() & p["e"].isNotNull(), p))


def _groups(text: Column, pattern: str, n: int) -> list[Column]:
    return [F.regexp_extract(text, pattern, k) for k in range(1, n + 1)]


def _matched(text: Column, pattern: str, n: int) -> Column:
    """The groups of the first match as an array, NULL without one: one search of the text."""
    parts = lambda whole: F.split(F.regexp_replace(whole, pattern, "|".join(f"${k}" for k in range(1, n + 1))), r"\|")
    return _let(F.regexp_extract(text, pattern, 0), lambda whole: F.when(whole != "", parts(whole)))


def vietnamese_period(text: Column) -> Column:
    """struct(s, e) of the first shape that matches; NULL if one of its dates does not exist."""
    day = lambda m, k: _dmy(*[F.get(m, F.lit(k + i)) for i in range(3)])

    def short(m: Column) -> Column:
        d1, m1, d2, m2, y2 = (F.get(m, F.lit(k)) for k in range(5))
        # a start month after the end month lies in the year before
        year = (y2.try_cast("int") - (m1.try_cast("int") > m2.try_cast("int")).cast("int")).cast("string")
        return _both(_dmy(d1, m1, year), _dmy(d2, m2, y2))

    whole = lambda m: _both(day(m, 0), day(m, 3))
    slash = _let(_matched(text, VN_SLASH, 6), lambda m: F.when(m.isNotNull(), whole(m)))
    rest = _let(_matched(text, VN_SHORT, 5), lambda m: F.when(m.isNotNull(), short(m)).otherwise(slash))
    return _let(_matched(text, VN_FULL, 6), lambda m: F.when(m.isNotNull(), whole(m)).otherwise(rest))


def english_period(text: Column) -> Column:
    def short(m: Column) -> Column:
        def within(end: Column) -> Column:
            same = english_date(F.concat_ws(" ", F.get(m, F.lit(0)), F.year(end).cast("string")))
            # a month after the end's month belongs to the year before
            return _both(_let(same, lambda d: F.when(F.month(d) > F.month(end), F.add_months(d, -12)).otherwise(d)), end)

        return _let(english_date(F.get(m, F.lit(1))), within)

    rest = _let(_matched(text, EN_SHORT, 2), lambda m: F.when(m.isNotNull(), short(m)))
    return _let(_matched(text, EN_FULL, 2), lambda m: F.when(m.isNotNull(), _both(english_date(F.get(m, F.lit(0))), english_date(F.get(m, F.lit(1))))).otherwise(rest))


def header_period(text: Column) -> Column:
    """struct(start, end, conflict): Vietnamese first, endpoint by endpoint; both are named if they differ."""

    def resolved(p: Column) -> Column:
        vn, en = p["vn"], p["en"]
        said = lambda what, k: F.when(vn[k] != en[k], F.concat(F.lit(f"{what} VN "), vn[k].cast("string"), F.lit(" vs EN "), en[k].cast("string")))
        conflict = F.nullif(F.concat_ws("; ", said("period_start", "s"), said("period_end", "e")), F.lit(""))
        return F.struct(F.coalesce(vn["s"], en["s"]).alias("start"), F.coalesce(vn["e"], en["e"]).alias("end"), conflict.alias("conflict"))

    return _let(F.struct(vietnamese_period(text).alias("vn"), english_period(text).alias("en")), resolved)


#: The filing's own date, Vietnamese first.
VN_REPORT = r"(?iu)Ngày lập báo cáo\s*:?\s*Ngày\s+(\d{1,2})\s+tháng\s+(\d{1,2})\s+năm\s+(\d{4})"
EN_REPORT = r"(?iu)Reporting\s+Date\s*:?\s*(\d{1,2}\s+[\p{L}\d_]{3,}\s+\d{4})"


def report_date(text: Column) -> Column:
    vn = _let(_matched(text, VN_REPORT, 3), lambda m: F.when(m.isNotNull(), _dmy(*[F.get(m, F.lit(k)) for k in range(3)])))
    return F.coalesce(vn, _let(F.regexp_extract(text, EN_REPORT, 1), english_date))


def clean_html(html: Column, *, closed: bool = False) -> Column:
    """Text without tags, character references resolved (closed: as in unescape), white space (also of other scripts) collapsed."""
    return F.trim(F.regexp_replace(unescape(F.regexp_replace(html, r"<[^>]+>", " "), closed=closed), r"(?U)[\s\x1c-\x1f]+", " "))


#: Document links carry one of these endings.
DOCUMENTS = "pdf|xlsx|xls"


def links(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r'href="([^"]*)"'), F.lit(1))


def file_links(html: Column) -> Column:
    """The distinct targets of links to documents, in either kind of quotes, a query string allowed."""
    found = F.regexp_extract_all(html, F.lit(rf"""(?i)href=["']([^"']+\.(?:{DOCUMENTS})(?:\?[^"']*)?)["']"""), F.lit(1))
    return F.array_distinct(F.transform(found, lambda link: unescape(link)))


def _named() -> dict[str, str]:
    """Character references by name, as the standard library lists them; a name ends with a
    semicolon, a few old ones also stand without it."""
    from html.entities import html5

    return html5


def _old_bytes() -> dict[str, str]:
    """Numbers that stand for something else than their code point: those of the one-byte table
    that old pages took them from, the null and the carriage return."""
    old = {n: bytes([n]).decode("cp1252", "replace").replace("\ufffd", chr(n)) for n in range(0x80, 0xA0)}
    return {str(n): c for n, c in (old | {0x00: "\ufffd", 0x0D: "\r"}).items()}


def _as_map(pairs: dict[str, str]) -> Column:
    """A constant map, built once for a query."""
    return F.str_to_map(F.lit("\x02".join(f"{k}\x03{v}" for k, v in pairs.items())), F.lit("\x02"), F.lit("\x03"))


def _numbered(digits: Column) -> Column:
    """The character of a decimal number; what is no character is U+FFFD or nothing."""
    n = digits.try_cast("bigint")
    known = F.element_at(_as_map(_old_bytes()), n.cast("string"))
    none = n.between(0x1, 0x8) | (n == 0xB) | n.between(0xE, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(known.isNotNull(), known).when(n.isNull() | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), "\ufffd").when(none, "").otherwise(char)


def _reference(part: Column, closed: bool) -> Column:
    """What follows an ampersand, up to the next one, with the reference it begins with resolved."""
    old = sorted((k for k in _named() if not k.endswith(";")), key=len, reverse=True)
    rest = lambda token: F.substr(part, F.length(token) + 1)
    resolved = lambda token, char: F.concat(char, rest(token))

    def number(token: Column) -> Column:
        digits = F.regexp_replace(token, "[#;xX]", "")
        return resolved(token, _numbered(F.when(token.rlike("^#[xX]"), F.conv(_short(F.ltrim(digits, F.lit("0"))), 16, 10)).otherwise(digits)))

    def name(token: Column) -> Column:
        # the whole name, else the longest old name that it begins with
        begun = F.lit("") if closed else F.regexp_extract(token, "^(?:" + "|".join(old) + ")", 0)
        whole = lambda found: F.when(found.isNotNull(), resolved(token, found)).when(begun != "", resolved(begun, F.element_at(_as_map(_named()), begun))).otherwise(F.concat(F.lit("&"), part))
        return _let(F.element_at(_as_map(_named()), token), whole)

    plain = F.concat(F.lit("&"), part)
    is_number = part.rlike("^#(?:[0-9]+|[xX][0-9a-fA-F]+);" if closed else "^#(?:[0-9]|[xX][0-9a-fA-F])")
    found = F.when(is_number, _let(F.regexp_extract(part, "^#(?:[0-9]+|[xX][0-9a-fA-F]+);?", 0), number))
    for basic, char in (("amp;", "&"), ("lt;", "<"), ("gt;", ">"), ("quot;", '"'), ("nbsp;", NBSP)):  # most are these
        found = found.when(part.startswith(basic), F.concat(F.lit(char), F.substr(part, F.lit(len(basic) + 1))))
    return found.when(part.rlike(r"^[^\t\n\f <&#;]{1,32};" if closed else r"^[^\t\n\f <&#;]"), _let(F.regexp_extract(part, r"^[^\t\n\f <&#;]{1,32};?", 0), name)).otherwise(plain)


def _short(digits: Column) -> Column:
    """Hexadecimal digits, without leading zeros; so many that they are no character become such a number."""
    return F.when(digits == "", "0").when(F.length(digits) > 8, "FFFFFFFF").otherwise(digits)


def unescape(text: Column, *, closed: bool = False) -> Column:
    """Character references resolved, in one pass: decimal, hexadecimal and named ones. What a
    reference gives is not read again: "&amp;#39;" is "&#39;". With closed those alone that end with
    a semicolon: one that a text's cut left open ("R&amp") stays as it stands."""

    def parted(parts: Column) -> Column:
        return F.concat(F.get(parts, F.lit(0)), F.array_join(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda part: _reference(part, closed)), ""))

    return F.when(F.contains(text, F.lit("&")), _let(F.split(text, "&"), parted)).otherwise(text)


def absolute_url(base: Column, link: Column) -> Column:
    """link as seen from the page base: whole, from the host's root, or beside the page."""
    host = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    folder = F.regexp_replace(F.regexp_replace(base, r"[?#].*$", ""), r"(?<=[^/:])/[^/]*$", "")
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link.startswith("/"), F.concat(host, link))
        .otherwise(F.concat(folder, F.lit("/"), link))
    )


def base_name(url: Column) -> Column:
    """The last part of the path, percent signs resolved; a part that can't be resolved stays."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    return F.coalesce(F.try_url_decode(F.replace(last, F.lit("+"), F.lit("%2B"))), last)


def page_slug(url: Column) -> Column:
    return F.lower(base_name(F.regexp_replace(F.regexp_replace(url, r"[?#].*$", ""), "/+$", "")))


#: Endings that a cached document keeps.
SUFFIX = r"(?i)\.(pdf|xlsx|xlsm|xls|zip)$"


def url_hash(url: Column) -> Column:
    return F.substring(F.sha2(F.encode(url, "UTF-8"), 256), 1, 16)


def cache_name(url: Column, content: Column | None = None) -> Column:
    """<stem>-<first 16 hex digits of the SHA-256 of the content, if given, else of the URL><suffix>."""
    last = F.element_at(F.split(F.regexp_replace(url, r"[?#].*$", ""), "/"), -1)
    name = F.regexp_replace(F.when(last == "", "download").otherwise(last), r"[^A-Za-z0-9._-]", "_")
    ending = F.lower(F.regexp_extract(name, SUFFIX, 0))
    stem = F.substring(F.regexp_replace(name, SUFFIX, ""), 1, 80)
    digest = url_hash(url) if content is None else F.coalesce(F.substring(F.sha2(content, 256), 1, 16), url_hash(url))
    return F.concat(F.when(stem == "", "download").otherwise(stem), F.lit("-"), digest, ending)


def flat_date(name: Column) -> Column:
    """The first eight digits of a file name as yyyymmdd."""
    d = r"(\d{4})(\d{2})(\d{2})"
    y, m, d_ = _groups(name, d, 3)
    return _dmy(d_, m, y)


def period_date(name: Column) -> Column:
    """The end of the period that a file name states: a dotted date after "den-", else eight
    digits at the end (a copy's number may follow), else the first eight digits."""
    dotted, last = r"(?i)den-(\d{2})\.(\d{2})\.(\d{4})", rf"(?i)(\d{{4}})(\d{{2}})(\d{{2}})(?:-\d+)?\.(?:{DOCUMENTS})$"
    y, m, d = _groups(name, last, 3)
    return F.when(name.rlike(dotted), _dmy(*_groups(name, dotted, 3))).when(name.rlike(last), _dmy(d, m, y)).otherwise(flat_date(name))


def any_date(name: Column) -> Column:
    """The first of yyyymmdd, yyyy-mm-dd and dd.mm.yyyy (also with _ or -) that is a date."""
    y, m, d = _groups(name, r"(\d{4})-(\d{2})-(\d{2})", 3)
    return F.coalesce(flat_date(name), _dmy(d, m, y), _dmy(*_groups(name, r"(\d{2})[_.-](\d{2})[_.-](\d{4})", 3)))


#: Fixed name shapes of the reports: (kind, pattern), the first that matches decides.
KINDS = {
    "period_word": (("daily", r"(?iu)[-_](?:ngay|ngày|daily)[-_]"), ("weekly", r"(?iu)[-_](?:tuan|tuần|weekly)[-_]")),
    "bc_code": (("daily", r"(?i)_BC_NGAY_"), ("period", r"(?i)_BC_KY_"), ("weekly", r"(?i)_BC_TUAN_"), ("unknown", r"(?i)_BC_")),
    "change_word": (("weekly", r"(?i)thay[\s_-]?doi"),),
}
#: The fixed word of a weekly report's page.
WEEKLY_PAGE = r"(?i)(?:^|[-_])(?:tuan|week)(?:[-_]|$)"


def report_kind(name: Column, scheme: str) -> Column:
    """The kind that a file name states in a scheme of KINDS, else "other"."""
    out = None
    for kind, pattern in KINDS[scheme]:
        out = F.when(name.rlike(pattern), kind) if out is None else out.when(name.rlike(pattern), kind)
    return out.otherwise("other")


#: A code in brackets: two capitals or digits at least, one part after a hyphen allowed.
FUND_CODE = r"\(([A-Z][A-Z0-9]{1,6}(?:-[A-Z0-9]{2,6})?)\)"


def fund_code(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, FUND_CODE, 1), F.lit(""))
