"""Feeds beside the filings: rate tables, nested rates, snapshots, index series, unit values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import panel

#: The fixed signs of a rate table: its row, its percent cell, the heading of the retail table.
TWELVE, PERCENT, RETAIL = r"(?iu)^12\s*th[áa]ng$", r"^([0-9]+(?:[.,][0-9]+)?)\s*%$", r"(?iu)Cá\s*nhân"
#: Characters before a table that may hold its heading, and how many of their text count.
LOOK, HEADING = 1600, 400
#: The banks whose mean counts, all of them, and the term in the nested form.
BANKS, TERM = ("Vietcombank", "BIDV", "Agribank", "VietinBank"), "12T"


def _text(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]+>", " "), r"\s+", " "))


def table_rate(html: Column) -> Column:
    """The twelve-month rate of a page: of its retail table, else of its first table with one."""
    pattern = F.lit(r"(?s)<table.*?</table>")
    tables, gaps = F.regexp_extract_all(html, pattern, F.lit(0)), F.split(html, r"(?s)<table.*?</table>", -1)
    # where each table begins: the gaps and tables before it
    ends = lambda i: F.aggregate(F.slice(F.zip_with(gaps, tables, lambda g, t: F.length(g) + F.coalesce(F.length(t), F.lit(0))), 1, i), F.lit(0), lambda a, n: a + n)

    def candidate(t: Column, i: Column) -> Column:
        start = ends(i) + F.length(F.get(gaps, i))
        before = _text(F.substr(html, F.greatest(start - LOOK, F.lit(0)) + 1, F.least(start, F.lit(LOOK))))
        rows = F.transform(F.regexp_extract_all(t, F.lit(r"(?s)<tr.*?</tr>"), F.lit(0)), lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?s)<t[dh].*?</t[dh]>"), F.lit(0)), _text))
        # the first row of the term decides, whatever stands beside it
        row = F.get(F.filter(rows, lambda r: (F.size(r) >= 2) & F.get(r, F.lit(0)).rlike(TWELVE)), F.lit(0))
        rate = F.replace(F.nullif(F.regexp_extract(F.get(row, F.lit(1)), PERCENT, 1), F.lit("")), F.lit(","), F.lit(".")).cast("double")
        return F.struct(F.right(before, F.lit(HEADING)).rlike(RETAIL).alias("retail"), rate.alias("rate"))

    found = F.filter(F.transform(tables, candidate), lambda c: c["rate"].isNotNull())
    return F.coalesce(F.get(F.filter(found, lambda c: c["retail"]), F.lit(0))["rate"], F.get(found, F.lit(0))["rate"])


def snapshot_rates(snapshots: DataFrame) -> DataFrame:
    """month, rate, snapshot, original: of each month the latest snapshot (timestamp
    yyyyMMdd..., original, html) that holds a rate."""
    got = snapshots.withColumn("rate", table_rate(F.col("html"))).where("rate is not null")
    month = F.to_date(F.concat(F.substring("timestamp", 1, 6), F.lit("01")), "yyyyMMdd")
    last = F.max_by(F.struct("rate", F.col("timestamp").alias("snapshot"), "original"), F.struct("timestamp", "original"))
    return got.groupBy(month.alias("month")).agg(last.alias("s")).select("month", "s.*")


NESTED = "struct<Data: array<struct<name: string, interestRates: array<struct<time: string, value: double>>>>>"


def bank_mean_rates(payloads: DataFrame, banks: tuple[str, ...] = BANKS, term: str = TERM) -> DataFrame:
    """month, rate (mean over the banks), n_banks, snapshot: of nested payloads (timestamp, json)
    that give all banks a positive rate of the term; the last payload of a month counts."""
    one = payloads.select("timestamp", F.from_json("json", NESTED).alias("p")).select("timestamp", F.posexplode("p.Data").alias("pos", "b"))
    value = F.get(F.filter("b.interestRates", lambda r: r["time"] == term), F.lit(0))["value"]
    one = one.where(F.col("b.name").isin(*banks)).select("timestamp", "pos", F.col("b.name").alias("name"), value.alias("value")).where("value > 0")
    per = one.groupBy("timestamp", "name").agg(F.max_by("value", "pos").alias("value"))
    whole = per.groupBy("timestamp").agg(F.count("*").alias("n_banks"), F.avg("value").alias("rate")).where(F.col("n_banks") == len(banks))
    month = F.to_date(F.concat(F.substring("timestamp", 1, 6), F.lit("01")), "yyyyMMdd")
    last = F.max_by(F.struct(F.round("rate", 4).alias("rate"), F.col("n_banks").cast("int").alias("n_banks"), F.col("timestamp").alias("snapshot")), "timestamp")
    return whole.groupBy(month.alias("month")).agg(last.alias("s")).select("month", "s.*")


SERIES = ["rate", "bank", "tenor", "source", "n_banks", "snapshot", "provenance"]


def rate_series(sources: list[DataFrame], first: str, last: str) -> DataFrame:
    """The monthly series: of the sources (month, rate, bank, tenor, source, n_banks, snapshot,
    provenance), the best first, the best of each month; gaps bridged where both sides agree."""
    return panel.bridge(panel.merge_sources([s.select("month", *SERIES) for s in sources]), first, last)


def index_series(history: DataFrame, first: str, last: str) -> DataFrame:
    """day, close within the dates, by day: names in any case, the day as date or timestamp."""
    low = history.select(*[F.col(f"`{c}`").alias(c.lower()) for c in history.columns])
    return low.select(F.to_date("time").alias("day"), F.col("close").cast("double").alias("close")).where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date"))).orderBy("day")


def fund_catalogue(payloads: DataFrame) -> DataFrame:
    """feed_id, short_name, name of a catalogue's answers (json)."""
    form = "struct<data: struct<rows: array<struct<id: bigint, shortName: string, name: string>>>>"
    return payloads.select(F.explode(F.from_json("json", form)["data"]["rows"]).alias("r")).select(F.col("r.id").alias("feed_id"), F.col("r.shortName").alias("short_name"), F.col("r.name").alias("name"))


def unit_value_history(payloads: DataFrame) -> DataFrame:
    """fund_code, day, nav_per_unit, pos of a feed's answers (fund_code, json). The day and the value
    have one of several names; an answer whose rows have none is an error. pos is the feed's order."""
    form = "struct<data: array<struct<navDate: string, createAt: string, date: string, nav: double, navValue: double>>>"
    rows = payloads.select("fund_code", F.posexplode(F.from_json("json", form)["data"]).alias("pos", "r"))
    day = F.coalesce("r.navDate", "r.createAt", "r.date")
    # a number is milliseconds since 1970, anything else begins with a day
    day = F.when(day.rlike(r"^\d{11,}$"), F.to_date(F.timestamp_millis(day.try_cast("bigint")))).otherwise(F.try_to_date(F.substring(day, 1, 10), "yyyy-MM-dd"))
    got = rows.select("fund_code", day.alias("day"), F.coalesce("r.nav", "r.navValue").alias("nav_per_unit"), "pos")
    bad = got.groupBy("fund_code").agg(F.count("day").alias("days"), F.count("nav_per_unit").alias("values")).where("days = 0 or values = 0").first()
    if bad:
        raise ValueError(f"the answer for {bad['fund_code']} has no day or no value of a known name")
    return got.where("nav_per_unit is not null")


def last_by_day(history: DataFrame) -> DataFrame:
    """Of a feed's rows for one fund and day the last, which is the revision."""
    return history.groupBy("fund_code", "day").agg(F.max_by("nav_per_unit", "pos").alias("nav_per_unit"))
