"""Restatements, overlaps, joins by key, by day and as of a day, monthly rollup, rate series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .gates import with_flow_measures

MAX_BRIDGE_MONTHS = 6
CROSS_TOLERANCE, CROSS_LAG = 0.1, 1


def dedupe(filings: DataFrame, values: list[str]) -> tuple[DataFrame, DataFrame]:
    """(kept, superseded): of filings for one fund and period the last source stays; each one
    that goes names the next source and whether the figures were the same. Undated filings
    are told apart by their source."""
    undated = F.when(F.col("period_end").isNull(), F.col("source"))
    w = Window.partitionBy("fund_code", "period_start", "period_end", undated).orderBy(F.coalesce("source", F.lit("")))
    same = F.lit(True)
    for v in values:
        same = same & F.col(v).eqNullSafe(F.lead(v).over(w))
    seen = filings.withColumns({"superseded_by": F.lead("source").over(w), "_last": F.lead(F.lit(1)).over(w).isNull(), "_same": same})
    kept = seen.where("_last").drop("superseded_by", "_last", "_same")
    gone = seen.where("not _last").withColumn("reason", F.when(F.col("_same"), "identical").otherwise("restatement")).drop("_last", "_same")
    return kept, gone


def overlaps(filings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(kept, superseded): of dated periods with one start the longest stays, of equals the last
    source. Filings without both dates stay."""
    dated = F.col("period_start").isNotNull() & F.col("period_end").isNotNull()
    w = Window.partitionBy("fund_code", "period_start", dated).orderBy(F.desc_nulls_last("period_end"), F.desc(F.coalesce("source", F.lit(""))))
    seen = filings.withColumns({"_rank": F.when(dated, F.row_number().over(w)).otherwise(1), "superseded_by": F.first("source").over(w)})
    kept = seen.where("_rank = 1").drop("_rank", "superseded_by")
    return kept, seen.where("_rank > 1").withColumn("reason", F.lit("longer period")).drop("_rank")


def with_metadata(panel: DataFrame, funds: DataFrame) -> DataFrame:
    """Left join on fund_code, once per fund; the planner broadcasts the registry while it is small."""
    return panel.join(funds.dropDuplicates(["fund_code"]), "fund_code", "left")


def asof_days(panel: DataFrame, series: DataFrame, day: str, value: str, out: str) -> DataFrame:
    """The last value of series (day, value) on or before panel's day; NULL before the first.

    Both sides are united by day with the series first, so no filled calendar or theta join
    is needed: per day one row carries the value forward over at most one row per day, so the
    one unpartitioned window holds as many rows as the calendar has days. Both must be DATE.
    """
    if panel.schema[day].dataType.typeName() != "date" or series.schema["day"].dataType.typeName() != "date":
        raise TypeError("both sides are matched by DATE; asof_keyed takes timestamps")
    days = panel.select(F.col(day).alias("day")).where("day is not null").distinct().withColumn("v", F.lit(None).cast("double"))
    known = series.groupBy(F.col("day")).agg(F.max_by(F.col(value).cast("double"), F.col(value)).alias("v"))
    every = days.unionByName(known).groupBy("day").agg(F.max("v").alias("v"))
    filled = every.select(F.col("day").alias(day), F.last("v", ignorenulls=True).over(Window.orderBy("day")).alias(out))
    return panel.join(filled, day, "left")


def asof_keyed(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, out: str, tie: str, chunk: str = "day") -> DataFrame:
    """Per key the last right value at or before each left row; tie breaks equal right times.

    Both sides are cut into chunks of time. The last value of each chunk is carried on over the
    chunks of a key, which are few; inside a chunk a window does the rest. So the rows of one
    busy key are spread over its chunks.
    """
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType), "_tie": F.lit(None).cast(right.schema[tie].dataType)})
    b = right.where(F.col(value).isNotNull()).select(F.col(key), F.col(ts), F.col(value).alias("_v"), F.col(tie).alias("_tie")).withColumn("_side", F.lit(0))
    part = F.date_trunc(chunk, F.col(ts))
    lasts = b.withColumn("_chunk", part).groupBy(key, "_chunk").agg(F.max_by("_v", F.struct(ts, "_tie")).alias("_last"))
    wanted = left.select(F.col(key), part.alias("_chunk")).distinct().withColumn("_last", F.lit(None).cast(right.schema[value].dataType))
    both = lasts.unionByName(wanted).groupBy(key, "_chunk").agg(F.max("_last").alias("_last"))
    earlier = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = both.select(F.col(key).alias("_key"), F.col("_chunk").alias("_of"), F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    w = Window.partitionBy(key, "_chunk").orderBy(ts, "_side", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    got = a.unionByName(b, allowMissingColumns=True).withColumn("_chunk", part).withColumn("_in", F.last("_v", ignorenulls=True).over(w)).where("_side = 1")
    got = got.join(carried, F.col(key).eqNullSafe(F.col("_key")) & F.col("_chunk").eqNullSafe(F.col("_of")), "left").withColumn(out, F.coalesce("_in", "_before"))
    return got.drop("_side", "_v", "_tie", "_chunk", "_in", "_key", "_of", "_before")


def _present(df: DataFrame, what: str) -> DataFrame:
    if df is None or df.isEmpty():
        raise ValueError(f"the {what} is empty")
    return df


def with_market_return(panel: DataFrame, index: DataFrame) -> DataFrame:
    """index_begin, index_end, market_return and, beside a gross_return, excess_return: the closes
    as of both ends of each row's own period. index: day (DATE), close."""
    series = _present(index.where("close is not null"), "index series")
    got = asof_days(panel, series, "period_start", "close", "index_begin")
    got = asof_days(got, series, "period_end", "close", "index_end")
    got = got.withColumn("market_return", F.try_divide("index_end", F.nullif("index_begin", F.lit(0.0))) - 1)
    return got.withColumn("excess_return", F.col("gross_return") - F.col("market_return")) if "gross_return" in panel.columns else got


#: Columns of a rate series that go along if they are there.
RATE_COLUMNS = ("rate_pct", "provenance", "rate_low_pct", "rate_high_pct", "tenor", "source", "bank")


def with_deposit_rate(panel: DataFrame, rates: DataFrame) -> DataFrame:
    """month (of the period's end) and the rate of that month as deposit_ columns; a month without
    a rate stays NULL. rates: month (DATE, its first day), once each, rate_pct, provenance."""
    _present(rates, "rate series")
    name = lambda c: "deposit_" + (c if c.startswith("rate") else f"rate_{c}")
    keep = rates.select(F.date_format("month", "yyyy-MM").alias("month"), *[F.col(c).alias(name(c)) for c in RATE_COLUMNS if c in rates.columns])
    return panel.withColumn("month", F.date_format("period_end", "yyyy-MM")).join(keep, "month", "left")


def with_macro(panel: DataFrame, index: DataFrame, rates: DataFrame | None = None) -> DataFrame:
    """The market's return, which is required, and the deposit rate, if there is a series."""
    got = with_market_return(panel, index)
    return got if rates is None else with_deposit_rate(got, rates)


def exact_crosscheck(panel: DataFrame, feed: DataFrame, value: str, observed: str, lag: int = CROSS_LAG, tolerance: float = CROSS_TOLERANCE, order: str | None = None) -> DataFrame:
    """Left join on fund and the exact day lag days later, with diff_pct and agrees, which is NULL
    without an observation. Of a feed's rows for one day the last by order counts, so no row doubles."""
    last = F.max_by(F.col(observed), F.col(order) if order else F.col(observed))
    feed = feed.where(F.col(observed).isNotNull()).groupBy("fund_code", F.date_sub("day", lag).alias("period_end")).agg(last.alias(observed))
    got = panel.join(feed, ["fund_code", "period_end"], "left")
    diff = (F.col(value) - F.col(observed)) / F.nullif(F.col(observed).cast("double"), F.lit(0.0)) * 100
    return got.withColumn("diff_pct", diff).withColumn("agrees", F.abs("diff_pct") <= tolerance)


#: What a rollup takes from the first row, from the last, adds up, compounds, and carries as an attribute.
FIRSTS, LASTS = ("nav_begin", "nav_per_unit_begin"), ("nav_end", "nav_per_unit_end")
SUMS = ("subscriptions", "redemptions", "net_flow", "chg_investment", "chg_distribution", "period_days")
COMPOUNDED = ("gross_return", "market_return")
ATTRIBUTES = ("deposit_rate_pct", "deposit_rate_provenance", "asset_class", "fund_name", "manager_id")


def roll_up(panel: DataFrame, key: Column, name: str = "month", zero_sums: bool = False) -> DataFrame:
    """One row per fund and key: first opening, last closing, sums, compounded returns, the last
    attributes, the residual, and the flow rates again. Columns that are not there are left out.

    Sums stay NULL when all their terms are; zero_sums makes them 0.
    """
    there = lambda cs: [c for c in cs if c in panel.columns]
    seen = lambda c, pick: pick(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.struct("period_end", "period_start"))).alias(c)
    sums = there(SUMS)
    got = panel.withColumn(name, key).groupBy("fund_code", name).agg(
        F.min("period_start").alias("period_start"), F.max("period_end").alias("period_end"), F.count("*").alias("n_periods"),
        *[seen(c, F.min_by) for c in there(FIRSTS)], *[seen(c, F.max_by) for c in there((*LASTS, *ATTRIBUTES))],
        *[(F.coalesce(F.sum(c), F.lit(0)) if zero_sums else F.sum(c)).alias(c) for c in sums],
        *[(F.product(1 + F.col(c)) - 1).alias(c) for c in there(COMPOUNDED)],
    )
    parts = [F.coalesce(c, F.lit(0)) for c in ("net_flow", "chg_investment", "chg_distribution") if c in sums]
    got = got.withColumn("residual", F.col("nav_end") - sum(parts, F.col("nav_begin")))
    if "market_return" in got.columns and "gross_return" in got.columns:
        got = got.withColumn("excess_return", F.col("gross_return") - F.col("market_return"))
    return with_flow_measures(got)


def to_monthly(panel: DataFrame, zero_sums: bool = False) -> DataFrame:
    """The panel by fund and the month of the period's end, yyyy-MM."""
    return roll_up(panel.drop("month"), F.date_format("period_end", "yyyy-MM"), "month", zero_sums)


def merge_sources(sources: list[DataFrame], key: str = "month") -> DataFrame:
    """Union by priority: the first source that has a key wins."""
    every = sources[0].withColumn("_p", F.lit(0))
    for i, s in enumerate(sources[1:], 1):
        every = every.unionByName(s.withColumn("_p", F.lit(i)), allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_p")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_p", "_r")


def bridge(observed: DataFrame, first: str, last: str, limit: int = MAX_BRIDGE_MONTHS) -> DataFrame:
    """month, rate, observed, provenance and every further column of observed, on the full spine
    of months: a gap is filled only between two equal rates that stand no further apart than the
    limit, and takes the further columns of the rate before. A provenance of observed is kept."""
    spark = observed.sparkSession
    more = [c for c in observed.columns if c not in ("month", "rate", "provenance", "observed")]
    spine = spark.range(1).select(F.explode(F.expr(f"sequence(date'{first}', date'{last}', interval 1 month)")).alias("month"))
    said = F.col("provenance") if "provenance" in observed.columns else F.lit("observed")
    # what was seen outside the spine still brackets its gaps
    at = spine.withColumn("inside", F.lit(True)).join(observed.withColumn("said", said).select("month", "rate", "said", *more), "month", "full")
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy("month").rowsBetween(1, Window.unboundedFollowing)
    seen = F.when(F.col("rate").isNotNull(), F.struct("month", "rate", *more))
    at = at.withColumns({"p": F.last(seen, True).over(before), "n": F.first(seen, True).over(after)}).where("inside")
    span = F.months_between("n.month", "p.month")
    month = lambda c: F.date_format(c, "yyyy-MM")
    bridged = (F.col("p.rate") == F.col("n.rate")) & (span <= limit)
    told = (
        F.when(F.col("rate").isNotNull(), F.coalesce("said", F.lit("observed"))).when(F.col("p").isNull(), "no earlier rate").when(F.col("n").isNull(), F.concat(F.lit("no later rate than "), month("p.month")))
        .when(F.col("p.rate") != F.col("n.rate"), F.concat(F.lit("rate changed between "), month("p.month"), F.lit(" and "), month("n.month")))
        .when(span > limit, F.concat(month("p.month"), F.lit(" and "), month("n.month"), F.lit(f" agree but are more than {limit} months apart")))
        .otherwise(F.concat(F.lit("bridged between "), month("p.month"), F.lit(" and "), month("n.month")))
    )
    taken = lambda c: F.when(F.col("rate").isNotNull(), F.col(c)).when(bridged, F.col(f"p.{c}")).alias(c)
    return at.select("month", taken("rate"), F.col("rate").isNotNull().alias("observed"), told.alias("provenance"), *[taken(c) for c in more])
