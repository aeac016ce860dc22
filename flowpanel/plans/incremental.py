"""A panel brought up to date from what changed among its filings, without building it again.

A filing touches the rows of its fund and opening day (restatements and overlaps are judged
there), the month rows of the periods that come, go or change there, and its fund's breaks. Only these
are worked out again; all other rows stay as they are.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import gates, panel
from ..operators.tables import settled
from . import build

#: What is judged together: republished and longer filings of one fund and opening day.
GROUP = ["fund_code", "period_start"]
MONTH = ["fund_code", "month"]


class State(NamedTuple):
    """The filings that a panel was built from and what was built; months is its monthly rollup."""

    filings: DataFrame
    result: build.PanelResult
    months: DataFrame


def full(filings: DataFrame, funds: DataFrame | None = None) -> State:
    result = build.build(filings, funds)
    return State(filings, result, panel.to_monthly(result.panel))


def content_hash(df: DataFrame) -> Column:
    """A digest of a whole row: equal rows have equal ones, whatever the columns' order."""
    return F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256)


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """Filings that came, went or changed, as the groups they touch: GROUP, each once.

    Rows are compared by digest and number, so a filing that stands twice and is withdrawn once
    counts, too."""
    counted = lambda df, sign: df.select(*GROUP, content_hash(df).alias("_hash"), F.lit(sign).alias("_n"))
    both = counted(before, -1).unionByName(counted(after, 1)).groupBy(*GROUP, "_hash").agg(F.sum("_n").alias("_n"))
    return both.where("_n <> 0").select(*GROUP).distinct()


def _join(df: DataFrame, keys: DataFrame, by: list[str], how: str) -> DataFrame:
    """A semi or anti join on keys that may be NULL."""
    other = keys.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate(by)])
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return df.join(other, same, how)


def update(state: State, filings: DataFrame, funds: DataFrame | None = None) -> State:
    """The state of these filings from that of the filings before: equal to ``full`` of them, but
    worked out for the touched groups, months and funds alone."""
    groups = settled(changed(state.filings, filings))
    part = build.build(_join(filings, groups, GROUP, "left_semi"), funds)
    swap = lambda old, new: _join(old, groups, GROUP, "left_anti").unionByName(new, allowMissingColumns=True)
    now = swap(state.result.panel, part.panel)
    # months in which a row of a touched group stood or stands
    month = F.date_format("period_end", "yyyy-MM").alias("month")
    touched = _join(state.result.panel, groups, GROUP, "left_semi").select("fund_code", month).unionByName(part.panel.select("fund_code", month)).distinct()
    touched = settled(touched)
    again = _join(now.drop("month").withColumn("month", month), touched, MONTH, "left_semi")
    months = _join(state.months, touched, MONTH, "left_anti").unionByName(panel.to_monthly(again), allowMissingColumns=True)
    # a break lies between two neighbours, so a touched fund's are sought again
    funds_touched = groups.select("fund_code").distinct()
    checks = gates.continuity(_join(now, funds_touched, ["fund_code"], "left_semi")).where("not passed")
    breaks = _join(state.result.continuity_breaks, funds_touched, ["fund_code"], "left_anti").unionByName(checks)
    result = build.PanelResult(now, swap(state.result.superseded, part.superseded), swap(state.result.quarantine, part.quarantine), breaks, swap(state.result.diagnostics, part.diagnostics))
    return State(filings, result, months)
