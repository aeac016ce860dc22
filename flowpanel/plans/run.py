"""The stages of a run: documents to filings and failures, to the audited panel, to estimates."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession

from ..operators import gates, panel, stats
from ..sources import readers, sinks
from . import build


class Parsed(NamedTuple):
    filings: DataFrame
    failures: DataFrame
    result: build.PanelResult


def parse_and_build(files: DataFrame, funds: DataFrame | None = None, glyphs: Callable[[DataFrame], DataFrame] | None = None) -> Parsed:
    """Files (path, content, fund_code, source) to filings, failures and the panel's parts. A
    document that does not parse is an exclusion that is written down like any other."""
    filings, failures = readers.split_failures(readers.parse_files(files, glyphs))
    rows = build.filing_rows(filings)
    return Parsed(rows, failures, build.build(rows, funds))


#: How the outputs are sorted.
ORDER = {name: ["fund_code", "period_end", "period_start", "source"] for name in ("fund_period", "fund_month", "quarantine", "superseded", "continuity_breaks", "diagnostics", "cross_check", "parse_failures")}


def write_panel(parsed: Parsed, folder: str, index: DataFrame, rates: DataFrame | None = None, feed: DataFrame | None = None, form: str = "csv") -> dict[str, str]:
    """All outputs, each in a folder of its own: the panel by period and by month with the macro
    series, the audit's parts, diagnostics, failures and, with a feed, the cross-check. Sorted by
    fund and period, and visible together or not at all."""
    full = panel.with_macro(parsed.result.panel, index, rates)
    out = {
        "fund_period": full, "fund_month": panel.to_monthly(full), "quarantine": parsed.result.quarantine, "superseded": parsed.result.superseded,
        "continuity_breaks": parsed.result.continuity_breaks, "diagnostics": parsed.result.diagnostics, "parse_failures": parsed.failures,
    }
    if feed is not None:
        checked = panel.exact_crosscheck(full, feed, "nav_per_unit_end", "nav_per_unit")
        out["cross_check"] = checked.select("fund_code", "period_end", "nav_per_unit_end", "nav_per_unit", "diff_pct", "agrees")
    return sinks.write_outputs(out, folder, form, ORDER)


def report(spark: SparkSession, parsed: Parsed) -> str:
    checks = gates.checks(parsed.filings).unionByName(gates.continuity(parsed.filings).withColumn("residual", gates.F.col("residual").cast("double")))
    return sinks.panel_report(spark, checks, build.audit(parsed.result, parsed.failures))


class Analysis(NamedTuple):
    record: dict
    table: DataFrame
    fits: list[stats.Fit]
    netting: DataFrame


def analyse(full: DataFrame, widths: tuple[int, ...] = (1, 4, 12)) -> Analysis:
    """The sample, the table by past performance, the paired specifications and what netting
    hides. widths: (1, 4, 12) for weeks, (1, 3, 6) for months; past performance is the second."""
    sample, record = stats.prepare_sample(full)
    sample = stats.add_lagged_performance(sample, widths=widths)
    performance = f"ret_lag1_{widths[1]}"
    return Analysis(record, stats.quantile_table(sample, performance), stats.paired_specifications(sample, performance), stats.netting_loss(sample))
