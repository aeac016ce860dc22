"""From filings to an audited panel: every filing ends in exactly one of the results."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import gates, panel
from ..sources.readers import FIELDS


class PanelResult(NamedTuple):
    panel: DataFrame
    superseded: DataFrame
    quarantine: DataFrame
    continuity_breaks: DataFrame
    diagnostics: DataFrame


#: The values by which republished filings are compared.
VALUES = list(FIELDS.values())


def filing_rows(parsed: DataFrame) -> DataFrame:
    """Parsed filings with the net flow, units, return, days and foreign share."""
    return gates.with_unit_measures(gates.with_net_flow(parsed))


def build(filings: DataFrame, funds: DataFrame | None = None) -> PanelResult:
    """Dedupe, overlaps, gate, measures, metadata; breaks are sought among accepted rows only."""
    kept, gone = panel.dedupe(filings, [v for v in VALUES if v in filings.columns])
    kept, longer = panel.overlaps(kept)
    gated = gates.gate(gates.with_net_flow(kept))
    if "nav_per_unit_begin" in gated.columns:
        gated = gates.with_unit_measures(gated)
    accepted = gates.with_flow_measures(gated.where("quarantine_reason = ''").drop("quarantine_reason"))
    if funds is not None:
        accepted = panel.with_metadata(accepted, funds)
    checks = gates.continuity(accepted)
    # every filing that stands is diagnosed, also those in quarantine
    diagnostics = gates.with_proxies(gated) if "nav_per_unit_begin" in gated.columns else gated
    return PanelResult(accepted, gone.unionByName(longer, allowMissingColumns=True), gated.where("quarantine_reason <> ''"), checks.where("not passed"), diagnostics)


def audit(result: PanelResult, failures: DataFrame | None = None) -> DataFrame:
    """Row counts of the disjoint results, and of the documents that did not parse."""
    one = lambda name, df: df.agg(F.lit(name).alias("part"), F.count("*").alias("n"))
    got = one("panel", result.panel).unionByName(one("quarantine", result.quarantine)).unionByName(one("superseded", result.superseded))
    return got if failures is None else got.unionByName(one("failures", failures))


#: Verdicts of ``accounting`` on a reference that does not stand in exactly one part.
NOWHERE, TWICE, STRANGER = "in no part", "in several parts", "no reference"


def accounting(refs: DataFrame, parts: dict[str, DataFrame], key: str = "source") -> DataFrame:
    """One row per reference: key, how often each part holds it, and verdict, which is empty where
    exactly one part holds it once.

    References and parts are united and counted once by key, so what no part holds, what several
    hold, what one holds twice and what no reference names are all rows of the result.
    """
    names = list(parts)
    every = refs.select(key, F.lit("").alias("_part"))
    for name, part in parts.items():
        every = every.unionByName(part.select(key, F.lit(name).alias("_part")))
    n = lambda name: F.count_if(F.col("_part") == name)
    got = every.groupBy(key).agg(n("").alias("_refs"), *[n(name).alias(name) for name in names])
    held = sum([F.col(name) for name in names], F.lit(0))
    within = F.concat_ws(", ", *[F.when(F.col(name) > 0, F.concat(F.lit(name), F.when(F.col(name) > 1, F.concat(F.lit(" x "), F.col(name).cast("string"))).otherwise(""))) for name in names])
    verdict = F.when(F.col("_refs") == 0, F.concat(F.lit(f"{STRANGER}: "), within)).when(held == 0, NOWHERE).when(held > 1, F.concat(F.lit(f"{TWICE}: "), within)).otherwise("")
    return got.select(key, *names, verdict.alias("verdict"))


def accounted(result: PanelResult, failures: DataFrame | None = None, unavailable: DataFrame | None = None) -> dict[str, DataFrame]:
    """The parts of a run among which each reference must stand once."""
    parts = {"panel": result.panel, "quarantine": result.quarantine, "superseded": result.superseded}
    more = {"failures": failures, "unavailable": unavailable}
    return parts | {k: v for k, v in more.items() if v is not None}


def violations(accounts: DataFrame) -> DataFrame:
    return accounts.where("verdict <> ''")


def totals(accounts: DataFrame) -> DataFrame:
    """part, n: references by the part that holds them; the sum over the parts and violations is that of all references."""
    names = [c for c in accounts.columns[1:] if c != "verdict"]
    one = F.when(F.col("verdict") != "", "violation").otherwise(F.coalesce(*[F.when(F.col(c) > 0, F.lit(c)) for c in names]))
    return accounts.groupBy(one.alias("part")).agg(F.count("*").alias("n"))
