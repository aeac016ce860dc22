"""Derived measures, accounting gates and the audit log. An absent leg is not a zero leg."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

ABS_TOL, REL_TOL = 5.0, 1e-9
MIN_DAYS, MAX_DAYS = 0, 35

_zero = lambda c: F.coalesce(F.col(c), F.lit(0))


def within(residual: Column, scale: Column, abs_tol: float = ABS_TOL, rel_tol: float = REL_TOL) -> Column:
    return F.abs(residual) <= F.greatest(F.lit(abs_tol), F.lit(rel_tol) * F.abs(scale))


def with_net_flow(df: DataFrame) -> DataFrame:
    """net_flow: the disclosed net line, else the legs' sum, else NULL."""
    legs = F.when(F.col("subscriptions").isNotNull() | F.col("redemptions").isNotNull(), _zero("subscriptions") + _zero("redemptions"))
    return df.withColumn("net_flow", F.coalesce("chg_flows_net", legs) if "chg_flows_net" in df.columns else legs)


def with_unit_measures(df: DataFrame) -> DataFrame:
    """units_begin, units_end, gross_return, period_days and, with the foreign line, its share in percent."""
    ratio = lambda a, b: F.try_divide(F.col(a).cast("double"), F.nullif(F.col(b).cast("double"), F.lit(0.0)))
    out = df.withColumns({
        "units_begin": ratio("nav_begin", "nav_per_unit_begin"),
        "units_end": ratio("nav_end", "nav_per_unit_end"),
        "gross_return": ratio("nav_per_unit_end", "nav_per_unit_begin") - 1,
        "period_days": F.datediff("period_end", "period_start"),
    })
    return out.withColumn("foreign_share_of_nav", ratio("foreign_value", "nav_end") * 100) if "foreign_value" in df.columns else out


def with_flow_measures(df: DataFrame) -> DataFrame:
    """Rates on the beginning value. Legs that are absent beside a net flow are undisclosed, not zero."""
    disclosed = ~(F.col("subscriptions").isNull() & F.col("redemptions").isNull() & (F.coalesce("net_flow", F.lit(0)) != 0))
    base = F.when(F.col("nav_begin") > 0, F.col("nav_begin").cast("double"))
    subs, reds = _zero("subscriptions").cast("double"), F.abs(_zero("redemptions")).cast("double")
    total = subs + reds
    return df.withColumns({
        "gross_legs_disclosed": disclosed,
        "gross_subscription_rate": F.when(disclosed, subs / base),
        "gross_redemption_rate": F.when(disclosed, reds / base),
        "net_flow_rate": F.col("net_flow") / base,
        "churn_rate": F.when(disclosed, total / base),
        "flow_asymmetry": F.when(disclosed & (total > 0), (subs - reds) / F.nullif(total, F.lit(0.0))),
    })


def _has_legs() -> Column:
    return F.col("subscriptions").isNotNull() | F.col("redemptions").isNotNull()


def identity_total() -> Column:
    """The opening value and all changes; the legs, else the disclosed net line, else nothing as the flow."""
    flow = F.when(_has_legs(), _zero("subscriptions") + _zero("redemptions")).otherwise(_zero("chg_flows_net"))
    return F.col("nav_begin") + _zero("chg_investment") + flow + _zero("chg_distribution")


def identity_residual() -> Column:
    return F.col("nav_end") - identity_total()


def net_residual() -> Column:
    """The net line less its legs; 0 where there is nothing to compare."""
    return F.when(F.col("chg_flows_net").isNotNull() & _has_legs(), F.col("chg_flows_net") - (_zero("subscriptions") + _zero("redemptions"))).otherwise(0)


def identity_detail() -> Column:
    """What the check compared, and which lines it took for zero because they are absent."""
    missing = F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in ("nav_begin", "nav_end")])
    absent = lambda *cs: F.concat_ws(", ", *[F.when(F.col(c).isNull(), c) for c in cs])
    zero = F.when(_has_legs(), absent("chg_investment", "chg_distribution", "subscriptions", "redemptions")).otherwise(absent("chg_investment", "chg_distribution", "chg_flows_net"))
    note = F.concat(F.when(zero == "", "").otherwise(F.concat(F.lit(" (absent, taken as 0: "), zero, F.lit(")"))), F.when(_has_legs(), " [flow from legs]").otherwise(" [flow from net line]"))
    told = F.concat(F.lit("nav_end "), F.format_number("nav_end", 0), F.lit(", identity "), F.format_number(identity_total(), 0), F.lit(", residual "), F.format_number(identity_residual(), 2), note)
    return F.when(missing != "", F.concat(F.lit("missing: "), missing)).otherwise(told)


def net_detail() -> Column:
    legs = _zero("subscriptions") + _zero("redemptions")
    told = F.concat(F.lit("net line "), F.format_number("chg_flows_net", 0), F.lit(", legs "), F.format_number(legs, 0), F.lit(", residual "), F.format_number(net_residual(), 2))
    return F.when(F.col("chg_flows_net").isNotNull() & _has_legs(), told).otherwise("nothing to compare")


def _passed(residual: str, scale: str) -> Column:
    return F.coalesce(within(F.col(residual), F.col(scale)), F.lit(False))


def gate(df: DataFrame) -> DataFrame:
    """Residuals of both checks and quarantine_reason, '' for accepted rows; nothing is dropped.

    Each reason begins with a fixed word: identity, net_flow, nav_begin, period_end, period_days.
    A conflict between the two header languages is recorded, but is no reason.
    """
    df = df.withColumns({"identity_residual": identity_residual(), "net_residual": net_residual(), "period_days": F.datediff("period_end", "period_start")})
    told = lambda word, text: F.concat(F.lit(f"{word}: "), text)
    reason = F.concat_ws(
        "; ",
        F.when(~_passed("identity_residual", "nav_end"), told("identity", identity_detail())),
        F.when(~F.coalesce(within(F.col("net_residual"), _zero("chg_flows_net")), F.lit(False)), told("net_flow", net_detail())),
        F.when(F.coalesce(F.col("nav_begin"), F.lit(0)) == 0, "nav_begin: missing or zero, rates undefined"),
        F.when(F.col("period_end").isNull(), "period_end: missing"),
        F.when(~F.col("period_days").between(MIN_DAYS, MAX_DAYS), told("period_days", F.concat(F.col("period_days").cast("string"), F.lit(f" outside [{MIN_DAYS}, {MAX_DAYS}]")))),
    )
    return df.withColumn("quarantine_reason", reason)


def reasons(quarantine_reason: Column) -> Column:
    """The fixed words of the reasons, in order, joined by commas."""
    return F.array_join(F.regexp_extract_all(quarantine_reason, F.lit(r"(?:^|; )(identity|net_flow|nav_begin|period_end|period_days):"), F.lit(1)), ",")


def checks(df: DataFrame) -> DataFrame:
    """The two checks of each filing as rows: fund_code, period_end, check, passed, residual, detail."""
    one = lambda name, ok, residual, detail: F.struct(F.lit(name).alias("check"), ok.alias("passed"), residual.cast("double").alias("residual"), detail.alias("detail"))
    both = F.array(
        one("reconcile", F.coalesce(within(identity_residual(), F.col("nav_end")), F.lit(False)), identity_residual(), identity_detail()),
        one("net_flow", F.coalesce(within(net_residual(), _zero("chg_flows_net")), F.lit(False)), net_residual(), net_detail()),
    )
    return df.select("fund_code", "period_end", F.explode(both).alias("c")).select("fund_code", "period_end", "c.*")


def with_proxies(df: DataFrame) -> DataFrame:
    """Flows guessed from unit counts, beside the disclosed ones: diagnostics, never values."""
    flow = F.col("net_flow").cast("double")
    units = F.when(flow.isNotNull(), F.col("units_end") - F.col("units_begin"))
    end = units * F.col("nav_per_unit_end")
    mid = units * (F.col("nav_per_unit_begin") + F.col("nav_per_unit_end")) / 2
    pct = lambda x: F.try_divide(x - flow, F.nullif(F.abs(flow), F.lit(0.0))) * 100
    return df.withColumns({"delta_units": units, "proxy_end": end, "proxy_mid": mid, "proxy_end_error": end - flow, "proxy_mid_error": mid - flow, "proxy_end_error_pct": pct(end), "proxy_mid_error_pct": pct(mid)})


def continuity(df: DataFrame) -> DataFrame:
    """One check per period but a fund's first: it opens where the one before closed."""
    w = Window.partitionBy("fund_code").orderBy(F.asc_nulls_first("period_end"))
    seen = df.withColumns({"was": F.lag("nav_end").over(w), "was_end": F.lag("period_end").over(w), "first": F.row_number().over(w) == 1})
    residual = F.col("nav_begin") - F.col("was")
    seen = seen.where(~F.col("first"))
    ok = F.coalesce(within(residual, F.col("was")), F.lit(False))
    figures = F.concat(F.lit("opening "), F.format_number("nav_begin", 0), F.lit(", closing before "), F.format_number("was", 0))
    gap = F.concat(figures, F.lit(", gap "), F.format_number(residual, 0), F.lit("; likely a missed filing between "), F.coalesce(F.col("was_end").cast("string"), F.lit("?")), F.lit(" and "), F.coalesce(F.col("period_start").cast("string"), F.lit("?")))
    detail = F.when(residual.isNull(), "cannot chain: nav_begin or nav_end is absent").when(ok, figures).otherwise(gap)
    return seen.select("fund_code", "period_end", F.lit("continuity").alias("check"), ok.alias("passed"), residual.alias("residual"), detail.alias("detail"))


def check_summary(checks: DataFrame, shown: int = 10) -> DataFrame:
    """Per check: total, n_passed, max_residual, failures: the first failures as text, how many more.

    Failures are first cut to the least of each slice of a fund's hash, so what one task orders is
    bounded however many fail.
    """
    line = F.struct(F.col("fund_code").cast("string").alias("fund_code"), "period_end", "detail")
    counts = checks.groupBy("check").agg(F.count("*").alias("total"), F.sum(F.col("passed").cast("bigint")).alias("n_passed"), F.max(F.nanvl(F.abs(F.col("residual").cast("double")), F.lit(None).cast("double"))).alias("max_residual"))
    failed = checks.where("not passed").select("check", line.alias("line"), F.pmod(F.xxhash64("fund_code", "period_end"), F.lit(256)).alias("slice"))
    order = lambda *by: Window.partitionBy("check", *by).orderBy(F.col("line.fund_code").asc_nulls_first(), F.col("line.period_end").asc_nulls_first(), "line.detail")
    for by in (("slice",), ()):
        failed = failed.withColumn("r", F.row_number().over(order(*by))).where(F.col("r") <= shown)
    told = F.transform(F.array_sort(F.collect_list(F.struct("r", "line"))), lambda x: F.concat_ws(" ", x["line"]["fund_code"], x["line"]["period_end"].cast("string"), x["line"]["detail"]))
    got = counts.join(failed.groupBy("check").agg(told.alias("lines")), "check", "left")
    more = F.col("total") - F.col("n_passed") - shown
    lines = F.concat(F.coalesce("lines", F.array().cast("array<string>")), F.when(more > 0, F.array(F.concat(F.lit("and "), more.cast("string"), F.lit(" more")))).otherwise(F.array().cast("array<string>")))
    return got.withColumn("failures", F.array_join(lines, "\n")).drop("lines")


def report(checks: DataFrame, shown: int = 10) -> str:
    """The summary as text for a console: a few rows reach the driver."""
    out = []
    for r in check_summary(checks, shown).orderBy("check").collect():
        out.append(f"{r['check']}: {r['n_passed']}/{r['total']} passed, max abs residual {r['max_residual'] or 0:,.2f}")
        out += [f"  {x}" if x.startswith("and ") else f"  FAIL {x}" for x in r["failures"].split("\n") if x]
    return "\n".join(out) or "no checks run"
