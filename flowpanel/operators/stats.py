"""Samples, lags, ranks, bins and least squares; only small matrices reach the driver."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tables import placed, settled

INCEPTION, WINSOR = 4, 0.01
BREAKS = (0.2, 0.8)


def after_inception(df: DataFrame, periods: int = INCEPTION, by: str = "fund_code", order: str = "period_end") -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("_n") > periods).drop("_n")


def clip(x: Column, low: Column, high: Column) -> Column:
    """least and greatest skip NULLs, so NULL is guarded."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, low), high))


#: Size of a quantile sketch, and how many times its error a bracket reaches to either side.
SKETCH, MARGIN = 4096, 3.0


def _brackets(df: DataFrame, xs: dict[str, Column], shares: list[float]) -> tuple[dict, dict]:
    """One pass: values of each column, and between which values each share's quantile must lie
    by a mergeable sketch (its error is a small share of the rows, but not certain)."""
    error = MARGIN * 2.296 / SKETCH**0.9021  # the sketch's published bound for one quantile
    near = sorted({min(1.0, max(0.0, q + d)) for q in shares for d in (-error, error)})
    sketch = {c: F.kll_sketch_agg_double(x, F.lit(SKETCH)) for c, x in xs.items()}
    got = df.agg(*[e.alias(f"{c}:{k}") for c, x in xs.items() for k, e in (("n", F.count(x)), ("lo", F.min(x)), ("hi", F.max(x)), ("s", sketch[c]))])
    got = got.select("*", *[F.when(F.col(f"`{c}:n`") > 0, F.kll_sketch_get_quantile_double(f"`{c}:s`", F.array(*map(F.lit, near)))).alias(f"{c}:q") for c in xs]).drop(*[f"{c}:s" for c in xs])
    row = got.collect()[0]
    sides = {}
    for c in xs:
        if row[f"{c}:n"]:
            at = dict(zip(near, row[f"{c}:q"]))
            for q in shares:
                low, high = q - error, q + error
                sides[c, q] = (at[low] if low > 0 else row[f"{c}:lo"], at[high] if high < 1 else row[f"{c}:hi"])
    return {c: (row[f"{c}:n"], row[f"{c}:lo"], row[f"{c}:hi"]) for c in xs}, sides


def exact_quantiles(df: DataFrame, columns: list[str], shares: list[float]) -> dict[str, list[float | None]]:
    """Interpolated quantiles of each column, exact at any size, in two passes over df for all
    columns and shares.

    The first pass brackets the order statistics by sketches. The second counts the values
    inside each bracket, and the rows on its farther side, which say where the bracket
    stands; the values are then placed over ranges. If a bracket missed (a sketch may err),
    it alone is looked for again, between the least and the greatest value.
    """
    xs = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    size, sides = _brackets(df, xs, shares)
    out: dict[tuple[str, float], float] = {}
    open_ = list(sides)
    while open_:
        entries = []
        for k, (c, q) in enumerate(open_):
            low, high = sides[c, q]
            beside = xs[c] < low if q < 0.5 else xs[c] > high
            entries.append(F.when(xs[c].between(low, high), F.struct(F.lit(k).alias("k"), xs[c].alias("v"))).when(beside, F.struct(F.lit(k).alias("k"), F.lit(None).cast("double").alias("v"))))
        counts = df.select(F.explode(F.array_compact(F.array(*entries))).alias("e")).groupBy("e.k", "e.v").agg(F.count("*").alias("n"))
        counts = settled(counts)
        beside = {r["k"]: r["n"] for r in counts.where("v is null").collect()}
        inside = {r["k"]: r["n"] for r in counts.where("v is not null").groupBy("k").agg(F.sum("n").alias("n")).collect()}
        below, wanted = {}, F.lit(False)
        for k, (c, q) in enumerate(open_):
            n = size[c][0]
            below[k] = beside.get(k, 0) if q < 0.5 else n - beside.get(k, 0) - inside.get(k, 0)
            spot = (n - 1) * q
            for at in {math.floor(spot), math.ceil(spot)}:
                here = F.col("_below") + below[k]
                wanted = wanted | ((F.col("k") == k) & (here <= at) & (here + F.col("n") > at))
        found: dict[int, list] = {}
        for r in placed(counts.where("v is not null"), ["k"], "v").where(wanted).collect():
            found.setdefault(r["k"], []).append((r["_below"] + below[r["k"]], r["n"], r["v"]))
        missed = []
        for k, (c, q) in enumerate(open_):
            spot = (size[c][0] - 1) * q
            at = [next((v for b, n, v in found.get(k, []) if b <= p < b + n), None) for p in (math.floor(spot), math.ceil(spot))]
            if None in at:
                sides[c, q] = size[c][1:]
                missed.append((c, q))
            else:
                out[c, q] = at[0] + (at[1] - at[0]) * (spot - math.floor(spot))
        open_ = missed
    return {c: [out.get((c, q)) for q in shares] for c in columns}


LEGS = ("gross_subscription_rate", "gross_redemption_rate")
FLOWS = ("net_flow_rate", *LEGS)


def winsorize(df: DataFrame, columns: list[str], share: float = WINSOR) -> DataFrame:
    """Clipped at pooled exact quantiles; then net is rebuilt from its legs."""
    bounds = exact_quantiles(df, columns, [share, 1 - share])
    return _clipped(df, bounds)


def _clipped(df: DataFrame, bounds: dict[str, list[float | None]]) -> DataFrame:
    out = df.withColumns({c: clip(F.col(c), F.lit(lo), F.lit(hi)) for c, (lo, hi) in bounds.items() if lo is not None})
    if "net_flow_rate" in bounds and all(x in bounds for x in LEGS):
        s, r = (F.col(x) for x in LEGS)
        out = out.withColumn("net_flow_rate", F.when(s.isNotNull() & r.isNotNull(), s - r).otherwise(F.col("net_flow_rate")))
    return out


def prepare_sample(df: DataFrame, inception: int = INCEPTION, share: float | None = WINSOR, order: str = "period_end") -> tuple[DataFrame, dict]:
    """The sample without each fund's first periods, winsorized, and a record of what that did:
    rows in, dropped and out, funds affected, values clipped, net flows rebuilt."""
    n = F.row_number().over(Window.partitionBy("fund_code").orderBy(F.asc_nulls_first(order)))
    ranked = df.withColumn("_n", n)
    record: dict = {}
    early = F.col("_n") <= inception
    got = ranked.agg(F.count("*").alias("n_input"), F.count_if(early).alias("n_dropped_inception"), F.countDistinct(F.when(early, F.col("fund_code"))).alias("funds_affected")).collect()[0]
    record |= got.asDict() | {"inception_periods": inception}
    sample = ranked.where(~early).drop("_n")
    if share:
        measures = [c for c in (*FLOWS, "churn_rate") if c in df.columns]
        bounds = exact_quantiles(sample, measures, [share, 1 - share])
        outside = [((F.col(c) < lo) | (F.col(c) > hi)).cast("int") for c, (lo, hi) in bounds.items() if lo is not None]
        both = F.lit(True) if all(c in df.columns for c in FLOWS) else F.lit(False)
        for c in LEGS:
            both = both & (F.col(c).isNotNull() if c in df.columns else F.lit(False))
        got = sample.agg(F.coalesce(F.sum(sum([F.coalesce(x, F.lit(0)) for x in outside], F.lit(0))), F.lit(0)).alias("n_values_winsorised"), F.count_if(both).alias("n_net_rebuilt_from_legs")).collect()[0]
        record |= got.asDict() | {"winsor_quantile": share}
        sample = _clipped(sample, bounds)
    return sample, record | {"n_output": record["n_input"] - record["n_dropped_inception"]}


def add_lagged_performance(df: DataFrame, lag: int = 1, widths: tuple[int, ...] = (1, 4, 12), order: str = "period_end") -> DataFrame:
    """ret_lag{lag}_{width}, exc_lag..., log_nav_begin and flow_lag1, as far as their columns are there; one sort by fund."""
    of = [(k, c) for k, c in (("ret", "gross_return"), ("exc", "excess_return")) if c in df.columns]
    out = {f"{k}_lag{lag}_{w}": lagged_sum(c, lag, w, order=order) for k, c in of for w in widths}
    if "nav_begin" in df.columns:
        out["log_nav_begin"] = F.when(F.col("nav_begin") > 0, F.log("nav_begin"))
    if "net_flow_rate" in df.columns:
        out["flow_lag1"] = F.lag("net_flow_rate").over(Window.partitionBy("fund_code").orderBy(order))
    return df.withColumns(out)


def lagged_sum(x: str, lag: int, width: int, by: str = "fund_code", order: str = "period_end") -> Column:
    """Sum of the width rows that end lag rows back; NULL unless all are there."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-(lag + width - 1), -lag)
    return F.when(F.count(x).over(w) == width, F.sum(x).over(w))


def with_average_rank(df: DataFrame, x: str, by: str, out: str) -> DataFrame:
    """df with the column out: the share rank of x in its group, ties averaged; NULLs have none and
    do not count. Values are counted before they are placed, and no task reads a whole group."""
    counts = df.where(F.col(x).isNotNull()).groupBy(by, x).agg(F.count("*").alias("n"))
    at = placed(counts, [by], x).select(F.col(by).alias("_by"), F.col(x).alias("_x"), ((F.col("_below") + (F.col("n") + 1) / 2) / F.col("_total")).alias(out))
    return df.join(at, F.col(by).eqNullSafe(F.col("_by")) & (F.col(x) == F.col("_x")), "left").drop("_by", "_x")


def splines(rank: Column, breaks=BREAKS) -> dict[str, Column]:
    lo, hi = map(F.lit, breaks)
    guard = lambda c: F.when(rank.isNotNull(), c)
    return {"rank_low": guard(F.least(rank, lo)), "rank_mid": guard(F.least(F.greatest(rank - lo, F.lit(0.0)), hi - lo)), "rank_high": guard(F.greatest(rank - hi, F.lit(0.0)))}


def performance_rank_splines(df: DataFrame, performance: str, by: str = "period_end", breaks=BREAKS) -> DataFrame:
    """perf_rank within each period and its three parts."""
    out = with_average_rank(df, performance, by, "perf_rank")
    return out.withColumns(splines(F.col("perf_rank"), breaks))


def quantile_bins(df: DataFrame, x: str, n: int = 5) -> DataFrame:
    """bin (from 1): right-closed intervals between the quantiles, the least value in the first;
    equal edges merge, the outer ones too, so ties stay together and there may be fewer bins."""
    edges = list(dict.fromkeys(e for e in exact_quantiles(df, [x], [i / n for i in range(n + 1)])[x] if e is not None))
    value = F.when(~F.isnan(F.col(x).cast("double")), F.col(x))
    bin_ = sum([(value > e).cast("int") for e in edges[1:-1]], F.lit(1))
    # one value alone makes no interval
    return df.withColumn("bin", F.when(value.isNotNull(), bin_) if len(edges) > 1 else F.lit(None).cast("int"))


def _disclosed(df: DataFrame) -> DataFrame:
    return df.where(F.coalesce("gross_legs_disclosed", F.lit(False))) if "gross_legs_disclosed" in df.columns else df


def quantile_table(df: DataFrame, performance: str, n: int = 5) -> DataFrame:
    """Mean flow rates in percent by bin of past performance, over complete and disclosed rows."""
    sample = _disclosed(df.dropna(subset=[performance, *FLOWS]))
    return quantile_bins(sample, performance, n).where("bin is not null").groupBy("bin").agg(*[F.round(F.avg(c) * 100, 4).alias(f"{c}_pct") for c in FLOWS], F.count("*").alias("n"))


def demean(df: DataFrame, columns: list[str], by: str = "fund_code") -> DataFrame:
    w = Window.partitionBy(by)
    return df.withColumns({c: F.col(c) - F.avg(c).over(w) for c in columns})


def netting_loss(df: DataFrame, quiet: float = 0.001) -> DataFrame:
    """What netting the legs hides, over disclosed rows, in one aggregation; no row without such rows."""
    s, r, n, churn = (F.col(c) for c in (*LEGS, "net_flow_rate", "churn_rate"))
    calm = F.abs(n) < quiet
    got = _disclosed(df.dropna(subset=["net_flow_rate", "churn_rate"])).agg(
        F.count("*").alias("n_obs"), F.lit(quiet).alias("quiet_threshold"), F.count_if(calm).alias("n_quiet_periods"), F.avg(calm.cast("double")).alias("share_quiet"),
        F.avg(F.when(calm, churn)).alias("mean_churn_when_quiet"), F.max(F.when(calm, churn)).alias("max_churn_when_quiet"), F.corr(n, churn).alias("corr_net_churn"),
        F.avg(s).alias("mean_gross_subscription_rate"), F.avg(r).alias("mean_gross_redemption_rate"), F.try_divide(F.stddev_samp(s), F.stddev_samp(r)).alias("sd_ratio_subs_over_reds"),
    )
    return got.where("n_obs > 0")


@dataclass
class Fit:
    """One specification. Standard errors are clustered, or robust to heteroskedasticity."""

    dependent: str
    terms: list[str]
    coef: np.ndarray
    std_err: np.ndarray
    r2: float
    n_obs: int
    n_clusters: int
    n_funds: int = 0
    name: str = ""

    def t_stats(self) -> list[float | None]:
        return [float(b / s) if s > 0 else None for b, s in zip(self.coef, self.std_err)]

    def rows(self) -> list[tuple]:
        """dependent, term, coef, std_err, t, n of each term."""
        return [(self.dependent, t, float(b), float(s), v, self.n_obs) for t, b, s, v in zip(self.terms, self.coef, self.std_err, self.t_stats())]

    def summary(self) -> str:
        head = f"{self.name or self.dependent}: n={self.n_obs}, funds={self.n_funds}, clusters={self.n_clusters}, R2={self.r2:.4f}"
        lines = [f"  {t:<24} {b: .6f}  se {s:.6f}  t {'-' if v is None else f'{v:.2f}'}" for (_, t, b, s, v, _) in self.rows()]
        return "\n".join([head, *lines])


ROWS = "dependent string, term string, coef double, std_err double, t double, n bigint"


def frame(spark: SparkSession, fits: list[Fit]) -> DataFrame:
    """The estimates of some fits, one row per term."""
    return spark.createDataFrame([r for f in fits for r in f.rows()], ROWS)


def compare(spark: SparkSession, fits: list[Fit], term: str) -> DataFrame:
    """One term across specifications."""
    return frame(spark, fits).where(F.col("term") == term).drop("term")


def least_squares(df: DataFrame, dependents: list[str], terms: list[str], cluster: str | None = None, absorb: str | None = None, correct: bool = True, funds: str = "fund_code") -> list[Fit]:
    """Fits of all dependents on one complete sample, in two passes however many they are: X'X and
    all X'y in the first, the scores of all dependents in the second.

    absorb: demeaned away, no constant; else a constant is added. cluster: sums of scores per
    cluster, whose outer products are summed again on the executors; without one the errors are
    robust (HC1, HC0 if not correct).
    """
    need = [*dependents, *terms, *([cluster] if cluster else []), *([absorb] if absorb else [])]
    count = F.countDistinct(funds) if funds in df.columns else F.lit(0)
    df = df.select(*dict.fromkeys([*need, *([funds] if funds in df.columns else [])])).dropna(subset=need)
    names = list(terms)
    if absorb:
        df = demean(df, [*dependents, *terms], absorb)
    else:
        df, names = df.withColumn("const", F.lit(1.0)), ["const", *terms]
    k = len(names)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = df.agg(F.count("*").alias("n"), count.alias("funds"), *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"x{i}_{j}") for i, j in pairs], *[F.sum(F.col(names[i]) * F.col(y)).alias(f"y{d}_{i}") for d, y in enumerate(dependents) for i in range(k)], *[f(y).alias(f"{n}{d}") for d, y in enumerate(dependents) for n, f in (("a", F.sum), ("q", lambda y: F.sum(F.col(y) * F.col(y))))]).collect()[0]
    n = row["n"]
    if n <= k:
        raise ValueError(f"{n} rows for {k} terms")
    xx = np.zeros((k, k))
    for i, j in pairs:
        xx[i, j] = xx[j, i] = row[f"x{i}_{j}"]
    inverse = np.linalg.pinv(xx)
    many = range(len(dependents))
    betas = [inverse @ np.array([row[f"y{d}_{i}"] for i in range(k)]) for d in many]
    left = [F.col(y) - sum([F.lit(float(b)) * F.col(x) for b, x in zip(betas[d], names)], F.lit(0.0)) for d, y in enumerate(dependents)]
    score = df.select(*([cluster] if cluster else []), *[(u * u).alias(f"uu{d}") for d, u in enumerate(left)], *[(F.col(x) * u).alias(f"s{d}_{i}") for d, u in enumerate(left) for i, x in enumerate(names)])
    if cluster:
        score = score.groupBy(cluster).agg(*[F.sum(c).alias(c) for c in score.columns if c != cluster])
    m = score.agg(F.count("*").alias("g"), *[F.sum(f"uu{d}").alias(f"uu{d}") for d in many], *[F.sum(F.col(f"s{d}_{i}") * F.col(f"s{d}_{j}")).alias(f"m{d}_{i}_{j}") for d in many for i, j in pairs]).collect()[0]
    g = m["g"]
    scale = 1.0 if not correct else (g / (g - 1) * (n - 1) / (n - k) if cluster and g > 1 else n / (n - k))
    out = []
    for d, y in enumerate(dependents):
        meat = np.zeros((k, k))
        for i, j in pairs:
            meat[i, j] = meat[j, i] = m[f"m{d}_{i}_{j}"]
        error = np.sqrt(np.clip(np.diag(inverse @ meat @ inverse) * scale, 0, None))
        spread = row[f"q{d}"] - row[f"a{d}"] ** 2 / n
        out.append(Fit(y, names, betas[d], error, 1 - m[f"uu{d}"] / spread if spread else float("nan"), n, g if cluster else n, row["funds"]))
    return out


def _with_cluster(df: DataFrame, cluster: str | None, time: str) -> DataFrame:
    return df.withColumn("month", F.date_format(time, "yyyy-MM")) if cluster == "month" and "month" not in df.columns else df


def flow_performance(df: DataFrame, dependent: str, regressors: list[str], fund_effects: bool = True, cluster: str | None = "month", name: str = "", time: str = "period_end") -> Fit:
    """One specification on its complete rows, fund effects absorbed, errors clustered by month."""
    (fit,) = least_squares(_with_cluster(df, cluster, time), [dependent], regressors, cluster, "fund_code" if fund_effects else None)
    fit.name = name or f"{dependent} ~ {' + '.join(regressors)}"
    return fit


#: Regressors beside past performance, as far as the panel has them.
CONTROLS = ("market_return", "log_nav_begin", "period_days")


def paired_specifications(df: DataFrame, performance: str = "ret_lag1_4", controls: tuple[str, ...] = CONTROLS, fund_effects: bool = True, cluster: str | None = "month", gross_only: bool = True, time: str = "period_end") -> list[Fit]:
    """The same equation on net, subscriptions and redemptions, on one sample, from one pair of passes."""
    sample = _disclosed(df) if gross_only else df
    regressors = [performance, *[c for c in controls if c in df.columns]]
    fits = least_squares(_with_cluster(sample, cluster, time), list(FLOWS), regressors, cluster, "fund_code" if fund_effects else None)
    for f in fits:
        f.name = f"{f.dependent} on {performance}"
    return fits
