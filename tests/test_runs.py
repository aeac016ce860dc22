"""Accounting by reference, outputs that stand together, rebuilds and late filings against the whole."""

import datetime as dt
import glob
import random

import pytest
from pyspark.sql import functions as F

from flowpanel.plans import build, incremental, run
from flowpanel.sources import sinks
from flowpanel.streaming import late

D = dt.date
SCHEMA = "fund_code string, period_start date, period_end date, nav_begin double, nav_end double, chg_investment double, subscriptions double, redemptions double, chg_flows_net double, chg_distribution double, source string"


def row(fund, start, end, source="f_1", begin=1e11, subs=5e8, off=0.0):
    return (fund, start, end, begin, begin + 1e8 + subs - 2e8 + off, 1e8, subs, -2e8, None, None, source)


def rows_of(df, drop=()):
    return sorted(tuple(str(r[c]) for c in sorted(df.columns) if c not in drop) for r in df.collect())


def test_every_reference_stands_once(spark):
    one = lambda *names: spark.createDataFrame([(n,) for n in names] or [], "source string")
    refs = one("a", "b", "c", "d", "e")
    got = build.accounting(refs, {"panel": one("a", "b", "x", "d"), "quarantine": one("b"), "failures": one("c", "c")})
    assert {r["source"]: r["verdict"] for r in build.violations(got).collect()} == {"b": "in several parts: panel, quarantine", "c": "in several parts: failures x 2", "e": "in no part", "x": "no reference: panel"}
    assert {r["part"]: r["n"] for r in build.totals(got).collect()} == {"panel": 2, "violation": 4}
    assert build.accounting(one(), {"panel": one()}).count() == 0


def test_a_run_accounts_for_its_filings(spark):
    rows = [row("A", D(2023, 1, 2), D(2023, 1, 8)), row("A", D(2023, 1, 2), D(2023, 1, 8), "f_2"), row("B", D(2023, 1, 2), D(2023, 1, 8), "f_3", off=1e9)]
    result = build.build(spark.createDataFrame(rows, SCHEMA))
    refs = spark.createDataFrame([(f"f_{k}",) for k in range(1, 6)], "source string")
    accounts = build.accounting(refs, build.accounted(result, refs.where("source = 'f_4'"), refs.where("source = 'f_5'")))
    assert build.violations(accounts).count() == 0
    assert {r["part"]: r["n"] for r in build.totals(accounts).collect()} == {"panel": 1, "superseded": 1, "quarantine": 1, "failures": 1, "unavailable": 1}


def test_outputs_are_sorted_over_their_files(spark, tmp_path):
    df = spark.range(4000).select((F.col("id") * 7919 % 13).cast("string").alias("fund_code"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") * 31 % 900).cast("int")).alias("period_end"), "id").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small data would be one file
    try:
        paths = sinks.write_outputs({"fund_period": df}, str(tmp_path), "parquet", run.ORDER)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = sorted(glob.glob(f"{paths['fund_period']}/part-*"))
    assert len(files) > 1
    read = [(r["fund_code"], r["period_end"]) for f in files for r in spark.read.parquet(f).collect()]
    assert len(read) == 4000 and read == sorted(read)


def test_a_broken_write_leaves_the_former_outputs(spark, tmp_path):
    folder = str(tmp_path)
    assert sinks.outputs(spark, folder) == {}
    one = lambda k: {"a": spark.range(k), "b": spark.range(2 * k)}
    sinks.write_outputs(one(1), folder, "parquet")
    boom = spark.range(3).select(F.raise_error(F.lit("boom")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        sinks.write_outputs({"a": spark.range(9), "b": boom}, folder, "parquet")
    seen = lambda: {n: spark.read.parquet(p).count() for n, p in sinks.outputs(spark, folder).items()}
    assert seen() == {"a": 1, "b": 2}
    for k in (4, 5):
        assert sinks.write_outputs(one(k), folder, "parquet") == sinks.outputs(spark, folder)
        assert seen() == {"a": k, "b": 2 * k}


def week(k):
    return D(2023, 1, 2) + dt.timedelta(days=7 * k), D(2023, 1, 8) + dt.timedelta(days=7 * k)


def same_state(a, b):
    for name in ("panel", "superseded", "quarantine", "continuity_breaks", "diagnostics"):
        assert rows_of(getattr(a.result, name)) == rows_of(getattr(b.result, name)), name
    assert rows_of(a.months) == rows_of(b.months)


def test_update_equals_a_full_rebuild(spark):
    filings = [row(f, *week(k), begin=1e11 + 3e8 * k) for f in "ABC" for k in range(14)] + [row(None, *week(1)), row("D", D(2023, 1, 2), None, "f_9"), row("D", None, None, "f_8")]
    changes = [
        [row("A", *week(14)), row("E", *week(0))],  # inserts
        [row("A", *week(3), "f_2", subs=6e8), row("B", *week(4), "f_2"), row("B", D(2023, 1, 30), D(2023, 2, 7), "f_4")],  # a restatement, a copy, a longer period
        [row("C", *week(5), "f_2", off=1e9), row("D", D(2023, 1, 2), None, "f_10"), row("A", *week(3), "f_0")],  # to quarantine, undated, late
    ]
    state = incremental.full(spark.createDataFrame(filings, SCHEMA))
    for more in changes:
        filings = filings + more
        state = incremental.update(state, spark.createDataFrame(filings, SCHEMA))
        same_state(state, incremental.full(spark.createDataFrame(filings, SCHEMA)))
    gone = [r for k, r in enumerate(filings) if k not in (2, 16, len(filings) - 3)]  # withdrawals, one of what superseded another
    changed = [(*r[:-2], -1.0, r[-1]) if r[0] == "C" and r[1] == week(7)[0] else r for r in gone]
    state = incremental.update(state, spark.createDataFrame(changed, SCHEMA))
    same_state(state, incremental.full(spark.createDataFrame(changed, SCHEMA)))


def test_only_touched_groups_are_worked_out_again(spark):
    before = spark.createDataFrame([row(f, *week(k)) for f in "ABC" for k in range(6)], SCHEMA)
    after = before.where(~((F.col("fund_code") == "A") & (F.col("period_start") == week(2)[0]))).unionByName(spark.createDataFrame([row("B", *week(5), "f_2")], SCHEMA))
    assert sorted((r["fund_code"], r["period_start"]) for r in incremental.changed(before, after).collect()) == [("A", week(2)[0]), ("B", week(5)[0])]
    assert incremental.changed(before, before.repartition(3)).count() == 0
    assert incremental.changed(before, before.unionByName(before.limit(1))).count() == 1


def test_late_filings_in_any_order(spark, tmp_path):
    rng = random.Random(2)
    schema = spark.createDataFrame([], SCHEMA).schema
    filings = [row(f, *week(k), f"f_{n}", subs=rng.choice([5e8, 6e8])) for f in "AB" for k in range(3) for n in range(rng.randint(1, 4))] + [row("C", D(2023, 1, 2), None, "f_7"), row("C", D(2023, 1, 2), None, "f_8"), row("C", None, None, "f_1")]
    rng.shuffle(filings)
    values = build.VALUES
    for n, part in enumerate((filings[:6], filings[6:9], filings[9:])):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query = late.follow(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "check"), values)
        query.awaitTermination()
        # a later batch reads its own files alone
        assert sum(p["numInputRows"] for p in query.recentProgress) == len(part)
        whole = spark.createDataFrame(filings[: (6, 9, len(filings))[n]], SCHEMA)
        kept, gone = build.panel.dedupe(whole, [v for v in values if v in whole.columns])
        want = kept.withColumns({"status": F.lit("kept"), "superseded_by": F.lit(None).cast("string"), "reason": F.lit(None).cast("string")}).unionByName(gone.withColumn("status", F.lit("superseded")))
        assert rows_of(late.last_words(spark, str(tmp_path / "out"))) == rows_of(want)
