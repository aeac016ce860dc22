"""Ranks and quantiles against numpy, and their plans."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowpanel.operators import stats, tables

rng = random.Random(11)


def slow_rank(rows):
    """Average rank over the count of values, by period."""
    out = {}
    for p in {r[1] for r in rows}:
        values = [r[2] for r in rows if r[1] == p and r[2] is not None]
        for i, q, v in rows:
            if q == p:
                out[i] = None if v is None else (sum(x < v for x in values) + (sum(x == v for x in values) + 1) / 2) / len(values)
    return out


def test_average_rank_with_a_hot_period(spark):
    rows = [(i, rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, 0.0, -0.0, 1.5, float(rng.randint(0, 40))])) for i in range(1500)] + [(1500, "alone", 1.0), (1501, "none", None)]
    df = spark.createDataFrame(rows, "id int, period string, x double").repartition(5)
    got = {r["id"]: r["pr"] for r in stats.with_average_rank(df, "x", "period", "pr").collect()}
    assert got == pytest.approx(slow_rank(rows), abs=1e-12)


def test_no_window_over_a_whole_period(spark):
    df = spark.range(100).select((F.col("id") % 2).alias("p"), F.col("id").cast("double").alias("x"))
    text = stats.with_average_rank(df, "x", "p", "pr")._jdf.queryExecution().optimizedPlan().toString()
    over = [line for line in text.split("\n") if "Window [" in line]
    # one window runs inside a range, one over a row per range
    assert len(over) == 3 and all("_part" in line or "_n#" in line for line in over)


def test_placed_counts_every_group(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 1), (None, 1, 2), (None, 7, 3)], "g string, x int, n long")
    got = sorted((str(r["g"]), r["x"], r["_below"], r["_total"]) for r in tables.placed(df, ["g"], "x").collect())
    assert got == [("None", 1, 0, 5), ("None", 7, 2, 5), ("a", 1, 0, 6), ("a", 2, 5, 6)]


@pytest.mark.parametrize("sketch", [4096, 16])
def test_quantiles_of_many_columns(spark, monkeypatch, sketch):
    monkeypatch.setattr(stats, "SKETCH", sketch)
    values = [(rng.gauss(0, 1), float(rng.choice([0, 0, 0, 1, 9])), None if rng.random() < 0.3 else rng.random(), float("nan") if rng.random() < 0.5 else 2.0) for _ in range(4000)]
    df = spark.createDataFrame(values, "a double, b double, c double, d double").repartition(3)
    shares = [0.0, 0.01, 0.2, 0.5, 0.8, 0.99, 1.0]
    got = stats.exact_quantiles(df, ["a", "b", "c", "d"], shares)
    for i, c in enumerate("abcd"):
        have = [v[i] for v in values if v[i] is not None and v[i] == v[i]]
        assert got[c] == pytest.approx(list(np.quantile(have, shares)), abs=1e-12)
    assert stats.exact_quantiles(df.where("a > 99"), ["a"], shares) == {"a": [None] * 7}


def test_quantiles_read_the_input_twice(spark, tmp_path):
    spark.range(5000).select(F.rand(1).alias("a"), F.rand(2).alias("b")).write.parquet(str(tmp_path / "x"))
    reads = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda v: reads.add(1) or v, "double").asNondeterministic()
    df = spark.read.parquet(str(tmp_path / "x")).select(seen("a").alias("a"), "b")
    stats.exact_quantiles(df, ["a", "b"], [0.01, 0.5, 0.99])
    assert reads.value == 2 * 5000
