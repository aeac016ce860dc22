"""The risk, its gradient, the fit on tables against the fit on lists, and the score by hand."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowpanel.llm import toxicity

rng = random.Random(4)
CLEAN = [f"{a}{b}" for a in ("sun", "tree", "rain", "stone", "river") for b in ("light", "top", "fall", "side", "bed")]
BAD = ["vile", "filth", "scumbag", "loathsome"]


def logistic(z, y):
    return np.log1p(np.exp(-y * z))


@pytest.mark.parametrize("shift", [-2.0, 0.5, 6.0])
def test_risk_is_the_corrected_one_and_steps_go_down_its_gradient(shift):
    """By the definition, one row at a time, and by finite differences of the part that a step goes down."""
    r = np.random.default_rng(1)
    x_p, x_u = r.integers(0, 2, (30, 6)).astype(float), r.integers(0, 2, (50, 6)).astype(float)
    w, prior = r.normal(size=6), 0.3
    parts = lambda w, b: (prior * np.mean([logistic(x @ w + b, 1) for x in x_p]), np.mean([logistic(x @ w + b, -1) for x in x_u]) - prior * np.mean([logistic(x @ w + b, -1) for x in x_p]))
    # the second data set makes the negative part fall below zero
    for mix in (x_u, np.zeros_like(x_u)):
        x_u = mix
        positive, negative = parts(w, shift)
        value, grad = toxicity.risk(w, shift, x_p, x_u, prior)
        assert value == pytest.approx(positive + max(0.0, negative))
        down = (lambda w, b: sum(parts(w, b))) if negative >= 0 else (lambda w, b: -parts(w, b)[1])
        eps = 1e-6
        for k in range(7):
            step = np.eye(7)[k] * eps
            slope = (down(w + step[:6], shift + step[6]) - down(w - step[:6], shift - step[6])) / (2 * eps)
            assert grad[k] == pytest.approx(slope, abs=1e-6)


def test_both_branches_are_met():
    x_p, none = np.ones((10, 1)), np.zeros((10, 1))
    assert toxicity.risk(np.array([5.0]), -5.0, x_p, none, 0.9)[0] == pytest.approx(0.9 * np.log1p(np.exp(0.0)))


def texts(n):
    rows = []
    for i in range(n):
        words = [rng.choice(CLEAN) for _ in range(rng.randint(3, 30))]
        bad = i % 5 == 0
        if bad:
            words += rng.sample(BAD, 2)
        rng.shuffle(words)
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_fit_on_tables_is_the_fit_on_lists(spark):
    rows = texts(700)
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(900, None, "x"), (901, "", "x")], "doc_id long, text string, held string").repartition(5)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i < 500], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    in_fold = lambda i: zlib.crc32(str(i).encode()) % 3 != 1
    positive = [t for i, t, y in rows if i < 500 and y and in_fold(i)]
    unlabelled = [t for i, t, _ in [*rows, (900, "", 0), (901, "", 0)] if in_fold(i)]
    seen = [y for i, _, y in rows if i < 500 and in_fold(i)]
    want = toxicity.train(positive, unlabelled, sum(seen) / len(seen))
    assert model.weights == want.weights and model.bias == want.bias and set(BAD) & set(model.weights)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    for i, t, y in [*rows, (900, None, 0)]:
        z = model.bias + sum(model.weights.get(f, 0.0) for f in toxicity.features(t))
        assert got[i] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
        assert (got[i] >= toxicity.THRESHOLD) == bool(y)


def test_one_very_long_text_stays_in_its_task(spark):
    """A sampled text of many megabytes and of 200,000 different words: only picked features leave the task."""
    rows = texts(60)
    long = " ".join(f"w{chr(97 + i % 26)}{'abcdefghij'[i // 26 % 10]}{'klmnopqrst'[i // 260 % 10]}{'uvwxyzabcd'[i // 2600 % 10]}q" for i in range(26000)) + " vile filth " + "sunlight " * 500_000
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").unionByName(spark.createDataFrame([(1000, long)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(1000, 1)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(model.weights) <= toxicity.FEATURES
    assert toxicity.score(docs, model).where(F.col("doc_id") == 1000).first()["score"] > 0
