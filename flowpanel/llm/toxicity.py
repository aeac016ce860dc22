"""Operator 4: toxicity by non-negative positive-unlabelled learning.

Positives are documents labelled toxic, the rest of the training texts count as unlabelled,
whatever their label. A linear classifier over the presence of words and word beginnings is
trained with numpy on the non-negative risk estimate

    prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

with the logistic loss; when the second part of a batch turns negative, the step goes back
along it. Words enter the model if they are commoner among positives than among unlabelled
texts (a G test). The prior is the toxic share among labelled training rows.

Only labels of rows whose crc32(doc_id) mod 3 is not 1 are read. The fit takes a bounded
sample: the ``MOST_POSITIVE`` and ``MOST_UNLABELLED`` training documents with the least hash.
Scoring is one pass over whole texts; label, language, source and id are no inputs.

Null and empty texts get the score of a text without any known word; very long ones are read
whole. Without a toxic label every score is 0. Repeated rows give repeated results; repeated
labels count once, as toxic if one of them says so. Of documents that share a sampled id one is
learnt from, the least by a hash of its text, so the sample holds a text for each id at most.
Rows without an id are scored and not learnt from. An empty table gives an empty result. Other
columns, whatever their names, are kept by ``keep_clean`` and not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, sampled_ids, small_batches, table, written

MOST_POSITIVE, MOST_UNLABELLED = 3000, 6000
#: A word enters if at least so many positives and this share of them hold it, at this ratio.
FEATURES, MIN_POSITIVE, MIN_SHARE, MIN_RATIO = 400, 5, 0.01, 4.0
PREFIXES = (4, 6)
EPOCHS, BATCH, RATE, L2 = 120, 512, 0.05, 1e-4
THRESHOLD = 0.7

_LETTERS = re.compile(r"[^\W\d_]+").findall


def features(text: str | None) -> set[str]:
    """The distinct words of a text in lower case, and their beginnings (with a ``^``)."""
    out = set(_LETTERS(text.lower())) if text else set()
    begins = {w[:k] + "^" for w in out for k in PREFIXES if len(w) > k}
    return out | begins


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3


class Model:
    def __init__(self, weights: dict[str, float], bias: float) -> None:
        self.weights, self.bias = weights, bias
        # words that begin as a known beginning are looked up by slices
        self.sizes = tuple(k for k in PREFIXES if any(len(f) == k + 1 and f[-1] == "^" for f in weights))

    def score(self, text: str | None) -> float:
        w = self.weights
        found = set(_LETTERS(text.lower())) if text else set()
        known = found & w.keys()
        for k in self.sizes:
            known |= {x[:k] + "^" for x in found if len(x) > k} & w.keys()
        z = self.bias + sum(sorted(w[f] for f in known))
        return float(1.0 / (1.0 + np.exp(-max(-500.0, min(500.0, z)))))


def risk(w: np.ndarray, b: float, x_p: np.ndarray, x_u: np.ndarray, prior: float) -> tuple[float, np.ndarray]:
    """The non-negative risk of a linear classifier on positive and unlabelled rows, by the
    logistic loss, and what a step goes down: the gradient of the risk where the negative part is
    not below zero, else minus the gradient of that part, which brings it back."""
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -50, 50)))
    z_p, z_u = x_p @ w + b, x_u @ w + b
    s_p, s_u = sigmoid(z_p), sigmoid(z_u)
    negative = np.logaddexp(0, z_u).mean() - prior * np.logaddexp(0, z_p).mean()
    value = prior * np.logaddexp(0, -z_p).mean() + max(0.0, negative)
    # gradients of the losses by the scores
    g_u, g_p = s_u / len(s_u), -prior * s_p / len(s_p)
    if negative >= 0:
        g_p = g_p + prior * (s_p - 1.0) / len(s_p)
    else:
        g_u, g_p = -g_u, -g_p
    return float(value), np.concatenate([x_u.T @ g_u + x_p.T @ g_p, [g_u.sum() + g_p.sum()]])


def pick(counts: list[tuple[str, int, int]], n_p: int, n_u: int) -> list[str]:
    """The features of a model, from their numbers of positive and unlabelled texts: those more
    common among the positives by the ratio, of most gain."""

    def gain(a: int, b: int) -> float:
        share = (a + b) / (n_p + n_u)
        return 2 * (a * np.log(a / (n_p * share)) + (b * np.log(b / (n_u * share)) if b else 0.0))

    common = [(f, gain(a, b)) for f, a, b in counts if a >= max(MIN_POSITIVE, MIN_SHARE * n_p) and a / n_p >= MIN_RATIO * (b / n_u)]
    return [f for f, _ in sorted(common, key=lambda x: (-x[1], x[0]))[:FEATURES]]


def learn(picked: list[str], x_p: np.ndarray, x_u: np.ndarray, prior: float, seed: int = 7) -> Model:
    """Fits the classifier on rows of zeros and ones; deterministic for the same rows."""
    n_p, n_u = len(x_p), len(x_u)
    rng = np.random.default_rng(seed)
    w, b = np.zeros(len(picked)), -1.0
    m, v, step = np.zeros(len(picked) + 1), np.zeros(len(picked) + 1), 0
    for _ in range(EPOCHS):
        order = rng.permutation(n_u)
        for lo in range(0, n_u, BATCH):
            u = x_u[order[lo : lo + BATCH]]
            p = x_p[rng.integers(0, n_p, BATCH)]
            grad = risk(w, b, p, u, prior)[1]
            grad[:-1] += L2 * w
            step += 1
            m = 0.9 * m + 0.1 * grad
            v = 0.999 * v + 0.001 * grad * grad
            move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
            w -= move[:-1]
            b -= move[-1]
    # the cut: positives found squared over the share of unlabelled texts taken, which grows as
    # precision times recall does and needs no negative labels; the score is THRESHOLD there
    z_p, z_u = x_p @ w + b, x_u @ w + b
    grid = np.unique(np.quantile(np.concatenate([z_p, z_u]), np.linspace(0, 1, 400)))
    found = 1 - np.searchsorted(np.sort(z_p), grid) / n_p
    taken = 1 - np.searchsorted(np.sort(z_u), grid) / n_u
    merit = np.where(found > 0, found**2 / np.maximum(taken, 0.5 * prior), 0)
    k = int(np.argmax(merit))
    below = np.concatenate([z_p, z_u])
    below = below[below < grid[k]]
    cut = (grid[k] + below.max()) / 2 if len(below) else grid[k]
    b += float(np.log(THRESHOLD / (1 - THRESHOLD)) - cut)
    return Model({f: round(float(x), 6) for f, x in zip(picked, w) if abs(x) > 1e-6}, round(float(b), 6))


def _rows(held: list[list[str]], picked: list[str]) -> np.ndarray:
    at = {f: i for i, f in enumerate(picked)}
    out = np.zeros((len(held), len(picked)), dtype=np.float32)
    for i, own in enumerate(held):
        out[i, [at[f] for f in own if f in at]] = 1.0
    return out


def train(positive: list[str], unlabelled: list[str], prior: float, seed: int = 7) -> Model:
    """The classifier of two lists of texts, for few of them: ``fit`` is its form on tables."""
    if not positive or not unlabelled:
        return Model({}, -20.0)
    p_df, u_df = (Counter(f for t in texts for f in features(t)) for texts in (positive, unlabelled))
    picked = pick([(f, a, u_df[f]) for f, a in p_df.items()], len(positive), len(unlabelled))
    return learn(picked, *(_rows([sorted(features(t)) for t in texts], picked) for texts in (positive, unlabelled)), prior, seed)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier of training rows: docs doc_id, text; labels doc_id, toxic.

    Texts stay in the tasks, however long: what reaches the driver is the counts of features that
    enough positives hold, and of each of the texts (at most MOST_POSITIVE and MOST_UNLABELLED)
    which of at most FEATURES it holds.
    """
    spark = docs.sparkSession
    seen = labels.where(F.col("toxic").isNotNull() & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    row = seen.agg(F.avg("toxic").alias("prior")).collect()[0]
    prior = min(0.5, max(0.001, row["prior"] or 0.001))
    # ids first: at most so many texts are then picked by a broadcast of at most so many ids
    p_ids = sampled_ids(seen.where("toxic = 1"), MOST_POSITIVE).withColumn("kind", F.lit(1))
    u_ids = sampled_ids(docs.where(fold(F.col("doc_id")) != 1), MOST_UNLABELLED).withColumn("kind", F.lit(0))
    sample = docs.select("doc_id", "text").join(F.broadcast(p_ids.unionByName(u_ids)), "doc_id")
    text = F.coalesce("text", F.lit(""))
    sample = sample.groupBy("kind", "doc_id").agg(F.min_by(text, F.struct(F.xxhash64(text), text)).alias("text"))
    small_batches(spark)
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("held", pa.list_(pa.string()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity", lambda: None)  # the caches of other operators go
        for batch in batches:
            held = [sorted(features(t)) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(held, schema.types[2])], schema=schema)

    held = written(sample.select(F.col("kind").cast("int"), F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "kind int, doc_id bigint, held array<string>"))
    n = {r["kind"]: r["n"] for r in held.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    n_p, n_u = n.get(1, 0), n.get(0, 0)
    if not n_p or not n_u:
        return Model({}, -20.0)
    counts = held.select("kind", F.explode("held").alias("f")).groupBy("f").agg(F.sum("kind").alias("a"), F.sum(1 - F.col("kind")).alias("b"))
    # the same conditions as in pick, so that few rows reach the driver
    counts = counts.where((F.col("a") >= float(max(MIN_POSITIVE, MIN_SHARE * n_p))) & (F.col("a") / n_p >= MIN_RATIO * (F.col("b") / n_u)))
    picked = pick([(r["f"], r["a"], r["b"]) for r in counts.collect()], n_p, n_u)
    names = F.array(*[F.lit(f) for f in picked]).cast("array<string>")
    got = held.select("kind", "doc_id", F.array_intersect("held", names).alias("held")).toArrow().sort_by([("kind", "ascending"), ("doc_id", "ascending")])
    kinds, rows = got.column("kind").to_pylist(), got.column("held").to_pylist()
    return learn(picked, *(_rows([r for k, r in zip(kinds, rows) if k == kind], picked) for kind in (1, 0)), prior)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score of every whole text; no shuffle."""
    small_batches(docs.sparkSession)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity", lambda: None)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([model.score(t) for t in batch.column(1).to_pylist()], pa.float64())], schema=schema)

    return docs.select(docs[id_col].cast("bigint").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, "doc_id bigint, score double")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return score(docs, model).select("doc_id", (fold(F.col("doc_id")) == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose text scores below the threshold, all columns as they were."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity", lambda: None)
        for batch in batches:
            yield batch.filter(pa.array([model.score(t) < threshold for t in batch.column("text").to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
