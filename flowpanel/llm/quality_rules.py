r"""Operator 9: quality rules as learned decision lists, native only.

Sequential covering learns an ordered list of rules from labelled statistics. A rule is a
conjunction of threshold tests on ratios of a text; growing adds the test that raises
FOIL's gain most on one part of the labelled rows, pruning drops tests from the end as long
as the other part's precision does not fall. The list becomes one Spark conditional
expression. Each growing step is one aggregation over binned statistics, so at most
features * bins rows of counts reach the driver.

Windows are told apart by 64-bit hashes of their words: two that differ agree by chance once in
2^64 pairs, so a text of a million words counts a false repeat with odds below 1 to 30 million.

Null and empty texts have no words: all counts are zero, base_failed is true. Texts are
measured whole, very long ones, too. Rows without an id are measured and not learnt from. Repeated rows give repeated results; labelled rows that repeat count as
often as they stand. Without labelled rows of both kinds the list is empty and base_failed
alone decides. An empty table gives an empty result. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE, table, words, written

SYMBOLS = "#*$%&|<>"
WINDOW = 5
BINS = 24
MAX_RULES = 8
MAX_TESTS = 3
#: A rule must hold this share of low quality on the pruning part, and cover so many rows.
MIN_PRECISION = 0.95
MIN_COVER = 10

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("n_words", "mean_word", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "distinct_share", "stop_share", "digit_share")


def _repeated(ws: Column) -> Column:
    """Words that lie in a five-word window found twice or more; windows compare by 64-bit hash."""
    n = F.size(ws)
    at = lambda i, k: F.get(ws, i + k)
    windows = F.transform(F.sequence(F.lit(0), n - WINDOW), lambda i: F.xxhash64(*[at(i, k) for k in range(WINDOW)]))
    return F.when(n >= WINDOW, windows).otherwise(F.array().cast("array<bigint>"))


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the counts of every whole text, in row-wise expressions: no shuffle."""
    text = F.coalesce(F.col("text"), F.lit(""))
    first = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"), words(F.col("text")).alias("ws"))
    joined = F.array_join("ws", "")
    lines = F.filter(F.split("text", "\n"), lambda x: x.rlike(f"[^{SPACE}]"))
    second = first.select(
        "doc_id",
        "ws",
        F.size("ws").cast("bigint").alias("n_words"),
        joined.alias("joined"),
        (F.length("text") - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        _repeated(F.col("ws")).alias("windows"),
    )
    # most texts repeat no window: only the others are sorted
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    keyed = F.when(repeats, F.array_sort(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    third = second.select("*", keyed.alias("keyed"))
    # neighbours in the sorted order with one hash; their positions in order
    left = F.concat(F.array(F.lit(None).cast("struct<h:bigint,i:int>")), F.slice("keyed", 1, F.greatest(F.size("keyed") - 1, F.lit(0))))
    right = F.concat(F.slice("keyed", 2, F.greatest(F.size("keyed") - 1, F.lit(0))), F.array(F.lit(None).cast("struct<h:bigint,i:int>")))
    zipped = F.arrays_zip(left.alias("l"), F.col("keyed").alias("k"), right.alias("r"))
    twice = F.array_sort(
        F.transform(
            F.filter(zipped, lambda z: F.coalesce(z["l"]["h"] == z["k"]["h"], F.lit(False)) | F.coalesce(z["r"]["h"] == z["k"]["h"], F.lit(False))),
            lambda z: z["k"]["i"],
        )
    )
    covered = F.aggregate(
        twice,
        F.struct(F.lit(0).alias("until"), F.lit(0).alias("n")),
        lambda acc, i: F.struct((i + WINDOW).alias("until"), (acc["n"] + i + WINDOW - F.greatest(acc["until"], i)).alias("n")),
    )["n"]
    low = F.lower("joined")
    return third.select(
        "doc_id",
        "n_words",
        F.length("joined").cast("bigint").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.col("keyed").isNull(), 0).otherwise(covered).cast("bigint").alias("n_repeat_words"),
        F.size("lines").cast("bigint").alias("n_lines"),
        F.size(F.array_distinct("ws")).cast("bigint").alias("n_distinct"),
        F.when(F.col("n_words") > 0, F.length("joined") - F.length(F.regexp_replace("joined", r"\p{Lu}+", ""))).otherwise(0).cast("bigint").alias("n_upper"),
        (F.length("joined") - F.length(F.translate("joined", "0123456789", ""))).cast("bigint").alias("n_digits"),
        (F.length("joined") - F.length(F.translate("joined", ".,;:!?", ""))).cast("bigint").alias("n_stops"),
    )


def _ratios() -> dict[str, Column]:
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b)), F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"),
        "mean_word": share("word_chars", "n_words"),
        "symbol_share": share("n_symbols", "word_chars"),
        "dup_line_share": share("n_dup_lines", "n_lines"),
        "repeat_share": share("n_repeat_words", "n_words"),
        "upper_share": share("n_upper", "word_chars"),
        "distinct_share": share("n_distinct", "n_words"),
        "stop_share": share("n_stops", "n_words"),
        "digit_share": share("n_digits", "word_chars"),
    }


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Test:
    """feature >= at, or feature < at."""

    feature: str
    above: bool
    at: float

    def column(self) -> Column:
        value = _ratios()[self.feature]
        return value >= self.at if self.above else value < self.at


def _all(tests) -> Column:
    out = F.lit(True)
    for t in tests:
        out = out & t.column()
    return out


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    """FOIL's gain: positives kept times the bits by which their share grows."""
    from math import log2

    if not p:
        return 0.0
    return p * (log2(p / (p + n)) - log2(p0 / (p0 + n0)))


def learn(labelled: DataFrame, features=RATIOS, bins: int = BINS) -> list[tuple[Test, ...]]:
    """Rules for low quality, in order. labelled: the counts of measured and bad (0 or 1).

    Two thirds of the rows, by a hash of the id, grow the rules, the others prune them.
    """
    ratios = _ratios()
    part = F.pmod(F.xxhash64("doc_id"), F.lit(3)) < 2
    spots = [i / bins for i in range(1, bins)]
    cuts = labelled.agg(*[F.percentile_approx(ratios[f], spots, 10_000).alias(f) for f in features]).collect()[0]
    # cuts from the two classes apart as well: a rare class shows in no quantile of all rows
    rare = labelled.where("bad = 1").agg(*[F.percentile_approx(ratios[f], spots, 10_000).alias(f) for f in features]).collect()[0]
    cuts = {f: sorted({*(cuts[f] or []), *(rare[f] or [])}) for f in features}
    placed = labelled.withColumn("part", part)
    cells = F.array(
        *[
            F.struct(F.lit(f).alias("f"), sum([(ratios[f] >= c).cast("int") for c in cuts[f]], F.lit(0)).alias("b"))
            for f in features
        ]
    )
    rules: list[tuple[Test, ...]] = []
    left = placed
    for _ in range(MAX_RULES):
        tests: list[Test] = []
        while len(tests) < MAX_TESTS:
            got = left.where("part").where(_all(tests)).select(F.explode(cells).alias("c"), "bad").groupBy("c.f", "c.b").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            by: dict[str, list] = {f: [[0, 0] for _ in range(len(cuts[f]) + 1)] for f in features}
            for r in got:
                by[r["f"]][r["b"]] = [r["p"], r["n"]]
            p0, n0 = (sum(x[k] for x in by[features[0]]) for k in (0, 1))
            if p0 < MIN_COVER or n0 == 0:
                break
            best = (1e-9, None)
            for f in features:
                for i, c in enumerate(cuts[f], 1):
                    for above, cells_in in ((True, by[f][i:]), (False, by[f][:i])):
                        p, n = (sum(x[k] for x in cells_in) for k in (0, 1))
                        if p >= MIN_COVER and (p, n) != (p0, n0):
                            best = max(best, (_gain(p, n, p0, n0), Test(f, above, c)), key=lambda x: x[0])
            if best[1] is None:
                break
            tests.append(best[1])
        if not tests:
            break
        # pruning: of the rule and its shorter forms the one with the best precision, the shortest of equals
        sums = [x for k in range(1, len(tests) + 1) for x in (F.sum(F.when(_all(tests[:k]), F.col("bad"))).alias(f"p{k}"), F.sum(F.when(_all(tests[:k]), 1 - F.col("bad"))).alias(f"n{k}"))]
        row = left.where(~F.col("part")).agg(*sums).collect()[0]
        scored = [((row[f"p{k}"] or 0) / max(1, (row[f"p{k}"] or 0) + (row[f"n{k}"] or 0)), -k) for k in range(1, len(tests) + 1)]
        precision, k = max(scored)
        if precision < MIN_PRECISION:
            break
        rules.append(tuple(tests[:-k]))
        left = left.where(~_all(rules[-1]))
    return rules


def verdict(rules) -> Column:
    """The list as an ordered conditional: the number of the first rule that fires, else null."""
    out = None
    for i, r in enumerate(rules, 1):
        out = F.when(_all(r), F.lit(i)) if out is None else out.when(_all(r), F.lit(i))
    return F.lit(None).cast("int") if out is None else out.otherwise(F.lit(None).cast("int"))


def apply_rules(counts: DataFrame, rules) -> DataFrame:
    failed = base_failed()
    return counts.select("doc_id", *BASE, failed.alias("base_failed"), (~failed & verdict(rules).isNull()).alias("kept"), verdict(rules).alias("rule"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = written(measured(table(spark, sf_dir, "documents").select("doc_id", "text")))
    labels = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("_id"), (1 - F.col("quality")).alias("bad"))
    labelled = counts.join(labels, F.col("doc_id") == F.col("_id")).drop("_id")
    return apply_rules(counts, learn(written(labelled)))
