r"""Operator 3: mixing sources to target weights by a low-discrepancy schedule.

Each source's documents stand in a shuffled order (by hash) and are cut, end to end, into
blocks of equally many words. Slot s of the mix takes its source from the golden-ratio point
frac(s * phi), mapped through the cumulative target shares; the rank of a slot among its
source's slots names the block: rank modulo the number of blocks, so a source whose target
exceeds its size is passed over again. Slots beyond three passes are left out, so no
document is taken more than three times.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share all sizes; a
target stops at three times its source's size and the excess is shared by weight again.

Sources are a table like any other, however many there are: ranked over ranges, their targets
found by a few sums over the table, and joined to slots by cells of the circle. Ranks and
running sizes are two-level: prefix sums over buckets, then windows inside a bucket, so no
source, however large, meets in one task. Some totals reach the driver, no source and no
document.

Null and empty texts have size 0 and nothing is taken of them; a source of size 0 has target
0. Repeated rows (same id) are documents of their own; rows without an id are documents, too.
Very long texts span many blocks. Other columns, whatever their names, are not read; sizes come
from the texts unless the caller names a column that holds them. An empty table gives an empty
result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, table, written

WEIGHTS = (5, 2, 1)
PASSES = 3
#: Words of a block at most, and blocks that a source is cut into at least (if it has so many words).
BLOCK, LEAST_BLOCKS = 256, 512
#: The circle of points, and floor(CIRCLE / golden ratio) made odd: the points of CIRCLE slots all differ.
CIRCLE, STEP = 1 << 40, 679_538_545_317 | 1
HALF = 1 << 20
#: Documents of a bucket, slots of a chunk, about, and cells of the circle at least.
BUCKET, CHUNK, CELLS = 2000, 1 << 14, 1 << 10


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), 0).otherwise(F.regexp_count(text, F.lit(f"[^{SPACE}]+"))).cast("bigint")


def targets(sources: DataFrame, weights=WEIGHTS, passes: int = PASSES) -> DataFrame:
    """sources (source, size) with place (by code point, null last), target: shares of all sizes
    by weight, each at most passes times its source's size."""
    named = sources.select("source", F.col("size").alias("source_size"), *[c for c in sources.columns if c not in ("source", "size")])
    # ranges in order, each sorted: a row's place is its number in its range after those before
    order = [F.col("source").isNull(), F.col("source")]
    ranged = named.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    ranged = written(ranged.withColumns({"_range": F.shiftright("_id", 33), "_in": F.col("_id").bitwiseAND((1 << 33) - 1)}))
    before = ranged.groupBy("_range").agg(F.count("*").alias("n"))
    before = before.select("_range", (F.sum("n").over(Window.orderBy("_range")) - F.col("n")).alias("_before"))
    placed = ranged.join(before, "_range").withColumn("place", F.col("_before") + F.col("_in"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    placed = written(placed.withColumn("weight", weight).drop("_id", "_range", "_in", "_before"))
    limit, level = passes * F.col("source_size"), 0.0
    while True:
        # all that are full at one level are full at any higher one
        full = limit <= F.lit(level) * F.col("weight")
        row = placed.agg(F.sum("source_size").alias("all"), F.sum(F.when(full, limit)).alias("used"), F.sum(F.when(~full, F.col("weight"))).alias("open")).collect()[0]
        if not row["open"]:
            break
        raised = ((row["all"] or 0) - (row["used"] or 0)) / row["open"]
        if raised <= level:
            break
        level = raised
    return placed.withColumn("target", F.least(limit.cast("double"), F.lit(level) * F.col("weight"))).drop("weight")


def mix(docs: DataFrame, weights=WEIGHTS, passes: int = PASSES, size_col: str | None = None) -> DataFrame:
    """doc_id, size, source_size, target, taken, row (a number that tells equal rows apart) and source.

    docs: doc_id, source and text, or the column of sizes that size_col names.
    """
    spark = docs.sparkSession
    size = docs[size_col].cast("bigint") if size_col else word_count(docs["text"])
    sized = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["source"].cast("string").alias("source"), size.alias("size"))
    # one row per distinct (id, source, size) with its count: equal rows are told apart by number later
    sized = written(sized.groupBy("doc_id", "source", "size").agg(F.count("*").alias("copies")))
    rows = sized.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    rows = rows.withColumn("h", F.xxhash64("doc_id", "size", "copy", F.lit(17)))
    known = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size"), F.sum("copies").alias("n"))
    cut = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.expr(f"source_size div {LEAST_BLOCKS}"))).cast("bigint")
    sources = targets(known, weights, passes).withColumn("cut", cut).withColumn("blocks", F.ceil(F.col("source_size") / F.col("cut")).cast("bigint"))
    share = F.when(F.col("source_size") > 0, F.col("target") * F.col("blocks") / F.col("source_size")).otherwise(0.0)
    sources = sources.select(F.col("place").alias("k"), "source", "source_size", "target", "cut", "blocks", F.greatest(F.lit(1), F.ceil(F.col("n") / BUCKET)).alias("buckets"), share.alias("share"))
    # where each source's part of the circle ends: shares as whole numbers, so that sums are exact
    # in any order, over chunks of places and then inside a chunk
    row = sources.agg(F.sum("share").alias("slots"), F.count("*").alias("n")).collect()[0]
    slots, n = round(row["slots"] or 0), row["n"]
    unit = F.round(F.col("share") * F.lit((CIRCLE / row["slots"]) if slots else 0.0)).cast("bigint")
    sources = sources.withColumns({"part": F.floor(F.col("k") / BUCKET), "width": unit})
    sums = sources.groupBy("part").agg(F.sum("width").alias("w"))
    sums = sums.select("part", (F.sum("w").over(Window.orderBy("part")) - F.col("w")).alias("base"))
    inside = Window.partitionBy("part").orderBy("k")
    sources = sources.join(sums, "part").withColumn("to", F.col("base") + F.sum("width").over(inside)).withColumn("from", F.col("to") - F.col("width"))
    # the last part takes what rounding leaves
    last = sources.where("width > 0").agg(F.max("k").alias("k")).collect()[0]["k"]
    sources = written(sources.withColumn("to", F.when(F.col("k") == F.lit(last), F.greatest("to", F.lit(CIRCLE))).otherwise(F.col("to"))).drop("part", "width", "base", "share"))
    placed = rows.join(sources.drop("from", "to").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    placed = placed.withColumn("bucket", F.floor(F.shiftrightunsigned("h", 32) * F.col("buckets") / F.lit(float(1 << 32))))
    # running sizes: over the buckets of a source, then inside a bucket
    sums = placed.groupBy("k", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.select("k", "bucket", (F.sum("words").over(Window.partitionBy("k").orderBy("bucket")) - F.col("words")).alias("base"))
    inside = Window.partitionBy("k", "bucket").orderBy("h", "doc_id", "size", "copy")
    placed = placed.join(sums, ["k", "bucket"]).withColumn("from", F.col("base") + F.sum("size").over(inside) - F.col("size"))
    # slots: source by point, rank within the source; the product is taken in two halves, so that it fits
    high, low = divmod(STEP, HALF)
    point = F.pmod(F.pmod(F.col("id") * high, F.lit(HALF)) * HALF + F.col("id") * low, F.lit(CIRCLE))
    cells = CELLS
    while cells < n:
        cells *= 2
    cell = CIRCLE // cells
    points = spark.range(slots).select(F.col("id").alias("slot"), F.floor(F.col("id") / CHUNK).alias("chunk"), point.alias("point")).withColumn("cell", F.floor(F.col("point") / cell))
    # a source stands in all cells that its part of the circle meets
    parts = sources.where("`from` < `to`").select("k", "blocks", "from", "to", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("to") - 1) / cell))).alias("cell"))
    lists = points.join(parts, "cell").where("point >= `from` and point < `to`").select("slot", "chunk", "k", "blocks")
    per = lists.groupBy("k", "chunk").agg(F.count("*").alias("n"))
    per = per.select("k", "chunk", (F.sum("n").over(Window.partitionBy("k").orderBy("chunk")) - F.col("n")).alias("before"))
    ranked = lists.join(per, ["k", "chunk"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("k", "chunk").orderBy("slot")) - 1)
    ranked = ranked.where(F.col("rank") < passes * F.col("blocks"))
    times = ranked.groupBy("k", (F.col("rank") % F.col("blocks")).alias("block")).agg(F.count("*").alias("times"))
    # each document's part of each block
    whole = placed.where("size > 0").withColumn("block", F.explode(F.sequence(F.floor(F.col("from") / F.col("cut")), F.floor((F.col("from") + F.col("size") - 1) / F.col("cut")))))
    part = F.least(F.col("from") + F.col("size"), (F.col("block") + 1) * F.col("cut")) - F.greatest(F.col("from"), F.col("block") * F.col("cut"))
    keys = ["doc_id", "size", "source_size", "target", "copy", "k", "source"]
    taken = whole.withColumn("part", part).join(times, ["k", "block"], "left").groupBy(*keys).agg(F.sum(F.col("part") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = placed.where("size <= 0").select(*keys, F.lit(0).cast("bigint").alias("taken"))
    return taken.unionByName(none).select("doc_id", "size", "source_size", "target", "taken", F.col("copy").alias("row"), "source")


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")
