"""A training-data pipeline over documents: five stages, each one operator of flowpanel.llm.

toxic documents go; one document of each near-duplicate group stays; secrets are masked in
the texts; sources are mixed to their target weights, documents repeated or left out as the
mix takes them; and the texts are encoded. All stages but the last keep the columns of
documents.

Every row is a document of its own, also where ids, texts or whole rows repeat or are null.
Null and empty texts are clean, are copies of nothing, hold no secrets, weigh nothing in the mix
(which keeps them once) and have no tokens. Very long texts are treated whole. Further columns,
whatever their names, go along unread up to the last stage, which has columns of its own. An
empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from flowpanel.llm import bpe, mixing, near_dup, secrets, toxicity
from flowpanel.llm.common import clean, mark, table, written

#: Documents of a bucket, about, and the parts of a whole copy that are drawn by.
BUCKET, UNIT = 2000, 1 << 20


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.keep_clean(docs, model)


def _packed(docs: DataFrame, **more: Column) -> DataFrame:
    """The rows as one struct each, beside columns of our own: no name of theirs can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), *[v.alias(k) for k, v in more.items()])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the first by id stays; of equal ids the first by a hash of the row."""
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    ordered = _packed(docs, id=F.col("doc_id"), hash=every).orderBy(F.col("id").asc_nulls_last(), "hash")
    numbered = written(ordered.select("doc", F.monotonically_increasing_id().alias("place")))
    gone = near_dup.near_groups(numbered.select(F.col("place").alias("doc_id"), F.col("doc.text").alias("text"))).where("not kept").select(F.col("doc_id").alias("place"))
    return numbered.join(gone, "place", "left_anti").select("doc.*")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs, secrets.log_ratios(spark, docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; a row without words, which weighs nothing, once.

    What is left beside whole copies is drawn by systematic sampling within the source: of a
    running sum of these parts, from a start that depends on the source, every whole number
    that is passed adds a copy. So a source keeps its expected words, whatever its documents'
    sizes.
    """
    # a row's key: id, source, size and a hash of all columns; nulls are told by columns of their
    # own, so that the join and the window below share one partitioning, and texts move once
    every = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    key = {"a": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)), "no_a": F.col("doc_id").isNull(), "b": F.coalesce(F.col("source").cast("string"), F.lit("")), "no_b": F.col("source").isNull(), "size": mixing.word_count(F.col("text")), "hash": every}
    own = _packed(docs, **key)
    narrow = written(own.drop("doc"))
    same = ["a", "no_a", "b", "no_b", "size"]
    ids = narrow.select(F.when(~F.col("no_a"), F.col("a")).alias("doc_id"), F.when(~F.col("no_b"), F.col("b")).alias("source"), "size")
    times = written(mixing.mix(ids, size_col="size").select(*[x.alias(k) for k, x in (key | {"size": F.col("size")}).items() if k != "hash"], "row", "taken"))
    buckets = 1 + times.count() // BUCKET
    full = F.greatest("size", F.lit(1))
    times = times.withColumn("part", F.when(F.col("size") > 0, F.floor(F.col("taken") % full * UNIT / full)).otherwise(0))
    times = times.withColumn("order", F.xxhash64(*same, "row")).withColumn("bucket", F.pmod("order", F.lit(buckets)))
    sums = times.groupBy("b", "no_b", "bucket").agg(F.sum("part").alias("sum"))
    start = F.pmod(F.xxhash64("b", "no_b", F.lit(29)), F.lit(UNIT))
    sums = sums.select("b", "no_b", "bucket", (start + F.sum("sum").over(Window.partitionBy("b", "no_b").orderBy("bucket")) - F.col("sum")).alias("base"))
    inside = Window.partitionBy("b", "no_b", "bucket").orderBy("order", *same, "row")
    times = times.join(sums, ["b", "no_b", "bucket"]).withColumn("to", F.col("base") + F.sum("part").over(inside))
    whole = F.floor(F.col("taken") / full) + F.floor(F.col("to") / UNIT) - F.floor((F.col("to") - F.col("part")) / UNIT)
    times = times.select(*same, "row", F.when(F.col("size") > 0, whole).otherwise(1).cast("bigint").alias("times"))
    # rows alike in id, source and size are told apart by number, in the order of the hash; rows
    # alike in all columns share what they are taken
    numbered = narrow.withColumn("row", F.row_number().over(Window.partitionBy(*same).orderBy("hash")))
    shares = numbered.join(times, [*same, "row"]).groupBy(*same, "hash").agg(F.sum("times").alias("times"), F.count("*").alias("rows"))
    taken = own.join(shares.where("times > 0"), [*same, "hash"])
    taken = taken.withColumn("place", F.row_number().over(Window.partitionBy(*same, "hash").orderBy("times")))
    n = F.expr("times div rows") + (F.col("place") <= F.col("times") % F.col("rows")).cast("bigint")
    return taken.withColumn("n", n).where("n > 0").withColumn("time", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("doc.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, with_ids=True)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", drop_near_copies),
    ("secret_scans", mask_secrets),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode),
]

#: Learned models and the tokenizer can't be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other. What a stage wrote for itself, and the output of the stage
    before it, go when its own output stands."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before = mark()
        docs = written(stage(spark, docs, sf_dir))
        clean(spark, before - (k > 0), keep=1)
    return STAGES[-1][1](spark, docs, sf_dir)
