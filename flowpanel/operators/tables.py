"""Intermediate tables that outlive a lost executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: what ``spark.checkpoint.dir`` names, else the
    one set on the context. In one process alone, where there is none, a folder of our own is set."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    jsc = spark.sparkContext._jsc.sc()
    if named or jsc.getCheckpointDir().isEmpty():
        master = spark.sparkContext.master or ""
        if not named and (not master.startswith("local") or master.startswith("local-cluster")):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="flowpanel-"))
    return named or jsc.getCheckpointDir().get()


def settled(df: DataFrame) -> DataFrame:
    """df worked out once, kept in the shared folder and without its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def placed(counts: DataFrame, by: list[str], x: str) -> DataFrame:
    """counts (by, x, n: rows that have this x; each x once in its group) with _below, the group's
    rows of less x, and _total, the group's rows.

    The values are dealt out by range and counted inside each range; what the ranges before
    hold is added from one row per range and group. So no task reads a group, however large.
    """
    ranged = counts.repartitionByRange(*by, x).withColumn("_part", F.spark_partition_id())
    ranged = settled(ranged)
    sums = ranged.groupBy(*by, "_part").agg(F.sum("n").alias("_n"))
    group = Window.partitionBy(*by)
    before = F.sum("_n").over(group.orderBy("_part")) - F.col("_n")
    sums = sums.select(*[F.col(c).alias(f"_by_{c}") for c in by], F.col("_part").alias("_of"), before.alias("_before"), F.sum("_n").over(group).alias("_total"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{c}"))
    inside = F.sum("n").over(Window.partitionBy(*by, "_part").orderBy(x)) - F.col("n")
    got = ranged.withColumn("_in", inside).join(sums, same)
    return got.withColumn("_below", F.col("_before") + F.col("_in")).drop("_part", "_of", "_in", "_before", *[f"_by_{c}" for c in by])
