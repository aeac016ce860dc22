"""An extension: filings that arrive over time replace what they restate, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.panel import dedupe


def merge_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, values: list[str]):
    """Reads parquet files of filings as they come; each batch adds its own filings to target, under
    the batch's number, without those that it restates itself.

    History is not rewritten: ``standing`` takes the last of each filing. A batch that runs
    again writes the same folder again, so a lost driver changes nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        dedupe(batch, values)[0].write.mode("overwrite").parquet(f"{target}/v={number}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def standing(spark: SparkSession, target: str) -> DataFrame:
    """The filings that stand after all batches: of each fund and period the last source, and of
    one source the last batch."""
    every = spark.read.parquet(target)
    undated = F.when(F.col("period_end").isNull(), F.col("source"))
    rest = F.struct(*every.columns)
    last = every.groupBy("fund_code", "period_start", "period_end", undated.alias("_u")).agg(F.max_by(rest, F.struct(F.coalesce("source", F.lit("")), "v")).alias("r"))
    return last.select("r.*").drop("v")
