"""Filings from a stream, judged as they come: what stands, what it supersedes and why.

The state of a fund and period is what has been filed for it: a few filings, by source. When one
comes, late or not, only the filings whose standing that changes are emitted; nothing that
was written before is read. After any number of batches, in any order, the last word on each
filing is what ``panel.dedupe`` says of all of them at once.
"""

from __future__ import annotations


import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

#: A store that keeps state for a keyed processor.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WORDS = "key string, source string, filing string, status string, superseded_by string, reason string"
#: What the batch form says of a superseded filing.
IDENTICAL, RESTATED = "identical", "restatement"


def words(held: dict[str, tuple[str, str]]) -> dict[str, tuple]:
    """For each source of one fund and period: filing, status, superseded_by, reason. The last
    source stands; each other is superseded by the next."""
    order, out = sorted(held), {}
    for this, after in zip(order, [*order[1:], None]):
        filing, values = held[this]
        same = after is not None and held[after][1] == values
        out[this] = (filing, "kept", None, None) if after is None else (filing, "superseded", after, IDENTICAL if same else RESTATED)
    return out


class Standing(StatefulProcessor):
    """Holds, per fund and period, filing and figures by source."""

    def init(self, handle) -> None:
        self.held = handle.getMapState("held", "source string", "filing string, figures string")

    def handleInputRows(self, key, rows, timerValues):
        held = {k[0]: (v[0], v[1]) for k, v in self.held.iterator()}
        before = words(held)
        new: dict[str, tuple[str, str]] = {}
        for part in rows:
            for source, filing, figures in zip(part["source"], part["filing"], part["figures"]):
                # of one source the last batch counts, inside a batch the greatest
                new[source] = max(new.get(source, ("", "")), (filing, figures))
        for source, value in new.items():
            if held.get(source) != value:
                held[source] = value
                self.held.updateValue((source,), value)
        out = [(key[0], s, *w) for s, w in words(held).items() if before.get(s) != w]
        yield pd.DataFrame(out, columns=["key", "source", "filing", "status", "superseded_by", "reason"])

    def close(self) -> None:
        pass


def judged(filings: DataFrame, values: list[str]) -> DataFrame:
    """The changes that a stream of filings makes: the filing's columns, status ("kept" or
    "superseded"), superseded_by and reason. A later row for a filing replaces the earlier one.
    The session needs a state store for keyed processors (PROVIDER)."""
    columns = filings.columns
    keep = {"ignoreNullFields": "false"}
    undated = F.when(F.col("period_end").isNull(), F.col("source"))
    key = F.to_json(F.struct("fund_code", "period_start", "period_end", undated.alias("u")), keep)
    # the row travels as text, so that its types come back as they were
    rows = filings.select(key.alias("key"), F.coalesce("source", F.lit("")).alias("source"), F.to_json(F.struct(*columns), keep).alias("filing"), F.to_json(F.struct(*[v for v in values if v in columns]), keep).alias("figures"))
    got = rows.groupBy("key").transformWithStateInPandas(Standing(), WORDS, "Update", "None")
    return got.select(F.from_json("filing", filings.schema).alias("f"), "key", F.col("source").alias("_source"), "status", "superseded_by", "reason").select("f.*", "key", "status", "superseded_by", "reason")


def follow(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, values: list[str]):
    """Reads parquet files of filings as they come and adds each batch's changes to target, in a
    folder with the batch's number. A batch that runs again writes the same folder again."""

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/v={number}")

    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    stream = judged(spark.readStream.schema(schema).parquet(source), values)
    return stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def last_words(spark: SparkSession, target: str) -> DataFrame:
    """The last change of each filing: status, superseded_by and reason after all batches."""
    every = spark.read.parquet(target)
    w = Window.partitionBy("key", F.coalesce("source", F.lit(""))).orderBy(F.desc("v"))
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r", "v", "key")
