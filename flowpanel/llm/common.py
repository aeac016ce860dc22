"""What the operators share: tables, materialisation, words, connected components."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import shared_dir

#: Rows and bytes of one Arrow batch; texts may be long, so a worker holds few rows at a time.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20

#: Caches of this worker's process, by operator, each with what empties it.
_IN_USE: dict[str, Callable[[], None]] = {}


def only(operator: str, clear: Callable[[], None]) -> None:
    """Empties the caches of the other operators: a worker runs the stages of several, one after
    the other, and holds the cache of one of them."""
    for other in [k for k in _IN_USE if k != operator]:
        _IN_USE.pop(other)()
    _IN_USE[operator] = clear


#: The white space that separates words, as a regular expression's character class.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of the Python stages planned in this session from now on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


class _Written(threading.local):
    """Tables that ``written`` made and ``clean`` has not removed yet, of each thread its own: runs
    in two threads don't remove each other's."""

    def __init__(self) -> None:
        self.paths: list[str] = []

    def __len__(self) -> int:
        return len(self.paths)


_WRITTEN = _Written()


def written(df: DataFrame) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and outlives a lost executor. It stays
    until ``clean``, as the results that are built on it read it."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/flowpanel/{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.paths.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """How many tables this thread has written and not removed: where a later ``clean`` may begin."""
    return len(_WRITTEN)


def clean(spark: SparkSession, since: int = 0, keep: int = 0) -> int:
    """Removes the tables that this thread wrote after the first ``since``, but for the last
    ``keep``, and says how many: for a caller whose results are stored."""
    end = max(since, len(_WRITTEN) - keep)
    n = 0
    for name in _WRITTEN.paths[since:end]:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        n += path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    del _WRITTEN.paths[since:end]
    return n


def sampled_ids(ids: DataFrame, n: int) -> DataFrame:
    """At most n distinct ids of the column doc_id, those of least hash: the same ids on every
    run, and each once, so that a join back multiplies no row.

    A threshold on the hash leaves about twice as many before they are sorted, so that what
    one task reads does not grow with the input.
    """
    ids = ids.select("doc_id").where("doc_id is not null")
    total = ids.agg(F.approx_count_distinct("doc_id", 0.02)).collect()[0][0]
    h = F.pmod(F.xxhash64("doc_id", F.lit(23)), F.lit(1 << 40))
    some = ids.where(h < min(1.0, (2 * n + 200) / max(1, total)) * float(1 << 40)).distinct()
    return some.orderBy(h, "doc_id").limit(n)


def words(text: Column) -> Column:
    """Array of the words of text; null texts have none."""
    text = F.coalesce(text, F.lit(""))
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda w: w != "")


#: Length of the blocks into which ``running`` and ``Cuts`` part long arrays and texts.
RUN, PIECE = 256, 4096


def running(values: Column, start: Column, step: Callable[[Column, Column], Column]) -> Column:
    """For each element the fold of start and all elements before it, as an array of start's type.

    Spark has no scan over an array, and appending to one copies it. So the array is cut into
    blocks, the blocks are folded, and appending goes on inside a block only.
    """
    n = F.size(values)
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(n / RUN).cast("int") - 1, F.lit(0))), lambda b: F.slice(values, b * RUN + 1, F.lit(RUN)))

    def inside(block: Column, first: Column, op) -> Column:
        empty = F.slice(F.array(first), 1, 0)
        return F.aggregate(block, F.struct(first.alias("at"), empty.alias("out")), lambda acc, v: F.struct(op(acc["at"], v).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")))["out"]

    # a block's own fold joins the folds of the blocks before as one more element
    firsts = inside(blocks, start, lambda at, block: F.aggregate(block, at, step))
    return F.flatten(F.zip_with(blocks, firsts, lambda block, first: inside(block, first, step)))


class Cuts:
    """Parts of a text by code points, without counting from its beginning for each of them."""

    def __init__(self, text: Column) -> None:
        self.blocks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))

    def part(self, start: Column, end: Column, blocks: Column | None = None) -> Column:
        blocks = self.blocks if blocks is None else blocks
        first = F.floor(start / PIECE).cast("int")
        n = F.floor(end / PIECE).cast("int") - first + 1
        return F.substr(F.array_join(F.slice(blocks, first + 1, n), ""), start - first * PIECE + 1, F.greatest(end - start, F.lit(0)))


def hex_sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def components(edges: DataFrame, max_rounds: int = 40) -> DataFrame:
    """Smallest reachable id of every node in edges (a, b: long): columns node, component.

    Alternates the large-star and small-star steps. Every step is a shuffle by node with a
    partial minimum; no node's neighbours are gathered in one row. Each round is written to
    the shared folder. Nodes without an edge are not in the result; empty edges give an
    empty result.
    """
    spark = edges.sparkSession
    now = written(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    for _ in range(max_rounds):
        before = _signature(now)
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(
            F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")
        ).select("e.u", "e.v")
        now = written(small.where("u <> v").distinct())
        if _signature(now) == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    least = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(least)


def _signature(edges: DataFrame) -> tuple:
    """Count and an order-free hash of the edges."""
    row = edges.agg(
        F.count("*").alias("n"),
        F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("h"),
    ).collect()[0]
    return row["n"], row["h"]
