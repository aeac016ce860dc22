"""Outputs of a run: one folder for each result, the manifest of fetches, the console report."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import gates


def _flat(df: DataFrame) -> DataFrame:
    """CSV holds no arrays or structs: they go as JSON."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "struct", "map")}
    return df.select(*[F.to_json(c).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns])


#: The file that names the outputs that count, in the folder of a run's outputs.
CURRENT = "current.json"


def _files(spark: SparkSession, folder: str):
    """The file system of a folder, and a path in it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), lambda name: spark._jvm.org.apache.hadoop.fs.Path(path, name)


def write_outputs(results: dict[str, DataFrame], folder: str, form: str = "csv", order: dict[str, list[str]] | None = None) -> dict[str, str]:
    """All results, each in its own folder, visible together or not at all: name -> path.

    They are written beside the former outputs; only when all stand, one file that names them is
    put in place of the one before, which is a single rename. A write that breaks leaves the
    former outputs as they were. The outputs before the former ones are removed.

    order: the columns by which a result is sorted, over its files and inside them.
    """
    spark = next(iter(results.values())).sparkSession
    folder, number = folder.rstrip("/"), f"run-{uuid.uuid4().hex}"
    before = _published(spark, folder)
    out = {}
    for name, df in results.items():
        by = [c for c in (order or {}).get(name, []) if c in df.columns]
        df = df.orderBy(*by) if by else df  # dealt out by range and sorted inside
        out[name] = f"{folder}/{number}/{name}.{form}"
        if form == "csv":
            _flat(df).write.option("header", True).option("escape", '"').csv(out[name])
        else:
            df.write.format(form).save(out[name])
    fs, at = _files(spark, folder)
    new = at(f".{CURRENT}.{number}")
    stream = fs.create(new, True)
    stream.write(bytearray(json.dumps({"run": number, "former": before.get("run"), "outputs": {n: f"{number}/{n}.{form}" for n in out}}, sort_keys=True).encode()))
    stream.close()
    # replaces the file in one step, which a plain rename does not do on every file system
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(new), fs.makeQualified(at(CURRENT)), options)
    if before.get("former"):
        fs.delete(at(before["former"]), True)
    return out


def _published(spark: SparkSession, folder: str) -> dict:
    fs, at = _files(spark, folder)
    if not fs.exists(at(CURRENT)):
        return {}
    return json.loads("".join(r["value"] for r in spark.read.text(f"{folder}/{CURRENT}").collect()))


def outputs(spark: SparkSession, folder: str) -> dict[str, str]:
    """name -> path of the outputs that count in a folder; none before a first run has ended."""
    folder = folder.rstrip("/")
    return {n: f"{folder}/{p}" for n, p in _published(spark, folder).get("outputs", {}).items()}


def append_manifest(records: DataFrame, folder: str) -> None:
    """Adds the records of some fetches, one JSON object a line, names in order."""
    records.select(*sorted(records.columns)).write.mode("append").json(folder)


def counts_by(failures: DataFrame, by: str = "fund_code") -> DataFrame:
    return failures.groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), by)


def panel_report(spark: SparkSession, checks: DataFrame, parts: DataFrame) -> str:
    """The checks' summary and the rows of each part of a run, for a console."""
    rows = {r["part"]: r["n"] for r in parts.collect()}
    return gates.report(checks) + "\n" + ", ".join(f"{k} {v}" for k, v in rows.items())
