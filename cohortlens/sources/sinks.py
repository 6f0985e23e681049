"""Writers: nested JSON, a Markdown card, atomic replace, idempotent append."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """Result rows as JSON documents."""
    df.write.mode("overwrite").json(path)


def card(title: str, tables: dict[str, DataFrame]) -> str:
    """Markdown of report tables with all their rows, which come to the driver a partition at a time."""
    out = [f"# {title}", ""]
    for name, df in tables.items():
        out += [f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        out += ["| " + " | ".join("" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r) + " |" for r in df.toLocalIterator()]
        out += ["", ""]
    return "\n".join(out)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _file_context(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = lambda x: jvm.org.apache.hadoop.fs.Path(x)
    return jvm, at, jvm.org.apache.hadoop.fs.FileContext.getFileContext(at(path).toUri(), spark._jsc.hadoopConfiguration())


def replace_table(df: DataFrame, path: str) -> None:
    """Write a new version beside the old ones, then point the table at it by one atomic rename.

    A reader that opened the old version still finds its files; only versions before that one are cleared.
    """
    spark = df.sparkSession
    name = uuid.uuid4().hex
    df.write.parquet(f"{path}/version={name}")
    before = current_version(spark, path)
    spark.createDataFrame([(name,)], "value string").coalesce(1).write.text(f"{path}/_pointers/{name}")
    jvm, at, fc = _file_context(spark, path)
    part = next(f for f in spark.read.text(f"{path}/_pointers/{name}").inputFiles())
    overwrite = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    overwrite[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    fc.rename(at(part), at(f"{path}/_current"), overwrite)
    fc.delete(at(f"{path}/_pointers/{name}"), True)
    for s in fc.util().listStatus(at(path)):
        folder = s.getPath().getName()
        if folder.startswith("version=") and folder not in (f"version={name}", f"version={before}"):
            fc.delete(s.getPath(), True)


def current_version(spark: SparkSession, path: str) -> str | None:
    _, at, fc = _file_context(spark, path)
    if not fc.util().exists(at(f"{path}/_current")):
        return None
    stream = fc.open(at(f"{path}/_current"))
    try:
        return bytes(stream.readNBytes(64)).decode().strip()
    finally:
        stream.close()


def read_current(spark: SparkSession, path: str) -> DataFrame:
    """The table that ``replace_table`` wrote last."""
    return spark.read.parquet(f"{path}/version={current_version(spark, path)}")


def append_once(df: DataFrame, path: str, keys, batch: str) -> None:
    """Store the rows whose key no other batch has, as batch ``batch``; storing a batch again replaces it.

    A table has one writer at a time: two that store different batches at once could both have a key.
    """
    spark = df.sparkSession
    _, at, fc = _file_context(spark, path)
    if fc.util().exists(at(path)):
        have = spark.read.option("recursiveFileLookup", True).parquet(*others) if (others := [
            s.getPath().toString() for s in fc.util().listStatus(at(path)) if s.getPath().getName().startswith("batch=") and s.getPath().getName() != f"batch={batch}"]) else None
        df = df if have is None else df.join(have.select(*keys).distinct(), list(keys), "left_anti")
    df.write.mode("overwrite").parquet(f"{path}/batch={batch}")
