"""Sharding by jump consistent hashing (Lamping and Veach, 2014): no ring table, and one more shard takes rows only into itself.

``assign`` adds the shard to any table as a map over rows. ``numbered`` gives gapless places inside
shards from counts alone, so no shard is ever sorted in one task. ``write_shards`` lays the rows out.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, table, without

MULTIPLIER = 2862933555777941757  # fixed value of the published generator
SHARDS = 8


def jump(keys: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each unsigned 64-bit key; rows leave the loop as their jump passes the last shard."""
    key = keys.astype(np.uint64)
    at = np.zeros(len(key), np.int64)
    live = np.arange(len(key))
    with np.errstate(over="ignore"):
        while len(live):
            k = key[live] * np.uint64(MULTIPLIER) + np.uint64(1)
            key[live] = k
            to = ((at[live] + 1) * (2147483648.0 / ((k >> np.uint64(33)).astype(np.float64) + 1.0))).astype(np.int64)
            inside = to < shards
            live = live[inside]
            at[live] = to[inside]
    return at


def key_of(c: Column, kind: T.DataType) -> Column:
    """64-bit key: integers as they are, other types by a stable hash; a missing key counts as 0."""
    number = c.cast("long") if isinstance(kind, T.IntegralType) else F.xxhash64(c)
    return F.when(c.isNull(), F.lit(0).cast("long")).otherwise(number)


def shard_of(key: Column, shards: int) -> Column:
    @F.pandas_udf("int")
    def place(k: pd.Series) -> pd.Series:
        return pd.Series(jump(k.to_numpy().astype(np.int64).view(np.uint64), shards).astype(np.int32))
    return place(key)


def assign(df: DataFrame, key: str, shards: int = SHARDS) -> DataFrame:
    """``df`` with ``shard`` and ``grown_shard`` (with one shard more). Rows with equal keys share a shard.

    A missing key counts as key 0. Input columns named like an output are replaced; an empty table gives none.
    """
    if shards < 1:
        raise ValueError("at least one shard is needed")
    k = key_of(F.col(f"`{key}`"), df.schema[key].dataType)
    out = df.select("*", shard_of(k, shards).alias("__shard"), shard_of(k, shards + 1).alias("__grown"))
    return without(out, "shard", "grown_shard").withColumnsRenamed({"__shard": "shard", "__grown": "grown_shard"})


def numbered(df: DataFrame, columns: list[str], shard: str = "shard", buckets: int = 4096, chunk: int = 1 << 20) -> DataFrame:
    """Rows of ``columns`` (with ``shard``) and ``slot``: places 0, 1, ... inside each shard.

    Equal rows are first counted, so a row repeated any number of times is one group of the window;
    their places come back as ranges of at most ``chunk`` places. The order inside a shard is by a
    hash bucket, then by the columns. ``buckets`` grows with the table: rows / shards / buckets is a window's size.
    """
    same = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
    digest = F.md5(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))
    cut = same.withColumn("__b", F.conv(F.substring(digest, 1, 6), 16, 10).cast("int") % F.lit(buckets))
    upto = Window.partitionBy(shard, "__b").orderBy(*columns).rowsBetween(Window.unboundedPreceding, -1)
    placed = cut.withColumn("__at", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    sizes = cut.groupBy(shard, "__b").agg(F.sum("__n").alias("__size"))
    before = Window.partitionBy(shard).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(shard, "__b", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__off"))
    start = placed.join(offsets, [shard, "__b"]).select(*columns, "__n", (F.col("__at") + F.col("__off")).alias("__from"))
    pieces = start.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(__n - 1) div {chunk}"))).alias("__c"))
    place = F.sequence(F.col("__c") * chunk, F.least((F.col("__c") + 1) * chunk, F.col("__n")) - 1)
    return pieces.select(*columns, "__from", F.explode(place).alias("__i")).select(*columns, (F.col("__from") + F.col("__i")).alias("slot"))


def write_shards(df: DataFrame, key: str, path: str, shards: int = SHARDS, tasks_per_shard: int = 8) -> None:
    """Write rows below ``shard=N`` folders; a shard is dealt to several tasks, so a hot shard is not one file."""
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), F.lit(tasks_per_shard))
    out = assign(df, key, shards).drop("grown_shard")
    out.repartition(shards * tasks_per_shard, "shard", deal).write.partitionBy("shard").parquet(path)


def op2_jump_sharding(spark, sf_dir: str) -> DataFrame:
    docs = pick(table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    text = F.coalesce("text", F.lit(""))
    sized = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    columns = ["doc_id", "size", "text_crc32", "shard", "grown_shard"]
    rows = numbered(assign(sized, "doc_id"), columns)
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
