"""Session defaults and the shared folder used to cut lineage."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", name: str = "cohortlens") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own session."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]").appName(name)
        .config("spark.sql.shuffle.partitions", cores)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # small local inputs: keep all cores busy instead of merging shuffle partitions to one
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(master: str) -> bool:
    """One machine, so that its folders are everyone's (a local-cluster is none)."""
    return re.match(r"local(\[|$)", master) is not None


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a fresh temporary one only on a local master where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named is None and not is_local(spark.sparkContext.master):
        raise RuntimeError("executors do not share the driver's folders: name one that they do in spark.checkpoint.dir")
    if named is None:
        named = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of a table that several later plans read. A written table survives the
    loss of executors and still prunes columns, which cached blocks or an RDD checkpoint do not.
    """
    spark = df.sparkSession
    path = os.path.join(shared_dir(spark), f"cohortlens-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
