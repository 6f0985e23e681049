"""Streams: growing run trees, failure ledgers, resumable measurements.

Every sink is idempotent: a batch that is replayed after a loss writes the same rows to the same
place, so results are exactly once with checkpoint and file source.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.prefix import null_safe_join
from ..operators import metrics as m
from ..session import settle

PREDICTIONS = "run string, subject string, row_id bigint, label bigint, score double"


def fresh(batch: DataFrame, number: int, stored: str, keys) -> DataFrame:
    """Rows of a batch whose keys no earlier batch stored, one per key (the smallest), written under the batch's number.

    However late a row lands it is compared with everything stored, so nothing is dropped unseen. A replayed batch
    sees the same earlier batches and writes the same rows again.
    """
    keys = list(keys)
    rest = [c for c in batch.columns if c not in keys]
    rows = batch.select(*keys, F.struct(*rest).alias("__r"), F.lit(False).alias("__had"))
    if number > 0:  # stored keys go through the same shuffle as the batch's rows, no join is needed
        have = batch.sparkSession.read.parquet(stored).filter(F.col("batch") < number).select(*keys)
        rows = rows.unionByName(have.select(*keys, F.lit(None).cast(rows.schema["__r"].dataType).alias("__r"), F.lit(True).alias("__had")))
    rows = rows.repartition(*keys).groupBy(*keys).agg(F.min("__r").alias("__r"), F.count("__r").alias("n_landed"), F.max("__had").alias("__had"))
    rows = settle(rows.filter("n_landed > 0").select(*keys, "__r.*", "n_landed", "__had"))
    path = os.path.join(stored, f"batch={number}")
    kept = rows.withColumn("n_refused", F.col("n_landed") - 1)
    kept.filter("NOT __had").drop("__had", "n_landed").write.mode("overwrite").parquet(path)
    again = rows.filter("__had").agg(F.coalesce(F.sum("n_landed"), F.lit(0)).alias("n_known_again"))
    again.write.mode("overwrite").parquet(os.path.join(stored + "-refused", f"batch={number}"))
    return batch.sparkSession.read.parquet(path).drop("n_refused")


def refused(spark: SparkSession, stored: str) -> int:
    """How many landed rows repeated a key: within their batch, or of an earlier one."""
    inside = spark.read.parquet(stored).agg(F.coalesce(F.sum("n_refused"), F.lit(0))).head()[0]
    return inside + spark.read.parquet(stored + "-refused").agg(F.coalesce(F.sum("n_known_again"), F.lit(0))).head()[0]


def run_ingest(spark: SparkSession, landing: str, counts: str, checkpoint: str, keys=("run",), files_per_trigger=16):
    """Score counts per (keys, score) of predictions that keep landing as JSON lines.

    A row that lands again, at any time, is refused and counted. Each batch adds its counts under its own
    number; counts add up, so ``live_auc`` over all batches is the AUC of everything seen.
    """
    src = spark.readStream.schema(PREDICTIONS).option("maxFilesPerTrigger", files_per_trigger).json(landing)

    def add(batch: DataFrame, number: int) -> None:
        new = fresh(batch, number, counts + "-rows", [*keys, "row_id"])
        m.score_counts(new, keys).write.mode("overwrite").parquet(os.path.join(counts, f"batch={number}"))

    return src.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def live_auc(spark: SparkSession, counts: str, keys=("run",)) -> DataFrame:
    c = spark.read.parquet(counts).groupBy(*keys, "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return m.auc_from_counts(c, keys)


def ledger_step(events: DataFrame, keys=("cohort", "control")) -> DataFrame:
    """Per key: the last begin, and failures and notes after it (or all, without one)."""
    keys = list(keys)
    last = events.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "begin", F.col("seq"))).alias("began"))
    j = null_safe_join(events, last, keys)
    after = F.col("seq") > F.coalesce("began", F.lit(-1))
    return j.groupBy(*keys).agg(F.max("began").alias("began"), F.count_if(after & (F.col("kind") == "fail")).alias("n_fail"),
                                F.count_if(after & (F.col("kind") == "note")).alias("n_note"), F.max("seq").alias("updated"))


def ledger_fold(events: DataFrame, keys=("cohort", "control")) -> DataFrame:
    """The events that can still matter: those from the last begin of their key on. Event order decides, not arrival."""
    keys = list(keys)
    last = events.groupBy(*keys).agg(F.max(F.when(F.col("kind") == "begin", F.col("seq"))).alias("__began"))
    kept = null_safe_join(events.distinct(), last, keys).filter(F.col("__began").isNull() | (F.col("seq") >= F.col("__began")))
    return kept.drop("__began")


def ledger_state(step: DataFrame) -> DataFrame:
    """attempted, failed and counts per key; a note alone is not a failure."""
    return step.withColumn("failed", F.col("n_fail") > 0).withColumn("attempted", F.lit(True))


LEDGER = "seq bigint, cohort string, control string, kind string"


def failure_ledger(spark: SparkSession, landing: str, state: str, checkpoint: str, files_per_trigger=1):
    """Events since the last begin per (cohort, control), a new version per batch; the version before it stays for a replay."""
    src = spark.readStream.schema(LEDGER).option("maxFilesPerTrigger", files_per_trigger).json(landing)

    def fold(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        events = batch if number == 0 else batch.unionByName(s.read.schema(batch.schema).parquet(os.path.join(state, f"version={number - 1}")))
        ledger_fold(events).write.mode("overwrite").parquet(os.path.join(state, f"version={number}"))
        old = s._jvm.org.apache.hadoop.fs.Path(os.path.join(state, f"version={number - 2}"))
        old.getFileSystem(s._jsc.hadoopConfiguration()).delete(old, True)

    return src.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_ledger(spark: SparkSession, state: str) -> DataFrame:
    d = spark.read.parquet(state)
    last = d.agg(F.max("version").alias("v")).first()["v"]
    return ledger_state(ledger_step(d.filter(F.col("version") == last).drop("version")))


MEASURES = "file string, slice bigint, value double"


def resumable_measure(spark: SparkSession, landing: str, out: str, checkpoint: str, measure, files_per_trigger=16):
    """Per-slice measurements, each once however often and late it lands; a restart continues from the checkpoint."""
    src = spark.readStream.schema(MEASURES).option("maxFilesPerTrigger", files_per_trigger).json(landing)

    def store(batch: DataFrame, number: int) -> None:
        fresh(batch.withColumn("measured", measure), number, out, ["file", "slice"])

    return src.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
