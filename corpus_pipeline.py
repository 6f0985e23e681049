"""From raw documents to token ids: quality, language, near-duplicates, benchmark leaks, byte-level BPE.

Every stage takes the documents that the one before kept, written and read again, and works on all of them.
Rows without a doc_id pass the stages that decide by id; rows of one doc_id share its fate there.
"""

from __future__ import annotations

import os
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.llm import bpe, decontaminate, langid, neardup, quality
from cohortlens.llm.common import short_batches
from cohortlens.session import shared_dir

LANGUAGE_SCORE = 0.4  # a language that holds less than this of a text is no identification


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents that fail the base rules or are mostly boilerplate lines."""
    short_batches(spark)
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    verdict = quality.judge(docs.withColumn("__text", F.col("text")), "__text", model, keep=docs.columns)
    return verdict.filter("kept").select(*docs.columns)


def keep_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in which no language can be identified."""
    short_batches(spark)
    found = langid.predict(docs, "text", langid.learned_from(docs), keep=docs.columns)
    return found.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LANGUAGE_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group linked by five-word shingles at similarity 0.8."""
    short_batches(spark)
    gone = neardup.cluster(docs, "doc_id", "text", width=5).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    leaks = decontaminate.leaks(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each document, and whether they decode to its text."""
    short_batches(spark)
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = f.read()
    texts = docs.select("doc_id", "lang", "source", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"), "text")
    both = bpe.decode(bpe.encode(texts, "text", ranks, keep=["doc_id", "lang", "source", "text_sha256"]), "ids", ranks)
    return both.select("doc_id", "lang", "source", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), "ids", "text_sha256",
                       (F.sha2("decoded", 256) == F.col("text_sha256")).alias("round_trip"))


STAGES = [("quality rules", keep_quality), ("language identification", keep_language), ("near-duplicates", drop_near_duplicates),
          ("benchmark decontamination", drop_benchmark_leaks), ("byte-level BPE", encode_tokens)]

#: Neither the random field nor the byte-pair merges have a reasonable form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    base = os.path.join(shared_dir(spark), f"corpus-pipeline-{uuid.uuid4().hex}")
    for i, (_, stage) in enumerate(STAGES):
        path = f"{base}/{i}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
