"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import settle  # noqa: F401  (re-exported)

SPACES = " \t\n\x0b\x0c\r"  # what separates words in every contract
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(doc_id: Column) -> Column:
    """crc32 of an id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))


def ascii_lower(c: Column) -> Column:
    """A-Z only: other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def texts_of(column: pa.Array) -> list[str]:
    """Texts of an Arrow column; a missing text is empty."""
    return [t or "" for t in column.to_pylist()]


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 512, size: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of at most ``rows`` rows and some ``size`` bytes: bounds what a worker holds as objects.

    Rows are taken as equally long inside pieces of 16, so only a text that is long by itself makes a batch larger.
    """
    for batch in batches:
        at, held = 0, 0
        for upto in range(0, len(batch), 16):
            n = batch.slice(upto, 16).nbytes
            if upto > at and (held + n > size or upto - at >= rows):
                yield batch.slice(at, upto - at)
                at, held = upto, 0
            held += n
        if at < len(batch):
            yield batch.slice(at)


def short_batches(spark, rows: int = 1000) -> None:
    """Fewer rows in an Arrow batch than Spark's 10,000: documents are long rows, and both sides hold whole batches."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))


def rowwise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row at a time, for rows that are large by design."""
    for batch in batches:
        for at in range(len(batch)):
            yield batch.slice(at, 1)


def without(df: DataFrame, *names: str) -> DataFrame:
    """``df`` without columns of these names in any case: outputs replace inputs of their name."""
    low = {n.lower() for n in names}
    return df.drop(*[c for c in df.columns if c.lower() in low])


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names, so that extra columns cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def owned(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A copy: columns picked from a received batch keep all of it in memory, the texts too."""
    return batch.take(pa.array(np.arange(len(batch))))


def give_back() -> None:
    """Return freed memory to the system: workers wait for their next task and would keep the peak of the last one."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def trimmed(work):
    """The same function of batches, which gives freed memory back when a task is done."""
    @functools.wraps(work)
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from work(batches)
        give_back()
    return run


def worker_cache() -> dict:
    """Lives as long as the Python worker: tokenizers and piece caches outlast a task."""
    import sys
    import types
    return sys.modules.setdefault("_cohortlens_worker_cache", types.ModuleType("_cohortlens_worker_cache")).__dict__
