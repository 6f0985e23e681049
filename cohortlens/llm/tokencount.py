"""Token counts without a shuffle of pre-tokens.

Tier one: lengths (in tokens) of the pre-tokens that are frequent in the whole table, in one compact
broadcast of a fixed number of short entries. Tier two: a bounded cache in every Python worker, which
outlasts its tasks; what misses both is encoded by the library's own model, once per worker and cache
life. Which pre-tokens are frequent is counted over all texts, but only the most frequent of each task
leave it; tier one changes speed, never a count.
"""

from __future__ import annotations

import heapq
import json
from collections import Counter
from collections.abc import Iterator

import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import pick, settle, sliced, table, texts_of, worker_cache

FREQUENT = 1 << 16  # entries of tier one: with MAX_PIECE at most some 6 MB
MAX_PIECE = 64  # longer pre-tokens are left to tier two
TRACKED = 1 << 20  # pre-tokens a task counts at a time
CACHED = 1 << 20  # entries of a worker's cache
LONG = 1024


def byte_alphabet() -> str:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return "".join(chr(b if b in shown else next(rest)) for b in range(256))


class Lengths(dict):
    """Pre-token -> number of tokens; ``tier`` is the shared table, this dict the worker's cache."""

    def __init__(self, file: str):
        self.tokenizer = Tokenizer.from_str(file)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.model, self.alphabet, self.tier = self.tokenizer.model, byte_alphabet(), {}
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(public_tokenizers.PATTERN).findall

    def __missing__(self, piece: str) -> int:
        n = self.tier.get(piece)
        if n is None:
            if len(self) >= CACHED:
                self.clear()
            n = self[piece] = len(self.model.tokenize(piece.encode().decode("latin-1").translate(self.alphabet)))
        return n

    def of_text(self, text: str) -> int:
        if any(a in text for a in self.added):  # strings of added tokens: the library's own rules
            return len(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return sum(map(self.__getitem__, self.find(text)))


def check_byte_level(file: str) -> None:
    """Refuse files whose pre-tokens are not those of the pattern: their counts need another path."""
    spec = json.loads(file)
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not spec.get("normalizer")
    if not plain or model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        raise ValueError("not a plain byte-level BPE file")


def frequent_pieces(texts: DataFrame, size: int) -> DataFrame:
    """The ``size`` most frequent pre-tokens of column ``text`` (ties: smallest), from each task's own most frequent ones.

    A task keeps TRACKED counters and lets half of them go when they are full (lossy counting), then
    emits its ``size`` best, so the shuffle holds at most ``size`` short rows for each task.
    """
    def top(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, seen = regex.compile(public_tokenizers.PATTERN).findall, Counter()
        for batch in sliced(batches):
            for text in texts_of(batch.column("text")):
                seen.update(find(text))
                if len(seen) > TRACKED:
                    seen = Counter(dict(heapq.nlargest(TRACKED // 2, seen.items(), key=lambda x: (x[1], x[0]))))
        best = heapq.nlargest(size, ((n, p) for p, n in seen.items() if n > 1 and len(p) <= MAX_PIECE))
        yield pa.RecordBatch.from_pydict({"piece": pa.array([p for _, p in best], pa.string()), "n": pa.array([n for n, _ in best], pa.int64())})
    each = texts.select("text").mapInArrow(top, "piece string, n long")
    return each.groupBy("piece").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "piece").limit(size)


def count_tokens(df: DataFrame, text: str, path: str, keep: list[str] | None = None, frequent: int = FREQUENT, limit: int = LONG) -> DataFrame:
    """Columns ``keep`` (all by default) with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit`` tokens).

    Counts are the library's for whole texts, without begin or end tokens, truncation or padding; strings of
    added tokens inside a text count as the library's default has them. A missing or empty text has 0 tokens.
    Input columns named like an output are replaced. The file at ``path`` is read by the driver and sent along.
    """
    file = open(path).read()
    check_byte_level(file)
    # written first: collecting a top list directly would send every partition's own list to the driver
    pieces = [r.piece for r in settle(frequent_pieces(pick(df, text=text), frequent)).collect()]
    counter = Lengths(file)
    shared = df.sparkSession.sparkContext.broadcast((file, pieces, bytes(min(255, counter[p]) for p in pieces)))
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("n_bytes", "n_tokens", "over_limit")]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        file, pieces, sizes = shared.value
        if cache.get("counted_by") != file:
            cache["counted_by"], cache["lengths"] = file, Lengths(file)
        count = cache["lengths"]
        count.tier = {p: n for p, n in zip(pieces, sizes) if n < 255}
        for batch in sliced(batches):
            n = pa.array([count.of_text(t) for t in texts_of(batch.column("__text"))], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ["__n_bytes", *names]], n], names=["__n_bytes", *names, "__n_tokens"])

    content = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = df.select(F.octet_length(content).cast("long").alias("__n_bytes"), *[F.col(f"`{c}`") for c in names], content.alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("__n_tokens", T.LongType())])
    out = rows.mapInArrow(measure, schema)
    return out.select(*names, F.col("__n_bytes").alias("n_bytes"), F.col("__n_tokens").alias("n_tokens"), (F.col("__n_tokens") > limit).alias("over_limit"))


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), "text", public_tokenizers.path("byte_bpe_50k.json"), keep=["doc_id"])
