"""Byte-level BPE: every distinct pre-token is encoded once, for the whole corpus.

Documents are cut into pre-tokens inside blocks of some millions. A block keeps, for each document, the
positions as numbers into its own list of distinct pre-tokens; those lists are exploded and shuffled by
pre-token, sorted, and each distinct one is encoded once. The ids go back to the blocks packed, and the
documents are put together by position. So a pre-token crosses the shuffle once for each block instead of
once for each position, and a frequent one has as many rows as there are blocks.

Ids are kept as little-endian unsigned 32-bit integers in a binary column, the form of token shards.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import owned, rowwise, short_batches, sliced, table, trimmed, worker_cache
from .packing import Index, grouped, pack_batch, pack_ints, pack_words, unpack_batch, unpack_ints, unpack_words

BLOCK = 7_000_000  # pre-tokens of a block: bounds the memory of a task, not the result
GATHERED = 300_000  # encoded pre-tokens held before they are packed for their blocks
VOCABULARY = 1_000_000  # entries of a rank file; larger ones are refused, as the table is sent to every worker
BLOCK_ROWS = "block long, n_words int, words binary, codes binary, sizes binary, rows binary"


def read_ranks(file: bytes) -> dict[bytes, int]:
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file.splitlines() if line.strip())}
    if len(ranks) > VOCABULARY:
        raise ValueError(f"{len(ranks)} ranks; at most {VOCABULARY} are sent along")
    return ranks


def encoder(file: bytes, pattern: str) -> tiktoken.Encoding:
    cache = worker_cache()
    if cache.get("encodes_by") != (file, pattern):
        cache["encoder"] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(file), special_tokens={})
        cache["encodes_by"] = (file, pattern)
    return cache["encoder"]


def blocks_of(df: DataFrame, text: str, keep: list[str], pattern: str) -> DataFrame:
    """One row for each block: its distinct pre-tokens, the documents as numbers into them, and their ``keep`` columns.

    The block's id covers its place and its pre-tokens in order. Where a lost task is run again over rows in another
    order, ids differ and the join of ``encode`` finds parts missing and fails, instead of mixing two versions.
    """
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, part, n_block = regex.compile(pattern).findall, TaskContext.get().partitionId(), 0
        index, codes, rows, held = Index(), [], [], 0

        def flush() -> pa.RecordBatch:
            sizes, code = np.array([len(c) for c in codes], np.uint32), np.concatenate(codes)
            codes.clear()
            order = np.argsort(-np.bincount(code, minlength=len(index)), kind="stable")  # frequent ones get small numbers
            rank = np.empty(len(index), np.uint32)
            rank[order] = np.arange(len(index), dtype=np.uint32)
            distinct = [w.encode() for w in index]
            words = pack_words([distinct[i] for i in order.tolist()])
            block = xxhash.xxh64_intdigest(b"%d %d " % (part, n_block) + words + sizes.tobytes()) - (1 << 63)
            body = pa.Table.from_batches(rows).combine_chunks().to_batches()
            row = [[block], [len(index)], [words], [pack_ints(rank[code])], [pack_ints(sizes)], [pack_batch(body[0])]]
            kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds)], names=["block", "n_words", "words", "codes", "sizes", "rows"])

        for batch in batches:
            columns, at = batch.select([f"k{i}" for i in range(len(keep))]), 0
            for i in range(len(batch)):
                pieces = find(batch.column("text")[i].as_py() or "")
                codes.append(np.fromiter(map(index.__getitem__, pieces), np.uint32, len(pieces)))
                held += len(pieces)
                if held >= BLOCK:
                    rows.append(owned(columns.slice(at, i + 1 - at)))
                    yield flush()
                    index, codes, rows, held, at, n_block = Index(), [], [], 0, i + 1, n_block + 1
            if at < len(columns):
                rows.append(owned(columns.slice(at)))
        if codes:
            yield flush()

    plain = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(trimmed(cut), BLOCK_ROWS)


def explode_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rowwise(batches):
        for row in batch.to_pylist():
            words = unpack_words(row["words"])
            for at in range(0, len(words), 100_000):
                some = words.slice(at, 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), row["block"])), pa.array(np.arange(at, at + len(some), dtype=np.int32)), some],
                                                 names=["block", "local", "word"])


def encode(df: DataFrame, text: str, file: bytes, pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None, out: str = "ids") -> DataFrame:
    """Columns ``keep`` (all by default) with ``out``: the ids of the whole text under the rank file, without special tokens.

    A missing or empty text has no ids. Repeated rows stay. An input column named ``out`` is replaced. ``df`` should
    be a table read from files: a plan that gives its rows in another order when run again fails after a lost executor.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(file)

    def encode_sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(shared.value, pattern)
        last, ids = None, None
        blocks, locals_, found, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            block, local = np.concatenate(blocks), np.concatenate(locals_)
            order = np.lexsort((local, block))
            block, local = block[order], local[order].astype(np.uint32)
            rows = []
            for a, b in grouped(block):
                some = [found[i] for i in order[a:b].tolist()]
                rows.append((int(block[a]), pack_ints(np.diff(local[a:b], prepend=np.uint32(0))), pack_ints(np.array([len(x) for x in some], np.uint32)),
                             pack_ints(np.concatenate(some))))
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*rows), kinds)], names=["block", "locals", "lens", "ids"])

        for batch in batches:
            for word in batch.column("word").to_pylist():
                if word != last:
                    last, ids = word, np.array(enc.encode_ordinary(word.decode()), np.uint32)
                found.append(ids)
            blocks.append(batch.column("block").to_numpy(zero_copy_only=False))
            locals_.append(batch.column("local").to_numpy(zero_copy_only=False))
            held += len(batch)
            if held >= GATHERED:
                yield flush()
                blocks, locals_, found, held = [], [], [], 0
        if held:
            yield flush()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rowwise(batches):
            for row in batch.to_pylist():
                parts = row["parts"] or []
                local = np.concatenate([np.cumsum(unpack_ints(p["locals"]), dtype=np.uint32) for p in parts] or [np.empty(0, np.uint32)])
                if len(local) != row["n_words"]:
                    raise RuntimeError("a block came back incomplete: its rows were replayed in another order; write the input as a table first")
                some = np.concatenate([unpack_ints(p["lens"]) for p in parts] or [local])
                flat = np.concatenate([unpack_ints(p["ids"]) for p in parts] or [local])
                lens, starts = np.empty(len(local), np.int64), np.empty(len(local), np.int64)
                lens[local], starts[local] = some, np.cumsum(some, dtype=np.int64) - some
                codes, sizes, rows = unpack_ints(row["codes"]), unpack_ints(row["sizes"]), unpack_batch(row["rows"])
                ends, done = np.cumsum(sizes, dtype=np.int64), 0
                while done < len(sizes):  # some documents at a time
                    first = int(ends[done - 1]) if done else 0
                    upto = max(done + 1, int(np.searchsorted(ends, first + 200_000, "right")))
                    code = codes[first:int(ends[upto - 1])]
                    n = lens[code]
                    stop = np.cumsum(n)
                    tokens = flat[np.repeat(starts[code] - stop + n, n) + np.arange(int(n.sum()))]
                    at = np.concatenate([[0], stop])[np.concatenate([[first], ends[done:upto]]) - first]
                    col = pa.array([tokens[a:b].tobytes() for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())
                    yield pa.RecordBatch.from_arrays([*rows.slice(done, upto - done).columns, col], names=[*rows.schema.names, "__ids"])
                    done = upto

    blocks = blocks_of(df, text, keep, pattern)
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = blocks.repartition(n, "block")  # both branches below read this one exchange
    words = dealt.mapInArrow(trimmed(explode_words), "block long, local int, word binary").repartition(n, "word").sortWithinPartitions("word")
    parts = words.mapInArrow(trimmed(encode_sorted), "block long, locals binary, lens binary, ids binary")
    joined = dealt.join(parts.groupBy("block").agg(F.collect_list(F.struct("locals", "lens", "ids")).alias("parts")), "block", "left")
    kinds = {f.name: f for f in df.schema.fields}
    schema = T.StructType([T.StructField(f"k{i}", kinds[c].dataType) for i, c in enumerate(keep)] + [T.StructField("__ids", T.BinaryType())])
    return joined.mapInArrow(trimmed(assemble), schema).select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("__ids").alias(out))


def decode(df: DataFrame, ids: str, file: bytes, keep: list[str] | None = None, out: str = "decoded") -> DataFrame:
    """Columns ``keep`` (all by default) with ``out``: the bytes that the ids stand for.

    Ids meet the token-byte table inside the tasks: the table has as many rows as the vocabulary and goes to every
    worker. Bytes may fall short of UTF-8 where ids were cut; an id outside the table is an error; null gives null.
    """
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() != out.lower()]
    shared = df.sparkSession.sparkContext.broadcast(file)

    def join_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = worker_cache()
        if cache.get("decodes_by") != shared.value:
            cache["bytes_of"], cache["decodes_by"] = {i: b for b, i in read_ranks(shared.value).items()}, shared.value
        bytes_of = cache["bytes_of"].__getitem__
        for batch in sliced(batches):
            some = [None if x is None else b"".join(map(bytes_of, np.frombuffer(x, "<u4").tolist())) for x in batch.column("__ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(some, pa.binary())], names=[*keep, "__decoded"])

    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{ids}`").alias("__ids"))
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("__decoded", T.BinaryType())])
    return rows.mapInArrow(trimmed(join_bytes), schema).withColumnRenamed("__decoded", out)


def ids_array(ids: str):
    """The ids of a binary column as an array of long."""
    @F.pandas_udf("array<long>")
    def unpack(values):
        return values.map(lambda x: None if x is None else np.frombuffer(x, "<u4").astype(np.int64))
    return unpack(ids)


def digests(docs: DataFrame, path: str) -> DataFrame:
    short_batches(docs.sparkSession)
    file = open(path, "rb").read()
    encoded = encode(docs, "text", file, keep=["doc_id"])
    both = decode(encoded, "ids", file)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                       F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
