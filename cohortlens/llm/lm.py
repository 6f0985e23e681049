"""Language-model scores by deleted interpolation.

Maximum-likelihood estimates of all orders are mixed by weights that depend on how often the context was
seen (buckets by powers of two). The weights are learned by expectation-maximisation on counts of documents
left out of the estimates; the final model has the same weights over the counts of all training documents.

Counting and look-up share one shuffle. Documents are cut into blocks; a block sends the distinct n-grams
it has, with its own counts, as sorted packed key ranges; each range is summed over all blocks in one place
and the totals go back to the blocks that asked. So an n-gram moves once for each block, however
frequent it is, and a range holds as many keys as ``ranges`` allows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, settle, table, texts_of
from .packing import Index, pack_batch, pack_ints, pack_words, unpack_batch, unpack_ints, unpack_words

BLOCK = 2_000_000  # tokens of a block: bounds the memory of a task
SCORED, COUNTED, DELETED = 0, 1, 2  # parts: not learned from; counted for estimates; counted for the weights
PAD, END = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # keys of the start and the end of a text
RESERVED = {b"": 0, b" ": 1}  # numbers of the start and the end: neither is a word
GRID = 8  # steps of a factor two in which likelihood ratios are tallied for the weights
NEVER = -10_000  # tally of an estimate that is zero
BUCKETS = 48


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (a published generator)."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def key_table(words: list[bytes]) -> np.ndarray:
    """Keys of a block's tokens: the start, the end, then its words."""
    return np.array([PAD, END, *map(xxhash.xxh64_intdigest, words)], np.uint64)


def ngram_keys(codes: np.ndarray, keys: np.ndarray, order: int) -> Iterator[np.ndarray]:
    """For n = 1..order the key of the n-gram that ends at each position; all start positions have one key an order."""
    last = single = keys[codes]
    yield single
    start = np.flatnonzero(codes == 0)
    for n in range(2, order + 1):
        with np.errstate(over="ignore"):
            last = np.concatenate([[np.uint64(PAD)], last[:-1]]) * np.uint64(0xD6E8FEB86659FD93)
            last += single
            last = mix(last)
            last[start] = np.uint64(PAD + n)
        yield last


def blocks_of(df: DataFrame, text: str, part: str, keep: list[str]) -> DataFrame:
    """One row for each block: its distinct words, the documents as numbers into them (0 starts, 1 ends a text), parts and columns."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n_block = TaskContext.get().partitionId(), 0
        index, codes, parts, rows, held = Index(RESERVED), [], [], [], 0

        def flush() -> pa.RecordBatch:
            words = pack_words(list(index)[len(RESERVED):])
            sizes = np.array([len(c) for c in codes], np.uint32)
            block = xxhash.xxh64_intdigest(b"%d %d " % (task, n_block) + words + sizes.tobytes()) - (1 << 63)
            body = pa.Table.from_batches(rows).combine_chunks().to_batches()[0]
            values = [block, words, pack_ints(np.concatenate(codes)), pack_ints(sizes), bytes(parts), pack_batch(body)]
            kinds = [pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds)], names=["block", "words", "codes", "sizes", "parts", "rows"])

        for batch in batches:
            columns, at = batch.select([f"k{i}" for i in range(len(keep))]), 0
            part_of = batch.column("part").to_pylist()
            for i in range(len(batch)):
                words = (batch.column("text")[i].as_py() or "").encode().lower().split()
                code = np.empty(len(words) + 2, np.uint32)
                code[0], code[-1] = 0, 1
                code[1:-1] = [index[w] for w in words]
                codes.append(code)
                parts.append(part_of[i])
                held += len(code)
                if held >= BLOCK:
                    rows.append(columns.slice(at, i + 1 - at))
                    yield flush()
                    index, codes, parts, rows, held, at, n_block = Index(RESERVED), [], [], [], 0, i + 1, n_block + 1
            if at < len(columns):
                rows.append(columns.slice(at))
        if codes:
            yield flush()

    plain = df.select(*[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)], F.col(f"`{part}`").cast("int").alias("part"), F.col(f"`{text}`").alias("text"))
    return plain.mapInArrow(cut, "block long, words binary, codes binary, sizes binary, parts binary, rows binary")


def opened(row: dict, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, Iterator[np.ndarray]]:
    """Codes, sizes, part of each position, and n-gram keys of a block."""
    codes, sizes = unpack_ints(row["codes"]), unpack_ints(row["sizes"])
    keys = key_table(unpack_words(row["words"]).to_pylist())
    return codes, sizes, np.repeat(np.frombuffer(row["parts"], np.uint8), sizes), ngram_keys(codes, keys, order)


def ranges_of(keys: np.ndarray, ranges: int) -> np.ndarray:
    """Where each of the equal key ranges begins in sorted keys, and the end."""
    width = (1 << 64) // ranges + 1
    return np.concatenate([np.searchsorted(keys, np.array([r * width for r in range(ranges)], np.uint64)), [len(keys)]])


def request(order: int, ranges: int):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                _, _, part, grams = opened(row, order)
                for n, keys in enumerate(grams, 1):
                    found, at = np.unique(keys, return_inverse=True)
                    a = np.bincount(at[part == COUNTED], minlength=len(found)).astype(np.uint32)
                    b = np.bincount(at[part == DELETED], minlength=len(found)).astype(np.uint32)
                    cuts = ranges_of(found, ranges).tolist()
                    out = [(row["block"], n, r, pack_ints(np.diff(found[x:y], prepend=np.uint64(0))), pack_ints(a[x:y]), pack_ints(b[x:y]))
                           for r, (x, y) in enumerate(zip(cuts, cuts[1:])) if y > x]
                    kinds = [pa.int64(), pa.int32(), pa.int32(), *[pa.binary()] * 3]
                    yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out), kinds)], names=["block", "n", "range", "keys", "a", "b"])
    return send


def answer(asked: pa.Table) -> pa.Table:
    """Totals over all blocks for one key range of one order, in the order of each request.

    ``types`` counts the learned n-grams that this row is the first to have, so its sum counts each once.
    """
    keys = [np.cumsum(unpack_ints(k, np.uint64), dtype=np.uint64) for k in asked.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    found, first, at = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    totals = []
    for column in ("a", "b"):
        own = np.concatenate([unpack_ints(x) for x in asked.column(column).to_pylist()])
        totals.append(np.bincount(at, weights=own, minlength=len(found)).astype(np.uint64))
    learned = first[(totals[0] + totals[1]) > 0]
    ends = np.cumsum(sizes)
    types = np.bincount(np.searchsorted(ends, learned, "right"), minlength=len(sizes))
    back = [at[e - s:e] for e, s in zip(ends.tolist(), sizes)]
    return pa.table({"block": asked.column("block"), "n": asked.column("n"), "range": asked.column("range"),
                     "a": pa.array([pack_ints(totals[0][x]) for x in back], pa.binary()), "b": pa.array([pack_ints(totals[1][x]) for x in back], pa.binary()),
                     "types": pa.array(types, pa.int64())})


def resolved(df: DataFrame, text: str, part: str, keep: list[str], order: int, ranges: int) -> DataFrame:
    """Blocks with the corpus counts of their n-grams, written once: the weights and the scores both read them."""
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    dealt = blocks_of(df, text, part, keep).repartition(n, "block")  # one exchange for both branches
    asked = dealt.mapInArrow(request(order, ranges), "block long, n int, range int, keys binary, a binary, b binary")
    told = asked.groupBy("n", "range").applyInArrow(answer, "block long, n int, range int, a binary, b binary, types long")
    per_block = told.groupBy("block").agg(F.collect_list(F.struct("n", "range", "a", "b", "types")).alias("counts"))
    return settle(dealt.join(per_block, "block", "left").select("*", F.size("counts").alias("n_counts")))


def counts_of(row: dict, grams: Iterator[np.ndarray], names: tuple[str, ...]) -> list[np.ndarray]:
    """For each order the count, over the parts ``names``, of the n-gram at each position."""
    out = []
    for n, keys in enumerate(grams, 1):
        mine = sorted((c for c in row["counts"] or [] if c["n"] == n), key=lambda c: c["range"])
        found, at = np.unique(keys, return_inverse=True)
        total = sum(np.concatenate([unpack_ints(c[name], np.uint64) for c in mine] or [np.empty(0, np.uint64)]) for name in names)
        if len(total) != len(found):
            raise RuntimeError("a block came back incomplete: its rows were replayed in another order; write the input as a table first")
        out.append(total.astype(np.float64)[at])
    return out


def stretches(counts: list[np.ndarray], total: float, vocabulary: int, size: int = 200_000) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """``estimates`` of some positions at a time: (from, to, estimates, buckets)."""
    for lo in range(0, len(counts[0]), size):
        before = min(lo, 1)  # the position before holds the context
        f, bucket = estimates([c[lo - before:lo + size] for c in counts], total, vocabulary)
        yield lo, min(lo + size, len(counts[0])), f[before:], bucket[before:]


def estimates(counts: list[np.ndarray], total: float, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximum-likelihood estimates (columns: uniform, order 1, 2, ...) and the bucket of the longest context at each position.

    A context never seen gives 0 at its order. The value at a start position means nothing.
    """
    f = [np.full(len(counts[0]), 1.0 / (vocabulary + 1)), counts[0] / max(total, 1.0)]
    context = np.zeros(len(counts[0]))
    for n in range(1, len(counts)):
        context = np.concatenate([[0.0], counts[n - 1][:-1]])
        f.append(np.divide(counts[n], context, out=np.zeros_like(context), where=context > 0))
    return np.stack(f, 1), np.minimum(np.ceil(np.log2(context + 1)), BUCKETS - 1).astype(np.int64)


def tally(order: int, total: float, vocabulary: int):
    """Counts of (bucket, log ratio of each estimate to the uniform one on a fine grid) over the deleted documents."""
    names = [f"q{n}" for n in range(1, order + 1)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                codes, _, part, grams = opened(row, order)
                used = (part == DELETED) & (codes != 0)
                if not used.any():
                    continue
                for lo, hi, f, bucket in stretches(counts_of(row, grams, ("a",)), total, vocabulary):
                    take = used[lo:hi]
                    with np.errstate(divide="ignore"):
                        q = np.where(f[take, 1:] > 0, np.rint(GRID * np.log2(f[take, 1:] * (vocabulary + 1))), NEVER).astype(np.int64)
                    cells, n = np.unique(np.column_stack([bucket[take], q]), axis=0, return_counts=True)
                    yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in cells.T], pa.array(n.astype(np.int64))], names=["bucket", *names, "n"])
    return count, ", ".join(f"{c} long" for c in ["bucket", *names, "n"])


def weights(cells: np.ndarray, order: int, rounds: int = 50) -> np.ndarray:
    """Mixture weights (bucket x estimate) by expectation-maximisation over tallied cells (bucket, q1.., n).

    A bucket without held-out counts has the weights of the nearest lower bucket that has some, at first even ones.
    """
    out = np.full((BUCKETS, order + 1), 1.0 / (order + 1))
    for b in range(BUCKETS):
        mine = cells[cells[:, 0] == b] if len(cells) else cells
        if not len(mine):
            out[b] = out[b - 1] if b else out[b]
            continue
        ratio = np.concatenate([np.ones((len(mine), 1)), np.where(mine[:, 1:-1] == NEVER, 0.0, np.exp2(mine[:, 1:-1] / GRID))], 1)
        n, w = mine[:, -1].astype(np.float64), out[b].copy()
        for _ in range(rounds):
            share = ratio * w
            share *= (n / share.sum(1))[:, None]
            w = share.sum(0) / n.sum()
        w = np.maximum(w, 1e-6)  # a weight of nothing would forbid what the sample happened not to have
        out[b] = w / w.sum()
    return out


def scores(order: int, total: float, vocabulary: int, lam: np.ndarray):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1).to_pylist()[0]
                codes, sizes, _, grams = opened(row, order)
                both, p = counts_of(row, grams, ("a", "b")), np.empty(len(codes))
                for lo, hi, f, bucket in stretches(both, total, vocabulary):
                    p[lo:hi] = np.log10(np.einsum("ij,ij->i", f, lam[bucket]))
                real = codes != 0
                doc = np.repeat(np.arange(len(sizes)), sizes)[real]
                summed = lambda x: np.bincount(doc, weights=x[real], minlength=len(sizes))
                base = np.log10((both[0] + 0.5) / (total + 0.5 * (vocabulary + 1)))
                rows = unpack_batch(row["rows"])
                made = [pa.array(sizes.astype(np.int64) - 1), pa.array(summed(both[0] > 0).astype(np.int64)), pa.array(summed(base)), pa.array(summed(p))]
                yield pa.RecordBatch.from_arrays([*rows.columns, *made], names=[*rows.schema.names, "n_tokens", "n_known", "base_score", "score"])
    return score


def score_texts(df: DataFrame, text: str, part: str, keep: list[str] | None = None, order: int = 2, ranges: int | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``.

    Tokens: A-Z lower-cased words and one end. ``part`` says what a row is for: SCORED, COUNTED or DELETED; all rows are
    scored. A missing text is empty and has its end alone. Repeated rows count as often as they come. Without any
    training text all estimates but the uniform one are 0. Input columns named like an output are replaced.
    """
    ours = ("n_tokens", "n_known", "train_tokens", "base_score", "score")
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ours]
    spark = df.sparkSession
    ranges = ranges or 2 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    blocks = resolved(df, text, part, keep, order, ranges)
    types = blocks.select(F.explode("counts").alias("c")).filter("c.n = 1").agg(F.coalesce(F.sum("c.types"), F.lit(0))).head()[0]
    learned = df.filter(F.col(f"`{part}`").isin(COUNTED, DELETED))
    trained = learned.head(1) != []
    vocabulary = types - 1 if trained else 0  # the start is no token

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts, sizes in zip(batch.column("parts").to_pylist(), batch.column("sizes").to_pylist()):
                n = np.bincount(np.frombuffer(parts, np.uint8), weights=unpack_ints(sizes).astype(np.int64) - 1, minlength=3).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([int(n[COUNTED])]), pa.array([int(n[DELETED])])], names=["a", "b"])
    a, b = blocks.select("parts", "sizes").mapInArrow(lengths, "a long, b long").agg(F.coalesce(F.sum("a"), F.lit(0)), F.coalesce(F.sum("b"), F.lit(0))).head()
    count, schema = tally(order, float(a), vocabulary)
    names = schema.replace(" long", "").split(", ")
    cells = blocks.mapInArrow(count, schema).groupBy(*names[:-1]).agg(F.sum("n").alias("n")).toArrow()  # bounded by the grid, not by the corpus
    lam = weights(np.column_stack([c.to_numpy() for c in cells.columns]).reshape(-1, order + 2), order)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    out = T.StructType([*[T.StructField(f"k{i}", kinds[c]) for i, c in enumerate(keep)], T.StructField("n_tokens", T.LongType()),
                        T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())])
    scored = blocks.mapInArrow(scores(order, float(a + b), vocabulary, lam), out)
    return scored.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", F.lit(a + b).cast("long").alias("train_tokens"), "base_score", "score")


def op5_interpolated_lm(spark, sf_dir: str) -> DataFrame:
    fold = crc_of_id(F.col("doc_id")) % 5
    part = F.when(fold == 1, SCORED).when(fold == 2, DELETED).otherwise(COUNTED)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold == 1).alias("held_out"), part.alias("part"))
    return score_texts(docs, "text", "part", keep=["doc_id", "held_out"]).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
