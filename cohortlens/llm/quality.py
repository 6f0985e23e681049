"""Quality rules: a linear-chain conditional random field labels each line content or boilerplate.

Each line with a word has a few binary features. The field has a weight for each feature and each pair of
neighbouring labels; it is fitted by gradient ascent on the likelihood of labelled documents (every line has
its document's label), and the best labelling of a document is found by Viterbi decoding. A document is kept
where enough of its words stand in content lines.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import pick, sliced, table, texts_of
from .packing import Index

SPACE, SYMBOLS, CAPITALS = b" \t\n\x0b\x0c\r", b"#*$%&|<>", bytes(range(65, 91))
FEATURES = ["words<4", "words<10", "words<30", "words>=30", "no symbols", "few symbols", "some symbols", "many symbols", "capitals", "shouting",
            "hardly distinct", "partly distinct", "seen before", "sentence end", "first", "last"]
TRAINED_ON = 2000  # labelled documents that the field is fitted to
TRAINED_LINES = 300  # longer documents are not taken into that sample
WINDOW = 8
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
CHUNK = 300_000  # words measured at a time


@dataclass
class Field:
    """Weights in favour of boilerplate: of each feature, of the first line, and ``step[previous][next]`` of neighbours."""
    weights: list[float]
    step: list[list[float]]
    cache: dict[int, float] = field(default_factory=dict)

    def emission(self, mask: int) -> float:
        e = self.cache.get(mask)
        if e is None:
            e = self.cache[mask] = sum(w for i, w in enumerate(self.weights) if mask >> i & 1)
        return e

    def viterbi(self, masks: list[int]) -> list[int]:
        """1 for boilerplate, 0 for content; ties go to content."""
        if not masks:
            return []
        (cc, cb), (bc, bb) = self.step
        content, boiler, back = 0.0, self.emission(masks[0]), []
        for mask in masks[1:]:
            from_c, from_b = content + cc >= boiler + bc, content + cb >= boiler + bb
            back.append((from_c, from_b))
            content, boiler = (content + cc if from_c else boiler + bc), (content + cb if from_b else boiler + bb) + self.emission(mask)
        label = int(boiler > content)
        labels = [label]
        for from_c, from_b in reversed(back):
            label = int(not (from_b if label else from_c))
            labels.append(label)
        return labels[::-1]


#: Used where no documents of both labels are given.
PRIOR = Field([0.5, 0, -0.5, -1, -1, 0, 1, 3, 3, 3, 3, 1, 1, -0.5, 0, 0], [[0.5, -0.5], [-0.5, 0.5]])


def lines_of(content: bytes) -> list[tuple[int, bytes, list[bytes]]]:
    """(number, line, words) of the \\n-split lines that have a word."""
    return [(i, line, words) for i, line in enumerate(content.split(b"\n")) if (words := line.split())]


def mask_of(line: bytes, words: list[bytes], seen: bool, first: bool, last: bool) -> int:
    n = len(words)
    solid = max(1, len(line.translate(None, SPACE)))
    symbols = (len(line) - len(line.translate(None, SYMBOLS))) / n
    distinct = len(set(words)) / n
    bits = (n < 4, 4 <= n < 10, 10 <= n < 30, n >= 30, symbols == 0, 0 < symbols < 0.1, 0.1 <= symbols < 0.25, symbols >= 0.25,
            (len(line) - len(line.translate(None, CAPITALS))) / solid > 0.4, line.count(b"!") > 0.3 * n,
            n >= 10 and distinct < 0.3, n >= 10 and 0.3 <= distinct < 0.6, seen, line.rstrip()[-1:] in b".?!", first, last)
    return sum(1 << i for i, b in enumerate(bits) if b)


def masks_of(lines: list[tuple[int, bytes, list[bytes]]]) -> tuple[list[int], int]:
    """Features of each line, and how many lines equal an earlier one."""
    seen, masks, repeats = set(), [], 0
    for i, (_, line, words) in enumerate(lines):
        again = line in seen
        repeats += again
        seen.add(line)
        masks.append(mask_of(line, words, again, i == 0, i == len(lines) - 1))
    return masks, repeats


def repeated_words(ids: np.ndarray, sizes: np.ndarray, width: int = WINDOW) -> np.ndarray:
    """Words of each document inside ``width``-word windows that it has at least twice; ``width`` is a power of two.

    Windows of 2, 4, 8 words are numbered from pairs of shorter ones, so equal numbers mean equal windows.
    """
    doc = np.repeat(np.arange(len(sizes)), sizes)
    if len(ids) < width:
        return np.zeros(len(sizes), np.int64)
    name, step = ids.astype(np.int64), 1
    while step < width:
        name = pd.factorize(name[:-step] * (int(name.max()) + 1) + name[step:])[0].astype(np.int64)
        step *= 2
    start = np.flatnonzero(doc[:len(name)] == doc[width - 1:])
    found = pd.factorize(doc[start] * (int(name.max()) + 1) + name[start])[0]
    start = start[np.bincount(found)[found] > 1] if len(start) else start
    edge = np.zeros(len(ids) + 1, np.int64)
    edge[start] += 1
    edge[start + width] -= 1
    return np.bincount(doc, weights=np.cumsum(edge[:-1]) > 0, minlength=len(sizes)).astype(np.int64)


def measured(texts: list[str], model: Field) -> Iterator[tuple]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_boiler_lines, n_content_words) of each text."""
    def flush() -> Iterator[tuple]:
        ids = np.concatenate([np.array(c, np.int64) for c in codes])
        repeats = repeated_words(ids, np.array([len(c) for c in codes]))
        for row, r in zip(rows, repeats.tolist()):
            yield (*row[:4], r, *row[4:])

    index, codes, rows, held = Index(), [], [], 0
    for text in texts:
        content = text.encode()
        lines = lines_of(content)
        masks, dups = masks_of(lines)
        labels = model.viterbi(masks)
        words = [w for _, _, ws in lines for w in ws]
        codes.append(list(map(index.__getitem__, words)))
        rows.append((len(words), len(text) - (len(content) - len(content.translate(None, SPACE))), len(content) - len(content.translate(None, SYMBOLS)),
                     dups, len(lines), sum(labels), sum(len(ws) for (_, _, ws), b in zip(lines, labels) if not b)))
        held += len(words)
        if held >= CHUNK:
            yield from flush()
            index, codes, rows, held = Index(), [], [], 0
    if rows:
        yield from flush()


def fit(masks: list[np.ndarray], boiler: np.ndarray, rounds: int = 200, rate: float = 0.2, ridge: float = 1e-4) -> Field:
    """Maximum likelihood by Adam; gradients are observed minus expected features (forward and backward sums in logs)."""
    order = sorted(range(len(masks)), key=lambda i: -len(masks[i]))  # long ones first: step t works on the first live[t]
    masks, y = [masks[i] for i in order], np.asarray(boiler, int)[order]
    k, n, longest = len(FEATURES), len(masks), len(masks[0])
    kinds, at = np.unique(np.concatenate(masks), return_inverse=True)  # few distinct lines: weights act on those
    bits = (kinds[:, None] >> np.arange(k) & 1).astype(np.float64)
    size = np.array([len(m) for m in masks])
    live = [int((size > t).sum()) for t in range(longest)]
    line, real = np.zeros((longest, n), np.int64), np.arange(longest)[:, None] < size
    line.T[real.T] = at
    steps = real[1:].sum()
    seen_steps = np.zeros((2, 2))
    for label in (0, 1):
        seen_steps[label, label] = real[1:, y == label].sum()
    theta = np.zeros(k + 4)
    m1, m2 = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, rounds + 1):
        e = np.stack([np.zeros((longest, n)), (bits @ theta[:k])[line]], -1)
        step = theta[k:].reshape(2, 2)
        alpha, beta = np.zeros((longest, n, 2)), np.zeros((longest, n, 2))
        alpha[0] = e[0]
        for t in range(1, longest):
            before = alpha[t - 1, :live[t]]
            alpha[t, :live[t]] = np.logaddexp(before[:, 0, None] + step[0], before[:, 1, None] + step[1]) + e[t, :live[t]]
        for t in range(longest - 2, -1, -1):
            after = (e[t + 1] + beta[t + 1])[:live[t + 1]]
            beta[t, :live[t + 1]] = np.logaddexp(step[:, 0] + after[:, 0, None], step[:, 1] + after[:, 1, None])
        total = np.logaddexp(*alpha[size - 1, np.arange(n)].T)
        p = np.exp(alpha[:, :, 1] + beta[:, :, 1] - total) * real
        grad = np.empty_like(theta)
        grad[:k] = np.bincount(line.ravel(), weights=(y * real - p).ravel(), minlength=len(kinds)) @ bits
        pair = alpha[:-1, :, :, None] + step + (e[1:] + beta[1:])[:, :, None, :] - total[None, :, None, None]
        grad[k:] = (seen_steps - np.exp(pair[real[1:]]).sum(0)).ravel() if longest > 1 else 0
        grad = grad / (real.sum() + steps) - ridge * theta
        m1, m2 = 0.9 * m1 + 0.1 * grad, 0.999 * m2 + 0.001 * grad ** 2
        theta = theta + rate * (m1 / (1 - 0.9 ** it)) / (np.sqrt(m2 / (1 - 0.999 ** it)) + 1e-9)
    return Field(theta[:k].tolist(), theta[k:].reshape(2, 2).tolist())


def train(docs: DataFrame, labels: DataFrame, most: int = TRAINED_ON, most_lines: int = TRAINED_LINES) -> Field:
    """The field fitted to at most ``most`` labelled documents (``quality`` 0 or 1), those whose ids hash lowest.

    Ids with contradicting or missing labels, and documents without words, are left out; with fewer than one
    document of each label the result is ``PRIOR``.
    """
    one = labels.groupBy("doc_id").agg(F.min("quality").alias("low"), F.max("quality").alias("high"))
    sample = one.filter("low = high AND low IN (0, 1) AND doc_id IS NOT NULL").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [masks_of(lines_of(t.encode()))[0] for t in texts_of(batch.column("text"))]
            fits = [0 < len(m) <= most_lines for m in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").filter(pa.array(fits, pa.bool_())), batch.column("low").filter(pa.array(fits, pa.bool_())),
                                              pa.array([m for m, f in zip(found, fits) if f], pa.list_(pa.int32()))], names=["doc_id", "low", "masks"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.join(F.broadcast(sample.select("doc_id", F.col("low").cast("int").alias("low"))), "doc_id").select("doc_id", "low", "text")
    got = sorted(rows.mapInArrow(features, f"doc_id {kind}, low int, masks array<int>").dropDuplicates(["doc_id"]).collect(), key=lambda r: str(r.doc_id))
    boiler = np.array([1 - r.low for r in got])
    if len(got) == 0 or boiler.min() == boiler.max():
        return PRIOR
    return fit([np.array(r.masks) for r in got], boiler)


def judge(df: DataFrame, text: str, model: Field, keep: list[str] | None = None, share: float = 0.5) -> DataFrame:
    """Columns ``keep`` (all by default) with the measures, ``n_lines``, ``n_boiler_lines``, ``content_share``, ``base_failed``, ``kept``.

    ``content_share`` is the share of words in content lines. A missing text, or one without words, has all measures 0 and
    fails the base rules. Repeated rows are judged one by one; input columns named like an output are replaced.
    """
    extra = [*MEASURES, "n_lines", "n_boiler_lines", "n_content_words"]
    ours = {*extra, "content_share", "base_failed", "kept"}
    names = [c for c in (df.columns if keep is None else keep) if c.lower() not in ours]
    plain = Field(model.weights, model.step)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns = list(zip(*measured(texts_of(batch.column("__text")), plain))) or [()] * len(extra)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], *[pa.array(c, pa.int64()) for c in columns]], names=[*names, *extra])
    rows = df.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text}`").alias("__text"))
    schema = T.StructType([*rows.schema.fields[:-1], *[T.StructField(c, T.LongType()) for c in extra]])
    out = rows.mapInArrow(measure, schema)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return (out.withColumn("content_share", F.col("n_content_words") / F.greatest("n_words", F.lit(1))).withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (F.col("content_share") >= share)).drop("n_content_words"))


def labelled_lines(df: DataFrame, key: str, text: str, model: Field) -> DataFrame:
    """One row for each line with a word: ``key``, ``line_no`` (from 0, all lines counted), ``line``, ``boilerplate``."""
    plain = Field(model.weights, model.step)

    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, t in enumerate(texts_of(batch.column("text"))):
                lines = lines_of(t.encode())
                marks = plain.viterbi(masks_of(lines)[0])
                if lines:
                    yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array([i] * len(lines))), pa.array([n for n, _, _ in lines], pa.int32()),
                                                      pa.array([line.decode() for _, line, _ in lines]), pa.array([bool(m) for m in marks])], names=["key", "line_no", "line", "boilerplate"])
    kind = df.schema[key].dataType.simpleString()
    return pick(df, key=key, text=text).mapInArrow(label, f"key {kind}, line_no int, line string, boilerplate boolean").withColumnRenamed("key", key)


def op3_quality_lines(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    return judge(docs, "text", model, keep=["doc_id"]).select("doc_id", *MEASURES, "base_failed", "kept", "n_lines", "n_boiler_lines", "content_share")
