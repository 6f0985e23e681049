"""Language identification of mixed texts.

Each language has a table of smoothed log-likelihoods of byte trigrams, counted over all labelled documents. A
document's words are draws from a mixture of languages; expectation-maximisation finds the proportions. The set
of languages is the one with the highest likelihood less a penalty for each language after the first, among the
best single language and the sets that add languages in the order of their proportions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import crc_of_id, sliced, table

BUCKETS = 1 << 16  # of hashed trigrams
LANGUAGES = 100  # more learned languages are refused: the tables are sent to every worker
TEMPER = 3.0  # neighbouring trigrams share bytes, so a word's evidence is divided by their length
ROUNDS = 12
PENALTY = 2.0  # times the logarithm of the words, for each further language
UNKNOWN = "und"

#: ASCII letters in lower case and all bytes of other characters stay; the rest parts words.
FOLD = np.array([b | 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of the trigram around each byte inside a word, where each word begins among them, and each word's text."""
    joined = FOLD[np.frombuffer(b" " + b" ".join(texts) + b"  ", np.uint8)]
    b = joined.astype(np.uint32)
    key = ((b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(0x9E3779B1)) >> np.uint32(16)
    inside = np.flatnonzero(joined[1:-1] != 32)
    begins = np.flatnonzero(joined[inside] == 32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return key[inside], begins, np.searchsorted(ends, inside[begins], "right")


def count_trigrams(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over columns ``lang``, ``text``: each task adds up first and emits what is not zero."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in sliced(batches):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, []).append(text.encode())
            for lang, texts in by_lang.items():
                sums[lang] = sums.get(lang, 0) + np.bincount(trigrams(texts)[0], minlength=BUCKETS)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at].astype(np.int64))], names=["lang", "bucket", "n"])
    known = docs.filter("lang IS NOT NULL AND text IS NOT NULL").select("lang", "text")
    return known.mapInArrow(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their log-likelihoods (bucket x language), add-a-half smoothed."""
    counts = count_trigrams(docs)
    names = [r.lang for r in counts.select("lang").distinct().limit(LANGUAGES + 1).collect()]
    if len(names) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    names.sort()
    seen = np.zeros((BUCKETS, len(names)))
    got = counts.toArrow()  # at most BUCKETS rows a language
    seen[got.column("bucket").to_numpy(), np.searchsorted(names, got.column("lang").to_pylist())] = got.column("n").to_numpy()
    return names, np.log((seen + 0.5) / (seen.sum(0) + 0.5 * BUCKETS)).astype(np.float32) if names else seen


def mixture(ll: np.ndarray, doc: np.ndarray, begins: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document, over its allowed languages. Rows of ``ll`` are words, sorted by document."""
    top = ll.max(1)
    likely = np.exp(ll - top[:, None])
    share = allowed / allowed.sum(1, keepdims=True)
    n = np.diff([*begins, len(ll)])[:, None]
    for _ in range(ROUNDS):
        part = likely * share[doc]
        part /= np.maximum(part.sum(1, keepdims=True), 1e-300)
        share = np.add.reduceat(part, begins, axis=0) / n
    return share, np.add.reduceat(np.log(np.maximum((likely * share[doc]).sum(1), 1e-300)) + top, begins)


def identify(texts: list[bytes], tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each text the proportions within its chosen set of languages, and those among all; zeros without a word."""
    size = tables.shape[1]
    chosen, full = np.zeros((len(texts), size)), np.zeros((len(texts), size))
    keys, begins, owner = trigrams(texts)
    if not len(begins) or not size:
        return chosen, full
    ll = np.add.reduceat(tables[keys], begins, axis=0).astype(np.float64) / TEMPER
    docs, first, doc = np.unique(owner, return_index=True, return_inverse=True)
    n = np.diff([*first, len(ll)])
    share, upper = mixture(ll, doc, first, np.ones((len(docs), size)))
    alone = np.add.reduceat(ll, first, axis=0)
    best, single = alone.max(1), np.eye(size)[alone.argmax(1)]
    cost = PENALTY * np.log(n + 1.0)
    pick = single.copy()
    rest = np.flatnonzero(upper - best > cost)  # no set can gain more than all languages together
    rank = np.argsort(np.argsort(-share, axis=1, kind="stable"), axis=1)
    value = best.copy()
    for k in range(2, size + 1):
        if not len(rest):
            break
        take = np.isin(doc, rest)
        local, at = np.unique(doc[take], return_index=True)
        within = np.searchsorted(local, doc[take])
        some, got = mixture(ll[take], within, at, (rank[rest] < k).astype(float))
        better = got - (k - 1) * cost[rest] > value[rest]
        pick[rest[better]], value[rest[better]] = some[better], (got - (k - 1) * cost[rest])[better]
        rest = rest[upper[rest] - k * cost[rest] > value[rest]]
    chosen[docs], full[docs] = pick, (share * n[:, None] + 0.5) / (n + 0.5 * size)[:, None]
    return chosen, full


def predict(df: DataFrame, text: str, model: tuple[list[str], np.ndarray], keep: list[str] | None = None) -> DataFrame:
    """Columns ``keep`` (all by default) with ``lang_pred``, ``score`` and ``languages`` (the chosen set with proportions).

    ``lang_pred`` has the largest proportion in the set (ties: first by name), ``score`` its smoothed proportion among all
    languages. Texts that are missing or have no letter, and all texts under an empty model, are ``und`` with score 0.
    Repeated rows are judged one by one; input columns named like an output are replaced.
    """
    names, tables = model
    keep = [c for c in (df.columns if keep is None else keep) if c.lower() not in ("lang_pred", "score", "languages")]
    shared = df.sparkSession.sparkContext.broadcast(tables)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 256, 1 << 20):
            texts = [t if t and any(map(str.isalpha, t)) else "" for t in batch.column("__text").to_pylist()]
            chosen, full = identify([t.encode() for t in texts], shared.value)
            at = chosen.argmax(1) if names else np.zeros(len(texts), int)
            told = [bool(names) and c.any() for c in chosen]
            made = [pa.array([names[i] if t else UNKNOWN for i, t in zip(at, told)], pa.string()),
                    pa.array([float(f[i]) if t else 0.0 for f, i, t in zip(full, at, told)], pa.float64()),
                    pa.array([[{"lang": names[i], "share": float(c[i])} for i in np.argsort(-c, kind="stable") if c[i] > 0] for c in chosen],
                             pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], *made], names=[*keep, "lang_pred", "score", "languages"])
    rows = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    found = T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType())])
    schema = T.StructType([*rows.schema.fields[:-1], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
                           T.StructField("languages", T.ArrayType(found))])
    return rows.mapInArrow(judge, schema)


def learned_from(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """The model of the documents whose crc32 of the id is not divisible by 5."""
    return learn(docs.filter(crc_of_id(F.col("doc_id")) % 5 != 0))


def op10_language_mixture(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (crc_of_id(F.col("doc_id")) % 5 == 0).alias("held_out"))
    return predict(docs, "text", learned_from(docs), keep=["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score", "languages")
