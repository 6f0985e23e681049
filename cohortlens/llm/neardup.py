"""Near-duplicates by a multi-index Hamming join over b-bit MinHash signatures.

A signature has CHUNKS x LENGTH positions of 16 bits. Two signatures that differ in at most DISTANCE =
2 * CHUNKS - 1 positions have, by the pigeonhole principle, a chunk with at most one difference; every chunk
is therefore filed once for each position that may be wrong, under the other positions. Such pairs always meet.
At similarity 0.8 a position differs with probability 0.2, so 80 positions differ in more than 31 places with
probability below 3e-5; pairs under the distance are then confirmed on the full shingle sets.

Equal sets are one class from the start. Inside a bucket all members are first compared with its smallest one, the
centre of a star. What the confirmed links leave apart is compared further, but only where it can matter: counts of
what members share with the centre (``possible``) and the rarest values of signatures (``inside``) rule most pairs out
before they are formed. So a group of copies costs about as many comparisons as it has members, and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, settle, short_batches, sliced, table, texts_of, trimmed, worker_cache
from .components import components
from .lm import mix

CHUNKS, LENGTH = 16, 5
DISTANCE = 2 * CHUNKS - 1
SIMILARITY = 80  # per cent
FILTER_BITS = 1 << 26  # of the fixed-size filter of documents whose sets are needed; when full it lets all through


def multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 65_536:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(text: str, width: int, hashes: dict) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the ``width``-word shingles; a shorter text is one shingle, one without words none."""
    words = text.encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    span = min(width, len(h))
    out = h[:len(h) - span + 1]
    with np.errstate(over="ignore"):
        for i in range(1, span):
            out = mix(out * np.uint64(0xD6E8FEB86659FD93) + h[i:len(h) - span + 1 + i])
    return np.unique(out)


def signature(shingle: np.ndarray, factors: np.ndarray) -> bytes:
    low = None
    with np.errstate(over="ignore"):
        for at in range(0, len(shingle), 2048):
            some = (shingle[at:at + 2048, None] * factors).min(0)
            low = some if low is None else np.minimum(low, some)
    return (mix(low) & np.uint64(0xFFFF)).astype("<u2").tobytes()


def word_hashes() -> dict:
    cache = worker_cache()
    if "word_hashes" not in cache:
        cache["word_hashes"] = WordHash()
    return cache["word_hashes"]


def prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, signature); without words the set id and the signature are null."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, factors = word_hashes(), multipliers(CHUNKS * LENGTH)
        for batch in sliced(batches):
            n, ids, signatures = [], [], []
            for text in texts_of(batch.column("text")):
                s = shingles(text, width, hashes)
                n.append(len(s))
                ids.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                signatures.append(signature(s, factors) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array(signatures, pa.binary())],
                                             names=["doc_id", "n_shingles", "set_id", "signature"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(trimmed(make), f"doc_id {kind}, n_shingles long, set_id binary, signature binary")


def chunk_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, id): for each chunk and each position that may be wrong, a hash of the other positions."""
    marks = mix(np.arange(1, CHUNKS * LENGTH + 1, dtype=np.uint64)).reshape(LENGTH, CHUNKS)
    for batch in sliced(batches, 1024):
        parts = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(len(batch), CHUNKS, LENGTH)
        keys = [mix(np.ascontiguousarray(np.delete(parts, j, 2)).view("<u8")[:, :, 0] ^ marks[j]) for j in range(LENGTH)]
        rows = np.repeat(np.arange(len(batch)), CHUNKS * LENGTH)
        yield pa.RecordBatch.from_arrays([pa.array(np.stack(keys, 1).reshape(-1).view(np.int64)), batch.column("id").take(pa.array(rows))], names=["key", "id"])


def near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures differ in at most DISTANCE positions."""
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            one, two = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u2").reshape(len(batch), -1) for c in ("sa", "sb"))
            yield batch.select(["a", "b"]).filter(pa.array((one != two).sum(1) <= DISTANCE))
    signed = (pairs.join(classes.select(F.col("id").alias("a"), F.col("signature").alias("sa")), "a")
              .join(classes.select(F.col("id").alias("b"), F.col("signature").alias("sb")), "b"))
    kind = classes.schema["id"].dataType.simpleString()
    return signed.select("a", "b", "sa", "sb").mapInArrow(trimmed(close), f"a {kind}, b {kind}")


def id_filter(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed ids: at most FILTER_BITS / 64 rows reach the driver, whatever the number of ids."""
    words = ids.select(F.expr(f"pmod(xxhash64(id), {FILTER_BITS}) div 64").alias("w"), F.expr("shiftleft(1L, cast(pmod(xxhash64(id), 64) AS int))").alias("bit"))
    got = words.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(FILTER_BITS // 64, np.uint64)
    out[got.column("w").to_numpy()] = got.column("bits").to_numpy().view(np.uint64)
    return out


def sets_of(docs: DataFrame, classes: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """(id, set): the full shingle sets of the classes ``ids``, from the texts of their first documents, written once.

    The texts are read in place and passed by a filter of fixed size; only sets of needed documents are shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(ids))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits = word_hashes(), shared.value
        for batch in sliced(batches):
            at = batch.column("at").to_numpy().astype(np.uint64)
            batch = batch.filter(pa.array((bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) > 0))
            sets = [shingles(t, width, hashes) for t in texts_of(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                                              pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "set_id", "set"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.filter("doc_id IS NOT NULL").select("doc_id", "text", F.expr(f"pmod(xxhash64(doc_id), {FILTER_BITS})").alias("at"))
    found = asked.mapInArrow(trimmed(make), f"id {kind}, set_id binary, set binary")
    needed = ids.join(classes.select("id", "set_id"), "id")
    return settle(found.join(needed, ["id", "set_id"], "left_semi").select("id", "set").dropDuplicates(["id"]))


def confirm(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) with ``na``, ``nb``, ``both`` (sizes of the full sets and of their intersection) and ``diff``: what only b has, and the complements of what only a has."""
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes, diff = [], []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two
                sizes.append((len(one), len(two), int(shared.sum())))
                lacking = np.delete(one, np.searchsorted(one, two[shared]))
                diff.append(np.concatenate([two[~shared], ~lacking]).tobytes())
            counts = [pa.array(c, pa.int64()) for c in zip(*sizes)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *counts, pa.array(diff, pa.binary())], names=["a", "b", "na", "nb", "both", "diff"])
    sets = sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width)
    kind = classes.schema["id"].dataType.simpleString()
    full = (pairs.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a"))
    return settle(full.select("a", "b", "x", "y").mapInArrow(trimmed(check), f"a {kind}, b {kind}, na long, nb long, both long, diff binary"))


def linked(checked: DataFrame, similarity: int) -> DataFrame:
    return checked.filter(100 * F.col("both") >= similarity * (F.col("na") + F.col("nb") - F.col("both"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def explode_diff(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        sets = [np.frombuffer(x, np.int64) for x in batch.column("diff").to_pylist()]
        at = pa.array(np.repeat(np.arange(len(sets)), [len(x) for x in sets]))
        kept = [batch.column(c).take(at) for c in ("a", "id", "n")]
        yield pa.RecordBatch.from_arrays([*kept, pa.array(np.concatenate([*sets, np.empty(0, np.int64)]))], names=["a", "id", "n", "h"])


def ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def possible(stars: DataFrame, groups: DataFrame, similarity: int) -> DataFrame:
    """Pairs of members of one star that may be similar, although one of them is not linked to its centre and no links join them yet.

    ``diff`` holds what a member has and the centre lacks, and the reverse. Two members x, y share
    shared(x) + shared(y) - size of the centre + |diff(x) and diff(y)| shingles, so a link needs a number of common
    differences that is known for each pair; and a member that misses the centre needs one at least, whatever the partner: the
    least need is that of a partner of the centre's size, ``need``. A prefix filter on the differences, those that are rare in
    the star first, rules the other pairs out inside the join: the first common difference leaves too few behind it.
    """
    at = stars.join(groups.select(F.col("node").alias("b"), F.col("component").alias("c")), "b", "left")
    over = similarity * (F.col("na") + F.col("nb")) - (100 + similarity) * F.col("both")
    at = at.select("a", F.col("b").alias("id"), F.coalesce("c", "b").alias("c"), F.col("na").alias("whole"), F.col("nb").alias("size"), F.col("both").alias("shared"), "diff",
                   F.ceil(over / (100 + similarity)).cast("long").alias("need"))
    mixed = at.groupBy("a").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("need").alias("worst")).filter("low < high AND worst > 0")
    at = settle(at.join(mixed.select("a"), "a"))
    kind = stars.schema["a"].dataType.simpleString()
    exploded = at.select("a", "id", (F.octet_length("diff") / 8).cast("long").alias("n"), "diff").mapInArrow(explode_diff, f"a {kind}, id {kind}, n long, h long")
    exploded = settle(exploded)
    seen = exploded.join(exploded.groupBy("a", "h").agg(F.count(F.lit(1)).alias("f")), ["a", "h"])
    rare = Window.partitionBy("a", "id").orderBy("f", "h")  # as many rows as a text has differences
    ranked = seen.withColumn("rest", F.col("n") - F.row_number().over(rare)).filter("f > 1")
    placed = ranked.join(at.drop("diff"), ["a", "id"]).filter("rest + 1 >= need").select("a", "h", "id", "c", "whole", "size", "shared", "need", "rest")
    split = placed.groupBy("a", "h").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.max("need").alias("worst")).filter("low < high AND worst > 0")
    placed = settle(placed.join(split.select("a", "h"), ["a", "h"]))
    x, y = (placed.select("a", "h", *[F.col(c).alias(f"{c}{side}") for c in ("id", "c", "whole", "size", "shared", "need", "rest")]).alias(side) for side in "xy")
    return ordered(x.filter("needx > 0").join(y, F.expr(
        f"x.a = y.a AND x.h = y.h AND idx <> idy AND cx <> cy AND {100 + similarity} * (sharedx + sharedy - wholex + 1 + least(restx, resty)) >= {similarity} * (sizex + sizey)"))
        .select(F.col("idx").alias("x"), F.col("idy").alias("y")))


def signature_tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, token): one for each position of a signature, the position and its value as one number."""
    marks = np.arange(CHUNKS * LENGTH, dtype=np.int64) << 16
    for batch in sliced(batches, 1024):
        tokens = np.frombuffer(b"".join(batch.column("signature").to_pylist()), "<u2").reshape(len(batch), -1).astype(np.int64) + marks
        rows = np.repeat(np.arange(len(batch)), len(marks))
        yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.array(tokens.reshape(-1))], names=["id", "token"])


def inside(open_: DataFrame, stars: DataFrame, classes: DataFrame, similarity: int) -> DataFrame:
    """Pairs of members of open buckets, one of them far from its bucket's first one, whose signatures may be near.

    Near signatures agree in all positions but DISTANCE, so they share one of their DISTANCE + 1 rarest values: a prefix
    filter, in which what many members have in common (a passage, a footer) counts for nothing. The first value they share
    has nothing common before it, so all positions of rarer values, of either side, differ: a pair with more than DISTANCE
    of these does not meet there (``low``, ``high``: bits of the positions). Values that occur in
    one component only are dropped before the join; sizes that rule a link out are ruled out in it. Members of one star
    are left to ``possible``: ``home`` is the first star of a member, and equal homes are not joined.
    """
    far = (open_.filter("first <> id").join(stars.select(F.col("a").alias("first"), F.col("b").alias("id")), ["first", "id"], "left_anti")
           .select("id").distinct().withColumn("far", F.lit(True)))
    homes = stars.select(F.col("b").alias("id"), "a").unionByName(stars.select(F.col("a").alias("id"), "a")).groupBy("id").agg(F.min("a").alias("home"))
    members = open_.select("id", "c").distinct().join(far, "id", "left").join(homes, "id", "left").withColumn("home", F.coalesce("home", "id"))
    kind = classes.schema["id"].dataType.simpleString()
    signed = members.join(classes.select("id", "signature"), "id").select("id", "signature")
    tokens = settle(signed.mapInArrow(signature_tokens, f"id {kind}, token long"))
    seen = tokens.join(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n")), "token")
    rare = Window.partitionBy("id").orderBy("n", "token")  # a window has as many rows as a signature has positions
    at, half, before = F.expr("cast(shiftright(token, 16) AS int)"), CHUNKS * LENGTH // 2, rare.rowsBetween(Window.unboundedPreceding, -1)
    bits = {"low": F.when(at < half, F.call_function("shiftleft", F.lit(1).cast("long"), at)),
            "high": F.when(at >= half, F.call_function("shiftleft", F.lit(1).cast("long"), at - half))}
    prefix = (seen.select("id", "token", F.row_number().over(rare).alias("i"), *[F.coalesce(F.bit_or(b).over(before), F.lit(0)).alias(c) for c, b in bits.items()])
              .filter(F.col("i") <= DISTANCE + 1).drop("i"))
    placed = prefix.join(members, "id").join(classes.select("id", "n_shingles"), "id")
    mixed = (placed.groupBy("token").agg(F.min("c").alias("low"), F.max("c").alias("high"), F.min("home").alias("one"), F.max("home").alias("two"))
             .filter("low < high AND one < two").select("token"))
    placed = settle(placed.join(mixed, "token"))
    columns = {"id": "", "c": "c", "n_shingles": "n", "home": "h", "low": "low", "high": "high", "far": "far"}
    x, y = (placed.select("token", *[F.col(c).alias(f"{short}{side}") for c, short in columns.items()]).alias(name) for side, name in (("x", "l"), ("y", "r")))
    return ordered(x.filter("farx").join(y, F.expr(
        f"l.token = r.token AND x <> y AND cx <> cy AND hx <> hy AND (x < y OR fary IS NULL) AND 100 * least(nx, ny) >= {similarity} * greatest(nx, ny)"
        f" AND bit_count(lowx | lowy) + bit_count(highx | highy) <= {DISTANCE}")).select("x", "y"))


def cluster(df: DataFrame, key: str, text: str, width: int = 5, similarity: int = SIMILARITY) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``class_id`` (first document with its set), ``component_id``, ``kept``.

    ``component_id`` is the smallest key that links lead to. A missing or empty text is linked with nothing and kept.
    Rows of one key are one document, with that of their non-empty sets whose hash is lowest. A missing key has no class, is
    linked with nothing and kept, row by row. Other columns are ignored.
    """
    short_batches(df.sparkSession)
    docs = pick(df, doc_id=key, text=text)
    each = settle(prints(docs, width))
    known = each.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min(F.when(F.col("set_id").isNotNull(), F.struct("set_id", "n_shingles", "signature"))).alias("s"))
    known = known.select("doc_id", "s.set_id", F.coalesce("s.n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "s.signature")
    found = known.filter("set_id IS NOT NULL")
    classes = settle(found.groupBy("set_id").agg(F.min("doc_id").alias("id"), F.min("signature").alias("signature"), F.min("n_shingles").alias("n_shingles")))

    filed = classes.select("id", "signature").mapInArrow(chunk_keys, f"key long, id {docs.schema['doc_id'].dataType.simpleString()}")
    shared = filed.groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("key", "first")
    members = settle(filed.join(shared, "key"))
    stars = confirm(settle(near(members.filter("first < id").select(F.col("first").alias("a"), F.col("id").alias("b")).distinct(), classes)), docs, classes, width)
    links = linked(stars, similarity)
    groups = components(links)

    group_of = groups.withColumnRenamed("node", "id")
    placed = members.join(group_of, "id", "left").select("key", "first", "id", F.coalesce("component", "id").alias("c"))
    split = placed.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).filter("low < high").select("key")
    open_ = settle(placed.join(split, "key"))
    apart = possible(stars, groups, similarity).unionByName(inside(open_, stars, classes, similarity)).distinct().join(stars.select("a", "b"), ["a", "b"], "left_anti")
    rest = settle(near(apart, classes))
    if rest.head(1):
        groups = components(links.unionByName(linked(confirm(rest, docs, classes, width), similarity)))

    classed = found.select("doc_id", "set_id").join(classes.select("set_id", F.col("id").alias("class_id")), "set_id")
    placed = classed.join(groups.withColumnRenamed("node", "class_id"), "class_id", "left").select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = known.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select(
        "doc_id", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = each.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    out = out.unionByName(nameless).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    return out.withColumnRenamed("doc_id", key)


def op4_minhash_hamming(spark, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "documents"), "doc_id", "text", width=2).select("doc_id", "n_shingles", "component_id", "kept", "class_id")
