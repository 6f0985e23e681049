"""Exact Jaccard join of n-gram sets by set-relation skipping.

An index list holds the sets that have one shingle in their prefix. Every entry knows how far it reaches: with i earlier
shingles passed by, an overlap needs d - i, so U(y) <= reach = 2 (100 + s) (d - i) - U(x) for a partner y, where
U(x) = (100 + s) d - (100 - s) |x| and d is the number of x's listed elements. Lists are cut into blocks of sizes between
which no link is possible, and entries whose reach ends before a block are never filed there.

The members of a list are compared with one of them, the centre c, only. The rest of the answers is derived from that
comparison: for x and y, |x ^ y| = |x ^ c| + |y ^ c| - 2 |(x ^ c) & (y ^ c)|, so two members are similar exactly if their
differences from c overlap enough. That is the same question again on smaller sets (d is now |x ^ c|; the first level is
the case of an empty centre), rare elements first. Members already in one component need no answer, so a group of copies
costs about as many comparisons as it has members. A centre is the member with the most familiar shingles: an
original rather than an altered copy. Centres come ever later in that order, so the levels end; and every pair of
similar sets shares an element inside both prefixes at each level until one of them is the centre or they are connected.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pick, settle, short_batches, sliced, table, texts_of
from .components import components
from .lm import mix
from .neardup import FILTER_BITS, id_filter, sets_of, shingles, word_hashes

SALTS = 16  # parts of a star's rows
STAR_LEVELS = 3  # after them, pairs that still reach each other are compared one by one
OFTEN = 8  # hits in a task that make a bucket worth counting
BUCKETS = 1 << 22  # of the table of frequencies


def steps(similarity: int, upto: int) -> np.ndarray:
    """Lowest sizes of the blocks: linked sets are in one block or in two that follow each other."""
    low = [1]
    while low[-1] <= upto:
        low.append(low[-1] * 100 // similarity + 1)
    return np.array(low)


def sizes(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n_shingles, set_id, bucket, hits); without words the set id is null.

    Each task adds rows without a document (``hits`` is not null): buckets of shingles that it met at least OFTEN times.
    """
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, hits, names = word_hashes(), np.zeros(BUCKETS, np.int32), ["doc_id", "n_shingles", "set_id", "bucket", "hits"]
        kind = None
        for batch in sliced(batches):
            kind = batch.schema.field("doc_id").type
            sets = [shingles(t, width, hashes) for t in texts_of(batch.column("text"))]
            np.add.at(hits, np.concatenate(sets) & np.uint64(BUCKETS - 1), 1)
            none = pa.nulls(len(batch), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                                              pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()), none, none], names=names)
        met = np.flatnonzero(hits >= OFTEN)
        if len(met):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(met), kind), pa.nulls(len(met), pa.int64()), pa.nulls(len(met), pa.binary()),
                                              pa.array(met.astype(np.int32)), pa.array(hits[met])], names=names)
    return docs.mapInArrow(make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, set_id binary, bucket int, hits int")


def by_bucket(rows: DataFrame) -> np.ndarray:
    """Binary logarithms of summed ``hits``, at most one row for a bucket."""
    got = rows.groupBy("bucket").agg(F.sum("hits").alias("n")).filter("n > 1").select("bucket", F.floor(F.log2("n")).cast("byte").alias("n")).toArrow()
    out = np.zeros(BUCKETS, np.uint8)
    out[got.column("bucket").to_numpy()] = got.column("n").to_numpy()
    return out


def index(docs: DataFrame, classes: DataFrame, frequent: np.ndarray, width: int, similarity: int) -> DataFrame:
    """(key, id, u, r, d, e, part, p): prefix entries of the first document of each class, filed by shingle and size block.

    ``d`` is the size of the set and ``e`` the number of its entries in the block ``part``;
    ``p`` says how frequent its shingles are on average, negated.
    Texts are read in place behind a filter of fixed size; a document it lets through in vain is a copy of another
    and only adds entries.
    """
    shared = docs.sparkSession.sparkContext.broadcast(id_filter(classes.select("id")))
    low, often_ = steps(similarity, 1 << 40), docs.sparkSession.sparkContext.broadcast(frequent)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, bits, often = word_hashes(), shared.value, often_.value
        for batch in sliced(batches):
            at = batch.column("at").to_numpy().astype(np.uint64)
            batch = batch.filter(pa.array((bits[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1)) > 0))
            keys, rows, us, rs, ds, es, gs, ps = ([] for _ in range(8))
            for row, text in enumerate(texts_of(batch.column("text"))):
                s = shingles(text, width, hashes)
                n = len(s)
                if not n:
                    continue
                known = often[s & np.uint64(BUCKETS - 1)]
                familiar = -int(known.sum(dtype=np.int64)) * 10_000 // n
                s = s[np.argsort(known, kind="stable")]  # rare ones first
                reach = 200 * n - 2 * (100 + similarity) * np.arange(n)
                block = int(np.searchsorted(low, n, "right")) - 1
                for b, least in ((block, -(-similarity * n // 100)), (block + 1, max(int(low[block + 1]), n + 1))):
                    m = int((reach >= 2 * similarity * least).sum())  # reach falls along the prefix
                    with np.errstate(over="ignore"):
                        keys.append(mix(s[:m] ^ mix(np.array([b + 1], np.uint64))))
                    rows.append(np.full(m, row))
                    us.append(np.full(m, 2 * similarity * n))
                    rs.append(reach[:m])
                    ds.append(np.full(m, n))
                    es.append(np.full(m, m))
                    gs.append(np.full(m, b))
                    ps.append(np.full(m, familiar))
            ids = batch.column("id").take(pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)), ids,
                                              *[pa.array(np.concatenate([*x, np.empty(0, np.int64)]).astype(np.int64)) for x in (us, rs, ds, es, gs, ps)]],
                                             names=["key", "id", "u", "r", "d", "e", "part", "p"])
    kind = docs.schema["doc_id"].dataType.simpleString()
    asked = docs.filter("doc_id IS NOT NULL").select(F.col("doc_id").alias("id"), "text", F.expr(f"pmod(xxhash64(doc_id), {FILTER_BITS})").alias("at"))
    return settle(asked.mapInArrow(make, f"key long, id {kind}, u long, r long, d long, e long, part long, p long"))


def shared_entries(entries: DataFrame, similarity: int) -> DataFrame:
    """Entries of lists with several members, with ``t``: a bound of U(x) + U(y) from the entries that nothing shares.

    An unshared entry is missing in every partner whose prefix goes as far; so of two sets, the bound of the one whose prefix
    ends first holds, and the larger one always.
    """
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    members = settle(entries.join(lists, "key"))
    shared = members.groupBy("id", "part").agg(F.count(F.lit(1)).alias("s"))
    return members.join(shared, ["id", "part"]).withColumn("t", 2 * (100 + similarity) * (F.col("d") - F.col("e") + F.col("s"))).drop("d", "e", "s", "part")


def reachable(entries: DataFrame) -> DataFrame:
    """Entries without those that nothing in their list can reach, or that reach nothing there.

    Members of the component of the list's centre (``main``) need partners outside it only.
    """
    side = lambda f, c, m: f(F.when(F.col("main") == F.lit(m), F.col(c)))
    ends = entries.groupBy("key").agg(side(F.min, "u", True).alias("um"), side(F.min, "u", False).alias("uo"), side(F.max, "r", True).alias("rm"), side(F.max, "r", False).alias("ro"), F.max("t").alias("tx"))
    u, r = F.when(F.col("main"), F.col("uo")).otherwise(F.least("um", "uo")), F.when(F.col("main"), F.col("ro")).otherwise(F.greatest("rm", "ro"))
    return entries.join(ends, "key").filter((F.col("r") >= u) & (F.col("u") <= r) & (F.col("u") + u <= F.col("tx"))).drop("um", "uo", "rm", "ro", "tx")


def star_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): each list's centre with every other member, for lists that span components; two alone are paired only within reach."""
    entries = reachable(entries)
    lists = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p", "id", "u", "r", "t")).alias("c"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    lists = lists.filter("n > 1 AND low < high").select("key", "n", "c")
    members = entries.join(lists, "key").filter("id <> c.id AND (n > 2 OR (u <= c.r AND c.u <= r AND u + c.u <= greatest(t, c.t)))")
    return members.select(F.col("c.id").alias("a"), F.col("id").alias("b")).distinct()


def reaching_pairs(entries: DataFrame) -> DataFrame:
    """(a, b): members of one list in different components that reach each other."""
    entries = settle(reachable(entries))
    one, two = (entries.select("key", *[F.col(c).alias(f"{c}{i}") for c in ("id", "u", "r", "t", "comp")]) for i in (1, 2))
    met = one.join(two, "key").filter("id1 < id2 AND comp1 <> comp2 AND u1 <= r2 AND u2 <= r1 AND u1 + u2 <= greatest(t1, t2)")
    return met.select(F.col("id1").alias("a"), F.col("id2").alias("b")).distinct()


def rarity(sets: DataFrame) -> np.ndarray:
    """How frequent shingles are, to a factor of two, in 2^22 buckets: an order that puts rare ones first. It decides speed only."""
    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 4096):
            all_ = np.concatenate([*[np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column("set")], np.empty(0, np.uint64)])
            bucket, n = np.unique((all_ & np.uint64(BUCKETS - 1)).astype(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n.astype(np.int64))], names=["bucket", "hits"])
    return by_bucket(sets.select("set").mapInArrow(tally, "bucket int, hits long"))


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """``pairs`` with the sets x of a and y of b. A centre's set is copied to SALTS parts of its star at most."""
    salted = pairs.withColumn("salt", F.expr(f"pmod(xxhash64(b), {SALTS})"))
    centres = salted.select("a", "salt").distinct().join(sets.select(F.col("id").alias("a"), F.col("set").alias("x")), "a")
    return salted.join(sets.select(F.col("id").alias("b"), F.col("set").alias("y")), "b").join(centres, ["a", "salt"]).drop("salt")


def in_first(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    return one[np.minimum(np.searchsorted(one, two), len(one) - 1)] == two


def compared(pairs: DataFrame, sets: DataFrame, kind: str) -> DataFrame:
    """(a, b, na, nb, both): sizes of the full sets and of their intersection."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            got = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                got.append((len(one), len(two), int(in_first(one, two).sum())))
            cols = [pa.array(c, pa.int64()) for c in zip(*got)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), *cols], names=["a", "b", "na", "nb", "both"])
    return settle(with_sets(pairs, sets).select("a", "b", "x", "y").mapInArrow(count, f"a {kind}, b {kind}, na long, nb long, both long"))


def open_members(checked: DataFrame, groups: DataFrame, similarity: int) -> DataFrame:
    """(a, b, u, comp, least): members of stars that span components, with the least U a partner elsewhere can have."""
    comp = groups.select(F.col("node").alias("b"), "component")
    u = (100 + similarity) * (F.col("na") + F.col("nb") - 2 * F.col("both")) - (100 - similarity) * F.col("nb")
    members = checked.join(comp, "b", "left").select("a", "b", u.alias("u"), F.coalesce("component", "b").alias("comp"))
    parts = members.groupBy("a", "comp").agg(F.min("u").alias("u"))
    own = groups.select(F.col("node").alias("a"), F.col("component").alias("own"))
    outside = F.min(F.when(F.col("comp") != F.coalesce("own", "a"), F.col("u")))
    stars = (parts.join(own, "a", "left").groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.min("u").alias("any"), outside.alias("out"), F.coalesce(F.max("own"), F.col("a")).alias("own"))
             .filter("k > 1").drop("k").withColumn("salt", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))))
    joined = members.withColumn("salt", F.expr(f"pmod(xxhash64(b), {SALTS})")).join(stars, ["a", "salt"])
    main = F.col("comp") == F.col("own")
    return joined.select("a", "b", "u", "comp", main.alias("main"), F.when(main, F.col("out")).otherwise(F.col("any")).alias("least"))


def differences(members: DataFrame, sets: DataFrame, frequency, similarity: int, kind: str) -> DataFrame:
    """(key, id, p, u, r, d, e, part, comp, main): prefix entries of b's difference from its centre, rare elements first."""
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = frequency.value
        for batch in sliced(batches):
            keys, rows, rs, ds, es = [], [], [], [], []
            seen = zip(batch.column("x"), batch.column("y"), batch.column("u").to_pylist(), batch.column("least").to_pylist(), batch.column("star").to_pylist())
            for row, (x, y, u, least, star) in enumerate(seen):
                one, two = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                d = np.concatenate([two[~in_first(one, two)], one[~in_first(two, one)]])
                d = d[np.lexsort((d, often[d & np.uint64(BUCKETS - 1)]))]
                reach = 2 * (100 + similarity) * (len(d) - np.arange(len(d))) - u
                m = int((reach >= least).sum())
                with np.errstate(over="ignore"):
                    keys.append(mix(d[:m] ^ mix(np.array([star], np.int64).view(np.uint64))))
                rows.append(np.full(m, row))
                rs.append(reach[:m])
                ds.append(np.full(m, len(d)))
                es.append(np.full(m, m))
            take = pa.array(np.concatenate([*rows, np.empty(0, np.int64)]).astype(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*keys, np.empty(0, np.uint64)]).view(np.int64)), batch.column("b").take(take), batch.column("p").take(take), batch.column("u").take(take),
                                              *[pa.array(np.concatenate([*v, np.empty(0, np.int64)]).astype(np.int64)) for v in (rs, ds, es)],
                                              *[batch.column(c).take(take) for c in ("star", "comp", "main")]], names=["key", "id", "p", "u", "r", "d", "e", "part", "comp", "main"])
    rows = with_sets(members, sets).select("b", "p", "x", "y", "u", "least", "comp", "main", F.xxhash64("a").alias("star"))
    return rows.mapInArrow(make, f"key long, id {kind}, p long, u long, r long, d long, e long, part long, comp {kind}, main boolean")


def join_groups(docs: DataFrame, classes: DataFrame, frequent: np.ndarray, width: int, similarity: int) -> DataFrame:
    """(node, component) of the similarity graph of the classes' first documents."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    entries = index(docs, classes, frequent, width, similarity)
    entries = shared_entries(entries, similarity).withColumn("comp", F.col("id")).withColumn("main", F.lit(False))
    entries = settle(reachable(entries))
    pairs = settle(star_pairs(entries))
    places = entries.groupBy(F.col("id").alias("b")).agg(F.min("p").alias("p"))
    sets = sets_of(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), width)
    frequency = docs.sparkSession.sparkContext.broadcast(rarity(sets))
    links, groups = [], None
    for level in range(STAR_LEVELS + 1):
        checked = compared(pairs, sets, kind)
        links.append(checked.filter((100 + similarity) * F.col("both") >= similarity * (F.col("na") + F.col("nb"))).select(F.col("a").alias("u"), F.col("b").alias("v")))
        if groups is None or links[-1].head(1):
            groups = components(reduce(DataFrame.unionByName, links))
        if level == STAR_LEVELS:
            return groups
        entries = settle(shared_entries(settle(differences(open_members(checked, groups, similarity).join(places, "b"), sets, frequency, similarity, kind)), similarity))
        pairs = settle((star_pairs if level + 1 < STAR_LEVELS else reaching_pairs)(entries))
        if not pairs.head(1):
            return groups


def similar(df: DataFrame, key: str, text: str, width: int = 4, similarity: int = 85) -> DataFrame:
    """One row per document: ``key``, ``n_shingles``, ``class_id`` (first document with its set), ``component_id``.

    ``component_id`` is the smallest key that links lead to: 100 * intersection >= ``similarity`` * union of the sets of
    ``width``-word shingles (64-bit hashes). A text without words, or none, has size 0 and is linked with nothing. Rows of one
    key are one document, with that of their non-empty sets whose hash is lowest. Rows without a key are linked with
    nothing, one by one. Equal sets are one class. Links are not counted: a group of n near copies has up to n * n of them.
    An empty table gives no rows; other columns are ignored.
    """
    short_batches(df.sparkSession)
    docs = pick(df, doc_id=key, text=text)
    counted = settle(sizes(docs, width))
    each, frequent = counted.filter("hits IS NULL").drop("bucket", "hits"), by_bucket(counted.filter("hits IS NOT NULL"))
    named = each.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.when(F.col("set_id").isNotNull(), F.struct("set_id", "n_shingles"))).alias("s"))
    known = named.select("doc_id", F.coalesce("s.n_shingles", F.lit(0)).cast("long").alias("n_shingles"), "s.set_id")
    found = known.filter("set_id IS NOT NULL")
    classes = settle(found.groupBy("set_id").agg(F.min("doc_id").alias("id")))
    groups = join_groups(docs, classes, frequent, width, similarity)
    placed = found.join(classes.withColumnRenamed("id", "class_id"), "set_id").join(groups.withColumnRenamed("node", "class_id"), "class_id", "left")
    placed = placed.select("doc_id", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    out = known.select("doc_id", "n_shingles").join(placed, "doc_id", "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component_id", "doc_id").alias("component_id"))
    nameless = each.filter("doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))
    return out.unionByName(nameless).withColumnRenamed("doc_id", key)


def op13_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar(table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_shingles", "component_id", "class_id")
