"""Draws and AUCs of all bootstrap replicates without a row per cell and replicate.

A replicate's draws are counted where its slots are numbered; the multiplicities of a unit are packed to one byte
per replicate, ``REPS`` replicates per row. Cells (keys, unit, s, p, n) carry a small number for their unit, are sorted
once and cut into chunks of ``CHUNK`` cells, a few bytes a cell. A task takes a share of the chunks and some replicates'
weights of all units side by side, and looks weights up by number: chunks are copied once per set of replicates
and weights once per share, so what moves grows with cells and with units, never with their product. What is left of
a chunk are vectors of (pairs won, positives, negatives) and its two outermost scores, which a neighbour may share.

Draws that follow from a unit's number alone (``Drawn``) are not written or moved at all: a task makes the weights of
its replicates when it starts and reads the written chunks where they lie, so the chunks are on disk once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.draws import draw_slots, unit_draw
from ..functions.prefix import SHARE_BUCKETS, merged, number_rows
from ..session import settle

REPS = 1000   # replicates per packed row
MOST = 255    # a unit drawn more often than this in one replicate is refused (chance below 1 / 255!)
WIDE = 1024   # units of one row of weights
CHUNK = 65536  # cells of one chunk
SHARES = 16   # sets of chunks; the weights are sent once to each
SLOTS = 1 << 16  # slots numbered by one row
SIDE = 64 << 20  # bytes of weights a task holds
COUNTED = 1 << 23  # units whose draws are counted at a time
MADE = 1 << 24  # draws that more tasks than one may make alike
BATCH = 16    # replicates looked up at a time


def _binary(matrix: np.ndarray) -> pa.Array:
    return pa.array([row.tobytes() for row in matrix], pa.binary())


def _narrow(weights: np.ndarray) -> np.ndarray:
    if weights.size and weights.max() > MOST:
        raise ValueError(f"a unit was drawn more than {MOST} times in one replicate")
    return weights.astype(np.uint8)


def pack(drawn: DataFrame, unit="subject") -> DataFrame:
    """(unit, __blk, __w) from (rep, unit, mult): byte i of a block is the multiplicity in replicate __blk * REPS + i."""
    at = F.struct((F.col("rep") % REPS).cast("short").alias("at"), F.least(F.col("mult"), F.lit(MOST + 1)).cast("short").alias("mult"))
    g = drawn.groupBy(unit, F.expr(f"bigint(rep div {REPS})").alias("__blk")).agg(F.collect_list(at).alias("__d"))
    g = g.select(unit, "__blk", F.col("__d.at").alias("__at"), F.col("__d.mult").alias("__mult"))

    def to_bytes(batches):
        for b in batches:
            at, mult = b.column("__at"), b.column("__mult")
            row = np.repeat(np.arange(len(at)), at.value_lengths().to_numpy(zero_copy_only=False))
            w = np.zeros((len(at), REPS), np.int16)
            w[row, at.flatten().to_numpy(zero_copy_only=False)] = mult.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("__blk"), _binary(_narrow(w))], [unit, "__blk", "__w"])

    schema = T.StructType([drawn.schema[unit], T.StructField("__blk", T.LongType()), T.StructField("__w", T.BinaryType())])
    return g.mapInArrow(to_bytes, schema)


def count_draws(indexed: DataFrame, n_boot: int, seed=0, unit="subject", stratum=None) -> DataFrame:
    """Packed multinomial draws of (unit, idx, k): slot i of a replicate takes unit hash(seed|rep|i) mod k.

    With ``stratum``, idx and k count inside a stratum, which is hashed too. Slots are numbered replicate by
    replicate, so a task counts whole replicates and no slot is shuffled.
    """
    # the units of a stratum stand side by side; one row per stratum is numbered
    sizes = indexed.groupBy(*([F.col(stratum).cast("string").alias("__st")] if stratum else [F.lit(None).cast("string").alias("__st")])).agg(F.count(F.lit(1)).alias("__k"))
    sizes = settle(sizes.withColumn("__off", F.sum("__k").over(Window.orderBy("__st").rowsBetween(Window.unboundedPreceding, -1))).fillna({"__off": 0}))
    if stratum:
        indexed = indexed.join(sizes, F.col(stratum).cast("string") == F.col("__st")).withColumn("idx", F.col("idx") + F.col("__off"))
    spark, k = indexed.sparkSession, indexed.count()
    schema = T.StructType([indexed.schema[unit], T.StructField("__blk", T.LongType()), T.StructField("__w", T.BinaryType())])
    if not k:
        return spark.createDataFrame([], schema)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), n_boot * k // 4_000_000)
    pieces = sizes.select("__st", "__k", "__off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__k") - 1, F.lit(SLOTS).cast("long"))).alias("lo"))
    slots = (spark.range(n_boot).withColumnRenamed("id", "rep").crossJoin(pieces).repartition(min(parts, n_boot), "rep").sortWithinPartitions("rep"))

    def tally(batches):
        def out():
            w = _narrow(np.bincount(np.concatenate(seen), minlength=k))
            cut = [w[c:c + WIDE].tobytes() for c in range(0, k, WIDE)]
            return pa.RecordBatch.from_arrays([pa.array([rep] * len(cut), pa.int64()), pa.array(range(len(cut)), pa.int64()), pa.array(cut, pa.binary())], ["rep", "c", "w"])

        rep, seen = None, []
        for b in batches:
            for r, st, n, off, lo in zip(*(b.column(x).to_pylist() for x in ("rep", "__st", "__k", "__off", "lo"))):
                if r != rep:
                    if seen:
                        yield out()
                    rep, seen = r, []
                got = draw_slots((seed, r) if st is None else (seed, r, st), lo, min(lo + SLOTS, n))
                seen.append((got % n + off).astype(np.int32 if k < 1 << 31 else np.int64))
        if seen:
            yield out()

    counted = slots.mapInArrow(tally, "rep bigint, c bigint, w binary").withColumn("__blk", F.expr(f"rep div {REPS}"))

    def turn(batches):
        """Replicate by replicate to unit by unit; a replicate may come in two parts."""
        def out():
            c, blk = at
            w = _narrow(m.T[:min(WIDE, k - c * WIDE)])
            return pa.RecordBatch.from_arrays([pa.array(np.arange(len(w)) + c * WIDE), pa.array([blk] * len(w), pa.int64()), _binary(w)], ["idx", "__blk", "__w"])

        at, m = None, None
        for b in batches:
            for rep, c, blk, w in zip(*(b.column(x).to_pylist() for x in ("rep", "c", "__blk", "w"))):
                if (c, blk) != at:
                    if at is not None:
                        yield out()
                    at, m = (c, blk), np.zeros((REPS, WIDE), np.uint16)
                m[rep % REPS, :len(w)] += np.frombuffer(w, np.uint8)
        if at is not None:
            yield out()

    whole = counted.repartition("c", "__blk").sortWithinPartitions("c", "__blk").mapInArrow(turn, "idx bigint, __blk bigint, __w binary")
    return merged(whole).join(indexed.select("idx", unit), "idx").select(unit, "__blk", "__w")


@dataclass(frozen=True)
class Drawn:
    """The multinomial draws of ``count_draws`` without strata, made anew in each task: units numbered (unit, __at) from 0 to k - 1."""
    index: DataFrame
    k: int
    n_boot: int
    seed: object


def drawn_here(indexed: DataFrame, n_boot: int, seed=0, unit="subject") -> Drawn:
    index = indexed.select(unit, F.col("idx").alias("__at"))
    return Drawn(index, index.count(), n_boot, seed)


def make_weights(seed, k: int, first: int, size: int) -> np.ndarray:
    """Multiplicities of k units in ``size`` replicates from ``first`` on."""
    side = np.zeros((size, k), np.uint8)
    slots = np.empty(k, np.int32 if k < 1 << 31 else np.int64)
    for i in range(size):
        for lo in range(0, k, SLOTS):
            slots[lo:lo + SLOTS] = draw_slots((seed, first + i), lo, min(lo + SLOTS, k)) % k
        for lo in range(0, k, COUNTED):  # bounds the counts of eight bytes
            here = slots if k <= COUNTED else slots[(slots >= lo) & (slots < lo + COUNTED)] - lo
            side[i, lo:lo + COUNTED] = _narrow(np.bincount(here, minlength=min(COUNTED, k - lo)))
    return side


def split_draws(indexed: DataFrame, n_boot: int, seed=0, unit="subject") -> DataFrame:
    """Packed multinomial draws made where a unit lies, from (unit, idx, k) with idx in 0..k-1.

    The k slots of a replicate are dealt down a binary tree over 0..k-1: a node passes a binomial share of
    its slots to its left half. The generator of a node is keyed by seed, block and node, so every task
    finds the same numbers, and the leaves of a replicate sum to k. Nothing is shuffled.
    """
    blocks = -(-n_boot // REPS)
    rows = indexed.select(unit, "idx", "k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("__blk"))

    def deal(batches):
        @lru_cache(maxsize=4096)
        def slots(k, blk, lo, hi):
            """Slots of node [lo, hi) in each replicate of the block."""
            if (lo, hi) == (0, k):
                left = np.full(REPS, k, np.int64)
                left[max(0, min(REPS, n_boot - blk * REPS)):] = 0
                return left
            up = parent(k, lo, hi)
            whole, mid = slots(k, blk, *up), (up[0] + up[1]) // 2
            gen = np.random.Generator(np.random.Philox(np.random.SeedSequence([seed, blk, k, up[0], up[1]])))
            first = gen.binomial(whole, (mid - up[0]) / (up[1] - up[0]))
            return first if lo == up[0] else whole - first

        @lru_cache(maxsize=4096)
        def parent(k, lo, hi):
            a, b = 0, k
            while True:
                mid = (a + b) // 2
                child = (a, mid) if hi <= mid else (mid, b)
                if child == (lo, hi):
                    return a, b
                a, b = child

        def leaf(k, blk, i):
            a, b = 0, k
            while b - a > 1:
                mid = (a + b) // 2
                a, b = (a, mid) if i < mid else (mid, b)
            return slots(k, blk, a, b)

        for b in batches:
            idx, k, blk = (b.column(c).to_pylist() for c in ("idx", "k", "__blk"))
            w = np.stack([leaf(*x) for x in zip(k, blk, idx)]) if idx else np.zeros((0, REPS), np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column("__blk"), _binary(_narrow(w))], [unit, "__blk", "__w"])

    schema = T.StructType([indexed.schema[unit], T.StructField("__blk", T.LongType()), T.StructField("__w", T.BinaryType())])
    return rows.mapInArrow(deal, schema)


def split_halves(units: DataFrame, n_rep: int, seed=0, unit="subject") -> DataFrame:
    """(unit, __blk, __w): 1 for the k div 2 units of a replicate with the smallest (draw, unit), else 0, packed.

    A unit's draws are made and kept where it lies. The middle of a replicate is found by counting draws in ``SHARE_BUCKETS``
    steps; only the draws of the step it is in are numbered, so no draw is sorted or moved for the rest.
    """
    steps = F.lit(float(SHARE_BUCKETS))
    u = units.select(unit).distinct()
    reps = F.sequence(F.lit(0), F.lit(n_rep - 1))
    u = settle(u.select(unit, F.transform(reps, lambda i: unit_draw(seed, "half", i, F.col(unit))).alias("__d")))
    want = u.count() // 2
    each = u.select(unit, F.posexplode("__d").alias("rep", "__h")).withColumn("__s", F.floor(F.col("__h") * steps))
    upto = Window.partitionBy("rep").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    tally = each.groupBy("rep", "__s").agg(F.count(F.lit(1)).alias("__n")).withColumn("__before", F.coalesce(F.sum("__n").over(upto), F.lit(0)))
    middle = tally.filter((F.col("__before") < want) & (F.col("__before") + F.col("__n") >= want)).select("rep", "__s", "__before")  # a row per replicate
    inside = each.join(F.broadcast(middle), ["rep", "__s"])
    last = inside.withColumn("__r", F.col("__before") + F.row_number().over(Window.partitionBy("rep").orderBy("__h", unit))).filter(F.col("__r") == want)
    ends = last.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("rep", F.struct(F.col("__h").alias("h"), F.col(unit).alias("u"))))).alias("__e"))
    ends = ends.select(F.transform(reps, lambda i: F.element_at("__e", i)).alias("__e"))  # n_rep numbers, the same for all units
    first = lambda x, e: (x < e["h"]) | ((x == e["h"]) & (F.col(unit).isNull() | F.coalesce(F.col(unit) <= e["u"], F.lit(False))))
    w = u.crossJoin(F.broadcast(ends)).select(unit, F.zip_with("__d", "__e", lambda x, e: F.coalesce(first(x, e), F.lit(False))).alias("__half"))
    blocks = -(-n_rep // REPS)

    def to_bytes(batches):
        for b in batches:
            m = np.zeros((b.num_rows, blocks * REPS), np.uint8)
            m[:, :n_rep] = b.column("__half").flatten().to_numpy(zero_copy_only=False).reshape(-1, n_rep)
            for blk in range(blocks):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array([blk] * b.num_rows, pa.int64()), _binary(m[:, blk * REPS:(blk + 1) * REPS])], [unit, "__blk", "__w"])

    return w.mapInArrow(to_bytes, T.StructType([units.schema[unit], T.StructField("__blk", T.LongType()), T.StructField("__w", T.BinaryType())]))


def drawn_units(packs: DataFrame) -> DataFrame:
    """(rep, __u): how many different units a replicate drew; replicates without any are not listed."""
    def tally(batches):
        seen = {}
        for b in batches:
            blks, w = b.column("__blk").to_pylist(), b.column("__w").to_pylist()
            for blk, x in zip(blks, w):
                row = np.frombuffer(x, np.uint8) > 0
                seen[blk] = seen[blk] + row if blk in seen else row.astype(np.int64)
        for blk, x in seen.items():
            yield pa.RecordBatch.from_pydict({"__blk": pa.array([blk], pa.int64()), "c": pa.array([x.tolist()], pa.list_(pa.int64()))})

    t = packs.select("__blk", "__w").mapInArrow(tally, "__blk bigint, c array<bigint>")
    return (t.select("__blk", F.posexplode("c").alias("i", "c")).groupBy((F.col("__blk") * REPS + F.col("i")).alias("rep"))
            .agg(F.sum("c").alias("__u")).filter("__u > 0"))


def numbered_units(packs: DataFrame, unit="subject") -> DataFrame:
    """(unit, __at): numbers from 0 for the units that have weights."""
    u = packs.select(unit).distinct().withColumn("__h", unit_draw("at", F.col(unit)))
    return number_rows(u, [], ["__h", unit], F.col("__h"), "__at", by_share=True).select(unit, (F.col("__at") - 1).alias("__at"))


def _sets(blk: int, size: int, n_rep: int | None) -> list:
    """Numbers inside a block of the sets of ``size`` replicates that hold any of the first ``n_rep``."""
    return [j for j in range(REPS // size) if n_rep is None or blk * REPS + j * size < n_rep]


def sides(packs: DataFrame, index: DataFrame, size: int, unit="subject", n_rep=None) -> DataFrame:
    """(__q, c, w): weights of ``WIDE`` units in ``size`` replicates, replicate by replicate."""
    d = packs.join(index, unit).select((F.col("__at") % WIDE).alias("i"), F.expr(f"__at div {WIDE}").alias("c"), "__blk", "__w")

    def turn(batches):
        def out():
            js = _sets(at[1], size, n_rep)
            return pa.RecordBatch.from_arrays([
                pa.array([at[1] * (REPS // size) + j for j in js], pa.int64()), pa.array([at[0]] * len(js), pa.int64()),
                pa.array([m[:, j * size:(j + 1) * size].T.tobytes() for j in js], pa.binary())], ["__q", "c", "w"])

        at, m = None, None
        for b in batches:
            for i, c, blk, w in zip(*(b.column(x).to_pylist() for x in ("i", "c", "__blk", "__w"))):
                if (c, blk) != at:
                    if at is not None:
                        yield out()
                    at, m = (c, blk), np.zeros((WIDE, REPS), np.uint8)
                m[i] = np.frombuffer(w, np.uint8)
        if at is not None:
            yield out()

    return d.repartition("c", "__blk").sortWithinPartitions("c", "__blk").mapInArrow(turn, "__q bigint, c bigint, w binary")


def _chunk(s, p, n, at) -> dict:
    """The sorted cells of one chunk as unit numbers: first score, last score, and what lies between.

    ``lo`` and ``hi`` are the negatives below and up to each score that has positives, counted between the outer scores.
    """
    first, last = s == s[0], (s == s[-1]) & (s != s[0])
    isneg, ispos = n > 0, p > 0
    mid = ~first & ~last
    ns, ps = s[mid & isneg], s[mid & ispos]
    g = np.flatnonzero(np.r_[True, ps[1:] != ps[:-1]]) if len(ps) else np.zeros(0, np.int64)
    order = lambda has: np.r_[np.flatnonzero(first & has), np.flatnonzero(mid & has), np.flatnonzero(last & has)]
    ni, pi = order(isneg), order(ispos)
    ones = lambda v: b"" if (v == 1).all() else v.astype(np.float64).tobytes()
    b32 = lambda v: v.astype(np.int32).tobytes()
    cut = [(first & isneg).sum(), len(ni) - (last & isneg).sum(), (first & ispos).sum(), len(pi) - (last & ispos).sum(), last.any(), mid.any()]
    return {"s0": s[0], "s1": s[-1], "sm": s[mid][0] if mid.any() else s[0], "neg": b32(at[ni]), "pos": b32(at[pi]), "nn": ones(n[ni]), "pp": ones(p[pi]),
            "g": b32(g), "lo": b32(np.searchsorted(ns, ps[g], "left")), "hi": b32(np.searchsorted(ns, ps[g], "right")), "cut": b32(np.array(cut))}


PARTS = [("s0", T.DoubleType()), ("s1", T.DoubleType()), ("sm", T.DoubleType()), *[(x, T.BinaryType()) for x in ("neg", "pos", "nn", "pp", "g", "lo", "hi", "cut")]]


def chunks(cells: DataFrame, index: DataFrame, keys, unit="subject", write=True) -> DataFrame:
    """(keys, __g, parts of ``_chunk``): cells of each key in order of s; __g is a chunk's share.

    Without ``write`` the cells are joined twice, for the bounds of the ranges and for the ranges, and rows of one cell are added up here.
    """
    keys = list(keys)
    tasks = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    d = cells if "__at" in cells.columns else cells.join(index, unit)
    d = d.select(*keys, *[F.col(c).cast("double").alias(c) for c in ("s", "p", "n")], "__at")
    d = (settle(d) if write else d).repartitionByRange(tasks, *keys, "s", "__at")  # a score that many units share is cut by the unit
    d = d.withColumn("__g", F.spark_partition_id()).sortWithinPartitions(*keys, "s", *([] if write else ["__at"]))
    schema = T.StructType([*[cells.schema[k] for k in keys], T.StructField("__g", T.LongType()), *[T.StructField(*x) for x in PARTS]])

    def cut(batches):
        def out():
            nonlocal made
            s, p, n, at = (np.concatenate([x[i] for x in held]) for i in range(4))
            if not write:
                first = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (at[1:] != at[:-1])])
                s, p, n, at = s[first], np.add.reduceat(p, first), np.add.reduceat(n, first), at[first]
            row = _chunk(s, p, n, at)
            made += 1
            cols = [*[pa.array([v], k) for v, k in zip(key, kinds)], pa.array([(part + made) % SHARES], pa.int64()),
                    *[pa.array([row[c]], pa.float64() if isinstance(t, T.DoubleType) else pa.binary()) for c, t in PARTS]]
            return pa.RecordBatch.from_arrays(cols, [*keys, "__g", *[c for c, _ in PARTS]])

        key, kinds, held, size, part, made = None, None, [], 0, 0, 0
        for b in batches:
            if not b.num_rows:
                continue
            kinds, part = [b.column(k).type for k in keys], b.column("__g")[0].as_py()
            cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("s", "p", "n", "__at")]
            ends = {b.num_rows}
            for k in keys:
                ends |= set(pc.run_end_encode(b.column(k)).run_ends.to_pylist())
            i = 0
            for j in sorted(ends):
                mine = tuple(b.column(k)[i].as_py() for k in keys)
                if held and (mine != key or size >= CHUNK):
                    yield out()
                    held, size = [], 0
                key = mine
                held.append([c[i:j].copy() for c in cols])
                size, i = size + j - i, j
        if held:
            yield out()

    return d.mapInArrow(cut, schema)


def _weigh(row, side, size, both=False) -> list:
    """(s, tie, won, pos, neg) of the first score, the last and the middle of one chunk, vectors over replicates.

    With ``both``, weights are 0 and 1, and the vectors go on with the replicates of the weights 1 - w.
    """
    i32 = lambda c: np.frombuffer(row[c], np.int32)
    neg, pos, g, lo, hi = (i32(c).astype(np.intp) for c in ("neg", "pos", "g", "lo", "hi"))
    nn, pp = (np.frombuffer(row[c], np.float64) if row[c] else None for c in ("nn", "pp"))
    n0, n1, p0, p1, has_last, has_mid = i32("cut")
    m = n1 - n0
    edges = np.unique(np.r_[0, lo, hi])
    edges = edges[edges < m]
    ends = np.r_[edges, m]
    below_lo, below_hi = np.searchsorted(ends, lo), np.searchsorted(ends, hi)
    res = np.zeros((7, size * (1 + both)))
    for r in range(0, size, BATCH):
        w = side[r:r + BATCH]
        looked = np.take(w, neg, axis=1, mode="clip"), np.take(w, pos, axis=1, mode="clip")
        for other in range(1 + both):
            N, P = (x if k is None else x * k for x, k in zip((1 - x if other else x for x in looked), (nn, pp)))
            at = slice(other * size + r, other * size + r + len(w))
            total = lambda x: x.sum(axis=1, dtype=np.float64)
            res[0, at], res[1, at] = total(P[:, :p0]), total(N[:, :n0])
            res[2, at], res[3, at] = total(P[:, p1:]), total(N[:, n1:])
            upto = np.zeros((len(w), len(edges) + 1))
            if m:
                np.cumsum(np.add.reduceat(N[:, n0:n1], edges, axis=1, dtype=np.uint32 if nn is None else np.float64), axis=1, out=upto[:, 1:])
            if len(g):
                gp = np.add.reduceat(P[:, p0:p1], g, axis=1, dtype=np.float64)
                res[4, at] = np.einsum("ij,ij->i", gp, upto[:, below_lo] + upto[:, below_hi]) / 2
                res[5, at] = gp.sum(axis=1)
            res[6, at] = upto[:, -1]
    zero = np.zeros(size * (1 + both))
    rows = [(row["s0"], True, zero, res[0], res[1])]
    if has_last:
        rows.append((row["s1"], True, zero, res[2], res[3]))
    if has_mid:
        rows.append((row["sm"], False, res[4], res[5], res[6]))
    return rows


VECTORS = ("won", "pos", "neg")


def _weighed_schema(cells: DataFrame, keys) -> T.StructType:
    return T.StructType([T.StructField("__q", T.LongType()), *[T.StructField(x, cells.schema[x].dataType) for x in keys], T.StructField("s", T.DoubleType()),
                         T.StructField("tie", T.BooleanType()), *[T.StructField(x, T.ArrayType(T.DoubleType())) for x in VECTORS]])


def _weighed(b, i, q, keys, side, size, both=False) -> pa.RecordBatch:
    """The rows of ``_weigh`` of the chunk in row i of a batch."""
    rows = _weigh({x: b.column(x)[i].as_py() for x, _ in PARTS}, side, size, both)
    n = len(rows)
    vec = lambda j: pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * len(rows[0][j])), pa.array(np.concatenate([r[j] for r in rows])))
    cols = [pa.array([q] * n, pa.int64()), *[pa.array([b.column(x)[i].as_py()] * n, b.column(x).type) for x in keys],
            pa.array([r[0] for r in rows], pa.float64()), pa.array([r[1] for r in rows], pa.bool_()), vec(2), vec(3), vec(4)]
    return pa.RecordBatch.from_arrays(cols, ["__q", *keys, "s", "tie", *VECTORS])


def set_size(k: int) -> int:
    """Replicates whose weights of k units a task holds; divides ``REPS``."""
    return next((x for x in (250, 125, 100, 50, 25, 10, 5) if x * k <= SIDE), 2)


def drawn_ranges(cells: DataFrame, drawn: Drawn, keys, unit="subject") -> tuple[DataFrame, int]:
    """``ranges`` of draws that each task makes itself; a row without ``tie`` tells how many units each replicate of a set drew.

    Every set of replicates meets the written chunks in a task that reads them from their files (a product without a shuffle).
    Where many draws belong to a set, one task reads all chunks, so that no draw is made twice.
    """
    keys = list(keys)
    spark = cells.sparkSession
    seed, k, n_boot, size = drawn.seed, drawn.k, drawn.n_boot, set_size(drawn.k)
    c = settle(chunks(cells, drawn.index, keys, unit, write=False).drop("__g"))
    sets = -(-n_boot // size)
    tasks = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // sets)
    parts = 1 if size * k > MADE else max(1, min(tasks, c.count()))
    each = spark.range(0, sets, 1, sets).withColumnRenamed("id", "__q")
    schema = _weighed_schema(cells, keys)

    def walk(batches):
        at, side = None, None
        for b in batches:
            qs = b.column("__q").to_pylist()
            for i in range(b.num_rows):
                if qs[i] != at:
                    at, side = qs[i], None
                    side = make_weights(seed, k, at * size, min(size, n_boot - at * size))
                    seen = [np.count_nonzero(side[j]) for j in range(len(side))]
                    row = {x: pa.array([None], b.column(x).type) for x in keys}
                    row |= {"__q": pa.array([at], pa.int64()), "s": pa.array([None], pa.float64()), "tie": pa.array([None], pa.bool_())}
                    row |= {x: pa.array([np.array(seen, np.float64)], pa.list_(pa.float64())) for x in VECTORS}
                    yield pa.RecordBatch.from_arrays([row[x.name] for x in schema], [x.name for x in schema])
                yield _weighed(b, i, at, keys, side, len(side))

    return c.coalesce(parts).hint("shuffle_replicate_nl").crossJoin(each).mapInArrow(walk, schema), size


def ranges(cells: DataFrame, packs: DataFrame, keys, unit="subject", halves=None) -> tuple[DataFrame, int]:
    """((__q, keys, s, tie, won, pos, neg), size): at most three rows per chunk and set of ``size`` replicates.

    ``halves``: as many replicates of weights 0 and 1, read with the weights and with 1 - w.
    """
    keys = list(keys)
    spark = cells.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    index = settle(numbered_units(packs, unit))
    k, blocks = index.count(), [x[0] for x in packs.select("__blk").distinct().collect()]  # thousands of replicates: few
    size = set_size(k)
    q = F.explode(F.array(*[F.lit(b * (REPS // size) + j).cast("long") for b in blocks or [0] for j in _sets(b, size, halves)])).alias("__q")
    c = chunks(cells, index, keys, unit).select("*", q)
    w = sides(packs, index, size, unit, halves).select("__q", "c", "w", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("__g"))
    both = w.unionByName(c, allowMissingColumns=True).repartition(tasks, "__q", "__g").sortWithinPartitions("__q", "__g", F.col("c").asc_nulls_last())
    schema = _weighed_schema(cells, keys)

    def walk(batches):
        at, side = None, None
        for b in batches:
            where = list(zip(b.column("__q").to_pylist(), b.column("__g").to_pylist()))
            cs = b.column("c").to_pylist()
            for i in range(b.num_rows):
                if where[i] != at:
                    at, side = where[i], np.zeros((size, k), np.uint8)
                if cs[i] is not None:
                    m = np.frombuffer(b.column("w")[i].as_buffer(), np.uint8).reshape(size, WIDE)
                    lo = cs[i] * WIDE
                    side[:, lo:lo + WIDE] = m[:, :min(WIDE, k - lo)]
                    continue
                yield _weighed(b, i, at[0], keys, side, size, halves is not None)

    return both.mapInArrow(walk, schema), size


def replicate_auc(cells: DataFrame, packs: DataFrame, keys=(), unit="subject", least=2, counts=False, halves=None) -> DataFrame:
    """(rep, keys, auc) of draws, packed or ``Drawn``; null where a replicate has under ``least`` distinct units or one class.

    With ``counts`` also the replicate's n_pos and n_neg. With ``halves``, the number of replicates, weights are 0 and 1 and
    tell the units of half 1 from those of half 0: (rep, half, keys, auc), null where a half has one class.
    """
    keys = list(keys)
    here = isinstance(packs, Drawn)
    packs = packs if here else settle(packs)
    r, size = drawn_ranges(cells, packs, keys, unit) if here else ranges(cells, packs, keys, unit, halves)
    r = settle(r)
    e = (r.filter("tie IS NOT NULL") if here else r).select("*", F.posexplode(F.arrays_zip("won", "pos", "neg")).alias("__i", "__x")).drop("won", "pos", "neg")
    if halves is not None:
        e = e.withColumn("half", (F.col("__i") < size).cast("int")).withColumn("rep", F.col("__q") * size + F.col("__i") % size).filter(F.col("rep") < halves)
        keys = [*keys, "half"]
    else:
        e = e.withColumn("rep", F.col("__q") * size + F.col("__i"))
    g = e.groupBy("rep", *keys, "s").agg(
        F.max("tie").alias("tie"), F.sum("__x.won").alias("won"), F.sum("__x.pos").alias("pos"), F.sum("__x.neg").alias("neg"))
    won = F.col("won") + F.when(F.col("tie"), F.col("pos") * F.col("neg") / 2).otherwise(0.0)
    before = Window.partitionBy("rep", *keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)  # three rows a chunk
    num = won + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0.0))
    t = g.select("rep", *keys, num.alias("num"), "pos", "neg").groupBy("rep", *keys).agg(
        F.sum("num").alias("num"), F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    if halves is not None:
        both = (F.col("pos") > 0) & (F.col("neg") > 0)
        return t.select("rep", *keys, F.when(both, F.col("num") / (F.col("pos") * F.col("neg"))).alias("auc"))
    auc = F.when((F.col("__u") >= least) & (F.col("pos") > 0) & (F.col("neg") > 0), F.col("num") / (F.col("pos") * F.col("neg")))
    if here:
        units = r.filter("tie IS NULL").select("__q", F.posexplode("won").alias("__i", "__u")).groupBy((F.col("__q") * size + F.col("__i")).alias("rep")).agg(F.max("__u").alias("__u"))
    else:
        units = drawn_units(packs)
    return t.join(units, "rep").select("rep", *keys, auc.alias("auc"), *([F.col("pos").cast("long").alias("n_pos"), F.col("neg").cast("long").alias("n_neg")] if counts else []))


def weighted_sums(values: DataFrame, packs: DataFrame, keys, cols, unit="subject") -> DataFrame:
    """(rep, keys, cols): per replicate the sums of ``cols`` times the units' multiplicities; a null adds nothing."""
    keys, cols = list(keys), list(cols)
    j = packs.join(values.select(unit, *keys, *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in cols]), unit).select("__blk", *keys, *cols, "__w")
    schema = T.StructType([T.StructField("__blk", T.LongType()), *[j.schema[k] for k in keys], *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in cols]])

    def add(batches):
        acc, kinds = {}, None

        def out():
            at = list(acc)
            each = lambda i: pa.array([list(acc[a][i]) for a in at], pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([pa.array([a[0] for a in at], pa.int64()), *[pa.array([a[i + 1] for a in at], t) for i, t in enumerate(kinds)],
                                               *[each(i) for i in range(len(cols))]], ["__blk", *keys, *cols])

        for b in batches:
            kinds = [b.column(k).type for k in keys]
            rows = {}
            for i, a in enumerate(zip(*[b.column(k).to_pylist() for k in ("__blk", *keys)])):
                rows.setdefault(a, []).append(i)
            v = np.stack([b.column(c).to_numpy(zero_copy_only=False) for c in cols]) if b.num_rows else None
            w = b.column("__w")
            for a, at in rows.items():
                got = sum(v[:, at[i:i + 512]] @ np.frombuffer(b"".join(w.take(pa.array(at[i:i + 512])).to_pylist()), np.uint8).reshape(-1, REPS).astype(np.float64)
                          for i in range(0, len(at), 512))
                acc[a] = acc[a] + got if a in acc else got
            if len(acc) > 1000:
                yield out()
                acc = {}
        if acc:
            yield out()

    t = j.mapInArrow(add, schema).select("__blk", *keys, F.posexplode(F.arrays_zip(*cols)).alias("__i", "__x"))
    g = t.groupBy((F.col("__blk") * REPS + F.col("__i")).alias("rep"), *keys).agg(*[F.sum(F.col("__x")[c]).alias(c) for c in cols])
    return g.join(drawn_units(packs), "rep").drop("__u")
