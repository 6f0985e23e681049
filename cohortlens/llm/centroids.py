"""Exact k-means on integer vectors by Shallot search.

Every vector carries its centroid, its second nearest centroid, an upper bound of its distance to the first and a
lower bound of its distance to all others. Moved centroids widen the bounds; a vector whose bounds still decide is left
alone. Any other one measures its two remembered centroids, starts at the closer one and looks at that centroid's
neighbours in order of distance, inside a ball whose radius (distance to the start plus distance to the second) shrinks
as closer centroids are found. Bounds are floating point, rounded outwards; survivors are compared in integers.

A round is one pass that writes the vectors with their new bounds, and one that adds up at most k rows a task. Only the
centroids (k x dims numbers) and their sums ever reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle, table

LIMIT = 1 << 27  # of a scaled component, so that squared distances fit a long
SLACK = 1e-9  # outward rounding of bounds, relative and absolute
COLUMNS = ["vec_id", "vec", "cluster", "second", "upper", "lower"]


class Geometry:
    """Centroids with what a pass needs of them: neighbours by distance, nearest separation, moves since the last round."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.c, k = centroids, len(centroids)
        gap = np.sqrt(((centroids[:, None, :] - centroids[None, :, :]) ** 2).sum(2).astype(float))
        np.fill_diagonal(gap, -1.0)
        self.order = np.argsort(gap, axis=1, kind="stable")[:, 1:]  # itself comes first
        self.gap = np.take_along_axis(gap, self.order, 1)
        self.half = self.gap[:, 0] / 2 if k > 1 else np.full(k, np.inf)
        self.moved = np.zeros(k) if before is None else np.sqrt(((centroids - before) ** 2).sum(1).astype(float))
        others = np.tile(self.moved, (k, 1))
        np.fill_diagonal(others, 0.0)
        self.others = others.max(1) if k else self.moved

    def squared(self, x: np.ndarray, to: np.ndarray) -> np.ndarray:
        return ((x - self.c[to]) ** 2).sum(1)

    def search(self, x: np.ndarray, a: np.ndarray, b: np.ndarray):
        """(first, second, squared distances to both) of rows whose remembered centroids are ``a`` and ``b``."""
        d1, d2 = self.squared(x, a), self.squared(x, b)
        swap = (d2 < d1) | ((d2 == d1) & (b < a))
        first, second = np.where(swap, b, a), np.where(swap, a, b)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, reach = first.copy(), np.sqrt(d1.astype(float))
        live = np.arange(len(x))
        for step in range(len(self.c) - 1):
            inside = self.gap[start[live], step] <= (reach[live] + np.sqrt(d2[live].astype(float))) * (1 + SLACK) + SLACK
            live = live[inside]
            if not len(live):
                break
            j = self.order[start[live], step]
            d = self.squared(x[live], j)
            f, s, df, ds = first[live], second[live], d1[live], d2[live]
            nearer = (d < df) | ((d == df) & (j < f))
            between = ~nearer & (j != f) & (j != s) & ((d < ds) | ((d == ds) & (j < s)))
            second[live], d2[live] = np.where(nearer, f, np.where(between, j, s)), np.where(nearer, df, np.where(between, d, ds))
            first[live], d1[live] = np.where(nearer, j, f), np.where(nearer, d, df)
        return first, second, d1, d2

    def update(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> None:
        """Bring assignments and bounds of the rows ``x`` up to date, in place."""
        if len(self.c) < 2:
            a[:], upper[:], lower[:] = 0, np.inf, np.inf
            return
        upper += self.moved[a] * (1 + SLACK) + SLACK
        lower -= self.others[a] * (1 + SLACK) + SLACK
        open_ = np.flatnonzero(upper >= np.maximum(lower, self.half[a] * (1 - SLACK)))
        if len(open_):  # a tight upper bound may already decide
            upper[open_] = np.sqrt(self.squared(x[open_], a[open_]).astype(float)) * (1 + SLACK) + SLACK
            open_ = open_[upper[open_] >= np.maximum(lower[open_], self.half[a[open_]] * (1 - SLACK))]
        if len(open_):
            a[open_], b[open_], d1, d2 = self.search(x[open_], a[open_], b[open_])
            upper[open_] = np.sqrt(d1.astype(float)) * (1 + SLACK) + SLACK
            lower[open_] = np.sqrt(d2.astype(float)) * (1 - SLACK) - SLACK


def rows_of(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("vec").to_pylist()), np.int32).reshape(-1, dims).astype(np.int64)


def integer_vectors(df: DataFrame, key: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(vec_id, vec): floor(scale * component) of the usable vectors, as packed 32-bit integers."""
    x = F.col(f"`{vector}`").cast("array<double>")
    usable = (F.size(x) == dims) & F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) * F.lit(float(scale)) < F.lit(float(LIMIT))), F.lit(False)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            packed = [v.tobytes() for v in np.floor(flat * scale).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(packed, pa.binary())], names=["vec_id", "vec"])
    kept = df.select(F.col(f"`{key}`").alias("vec_id"), x.alias("x"), usable.alias("usable")).filter("usable").select("vec_id", "x")
    return kept.mapInArrow(pack, f"vec_id {kept.schema['vec_id'].dataType.simpleString()}, vec binary")


def seeds(vectors: DataFrame, k: int, seed: str, dims: int) -> np.ndarray:
    """The k vectors with smallest sha256 of ``seed:id``; equal ids go by content."""
    mark = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = vectors.select(mark.alias("mark"), "vec").orderBy("mark", "vec").limit(k).collect()
    return np.array([np.frombuffer(r.vec, np.int32) for r in first], np.int64).reshape(-1, dims)


def reassigned(state: DataFrame, geometry: Geometry, dims: int) -> DataFrame:
    """One pass over all vectors; rows new to the search (no cluster yet) start at centroids 0 and 1 with open bounds."""
    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = rows_of(batch, dims)
            if "cluster" in batch.schema.names:
                a, b, upper, lower = (batch.column(c).to_numpy().copy() for c in COLUMNS[2:])
            else:
                a, b = np.zeros(len(x), np.int32), np.ones(len(x), np.int32)
                upper, lower = np.full(len(x), np.inf), np.full(len(x), -np.inf)
            geometry.update(x, a, b, upper, lower)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("vec"), *map(pa.array, (a, b, upper, lower))], names=COLUMNS)
    kind = state.schema["vec_id"].dataType.simpleString()
    return settle(state.mapInArrow(step, f"vec_id {kind}, vec binary, cluster int, second int, upper double, lower double"))


def moved(state: DataFrame, centroids: np.ndarray, dims: int) -> np.ndarray:
    """floor(sum / count) of every cluster; empty ones stay. Each task sends at most one row for a cluster and component."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dims), np.int64)
        for batch in batches:
            x, a = rows_of(batch, dims), batch.column("cluster").to_numpy()
            for c in np.unique(a):
                n[c] += (a == c).sum()
                total[c] += x[a == c].sum(0)
        c = np.repeat(np.flatnonzero(n), dims)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(np.tile(np.arange(dims, dtype=np.int32), len(c) // dims)),
                                          pa.array(n[c]), pa.array(total[n > 0].reshape(-1))], names=["cluster", "at", "n", "total"])
    sums = (state.select("vec", "cluster").mapInArrow(add, "cluster int, at int, n long, total long").groupBy("cluster", "at")
            .agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect())
    out = centroids.copy()
    for r in sums:
        out[r.cluster, r.at] = int(r.total) // r.n
    return out


def shallot_kmeans(df: DataFrame, key: str = "vec_id", vector: str = "embedding", dims: int = 64, k: int = 16, rounds: int = 3,
                   scale: int = 64, seed: str = "1") -> DataFrame:
    """One row per usable vector: key, ``cluster``, ``distance`` (squared), ``cluster_inertia``, ``inertia``, ``centroid_sha256``.

    Usable are vectors of exactly ``dims`` components, none null or non-finite or, scaled, beyond +-2^27 (squared distances
    would not fit a long); all others have no row. Ties go to the smaller centroid. Repeated ids are separate rows, equal
    ones may both become seeds; a null id hashes like an empty one. Fewer than k vectors give as many centroids; an empty
    table gives no rows. Other columns are ignored.
    """
    vectors = settle(integer_vectors(df, key, vector, dims, scale))
    centroids = seeds(vectors, k, seed, dims)
    kind = vectors.schema["vec_id"].dataType.simpleString()
    if not len(centroids):
        return vectors.select(F.col("vec_id").alias(key), *[F.lit(None).cast(t).alias(c) for c, t in (
            ("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid_sha256", "string"))])
    state, before = vectors, None
    for _ in range(rounds):
        state = reassigned(state, Geometry(centroids, before), dims)
        before, centroids = centroids, moved(state, centroids, dims)
    state = reassigned(state, Geometry(centroids, before), dims)

    final = Geometry(centroids)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a = batch.column("cluster").to_numpy()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("cluster"), pa.array(final.squared(rows_of(batch, dims), a))],
                                             names=["vec_id", "cluster", "distance"])
    far = settle(state.select("vec_id", "vec", "cluster").mapInArrow(measure, f"vec_id {kind}, cluster int, distance long"))
    spread = far.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = df.sparkSession.createDataFrame([(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())],
                                              "cluster int, centroid_sha256 string")
    # at most k rows and one row
    by_cluster = spread.join(F.broadcast(digests), "cluster").crossJoin(F.broadcast(far.agg(F.sum("distance").alias("inertia"))))
    return far.join(F.broadcast(by_cluster), "cluster").select(
        F.col("vec_id").alias(key), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op11_shallot_kmeans(spark, sf_dir: str) -> DataFrame:
    return shallot_kmeans(table(spark, sf_dir, "embeddings"))


def sql(k: int = 16, rounds: int = 3) -> str:
    """The same clustering with all distances measured."""
    parts = [f"""WITH raw AS (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, embedding FROM embeddings WHERE len(embedding) = 64
 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
v AS MATERIALIZED (SELECT r, vec_id, unnest(list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT))) AS x, unnest(range(64)) AS d FROM raw),
first AS (SELECT r, row_number() OVER (ORDER BY sha256('1:' || vec_id), r) - 1 AS k FROM raw QUALIFY k < {k}),
c0 AS MATERIALIZED (SELECT k, d, x FROM v JOIN first USING (r))"""]
    near = """a{i} AS MATERIALIZED (SELECT r, arg_min(k, (dist, k)) AS k, min(dist) AS dist FROM (
 SELECT r, c.k, sum((v.x - c.x) * (v.x - c.x)) AS dist FROM v JOIN c{i} c ON c.d = v.d GROUP BY r, c.k) q GROUP BY r)"""
    for i in range(rounds + 1):
        parts.append(near.format(i=i))
        if i < rounds:
            parts.append(f"""m{i} AS (SELECT a.k, d, sum(x) AS s, count(*) AS n FROM v JOIN a{i} a USING (r) GROUP BY a.k, d),
c{i + 1} AS MATERIALIZED (SELECT c.k, c.d, coalesce(CAST((s - ((s % n) + n) % n) // n AS BIGINT), c.x) AS x FROM c{i} c LEFT JOIN m{i} m ON m.k = c.k AND m.d = c.d)""")
    return ",\n".join(parts) + f"""
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
 CAST(sum(dist) OVER () AS BIGINT) AS inertia, h AS centroid_sha256
FROM a{rounds} a JOIN raw USING (r) JOIN (SELECT k, sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY d)) AS h FROM c{rounds} GROUP BY k) s ON s.k = a.k"""
