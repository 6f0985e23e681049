"""Ordered prefixes (row numbers, running sums) that survive a hot key.

A window function keeps one key in one task. These helpers cut a key into ordered buckets,
work inside the buckets, and carry bucket totals over. The bucket of a row is a function of the
row alone, so both branches of a plan agree on it even after a task is recomputed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARE_BUCKETS = 4096  # buckets of a uniform lead
HOT_ROWS = 10_000  # a key with more rows is numbered bucket by bucket
TASK_ROWS = 500_000  # rows a task sorts, where the number of tasks follows the table


def spread(c: Column) -> Column:
    """Monotone bucket number of a finite double; null of a null, which an ascending order puts first.

    Log-spaced over all magnitudes with extra linear steps in [-2, 2], where scores live: about
    11,000 buckets on [0, 1]. Every step is a monotone float operation, so order is kept.
    """
    x = F.greatest(F.lit(-1e300), F.least(F.lit(1e300), c.cast("double")))
    curve = F.signum(x) * F.log1p(F.abs(x) * F.lit(1e6)) * F.lit(256.0)
    line = F.greatest(F.lit(-2.0), F.least(F.lit(2.0), x)) * F.lit(8192.0)
    return F.when(c.isNotNull(), F.floor(curve + line).cast("long"))


def null_safe_join(left: DataFrame, right: DataFrame, keys, how="inner") -> DataFrame:
    """Equi-join on ``keys`` where a null key meets a null key; right keys are dropped."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(right)
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def merged(df: DataFrame) -> DataFrame:
    """``df`` with the wish for a sort-merge join.

    Sizes are guessed from the files before rows are copied per permutation, draw or arm, so without it
    either side of a join of copies may pass for small and be collected on the driver.
    """
    return df.hint("merge")


def tasks_for(table: DataFrame, copies=1) -> int:
    """Partitions that leave ``TASK_ROWS`` rows to a task, the session's number at least; counted in the footers of a file.

    ``copies``: rows that come of each row of the table.
    """
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-table.count() * copies // TASK_ROWS))


def group_stats(df: DataFrame, keys, *aggs: Column) -> DataFrame:
    """Attach per-group aggregates to every row: partial aggregation plus a join.

    A whole-partition window would pull each group into one task; here the rows of a hot group
    stay spread out (the join side is one row per group and adaptive execution splits skew).
    """
    keys = list(keys)
    stats = df.groupBy(*keys).agg(*aggs)
    return null_safe_join(df, stats, keys)


def text_lead(c: Column) -> Column:
    """Lead of a text order: its first three code points as one number."""
    code = lambda i: F.ascii(F.substring(c, i, 1)).cast("long")
    return code(1) * F.lit(1 << 42) + code(2) * F.lit(1 << 21) + code(3)


def packed(df: DataFrame, keys) -> DataFrame:
    """``keys`` as one struct ``__key`` behind its hash ``__kh``, other columns kept.

    A struct is never null and equal structs meet, so a window and the join after it ask for the same
    columns: the rows are shuffled and sorted once for both.
    """
    return df.select(F.xxhash64(*keys).alias("__kh"), F.struct(*keys).alias("__key"), *[F.col(f"`{c}`") for c in df.columns if c not in keys])


def _unpacked(df: DataFrame, keys, columns) -> DataFrame:
    return df.select(*[F.col(f"__key.`{c}`").alias(c) if c in keys else F.col(f"`{c}`") for c in columns if c != "__all"])


def number_rows(df: DataFrame, keys, order, lead: Column, out: str, by_share=False, tasks=None) -> DataFrame:
    """``row_number() over (partition by keys order by order)`` that survives a hot key.

    ``lead`` must not decrease along ``order``: a bucket number, or with ``by_share`` a uniform number
    in [0, 1). Rows of a key with more than ``HOT_ROWS`` rows are cut by it, numbered inside (key, bucket) and
    shifted by the totals of earlier buckets; any other key is one bucket. What is broadcast are the hot
    keys, at most one for each ``HOT_ROWS`` rows: one plan for tables of every size. ``tasks`` deals the rows to that
    many partitions, so that a sort does not grow with the table.
    """
    keys = list(keys)
    made = not keys
    if made:
        df, keys = df.withColumn("__all", F.lit(1)), ["__all"]
    columns = [*[c for c in df.columns if c != out], out]
    share = F.floor(lead * F.lit(float(SHARE_BUCKETS))) if by_share else lead
    marked = packed(df.withColumn("__bucket", F.coalesce(share.cast("long"), F.lit(-1 << 63))), keys)
    at = ["__kh", "__key", "__bucket"]
    if not made:
        hot = (marked.groupBy("__kh", "__key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS)
               .select("__kh", "__key", F.lit(True).alias("__hot")))
        marked = marked.join(F.broadcast(hot), ["__kh", "__key"], "left").withColumn(
            "__bucket", F.when(F.col("__hot"), F.col("__bucket")).otherwise(F.lit(0)))
    if tasks:
        marked = marked.repartition(tasks, *at)
    within = Window.partitionBy(*at).orderBy(*[c for c in order if not (isinstance(c, str) and c in keys)] or ["__bucket"])
    numbered = marked.withColumn(out, F.row_number().over(within).cast("long"))
    totals = (marked if made else marked.filter("__hot")).groupBy(*at).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy("__kh", "__key").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*at, F.sum("__n").over(before).alias("__off"))
    joined = numbered.join(offsets.hint("merge"), at, "left").withColumn(out, F.col(out) + F.coalesce("__off", F.lit(0)))
    return _unpacked(joined, keys, columns)


def running(df: DataFrame, keys, order, lead: Column, **cols) -> DataFrame:
    """Inclusive running sums of pre-aggregated rows: ``out=column`` per keyword.

    Always cut by ``lead`` (a non-decreasing bucket along ``order``); the offset table holds one
    row per bucket. The big side is shuffled once, by (keys, bucket), for window and join.
    """
    keys = list(keys)
    if not keys:
        df, keys = df.withColumn("__all", F.lit(1)), ["__all"]
    columns = [*[c for c in df.columns if c not in cols], *cols]
    marked = packed(df.withColumn("__bucket", F.coalesce(lead.cast("long"), F.lit(-1 << 63))), keys)
    at = ["__kh", "__key", "__bucket"]
    within = Window.partitionBy(*at).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inner = marked.select("*", *[F.sum(c).over(within).alias(f"__i_{o}") for o, c in cols.items()])
    totals = marked.groupBy(*at).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in cols.items()])
    before = Window.partitionBy("__kh", "__key").orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    offsets = totals.select(*at, *[F.coalesce(F.sum(f"__t_{o}").over(before), F.lit(0)).alias(f"__o_{o}") for o in cols])
    joined = inner.join(offsets.hint("merge"), at)
    return _unpacked(joined.withColumns({o: F.col(f"__i_{o}") + F.col(f"__o_{o}") for o in cols}), keys, columns)


def running_small(df: DataFrame, keys, order, lead: Column, **cols) -> DataFrame:
    """``running`` for many keys of which most are small, with the keys' sums as ``<out>_all``; ``df`` is read three times.

    Only keys of more than ``HOT_ROWS`` rows are cut by ``lead`` and have offsets; any other key is one bucket, so a
    table of small keys is sorted once and joined with nothing.
    """
    keys = list(keys)
    columns = [*[c for c in df.columns if c not in cols], *cols, *[f"{o}_all" for o in cols]]
    marked = packed(df.withColumn("__bucket", F.coalesce(lead.cast("long"), F.lit(-1 << 63))), keys)
    hot = (marked.groupBy("__kh", "__key").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > HOT_ROWS)
           .select("__kh", "__key", F.lit(True).alias("__hot")))  # at most one key for each HOT_ROWS rows
    marked = marked.join(F.broadcast(hot), ["__kh", "__key"], "left").withColumn("__bucket", F.when(F.col("__hot"), F.col("__bucket")).otherwise(F.lit(0)))
    at = ["__kh", "__key", "__bucket"]
    within = Window.partitionBy(*at).orderBy(*order)
    upto, all_ = within.rowsBetween(Window.unboundedPreceding, 0), within.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    inner = marked.select("*", *[F.sum(c).over(upto).alias(f"__i_{o}") for o, c in cols.items()], *[F.sum(c).over(all_).alias(f"__a_{o}") for o, c in cols.items()])
    totals = marked.filter("__hot").groupBy(*at).agg(*[F.sum(c).alias(f"__t_{o}") for o, c in cols.items()])
    whole = Window.partitionBy("__kh", "__key")
    before = whole.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*at, *[F.sum(f"__t_{o}").over(before).alias(f"__o_{o}") for o in cols], *[F.sum(f"__t_{o}").over(whole).alias(f"__w_{o}") for o in cols])
    joined = inner.join(offsets.hint("merge"), at, "left")
    out = {o: F.col(f"__i_{o}") + F.coalesce(f"__o_{o}", F.lit(0)) for o in cols} | {f"{o}_all": F.coalesce(f"__w_{o}", f"__a_{o}") for o in cols}
    return _unpacked(joined.withColumns(out), keys, columns)


def with_next(df: DataFrame, keys, col: str, out: str) -> DataFrame:
    """The next larger ``col`` of distinct values inside the keys, cut by ``spread``."""
    keys = list(keys)
    d = df.withColumn("__bucket", spread(F.col(col)))
    inner = d.withColumn("__next", F.lead(col).over(Window.partitionBy(*keys, "__bucket").orderBy(col)))
    firsts = d.groupBy(*keys, "__bucket").agg(F.min(col).alias("__min"))
    after = firsts.select(*keys, "__bucket", F.lead("__min").over(
        Window.partitionBy(*keys).orderBy("__bucket")).alias("__after"))
    j = null_safe_join(inner, after, [*keys, "__bucket"])
    return j.withColumn(out, F.coalesce("__next", "__after")).drop("__bucket", "__next", "__after")


def quantiles(counts: DataFrame, keys, value: str, n: str, probs) -> DataFrame:
    """Exact linear quantiles of weighted values: one row per (keys, prob).

    Works on distinct values with counts and running sums, so no group is held in memory.
    """
    keys = list(keys)
    r = running(counts.filter(F.col(n) > 0), keys, [value], spread(F.col(value)), __upto=n)
    total = counts.groupBy(*keys).agg(F.sum(n).alias("__total"))
    r = null_safe_join(r, total, keys)
    ps = F.explode(F.array(*[F.lit(float(p)) for p in probs])).alias("prob")
    at = (F.col("__total") - 1) * F.col("prob")
    r = r.select(*keys, value, n, "__upto", "__total", ps)
    lo, hi = F.floor(at), F.ceil(at)
    has = lambda k: (k >= F.col("__upto") - F.col(n)) & (k < F.col("__upto"))
    g = (r.filter(has(lo) | has(hi)).groupBy(*keys, "prob").agg(
        F.max(F.when(has(lo), F.col(value))).alias("__lo"), F.max(F.when(has(hi), F.col(value))).alias("__hi"),
        F.max(at - lo).alias("__frac")))
    return g.select(*keys, "prob", (F.col("__lo") + F.col("__frac") * (F.col("__hi") - F.col("__lo"))).alias("value"))
