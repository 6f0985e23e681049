"""Predictors that see no data but position, table size or metadata.

Rows carry ``fold``: a row is tested in partition ``fold`` and trains every other partition; a row
of a published training arm has fold -1 and is never tested. Rows are first collapsed to cells
(subject, feature, level) with class counts. The model of partition f is the sum of all cells
outside f, so nothing is copied K times, and test scores are per cell, not per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import null_safe_join, quantiles, running, spread
from ..functions.rules import snap
from ..operators.geometry import bin_of
from ..session import settle

CELL = ["feature", "subject", "fold", "level"]


def cells(df: DataFrame, features: dict[str, Column], keys=(), label="label") -> DataFrame:
    """(keys, feature, subject, fold, level, p, n); a missing value is a level of its own (null)."""
    arms = F.array(*[F.struct(F.lit(n).alias("feature"), c.cast("string").alias("level")) for n, c in features.items()])
    y = F.col(label).cast("long")
    c = (df.select(*keys, "subject", "fold", y.alias("__y"), F.inline(arms))
         .groupBy(*keys, *CELL).agg(F.sum("__y").alias("p"), F.sum(1 - F.col("__y")).alias("n")))
    return settle(c)  # fitting, scoring and metrics all read the cells, none of them the rows


def outside(c: DataFrame, level_keys, n_folds: int) -> DataFrame:
    """Class counts of all rows outside each partition: (partition, level keys, p, n).

    Summed per fold first; the copy per partition is made on that small table.
    """
    per = c.groupBy("fold", *level_keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    parts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(n_folds)])).alias("partition")
    return (per.select("*", parts).filter(F.col("fold") != F.col("partition"))
            .groupBy("partition", *level_keys).agg(F.sum("p").alias("p"), F.sum("n").alias("n")))


def encode(c: DataFrame, n_folds: int, smoothing: float, keys=(), max_levels: int | None = None) -> DataFrame:
    """Score cells by smoothed target encoding: (sum + a * prior) / (n + a) per level outside the fold.

    An unseen level takes the prior; with ``max_levels`` only the most frequent levels keep a rate.
    """
    by = [*keys, "feature"]
    tr = outside(c, [*by, "level"], n_folds)
    prior = tr.groupBy("partition", *by).agg((F.sum("p") / F.sum(F.col("p") + F.col("n"))).alias("prior"))
    if max_levels is not None:
        # the partial top list keeps at most max_levels entries per key
        w = Window.partitionBy("partition", *by).orderBy((F.col("p") + F.col("n")).desc(), F.col("level").asc_nulls_last())
        tr = tr.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= max_levels).drop("__r")
    rate = null_safe_join(tr, prior, ["partition", *by]).select(
        F.col("partition").alias("fold"), *by, "level",
        ((F.col("p") + smoothing * F.col("prior")) / (F.col("p") + F.col("n") + smoothing)).alias("rate"))
    test = c.filter(F.col("fold").between(0, n_folds - 1))
    d = null_safe_join(test, rate, ["fold", *by, "level"], "left")
    d = null_safe_join(d, prior.withColumnRenamed("partition", "fold"), ["fold", *by])
    return d.withColumn("s", snap(F.coalesce("rate", "prior"))).drop("rate", "prior")


def numeric_levels(c: DataFrame, n_folds: int, n_bins=10, keys=()) -> DataFrame:
    """Test and training levels of numeric features per partition.

    A feature with more than ``n_bins`` distinct finite training values is cut at its training
    deciles (level = number of distinct edges <= value); otherwise each value is a level.
    """
    by = [*keys, "feature"]
    tr = outside(c.filter(F.col("level").isNotNull()), [*by, "level"], n_folds).select(
        "partition", *by, F.col("level").cast("double").alias("v"), (F.col("p") + F.col("n")).alias("w"))
    many = tr.groupBy("partition", *by).agg(F.count(F.lit(1)).alias("__k")).filter(F.col("__k") > n_bins)
    cut = tr.join(many.drop("__k"), ["partition", *by], "left_semi")
    edges = (quantiles(cut, ["partition", *by], "v", "w", [i / n_bins for i in range(1, n_bins)])
             .groupBy("partition", *by).agg(F.array_sort(F.collect_set("value")).alias("edges")))  # < n_bins values
    return edges


def column_scores(c: DataFrame, n_folds: int, numeric: set[str], n_bins=10, smoothing=1.0, max_levels=50,
                  keys=()) -> DataFrame:
    """Scored cells of every single-column baseline at once: feature = column."""
    by = [*keys, "feature"]
    cat = c.filter(~F.col("feature").isin(*numeric)) if numeric else c
    out = encode(cat, n_folds, smoothing, keys, max_levels)
    if not numeric:
        return out
    num = c.filter(F.col("feature").isin(*numeric))
    edges = numeric_levels(num, n_folds, n_bins, keys)
    # each partition has its own edges, so cells are copied per partition after they were collapsed
    parts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(n_folds)])).alias("partition")
    flat = num.groupBy("fold", *by, "level").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).select("*", parts)
    code = lambda: F.when(F.col("level").isNull(), F.lit(None)).when(
        F.col("edges").isNull(), F.col("level")).otherwise(F.expr(
            "string(size(filter(edges, e -> e <= double(level))))"))
    tr = (null_safe_join(flat, edges, ["partition", *by], "left").filter(F.col("fold") != F.col("partition"))
          .withColumn("code", code()).groupBy("partition", *by, "code").agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
    prior = tr.groupBy("partition", *by).agg((F.sum("p") / F.sum(F.col("p") + F.col("n"))).alias("prior"))
    rate = null_safe_join(tr, prior, ["partition", *by]).select(
        F.col("partition").alias("fold"), *by, "code",
        ((F.col("p") + smoothing * F.col("prior")) / (F.col("p") + F.col("n") + smoothing)).alias("rate"))
    test = num.filter(F.col("fold").between(0, n_folds - 1))
    d = null_safe_join(test, edges.withColumnRenamed("partition", "fold"), ["fold", *by], "left").withColumn("code", code())
    d = null_safe_join(d, rate, ["fold", *by, "code"], "left")
    d = null_safe_join(d, prior.withColumnRenamed("partition", "fold"), ["fold", *by])
    d = d.withColumn("s", snap(F.coalesce("rate", "prior")))
    return out.unionByName(d.select(*out.columns))


def position_features(bins=(20,), pos="relpos") -> dict[str, Column]:
    return {f"positional_{b}bin": bin_of(F.col(pos), b) for b in bins}


def simple_baselines(df: DataFrame, n_folds: int, bins=(20,), keys=(), size_col="n_slices") -> DataFrame:
    """Scored cells of prevalence, position (one feature per bin count) and volume size."""
    flat = cells(df, {"prevalence": F.lit("all"), **position_features(bins)}, keys)
    out = encode(flat, n_folds, 0.0, keys)
    size = cells(df, {"volume_size": F.col(size_col)}, keys)
    return out.unionByName(column_scores(size, n_folds, {"volume_size"}, keys=keys).select(*out.columns))


def partition_report(df: DataFrame, n_folds: int) -> DataFrame:
    """Per partition: sizes, subjects, training prevalence, and whether it can be scored."""
    per = df.groupBy("fold", "subject").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    g = per.groupBy("fold").agg(F.sum("n").alias("n"), F.sum("k").alias("k"), F.count(F.lit(1)).alias("subjects"))
    parts = F.explode(F.array(*[F.lit(i).cast("long") for i in range(n_folds)])).alias("partition")
    d = g.select("*", parts)
    te, tr = F.col("fold") == F.col("partition"), F.col("fold") != F.col("partition")
    s = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    r = d.groupBy("partition").agg(s("n", tr).alias("n_train"), s("n", te).alias("n_test"), s("subjects", tr).alias("train_subjects"),
                                   s("subjects", te).alias("test_subjects"), s("k", tr).alias("__ktr"), s("k", te).alias("__kte"))
    ok = (F.col("__ktr") > 0) & (F.col("__ktr") < F.col("n_train")) & (F.col("__kte") > 0) & (F.col("__kte") < F.col("n_test"))
    return r.withColumn("train_prevalence", F.try_divide(F.col("__ktr").cast("double"), F.col("n_train"))) \
        .withColumn("scored", ok).drop("__ktr", "__kte")


def multiclass_positional(df: DataFrame, train: Column, cls="class", n_bins=20, pos="relpos") -> DataFrame:
    """Each test row with the most frequent training class of its position bin.

    Ties inside a bin go to the class with the larger prior, then the smaller class; an empty bin
    takes the majority class.
    """
    d = df.withColumn("bin", bin_of(F.col(pos), n_bins)).withColumn("__tr", train)
    tr = d.filter("__tr").groupBy("bin", cls).agg(F.count(F.lit(1)).alias("c"))
    prior = tr.groupBy(cls).agg(F.sum("c").alias("t"))
    pick = lambda cols: F.max(F.struct(*cols, (-F.col(cls)).alias("neg")))
    best = (tr.join(prior, cls).groupBy("bin").agg(pick([F.col("c"), F.col("t")]).alias("b"))
            .select("bin", (-F.col("b.neg")).alias("pred")))
    major = prior.agg(pick([F.col("t")]).alias("b")).select((-F.col("b.neg")).alias("majority"))
    # one row per bin and one row in all: bounded by the bin count
    return (d.filter(~F.col("__tr")).join(F.broadcast(best), "bin", "left").crossJoin(F.broadcast(major))
            .withColumn("pred", F.coalesce("pred", "majority")).drop("__tr"))


def multiclass_summary(scored: DataFrame, df: DataFrame, train: Column, cls="class") -> DataFrame:
    acc = scored.agg(F.count(F.lit(1)).alias("n_test"), F.avg((F.col("pred") == F.col(cls)).cast("double")).alias("accuracy"),
                     F.avg((F.col("majority") == F.col(cls)).cast("double")).alias("majority_accuracy"))
    share = lambda d, name: d.groupBy(cls).agg(F.count(F.lit(1)).alias("c")).select(
        cls, (F.col("c") / F.sum("c").over(Window.partitionBy(F.lit(1)))).alias(name))  # one row per class
    pr = share(df.filter(train), "a").join(share(scored, "b"), cls).agg(F.sum(F.col("a") * F.col("b")).alias("prior_random_accuracy"))
    return acc.crossJoin(F.broadcast(pr))
