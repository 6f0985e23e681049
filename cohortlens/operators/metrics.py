"""Rank metrics from score counts.

Every metric starts from ``score_counts``: positives and negatives per (keys, score). That is a
partial aggregate, so a hot key or a hot score shrinks before it is shuffled. Extra grouping keys
(partition, replicate, method, stratum) turn loops over evaluations into one plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import group_stats, null_safe_join, packed, quantiles, running, running_small, spread
from ..functions.rules import snap, usable
from ..session import settle


# Means of scores that were snapped to 12 digits can fall exactly between two 12-digit numbers,
# where summation order would decide; ten digits leave no such halves and still tie equal means.
MEAN_DIGITS = 10


def score_counts(df: DataFrame, keys=(), score="score", label="label") -> DataFrame:
    """(keys, s, p, n): usable rows per snapped score."""
    return (df.filter(usable(F.col(label), F.col(score)))
            .groupBy(*keys, snap(F.col(score)).alias("s"))
            .agg(F.sum(F.col(label).cast("long")).alias("p"), F.sum((1 - F.col(label)).cast("long")).alias("n")))


def auc_from_counts(counts: DataFrame, keys=(), few=False, out="auc") -> DataFrame:
    """(keys, auc, n_pos, n_neg): Mann-Whitney with ties half; null for a single class.

    Two levels: inside a score bucket each score sees the negatives below it; a bucket then sees
    the negatives of earlier buckets. Nothing is joined back, and a key with very many scores is
    spread over its buckets. ``few``: at most some hundred scores per key, one level.
    """
    keys = list(keys)
    p, n = F.col("p").cast("double"), F.col("n").cast("double")
    if few:
        w = Window.partitionBy(*keys).orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        per = counts.select(*keys, p.alias("P"), n.alias("N"),
                            (p * (F.coalesce(F.sum(n).over(w), F.lit(0.0)) + n / 2)).alias("num"))
    else:
        d = counts.withColumn("__b", spread(F.col("s")))
        w = Window.partitionBy(*keys, "__b").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
        cells = (d.withColumn("__num", p * (F.coalesce(F.sum(n).over(w), F.lit(0.0)) + n / 2))
                 .groupBy(*keys, "__b").agg(F.sum("__num").alias("num"), F.sum(p).alias("P"), F.sum(n).alias("N")))
        w2 = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
        per = cells.select(*keys, "P", "N", (F.col("num") + F.col("P") * F.coalesce(
            F.sum("N").over(w2), F.lit(0.0))).alias("num"))
    g = per.groupBy(*keys).agg(F.sum("num").alias("__num"), F.sum("P").alias("__P"), F.sum("N").alias("__N"))
    return g.select(*keys, F.when((F.col("__P") > 0) & (F.col("__N") > 0),
                                  F.col("__num") / (F.col("__P") * F.col("__N"))).alias(out),
                    F.col("__P").cast("long").alias("n_pos"), F.col("__N").cast("long").alias("n_neg"))


def auc(df: DataFrame, keys=(), score="score", label="label", out="auc") -> DataFrame:
    return auc_from_counts(score_counts(df, keys, score, label), keys, out=out)


def midrank(df: DataFrame, keys=(), value="score", out="midrank", descending=False) -> DataFrame:
    """1-based average rank under ties of every row: ranks are made on distinct values and joined."""
    keys = list(keys)
    v = df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value))) \
        .groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    sign = F.lit(-1.0 if descending else 1.0)
    r = running(v, keys, [sign * F.col(value)], spread(sign * F.col(value)), __u="__c")
    r = r.select(*keys, value, (F.col("__u") - (F.col("__c") - 1) / 2.0).alias(out))
    return null_safe_join(df, r, [*keys, value], "left")


def average_precision_from_counts(counts: DataFrame, keys=(), out="ap") -> DataFrame:
    """Non-interpolated average precision; tied scores are one threshold."""
    keys = list(keys)
    r = running(counts, keys, [F.col("s").desc()], -spread(F.col("s")), tp="p", fp="n")
    g = r.groupBy(*keys).agg(F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("__a"),
                             F.sum("p").alias("__P"))
    return g.select(*keys, F.when(F.col("__P") > 0, F.col("__a") / F.col("__P")).alias(out))


def cluster_aggregate(df: DataFrame, keys=(), subject="subject", score="score", label="label") -> DataFrame:
    """One row per subject: snapped mean and max score, max label, mixed-label flag, sizes."""
    s = snap(F.col(score))
    return df.filter(usable(F.col(label), F.col(score))).groupBy(*keys, subject).agg(
        snap(F.avg(s), MEAN_DIGITS).alias("mean_score"), F.max(s).alias("max_score"), F.max(label).alias("label"),
        (F.min(label) != F.max(label)).alias("mixed"), F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_pos"))


def subjects_from_cells(cells: DataFrame, keys=(), subject="subject") -> DataFrame:
    """The same from (keys, subject, s, p, n) counts."""
    w = F.col("p") + F.col("n")
    return cells.groupBy(*keys, subject).agg(
        snap(F.sum(F.col("s") * w) / F.sum(w), MEAN_DIGITS).alias("mean_score"), F.max("s").alias("max_score"),
        F.max((F.col("p") > 0).cast("long")).alias("label"),
        ((F.sum("p") > 0) & (F.sum("n") > 0)).alias("mixed"), F.sum(w).alias("n"), F.sum("p").alias("n_pos"))


def patient_auc(df: DataFrame, keys=(), subject="subject", score="score", label="label", how="mean") -> DataFrame:
    return auc(cluster_aggregate(df, keys, subject, score, label), keys, f"{how}_score", "label")


# The aggregation schemes, kind and parameter.
SCHEMES = (("mean", "mean", 0.0), ("max", "top", 1.0), ("top1_mean", "top", 1.0), ("top2_mean", "top", 2.0),
           ("top3_mean", "top", 3.0), ("top5_mean", "top", 5.0), ("q75", "q", 0.75), ("q90", "q", 0.9))


def aggregate_matrix(df: DataFrame, keys=(), subject="subject", score="score", label="label", digits=MEAN_DIGITS) -> DataFrame:
    """(keys, subject, scheme, score, label, short): eight ways to read one subject's scores.

    From per-subject score counts, written once, with running counts from the top, so no score list is built.
    A subject with fewer rows than k takes the mean of what it has and is marked short. Results are
    snapped to ``digits``.
    """
    keys = list(keys)
    by = [*keys, subject]
    c = (df.filter(usable(F.col(label), F.col(score))).groupBy(*by, snap(F.col(score)).alias("s"))
         .agg(F.count(F.lit(1)).alias("c"), F.max(label).alias("y")))
    r = running_small(settle(c), by, [F.col("s").desc()], -spread(F.col("s")), u="c").withColumnRenamed("u_all", "t").withColumn("before", F.col("u") - F.col("c"))
    take = lambda k: F.greatest(F.lit(0), F.least(F.col("c"), F.lit(k) - F.col("before")))
    top = lambda k: F.sum(F.col("s") * take(k)) / F.least(F.lit(float(k)), F.max("t").cast("double"))
    up = F.col("t") - F.col("u")  # rows below this score, counted from the bottom
    def quant(q):
        at = (F.col("t") - 1) * F.lit(q)
        lo, hi = F.floor(at), F.ceil(at)
        has = lambda k: (k >= up) & (k < up + F.col("c"))
        a, b = F.max(F.when(has(lo), F.col("s"))), F.max(F.when(has(hi), F.col("s")))
        return a + F.max(at - lo) * (b - a)
    cols = []
    for name, kind, par in SCHEMES:
        v = (F.sum(F.col("s") * F.col("c")) / F.max("t")) if kind == "mean" else \
            top(int(par)) if kind == "top" else quant(par)
        cols.append(snap(v, digits).alias(name))
    g = r.groupBy(*by).agg(F.max("y").alias("label"), F.max("t").alias("t"), *cols)
    arms = F.array(*[F.struct(F.lit(n).alias("scheme"), F.col(n).alias("score"),
                              ((F.lit(p if k == "top" else 0.0)) > F.col("t")).alias("short"))
                     for n, k, p in SCHEMES])
    return g.select(*by, "label", F.inline(arms))


def stratified_auc(df: DataFrame, stratum: str, keys=(), score="score", label="label", floor=1) -> DataFrame:
    """Pair-weighted AUC inside strata: only pairs of one stratum count."""
    keys = list(keys)
    per = auc(df, [*keys, stratum], score, label)
    return pool_strata(per, keys, floor)


def pool_strata(per: DataFrame, keys=(), floor=1) -> DataFrame:
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    ok = (F.col("n_pos") >= floor) & (F.col("n_neg") >= floor)
    return per.groupBy(*keys).agg(
        (F.sum(F.when(ok, F.col("auc") * pairs)) / F.sum(F.when(ok, pairs))).alias("auc"),
        F.count_if(ok).alias("n_strata_used"), F.coalesce(F.sum(F.when(ok, pairs)), F.lit(0.0)).alias("n_pairs"))


def within_stratum_auc(subj: DataFrame, stratum: str, keys=(), score="score", label="label", floor=10, min_size=4):
    """Size-weighted mean of stratum AUCs, and pair-weighted ones with a floor and with floor 1."""
    keys = list(keys)
    per = auc(subj, [*keys, stratum], score, label)
    size = F.col("n_pos") + F.col("n_neg")
    both = (F.col("n_pos") > 0) & (F.col("n_neg") > 0)
    pairs = F.col("n_pos").cast("double") * F.col("n_neg")
    fl = (F.col("n_pos") >= floor) & (F.col("n_neg") >= floor)
    use = both & (size >= min_size)
    return per.groupBy(*keys).agg(
        (F.sum(F.when(use, F.col("auc") * size)) / F.sum(F.when(use, size))).alias("size_weighted"),
        F.count_if(use).alias("n_strata_used"),
        (F.sum(F.when(fl, F.col("auc") * pairs)) / F.sum(F.when(fl, pairs))).alias("pair_weighted"),
        (F.sum(F.when(both, F.col("auc") * pairs)) / F.sum(F.when(both, pairs))).alias("pair_weighted_underpowered"))


def separability(subj: DataFrame, stratum: str, label="label", floor=10, keys=()) -> DataFrame:
    """Per keys and stratum: class sizes, both classes, power floor, pairs; and the share of pairs kept per keys."""
    keys = list(keys)
    g = subj.groupBy(*keys, stratum).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_pos"))
    g = g.withColumn("n_neg", F.col("n") - F.col("n_pos"))
    tot = g.groupBy(*keys).agg((F.sum("n_pos").cast("double") * F.sum("n_neg")).alias("__all"),
                F.sum(F.col("n_pos").cast("double") * F.col("n_neg")).alias("__in"))
    return ((null_safe_join(g, tot, keys) if keys else g.crossJoin(F.broadcast(tot)))
            .withColumn("spans_both", (F.col("n_pos") > 0) & (F.col("n_neg") > 0))
            .withColumn("meets_floor", (F.col("n_pos") >= floor) & (F.col("n_neg") >= floor))
            .withColumn("pairs", F.col("n_pos") * F.col("n_neg"))
            .withColumn("fraction_retained", F.try_divide(F.col("__in"), F.col("__all"))).drop("__all", "__in"))


def wilson(k: Column, n: Column, z=1.959963984540054):
    """(low, high) columns of the Wilson score interval; null for n = 0."""
    k, n = k.cast("double"), n.cast("double")
    p, z2 = k / n, z * z
    denom = 1.0 + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2 * n)) / denom
    half = (F.lit(z) / denom) * F.sqrt(p * (1 - p) / n + F.lit(z2) / (4 * n * n))
    ok = n > 0
    return (F.when(ok, F.greatest(F.lit(0.0), centre - half)), F.when(ok, F.least(F.lit(1.0), centre + half)))


def youden_threshold(counts: DataFrame, keys=()) -> DataFrame:
    """Midpoint threshold with the largest sensitivity + specificity - 1; the median of ties.

    Counts are written once and cut into score buckets. Only the best thresholds of each bucket, which the best of all
    are among, are kept and written; ties are looked for among those.
    """
    keys = list(keys)
    made = not keys
    if made:
        counts, keys = counts.withColumn("__any", F.lit(1)), ["__any"]
    counts = settle(counts.select(*keys, "s", "p", "n"))
    marked = packed(counts.withColumn("__bucket", spread(F.col("s"))), keys)
    key, at = ["__kh", "__key"], ["__kh", "__key", "__bucket"]
    whole, along = Window.partitionBy(*key), Window.partitionBy(*key).orderBy("__bucket")
    before = lambda c: F.coalesce(F.sum(c).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = marked.groupBy(*at).agg(F.sum("p").alias("bp"), F.sum("n").alias("bn"), F.min("s").alias("bs"))  # one row per bucket
    offsets = settle(offsets.select(
        *at, F.sum("bp").over(whole).alias("all_p"), F.sum("bn").over(whole).alias("all_n"), F.min("bs").over(whole).alias("lo"),
        before("bp").alias("p0"), before("bn").alias("n0"), F.lead("bs").over(along).alias("after")).filter("all_p > 0 AND all_n > 0"))
    within = Window.partitionBy(*at).orderBy("s")
    upto = lambda c: F.sum(c).over(within.rowsBetween(Window.unboundedPreceding, 0))
    inner = marked.select(*at, "s", upto("p").alias("pb"), upto("n").alias("nb"), F.lead("s").over(within).alias("nxt"))
    c = inner.join(offsets.hint("merge"), at).withColumn("nxt", F.coalesce("nxt", "after")).filter(F.col("nxt").isNotNull()).select(
        *at, ((F.col("s") + F.col("nxt")) / 2).alias("threshold"),
        (1 - (F.col("pb") + F.col("p0")) / F.col("all_p")).alias("sens"), ((F.col("nb") + F.col("n0")) / F.col("all_n")).alias("spec"))
    c = c.withColumn("j", F.col("sens") + F.col("spec") - 1).withColumn("__top", F.max("j").over(Window.partitionBy(*at)))
    c = c.filter(F.col("j") >= F.col("__top") - 1e-12).select("__key", "threshold", "sens", "spec", "j")
    first = offsets.groupBy("__key").agg((F.min("lo") - 1e-9).alias("threshold")).select("__key", "threshold", F.lit(1.0).alias("sens"), F.lit(0.0).alias("spec"), F.lit(0.0).alias("j"))
    c = settle(c.unionByName(first).select(*[F.col(f"__key.`{k}`").alias(k) for k in keys], "threshold", "j", "sens", "spec"))
    best = c.groupBy(*keys).agg(F.max("j").alias("__m"))
    tied = null_safe_join(c, best, keys).filter(F.col("j") >= F.col("__m") - 1e-12).withColumn("__one", F.lit(1))
    r2 = running(tied, keys, ["threshold"], spread(F.col("threshold")), __i="__one")
    n = tied.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_tied"))
    return (null_safe_join(r2, n, keys).filter(F.col("__i") == F.expr("n_tied div 2") + 1)
            .select(*([] if made else keys), "threshold", "j", "sens", "spec", "n_tied"))


def confusion(df: DataFrame, thresholds: DataFrame, keys=(), score="score", label="label", few=False) -> DataFrame:
    """tp fp tn fn per key at the key's threshold (one row per key). ``few``: at most some thousand keys, whose rows stay where they are."""
    keys = list(keys)
    at = thresholds.select(*keys, "threshold")
    d = null_safe_join(df.filter(usable(F.col(label), F.col(score))), F.broadcast(at) if few else at, keys)
    hit, pos = F.col(score) >= F.col("threshold"), F.col(label) == 1
    return d.groupBy(*keys).agg(
        F.count_if(hit & pos).alias("tp"), F.count_if(hit & ~pos).alias("fp"),
        F.count_if(~hit & ~pos).alias("tn"), F.count_if(~hit & pos).alias("fn"), F.max("threshold").alias("threshold"))


def threshold_metrics(conf: DataFrame) -> DataFrame:
    """Rates with Wilson limits from confusion counts; null where undefined."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    lo1, hi1 = wilson(tp, tp + fn)
    lo0, hi0 = wilson(tn, tn + fp)
    div = lambda a, b: F.try_divide(a.cast("double"), b)
    return conf.select("*", div(tp, tp + fn).alias("sens"), lo1.alias("sens_lo"), hi1.alias("sens_hi"),
                       div(tn, tn + fp).alias("spec"), lo0.alias("spec_lo"), hi0.alias("spec_hi"),
                       div(tp, tp + fp).alias("ppv"), div(tn, tn + fn).alias("npv"),
                       div(tp + tn, tp + fp + tn + fn).alias("accuracy"))


def pooled_operating_point(val: DataFrame, test: DataFrame, keys=(), fold="fold") -> DataFrame:
    """Youden threshold per fold on validation rows, applied to that fold's test rows, counts summed."""
    keys = list(keys)
    th = youden_threshold(score_counts(val, [*keys, fold]), [*keys, fold])
    c = confusion(test, th, [*keys, fold], few=True)  # one row per fold
    pooled = c.groupBy(*keys).agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "tn", "fn")],
                                  F.median("threshold").alias("threshold"), F.count(F.lit(1)).alias("n_folds"))
    return threshold_metrics(pooled)


def class_accuracy(df: DataFrame, keys=(), score="score", label="label", cut=0.5) -> DataFrame:
    pred = (F.col(score) >= cut).cast("int")
    y = F.col(label)
    ok = (pred == y).cast("double")
    rec = lambda v: F.avg(F.when(y == v, ok))
    return df.filter(usable(y, F.col(score))).groupBy(*keys).agg(
        F.avg(ok).alias("accuracy"), ((rec(0) + rec(1)) / 2).alias("balanced_accuracy"),
        F.greatest(F.avg(y), 1 - F.avg(y)).alias("majority"), rec(0).alias("recall_0"), rec(1).alias("recall_1"))


# False positives per scan at which sensitivity is read.
FP_POINTS = (0.125, 0.25, 0.5, 1.0, 2.0, 4.0, 8.0)


def froc(df: DataFrame, scan="volume", row="row_id", score="score", label="label") -> DataFrame:
    """Sensitivity at each false-positive budget per scan, the random-score value, and the mean.

    Rows of one score are taken in hash order of their key. Only the score at which a budget runs
    out is looked at row by row; all other scores are counts.
    """
    c = score_counts(df, [], score, label)
    r = running(c, [], [F.col("s").desc()], -spread(F.col("s")), tp="p", fp="n")
    tot = c.agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")).crossJoin(
        F.broadcast(df.select(scan).distinct().agg(F.count(F.lit(1)).alias("scans"))))
    b = tot.select("all_p", "all_n", "scans", F.explode(F.array(*[F.lit(f) for f in FP_POINTS])).alias("budget"))
    b = b.withColumn("allowed", F.floor(F.col("budget") * F.col("scans")))
    # whole scores inside the budget
    full = (r.crossJoin(F.broadcast(b)).filter(F.col("fp") <= F.col("allowed"))
            .groupBy("budget").agg(F.max("tp").alias("tp_full"), F.max("fp").alias("fp_full")))
    cut = (r.crossJoin(F.broadcast(b)).filter((F.col("fp") > F.col("allowed")) & (F.col("fp") - F.col("n") <= F.col("allowed")))
           .select("budget", "s", (F.col("allowed") - (F.col("fp") - F.col("n"))).alias("room")))
    from ..functions.draws import unit_draw
    ties = (df.select(row, label, snap(F.col(score)).alias("s")).join(F.broadcast(cut), "s")
            .withColumn("h", unit_draw("tie", F.col(row))).withColumn("neg", 1 - F.col(label)))
    t = running(ties, ["budget"], ["h", row], F.floor(F.col("h") * 4096), f="neg", g=label)
    part = t.filter(F.col("f") <= F.col("room")).groupBy("budget").agg(F.max("g").alias("tp_part"))
    out = b.join(full, "budget", "left").join(part, "budget", "left")
    tp = F.coalesce("tp_full", F.lit(0)) + F.coalesce("tp_part", F.lit(0))
    return out.select("budget", F.try_divide(tp.cast("double"), F.col("all_p")).alias("sensitivity"),
                      F.least(F.lit(1.0), F.col("budget") * F.col("scans") / F.greatest(F.col("all_n"), F.lit(1))).alias("chance"))


def describe_finite(df: DataFrame, value: str, thresholds=(0.9, 0.95), keys=()) -> DataFrame:
    """Counts, moments, exact median and 5 % point of the finite values, and shares below limits."""
    keys = list(keys)
    v = F.col(value)
    fin = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    x = F.when(fin, v)
    base = df.groupBy(*keys).agg(
        F.count(x).alias("n"), (F.count(F.lit(1)) - F.count(x)).alias("n_missing"), F.avg(x).alias("mean"),
        F.min(x).alias("min"), F.max(x).alias("max"),
        F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, 0.0).alias("sd"),
        *[F.count_if(x < t).alias(f"n_below_{i}") for i, t in enumerate(thresholds)])
    for i, _ in enumerate(thresholds):
        base = base.withColumn(f"frac_below_{i}", F.try_divide(F.col(f"n_below_{i}").cast("double"), F.col("n")))
    c = df.filter(fin).groupBy(*keys, v.cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    q = quantiles(c, keys, "v", "c", (0.05, 0.5)).groupBy(*keys).agg(
        F.max(F.when(F.col("prob") == 0.5, F.col("value"))).alias("median"),
        F.max(F.when(F.col("prob") == 0.05, F.col("value"))).alias("p05"))
    return null_safe_join(base, q, keys, "left") if keys else base.join(q, how="left")


def claim_verdict(stats: DataFrame, claims: DataFrame, key: str) -> DataFrame:
    """Observed mean against a documented claim minus its tolerance."""
    j = claims.join(stats, key, "left")
    return j.withColumn("status", F.when(F.col("mean").isNull(), "not_measured")
                        .when(F.col("mean") >= F.col("claim") - F.col("tol"), "matches_documented_claim")
                        .otherwise("BELOW_DOCUMENTED_CLAIM")).withColumn("delta", F.col("mean") - F.col("claim"))


def pearson(a: str, b: str) -> Column:
    """Pearson r; null when a side is constant, where ``corr`` divides by zero even under a condition."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pair_correlation(df: DataFrame, keys, a: str, b: str, out="r") -> DataFrame:
    """Pearson r per key; null when a side is constant."""
    return df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(*keys).agg(
        F.when((F.min(a) < F.max(a)) & (F.min(b) < F.max(b)), pearson(a, b)).alias(out), F.count(F.lit(1)).alias("n_pairs"))


def dilution_profile(df: DataFrame, subject="subject", label="label") -> DataFrame:
    per = df.groupBy(subject).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k"))
    base = per.agg(F.count(F.lit(1)).alias("n_subjects"), F.count_if(F.col("k") > 0).alias("n_pos_subjects"),
                   (F.sum("k") / F.sum("n")).alias("positive_row_rate"), F.count_if(F.col("k") == 1).alias("n_single"))
    c = per.filter("k > 0").groupBy((F.col("k") / F.col("n")).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    q = quantiles(c, [], "v", "c", (0.25, 0.5, 0.75)).agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return base.crossJoin(F.broadcast(q))


def trivial_fraction(df: DataFrame, headroom=0.02) -> DataFrame:
    """(baseline - chance) / (published - chance), clipped copy, interval; null without headroom."""
    d = F.col("published") - F.col("chance")
    ok = d > headroom
    f = lambda c: F.when(ok, (F.col(c) - F.col("chance")) / d)
    v = f("baseline")
    return df.select("*", v.alias("fraction"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v)).alias("clipped"),
                     f("ci_lo").alias("fraction_lo"), f("ci_hi").alias("fraction_hi"),
                     F.when(~F.coalesce(ok, F.lit(False)), "published at or below chance").alias("reason"))


def fraction_distribution(df: DataFrame, sets: dict[str, Column]) -> DataFrame:
    """Five-number summary and band counts of the fraction in overlapping sets of rows."""
    arms = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in sets.items()]))
    d = df.filter(F.col("fraction").isNotNull()).select("fraction", F.explode(arms).alias("set"))
    base = d.groupBy("set").agg(
        F.count(F.lit(1)).alias("n"), F.min("fraction").alias("min"), F.max("fraction").alias("max"),
        F.count_if(F.col("fraction") < 0.25).alias("below_25"),
        F.count_if(F.col("fraction").between(0.25, 0.75)).alias("mid"),
        F.count_if(F.col("fraction") > 0.75).alias("above_75"), F.count_if(F.col("fraction") >= 1).alias("reaches"))
    c = d.groupBy("set", F.col("fraction").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    q = quantiles(c, ["set"], "v", "c", (0.25, 0.5, 0.75)).groupBy("set").agg(
        *[F.max(F.when(F.col("prob") == p, F.col("value"))).alias(f"q{int(p * 100)}") for p in (0.25, 0.5, 0.75)])
    return base.join(q, "set")


def seed_summary(df: DataFrame, keys, value="auc") -> DataFrame:
    """n, mean, sd, range over seeds; a mixed-family flag; the widest interval and largest p."""
    return df.groupBy(*keys).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"),
        F.min(value).alias("min"), F.max(value).alias("max"), (F.min("family") != F.max("family")).alias("mixed_family"),
        F.max(F.col("ci_hi") - F.col("ci_lo")).alias("widest_ci"), F.max("p").alias("largest_p"),
        F.min(F.struct(F.abs(F.col("concordance") - 0.5).alias("d"), F.col("concordance").alias("c")))["c"].alias("worst_concordance"))


def fold_dispersion(per_fold: DataFrame, pooled: DataFrame, keys) -> DataFrame:
    g = per_fold.groupBy(*keys).agg((F.max("auc") - F.min("auc")).alias("range"), F.stddev_samp("auc").alias("sd"),
                                    F.count("auc").alias("n_folds"))
    return g.join(pooled, list(keys)).withColumn("range_over_ci", F.try_divide(F.col("range"), F.col("ci_hi") - F.col("ci_lo")))


def class_parameter_contrast(df: DataFrame, cls: str, params) -> DataFrame:
    arms = F.array(*[F.struct(F.lit(p).alias("param"), F.col(p).cast("double").alias("v")) for p in params])
    d = df.select(F.col(cls).alias("class"), F.inline(arms)).filter(F.col("v").isNotNull())
    c = d.groupBy("class", "param", "v").agg(F.count(F.lit(1)).alias("c"))
    base = c.groupBy("class", "param").agg(F.sum("c").alias("n"), F.min("v").alias("min"), F.max("v").alias("max"))
    q = quantiles(c, ["class", "param"], "v", "c", (0.5,)).select("class", "param", F.col("value").alias("median"))
    return base.join(q, ["class", "param"])


def class_histogram(df: DataFrame, cls="label", subject="subject", rare=5) -> DataFrame:
    """Rows and subjects per class with a total row (class null), shares, and a rare flag."""
    g = df.groupBy(cls, subject).agg(F.count(F.lit(1)).alias("n"))
    c = g.rollup(cls).agg(F.sum("n").alias("n_rows"), F.countDistinct(subject).alias("n_subjects"),
                          F.grouping(cls).alias("total"))
    tot = df.agg(F.count(F.lit(1)).alias("__all"))
    return (c.crossJoin(F.broadcast(tot)).withColumn("share", F.col("n_rows") / F.col("__all"))
            .withColumn("rare", (F.col("total") == 0) & (F.col("n_subjects") < rare)).drop("__all"))


def seed_pooled(df: DataFrame, keys, score="score") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(score).alias(score), F.max("label").alias("label"), F.count(F.lit(1)).alias("n_seeds"))


def file_rollup(df: DataFrame, keys, value="value", null="null_value") -> DataFrame:
    """Per-file mean, median, min, max of the finite values and the mean of the null values."""
    keys = list(keys)
    fin = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")), F.col(c))
    base = df.groupBy(*keys).agg(F.count(fin(value)).alias("n"), F.avg(fin(value)).alias("mean"),
                                 F.min(fin(value)).alias("min"), F.max(fin(value)).alias("max"), F.avg(fin(null)).alias("null_mean"))
    c = df.filter(fin(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    q = quantiles(c, keys, "v", "c", (0.5,)).select(*keys, F.col("value").alias("median"))
    return null_safe_join(base, q, keys, "left")
