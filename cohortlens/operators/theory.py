"""What position alone can reach: profile, ceiling, and the corrections of a fitted ceiling.

Everything after ``positional_profile`` works on one row per bin (at most some hundred), so the
only pass over the data is the count per bin.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import group_stats, merged, null_safe_join
from ..session import settle
from . import baselines as b
from . import metrics as m
from . import resample
from .geometry import bin_of, canonical_bins
from .inference import normal_cdf
from .splits import seeded_folds


def positional_profile(df: DataFrame, n_bins=20, keys=(), pos="relpos", label="label") -> DataFrame:
    """(keys, bin, n, n_pos, q, rate, theta): all bins present; an empty one has share 0 and rate theta."""
    keys = list(keys)
    c = df.groupBy(*keys, bin_of(F.col(pos), n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("n_pos"))
    tot = c.groupBy(*keys).agg(F.sum("n").alias("__t"), (F.sum("n_pos") / F.sum("n")).alias("theta"))
    spine = tot.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    d = null_safe_join(spine, c, [*keys, "bin"], "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    return d.select(*keys, "bin", n.alias("n"), F.coalesce("n_pos", F.lit(0)).alias("n_pos"), (n / F.col("__t")).alias("q"),
                    F.when(n > 0, F.col("n_pos") / F.col("n")).otherwise(F.col("theta")).alias("rate"), "theta")


def positional_ceiling(profile: DataFrame, keys=(), rate="rate") -> DataFrame:
    """Half Gini mean difference over bins, Gini, the best AUC position can give, and kappa."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(rate, "bin").rowsBetween(Window.unboundedPreceding, -1)
    qp = F.col("q") * F.col(rate)
    d = profile.withColumn("__m", qp * F.coalesce(F.sum("q").over(w), F.lit(0.0)) - F.col("q") * F.coalesce(F.sum(qp).over(w), F.lit(0.0)))
    g = d.groupBy(*keys).agg(F.sum("__m").alias("gmd_half"), F.sum(qp).alias("theta"), F.count_if(F.col("n") == 0).alias("n_empty"))
    ok = (F.col("theta") > 0) & (F.col("theta") < 1)
    a = F.when(ok, 0.5 + F.col("gmd_half") / (2 * F.col("theta") * (1 - F.col("theta"))))
    return g.select(*keys, a.alias("auc"), "theta", "gmd_half", F.when(F.col("theta") > 0, F.col("gmd_half") / F.col("theta")).alias("gini"),
                    (2 * a - 1).alias("kappa"), "n_empty")


def within_volume_icc(df: DataFrame, n_bins=20, volume="volume", pos="relpos", label="label") -> DataFrame:
    """ANOVA intraclass correlation of the label inside a volume after removing the bin mean.

    Bin means are subtracted on (volume, bin) counts, so rows are read once.
    """
    c = settle(df.groupBy(volume, bin_of(F.col(pos), n_bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("k")))
    mean = c.groupBy("bin").agg((F.sum("k") / F.sum("n")).alias("mu"))  # one row per bin
    d = c.join(F.broadcast(mean), "bin")
    r = F.col("k") - F.col("n") * F.col("mu")  # residual sum of the cell
    r2 = F.col("k") * F.pow(1 - F.col("mu"), 2) + (F.col("n") - F.col("k")) * F.pow(F.col("mu"), 2)
    v = d.groupBy(volume).agg(F.sum("n").alias("n"), F.sum(r).alias("s"), F.sum(r2).alias("ss"))
    g = v.agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("t"), F.sum(F.col("n").cast("double") * F.col("n")).alias("n2"), F.sum("s").alias("s"),
              F.sum(F.col("s") * F.col("s") / F.col("n")).alias("b"), F.sum("ss").alias("ss"))
    k, t = F.col("k"), F.col("t")
    msb = (F.col("b") - F.col("s") * F.col("s") / t) / (k - 1)
    msw = (F.col("ss") - F.col("b")) / (t - k)
    n0 = (t - F.col("n2") / t) / (k - 1)
    icc = F.when((k < 2) | (t <= k), 0.0).when(msw <= 0, 0.0).when(msb + (n0 - 1) * msw <= 0, 0.0).otherwise(
        F.least(F.greatest((msb - msw) / (msb + (n0 - 1) * msw), F.lit(0.0)), F.lit(0.999)))
    return g.select(icc.alias("icc"), k.alias("n_volumes"), t.alias("n_rows"))


def bin_design_effect(df: DataFrame, icc: DataFrame, n_bins=20, volume="volume", pos="relpos") -> DataFrame:
    """Per bin: 1 + (rows per volume in the bin - 1) * icc."""
    g = df.groupBy(bin_of(F.col(pos), n_bins).alias("bin")).agg((F.count(F.lit(1)) / F.countDistinct(volume)).alias("per_volume"))
    return g.crossJoin(F.broadcast(icc.select("icc"))).select(
        "bin", "per_volume", (1 + F.greatest(F.col("per_volume") - 1, F.lit(0.0)) * F.col("icc")).alias("deff"))


def bin_pairs(profile: DataFrame, deff: DataFrame | None = None, m_share=1.0) -> DataFrame:
    """Pairs of bins with the sampling sd of their rate difference; bins squared, at most thousands."""
    p = profile if deff is None else profile.join(deff.select("bin", "deff"), "bin", "left")
    d = F.lit(1.0) if deff is None else F.greatest(F.coalesce("deff", F.lit(1.0)), F.lit(1.0))
    p = settle(p.select("bin", "q", "rate", "theta", (F.col("rate") * (1 - F.col("rate")) * d / F.greatest(F.col("n") * F.lit(float(m_share)), F.lit(1.0))).alias("v")))
    l = p.select(*[F.col(c).alias(f"{c}_i") for c in ("bin", "q", "rate", "v")], "theta")
    r = p.select(*[F.col(c).alias(f"{c}_j") for c in ("bin", "q", "rate", "v")])
    return l.crossJoin(F.broadcast(r)).filter(F.col("bin_i") < F.col("bin_j")).select(
        "*", F.abs(F.col("rate_i") - F.col("rate_j")).alias("gap"), F.sqrt(F.col("v_i") + F.col("v_j")).alias("tau"))


def order_recovery_auc(profile: DataFrame, deff: DataFrame | None = None, m_share=0.8) -> DataFrame:
    """The ceiling with each pair of bins discounted by the chance that training data order it right."""
    p = bin_pairs(profile, deff, m_share)
    rho = F.when(F.col("tau") > 0, normal_cdf(F.col("gap") / F.col("tau"))).when(F.col("gap") > 0, 1.0).otherwise(0.5)
    g = p.agg(F.sum(F.col("q_i") * F.col("q_j") * F.col("gap") * (2 * rho - 1)).alias("x"), F.max("theta").alias("theta"))
    ok = (F.col("theta") > 0) & (F.col("theta") < 1)
    return g.select(F.when(ok, 0.5 + F.col("x") / (2 * F.col("theta") * (1 - F.col("theta")))).alias("auc"), "theta")


def folded_mean(delta: Column, tau: Column) -> Column:
    """E|D| of D ~ N(delta, tau^2)."""
    z = delta / tau
    return tau * math.sqrt(2 / math.pi) * F.exp(-z * z / 2) + delta * (2 * normal_cdf(z) - 1)


def invert_folded(observed: Column, tau: Column, steps=60) -> Column:
    """The |delta| whose folded mean is the observed gap, by bisection; 0 at or below the floor."""
    start = F.struct(F.lit(0.0).alias("lo"), (observed + 8 * F.greatest(tau, F.lit(1e-12))).alias("hi"))
    def halve(acc, _):
        mid = (acc["lo"] + acc["hi"]) / 2
        low = folded_mean(mid, tau) < observed
        return F.struct(F.when(low, mid).otherwise(acc["lo"]).alias("lo"), F.when(low, acc["hi"]).otherwise(mid).alias("hi"))
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return (F.when(tau <= 0, observed).when(observed <= tau * math.sqrt(2 / math.pi), 0.0)
            .otherwise((end["lo"] + end["hi"]) / 2))


def debiased_ceiling(profile: DataFrame, deff: DataFrame | None = None) -> DataFrame:
    """Raw and debiased half Gini difference, the shrink factor of the profile, and the debiased AUC."""
    p = bin_pairs(profile, deff)
    w = F.col("q_i") * F.col("q_j")
    g = p.agg(F.sum(w * F.col("gap")).alias("gmd_raw"), F.sum(w * invert_folded(F.col("gap"), F.col("tau"))).alias("gmd_debiased"), F.max("theta").alias("theta"))
    return g.select("gmd_raw", "gmd_debiased", F.when(F.col("gmd_raw") > 0, F.sqrt(F.col("gmd_debiased") / F.col("gmd_raw"))).otherwise(0.0).alias("shrink"),
                    (0.5 + F.col("gmd_debiased") / (2 * F.col("theta") * (1 - F.col("theta")))).alias("auc"))


def crossfit_ceiling(df: DataFrame, n_bins=20, seed=0) -> DataFrame:
    """Order of the bins from one half of the subjects, counts from the other, averaged."""
    f = seeded_folds(df, 2, seed).select("subject", "fold")
    c = b.encode(b.cells(df.drop("fold").join(f, "subject"), b.position_features((n_bins,))), 2, 0.0)
    a = m.auc_from_counts(c.groupBy("fold", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["fold"], few=True)
    return a.agg(F.avg("auc").alias("auc"), F.count("auc").alias("n_halves"))


def null_ceiling(df: DataFrame, n_perm=25, n_bins=20, seed=0) -> DataFrame:
    """Median and 5 / 95 % points of the ceiling under within-volume label permutation."""
    p = resample.permute_within(df, n_perm, seed=seed)
    bins = df.select("row_id", "relpos")
    c = positional_ceiling(settle(positional_profile(merged(p).join(bins, "row_id"), n_bins, ["perm"])), ["perm"])
    q = lambda x: F.percentile("auc", F.lit(x))  # one value per permutation
    return c.agg(q(0.5).alias("median"), q(0.05).alias("p05"), q(0.95).alias("p95"), F.count("auc").alias("n"))


def depth_surrogate(df: DataFrame, n_folds: int, n_bins=20) -> DataFrame:
    """Measured patient AUC of the positional score, the same if every volume held the canonical bins
    of its depth, and how many volumes reach the top bin or span all bins."""
    flat = b.cells(df, b.position_features((n_bins,)))
    tr = b.outside(flat, ["level"], n_folds)
    prior = tr.groupBy("partition").agg((F.sum("p") / F.sum(F.col("p") + F.col("n"))).alias("prior"))
    spine = prior.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_bins - 1).cast("long"))).alias("bin"))
    rate = spine.join(tr.withColumn("bin", F.col("level").cast("long")), ["partition", "bin"], "left").select(
        F.col("partition").alias("fold"), "bin", F.coalesce(F.col("p") / (F.col("p") + F.col("n")), F.col("prior")).alias("rate"))
    rate = settle(rate)  # folds times bins
    top = rate.groupBy("fold").agg(F.max(F.struct(F.round("rate", 12).alias("r"), (-F.col("bin")).alias("nb")))["nb"].alias("nb")).select("fold", (-F.col("nb")).alias("top"))
    d = df.withColumn("bin", bin_of(F.col("relpos"), n_bins))
    vol = settle(d.groupBy("volume", "subject", "fold").agg(F.count(F.lit(1)).alias("n_slices"), F.collect_set("bin").alias("bins")))  # <= n_bins values
    label = df.groupBy("subject").agg(F.max("label").alias("label"))
    real = d.join(F.broadcast(rate), ["fold", "bin"]).withColumn("score", F.col("rate"))
    canon = vol.select("volume", "subject", "fold", "n_slices").join(canonical_bins(vol, n_bins), "n_slices").join(F.broadcast(rate), ["fold", "bin"]).join(label, "subject")
    out = None
    for name, x in (("measured", real), ("surrogate", canon.withColumn("score", F.col("rate")))):
        s = settle(m.cluster_aggregate(x))
        for how in ("mean", "max"):
            a = m.auc(s, [], f"{how}_score").select(F.col("auc").alias(f"{name}_{how}"))
            out = a if out is None else out.crossJoin(F.broadcast(a))
    hit = vol.join(F.broadcast(top), "fold").agg(
        F.count(F.lit(1)).alias("n_volumes"), F.avg(F.expr("array_contains(bins, top)").cast("double")).alias("share_hit_top"),
        F.avg((F.size("bins") == n_bins).cast("double")).alias("share_span_all"))
    return out.crossJoin(F.broadcast(hit)).withColumn("predicted_max", F.when(F.col("share_hit_top") == 1, 0.5))


def predicted_vs_measured(df: DataFrame, n_folds: int, n_bins=20, n_perm=10, seed=0) -> DataFrame:
    """One row: ceiling, debiased, cross-fitted, null, predicted and measured AUC and their gaps."""
    df = settle(df)
    prof = settle(positional_profile(df, n_bins))
    icc = settle(within_volume_icc(df, n_bins))
    deff = settle(bin_design_effect(df, icc, n_bins))
    c = b.encode(b.cells(df, b.position_features((n_bins,))), n_folds, 0.0)
    meas = m.auc_from_counts(c.groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), [], few=True)
    out = positional_ceiling(prof).select(F.col("auc").alias("ceiling"))
    for x in (debiased_ceiling(prof, deff).select(F.col("auc").alias("debiased")), crossfit_ceiling(df, n_bins, seed).select(F.col("auc").alias("crossfit")),
              null_ceiling(df, n_perm, n_bins, seed).select(F.col("median").alias("null_median")),
              order_recovery_auc(prof, deff, (n_folds - 1) / n_folds).select(F.col("auc").alias("predicted")), meas.select(F.col("auc").alias("measured")), icc.select("icc")):
        out = out.crossJoin(F.broadcast(x))  # one-row results
    return out.withColumn("gap_predicted", F.col("measured") - F.col("predicted")).withColumn("gap_ceiling", F.col("measured") - F.col("ceiling"))
