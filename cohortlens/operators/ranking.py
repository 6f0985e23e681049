"""How methods rank at two units, and whether the unit reorders them.

The lists ranked here are methods (tens at most), repeated per replicate; a key is one replicate
and one unit, so windows and pairs inside a key stay tiny while keys spread over the cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import unit_draw
from ..functions.prefix import null_safe_join, number_rows, running, spread
from ..session import settle
from . import metrics as m
from . import replicates, resample
from .inference import holm_adjust

STABLE_TAU, STABLE_TOP1 = 0.5, 0.5  # fixed values of the stability rule
ALPHA = 0.05


def ranks_desc(df: DataFrame, keys=(), value="auc", out="rank") -> DataFrame:
    """Rank 1 = best, ties averaged."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return df.withColumn(out, F.rank().over(w) + (ties - 1) / 2.0)


def spearman(df: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    """Pearson of midranks; null when a side is all tied."""
    d = ranks_desc(ranks_desc(df, keys, a, "__ra"), keys, b, "__rb")
    ok = (F.min("__ra") < F.max("__ra")) & (F.min("__rb") < F.max("__rb"))
    return d.groupBy(*keys).agg(F.when(ok, m.pearson("__ra", "__rb")).alias("rho"), F.count(F.lit(1)).alias("n_methods"))


def pairs(df: DataFrame, keys=(), item="method", values=("a", "b")) -> DataFrame:
    """(keys, i, j, values of both) for i < j; at most tens of items per key."""
    l = df.select(*keys, F.col(item).alias("i"), *[F.col(v).alias(f"{v}_i") for v in values])
    r = df.select(*keys, F.col(item).alias("j"), *[F.col(v).alias(f"{v}_j") for v in values])
    j = l.join(r, list(keys)) if keys else l.crossJoin(F.broadcast(r))
    return j.filter(F.col("i") < F.col("j"))


def tau_of_methods(df: DataFrame, a: str, b: str, keys=(), item="method", out="tau") -> DataFrame:
    """Tau-b of short lists (methods of a replicate) by their pairs; null when a side is all tied."""
    p = pairs(df, keys, item, (a, b))
    sa, sb = F.signum(F.col(f"{a}_i") - F.col(f"{a}_j")), F.signum(F.col(f"{b}_i") - F.col(f"{b}_j"))
    na, nb = F.sum(F.abs(sa)), F.sum(F.abs(sb))
    return p.groupBy(*keys).agg(F.when((na > 0) & (nb > 0), F.sum(sa * sb) / F.sqrt(na * nb)).alias(out))


def inversions(df: DataFrame, keys, place: str, rank: str) -> DataFrame:
    """(keys, inversions): pairs whose ``rank`` strictly falls while ``place`` (0-based, distinct) rises.

    Two ranks differ first at one binary digit, where the larger has a one: for every digit, each zero counts the ones before
    it among the ranks that agree in all higher digits. Running counts are cut by place, so no list is one task: n log n rows.
    """
    top = df.agg(F.coalesce(F.length(F.bin(F.max(rank))), F.lit(1)).alias("n")).head()[0]  # one number
    digits = df.select(*keys, F.col(place).alias("__at"), F.col(rank).alias("__r"), F.explode(F.sequence(F.lit(0), F.lit(top - 1))).alias("__digit"))
    rows = digits.select(*keys, "__at", "__digit", F.expr("shiftright(__r, __digit + 1)").alias("__high"), F.expr("shiftright(__r, __digit) & 1").alias("__one"))
    counted = running(rows, [*keys, "__digit", "__high"], ["__at"], F.expr("shiftright(__at, 12)"), __before="__one")
    return counted.groupBy(*keys).agg(F.sum(F.when(F.col("__one") == 0, F.col("__before")).otherwise(0)).alias("inversions"))


def kendall_tau_b(df: DataFrame, a: str, b: str, keys=(), out="tau") -> DataFrame:
    """Tau-b with tie correction of lists of any length; null when a side is all tied. Rows that miss a value are left out.

    Discordant pairs are the inversions of b's rank in the order of (a, b); tied pairs come from counts.
    """
    made = not keys
    keys = list(keys) or ["__list"]
    d = (df.withColumn("__list", F.lit(1)) if made else df).filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    d = settle(d.select(*keys, F.col(a).cast("double").alias("__a"), F.col(b).cast("double").alias("__b")))
    both = settle(d.groupBy(*keys, "__a", "__b").agg(F.count(F.lit(1)).alias("__n")))
    tied = lambda cols, name: (both.groupBy(*keys, *cols).agg(F.sum("__n").alias("t")).groupBy(*keys)
                               .agg(F.sum(F.expr("t * (t - 1) div 2")).alias(name), F.sum("t").alias("n")))
    ranks = number_rows(both.select(*keys, "__b").distinct(), keys, ["__b"], spread(F.col("__b")), "__rank")
    placed = number_rows(d, keys, ["__a", "__b"], spread(F.col("__a")), "__place")
    rows = settle(null_safe_join(placed, ranks, [*keys, "__b"]))
    t = tied(["__a"], "ta")
    for cols, name in ((["__b"], "tb"), (["__a", "__b"], "tab")):
        t = null_safe_join(t, tied(cols, name).drop("n"), keys)
    t = null_safe_join(t, inversions(rows, keys, "__place", "__rank"), keys)
    all_ = F.expr("n * (n - 1) div 2")
    free_a, free_b = (all_ - F.col("ta")).cast("double"), (all_ - F.col("tb")).cast("double")
    score = all_ - F.col("ta") - F.col("tb") + F.col("tab") - 2 * F.col("inversions")
    got = t.select(*keys, F.when((free_a > 0) & (free_b > 0), score / F.sqrt(free_a * free_b)).alias(out))
    return got.drop("__list") if made else got


def top_k(df: DataFrame, k: int, keys=(), value="auc") -> DataFrame:
    """Top-k rows including ties at the k-th place."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc())
    return df.withColumn("place", F.rank().over(w)).filter(F.col("place") <= k)


def point_auc(df: DataFrame, method="method") -> DataFrame:
    """(unit, method, auc) at row and subject level."""
    a = m.auc(df, [method]).select(F.lit("slice").alias("unit"), method, "auc")
    b = m.patient_auc(df, [method]).select(F.lit("patient").alias("unit"), method, "auc")
    return a.unionByName(b)


def point_from_cells(cells: DataFrame, method="method") -> DataFrame:
    """The same from ``resample.joint_cells``, both units in one plan."""
    c = cells.groupBy("unit", method, "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return m.auc_from_counts(c, ["unit", method]).select("unit", method, "auc")


def by_unit(long: DataFrame, keys=("rep",), method="method") -> DataFrame:
    """(keys, method, slice, patient)."""
    return long.groupBy(*keys, method).agg(F.max(F.when(F.col("unit") == "slice", F.col("auc"))).alias("slice"),
                                           F.max(F.when(F.col("unit") == "patient", F.col("auc"))).alias("patient"))


def _agreement(wide: DataFrame, keys) -> DataFrame:
    keys = list(keys)
    rs = F.rank().over(Window.partitionBy(*keys).orderBy(F.col("slice").desc()))
    rp = F.rank().over(Window.partitionBy(*keys).orderBy(F.col("patient").desc()))
    t = wide.select(*keys, "method", rs.alias("rs"), rp.alias("rp")).groupBy(*keys).agg(
        F.max(((F.col("rs") == 1) & (F.col("rp") == 1)).cast("int")).alias("top1_same"),
        F.count_if((F.col("rs") <= 3) & (F.col("rp") <= 3)).alias("top3_overlap"))
    return (spearman(wide, "slice", "patient", keys).join(tau_of_methods(wide, "slice", "patient", keys), keys).join(t, keys))


def rank_agreement(point: DataFrame, reps: DataFrame) -> DataFrame:
    """One row: rho, tau, top-1 and top-3 agreement of the two units at the point and over replicates."""
    p = _agreement(by_unit(point.withColumn("rep", F.lit(-1)), ["rep"]), ["rep"])
    r = _agreement(by_unit(reps), ["rep"])
    q = lambda c, x: F.percentile(c, F.lit(x))  # one value per replicate
    s = r.agg(q("rho", 0.025).alias("rho_lo"), q("rho", 0.975).alias("rho_hi"), q("tau", 0.5).alias("tau_median"),
              q("tau", 0.025).alias("tau_lo"), q("tau", 0.975).alias("tau_hi"), F.avg("top1_same").alias("top1_same_rate"),
              F.avg("top3_overlap").alias("top3_overlap_mean"), F.count(F.lit(1)).alias("n_used"))
    return p.select(F.col("rho").alias("rho_obs"), F.col("tau").alias("tau_obs"), "top1_same",
                    F.col("top3_overlap").alias("top3_overlap_obs")).crossJoin(F.broadcast(s))


def boot_p(c: Column) -> Column:
    """Twice the smaller tail, at least one over the number of replicates."""
    return F.least(F.lit(1.0), F.greatest(2.0 * F.least(F.count_if(c <= 0), F.count_if(c >= 0)) / F.count(c), 1.0 / F.count(c)))


def rank_stability(point: DataFrame, reps: DataFrame, halves: DataFrame | None = None) -> DataFrame:
    """One row: does switching the unit move the ranking more than resampling subjects does?"""
    w = by_unit(reps)
    pw = by_unit(point.withColumn("rep", F.lit(-1)), ["rep"]).select(
        "method", F.col("slice").alias("slice_0"), F.col("patient").alias("patient_0"))
    j = settle(w.join(F.broadcast(pw), "method"))  # one row per method on the small side
    keys = ["rep"]
    t = (tau_of_methods(j, "slice", "patient", keys, out="t_bt").join(tau_of_methods(j, "slice", "slice_0", keys, out="t_ws"), keys)
         .join(tau_of_methods(j, "patient", "patient_0", keys, out="t_wp"), keys))
    first = lambda c: F.rank().over(Window.partitionBy(*keys).orderBy(F.col(c).desc())) == 1
    top = j.select("rep", (first("slice") & first("slice_0")).cast("int").alias("s"), (first("patient") & first("patient_0")).cast("int").alias("p")) \
        .groupBy("rep").agg(F.max("s").alias("top_s"), F.max("p").alias("top_p"))
    obs = tau_of_methods(pw, "slice_0", "patient_0", out="tau_obs")
    d = t.join(top, "rep").filter("t_bt IS NOT NULL AND t_ws IS NOT NULL AND t_wp IS NOT NULL").crossJoin(F.broadcast(obs))
    med = lambda c: F.percentile(c, F.lit(0.5))
    ds, dp = F.col("t_ws") - F.col("t_bt"), F.col("t_wp") - F.col("t_bt")  # (1 - t_bt) - (1 - t_w)
    g = d.agg((1 - F.max("tau_obs")).alias("d_between_obs"), F.count(F.lit(1)).alias("n_used"), med(ds).alias("delta_slice"), boot_p(ds).alias("p_slice"),
              med(dp).alias("delta_patient"), boot_p(dp).alias("p_patient"), med("t_ws").alias("tau_within_slice"),
              med("t_wp").alias("tau_within_patient"), F.avg("top_s").alias("top1_slice"), F.avg("top_p").alias("top1_patient"),
              F.greatest(F.avg((1 - F.col("t_ws") >= 1 - F.col("tau_obs")).cast("double")),
                         F.avg((1 - F.col("t_wp") >= 1 - F.col("tau_obs")).cast("double"))).alias("p_exceed"))
    half = (halves.agg(F.min("tau_median").alias("half_min")) if halves is not None
            else g.select(F.lit(None).cast("double").alias("half_min")))
    g = g.crossJoin(F.broadcast(half))
    order = ((F.coalesce("tau_within_slice", F.lit(0.0)) < STABLE_TAU) | (F.coalesce("tau_within_patient", F.lit(0.0)) < STABLE_TAU)
             | F.coalesce(F.col("half_min") < STABLE_TAU, F.lit(False)))
    top1 = (F.col("top1_slice") < STABLE_TOP1) | (F.col("top1_patient") < STABLE_TOP1)
    exceed = ((F.col("delta_slice") > 0) & (F.col("p_slice") < ALPHA) & (F.col("delta_patient") > 0) & (F.col("p_patient") < ALPHA))
    return g.withColumn("verdict", F.when(F.col("n_used") == 0, "NO_ESTIMATE").when(exceed, "UNIT_CHANGES_RANK")
                        .when(order, "CANNOT_RANK").when(top1, "CANNOT_NAME_WINNER").otherwise("INCONCLUSIVE"))


def split_half_tau(df: DataFrame, n_rep=200, seed=0, method="method", subject="subject") -> DataFrame:
    """(unit, median, lo, hi, n_used): tau between the rankings of two disjoint halves of the subjects."""
    cells = resample.joint_cells(df, method, subject)
    a = replicates.replicate_auc(cells, replicates.split_halves(df, n_rep, seed, subject), ["unit", method], subject, halves=n_rep)
    w = a.groupBy("rep", "unit", method).agg(F.max(F.when(F.col("half") == 0, F.col("auc"))).alias("h0"),
                                             F.max(F.when(F.col("half") == 1, F.col("auc"))).alias("h1"),
                                             (F.count("auc") == 2).alias("ok"))
    w = settle(w)
    bad = w.filter("NOT ok").select("rep").distinct()
    t = tau_of_methods(w.join(bad, "rep", "left_anti"), "h0", "h1", ["rep", "unit"], method)
    q = lambda x: F.percentile("tau", F.lit(x))
    return t.groupBy("unit").agg(q(0.5).alias("tau_median"), q(0.025).alias("tau_lo"), q(0.975).alias("tau_hi"), F.count("tau").alias("n_used"))


def pair_differences(reps: DataFrame, method="method") -> DataFrame:
    """(unit, i, j, ci_lo, ci_hi, p) of AUC differences over replicates."""
    p = pairs(reps, ["rep", "unit"], method, ("auc",)).withColumn("d", F.col("auc_i") - F.col("auc_j"))
    q = lambda x: F.percentile("d", F.lit(x))
    return p.groupBy("unit", "i", "j").agg(q(0.025).alias("ci_lo"), q(0.975).alias("ci_hi"), boot_p(F.col("d")).alias("p"))


def inversion_pairs(point: DataFrame, reps: DataFrame, method="method") -> DataFrame:
    """Pairs whose order flips between units, turned so that the slice unit prefers ``a``.

    A pair survives when both intervals exclude zero in opposite directions and both Holm-adjusted
    p are below 0.05; Holm runs over all pairs of a unit, not only the flipped ones.
    """
    d = holm_adjust(pair_differences(reps, method), keys=["unit"], order=("i", "j"))
    o = pairs(point, ["unit"], method, ("auc",)).select("unit", "i", "j", (F.col("auc_i") - F.col("auc_j")).alias("diff"))
    x = d.join(o, ["unit", "i", "j"])
    side = lambda u, s: x.filter(F.col("unit") == u).select("i", "j", *[F.col(c).alias(f"{c}_{s}") for c in ("diff", "ci_lo", "ci_hi", "p_holm")])
    w = side("slice", "s").join(side("patient", "p"), ["i", "j"])
    w = w.filter((F.col("diff_s") != 0) & (F.col("diff_p") != 0) & ((F.col("diff_s") > 0) != (F.col("diff_p") > 0)))
    up = F.col("diff_s") > 0
    lo_s = F.when(up, F.col("ci_lo_s")).otherwise(-F.col("ci_hi_s"))
    hi_p = F.when(up, F.col("ci_hi_p")).otherwise(-F.col("ci_lo_p"))
    return w.select(F.when(up, F.col("i")).otherwise(F.col("j")).alias("a"), F.when(up, F.col("j")).otherwise(F.col("i")).alias("b"),
                    F.abs("diff_s").alias("slice_diff"), F.abs("diff_p").alias("patient_diff"), "p_holm_s", "p_holm_p",
                    ((lo_s > 0) & (hi_p < 0) & (F.col("p_holm_s") < ALPHA) & (F.col("p_holm_p") < ALPHA)).alias("survives"))


def condition_interaction(point: DataFrame, reps: DataFrame, contrast=("a", "b"), model="model") -> DataFrame:
    """Per model how much the contrast of two conditions moves when the unit changes, with a mean row.

    Rows carry (unit, model, condition, auc); replicates also rep.
    """
    c1, c2 = contrast
    pick = lambda u, c: F.max(F.when((F.col("unit") == u) & (F.col("condition") == c), F.col("auc")))
    def moves(d, keys):
        g = d.groupBy(*keys, model).agg((pick("slice", c1) - pick("slice", c2)).alias("d_slice"), (pick("patient", c1) - pick("patient", c2)).alias("d_agg"),
                                        F.least(pick("patient", c1), pick("patient", c2)).alias("low"))
        return g.withColumn("x", F.col("d_agg") - F.col("d_slice")).filter(F.col("x").isNotNull())
    o, r = moves(point, []), moves(reps, ["rep"])
    r = r.select("rep", model, "x").unionByName(r.groupBy("rep").agg(F.avg("x").alias("x")).withColumn(model, F.lit("MEAN")))
    q = lambda x: F.percentile("x", F.lit(x))
    ci = r.groupBy(model).agg(q(0.025).alias("ci_lo"), q(0.975).alias("ci_hi"), boot_p(F.col("x")).alias("p"))
    mean = o.agg(F.avg("d_slice").alias("d_slice"), F.avg("d_agg").alias("d_agg"), F.lit(None).cast("double").alias("low"), F.avg("x").alias("x")).withColumn(model, F.lit("MEAN"))
    d = o.unionByName(mean).join(ci, model)
    one = holm_adjust(d.filter(F.col(model) != "MEAN"), order=(model,)).unionByName(d.filter(F.col(model) == "MEAN").withColumn("p_holm", F.lit(None).cast("double")))
    ceil = F.coalesce(F.col("low") >= 0.995, F.lit(False))
    return one.select(model, "d_slice", "d_agg", F.col("x").alias("interaction"), "ci_lo", "ci_hi", "p", "p_holm",
                      ((F.col("d_slice") != 0) & (F.col("d_agg") != 0) & ((F.col("d_slice") > 0) != (F.col("d_agg") > 0))).alias("sign_flip"),
                      ceil.alias("ceilinged"), (((F.col("ci_lo") > 0) | (F.col("ci_hi") < 0)) & (F.coalesce("p_holm", F.lit(1.0)) < ALPHA) & ~ceil).alias("supported"))


def discordant_tables(cells: DataFrame) -> DataFrame:
    """(doc, metric): models read at a fine and a coarse unit of one document, discordant pairs, tau,
    and whether the best model changes (strictly: the best is unique at both units)."""
    v = lambda u: F.max(F.when(F.col("unit") == u, F.col("value")))
    w = cells.groupBy("doc", "metric", "model").agg(v("fine").alias("fine"), v("coarse").alias("coarse")).filter("fine IS NOT NULL AND coarse IS NOT NULL")
    keys = ["doc", "metric"]
    p = pairs(w, keys, "model", ("fine", "coarse"))
    s = F.signum(F.col("fine_i") - F.col("fine_j")) * F.signum(F.col("coarse_i") - F.col("coarse_j"))
    g = p.groupBy(*keys).agg(F.count_if(s < 0).alias("n_discordant"), F.count(F.lit(1)).alias("n_pairs"))
    top = w.groupBy(*keys).agg(F.max("fine").alias("mf"), F.max("coarse").alias("mc"), F.count(F.lit(1)).alias("n_models"))
    b = w.join(top, keys).groupBy(*keys).agg(
        F.count_if(F.col("fine") == F.col("mf")).alias("kf"), F.count_if(F.col("coarse") == F.col("mc")).alias("kc"), F.max("n_models").alias("n_models"),
        F.count_if((F.col("fine") == F.col("mf")) & (F.col("coarse") == F.col("mc"))).alias("both"))
    return (g.join(b, keys).join(kendall_tau_b(w, "fine", "coarse", keys), keys).filter("n_discordant > 0")
            .withColumn("top1_changed_strict", (F.col("both") == 0) & (F.col("kf") == 1) & (F.col("kc") == 1)).drop("kf", "kc", "both"))


def sweep_summary(est: DataFrame, models, conditions) -> DataFrame:
    """One row per expected (model, condition): text, does the interval clear 0.5, best cell, missing."""
    spine = est.sparkSession.range(1).select(F.explode(F.array(*[F.lit(x) for x in models])).alias("model")).select(
        "model", F.explode(F.array(*[F.lit(x) for x in conditions])).alias("condition"))
    best = est.agg(F.max(F.struct("auc", "model", "condition")).alias("b"))
    d = spine.join(est, ["model", "condition"], "left").crossJoin(F.broadcast(best))
    text = F.format_string("%.3f [%.3f, %.3f]", "auc", "ci_lo", "ci_hi")
    return d.select("model", "condition", F.when(F.col("auc").isNotNull(), text).alias("text"), (F.col("ci_lo") > 0.5).alias("clears"),
                    ((F.col("model") == F.col("b.model")) & (F.col("condition") == F.col("b.condition"))).alias("is_best"), F.col("auc").isNull().alias("missing"))
