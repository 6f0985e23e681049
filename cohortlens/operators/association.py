"""Association between columns, agreement between raters, bounds under missing answers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import group_stats, merged, null_safe_join, number_rows, spread, text_lead
from ..functions.rules import canonical_text
from ..session import settle
from . import metrics as m
from . import replicates, resample
from .metrics import wilson


def contingency(df: DataFrame, a: str, b: str, keys=()) -> DataFrame:
    """(keys, a, b, n): level by level counts, as text."""
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    return d.groupBy(*keys, F.col(a).cast("string").alias("a"), F.col(b).cast("string").alias("b")).agg(F.count(F.lit(1)).alias("n"))


def table_statistics(ct: DataFrame, keys=()) -> DataFrame:
    """Chi-square, V, corrected V, mutual information and entropies from (keys, a, b, n).

    Marginals come from the counts; absent cells add nothing to any of the sums in this form.
    """
    keys = list(keys)
    ra = ct.groupBy(*keys, "a").agg(F.sum("n").alias("r"))
    cb = ct.groupBy(*keys, "b").agg(F.sum("n").alias("c"))
    tot = ct.groupBy(*keys).agg(F.sum("n").alias("t"))
    j = null_safe_join(null_safe_join(null_safe_join(ct, ra, [*keys, "a"]), cb, [*keys, "b"]), tot, keys)
    n, r, c, t = (F.col(x).cast("double") for x in ("n", "r", "c", "t"))
    g = j.groupBy(*keys).agg(F.sum(n * n / (r * c)).alias("q"), F.sum(n / t * F.log(n * t / (r * c))).alias("mi"), F.max(t).alias("total"))
    def entropy(x, col, name):
        return null_safe_join(x, tot, keys).groupBy(*keys).agg(
            (-F.sum(F.col(col) / F.col("t") * F.log(F.col(col) / F.col("t")))).alias(f"h_{name}"), F.count(F.lit(1)).alias(f"k_{name}"))
    g = null_safe_join(null_safe_join(g, entropy(ra, "r", "a"), keys), entropy(cb, "c", "b"), keys)
    g = g.withColumn("chi2", F.col("total") * (F.col("q") - 1))
    ka, kb, N = F.col("k_a"), F.col("k_b"), F.col("total")
    phi = F.col("chi2") / N
    corr = F.greatest(F.lit(0.0), phi - (ka - 1) * (kb - 1) / (N - 1))
    side = lambda k: k - (k - 1) * (k - 1) / (N - 1)
    least = F.least(ka, kb) - 1
    low = F.least(side(ka), side(kb)) - 1
    return g.select(
        *keys, "chi2", F.when(least > 0, F.sqrt(phi / least)).alias("v"), F.when(low > 0, F.sqrt(corr / low)).alias("v_corrected"),
        "mi", (F.col("mi") / math.log(2)).alias("mi_bits"), "h_a", "h_b",
        F.when((F.col("h_a") > 0) & (F.col("h_b") > 0), F.col("mi") / F.sqrt(F.col("h_a") * F.col("h_b"))).alias("nmi"),
        F.when(F.col("h_b") > 0, F.col("mi") / F.col("h_b")).alias("u_b_given_a"), N.cast("long").alias("n"))


def association_matrix(df: DataFrame, cols, label: str) -> DataFrame:
    """(first, second) statistics for all pairs of context columns and of each with the label.

    Pair counts are made from an array of the row's values, so no row is joined to itself.
    """
    names = [*cols, label]
    pairs = F.array(*[F.struct(F.lit(x).alias("first"), F.lit(y).alias("second"), F.col(x).cast("string").alias("a"), F.col(y).cast("string").alias("b"))
                      for i, x in enumerate(names) for y in names[i + 1:]])
    d = df.select(F.inline(pairs)).filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    ct = settle(d.groupBy("first", "second", "a", "b").agg(F.count(F.lit(1)).alias("n")))
    return table_statistics(ct, ["first", "second"])


def association_null(df: DataFrame, a: str, b: str, n_perm: int, seed=0, row="row_id") -> DataFrame:
    """Observed V and MI against shuffles of one variable: null mean, q95, p."""
    base = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("whole", F.lit(1))
    p = resample.permute_within(base, n_perm, ["whole"], row, b, seed)
    null = table_statistics(settle(contingency(merged(base.drop(b)).join(p, row), a, b, ["perm"])), ["perm"])
    obs = table_statistics(contingency(base, a, b)).select(F.col("v").alias("v_obs"), F.col("mi").alias("mi_obs"))
    j = null.crossJoin(F.broadcast(obs))
    n = F.count(F.lit(1))
    q = lambda c: F.percentile(c, F.lit(0.95))  # one value per permutation
    return j.agg(F.max("v_obs").alias("v"), F.avg("v").alias("v_null_mean"), q("v").alias("v_null_q95"),
                 ((F.count_if(F.col("v") >= F.col("v_obs") - 1e-12) + 1) / (n + 1)).alias("v_p"), F.max("mi_obs").alias("mi"),
                 F.avg("mi").alias("mi_null_mean"), ((F.count_if(F.col("mi") >= F.col("mi_obs") - 1e-12) + 1) / (n + 1)).alias("mi_p"))


def auc_vs_label(subj: DataFrame, cols, label="label", first="subject") -> DataFrame:
    """Each column as a score against the label at subject level, folded to at least 0.5.

    A text level is coded by the order of the smallest subject that has it.
    """
    types = dict(subj.dtypes)
    text = [c for c in cols if types[c] == "string"]
    arms = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level"),
                              (F.lit(None) if c in text else F.col(c)).cast("double").alias("num")) for c in cols])
    d = settle(subj.select(first, F.col(label).alias("label"), F.inline(arms)).filter(F.col("level").isNotNull()))
    seen = d.filter(F.col("column").isin(*text)).groupBy("column", "level").agg(F.min(first).alias("__f")) if text else \
        d.limit(0).select("column", "level", F.col(first).alias("__f"))
    codes = number_rows(seen, ["column"], ["__f", "level"], text_lead(F.col("__f").cast("string")) if dict(seen.dtypes)["__f"] == "string" else spread(F.col("__f")), "code")
    j = null_safe_join(d, codes.drop("__f"), ["column", "level"], "left").withColumn("score", F.coalesce("num", F.col("code").cast("double")))
    lv = d.groupBy("column").agg(F.countDistinct("level").alias("n_levels"), F.count(F.lit(1)).alias("n"))
    a = m.auc(j, ["column"])
    return a.join(lv, "column").filter("n_levels > 1").select("column", "n", "n_levels", F.greatest(F.col("auc"), 1 - F.col("auc")).alias("auc"))


def eta_squared(subj: DataFrame, cols, score="score", label="label", per_level=4) -> DataFrame:
    """Share of the score variance between levels; null where levels are too small; label as reference."""
    arms = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("level")) for c in [*cols, label]])
    d = subj.select(F.col(score).cast("double").alias("x"), F.inline(arms)).filter(F.col("level").isNotNull() & F.col("x").isNotNull())
    g = d.groupBy("column", "level").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mu"), F.var_pop("x").alias("v"))
    tot = g.groupBy("column").agg(F.sum("n").alias("size"), F.count(F.lit(1)).alias("levels"), (F.sum(F.col("n") * F.col("mu")) / F.sum("n")).alias("grand"))
    j = g.join(tot, "column")
    ssb = F.sum(F.col("n") * F.pow(F.col("mu") - F.col("grand"), 2))
    ssw = F.sum(F.col("n") * F.col("v"))
    r = j.groupBy("column").agg(ssb.alias("ssb"), ssw.alias("ssw"), F.max("size").alias("size"), F.max("levels").alias("n_levels"))
    ok = F.col("n_levels") <= F.greatest(F.lit(2), F.expr(f"size div {per_level}"))
    st = F.col("ssb") + F.col("ssw")
    return r.filter("n_levels > 1").select("column", "size", "n_levels", F.when(ok & (st > 0), F.col("ssb") / st).alias("eta2"),
                                           F.when(~ok, "too many levels").alias("skipped"))


def connected_components(edges: DataFrame, src="src", dst="dst") -> DataFrame:
    """(node, component) where component is the smallest node id reachable.

    Alternates neighbour minimum and pointer jumping, so a chain of length L needs about log L
    rounds, and the loop ends when one changes nothing; each round is written to the shared folder.
    """
    e = edges.select(F.col(src).alias("x"), F.col(dst).alias("y")).distinct()
    both = settle(e.unionByName(e.select(F.col("y").alias("x"), F.col("x").alias("y"))).distinct())
    lab = settle(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("x")).alias("component")))
    while True:
        near = (both.join(lab.select(F.col("node").alias("y"), F.col("component").alias("c")), "y")
                .groupBy(F.col("x").alias("node")).agg(F.min("c").alias("__n")))
        step = lab.join(near, "node").select("node", F.col("component").alias("__old"), F.least("component", "__n").alias("component"))
        step = settle(step)
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("__j"))
        new = settle(step.join(jump, "component").select("node", "__old", F.col("__j").alias("component")))
        if not new.filter(F.col("component") != F.col("__old")).head(1):
            return new.select("node", "component")
        lab = new.select("node", "component")


def site_components(df: DataFrame, institution="institution", device="device"):
    """(canonical string, site, rows, shared devices): strings that share a device are one site.

    A site is named by its most common string, then the shortest, then the smallest.
    """
    pairs = settle(df.groupBy(canonical_text(F.col(institution)).alias("inst"), F.concat(F.lit("DEV:"), F.col(device).cast("string")).alias("dev"))
                   .agg(F.count(F.lit(1)).alias("n")))
    comp = connected_components(pairs.select(F.concat(F.lit("INST:"), F.col("inst")).alias("src"), F.col("dev").alias("dst")))
    per = pairs.groupBy("inst").agg(F.sum("n").alias("n_rows"))
    inst = comp.filter(F.col("node").startswith("INST:")).select(F.expr("substring(node, 6)").alias("inst"), "component").join(per, "inst")
    name = inst.groupBy("component").agg(
        F.min(F.struct((-F.col("n_rows")).alias("a"), F.length("inst").alias("b"), F.col("inst").alias("c")))["c"].alias("site"),
        F.count(F.lit(1)).alias("n_strings"))
    shared = (pairs.groupBy("dev").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
              .join(comp.select(F.col("node").alias("dev"), "component"), "dev").groupBy("component").agg(F.count(F.lit(1)).alias("n_shared_devices")))
    return inst.join(name, "component").join(shared, "component", "left").select(
        "inst", "site", "n_rows", "n_strings", F.coalesce("n_shared_devices", F.lit(0)).alias("n_shared_devices"))


def same_partition(df: DataFrame, a: str, b: str) -> DataFrame:
    """Do two groupings make the same partition: one value of each per value of the other."""
    p = df.select(F.col(a).alias("a"), F.col(b).alias("b")).distinct()
    one = lambda k: p.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias(f"max_{k}"))
    return one("a").crossJoin(F.broadcast(one("b"))).select(
        "max_a", "max_b", ((F.col("max_a") == 1) & (F.col("max_b") == 1)).alias("same"))


def rater_agreement(df: DataFrame, item="item", code="code", keys=()) -> DataFrame:
    """Observed agreement, Fleiss kappa, Gwet AC1 and unanimous items, from (item, code) counts."""
    keys = list(keys)
    c = df.groupBy(*keys, item, F.col(code).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    per = c.groupBy(*keys, item).agg(F.sum("n").alias("m"), F.sum(F.col("n") * (F.col("n") - 1)).alias("agree"), F.count(F.lit(1)).alias("k"))
    obs = per.groupBy(*keys).agg(F.avg(F.col("agree") / (F.col("m") * (F.col("m") - 1))).alias("pa"), F.count(F.lit(1)).alias("n_items"),
                                 F.max("m").alias("n_raters"), F.sum("m").alias("t"), F.count_if(F.col("k") == 1).alias("n_unanimous"))
    cat = null_safe_join(c.groupBy(*keys, "c").agg(F.sum("n").alias("n")), obs.select(*keys, "t"), keys)
    s = F.col("n") / F.col("t")
    pe = cat.groupBy(*keys).agg(F.sum(s * s).alias("pe_f"), F.sum(s * (1 - s)).alias("w"), F.count(F.lit(1)).alias("n_categories"))
    g = null_safe_join(obs, pe, keys)
    pg = F.when(F.col("n_categories") > 1, F.col("w") / (F.col("n_categories") - 1)).otherwise(0.0)
    return g.select(*keys, "pa", F.when(F.col("pe_f") < 1 - 1e-12, (F.col("pa") - F.col("pe_f")) / (1 - F.col("pe_f"))).alias("fleiss_kappa"),
                    ((F.col("pa") - pg) / (1 - pg)).alias("gwet_ac1"), "n_items", "n_raters", "n_categories", "n_unanimous")


def agreement_bootstrap(df: DataFrame, n_boot=2000, seed=0, item="item", code="code") -> DataFrame:
    """Item-resampled intervals of the observed agreement, Fleiss kappa and Gwet AC1: one row per ``statistic``.

    Items of equal category counts are one type; a replicate is the weights of its types, so its statistics are sums over
    few rows. Categories are those of the replicate; with one alone kappa is undefined (skipped) and AC1 is 1.
    """
    c = df.groupBy(item, F.col(code).alias("c")).agg(F.count(F.lit(1)).alias("n"))
    per = settle(c.groupBy(item).agg(F.array_sort(F.collect_list(F.struct("c", "n"))).alias("type")))  # an item has few codes
    known = settle(per.groupBy("type").agg(F.min(item).alias("id")))  # a type goes by its smallest item
    unit = per.join(known, "type").select(item, "id", F.lit(1).alias("w"))
    w = replicates.weighted_sums(unit, settle(resample.packed(per, n_boot, seed, item)), ["id"], ["w"], item).filter("w > 0")
    types = settle(w.join(known, "id").select("rep", "type", "w"))
    cell = types.select("rep", "w", F.inline("type"), F.aggregate("type", F.lit(0).cast("long"), lambda t, x: t + x["n"]).alias("m"))
    share = cell.groupBy("rep").agg(F.sum(F.col("w") * F.col("n")).alias("t"), F.sum(F.col("w") * F.col("n") * (F.col("n") - 1) / (F.col("m") * (F.col("m") - 1))).alias("agree"))
    items = types.groupBy("rep").agg(F.sum("w").alias("items"))
    cat = cell.groupBy("rep", "c").agg(F.sum(F.col("w") * F.col("n")).alias("n")).join(share, "rep").withColumn("s", F.col("n") / F.col("t"))
    g = cat.groupBy("rep").agg(F.sum(F.col("s") * F.col("s")).alias("pf"), F.sum(F.col("s") * (1 - F.col("s"))).alias("pg"), F.count(F.lit(1)).alias("q"), F.max("agree").alias("agree"))
    g = g.join(items, "rep").withColumn("pa", F.col("agree") / F.col("items")).withColumn("pg", F.when(F.col("q") > 1, F.col("pg") / (F.col("q") - 1)).otherwise(0.0))
    kappa = F.when(F.col("q") > 1, (F.col("pa") - F.col("pf")) / (1 - F.col("pf")))
    rows = F.array(*[F.struct(F.lit(k).alias("statistic"), v.alias("value")) for k, v in (
        ("pa", F.col("pa")), ("fleiss_kappa", kappa), ("gwet_ac1", (F.col("pa") - F.col("pg")) / (1 - F.col("pg"))))])
    return resample.percentile_ci(g.select(F.inline(rows)), ["statistic"], "value")


def cohen_kappa(df: DataFrame, item="item", rater="rater", code="code") -> DataFrame:
    """Agreement and kappa of each rater pair. An item has a handful of raters, so pairs are few."""
    a = df.select(item, F.col(rater).alias("rater_a"), F.col(code).alias("ca"))
    b = df.select(item, F.col(rater).alias("rater_b"), F.col(code).alias("cb"))
    c = a.join(b, item).filter(F.col("rater_a") < F.col("rater_b")).groupBy("rater_a", "rater_b", "ca", "cb").agg(F.count(F.lit(1)).alias("n"))
    c = settle(c)
    by = ["rater_a", "rater_b"]
    po = c.groupBy(*by).agg((F.sum(F.when(F.col("ca") == F.col("cb"), F.col("n")).otherwise(0)) / F.sum("n")).alias("po"), F.sum("n").alias("t"))
    ma = c.groupBy(*by, F.col("ca").alias("c")).agg(F.sum("n").alias("na"))
    mb = c.groupBy(*by, F.col("cb").alias("c")).agg(F.sum("n").alias("nb"))
    pe = ma.join(mb, [*by, "c"]).join(po, by).groupBy(*by).agg(F.sum(F.col("na") / F.col("t") * (F.col("nb") / F.col("t"))).alias("pe"))
    d = po.join(pe, by, "left").withColumn("pe", F.coalesce("pe", F.lit(0.0)))
    return d.select(*by, "po", F.when(F.col("pe") < 1 - 1e-12, (F.col("po") - F.col("pe")) / (1 - F.col("pe"))).alias("kappa"), F.col("t").alias("n"))


def majority_code(df: DataFrame, prefer=(), item="item", code="code") -> DataFrame:
    """Most frequent code per item; ties by the preference list, then by the code; tie flag."""
    rank = F.lit(len(prefer))
    for i, p in reversed(list(enumerate(prefer))):
        rank = F.when(F.col("c") == p, i).otherwise(rank)
    c = df.groupBy(item, F.col(code).cast("string").alias("c")).agg(F.count(F.lit(1)).alias("n")).withColumn("__p", rank)
    g = c.groupBy(item).agg(F.min(F.struct((-F.col("n")).alias("a"), "__p", "c")).alias("b"), F.max("n").alias("top"))
    ties = c.join(g.select(item, "top"), item).filter(F.col("n") == F.col("top")).groupBy(item).agg(F.count(F.lit(1)).alias("k"))
    return g.join(ties, item).select(item, F.col("b.c").alias("majority"), F.col("top").alias("votes"), (F.col("k") > 1).alias("tied"))


def consensus(df: DataFrame, item="item", code="code") -> DataFrame:
    """TRUE if any rater says so, FALSE only if all do, and whether a disagreement remains."""
    y = F.col(code) == 1
    return df.groupBy(item).agg(F.when(F.bool_or(y), "TRUE").when(F.bool_and(~y), "FALSE").otherwise("NOT_ASSESSABLE").alias("consensus"),
                                (F.min(code) != F.max(code)).alias("disagreement"))


def endpoint_bounds(df: DataFrame, flag="flag", limit=0.15) -> DataFrame:
    """k of n with Wilson limits: complete case, lower (missing = no), upper (missing = yes).

    Where more than ``limit`` is missing, the bounds replace the estimate.
    """
    yes, no = F.count_if(F.col(flag) == "TRUE"), F.count_if(F.col(flag) == "FALSE")
    gap = F.count_if(F.col(flag) == "NOT_ASSESSABLE")
    one = df.agg(yes.alias("y"), no.alias("x"), gap.alias("g"))
    total = F.col("y") + F.col("x") + F.col("g")
    rows = F.array(*[F.struct(F.lit(n).alias("endpoint"), k.cast("long").alias("k"), t.cast("long").alias("n")) for n, k, t in (
        ("complete_case", F.col("y"), F.col("y") + F.col("x")), ("lower_bound", F.col("y"), total), ("upper_bound", F.col("y") + F.col("g"), total))])
    d = one.select((F.col("g") / total > limit).alias("bounds_replace"), F.inline(rows))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return d.select("endpoint", "k", "n", F.try_divide(F.col("k").cast("double"), F.col("n")).alias("proportion"), lo.alias("ci_lo"), hi.alias("ci_hi"), "bounds_replace")


def screening_flow(df: DataFrame, stage="stage", reason="reason") -> DataFrame:
    """Counts per stage and per reason inside a stage, in one pass over grouping sets."""
    return (df.groupingSets([[stage], [stage, reason]], stage, reason)
            .agg(F.count(F.lit(1)).alias("n"), F.grouping(reason).alias("is_total")))


def stopping_rule(df: DataFrame, target: int, block="block", included="included") -> DataFrame:
    """Running included total by block; blocks after the target was reached are post hoc (few blocks)."""
    g = df.groupBy(block).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(included).cast("long")).alias("n_included"))
    w = Window.orderBy(block).rowsBetween(Window.unboundedPreceding, 0)
    g = g.withColumn("running", F.sum("n_included").over(w))
    return g.withColumn("post_hoc", (F.col("running") - F.col("n_included")) >= target)


def cross_table(df: DataFrame, row: str, col: str, values) -> DataFrame:
    """Counts of one column against the fixed values of another."""
    return df.groupBy(row).pivot(col, list(values)).agg(F.count(F.lit(1))).na.fill(0, list(values))
