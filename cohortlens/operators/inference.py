"""Tests and corrections."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.prefix import null_safe_join, running, spread
from ..functions.rules import snap, usable
from ..session import settle
from . import metrics as m
from . import resample
from .metrics import wilson

Z_975 = 1.959963984540054  # fixed value


@F.pandas_udf(DoubleType())
def _erfc(x: pd.Series) -> pd.Series:
    return x.map(math.erfc)


def normal_p(z: Column) -> Column:
    """Two-sided normal p, exact through erfc in Arrow batches."""
    return F.least(F.lit(1.0), _erfc(F.abs(z) / F.lit(math.sqrt(2.0))))


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function without leaving the JVM (absolute error below 7.5e-8).

    Fixed values: the five-term polynomial of Abramowitz and Stegun 26.2.17.
    """
    a = F.abs(x)
    k = 1.0 / (1.0 + 0.2316419 * a)
    poly = k * (0.319381530 + k * (-0.356563782 + k * (1.781477937 + k * (-1.821255978 + k * 1.330274429))))
    upper = F.exp(-a * a / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(x >= 0, 1 - upper).otherwise(upper)


def placements(df: DataFrame, keys=(), row="row_id", score="score", label="label") -> DataFrame:
    """Per row the share of the other class it beats (ties half), from score counts joined back."""
    keys = list(keys)
    c = df.filter(usable(F.col(label), F.col(score))).groupBy(*keys, score).agg(
        F.sum(label).alias("p"), F.sum(1 - F.col(label)).alias("n"))
    r = running(c, keys, [score], spread(F.col(score)), pb="p", nb="n")
    t = c.groupBy(*keys).agg(F.sum("p").alias("tp"), F.sum("n").alias("tn"))
    r = null_safe_join(r, t, keys).select(
        *keys, score, ((F.col("nb") - F.col("n") / 2) / F.col("tn")).alias("v1"),
        (1 - (F.col("pb") - F.col("p") / 2) / F.col("tp")).alias("v0"), "tp", "tn")
    j = null_safe_join(df.select(*keys, row, label, score), r, [*keys, score])
    return j.withColumn("v", F.when(F.col(label) == 1, F.col("v1")).otherwise(F.col("v0"))).drop("v1", "v0", score)


def delong(df: DataFrame, a: str, b: str, keys=(), row="row_id", label="label") -> DataFrame:
    """Two correlated AUCs on the same rows: variances, covariance, standard error, z, two-sided p and interval of the difference.

    Where the test is refused, with a reason, the AUCs stay and all from the standard error on is null.
    """
    keys = list(keys)
    # a row that lacks one score is in neither arm: placements are taken after both scores are known
    df = df.filter(usable(F.col(label), F.col(a)) & usable(F.col(label), F.col(b))).withColumns({a: snap(F.col(a)), b: snap(F.col(b))})
    pa = placements(df, keys, row, a, label).withColumnRenamed("v", "va")
    pb = placements(df, keys, row, b, label).select(*keys, row, F.col("v").alias("vb"))
    j = null_safe_join(pa, pb, [*keys, row])
    pos = F.col(label) == 1
    at = lambda c, cond: F.when(cond, F.col(c))
    g = j.groupBy(*keys).agg(
        F.avg(at("va", pos)).alias("auc_a"), F.avg(at("vb", pos)).alias("auc_b"),
        F.count_if(pos).alias("m"), F.count_if(~pos).alias("n"),
        *[f(*cols).alias(name) for name, f, cols in (
            ("a1", F.var_samp, [at("va", pos)]), ("a0", F.var_samp, [at("va", ~pos)]),
            ("b1", F.var_samp, [at("vb", pos)]), ("b0", F.var_samp, [at("vb", ~pos)]),
            ("c1", F.covar_samp, [at("va", pos), at("vb", pos)]), ("c0", F.covar_samp, [at("va", ~pos), at("vb", ~pos)]))])
    part = lambda x: F.col(f"{x}1") / F.col("m") + F.col(f"{x}0") / F.col("n")
    d = g.select(*keys, "auc_a", "auc_b", (F.col("auc_a") - F.col("auc_b")).alias("diff"), part("a").alias("var_a"),
                 part("b").alias("var_b"), part("c").alias("cov_ab"), "m", "n")
    var = F.col("var_a") + F.col("var_b") - 2 * F.col("cov_ab")
    d = d.withColumn("var_diff", var)
    why = (F.when((F.col("m") < 1) | (F.col("n") < 1), "single-class").when((F.col("m") < 2) | (F.col("n") < 2), "too few cases")
           .when(F.coalesce(F.col("var_diff"), F.lit(0.0)) <= 1e-18, "degenerate variance"))
    d = d.withColumn("reason", why)
    d = d.withColumn("se_diff", F.when(F.col("reason").isNull(), F.sqrt("var_diff")))
    d = d.withColumn("z", F.when(F.col("reason").isNull(), F.col("diff") / F.sqrt("var_diff")))
    p = F.when(F.col("z").isNotNull(), normal_p(F.coalesce("z", F.lit(0.0))))
    return d.withColumns({"p": p, "ci_lo": F.col("diff") - Z_975 * F.col("se_diff"), "ci_hi": F.col("diff") + Z_975 * F.col("se_diff")})


def compare_conditions(df: DataFrame, keys=("method",), condition="condition", row="row_id", n_boot=2000, seed=0) -> DataFrame:
    """DeLong, and next to it the subject-resampled difference, for every pair of conditions of one experiment at row, patient-mean and patient-max level.

    DeLong takes cases as independent, which rows of a subject are not. Draws are shared by all pairs and levels; a case that lacks one score is in neither.
    """
    keys = list(keys)
    s = m.cluster_aggregate(df, [*keys, condition])
    levels = df.select(*keys, condition, F.lit("slice").alias("level"), F.col(row).cast("string").alias("id"), "subject", "label", "score")
    both = F.array(*[F.struct(F.lit(f"patient_{name}").alias("level"), F.col(f"{name}_score").alias("score")) for name in ("mean", "max")])
    levels = settle(levels.unionByName(s.select(*keys, condition, F.col("subject").alias("id"), "subject", "label", F.inline(both))))
    by = [*keys, "level", "id"]
    a = levels.select(*by, "subject", "label", F.col(condition).alias("condition_a"), F.col("score").alias("sa"))
    b = levels.select(*by, F.col(condition).alias("condition_b"), F.col("score").alias("sb"))
    j = settle(a.join(b, by).filter(F.col("condition_a") < F.col("condition_b")))
    pair = [*keys, "level", "condition_a", "condition_b"]
    cases = j.filter(usable(F.col("label"), F.col("sa")) & usable(F.col("label"), F.col("sb")))
    boot = resample.bootstrap_auc_diff(cases, "sa", "sb", n_boot, seed, keys=pair).select(
        *pair, F.col("n_used").alias("boot_used"), F.col("n_skipped").alias("boot_skipped"), F.col("ci_lo").alias("boot_lo"), F.col("ci_hi").alias("boot_hi"), F.col("p").alias("boot_p"))
    return null_safe_join(delong(j, "sa", "sb", pair, "id"), boot, pair, "left")


def holm_adjust(df: DataFrame, p="p", keys=(), order=("id",), out="p_holm") -> DataFrame:
    """Step-down with a running maximum per family; a missing p is not in the family.

    A family is a list of comparisons between methods, so one family is small.
    """
    keys = list(keys)
    f = df.filter(F.col(p).isNotNull())
    w = Window.partitionBy(*keys).orderBy(p, *order)
    r = f.withColumn("__r", F.row_number().over(w)).withColumn("__m", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    adj = F.max((F.col("__m") - F.col("__r") + 1) * F.col(p)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    done = r.withColumn(out, F.least(F.lit(1.0), adj)).drop("__r", "__m")
    return done.unionByName(df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def paired_differences(df: DataFrame, keys=(), subject="subject", score="score", label="label"):
    """(per-subject mean(score | 1) - mean(score | 0), subjects left out for having one class)."""
    g = df.filter(usable(F.col(label), F.col(score))).groupBy(*keys, subject).agg(
        F.avg(F.when(F.col(label) == 1, F.col(score))).alias("mean_pos"), F.avg(F.when(F.col(label) == 0, F.col(score))).alias("mean_neg"))
    both = F.col("mean_pos").isNotNull() & F.col("mean_neg").isNotNull()
    return g.filter(both).withColumn("diff", F.col("mean_pos") - F.col("mean_neg")), g.filter(~both)


def wilcoxon_signed_rank(diffs: DataFrame, keys=(), value="diff", exact_max=100) -> DataFrame:
    """Zeros dropped, midranks of |d|, W+ and W-; exact p up to ``exact_max`` differences, else normal; the bound is reported.

    Ranks and sums are joins and aggregates over any size; only a group already known to hold at
    most ``exact_max`` differences sends its ranks to the exact count.
    """
    keys = list(keys)
    d = diffs.filter((F.col(value) != 0) & F.col(value).isNotNull()).withColumn("__a", F.round(F.abs(value), 12))
    d = m.midrank(d, keys, "__a", "rank")
    t = d.groupBy(*keys, "__a").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg(
        F.sum(F.col("c").cast("double") * F.col("c") * F.col("c") - F.col("c")).alias("ties"))
    g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col(value) > 0, F.col("rank")).otherwise(0.0)).alias("w_plus"),
                             F.sum(F.when(F.col(value) < 0, F.col("rank")).otherwise(0.0)).alias("w_minus"))
    g = null_safe_join(g, t, keys)
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("ties") / 48
    g = g.withColumn("z", F.when((F.col("n") > exact_max) & (var > 0), (F.col("w_plus") - n * (n + 1) / 4) / F.sqrt(var)))
    small = null_safe_join(d, g.filter(F.col("n") <= exact_max).select(*keys, F.col("n").alias("__n")), keys)
    tails = small.groupBy(*keys).agg(_exact_tail(F.col("rank"), (F.col(value) > 0)).alias("p_exact")) if keys else \
        small.agg(_exact_tail(F.col("rank"), (F.col(value) > 0)).alias("p_exact"))
    g = null_safe_join(g, tails, keys, "left") if keys else g.crossJoin(F.broadcast(tails))
    return g.withColumn("p", F.when(F.col("z").isNotNull(), normal_p(F.coalesce("z", F.lit(0.0)))).otherwise(F.col("p_exact"))).withColumn("exact_max", F.lit(exact_max)).drop("p_exact", "ties")


@F.pandas_udf(DoubleType())
def _exact_tail(rank: pd.Series, positive: pd.Series) -> float:
    """Two-sided tail of the subset sums of doubled ranks."""
    twice = [int(round(2 * x)) for x in rank]
    ways = [1]
    for x in twice:
        ways = [(ways[i] if i < len(ways) else 0) + (ways[i - x] if i >= x else 0) for i in range(len(ways) + x)]
    w = sum(x for x, up in zip(twice, positive) if up)
    return min(1.0, 2 * min(sum(ways[: w + 1]), sum(ways[w:])) / 2 ** len(twice)) if twice else None


@F.pandas_udf(DoubleType())
def _half_binomial_tail(n: pd.Series, k: pd.Series) -> pd.Series:
    """P(X <= k) of n fair coins: the regularised incomplete beta function at 1/2 by its continued fraction."""
    def tail(n, k):
        if not n > 0:
            return None
        if 2 * k >= n:  # past the middle: by symmetry
            return 1.0 - tail(n, n - k - 1) if k < n else 1.0
        a, b, x = n - k, k + 1.0, 0.5
        c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
        h, i, step = d, 0, 0.0
        while abs(step - 1.0) > 1e-14:
            i += 1
            if i > 1000 + 50 * math.sqrt(n):
                raise ArithmeticError(f"no convergence for {n} signs")
            step = 1.0
            for term in (i * (b - i) * x / ((a + 2 * i - 1) * (a + 2 * i)), -(a + i) * (a + b + i) * x / ((a + 2 * i) * (a + 2 * i + 1))):
                d, c = 1.0 / (1.0 + term * d), 1.0 + term / c
                step *= d * c
            h *= step
        log_front = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + (a + b) * math.log(0.5)
        return math.exp(log_front) * h / a
    return pd.Series([tail(float(i), float(j)) for i, j in zip(n, k)], dtype="float64")


def sign_test(diffs: DataFrame, keys=(), value="diff") -> DataFrame:
    """Exact two-sided binomial sign test, for any number of signs."""
    g = diffs.groupBy(*keys).agg(F.count_if(F.col(value) > 0).alias("n_pos"), F.count_if(F.col(value) < 0).alias("n_neg"),
                                 F.count_if(F.col(value) == 0).alias("n_zero"))
    n, k = (F.col("n_pos") + F.col("n_neg")).cast("double"), F.least("n_pos", "n_neg").cast("double")
    return g.withColumn("p", F.least(F.lit(1.0), 2 * _half_binomial_tail(n, k)))


def concordance(diffs: DataFrame, keys=(), value="diff", sign=1) -> DataFrame:
    """Share of subjects with the expected sign (ties count against), Wilson limits, p floor 2 / 2^n."""
    g = diffs.groupBy(*keys).agg(F.count_if(F.col(value) * sign > 0).alias("k"), F.count(value).alias("n"))
    lo, hi = wilson(F.col("k"), F.col("n"))
    return g.select(*keys, "k", "n", (F.col("k") / F.col("n")).alias("proportion"), lo.alias("ci_lo"), hi.alias("ci_hi"),
                    F.least(F.lit(1.0), F.pow(F.lit(2.0), 1 - F.col("n"))).alias("p_floor"))


@F.pandas_udf(DoubleType())
def _chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    """Upper tail of the chi-square distribution (incomplete gamma by series or continued fraction)."""
    def q(v, k):
        if v is None or k is None or v != v or k <= 0:
            return None
        a, z = k / 2.0, v / 2.0
        if z <= 0:
            return 1.0
        scale = math.exp(-z + a * math.log(z) - math.lgamma(a))
        if z < a + 1:
            term = total = 1.0 / a
            i = a
            while abs(term) > abs(total) * 1e-15:
                i += 1
                term *= z / i
                total += term
            return max(0.0, 1.0 - total * scale)
        b = z + 1 - a
        c, d = 1e300, 1.0 / b
        h = d
        i = 0
        while True:
            i += 1
            if i > 10_000:
                raise ArithmeticError(f"no convergence for chi-square {v} with {k} degrees of freedom")
            an = -i * (i - a)
            b += 2
            d = an * d + b
            d = 1.0 / (d if abs(d) > 1e-300 else 1e-300)
            c = b + an / (c if abs(c) > 1e-300 else 1e-300)
            h *= d * c
            if abs(d * c - 1) < 1e-15:
                break
        return scale * h
    return pd.Series([q(a, b) for a, b in zip(x, df)], dtype="float64")


def chi2_p(x: Column, df: Column) -> Column:
    return _chi2_sf(x.cast("double"), df.cast("double"))


def confound_screen(df: DataFrame, cols, label="label", few=6, unit="row", subject="subject") -> DataFrame:
    """Each column against the label, one row each: chi-square for categories, else a rank test.

    ``unit="subject"`` tests one row per subject: its largest label and the smallest value of each column. Negative or
    missing labels leave. A missing category is a level of its own; missing numbers leave the rank test, and so do
    classes with fewer than two numbers. Two-by-two tables have the continuity correction; two classes get the
    Mann-Whitney normal p with tie and continuity correction, more the Kruskal-Wallis one. One plan for all columns:
    they are unpivoted, counted per (column, value, label), and all statistics come from those counts.
    """
    types = dict(df.dtypes)
    numeric = {c for c in cols if types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[c].startswith("decimal")}
    d = df if unit == "row" else df.groupBy(subject).agg(F.max(label).alias(label), *[F.min(c).alias(c) for c in cols])
    arms = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(c in numeric).alias("num"), F.col(c).cast("string").alias("value")) for c in cols])
    c = d.filter(F.col(label) >= 0).select(F.col(label).alias("y"), F.inline(arms)).groupBy("column", "num", "value", "y").agg(F.count(F.lit(1)).alias("c"))
    known = c.groupBy("column").agg(F.countDistinct("value").alias("known"))  # missing is no value here
    c = c.join(known, "column").withColumn("ranked", F.col("num") & (F.col("known") > few)).filter(~F.col("ranked") | F.col("value").isNotNull())
    big = c.groupBy("column", "y").agg(F.sum("c").alias("k"))
    c = c.join(big, ["column", "y"]).filter(~F.col("ranked") | (F.col("k") >= 2)).drop("k").withColumn("value", F.coalesce("value", F.lit("NA")))
    lv = c.groupBy("column").agg(F.countDistinct("value").alias("levels"), F.countDistinct("y").alias("classes"), F.sum("c").alias("total"),
                                 F.first("ranked").alias("ranked")).filter("levels >= 2 AND classes >= 2")
    kind = lv.withColumn("test", F.when(~F.col("ranked"), "chi-square").when(F.col("classes") == 2, "mann-whitney").otherwise("kruskal-wallis"))
    # chi-square = N (sum O^2 / (R C) - 1), absent cells add nothing; all |O - E| of a two-by-two table are equal
    rows, cls = c.groupBy("column", "value").agg(F.sum("c").alias("r")), c.groupBy("column", "y").agg(F.sum("c").alias("k"))
    x = c.join(rows, ["column", "value"]).join(cls, ["column", "y"]).groupBy("column").agg(
        F.sum(F.col("c") * F.col("c") / (F.col("r").cast("double") * F.col("k"))).alias("q"))
    inv = rows.groupBy("column").agg(F.sum(1.0 / F.col("r")).alias("ir")).join(cls.groupBy("column").agg(F.sum(1.0 / F.col("k")).alias("ik")), "column")
    # rank sums of the numeric columns from counts, with tie correction
    num = c.filter("ranked").withColumn("v", F.col("value").cast("double"))
    v = num.groupBy("column", "v").agg(F.sum("c").alias("t"))
    r = running(v, ["column"], ["v"], spread(F.col("v")), u="t").withColumn("rank", F.col("u") - (F.col("t") - 1) / 2.0)
    ties = v.groupBy("column").agg(F.sum(F.col("t").cast("double") * F.col("t") * F.col("t") - F.col("t")).alias("ties"))
    rs = num.join(r.select("column", "v", "rank"), ["column", "v"]).groupBy("column", "y").agg(
        F.sum(F.col("rank") * F.col("c")).alias("R"), F.sum("c").cast("double").alias("k"))
    kw = rs.groupBy("column").agg(F.sum(F.col("R") * F.col("R") / F.col("k")).alias("h"), F.max(F.struct("y", "R", "k")).alias("top"))
    d = kind.join(x, "column", "left").join(inv, "column", "left").join(kw, "column", "left").join(ties, "column", "left")
    n, k1 = F.col("total").cast("double"), F.col("top.k")
    k0 = n - k1
    plain, off = n * (F.col("q") - 1), n * F.col("ir") * F.col("ik")
    corrected = off * F.pow(F.greatest(F.lit(0.0), F.sqrt(F.greatest(F.lit(0.0), plain) / off) - 0.5), F.lit(2.0))
    chi = F.when((F.col("levels") == 2) & (F.col("classes") == 2), corrected).otherwise(plain)
    u = F.col("top.R") - k1 * (k1 + 1) / 2
    spread_u = F.sqrt(k1 * k0 / 12 * ((n + 1) - F.col("ties") / (n * (n - 1))))
    kruskal = (12.0 / (n * (n + 1)) * F.col("h") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    test = F.col("test")
    d = d.withColumn("statistic", F.when(test == "chi-square", chi).when(test == "mann-whitney", u).otherwise(kruskal))
    d = d.withColumn("dof", F.when(test == "chi-square", (F.col("levels") - 1) * (F.col("classes") - 1)).when(test == "kruskal-wallis", F.col("classes") - 1))
    z = F.greatest(F.lit(0.0), F.abs(u - k1 * k0 / 2) - 0.5) / spread_u
    p = F.when(test == "mann-whitney", normal_p(F.coalesce(z, F.lit(0.0)))).otherwise(chi2_p(F.coalesce("statistic", F.lit(0.0)), F.coalesce("dof", F.lit(1))))
    return d.withColumn("p", p).select("column", "test", "levels", "classes", "statistic", "dof", "p")


def alias_filter(cols, target: str, aliases=()) -> list[str]:
    """Plan-time: columns that are the target under another name leave the screen."""
    drop = {target, *aliases}
    return [c for c in cols if c not in drop and not c.startswith(f"{target}_") and c != f"{target}_code"]
