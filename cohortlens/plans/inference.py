"""Queries: tests and corrections."""

from pyspark.sql import functions as F

from ..operators import inference as i
from ..operators import metrics as m
from .registry import query
from .resampling import B, arms, ci, rep_auc
from .sqlkit import wilson_sql
from .views import sql_view


@query("wilson_interval", "event_type k:i n:i ci_lo:d ci_hi:d", "SELECT *, {} AS ci_lo, {} AS ci_hi FROM (SELECT event_type, count(*) FILTER (value > 100) AS k, count(*) AS n FROM events GROUP BY 1) q".format(*wilson_sql("k", "n")))
def _(t):
    g = t.table("events").groupBy("event_type").agg(F.count_if(F.col("value") > 100).alias("k"), F.count(F.lit(1)).alias("n"))
    lo, hi = m.wilson(F.col("k"), F.col("n"))
    return g.withColumn("ci_lo", lo).withColumn("ci_hi", hi)


@query("normal_p", "event_type z:d p_exact:d p_column:d")
def _(t):
    g = t.table("events").groupBy("event_type").agg((F.avg("value") - 15).alias("z"))
    return g.select("event_type", "z", i.normal_p(F.col("z")).alias("p_exact"), (2 * i.normal_cdf(-F.abs("z"))).alias("p_column"))


DELONG = """
WITH j AS ({pairs}), v AS (
 SELECT {k} label, sa, sb,
  CASE WHEN label = 1 THEN (nba - na / 2.0::DOUBLE) / tn ELSE 1 - (pba - pa / 2.0::DOUBLE) / tp END AS va,
  CASE WHEN label = 1 THEN (nbb - nb / 2.0::DOUBLE) / tn ELSE 1 - (pbb - pb / 2.0::DOUBLE) / tp END AS vb FROM (
  SELECT *, sum(1 - label) OVER (PARTITION BY {p} ORDER BY sa) AS nba, sum(label) OVER (PARTITION BY {p} ORDER BY sa) AS pba, sum(1 - label) OVER (PARTITION BY {p}, sa) AS na, sum(label) OVER (PARTITION BY {p}, sa) AS pa,
   sum(1 - label) OVER (PARTITION BY {p} ORDER BY sb) AS nbb, sum(label) OVER (PARTITION BY {p} ORDER BY sb) AS pbb, sum(1 - label) OVER (PARTITION BY {p}, sb) AS nb, sum(label) OVER (PARTITION BY {p}, sb) AS pb,
   sum(1 - label) OVER (PARTITION BY {p}) AS tn, sum(label) OVER (PARTITION BY {p}) AS tp FROM j) w),
g AS (SELECT {k} avg(va) FILTER (label = 1) AS auc_a, avg(vb) FILTER (label = 1) AS auc_b, count(*) FILTER (label = 1) AS m, count(*) FILTER (label = 0) AS n,
 var_samp(va) FILTER (label = 1) AS a1, var_samp(va) FILTER (label = 0) AS a0, var_samp(vb) FILTER (label = 1) AS b1, var_samp(vb) FILTER (label = 0) AS b0,
 covar_samp(va, vb) FILTER (label = 1) AS c1, covar_samp(va, vb) FILTER (label = 0) AS c0 FROM v GROUP BY ALL)
SELECT *, auc_a - auc_b AS diff, (auc_a - auc_b) / sqrt(var_a + var_b - 2 * cov_ab) AS z FROM (
 SELECT {k} auc_a, auc_b, a1 / m + a0 / n AS var_a, b1 / m + b0 / n AS var_b, c1 / m + c0 / n AS cov_ab FROM g) h"""
COLS = "auc_a:d auc_b:d diff:d var_a:d var_b:d cov_ab:d z:d"
WIDE = "SELECT method, row_id, label, max(score) FILTER (condition = 'a') AS sa, max(score) FILTER (condition = 'b') AS sb FROM runs GROUP BY 1, 2, 3"


@query("delong_test", f"method {COLS}", DELONG.format(pairs=WIDE, k="method,", p="method"))
def _(t):
    w = t.runs.groupBy("method", "row_id", "label").pivot("condition", ["a", "b"]).agg(F.first("score"))
    return i.delong(w, "a", "b", ["method"])


LEVELS = """
WITH s AS (SELECT * FROM run_subj), l AS (
 SELECT method, condition, 'slice' AS level, CAST(row_id AS VARCHAR) AS id, label, score FROM runs
 UNION ALL SELECT method, condition, 'patient_mean', subject, label, mean_score FROM s UNION ALL SELECT method, condition, 'patient_max', subject, label, max_score FROM s)
SELECT a.method, a.level, a.id, a.label, a.score AS sa, b.score AS sb FROM l a JOIN l b ON a.method = b.method AND a.level = b.level AND a.id = b.id WHERE a.condition = 'a' AND b.condition = 'b'"""


LONG = """
SELECT subject, method, condition, 'slice' AS level, round(CAST(score AS DOUBLE), 12) AS s, sum(label) AS p, sum(1 - label) AS n FROM runs GROUP BY ALL
UNION ALL SELECT subject, method, condition, 'patient_mean', mean_score, label, 1 - label FROM run_subj UNION ALL SELECT subject, method, condition, 'patient_max', max_score, label, 1 - label FROM run_subj"""
DIFF = f"""
WITH a AS ({rep_auc(LONG, "method, level, condition")}), d AS (SELECT rep, method, level, max(auc) FILTER (condition = 'a') - max(auc) FILTER (condition = 'b') AS diff FROM a GROUP BY ALL),
tail AS (SELECT method, level, count(*) FILTER (diff <= 0) AS le, count(*) FILTER (diff >= 0) AS ge FROM d GROUP BY ALL)
SELECT q.method, q.level, n_used AS boot_used, n_skipped AS boot_skipped, ci_lo AS boot_lo, ci_hi AS boot_hi, least(1.0::DOUBLE, greatest(2.0::DOUBLE * least(le, ge) / n_used, 1.0::DOUBLE / n_used)) AS boot_p
FROM ({ci("SELECT * FROM d", "method, level", "diff")}) q JOIN tail ON tail.method = q.method AND tail.level = q.level"""
# the series of the error function has positive terms only; beyond 6 its complement is below 1e-16
NORMAL_P = """CASE WHEN z IS NOT NULL THEN least(1.0::DOUBLE, greatest(0.0::DOUBLE, 1 - (SELECT sum(exp((2 * j + 1) * ln(x) - x * x - lgamma(j + 1.5::DOUBLE))) FROM range(0, 200) r(j)))) END"""


@query("compare_conditions", f"method level {COLS} se_diff:d p:d ci_lo:d ci_hi:d boot_used:i boot_skipped:i boot_lo:d boot_hi:d boot_p:d", f"""
SELECT t.*, {NORMAL_P} AS p, diff - 1.959963984540054::DOUBLE * se_diff AS ci_lo, diff + 1.959963984540054::DOUBLE * se_diff AS ci_hi, boot_used, boot_skipped, boot_lo, boot_hi, boot_p
FROM (SELECT *, sqrt(var_a + var_b - 2 * cov_ab) AS se_diff, least(6.0::DOUBLE, greatest(1e-300::DOUBLE, abs(z) / sqrt(2.0::DOUBLE))) AS x FROM ({DELONG.format(pairs=LEVELS, k="method, level,", p="method, level")}) y) t
JOIN ({DIFF}) v ON v.method = t.method AND v.level = t.level""")
def _(t):
    return i.compare_conditions(t.runs, n_boot=B, seed=1)


sql_view("pvals", """
SELECT n_name AS id, CAST(n_regionkey AS VARCHAR) AS family, CASE WHEN n_nationkey % 7 = 3 THEN NULL ELSE p END AS p FROM nation JOIN (
 SELECT c_nationkey, avg(CAST(c_acctbal > 8500 AS DOUBLE)) / 5 AS p FROM customer GROUP BY 1) q ON c_nationkey = n_nationkey
""")


@query("holm_adjust", "id p:d p_family:d p_global:d", """
SELECT id, p, CASE WHEN p IS NOT NULL THEN least(1, max((mf - rf + 1) * p) OVER (PARTITION BY family, p IS NULL ORDER BY rf)) END AS p_family,
 CASE WHEN p IS NOT NULL THEN least(1, max((mg - rg + 1) * p) OVER (PARTITION BY p IS NULL ORDER BY rg)) END AS p_global
FROM (SELECT *, row_number() OVER (PARTITION BY family, p IS NULL ORDER BY p, id) AS rf, count(p) OVER (PARTITION BY family) AS mf,
 row_number() OVER (PARTITION BY p IS NULL ORDER BY p, id) AS rg, count(p) OVER () AS mg FROM pvals) q""")
def _(t):
    c = t.table("customer").groupBy("c_nationkey").agg((F.avg((F.col("c_acctbal") > 8500).cast("double")) / 5).alias("p"))
    d = t.table("nation").join(c, F.expr("c_nationkey = n_nationkey")).select(
        F.col("n_name").alias("id"), F.col("n_regionkey").cast("string").alias("family"), F.when(F.expr("n_nationkey % 7 <> 3"), F.col("p")).alias("p"))
    return i.holm_adjust(i.holm_adjust(d, keys=["family"], out="p_family"), out="p_global")


@query("paired_differences", "method subject mean_pos:d mean_neg:d diff:d n_excluded:i", """
SELECT paired.method, subject, m1 + 3e-11 AS mean_pos, m0 + 3e-11 AS mean_neg, diff + 3e-11 AS diff, coalesce(n, 0) AS n_excluded FROM paired LEFT JOIN (
 SELECT method, count(*) AS n FROM (SELECT method, subject FROM run2 GROUP BY ALL HAVING min(label) = max(label)) q GROUP BY method) x ON x.method = paired.method""")
def _(t):
    both, left = i.paired_differences(arms(t), ["method"])
    n = left.groupBy("method").agg(F.count(F.lit(1)).alias("n_excluded"))
    # a mean can fall just between two nine-digit numbers, where two engines round apart: both sides lift it a little
    both = both.withColumns({c: F.col(c) + F.lit(3e-11) for c in ("mean_pos", "mean_neg", "diff")})
    return both.join(n, "method", "left").withColumn("n_excluded", F.coalesce("n_excluded", F.lit(0)))


def diffs(t):
    return i.paired_differences(arms(t), ["method"])[0]


@query("wilcoxon_signed_rank", "method n:i w_plus:d w_minus:d z:d p:d")
def _(t):
    return i.wilcoxon_signed_rank(diffs(t), ["method"])


sql_view("pair_m", "SELECT method, subject, avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0) AS diff FROM run2 GROUP BY ALL HAVING min(label) <> max(label)")


@query("sign_test", "method n_pos:i n_neg:i n_zero:i p:d", """
SELECT g.*, least(1.0::DOUBLE, 2 * (SELECT sum(exp(lgamma(n_pos + n_neg + 1.0::DOUBLE) - lgamma(j + 1.0::DOUBLE) - lgamma(n_pos + n_neg - j + 1.0::DOUBLE) - (n_pos + n_neg) * ln(2.0::DOUBLE)))
  FROM range(0, 10000) r(j) WHERE j <= least(n_pos, n_neg))) AS p
FROM (SELECT method, count(*) FILTER (diff > 0) AS n_pos, count(*) FILTER (diff < 0) AS n_neg, count(*) FILTER (diff = 0) AS n_zero FROM pair_m GROUP BY 1) g""")
def _(t):
    return i.sign_test(diffs(t), ["method"])


@query("concordance", "method k:i n:i proportion:d ci_lo:d ci_hi:d p_floor:d", "SELECT *, k / CAST(n AS DOUBLE) AS proportion, {} AS ci_lo, {} AS ci_hi, least(1.0::DOUBLE, pow(2.0::DOUBLE, 1 - n)) AS p_floor FROM (SELECT method, count(*) FILTER (diff > 0) AS k, count(*) AS n FROM pair_m GROUP BY 1) q".format(*wilson_sql("k", "n")))
def _(t):
    return i.concordance(diffs(t), ["method"])


@query("confound_screen", "column_name test levels:i classes:i statistic:d dof:i p:d")
def _(t):
    cols = i.alias_filter(["linestatus", "priority", "quantity", "discount"], "label")
    return i.confound_screen(t.li_slices, cols).withColumnRenamed("column", "column_name")


@query("confound_alias_filter", "column_name n_levels:i")
def _(t):
    d = t.sites.withColumn("label_code", F.col("label")).withColumn("label_rank", F.col("label"))
    kept = i.alias_filter(["segment", "region", "label", "label_code", "label_rank", "balance_band"], "label", ["balance_band"])
    arms = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in kept])
    return d.select(F.inline(arms)).groupBy("column_name").agg(F.countDistinct("v").alias("n_levels"))
