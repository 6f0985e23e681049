"""Queries: clustered bootstrap intervals and permutation nulls."""

from pyspark.sql import functions as F

from ..functions.draws import unit_draw
from ..operators import baselines as b
from ..operators import metrics as m
from ..operators import resample as r
from ..session import settle
from .registry import query
from .sqlkit import auc_sql, counts_sql, subj_sql
from .views import H, U, sql_view

B = 2000
sql_view("unit_idx", f"""
SELECT subject, row_number() OVER (ORDER BY {U("'idx|' || subject")}, subject) - 1 AS idx, count(*) OVER () AS k FROM (SELECT DISTINCT subject FROM ev_deep) q
""")
sql_view("boot", f"""
SELECT rep, u.subject, mult FROM (SELECT rep, {H("'1|' || rep || '|' || idx")} % k AS d, count(*) AS mult FROM unit_idx, range({B}) x(rep) GROUP BY 1, 2) q
JOIN unit_idx u ON u.idx = q.d
""")


def rep_auc(cells, keys=""):
    """cells: (subject, keys, s, p, n) -> AUC per rep and keys, from the pairs each two subjects win against each other."""
    names = [k.strip() for k in keys.split(",") if k.strip()]
    k = "".join(f", {x}" for x in names)
    of = lambda t: "".join(f", {t}.{x}" for x in names)
    same = lambda t, u: "".join(f" AND {t}.{x} = {u}.{x}" for x in names)
    return f"""
WITH cell AS ({cells}),
pr AS (SELECT a.subject AS i, b.subject AS j{of('a')}, sum(CAST(a.p * b.n AS DOUBLE) * CASE WHEN b.s < a.s THEN 1.0::DOUBLE WHEN b.s = a.s THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END) AS won
 FROM cell a JOIN cell b ON a.p > 0 AND b.n > 0{same('a', 'b')} GROUP BY ALL),
half AS (SELECT rep, i{k}, sum(won * mult) AS won FROM pr JOIN boot ON boot.subject = pr.j GROUP BY ALL),
full_ AS (SELECT half.rep{of('half')}, sum(won * mult) AS won FROM half JOIN boot ON boot.subject = half.i AND boot.rep = half.rep GROUP BY ALL),
tot AS (SELECT rep{k}, sum(p * mult) AS p, sum(n * mult) AS n FROM (SELECT subject{k}, sum(p) AS p, sum(n) AS n FROM cell GROUP BY ALL) q JOIN boot ON boot.subject = q.subject GROUP BY ALL)
SELECT tot.rep{of('tot')}, CASE WHEN p > 0 AND n > 0 THEN coalesce(won, 0) / (CAST(p AS DOUBLE) * n) END AS auc FROM tot LEFT JOIN full_ ON full_.rep = tot.rep{same('full_', 'tot')}"""


def rep_auc_few(cells, keys):
    """The same from running counts, where a subject has one cell."""
    return auc_sql(f"SELECT rep, {keys}, s, sum(p * mult) AS p, sum(n * mult) AS n FROM ({cells}) c JOIN boot ON boot.subject = c.subject GROUP BY ALL", f"rep, {keys}")


def ci(reps, keys="", value="auc"):
    k, g = (f"{keys},", f"GROUP BY {keys}") if keys else ("", "")
    return f"""SELECT {k} count({value}) AS n_used, count(*) - count({value}) AS n_skipped, quantile_cont({value}, 0.025) AS ci_lo, quantile_cont({value}, 0.975) AS ci_hi,
 avg({value}) AS boot_mean, stddev_samp({value}) AS boot_sd FROM ({reps}) q {g}"""


CI = "n_used:i n_skipped:i ci_lo:d ci_hi:d boot_mean:d boot_sd:d"
CELLS_M = "SELECT subject, method, condition, round(CAST(score AS DOUBLE), 12) AS s, sum(label) AS p, sum(1 - label) AS n FROM runs GROUP BY ALL"


def wide_runs(t):
    """(method, row_id, subject, label, a, b): the scores of each condition. Repeated events leave before they are copied to their arms."""
    e = settle(t.events_plain.select("row_id", "subject", "label").distinct())
    return t.scored_wide(e)


def arms(t):
    """All rows of the runs; a method under a condition is a method of its own."""
    return t.runs.withColumn("method", F.concat("method", "condition"))


@query("cluster_bootstrap_auc", f"method condition {CI}", ci(rep_auc(CELLS_M, "method, condition"), "method, condition"))
def _(t):
    return r.cluster_bootstrap_auc(t.runs, B, 1, ["method", "condition"])


@query("naive_bootstrap_auc", "n_used:i ci_lo:d ci_hi:d width:d", f"""
WITH u AS (SELECT row_id, round(hour, 12) AS s, label, row_number() OVER (ORDER BY {U("'idx|' || row_id")}, CAST(row_id AS VARCHAR)) - 1 AS idx, count(*) OVER () AS k FROM ev_deep),
d AS (SELECT rep, {H("'1|' || rep || '|' || idx")} % k AS d, count(*) AS mult FROM u, range({B}) x(rep) GROUP BY 1, 2)
SELECT n_used, ci_lo, ci_hi, ci_hi - ci_lo AS width FROM ({ci(auc_sql("SELECT rep, s, sum(mult * label) AS p, sum(mult * (1 - label)) AS n FROM d JOIN u ON u.idx = d.d GROUP BY ALL", "rep"))}) q""")
def _(t):
    return r.naive_bootstrap_auc(t.events_plain.withColumn("score", F.col("hour").cast("double")), B, 1)


@query("bootstrap_auc_diff", "method n_used:i ci_lo:d ci_hi:d p:d", f"""
WITH a AS ({rep_auc(CELLS_M, "method, condition")}), d AS (SELECT rep, method, max(auc) FILTER (condition = 'a') - max(auc) FILTER (condition = 'b') AS diff FROM a GROUP BY rep, method),
tail AS (SELECT method, count(*) FILTER (diff <= 0) AS le, count(*) FILTER (diff >= 0) AS ge FROM d GROUP BY method)
SELECT q.method, n_used, ci_lo, ci_hi, least(1.0::DOUBLE, greatest(2.0::DOUBLE * least(le, ge) / n_used, 1.0::DOUBLE / n_used)) AS p FROM ({ci("SELECT * FROM d", "method", "diff")}) q JOIN tail ON tail.method = q.method""")
def _(t):
    return r.bootstrap_auc_diff(wide_runs(t), "a", "b", B, 1, keys=["method"])


CELLS_S = "SELECT subject, method, condition, scheme, score AS s, label AS p, 1 - label AS n FROM agg_matrix WHERE scheme <> 'top1_mean'"


def schemes(t):
    return m.aggregate_matrix(t.runs, ["method", "condition"], digits=13).filter("scheme <> 'top1_mean'")


@query("shared_bootstrap_envelope", f"method condition scheme {CI}", f"""
WITH a AS ({rep_auc_few(CELLS_S, "method, condition, scheme")})
{ci("SELECT * FROM a", "method, condition, scheme")} UNION ALL BY NAME
SELECT *, 'envelope' AS scheme FROM ({ci("SELECT rep, method, condition, max(auc) AS auc FROM a GROUP BY ALL", "method, condition")}) b""")
def _(t):
    per, env = r.shared_bootstrap_envelope(schemes(t), B, 1, keys=["method", "condition"])
    return per.unionByName(env.withColumn("scheme", F.lit("envelope")))


sql_view("run2", "SELECT * REPLACE (method || condition AS method) FROM runs")
sql_view("joint", f"""
SELECT * EXCLUDE (ok) FROM (SELECT *, bool_and(auc IS NOT NULL) OVER (PARTITION BY rep) AS ok FROM (
{rep_auc("SELECT subject, method, 'slice' AS unit, round(CAST(score AS DOUBLE), 12) AS s, sum(label) AS p, sum(1 - label) AS n FROM run2 GROUP BY ALL UNION ALL SELECT subject, method, 'patient', mean_score, label, 1 - label FROM (" + subj_sql('run2', 'method') + ") z", "unit, method")}) a) b WHERE ok
""")


def joint(t):
    return r.joint_bootstrap(arms(t), B, 1)


@query("joint_bootstrap", "rep:i unit method auc:d", "SELECT rep, unit, method, auc FROM joint")
def _(t):
    return joint(t)


sql_view("paired", "SELECT method, subject, avg(score) FILTER (label = 1) AS m1, avg(score) FILTER (label = 0) AS m0, avg(score) FILTER (label = 1) - avg(score) FILTER (label = 0) AS diff FROM run2 GROUP BY ALL HAVING min(label) <> max(label)")


@query("paired_mean_bootstrap", f"method {CI}", f"""
WITH u AS (SELECT subject, row_number() OVER (ORDER BY {U("'idx|' || subject")}, subject) - 1 AS idx, count(*) OVER () AS k FROM (SELECT DISTINCT subject FROM paired) q),
d AS (SELECT rep, {H("'1|' || rep || '|' || idx")} % k AS d, count(*) AS mult FROM u, range({B}) x(rep) GROUP BY 1, 2)
{ci("SELECT rep, method, sum(diff * mult) / sum(mult) AS mean FROM d JOIN u ON u.idx = d.d JOIN paired ON paired.subject = u.subject GROUP BY ALL", "method", "mean")}""")
def _(t):
    from ..operators.inference import paired_differences
    return r.paired_mean_bootstrap(paired_differences(arms(t), ["method"])[0], B, 1, keys=["method"])


@query("within_strata_bootstrap", f"method {CI}", f"""
WITH u AS (SELECT *, CAST(subject AS BIGINT) % 4 AS st FROM ({subj_sql("run2", "method")}) z),
i AS (SELECT *, row_number() OVER (PARTITION BY st ORDER BY {U("'idx|' || subject")}, subject) - 1 AS idx, count(*) OVER (PARTITION BY st) AS k FROM (SELECT DISTINCT subject, st FROM u) q),
d AS (SELECT rep, st, {H("'1|' || rep || '|' || st || '|' || idx")} % k AS d, count(*) AS mult FROM i, range({B}) x(rep) GROUP BY 1, 2, 3),
a AS ({auc_sql("SELECT rep, u.method, d.st, mean_score AS s, sum(mult * label) AS p, sum(mult * (1 - label)) AS n FROM d JOIN i ON i.idx = d.d AND i.st = d.st JOIN u ON u.subject = i.subject AND u.st = i.st GROUP BY ALL", "rep, method, st")})
{ci("SELECT rep, method, sum(auc * n_pos * n_neg) / sum(CASE WHEN n_pos > 0 AND n_neg > 0 THEN n_pos * n_neg END) AS auc FROM a GROUP BY rep, method", "method")}""")
def _(t):
    s = m.cluster_aggregate(arms(t), ["method"]).withColumn("st", F.col("subject").cast("long") % 4)
    return r.within_strata_bootstrap(s, "st", B, 1, score="mean_score", keys=["method"])


@query("cluster_bootstrap_accuracy", CI, f"""
WITH c AS (SELECT subject, sum(CAST(class % 2 = row_id % 2 AS INT)) AS c, count(*) AS t FROM emb_multi GROUP BY subject),
u AS (SELECT *, row_number() OVER (ORDER BY {U("'idx|' || subject")}, subject) - 1 AS idx, count(*) OVER () AS k FROM c),
d AS (SELECT rep, {H("'1|' || rep || '|' || idx")} % k AS d, count(*) AS mult FROM u, range({B}) x(rep) GROUP BY 1, 2)
{ci("SELECT rep, sum(c * mult) / CAST(sum(t * mult) AS DOUBLE) AS acc FROM d JOIN u ON u.idx = d.d GROUP BY rep", "", "acc")}""")
def _(t):
    return r.bootstrap_accuracy(t.emb_multi.withColumn("correct", F.expr("class % 2 = row_id % 2")), B, 1)


@query("agreement_bootstrap", f"statistic {CI}", f"""
WITH c AS (SELECT item, code, count(*) AS n FROM raters GROUP BY 1, 2), p AS (SELECT item, sum(n) AS m, sum(n * (n - 1)) AS ag FROM c GROUP BY item),
u AS (SELECT *, row_number() OVER (ORDER BY {U("'idx|' || item")}, item) - 1 AS idx, count(*) OVER () AS k FROM p),
d AS (SELECT rep, {H("'1|' || rep || '|' || idx")} % k AS d, count(*) AS mult FROM u, range({B}) x(rep) GROUP BY 1, 2),
o AS (SELECT rep, sum(mult * ag / CAST(m * (m - 1) AS DOUBLE)) / sum(mult) AS pa, sum(mult * m) AS t FROM d JOIN u ON u.idx = d.d GROUP BY rep),
s AS (SELECT d.rep, code, sum(mult * n) AS n FROM d JOIN u ON u.idx = d.d JOIN c ON c.item = u.item GROUP BY 1, 2),
e AS (SELECT o.rep, pa, sum((n / CAST(t AS DOUBLE)) * (n / CAST(t AS DOUBLE))) AS pf, sum((n / CAST(t AS DOUBLE)) * (1 - n / CAST(t AS DOUBLE))) AS w, count(*) AS q FROM s JOIN o ON o.rep = s.rep GROUP BY 1, 2),
r AS (SELECT rep, pa, CASE WHEN q > 1 THEN (pa - pf) / (1 - pf) END AS fleiss_kappa, CASE WHEN q > 1 THEN (pa - w / (q - 1)) / (1 - w / (q - 1)) ELSE 1.0 END AS gwet_ac1 FROM e)
{ci("SELECT unnest(['pa', 'fleiss_kappa', 'gwet_ac1']) AS statistic, unnest([pa, fleiss_kappa, gwet_ac1]) AS value FROM r", "statistic", "value")}""")
def _(t):
    from ..operators.association import agreement_bootstrap
    return agreement_bootstrap(t.raters, B, 1)


# ---------------------------------------------------------------- permutations
P = 20
sql_view("perm_vol", f"""
WITH b AS (SELECT volume, row_id, label, row_number() OVER (PARTITION BY volume ORDER BY {U("'3|base|' || row_id")}, row_id) AS i FROM ev_slices),
p AS (SELECT perm, volume, label, row_number() OVER (PARTITION BY perm, volume ORDER BY {U("'3|' || perm || '|' || row_id")}, row_id) AS i FROM ev_slices, range({P}) x(perm))
SELECT p.perm, b.row_id, p.label FROM b JOIN p ON p.volume = b.volume AND p.i = b.i
""")


@query("permute_within_volume", "perm:i row_id:i label:i", "SELECT * FROM perm_vol")
def _(t):
    return r.permute_within(t.ev_slices, P, seed=3)


def donors(split="1", salt="donor", seed=0, src="ev_deep"):
    return f"""
SELECT p.perm, b.g, b.subject, p.subject AS donor FROM
(SELECT *, row_number() OVER (PARTITION BY g ORDER BY {U(f"'{seed}|{salt}|' || subject")}, subject) AS i FROM (SELECT DISTINCT {split} AS g, subject FROM {src}) a) b JOIN
(SELECT *, row_number() OVER (PARTITION BY perm, g ORDER BY {U(f"'{seed}|{salt}|' || perm || '|' || subject")}, subject) AS i FROM (SELECT DISTINCT {split} AS g, subject FROM {src}) a, range({P}) x(perm)) p
ON p.g = b.g AND p.i = b.i"""


@query("permute_metadata_blocks", "perm:i row_id:i hour:i k:i", f"""
WITH d AS ({donors()}), n AS (SELECT subject, count(*) AS n FROM ev_deep GROUP BY subject)
SELECT d.perm, e.row_id, g.hour, g.k FROM ev_deep e JOIN d ON d.subject = e.subject JOIN n ON n.subject = d.donor JOIN ev_deep g ON g.subject = d.donor AND g.slice = least(e.slice, n.n)""")
def _(t):
    return r.permute_metadata(t.ev_deep, ["hour", "k"], P)


@query("permute_subject_labels", "perm:i split n_subjects:i n_class_changed:i pos_before:i pos_after:i row_pos_before:d row_pos_after:d changed_fraction:d usable:b", f"""
WITH d AS ({donors('split', src='two_arm')}), n AS (SELECT subject, count(*) AS n, max(label) AS y FROM two_arm GROUP BY subject),
w AS (SELECT d.perm, d.g AS split, e.label AS old, gv.label AS new FROM two_arm e JOIN d ON d.subject = e.subject JOIN n a ON a.subject = e.subject JOIN n b ON b.subject = d.donor
      JOIN two_arm gv ON gv.subject = d.donor AND gv.slice - 1 = least(((e.slice - 1) * b.n) // a.n, b.n - 1)),
s AS (SELECT perm, g AS split, count(*) AS n_subjects, count(*) FILTER (a.y <> b.y) AS n_class_changed, sum(a.y) AS pos_before, sum(b.y) AS pos_after FROM d JOIN n a ON a.subject = d.subject JOIN n b ON b.subject = d.donor GROUP BY 1, 2)
SELECT s.*, avg_old AS row_pos_before, avg_new AS row_pos_after, ch AS changed_fraction, n_class_changed > 0 AS usable FROM s JOIN (
 SELECT perm, split, avg(old) AS avg_old, avg(new) AS avg_new, avg(CAST(old <> new AS DOUBLE)) AS ch FROM w GROUP BY 1, 2) x ON x.perm = s.perm AND x.split = s.split""")
def _(t):
    from .splits import two_arm
    return r.permute_subject_labels(two_arm(t), P)[1]


def null_positional(t, n_perm=P):
    """Out-of-fold positional AUC under within-volume label permutation, one row per permutation."""
    from .baselines import K, ev_cv
    d = settle(ev_cv(t).select("volume", "row_id", "label", "subject", "fold", "relpos"))
    d = r.permuted(d, n_perm, seed=3)
    c = b.encode(b.cells(d, b.position_features((20,)), ["perm"]), K, 0.0, ["perm"])
    c = settle(c)
    sl = m.auc_from_counts(c.groupBy("perm", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["perm"], few=True)
    pa = m.auc(m.subjects_from_cells(c, ["perm"]), ["perm"], "mean_score", out="patient")
    return sl.select("perm", "auc").join(pa.select("perm", "patient"), "perm")


sql_view("perm_deep", f"""
WITH b AS (SELECT volume, row_id, label, row_number() OVER (PARTITION BY volume ORDER BY {U("'3|base|' || row_id")}, row_id) AS i FROM ev_deep),
p AS (SELECT perm, volume, label, row_number() OVER (PARTITION BY perm, volume ORDER BY {U("'3|' || perm || '|' || row_id")}, row_id) AS i FROM ev_deep, range({P}) x(perm))
SELECT p.perm, b.row_id, p.label FROM b JOIN p ON p.volume = b.volume AND p.i = b.i
""")
sql_view("perm_scored", """
WITH d AS (SELECT c.* EXCLUDE (label), p.perm, p.label FROM ev_cv c JOIN perm_deep p ON p.row_id = c.row_id),
r AS (SELECT perm, x AS part, bin20, sum(label) AS sp, count(*) AS c FROM d, range(5) q(x) WHERE fold <> x GROUP BY 1, 2, 3),
pr AS (SELECT perm, part, sum(sp) / CAST(sum(c) AS DOUBLE) AS prior FROM r GROUP BY 1, 2)
SELECT d.perm, d.row_id, d.subject, d.label, round(coalesce(CAST(r.sp AS DOUBLE) / r.c, prior), 12) AS score
FROM d JOIN pr ON pr.perm = d.perm AND pr.part = d.fold LEFT JOIN r ON r.perm = d.perm AND r.part = d.fold AND r.bin20 = d.bin20
""")
sql_view("null_runs", f"""
SELECT a.perm, a.auc, b.auc AS patient FROM ({auc_sql(counts_sql('perm_scored', 'perm'), 'perm')}) a
JOIN ({auc_sql(counts_sql('(' + subj_sql('perm_scored', 'perm') + ')', 'perm', 'mean_score'), 'perm')}) b ON a.perm = b.perm
""")


@query("null_calibration", "n_perm:i slice_mean:d slice_lo:d slice_hi:d patient_mean:d n_mixed_volumes:i", """
SELECT count(*) AS n_perm, avg(auc) AS slice_mean, quantile_cont(auc, 0.025) AS slice_lo, quantile_cont(auc, 0.975) AS slice_hi, avg(patient) AS patient_mean,
 (SELECT count(*) FROM (SELECT volume FROM ev_deep GROUP BY volume HAVING min(label) <> max(label)) q) AS n_mixed_volumes FROM null_runs""")
def _(t):
    n = null_positional(t)
    q = F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975)))
    mixed = t.ev_deep.groupBy("volume").agg((F.min("label") != F.max("label")).alias("x")).agg(F.count_if("x").alias("n_mixed_volumes"))
    return n.agg(F.count(F.lit(1)).alias("n_perm"), F.avg("auc").alias("slice_mean"), q[0].alias("slice_lo"), q[1].alias("slice_hi"),
                 F.avg("patient").alias("patient_mean")).crossJoin(F.broadcast(mixed))


NULLS = f"""
SELECT CASE WHEN row_id % 3 = 0 THEN 'positional' WHEN row_id % 3 = 1 THEN 'combined' ELSE 'tree' END AS baseline, CASE WHEN row_id % 2 = 0 THEN 'within' ELSE 'block' END AS kind, value / 200 + 0.3 AS auc FROM ev_deep WHERE event_type = 'purchase'"""
sql_view("null_draws", NULLS)
HEAD = "(VALUES ('positional', 0.55::DOUBLE), ('combined', 0.95), ('tree', 0.2), ('size', 0.5), ('prevalence', 0.5)) h(baseline, auc)"


def null_draws(t):
    return t.ev_deep.filter("event_type = 'purchase'").select(
        F.when(F.col("row_id") % 3 == 0, "positional").when(F.col("row_id") % 3 == 1, "combined").otherwise("tree").alias("baseline"),
        F.when(F.col("row_id") % 2 == 0, "within").otherwise("block").alias("kind"), (F.col("value") / 200 + 0.3).alias("auc"))


def heads(t):
    return t.spark.createDataFrame([("positional", 0.55), ("combined", 0.95), ("tree", 0.2), ("size", 0.5), ("prevalence", 0.5)], "baseline string, auc double")


@query("null_attach", "baseline auc:d kind n_perm:i null_mean:d null_lo:d null_hi:d excess:d p:d exceeds:b", f"""
WITH g AS (SELECT d.baseline, kind, count(*) AS n_perm, avg(d.auc) AS null_mean, quantile_cont(d.auc, 0.025) AS lo, quantile_cont(d.auc, 0.975) AS hi, count(*) FILTER (d.auc >= h.auc) AS ge
 FROM null_draws d JOIN {HEAD} ON h.baseline = d.baseline GROUP BY 1, 2),
b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY baseline ORDER BY null_mean DESC) AS r FROM g) q WHERE r = 1)
SELECT h.baseline, h.auc, CASE WHEN h.baseline = 'prevalence' THEN 'not_applicable' WHEN b.kind IS NULL THEN 'unavailable' ELSE b.kind END AS kind, n_perm, null_mean, lo AS null_lo, hi AS null_hi,
 h.auc - null_mean AS excess, (ge + 1) / CAST(n_perm + 1 AS DOUBLE) AS p, h.auc > hi AS exceeds FROM {HEAD} LEFT JOIN b ON b.baseline = h.baseline""")
def _(t):
    return r.null_attach(heads(t), null_draws(t))


@query("permutation_p", "baseline observed:d null_mean:d n_perm:i p:d state", f"""
SELECT *, CASE WHEN observed <= null_mean THEN 'fails' WHEN n_perm < 20 THEN 'inconclusive' WHEN p <= 0.05 THEN 'survives' ELSE 'fails' END AS state FROM (
SELECT h.baseline, max(h.auc) AS observed, avg(d.auc) AS null_mean, count(*) AS n_perm, (1 + count(*) FILTER (d.auc >= h.auc)) / CAST(1 + count(*) AS DOUBLE) AS p FROM null_draws d JOIN {HEAD} ON h.baseline = d.baseline GROUP BY 1) q""")
def _(t):
    return r.permutation_p(heads(t), null_draws(t), ["baseline"])
