"""Queries: rankings of methods at two units."""

from pyspark.sql import functions as F

from ..functions.draws import draw
from ..operators import metrics as m
from ..operators import ranking as k
from ..operators import resample as r
from .registry import query
from .resampling import B, arms
from .sqlkit import auc_sql, counts_sql, subj_sql
from .views import H, U, sql_view

# one table of values per part brand: five types ranked by two measures
sql_view("brands", "SELECT p_brand AS grp, p_type AS method, round(avg(p_retailprice), 0) AS a, CAST(max(p_size) AS DOUBLE) AS b FROM part GROUP BY 1, 2")


def brands(t):
    return t.table("part").groupBy(F.col("p_brand").alias("grp"), F.col("p_type").alias("method")).agg(
        F.round(F.avg("p_retailprice"), 0).alias("a"), F.max("p_size").cast("double").alias("b"))


RANK = "rank() OVER (PARTITION BY {k} ORDER BY {v} DESC) + (count(*) OVER (PARTITION BY {k}, {v}) - 1) / 2.0::DOUBLE"


@query("ranks_desc", "grp method rank:d", f"SELECT grp, method, {RANK.format(k='grp', v='b')} AS rank FROM brands")
def _(t):
    return k.ranks_desc(brands(t), ["grp"], "b")


def spear(src, key, a, b):
    return f"""SELECT {key}, CASE WHEN min(ra) < max(ra) AND min(rb) < max(rb) THEN corr(ra, rb) END AS rho, count(*) AS n_methods FROM (
 SELECT *, {RANK.format(k=key, v=a)} AS ra, {RANK.format(k=key, v=b)} AS rb FROM {src}) q GROUP BY {key}"""


def tau(src, key, a, b, item="method", out="tau"):
    on = " AND ".join(f"x.{c.strip()} = y.{c.strip()}" for c in key.split(","))
    ks = ", ".join(f"x.{c.strip()}" for c in key.split(","))
    return f"""SELECT {ks}, CASE WHEN sum(abs(sign(x.{a} - y.{a}))) > 0 AND sum(abs(sign(x.{b} - y.{b}))) > 0 THEN sum(sign(x.{a} - y.{a}) * sign(x.{b} - y.{b}))
 / sqrt(CAST(sum(abs(sign(x.{a} - y.{a}))) * sum(abs(sign(x.{b} - y.{b}))) AS DOUBLE)) END AS {out} FROM {src} x JOIN {src} y ON {on} AND x.{item} < y.{item} GROUP BY ALL"""


@query("spearman", "grp rho:d n_methods:i", spear("brands", "grp", "a", "b"))
def _(t):
    return k.spearman(brands(t), "a", "b", ["grp"])


@query("kendall_tau_b", "grp tau:d", tau("brands", "grp", "a", "b"))
def _(t):
    return k.kendall_tau_b(brands(t), "a", "b", ["grp"])


@query("top_k_with_ties", "grp method place:i", "SELECT grp, method, place FROM (SELECT *, rank() OVER (PARTITION BY grp ORDER BY b DESC) AS place FROM brands) q WHERE place <= 3")
def _(t):
    return k.top_k(brands(t), 3, ["grp"], "b")


sql_view("point_auc", f"""
SELECT 'slice' AS unit, method, auc FROM ({auc_sql(counts_sql('run2', 'method'), 'method')}) a
UNION ALL SELECT 'patient', method, auc FROM ({auc_sql(counts_sql('(' + subj_sql('run2', 'method') + ')', 'method', 'mean_score'), 'method')}) b
""")
sql_view("wide_rep", """
SELECT rep, method, max(auc) FILTER (unit = 'slice') AS s, max(auc) FILTER (unit = 'patient') AS p FROM joint GROUP BY 1, 2
UNION ALL SELECT -1, method, max(auc) FILTER (unit = 'slice'), max(auc) FILTER (unit = 'patient') FROM point_auc GROUP BY 2
""")
sql_view("agree_rep", f"""
SELECT r.*, tau, top1_same, top3_overlap FROM ({spear('wide_rep', 'rep', 's', 'p')}) r JOIN ({tau('wide_rep', 'rep', 's', 'p')}) t ON r.rep = t.rep JOIN (
 SELECT rep, max(CAST(rs = 1 AND rp = 1 AS INT)) AS top1_same, count(*) FILTER (rs <= 3 AND rp <= 3) AS top3_overlap FROM (
  SELECT rep, rank() OVER (PARTITION BY rep ORDER BY s DESC) AS rs, rank() OVER (PARTITION BY rep ORDER BY p DESC) AS rp FROM wide_rep) q GROUP BY rep) x ON x.rep = r.rep
""")


def pt_reps(t):
    from ..session import settle
    cells = r.joint_cells(arms(t))  # the events are scored once
    return settle(k.point_from_cells(cells)), settle(r.joint_replicates(cells, B, 1))


@query("rank_agreement", "rho_obs:d tau_obs:d top1_same:i top3_overlap_obs:i rho_lo:d rho_hi:d tau_median:d tau_lo:d tau_hi:d top1_same_rate:d top3_overlap_mean:d n_used:i", """
SELECT o.rho AS rho_obs, o.tau AS tau_obs, o.top1_same, o.top3_overlap AS top3_overlap_obs, s.* FROM (SELECT * FROM agree_rep WHERE rep = -1) o, (
 SELECT quantile_cont(rho, 0.025) AS rho_lo, quantile_cont(rho, 0.975) AS rho_hi, quantile_cont(tau, 0.5) AS tau_median, quantile_cont(tau, 0.025) AS tau_lo, quantile_cont(tau, 0.975) AS tau_hi,
  avg(top1_same) AS top1_same_rate, avg(top3_overlap) AS top3_overlap_mean, count(*) AS n_used FROM agree_rep WHERE rep >= 0) s""")
def _(t):
    return k.rank_agreement(*pt_reps(t))


BP = "least(1.0::DOUBLE, greatest(2.0::DOUBLE * least(count(*) FILTER ({d} <= 0), count(*) FILTER ({d} >= 0)) / count({d}), 1.0::DOUBLE / count({d})))"
sql_view("with_point", "SELECT w.*, o.s AS s0, o.p AS p0 FROM wide_rep w JOIN wide_rep o ON o.rep = -1 AND o.method = w.method WHERE w.rep >= 0")


@query("rank_stability", "d_between_obs:d n_used:i delta_slice:d p_slice:d delta_patient:d p_patient:d tau_within_slice:d tau_within_patient:d top1_slice:d top1_patient:d p_exceed:d verdict", f"""
WITH t AS (SELECT a.rep, a.tau AS bt, b.tau AS ws, c.tau AS wp, ts, tp, (SELECT tau FROM agree_rep WHERE rep = -1) AS ob FROM ({tau('with_point', 'rep', 's', 'p')}) a
 JOIN ({tau('with_point', 'rep', 's', 's0')}) b ON a.rep = b.rep JOIN ({tau('with_point', 'rep', 'p', 'p0')}) c ON a.rep = c.rep
 JOIN (SELECT rep, max(CAST(rs = 1 AND rs0 = 1 AS INT)) AS ts, max(CAST(rp = 1 AND rp0 = 1 AS INT)) AS tp FROM (SELECT rep, rank() OVER (PARTITION BY rep ORDER BY s DESC) AS rs, rank() OVER (PARTITION BY rep ORDER BY s0 DESC) AS rs0,
  rank() OVER (PARTITION BY rep ORDER BY p DESC) AS rp, rank() OVER (PARTITION BY rep ORDER BY p0 DESC) AS rp0 FROM with_point) q GROUP BY rep) d ON d.rep = a.rep),
g AS (SELECT 1 - max(ob) AS d_between_obs, count(*) AS n_used, quantile_cont(ws - bt, 0.5) AS delta_slice, {BP.format(d='(ws - bt)')} AS p_slice, quantile_cont(wp - bt, 0.5) AS delta_patient, {BP.format(d='(wp - bt)')} AS p_patient,
 quantile_cont(ws, 0.5) AS tau_within_slice, quantile_cont(wp, 0.5) AS tau_within_patient, avg(ts) AS top1_slice, avg(tp) AS top1_patient, greatest(avg(CAST(1 - ws >= 1 - ob AS DOUBLE)), avg(CAST(1 - wp >= 1 - ob AS DOUBLE))) AS p_exceed
 FROM t WHERE bt IS NOT NULL AND ws IS NOT NULL AND wp IS NOT NULL)
SELECT *, CASE WHEN n_used = 0 THEN 'NO_ESTIMATE' WHEN delta_slice > 0 AND p_slice < 0.05 AND delta_patient > 0 AND p_patient < 0.05 THEN 'UNIT_CHANGES_RANK'
 WHEN tau_within_slice < 0.5 OR tau_within_patient < 0.5 THEN 'CANNOT_RANK' WHEN top1_slice < 0.5 OR top1_patient < 0.5 THEN 'CANNOT_NAME_WINNER' ELSE 'INCONCLUSIVE' END AS verdict FROM g""")
def _(t):
    return k.rank_stability(*pt_reps(t))


HALF = f"""
WITH s AS (SELECT rep, subject, row_number() OVER (PARTITION BY rep ORDER BY {U("'0|half|' || rep || '|' || subject")}, subject) <= k // 2 AS half FROM unit_idx, range(200) x(rep)),
c AS (SELECT rep, half, 'slice' AS unit, method, score AS sc, label FROM run2 JOIN s ON s.subject = run2.subject
 UNION ALL SELECT rep, half, 'patient', method, mean_score, label FROM ({subj_sql('run2', 'method')}) z JOIN s ON s.subject = z.subject),
a AS ({auc_sql("SELECT rep, half, unit, method, sc AS s, sum(label) AS p, sum(1 - label) AS n FROM c GROUP BY ALL", "rep, half, unit, method")}),
w AS (SELECT rep, unit, method, max(auc) FILTER (NOT half) AS h0, max(auc) FILTER (half) AS h1 FROM a GROUP BY 1, 2, 3)
SELECT unit, quantile_cont(tau, 0.5) AS tau_median, quantile_cont(tau, 0.025) AS tau_lo, quantile_cont(tau, 0.975) AS tau_hi, count(tau) AS n_used FROM ({tau('w', 'rep, unit', 'h0', 'h1')}) q GROUP BY unit"""


@query("split_half_tau", "unit tau_median:d tau_lo:d tau_hi:d n_used:i", HALF)
def _(t):
    return k.split_half_tau(arms(t))


sql_view("pair_diff", f"""
SELECT x.unit, x.method AS i, y.method AS j, quantile_cont(x.auc - y.auc, 0.025) AS lo, quantile_cont(x.auc - y.auc, 0.975) AS hi, {BP.format(d='(x.auc - y.auc)')} AS p
FROM joint x JOIN joint y ON x.rep = y.rep AND x.unit = y.unit AND x.method < y.method GROUP BY 1, 2, 3
""")


@query("inversion_pairs", "a b slice_diff:d patient_diff:d p_holm_s:d p_holm_p:d survives:b", """
WITH h AS (SELECT *, least(1, max((28 - r + 1) * p) OVER (PARTITION BY unit ORDER BY r)) AS ph FROM (SELECT *, row_number() OVER (PARTITION BY unit ORDER BY p, i, j) AS r FROM pair_diff) q),
o AS (SELECT x.unit, x.method AS i, y.method AS j, x.auc - y.auc AS diff FROM point_auc x JOIN point_auc y ON x.unit = y.unit AND x.method < y.method),
z AS (SELECT s.i, s.j, so.diff AS ds, po.diff AS dp, s.lo, s.hi, p.lo AS plo, p.hi AS phi, s.ph AS hs, p.ph AS hp FROM h s JOIN h p ON s.i = p.i AND s.j = p.j AND s.unit = 'slice' AND p.unit = 'patient'
 JOIN o so ON so.i = s.i AND so.j = s.j AND so.unit = 'slice' JOIN o po ON po.i = s.i AND po.j = s.j AND po.unit = 'patient')
SELECT CASE WHEN ds > 0 THEN i ELSE j END AS a, CASE WHEN ds > 0 THEN j ELSE i END AS b, abs(ds) AS slice_diff, abs(dp) AS patient_diff, hs AS p_holm_s, hp AS p_holm_p,
 (CASE WHEN ds > 0 THEN lo ELSE -hi END) > 0 AND (CASE WHEN ds > 0 THEN phi ELSE -plo END) < 0 AND hs < 0.05 AND hp < 0.05 AS survives FROM z WHERE ds <> 0 AND dp <> 0 AND (ds > 0) <> (dp > 0)""")
def _(t):
    return k.inversion_pairs(*pt_reps(t))


def split_names(d):
    """An arm read as its method under its condition."""
    return d.withColumn("model", F.substring("method", 1, 2)).withColumn("condition", F.substring("method", 3, 1))


MOVE = """SELECT {k} substr(method, 1, 2) AS model, max(auc) FILTER (unit = 'slice' AND substr(method, 3, 1) = 'a') - max(auc) FILTER (unit = 'slice' AND substr(method, 3, 1) = 'b') AS d_slice,
 max(auc) FILTER (unit = 'patient' AND substr(method, 3, 1) = 'a') - max(auc) FILTER (unit = 'patient' AND substr(method, 3, 1) = 'b') AS d_agg, min(auc) FILTER (unit = 'patient') AS low FROM {s} GROUP BY ALL"""


@query("condition_interaction", "model d_slice:d d_agg:d interaction:d ci_lo:d ci_hi:d p:d p_holm:d sign_flip:b ceilinged:b supported:b", f"""
WITH o AS ({MOVE.format(k='', s='point_auc')}), r AS (SELECT *, d_agg - d_slice AS x FROM ({MOVE.format(k='rep,', s='joint')}) q),
ra AS (SELECT rep, model, x FROM r UNION ALL SELECT rep, 'MEAN', avg(x) FROM r GROUP BY rep),
ci AS (SELECT model, quantile_cont(x, 0.025) AS ci_lo, quantile_cont(x, 0.975) AS ci_hi, {BP.format(d='x')} AS p FROM ra GROUP BY model),
oa AS (SELECT *, d_agg - d_slice AS interaction FROM o UNION ALL SELECT 'MEAN', avg(d_slice), avg(d_agg), NULL, avg(d_agg - d_slice) FROM o),
h AS (SELECT model, least(1, max((4 - rk + 1) * p) OVER (ORDER BY rk)) AS p_holm FROM (SELECT model, p, row_number() OVER (ORDER BY p, model) AS rk FROM ci WHERE model <> 'MEAN') q)
SELECT oa.model, d_slice, d_agg, interaction, ci_lo, ci_hi, p, p_holm, d_slice <> 0 AND d_agg <> 0 AND (d_slice > 0) <> (d_agg > 0) AS sign_flip, coalesce(low >= 0.995, false) AS ceilinged,
 (ci_lo > 0 OR ci_hi < 0) AND coalesce(p_holm, 1) < 0.05 AND NOT coalesce(low >= 0.995, false) AS supported FROM oa JOIN ci ON ci.model = oa.model LEFT JOIN h ON h.model = oa.model""")
def _(t):
    p, reps = pt_reps(t)
    return k.condition_interaction(split_names(p), split_names(reps))


# a long table of reported values: document = supplier, model = part type, two units
sql_view("reported", f"""
SELECT s_suppkey AS doc, 'auc' AS metric, u AS unit, m AS model, CAST({H("s_suppkey || '|' || u || '|' || m")} % 12 AS DOUBLE) AS value FROM supplier, (VALUES ('fine'), ('coarse')) a(u), (VALUES ('resnet'), ('vgg'), ('vit'), ('unet')) b(m)
""")


@query("discordant_table_scan", "doc:i metric n_discordant:i n_pairs:i n_models:i tau:d top1_changed_strict:b", f"""
WITH w AS (SELECT doc, metric, model, max(value) FILTER (unit = 'fine') AS f, max(value) FILTER (unit = 'coarse') AS c FROM reported GROUP BY ALL),
g AS (SELECT x.doc, x.metric, count(*) FILTER (sign(x.f - y.f) * sign(x.c - y.c) < 0) AS n_discordant, count(*) AS n_pairs FROM w x JOIN w y ON x.doc = y.doc AND x.metric = y.metric AND x.model < y.model GROUP BY ALL),
b AS (SELECT doc, metric, count(*) AS n_models, count(*) FILTER (f = mf) = 1 AND count(*) FILTER (c = mc) = 1 AND count(*) FILTER (f = mf AND c = mc) = 0 AS top1_changed_strict FROM (
 SELECT *, max(f) OVER (PARTITION BY doc, metric) AS mf, max(c) OVER (PARTITION BY doc, metric) AS mc FROM w) q GROUP BY ALL)
SELECT g.*, n_models, tau, top1_changed_strict FROM g JOIN b USING (doc, metric) JOIN ({tau('w', 'doc, metric', 'f', 'c', 'model')}) t USING (doc, metric) WHERE n_discordant > 0""")
def _(t):
    cells = t.table("supplier").select(F.col("s_suppkey").alias("doc"), F.lit("auc").alias("metric"), F.explode(F.array(F.lit("fine"), F.lit("coarse"))).alias("unit")) \
        .select("*", F.explode(F.array(*[F.lit(x) for x in ("resnet", "vgg", "vit", "unet")])).alias("model"))
    return k.discordant_tables(cells.withColumn("value", (draw(F.col("doc"), F.col("unit"), F.col("model")) % 12).cast("double")))


@query("sweep_summary", "model condition text clears:b is_best:b missing:b", f"""
WITH e AS (SELECT method AS model, condition, auc, auc - 0.05 AS lo, auc + 0.05 AS hi FROM ({auc_sql(counts_sql('runs', 'method, condition'), 'method, condition')}) q)
SELECT m AS model, c AS condition, CASE WHEN auc IS NOT NULL THEN printf('%.3f [%.3f, %.3f]', auc, lo, hi) END AS text, lo > 0.5 AS clears, m = (SELECT model FROM e ORDER BY auc DESC LIMIT 1) AND c = (SELECT condition FROM e ORDER BY auc DESC LIMIT 1) AS is_best,
 auc IS NULL AS missing FROM (VALUES ('m1'), ('m2'), ('m3'), ('m4'), ('m5')) a(m) CROSS JOIN (VALUES ('a'), ('b')) b(c) LEFT JOIN e ON e.model = m AND e.condition = c""")
def _(t):
    est = m.auc(t.runs, ["method", "condition"]).select(F.col("method").alias("model"), "condition", "auc", (F.col("auc") - 0.05).alias("ci_lo"), (F.col("auc") + 0.05).alias("ci_hi"))
    return k.sweep_summary(est, ["m1", "m2", "m3", "m4", "m5"], ["a", "b"])
