"""Queries: positional theory."""

from pyspark.sql import functions as F

from ..operators import theory as th
from ..operators.geometry import relative_position
from ..session import settle
from .baselines import K, ev_cv
from .geometry import REL
from .registry import query
from .resampling import P
from .sqlkit import auc_sql, counts_sql, subj_sql
from .views import sql_view

# the common event type as label: 'error' rows against the rest, positions in a user's history
sql_view("er_pos", REL.format(src="ev_errors"))
sql_view("prof", """
WITH t AS (SELECT count(*) AS t, avg(label) AS theta FROM er_pos), c AS (SELECT CAST(least(floor(relpos * 20.0::DOUBLE), 19) AS BIGINT) AS bin, count(*) AS n, sum(label) AS k FROM er_pos GROUP BY 1)
SELECT b AS bin, coalesce(n, 0) AS n, coalesce(k, 0) AS n_pos, coalesce(n, 0) / CAST(t AS DOUBLE) AS q, coalesce(CAST(k AS DOUBLE) / n, theta) AS rate, theta FROM range(20) r(b) CROSS JOIN t LEFT JOIN c ON bin = b
""")


def er_pos(t):
    from .geometry import ev_errors
    return relative_position(ev_errors(t))


@query("positional_profile", "bin:i n:i n_pos:i q:d rate:d theta:d", "SELECT * FROM prof")
def _(t):
    return th.positional_profile(er_pos(t))


CEIL = """SELECT {k} 0.5 + gmd / (2 * th * (1 - th)) AS auc, th AS theta, gmd AS gmd_half, gmd / th AS gini, gmd / (th * (1 - th)) AS kappa FROM (
 SELECT {k2} sum(CASE WHEN x.bin < y.bin THEN x.q * y.q * abs(x.rate - y.rate) ELSE 0 END) AS gmd, sum(CASE WHEN x.bin = y.bin THEN x.q * x.rate END) AS th FROM {s} x JOIN {s} y ON {on} {g}) z"""


@query("positional_ceiling", "auc:d theta:d gmd_half:d gini:d kappa:d", CEIL.format(k="", k2="", s="prof", on="true", g=""))
def _(t):
    return th.positional_ceiling(th.positional_profile(er_pos(t)))


sql_view("icc", """
WITH d AS (SELECT volume, label - avg(label) OVER (PARTITION BY CAST(least(floor(relpos * 20.0::DOUBLE), 19) AS BIGINT)) AS r FROM er_pos),
v AS (SELECT volume, count(*) AS n, avg(r) AS mu FROM d GROUP BY volume), g AS (SELECT avg(r) AS grand FROM d),
a AS (SELECT count(*) AS k, sum(n) AS t, sum(CAST(n AS DOUBLE) * n) AS n2, sum(n * (mu - grand) * (mu - grand)) / (count(*) - 1) AS msb FROM v, g),
w AS (SELECT sum((r - mu) * (r - mu)) AS ssw FROM d JOIN v ON v.volume = d.volume),
m AS (SELECT k, t, msb, ssw / (t - k) AS msw, (t - n2 / t) / (k - 1) AS n0 FROM a, w)
SELECT CASE WHEN msb + (n0 - 1) * msw <= 0 THEN 0.0 ELSE least(greatest((msb - msw) / (msb + (n0 - 1) * msw), 0.0), 0.999) END AS icc, k AS n_volumes, t AS n_rows FROM m
""")


@query("within_volume_icc", "icc:d n_volumes:i n_rows:i", "SELECT * FROM icc")
def _(t):
    return th.within_volume_icc(er_pos(t))


@query("bin_design_effect", "bin:i per_volume:d deff:d", """
SELECT bin, pv AS per_volume, 1 + greatest(pv - 1, 0) * icc AS deff FROM (SELECT CAST(least(floor(relpos * 20.0::DOUBLE), 19) AS BIGINT) AS bin, count(*) / CAST(count(DISTINCT volume) AS DOUBLE) AS pv FROM er_pos GROUP BY 1) a, icc""")
def _(t):
    d = settle(er_pos(t))
    return th.bin_design_effect(d, th.within_volume_icc(d))


@query("order_recovery_auc", "auc:d theta:d")
def _(t):
    d = settle(er_pos(t))
    return th.order_recovery_auc(th.positional_profile(d), th.bin_design_effect(d, th.within_volume_icc(d)))


@query("debiased_ceiling", "gmd_raw:d gmd_debiased:d shrink:d auc:d")
def _(t):
    return th.debiased_ceiling(th.positional_profile(er_pos(t)))


@query("crossfit_ceiling", "auc:d n_halves:i", """
WITH f AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY h, subject) - 1) % 2 AS fold FROM (SELECT subject, max(label) AS label, CAST('0x' || substr(md5('0|' || subject), 1, 13) AS BIGINT) AS h FROM er_pos GROUP BY subject) a),
d AS (SELECT e.*, fold, CAST(least(floor(relpos * 20.0::DOUBLE), 19) AS BIGINT) AS bin FROM er_pos e JOIN f ON f.subject = e.subject),
r AS (SELECT 1 - fold AS fold, bin, avg(label) AS rate FROM d GROUP BY 1, 2), pr AS (SELECT 1 - fold AS fold, avg(label) AS prior FROM d GROUP BY 1),
s AS (SELECT d.fold, label, coalesce(rate, prior) AS score FROM d JOIN pr ON pr.fold = d.fold LEFT JOIN r ON r.fold = d.fold AND r.bin = d.bin)
SELECT avg(auc) AS auc, count(auc) AS n_halves FROM (""" + auc_sql(counts_sql("s", "fold"), "fold") + ") z")
def _(t):
    return th.crossfit_ceiling(settle(er_pos(t)))


sql_view("perm_prof", """
WITH d AS (SELECT perm, CAST(least(floor(relpos * 20.0::DOUBLE), 19) AS BIGINT) AS bin, p.label FROM perm_deep p JOIN ev_pos e ON e.row_id = p.row_id),
t AS (SELECT perm, count(*) AS t, avg(label) AS theta FROM d GROUP BY 1), c AS (SELECT perm, bin, count(*) AS n, sum(label) AS k FROM d GROUP BY 1, 2)
SELECT t.perm, b AS bin, coalesce(n, 0) / CAST(t AS DOUBLE) AS q, coalesce(CAST(k AS DOUBLE) / n, theta) AS rate FROM t CROSS JOIN range(20) r(b) LEFT JOIN c ON c.bin = b AND c.perm = t.perm
""")


@query("null_ceiling", "median:d p05:d p95:d n:i", "SELECT quantile_cont(auc, 0.5) AS median, quantile_cont(auc, 0.05) AS p05, quantile_cont(auc, 0.95) AS p95, count(auc) AS n FROM ("
       + CEIL.format(k="perm,", k2="x.perm,", s="perm_prof", on="x.perm = y.perm", g="GROUP BY x.perm") + ") c")
def _(t):
    return th.null_ceiling(settle(relative_position(t.ev_deep)), P, seed=3)


@query("depth_surrogate", "measured_mean:d measured_max:d surrogate_mean:d surrogate_max:d n_volumes:i share_hit_top:d share_span_all:d predicted_max:d", f"""
WITH d AS (SELECT e.* FROM ev_cv e), r0 AS (SELECT x AS fold, bin20 AS bin, avg(label) AS rate FROM d, range(5) q(x) WHERE fold <> x GROUP BY 1, 2), pr AS (SELECT x AS fold, avg(label) AS prior FROM d, range(5) q(x) WHERE fold <> x GROUP BY 1),
r AS (SELECT pr.fold, b AS bin, coalesce(rate, prior) AS rate FROM pr CROSS JOIN range(20) z(b) LEFT JOIN r0 ON r0.fold = pr.fold AND r0.bin = b),
top AS (SELECT fold, bin AS top FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY round(rate, 12) DESC, bin) AS i FROM r) q WHERE i = 1),
v AS (SELECT volume, subject, fold, count(*) AS n, list(DISTINCT bin20) AS bins FROM d GROUP BY 1, 2, 3), y AS (SELECT subject, max(label) AS label FROM d GROUP BY 1),
real AS (SELECT d.subject, d.label, rate AS score FROM d JOIN r ON r.fold = d.fold AND r.bin = d.bin20),
cb AS (SELECT volume, subject, fold, CASE WHEN n <= 1 THEN 0 ELSE least((20 * k) // greatest(n - 1, 1), 19) END AS bin FROM (SELECT *, unnest(range(0, n)) AS k FROM v) q),
sur AS (SELECT cb.subject, y.label, rate AS score FROM cb JOIN r ON r.fold = cb.fold AND r.bin = cb.bin JOIN y ON y.subject = cb.subject),
sr AS ({subj_sql('real')}), ss AS ({subj_sql('sur')}),
h AS (SELECT count(*) AS n_volumes, avg(CAST(list_contains(bins, top) AS DOUBLE)) AS share_hit_top, avg(CAST(len(bins) = 20 AS DOUBLE)) AS share_span_all FROM v JOIN top ON top.fold = v.fold)
SELECT a.auc AS measured_mean, b.auc AS measured_max, c.auc AS surrogate_mean, e.auc AS surrogate_max, h.*, CASE WHEN share_hit_top = 1 THEN 0.5 END AS predicted_max
FROM ({auc_sql(counts_sql('sr', score='mean_score'))}) a, ({auc_sql(counts_sql('sr', score='max_score'))}) b, ({auc_sql(counts_sql('ss', score='mean_score'))}) c, ({auc_sql(counts_sql('ss', score='max_score'))}) e, h""")
def _(t):
    return th.depth_surrogate(settle(ev_cv(t)), K)


@query("predicted_vs_measured", "ceiling:d debiased:d crossfit:d null_median:d predicted:d measured:d icc:d gap_predicted:d gap_ceiling:d")
def _(t):
    return th.predicted_vs_measured(ev_cv(t), K)
