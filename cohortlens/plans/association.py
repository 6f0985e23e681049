"""Queries: association, agreement, bounds."""

from pyspark.sql import functions as F

from ..operators import association as a
from ..operators import metrics as m
from .columns import coded
from .registry import query
from .sqlkit import auc_sql, counts_sql, wilson_sql
from .views import U, sql_view


@query("contingency", "a b n:i", "SELECT linestatus AS a, priority AS b, count(*) AS n FROM li_slices GROUP BY 1, 2")
def _(t):
    return a.contingency(t.li_slices, "linestatus", "priority")


STATS = "chi2:d v:d v_corrected:d mi:d mi_bits:d h_a:d h_b:d nmi:d u_b_given_a:d n:i"


def stats_sql(ct, keys=""):
    """Chi-square over all cells (absent ones through a cross join of levels) and information."""
    k = f"{keys}, " if keys else ""
    j = lambda x, y: " AND ".join(f"{x}.{c.strip()} = {y}.{c.strip()}" for c in keys.split(",")) if keys else "true"
    return f"""
WITH ct AS ({ct}), ra AS (SELECT {k} a, sum(n) AS r FROM ct GROUP BY ALL), cb AS (SELECT {k} b, sum(n) AS c FROM ct GROUP BY ALL), tt AS (SELECT {k} sum(n) AS t FROM ct GROUP BY ALL),
cells AS (SELECT {'ra.' + ', ra.'.join(c.strip() for c in keys.split(',')) + ',' if keys else ''} ra.a, cb.b, CAST(r AS DOUBLE) AS r, CAST(c AS DOUBLE) AS c, CAST(t AS DOUBLE) AS t, coalesce(ct.n, 0) AS n
 FROM ra JOIN cb ON {j('ra', 'cb')} JOIN tt ON {j('ra', 'tt')} LEFT JOIN ct ON ct.a = ra.a AND ct.b = cb.b AND {j('ct', 'ra')}),
g AS (SELECT {k} sum((n - r * c / t) * (n - r * c / t) / (r * c / t)) AS chi2, sum(CASE WHEN n > 0 THEN n / t * ln(n * t / (r * c)) ELSE 0 END) AS mi, max(t) AS nn, count(DISTINCT a) AS ka, count(DISTINCT b) AS kb FROM cells GROUP BY ALL),
ha AS (SELECT {'ra.' + ', ra.'.join(c.strip() for c in keys.split(',')) + ',' if keys else ''} -sum(r / CAST(t AS DOUBLE) * ln(r / CAST(t AS DOUBLE))) AS h_a FROM ra JOIN tt ON {j('ra', 'tt')} GROUP BY ALL),
hb AS (SELECT {'cb.' + ', cb.'.join(c.strip() for c in keys.split(',')) + ',' if keys else ''} -sum(c / CAST(t AS DOUBLE) * ln(c / CAST(t AS DOUBLE))) AS h_b FROM cb JOIN tt ON {j('cb', 'tt')} GROUP BY ALL)
SELECT {'g.' + ', g.'.join(c.strip() for c in keys.split(',')) + ',' if keys else ''} chi2, sqrt(chi2 / nn / (least(ka, kb) - 1)) AS v,
 sqrt(greatest(0.0::DOUBLE, chi2 / nn - (ka - 1) * (kb - 1) / (nn - 1)) / (least(ka - (ka - 1) * (ka - 1) / (nn - 1), kb - (kb - 1) * (kb - 1) / (nn - 1)) - 1)) AS v_corrected,
 mi, mi / ln(2.0::DOUBLE) AS mi_bits, h_a, h_b, mi / sqrt(h_a * h_b) AS nmi, mi / h_b AS u_b_given_a, nn AS n FROM g JOIN ha ON {j('g', 'ha')} JOIN hb ON {j('g', 'hb')}"""


CT = "SELECT linestatus AS a, priority AS b, count(*) AS n FROM li_slices GROUP BY 1, 2"


@query("chi2_cramers_v", "chi2:d v:d v_corrected:d n:i", "SELECT chi2, v, v_corrected, n FROM (" + stats_sql(CT) + ") z")
def _(t):
    return a.table_statistics(a.contingency(t.li_slices, "linestatus", "priority"))


@query("mutual_information", "mi:d mi_bits:d h_a:d h_b:d nmi:d u_b_given_a:d", "SELECT mi, mi_bits, h_a, h_b, nmi, u_b_given_a FROM (" + stats_sql(CT) + ") z")
def _(t):
    return a.table_statistics(a.contingency(t.li_slices, "linestatus", "priority"))


PAIRS = " UNION ALL ".join(
    f"SELECT '{x}' AS first, '{y}' AS second, CAST({x} AS VARCHAR) AS a, CAST({y} AS VARCHAR) AS b, count(*) AS n FROM sites GROUP BY ALL"
    for x, y in (("segment", "region"), ("segment", "nation"), ("segment", "label"), ("region", "nation"), ("region", "label"), ("nation", "label")))


@query("association_matrix", f"first second {STATS}", stats_sql(PAIRS, "first, second"))
def _(t):
    return a.association_matrix(t.sites, ["segment", "region", "nation"], "label")


NP = 20
sql_view("assoc_perm", f"""
WITH b AS (SELECT row_id, segment, row_number() OVER (ORDER BY {U("'5|base|' || row_id")}, row_id) AS i FROM sites),
p AS (SELECT perm, region, row_number() OVER (PARTITION BY perm ORDER BY {U("'5|' || perm || '|' || row_id")}, row_id) AS i FROM sites, range({NP}) x(perm))
SELECT perm, segment AS a, region AS b, count(*) AS n FROM b JOIN p ON p.i = b.i GROUP BY ALL
""")


@query("association_null", "v:d v_null_mean:d v_null_q95:d v_p:d mi:d mi_null_mean:d mi_p:d", f"""
WITH nl AS ({stats_sql('SELECT * FROM assoc_perm', 'perm')}), ob AS ({stats_sql('SELECT segment AS a, region AS b, count(*) AS n FROM sites GROUP BY 1, 2')})
SELECT max(ob.v) AS v, avg(nl.v) AS v_null_mean, quantile_cont(nl.v, 0.95) AS v_null_q95, (count(*) FILTER (nl.v >= ob.v - 1e-12) + 1) / CAST(count(*) + 1 AS DOUBLE) AS v_p,
 max(ob.mi) AS mi, avg(nl.mi) AS mi_null_mean, (count(*) FILTER (nl.mi >= ob.mi - 1e-12) + 1) / CAST(count(*) + 1 AS DOUBLE) AS mi_p FROM nl, ob""")
def _(t):
    return a.association_null(t.sites, "segment", "region", NP, 5)


@query("auc_vs_label", "column_name n:i n_levels:i auc:d", f"""
WITH f AS (SELECT 'segment' AS c, segment AS lv, min(subject) AS f FROM sites GROUP BY 2 UNION ALL SELECT 'region', region, min(subject) FROM sites GROUP BY 2),
k AS (SELECT *, CAST(row_number() OVER (PARTITION BY c ORDER BY f, lv) AS DOUBLE) AS code FROM f),
d AS (SELECT 'segment' AS column_name, label, code AS score, segment AS lv FROM sites JOIN k ON c = 'segment' AND lv = segment UNION ALL SELECT 'region', label, code, region FROM sites JOIN k ON c = 'region' AND lv = region
 UNION ALL SELECT 'device', label, CAST(device AS DOUBLE), CAST(device AS VARCHAR) FROM sites)
SELECT x.column_name, n, n_levels, greatest(auc, 1 - auc) AS auc FROM ({auc_sql(counts_sql('d', 'column_name'), 'column_name')}) x JOIN (SELECT column_name, count(*) AS n, count(DISTINCT lv) AS n_levels FROM d GROUP BY 1) y ON x.column_name = y.column_name""")
def _(t):
    return a.auc_vs_label(t.sites, ["segment", "region", "device"]).withColumnRenamed("column", "column_name")


ETA = " UNION ALL ".join(f"SELECT '{c}' AS column_name, CAST({c} AS VARCHAR) AS lv, balance AS x FROM sites" for c in ("segment", "nation", "subject", "label"))


@query("eta_squared", "column_name size:i n_levels:i eta2:d skipped", f"""
SELECT column_name, size, n_levels, CASE WHEN ok THEN ssb / sst END AS eta2, CASE WHEN NOT ok THEN 'too many levels' END AS skipped FROM (
 SELECT column_name, count(*) AS size, count(DISTINCT lv) AS n_levels, sum((mu - grand) * (mu - grand)) AS ssb, sum((x - grand) * (x - grand)) AS sst, count(DISTINCT lv) <= greatest(2, count(*) // 4) AS ok FROM (
  SELECT *, avg(x) OVER (PARTITION BY column_name, lv) AS mu, avg(x) OVER (PARTITION BY column_name) AS grand FROM ({ETA}) e) q GROUP BY 1) r""")
def _(t):
    return a.eta_squared(t.sites, ["segment", "nation", "subject"], "balance").withColumnRenamed("column", "column_name")


@query("site_components", "inst site n_rows:i n_strings:i n_shared_devices:i", """
WITH RECURSIVE s AS (SELECT trim(regexp_replace(regexp_replace(upper(trim(institution)), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS inst, device FROM sites),
e AS (SELECT DISTINCT x.inst AS a, y.inst AS b FROM s x JOIN s y ON x.device = y.device),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a AS inst, min(b) AS comp FROM r GROUP BY a), n AS (SELECT inst, count(*) AS n_rows FROM s GROUP BY inst),
nm AS (SELECT comp, arg_min(c.inst, (-n_rows, length(c.inst), c.inst)) AS site, count(*) AS n_strings FROM c JOIN n ON n.inst = c.inst GROUP BY comp),
sh AS (SELECT comp, count(*) AS k FROM (SELECT device, min(inst) AS i FROM s GROUP BY device HAVING count(DISTINCT inst) > 1) d JOIN c ON c.inst = d.i GROUP BY comp)
SELECT c.inst, site, n_rows, n_strings, coalesce(k, 0) AS n_shared_devices FROM c JOIN n ON n.inst = c.inst JOIN nm ON nm.comp = c.comp LEFT JOIN sh ON sh.comp = c.comp""")
def _(t):
    return a.site_components(t.sites)


@query("same_partition", "pair max_a:i max_b:i same:b", """
WITH p AS (SELECT DISTINCT nation AS a, region AS b FROM sites), q AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS a, n_name AS b FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'nation-region' AS pair, *, max_a = 1 AND max_b = 1 AS same FROM (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY a) x) AS max_a, (SELECT max(n) FROM (SELECT count(*) AS n FROM p GROUP BY b) x) AS max_b) z
UNION ALL SELECT 'key-name', *, max_a = 1 AND max_b = 1 FROM (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM q GROUP BY a) x) AS max_a, (SELECT max(n) FROM (SELECT count(*) AS n FROM q GROUP BY b) x) AS max_b) z""")
def _(t):
    c = t.table("customer").join(t.table("nation"), F.expr("c_nationkey = n_nationkey"))
    return a.same_partition(t.sites, "nation", "region").withColumn("pair", F.lit("nation-region")).unionByName(
        a.same_partition(c, "c_nationkey", "n_name").withColumn("pair", F.lit("key-name")))


AGREE = """
WITH c AS (SELECT {k} item, code, count(*) AS n FROM raters GROUP BY ALL), p AS (SELECT {k} item, sum(n) AS m, sum(n * (n - 1)) AS ag, count(*) AS kk FROM c GROUP BY ALL),
o AS (SELECT {k} avg(ag / CAST(m * (m - 1) AS DOUBLE)) AS pa, count(*) AS n_items, max(m) AS n_raters, sum(m) AS t, count(*) FILTER (kk = 1) AS n_unanimous FROM p GROUP BY ALL),
s AS (SELECT code, sum(n) / CAST((SELECT t FROM o) AS DOUBLE) AS s FROM c GROUP BY code)
SELECT pa, (pa - pf) / (1 - pf) AS fleiss_kappa, (pa - pg) / (1 - pg) AS gwet_ac1, n_items, n_raters, n_categories, n_unanimous
FROM o, (SELECT sum(s * s) AS pf, sum(s * (1 - s)) / (count(*) - 1) AS pg, count(*) AS n_categories FROM s) z"""


@query("rater_agreement", "pa:d fleiss_kappa:d gwet_ac1:d n_items:i n_raters:i n_categories:i n_unanimous:i", AGREE.format(k=""))
def _(t):
    return a.rater_agreement(t.raters)


@query("cohen_kappa", "rater_a rater_b po:d kappa:d n:i", """
WITH j AS (SELECT x.rater AS rater_a, y.rater AS rater_b, x.code AS ca, y.code AS cb FROM raters x JOIN raters y ON x.item = y.item AND x.rater < y.rater)
SELECT rater_a, rater_b, po, (po - pe) / (1 - pe) AS kappa, n FROM (SELECT rater_a, rater_b, avg(CAST(ca = cb AS DOUBLE)) AS po,
 avg(ca) * avg(cb) + (1 - avg(ca)) * (1 - avg(cb)) AS pe, count(*) AS n FROM j GROUP BY 1, 2) q""")
def _(t):
    return a.cohen_kappa(t.raters)


@query("majority_code", "item:i majority votes:i tied:b", """
SELECT item, c AS majority, n AS votes, k > 1 AS tied FROM (SELECT item, c, n, row_number() OVER (PARTITION BY item ORDER BY n DESC, c <> '1', c) AS r, count(*) FILTER (n = mx) OVER (PARTITION BY item) AS k
 FROM (SELECT *, max(n) OVER (PARTITION BY item) AS mx FROM (SELECT item, CAST(code AS VARCHAR) AS c, count(*) AS n FROM raters GROUP BY 1, 2) q) p) z WHERE r = 1""")
def _(t):
    return a.majority_code(t.raters, ["1"])


@query("consensus_rows", "item:i consensus disagreement:b", "SELECT item, CASE WHEN bool_or(code = 1) THEN 'TRUE' WHEN bool_and(code <> 1) THEN 'FALSE' ELSE 'NOT_ASSESSABLE' END AS consensus, min(code) <> max(code) AS disagreement FROM raters GROUP BY item")
def _(t):
    return a.consensus(t.raters)


@query("endpoint_bounds", "endpoint k:i n:i proportion:d ci_lo:d ci_hi:d bounds_replace:b", """
WITH c AS (SELECT count(*) FILTER (flag = 'TRUE') AS y, count(*) FILTER (flag = 'FALSE') AS x, count(*) FILTER (flag = 'NOT_ASSESSABLE') AS g FROM coded),
e AS (SELECT 'complete_case' AS endpoint, y AS k, y + x AS n, g / CAST(y + x + g AS DOUBLE) > 0.15 AS bounds_replace FROM c UNION ALL SELECT 'lower_bound', y, y + x + g, g / CAST(y + x + g AS DOUBLE) > 0.15 FROM c UNION ALL SELECT 'upper_bound', y + g, y + x + g, g / CAST(y + x + g AS DOUBLE) > 0.15 FROM c)
SELECT endpoint, k, n, k / CAST(n AS DOUBLE) AS proportion, {} AS ci_lo, {} AS ci_hi, bounds_replace FROM e""".format(*wilson_sql("k", "n")))
def _(t):
    return a.endpoint_bounds(coded(t))


@query("screening_flow", "status unit n:i is_total:i", """
SELECT status, unit, count(*) AS n, grouping(unit) AS is_total FROM coded GROUP BY GROUPING SETS ((status), (status, unit))""")
def _(t):
    return a.screening_flow(coded(t), "status", "unit")


@query("stopping_rule", "block:i n:i n_included:i running:i post_hoc:b", """
SELECT *, running - n_included >= 75 AS post_hoc FROM (SELECT block, count(*) AS n, sum(CAST(decision = 'included' AS INT)) AS n_included, sum(sum(CAST(decision = 'included' AS INT))) OVER (ORDER BY block) AS running FROM records GROUP BY block) q""")
def _(t):
    return a.stopping_rule(t.records.withColumn("included", F.col("decision") == "included"), 75)


@query("cross_table", "unit TRUE_n:i FALSE_n:i NOT_ASSESSABLE_n:i NOT_APPLICABLE_n:i", """
SELECT unit, count(*) FILTER (flag = 'TRUE') AS TRUE_n, count(*) FILTER (flag = 'FALSE') AS FALSE_n, count(*) FILTER (flag = 'NOT_ASSESSABLE') AS NOT_ASSESSABLE_n, count(*) FILTER (flag = 'NOT_APPLICABLE') AS NOT_APPLICABLE_n FROM coded GROUP BY unit""")
def _(t):
    v = ["TRUE", "FALSE", "NOT_ASSESSABLE", "NOT_APPLICABLE"]
    return a.cross_table(coded(t), "unit", "flag", v).withColumnsRenamed({x: f"{x}_n" for x in v})
