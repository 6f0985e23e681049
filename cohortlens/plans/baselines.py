"""Queries: zero-information baselines, scored out of fold."""

from pyspark.sql import functions as F

from ..operators import baselines as b
from ..operators import geometry as g
from ..operators import metrics as m
from ..operators.splits import seeded_folds
from ..session import settle
from .registry import query
from .sqlkit import auc_sql, counts_sql, subj_sql
from .views import sql_view

K = 5
sql_view("ev_cv", """
SELECT p.*, f.fold, CAST(least(floor(relpos * 20.0::DOUBLE), 19) AS BIGINT) AS bin20, CAST(least(floor(relpos * 5.0::DOUBLE), 4) AS BIGINT) AS bin5,
       CAST(least(floor(relpos * 10.0::DOUBLE), 9) AS BIGINT) AS bin10, CAST(least(floor(relpos * 50.0::DOUBLE), 49) AS BIGINT) AS bin50
FROM ev_pos p JOIN folds5 f ON p.subject = f.subject
""")


def rate_sql(level, name, smoothing=0, src="ev_cv"):
    """Out-of-fold encoding of one level column, one row per row."""
    a = f"{float(smoothing)}::DOUBLE"
    return f"""
SELECT t.row_id, t.subject, t.volume, t.fold, t.label, t.relpos, '{name}' AS feature, round(coalesce((r.sp + {a} * pr.prior) / (r.c + {a}), pr.prior), 12) AS score
FROM {src} t JOIN (SELECT x AS fold, avg(label) AS prior FROM {src}, range(5) q(x) WHERE fold <> x GROUP BY x) pr ON pr.fold = t.fold
LEFT JOIN (SELECT x AS fold, {level} AS lv, sum(label) AS sp, count(*) AS c FROM {src}, range(5) q(x) WHERE fold <> x GROUP BY 1, 2) r
ON r.fold = t.fold AND r.lv IS NOT DISTINCT FROM t.{level}"""


sql_view("decile", """
SELECT x AS fold, list_sort(list_distinct(list_transform(range(1, 10), lambda i: quantile_cont(v, list_value(0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))[i]))) AS edges
FROM (SELECT x, value AS v FROM ev_cv, range(5) q(x) WHERE fold <> x) z GROUP BY x
""".replace("list_sort(list_distinct(list_transform(range(1, 10), lambda i: quantile_cont(v, list_value(0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9))[i])))",
            "list_sort(list_distinct(quantile_cont(v, [0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])))"))
sql_view("scored_simple", " UNION ALL ".join([
    rate_sql("one", "prevalence", src="(SELECT *, 1 AS one FROM ev_cv)"),
    rate_sql("bin5", "positional_5bin"), rate_sql("bin10", "positional_10bin"),
    rate_sql("bin20", "positional_20bin"), rate_sql("bin50", "positional_50bin")]))
# depth has more than ten values, so volume size is cut at the training deciles
sql_view("scored_size", """
WITH v AS (SELECT x AS part, c.*, n_slices FROM ev_cv c, range(5) q(x)),
e AS (SELECT part, list_sort(list_distinct(quantile_cont(n_slices, [0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM v WHERE fold <> part GROUP BY part),
c AS (SELECT v.*, len(list_filter(edges, lambda z: z <= n_slices)) AS code FROM v JOIN e ON v.part = e.part),
r AS (SELECT part, code, sum(label) AS sp, count(*) AS c FROM c WHERE fold <> part GROUP BY 1, 2),
pr AS (SELECT part, avg(label) AS prior FROM c WHERE fold <> part GROUP BY 1)
SELECT c.row_id, c.subject, c.volume, c.fold, c.label, c.relpos, 'volume_size' AS feature, round(coalesce((sp + prior) / (r.c + 1.0::DOUBLE), prior), 12) AS score
FROM c JOIN pr ON pr.part = c.part LEFT JOIN r ON r.part = c.part AND r.code = c.code WHERE c.fold = c.part
""")
BINS = (5, 10, 20, 50)


def ev_cv(t):
    e = settle(t.ev_deep)
    d = g.volume_size(g.relative_position(e))
    return d.join(seeded_folds(e, K, 0).select("subject", "fold"), "subject")


def flat(c):
    """Cells to (feature, fold, s, p, n)."""
    return c.groupBy("feature", "fold", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


FLAT = "SELECT feature, fold, score AS s, sum(label) AS p, sum(1 - label) AS n FROM {} GROUP BY ALL"


@query("baseline_prevalence", "feature fold:i s:d p:i n:i", FLAT.format("scored_simple") .replace("GROUP BY ALL", "WHERE feature = 'prevalence' GROUP BY ALL"))
def _(t):
    return flat(b.encode(b.cells(ev_cv(t), {"prevalence": F.lit("all")}), K, 0.0))


@query("baseline_positional", "feature fold:i s:d p:i n:i", FLAT.format("scored_simple").replace("GROUP BY ALL", "WHERE feature = 'positional_20bin' GROUP BY ALL"))
def _(t):
    return flat(b.encode(b.cells(ev_cv(t), b.position_features((20,))), K, 0.0))


@query("baseline_volume_size", "feature fold:i s:d p:i n:i", FLAT.format("scored_size"))
def _(t):
    return flat(b.column_scores(b.cells(ev_cv(t), {"volume_size": F.col("n_slices")}), K, {"volume_size"}))


COLS = ("event_type", "hour", "k", "value")
sql_view("scored_cols", " UNION ALL ".join([
    rate_sql("event_type", "event_type", 1)] + [f"""
SELECT * FROM (WITH v AS (SELECT x AS part, c.* FROM ev_cv c, range(5) q(x)),
e AS (SELECT part, count(DISTINCT {c}) > 10 AS many, list_sort(list_distinct(quantile_cont(CAST({c} AS DOUBLE), [0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM v WHERE fold <> part GROUP BY part),
c AS (SELECT v.*, CASE WHEN {c} IS NULL THEN NULL ELSE len(list_filter(edges, lambda z: z <= {c})) END AS code FROM v JOIN e ON v.part = e.part),
r AS (SELECT part, code, sum(label) AS sp, count(*) AS c FROM c WHERE fold <> part GROUP BY 1, 2),
pr AS (SELECT part, avg(label) AS prior FROM c WHERE fold <> part GROUP BY 1)
SELECT c.row_id, c.subject, c.volume, c.fold, c.label, c.relpos, '{c}' AS feature, round(coalesce((sp + prior) / (r.c + 1.0::DOUBLE), prior), 12) AS score
FROM c JOIN pr ON pr.part = c.part LEFT JOIN r ON r.part = c.part AND r.code IS NOT DISTINCT FROM c.code WHERE c.fold = c.part) z""" for c in COLS[1:]]))


def column_cells(t):
    c = b.cells(ev_cv(t), {n: F.col(n) for n in COLS})
    return settle(b.column_scores(c, K, set(COLS[1:])))


@query("baseline_column", "feature fold:i s:d p:i n:i", FLAT.format("scored_cols"))
def _(t):
    return flat(column_cells(t))


@query("bin_sweep", "feature auc:d n_pos:i n_neg:i",
       auc_sql(counts_sql("scored_simple", "feature").replace("GROUP BY", "AND feature <> 'prevalence' GROUP BY"), "feature")
       + " UNION ALL SELECT 'centrality', auc, n_pos, n_neg FROM (" + auc_sql(counts_sql("ev_cv", score="-abs(relpos - 0.5)")) + ") c")
def _(t):
    d = ev_cv(t)
    out = m.auc_from_counts(flat(b.encode(b.cells(d, b.position_features(BINS)), K, 0.0))
                            .groupBy("feature", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["feature"], few=True)
    c = m.auc(d.withColumn("score", g.centrality_score(F.col("relpos"))))
    return out.unionByName(c.select(F.lit("centrality").alias("feature"), "auc", "n_pos", "n_neg"))


@query("bin_agg_grid", "feature mean_auc:d max_auc:d", f"""
SELECT a.feature, a.auc AS mean_auc, b.auc AS max_auc FROM
({auc_sql(counts_sql('(' + subj_sql('scored_simple', 'feature') + ')', 'feature', 'mean_score'), 'feature')}) a
JOIN ({auc_sql(counts_sql('(' + subj_sql('scored_simple', 'feature') + ')', 'feature', 'max_score'), 'feature')}) b ON a.feature = b.feature
WHERE a.feature <> 'prevalence'""")
def _(t):
    c = b.encode(b.cells(ev_cv(t), b.position_features(BINS)), K, 0.0)
    s = m.subjects_from_cells(c, ["feature"])
    arms = F.array(*[F.struct(F.lit(a).alias("agg"), F.col(f"{a}_score").alias("score")) for a in ("mean", "max")])
    return (m.auc(s.select("feature", "label", F.inline(arms)), ["feature", "agg"]).groupBy("feature")
            .pivot("agg", ["mean", "max"]).agg(F.first("auc"))
            .withColumnsRenamed({"mean": "mean_auc", "max": "max_auc"}))


@query("univariate_screen", "feature slice_auc:d patient_auc:d n_levels:i subject_constant:b tautology:b is_best:b n_screened:i", f"""
WITH a AS ({auc_sql(counts_sql('scored_cols', 'feature'), 'feature', 'slice_auc')}),
p AS ({auc_sql(counts_sql('(' + subj_sql('scored_cols', 'feature') + ')', 'feature', 'mean_score'), 'feature', 'patient_auc')}),
l AS (SELECT 'event_type' AS feature, count(DISTINCT event_type) AS n_levels FROM ev_deep UNION ALL SELECT 'hour', count(DISTINCT hour) FROM ev_deep
 UNION ALL SELECT 'k', count(DISTINCT k) FROM ev_deep UNION ALL SELECT 'value', count(DISTINCT value) FROM ev_deep)
SELECT a.feature, slice_auc, patient_auc, n_levels, false AS subject_constant, slice_auc >= 0.999 AS tautology,
       row_number() OVER (ORDER BY slice_auc DESC, a.feature) = 1 AS is_best, 4 AS n_screened
FROM a JOIN p ON a.feature = p.feature JOIN l ON l.feature = a.feature""")
def _(t):
    c = column_cells(t)
    sl = m.auc_from_counts(c.groupBy("feature", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["feature"], out="slice_auc")
    pa = m.auc(m.subjects_from_cells(c, ["feature"]), ["feature"], "mean_score", out="patient_auc")
    lv = c.filter(F.col("level").isNotNull()).groupBy("feature").agg(F.countDistinct("level").alias("n_levels"))
    const = (c.select("feature", "subject", "level").distinct().groupBy("feature", "subject").agg(F.count(F.lit(1)).alias("k"))
             .groupBy("feature").agg((F.max("k") == 1).alias("subject_constant")))
    d = sl.select("feature", "slice_auc").join(pa.select("feature", "patient_auc"), "feature").join(lv, "feature").join(const, "feature")
    best = d.agg(F.min(F.struct((-F.col("slice_auc")).alias("a"), "feature"))["feature"].alias("__best"), F.count(F.lit(1)).alias("n_screened"))
    return (d.crossJoin(F.broadcast(best)).withColumn("is_best", F.col("feature") == F.col("__best"))
            .withColumn("tautology", F.col("slice_auc") >= 0.999))


@query("feature_encoder", "row_id:i num:d missing:i l0:i l1:i other:i", """
WITH tr AS (SELECT * FROM li_slices WHERE CAST(subject AS BIGINT) % 3 > 0),
med AS (SELECT quantile_cont(CASE WHEN quantity > 45 THEN NULL ELSE quantity END, 0.5) AS x FROM tr),
lv AS (SELECT priority, row_number() OVER (ORDER BY count(*) DESC, priority) AS r FROM tr GROUP BY priority)
SELECT row_id, coalesce(CASE WHEN quantity > 45 THEN NULL ELSE quantity END, med.x) AS num, CAST(quantity > 45 AS BIGINT) AS missing,
       CAST(coalesce(r = 1, false) AS BIGINT) AS l0, CAST(coalesce(r = 2, false) AS BIGINT) AS l1, CAST(coalesce(r > 2, true) AS BIGINT) AS other
FROM li_slices l CROSS JOIN med LEFT JOIN lv ON lv.priority = l.priority""")
def _(t):
    from ..operators.tree import Encoder
    d = t.li_slices.withColumn("q", F.when(F.col("quantity") <= 45, F.col("quantity")))
    enc = Encoder.fit(d.filter(F.col("subject").cast("long") % 3 > 0), ["q", "priority"], max_levels=2)
    cols = enc.columns()
    return d.select("row_id", *[c.alias(n) for c, n in zip([x for _, x in cols], ("num", "missing", "l0", "l1", "other"))])


def _tree(t, relpos):
    from ..operators import tree
    d = ev_cv(t)
    return tree.fit_score(d, K, ["event_type", "hour", "value"], use_relpos=relpos, name="tree")


@query("baseline_tree", "feature fold:i s:d p:i n:i")
def _(t):
    return flat(_tree(t, False)[0])


@query("baseline_combined", "feature fold:i s:d p:i n:i")
def _(t):
    return flat(_tree(t, True)[0])


@query("tree_describe", "partition:i depth:i n_leaves:i features smallest_leaf:i")
def _(t):
    from ..operators import tree
    return tree.describe(t.spark, _tree(t, True)[1])


@query("partition_scores", "feature n_cells_pos:i n_pos:i n_neg:i auc:d", f"""
SELECT a.feature, (SELECT count(*) FROM range(1)) AS n_cells_pos, n_pos, n_neg, auc FROM ({auc_sql(counts_sql("(SELECT * FROM scored_simple WHERE feature IN ('prevalence', 'positional_20bin') UNION ALL SELECT * FROM scored_size)", 'feature'), 'feature')}) a""")
def _(t):
    c = b.simple_baselines(ev_cv(t), K)
    return m.auc_from_counts(c.groupBy("feature", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["feature"]) \
        .withColumn("n_cells_pos", F.lit(1))


@query("multiclass_positional", "n_test:i accuracy:d majority_accuracy:d prior_random_accuracy:d", """
WITH d AS (SELECT *, CAST(least(floor(relpos * 20.0::DOUBLE), 19) AS BIGINT) AS bin, CAST(subject AS BIGINT) % 4 > 0 AS tr FROM emb_multi),
pr AS (SELECT class, count(*) AS t FROM d WHERE tr GROUP BY class),
best AS (SELECT bin, class AS pred FROM (SELECT bin, d.class, row_number() OVER (PARTITION BY bin ORDER BY count(*) DESC, max(t) DESC, d.class) AS r FROM d JOIN pr ON pr.class = d.class WHERE tr GROUP BY 1, 2) q WHERE r = 1),
mj AS (SELECT class AS majority FROM pr ORDER BY t DESC, class LIMIT 1),
s AS (SELECT d.*, coalesce(pred, majority) AS pred, majority FROM d CROSS JOIN mj LEFT JOIN best ON best.bin = d.bin WHERE NOT tr)
SELECT count(*) AS n_test, avg(CAST(pred = class AS DOUBLE)) AS accuracy, avg(CAST(majority = class AS DOUBLE)) AS majority_accuracy,
  (SELECT sum(a * b) FROM (SELECT class, t / CAST((SELECT sum(t) FROM pr) AS DOUBLE) AS a FROM pr) x JOIN (SELECT class, count(*) / CAST((SELECT count(*) FROM s) AS DOUBLE) AS b FROM s GROUP BY class) y ON x.class = y.class) AS prior_random_accuracy FROM s""")
def _(t):
    d, tr = t.emb_multi, F.col("subject").cast("long") % 4 > 0
    return b.multiclass_summary(b.multiclass_positional(d, tr), d, tr)
