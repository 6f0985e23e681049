"""Queries: whole reports and streams."""

from pyspark.sql import functions as F

from ..functions.draws import draw, unit_draw
from ..functions.prefix import TASK_ROWS
from ..operators import baselines as b
from ..operators import guards
from ..operators import metrics as m
from ..operators import reports as rp
from ..operators import resample as r
from ..operators.geometry import relative_position, volume_size
from ..operators.splits import seeded_folds
from ..session import settle
from ..streaming import ingest
from .baselines import K, ev_cv
from .metrics import KEYS
from .registry import query
from .resampling import B, P, arms, ci, rep_auc
from .sqlkit import auc_sql, counts_sql, subj_sql
from .tables import folder
from .views import H, U, sql_view


def flagship(t):
    """One row per baseline: row and subject AUC out of fold, with subject-resampled intervals."""
    e = settle(t.ev_deep)
    d = volume_size(relative_position(e)).join(seeded_folds(e, K, 0).select("subject", "fold"), "subject")
    parts = d.select("subject", "fold").distinct().groupBy("subject").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    guards.require_empty(parts, "subject in two folds")
    c = b.simple_baselines(d, K)
    return rp.bundle(c, ["feature"], n_boot=B, seed=1)


@query("audit_report", "evaluation baseline slice_auc:d ap:d patient_auc:d slice_lo:d slice_hi:d patient_lo:d patient_hi:d kind null_mean:d p:d headline:b fraction:d")
def _(t):
    d = t.ev_deep.select("subject", "slice", "label", "hour", "k", "event_type", F.col("volume"))
    a = rp.audit(d, n_boot=B, n_perm=P, published=0.9, volume="volume", trees=True, seed=1, metadata=["hour", "event_type"])
    h = a["headline"].select(F.col("feature").alias("__f"), "fraction")
    e = a["evaluations"][a["headline_evaluation"]]
    j = e["baselines"].withColumnRenamed("feature", "baseline").join(e["nulls"].select("baseline", "kind", "null_mean", "p"), "baseline", "left")
    j = j.join(h, F.col("baseline") == F.col("__f"), "left")
    return j.withColumn("evaluation", F.lit(a["headline_evaluation"])).withColumn("headline", F.col("__f").isNotNull())


WF = "(SELECT *, CAST(subject AS BIGINT) % 6 AS st FROM run2)"


@query("waterfall", "method rung:i reading auc:d", f"""
SELECT method, 1 AS rung, 'rows' AS reading, auc FROM ({auc_sql(counts_sql(WF, 'method'), 'method')}) a
UNION ALL SELECT method, 2, 'subject mean', auc FROM ({auc_sql(counts_sql('(' + subj_sql(WF, 'method') + ')', 'method', 'mean_score'), 'method')}) a
UNION ALL SELECT method, 3, 'subject max', auc FROM ({auc_sql(counts_sql('(' + subj_sql(WF, 'method') + ')', 'method', 'max_score'), 'method')}) a
UNION ALL SELECT method, 4, 'inside strata', sum(auc * n_pos * n_neg) / sum(CASE WHEN auc IS NOT NULL THEN n_pos * n_neg END) FROM ({auc_sql(counts_sql(WF, 'method, st'), 'method, st')}) a GROUP BY method""")
def _(t):
    return rp.waterfall(arms(t).withColumn("st", F.col("subject").cast("long") % 6), "st", ["method"])


# headline per nation and region with control intervals drawn from customer balances
sql_view("heads", "SELECT n_name AS cohort, CAST(n_regionkey AS VARCHAR) AS condition, 0.4 + 0.5 * b AS auc, 0.3 + 0.5 * b AS lo, 0.5 + 0.5 * b AS hi FROM nation JOIN (SELECT c_nationkey, avg(CAST(c_acctbal > 5000 AS INT)) AS b FROM customer GROUP BY 1) q ON c_nationkey = n_nationkey")
sql_view("ctrl", f"SELECT n_name AS cohort, CAST(n_regionkey AS VARCHAR) AS condition, c AS control, 0.2 + 0.6 * {U('c || n_nationkey')} AS lo, 0.3 + 0.6 * {U('c || n_nationkey')} AS hi FROM nation, (VALUES ('background'), ('scramble'), ('acquisition'), ('confound')) v(c) WHERE {U('c || n_nationkey')} > 0.1 AND n_nationkey % 6 <> 5")
sql_view("perm_runs", "SELECT n_name AS cohort, CAST(n_regionkey AS VARCHAR) AS condition, 0.45 + c_acctbal / 60000 AS auc FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 6 <> 5")


def control_tables(t):
    n = t.table("nation")
    cb = t.table("customer").groupBy("c_nationkey").agg(F.avg((F.col("c_acctbal") > 5000).cast("int")).alias("b"))
    key = [F.col("n_name").alias("cohort"), F.col("n_regionkey").cast("string").alias("condition")]
    head = n.join(cb, F.expr("c_nationkey = n_nationkey")).select(*key, *[(x + 0.5 * F.col("b")).alias(c) for x, c in ((0.4, "auc"), (0.3, "lo"), (0.5, "hi"))])
    u = unit_draw(F.concat(F.col("control"), F.col("n_nationkey").cast("string")))
    ctl = n.select("*", F.explode(F.array(*[F.lit(x) for x in ("background", "scramble", "acquisition", "confound")])).alias("control")) \
        .filter((u > 0.1) & (F.col("n_nationkey") % 6 != 5)).select(*key, "control", (0.2 + 0.6 * u).alias("lo"), (0.3 + 0.6 * u).alias("hi"))
    perm = t.table("customer").join(n, F.expr("c_nationkey = n_nationkey")).filter("n_nationkey % 6 <> 5").select(*key, (0.45 + F.col("c_acctbal") / 60000).alias("auc"))
    return head, ctl, perm


@query("control_verdicts", "cohort condition permutation background_state scramble_state acquisition_state confound_state failed verdict", """
WITH p AS (SELECT h.cohort, CASE WHEN max(h.auc) <= avg(r.auc) THEN 'fails' WHEN count(*) < 20 THEN 'inconclusive' WHEN (1 + count(*) FILTER (r.auc >= h.auc)) / CAST(1 + count(*) AS DOUBLE) <= 0.05 THEN 'survives' ELSE 'fails' END AS st FROM heads h JOIN perm_runs r ON r.cohort = h.cohort GROUP BY h.cohort),
s AS (SELECT h.cohort, h.condition, coalesce(p.st, 'absent') AS permutation,
 CASE WHEN b.lo IS NULL THEN 'absent' WHEN b.lo > 0.6 THEN 'fails' ELSE 'survives' END AS background_state, CASE WHEN s.lo IS NULL THEN 'absent' WHEN s.hi < h.lo THEN 'survives' WHEN s.lo >= h.auc THEN 'fails' ELSE 'inconclusive' END AS scramble_state,
 CASE WHEN a.lo IS NULL THEN 'absent' WHEN a.lo > 0.5 THEN 'survives' WHEN h.lo > 0.5 THEN 'fails' ELSE 'inconclusive' END AS acquisition_state, CASE WHEN c.lo IS NULL THEN 'absent' WHEN c.lo > 0.6 THEN 'flagged' ELSE 'survives' END AS confound_state
 FROM heads h LEFT JOIN p ON p.cohort = h.cohort LEFT JOIN ctrl b ON b.cohort = h.cohort AND b.control = 'background' LEFT JOIN ctrl s ON s.cohort = h.cohort AND s.control = 'scramble'
 LEFT JOIN ctrl a ON a.cohort = h.cohort AND a.control = 'acquisition' LEFT JOIN ctrl c ON c.cohort = h.cohort AND c.control = 'confound'),
f AS (SELECT *, concat_ws(',', CASE WHEN permutation = 'fails' THEN 'permutation' END, CASE WHEN background_state = 'fails' THEN 'background' END, CASE WHEN scramble_state = 'fails' THEN 'scramble' END, CASE WHEN acquisition_state = 'fails' THEN 'acquisition' END) AS failed FROM s)
SELECT *, CASE WHEN permutation = 'absent' AND background_state = 'absent' AND scramble_state = 'absent' AND acquisition_state = 'absent' THEN 'NO CONTROLS' WHEN failed <> '' THEN 'FALSIFIED'
 WHEN permutation = 'survives' AND background_state = 'survives' AND scramble_state = 'survives' AND acquisition_state = 'survives' THEN 'SURVIVES' ELSE 'NOT ESTABLISHED' END || CASE WHEN confound_state = 'flagged' THEN '+CONFOUNDED' ELSE '' END AS verdict FROM f""")
def _(t):
    return rp.control_verdicts(*control_tables(t))


AGG = "SELECT method AS cohort, condition AS scheme, fold AS seed, auc - 0.05 AS ci_lo FROM (" + auc_sql(counts_sql("runs", "method, condition, fold"), "method, condition, fold") + ") a"


@query("aggregation_verdict", "cohort scheme min_lo:d n_seeds:i n_seed_hits:i cohort_clears:b clears:b role", f"""
SELECT *, bool_or(min_lo > 0.5) OVER (PARTITION BY cohort) AS cohort_clears, min_lo > 0.5 AS clears, CASE WHEN cohort = 'm4' THEN 'positive control' ELSE 'on trial' END AS role
FROM (SELECT cohort, scheme, min(ci_lo) AS min_lo, count(*) AS n_seeds, count(*) FILTER (ci_lo > 0.5) AS n_seed_hits FROM ({AGG}) x GROUP BY 1, 2) y""")
def _(t):
    a = m.auc(t.runs, [*KEYS, "fold"]).select(F.col("method").alias("cohort"), F.col("condition").alias("scheme"), (F.col("auc") - 0.05).alias("ci_lo"))
    return rp.aggregation_verdict(a, ["m4"])


CTX = " UNION ALL ".join(f"SELECT '{c}' AS context, CAST({c} AS VARCHAR) AS st, label, balance AS score FROM sites" for c in ("segment", "nation", "subject"))


@query("context_verdict", "context n_strata:i n_both:i n_floor:i pairs_kept:d within_auc:d claim", f"""
WITH d AS (SELECT context, st, CASE WHEN CAST({H("'ctx|' || score")} % 10 AS BIGINT) < 3 THEN 1 - label ELSE label END AS label, score FROM ({CTX}) c),
a AS ({auc_sql(counts_sql('d', 'context, st'), 'context, st')}),
g AS (SELECT context, count(*) AS n_strata, count(*) FILTER (n_pos > 0 AND n_neg > 0) AS n_both, count(*) FILTER (n_pos >= 10 AND n_neg >= 10) AS n_floor, sum(n_pos * n_neg) / (CAST(sum(n_pos) AS DOUBLE) * sum(n_neg)) AS pairs_kept,
 sum(auc * n_pos * n_neg) FILTER (n_pos >= 10 AND n_neg >= 10) / sum(n_pos * n_neg) FILTER (n_pos >= 10 AND n_neg >= 10) AS within_auc FROM a GROUP BY context)
SELECT *, CASE WHEN n_both = 0 THEN 'label and context cannot be separated' WHEN n_floor = 0 THEN 'separable but underpowered' ELSE 'label can be tested inside the context' END AS claim FROM g""")
def _(t):
    flip = draw("ctx", F.col("balance")) % 10 < 3
    d = t.sites.withColumn("label", F.when(flip, 1 - F.col("label")).otherwise(F.col("label")))
    return rp.context_verdict(d, ["segment", "nation", "subject"], "balance")


UC = "SELECT subject, target, round(hour, 12) AS s, sum(label) AS p, sum(1 - label) AS n FROM uc GROUP BY ALL"
sql_view("uc", "SELECT subject, 'rare' AS target, label, hour FROM ev_deep UNION ALL SELECT subject, 'click', CAST(event_type = 'click' AS BIGINT), hour FROM ev_deep")


@query("unit_collapse_report", "target slice_auc:d slice_lo:d slice_hi:d patient_auc:d constant_auc:d gap:d", f"""
SELECT a.target, a.auc AS slice_auc, c.ci_lo AS slice_lo, c.ci_hi AS slice_hi, p.auc AS patient_auc, 0.5 AS constant_auc, a.auc - p.auc AS gap FROM ({auc_sql(counts_sql('uc', 'target', 'hour'), 'target')}) a
JOIN ({auc_sql(counts_sql('(' + subj_sql('uc', 'target', 'hour') + ')', 'target', 'mean_score'), 'target')}) p ON p.target = a.target JOIN ({ci(rep_auc(UC, 'target'), 'target')}) c ON c.target = a.target""")
def _(t):
    d = t.ev_deep.withColumn("rare", F.col("label")).withColumn("click", F.col("event_type") == "click").withColumn("score", F.col("hour").cast("double"))
    return rp.unit_collapse(d, ["rare", "click"], n_boot=B, seed=1)


@query("coverage_grid", "chunk:i first:i last:i expected:i usable:i broken:i absent:i off_grid:i", """
WITH p AS (SELECT o_custkey AS id, max(CAST(o_totalprice > 100000 AS INT)) AS u FROM orders GROUP BY 1), g AS (SELECT i, u, (i - 1) // 100 AS chunk FROM range(1, 1201) r(i) LEFT JOIN p ON p.id = i)
SELECT chunk, min(i) AS first, max(i) AS last, count(*) AS expected, count(*) FILTER (u = 1) AS usable, count(*) FILTER (u = 0) AS broken, count(*) FILTER (u IS NULL) AS absent, (SELECT count(*) FROM p WHERE id NOT BETWEEN 1 AND 1200) AS off_grid FROM g GROUP BY chunk""")
def _(t):
    o = t.table("orders").select(F.col("o_custkey").alias("id"), (F.col("o_totalprice") > 100000).alias("usable"))
    return rp.coverage_grid(o, 1200, 100)


# ------------------------------------------------------------------ streams

@query("stream_run_ingest", "run auc:d n_pos:i n_neg:i", auc_sql(counts_sql("(SELECT method AS run, score, label FROM run2)", "run"), "run"))
def _(t):
    land, counts = folder(t, "land"), folder(t, "counts")
    d = arms(t).select(F.col("method").alias("run"), "subject", "row_id", "label", "score")
    files = max(4, -(-8 * t.table("events").count() // TASK_ROWS))  # eight arms; more files from a larger table
    d.repartition(files, "row_id").write.json(land)
    d.filter("row_id % 10 = 0").write.mode("append").json(land)  # some rows land twice
    ingest.run_ingest(t.spark, land, counts, folder(t, "ckpt"), files_per_trigger=files * 3 // 4).awaitTermination()
    return ingest.live_auc(t.spark, counts)


LED = "SELECT event_id AS seq, CAST(user_id % 20 AS VARCHAR) AS cohort, event_type AS control, CASE WHEN value > 60 THEN 'begin' WHEN value > 30 THEN 'fail' ELSE 'note' END AS kind FROM events"


@query("stream_failure_ledger", "cohort control began:i n_fail:i n_note:i updated:i failed:b attempted:b", f"""
WITH e AS ({LED}), b AS (SELECT *, max(CASE WHEN kind = 'begin' THEN seq END) OVER (PARTITION BY cohort, control) AS began FROM e)
SELECT cohort, control, max(began) AS began, count(*) FILTER (kind = 'fail' AND seq > coalesce(began, -1)) AS n_fail, count(*) FILTER (kind = 'note' AND seq > coalesce(began, -1)) AS n_note, max(seq) AS updated,
 count(*) FILTER (kind = 'fail' AND seq > coalesce(began, -1)) > 0 AS failed, true AS attempted FROM b GROUP BY 1, 2""")
def _(t):
    land, state = folder(t, "land"), folder(t, "ledger")
    e = t.table("events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 20).cast("string").alias("cohort"), F.col("event_type").alias("control"),
                                 F.when(F.col("value") > 60, "begin").when(F.col("value") > 30, "fail").otherwise("note").alias("kind"))
    cuts = e.approxQuantile("seq", [0.33, 0.67], 0.01)  # three landings in order
    for part in (f"seq < {cuts[0]}", f"seq >= {cuts[0]} AND seq < {cuts[1]}", f"seq >= {cuts[1]}"):
        e.filter(part).coalesce(1).write.mode("append").json(land)
        ingest.failure_ledger(t.spark, land, state, state + "-ckpt", 1000).awaitTermination()
    return ingest.latest_ledger(t.spark, state)


@query("stream_resumable_measure", "file n:i total:d", "SELECT CAST(l_orderkey AS VARCHAR) AS file, count(*) AS n, sum(v * 2) AS total FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS v FROM lineitem GROUP BY 1, 2) q GROUP BY 1")
def _(t):
    land, out = folder(t, "land"), folder(t, "measured")
    d = t.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("value")).select(
        F.col("l_orderkey").cast("string").alias("file"), F.col("l_linenumber").cast("bigint").alias("slice"), "value")
    for part in ("slice % 2 = 0", "slice % 2 = 1 OR slice = 2"):  # a second landing repeats some slices
        d.filter(part).write.mode("append").json(land)
        ingest.resumable_measure(t.spark, land, out, out + "-ckpt", F.col("value") * 2).awaitTermination()
    return t.spark.read.parquet(out).groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.sum("measured").alias("total"))
