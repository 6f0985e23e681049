"""Queries: sources and sinks. Files are written from the given tables and read back."""

import os
import uuid

from pyspark.sql import functions as F

from ..functions.prefix import tasks_for
from ..session import shared_dir
from ..sources import sinks
from ..sources import tables as s
from .registry import query
from .views import U, sql_view


def folder(t, name):
    return os.path.join(shared_dir(t.spark), f"cohortlens-{name}-{uuid.uuid4().hex}")


@query("scan_label_table", "row_id:i quantity:d priority", "SELECT row_id, quantity, priority FROM li_slices")
def _(t):
    path = folder(t, "labels") + ".csv"
    t.li_slices.select("row_id", "quantity", "priority").write.option("header", True).option("sep", ";").csv(path)
    return s.read_label_table(t.spark, path)


def payloads(t):
    """Run files of at most 512 predictions each, one JSON document per line, a folder per fold."""
    z = F.sort_array(F.collect_list(F.struct("row_id", "score", "label", "subject")))
    g = t.runs.groupBy("method", "condition", "fold", F.expr("row_id div 512").alias("shard")).agg(z.alias("z"))
    test = F.struct(F.col("z.score").alias("probs"), F.col("z.label").alias("labels"), F.col("z.subject").alias("patient_ids"), F.col("z.row_id").alias("cache_idx"))
    # shard 1 of m4 is a control run, shard 2 lost its condition
    doc = F.to_json(F.struct(F.col("method").alias("cohort"), F.when(~((F.col("method") == "m4") & (F.col("shard") == 2)), F.col("condition")).alias("condition"),
                             F.lit(0).alias("seed"), F.lit("full").alias("region"), F.when((F.col("method") == "m4") & (F.col("shard") == 1), "scramble").otherwise("none").alias("control"), test.alias("test")))
    path = folder(t, "runs")
    g.select(F.format_string("%s_cv%d", "method", "fold").alias("run"), doc.alias("value")).write.partitionBy("run").text(path)
    return path


KEPT = "NOT (method = 'm4' AND row_id // 512 IN (1, 2))"


@query("scan_run_payloads", "base fold:i family n_payloads:i n_predictions:i", f"""
SELECT 'run=' || method AS base, fold, 'cv' AS family, count(DISTINCT condition || '|' || row_id // 512) AS n_payloads, count(*) AS n_predictions FROM runs WHERE {KEPT} GROUP BY ALL""")
def _(t):
    d = s.read_payloads(t.spark, payloads(t), lines=True, pattern="*.txt")
    return d.groupBy("base", "fold", "family").agg(F.count(F.lit(1)).alias("n_payloads"), F.sum(F.size("test.probs")).alias("n_predictions"))


@query("explode_predictions", "cohort condition fold:i row_id:i patient_id label:i score:d", f"""
SELECT method AS cohort, condition, fold, row_id, subject AS patient_id, label, score FROM runs WHERE {KEPT}""")
def _(t):
    return s.explode_predictions(s.read_payloads(t.spark, payloads(t), lines=True, pattern="*.txt"))


@query("scan_runs_dedup", "cohort n_predictions:i", "SELECT method AS cohort, count(*) AS n_predictions FROM runs WHERE NOT (method = 'm4' AND row_id // 512 = 2) GROUP BY 1")
def _(t):
    path = payloads(t)
    d = s.read_payloads(t.spark, [path, path], keep_controls=True, lines=True, pattern="*.txt")
    return d.groupBy("cohort").agg(F.sum(F.size("test.probs")).alias("n_predictions"))


@query("manifest_scan", "dir n_files:i bytes:i n_folders:i n_misfiled:i", """
SELECT dir, count(*) AS n_files, sum(bytes) AS bytes, count(DISTINCT host) AS n_folders, count(*) FILTER (name_dir <> '' AND name_dir <> dir) AS n_misfiled FROM files GROUP BY dir""")
def _(t):
    return s.manifest(t.files)


@query("sampled_scan", "page_id:i host place:i", "SELECT page_id, host, place FROM (SELECT *, row_number() OVER (PARTITION BY host ORDER BY page_id) AS place FROM files) q WHERE place <= 2")
def _(t):
    files = t.files.withColumn("path", F.format_string("%020d", "page_id"))  # text order is the order of the ids
    return s.sampled_scan(files, 2, "host", "path")


@query("layout_census", "event_type signature n:i", """
SELECT event_type, CASE WHEN value > 50 THEN 'k,v' ELSE 'k' END AS signature, count(*) AS n FROM events GROUP BY 1, 2""")
def _(t):
    e = t.table("events").withColumn("attrs", F.when(F.col("value") > 50, F.create_map(F.lit("v"), F.lit("1"), F.lit("k"), F.col("props"))).otherwise(F.create_map(F.lit("k"), F.col("props"))))
    return s.layout_census(e, "event_type", F.col("attrs"))


sql_view("cohort", "SELECT o_orderkey AS id, '/data/' || o_orderstatus || '/f' || (o_orderkey % 3000) || '.h5' AS file, CASE WHEN o_orderkey % 700 = 5 THEN NULL ELSE 'p' || (o_orderkey % 3000 + CASE WHEN o_orderkey % 9000 = 8 THEN 1 ELSE 0 END) END AS subject_id, o_orderpriority AS priority FROM orders")


def cohort(t):
    return t.table("orders").select(F.col("o_orderkey").alias("id"), F.expr("'/data/' || o_orderstatus || '/f' || (o_orderkey % 3000) || '.h5'").alias("file"),
                                    F.expr("CASE WHEN o_orderkey % 700 = 5 THEN NULL ELSE 'p' || (o_orderkey % 3000 + CASE WHEN o_orderkey % 9000 = 8 THEN 1 ELSE 0 END) END").alias("subject_id"),
                                    F.col("o_orderpriority").alias("priority"))


@query("subject_lookup_join", "problem n_files:i", """
WITH g AS (SELECT split_part(file, '/', 4) AS b, count(DISTINCT subject_id) AS n, count(*) FILTER (subject_id IS NULL) AS nulls FROM cohort GROUP BY 1)
SELECT CASE WHEN nulls > 0 THEN 'missing subject' WHEN n <> 1 THEN 'two subjects' ELSE 'ok' END AS problem, count(*) AS n_files FROM g GROUP BY 1""")
def _(t):
    look, bad = s.subject_lookup(cohort(t))
    return bad.groupBy("problem").agg(F.count(F.lit(1)).alias("n_files")).unionByName(look.agg(F.lit("ok").alias("problem"), F.count(F.lit(1)).alias("n_files")))


@query("enrich_from_cohort", "row_id:i priority n_matched:i n_rows:i", """
WITH l AS (SELECT l_orderkey * 10 + l_linenumber AS row_id, 'f' || (l_orderkey % 4000) || '.h5' AS b FROM lineitem),
c AS (SELECT split_part(file, '/', 4) AS b, min(priority) AS priority FROM cohort GROUP BY 1), j AS (SELECT row_id, priority FROM l LEFT JOIN c ON l.b = c.b)
SELECT row_id, priority, (SELECT count(priority) FROM j) AS n_matched, (SELECT count(*) FROM j) AS n_rows FROM j""")
def _(t):
    l = t.table("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.expr("'/cache/f' || (l_orderkey % 4000) || '.h5'").alias("file"))
    d, n = s.enrich(l, cohort(t).select("file", "priority"))
    return d.crossJoin(F.broadcast(n))


@query("cluster_unit_resolution", "method cluster_unit n:i n_clusters:i", """
SELECT method, CASE WHEN method = 'm1' THEN 'given subject' WHEN method = 'm3' THEN 'patient (downgraded)' ELSE 'joined subject' END AS cluster_unit, count(*) AS n,
 count(DISTINCT CASE WHEN method = 'm3' THEN CAST(row_id % 7 AS VARCHAR) ELSE subject END) AS n_clusters FROM runs GROUP BY ALL""")
def _(t):
    r = t.runs.select("method", F.when((F.col("method") == "m3") & (F.col("row_id") % 50 == 0), -F.col("row_id") - 1).otherwise(F.col("row_id")).alias("row_id"),
                      (F.col("row_id") % 7).cast("string").alias("patient_id"), F.when(F.col("method") == "m1", F.col("subject")).alias("subject_id_given"))
    d = s.resolve_clusters(r, t.ev_deep.select("row_id", "subject"))
    return d.groupBy("method", "cluster_unit").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("cluster").alias("n_clusters"))


@query("backfill_column", "case_name status n_rows:i n_missing:i", """
SELECT 'absent' AS case_name, 'backfilled' AS status, count(*) AS n_rows, 0 AS n_missing FROM orders UNION ALL SELECT 'equal', 'already-present', count(*), 0 FROM orders UNION ALL SELECT 'other', 'conflict', count(*), 0 FROM orders""")
def _(t):
    o = t.table("orders").select("o_orderkey", "o_custkey")
    look = o.select("o_orderkey", F.col("o_custkey").alias("subject_id"))
    out = None
    for name, d in (("absent", o), ("equal", o.withColumn("subject_id", F.col("o_custkey"))), ("other", o.withColumn("subject_id", F.col("o_custkey") + 1))):
        rep = s.backfill(d, look, "o_orderkey", "subject_id")[1].withColumn("case_name", F.lit(name))
        out = rep if out is None else out.unionByName(rep)
    return out


@query("table_fingerprint", "n_rows:i mixed:i mod_sum:i same_after_shuffle:b")
def _(t):
    li = t.table("lineitem")
    a = s.table_fingerprint(li)
    b = s.table_fingerprint(li.repartition(tasks_for(li), *li.columns)).select(F.col("mixed").alias("__m"), F.col("mod_sum").alias("__s"))
    return a.crossJoin(F.broadcast(b)).withColumn("same_after_shuffle", (F.col("mixed") == F.col("__m")) & (F.col("mod_sum") == F.col("__s")))


@query("write_payload", "event_type n:i mean:d", "SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY 1")
def _(t):
    d = t.table("events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    path = folder(t, "payload")
    sinks.write_json(d, path)
    sinks.write_text(t.spark, sinks.card("Events", {"per type": d}), path + "-card")
    return t.spark.read.schema(d.schema).json(path)


@query("resumable_append", "state n:i", """
SELECT 'kept' AS state, count(*) AS n FROM lineitem WHERE l_orderkey % 4 = 0 UNION ALL SELECT 'todo', count(DISTINCT o_orderkey) FROM orders WHERE o_orderkey % 4 <> 0""")
def _(t):
    sl = t.table("lineitem").select(F.col("l_orderkey").alias("file"))
    done = t.table("orders").filter("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("file"))
    kept, todo = s.resume(sl, done, t.table("orders").select(F.col("o_orderkey").alias("file")))
    n = lambda d, x: d.agg(F.lit(x).alias("state"), F.count(F.lit(1)).alias("n"))
    return n(kept, "kept").unionByName(n(todo.distinct(), "todo"))
