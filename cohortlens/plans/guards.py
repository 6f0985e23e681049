"""Queries: integrity guards on tables with planted and natural violations."""

from pyspark.sql import functions as F

from ..functions.draws import draw, unit_draw
from ..functions.prefix import tasks_for
from ..operators import guards as g
from ..operators import splits as s
from .registry import query
from .splits import li_cv, two_arm
from .views import H, U, sql_view

# rows, not subjects, dealt to arms: leaks on purpose
sql_view("leaky", f"SELECT *, CASE WHEN {U(chr(39) + 'leak|' + chr(39) + ' || volume')} < 0.02 THEN 'test' ELSE 'training' END AS split FROM ev_slices")


def leaky(t):
    return t.ev_slices.withColumn("split", F.when(unit_draw("leak", F.col("volume")) < 0.02, "test").otherwise("training"))


@query("no_span_guard", "unit id column_name n_arms:i arms", """
SELECT 'subject' AS unit, subject AS id, 'split' AS column_name, count(DISTINCT split) AS n_arms, string_agg(DISTINCT split, ',' ORDER BY split) AS arms
FROM leaky GROUP BY subject HAVING count(DISTINCT split) > 1""")
def _(t):
    return g.no_span_guard(leaky(t), ["split"], ["subject", "volume"]).withColumnRenamed("column", "column_name")


@query("cv_partition_guard", "subject rule", f"""
WITH d AS (SELECT e.subject, o AS outer_fold, CASE WHEN e.subject LIKE '%7' AND o = 1 AND role = 'test' THEN 'training' ELSE role END AS role, fold
  FROM (SELECT DISTINCT subject FROM li_elig WHERE ok) e JOIN li_fold f ON e.subject = f.subject, range(3) x(o) JOIN li_roles r ON r.outer_fold = x.o AND r.subject = e.subject)
SELECT subject, 'not tested once' AS rule FROM d GROUP BY subject HAVING sum(CASE WHEN role = 'test' THEN 1 ELSE 0 END) <> 1""")
def _(t):
    d = li_cv(t)
    bad = F.col("subject").endswith("7") & (F.col("cv1_split") == "test")
    d = d.withColumn("cv1_split", F.when(bad, "training").otherwise(F.col("cv1_split")))
    return g.cv_partition_guard(d, 3, F.col("quantity") > 10)


@query("train_test_overlap", "partition:i subject", """
SELECT 0 AS partition, subject FROM leaky GROUP BY subject HAVING count(DISTINCT split) > 1""")
def _(t):
    d = leaky(t).select(F.lit(0).alias("partition"), "subject",
                        F.when(F.col("split") == "test", "test").otherwise("train").alias("role"))
    return g.train_test_overlap(d)


@query("index_coherence", "rule n_bad:i", """
WITH d AS (SELECT l_orderkey * 10 + l_linenumber AS idx, CAST(l_suppkey AS VARCHAR) AS subject, l_partkey AS patient,
                  CASE WHEN l_tax > 0.07 THEN NULL WHEN l_tax > 0.05 THEN 2 ELSE 1 END AS label FROM lineitem)
SELECT 'null_idx' AS rule, count(*) FILTER (idx IS NULL) AS n_bad FROM d
UNION ALL SELECT 'null_subject', count(*) FILTER (subject IS NULL) FROM d
UNION ALL SELECT 'null_patient', count(*) FILTER (patient IS NULL) FROM d
UNION ALL SELECT 'null_label', count(*) FILTER (label IS NULL) FROM d
UNION ALL SELECT 'not_binary', count(*) FILTER (NOT coalesce(label IN (0, 1), false)) FROM d
UNION ALL SELECT 'duplicate_idx', count(*) - count(DISTINCT idx) FROM d
UNION ALL SELECT 'patient_in_two_subjects', count(*) FROM (SELECT patient FROM d GROUP BY patient HAVING count(DISTINCT subject) > 1) q""")
def _(t):
    d = t.table("lineitem").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), F.col("l_suppkey").cast("string").alias("subject"),
        F.col("l_partkey").alias("patient"),
        F.when(F.col("l_tax") > 0.07, None).when(F.col("l_tax") > 0.05, 2).otherwise(1).alias("label"))
    return g.index_coherence(d)


@query("trainable_guard", "split problem", """
SELECT w AS split, CASE WHEN n IS NULL THEN 'empty' ELSE 'single-class' END AS problem
FROM (VALUES ('training'), ('validation'), ('test')) v(w) LEFT JOIN (
  SELECT split, count(*) AS n, count(DISTINCT label) AS k FROM (SELECT split, CASE WHEN split = 'test' THEN 0 ELSE label END AS label FROM two_arm) a GROUP BY split) b ON w = split
WHERE n IS NULL OR (w IN ('training', 'test') AND k < 2)""")
def _(t):
    d = two_arm(t).withColumn("label", F.when(F.col("split") == "test", 0).otherwise(F.col("label")))
    return g.trainable_guard(d)


@query("design_kind", "kind n_subjects:i n_mixed:i paired:b", """
SELECT kind, count(*) AS n_subjects, count(*) FILTER (mixed) AS n_mixed, bool_and(mixed) AS paired FROM (
  SELECT 'rare' AS kind, subject, min(label) <> max(label) AS mixed FROM ev_deep GROUP BY subject
  UNION ALL SELECT 'error', subject, min(label) <> max(label) FROM ev_errors GROUP BY subject) q GROUP BY kind""")
def _(t):
    from .geometry import ev_errors
    both = t.ev_deep.select("subject", "label", F.lit("rare").alias("kind")).unionByName(
        ev_errors(t).select("subject", "label", F.lit("error").alias("kind")))
    return g.design_kind(both, keys=["kind"])


def files(t):
    return t.files.withColumn("canonical", F.col("dir") == F.col("name_dir")).withColumn(
        "path", F.concat_ws("#", "path", F.col("page_id").cast("string")))


sql_view("file_rows", "SELECT * REPLACE (path || '#' || page_id AS path), dir = name_dir AS canonical FROM files")


@query("dedup_basename", "path basename kept_path is_kept:b n_copies:i", """
SELECT path, basename, kept_path, path = kept_path AS is_kept, n_copies FROM (
  SELECT path, basename, first_value(path) OVER (PARTITION BY basename ORDER BY canonical DESC, path) AS kept_path,
         count(*) OVER (PARTITION BY basename) AS n_copies FROM file_rows) q""")
def _(t):
    return g.dedup_basename(files(t))


@query("dedup_identity", "path state", """
SELECT path, CASE WHEN rn > 1 THEN 'identical copy' WHEN path = first THEN 'first' ELSE 'kept repeat' END AS state
FROM (SELECT path, row_number() OVER (PARTITION BY dir, name_dir, fp ORDER BY path) AS rn, min(path) OVER (PARTITION BY dir, name_dir) AS first
      FROM (SELECT *, bytes % 97 AS fp FROM file_rows) a) q""")
def _(t):
    return g.dedup_identity(files(t).withColumn("fingerprint", F.col("bytes") % 97), ["dir", "name_dir"])


@query("dedup_exam", "path exam kept_path is_kept:b n_copies:i", """
SELECT path, exam, min(path) OVER (PARTITION BY exam) AS kept_path, path = min(path) OVER (PARTITION BY exam) AS is_kept,
       count(*) OVER (PARTITION BY exam) AS n_copies
FROM (SELECT path, coalesce(nullif(CASE WHEN page_id % 3 = 0 THEN '' ELSE basename END, ''), '__no_id__' || path) AS exam FROM file_rows) q""")
def _(t):
    d = files(t).withColumn("measurement_id", F.when(F.col("page_id") % 3 == 0, "").otherwise(F.col("basename")))
    return g.dedup_exam(d)


@query("disjoint_collections", "basename n_collections:i", """
SELECT basename, count(DISTINCT host) AS n_collections FROM files GROUP BY basename HAVING count(DISTINCT host) > 1""")
def _(t):
    return g.disjoint_collections(t.files, collection="host")


@query("first_seen_dedup", "k:i month:i first_block:i", """
SELECT k, month, first_block FROM (SELECT DISTINCT l_partkey AS k, month(l_shipdate) AS month, min(month(l_shipdate)) OVER (PARTITION BY l_partkey) AS first_block
  FROM lineitem) q WHERE month > first_block""")
def _(t):
    d = t.table("lineitem").select(F.col("l_partkey").alias("k"), F.month("l_shipdate").alias("month")).distinct()
    return g.first_seen_dedup(d, "k", "month")


@query("nesting_audit", "n_rows:i series_in_many_study:i study_in_many_patient:i patient_with_many_study:i patient_with_many_series:i series_without_lookup:i", """
WITH d AS (SELECT l_partkey AS series, l_orderkey AS study, o_custkey AS patient FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT (SELECT count(*) FROM d) AS n_rows,
  (SELECT count(*) FROM (SELECT series FROM d GROUP BY series HAVING count(DISTINCT study) > 1) a) AS series_in_many_study,
  (SELECT count(*) FROM (SELECT study FROM d GROUP BY study HAVING count(DISTINCT patient) > 1) a) AS study_in_many_patient,
  (SELECT count(*) FROM (SELECT patient FROM d GROUP BY patient HAVING count(DISTINCT study) > 1) a) AS patient_with_many_study,
  (SELECT count(*) FROM (SELECT patient FROM d GROUP BY patient HAVING count(DISTINCT series) > 1) a) AS patient_with_many_series,
  (SELECT count(DISTINCT series) FROM d WHERE series NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)) AS series_without_lookup""")
def _(t):
    tasks = tasks_for(t.table("lineitem"))
    d = (t.table("lineitem").select(F.col("l_partkey").alias("series"), F.col("l_orderkey").alias("study")).repartition(tasks, "study")
         .join(t.table("orders").select(F.col("o_orderkey").alias("study"), F.col("o_custkey").alias("patient")).repartition(tasks, "study"), "study"))
    look = t.table("part").filter("p_size > 10").select(F.col("p_partkey").alias("series"))
    return g.nesting_audit(d, lookup=look)


@query("release_reconcile", "in_both:i only_official:i only_mirror:i differ_quality:i differ_toxic:i any_not_or:i conflicting:i", f"""
WITH o AS (SELECT doc_id, 'quality' AS kind, quality AS label FROM doc_labels UNION ALL SELECT doc_id, 'toxic', toxic FROM doc_labels
  UNION ALL SELECT doc_id, 'any', greatest(quality, toxic) FROM doc_labels
  UNION ALL SELECT doc_id, 'quality', 1 - quality FROM doc_labels WHERE doc_id % 50 = 3),
clash AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, kind FROM o GROUP BY 1, 2 HAVING min(label) <> max(label)) c),
w AS (SELECT doc_id, max(CASE WHEN kind = 'quality' THEN label END) AS quality, max(CASE WHEN kind = 'toxic' THEN label END) AS toxic, max(CASE WHEN kind = 'any' THEN label END) AS any_l
  FROM o WHERE doc_id NOT IN (SELECT doc_id FROM clash) GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN {U("'mir|' || doc_id")} < 0.1 THEN 1 - quality ELSE quality END AS quality, toxic FROM doc_labels WHERE doc_id % 9 <> 0)
SELECT count(*) FILTER (w.doc_id IS NOT NULL AND m.doc_id IS NOT NULL) AS in_both, count(*) FILTER (m.doc_id IS NULL) AS only_official,
  count(*) FILTER (w.doc_id IS NULL) AS only_mirror, count(*) FILTER (w.quality <> m.quality) AS differ_quality,
  count(*) FILTER (w.toxic <> m.toxic) AS differ_toxic, count(*) FILTER (any_l <> greatest(w.quality, w.toxic)) AS any_not_or,
  (SELECT count(*) FROM clash) AS conflicting FROM w FULL OUTER JOIN m ON w.doc_id = m.doc_id""")
def _(t):
    d = t.doc_labels
    long = d.select("doc_id", F.inline(F.array(
        F.struct(F.lit("quality").alias("kind"), F.col("quality").alias("label")),
        F.struct(F.lit("toxic").alias("kind"), F.col("toxic").alias("label")),
        F.struct(F.lit("any").alias("kind"), F.greatest("quality", "toxic").alias("label"))))).unionByName(
        d.filter("doc_id % 50 = 3").select("doc_id", F.lit("quality").alias("kind"), (1 - F.col("quality")).alias("label")))
    mirror = d.filter("doc_id % 9 <> 0").select(
        "doc_id", F.when(unit_draw("mir", F.col("doc_id")) < 0.1, 1 - F.col("quality")).otherwise(F.col("quality")).alias("quality"),
        "toxic", F.greatest("quality", "toxic").alias("any"))
    return g.release_reconcile(long, mirror, "doc_id", ["quality", "toxic", "any"])


@query("join_accounting", "labelled_no_data:i data_no_label:i matched:i example_data_no_label:i n_minus_one:i", """
SELECT (SELECT count(*) FROM labels WHERE doc_id % 13 = 0) AS labelled_no_data,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 13 <> 0) AS data_no_label,
  (SELECT count(*) FROM labels WHERE doc_id % 13 <> 0) AS matched,
  (SELECT min(doc_id) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 13 <> 0) AS example_data_no_label,
  (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 13 <> 0) AS n_minus_one""")
def _(t):
    lab = t.table("labels").select("doc_id", F.col("quality").cast("long").alias("label"))
    counts, rows = g.join_accounting(lab, t.table("documents").filter("doc_id % 13 <> 0").select("doc_id", "lang"), "doc_id")
    return counts.crossJoin(F.broadcast(rows.agg(F.count_if(F.col("label") == -1).alias("n_minus_one"))))


@query("slice_index_check", "volume:i depth:i last:i", """
SELECT d.volume, depth, last FROM (SELECT conv_id AS volume, count(*) + conv_id % 2 AS depth FROM conversations GROUP BY conv_id) d
LEFT JOIN (SELECT volume, min(slice) AS first, max(slice) AS last, count(DISTINCT slice) AS n FROM (SELECT volume, slice + 1 AS slice FROM turns) a GROUP BY volume) q ON d.volume = q.volume
WHERE NOT coalesce(first = 1 AND last = depth AND n = depth, false)""")
def _(t):
    declared = t.table("conversations").groupBy(F.col("conv_id").alias("volume")).agg(
        (F.count(F.lit(1)) + F.col("conv_id") % 2).alias("depth"))
    return g.slice_index_check(t.turns.withColumn("slice", F.col("slice") + 1), declared)


@query("header_vs_array_check", "doc_id:i n_chars:i n:i", """
SELECT doc_id, n_chars, n FROM (SELECT doc_id, n_chars, length(text) - doc_id % 2 AS n FROM documents) q WHERE n_chars IS DISTINCT FROM n""")
def _(t):
    d = t.table("documents").select("doc_id", "n_chars", (F.length("text") - F.col("doc_id") % 2).alias("n"))
    return g.header_vs_array(d, "n_chars", "n")


@query("value_recheck", "n_compared:i max_delta:d mean_delta:d n_mismatch:i", """
SELECT count(*) AS n_compared, max(d) AS max_delta, avg(d) AS mean_delta, count(*) FILTER (d > 1000) AS n_mismatch FROM (
  SELECT abs(o_totalprice - s) AS d FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) l ON o_orderkey = l_orderkey) q""")
def _(t):
    a = t.table("orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("value"))
    b = t.table("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.sum("l_extendedprice").alias("value"))
    return g.value_recheck(a, b, "k", tol=1000)


# method m4 repeats some rows in a second fold, m3 loses a fold
sql_view("oof", "SELECT * FROM runs WHERE NOT (method = 'm3' AND fold = 2) UNION ALL SELECT * REPLACE ((fold + 1) % 3 AS fold) FROM runs WHERE method = 'm4' AND row_id % 100 = 0")


def oof(t):
    r = t.runs.filter(~((F.col("method") == "m3") & (F.col("fold") == 2)))
    return r.unionByName(t.runs.filter((F.col("method") == "m4") & (F.col("row_id") % 100 == 0))
                         .withColumn("fold", (F.col("fold") + 1) % 3))


@query("oof_pool", "method condition n_folds:i n_rows:i duplicate_rows:i duplicate_subjects:i missing_folds:i single_class_folds:i accepted:b n_pooled:i", """
WITH r AS (SELECT method, condition, count(DISTINCT fold) AS n_folds, count(*) AS n_rows FROM oof GROUP BY 1, 2),
dr AS (SELECT method, condition, count(*) FILTER (n > 1) AS duplicate_rows FROM (SELECT method, condition, row_id, count(*) AS n FROM oof GROUP BY 1, 2, 3) a GROUP BY 1, 2),
ds AS (SELECT method, condition, count(*) FILTER (n > 1) AS duplicate_subjects FROM (SELECT method, condition, subject, count(DISTINCT fold) AS n FROM oof GROUP BY 1, 2, 3) a GROUP BY 1, 2),
sc AS (SELECT method, condition, count(*) FILTER (n = 1) AS single_class_folds FROM (SELECT method, condition, fold, count(DISTINCT label) AS n FROM oof GROUP BY 1, 2, 3) a GROUP BY 1, 2)
SELECT *, CASE WHEN accepted THEN n_rows ELSE 0 END AS n_pooled FROM (
SELECT r.*, duplicate_rows, duplicate_subjects, single_class_folds, 3 - n_folds AS missing_folds, duplicate_rows = 0 AND duplicate_subjects = 0 AS accepted
FROM r JOIN dr USING (method, condition) JOIN ds USING (method, condition) JOIN sc USING (method, condition)) q""")
def _(t):
    pooled, rep = g.oof_pool(oof(t), ["method", "condition"], 3)
    n = pooled.groupBy("method", "condition").agg(F.count(F.lit(1)).alias("n_pooled"))
    return rep.join(n, ["method", "condition"], "left").withColumn("n_pooled", F.coalesce("n_pooled", F.lit(0)))


@query("align_pair", "pair n_rows:i only_a:i only_b:i label_clash:i accepted:b n_aligned:i", """
SELECT 'same' AS pair, count(*) AS n_rows, 0 AS only_a, 0 AS only_b, 0 AS label_clash, true AS accepted, count(*) AS n_aligned FROM runs WHERE condition = 'a'
UNION ALL SELECT 'cut', count(*), count(*) FILTER (row_id % 10 = 0), 0, 0, false, 0 FROM runs WHERE condition = 'a'""")
def _(t):
    d = t.runs.withColumn("key", F.concat_ws("|", "method", F.col("row_id").cast("string")))
    a, b = d.filter("condition = 'a'"), d.filter("condition = 'b'")  # the two sides of the pair
    out = None
    for name, right in (("same", b), ("cut", b.filter("row_id % 10 <> 0"))):
        rows, rep = g.align_pair(a, right, "key")
        d = rep.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("n_aligned")))).withColumn("pair", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out


@query("align_methods", "method n:i n_subjects:i unit", """
SELECT method, count(*) AS n, count(DISTINCT subject) AS n_subjects, 'subject' AS unit FROM run2
WHERE method NOT LIKE 'm3%' AND row_id NOT IN (SELECT row_id FROM runs WHERE row_id % 37 = 5) GROUP BY method""")
def _(t):
    r = t.runs.withColumn("method", F.concat("method", "condition")).filter("NOT (method LIKE 'm3%' AND row_id % 10 = 0)")
    r = r.withColumn("score", F.when(F.col("method").startswith("m2") & (F.col("row_id") % 37 == 5), F.lit(float("nan"))).otherwise(F.col("score")))
    rows, unit = g.align_methods(r)
    return rows.groupBy("method").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("n_subjects")).crossJoin(F.broadcast(unit))


@query("collect_methods", "method condition source:i n_folds:i note", """
WITH d AS (SELECT method, condition, CAST(row_id % 3 AS BIGINT) AS source, count(DISTINCT fold) AS n_folds FROM runs
           WHERE NOT (row_id % 3 = 0 AND method = 'm1' AND fold > 0) AND NOT (row_id % 3 = 1 AND method = 'm1' AND fold > 1) GROUP BY 1, 2, 3)
SELECT method, condition, source, n_folds, CASE WHEN n_folds < 3 THEN 'incomplete pool' WHEN i > 1 THEN 'shadowed' END AS note
FROM (SELECT *, row_number() OVER (PARTITION BY method, condition ORDER BY n_folds < 3, n_folds DESC, source) AS i FROM d) q""")
def _(t):
    r = t.runs.withColumn("source", F.col("row_id") % 3).filter(
        "NOT (source = 0 AND method = 'm1' AND fold > 0) AND NOT (source = 1 AND method = 'm1' AND fold > 1)")
    d = r.groupBy("method", "condition", "source").agg(F.countDistinct("fold").alias("n_folds"))
    return g.collect_methods(d, keys=("method", "condition"), expected=3)


@query("record_rule_violations", "item:i", """
SELECT item FROM records WHERE decision = 'excluded' AND access LIKE 'unreachable%' AND stage1 <> 'exclude'""")
def _(t):
    return g.rule_violations(t.records)
