"""Queries: splits, folds, draws, frames."""

from pyspark.sql import functions as F

from ..functions.draws import hash_unit, unit_draw
from ..functions.prefix import spread
from ..operators import splits as s
from .registry import query
from .views import S1, U, sql_view

sql_view("ev_subj", "SELECT subject, max(label) AS label FROM ev_deep GROUP BY subject")


def ranked(src, h, by="label", key="subject"):
    return (f"SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {h}, {key}) AS rank, "
            f"count(*) OVER (PARTITION BY {by}) AS size FROM {src}")


@query("hash_unit", "subject u:d", f"SELECT subject, {S1(chr(39) + '11|' + chr(39) + ' || subject')} AS u FROM ev_subj")
def _(t):
    return t.ev_deep.select("subject").distinct().withColumn("u", hash_unit(F.col("subject"), 11))


sql_view("split_base", f"""
SELECT subject, label, CASE WHEN rank - 1 < n_test THEN 'test' WHEN rank - 1 < n_test + n_val THEN 'validation' ELSE 'training' END AS split
FROM (SELECT *, least(round_even(size * 0.15::DOUBLE, 0), greatest(0, size - n_test - 1)) AS n_val
      FROM (SELECT *, least(round_even(size * 0.2::DOUBLE, 0), greatest(0, size - 1)) AS n_test
            FROM ({ranked('ev_subj', S1("'5|' || subject"))}) a) b) c
""")


@query("stratified_split", "subject label:i split", "SELECT * FROM split_base")
def _(t):
    return s.stratified_split(t.ev_deep, 5, 0.15, 0.2)


sql_view("two_arm", f"""
SELECT e.*, CASE WHEN {U("'two|' || subject")} < 0.7 THEN 'training' ELSE 'test' END AS split FROM ev_deep e
""")


def two_arm(t):
    return t.ev_deep.withColumn("split", F.when(unit_draw("two", F.col("subject")) < 0.7, "training").otherwise("test"))


@query("carve_validation", "row_id:i split_with_val", f"""
SELECT row_id, CASE WHEN split = 'training' AND p.subject IS NOT NULL THEN 'validation' ELSE split END AS split_with_val
FROM two_arm LEFT JOIN (SELECT subject FROM ({ranked("(SELECT subject, max(label) AS label FROM two_arm WHERE split = 'training' GROUP BY subject)", S1("'980|' || subject"))}) q
  WHERE rank <= least(round_even(size * 0.2::DOUBLE, 0), greatest(0, size - 1))) p ON two_arm.subject = p.subject""")
def _(t):
    return s.carve_validation(two_arm(t), 3, 0.2)


OFF = "CAST('0x' || substr(sha1('{seed}|stratum|' || label), 1, 8) AS BIGINT) % {k}"
sql_view("kfold5", f"""
SELECT subject, label, (rank - 1 + {OFF.format(seed=5, k=5)}) % 5 AS fold FROM ({ranked('ev_subj', S1("'5|' || subject"))}) q
""")
sql_view("folds5", f"SELECT subject, label, (rank - 1) % 5 AS fold FROM ({ranked('ev_subj', U(chr(39) + '0|' + chr(39) + ' || subject'))}) q")


@query("stratified_kfold", "subject label:i fold:i", "SELECT * FROM kfold5")
def _(t):
    return s.stratified_kfold(t.ev_deep, 5, 5)


@query("seeded_folds", "subject label:i fold:i", "SELECT * FROM folds5")
def _(t):
    return s.seeded_folds(t.ev_deep, 5, 0)


sql_view("li_elig", "SELECT *, quantity > 10 AS ok FROM li_slices")
sql_view("li_sub", "SELECT subject, max(label) AS label FROM li_elig WHERE ok GROUP BY subject")
sql_view("li_fold", f"SELECT subject, label, (rank - 1 + {OFF.format(seed=9, k=3)}) % 3 AS fold FROM ({ranked('li_sub', S1(chr(39) + '9|' + chr(39) + ' || subject'))}) q")
sql_view("li_roles", f"""
SELECT o AS outer_fold, subject, 'test' AS role FROM li_fold, range(3) r(o) WHERE fold = o
UNION ALL SELECT o, subject, CASE WHEN rank <= least(round_even(size * 0.2::DOUBLE, 0), greatest(0, size - 1)) THEN 'validation' ELSE 'training' END
FROM ({ranked('(SELECT f.*, o FROM li_fold f, range(3) r(o) WHERE fold <> o)', S1("(9 + 10007 * (o + 1)) || '|' || subject"), by='o, label')}) q
""")


def li_cv(t):
    return s.nested_cv_columns(t.li_slices, 3, 9, 0.2, F.col("quantity") > 10)


@query("nested_cv_columns", "row_id:i cv_fold:i cv0_split cv1_split cv2_split", """
SELECT row_id, coalesce(fold, -1) AS cv_fold, CASE WHEN ok THEN coalesce(r0.role, '') ELSE '' END AS cv0_split,
       CASE WHEN ok THEN coalesce(r1.role, '') ELSE '' END AS cv1_split, CASE WHEN ok THEN coalesce(r2.role, '') ELSE '' END AS cv2_split
FROM li_elig e LEFT JOIN li_fold f ON e.subject = f.subject
LEFT JOIN li_roles r0 ON e.subject = r0.subject AND r0.outer_fold = 0
LEFT JOIN li_roles r1 ON e.subject = r1.subject AND r1.outer_fold = 1
LEFT JOIN li_roles r2 ON e.subject = r2.subject AND r2.outer_fold = 2""")
def _(t):
    return li_cv(t)


@query("build_partitions", "scheme partition:i role n:i n_subjects:i", """
SELECT 'official' AS scheme, 0 AS partition, CASE split WHEN 'training' THEN 'train' ELSE 'test' END AS role,
       count(*) AS n, count(DISTINCT subject) AS n_subjects FROM two_arm GROUP BY ALL
UNION ALL SELECT 'folds', p, CASE WHEN fold = p THEN 'test' ELSE 'train' END, count(*), count(DISTINCT e.subject)
FROM ev_deep e JOIN folds5 f ON e.subject = f.subject, range(5) r(p) GROUP BY ALL""")
def _(t):
    from ..functions.rules import split_arm
    own = s.build_partitions(two_arm(t).withColumn("arm", split_arm(F.col("split"))), 5, 0, arm="arm")
    cv = s.build_partitions(t.ev_deep, 5, 0)
    count = lambda d, name: d.groupBy("partition", "role").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("n_subjects")).withColumn("scheme", F.lit(name))
    return count(own, "official").unionByName(count(cv, "folds"))


sql_view("mixed_official", """
SELECT e.*, CASE WHEN hour(CAST(subject AS BIGINT) * INTERVAL 1 HOUR + TIMESTAMP '2024-01-01') < 6 THEN 'test'
  WHEN hour(CAST(subject AS BIGINT) * INTERVAL 1 HOUR + TIMESTAMP '2024-01-01') < 12 THEN 'training' ELSE '' END AS official_split FROM ev_deep e
""")


def mixed_official(t):
    h = F.col("subject").cast("long") % 24
    return t.ev_deep.withColumn("official_split", F.when(h < 6, "test").when(h < 12, "training").otherwise(""))


@query("finish_cohort", "row_id:i split split_source split_with_val idx:i", f"""
WITH s AS (SELECT m.row_id, m.subject, m.label, coalesce(nullif(official_split, ''), b.split) AS split,
             CASE WHEN official_split <> '' THEN 'official' ELSE 'fallback' END AS split_source
           FROM mixed_official m JOIN split_base b ON m.subject = b.subject)
SELECT row_id, split, split_source, split AS split_with_val, row_number() OVER (ORDER BY row_id) - 1 AS idx FROM s""")
def _(t):
    return s.finish_cohort(mixed_official(t), 5, 0.15, 0.2, lead=spread(F.col("row_id")))


@query("frozen_holdout", "seed:i n_held:i n_pos_held:i n_rows_held:i", f"""
SELECT seed, count(*) AS n_held, sum(label) AS n_pos_held, sum(n) AS n_rows_held FROM (
  SELECT *, row_number() OVER (PARTITION BY seed ORDER BY {U("seed || '|' || subject")}, subject) AS rank, count(*) OVER (PARTITION BY seed) AS size
  FROM (SELECT subject, max(label) AS label, count(*) AS n FROM ev_deep GROUP BY subject) a, range(24) r(seed)) b
WHERE rank <= round_even(size * 0.3::DOUBLE, 0) GROUP BY seed""")
def _(t):
    h = s.frozen_holdout(t.ev_deep, range(24)).filter("held_out")
    subj = t.ev_deep.groupBy("subject").agg(F.max("label").alias("label"), F.count(F.lit(1)).alias("n"))
    return h.join(subj, "subject").groupBy("seed").agg(
        F.count(F.lit(1)).alias("n_held"), F.sum("label").alias("n_pos_held"), F.sum("n").alias("n_rows_held"))


@query("repeated_random_split", "draw:i arm:i n:i", f"""
SELECT draw, CASE WHEN rank <= round_even(size * 0.25::DOUBLE, 0) THEN 0 WHEN rank <= round_even(size * 0.5::DOUBLE, 0) THEN 1 ELSE 2 END AS arm, count(*) AS n
FROM (SELECT *, row_number() OVER (PARTITION BY draw ORDER BY {U("'split|' || draw || '|' || volume")}, volume) AS rank, count(*) OVER (PARTITION BY draw) AS size
      FROM (SELECT DISTINCT volume FROM ev_slices) v, range(10) r(draw)) q GROUP BY ALL""")
def _(t):
    return s.repeated_random_split(t.ev_slices, 10, (0.25, 0.25, 0.5)).groupBy("draw", "arm").agg(F.count(F.lit(1)).alias("n"))


@query("group_split_fresh", "subject stratum split", f"""
SELECT subject, priority AS stratum, CASE WHEN rank <= tr THEN 'training' WHEN rank <= tr + val THEN 'validation' ELSE 'test' END AS split
FROM (SELECT *, least(greatest(1, round_even(size * 0.6::DOUBLE, 0)), greatest(1, size - val - CASE WHEN size >= 3 THEN 1 ELSE 0 END)) AS tr
      FROM (SELECT *, CASE WHEN size >= 3 THEN greatest(1, round_even(size * 0.2::DOUBLE, 0)) ELSE 0 END AS val
            FROM ({ranked("(SELECT subject, priority FROM (SELECT subject, priority, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, priority) AS r FROM li_slices GROUP BY subject, priority) x WHERE r = 1)", U("'4|' || subject"), by='priority')}) a) b) c""")
def _(t):
    return s.group_split_fresh(t.li_slices, "priority", (0.6, 0.2, 0.2), 4)


# the greedy fold is sequential, so its SQL twin is a recursive table
def arms_sql(src):
    return f"""
WITH RECURSIVE cats AS (SELECT v, n, row_number() OVER (ORDER BY n DESC, v) AS i FROM {src}),
g(i, v, n, arm, na, nb) AS (
  SELECT i, v, n, 'a', CAST(n AS HUGEINT), CAST(0 AS HUGEINT) FROM cats WHERE i = 1
  UNION ALL SELECT c.i, c.v, c.n, CASE WHEN na <= nb THEN 'a' ELSE 'b' END,
         CASE WHEN na <= nb THEN na + c.n ELSE na END, CASE WHEN na <= nb THEN nb ELSE nb + c.n END
  FROM g JOIN cats c ON c.i = g.i + 1)
SELECT v, n, arm FROM g"""


@query("balanced_bipartition", "v n:i arm", arms_sql("(SELECT subject AS v, count(*) AS n FROM doc_labels GROUP BY subject)"))
def _(t):
    return s.balanced_arms(t.doc_labels.groupBy(F.col("subject").alias("v")).agg(F.count(F.lit(1)).alias("n")), "v")


sql_view("site_modal", "SELECT region AS subject, segment AS v FROM (SELECT region, segment, row_number() OVER (PARTITION BY region ORDER BY count(*) DESC, segment) AS r FROM sites GROUP BY region, segment) q WHERE r = 1")


@query("acquisition_holdout", "direction subject split trainable:b", f"""
WITH m AS (SELECT subject, v FROM (SELECT nation AS subject, segment AS v, row_number() OVER (PARTITION BY nation ORDER BY count(*) DESC, segment) AS r
           FROM sites GROUP BY nation, segment) q WHERE r = 1),
a AS ({arms_sql('(SELECT v, count(*) AS n FROM m GROUP BY v)')}),
d AS (SELECT direction, m.subject, CASE WHEN arm = tr THEN 'training' ELSE 'test' END AS split
      FROM m JOIN a ON m.v = a.v, (VALUES ('a2b', 'a'), ('b2a', 'b')) x(direction, tr))
SELECT d.*, trainable FROM d JOIN (
  SELECT direction, count(*) = 2 AND bool_and(two) AS trainable FROM (
    SELECT direction, split, count(DISTINCT label) > 1 AS two FROM d JOIN sites ON sites.nation = d.subject GROUP BY direction, split) y
  GROUP BY direction) z ON d.direction = z.direction""")
def _(t):
    return s.acquisition_holdout(t.sites.withColumn("subject", F.col("nation")), "segment")


@query("split_summary", "split n_rows:i n_groups:i n_pos:i", """
SELECT split, count(*) AS n_rows, count(DISTINCT subject) AS n_groups, sum(label) AS n_pos FROM two_arm GROUP BY split""")
def _(t):
    return s.split_summary(two_arm(t))


@query("inverse_class_weights", "row_id:i weight:d copies:i", f"""
SELECT row_id, weight, floor(mean) + CASE WHEN {U("'resample|0|' || row_id")} < mean - floor(mean) THEN 1 ELSE 0 END AS copies
FROM (SELECT row_id, 1.0::DOUBLE / n AS weight, all_n / CAST(2 AS DOUBLE) * (1.0::DOUBLE / n) AS mean
      FROM (SELECT row_id, count(*) OVER (PARTITION BY label) AS n, count(*) OVER () AS all_n FROM ev_deep) a) b""")
def _(t):
    return s.inverse_class_weights(t.ev_deep)


SPANS = {"overlap": (1, 15), "batch_a": (16, 100), "batch_b": (101, 185), "pilot": (186, 200), "reserve": (201, 260)}


@query("sampling_frame", "id:i position:i span assigned_to", f"""
SELECT id, position, span, CASE WHEN span = 'reserve' THEN ['batch_a', 'batch_b', 'batch_c', 'batch_d'][CAST((position - 201) % 4 + 1 AS INT)] END AS assigned_to
FROM (SELECT id, position, CASE {" ".join(f"WHEN position BETWEEN {a} AND {b} THEN '{n}'" for n, (a, b) in SPANS.items())} END AS span
      FROM (SELECT id, row_number() OVER (ORDER BY {U("'2026|' || id")}, id) AS position FROM (SELECT DISTINCT o_custkey AS id FROM orders) a) b) c""")
def _(t):
    return s.sampling_frame(t.table("orders"), "o_custkey", 2026, SPANS)


@query("frame_drift", "id:i change", """
WITH a AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate < DATE '1997-01-01'),
b AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_orderdate >= DATE '1997-01-01')
SELECT id, 'dropped' AS change FROM a WHERE id NOT IN (SELECT id FROM b)
UNION ALL SELECT id, 'added' FROM b WHERE id NOT IN (SELECT id FROM a)""")
def _(t):
    o = t.table("orders").select(F.col("o_custkey").alias("id"), "o_orderdate")
    cut = F.lit("1997-01-01").cast("timestamp")
    return s.frame_drift(o.filter(F.col("o_orderdate") < cut), o.filter(F.col("o_orderdate") >= cut), "id")


FOLD_SQL = f"""
SELECT k, fold, sum(n) AS n_subjects, CASE WHEN count(*) < 2 THEN 0 ELSE min(n) END AS min_class FROM (
  SELECT k, (rank - 1 + CAST('0x' || substr(sha1('5|stratum|' || label), 1, 8) AS BIGINT) % k) % k AS fold, label, count(*) AS n
  FROM ({ranked('{src}', S1("'5|' || subject"))}) q, {{ks}} GROUP BY 1, 2, 3) r GROUP BY k, fold"""


@query("fold_gate_sweep", "k:i min_subjects:i min_class:i all_clear:b largest_k:i", f"""
SELECT *, max(CASE WHEN all_clear THEN k END) OVER () AS largest_k FROM (
  SELECT k, min(n_subjects) AS min_subjects, min(min_class) AS min_class, bool_and(n_subjects >= 10 AND min_class >= 5) AND count(*) = k AS all_clear
  FROM ({FOLD_SQL.format(src='ev_subj', ks='range(2, 13) x(k)').replace('{src}', 'ev_subj').replace('{ks}', 'range(2, 13) x(k)')}) g GROUP BY k) h""")
def _(t):
    return s.fold_gate_sweep(t.ev_deep, 5)


@query("viable_classes", "label:i n_subjects:i n_rows:i kept:b kept_fraction:d clears_gate:b", f"""
WITH p AS (SELECT class AS label, count(DISTINCT subject) AS n_subjects, count(*) AS n_rows, count(DISTINCT subject) >= 5 * 5 AS kept FROM emb_multi GROUP BY class),
rest AS (SELECT subject, max(class) AS label FROM emb_multi WHERE class IN (SELECT label FROM p WHERE kept) GROUP BY subject),
f AS (SELECT (rank - 1 + CAST('0x' || substr(sha1('5|stratum|' || label), 1, 8) AS BIGINT) % 5) % 5 AS fold, label, count(*) AS n
      FROM ({ranked('rest', S1("'5|' || subject"))}) q GROUP BY 1, 2),
g AS (SELECT fold, sum(n) AS ns, CASE WHEN count(*) < (SELECT count(DISTINCT label) FROM rest) THEN 0 ELSE min(n) END AS mc FROM f GROUP BY fold)
SELECT p.*, (SELECT sum(CASE WHEN kept THEN n_rows ELSE 0 END) / CAST(sum(n_rows) AS DOUBLE) FROM p) AS kept_fraction,
       coalesce((SELECT bool_and(ns >= 10 AND mc >= 5 AND (SELECT count(DISTINCT label) FROM rest) > 1) FROM g), false) AS clears_gate FROM p""")
def _(t):
    return s.viable_classes(t.emb_multi.withColumn("label", F.col("class")), 5, 5)
