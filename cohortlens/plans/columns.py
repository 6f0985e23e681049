"""Queries: roles, admission, label and text rules."""

from pyspark.sql import functions as F

from ..functions import rules as r
from ..functions.draws import unit_draw
from ..operators import roles
from .registry import query
from .views import U, sql_view


@query("resolve_roles", "role column")
def _(t):
    # bound at plan time from the schema; the table supplies the row that carries the answer
    d = t.li_slices.withColumnRenamed("label", "Ground Truth")
    cm = roles.resolve_roles(d)
    pairs = F.array(*[F.struct(F.lit(k).alias("role"), F.lit(getattr(cm, k)).cast("string").alias("column"))
                      for k in ("subject", "slice", "label", "split", "volume")])
    return d.agg(F.count(F.lit(1)).alias("n")).select(F.inline(pairs))


@query("metadata_admission", "column_name admitted:b reason levels:i", """
WITH c AS (
  SELECT 'linestatus' AS c, false AS numeric, count(DISTINCT linestatus) AS n FROM li_slices
  UNION ALL SELECT 'priority', false, count(DISTINCT priority) FROM li_slices
  UNION ALL SELECT 'quantity', true, count(DISTINCT quantity) FROM li_slices
  UNION ALL SELECT 'discount', true, count(DISTINCT discount) FROM li_slices
  UNION ALL SELECT 'row_id', true, count(DISTINCT row_id) FROM li_slices),
t AS (SELECT count(*) AS n_rows, count(DISTINCT subject) AS n_subjects FROM li_slices)
SELECT c AS column_name, n >= 2 AND n <> n_rows AND (numeric OR n < n_subjects) AS admitted,
       CASE WHEN n < 2 THEN 'constant' WHEN n = n_rows THEN 'row-identifier-like'
            WHEN NOT numeric AND n >= n_subjects THEN 'identifier-like' END AS reason, n AS levels FROM c, t
UNION ALL SELECT x, false, 'role column', NULL FROM (VALUES ('subject'), ('volume'), ('slice'), ('label')) v(x)""")
def _(t):
    d = t.li_slices
    return roles.admission_table(d, roles.resolve_roles(d)).withColumnRenamed("column", "column_name")


@query("binarise_label", "row_id:i gt:i le:i eq:i among:i two:i", """
SELECT event_id AS row_id, coalesce(CAST(value > 50 AS BIGINT), 0) AS gt, coalesce(CAST(value <= 2.5 AS BIGINT), 0) AS le,
       coalesce(CAST(event_type = 'click' AS BIGINT), 0) AS eq, coalesce(CAST(hour(ts) IN (3, 4, 5) AS BIGINT), 0) AS among,
       CAST(value > 50 AS BIGINT) AS two FROM events""")
def _(t):
    e = t.table("events").select(F.col("event_id").alias("row_id"), "value", "event_type",
                                 F.hour("ts").alias("h"), (F.col("value") > 50).alias("big"))
    d = e.select("*", r.binary_label(F.col("value"), ">50").alias("gt"),
                 r.binary_label(F.col("value"), "<= 2.5").alias("le"),
                 r.binary_label(F.col("event_type"), "==click").alias("eq"),
                 r.binary_label(F.col("h"), "in:3,4,5").alias("among"))
    return roles.binarise(d, "big", out="two")[0]


# split words derived from the region of a supplier, some of them unknown
sql_view("split_words", f"""
SELECT o_orderkey AS row_id, CASE o_orderstatus WHEN 'O' THEN ' Training' WHEN 'F' THEN 'TEST'
       ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'val' ELSE 'weird' END END AS word FROM orders
""")


def split_words(t):
    return t.table("orders").select(F.col("o_orderkey").alias("row_id"), F.expr(
        "CASE o_orderstatus WHEN 'O' THEN ' Training' WHEN 'F' THEN 'TEST' "
        "ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'val' ELSE 'weird' END END").alias("word"))


@query("normalise_split", "word arm n:i", """
SELECT lower(trim(word)) AS word, CASE lower(trim(word)) WHEN 'training' THEN 'train' WHEN 'test' THEN 'test'
       WHEN 'val' THEN 'val' ELSE 'other' END AS arm, count(*) AS n FROM split_words GROUP BY 1, 2""")
def _(t):
    return (split_words(t).select(F.lower(F.trim("word")).alias("word"), r.split_arm(F.col("word")).alias("arm"))
            .groupBy("word", "arm").agg(F.count(F.lit(1)).alias("n")))


@query("normalise_split_strict", "row_id:i arm", """
SELECT row_id, CASE lower(trim(word)) WHEN 'training' THEN 'train' WHEN 'test' THEN 'test' ELSE 'val' END AS arm
FROM split_words WHERE word <> 'weird'""")
def _(t):
    d = split_words(t).filter(F.col("word") != "weird")
    return d.select("row_id", r.split_arm(F.col("word"), strict=True).alias("arm"))


@query("snap_ties", "score:d n:i", """
SELECT round(value / 3, 12) AS score, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY 1""")
def _(t):
    e = t.table("events").filter("value IS NOT NULL")
    return e.groupBy(r.snap(F.col("value") / 3).alias("score")).agg(F.count(F.lit(1)).alias("n"))


@query("clean_predictions", "n_kept:i n_dropped:i mean_score:d", """
SELECT count(*) FILTER (ok) AS n_kept, count(*) FILTER (NOT ok) AS n_dropped, avg(score) FILTER (ok) AS mean_score
FROM (SELECT value AS score, hour(ts) % 3 AS y, value IS NOT NULL AND event_id % 11 <> 0 AND hour(ts) % 3 IN (0, 1) AS ok
      FROM events) q""")
def _(t):
    e = t.table("events").select(
        (F.hour("ts") % 3).alias("y"),
        F.when(F.col("event_id") % 11 != 0, F.col("value")).otherwise(F.lit(float("nan"))).alias("score"))
    ok = r.usable(F.col("y"), F.col("score"))
    return e.agg(F.count_if(ok).alias("n_kept"), F.count_if(~F.coalesce(ok, F.lit(False))).alias("n_dropped"),
                 F.avg(F.when(ok, F.col("score"))).alias("mean_score"))


@query("confound_target_2class", "target n:i n_pos:i", """
WITH num AS (SELECT quantity AS v, count(*) AS n FROM li_slices GROUP BY 1),
cuts AS (SELECT v, abs(sum(n) OVER (ORDER BY v DESC) / CAST(sum(n) OVER () AS DOUBLE) - 0.5) AS gap,
                row_number() OVER (ORDER BY v) AS i FROM num),
cut AS (SELECT v FROM cuts WHERE i > 1 ORDER BY gap, v LIMIT 1),
cats AS (SELECT priority AS c, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, priority) AS i FROM li_slices GROUP BY 1),
arms AS (SELECT c, n, i, 'a' AS arm, n AS na, CAST(0 AS BIGINT) AS nb FROM cats WHERE i = 1)
SELECT 'linestatus' AS target, count(*) AS n, count(*) FILTER (linestatus = (SELECT max(linestatus) FROM li_slices)) AS n_pos FROM li_slices
UNION ALL SELECT 'quantity', count(*), count(*) FILTER (quantity >= (SELECT v FROM cut)) FROM li_slices""")
def _(t):
    out = None
    for c in ("linestatus", "quantity"):
        d = (roles.two_class_target(t.li_slices.select(c), c, out="y")
             .agg(F.lit(c).alias("target"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("n_pos")))
        out = d if out is None else out.unionByName(d)
    return out


@query("apply_target_rules", "row_id:i bucket:i modal:i named:i", """
SELECT row_id, CAST(quantity >= 25 AS BIGINT) AS bucket, CAST(priority = (
         SELECT priority FROM li_slices GROUP BY priority ORDER BY count(*) DESC, priority LIMIT 1) AS BIGINT) AS modal,
       CAST(linestatus = 'F' AS BIGINT) AS named FROM li_slices""")
def _(t):
    d = t.li_slices.withColumn("bucket", r.binary_label(F.col("quantity"), ">=25")) \
        .withColumn("named", r.binary_label(F.col("linestatus"), "==F"))
    return roles.equals_modal(d, "priority", "modal")


@query("class_codes", "code:i value n:i", """
SELECT coalesce(code, -1) AS code, c AS value, count(*) AS n
FROM (SELECT nullif(event_type, 'login') AS c FROM events) e
LEFT JOIN (SELECT c2, row_number() OVER (ORDER BY c2) - 1 AS code FROM (
  SELECT DISTINCT nullif(event_type, 'login') AS c2 FROM events) d WHERE c2 IS NOT NULL) k ON c = c2 GROUP BY 1, 2""")
def _(t):
    d = t.table("events").select(F.nullif("event_type", F.lit("login")).alias("value"))
    return roles.class_codes(d, "value").groupBy("code", "value").agg(F.count(F.lit(1)).alias("n"))


@query("canon_string", "row_id:i canonical prefix", """
SELECT row_id, c AS canonical, split_part(c, ' ', 1) AS prefix FROM (
  SELECT row_id, trim(regexp_replace(regexp_replace(upper(trim(institution)), '[^A-Z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS c
  FROM sites) q""")
def _(t):
    return t.sites.withColumn("canonical", r.canonical_text(F.col("institution"))) \
        .withColumn("prefix", r.first_token(F.col("canonical")))


@query("parse_key_columns", "row_id:i counter:i stem suffix kvalue:i year:i", """
SELECT c_custkey AS row_id, CAST(regexp_extract(c_name, '#([0-9]+)', 1) AS BIGINT) AS counter,
       split_part(c_name, '#', 1) AS stem, split_part(c_name, '#', 2) AS suffix,
       CAST(NULL AS BIGINT) AS kvalue, CAST(NULL AS BIGINT) AS year FROM customer
UNION ALL SELECT event_id, NULL, NULL, NULL, CAST(regexp_extract(props, '"k": ([0-9]+)', 1) AS BIGINT), year(ts) FROM events""")
def _(t):
    must = lambda c: F.when(c.isNull(), F.raise_error(F.lit("unparsed key"))).otherwise(c)
    c = t.table("customer").select(
        F.col("c_custkey").alias("row_id"),
        must(F.regexp_extract("c_name", "#([0-9]+)", 1).try_cast("bigint")).alias("counter"),
        F.substring_index("c_name", "#", 1).alias("stem"), F.substring_index("c_name", "#", -1).alias("suffix"))
    e = t.table("events").select(
        F.col("event_id").alias("row_id"),
        must(F.regexp_extract("props", '"k": ([0-9]+)', 1).try_cast("bigint")).alias("kvalue"),
        F.year(F.try_to_timestamp(F.col("ts").cast("string"))).alias("year"))
    return c.unionByName(e, allowMissingColumns=True)


@query("subject_merge_key", "row_id:i subject_id short_id", """
SELECT row_id, subject_id, 'p_' || CASE WHEN n < 10000 THEN lpad(CAST(n AS VARCHAR), 4, '0') ELSE CAST(n AS VARCHAR) END AS short_id
FROM (SELECT row_id, subject_id, h, dense_rank() OVER (ORDER BY h) AS n FROM (
  SELECT c_custkey AS row_id, CASE WHEN c_nationkey > 12 THEN 'group_' || c_nationkey ELSE c_name END AS subject_id,
         md5(CASE WHEN c_nationkey > 12 THEN 'group_' || c_nationkey ELSE c_name END) AS h FROM customer) a) b""")
def _(t):
    key = F.when(F.col("c_nationkey") > 12, F.concat(F.lit("group_"), F.col("c_nationkey").cast("string"))).otherwise(F.col("c_name"))
    d = t.table("customer").select(F.col("c_custkey").alias("row_id"), key.alias("subject_id"))
    return roles.sequential_ids(d.withColumn("h", F.md5("subject_id")), "h", "p", "short_id")


@query("qc_flag", "flag n:i", """
SELECT CASE WHEN value > 120 THEN 'mask_flooded' WHEN value < 3 THEN 'mask_empty' ELSE 'ok' END AS flag, count(*) AS n
FROM events GROUP BY 1""")
def _(t):
    return t.table("events").groupBy(r.range_flag(F.col("value"), 3, 120).alias("flag")).agg(F.count(F.lit(1)).alias("n"))


TRI = """CASE WHEN {status} = 'excluded' THEN 'NOT_APPLICABLE'
     WHEN coalesce(flag_a = 'true', false) OR coalesce(flag_b = 'true', false) THEN 'TRUE'
     WHEN coalesce(flag_a = 'false', false) AND coalesce(flag_b = 'false', false) THEN 'FALSE' ELSE 'NOT_ASSESSABLE' END"""
STATUS = """CASE WHEN decision = 'excluded' THEN 'excluded' WHEN access LIKE 'unreachable%' THEN 'eligible_unreachable'
     ELSE 'included_reachable' END"""
sql_view("coded", f"""
SELECT *, {TRI.format(status='status')} AS flag FROM (SELECT *, {STATUS} AS status FROM records) q
""")


def coded(t):
    d = t.records.withColumn("status", r.screening_status(F.col("decision"), F.col("access")))
    return d.withColumn("flag", r.any_flag([F.col("flag_a"), F.col("flag_b")], F.col("status")))


@query("tri_state_flag", "item:i flag", "SELECT item, flag FROM coded")
def _(t):
    return coded(t)


@query("status_rule", "item:i status", "SELECT item, status FROM coded")
def _(t):
    return coded(t)


def recode_with_log(records, overlay):
    """Ordered amendments to coded records, with a log of each field that changed.

    1. a recovered record takes the overlay's access; 2. a record excluded at stage 1 was never
    fetched; 3. an unreachable record is unresolved, and an exclusion code is withdrawn.
    """
    d = records.join(overlay, "item", "left")
    a1 = F.coalesce("new_access", "access")
    d = d.withColumn("a1", a1)
    d = d.withColumn("a2", F.when((F.col("stage1") == "exclude") & F.col("a1").startswith("unreachable"),
                                  "not_attempted").otherwise(F.col("a1")))
    d = d.withColumn("d2", F.when(F.col("a2").startswith("unreachable"), "unresolved").otherwise(F.col("decision")))
    step = lambda field, old, new, rule: F.when(~old.eqNullSafe(new), F.concat_ws(
        ":", F.lit(field), F.coalesce(old, F.lit("")), F.coalesce(new, F.lit("")), F.lit(rule)))
    log = F.array_compact(F.array(
        step("access", F.col("access"), F.col("a1"), "recovery"),
        step("access", F.col("a1"), F.col("a2"), "stage1"),
        step("decision", F.col("decision"), F.col("d2"), "unreachable")))
    withdrawn = F.when((F.col("d2") == "unresolved") & (F.col("decision") == "excluded"), F.col("unit"))
    return d.select("item", F.col("a2").alias("access"), F.col("d2").alias("decision"),
                    withdrawn.alias("withdrawn"), F.array_join(log, ";").alias("log"), F.size(log).alias("n_changes"))


@query("rule_recode_with_log", "item:i access decision withdrawn log n_changes:i", f"""
SELECT item, a2 AS access, d2 AS decision, CASE WHEN d2 = 'unresolved' AND decision = 'excluded' THEN unit END AS withdrawn,
       concat_ws(';', l1, l2, l3) AS log, (l1 IS NOT NULL)::INT + (l2 IS NOT NULL)::INT + (l3 IS NOT NULL)::INT AS n_changes
FROM (SELECT *, CASE WHEN access <> a1 THEN concat_ws(':', 'access', access, a1, 'recovery') END AS l1,
        CASE WHEN a1 <> a2 THEN concat_ws(':', 'access', a1, a2, 'stage1') END AS l2,
        CASE WHEN decision <> d2 THEN concat_ws(':', 'decision', decision, d2, 'unreachable') END AS l3
  FROM (SELECT *, CASE WHEN a2 LIKE 'unreachable%' THEN 'unresolved' ELSE decision END AS d2
    FROM (SELECT *, CASE WHEN stage1 = 'exclude' AND a1 LIKE 'unreachable%' THEN 'not_attempted' ELSE a1 END AS a2
      FROM (SELECT *, CASE WHEN access LIKE 'unreachable%' AND {U("'rec|' || item")} < 0.3 THEN 'full_text'
                           ELSE access END AS a1 FROM records) a) b) c) d""")
def _(t):
    overlay = (t.records.filter(F.col("access").startswith("unreachable") & (unit_draw("rec", F.col("item")) < 0.3))
               .select("item", F.lit("full_text").alias("new_access")))
    return recode_with_log(t.records, overlay)


TEXT = """'Table ' || page_id || ': ' || CASE page_id % 5 WHEN 0 THEN 'Slice-level AUC of ResNet-50 0.91'
  WHEN 1 THEN 'per-patient accuracy (%)' WHEN 2 THEN 'image-wise and patient level F1 score'
  WHEN 3 THEN 'Scan based average  precision' ELSE 'no unit here, dice' END || ' ' || substr(html, 1, 40)"""


@query("unit_metric_text_rules", "page_id:i unit metric model lead:d", f"""
SELECT page_id, CASE WHEN fine AND NOT coarse THEN 'fine' WHEN coarse AND NOT fine THEN 'coarse' END AS unit,
       CASE {" ".join(f"WHEN regexp_matches(regexp_replace(tl, '{chr(92)}s+', ' ', 'g'), '(^|[^a-z]){m}([^a-z]|$)') THEN '{m.replace(' score', '').replace('-score', '')}'" for m in r.METRICS)} END AS metric,
       regexp_replace(split_part(tl, ':', 1), '[^a-z0-9]', '', 'g') AS model,
       TRY_CAST(regexp_extract(regexp_replace(trim(replace(tl, '%', '')), '^[^0-9.\\-]*', ''), '^(-?[0-9]*\\.?[0-9]+)', 1) AS DOUBLE) AS lead
FROM (SELECT *, regexp_matches(tl, '{r.FINE}[\\s-]?(level|wise|based)') OR regexp_matches(tl, 'per[\\s-]?{r.FINE}') AS fine,
             regexp_matches(tl, '{r.COARSE}[\\s-]?(level|wise|based)') OR regexp_matches(tl, 'per[\\s-]?{r.COARSE}') AS coarse
      FROM (SELECT page_id, lower({TEXT}) AS tl FROM pages) a) b""")
def _(t):
    d = t.table("pages").withColumn("t", F.expr(TEXT))
    return d.select("page_id", r.unit_in_text(F.col("t")).alias("unit"), r.metric_in_text(F.col("t")).alias("metric"),
                    r.model_key(F.split_part("t", F.lit(":"), F.lit(1))).alias("model"),
                    r.leading_number(F.col("t")).alias("lead"))


@query("range_labels", "subject ranges", """
SELECT subject, string_agg(CASE WHEN a = b THEN lpad(CAST(a AS VARCHAR), 3, '0')
         ELSE lpad(CAST(a AS VARCHAR), 3, '0') || '-' || lpad(CAST(b AS VARCHAR), 3, '0') END, ', ' ORDER BY a) AS ranges
FROM (SELECT subject, min(k) AS a, max(k) AS b
      FROM (SELECT subject, k, k - row_number() OVER (PARTITION BY subject ORDER BY k) AS island
            FROM (SELECT DISTINCT subject, k FROM ev_deep) d) e GROUP BY subject, island) f GROUP BY subject""")
def _(t):
    return roles.range_text(t.ev_deep, ["subject"], "k")


@query("promote_fold_split", "active n:i n_dropped:i", f"""
SELECT split AS active, count(*) AS n, (SELECT count(*) FROM ev_deep WHERE {U("'cv|' || subject")} >= 0.9) AS n_dropped
FROM (SELECT CASE WHEN {U("'cv|' || subject")} < 0.5 THEN 'training' WHEN {U("'cv|' || subject")} < 0.7 THEN 'validation'
             WHEN {U("'cv|' || subject")} < 0.9 THEN 'test' END AS split FROM ev_deep) q
WHERE split IS NOT NULL GROUP BY split""")
def _(t):
    u = unit_draw("cv", F.col("subject"))
    d = t.ev_deep.withColumn("cv0_split", F.when(u < 0.5, "training").when(u < 0.7, "validation").when(u < 0.9, "test"))
    from ..operators.splits import promote_split
    kept, dropped = promote_split(d, "cv0_split")
    return kept.groupBy(F.col("split").alias("active")).agg(F.count(F.lit(1)).alias("n")).crossJoin(F.broadcast(dropped))
