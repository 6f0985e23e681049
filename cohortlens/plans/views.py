"""Label tables, rater tables and the like derived from the driver's tables.

Each view exists twice: as a DataFrame (class ``Tables``) and as a SQL fragment (``SQL_VIEWS``)
that is prepended to a cross-check query when its name occurs in it.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import draw, unit_draw
from ..functions.prefix import number_rows, tasks_for

SQL_VIEWS: dict[str, str] = {}


def sql_view(name: str, body: str) -> None:
    SQL_VIEWS[name] = body.strip()


def with_clause(sql: str) -> str:
    """WITH list of the views a query names, directly or through other views, in order."""
    def names(text):
        return set(re.findall(r"[A-Za-z_][A-Za-z_0-9]*", text)) & set(SQL_VIEWS)
    need, todo = set(), names(sql)
    while todo:
        need |= todo
        todo = set().union(*(names(SQL_VIEWS[n]) for n in todo)) - need
    if not need:
        return ""
    parts = [f"{n} AS (\n{SQL_VIEWS[n]}\n)" for n in SQL_VIEWS if n in need]
    return "WITH " + ",\n".join(parts) + "\n"


def H(text: str) -> str:
    """SQL of ``draw``: 52-bit integer of md5."""
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT)"


def U(text: str) -> str:
    """SQL of ``unit_draw``."""
    return f"({H(text)} / CAST(4503599627370496 AS DOUBLE))"


def S1(text: str) -> str:
    """SQL of ``hash_unit``: sha1 of 'seed|key' as a number in [0, 1)."""
    return f"(CAST('0x' || substr(sha1({text}), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE))"


_EV = """
SELECT event_id AS row_id, CAST(user_id AS VARCHAR) AS subject, {volume} AS volume,
       row_number() OVER (PARTITION BY {volume} ORDER BY ts, event_id) AS slice,
       CAST(event_type = 'error' AND value > 120 AS BIGINT) AS label,
       CAST(hour(ts) AS BIGINT) AS hour, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k,
       event_type, value
FROM events
"""
sql_view("ev_slices", _EV.format(
    volume="CAST(user_id AS VARCHAR) || '|' || strftime(ts, '%Y-%m-%d')"))
sql_view("ev_deep", _EV.format(volume="CAST(user_id AS VARCHAR)"))
sql_view("li_slices", """
SELECT l_orderkey * 1000 + row_number() OVER w AS row_id, CAST(o_custkey AS VARCHAR) AS subject,
       CAST(l_orderkey AS VARCHAR) AS volume, row_number() OVER w AS slice,
       CAST(l_returnflag = 'R' AS BIGINT) AS label, l_linestatus AS linestatus,
       o_orderpriority AS priority, l_quantity AS quantity, l_discount AS discount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey
WINDOW w AS (PARTITION BY l_orderkey
             ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)
""")
sql_view("doc_labels", """
SELECT d.doc_id, d.source AS subject, d.lang, d.n_chars, CAST(l.quality AS BIGINT) AS quality,
       CAST(l.toxic AS BIGINT) AS toxic
FROM documents d JOIN labels l ON d.doc_id = l.doc_id
""")
# four codings per document: the given one, two noisy ones, one from the length
sql_view("raters", f"""
SELECT doc_id AS item, 'r1' AS rater, quality AS code FROM doc_labels
UNION ALL SELECT doc_id, 'r2', CASE WHEN {U("'2|' || doc_id")} < 0.1 THEN 1 - quality ELSE quality END
FROM doc_labels
UNION ALL SELECT doc_id, 'r3', CASE WHEN {U("'3|' || doc_id")} < 0.2 THEN 1 - quality ELSE quality END
FROM doc_labels
UNION ALL SELECT doc_id, 'r4', CAST(n_chars > 500 AS BIGINT) FROM doc_labels
""")
# one record per labelled document with a screening decision, reachability and flags
sql_view("records", f"""
SELECT doc_id AS item, subject AS source, lang,
       CASE WHEN {U("'inc|' || doc_id")} < 0.45 THEN 'included' ELSE 'excluded' END AS decision,
       CASE WHEN {U("'rea|' || doc_id")} < 0.75 THEN 'full_text'
            WHEN {U("'rea|' || doc_id")} < 0.9 THEN 'unreachable_paywall' ELSE 'unreachable_other' END AS access,
       CASE WHEN {U("'st1|' || doc_id")} < 0.3 THEN 'exclude' ELSE 'include' END AS stage1,
       CASE WHEN toxic = 1 THEN 'true' WHEN {U("'fa|' || doc_id")} < 0.6 THEN 'false'
            WHEN {U("'fa|' || doc_id")} < 0.8 THEN 'unclear' END AS flag_a,
       CASE WHEN {U("'fb|' || doc_id")} < 0.1 THEN 'true' WHEN {U("'fb|' || doc_id")} < 0.8 THEN 'false' END AS flag_b,
       CASE WHEN quality = 1 THEN 'slice' WHEN {U("'un|' || doc_id")} < 0.5 THEN 'patient' ELSE 'both' END AS unit,
       CAST(floor({U("'bl|' || doc_id")} * 4) AS BIGINT) AS block
FROM doc_labels
""")
# four methods under two conditions: noise plus a share of the label, one score per row and method
sql_view("runs", f"""
SELECT e.row_id, e.subject, e.volume, e.label, m.method, m.weight, c.condition,
       CAST({H("'fold|' || e.subject")} % 3 AS BIGINT) AS fold,
       round({U("m.method || '|' || c.condition || '|' || e.row_id")} + e.label * (m.weight + c.shift)
             + 0.3 * {U("m.method || '|' || e.subject")}, 6) AS score
FROM ev_deep e
CROSS JOIN (VALUES ('m1', 0.05), ('m2', 0.15), ('m3', 0.25), ('m4', 0.35)) m(method, weight)
CROSS JOIN (VALUES ('a', 0.0), ('b', 0.1)) c(condition, shift)
""")
sql_view("sites", """
SELECT c_custkey AS row_id, CAST(c_custkey AS VARCHAR) AS subject,
       CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || ' - dept'
            WHEN c_custkey % 3 = 1 THEN c_mktsegment ELSE '  ' || c_mktsegment || ' ' END AS institution,
       CAST(c_nationkey AS BIGINT) * 10 + c_custkey % 3 + length(c_mktsegment) AS device,
       n_name AS nation, CAST(n_regionkey AS VARCHAR) AS region, c_mktsegment AS segment,
       CAST(c_acctbal > 5000 AS BIGINT) AS label, c_acctbal AS balance
FROM customer JOIN nation ON c_nationkey = n_nationkey
""")
sql_view("files", """
SELECT page_id, url AS path, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host,
       regexp_extract(url, '^[a-z]+://[^/?#]+/([^/?#]+)', 1) AS dir,
       regexp_extract(url, '([^/?#]+)([?#].*)?$', 1) AS basename,
       regexp_extract(html, 'html lang="([a-z]+)"', 1) AS name_dir,
       CAST(length(html) AS BIGINT) AS bytes
FROM pages
""")
sql_view("turns", """
SELECT conv_id AS volume, turn AS slice, role, CAST(role = 'assistant' AS BIGINT) AS label
FROM conversations
""")
sql_view("emb_multi", """
SELECT vec_id AS row_id, CAST(vec_id // 5 AS VARCHAR) AS subject, CAST(label AS BIGINT) AS class,
       (CAST(embedding[1] AS DOUBLE) - min(CAST(embedding[1] AS DOUBLE)) OVER ())
       / (max(CAST(embedding[1] AS DOUBLE)) OVER () - min(CAST(embedding[1] AS DOUBLE)) OVER ()) AS relpos
FROM embeddings
""")


class Tables:
    """The driver's tables and the views over them, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def _events(self, volume, numbered=True) -> DataFrame:
        e = self.table("events").withColumn("volume", volume)
        if numbered:
            e = number_rows(e, ["volume"], ["ts", "event_id"],
                            F.unix_date(F.to_date("ts")).cast("long"), "slice")
        return e.select(
            F.col("event_id").alias("row_id"), F.col("user_id").cast("string").alias("subject"),
            "volume", *(["slice"] if numbered else []),
            F.when((F.col("event_type") == "error") & (F.col("value") > 120), 1).otherwise(0)
            .cast("long").alias("label"),
            F.hour("ts").cast("long").alias("hour"),
            F.regexp_extract("props", "([0-9]+)", 1).cast("long").alias("k"),
            "event_type", "value")

    @cached_property
    def ev_slices(self) -> DataFrame:
        return self._events(F.concat_ws("|", F.col("user_id").cast("string"),
                                        F.date_format("ts", "yyyy-MM-dd")))

    @cached_property
    def ev_deep(self) -> DataFrame:
        return self._events(F.col("user_id").cast("string"))

    @cached_property
    def li_slices(self) -> DataFrame:
        tasks = tasks_for(self.table("lineitem"))
        li = (self.table("lineitem")
              .select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                      "l_extendedprice", "l_returnflag", "l_linestatus", "l_quantity", "l_discount")
              .repartition(tasks, "l_orderkey")
              .join(self.table("orders").select("o_orderkey", "o_custkey", "o_orderpriority").repartition(tasks, "o_orderkey"),
                    F.col("l_orderkey") == F.col("o_orderkey")))
        li = number_rows(li, ["l_orderkey"],
                         ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice"],
                         F.col("l_linenumber").cast("long"), "slice", tasks=tasks)
        return li.select(
            (F.col("l_orderkey") * 1000 + F.col("slice")).alias("row_id"),
            F.col("o_custkey").cast("string").alias("subject"),
            F.col("l_orderkey").cast("string").alias("volume"), "slice",
            (F.col("l_returnflag") == "R").cast("long").alias("label"),
            F.col("l_linestatus").alias("linestatus"), F.col("o_orderpriority").alias("priority"),
            F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"))

    @cached_property
    def doc_labels(self) -> DataFrame:
        d = self.table("documents").select("doc_id", F.col("source").alias("subject"), "lang", "n_chars")
        lab = self.table("labels").select("doc_id", F.col("quality").cast("long").alias("quality"),
                                          F.col("toxic").cast("long").alias("toxic"))
        return d.join(lab, "doc_id")

    @cached_property
    def raters(self) -> DataFrame:
        flip = lambda tag, p: F.when(unit_draw(tag, F.col("doc_id")) < p, 1 - F.col("quality")) \
            .otherwise(F.col("quality"))
        coded = F.array(
            F.struct(F.lit("r1").alias("rater"), F.col("quality").alias("code")),
            F.struct(F.lit("r2").alias("rater"), flip("2", 0.1).alias("code")),
            F.struct(F.lit("r3").alias("rater"), flip("3", 0.2).alias("code")),
            F.struct(F.lit("r4").alias("rater"), (F.col("n_chars") > 500).cast("long").alias("code")))
        return self.doc_labels.select(F.col("doc_id").alias("item"), F.inline(coded))

    @cached_property
    def records(self) -> DataFrame:
        u = lambda tag: unit_draw(tag, F.col("doc_id"))
        return self.doc_labels.select(
            F.col("doc_id").alias("item"), F.col("subject").alias("source"), "lang",
            F.when(u("inc") < 0.45, "included").otherwise("excluded").alias("decision"),
            F.when(u("rea") < 0.75, "full_text").when(u("rea") < 0.9, "unreachable_paywall")
            .otherwise("unreachable_other").alias("access"),
            F.when(u("st1") < 0.3, "exclude").otherwise("include").alias("stage1"),
            F.when(F.col("toxic") == 1, "true").when(u("fa") < 0.6, "false")
            .when(u("fa") < 0.8, "unclear").alias("flag_a"),
            F.when(u("fb") < 0.1, "true").when(u("fb") < 0.8, "false").alias("flag_b"),
            F.when(F.col("quality") == 1, "slice").when(u("un") < 0.5, "patient")
            .otherwise("both").alias("unit"),
            F.floor(u("bl") * 4).alias("block"))

    @cached_property
    def events_plain(self) -> DataFrame:
        """``ev_deep`` without its slices, so no event is numbered."""
        return self._events(F.col("user_id").cast("string"), numbered=False)

    @cached_property
    def runs(self) -> DataFrame:
        """No slice is read here, so no event is numbered."""
        return self.scored(self.events_plain)

    def scored_wide(self, events: DataFrame) -> DataFrame:
        """(method, row_id, subject, label, a, b): the scores of ``scored`` under both conditions side by side."""
        conditions = (("a", 0.0), ("b", 0.1))
        score = lambda m, w, c, s: F.round((unit_draw(F.lit(m), F.lit(c), F.col("row_id")) + F.col("label") * (F.lit(w) + F.lit(s))
                                            + 0.3 * unit_draw(m, F.col("subject"))), 6)
        arms = F.array(*[F.struct(F.lit(m).alias("method"), *[score(m, w, c, s).alias(c) for c, s in conditions])
                         for m, w in (("m1", 0.05), ("m2", 0.15), ("m3", 0.25), ("m4", 0.35))])
        return events.select("row_id", "subject", "label", F.inline(arms))

    def scored(self, events: DataFrame, *more: str) -> DataFrame:
        """``events`` copied to their arms and scored; what is drawn per subject is drawn before. ``more``: columns to keep."""
        methods = (("m1", 0.05), ("m2", 0.15), ("m3", 0.25), ("m4", 0.35))
        arms = F.array(*[
            F.struct(F.lit(m).alias("method"), F.lit(w).alias("weight"),
                     F.lit(c).alias("condition"), F.lit(s).alias("shift"), F.col(f"__u_{m}").alias("__u"))
            for m, w in methods for c, s in (("a", 0.0), ("b", 0.1))])
        e = events.select(
            *more, "row_id", "subject", "volume", "label", (draw("fold", F.col("subject")) % 3).alias("fold"),
            *[unit_draw(m, F.col("subject")).alias(f"__u_{m}") for m, _ in methods])
        e = e.select(*more, "row_id", "subject", "volume", "label", "fold", F.inline(arms))
        score = (unit_draw(F.col("method"), F.col("condition"), F.col("row_id"))
                 + F.col("label") * (F.col("weight") + F.col("shift")) + 0.3 * F.col("__u"))
        return e.select(*more, "row_id", "subject", "volume", "label", "method", "weight", "condition", "fold",
                        F.round(score, 6).alias("score"))

    @cached_property
    def sites(self) -> DataFrame:
        c = self.table("customer").join(self.table("nation"), F.expr("c_nationkey = n_nationkey"))
        return c.select(
            F.col("c_custkey").alias("row_id"), F.col("c_custkey").cast("string").alias("subject"),
            F.expr("CASE WHEN c_custkey % 3 = 0 THEN lower(c_mktsegment) || ' - dept' "
                   "WHEN c_custkey % 3 = 1 THEN c_mktsegment "
                   "ELSE '  ' || c_mktsegment || ' ' END").alias("institution"),
            F.expr("bigint(c_nationkey) * 10 + c_custkey % 3 + length(c_mktsegment)").alias("device"),
            F.col("n_name").alias("nation"), F.col("n_regionkey").cast("string").alias("region"),
            F.col("c_mktsegment").alias("segment"),
            (F.col("c_acctbal") > 5000).cast("long").alias("label"), F.col("c_acctbal").alias("balance"))

    @cached_property
    def files(self) -> DataFrame:
        return self.table("pages").select(
            "page_id", F.col("url").alias("path"),
            F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("host"),
            F.regexp_extract("url", "^[a-z]+://[^/?#]+/([^/?#]+)", 1).alias("dir"),
            F.regexp_extract("url", "([^/?#]+)([?#].*)?$", 1).alias("basename"),
            F.regexp_extract("html", 'html lang="([a-z]+)"', 1).alias("name_dir"),
            F.length("html").cast("long").alias("bytes"))

    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations").select(
            F.col("conv_id").alias("volume"), F.col("turn").alias("slice"), "role",
            (F.col("role") == "assistant").cast("long").alias("label"))

    @cached_property
    def emb_multi(self) -> DataFrame:
        e = self.table("embeddings").select(
            F.col("vec_id").alias("row_id"), F.expr("string(vec_id div 5)").alias("subject"),
            F.col("label").cast("long").alias("class"),
            F.expr("double(embedding[0])").alias("x"))
        span = e.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))  # one row
        return (e.crossJoin(F.broadcast(span))
                .select("row_id", "subject", "class",
                        ((F.col("x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).alias("relpos")))
