"""Queries: positions, bins, runs, spines."""

from pyspark.sql import functions as F

from ..operators import geometry as g
from .registry import query
from .views import H, U, sql_view

REL = """
SELECT *, CASE WHEN hi = lo THEN 0.0::DOUBLE ELSE CAST(slice - lo AS DOUBLE) / (hi - lo) END AS relpos
FROM (SELECT *, min(slice) OVER (PARTITION BY volume) AS lo, max(slice) OVER (PARTITION BY volume) AS hi,
             count(*) OVER (PARTITION BY volume) AS n_slices FROM {src}) q
"""
sql_view("ev_pos", REL.format(src="ev_deep"))
sql_view("li_pos", REL.format(src="li_slices"))


sql_view("ev_errors", "SELECT * REPLACE (CAST(event_type = 'error' AS BIGINT) AS label) FROM ev_deep")


def ev_errors(t):
    return t.ev_deep.withColumn("label", (F.col("event_type") == "error").cast("long"))


def bin_sql(expr, n):
    return f"CAST(least(floor({expr} * {float(n)}::DOUBLE), {n - 1}) AS BIGINT)"


@query("relative_position", "row_id:i volume slice:i relpos:d",
       "SELECT row_id, volume, slice, relpos FROM li_pos")
def _(t):
    return g.relative_position(t.li_slices)


@query("supplied_position", "row_id:i relpos:d", """
SELECT row_id, CASE WHEN lo < 0 OR hi > 1 THEN (r - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1 END) ELSE r END AS relpos
FROM (SELECT event_id AS row_id, value AS r, min(value) OVER () AS lo, max(value) OVER () AS hi
      FROM events WHERE value IS NOT NULL) q""")
def _(t):
    e = t.table("events").select(F.col("event_id").alias("row_id"), F.col("value").cast("string").alias("v"))
    return g.supplied_position(e, "v")


@query("volume_size", "row_id:i n_slices:i", "SELECT row_id, n_slices FROM li_pos")
def _(t):
    return g.volume_size(t.li_slices)


@query("position_bins", "row_id:i bin5:i bin20:i",
       f"SELECT row_id, {bin_sql('relpos', 5)} AS bin5, {bin_sql('relpos', 20)} AS bin20 FROM ev_pos")
def _(t):
    d = g.relative_position(t.ev_deep)
    return g.position_bins(g.position_bins(d, 5, out="bin5"), 20, out="bin20")


@query("canonical_bins", "n_slices:i n_occupied:i top_bin:i spans_all:b", """
SELECT n_slices, count(DISTINCT bin) AS n_occupied, max(bin) AS top_bin, count(DISTINCT bin) = 20 AS spans_all FROM (
  SELECT n_slices, CASE WHEN n_slices <= 1 THEN 0 ELSE least((20 * k) // greatest(n_slices - 1, 1), 19) END AS bin
  FROM (SELECT n_slices, unnest(range(0, greatest(n_slices, 1))) AS k
        FROM (SELECT DISTINCT n_slices FROM (SELECT count(*) AS n_slices FROM ev_deep GROUP BY volume) a) b) c) d
GROUP BY n_slices""")
def _(t):
    depths = t.ev_deep.groupBy("volume").agg(F.count(F.lit(1)).alias("n_slices"))
    return g.canonical_spans(depths, 20)


@query("centrality_score", "row_id:i score:d", "SELECT row_id, -abs(relpos - 0.5) AS score FROM ev_pos")
def _(t):
    return g.relative_position(t.ev_deep).withColumn("score", g.centrality_score(F.col("relpos")))


@query("patient_depth", "subject n_rows:i n_volumes:i depth:i", """
SELECT subject, count(*) AS n_rows, count(DISTINCT volume) AS n_volumes,
       count(*) // count(DISTINCT volume) AS depth FROM ev_slices GROUP BY subject""")
def _(t):
    return g.patient_depth(t.ev_slices)


@query("contiguity_audit", "volume first:i last:i n_rows:i contiguous:b n_missing:i unit_step_share:d", """
SELECT volume, first, last, n_rows, contiguous, CASE WHEN contiguous THEN 0 ELSE last - n_rows END AS n_missing,
       unit_step_share
FROM (SELECT volume, min(slice) AS first, max(slice) AS last, count(*) AS n_rows,
             min(slice) = 1 AND max(slice) = count(*) AND count(DISTINCT slice) = count(*) AS contiguous,
             CASE WHEN count(*) > 1 THEN CAST(sum(step) AS DOUBLE) / (count(*) - 1) END AS unit_step_share
      FROM (SELECT volume, slice, CASE WHEN slice - lag(slice) OVER (PARTITION BY volume ORDER BY slice) = 1
                                       THEN 1 ELSE 0 END AS step
            FROM turns) a GROUP BY volume) b""")
def _(t):
    return g.contiguity_audit(t.turns)


RUNS = """
SELECT {by} {v} AS volume, count(*) AS n, sum(label) AS n_pos,
       sum(CASE WHEN label = 1 AND coalesce(prev, 0) = 0 THEN 1 ELSE 0 END) AS observed
FROM (SELECT *, lag(label) OVER (PARTITION BY {by} {v} ORDER BY {pos}) AS prev FROM {src}) q
GROUP BY {by} {v} HAVING sum(label) >= 3
"""
TEST = """
SELECT {by} count(*) AS n_series, avg(observed) AS observed, avg(expected) AS expected,
       avg(observed) / avg(expected) AS ratio
FROM (SELECT *, CAST(n_pos * (n - n_pos + 1) AS DOUBLE) / n AS expected FROM ({runs}) r) s {group}
"""


@query("run_length_test", "n_series:i observed:d expected:d ratio:d",
       TEST.format(by="", runs=RUNS.format(by="", v="volume", pos="slice", src="ev_errors"), group=""))
def _(t):
    return g.run_length_test(ev_errors(t))


_KEY = "CAST(fraction AS VARCHAR) || '|' || draw || '|' || volume || '|' || rank"


@query("order_corruption_curve", "fraction:d n_draws:i ratio_mean:d ratio_sd:d ratio_min:d ratio_max:d z:d", f"""
SELECT fraction, count(*) AS n_draws, avg(ratio) AS ratio_mean, stddev_samp(ratio) AS ratio_sd,
       min(ratio) AS ratio_min, max(ratio) AS ratio_max,
       (min(base) - avg(ratio)) / (CASE WHEN stddev_samp(ratio) > 1e-9 THEN stddev_samp(ratio) END) AS z
FROM (SELECT *, max(CASE WHEN fraction = 0 THEN ratio END) OVER () AS base FROM (
{TEST.format(by='fraction, draw,', group='GROUP BY fraction, draw',
             runs=RUNS.format(by='fraction, draw,', v='volume', pos='newpos', src='moved_all'))}) t) u
GROUP BY fraction""")
def _(t):
    c = g.corrupted_order(ev_errors(t).select("volume", "slice", "label"), [0.0, 0.25, 0.5, 1.0], 3, seed=7)
    r = g.run_length_test(c, by=["fraction", "draw"])
    base = r.filter(F.col("fraction") == 0).agg(F.max("ratio").alias("base"))
    return r.crossJoin(F.broadcast(base)).groupBy("fraction").agg(
        F.count(F.lit(1)).alias("n_draws"), F.avg("ratio").alias("ratio_mean"),
        F.stddev_samp("ratio").alias("ratio_sd"), F.min("ratio").alias("ratio_min"),
        F.max("ratio").alias("ratio_max"),
        ((F.min("base") - F.avg("ratio")) / F.when(F.stddev_samp("ratio") > 1e-9, F.stddev_samp("ratio"))).alias("z"))


sql_view("moved_all", f"""
WITH copies AS (
  SELECT e.volume, e.label, row_number() OVER (PARTITION BY volume, fraction, draw ORDER BY slice) AS rank,
         count(*) OVER (PARTITION BY volume, fraction, draw) AS len, fraction, draw
  FROM ev_errors e CROSS JOIN (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) f(fraction)
  CROSS JOIN (VALUES (0), (1), (2)) d(draw)),
picked AS (
  SELECT *, row_number() OVER (PARTITION BY volume, fraction, draw
           ORDER BY {U("'7|pick|' || " + _KEY)}, rank) <= round_even(fraction * len, 0) AS moving FROM copies),
src AS (SELECT *, row_number() OVER (PARTITION BY volume, fraction, draw
           ORDER BY {U("'7|place|' || " + _KEY)}, rank) AS slot FROM picked WHERE moving),
dst AS (SELECT volume, fraction, draw, rank AS newpos,
               row_number() OVER (PARTITION BY volume, fraction, draw ORDER BY rank) AS slot FROM picked WHERE moving)
SELECT volume, fraction, draw, label, rank AS newpos FROM picked WHERE NOT moving
UNION ALL
SELECT s.volume, s.fraction, s.draw, s.label, d.newpos FROM src s
JOIN dst d ON s.volume = d.volume AND s.fraction = d.fraction AND s.draw = d.draw AND s.slot = d.slot
""")

# intervals: per customer a stack of as many slices as orders, marked between two order ranks
sql_view("boxes", """
SELECT o_custkey AS volume, count(*) + 10 AS n_slices, CAST(o_custkey % 7 AS BIGINT) AS box_start,
       CAST(o_custkey % 7 + o_custkey % 4 AS BIGINT) AS box_end
FROM orders GROUP BY o_custkey
""")


def boxes(t):
    return t.table("orders").groupBy(F.col("o_custkey").alias("volume")).agg(
        (F.count(F.lit(1)) + 10).alias("n_slices")).select(
        "volume", "n_slices", (F.col("volume") % 7).alias("start"),
        (F.col("volume") % 7 + F.col("volume") % 4).alias("end"))


@query("interval_expand_label", "volume:i slice:i label:i", """
SELECT volume, slice, CASE WHEN slice BETWEEN box_start AND box_end THEN 1 ELSE 0 END AS label
FROM (SELECT *, unnest(range(0, n_slices)) AS slice FROM boxes) q
WHERE slice BETWEEN box_start AND box_end OR slice < box_start - 5 OR slice > box_end + 5""")
def _(t):
    return g.interval_expand(boxes(t))


@query("roster_expand", "volume slice:i label:i any_finding:i", """
SELECT r.volume, r.slice, coalesce(f.t, 0) AS label, CASE WHEN f.t IS NULL THEN 0 ELSE 1 END AS any_finding
FROM (SELECT volume, unnest(range(1, n + 1)) AS slice FROM (SELECT volume, count(*) AS n FROM ev_deep GROUP BY volume) a) r
LEFT JOIN (SELECT volume, slice, max(CAST(event_type = 'error' AS INT)) AS t FROM ev_deep
           WHERE event_type IN ('error', 'purchase') GROUP BY volume, slice) f
ON r.volume = f.volume AND r.slice = f.slice""")
def _(t):
    e = t.ev_deep
    roster = e.groupBy("volume").agg(F.count(F.lit(1)).alias("n_slices"))
    return g.roster_expand(roster, e.filter(F.col("event_type").isin("error", "purchase")), "error",
                           kind="event_type")


@query("even_sample", "volume slice:i", """
SELECT volume, slice FROM (
  SELECT volume, slice, i, n, list_contains(list_transform(range(0, 8), lambda j:
           CAST(round_even((n - band) // 2 + j * ((band - 1) / 7.0::DOUBLE), 0) AS BIGINT)), i) AS hit
  FROM (SELECT *, greatest(8, CAST(round_even(n * 0.5::DOUBLE, 0) AS BIGINT)) AS band
        FROM (SELECT volume, slice, row_number() OVER (PARTITION BY volume ORDER BY slice) - 1 AS i,
                     count(*) OVER (PARTITION BY volume) AS n FROM ev_deep) a) b) c
WHERE n <= 8 OR hit""")
def _(t):
    return g.even_sample(t.ev_deep, 8)


@query("shift_partner", "row_id:i partner:i partner_value:d", """
SELECT a.row_id, b.slice AS partner, b.value AS partner_value
FROM (SELECT *, CASE WHEN n <= 1 THEN NULL WHEN i + 3 < n THEN i + 3 WHEN i - 3 >= 0 THEN i - 3
                     WHEN i <> n - 1 THEN n - 1 ELSE 0 END AS j
      FROM (SELECT *, slice - 1 AS i, count(*) OVER (PARTITION BY volume) AS n FROM ev_slices) q) a
LEFT JOIN ev_slices b ON a.volume = b.volume AND b.slice = a.j + 1""")
def _(t):
    return g.shift_partner(t.ev_slices, 3)


@query("median_row", "volume slice:i value:d", """
SELECT volume, slice, value FROM (
  SELECT *, row_number() OVER (PARTITION BY volume ORDER BY slice) AS i, count(*) OVER (PARTITION BY volume) AS n
  FROM ev_deep WHERE event_type = 'click') q WHERE i = n // 2 + 1""")
def _(t):
    return g.median_row(t.ev_deep.filter(F.col("event_type") == "click"), ["volume"])


@query("modal_group_value", "subject modal n:i", """
SELECT subject, priority AS modal, n FROM (
  SELECT subject, priority, count(*) AS n, row_number() OVER (PARTITION BY subject ORDER BY count(*) DESC, priority) AS r
  FROM li_slices WHERE priority IS NOT NULL GROUP BY subject, priority) q WHERE r = 1""")
def _(t):
    return g.modal_group_value(t.li_slices, ["subject"], "priority")
