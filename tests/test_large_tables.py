"""Findings of the third round, second part: steps whose cost grew too fast with the tables."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions import prefix
from cohortlens.operators import guards, inference, ranking, resample
from cohortlens.plans.views import Tables
from cohortlens.streaming import ingest

SF = "/root/testdata/sf0.001"


def plan(d):
    return d._jdf.queryExecution().optimizedPlan().toString()


def test_runs_number_no_events(spark):
    """Scoring the events needs no slice, so nothing is sorted, joined or shuffled for one."""
    t = Tables(spark, SF)
    assert "Window" not in plan(t.runs) and "Join" not in plan(t.runs)
    assert t.runs.count() == 8 * t.table("events").count()


def test_joint_cells_score_the_rows_once(spark):
    """Point AUCs and replicates from the shared cells are those of the rows."""
    d = spark.range(600).select((F.col("id") % 30).cast("string").alias("subject"), F.concat(F.lit("m"), F.col("id") % 2).alias("method"),
                                F.expr("CAST(id % 30 < 12 AS BIGINT)").alias("label"), F.expr("if(id % 50 = 0, NULL, (id * 7919 % 101) / 100D)").alias("score"))
    cells = resample.joint_cells(d)
    assert "score" not in plan(cells)  # read back, not scored again
    got = {(x.unit, x.method): x.auc for x in ranking.point_from_cells(cells).collect()}
    want = {(x.unit, x.method): x.auc for x in ranking.point_auc(d).collect()}
    assert len(got) == 4 and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)


def test_levels_are_scored_once(spark, monkeypatch):
    """The three levels of every condition come from one written table; rows are not scored again for each join."""
    seen = []
    monkeypatch.setattr(inference, "delong", lambda d, *a, **k: seen.append(d) or d)
    inference.compare_conditions(Tables(spark, SF).runs)
    assert "md5" not in plan(seen[0])


def test_partitions_follow_the_table(spark, monkeypatch):
    """Line items are joined and numbered in more tasks when there are more of them; numbers stay those of the plain window."""
    n = Tables(spark, SF).table("lineitem").count()
    monkeypatch.setattr(prefix, "TASK_ROWS", n // 40)
    t = Tables(spark, SF)
    assert plan(t.li_slices).count("[l_orderkey") and "RepartitionByExpression" in plan(t.li_slices) and prefix.tasks_for(t.table("lineitem")) >= 40
    got = t.li_slices.selectExpr("int(volume) AS o", "slice").exceptAll(t.table("lineitem").selectExpr(
        "int(l_orderkey) AS o", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS slice").selectExpr("o", "bigint(slice)"))
    assert got.count() == 0 and t.li_slices.count() == n


@pytest.mark.parametrize("tasks", [None, 13])
def test_dealt_rows_are_numbered_alike(spark, monkeypatch, tasks):
    monkeypatch.setattr(prefix, "HOT_ROWS", 50)
    d = spark.range(900).select("id", F.expr("if(id % 3 = 0, 'hot', concat('k', id % 40))").alias("key"), F.expr("(id * 7919 % 1000) / 1000D").alias("x"))
    got = prefix.number_rows(d, ["key"], ["x", "id"], prefix.spread(F.col("x")), "rn", tasks=tasks)
    want = d.withColumn("want", F.row_number().over(Window.partitionBy("key").orderBy("x", "id")))
    assert got.join(want.select("id", "want"), "id").filter("rn = want").count() == 900


def test_nesting_shuffles_no_pairs(spark):
    """More than one parent, a missing parent beside a known one included; no distinct pairs are made."""
    d = spark.createDataFrame([(1, 10, 7), (1, 11, 7), (2, 10, None), (3, 12, 8), (4, None, 9), (5, 13, 9), (5, None, 9)], "series int, study int, patient int")
    a = guards.nesting_audit(d)
    assert not re.search(r"Aggregate \[\w+#\w+, \w+#", plan(a))
    got = a.first()
    assert (got.n_rows, got.series_in_many_study, got.study_in_many_patient, got.patient_with_many_study, got.patient_with_many_series) == (7, 2, 1, 2, 1)


def test_fresh_rows_need_no_join(spark, tmp_path, monkeypatch):
    """Repeats inside a batch and of earlier batches, a null key among them, are refused; the batch is read once."""
    stored = str(tmp_path / "rows")
    calls = spark.sparkContext.accumulator(0)
    monkeypatch.setattr(ingest, "null_safe_join", None)
    seen = F.udf(lambda x: (calls.add(1), x)[1], "long").asNondeterministic()
    rows = lambda r: spark.createDataFrame(r, "run string, row_id long, v long").withColumn("v", seen("v"))
    first = ingest.fresh(rows([("a", 1, 5), ("a", 1, 4), (None, 2, 6)]), 0, stored, ["run", "row_id"])
    assert {(x.run, x.row_id, x.v) for x in first.collect()} == {("a", 1, 4), (None, 2, 6)} and calls.value == 3
    for _ in range(2):  # a replay writes the same
        second = ingest.fresh(rows([(None, 2, 6), ("a", 3, 1), ("a", 1, 2)]), 1, stored, ["run", "row_id"])
        assert [(x.run, x.row_id, x.v) for x in second.collect()] == [("a", 3, 1)]
    assert ingest.refused(spark, stored) == 3
