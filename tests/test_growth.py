"""Queries whose cost grew too fast with their tables: what they read, keep or shuffle is bounded here."""

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import metrics as m


def counted(df):
    """``df`` behind a step that counts the rows that go through it, and the counter."""
    seen = df.sparkSession.sparkContext.accumulator(0)

    def look(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b
    return df.mapInArrow(look, df.schema), seen


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_youden_reads_its_counts_once(spark, keys):
    """Against a plain loop, with ties of the best threshold, a key of one class and a null key."""
    rows = [(k, s / 8, int((s * 7 + i) % 5 < s % 3), int((s * 3 + i) % 4 == 0)) for i, k in enumerate([None, "a", "b"]) for s in range(40)] + [("c", 0.5, 3, 0), ("c", 0.7, 1, 0)]
    rows += [("d", 0.1, 0, 1), ("d", 0.2, 1, 0), ("d", 0.3, 0, 1), ("d", 0.4, 1, 0)]  # two equal best thresholds
    d = spark.createDataFrame(rows, "k string, s double, p long, n long")
    d = d if keys else d.groupBy("s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    n, (d, seen) = d.count(), counted(d)
    got = {tuple(x[k] for k in keys): x for x in m.youden_threshold(d, keys).collect()}
    assert seen.value == n
    groups = {}
    for x in rows:
        cell = groups.setdefault(tuple([x[0]] * len(keys)), {}).setdefault(x[1], [0, 0])
        cell[0], cell[1] = cell[0] + x[2], cell[1] + x[3]
    for key, cells in groups.items():
        s, P, N = sorted(cells), sum(c[0] for c in cells.values()), sum(c[1] for c in cells.values())
        if not P or not N:
            assert key not in got
            continue
        tried = [(s[0] - 1e-9, 1.0, 0.0)]
        for i in range(len(s) - 1):
            tried.append(((s[i] + s[i + 1]) / 2, 1 - sum(cells[x][0] for x in s[:i + 1]) / P, sum(cells[x][1] for x in s[:i + 1]) / N))
        best = max(b + c - 1 for _, b, c in tried)
        tied = [x for x in tried if x[1] + x[2] - 1 >= best - 1e-12]
        assert (got[key].threshold, got[key].sens, got[key].spec) == tied[len(tied) // 2] and got[key].n_tied == len(tied)
    assert len(got) == (4 if keys else 1)


def test_thresholds_of_folds_leave_the_rows_where_they_are(spark, tmp_path):
    spark.range(4000).select(F.expr("id % 5").alias("fold"), F.expr("id * 7919 % 1000 / 1000D").alias("score"), F.expr("id * 7919 % 1000 + id % 300 > 600").cast("long").alias("label"), F.expr("id % 3 = 0").alias("val")).write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    out = m.pooled_operating_point(d.filter("val"), d.filter("NOT val"))
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin [fold" not in plan
    got, th = out.head(), {x.fold: x.threshold for x in m.youden_threshold(m.score_counts(d.filter("val"), ["fold"]), ["fold"]).collect()}
    hits = [(x.score >= th[x.fold], x.label == 1) for x in d.filter("NOT val").collect()]
    assert (got.tp, got.fp, got.tn, got.fn) == tuple(hits.count(x) for x in ((True, True), (True, False), (False, False), (False, True)))


def test_fingerprint_is_dealt_to_as_many_tasks_as_the_table_asks_for(spark, monkeypatch):
    from cohortlens.functions import prefix
    from cohortlens.plans.catalog import REGISTRY
    monkeypatch.setattr(prefix, "TASK_ROWS", 100)
    n = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
    out = REGISTRY["table_fingerprint"].run(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert f", {-(-n // 100)}), REPARTITION_BY_NUM" in plan
    assert out.head().same_after_shuffle


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_halves_are_the_units_with_the_smallest_draws(spark, n):
    """Against a sort of each replicate; one replicate read with its weights and the others."""
    import numpy as np
    from cohortlens.functions.draws import draw, unit_draw
    from cohortlens.operators import replicates
    u = spark.range(n).select(F.col("id").cast("string").alias("subject"))
    drawn = u.select("subject", F.explode(F.sequence(F.lit(0), F.lit(11))).alias("rep")).withColumn("h", unit_draw(3, "half", F.col("rep"), F.col("subject"))).collect()
    got = {x.subject: np.frombuffer(x["__w"], np.uint8) for x in replicates.split_halves(u.unionByName(u), 12, 3).collect()}
    first = {i: {x.subject for x in sorted((x for x in drawn if x.rep == i), key=lambda x: (x.h, x.subject))[:n // 2]} for i in range(12)}
    assert len(got) == n and all(got[s][i] == (s in first[i]) for s in got for i in range(12)) and not any(got[s][12:].any() for s in got)
    cells = u.select("subject", F.explode(F.sequence(F.lit(1), F.lit(9))).alias("j")).select(
        "subject", ((draw("s", F.col("subject"), F.col("j")) % 30) / 30).alias("s"), (draw("p", F.col("subject"), F.col("j")) % 3).alias("p"), (draw("n", F.col("subject"), F.col("j")) % 2).alias("n"))
    rows = cells.collect()
    auc = {(x.rep, x.half): x.auc for x in replicates.replicate_auc(cells, replicates.split_halves(u, 12, 3), halves=12).collect()}
    for i in range(12):
        for half in (0, 1):
            mine = [x for x in rows if (x.subject in first[i]) == half]
            P, N = sum(x.p for x in mine), sum(x.n for x in mine)
            want = sum(x.p * y.n * ((x.s > y.s) + (x.s == y.s) / 2) for x in mine for y in mine) / (P * N) if P and N else None
            assert auc.get((i, half)) == (want if want is None else pytest.approx(want, abs=1e-12))


def test_half_replicates_are_not_padded(spark):
    """200 replicates are two halves of one set of weights; the rest of a packed row of 1,000 is not looked up."""
    from cohortlens.operators import replicates
    u = spark.range(30).select(F.col("id").cast("string").alias("subject"))
    cells = u.select("subject", (F.col("subject").cast("int") / 30).alias("s"), (F.col("subject") % 2).cast("long").alias("p"), (1 - F.col("subject") % 2).cast("long").alias("n"))
    r, size = replicates.ranges(cells, replicates.split_halves(u, 200, 0), [], halves=200)
    assert {x["__q"] for x in r.collect()} == set(range(-(-200 // size)))


def test_running_sums_of_small_keys_need_no_offsets(spark, monkeypatch):
    """Keys above and below the limit, a null key and null leads give the plain sums."""
    from pyspark.sql import Window
    from cohortlens.functions import prefix
    monkeypatch.setattr(prefix, "HOT_ROWS", 50)
    d = spark.range(1200).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id % 40) END").alias("key"),
                                 F.expr("CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 7919 % 1000) / 1000D END").alias("x"), (F.col("id") % 4).alias("n"))
    d = d.groupBy("key", "x").agg(F.sum("n").alias("n"))
    got = prefix.running_small(d, ["key"], ["x"], prefix.spread(F.col("x")), u="n")
    w = Window.partitionBy("key")
    want = d.withColumn("u", F.sum("n").over(w.orderBy("x"))).withColumn("u_all", F.sum("n").over(w)).select(*got.columns)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_aggregations_of_subjects_read_their_scores_once(spark):
    d = spark.range(600).select((F.col("id") % 7).cast("string").alias("subject"), F.expr("id * 37 % 101 / 101D").alias("score"), (F.col("id") % 2).alias("label"))
    d, seen = counted(d)
    assert m.aggregate_matrix(d).count() == 7 * len(m.SCHEMES)
    assert seen.value == 600


def test_strata_are_known_before_rows_are_copied(spark):
    """A stratum joined to the scored copies sorted eight rows of an event by its number."""
    from cohortlens.plans.catalog import REGISTRY
    plan = REGISTRY["stratified_auc"].run(spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "Join [row_id" in x]


def test_copies_of_permutations_are_dealt_to_as_many_tasks_as_they_ask_for(spark, monkeypatch):
    from cohortlens.functions import prefix
    from cohortlens.operators import resample as r
    monkeypatch.setattr(prefix, "TASK_ROWS", 100)
    d = spark.range(600).select(F.col("id").alias("row_id"), (F.col("id") % 30).cast("string").alias("subject"), F.expr("id div 30").alias("slice"),
                                (F.col("id") % 7 == 0).cast("long").alias("label"), F.when(F.col("id") % 30 < 10, "a").otherwise("b").alias("split"))
    rows, audit = r.permute_subject_labels(d, 20)
    assert ", 120), REPARTITION_BY_NUM" in rows._jdf.queryExecution().sparkPlan().toString()
    assert rows.groupBy("perm").count().filter("count = 600").count() == 20 and audit.count() == 40
