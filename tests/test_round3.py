"""Findings of the third round: large or odd tables that once failed."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions import prefix
from cohortlens.functions.draws import draw, draw_slots
from cohortlens.operators import ranking, replicates
from cohortlens.operators import resample as r


@pytest.mark.parametrize("by_share", [False, True])
def test_hot_and_null_keys_are_numbered(spark, monkeypatch, by_share):
    """Keys above and below the limit, a null key and null leads give the plain row number."""
    monkeypatch.setattr(prefix, "HOT_ROWS", 50)
    d = spark.range(1200).select("id", F.expr("CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 3 = 1 THEN NULL ELSE concat('k', id % 40) END").alias("key"),
                                 F.expr("CASE WHEN id % 11 = 0 THEN NULL ELSE (id * 7919 % 1000) / 1000D END").alias("x"))
    d = d.fillna({"x": 0.0}) if by_share else d
    got = prefix.number_rows(d, ["key"], ["x", "id"], F.col("x") if by_share else prefix.spread(F.col("x")), "rn", by_share)
    want = d.withColumn("want", F.row_number().over(Window.partitionBy("key").orderBy("x", "id")))
    assert got.columns == ["id", "key", "x", "rn"]
    assert got.join(want.select("id", "want"), "id").filter("rn = want").count() == 1200


def test_running_meets_null_keys_and_null_leads(spark):
    d = spark.createDataFrame([(None, None, 2), (None, 1.0, 3), ("a", None, 5), ("a", -1.0, 7)], "k string, s double, n long")
    got = {(x.k, x.s): x.u for x in prefix.running(d, ["k"], ["s"], prefix.spread(F.col("s")), u="n").collect()}
    assert got == {(None, None): 2, (None, 1.0): 5, ("a", None): 5, ("a", -1.0): 12}


def test_copies_per_permutation_are_not_broadcast(spark, tmp_path):
    """A small file copied 20 times passes for small; its join must not go through the driver."""
    spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 900).alias("volume"), (F.col("id") % 2).alias("label")).write.parquet(str(tmp_path / "t"))
    p = r.permute_within(spark.read.parquet(str(tmp_path / "t")), 20)
    plan = p._jdf.queryExecution().sparkPlan().toString()
    assert not [x for x in plan.splitlines() if "BroadcastHashJoin" in x and "__i" in x]
    assert p.count() == 60000


def test_spearman_of_tied_side_is_null(spark):
    d = spark.createDataFrame([("t", 1.0, 5.0), ("t", 2.0, 5.0), ("u", 1.0, 1.0), ("u", 2.0, 3.0), ("one", 1.0, 1.0)], "g string, a double, b double")
    got = {x.g: (x.rho, x.n_methods) for x in ranking.spearman(d, "a", "b", ["g"]).collect()}
    assert got["t"] == (None, 2) and got["one"] == (None, 1) and got["u"] == (pytest.approx(1.0), 2)


def test_draws_are_counted_without_a_row_per_slot(spark, monkeypatch):
    """The packed draws are those of the written-out slots, and no plan holds a row for each slot."""
    monkeypatch.setattr(replicates, "SLOTS", 300)
    monkeypatch.setattr(replicates, "WIDE", 256)
    sql = [x[0] for x in spark.range(40).select(draw(7, F.lit(3), F.col("id"))).collect()]
    assert list(draw_slots((7, 3), 0, 40)) == sql
    units = spark.range(700).select(F.col("id").cast("string").alias("subject"))
    packs = r.packed(units, 1002, 7)
    assert "md5" not in packs._jdf.queryExecution().optimizedPlan().toString()  # hashed where slots are numbered
    got = {(x["__blk"] * replicates.REPS + i, x.subject): w for x in packs.collect() for i, w in enumerate(x["__w"]) if w}
    want = {(x.rep, x.subject): x.mult for x in r.draws(units, 1002, 7).collect()}
    assert got == want


def test_chunks_share_scores_and_weights(spark, monkeypatch):
    """Chunks far smaller than a score's cells, counts above one, several sets of replicates."""
    monkeypatch.setattr(replicates, "CHUNK", 7)
    d = spark.range(400).select((F.col("id") % 37).cast("string").alias("subject"), F.expr("CASE WHEN id % 2 = 0 THEN 0.5D ELSE (id % 5) / 10D END").alias("s"),
                                (F.col("id") % 3).alias("p"), (F.col("id") % 4).alias("n"))
    packs = r.packed(d, 400, 2)
    got = {x.rep: x.auc for x in r.replicate_auc(d, packs).collect()}
    w = {(x["__blk"] * replicates.REPS + i, x.subject): v for x in packs.collect() for i, v in enumerate(x["__w"])}
    rows = d.collect()
    for rep in (0, 249, 250, 399):
        pos, neg = [(x.s, x.p * w[rep, x.subject]) for x in rows], [(x.s, x.n * w[rep, x.subject]) for x in rows]
        want = sum(a * b * ((s > t) + (s == t) / 2) for s, a in pos for t, b in neg) / (sum(a for _, a in pos) * sum(b for _, b in neg))
        assert got[rep] == pytest.approx(want, abs=1e-12)


def test_means_need_no_row_per_draw(spark):
    """Means of units under keys on packed draws equal the ones from written-out draws; a null value adds nothing."""
    d = spark.range(60).select((F.col("id") % 20).cast("string").alias("subject"), F.expr("if(id < 20, 'a', 'b')").alias("k"), F.expr("if(id % 7 = 0, NULL, id * 0.5D)").alias("diff")).filter("k = 'a' OR subject < '5'")
    packs = r.packed(d, 50, 4)
    got = {(x.rep, x.k): (x.diff, x.one) for x in replicates.weighted_sums(d.withColumn("one", F.lit(1)), packs, ["k"], ["diff", "one"]).collect()}
    want = d.join(r.draws(d, 50, 4), "subject").groupBy("rep", "k").agg(F.sum(F.col("diff") * F.col("mult")).alias("v"), F.sum("mult").alias("m")).collect()
    assert len(want) == 100 and all(got[x.rep, x.k] == (pytest.approx(x.v), x.m) for x in want)


def test_strata_are_drawn_without_a_row_per_slot(spark):
    """Draws inside strata are those of hash(seed|rep|stratum|slot), a percent sign included."""
    ix = spark.range(90).select(F.struct("id", F.expr("if(id < 60, '5%d', 'b')").alias("st")).alias("u"), F.expr("if(id < 60, '5%d', 'b')").alias("st"),
                                F.expr("if(id < 60, id, id - 60)").alias("idx"))
    got = {(i, x.u.id): w for x in replicates.count_draws(ix, 7, 3, "u", "st").collect() for i, w in enumerate(x["__w"]) if w}
    slots = ix.select("st", "idx", F.expr("if(st = 'b', 30, 60)").alias("k"))
    at = slots.crossJoin(spark.range(7).withColumnRenamed("id", "rep")).select("rep", "st", (draw(3, F.col("rep"), F.col("st"), F.col("idx")) % F.col("k")).alias("idx"))
    want = {(x.rep, x.idx + (60 if x.st == "b" else 0)): x["count"] for x in at.groupBy("rep", "st", "idx").count().collect()}
    assert got == want
