"""Queries that wrote more to disk than their tables justify: what is moved or written is bounded here."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import replicates
from cohortlens.operators import resample as r


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(8)
    rows = [(None if u == 11 else str(int(u)), k, float(s), int(y)) for u, k, s, y in zip(
        rng.integers(0, 12, 500), rng.choice(["x", "y", None], 500), rng.integers(-3, 4, 500), rng.random(500) < 0.3)]
    return spark.createDataFrame(rows, "subject string, k string, score double, label int")


@pytest.mark.parametrize("chunk", [7, 1 << 16])
def test_draws_made_in_tasks_are_the_packed_ones(spark, scored, monkeypatch, chunk):
    """A null unit takes its slots, a null key is a key, rows that are not added up are cells; units are counted in steps."""
    monkeypatch.setattr(replicates, "CHUNK", chunk)
    monkeypatch.setattr(replicates, "COUNTED", 5)
    cells = r.subject_cells(scored, ["k"])
    want = {(x.rep, x.k): x.auc for x in r.replicate_auc(cells, r.packed(cells, 260, 5), ["k"]).collect()}
    for c in (cells, r.row_cells(scored, ["k"])):
        got = {(x.rep, x.k): x.auc for x in r.replicate_auc(c, r.drawn_units(c, 260, 5), ["k"]).collect()}
        assert len(got) == 260 * 3 and set(got) == set(want)
        assert all(got[i] == want[i] or got[i] == pytest.approx(want[i], abs=1e-12) for i in want)


def test_no_weights_are_moved(spark, scored, monkeypatch):
    """Sets of replicates meet the written chunks where these lie; only what is left of a chunk is shuffled."""
    cells, settled = r.subject_cells(scored, ["k"]), []
    settle = replicates.settle
    monkeypatch.setattr(replicates, "settle", lambda df: settled.append(df) or settle(df))
    out, size = replicates.drawn_ranges(cells, r.drawn_units(cells, 2000, 1), ["k"])
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan and "Join" not in plan
    assert [set(x.columns) & {"w", "__w"} for x in settled] == [set()]


def test_one_unit_and_no_rows(spark):
    one = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 0)], "subject string, score double, label int")
    assert {x.auc for x in r.replicate_auc(r.row_cells(one), r.drawn_units(one, 5)).collect()} == {None}
    none = r.row_cells(one.filter("score > 1"))
    assert r.replicate_auc(none, r.drawn_units(none, 5)).count() == 0


def test_slots_longer_than_a_block_and_across_lengths():
    import hashlib
    from cohortlens.functions.draws import draw_slots
    for parts in ((1, 0), ("é|", 7), ("x" * 49, 1), ("x" * 60,)):
        text = "".join(f"{p}|" for p in parts)
        for lo, hi in ((0, 11), (95, 1203), (9998, 10003), (5, 5), (123456, 123460)):
            assert draw_slots(parts, lo, hi).tolist() == [int(hashlib.md5(f"{text}{i}".encode()).hexdigest()[:13], 16) for i in range(lo, hi)]


def events(spark, path):
    """Repeated rows, a repeated number with other values and null values."""
    rows = [(i, f"2024-01-0{1 + i % 5} 0{i % 10}:00:00", i % 7 if i % 11 else None, "error" if i % 3 else "click", 200.0 if i % 4 else None, '{"k": %d}' % i) for i in range(60)]
    rows += rows[:9] + [(3, "2024-01-02 01:00:00", 6, "error", 300.0, None)]
    d = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string")
    d.withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{path}/events.parquet")


def test_wide_scores_are_those_of_the_runs(spark, tmp_path):
    from cohortlens.plans.resampling import wide_runs
    from cohortlens.plans.views import Tables
    events(spark, tmp_path)
    t = Tables(spark, str(tmp_path))
    want = t.runs.groupBy("method", "row_id", "subject", "label").pivot("condition", ["a", "b"]).agg(F.first("score"))
    got = wide_runs(t).select(*want.columns)
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_difference_shuffles_no_copies_to_arms(spark, tmp_path, monkeypatch):
    """Against replicates of cells that are added up first; a row that lacks a score counts for the other arm."""
    rng = np.random.default_rng(3)
    rows = [(str(int(u)), float(x), None if i % 9 == 0 else float(x + z), int(y)) for i, (u, x, z, y) in enumerate(zip(rng.integers(0, 9, 300), rng.integers(0, 8, 300), rng.integers(0, 3, 300), rng.random(300) < 0.4))]
    rows += [("only b", None, 3.0, 1), ("neither", None, None, 0)]
    d = spark.createDataFrame(rows, "subject string, a double, b double, label int")
    both = d.select("subject", "label", F.inline(F.array(*[F.struct(F.lit(x).alias("arm"), F.col(x).alias("score")) for x in "ab"])))
    cells = r.subject_cells(both, ["arm"])
    reps = r.replicate_auc(cells, r.packed(cells, 100, 4), ["arm"]).groupBy("rep").pivot("arm", ["a", "b"]).agg(F.first("auc"))
    want = [x.a - x.b for x in reps.collect() if x.a is not None and x.b is not None]
    seen = []
    inner = r.replicate_auc
    monkeypatch.setattr(r, "replicate_auc", lambda c, *a, **k: seen.append(c) or inner(c, *a, **k))
    got = r.bootstrap_auc_diff(d, "a", "b", 100, 4).head()
    assert got.n_used == len(want) and (got.ci_lo, got.ci_hi) == (pytest.approx(np.quantile(want, 0.025)), pytest.approx(np.quantile(want, 0.975)))
    plan = seen[0]._jdf.queryExecution().sparkPlan().toString()
    assert "Aggregate" not in plan and plan.index("Generate") < plan.index("Join")


@pytest.mark.parametrize("hot, apart", [(10_000, False), (25, False), (10_000, True)])
def test_permuted_rows_are_those_of_the_join(spark, monkeypatch, tmp_path, hot, apart):
    """Repeated and null numbers, a null volume, a hot volume, and a number of two volumes."""
    from cohortlens.functions import prefix
    monkeypatch.setattr(prefix, "HOT_ROWS", hot)
    monkeypatch.setattr(r, "PIECE", 10)
    rows = [(None if i % 13 == 0 else "big" if i % 2 else f"v{i % 8}", None if i % 17 == 0 else i, 1 if i % 17 == 0 else i % 3, i / 8) for i in range(90)]
    rows += rows[:20] + ([("v2", 4, 1, 0.5), ("v6", 4, 2, 0.25)] if apart else [])
    spark.createDataFrame(rows, "volume string, row_id long, label long, x double").write.parquet(str(tmp_path / "t"))
    d = spark.read.parquet(str(tmp_path / "t"))
    want = d.drop("label").join(r.permute_within(d, 4, seed=3), "row_id").select("perm", *d.columns)
    got = r.permuted(d, 4, seed=3)
    # copies of a number, and rows without one, are ranked among each other in any order
    key = lambda x: (x.perm, str(x.volume), x.row_id, x.x)
    count = lambda df: sorted(map(key, df.collect()))
    assert count(got) == count(want) and got.columns == want.columns
    alone = [x[1] for x in rows if x[1] is not None]
    alone = {x for x in alone if alone.count(x) == 1}
    pick = lambda df: sorted((key(x), x.label) for x in df.collect() if x.row_id in alone)
    assert pick(got) == pick(want)


def test_copies_of_permutations_are_not_moved(spark, tmp_path):
    spark.range(3000).select(F.col("id").alias("row_id"), (F.col("id") % 90).alias("volume"), (F.col("id") % 2).alias("label")).write.parquet(str(tmp_path / "t"))
    p = r.permuted(spark.read.parquet(str(tmp_path / "t")), 20)
    plan = p._jdf.queryExecution().executedPlan().toString()
    assert p.count() == 60000 and "Join" not in plan and "Exchange" not in plan[:plan.index("MapInArrow")]
