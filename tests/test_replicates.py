"""Bootstrap AUCs of packed draws against replicates written out row by row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.operators import replicates
from cohortlens.operators import resample as r


def plain_auc(rows):
    """rows: (score, label, weight)."""
    pos = [(s, w) for s, y, w in rows if y == 1 and w]
    neg = [(s, w) for s, y, w in rows if y == 0 and w]
    total = sum(w for _, w in pos) * sum(w for _, w in neg)
    won = sum(w * v * ((s > t) + (s == t) / 2) for s, w in pos for t, v in neg)
    return won / total if total else None


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(4)
    rows = [(str(int(u)), k, float(s), int(y)) for u, k, s, y in zip(
        rng.integers(0, 12, 600), rng.choice(["x", "y", None], 600), np.where(rng.random(600) < 0.4, 0.0, rng.integers(-3, 4, 600)), rng.random(600) < 0.3)]
    return rows, spark.createDataFrame(rows, "subject string, k string, score double, label int")


@pytest.mark.parametrize("method", ["multinomial", "poisson", "split"])
def test_packed_replicates_equal_written_out_rows(spark, scored, method):
    """Ties over many units cross the ranges; a null key is a key; 1,203 replicates need two blocks."""
    rows, df = scored
    cells = r.subject_cells(df, ["k"])
    packs = r.packed(cells, 1203, 5, method=method)
    got = {(x.rep, x.k): x.auc for x in r.replicate_auc(cells, packs, ["k"]).collect()}
    weights = {}
    for x in packs.collect():
        for i, w in enumerate(x["__w"]):
            weights[x["__blk"] * replicates.REPS + i, x.subject] = w
    assert len(got) == 1203 * 3
    for rep in (0, 1, 999, 1000, 1202):
        for k in ("x", "y", None):
            want = plain_auc([(s, y, weights.get((rep, u), 0)) for u, key, s, y in rows if key == k])
            assert got[rep, k] == pytest.approx(want, abs=1e-12)


def test_split_draws_are_multinomial(spark):
    """Every replicate hands out k slots; counts have the mean and variance of a multinomial one."""
    units = spark.range(40).select(F.col("id").cast("string").alias("subject"))
    w = np.array([list(x["__w"]) for x in r.packed(units, 1000, 3, method="split").collect()])
    assert w.shape == (40, 1000) and (w.sum(axis=0) == 40).all()
    assert abs(w.mean() - 1) < 1e-9 and abs(w.var() - 39 / 40) < 0.03
    assert np.abs(np.corrcoef(w)[np.triu_indices(40, 1)].mean() + 1 / 39) < 0.01


def test_degenerate_replicates_and_empty_tables(spark):
    one = spark.createDataFrame([("a", 0.1, 1), ("a", 0.2, 0)], "subject string, score double, label int")
    cells = r.subject_cells(one)
    assert {x.auc for x in r.replicate_auc(cells, r.packed(cells, 5)).collect()} == {None}
    none = r.subject_cells(one.filter("score > 1"))
    assert r.replicate_auc(none, r.packed(none, 5)).count() == 0
