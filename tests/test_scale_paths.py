"""The paths taken for hot keys give the results of the plain ones."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cohortlens.functions import prefix
from cohortlens.functions.draws import unit_draw
from cohortlens.operators import association as a
from cohortlens.operators import metrics as m
from cohortlens.operators import resample as r
from cohortlens.operators import theory as th
from cohortlens.operators import tree


@pytest.fixture
def skewed(spark):
    """One key holds most rows; scores span signs and magnitudes."""
    rnd = random.Random(3)
    rows = [("hot" if k % 3 else f"k{k % 30}", k, rnd.choice([-1, 1]) * 10 ** rnd.uniform(-8, 4) if k % 2 else round(rnd.random(), 2), int(rnd.random() < 0.4))
            for k in range(1500)]
    return spark.createDataFrame(rows, "key string, id long, score double, label long").cache()


def test_spread_never_decreases(spark, skewed):
    v = [x[0] for x in skewed.select("score").distinct().orderBy("score").collect()]
    b = [x[0] for x in skewed.select("score", prefix.spread(F.col("score")).alias("b")).distinct().orderBy("score").select("b").collect()]
    assert b == sorted(b) and len(set(b)) > len(v) / 10


@pytest.mark.parametrize("by_share", [False, True])
def test_number_rows_equals_window(skewed, by_share):
    d = skewed.withColumn("h", unit_draw("x", F.col("id")))
    order, lead = (["h", "id"], F.col("h")) if by_share else (["score", "id"], prefix.spread(F.col("score")))
    got = prefix.number_rows(d, ["key"], order, lead, "rn", by_share)
    want = d.withColumn("want", F.row_number().over(Window.partitionBy("key").orderBy(*order)))
    assert got.join(want.select("id", "want"), "id").filter("rn <> want").count() == 0
    assert got.count() == 1500


def test_running_and_next(skewed):
    c = skewed.groupBy("key", "score").agg(F.count("*").alias("c"))
    w = Window.partitionBy("key").orderBy("score")
    got = prefix.with_next(prefix.running(c, ["key"], ["score"], prefix.spread(F.col("score")), u="c"), ["key"], "score", "nx")
    want = c.select("key", "score", F.sum("c").over(w).alias("u2"), F.lead("score").over(w).alias("n2"))
    j = got.join(want, ["key", "score"])
    assert j.filter("u <> u2 OR NOT (nx <=> n2)").count() == 0 and j.count() == c.count()


def test_auc_levels_agree_with_pairs(skewed):
    c = m.score_counts(skewed, ["key"])
    two, one = (m.auc_from_counts(c, ["key"], few).orderBy("key").collect() for few in (False, True))
    rows = skewed.collect()
    for x, y in zip(two, one):
        g = [q for q in rows if q["key"] == x["key"]]
        pos, neg = [round(q["score"], 12) for q in g if q["label"]], [round(q["score"], 12) for q in g if not q["label"]]
        want = sum((p > n) + 0.5 * (p == n) for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
        assert abs(x["auc"] - want) < 1e-12 and abs(y["auc"] - want) < 1e-12


def test_quantiles_match_numpy(skewed):
    c = skewed.groupBy("key", "score").agg(F.count("*").alias("c"))
    got = {(q["key"], q["prob"]): q["value"] for q in prefix.quantiles(c, ["key"], "score", "c", (0.05, 0.5, 0.9)).collect()}
    rows = skewed.collect()
    for (key, p), v in got.items():
        assert np.isclose(v, np.quantile([q["score"] for q in rows if q["key"] == key], p), rtol=1e-9, atol=1e-12)


def test_permutation_keeps_positives_per_volume(skewed):
    p = r.permute_within(skewed, 3, ["key"], "id", "label", 1)
    before = {x["key"]: x["k"] for x in skewed.groupBy("key").agg(F.sum("label").alias("k")).collect()}
    after = p.join(skewed.select("id", "key"), "id").groupBy("perm", "key").agg(F.sum("label").alias("k"), F.count("*").alias("n")).collect()
    assert all(x["k"] == before[x["key"]] for x in after) and sum(x["n"] for x in after) == 4500


def test_bootstrap_draws_are_k_per_replicate(spark):
    u = spark.range(40).select(F.col("id").cast("string").alias("subject"))
    n = r.draws(u, 10, 1).groupBy("rep").agg(F.sum("mult").alias("n")).collect()
    assert len(n) == 10 and all(x["n"] == 40 for x in n)
    mean = r.draws(u, 200, 1, method="poisson").agg((F.sum("mult") / 8000).alias("m")).first()["m"]
    assert abs(mean - 1) < 0.05


def test_components_on_chain_and_cycle(spark):
    e = [(f"n{k:03d}", f"n{k + 1:03d}") for k in range(60)] + [("x1", "x2"), ("x2", "x3"), ("x3", "x1")]
    c = a.connected_components(spark.createDataFrame(e, "src string, dst string"))
    assert {q["component"]: q["n"] for q in c.groupBy("component").agg(F.count("*").alias("n")).collect()} == {"n000": 61, "x1": 3}


def test_tree_finds_planted_split(spark):
    rows = [(f"s{k}", -1 if k % 2 else 0, float(k % 50), int(k % 50 > 30), "u" if k % 3 else "v") for k in range(600)]
    df = spark.createDataFrame(rows, "subject string, fold long, x double, label long, c string")
    cells, fit = tree.fit_score(df, 1, ["x", "c"], name="t")
    assert fit["splits"][(0, 1)][1] == pytest.approx(30.5, abs=1)
    flat = cells.groupBy("feature", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    assert m.auc_from_counts(flat, ["feature"]).first()["auc"] == 1.0


def test_folded_normal_inversion(spark):
    d = spark.createDataFrame([(x, t) for x in (0.05, 0.2, 0.7) for t in (0.01, 0.1)], "delta double, tau double")
    d = d.withColumn("obs", th.folded_mean(F.col("delta"), F.col("tau")))
    for q in d.select("delta", th.invert_folded(F.col("obs"), F.col("tau")).alias("back")).collect():
        assert abs(q["delta"] - q["back"]) < 1e-6


@pytest.mark.parametrize("n, levels", [(10_000, 10_000), (10_000, 40), (3, 2), (5, 1)])
def test_kendall_counts_inversions(spark, n, levels):
    """Two lists, one of them long: the same as all pairs, counted by numpy."""
    import numpy as np
    from cohortlens.operators.ranking import kendall_tau_b
    g = np.random.default_rng(n + levels)
    lists = {None: (g.integers(0, levels, n), g.integers(0, levels, n)), "short": (np.array([1, 1, 2, 5]), np.array([3.5, 3.5, -1, -1e9]))}
    lists[None] = (lists[None][0], lists[None][1] + lists[None][0] // 2)
    rows = [(k, f"m{i}", float(x), float(y)) for k, (a, b) in lists.items() for i, (x, y) in enumerate(zip(a, b))] + [("short", "no", None, 1.0)]
    got = {r.grp: r.tau for r in kendall_tau_b(spark.createDataFrame(rows, "grp string, method string, a double, b double"), "a", "b", ["grp"]).collect()}
    for key, (a, b) in lists.items():
        c = free_a = free_b = 0.0
        for i in range(len(a)):
            x, y = np.sign(a[i] - a[i + 1:]), np.sign(b[i] - b[i + 1:])
            c, free_a, free_b = c + (x * y).sum(), free_a + abs(x).sum(), free_b + abs(y).sum()
        want = c / np.sqrt(free_a * free_b) if free_a and free_b else None
        assert got[key] == (pytest.approx(want, abs=1e-12) if want is not None else None)


def test_tree_counts_a_row_once_per_column(spark):
    """Missing numbers, missing levels and rare levels: the root split is that of all 0/1 features; a row is counted once per column, not per partition and level."""
    rows = [(f"s{k}", k % 3, None if k % 7 == 0 else float(k % 40), int((k % 7 == 0) ^ (k % 11 == 3)), None if k % 5 == 0 else "abcdef"[k % 6], k % 13 / 13) for k in range(900)]
    df = spark.createDataFrame(rows, "subject string, fold long, x double, label long, c string, relpos double")
    _, fit = tree.fit_score(df, 3, ["x", "c"], use_relpos=True, max_levels=3, max_depth=1)
    for f in range(3):
        part = [r for r in rows if r[1] != f]
        assert fit["info"][(f, 1)] == (len(part), sum(r[3] for r in part))
        at, threshold = fit["splits"][(f, 1)]
        assert (fit["names"][f][at], threshold) == ("x__missing", 0.5)
        missing = [r for r in part if r[2] is None]
        assert fit["info"][(f, 3)] == (len(missing), sum(r[3] for r in missing))
    arms = tree._arms(df, ["x", "c"])
    assert df.select(F.inline(F.array(*arms))).count() == 2 * len(rows)
