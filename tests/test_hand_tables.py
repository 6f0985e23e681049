"""Small tables with results known by hand."""

import math

import pytest
from pyspark.sql import functions as F

from cohortlens.functions import rules
from cohortlens.operators import baselines as b
from cohortlens.operators import geometry as g
from cohortlens.operators import guards, roles, splits
from cohortlens.operators import inference as i
from cohortlens.operators import metrics as m
from cohortlens.sources import tables as src


def column(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


def test_midrank_ties(spark):
    df = spark.createDataFrame(list(enumerate([3.0, 1.0, 1.0, 2.0, 3.0, 3.0])), "id long, score double")
    assert column(m.midrank(df), "midrank", "id") == [5, 1.5, 1.5, 3, 5, 5]


def test_relative_position_and_size(spark):
    rows = [("a", z) for z in range(10, 15)] + [("b", z) for z in (0, 5, 10)] + [("c", 7)]
    df = spark.createDataFrame(rows, "volume string, slice long")
    d = g.volume_size(g.relative_position(df)).orderBy("volume", "slice").collect()
    assert [r["relpos"] for r in d] == [0, .25, .5, .75, 1, 0, .5, 1, 0]
    assert [r["n_slices"] for r in d] == [5] * 5 + [3] * 3 + [1]


def test_binarise(spark):
    df = spark.createDataFrame([(x,) for x in range(1, 6)], "v long")
    out, _ = roles.binarise(df, "v", ">2")
    assert column(out, "label", "v") == [0, 0, 1, 1, 1]
    with pytest.raises(ValueError, match="distinct values"):
        roles.binarise(df.filter("v <= 3"), "v")
    two, rule = roles.binarise(df.filter("v IN (2, 4)"), "v")
    assert column(two, "label", "v") == [0, 1] and "larger" in rule


def test_missing_label_is_negative_and_differs(spark):
    df = spark.createDataFrame([(1, 3), (2, None)], "id long, v long")
    d = df.select("id", rules.binary_label(F.col("v"), ">2").alias("a"), rules.binary_label(F.col("v"), "!=3").alias("b"))
    assert [(r["a"], r["b"]) for r in d.orderBy("id").collect()] == [(1, 0), (0, 1)]


def test_split_words(spark):
    df = spark.createDataFrame([(0, "training"), (1, "TEST"), (2, "val"), (3, "weird")], "id long, w string")
    assert column(df.withColumn("a", rules.split_arm(F.col("w"))), "a", "id") == ["train", "test", "val", "other"]
    with pytest.raises(Exception, match="unknown split value"):
        df.select(rules.split_arm(F.col("w"), strict=True)).collect()


def test_target_encoding_unseen_level_takes_prior(spark):
    rows = [("s1", -1, "a", 1), ("s2", -1, "a", 1), ("s3", -1, "b", 0), ("s4", -1, "b", 0),
            ("t1", 0, "a", 0), ("t2", 0, "b", 0), ("t3", 0, "zzz", 1)]
    df = spark.createDataFrame(rows, "subject string, fold long, c string, label long")
    s = b.encode(b.cells(df, {"c": F.col("c")}), 1, 0.0)
    assert {r["level"]: r["s"] for r in s.collect()} == {"a": 1.0, "b": 0.0, "zzz": 0.5}


def test_constant_predictor_is_half_at_subject_level(spark):
    rows = [(f"p{k}", 0.04824120603015075, int(k % 2 == 0 and z == 0)) for k, n in enumerate((28, 30, 31, 33)) for z in range(n)]
    df = spark.createDataFrame(rows, "subject string, score double, label long")
    assert m.patient_auc(df).first()["auc"] == 0.5


def test_fraction(spark):
    rows = [(0.851, 0.5, 0.861), (0.6, 0.5, 0.51), (0.9, 0.5, 0.8)]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "baseline double, chance double, published double, ci_lo double, ci_hi double")
    out = m.trivial_fraction(df).orderBy("baseline").collect()
    assert out[0]["fraction"] is None and out[0]["reason"]
    assert math.isclose(out[1]["fraction"], 0.351 / 0.361)
    assert out[2]["fraction"] > 1 and out[2]["clipped"] == 1


def test_wilson_three_of_three(spark):
    lo, hi = m.wilson(F.lit(3), F.lit(3))
    r = spark.range(1).select(lo.alias("lo"), hi.alias("hi")).first()
    assert round(r["lo"], 2) == 0.44 and r["hi"] == 1.0


def test_single_class_auc_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label long, score double")
    assert m.auc(df).first()["auc"] is None


def test_auc_symmetry_and_strata(spark):
    df = spark.range(500).select("id", (F.col("id") * 7 % 31 / 31.0).alias("score"), (F.col("id") * 13 % 17 < 6).cast("long").alias("label"))
    a = m.auc(df).first()["auc"]
    assert math.isclose(m.auc(df.withColumn("score", -F.col("score"))).first()["auc"], 1 - a)
    assert math.isclose(m.stratified_auc(df.withColumn("st", F.lit(1)), "st").first()["auc"], a)


def test_kfold_spreads_positives(spark):
    df = spark.range(50).select(F.concat(F.lit("s"), "id").alias("subject"), (F.col("id") < 20).cast("long").alias("label"))
    f = splits.stratified_kfold(df, 5, 1).groupBy("fold").agg(F.sum("label").alias("k"), F.count("*").alias("n")).collect()
    assert len(f) == 5 and all(r["k"] == 4 and r["n"] == 10 for r in f)


def test_guards_fire(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "test")], "subject string, split string")
    bad = guards.no_span_guard(df, ["split"]).collect()
    assert [r["id"] for r in bad] == ["a"] and bad[0]["arms"] == "test,train"
    with pytest.raises(ValueError, match="leak"):
        guards.require_empty(guards.no_span_guard(df, ["split"]), "leak")


def test_unequal_arrays_are_an_error(spark):
    one = "struct<probs: array<double>, labels: array<bigint>, patient_ids: array<string>, cache_idx: array<bigint>>"
    df = spark.createDataFrame([("p", ([0.1, 0.2], [1], ["a", "b"], [1, 2]))], f"path string, test {one}")
    with pytest.raises(Exception, match="unequal arrays"):
        src.explode_predictions(df).collect()


def test_exact_wilcoxon_against_enumeration(spark):
    d = [0.5, -0.2, 0.9, 0.9, -0.1, 0.3, 0.7]
    df = spark.createDataFrame([(str(k), v) for k, v in enumerate(d)], "subject string, diff double")
    got = i.wilcoxon_signed_rank(df).first()
    ranks = [4, 2, 6.5, 6.5, 1, 3, 5]
    w = sum(r for r, v in zip(ranks, d) if v > 0)
    sums = [sum(r for k, r in enumerate(ranks) if bits >> k & 1) for bits in range(1 << len(d))]
    p = min(1, 2 * min(sum(s <= w for s in sums), sum(s >= w for s in sums)) / len(sums))
    assert got["w_plus"] == w and math.isclose(got["p"], p)


def test_normal_tail_column_matches_erfc(spark):
    df = spark.range(-40, 41).select((F.col("id") / 10.0).alias("z"))
    for r in df.select("z", i.normal_p(F.col("z")).alias("a"), (2 * i.normal_cdf(-F.abs("z"))).alias("b")).collect():
        assert math.isclose(r["a"], min(1, math.erfc(abs(r["z"]) / math.sqrt(2))), rel_tol=1e-12) and abs(r["a"] - r["b"]) < 2e-7


def test_chi_square_tail(spark):
    r = spark.range(1).select(i.chi2_p(F.lit(3.841458820694124), F.lit(1)).alias("a"), i.chi2_p(F.lit(18.307038053275146), F.lit(10)).alias("b")).first()
    assert abs(r["a"] - 0.05) < 1e-9 and abs(r["b"] - 0.05) < 1e-9


def test_agreement_bootstrap_degenerate_replicates(spark):
    """One category everywhere: agreement and AC1 are 1 in each replicate, kappa is undefined and skipped."""
    from cohortlens.operators.association import agreement_bootstrap
    rows = [(str(i), str(r), "yes") for i in range(6) for r in range(3)]
    got = {r.statistic: r for r in agreement_bootstrap(spark.createDataFrame(rows, "item string, rater string, code string"), 40, 1).collect()}
    assert (got["pa"].ci_lo, got["pa"].ci_hi, got["gwet_ac1"].ci_lo, got["gwet_ac1"].ci_hi) == (1.0, 1.0, 1.0, 1.0)
    assert (got["fleiss_kappa"].n_used, got["fleiss_kappa"].n_skipped, got["fleiss_kappa"].ci_lo) == (0, 40, None)
