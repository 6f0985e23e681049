"""Cases that once gave wrong answers."""

import os

import pytest
from pyspark.sql import functions as F

from cohortlens import session
from cohortlens.functions.rules import binary_label
from cohortlens.operators import inference, reports, roles, splits
from cohortlens.sources import sinks
from cohortlens.streaming import ingest


def test_delong_leaves_rows_without_both_scores_out_first(spark):
    rows = [(1, 1, .9, .8), (2, 1, .4, .7), (3, 0, .5, .2), (4, 0, .1, .3), (5, 1, .7, .6), (6, 0, .6, float("nan"))]
    df = spark.createDataFrame(rows, "row_id long, label long, a double, b double")
    got, want = (inference.delong(d, "a", "b").head() for d in (df, df.filter("row_id < 6")))
    assert got == want


def test_sign_test_is_exact_for_any_number(spark):
    from math import comb
    for n, k in ((1, 0), (7, 2), (8, 4), (41, 20), (300, 120)):
        p = inference.sign_test(spark.createDataFrame([(1.0 if i < k else -1.0,) for i in range(n)], "diff double")).head()["p"]
        assert p == pytest.approx(min(1.0, 2 * sum(comb(n, i) for i in range(k + 1)) / 2 ** n), rel=1e-11)
    many = spark.range(30000).select(F.when(F.col("id") < 14800, 1.0).otherwise(-1.0).alias("diff"))
    p = inference.sign_test(many).head()["p"]
    assert p == pytest.approx(0.0211, abs=3e-4)


def test_confound_screen_by_hand(spark):
    cells = [("u", 0, 8), ("u", 1, 2), ("v", 0, 3), ("v", 1, 7)]
    rows = [(v, y, float(i)) for v, y, n in cells for i in range(n)]
    df = spark.createDataFrame(rows, "c string, label long, x double")
    got = {r["column"]: r for r in inference.confound_screen(df, ["c", "x"]).collect()}
    assert got["c"]["statistic"] == pytest.approx(3.2323, abs=1e-3) and got["c"]["p"] == pytest.approx(0.0722, abs=1e-3)
    ranked = sorted(x for _, _, x in rows)
    rank = {v: ranked.index(v) + (ranked.count(v) + 1) / 2 for v in set(ranked)}
    n1, n0, n = 9, 11, 20
    u = sum(rank[x] for _, y, x in rows if y) - n1 * (n1 + 1) / 2
    ties = sum(ranked.count(v) ** 3 - ranked.count(v) for v in set(ranked))
    z = (abs(u - n1 * n0 / 2) - 0.5) / (n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))) ** 0.5
    import math
    assert got["x"]["test"] == "mann-whitney" and got["x"]["statistic"] == u and got["x"]["p"] == pytest.approx(math.erfc(z / 2 ** 0.5))
    missing = df.unionByName(spark.createDataFrame([(None, 1, 1.0)] * 3, df.schema))
    assert inference.confound_screen(missing, ["c"]).head()["levels"] == 3
    per_subject = inference.confound_screen(df.withColumn("subject", F.concat("c", F.col("label"))), ["c"], unit="subject")
    assert per_subject.head()["statistic"] == pytest.approx(0.0)


def test_ids_follow_the_order_of_the_keys(spark):
    keys = ["1Z", "1A", "B0", "a0", "", "a", "\u00e9"]
    got = {r["k"]: r["id"] for r in roles.sequential_ids(spark.createDataFrame([(k,) for k in keys], "k string"), "k", "p", "id").collect()}
    assert [got[k] for k in sorted(keys)] == [f"p_{i + 1:04d}" for i in range(len(keys))]
    codes = roles.class_codes(spark.createDataFrame([(x,) for x in (30, -5, 7, None)], "v long"), "v").collect()
    assert {r["v"]: r["code"] for r in codes} == {-5: 0, 7: 1, 30: 2, None: -1}


def test_cohort_is_numbered_without_a_lead_and_carves_validation(spark):
    rows = [(i, f"s{i % 40}", i % 2, "") for i in range(200)]
    d = splits.finish_cohort(spark.createDataFrame(rows, "row_id long, subject string, label long, official_split string"), 1, 0.2, 0.2).collect()
    assert [r["idx"] for r in sorted(d, key=lambda r: r["row_id"])] == list(range(200))
    assert {r["split_source"] for r in d} == {"fallback"} and len({r["split_with_val"] for r in d}) == 3


def test_rows_alike_are_not_multiplied_and_dead_nulls_are_refused(spark):
    rows = [(f"s{v}", v, s, v % 2) for v in range(12) for s in (0, 1, 2) for _ in range(2)]
    df = spark.createDataFrame(rows, "subject string, volume long, slice long, label long")
    cm = roles.resolve_roles(df)
    d = reports.prepare(df, cm)
    assert d.count() == len(rows)
    folds = session.settle(d.join(splits.seeded_folds(d, 3, 0).select("subject", "fold"), "subject"))
    nulls = reports.evaluate(folds, 3, [], set(), n_boot=0, n_perm=3, trees=False)["nulls"].collect()
    assert {r["baseline"]: r["kind"] for r in nulls}["positional_20bin"] == "unavailable"  # every volume has one class
    assert {r["baseline"]: r["kind"] for r in nulls}["volume_size"] == "unavailable"


def test_metadata_columns_with_reserved_names_stay(spark):
    df = spark.createDataFrame([("a", 1, 1, 0, 5.0), ("a", 1, 2, 1, 6.0)], "patient_id string, series_id long, slice_idx long, target long, relpos double")
    cm = roles.resolve_columns(df, metadata=["relpos"])
    assert {r["metadata_relpos"] for r in reports.prepare(df, cm).collect()} == {5.0, 6.0}


def test_late_and_repeated_files_are_counted(spark, tmp_path):
    land, counts, ckpt = (str(tmp_path / x) for x in ("land", "counts", "ckpt"))

    def drop(rows, age):
        os.makedirs(land, exist_ok=True)
        name = os.path.join(land, f"f{len(os.listdir(land))}.json")
        with open(name, "w") as f:
            f.writelines(f'{{"run": "r", "subject": "s", "row_id": {i}, "label": {i % 2}, "score": {i / 10}}}\n' for i in rows)
        os.utime(name, (1_700_000_000 - age, 1_700_000_000 - age))
        ingest.run_ingest(spark, land, counts, ckpt, files_per_trigger=1).awaitTermination()
    drop([1, 2, 2], 0)
    drop([3, 4, 1], 3 * 3600)
    drop([5, 6], 9 * 3600)
    got = ingest.live_auc(spark, counts).head()
    assert (got["n_pos"], got["n_neg"]) == (3, 3) and ingest.refused(spark, counts + "-rows") == 2


def test_ledger_goes_by_event_order(spark, tmp_path):
    land, state = str(tmp_path / "land"), str(tmp_path / "state")
    os.makedirs(land)
    for i, events in enumerate([[(10, "begin")], [(3, "fail"), (12, "note")], [(5, "begin"), (4, "fail")], [(15, "fail")]]):
        with open(f"{land}/{i}.json", "w") as f:
            f.writelines(f'{{"seq": {s}, "cohort": "c", "control": "k", "kind": "{k}"}}\n' for s, k in events)
        ingest.failure_ledger(spark, land, state, state + "-ckpt").awaitTermination()
        now = ingest.latest_ledger(spark, state).head()
        assert now["began"] == 10 and now["n_fail"] == int(i == 3) and now["failed"] == (i == 3)
    assert (now["n_note"], now["updated"]) == (1, 15) and sorted(x for x in os.listdir(state)) == ["version=2", "version=3"]


def test_tables_are_replaced_and_appended(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in (3, 5, 4):
        sinks.replace_table(spark.range(n), path)
        assert sinks.read_current(spark, path).count() == n
    assert len([x for x in os.listdir(path) if x.startswith("version=")]) == 2
    log = str(tmp_path / "log")
    for batch, ids in (("a", range(0, 5)), ("b", range(3, 8)), ("b", range(3, 9)), ("a", range(0, 5))):
        sinks.append_once(spark.createDataFrame([(i,) for i in ids], "id long"), log, ["id"], batch)
    assert sorted(r["id"] for r in spark.read.parquet(log).collect()) == list(range(9))


def test_folders_of_one_machine_are_refused_on_a_cluster(monkeypatch):
    assert [session.is_local(m) for m in ("local", "local[4]", "local-cluster[2,1,1024]", "yarn", "spark://h:7077")] == [True, True, False, False, False]

    class Elsewhere:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"
            getCheckpointDir = staticmethod(lambda: None)
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_dir(Elsewhere)


@pytest.mark.parametrize("rule, want", [(">2", [0, 1, 0, 0]), ("<= 2.5", [1, 0, 0, 0]), ("==x", [0, 0, 1, 0]), ("!= 3", [1, 0, 0, 1]), ("in: 2, 3", [1, 1, 0, 0]), ("IN:x", [0, 0, 1, 0])])
def test_label_rules(spark, rule, want):
    df = spark.createDataFrame([(0, "2"), (1, "3"), (2, "x"), (3, None)], "i long, v string")
    got = [r["y"] for r in df.select("i", binary_label(F.col("v"), rule).alias("y")).orderBy("i").collect()]
    assert got == (want if rule != "!= 3" else [1, 0, 1, 1])
