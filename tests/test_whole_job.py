"""Registered queries do the whole job of their operators."""

from inspect import signature

import pytest

from cohortlens.operators import reports as rp
from cohortlens.operators import resample as r
from cohortlens.plans import reports, resampling, tables, views
from cohortlens.plans.catalog import REGISTRY


def default(f, name):
    return signature(f).parameters[name].default


def test_replicates_and_permutations_are_the_defaults():
    assert resampling.B == default(r.cluster_bootstrap_auc, "n_boot") == default(rp.bundle, "n_boot") == 2000
    assert resampling.P == default(rp.audit, "n_perm") == 20


def test_reports_use_them_too(monkeypatch):
    class Called(Exception):
        pass

    def stop(*a, **k):
        raise Called(k)

    class Any:
        def __getattr__(self, name):
            return lambda *a, **k: self
        ev_deep = property(lambda self: self)
    monkeypatch.setattr(reports.rp, "audit", stop)
    monkeypatch.setattr(reports, "F", Any())
    with pytest.raises(Called) as e:
        REGISTRY["audit_report"].build(Any())
    assert (e.value.args[0]["n_boot"], e.value.args[0]["n_perm"]) == (2000, 20)


def test_resumable_append_reads_all_rows(spark, monkeypatch):
    seen, resume = [], tables.s.resume
    monkeypatch.setattr(tables.s, "resume", lambda sl, *a: seen.append(sl.count()) or resume(sl, *a))
    t = views.Tables(spark, "/root/testdata/sf0.001")
    REGISTRY["resumable_append"].build(t)
    assert seen == [t.table("lineitem").count()]


def plain_delong(y, a, b):
    """Difference, standard error, z, p and interval from all placements."""
    import math
    import numpy as np
    y, place = np.array(y), []
    for s in (np.array(a), np.array(b)):
        won = (s[y == 1][:, None] > s[y == 0]) + (s[y == 1][:, None] == s[y == 0]) / 2
        place.append((won.mean(axis=1), won.mean(axis=0)))
    diff = place[0][0].mean() - place[1][0].mean()
    se = math.sqrt(sum(np.var(u - v, ddof=1) / len(u) for u, v in zip(place[0], place[1])))
    return diff, se, diff / se, math.erfc(abs(diff / se) / math.sqrt(2)), diff - 1.959963984540054 * se, diff + 1.959963984540054 * se


def test_conditions_are_compared_to_the_end(spark):
    """DeLong goes on to p and interval, and the subject-resampled difference stands beside it, at all three levels."""
    import numpy as np
    from cohortlens.operators import inference
    rng = np.random.default_rng(6)
    rows = [(i, f"s{i % 24}", int(i % 24 < 10), c, float(np.round(rng.random() + (i % 24 < 10) * w, 2))) for i in range(144) for c, w in (("a", 0.1), ("b", 0.4))]
    rows.append((144, "s0", 1, "a", None)), rows.append((144, "s0", 1, "b", 9.0))
    df = spark.createDataFrame([("m", *x) for x in rows], "method string, row_id long, subject string, label long, condition string, score double")
    got = {x.level: x for x in inference.compare_conditions(df, n_boot=100, seed=4).collect()}
    assert set(got) == {"slice", "patient_mean", "patient_max"}
    whole = [x for x in rows if x[0] < 144]
    of = lambda c: [x[4] for x in whole if x[3] == c]
    x, y = got["slice"], [z[2] for z in whole if z[3] == "a"]
    assert (x["diff"], x.se_diff, x.z, x.p, x.ci_lo, x.ci_hi) == tuple(pytest.approx(v, abs=1e-9) for v in plain_delong(y, of("a"), of("b")))
    wide = spark.createDataFrame([(z[1], z[2], u, v) for z, u, v in zip([z for z in whole if z[3] == "a"], of("a"), of("b"))], "subject string, label long, sa double, sb double")
    want = r.bootstrap_auc_diff(wide, "sa", "sb", 100, 4).head()
    assert (x.boot_used, x.boot_lo, x.boot_hi, x.boot_p) == (100, *[pytest.approx(v, abs=1e-12) for v in (want.ci_lo, want.ci_hi, want.p)])
    for x in got.values():
        assert x.ci_lo < x["diff"] < x.ci_hi and x.boot_lo < x["diff"] < x.boot_hi and 0 < x.p <= 1 and x.boot_used == 100


def test_a_refused_comparison_keeps_its_areas(spark):
    from cohortlens.operators import inference
    d = spark.createDataFrame([(i, i % 2, float(i), float(i)) for i in range(8)], "row_id long, label long, a double, b double")
    x = inference.delong(d, "a", "b").head()
    assert x.reason == "degenerate variance" and x.auc_a == x.auc_b is not None and (x.se_diff, x.z, x.p, x.ci_lo, x.ci_hi) == (None,) * 5
