"""Integrity guards. Each returns the rows that break a rule; an empty result is a pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import group_stats, null_safe_join
from ..session import settle


def require_empty(violations: DataFrame, what: str) -> None:
    """Strict mode: raise with one example when a guard found anything."""
    bad = violations.head(1)
    if bad:
        raise ValueError(f"{what}: {bad[0].asDict()}")


def no_span_guard(df: DataFrame, split_cols, groups=("subject",)) -> DataFrame:
    """Groups with rows in more than one arm of a split column, with the arms as evidence."""
    arms = F.array(*[F.struct(F.lit(g).alias("unit"), F.col(g).cast("string").alias("id"),
                              F.lit(c).alias("column"), F.col(c).cast("string").alias("arm"))
                     for g in groups for c in split_cols])
    d = df.select(F.inline(arms)).filter(F.coalesce(F.col("arm"), F.lit("")) != "").distinct()
    return (d.groupBy("unit", "id", "column").agg(F.count(F.lit(1)).alias("n_arms"),
                                                  F.array_join(F.array_sort(F.collect_list("arm")), ",").alias("arms"))
            .filter(F.col("n_arms") > 1))  # arms are a handful of words


def cv_partition_guard(df: DataFrame, k: int, eligible: Column, subject="subject") -> DataFrame:
    """Subjects for which the folds are not a partition, with the broken rule."""
    roles = F.array(*[F.struct(F.lit(j).cast("long").alias("outer"), F.col(f"cv{j}_split").alias("role"))
                      for j in range(k)])
    d = df.filter(eligible).select(subject, "cv_fold", F.inline(roles)).distinct()
    per = d.groupBy(subject, "outer").agg(
        F.countDistinct("role").alias("n_roles"),
        F.max((~F.coalesce("role", F.lit("")).isin("training", "validation", "test")).cast("int")).alias("none"),
        F.max((F.col("role") == "test").cast("int")).alias("tested"),
        F.max(((F.col("role") == "test") & (F.col("cv_fold") != F.col("outer"))).cast("int")).alias("wrong"),
        F.min("cv_fold").alias("lo"), F.max("cv_fold").alias("hi"))
    g = per.groupBy(subject).agg(
        F.max((F.col("n_roles") > 1).cast("int")).alias("spans"), F.max("none").alias("uncovered"),
        F.sum("tested").alias("n_tests"), F.max("wrong").alias("wrong"),
        F.max((F.col("lo") != F.col("hi")).cast("int")).alias("two_folds"))
    rules = F.array_compact(F.array(
        F.when(F.col("two_folds") == 1, "two folds"), F.when(F.col("spans") == 1, "two roles in a fold"),
        F.when(F.col("uncovered") == 1, "not covered"), F.when(F.col("n_tests") != 1, "not tested once"),
        F.when(F.col("wrong") == 1, "fold label disagrees")))
    return g.select(subject, F.explode(rules).alias("rule"))


def train_test_overlap(parts: DataFrame, subject="subject") -> DataFrame:
    """(partition, subject) pairs in both arms."""
    arm = lambda r: parts.filter(F.col("role") == r).select("partition", subject)
    return arm("train").intersect(arm("test"))


def index_coherence(df: DataFrame, idx="idx", subject="subject", patient="patient", label="label",
                    required=()) -> DataFrame:
    """One row per rule: rows (or keys) that break it."""
    cols = list(required) or [idx, subject, patient, label]
    counts = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in cols],
        F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))).alias("not_binary"))
    dup = df.groupBy(idx).agg(F.count(F.lit(1)).alias("n")).agg(
        F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(0)).alias("duplicate_idx"))
    spread_ = df.groupBy(patient).agg(F.countDistinct(subject).alias("n")).agg(
        F.count_if(F.col("n") > 1).alias("patient_in_two_subjects"))
    one = counts.crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(spread_))  # three one-row results
    return one.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("rule"), F.col(c).cast("long").alias("n_bad")) for c in one.columns])))


def trainable_guard(df: DataFrame, split="split", label="label",
                    needed=("training", "validation", "test"), two_class=("training", "test")) -> DataFrame:
    """Arms that are empty, or single-class where two classes are needed."""
    spine = F.explode(F.array(*[F.lit(x) for x in needed])).alias(split)
    have = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(label).alias("k"))
    d = df.sparkSession.range(1).select(spine).join(have, split, "left")
    why = (F.when(F.col("n").isNull(), "empty")
           .when(F.col(split).isin(*two_class) & (F.col("k") < 2), "single-class"))
    return d.select(split, why.alias("problem")).filter(F.col("problem").isNotNull())


def design_kind(df: DataFrame, subject="subject", label="label", keys=()) -> DataFrame:
    """Paired when every subject has every class of rows, else between-subject."""
    per = df.groupBy(*keys, subject).agg((F.min(label) != F.max(label)).alias("__mixed"))
    return per.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_subjects"), F.count_if("__mixed").alias("n_mixed"),
        F.every("__mixed").alias("paired"))


def keep_first(df: DataFrame, key, order: list, keep_col="path", out="kept_path") -> DataFrame:
    """Every row with the kept row of its key: the smallest by ``order``.

    ``min(struct)`` is a partial aggregate, so a key with very many copies is never sorted in
    one task.
    """
    fields = [c.alias(f"o{i}") for i, c in enumerate(order)]
    best = F.min(F.struct(*fields, F.col(keep_col).alias("kept"))).alias("__best")
    key = [key] if isinstance(key, str) else list(key)
    d = group_stats(df, key, best, F.count(F.lit(1)).alias("n_copies"))
    return d.withColumn(out, F.col("__best.kept")).withColumn("is_kept", F.col(keep_col) == F.col(out)).drop("__best")


def dedup_basename(df: DataFrame, basename="basename", canonical="canonical", path="path") -> DataFrame:
    """One row per basename: the canonical tree wins, then the smallest path."""
    return keep_first(df, basename, [~F.col(canonical), F.col(path)], path)


def dedup_identity(df: DataFrame, key, fingerprint="fingerprint", path="path") -> DataFrame:
    """Same key and same content: a dropped copy. Same key, other content: a kept repeat."""
    d = keep_first(df, [*key, fingerprint], [F.col(path)], path)
    firsts = d.filter("is_kept").groupBy(*key).agg(F.min(path).alias("__first"))
    d = null_safe_join(d, firsts, list(key))
    state = (F.when(~F.col("is_kept"), "identical copy").when(F.col(path) == F.col("__first"), "first")
             .otherwise("kept repeat"))
    return d.withColumn("state", state).drop("__first")


def dedup_exam(df: DataFrame, measurement="measurement_id", file="path") -> DataFrame:
    """First file per measurement id; a blank id stands for itself."""
    key = F.coalesce(F.nullif(F.col(measurement), F.lit("")), F.concat(F.lit("__no_id__"), F.col(file)))
    return keep_first(df.withColumn("exam", key), "exam", [F.col(file)], file)


def disjoint_collections(df: DataFrame, basename="basename", collection="collection") -> DataFrame:
    return (df.select(basename, collection).distinct().groupBy(basename)
            .agg(F.count(F.lit(1)).alias("n_collections")).filter(F.col("n_collections") > 1))


def first_seen_dedup(df: DataFrame, item="item", block="block") -> DataFrame:
    """Later occurrences of an item with the block that had it first."""
    d = group_stats(df, [item], F.min(block).alias("first_block"))
    return d.filter(F.col(block) > F.col("first_block"))


def nesting_audit(df: DataFrame, levels=("series", "study", "patient"), lookup: DataFrame | None = None) -> DataFrame:
    """One row: keys of each level with more than one parent or child, and lookup coverage."""
    a, b, c = levels
    df = settle(df.select(*levels))
    def multi(child, parent, name):
        # more than one parent: the smallest and the largest differ, or some are missing; no pair is shuffled
        lo, hi, n = F.min(parent), F.max(parent), F.count(parent)
        g = df.groupBy(child).agg(((lo != hi) | ((n > 0) & (n < F.count(F.lit(1))))).alias("many"))
        return g.agg(F.count_if("many").alias(name))
    out = df.agg(F.count(F.lit(1)).alias("n_rows"))
    pieces = [multi(a, b, f"{a}_in_many_{b}"), multi(b, c, f"{b}_in_many_{c}"),
              multi(c, b, f"{c}_with_many_{b}"), multi(c, a, f"{c}_with_many_{a}")]
    if lookup is not None:
        pieces.append(df.select(a).distinct().join(lookup.select(a).distinct(), a, "left_anti")
                      .agg(F.count(F.lit(1)).alias(f"{a}_without_lookup")))
    for p in pieces:  # one-row results
        out = out.crossJoin(F.broadcast(p))
    return out


def release_reconcile(official: DataFrame, mirror: DataFrame, key: str, kinds, any_col="any") -> DataFrame:
    """Official long labels pivoted wide against a mirror: presence counts and disagreements.

    Exact duplicates collapse; a key whose duplicates conflict is counted and left out.
    """
    cell = official.groupBy(key, "kind").agg(F.min("label").alias("lo"), F.max("label").alias("hi"))
    clash = cell.filter(F.col("lo") != F.col("hi")).select(key).distinct()
    wide = (cell.join(clash, key, "left_anti").groupBy(key).pivot("kind", list(kinds)).agg(F.max("lo")))
    m = mirror.select(key, *[F.col(k).alias(f"m_{k}") for k in kinds], F.lit(1).alias("__m"))
    j = wide.withColumn("__o", F.lit(1)).join(m, key, "full_outer")
    both = F.col("__o").isNotNull() & F.col("__m").isNotNull()
    parts = F.greatest(*[F.col(k) for k in kinds if k != any_col])
    res = j.agg(F.count_if(both).alias("in_both"),
                F.count_if(F.col("__m").isNull()).alias("only_official"),
                F.count_if(F.col("__o").isNull()).alias("only_mirror"),
                *[F.count_if(both & (F.col(k) != F.col(f"m_{k}"))).alias(f"differ_{k}") for k in kinds],
                F.count_if(F.col("__o").isNotNull() & (F.col(any_col) != parts)).alias("any_not_or"))
    return res.crossJoin(F.broadcast(clash.agg(F.count(F.lit(1)).alias("conflicting"))))


def join_accounting(labels: DataFrame, data: DataFrame, key: str, label="label"):
    """(one row of counts, data rows with label -1 where none was given)."""
    l, d = labels.select(key).distinct(), data.select(key).distinct()
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name), F.min(key).alias(f"example_{name}"))
    counts = (n(l.join(d, key, "left_anti"), "labelled_no_data")
              .crossJoin(F.broadcast(n(d.join(l, key, "left_anti"), "data_no_label")))
              .crossJoin(F.broadcast(n(d.join(l, key, "left_semi"), "matched"))))
    rows = data.join(labels, key).unionByName(
        data.join(labels, key, "left_anti").withColumn(label, F.lit(-1).cast("long")), allowMissingColumns=True)
    return counts, rows


def slice_index_check(df: DataFrame, declared: DataFrame, keys=("volume",), pos="slice", depth="depth") -> DataFrame:
    """Files whose counter does not cover 1..declared depth."""
    g = df.groupBy(*keys).agg(F.min(pos).alias("first"), F.max(pos).alias("last"),
                              F.countDistinct(pos).alias("n"))
    d = declared.join(g, list(keys), "left")
    ok = (F.col("first") == 1) & (F.col("last") == F.col(depth)) & (F.col("n") == F.col(depth))
    return d.filter(~F.coalesce(ok, F.lit(False)))


def header_vs_array(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.filter(~F.col(a).eqNullSafe(F.col(b)))


def value_recheck(stored: DataFrame, again: DataFrame, key, value="value", tol=1e-6) -> DataFrame:
    """Compared, max and mean absolute difference, and mismatches above the tolerance."""
    key = [key] if isinstance(key, str) else list(key)
    j = stored.select(*key, F.col(value).alias("__a")).join(again.select(*key, F.col(value).alias("__b")), key)
    d = F.abs(F.col("__a") - F.col("__b"))
    return j.agg(F.count(d).alias("n_compared"), F.max(d).alias("max_delta"), F.avg(d).alias("mean_delta"),
                 F.count_if(d > tol).alias("n_mismatch"))


def oof_pool(preds: DataFrame, unit, expected_folds: int, fold="fold", row="row_id", subject="subject",
             label="label"):
    """(pooled rows of accepted units, report per unit).

    A unit is refused when a row id or a subject occurs in two folds (or a row twice in one);
    missing and single-class folds are reported.
    """
    unit = list(unit)
    dup_rows = (preds.groupBy(*unit, row).agg(F.count(F.lit(1)).alias("n")).groupBy(*unit)
                .agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("duplicate_rows")))
    dup_subj = (preds.select(*unit, subject, fold).distinct().groupBy(*unit, subject)
                .agg(F.count(F.lit(1)).alias("n")).groupBy(*unit)
                .agg(F.sum(F.when(F.col("n") > 1, 1).otherwise(0)).alias("duplicate_subjects"),
                     F.count(F.lit(1)).alias("n_subjects")))
    folds = (preds.groupBy(*unit, fold).agg(F.min(label).alias("lo"), F.max(label).alias("hi"), F.count(F.lit(1)).alias("n"))
             .groupBy(*unit).agg(F.count(F.lit(1)).alias("n_folds"), F.sum("n").alias("n_rows"),
                                 F.sum(F.when(F.col("lo") == F.col("hi"), 1).otherwise(0)).alias("single_class_folds")))
    rep = null_safe_join(null_safe_join(folds, dup_rows, unit), dup_subj, unit)
    rep = (rep.withColumn("missing_folds", F.lit(expected_folds) - F.col("n_folds"))
           .withColumn("accepted", (F.col("duplicate_rows") == 0) & (F.col("duplicate_subjects") == 0)))
    return preds.join(rep.filter("accepted").select(*unit), unit, "left_semi"), rep


def align_pair(a: DataFrame, b: DataFrame, row="row_id", label="label", score="score"):
    """(complete aligned rows, one-row report); any one-sided row or label clash refuses the pair."""
    j = (a.select(row, "subject", F.col(label).alias("y_a"), F.col(score).alias("score_a"))
         .join(b.select(row, F.col("subject").alias("__sb"), F.col(label).alias("y_b"), F.col(score).alias("score_b")), row, "full_outer"))
    rep = j.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("y_b").isNull()).alias("only_a"),
                F.count_if(F.col("y_a").isNull()).alias("only_b"),
                F.count_if(F.col("y_a") != F.col("y_b")).alias("label_clash"))
    rep = rep.withColumn("accepted", (F.col("only_a") + F.col("only_b") + F.col("label_clash")) == 0)
    fin = lambda c: F.col(c).isNotNull() & ~F.isnan(c)
    rows = (j.crossJoin(F.broadcast(rep.select("accepted"))).filter("accepted").drop("accepted")
            .filter(fin("score_a") & fin("score_b"))
            .select(row, "subject", F.col("y_a").alias(label), "score_a", "score_b"))
    return rows, rep


def align_methods(preds: DataFrame, method="method", row="row_id", label="label", score="score",
                  subject="subject", volume="volume"):
    """(rows usable in every kept method, one-row unit choice).

    The reference row set is the largest one; a method with another set is dropped, and a row
    that is not finite in one method leaves all of them. When subjects are single-class the
    aggregated unit falls back to the scan.
    """
    h = F.xxhash64(row)
    sets = preds.groupBy(method).agg(F.count(F.lit(1)).alias("n"), F.bit_xor(h).alias("mix"),
                                     F.sum(F.pmod(h, F.lit(1000003))).alias("mod"))
    ref = sets.groupBy("n", "mix", "mod").agg(F.count(F.lit(1)).alias("k")).agg(
        F.max(F.struct("k", "n", "mix", "mod")).alias("r")).select("r.*")
    kept = sets.join(F.broadcast(ref), ["n", "mix", "mod"]).select(method, "k")
    d = preds.join(F.broadcast(kept), method)
    fin = F.col(score).isNotNull() & ~F.isnan(score)
    d = group_stats(d, [row], F.sum(fin.cast("long")).alias("__ok")).filter(F.col("__ok") == F.col("k")).drop("__ok", "k")
    per = d.groupBy(subject).agg(F.max(label).alias("y")).agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    unit = per.select(F.when(F.col("lo") == F.col("hi"), volume).otherwise(subject).alias("unit"))
    return d, unit


def collect_methods(preds: DataFrame, source="source", keys=("method", "condition", "seed"),
                    folds="n_folds", expected=None):
    """(chosen source per key, dropped ones with a note): complete pools first, then more folds,
    then the earlier source."""
    ok = F.col(folds) >= expected if expected else F.lit(True)
    order = F.struct((~ok).alias("a"), (-F.col(folds)).alias("b"), F.col(source).alias("c"))
    best = preds.groupBy(*keys).agg(F.min(order).alias("best"))
    d = null_safe_join(preds, best, list(keys))
    note = (F.when(~ok, "incomplete pool").when(F.col(source) != F.col("best.c"), "shadowed"))
    return d.select(*keys, source, folds, note.alias("note"))


def rule_violations(df: DataFrame) -> DataFrame:
    """Excluded although unreachable and not excluded at stage 1."""
    return df.filter((F.col("decision") == "excluded") & F.col("access").startswith("unreachable")
                     & (F.col("stage1") != "exclude"))
