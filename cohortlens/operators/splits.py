"""Subject-level splits, folds, draws and frames, all from hashes of the subject key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, hash_unit, unit_draw
from ..functions.prefix import group_stats, null_safe_join, number_rows, spread


def subject_labels(df: DataFrame, subject="subject", label="label", keys=()) -> DataFrame:
    """One row per subject: the label is the largest of its rows."""
    return df.groupBy(*keys, subject).agg(F.max(label).alias(label))


def hash_ranked(subj: DataFrame, strata, h: Column, subject="subject", out="rank") -> DataFrame:
    """Rank of each subject inside its stratum by hash, and the size of the stratum.

    Strata are few and large, so the rank is always computed in hash buckets.
    """
    d = subj.withColumn("__h", h)
    d = number_rows(d, strata, ["__h", subject], F.col("__h"), out, by_share=True)
    n = subj.groupBy(*strata).agg(F.count(F.lit(1)).alias("size"))
    return null_safe_join(d, n, strata).drop("__h")


def stratified_split(df: DataFrame, seed: int, val_frac: float, test_frac: float,
                     subject="subject", label="label") -> DataFrame:
    """(subject, label, split): test first, then validation, the rest training, per label."""
    r = hash_ranked(subject_labels(df, subject, label), [label], hash_unit(F.col(subject), seed), subject)
    n = F.col("size")
    test = F.least(F.bround(n * F.lit(test_frac)), F.greatest(F.lit(0), n - 1))
    val = F.least(F.bround(n * F.lit(val_frac)), F.greatest(F.lit(0.0), n - test - 1))
    i = F.col("rank") - 1
    return r.select(subject, label, F.when(i < test, "test").when(i < test + val, "validation")
                    .otherwise("training").alias("split"))


def carve_validation(df: DataFrame, seed: int, val_frac: float, subject="subject", label="label",
                     split="split", out="split_with_val") -> DataFrame:
    """Where no validation rows exist, a hashed share of training subjects becomes validation."""
    has = df.agg(F.coalesce(F.max((F.col(split) == "validation").cast("int")), F.lit(0)).alias("__has"))
    train = df.filter(F.col(split) == "training")
    r = hash_ranked(subject_labels(train, subject, label), [label], hash_unit(F.col(subject), seed + 977), subject)
    n = F.col("size")
    take = F.least(F.bround(n * F.lit(val_frac)), F.greatest(F.lit(0), n - 1))
    picks = r.filter(F.col("rank") <= take).select(subject, F.lit(1).alias("__pick"))
    d = df.join(picks, subject, "left").crossJoin(F.broadcast(has))
    move = (F.col("__has") == 0) & (F.col(split) == "training") & F.col("__pick").isNotNull()
    return d.withColumn(out, F.when(move, "validation").otherwise(F.col(split))).drop("__pick", "__has")


def stratum_offset(label: Column, k: int, seed: int) -> Column:
    """Fold at which a stratum starts dealing: 32 bits of sha1('seed|stratum|label') mod k."""
    hexed = F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.lit("stratum"), label.cast("string"))), 1, 8)
    return F.conv(hexed, 16, 10).cast("long") % k


def stratified_kfold(df: DataFrame, k: int, seed: int, subject="subject", label="label") -> DataFrame:
    """(subject, label, fold): hash-ranked subjects of a label dealt round-robin from its offset."""
    if k < 2:
        raise ValueError("cross-validation needs k >= 2")
    r = hash_ranked(subject_labels(df, subject, label), [label], hash_unit(F.col(subject), seed), subject)
    return r.select(subject, label, ((F.col("rank") - 1 + stratum_offset(F.col(label), k, seed)) % k).alias("fold"))


def seeded_folds(df: DataFrame, k: int, seed: int, subject="subject", label="label") -> DataFrame:
    """(subject, label, fold): a seeded permutation per label, dealt from fold 0."""
    r = hash_ranked(subject_labels(df, subject, label), [label], unit_draw(seed, F.col(subject)), subject)
    return r.select(subject, label, ((F.col("rank") - 1) % k).alias("fold"))


def inner_validation(folds: DataFrame, k: int, seed: int, frac: float, subject="subject", label="label") -> DataFrame:
    """(outer, subject, role) for every fold: test, or training with a stratified inner validation."""
    outer = F.array(*[F.lit(j).cast("long") for j in range(k)])
    d = folds.select(subject, label, "fold", F.explode(outer).alias("outer"))
    test = d.filter(F.col("fold") == F.col("outer")).select("outer", subject, F.lit("test").alias("role"))
    rest = d.filter(F.col("fold") != F.col("outer"))
    h = hash_unit(F.col(subject), (F.lit(seed) + 10007 * (F.col("outer") + 1)).cast("string"))
    r = hash_ranked(rest, ["outer", label], h, subject)
    take = F.least(F.bround(F.col("size") * F.lit(frac)), F.greatest(F.lit(0), F.col("size") - 1))
    role = F.when(F.col("rank") <= take, "validation").otherwise("training")
    return test.unionByName(r.select("outer", subject, role.alias("role")))


def nested_cv_columns(df: DataFrame, k: int, seed: int, frac: float, eligible: Column,
                      subject="subject", label="label") -> DataFrame:
    """``cv_fold`` and one ``cv<j>_split`` column per fold on every row.

    A subject without an eligible row has fold -1; an ineligible row has empty roles.
    """
    ok = df.filter(eligible)
    folds = stratified_kfold(ok, k, seed, subject, label)
    roles = (inner_validation(folds, k, seed, frac, subject, label).groupBy(subject)
             .pivot("outer", list(range(k))).agg(F.first("role")))
    for j in range(k):
        roles = roles.withColumnRenamed(str(j), f"__r{j}")
    d = df.join(folds.select(subject, F.col("fold").alias("__fold")), subject, "left").join(roles, subject, "left")
    d = d.withColumn("cv_fold", F.coalesce("__fold", F.lit(-1)).cast("long"))
    for j in range(k):
        d = d.withColumn(f"cv{j}_split", F.when(F.coalesce(eligible, F.lit(False)), F.coalesce(f"__r{j}", F.lit("")))
                         .otherwise(""))
    return d.drop("__fold", *[f"__r{j}" for j in range(k)])


def promote_split(df: DataFrame, column: str, out="split"):
    """(rows with the column as active split, one-row count of the unassigned rows dropped)."""
    assigned = F.coalesce(F.col(column), F.lit("")) != ""
    return (df.filter(assigned).withColumn(out, F.col(column)),
            df.agg(F.count_if(~assigned).alias("n_dropped")))


def build_partitions(df: DataFrame, k: int, seed: int, arm: str | None = None, val_as: str | None = None,
                     subject="subject", label="label") -> DataFrame:
    """Rows with (partition, role). A published split that has both arms is one partition;
    otherwise K subject folds, each row once as test and K-1 times as train."""
    if arm:
        a = F.col(arm)
        if val_as:
            a = F.when(a == "val", val_as).otherwise(a)
        d = df.withColumn("role", a).filter(F.col("role").isin("train", "test"))
        found = {r[0] for r in d.select("role").distinct().limit(2).collect()}
        if found == {"train", "test"}:
            return d.withColumn("partition", F.lit(0).cast("long"))
    f = seeded_folds(df, k, seed, subject, label).select(subject, "fold")
    parts = F.explode(F.array(*[F.lit(j).cast("long") for j in range(k)])).alias("partition")
    return (df.join(f, subject).select("*", parts)
            .withColumn("role", F.when(F.col("fold") == F.col("partition"), "test").otherwise("train")).drop("fold"))


def finish_cohort(df: DataFrame, seed: int, val_frac: float, test_frac: float, official="official_split",
                  order=("row_id",), lead: Column | None = None, subject="subject", label="label") -> DataFrame:
    """Official split where given, else the fallback; its source, a carved validation, a row index.

    ``lead`` cuts the order into buckets; by default the first column of ``order``, which is then a number.
    """
    fallback = stratified_split(df, seed, val_frac, test_frac, subject, label).select(
        subject, F.col("split").alias("fallback_split"))
    given = F.nullif(F.col(official), F.lit(""))
    d = (df.join(fallback, subject).withColumn("split", F.coalesce(given, F.col("fallback_split")))
         .withColumn("split_source", F.when(given.isNotNull(), "official").otherwise("fallback")))
    d = carve_validation(d, seed, val_frac, subject, label)
    d = number_rows(d, [], list(order), spread(F.col(order[0])) if lead is None else lead, "idx")
    return d.withColumn("idx", F.col("idx") - 1)


def frozen_holdout(df: DataFrame, seeds, frac=0.3, subject="subject") -> DataFrame:
    """(seed, subject, held_out): one subject-disjoint holdout per seed."""
    s = df.select(subject).distinct().select(
        subject, F.explode(F.array(*[F.lit(x).cast("long") for x in seeds])).alias("seed"))
    r = hash_ranked(s, ["seed"], unit_draw(F.col("seed"), F.col(subject)), subject)
    return r.select("seed", subject, (F.col("rank") <= F.bround(F.col("size") * F.lit(float(frac)))).alias("held_out"))


def repeated_random_split(df: DataFrame, n_draws: int, fractions, unit="volume") -> DataFrame:
    """(draw, unit, arm): draws of a published geometry, e.g. (0.25, 0.25, 0.5) -> arms 0, 1, 2."""
    s = df.select(unit).distinct().select(
        unit, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_draws - 1).cast("long"))).alias("draw"))
    r = hash_ranked(s, ["draw"], unit_draw("split", F.col("draw"), F.col(unit)), unit)
    arm, upto = F.lit(len(fractions) - 1), 0.0
    for i in reversed(range(len(fractions) - 1)):
        upto = sum(fractions[: i + 1])
        arm = F.when(F.col("rank") <= F.bround(F.col("size") * F.lit(float(upto))), i).otherwise(arm)
    return r.select("draw", unit, arm.cast("long").alias("arm"))


def group_split_fresh(df: DataFrame, strata: str, fracs, seed: int, group="subject") -> DataFrame:
    """(group, stratum, split) stratified on the group's modal value, with minimum sizes."""
    from .geometry import modal_group_value
    g = modal_group_value(df, [group], strata, "stratum").select(group, "stratum")
    r = hash_ranked(g, ["stratum"], unit_draw(seed, F.col(group)), group)
    n = F.col("size")
    val = F.when(n >= 3, F.greatest(F.lit(1), F.bround(n * F.lit(fracs[1])))).otherwise(0)
    tr = F.least(F.greatest(F.lit(1), F.bround(n * F.lit(fracs[0]))),
                 F.greatest(F.lit(1), n - val - F.when(n >= 3, 1).otherwise(0)))
    return r.select(group, "stratum", F.when(F.col("rank") <= tr, "training")
                    .when(F.col("rank") <= tr + val, "validation").otherwise("test").alias("split"))


def balanced_arms(counts: DataFrame, value: str, n="n") -> DataFrame:
    """Largest category first, each to the smaller arm ('a' on a tie).

    The fold is sequential, so the category counts become one array; the categories of an
    acquisition column are few, and a column with more than 100,000 is refused.
    """
    packed = counts.agg(F.collect_list(F.struct((-F.col(n)).alias("neg"), F.col(value).alias("v"))).alias("xs"),
                        F.count(F.lit(1)).alias("k"))
    xs = F.when(F.col("k") > 100_000, F.raise_error(F.lit("too many categories to balance"))) \
        .otherwise(F.array_sort("xs"))
    zero = F.expr("named_struct('na', 0L, 'nb', 0L, 'arms', cast(array() as array<string>))")
    step = lambda acc, x: F.struct(
        F.when(acc["na"] <= acc["nb"], acc["na"] - x["neg"]).otherwise(acc["na"]).alias("na"),
        F.when(acc["na"] <= acc["nb"], acc["nb"]).otherwise(acc["nb"] - x["neg"]).alias("nb"),
        F.concat(acc["arms"], F.array(F.when(acc["na"] <= acc["nb"], "a").otherwise("b"))).alias("arms"))
    folded = packed.select(xs.alias("xs")).select("xs", F.aggregate("xs", zero, step)["arms"].alias("arms"))
    return folded.select(F.inline(F.arrays_zip("xs", "arms"))).select(
        F.col("xs.v").alias(value), (-F.col("xs.neg")).alias(n), F.col("arms").alias("arm"))


def acquisition_holdout(df: DataFrame, key: str, subject="subject", label="label") -> DataFrame:
    """(direction, subject, split, trainable): train on one arm of a property, test on the other."""
    from .geometry import modal_group_value
    g = modal_group_value(df, [subject], key, "value").select(subject, "value")
    arms = balanced_arms(g.groupBy("value").agg(F.count(F.lit(1)).alias("n")), "value").select("value", "arm")
    dirs = F.array(F.struct(F.lit("a2b").alias("direction"), F.lit("a").alias("tr")),
                   F.struct(F.lit("b2a").alias("direction"), F.lit("b").alias("tr")))
    s = g.join(arms, "value").select(subject, "arm", F.inline(dirs))
    s = s.withColumn("split", F.when(F.col("arm") == F.col("tr"), "training").otherwise("test"))
    classes = (df.groupBy(subject).agg(F.max(label).alias("hi"), F.min(label).alias("lo")).join(s, subject)
               .groupBy("direction", "split").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"))
               .groupBy("direction").agg(((F.count(F.lit(1)) == 2) & F.every(F.col("hi") != F.col("lo"))).alias("trainable")))
    return s.join(F.broadcast(classes), "direction").select("direction", subject, "split", "trainable")


def split_summary(df: DataFrame, split="split", group="subject", label="label") -> DataFrame:
    return df.groupBy(split).agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(group).alias("n_groups"),
                                 F.sum(label).alias("n_pos"))


def inverse_class_weights(df: DataFrame, label="label", seed=0, row="row_id") -> DataFrame:
    """Row weight 1/class count, and a weighted resample count per row by hashed Poisson draws.

    The class table has one row per class; a single class is an error.
    """
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    total = n.agg(F.count(F.lit(1)).alias("__k"), F.sum("__n").alias("__all"))
    d = df.join(n, label).crossJoin(F.broadcast(total))
    d = d.withColumn("weight", F.when(F.col("__k") < 2, F.raise_error(F.lit("single-class labels")))
                     .otherwise(1.0 / F.col("__n")))
    # expected copies of a row: share of its class in a balanced table of the same size
    mean = F.col("__all") / F.col("__k") * F.col("weight")
    u = unit_draw("resample", seed, F.col(row))
    d = d.withColumn("copies", F.floor(mean) + F.when(u < mean - F.floor(mean), 1).otherwise(0))
    return d.drop("__n", "__k", "__all")


def sampling_frame(ids: DataFrame, col: str, seed, spans: dict[str, tuple[int, int]], reserve="reserve",
                   batches=("batch_a", "batch_b", "batch_c", "batch_d")) -> DataFrame:
    """De-duplicated ids in a seeded order; positions allocated to named spans.

    Positions of the reserve span are dealt round-robin to the batches.
    """
    u = ids.select(F.col(col).alias("id")).distinct()
    p = number_rows(u.withColumn("__h", unit_draw(seed, F.col("id"))), [], ["__h", "id"], F.col("__h"),
                    "position", by_share=True).drop("__h")
    span = F.lit(None).cast("string")
    for name, (a, b) in spans.items():
        span = F.when(F.col("position").between(a, b), name).otherwise(span)
    p = p.withColumn("span", span)
    start = spans[reserve][0]
    names = F.array(*[F.lit(b) for b in batches])
    return p.withColumn("assigned_to", F.when(F.col("span") == reserve, F.element_at(
        names, ((F.col("position") - start) % len(batches) + 1).cast("int"))))


def frame_digest(ids: DataFrame, col: str) -> DataFrame:
    """Order-free digest of a set of ids: count, and the sum of 52-bit hashes per 4096 buckets mixed.

    A digest of one concatenated list would need the whole list in one task.
    """
    h = draw(F.col(col))
    return ids.select(col).distinct().agg(
        F.count(F.lit(1)).alias("n"), F.sum((h % 1000003)).alias("mod_sum"), F.bit_xor(h).alias("mixed"))


def frame_drift(old: DataFrame, new: DataFrame, col: str) -> DataFrame:
    """Ids only in one of two frames."""
    a, b = old.select(col).distinct(), new.select(col).distinct()
    return (a.join(b, col, "left_anti").withColumn("change", F.lit("dropped"))
            .unionByName(b.join(a, col, "left_anti").withColumn("change", F.lit("added"))))


MIN_SUBJECTS, MIN_PER_CLASS = 10, 5  # fixed values: smallest readable test fold


def fold_counts(subj: DataFrame, k_values, seed: int, subject="subject", label="label") -> DataFrame:
    """(k, fold): test subjects and positives for several K at once, and whether the fold is readable."""
    r = hash_ranked(subj, [label], hash_unit(F.col(subject), seed), subject)
    ks = F.explode(F.array(*[F.lit(k).cast("long") for k in k_values])).alias("k")
    d = r.select(subject, label, "rank", ks)
    hexed = F.substring(F.sha1(F.concat_ws("|", F.lit(str(seed)), F.lit("stratum"), F.col(label).cast("string"))), 1, 8)
    fold = (F.col("rank") - 1 + F.conv(hexed, 16, 10).cast("long") % F.col("k")) % F.col("k")
    per = d.groupBy("k", fold.alias("fold"), label).agg(F.count(F.lit(1)).alias("n"))
    classes = subj.select(label).distinct().agg(F.count(F.lit(1)).alias("n_classes"))
    g = per.groupBy("k", "fold").agg(F.sum("n").alias("n_subjects"), F.min("n").alias("__min"),
                                     F.count(F.lit(1)).alias("__present"))
    g = g.crossJoin(F.broadcast(classes)).withColumn(
        "min_class", F.when(F.col("__present") < F.col("n_classes"), 0).otherwise(F.col("__min")))
    return g.withColumn("clears", (F.col("n_subjects") >= MIN_SUBJECTS) & (F.col("min_class") >= MIN_PER_CLASS)
                        & (F.col("n_classes") > 1)).select("k", "fold", "n_subjects", "min_class", "clears")


def fold_gate_sweep(df: DataFrame, seed: int, k_max=12, subject="subject", label="label") -> DataFrame:
    """Per K in 2..k_max: does every fold clear the gate; and the largest K that does."""
    c = fold_counts(subject_labels(df, subject, label), range(2, k_max + 1), seed, subject, label)
    g = c.groupBy("k").agg(F.min("n_subjects").alias("min_subjects"), F.min("min_class").alias("min_class"),
                           (F.every("clears") & (F.count(F.lit(1)) == F.col("k"))).alias("all_clear"))
    best = g.filter("all_clear").agg(F.max("k").alias("largest_k"))
    return g.crossJoin(F.broadcast(best))


def viable_classes(df: DataFrame, k: int, seed: int, subject="subject", label="label") -> DataFrame:
    """Classes with enough subjects for K folds, the share of rows they keep, and the gate on them."""
    per = df.groupBy(label).agg(F.countDistinct(subject).alias("n_subjects"), F.count(F.lit(1)).alias("n_rows"))
    per = per.withColumn("kept", F.col("n_subjects") >= k * MIN_PER_CLASS)
    rest = df.join(per.filter("kept").select(label), label, "left_semi")
    gate = fold_counts(subject_labels(rest, subject, label), [k], seed, subject, label).agg(
        F.coalesce(F.every("clears"), F.lit(False)).alias("clears_gate"))
    tot = per.agg((F.sum(F.when(F.col("kept"), F.col("n_rows")).otherwise(0)) / F.sum("n_rows")).alias("kept_fraction"))
    return per.crossJoin(F.broadcast(tot)).crossJoin(F.broadcast(gate))
