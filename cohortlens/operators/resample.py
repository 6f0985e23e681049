"""Subject-clustered bootstrap and permutation nulls.

Draws are hashes, shared by every method, scheme and unit of one call. The rows of a subject are
collapsed to (score, p, n) cells before they meet the draws, so a replicate costs as many rows as
there are cells, never as many as there are rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import prefix
from ..functions.draws import draw, poisson_weight, unit_draw
from ..functions.prefix import group_stats, merged, null_safe_join, number_rows, spread, tasks_for
from ..functions.rules import snap, usable
from ..session import settle
from . import metrics as m
from . import replicates

MIN_USED = 20  # fixed value: fewer evaluable replicates give no interval


def subject_cells(df: DataFrame, keys=(), subject="subject", score="score", label="label") -> DataFrame:
    """(keys, subject, s, p, n) counts of usable rows."""
    return m.score_counts(df, [*keys, subject], score, label)


def index_units(units: DataFrame, unit="subject") -> DataFrame:
    """(unit, idx, k): dense numbers 0..k-1 in hash order, and their count."""
    u = units.select(unit).distinct().withColumn("__h", unit_draw("idx", F.col(unit)))
    d = number_rows(u, [], ["__h", unit], F.col("__h"), "idx", by_share=True).drop("__h")
    k = u.agg(F.count(F.lit(1)).alias("k"))
    return d.withColumn("idx", F.col("idx") - 1).crossJoin(F.broadcast(k))


def draws(units: DataFrame, n_boot: int, seed=0, unit="subject", method="multinomial") -> DataFrame:
    """(rep, unit, mult, n_distinct): how often each unit was drawn in each replicate.

    ``multinomial``: k slots per replicate, slot i takes unit hash(seed|rep|i) mod k - the exact
    bootstrap; B * k small rows are hashed and combined before the shuffle. ``poisson``: an
    independent Poisson(1) weight per unit, no shuffle at all, for very many units.
    """
    reps = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_boot - 1).cast("long"))).alias("rep")
    if method == "poisson":
        d = units.select(unit).distinct().select(unit, reps)
        return d.withColumn("mult", poisson_weight(seed, F.col("rep"), F.col(unit))).filter("mult > 0")
    ix = settle(index_units(units, unit))
    slots = ix.select("idx", "k", reps).select(
        "rep", (draw(seed, F.col("rep"), F.col("idx")) % F.col("k")).alias("idx"))
    m_ = slots.groupBy("rep", "idx").agg(F.count(F.lit(1)).alias("mult"))
    return m_.join(ix.select("idx", unit), "idx").select("rep", unit, "mult")


def packed(cells: DataFrame, n_boot=2000, seed=0, unit="subject", method="multinomial") -> DataFrame:
    """Draws of ``cells``' units, packed. ``split`` deals the slots down a tree where the units lie: the exact
    bootstrap without B * k rows anywhere, for very many units; its numbers come from numpy, so SQL has none."""
    if method == "split":
        return replicates.split_draws(settle(index_units(cells, unit)), n_boot, seed, unit)
    if method == "poisson":
        return replicates.pack(draws(cells, n_boot, seed, unit, method), unit)
    return replicates.count_draws(settle(index_units(cells, unit)), n_boot, seed, unit)


def drawn_units(cells: DataFrame, n_boot=2000, seed=0, unit="subject", method="multinomial"):
    """The same draws for ``replicate_auc``: multinomial ones are only numbered here and made in the tasks that read the cells."""
    if method != "multinomial":
        return packed(cells, n_boot, seed, unit, method)
    return replicates.drawn_here(settle(index_units(cells, unit)), n_boot, seed, unit)


def row_cells(df: DataFrame, keys=(), unit="subject", score="score", label="label", more=()) -> DataFrame:
    """(keys, unit, s, p, n) of each usable row, not added up: rows of one cell meet where cells are sorted."""
    return df.filter(usable(F.col(label), F.col(score))).select(
        *keys, unit, *more, snap(F.col(score)).alias("s"), F.col(label).cast("long").alias("p"), (1 - F.col(label)).cast("long").alias("n"))


def replicate_auc(cells: DataFrame, drawn, keys=(), unit="subject") -> DataFrame:
    """(rep, keys, auc) of draws, ``Drawn``, packed or (rep, unit, mult); one distinct unit or one class gives null."""
    packs = drawn if isinstance(drawn, replicates.Drawn) or "__w" in drawn.columns else replicates.pack(drawn, unit)
    return replicates.replicate_auc(cells, packs, keys, unit)


def percentile_ci(reps: DataFrame, keys=(), value="auc", alpha=0.05) -> DataFrame:
    """Percentile interval per key; null below 20 evaluable replicates, which are counted.

    A key has one value per replicate, so the values of a key are few.
    """
    used = F.count(value)
    q = F.percentile(value, F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    g = reps.groupBy(*keys).agg(used.alias("n_used"), (F.count(F.lit(1)) - used).alias("n_skipped"), q.alias("__q"),
                                F.avg(value).alias("boot_mean"), F.stddev_samp(value).alias("boot_sd"))
    ok = F.col("n_used") >= MIN_USED
    return g.select(*keys, "n_used", "n_skipped", F.when(ok, F.col("__q")[0]).alias("ci_lo"),
                    F.when(ok, F.col("__q")[1]).alias("ci_hi"), F.when(ok, F.col("boot_mean")).alias("boot_mean"),
                    F.when(ok, F.col("boot_sd")).alias("boot_sd"))


def cluster_bootstrap_auc(df: DataFrame, n_boot=2000, seed=0, keys=(), unit="subject", alpha=0.05, method="multinomial"):
    cells = settle(subject_cells(df, keys, unit))
    return percentile_ci(replicate_auc(cells, drawn_units(cells, n_boot, seed, unit, method), keys, unit), keys, alpha=alpha)


def naive_bootstrap_auc(df: DataFrame, n_boot=2000, seed=0, row="row_id", method="multinomial"):
    """Row-level interval, only to show how much too narrow it is."""
    d = df.withColumn("__row", F.col(row).cast("string"))
    if method == "multinomial":  # a row is a cell of its own
        cells = row_cells(d, unit="__row")
        g = percentile_ci(replicate_auc(cells, drawn_units(cells, n_boot, seed, "__row"), unit="__row"))
    else:
        g = cluster_bootstrap_auc(d, n_boot, seed, unit="__row", method=method)
    return g.withColumn("width", F.col("ci_hi") - F.col("ci_lo"))


def bootstrap_auc_diff(df: DataFrame, a: str, b: str, n_boot=2000, seed=0, unit="subject", alpha=0.05, keys=()) -> DataFrame:
    """Difference of two score columns on shared draws, per keys: interval and two-sided p, at least 1/B."""
    keys = list(keys)
    some = usable(F.col("label"), F.col(a)) | usable(F.col("label"), F.col(b))
    drawn = drawn_units(df.filter(some), n_boot, seed, unit)
    wide = df.select(unit, *keys, "label", a, b).join(drawn.index, unit)  # before a row is copied to its arms
    both = wide.select(unit, "__at", *keys, "label", F.inline(F.array(
        F.struct(F.lit("a").alias("arm"), F.col(a).alias("score")), F.struct(F.lit("b").alias("arm"), F.col(b).alias("score")))))
    r = replicate_auc(row_cells(both, [*keys, "arm"], unit, more=["__at"]), drawn, [*keys, "arm"], unit)
    d = r.groupBy("rep", *keys).agg((F.max(F.when(F.col("arm") == "a", F.col("auc"))) - F.max(F.when(F.col("arm") == "b", F.col("auc")))).alias("diff"))
    d = settle(d)
    ci = percentile_ci(d, keys, "diff", alpha)
    tail = d.groupBy(*keys).agg(F.count_if(F.col("diff") <= 0).alias("le"), F.count_if(F.col("diff") >= 0).alias("ge"), F.count("diff").alias("u"))
    p = F.least(F.lit(1.0), F.greatest(2.0 * F.least("le", "ge") / F.col("u"), 1.0 / F.col("u")))
    j = null_safe_join(ci, tail, keys) if keys else ci.crossJoin(F.broadcast(tail))
    return j.withColumn("p", F.when(F.col("n_used") >= MIN_USED, p)).drop("le", "ge", "u")


def replicate_auc_subjects(long: DataFrame, drawn, keys, unit="subject") -> DataFrame:
    """AUC per (rep, keys) of one score per subject."""
    return replicate_auc(subject_cells(long, keys, unit), drawn, keys, unit)


def shared_bootstrap_envelope(long: DataFrame, n_boot=2000, seed=0, unit="subject", scheme="scheme", keys=()):
    """(interval per keys and scheme, interval of the best scheme of each replicate per keys)."""
    long, keys = settle(long), list(keys)
    r = settle(replicate_auc_subjects(long, drawn_units(long, n_boot, seed, unit), [*keys, scheme], unit))
    env = r.groupBy("rep", *keys).agg(F.max("auc").alias("auc"))
    return percentile_ci(r, [*keys, scheme]), percentile_ci(env, keys)


def joint_cells(df: DataFrame, method="method", subject="subject") -> DataFrame:
    """(unit, method, subject, s, p, n): cells at row and subject level, written once. Subjects are read from the row cells."""
    rows = settle(subject_cells(df, [method], subject))
    subj = subject_cells(m.subjects_from_cells(rows, [method], subject), [method], subject, score="mean_score")
    at = lambda d, unit: d.select(F.lit(unit).alias("unit"), method, subject, "s", "p", "n")
    return at(rows, "slice").unionByName(settle(at(subj, "patient")))


def joint_bootstrap(df: DataFrame, n_boot=2000, seed=0, method="method") -> DataFrame:
    """(rep, unit, method, auc) with one set of draws for row and subject level; a replicate that is
    degenerate at either level is dropped."""
    return joint_replicates(joint_cells(df, method), n_boot, seed, method)


def joint_replicates(cells: DataFrame, n_boot=2000, seed=0, method="method") -> DataFrame:
    """The same from ``joint_cells``. Every subject has a cell at subject level, which are far fewer."""
    units = cells.filter(F.col("unit") == "patient")
    r = settle(replicate_auc(cells, drawn_units(units, n_boot, seed), ["unit", method]))
    return group_stats(r, ["rep"], F.every(F.col("auc").isNotNull()).alias("__ok")).filter("__ok").drop("__ok")


def paired_mean_bootstrap(diffs: DataFrame, n_boot=2000, seed=0, unit="subject", value="diff", keys=()) -> DataFrame:
    """Interval of the mean of a unit's value, per keys on shared draws."""
    keys = list(keys)
    d = settle(diffs.select(unit, *keys, value))
    w = replicates.weighted_sums(d.select(unit, *keys, F.col(value).alias("v"), F.lit(1).alias("w")), settle(packed(d, n_boot, seed, unit)), keys, ["v", "w"], unit)
    return percentile_ci(w.filter("w > 0").withColumn("mean", F.col("v") / F.col("w")), keys, "mean")


def within_strata_bootstrap(subj: DataFrame, stratum: str, n_boot=2000, seed=0, unit="subject", score="score", floor=1, keys=()):
    """Resample inside each stratum (draws shared by the keys), then the pair-weighted AUC over strata."""
    keys = list(keys)
    u = settle(subj.select(unit, stratum, *keys, score, "label"))
    d = u.select(unit, stratum).distinct().withColumn("__h", unit_draw("idx", F.col(unit)))
    ix = number_rows(d, [stratum], ["__h", unit], F.col("__h"), "idx", by_share=True).drop("__h")
    ix = settle(ix.withColumn("idx", F.col("idx") - 1))
    both = F.struct(unit, stratum).alias("__unit")  # a unit is drawn anew in each of its strata
    packs = replicates.count_draws(ix.select(both, stratum, "idx"), n_boot, seed, "__unit", stratum)
    cells = settle(subject_cells(u.select("*", both), [*keys, stratum], "__unit", score))
    per = replicates.replicate_auc(cells, packs, [*keys, stratum], "__unit", least=1, counts=True)
    return percentile_ci(m.pool_strata(per, ["rep", *keys], floor), keys)


def bootstrap_accuracy(df: DataFrame, n_boot=2000, seed=0, unit="subject", correct="correct") -> DataFrame:
    c = settle(df.groupBy(unit).agg(F.sum(F.col(correct).cast("long")).alias("c"), F.count(F.lit(1)).alias("t")))
    r = replicates.weighted_sums(c, settle(packed(c, n_boot, seed, unit)), [], ["c", "t"], unit)
    return percentile_ci(r.withColumn("acc", F.col("c") / F.col("t")), [], "acc")


# ------------------------------------------------------------------ permutations

def _perms(n_perm: int) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_perm - 1).cast("long"))).alias("perm")


def permute_within(df: DataFrame, n_perm: int, keys=("volume",), row="row_id", value="label", seed=0) -> DataFrame:
    """(perm, row, value): the values of each volume in another order, one copy per permutation.

    Rows of a volume are ranked once by a hash of the row, and per permutation by another hash;
    equal ranks meet. A single-row volume keeps its value.
    """
    keys = list(keys)
    base = df.select(*keys, row, value)
    d = base.withColumn("__h", unit_draw(seed, "base", F.col(row)))
    a = settle(number_rows(d, keys, ["__h", row], F.col("__h"), "__i", by_share=True).drop("__h"))
    p = a.select(*keys, row, value, _perms(n_perm)).withColumn("__h", unit_draw(seed, F.col("perm"), F.col(row)))
    by = ["perm", *keys]
    p = number_rows(p, by, ["__h", row], F.col("__h"), "__i", by_share=True)
    giver = p.select(*by, "__i", value)
    taker = a.select(*keys, row, "__i", _perms(n_perm))
    return null_safe_join(merged(taker), giver, [*by, "__i"]).select("perm", row, value)


def permuted(df: DataFrame, n_perm: int, keys=("volume",), row="row_id", value="label", seed=0) -> DataFrame:
    """``df`` once per permutation, ``value`` as ``permute_within`` gives it to the row: (perm, columns).

    The rows of a volume are shuffled once, without their copies; a task ranks the values of whole volumes for all permutations
    and writes the copies with their columns, so none is sorted, joined or moved. Volumes of more than ``HOT_ROWS`` rows, and a
    table in which two volumes share a row's number, take the join with ``permute_within``. ``df`` is read several times.
    """
    keys = list(keys)
    joined = lambda d: merged(d.drop(value)).join(permute_within(d, n_perm, keys, row, value, seed), row).select("perm", *df.columns)
    apart = df.groupBy(row).agg(F.min(F.struct(*keys)).alias("lo"), F.max(F.struct(*keys)).alias("hi")).filter(F.col(row).isNotNull() & (F.col("lo") != F.col("hi")))
    if apart.head(1):
        return joined(df)
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > prefix.HOT_ROWS).select(*keys, F.lit(True).alias("__hot"))
    if not hot.head(1):
        return _permuted_here(df, n_perm, keys, row, value, seed)
    marked = null_safe_join(df, F.broadcast(hot), keys, "left")  # at most one key for each HOT_ROWS rows
    few = _permuted_here(marked.filter("__hot IS NULL").drop("__hot"), n_perm, keys, row, value, seed)
    return few.unionByName(joined(settle(marked.filter("__hot").drop("__hot"))))


PIECE = 100_000  # rows whose copies are made at a time


def _permuted_here(df: DataFrame, n_perm: int, keys, row, value, seed) -> DataFrame:
    """``permuted`` where a volume fits a task."""
    columns = df.columns
    rest = [c for c in columns if c not in (row, value)]
    one = F.struct(F.col(row).alias("r"), F.col(row).cast("string").alias("t"), F.col(value).alias("v"), *[F.col(c).alias(f"c{i}") for i, c in enumerate(rest)])
    g = df.repartition(tasks_for(df, 4), *keys).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("__rows")).select("__rows")
    schema = T.StructType([T.StructField("perm", T.LongType()), *[T.StructField(c, df.schema[c].dataType) for c in (row, value, *rest)]])

    def hashes(name, texts):
        head, bare = f"{seed}|{name}|".encode(), f"{seed}|{name}".encode()
        digests = b"".join([hashlib.md5(bare if t is None else head + t).digest() for t in texts])
        return np.frombuffer(digests, ">u8")[::2] >> np.uint64(12)

    def piece(lists):
        """Rows of whole volumes, in order of their numbers."""
        r, t, v, *others = lists.flatten().flatten()
        texts = [None if x is None else x.encode() for x in t.to_pylist()]
        n, volume = len(texts), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        place = np.empty(n, np.int64)
        place[np.lexsort((hashes("base", texts), volume))] = np.arange(n)
        # a number that comes more than once in a volume meets every copy of itself
        code = np.cumsum([True] + [x != y for x, y in zip(texts[1:], texts)] | np.r_[True, volume[1:] != volume[:-1]]) - 1
        first = np.searchsorted(code, np.arange(code[-1] + 1))
        size = np.bincount(code)[code]
        mine = np.repeat(np.arange(n), size)
        theirs = first[code[mine]] + np.arange(len(mine)) - np.repeat(np.cumsum(size) - size, size)
        known = np.array([x is not None for x in texts])[mine]
        mine, theirs = mine[known], theirs[known]
        at = pa.array(mine)
        same = [x.take(at) for x in (r, *others)]
        for perm in range(n_perm):
            giver = np.lexsort((hashes(perm, texts), volume))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(mine), perm, np.int64)), same[0], v.take(pa.array(giver[place[theirs]])), *same[1:]], ["perm", row, value, *rest])

    def move(batches):
        for b in batches:
            lists = b.column("__rows")
            ends = np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False))
            at = 0
            while at < len(lists):
                upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
                yield from piece(lists.slice(at, upto - at))
                at = upto

    return g.mapInArrow(move, schema).select("perm", *columns)


def subject_donors(subjects: DataFrame, n_perm: int, keys=(), subject="subject", seed=0, salt="donor") -> DataFrame:
    """(perm, keys, subject, donor): a random bijection of subjects per permutation."""
    keys = list(keys)
    s = subjects.select(*keys, subject).distinct()
    a = number_rows(s.withColumn("__h", unit_draw(seed, salt, F.col(subject))), keys, ["__h", subject], F.col("__h"),
                    "__i", by_share=True).drop("__h")
    a = a.select("*", _perms(n_perm))
    p = a.select("perm", *keys, subject).withColumn("__h", unit_draw(seed, salt, F.col("perm"), F.col(subject)))
    p = number_rows(p, ["perm", *keys], ["__h", subject], F.col("__h"), "__i", by_share=True)
    return null_safe_join(merged(a), p.select("perm", *keys, "__i", F.col(subject).alias("donor")), ["perm", *keys, "__i"]) \
        .select("perm", *keys, subject, "donor")


def permute_metadata(df: DataFrame, cols, n_perm: int, row="row_id", subject="subject", order=("slice",), seed=0) -> DataFrame:
    """(perm, row, cols): each subject takes another subject's whole metadata block, matched by row
    order; the last donor row is repeated where the donor is shorter."""
    base = df.select(row, subject, *order, *cols)
    r = number_rows(base, [subject], [*order, row], spread(F.col(order[0])), "__i")
    r = settle(group_stats(r, [subject], F.count(F.lit(1)).alias("__n")))
    d = subject_donors(r, n_perm, subject=subject, seed=seed)
    size = r.select(F.col(subject).alias("donor"), F.col("__n").alias("__dn")).distinct()
    want = (merged(merged(r.select(row, subject, "__i")).join(d, subject)).join(size, "donor")
            .withColumn("__i", F.least("__i", "__dn")))
    give = r.select(F.col(subject).alias("donor"), "__i", *cols)
    return merged(want).join(give, ["donor", "__i"]).select("perm", row, *cols)


def permute_subject_labels(df: DataFrame, n_perm: int, split="split", row="row_id", subject="subject",
                           order=("slice",), label="label", seed=0):
    """(permuted rows, audit): whole label vectors change hands inside a split, index-mapped to the
    recipient's length; a draw without any change of class is marked in the audit."""
    base = df.select(row, subject, split, *order, label)
    r = number_rows(base, [subject], [*order, row], spread(F.col(order[0])), "__i").withColumn("__i", F.col("__i") - 1)
    r = settle(group_stats(r, [subject], F.count(F.lit(1)).alias("__n"), F.max(label).alias("__y")))
    d = settle(subject_donors(r, n_perm, [split], subject, seed))
    facts = r.select(subject, "__n", "__y").distinct()
    size = facts.select(F.col(subject).alias("donor"), F.col("__n").alias("__dn"), F.col("__y").alias("__dy"))
    dd = merged(d).join(size, "donor")
    tasks = tasks_for(r, n_perm)  # the copies of all permutations are made and sorted in memory
    want = (r.select(row, subject, "__i", "__n", F.col(label).alias("__old")).repartition(tasks, subject).join(merged(dd.repartition(tasks, subject)), subject)
            .withColumn("__i", F.least(F.expr("(__i * __dn) div __n"), F.col("__dn") - 1)))
    give = r.select(F.col(subject).alias("donor"), "__i", label)
    out = merged(want.repartition(tasks, "donor", "__i")).join(give.repartition(tasks, "donor", "__i"), ["donor", "__i"]).select("perm", split, row, label, "__old")
    subj = (dd.join(facts, subject).groupBy("perm", split).agg(
        F.count(F.lit(1)).alias("n_subjects"), F.count_if(F.col("__dy") != F.col("__y")).alias("n_class_changed"),
        F.sum("__y").alias("pos_before"), F.sum("__dy").alias("pos_after")))
    rows = out.groupBy("perm", split).agg(F.avg(label).alias("row_pos_after"), F.avg("__old").alias("row_pos_before"),
                                          F.avg((F.col(label) != F.col("__old")).cast("double")).alias("changed_fraction"))
    audit = subj.join(rows, ["perm", split]).withColumn("usable", F.col("n_class_changed") > 0)
    return out.drop("__old"), audit


def permutation_p(headline: DataFrame, null: DataFrame, keys, alpha=0.05, value="auc") -> DataFrame:
    """p = (1 + #(null >= observed)) / (1 + n) and a state; fewer than 20 runs are inconclusive."""
    j = null.select(*keys, F.col(value).alias("__v")).filter(F.col("__v").isNotNull()).join(headline.select(*keys, F.col(value).alias("observed")), list(keys))
    g = j.groupBy(*keys).agg(F.max("observed").alias("observed"), F.avg("__v").alias("null_mean"), F.count(F.lit(1)).alias("n_perm"),
                             ((1 + F.count_if(F.col("__v") >= F.col("observed"))) / (1 + F.count(F.lit(1)))).alias("p"))
    return g.withColumn("state", F.when(F.col("observed") <= F.col("null_mean"), "fails").when(F.col("n_perm") < 20, "inconclusive")
                        .when(F.col("p") <= alpha, "survives").otherwise("fails"))


def null_attach(headline: DataFrame, nulls: DataFrame) -> DataFrame:
    """Per baseline the highest applicable null: excess, one-sided p, and whether it is exceeded.

    ``nulls``: (baseline, kind, auc) draws of applicable kinds only. A baseline without one is
    'unavailable'; prevalence is 'not_applicable'.
    """
    q = F.percentile("auc", F.array(F.lit(0.025), F.lit(0.975)))  # one value per permutation
    per = nulls.filter(F.col("auc").isNotNull()).groupBy("baseline", "kind").agg(
        F.count(F.lit(1)).alias("n_perm"), F.avg("auc").alias("null_mean"), q.alias("__q"))
    best = per.groupBy("baseline").agg(F.max(F.struct("null_mean", "kind", "n_perm", "__q")).alias("b")).select("baseline", "b.*")
    ge = (nulls.join(headline.select("baseline", F.col("auc").alias("__o")), "baseline").groupBy("baseline", "kind")
          .agg(F.count_if(F.col("auc") >= F.col("__o")).alias("__ge")))
    d = headline.join(best, "baseline", "left").join(ge, ["baseline", "kind"], "left")
    prev = F.col("baseline") == "prevalence"
    has = F.col("null_mean").isNotNull() & ~prev
    return d.select("baseline", "auc", F.when(prev, "not_applicable").when(~has, "unavailable").otherwise(F.col("kind")).alias("kind"),
                    F.when(has, F.col("n_perm")).alias("n_perm"), F.when(has, F.col("null_mean")).alias("null_mean"),
                    F.when(has, F.col("__q")[0]).alias("null_lo"), F.when(has, F.col("__q")[1]).alias("null_hi"),
                    F.when(has, F.col("auc") - F.col("null_mean")).alias("excess"),
                    F.when(has, (F.col("__ge") + 1) / (F.col("n_perm") + 1)).alias("p"),
                    F.when(has, F.col("auc") > F.col("__q")[1]).alias("exceeds"))
