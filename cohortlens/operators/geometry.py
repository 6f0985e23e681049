"""Where a row sits in its volume: positions, bins, runs, spines and partners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import draw, unit_draw
from ..functions.prefix import group_stats, merged, null_safe_join, number_rows, spread
from ..session import settle


def relative_position(df: DataFrame, keys=("volume",), pos="slice", out="relpos") -> DataFrame:
    """(pos - min) / (max - min) inside the volume; 0 where the volume has no span."""
    z = F.col(pos).try_cast("double")
    d = group_stats(df.withColumn("__z", z), keys, F.min("__z").alias("__lo"), F.max("__z").alias("__hi"))
    span = F.col("__hi") - F.col("__lo")
    return (d.withColumn(out, F.when(span == 0, 0.0).otherwise((F.col("__z") - F.col("__lo")) / span))
            .drop("__z", "__lo", "__hi"))


def supplied_position(df: DataFrame, col: str, out="relpos") -> DataFrame:
    """A given position column; rescaled to [0, 1] only when it leaves it, bad values dropped."""
    d = df.withColumn("__r", F.col(col).try_cast("double")).filter(
        F.col("__r").isNotNull() & ~F.isnan("__r"))
    span = d.agg(F.min("__r").alias("__lo"), F.max("__r").alias("__hi"))  # always one row
    width = F.when(F.col("__hi") > F.col("__lo"), F.col("__hi") - F.col("__lo")).otherwise(1.0)
    outside = (F.col("__lo") < 0) | (F.col("__hi") > 1)
    return (d.crossJoin(F.broadcast(span))
            .withColumn(out, F.when(outside, (F.col("__r") - F.col("__lo")) / width)
                        .otherwise(F.col("__r")))
            .drop("__r", "__lo", "__hi"))


def volume_size(df: DataFrame, keys=("volume",), out="n_slices") -> DataFrame:
    """Labelled rows per volume, on every row."""
    return group_stats(df, keys, F.count(F.lit(1)).alias(out))


def bin_of(relpos: Column, n_bins: int) -> Column:
    """Equal-width bin of [0, 1]; the last bin is closed."""
    return F.least(F.floor(relpos * F.lit(float(n_bins))), F.lit(n_bins - 1)).cast("long")


def position_bins(df: DataFrame, n_bins=20, pos="relpos", out="bin") -> DataFrame:
    return df.withColumn(out, bin_of(F.col(pos), n_bins))


def canonical_bins(depths: DataFrame, n_bins=20, depth="n_slices") -> DataFrame:
    """Bins that a volume of ``depth`` consecutive slices occupies: one row per depth and slice."""
    n = F.col(depth)
    d = depths.select(depth).distinct().select(
        depth, F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(n - 1, F.lit(0)))).alias("k"))
    return d.withColumn("bin", F.when(n <= 1, 0).otherwise(
        F.least(F.expr(f"({n_bins} * k) div greatest({depth} - 1, 1)"), F.lit(n_bins - 1))).cast("long"))


def canonical_spans(depths: DataFrame, n_bins=20, depth="n_slices") -> DataFrame:
    """Per depth: occupied bins, and whether all bins are spanned."""
    g = canonical_bins(depths, n_bins, depth).groupBy(depth).agg(
        F.countDistinct("bin").alias("n_occupied"), F.max("bin").alias("top_bin"))
    return g.withColumn("spans_all", F.col("n_occupied") == n_bins)


def centrality_score(relpos: Column) -> Column:
    """Fit-free score: closeness to the middle of the stack."""
    return -F.abs(relpos - F.lit(0.5))


def patient_depth(df: DataFrame, subject="subject", volume="volume") -> DataFrame:
    """Whole rows per volume of each subject."""
    per = df.groupBy(subject, volume).agg(F.count(F.lit(1)).alias("__n"))
    return (per.groupBy(subject).agg(F.sum("__n").alias("n_rows"), F.count(F.lit(1)).alias("n_volumes"))
            .withColumn("depth", F.expr("n_rows div n_volumes")))


def contiguity_audit(df: DataFrame, keys=("volume",), pos="slice") -> DataFrame:
    """Per series: is the counter exactly 1..n, rows implied missing, share of unit steps."""
    keys = list(keys)
    base = df.groupBy(*keys, pos).agg(F.count(F.lit(1)).alias("__m"))  # distinct counters
    # a unit step is a counter whose predecessor is present: a semi join, not an ordered window
    nxt = base.select(*keys, (F.col(pos) + 1).alias(pos), F.lit(1).alias("__step"))
    steps = base.join(nxt, [*keys, pos], "left")
    g = steps.groupBy(*keys).agg(
        F.min(pos).alias("first"), F.max(pos).alias("last"), F.sum("__m").alias("n_rows"),
        F.count(F.lit(1)).alias("n_distinct"), F.coalesce(F.sum("__step"), F.lit(0)).alias("__steps"))
    ok = (F.col("first") == 1) & (F.col("last") == F.col("n_rows")) & (F.col("n_distinct") == F.col("n_rows"))
    return g.select(
        *keys, "first", "last", "n_rows", ok.alias("contiguous"),
        F.when(ok, 0).otherwise(F.col("last") - F.col("n_rows")).alias("n_missing"),
        F.when(F.col("n_distinct") > 1, F.col("__steps") / (F.col("n_distinct") - 1)).alias("unit_step_share"))


def order_lead(pos: str) -> Column:
    return spread(F.col(pos))


def runs_per_series(df: DataFrame, keys=("volume",), pos="slice", label="label", min_pos=3) -> DataFrame:
    """Per series with enough positives: runs of positives and k(n-k+1)/n, their expectation.

    A run starts at a positive whose predecessor in the series is not positive. Rows get a dense
    rank first, so the predecessor is an equi-join on rank - 1 and a long series is not pulled
    into one task.
    """
    keys = list(keys)
    r = number_rows(df.select(*keys, pos, label), keys, [pos], order_lead(pos), "__rank")
    prev = r.select(*keys, (F.col("__rank") + 1).alias("__rank"), F.col(label).alias("__prev"))
    j = null_safe_join(merged(r), prev, [*keys, "__rank"], "left")
    start = (F.col(label) == 1) & (F.coalesce(F.col("__prev"), F.lit(0)) == 0)
    n, k = F.count(F.lit(1)), F.sum(label)
    g = j.groupBy(*keys).agg(n.alias("n"), k.alias("n_pos"), F.sum(start.cast("long")).alias("observed"))
    return g.filter(F.col("n_pos") >= min_pos).withColumn(
        "expected", F.col("n_pos") * (F.col("n") - F.col("n_pos") + 1) / F.col("n").cast("double"))


def run_length_test(df: DataFrame, by=(), keys=("volume",), pos="slice", label="label", min_pos=3) -> DataFrame:
    """Mean observed against mean expected runs, and their ratio (1 = random order)."""
    by = list(by)
    g = runs_per_series(df, [*by, *keys], pos, label, min_pos)
    return g.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_series"), F.avg("observed").alias("observed"),
        F.avg("expected").alias("expected")).withColumn("ratio", F.col("observed") / F.col("expected"))


def corrupted_order(df: DataFrame, fractions, draws: int, keys=("volume",), pos="slice", seed=0) -> DataFrame:
    """Copies of each series in which a share of the slices changed places at random.

    One copy per (fraction, draw): bround(fraction * n) slices with the smallest hash swap places
    among themselves; the others keep theirs. Adds fraction, draw and the new position ``pos``.
    """
    keys = list(keys)
    arms = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(d).cast("long").alias("draw"))
                     for f in fractions for d in range(draws)])
    d = number_rows(df, keys, [pos], order_lead(pos), "__rank")
    d = settle(group_stats(d, keys, F.count(F.lit(1)).alias("__len")))
    d = d.select("*", F.inline(arms))
    grp = ["fraction", "draw", *keys]
    h = unit_draw(seed, "pick", F.col("fraction"), F.col("draw"), *[F.col(k) for k in keys], F.col("__rank"))
    d = number_rows(d.withColumn("__h", h), grp, ["__h", "__rank"], F.col("__h"), "__pick", by_share=True)
    moving = F.col("__pick") <= F.bround(F.col("fraction") * F.col("__len"))
    moved, kept = d.filter(moving), d.filter(~moving)
    places = number_rows(moved.select(*grp, "__rank"), grp, ["__rank"],
                         spread(F.col("__rank")), "__slot").withColumnRenamed("__rank", "__new")
    h2 = unit_draw(seed, "place", F.col("fraction"), F.col("draw"), *[F.col(k) for k in keys], F.col("__rank"))
    shuffled = number_rows(moved.withColumn("__h", h2), grp, ["__h", "__rank"], F.col("__h"), "__slot",
                           by_share=True)
    moved = null_safe_join(merged(shuffled), places, [*grp, "__slot"]).withColumn(pos, F.col("__new"))
    kept = kept.withColumn(pos, F.col("__rank"))
    cols = [*df.columns, "fraction", "draw"]
    return kept.select(*cols).unionByName(moved.select(*cols))


def interval_expand(df: DataFrame, n="n_slices", start="start", end="end", gap=5) -> DataFrame:
    """One row per slice 0..n-1: 1 inside [start, end], 0 beyond a gap, the band between dropped."""
    z = F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("slice")
    d = df.filter(F.col(n) > 0).select("*", z)
    inside = F.col("slice").between(F.col(start), F.col(end))
    outside = (F.col("slice") < F.col(start) - gap) | (F.col("slice") > F.col(end) + gap)
    return d.filter(inside | outside).withColumn("label", inside.cast("long"))


def roster_expand(roster: DataFrame, findings: DataFrame, target: str, keys=("volume",), n="n_slices",
                  kind="finding") -> DataFrame:
    """Positives-only findings to a full 0/1 roster: one flag for ``target``, one for any finding."""
    keys = list(keys)
    spine = roster.filter(F.col(n) > 0).select(
        *keys, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))).alias("slice"))
    marks = findings.groupBy(*keys, "slice").agg(
        F.max((F.col(kind) == target).cast("long")).alias("__t"))
    return (spine.join(marks, [*keys, "slice"], "left")
            .select(*keys, "slice", F.coalesce("__t", F.lit(0)).alias("label"),
                    F.when(F.col("__t").isNull(), 0).otherwise(1).alias("any_finding")))


def even_sample(df: DataFrame, want: int, central=0.5, keys=("volume",), pos="slice") -> DataFrame:
    """``want`` evenly spaced rows of the central share of each volume; all of a short volume.

    The wanted ranks are an arithmetic sequence, so a row knows from its own rank whether it is in.
    """
    keys = list(keys)
    d = number_rows(df, keys, [pos], order_lead(pos), "__i")
    d = group_stats(d, keys, F.count(F.lit(1)).alias("__n")).withColumn("__i", F.col("__i") - 1)
    band = F.greatest(F.lit(want), F.bround(F.col("__n") * F.lit(float(central)))).cast("long")
    d = d.withColumn("__band", band).withColumn("__lo", F.expr("(__n - __band) div 2"))
    step = (F.col("__band") - 1) / F.lit(float(max(want - 1, 1)))
    near = F.bround((F.col("__i") - F.col("__lo")) / F.nullif(step, F.lit(0.0)))
    # the nearest multiple of the step must round back to this rank; its neighbours cover half-steps
    hit = F.lit(False)
    for shift in (-1, 0, 1):
        j = F.coalesce(near, F.lit(0.0)) + shift
        hit = hit | (j.between(0, want - 1) & (F.bround(F.col("__lo") + j * step) == F.col("__i")))
    return d.filter((F.col("__n") <= want) | hit).drop("__i", "__n", "__band", "__lo")


def shift_partner(df: DataFrame, shift: int, keys=("volume",), pos="slice", value="value") -> DataFrame:
    """Pair each slice with the one ``shift`` further, else ``shift`` back, else the far end."""
    keys = list(keys)
    d = number_rows(df, keys, [pos], order_lead(pos), "__i").withColumn("__i", F.col("__i") - 1)
    d = group_stats(d, keys, F.count(F.lit(1)).alias("__n"))
    i, n = F.col("__i"), F.col("__n")
    other = (F.when(n <= 1, None).when(i + shift < n, i + shift).when(i - shift >= 0, i - shift)
             .when(i != n - 1, n - 1).otherwise(F.lit(0).cast("long")))
    d = d.withColumn("__j", other)
    partner = d.select(*keys, F.col("__i").alias("__j"), F.col(pos).alias("partner"),
                       F.col(value).alias("partner_value"))
    return null_safe_join(d, partner, [*keys, "__j"], "left").drop("__i", "__j", "__n")


def median_row(df: DataFrame, keys, pos="slice") -> DataFrame:
    """The row at place count div 2 (from 0) of each group in index order."""
    keys = list(keys)
    d = number_rows(df, keys, [pos], order_lead(pos), "__i")
    d = group_stats(d, keys, F.count(F.lit(1)).alias("__n"))
    return d.filter(F.col("__i") == F.expr("__n div 2") + 1).drop("__i", "__n")


def modal_group_value(df: DataFrame, keys, value: str, out="modal") -> DataFrame:
    """Most frequent non-null value per group; ties go to the smallest value."""
    keys = list(keys)
    c = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__n"))
    best = c.groupBy(*keys).agg(F.min(F.struct((-F.col("__n")).alias("neg"), F.col(value).alias("v"))).alias("__b"))
    return best.select(*keys, F.col("__b.v").alias(out), (-F.col("__b.neg")).alias("n"))
