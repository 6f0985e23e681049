"""Whole reports: compositions of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import merged, null_safe_join
from ..functions.rules import split_arm
from ..session import settle
from . import baselines as b
from . import geometry as g
from . import guards
from . import metrics as m
from . import resample as r
from . import roles
from . import splits
from . import tree

SWEEP = (5, 10, 20, 50)  # fixed values


def bundle(cells: DataFrame, keys, n_boot=2000, seed=0) -> DataFrame:
    """One row per key: row and subject metrics with clustered intervals, from (keys, subject, s, p, n)."""
    keys = list(keys)
    cells = settle(cells.select(*keys, "subject", "s", "p", "n"))
    c = cells.groupBy(*keys, "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    out = m.auc_from_counts(c, keys, out="slice_auc").withColumn("prevalence", F.col("n_pos") / (F.col("n_pos") + F.col("n_neg")))
    subj = settle(m.subjects_from_cells(cells, keys))
    cnt = subj.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_patients"), F.sum("label").alias("n_pos_patients"), F.count_if("mixed").alias("n_mixed"))
    pieces = [m.average_precision_from_counts(c, keys), cnt,
              m.auc(subj, keys, "mean_score", out="patient_auc").drop("n_pos", "n_neg"),
              m.auc(subj, keys, "max_score", out="patient_auc_max").drop("n_pos", "n_neg")]
    if n_boot:
        drawn = r.drawn_units(cells, n_boot, seed)  # shared by both units and all keys
        lim = lambda d, u: d.select(*keys, F.col("ci_lo").alias(f"{u}_lo"), F.col("ci_hi").alias(f"{u}_hi"))
        sc = r.subject_cells(subj, keys, score="mean_score")
        pieces += [lim(r.percentile_ci(r.replicate_auc(cells, drawn, keys), keys), "slice"), lim(r.percentile_ci(r.replicate_auc(sc, drawn, keys), keys), "patient")]
    for p in pieces:
        out = null_safe_join(out, p, keys)
    return out


OWN = ("subject", "volume", "slice", "label", "relpos", "n_slices", "fold")  # names that prepared tables use themselves


def metadata_name(c: str) -> str:
    """A metadata column keeps its name unless a prepared table has its own column of that name."""
    return f"metadata_{c}" if c in OWN else c


def prepare(df: DataFrame, cm: roles.ColumnMap, positive_if=None, relpos_col=None) -> DataFrame:
    """Bind roles to subject, volume, slice, label, relpos, n_slices; rows without a slice number go."""
    d, _ = roles.binarise(df, cm.label, positive_if, "__y")
    vol = F.col(cm.subject).cast("string") if cm.volume is None else F.concat_ws("|", F.col(cm.subject).cast("string"), F.col(cm.volume).cast("string"))
    keep = [F.col(c).alias(metadata_name(c)) for c in cm.metadata]
    extra = ([F.col(cm.split).alias("__split")] if cm.split else []) + ([F.col(relpos_col).alias("__pos")] if relpos_col else [])
    d = d.select(*keep, F.col(cm.subject).cast("string").alias("subject"), vol.alias("volume"), F.col(cm.slice).try_cast("double").alias("slice"), F.col("__y").alias("label"), *extra)
    d = d.filter(F.col("slice").isNotNull())
    d = g.supplied_position(d, "__pos").drop("__pos") if relpos_col else g.relative_position(d)
    return g.volume_size(d)


def evaluate(d: DataFrame, n_folds: int, metadata, numeric, n_boot=2000, seed=0, n_perm=20, depth=3, max_levels=30, n_bins=20, trees=True) -> dict[str, DataFrame]:
    """Baselines, sweep, screen and nulls of one set of partitions (``fold`` on every row)."""
    main = b.simple_baselines(d, n_folds, (n_bins,))
    cols = ["feature", "subject", "fold", "s", "p", "n"]
    main = main.select(*cols)
    if trees:
        fits = ([("metadata_tree", False)] if metadata else []) + [("combined_position_metadata", True)]
        for name, rel in fits:
            main = main.unionByName(tree.fit_score(d, n_folds, metadata, rel, name, depth, max_levels)[0].select(*cols))
    main = settle(main)
    out = {"baselines": bundle(main, ["feature"], n_boot, seed), "partitions": b.partition_report(d, n_folds)}
    sweep = b.encode(b.cells(d, b.position_features(SWEEP)), n_folds, 0.0)
    out["bin_sweep"] = bundle(sweep, ["feature"], 0).select("feature", "slice_auc", "patient_auc")
    if metadata:
        sc = settle(b.column_scores(b.cells(d, {c: F.col(c) for c in [*metadata, "n_slices"]}), n_folds, {*numeric, "n_slices"}))
        out["univariate"] = bundle(sc, ["feature"], 0).select("feature", "slice_auc", "patient_auc", (F.col("slice_auc") >= 0.999).alias("tautology"))
    if n_perm:
        rows = settle(d.withColumn("__id", F.monotonically_increasing_id()))  # written once, so every reader sees one number a row
        can = changeable(rows).head()
        pd_ = r.permuted(rows.select("volume", "__id", "label", "subject", "fold", "relpos"), n_perm, row="__id", seed=seed + 1)
        c = settle(b.encode(b.cells(pd_, b.position_features((n_bins,)), ["perm"]), n_folds, 0.0, ["perm"]))
        pos = m.auc_from_counts(c.groupBy("perm", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["perm"], few=True)
        nulls = pos.select(F.lit(f"positional_{n_bins}bin").alias("baseline"), F.lit("within_volume_label_permutation").alias("kind"), "auc")
        nulls = nulls.filter(F.lit(can["labels"]))
        blk = settle(r.permute_metadata(rows, ["n_slices"], n_perm, "__id", seed=seed + 2))
        sd = merged(rows.select("__id", "subject", "fold", "label")).join(blk, "__id")
        c2 = b.column_scores(b.cells(sd, {"volume_size": F.col("n_slices")}, ["perm"]), n_folds, {"volume_size"}, keys=["perm"])
        siz = m.auc_from_counts(c2.groupBy("perm", "s").agg(F.sum("p").alias("p"), F.sum("n").alias("n")), ["perm"], few=True)
        nulls = nulls.unionByName(siz.select(F.lit("volume_size").alias("baseline"), F.lit("metadata_block_permutation").alias("kind"), "auc").filter(F.lit(bool(metadata) and can["blocks"])))
        out["nulls"] = r.null_attach(out["baselines"].select(F.col("feature").alias("baseline"), F.col("slice_auc").alias("auc")), settle(nulls))
    return out


def changeable(rows: DataFrame) -> DataFrame:
    """Whether a permutation can change anything: labels inside a volume, metadata blocks between subjects."""
    volumes = rows.groupBy("volume").agg((F.min("label") < F.max("label")).alias("mixed"))
    blocks = rows.groupBy("subject").agg(F.min("n_slices").alias("lo"), F.max("n_slices").alias("hi"))
    return volumes.agg(F.coalesce(F.bool_or("mixed"), F.lit(False)).alias("labels")).crossJoin(
        blocks.agg((F.coalesce(F.min("lo") < F.max("hi"), F.lit(False)) & (F.count(F.lit(1)) > 1)).alias("blocks")))


def audit(df: DataFrame, n_boot=2000, seed=0, n_bins=20, cv_folds=5, depth=3, max_levels=30, published=None, published_metric="slice_auc",
          val_as=None, positive_if=None, n_perm=20, relpos_col=None, trees=True, **columns) -> dict:
    """Full audit of one label table: roles, label, geometry, own split and subject folds, baselines, nulls, headline."""
    cm = roles.resolve_columns(df, exclude=(relpos_col,) if relpos_col else (), **columns)
    d = settle(prepare(df, cm, positive_if, relpos_col))
    types = dict(d.dtypes)
    meta = [metadata_name(c) for c in cm.metadata]
    numeric = {c for c in meta if types[c] in ("tinyint", "smallint", "int", "bigint", "float", "double") or types[c].startswith("decimal")}
    opts = dict(n_boot=n_boot, seed=seed, n_perm=n_perm, depth=depth, max_levels=max_levels, n_bins=n_bins, trees=trees)
    evals = {}
    if cm.split:
        a = split_arm(F.col("__split"))
        arm = F.when(a == "val", val_as).otherwise(a) if val_as else a
        own = d.withColumn("fold", F.when(arm == "train", -1).when(arm == "test", 0).cast("long")).filter("fold IS NOT NULL")
        if {x[0] for x in own.select("fold").distinct().limit(2).collect()} == {-1, 0}:
            parts = own.select("subject", F.lit(0).alias("partition"), F.when(F.col("fold") == 0, "test").otherwise("train").alias("role"))
            guards.require_empty(guards.train_test_overlap(parts), "subject in both arms")
            evals["official_split"] = evaluate(own, 1, meta, numeric, **opts)
    f = splits.seeded_folds(d, cv_folds, seed).select("subject", "fold")
    evals["subject_cv"] = evaluate(settle(d.join(f, "subject")), cv_folds, meta, numeric, **opts)
    head = "official_split" if "official_split" in evals else "subject_cv"
    e = evals[head]["baselines"]
    best = e.filter(F.col("feature") != "prevalence").filter(F.col(published_metric).isNotNull()).orderBy(F.desc(published_metric), "feature").limit(1)
    lo, hi = ("patient_lo", "patient_hi") if published_metric.startswith("patient") else ("slice_lo", "slice_hi")
    chance = F.col("prevalence") if published_metric == "ap" else F.lit(0.5)
    line = best.select("feature", F.col(published_metric).alias("baseline"), chance.alias("chance"), F.lit(published).cast("double").alias("published"),
                       *[(F.col(c) if n_boot else F.lit(None).cast("double")).alias(x) for c, x in ((lo, "ci_lo"), (hi, "ci_hi"))])
    return {"columns": cm, "evaluations": evals, "headline_evaluation": head, "headline": m.trivial_fraction(line), "warnings": warnings(e, cm)}


def warnings(e: DataFrame, cm) -> DataFrame:
    """Few test subjects; a constant predictor away from 0.5 (pooling across folds); no metadata."""
    p = e.filter(F.col("feature") == "prevalence")
    few = (F.col("n_patients") < 10) | (F.least(F.col("n_pos_patients"), F.col("n_patients") - F.col("n_pos_patients")) < 3)
    w = F.array_compact(F.array(F.when(few, "few test subjects"), F.when(F.abs(F.col("slice_auc") - 0.5) > 0.01, "constant predictor is not 0.5 when folds are pooled"),
                                F.lit(None if cm.metadata else "no admissible metadata columns").cast("string")))
    return p.select(F.explode(w).alias("warning"))


def waterfall(df: DataFrame, stratum: str, keys=()) -> DataFrame:
    """(keys, rung, reading, auc): one score set read as rows, subjects (mean, max) and inside strata."""
    keys = list(keys)
    df = settle(df)
    s = settle(m.cluster_aggregate(df, keys))
    rung = lambda d, i, name: d.select(*keys, F.lit(i).alias("rung"), F.lit(name).alias("reading"), "auc")
    return (rung(m.auc(df, keys), 1, "rows").unionByName(rung(m.auc(s, keys, "mean_score"), 2, "subject mean"))
            .unionByName(rung(m.auc(s, keys, "max_score"), 3, "subject max")).unionByName(rung(m.stratified_auc(df, stratum, keys), 4, "inside strata")))


# Fixed values of the control rules.
BACKGROUND_ALARM, CONFOUND_ALARM, PERM_ALPHA = 0.6, 0.6, 0.05


def control_verdicts(head: DataFrame, controls: DataFrame, perm: DataFrame, keys=("cohort", "condition")) -> DataFrame:
    """State of each control and the overall verdict per (cohort, condition).

    ``head``: keys, auc, lo, hi; ``controls``: keys, control, lo, hi; ``perm``: keys, auc per run.
    """
    keys = list(keys)
    names = ("background", "scramble", "acquisition", "confound")
    c = controls.groupBy(*keys).pivot("control", list(names)).agg(F.first(F.struct("lo", "hi")))
    p = r.permutation_p(head, perm, keys, PERM_ALPHA).select(*keys, F.col("state").alias("perm_state"))
    d = head.join(c, keys, "left").join(p, keys, "left")
    lo, hi = (lambda n: F.col(f"{n}.lo")), (lambda n: F.col(f"{n}.hi"))
    absent = lambda n, x: F.when(F.col(n).isNull(), "absent").otherwise(x)
    known = lambda n, x: F.when(lo(n).isNull(), "inconclusive").otherwise(x)
    d = d.withColumn("permutation", F.coalesce("perm_state", F.lit("absent")))
    states = {
        "background": F.when(lo("background") > BACKGROUND_ALARM, "fails").otherwise("survives"),
        "scramble": F.when(hi("scramble") < F.col("lo"), "survives").when(lo("scramble") >= F.col("auc"), "fails").otherwise("inconclusive"),
        "acquisition": F.when(lo("acquisition") > 0.5, "survives").when(F.col("lo") > 0.5, "fails").otherwise("inconclusive"),
        "confound": F.when(lo("confound") > CONFOUND_ALARM, "flagged").otherwise("survives")}
    for n, x in states.items():
        d = d.withColumn(f"{n}_state", absent(n, known(n, x)))
    tests = ["permutation", "background_state", "scramble_state", "acquisition_state"]
    failed = F.array_compact(F.array(*[F.when(F.col(t) == "fails", F.lit(t.removesuffix("_state"))) for t in tests]))
    any_test = F.greatest(*[(F.col(t) != "absent").cast("int") for t in tests]) == 1
    all_ok = F.least(*[(F.col(t) == "survives").cast("int") for t in tests]) == 1
    verdict = F.when(~any_test, "NO CONTROLS").when(F.size(failed) > 0, "FALSIFIED").when(all_ok, "SURVIVES").otherwise("NOT ESTABLISHED")
    verdict = F.concat(verdict, F.when(F.col("confound_state") == "flagged", "+CONFOUNDED").otherwise(""))
    return d.select(*keys, "permutation", *[f"{n}_state" for n in names], F.array_join(failed, ",").alias("failed"), verdict.alias("verdict"))


def aggregation_verdict(rows: DataFrame, positive_controls, chance=0.5) -> DataFrame:
    """Lowest interval bound over seeds per cohort and scheme; does any scheme of a cohort clear chance."""
    g = rows.groupBy("cohort", "scheme").agg(F.min("ci_lo").alias("min_lo"), F.count(F.lit(1)).alias("n_seeds"), F.count_if(F.col("ci_lo") > chance).alias("n_seed_hits"))
    per = g.groupBy("cohort").agg(F.bool_or(F.col("min_lo") > chance).alias("cohort_clears"))
    return (g.join(per, "cohort").withColumn("clears", F.col("min_lo") > chance)
            .withColumn("role", F.when(F.col("cohort").isin(*positive_controls), "positive control").otherwise("on trial")))


def context_verdict(subj: DataFrame, contexts, score="score", label="label", floor=10) -> DataFrame:
    """Per context column: can the label be told apart from it, and does the score rank inside its levels."""
    arms = F.array(*[F.struct(F.lit(c).alias("context"), F.col(c).cast("string").alias("stratum")) for c in contexts])
    d = settle(subj.select(F.col(score).alias("score"), F.col(label).alias("label"), F.inline(arms)))
    g = d.groupBy("context", "stratum").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("k"))
    both, fl = (F.col("k") > 0) & (F.col("k") < F.col("n")), (F.col("k") >= floor) & (F.col("n") - F.col("k") >= floor)
    s = g.groupBy("context").agg(F.count(F.lit(1)).alias("n_strata"), F.count_if(both).alias("n_both"), F.count_if(fl).alias("n_floor"),
                                 (F.sum(F.col("k") * (F.col("n") - F.col("k"))) / (F.sum("k") * F.sum(F.col("n") - F.col("k")))).alias("pairs_kept"))
    w = m.pool_strata(m.auc(d, ["context", "stratum"]), ["context"], floor).select("context", F.col("auc").alias("within_auc"))
    claim = (F.when(F.col("n_both") == 0, "label and context cannot be separated").when(F.col("n_floor") == 0, "separable but underpowered")
             .otherwise("label can be tested inside the context"))
    return s.join(w, "context", "left").withColumn("claim", claim)


def unit_collapse(df: DataFrame, labels, score="score", subject="subject", n_boot=2000, seed=0) -> DataFrame:
    """Per label column: row and subject AUC of one score with intervals, constant control and gap."""
    arms = F.array(*[F.struct(F.lit(c).alias("target"), F.col(c).cast("long").alias("label")) for c in labels])
    d = df.select(F.col(subject).alias("subject"), F.col(score).alias("score"), F.inline(arms))
    e = bundle(r.subject_cells(d, ["target"]), ["target"], n_boot, seed)
    const = m.auc(d.withColumn("score", F.lit(0.5)), ["target"], out="constant_auc").select("target", "constant_auc")
    return e.join(const, "target").withColumn("gap", F.col("slice_auc") - F.col("patient_auc"))


def coverage_grid(present: DataFrame, n_ids: int, stride: int, id_col="id", usable="usable") -> DataFrame:
    """Expected ids 1..n in chunks against what is present: usable, broken and absent per chunk."""
    spine = present.sparkSession.range(1, n_ids + 1).select(F.col("id").alias("__id"))
    p = present.groupBy(F.col(id_col).alias("__id")).agg(F.max(F.col(usable).cast("int")).alias("u"))
    d = spine.join(p, "__id", "left").withColumn("chunk", F.expr(f"(__id - 1) div {stride}"))
    g = d.groupBy("chunk").agg(F.min("__id").alias("first"), F.max("__id").alias("last"), F.count(F.lit(1)).alias("expected"), F.count_if(F.col("u") == 1).alias("usable"),
                               F.count_if(F.col("u") == 0).alias("broken"), F.count_if(F.col("u").isNull()).alias("absent"))
    off = present.filter(~F.col(id_col).between(1, n_ids)).agg(F.countDistinct(id_col).alias("off_grid"))
    return g.crossJoin(F.broadcast(off))
