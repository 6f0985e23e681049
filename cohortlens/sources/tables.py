"""Readers: label tables, trees of run payloads, file manifests, lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.prefix import null_safe_join, number_rows, text_lead
from ..operators.geometry import order_lead

RESERVED = "__"  # internal columns start with it

BLOCK = "struct<probs: array<double>, labels: array<bigint>, patient_ids: array<string>, subject_ids: array<string>, cache_idx: array<bigint>, auc: double>"
PAYLOAD = f"cohort string, condition string, seed bigint, region string, control string, test {BLOCK}, val {BLOCK}"


def read_label_table(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """CSV, TSV or Parquet by suffix; the CSV delimiter is taken from the first line."""
    low = path.lower().rstrip("/")
    if low.endswith((".parquet", ".pq")):
        df = spark.read.parquet(path)
    else:
        sep = "\t"
        if not low.endswith((".tsv", ".tab")):
            head = spark.read.text(path).limit(1).collect()  # one line
            line = head[0][0] if head else ""
            sep = max((",", ";", "\t", "|"), key=line.count)
        reader = spark.read.option("header", True).option("sep", sep)
        df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    df = df.drop(*[c for c in df.columns if c.startswith("Unnamed: ") or c.startswith("_c") and c[2:].isdigit()])
    clash = [c for c in df.columns if c.startswith(RESERVED)]
    if clash:
        raise ValueError(f"reserved column names {clash}; rename them")
    return df


def read_payloads(spark: SparkSession, roots, recurse=True, keep_controls=False, skip_dir="_scratch", lines=False,
                  pattern="*.json") -> DataFrame:
    """One row per run payload of one or more trees, with base and fold from its directory.

    A physical file counts once; files without a test block or a condition, unreadable ones, the
    summary file and control runs are left out. ``lines``: many payloads per file, one per line.
    """
    roots = [roots] if isinstance(roots, str) else list(roots)
    r = (spark.read.schema(f"{PAYLOAD}, _corrupt_record string").option("multiLine", not lines).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", pattern).option("recursiveFileLookup", recurse))
    # a root below another one would list its files twice
    top = sorted({x.rstrip("/") for x in roots})
    top = [x for x in top if not any(recurse and x.startswith(y + "/") for y in top if y != x)]
    d = r.json(top).select("*", F.col("_metadata.file_path").alias("path"))
    return keep_payloads(d, keep_controls, skip_dir)


def keep_payloads(d: DataFrame, keep_controls=False, skip_dir="_scratch") -> DataFrame:
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    d = d.filter((F.col("_corrupt_record").isNull()) & F.col("test").isNotNull() & F.col("condition").isNotNull()
                 & (folder != skip_dir) & ~F.col("path").endswith("/statistics.json"))
    if not keep_controls:
        d = d.filter(F.coalesce("control", F.lit("none")) == "none")
    cv = F.regexp_extract(folder, r"^(.+)_cv([0-9]+)$", 2)
    d = d.withColumn("fold", F.nullif(cv, F.lit("")).cast("long"))
    d = d.withColumn("base", F.when(F.col("fold").isNotNull(), F.regexp_extract(folder, r"^(.+)_cv([0-9]+)$", 1)))
    d = d.withColumn("family", F.when(F.col("fold").isNotNull(), "cv").otherwise(folder))
    return d.drop("_corrupt_record")


def explode_predictions(payloads: DataFrame, block="test") -> DataFrame:
    """One row per prediction; parallel arrays of unequal length are an error."""
    b = lambda c: F.col(f"{block}.{c}")
    n = F.size(b("probs"))
    same = (F.size(b("labels")) == n) & (F.size(b("patient_ids")) == n) & (F.size(b("cache_idx")) == n)
    zipped = F.when(F.coalesce(same, F.lit(False)), F.arrays_zip(
        b("probs").alias("score"), b("labels").alias("label"), b("patient_ids").alias("patient_id"), b("cache_idx").alias("row_id"))) \
        .otherwise(F.raise_error(F.concat(F.lit("unequal arrays in "), F.col("path"))))
    keys = [c for c in ("path", "base", "fold", "family", "cohort", "condition", "seed", "region", "control") if c in payloads.columns]
    return payloads.select(*keys, F.inline(zipped)).toDF(*keys, "score", "label", "patient_id", "row_id")


def folder_kind(path: Column, kinds) -> Column:
    """The first known kind among the folder names of a path, deepest first."""
    parts = F.reverse(F.split(F.lower(path), "/"))
    return F.coalesce(F.element_at(F.filter(parts, lambda p: p.isin(*kinds)), 1), F.lit("unknown"))


def manifest(files: DataFrame) -> DataFrame:
    """Per kind by folder: files, bytes, folders, and files whose name says another kind."""
    wrong = (F.col("name_dir") != "") & (F.col("name_dir") != F.col("dir"))
    return files.groupBy("dir").agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("bytes"),
                                    F.countDistinct("host").alias("n_folders"), F.count_if(wrong).alias("n_misfiled"))


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    """(path, bytes, folder, basename) of every file below a root; contents are not read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", F.col("length").alias("bytes"))
    return d.withColumn("folder", F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).withColumn("basename", F.regexp_extract("path", r"([^/]+)$", 1))


def sampled_scan(files: DataFrame, per_folder: int, folder="dir", order="path") -> DataFrame:
    """The first files of every folder, so that a sample touches every group (the feature is the sample)."""
    d = number_rows(files, [folder], [order], text_lead(F.col(order).cast("string")), "place")
    return d.filter(F.col("place") <= per_folder)


def layout_census(df: DataFrame, group: str, attrs: Column) -> DataFrame:
    """Structural signatures (sorted attribute names) per group, and how often each occurs."""
    sig = F.array_join(F.array_sort(F.map_keys(attrs)), ",")
    return df.groupBy(group, sig.alias("signature")).agg(F.count(F.lit(1)).alias("n"))


def basename(c: Column) -> Column:
    return F.regexp_extract(c, r"([^/]+)$", 1)


def subject_lookup(cohort: DataFrame, file="file", subject="subject_id"):
    """(basename -> subject table, violations): a missing subject or one file with two subjects."""
    d = cohort.select(basename(F.col(file)).alias("basename"), F.col(subject).cast("string").alias("subject_id"))
    g = d.groupBy("basename").agg(F.min("subject_id").alias("subject_id"), F.countDistinct("subject_id").alias("n"),
                                  F.count_if(F.col("subject_id").isNull()).alias("nulls"))
    bad = g.filter((F.col("n") != 1) | (F.col("nulls") > 0)).select("basename", F.when(F.col("nulls") > 0, "missing subject").otherwise("two subjects").alias("problem"))
    return g.filter((F.col("n") == 1) & (F.col("nulls") == 0)).select("basename", "subject_id"), bad


def attach_subjects(df: DataFrame, lookup: DataFrame, file="file"):
    """(rows with subject_id, files without one)."""
    d = df.withColumn("basename", basename(F.col(file)))
    return d.join(lookup, "basename", "left"), d.join(lookup, "basename", "left_anti").select("basename").distinct()


def enrich(df: DataFrame, cohort: DataFrame, file="file", never=("label", "slice", "official_split")):
    """(rows with the cohort's file-level columns that were absent, one-row match count).

    One cohort row per file is kept: the smallest as a struct.
    """
    bring = [c for c in cohort.columns if c not in df.columns and c not in never]
    one = cohort.withColumn("basename", basename(F.col(file))).groupBy("basename").agg(F.min(F.struct(*bring)).alias("x"), F.lit(1).alias("__hit"))
    d = df.withColumn("basename", basename(F.col(file))).join(one, "basename", "left")
    n = d.agg(F.count("__hit").alias("n_matched"), F.count(F.lit(1)).alias("n_rows"))
    return d.select(*df.columns, *[F.col(f"x.{c}").alias(c) for c in bring]), n


def resolve_clusters(preds: DataFrame, cluster_map: DataFrame, run=("method",), row="row_id", patient="patient_id", given="subject_id_given"):
    """Rows with ``cluster`` and ``cluster_unit``: given subject, else joined subject when every row of
    the run joins, else the patient with the downgrade recorded."""
    from ..functions.prefix import group_stats
    d = preds.join(cluster_map.select(row, F.col("subject").alias("__s")), row, "left")
    d = group_stats(d, list(run), F.every(F.col(given).isNotNull()).alias("__g"), F.every(F.col("__s").isNotNull()).alias("__all"))
    return (d.withColumn("cluster", F.when(F.col("__g"), F.col(given)).when(F.col("__all"), F.col("__s")).otherwise(F.col(patient)))
            .withColumn("cluster_unit", F.when(F.col("__g"), "given subject").when(F.col("__all"), "joined subject").otherwise("patient (downgraded)"))
            .drop("__s", "__g", "__all"))


def backfill(df: DataFrame, lookup: DataFrame, key: str, column: str):
    """(table with the column, one-row report). Present and equal: no-op; present and different: an error."""
    new = lookup.select(key, F.col(column).alias("__new"))
    d = df.join(new, key, "left")
    if column not in df.columns:
        out = d.withColumnRenamed("__new", column)
        rep = out.agg(F.lit("backfilled").alias("status"), F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col(column).isNull()).alias("n_missing"))
        return out, rep
    differs = ~F.col(column).eqNullSafe(F.col("__new"))
    checked = d.withColumn(column, F.when(differs, F.raise_error(F.lit(f"{column} is present and disagrees"))).otherwise(F.col(column)))
    rep = d.agg(F.when(F.count_if(differs) == 0, "already-present").otherwise("conflict").alias("status"),
                F.count(F.lit(1)).alias("n_rows"), F.count_if(F.col("__new").isNull()).alias("n_missing"))
    return checked.drop("__new"), rep


def table_fingerprint(df: DataFrame) -> DataFrame:
    """Order-free content digest: rows, xor and modular sum of row hashes."""
    h = F.xxhash64(*[F.col(c) for c in sorted(df.columns)])
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.bit_xor(h).alias("mixed"), F.sum(F.pmod(h, F.lit(1_000_003))).alias("mod_sum"))


def resume(slices: DataFrame, done: DataFrame, todo: DataFrame, key="file"):
    """(slice rows of finished files, orphans dropped; files still to measure)."""
    d = done.select(key).filter(F.col(key).isNotNull()).distinct()
    return slices.join(d, key, "left_semi"), todo.join(d, key, "left_anti")
