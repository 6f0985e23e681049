"""A shallow classification tree grown level by level from grouped counts.

One scan per level for all partitions at once: rows are routed to their node in every partition by
nested column expressions and counted per (fold, nodes, column, value). Partitions, missing flags and
the 0/1 features of categories follow from these counts, not from rows. The best threshold comes
from running sums over the distinct values. Only the chosen splits (at most 2^depth per partition)
reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.prefix import null_safe_join, quantiles, running, spread, with_next
from ..functions.rules import snap
from ..session import settle

MAX_THRESHOLDS = 64  # fixed value: more distinct values are thinned to this many quantiles
NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double", "boolean")


@dataclass
class Encoder:
    """Design columns fitted on training rows: median and missing flag, or top levels and the rest."""

    spec: list = field(default_factory=list)

    @classmethod
    def fit(cls, train: DataFrame, cols, max_levels=30) -> "Encoder":
        return cls.fit_all(train.withColumn("fold", F.lit(-1)), 1, cols, max_levels)[0]

    @classmethod
    def fit_all(cls, df: DataFrame, n_folds: int, cols, max_levels=30) -> list["Encoder"]:
        """One encoder per partition from one pass: values are counted per fold and column first."""
        if not cols:
            return [cls([]) for _ in range(n_folds)]
        types = dict(df.dtypes)
        num = [c for c in cols if types[c] in NUMERIC or types[c].startswith("decimal")]
        per = df.select("fold", F.inline(F.array(*_arms(df, cols)))).groupBy("fold", "i", "v", "t").agg(F.count(F.lit(1)).alias("c"))
        parts = F.explode(F.array(*[F.lit(f) for f in range(n_folds)])).alias("part")
        c = settle(per.select("*", parts).filter(F.col("fold") != F.col("part")).groupBy("part", "i", "v", "t").agg(F.sum("c").alias("c")))
        is_num = F.col("i").isin([i for i, n in enumerate(cols) if n in num]) if num else F.lit(False)
        med = {(r["part"], r["i"]): r["value"] for r in quantiles(
            c.filter(is_num & F.col("v").isNotNull()), ["part", "i"], "v", "c", [0.5]).collect()}  # a number per column
        gap = {(r["part"], r["i"]) for r in c.filter(is_num & F.col("v").isNull()).select("part", "i").distinct().collect()}
        w = Window.partitionBy("part", "i").orderBy(F.desc("c"), F.asc_nulls_last("t"))
        top: dict = {}
        for r in (c.filter(~is_num).withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_levels)
                  .orderBy("part", "i", "r").collect()):  # max_levels names per column
            top.setdefault((r["part"], r["i"]), []).append(r["t"])
        return [cls([("num", n, med.get((f, i), 0.0), (f, i) in gap) if n in num else ("cat", n, top.get((f, i), []), None)
                     for i, n in enumerate(cols)]) for f in range(n_folds)]

    def columns(self) -> list[tuple[str, Column]]:
        out = []
        for kind, c, a, gap in self.spec:
            if kind == "num":
                x = F.col(c).cast("double")
                miss = x.isNull() | F.isnan(x)
                out.append((c, F.when(miss, F.lit(a)).otherwise(x)))
                if gap:
                    out.append((f"{c}__missing", miss.cast("double")))
            else:
                hits = [F.col(c).cast("string").eqNullSafe(F.lit(v)) for v in a]
                out += [(f"{c}={v}", h.cast("double")) for v, h in zip(a, hits)]
                rest = ~F.coalesce(F.greatest(*hits) if len(hits) > 1 else hits[0], F.lit(False)) if hits else F.lit(True)
                out.append((f"{c}=__other__", rest.cast("double")))
        return out

    def counted(self, first: int) -> dict[int, list[tuple[int, int, Column]]]:
        """Per column what follows from its counted ``v`` or ``t``: (number of the first feature, number of 0/1 features or none, value or level)."""
        out, at = {}, first
        for i, (kind, _, a, gap) in enumerate(self.spec):
            if kind == "num":
                out[i] = [(at, 0, F.coalesce("v", F.lit(float(a)))), *([(at + 1, 0, F.col("v").isNull().cast("double"))] if gap else [])]
                at += 2 if gap else 1
            else:
                level = F.lit(float(len(a)))
                for j, v in enumerate(a):
                    level = F.when(F.col("t").eqNullSafe(F.lit(v)), F.lit(float(j))).otherwise(level)
                out[i] = [(at, len(a) + 1, level)]
                at += len(a) + 1
        return out


def _arms(df: DataFrame, cols) -> list[Column]:
    """(i, v, t) of each column: its number and its value, a number or a text; a missing number is null."""
    types = dict(df.dtypes)
    num = {c for c in cols if types[c] in NUMERIC or types[c].startswith("decimal")}
    x = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    return [F.struct(F.lit(i).alias("i"), (x(c) if c in num else F.lit(None)).cast("double").alias("v"),
                     (F.lit(None) if c in num else F.col(c)).cast("string").alias("t")) for i, c in enumerate(cols)]


def _features(cells: DataFrame) -> DataFrame:
    """(partition, node, feature, v, p, n): counted cells, those of levels as counts of each level's 0/1 feature; written once."""
    at = ["partition", "node", "feature"]
    levels = cells.filter("width > 0").select("partition", "node", F.col("feature").alias("first"), "v", "p", "n", F.explode(F.expr("sequence(feature, feature + width - 1)")).alias("feature"))
    split = levels.withColumn("v", (F.col("v") == F.col("feature") - F.col("first")).cast("double")).groupBy(*at, "v").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    return settle(cells.filter("width = 0").select(*at, "v", "p", "n").unionByName(split))


def _best_splits(c: DataFrame) -> DataFrame:
    """(partition, node, feature, threshold): the split with least Gini impurity per node, from one row per value; ``c`` is read by four branches."""
    by = ["partition", "node", "feature"]
    r = running(c, by, ["v"], spread(F.col("v")), cp="p", cn="n")
    r = with_next(r, by, "v", "nxt")
    tot = c.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n"), F.count(F.lit(1)).alias("k"))
    r = null_safe_join(r, tot, by).filter(F.col("nxt").isNotNull())
    m, left = F.col("all_p") + F.col("all_n"), F.col("cp") + F.col("cn")
    first = left - F.col("p") - F.col("n")
    # quantile j of m sorted rows sits at (m - 1) j / 65; its lower neighbour has this row's value
    j = F.ceil(first * 65.0 / F.greatest(m - 1, F.lit(1)))
    at = (m - 1) * j / 65.0
    hit = (j >= 1) & (j <= MAX_THRESHOLDS) & (F.floor(at) >= first) & (F.floor(at) < left)
    frac = F.when(F.floor(at) == left - 1, at - F.floor(at)).otherwise(0.0)
    thr = F.when(F.col("k") > MAX_THRESHOLDS + 1, F.col("v") + frac * (F.col("nxt") - F.col("v"))) \
        .otherwise((F.col("v") + F.col("nxt")) / 2)
    r = r.filter((F.col("k") <= MAX_THRESHOLDS + 1) | hit)
    r = r.filter((left >= F.col("min_leaf")) & (m - left >= F.col("min_leaf")))
    pl, pr = F.col("cp") / left, (F.col("all_p") - F.col("cp")) / (m - left)
    imp = (left * 2 * pl * (1 - pl) + (m - left) * 2 * pr * (1 - pr)) / m
    return r.groupBy("partition", "node").agg(
        F.min(F.struct(F.round(imp, 12).alias("imp"), F.col("feature"), thr.alias("thr"))).alias("b")).select(
        "partition", "node", F.col("b.feature").alias("feature"), F.col("b.thr").alias("threshold"))


def _by_partition(part: Column, cases: dict) -> Column:
    """One expression that picks the case of a row's partition."""
    out = F.lit(None)
    for f, x in cases.items():
        out = F.when(part == f, x).otherwise(out)
    return out


def _route(splits: dict, partition: int, design: list) -> Column:
    """Node id of a row under the splits of one partition: root 1, children 2i and 2i + 1."""
    def walk(node):
        if (partition, node) not in splits:
            return F.lit(node)
        f, thr = splits[(partition, node)]
        return F.when(design[f] <= F.lit(thr), walk(2 * node)).otherwise(walk(2 * node + 1))
    return walk(1)


def fit_score(df: DataFrame, n_folds: int, cols, use_relpos=False, name="tree", max_depth=3, max_levels=30,
              smoothing=1.0, min_leaf: int | None = None):
    """(scored cells, trees). Rows need subject, fold, label and, with ``use_relpos``, relpos.

    All partitions grow together in one scan per level; features of a partition are numbered in
    design order.
    """
    need = ["subject", "fold", F.col("label").cast("long").alias("y"), *(["relpos"] if use_relpos else []), *cols]
    df = settle(df.select(*need))
    names, design, counted = {}, {}, {}
    for f, enc in enumerate(Encoder.fit_all(df, n_folds, list(cols), max_levels)):
        lead = [("relative_position", F.col("relpos").cast("double"))] if use_relpos else []
        names[f], design[f] = ([*x] for x in zip(*lead, *enc.columns())) if lead or enc.spec else ([], [])
        counted[f] = ({-1: [(0, 0, F.col("v"))]} if lead else {}) | enc.counted(len(lead))
    one = F.struct(F.lit(-1).alias("i"), F.col("relpos" if use_relpos else "y").cast("double").alias("v"), F.lit(None).cast("string").alias("t"))
    none = F.struct(F.lit(-1).alias("i"), F.lit(None).cast("double").alias("v"), F.lit(None).cast("string").alias("t"))
    arms = [*([one] if use_relpos else []), *_arms(df, list(cols))]
    folds = range(n_folds)
    per_partition = F.array(*[F.struct(F.lit(f).alias("partition"), F.col(f"node{f}").alias("node")) for f in folds])
    splits, info, total, least = {}, {}, {}, {}
    open_nodes = {(f, 1) for f in folds}
    for depth in range(max_depth + 1):
        last = depth == max_depth or not arms  # sizes of nodes only
        rows = df.select("*", *[_route(splits, f, design[f]).alias(f"node{f}") for f in folds])
        by = ["fold", *[f"node{f}" for f in folds]]
        cells = settle(rows.select(*by, "y", F.inline(F.array(*([none] if last else arms)))).groupBy(*by, "i", "v", "t").agg(
            F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")))
        tag = F.concat_ws(":", "partition", "node")
        within = lambda c, keep: (c.select("fold", "i", "v", "t", "p", "n", F.inline(per_partition)).filter(F.col("fold") != F.col("partition"))
                                  .filter(tag.isin([f"{p}:{n}" for p, n in keep])))
        sizes = within(cells.filter(F.col("i") == (-1 if last or use_relpos else 0)), open_nodes).groupBy("partition", "node").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
        stats = {(r["partition"], r["node"]): (r["p"] + r["n"], r["p"]) for r in sizes.collect()}  # <= 2^depth rows per partition
        info.update(stats)
        if depth == 0:
            total = {f: stats[(f, 1)] for f in folds if (f, 1) in stats}
            least = {f: min_leaf or max(10, int(0.02 * n)) for f, (n, _) in total.items()}
        grow = {k for k, (n, y) in stats.items() if not last and n >= 2 * least[k[0]] and 0 < y < n}
        if not grow:
            break
        feature = F.lit(None)
        for f in folds:
            for i, made in counted[f].items():
                each = F.array(*[F.struct(F.lit(at).alias("feature"), F.lit(width).alias("width"), x.alias("v")) for at, width, x in made])
                feature = F.when((F.col("partition") == f) & (F.col("i") == i), each).otherwise(feature)
        counts = within(cells, grow).select("partition", "node", "p", "n", F.inline(feature)).groupBy("partition", "node", "feature", "width", "v")
        cells = _features(counts.agg(F.sum("p").alias("p"), F.sum("n").alias("n")))
        floor = _by_partition(F.col("partition"), {f: F.lit(v) for f, v in least.items()})
        new = {(r["partition"], r["node"]): (r["feature"], r["threshold"])
               for r in _best_splits(cells.withColumn("min_leaf", floor)).collect()}
        splits.update(new)
        open_nodes = {(p, c) for (p, n) in new for c in (2 * n, 2 * n + 1)}
        if not open_nodes:
            break
    prior = {f: k / n for f, (n, k) in total.items()}
    leaf = {f"{p}:{n}": (k + smoothing * prior[p]) / (c + smoothing) for (p, n), (c, k) in info.items() if (p, n) not in splits}
    rates = F.create_map(*[F.lit(x) for kv in leaf.items() for x in kv])
    test = (df.filter(F.col("fold").isin([f for f in folds if f in total]))
            .withColumn("node", _by_partition(F.col("fold"), {f: _route(splits, f, design[f]) for f in folds}))
            .groupBy("subject", "fold", "node").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")))
    scored = test.select(F.lit(name).alias("feature"), "subject", "fold", F.col("node").cast("string").alias("level"), "p", "n",
                         snap(rates[F.concat_ws(":", "fold", "node")]).alias("s"))
    return scored, {"splits": splits, "info": info, "names": names}


def describe(spark, trees) -> DataFrame:
    """Per partition: depth used, leaves, split features, smallest leaf."""
    rows = []
    for f, names in trees["names"].items():
        sp = {n: s for (p, n), s in trees["splits"].items() if p == f}
        nodes = {n: c for (p, n), (c, _) in trees["info"].items() if p == f}
        leaves = {n: c for n, c in nodes.items() if n not in sp}
        depth = max((n.bit_length() for n in sp), default=0)
        rows.append((f, depth, len(leaves), ",".join(sorted({names[s[0]] for s in sp.values()})), min(leaves.values())))
    return spark.createDataFrame(rows, "partition long, depth long, n_leaves long, features string, smallest_leaf long")
