"""Spelling variants by a relational trie frontier.

The vocabulary is filed in tries held as one table of nodes with their labelled edges (path-compressed: only branching
nodes remain). States (word, position, node, edits) are joined with it level by level: a state without an edit follows its
own letters and spawns a one-edit state wherever a path leaves it; a one-edit state must match exactly from there on; one
that reaches the end of a path has found a neighbour.

Two things keep the frontier small without losing a pair. There is a trie for each word length and reading direction: of
two words one edit apart, either the part before or the part after the edit is at least half of the word, so walks start
at half length, forward or backward. And a pair is sought from one side only: from the shorter word, or from the one whose
replaced letter is smaller. Nodes are 64-bit hashes of (direction, length, prefix); a neighbour is an edited word that the
word table confirms, so colliding hashes add nothing.

Both sides of every join grow with the vocabulary and all are merged: Spark guesses sizes from files before rows are exploded,
or from small files of nested rows, and would collect on the driver what passes for small.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.prefix import merged
from .common import ascii_lower, pick, settle, table

LETTERS = "a-zÀ-ÿ"  # of a lower-cased run
EVERY = 97  # one in so many (document, run) pairs loses a letter


def part(s: str, at: Column | str, n: Column | int | None = None) -> Column:
    """``n`` code points of column ``s`` from the 0-based position ``at``."""
    at = F.col(at) if isinstance(at, str) else at
    return F.substring(F.col(s), at + 1, F.lit(1 << 30) if n is None else (F.lit(n) if isinstance(n, int) else n))


def word_counts(df: DataFrame, key: str, text: str, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n): runs of letters of all texts, lower-cased, with the planted slips; a missing text has none, a missing key counts as empty."""
    runs = pick(df, doc_id=key, text=text).select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("run"))
    hashed = runs.filter(F.length("run") >= shortest).withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % EVERY == 0, F.concat(F.substring("run", F.lit(1), at), part("run", at + 1))).otherwise(F.col("run"))
    words = hashed.select(word.alias("word")).filter(F.length("word") >= shortest)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def start(back: bool, size: Column) -> Column:
    """Where walks for targets of ``size`` letters begin."""
    return F.floor(size / 2).cast("int") + 1 if back else F.floor((size - 1) / 2).cast("int")


def node_id(back: Column, size: Column, prefix: Column) -> Column:
    return F.xxhash64(back, size.cast("int"), prefix)


def oriented(words: DataFrame) -> DataFrame:
    """Each word read forward and backward, with its length."""
    both = F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("s")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("s"))))
    return words.select(both.alias("x")).select("x.*").withColumn("size", F.length("s"))


def trie(words: DataFrame) -> DataFrame:
    """(node, children): kept nodes with edges (label, child, nexts). A leaf has no child; ``nexts`` are the child's own first letters."""
    from_ = F.when(F.col("back"), start(True, F.col("size"))).otherwise(start(False, F.col("size")))
    steps = oriented(words).select("back", "s", "size", from_.alias("low"), F.explode(F.sequence(from_, F.col("size") - 1)).alias("d"))
    steps = steps.withColumn("node", node_id(F.col("back"), F.col("size"), part("s", F.lit(0), F.col("d"))))
    kept = (steps.groupBy("node").agg(F.collect_set(part("s", "d", 1)).alias("nexts"), F.bool_or(F.col("d") == F.col("low")).alias("first"))
            .filter("first OR size(nexts) > 1").select("node", F.concat_ws("", "nexts").alias("nexts")))
    paths = merged(steps).join(kept, "node").groupBy("back", "s").agg(F.array_sort(F.collect_list(F.struct("d", "node", "nexts"))).alias("p"))
    edges = paths.select("s", F.posexplode("p").alias("i", "here"), "p").select("s", "here", F.try_element_at("p", F.col("i") + 2).alias("there")).select(
        F.col("here.node").alias("node"), part("s", F.col("here.d"), F.coalesce(F.col("there.d") - F.col("here.d"), F.lit(1 << 30))).alias("label"),
        F.col("there.node").alias("child"), F.col("there.nexts").alias("nexts"))
    # at most one child for each letter of the alphabet
    return settle(edges.groupBy("node").agg(F.collect_set(F.struct("label", "child", "nexts")).alias("children")))


def frontier(words: DataFrame) -> DataFrame:
    """First states (back, s, target, pos, node): each word on its way to targets of its own length and of one letter more."""
    goal = F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("goal")
    own = oriented(words).select("back", "s", goal)
    pos = F.when(F.col("back"), start(True, F.col("goal"))).otherwise(start(False, F.col("goal")))
    own = own.withColumn("pos", pos).filter(F.col("pos") <= F.length("s"))
    return own.select("back", "s", F.lit(None).cast("string").alias("target"), "pos", node_id(F.col("back"), F.col("goal"), part("s", F.lit(0), F.col("pos"))).alias("node"), "goal")


def advance(states: DataFrame, nodes: DataFrame) -> DataFrame:
    """The next states; ``node`` is null where a target is complete."""
    at = merged(states).join(nodes, "node").select("back", "s", "target", "pos", "goal", F.inline("children")).withColumn("len", F.length("label"))
    follows = F.col("child").isNull() | (F.instr(F.col("nexts"), F.substring(F.col("target"), F.col("pos") + F.col("len") + 1, F.lit(1))) > 0)
    fits = part("target", "pos", F.col("len")) == F.col("label")
    edited = at.filter(F.col("target").isNotNull() & fits & follows)

    free = at.filter("target IS NULL").withColumn("same", F.left("label", F.lit(1)) == part("s", "pos", 1)).withColumn("whole", part("s", "pos", F.col("len")) == F.col("label"))
    walked = free.filter("whole AND child IS NOT NULL")
    leave = F.when(F.col("same"), F.sequence(F.lit(1), F.col("len") - 1)).otherwise(F.array(F.lit(0)))
    left = free.filter("NOT whole").withColumn("q", F.explode(leave))
    here, letter = F.col("pos") + F.col("q"), part("label", "q", 1)
    old = part("s", here, 1)
    left = left.filter((part("s", "pos", F.col("q")) == F.left("label", F.col("q"))) & (old != letter))
    left = left.filter((F.col("goal") > F.length("s")) | (letter > old)).filter((F.col("goal") > F.length("s")) | (old != ""))
    rest = F.when(F.col("goal") > F.length("s"), part("s", here)).otherwise(part("s", here + 1))
    spawned = left.withColumn("target", F.concat(part("s", F.lit(0), here), letter, rest)).filter(fits & follows)

    def shape(df: DataFrame) -> DataFrame:
        return df.select("back", "s", "target", (F.col("pos") + F.col("len")).alias("pos"), F.col("child").alias("node"), "goal")
    return reduce(DataFrame.unionByName, map(shape, (edited, walked, spawned)))


def neighbours(words: DataFrame) -> DataFrame:
    """(a, b): pairs of distinct ``words`` of at least 4 letters that are one edit apart, each pair once."""
    nodes, found = trie(words), []
    states = settle(frontier(words))
    while True:
        states = settle(advance(states, nodes))
        found.append(states.filter("node IS NULL").select("back", "s", "target"))
        states = states.filter("node IS NOT NULL")
        if not states.head(1):
            break
    turn = lambda c: F.when(F.col("back"), F.reverse(c)).otherwise(F.col(c))
    pairs = reduce(DataFrame.unionByName, found).select(turn("s").alias("a"), turn("target").alias("b")).distinct()
    return merged(pairs).join(words.select(F.col("word").alias("b")), "b").select("a", "b")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of the words that have a form, by doubling the steps taken until none leads further."""
    now = settle(forms.select("word", F.col("form").alias("root")))
    while True:
        step = merged(now).join(now.select(F.col("word").alias("root"), F.col("root").alias("beyond")), "root", "left")
        step = settle(step.select("word", F.coalesce("beyond", "root").alias("root"), F.col("beyond").isNotNull().alias("on")))
        now = step.select("word", "root")
        if not step.filter("on").head(1):
            return now


def variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """Words (word, n), distinct, of at least 4 letters -> word, form, root, n, n_near, form_n.

    Near words differ by one letter inserted, deleted or replaced. The form is the near word of largest n (ties: smallest
    in code-point order) if that n is at least ``ratio`` times the word's. Forms have ever larger n, so they end in a root.
    An empty table gives no rows.
    """
    counts = settle(counts.select("word", "n"))
    once = neighbours(counts)
    both = once.select(F.col("a").alias("word"), F.col("b").alias("other")).unionByName(once.select(F.col("b").alias("word"), F.col("a").alias("other")))
    near = merged(both).join(counts.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")
    best = near.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("minus"), "other")).alias("best"))
    fits = -F.col("best.minus") >= ratio * F.col("n")
    chosen = settle(merged(counts).join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(fits, F.col("best.other")).alias("form"), F.when(fits, -F.col("best.minus")).alias("form_n")))
    ends = roots(chosen.filter("form IS NOT NULL"))
    return merged(chosen).join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    return variants(word_counts(table(spark, sf_dir, "documents"), "doc_id", "text"))
