"""Benchmark decontamination by template windows; DataFrame functions only.

Texts become words and numbers; numbers, names (capitalised inside a sentence) and units after a number give way
to typed placeholders, everything else is lower-cased. Windows of WIDTH such tokens are hash-joined with those of
the benchmark. Matches of one document and item that lie on one diagonal are a copy of a passage if they are
enough and their slots agree: one value of the item always stands for one value of the document, and different
values for different ones. So a question asked again with other numbers, names or units is caught, and windows
that only share a template are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick, settle, table

WIDTH = 8
LITERALS = 5  # windows with fewer plain words are no evidence and are not indexed
WINDOWS = 3  # matching windows on a diagonal (all of an item that has fewer)
BROADCAST_ROWS = 1_000_000  # benchmark windows up to this number are sent to the tasks; more are joined by shuffle
TOKEN = r"[.?!\n][ .?!\n\t\r\x22]*[\p{L}\p{M}]+|[\p{L}\p{M}]+|[0-9]+(?:[.,:/][0-9]+)*"
# raw tokens: one for each letter of a script without spaces, and signs, so that 1 + 2 and 1 - 2 differ
UNSPACED = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}"
RAW = rf"[{UNSPACED}]|[\p{{L}}\p{{M}}&&[^{UNSPACED}]]+|[0-9]+(?:[.,:/][0-9]+)*|[\p{{S}}*/%-]"
BREAK = " .?!\n\t\r\""
UNITS = ["mm", "cm", "m", "km", "in", "inch", "inches", "ft", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons",
         "lb", "lbs", "pound", "pounds", "oz", "ounce", "ounces", "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "s", "sec", "second",
         "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years", "kmh", "mph",
         "dollar", "dollars", "cent", "cents", "euro", "euros", "percent", "degree", "degrees", "meter", "meters", "metre", "metres"]


def canonical(tokens: Column) -> Column:
    """Each token as a literal or a typed placeholder. Most tokens begin with a small letter, so that is asked first."""
    def one(t: Column, i: Column) -> Column:
        code, low, first = F.ascii(t), F.lower(t), F.substring(t, 1, 1)
        unit = low.isin(UNITS) & F.ascii(F.get(tokens, i - 1)).between(48, 57)
        return (F.when(code.between(97, 122), F.when(unit, F.lit("<unit>")).otherwise(low)).when(code.between(48, 57), F.lit("<num>"))
                .when(code < 65, F.lower(F.ltrim(t, F.lit(BREAK)))).when(unit, F.lit("<unit>"))
                .when((first != F.lower(first)) & (i > 0), F.lit("<name>")).otherwise(low))
    return F.transform(tokens, one)


def typed_tokens(df: DataFrame, ident: str) -> DataFrame:
    tokens = df.select(ident, F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(TOKEN), F.lit(0)).alias("tokens"))
    return tokens.select(ident, "tokens", canonical(F.col("tokens")).alias("canon"))


def window_places() -> Column:
    return F.when(F.size("canon") >= WIDTH, F.sequence(F.lit(1), F.size("canon") - (WIDTH - 1))).otherwise(F.array().cast("array<int>"))


def window_hashes(df: DataFrame, ident: str) -> DataFrame:
    """(ident, h) of every window of column ``text``."""
    made = F.transform(window_places(), lambda i: F.xxhash64(F.slice("canon", i, WIDTH)))
    return typed_tokens(df, ident).select(ident, F.explode(made).alias("h"))


def windows(df: DataFrame, ident: str) -> DataFrame:
    """(ident, place, h, slots) of every window of column ``text``; slots hold the raw value of each placeholder, else null."""
    typed = typed_tokens(df, ident)
    slotted = typed.select(ident, "canon", F.transform("canon", lambda c, i: F.when(c.startswith("<"), F.lower(F.get("tokens", i)))).alias("slots"))
    made = F.transform(window_places(), lambda i: F.struct(F.xxhash64(F.slice("canon", i, WIDTH)).alias("h"), F.slice("slots", i, WIDTH).alias("slots")))
    out = slotted.select(ident, F.posexplode(made).alias("place", "w"))
    return out.select(ident, "place", "w.h", "w.slots")


def template_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """(``key``, ``item``, n_windows, item_windows, n_changed): passages of benchmark items inside documents.

    ``n_windows`` counts distinct windows of the item found on its best diagonal; ``n_changed`` the slot values that differ
    there (0: a verbatim copy). Texts shorter than a window, missing texts and rows without a key match nothing. Rows of one
    key are one document; of items with one id, each row counts. Other columns are ignored.
    """
    asked = windows(pick(benchmark, item=item, text=item_text).filter("item IS NOT NULL"), "item").withColumnsRenamed({"place": "item_place", "slots": "item_slots"})
    asked = asked.filter(F.size(F.filter("item_slots", lambda s: s.isNotNull())) <= WIDTH - LITERALS)
    sizes = asked.groupBy("item").agg(F.countDistinct("h").alias("item_windows"))
    templates = asked.select("h").distinct()
    if asked.count() <= BROADCAST_ROWS:
        asked, sizes, templates = F.broadcast(asked), F.broadcast(sizes), F.broadcast(templates)
    texts = pick(docs, key=key, text=text).filter("key IS NOT NULL")
    # every window as a hash first; places and slots are worked out for documents that have a template at all
    hit = settle(window_hashes(texts, "key").join(templates, "h", "left_semi").select("key").distinct())
    hit = F.broadcast(hit) if hit.count() <= BROADCAST_ROWS else hit
    found = windows(texts.join(hit, "key", "left_semi"), "key").join(asked, "h")
    runs = ["key", "item", (F.col("place") - F.col("item_place")).alias("diagonal")]
    matches = found.select(*runs, "h", F.arrays_zip("item_slots", "slots").alias("pairs"))
    counted = matches.groupBy("key", "item", "diagonal").agg(F.countDistinct("h").alias("n_windows"))
    slots = (matches.select("key", "item", "diagonal", F.explode("pairs").alias("p")).filter("p.item_slots IS NOT NULL")
             .select("key", "item", "diagonal", F.col("p.item_slots").alias("theirs"), F.col("p.slots").alias("ours")).distinct())
    agreed = slots.groupBy("key", "item", "diagonal").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("theirs").alias("n_theirs"), F.countDistinct("ours").alias("n_ours"),
                                                          F.count_if(F.col("theirs") != F.col("ours")).alias("n_changed"))
    judged = counted.join(agreed, ["key", "item", "diagonal"], "left").join(sizes, "item")
    ok = F.col("n").isNull() | ((F.col("n") == F.col("n_theirs")) & (F.col("n") == F.col("n_ours")))
    leaks = judged.filter(ok & (F.col("n_windows") >= F.least(F.lit(WINDOWS), F.col("item_windows"))))
    best = leaks.groupBy("key", "item").agg(F.max(F.struct("n_windows", F.negate(F.coalesce("n_changed", F.lit(0))).alias("c"))).alias("b"), F.max("item_windows").alias("item_windows"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "b.n_windows", "item_windows", F.negate("b.c").alias("n_changed"))


def raw_tokens() -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(RAW), F.lit(0)), F.lower)


def raw_windows(df: DataFrame, ident: str, lengths: list[int]) -> DataFrame:
    """(ident, place, h) of every window of so many raw tokens of column ``text``."""
    def made(n: int) -> Column:
        places = F.when(F.size("raw") >= n, F.sequence(F.lit(1), F.size("raw") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("place"), F.xxhash64(F.slice("raw", i, n)).alias("h")))
    out = df.select(ident, raw_tokens().alias("raw")).select(ident, F.explode(F.concat(*[made(n) for n in lengths])).alias("w"))
    return out.select(ident, "w.place", "w.h")


def verbatim_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """The columns of ``template_leaks`` for word-for-word copies of items with fewer than WINDOWS windows of LITERALS plain words.

    Such an item is found by windows of WIDTH raw tokens in order, or whole if it is shorter; case, spaces and punctuation
    do not count, numbers and names do. A short item of one word is found wherever that word is. Items without a letter,
    number or sign, missing texts and rows without a key match nothing.
    """
    items = pick(benchmark, item=item, text=item_text).filter("item IS NOT NULL").withColumn("row", F.monotonically_increasing_id())
    items = settle(items)
    typed = windows(items, "row").filter(F.size(F.filter("slots", lambda s: s.isNotNull())) <= WIDTH - LITERALS)
    # the first window counts for nothing: inside a sentence its first word can look like a name
    rich = typed.filter("place > 0").groupBy("row").agg(F.countDistinct("h").alias("k")).filter(F.col("k") >= WINDOWS)
    poor = items.join(rich.select("row"), "row", "left_anti").withColumn("n", F.least(F.lit(WIDTH), F.size(raw_tokens()))).filter("n > 0")
    poor = settle(poor)
    lengths = sorted(r[0] for r in poor.select("n").distinct().collect())  # WIDTH values at most
    texts = pick(docs, key=key, text=text).filter("key IS NOT NULL")
    asked = None
    for n in lengths:
        of_n = raw_windows(poor.filter(F.col("n") == n), "row", [n])
        asked = of_n if asked is None else asked.unionByName(of_n)
    if asked is None:
        kinds = texts.schema["key"].dataType.simpleString(), items.schema["item"].dataType.simpleString()
        return docs.sparkSession.createDataFrame([], f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, n_windows long, item_windows long, n_changed long")
    asked = settle(asked.join(poor.select("row", "item"), "row").withColumnRenamed("place", "item_place"))
    sizes = asked.groupBy("row").agg(F.countDistinct("h").alias("item_windows"))
    if asked.count() <= BROADCAST_ROWS:
        asked, sizes = F.broadcast(asked), F.broadcast(sizes)
    found = raw_windows(texts, "key", lengths).join(asked, "h")
    runs = found.groupBy("key", "item", "row", (F.col("place") - F.col("item_place")).alias("diagonal")).agg(F.countDistinct("h").alias("n_windows"))
    leaks = runs.join(sizes, "row").filter(F.col("n_windows") >= F.least(F.lit(WINDOWS), F.col("item_windows")))
    best = leaks.groupBy("key", "item").agg(F.max(F.struct("n_windows", "item_windows")).alias("b"))
    return best.select(F.col("key").alias(key), F.col("item").alias(item), "b.n_windows", "b.item_windows", F.lit(0).cast("long").alias("n_changed"))


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``template_leaks`` and ``verbatim_leaks``, one row for each document and item; what both find is the template's."""
    names = dict(key=key, text=text, item=item, item_text=item_text)
    first = settle(template_leaks(docs, benchmark, **names))
    return first.unionByName(verbatim_leaks(docs, benchmark, **names).join(first.select(key, item), [key, item], "left_anti"))


def op9_template_decontamination(spark, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def sql() -> str:
    def made(source: str, ident: str) -> str:
        units = ", ".join(f"'{u}'" for u in UNITS)
        brk = "' .?!' || chr(10) || chr(9) || chr(13) || '\"'"
        digit = lambda c: f"(substr({c}, 1, 1) >= '0' AND substr({c}, 1, 1) <= '9')"
        pattern = TOKEN.replace("'", "''")
        return f"""
SELECT {ident} AS id, place - 1 AS place, array_to_string(canon[place:place + {WIDTH - 1}], ' ') AS h, slots[place:place + {WIDTH - 1}] AS slots
FROM (SELECT *, unnest(range(1, len(canon) - {WIDTH - 2})) AS place FROM
 (SELECT {ident}, canon, list_transform(canon, lambda c, i: CASE WHEN c[1] = '<' THEN lower(tokens[i]) END) AS slots FROM
  (SELECT {ident}, tokens, list_transform(tokens, lambda t, i: CASE WHEN contains({brk}, substr(t, 1, 1)) THEN lower(ltrim(t, {brk}))
     WHEN {digit('t')} THEN '<num>' WHEN lower(t) IN ({units}) AND i > 1 AND {digit('tokens[greatest(i - 1, 1)]')} THEN '<unit>'
     WHEN substr(t, 1, 1) <> lower(substr(t, 1, 1)) AND i > 1 THEN '<name>' ELSE lower(t) END) AS canon FROM
   (SELECT {ident}, regexp_extract_all(coalesce(text, ''), '{pattern}') AS tokens FROM {source} WHERE {ident} IS NOT NULL)))) AS w"""
    return f"""
WITH d AS ({made('documents', 'doc_id')}),
b AS (SELECT * FROM ({made('benchmark', 'item_id')}) AS q WHERE len(list_filter(slots, lambda s: s IS NOT NULL)) <= {WIDTH - LITERALS}),
sizes AS (SELECT id AS item_id, count(DISTINCT h) AS item_windows FROM b GROUP BY 1),
m AS (SELECT d.id AS doc_id, b.id AS item_id, d.place - b.place AS diagonal, d.h, b.slots AS theirs, d.slots AS ours FROM d JOIN b USING (h)),
counted AS (SELECT doc_id, item_id, diagonal, count(DISTINCT h) AS n_windows FROM m GROUP BY ALL),
s AS (SELECT DISTINCT doc_id, item_id, diagonal, theirs, ours FROM (SELECT doc_id, item_id, diagonal, unnest(theirs) AS theirs, unnest(ours) AS ours FROM m) AS u WHERE theirs IS NOT NULL),
agreed AS (SELECT doc_id, item_id, diagonal, count(*) AS n, count(DISTINCT theirs) AS nt, count(DISTINCT ours) AS no, count(*) FILTER (theirs <> ours) AS n_changed FROM s GROUP BY ALL),
leaks AS (SELECT c.doc_id, c.item_id, n_windows, item_windows, coalesce(n_changed, 0) AS n_changed,
            row_number() OVER (PARTITION BY c.doc_id, c.item_id ORDER BY n_windows DESC, coalesce(n_changed, 0)) AS place
          FROM counted c LEFT JOIN agreed a USING (doc_id, item_id, diagonal) JOIN sizes USING (item_id)
          WHERE (n IS NULL OR (n = nt AND n = no)) AND n_windows >= least({WINDOWS}, item_windows))
SELECT doc_id, item_id, n_windows, item_windows, n_changed FROM leaks WHERE place = 1"""
