"""URL filter: pattern rules indexed by their rarest literal token.

A rule's pattern is written as block lists write them: ``||`` starts at the host or one of its
subdomains, ``^`` is a separator or the end, ``*`` is anything, ``|`` at either end anchors there,
everything else is literal. Literal pieces bounded on both sides inside the pattern must turn up as
whole tokens of a matching URL, so each rule is filed under the one that is rarest in the table of
URLs. A URL's tokens fetch the rules filed under them, and only those run their regular expression.
Rules without such a token run on every URL.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, pick, table

SEPARATOR = r"[^A-Za-z0-9_%.\x{80}-\x{10FFFF}-]"
RULES_LIMIT = 100_000  # a rule list is read by the driver; longer lists are refused


@dataclass(frozen=True)
class Rule:
    """``name`` is reported; among fitting rules the highest ``rank`` wins, then the smallest name."""
    name: str
    pattern: str
    verdict: str
    rank: int


def site_rule(host: str, path: str, verdict: str) -> Rule:
    """A host with its subdomains and a path prefix; the longest such rule wins."""
    return Rule(host + path, f"||{host}{path}", verdict, 1000 + len(host + path))


#: The fixed rules of the query, and pattern rules that judge URLs which none of them fits.
SITES = [site_rule("org", "/", "allow"), site_rule("example.org", "/es/", "block"), site_rule("example.org", "/en/1", "block"),
         site_rule("com", "/fr/", "allow"), site_rule("com", "/de/", "block")]
PATTERNS = [Rule("spam", "||spam-*^", "block", 3), Rule("pills", "-pills.", "block", 3), Rule("casino", ".casino-", "block", 3),
            Rule("adult", "||adult-*^", "block", 3), Rule("free-download", "/free-download/", "block", 2),
            Rule("tracking", "^utm_source=spam^", "block", 2), Rule("feed", "?utm_source=feed|", "allow", 1)]
DEFAULT = "allow"


def regex_of(pattern: str) -> str:
    """The pattern as a regular expression over ``host + rest`` (the URL after ``://``), for Java and RE2."""
    body, head, tail = pattern, "", ""
    if body.startswith("||"):
        body, head = body[2:], r"^([^/?#]*\.)?"
    elif body.startswith("|"):
        body, head = body[1:], "^"
    if body.endswith("|"):
        body, tail = body[:-1], "$"
    special = {"*": ".*", "^": f"({SEPARATOR}|$)"}
    return "(?s)" + head + "".join(special.get(c) or re.sub(r"([^A-Za-z0-9_])", r"\\\1", c) for c in body) + tail


def tokens_of(pattern: str) -> list[str]:
    """Literal tokens that every URL under the pattern has as whole tokens: runs of letters and digits
    with a literal that is neither, a separator or an anchor on either side."""
    found = []
    for m in re.finditer(r"[a-z0-9]+", pattern):
        left, right = pattern[:m.start()], pattern[m.end():]
        if left and left[-1] != "*" and right and right[0] != "*":
            found.append(m.group())
    return sorted(set(found))


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host, path, and the whole after ``://`` with the host's A-Z lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.lit(1 << 30))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0))
    after = F.regexp_replace(rest, r"(?s)^[^/?#]*", "")
    path = F.regexp_extract(after, r"(?s)^[^?#]*", 0)
    return host, path, F.concat(host, after)


def url_tokens(c: Column) -> Column:
    return F.array_remove(F.array_distinct(F.split(ascii_lower(c), "[^a-z0-9]+")), "")


def rules_table(spark: SparkSession, rules: list[Rule]) -> DataFrame:
    if len(rules) > RULES_LIMIT:
        raise ValueError(f"{len(rules)} rules; at most {RULES_LIMIT} are held by the driver")
    rows = [(r.name, r.verdict, r.rank, regex_of(r.pattern), tokens_of(r.pattern)) for r in rules]
    return spark.createDataFrame(rows, "rule string, verdict string, rank int, regex string, tokens array<string>")


def index_rules(urls: DataFrame, rules: list[Rule]) -> DataFrame:
    """Each rule with ``token``, its literal that the fewest URLs have; null without literals.

    Counts are taken over all URLs, but only for tokens of rules (a broadcast of at most the rule list).
    """
    spec = rules_table(urls.sparkSession, rules)
    literal = spec.select("rule", F.explode("tokens").alias("token"))
    seen = urls.select(F.explode("tokens").alias("token")).join(F.broadcast(literal.select("token").distinct()), "token", "left_semi")
    counts = seen.groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rare = (literal.join(counts, "token", "left").groupBy("rule")
            .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token"))["token"].alias("token")))
    return spec.drop("tokens").join(rare, "rule", "left")


def judge(pages: DataFrame, url: str, keys: list[str], rules: list[Rule], default: str = DEFAULT) -> DataFrame:
    """One row per page: ``keys``, host, path, ``rule`` (of the winning rule, else null), ``verdict``.

    A missing URL, or one without ``://``, has an empty host and path, no tokens, and the default verdict
    unless a rule without tokens fits the empty text. Repeated pages are judged row by row: candidates and the
    winner are folded inside the row, nothing is grouped. Columns beyond ``keys`` are ignored.
    """
    names = {f"k{i}": k for i, k in enumerate(keys)}
    host, path, whole = url_parts(F.col("url"))
    parts = pick(pages, url=url, **names).select(*names, host.alias("host"), path.alias("path"), whole.alias("whole"))
    parts = parts.withColumn("tokens", url_tokens(F.col("whole")))
    index = index_rules(parts, rules)
    # one row: token -> rules filed under it; rules without a token under ''
    held = (index.groupBy(F.coalesce("token", F.lit("")).alias("token")).agg(F.collect_list(F.struct("rank", "rule", "verdict", "regex")).alias("rules"))
            .agg(F.map_from_entries(F.collect_list(F.struct("token", "rules"))).alias("by_token")))
    fetched = parts.crossJoin(F.broadcast(held))  # one row of at most RULES_LIMIT rules
    candidates = F.flatten(F.transform(F.concat(F.col("tokens"), F.array(F.lit(""))), lambda t: F.coalesce(F.try_element_at("by_token", t), F.array().cast("array<struct<rank:int,rule:string,verdict:string,regex:string>>"))))
    fit = F.filter(candidates, lambda r: F.regexp_like(F.col("whole"), r["regex"]))
    best = F.aggregate(fit, F.lit(None).cast("struct<rank:int,rule:string,verdict:string,regex:string>"), lambda a, r: F.when(
        a.isNull() | (r["rank"] > a["rank"]) | ((r["rank"] == a["rank"]) & (r["rule"] < a["rule"])), r).otherwise(a))
    out = fetched.withColumn("best", best)
    return out.select(*[F.col(n).alias(k) for n, k in names.items()], "host", "path", F.col("best.rule").alias("rule"),
                      F.coalesce("best.verdict", F.lit(default)).alias("verdict"), F.size(candidates).alias("n_tested"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    judged = judge(table(spark, sf_dir, "pages"), "url", ["page_id"], SITES + PATTERNS)
    site = F.col("rule").isin([r.name for r in SITES])
    return judged.select("page_id", "host", "path", F.when(site, F.col("rule")).alias("rule"), "verdict", F.when(~site, F.col("rule")).alias("pattern_rule"))


def sql() -> str:
    def text(v: str) -> str:
        return "'" + v.replace("'", "''") + "'"
    rows = ", ".join(f"({text(r.name)}, {text(r.verdict)}, {r.rank}, {text(regex_of(r.pattern))}, {r in SITES})" for r in SITES + PATTERNS)
    return f"""
WITH rules(rule, verdict, rank, regex, site) AS (VALUES {rows}),
rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r,
         row_number() OVER () AS row_no FROM pages),
parts AS (SELECT row_no, page_id, translate(regexp_extract(r, '(?s)^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
          regexp_replace(r, '(?s)^[^/?#]*', '') AS after FROM rest),
fits AS (SELECT row_no, rule, verdict, site, row_number() OVER (PARTITION BY row_no ORDER BY rank DESC, rule) AS place
         FROM parts JOIN rules ON regexp_matches(host || after, regex))
SELECT p.page_id, p.host, regexp_extract(p.after, '(?s)^[^?#]*') AS path, CASE WHEN f.site THEN f.rule END AS rule,
       coalesce(f.verdict, '{DEFAULT}') AS verdict, CASE WHEN NOT f.site THEN f.rule END AS pattern_rule
FROM parts p LEFT JOIN fits f ON p.row_no = f.row_no AND f.place = 1"""
