"""WARC derivatives: metadata and plain-text conversion records of response records.

Both records name their source in WARC-Refers-To (with its URI and date) and carry its payload digest; the metadata
record keeps the source's HTTP status and headers, its title and its links. Ids are name-based on the source id and
the kind, so a task that runs again, or the whole job, gives the same ids. Every step is a map over rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table

CAPTURED, DERIVED = "2024-01-01T00:00:00Z", "2024-02-01T00:00:00Z"  # dates of the query's records: the pages have none
CRLF = "\r\n"
#: (pattern, replacement) in order, valid for Java and RE2: what has no text, tags that break lines, other tags
TAG_STEPS = [(r"(?is)<(?:!--.*?--|script\b.*?</script\s*|style\b.*?</style\s*|head\b.*?</head\s*)>", " "),
             (r"(?i)</?(?:p|div|br|li|ul|ol|dl|dt|dd|h[1-6]|tr|td|th|table|article|section|header|footer|nav|main|aside|form|pre|blockquote|body|html)\b[^>]*>", "\n"),
             (r"<[^>]*>", "")]
#: plain replacements; the ampersand comes last, so that no text is decoded twice
ENTITIES = [("&nbsp;", " "), ("&#160;", " "), ("&lt;", "<"), ("&#60;", "<"), ("&gt;", ">"), ("&#62;", ">"), ("&quot;", "\""), ("&#34;", "\""), ("&apos;", "'"),
            ("&#39;", "'"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"), ("&#38;", "&")]
SPACE_STEPS = [(r"[ \t\r\f]{2,}|[\t\r\f]", " "), (r" ?\n[ \n]*", "\n")]
TITLE = r"(?is)<title\b[^>]*>(.*?)</title\s*>"
LINK = r"(?i)<a\s[^>]*?href=\"([^\"]*)\""


def digest(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def record_id(*parts: Column) -> Column:
    """A urn:uuid made of the parts' sha256."""
    h = F.sha2(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]), 256)
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def responses(pages: DataFrame, date: str = CAPTURED) -> DataFrame:
    """Response records of a table of pages: all its columns under ``page`` and the record's fields."""
    payload = F.coalesce("html", F.lit(""))
    headers = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.octet_length(payload).cast("string"))
    return pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("page"), record_id(F.lit("response"), F.col("page_id"), F.col("url")).alias("record_id"),
                        F.col("url").alias("target_uri"), F.lit(date).alias("date"), headers.alias("headers"), payload.alias("payload"), digest(payload).alias("payload_digest"))


def plain_text(html: Column) -> Column:
    for pattern, to in TAG_STEPS:
        html = F.regexp_replace(html, pattern, to)
    for entity, to in ENTITIES:
        html = F.replace(html, F.lit(entity), F.lit(to))
    for pattern, to in SPACE_STEPS:
        html = F.regexp_replace(html, pattern, to)
    return F.btrim(html, F.lit(" \n"))


def metadata(source: dict[str, Column]) -> Column:
    """Block of a metadata record, in warc-fields."""
    headers = F.coalesce(source["headers"], F.lit(""))
    fields = F.regexp_replace(F.regexp_replace(headers, r"^[^\r\n]*(\r\n)?", ""), r"(?m)^([^:\r\n]+):", "source-$1:")
    title = F.regexp_replace(F.regexp_extract(source["payload"], TITLE, 1), r"[\r\n]+", " ")
    links = F.transform(F.regexp_extract_all(source["payload"], F.lit(LINK), F.lit(1)), lambda x: F.concat(F.lit("outlink: "), F.regexp_replace(x, r"[\r\n]+", " "), F.lit(CRLF)))
    lines = [F.lit("source-record-id: "), source["record_id"], F.lit(f"{CRLF}source-payload-digest: "), source["payload_digest"], F.lit(f"{CRLF}source-status: "),
             F.regexp_extract(headers, r"^[^\r\n]*", 0), F.lit(CRLF), fields, F.when(fields != "", F.lit(CRLF)).otherwise(""), F.lit("title: "), title, F.lit(CRLF), F.array_join(links, "")]
    return F.concat(*lines)


def derive(records: DataFrame, keep: list[str], date: str = DERIVED) -> DataFrame:
    """Two rows per response: ``keep``, warc_type, record_id, refers_to, refers_to_target_uri, refers_to_date, target_uri, date,
    content_type, source_payload_digest, block_digest, content_length, header, block.

    A missing payload counts as empty and gives an empty conversion; missing headers give no source lines; a missing
    URI or date leaves its header lines out. Repeated responses give repeated records with equal ids.
    """
    src = {c: F.col(c) for c in ("record_id", "headers", "payload", "payload_digest")}
    src["payload"] = F.coalesce("payload", F.lit(""))
    src["payload_digest"] = F.coalesce("payload_digest", digest(src["payload"]))
    made = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(mime).alias("mime"), block.alias("block"))
                     for kind, mime, block in (("metadata", "application/warc-fields", metadata(src)), ("conversion", "text/plain; charset=utf-8", plain_text(src["payload"])))])
    rows = records.select(*[F.col(f"`{c}`") for c in keep], F.col("record_id").alias("source"), "target_uri", F.col("date").alias("source_date"),
                          src["payload_digest"].alias("source_digest"), F.explode(made).alias("r"))
    block = F.col("r.block")
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))
    full = rows.select("*", record_id(F.col("r.kind"), F.col("source")).alias("own"), digest(block).alias("block_digest"), F.octet_length(block).cast("long").alias("n"))
    header = F.concat(F.lit(f"WARC/1.1{CRLF}"), line("WARC-Type", F.col("r.kind")), line("WARC-Record-ID", F.col("own")), line("WARC-Date", F.lit(date)),
                      line("WARC-Target-URI", F.col("target_uri")), line("WARC-Refers-To", F.col("source")), line("WARC-Refers-To-Target-URI", F.col("target_uri")),
                      line("WARC-Refers-To-Date", F.col("source_date")), line("WARC-Source-Payload-Digest", F.col("source_digest")), line("WARC-Block-Digest", F.col("block_digest")),
                      line("Content-Type", F.col("r.mime")), line("Content-Length", F.col("n").cast("string")))
    return full.select(*[F.col(f"`{c}`") for c in keep], F.col("r.kind").alias("warc_type"), F.col("own").alias("record_id"), F.col("source").alias("refers_to"),
                       F.col("target_uri").alias("refers_to_target_uri"), F.col("source_date").alias("refers_to_date"), "target_uri", F.lit(date).alias("date"),
                       F.col("r.mime").alias("content_type"), F.col("source_digest").alias("source_payload_digest"), "block_digest", F.col("n").alias("content_length"),
                       header.alias("header"), block.alias("block"))


def write_warc(derived: DataFrame, path: str) -> None:
    """WARC files: header, empty line, block, and two line ends after each record."""
    derived.select(F.concat("header", F.lit(CRLF), "block").alias("value")).write.option("lineSep", CRLF + CRLF).text(path)


def op1_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    records = responses(table(spark, sf_dir, "pages")).select("*", F.col("page.page_id").alias("page_id"))
    return derive(records, ["page_id"])


def sql() -> str:
    def text(v: str) -> str:
        return "concat('" + v.replace("'", "''").replace("\r", "', chr(13), '").replace("\n", "', chr(10), '") + "')"
    plain = "payload"
    for pattern, to in TAG_STEPS:
        plain = f"regexp_replace({plain}, {text(pattern)}, {text(to)}, 'g')"
    for entity, to in ENTITIES:
        plain = f"replace({plain}, {text(entity)}, {text(to)})"
    for pattern, to in SPACE_STEPS:
        plain = f"regexp_replace({plain}, {text(pattern)}, {text(to)}, 'g')"
    plain = f"trim({plain}, ' ' || chr(10))"
    uuid = lambda h: " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    end = "chr(13) || chr(10)"
    line = lambda name, value: f"coalesce('{name}: ' || {value} || {end}, '')"
    return f"""
WITH source AS (SELECT page_id, url AS target_uri, coalesce(html, '') AS payload, 'sha256:' || sha256(coalesce(html, '')) AS source_payload_digest,
       sha256('response|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || coalesce(url, '')) AS h FROM pages),
s AS (SELECT *, '<urn:uuid:' || {uuid('h')} || '>' AS refers_to FROM source),
made AS (
  SELECT page_id, 'metadata' AS warc_type, 'application/warc-fields' AS content_type, target_uri, refers_to, source_payload_digest,
    'source-record-id: ' || refers_to || {end} || 'source-payload-digest: ' || source_payload_digest || {end} || 'source-status: HTTP/1.1 200 OK' || {end} ||
    'source-Content-Type: text/html; charset=utf-8' || {end} || 'source-Content-Length: ' || strlen(payload) || {end} ||
    'title: ' || regexp_replace(regexp_extract(payload, {text(TITLE)}, 1), '[' || chr(13) || chr(10) || ']+', ' ', 'g') || {end} ||
    array_to_string(list_transform(regexp_extract_all(payload, {text(LINK)}, 1), lambda x: 'outlink: ' || regexp_replace(x, '[' || chr(13) || chr(10) || ']+', ' ', 'g') || {end}), '') AS block FROM s
  UNION ALL
  SELECT page_id, 'conversion', 'text/plain; charset=utf-8', target_uri, refers_to, source_payload_digest, {plain} FROM s),
own AS (SELECT *, sha256(warc_type || '|' || refers_to) AS k, 'sha256:' || sha256(block) AS block_digest, strlen(block) AS content_length FROM made),
named AS (SELECT *, '<urn:uuid:' || {uuid('k')} || '>' AS record_id FROM own)
SELECT page_id, warc_type, record_id, refers_to, target_uri AS refers_to_target_uri, '{CAPTURED}' AS refers_to_date, target_uri, '{DERIVED}' AS date,
  content_type, source_payload_digest, block_digest, content_length,
  'WARC/1.1' || {end} || {line('WARC-Type', 'warc_type')} || {line('WARC-Record-ID', 'record_id')} || {line('WARC-Date', f"'{DERIVED}'")} || {line('WARC-Target-URI', 'target_uri')} ||
  {line('WARC-Refers-To', 'refers_to')} || {line('WARC-Refers-To-Target-URI', 'target_uri')} || {line('WARC-Refers-To-Date', f"'{CAPTURED}'")} ||
  {line('WARC-Source-Payload-Digest', 'source_payload_digest')} || {line('WARC-Block-Digest', 'block_digest')} || {line('Content-Type', 'content_type')} ||
  {line('Content-Length', 'CAST(content_length AS VARCHAR)')} AS header, block
FROM named"""
