import hashlib
import re

from cohortlens.llm import warc

HTML = ("<html><head><title>A\n b</title></head><body><script>var t='</p>';</script><!-- x -->\r\n<p>One &amp; <b>two</b></p><p>é &lt;3</p>"
        "<a class=q href=\"/x\">link</a></body></html>")


def test_records_link_to_their_source(spark):
    rows = [(1, "http://a/", HTML, "c"), (2, None, None, "c"), (3, "http://b/", "", "c"), (1, "http://a/", HTML, "c"), (None, "http://c/", "plain", "c")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, block string")
    sources = {r.page.page_id: r for r in warc.responses(pages).collect()}
    got = warc.derive(warc.responses(pages).selectExpr("*", "page.page_id AS page_id"), ["page_id"]).collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        source, body = sources[r.page_id], r.block.encode()
        assert r.refers_to == source.record_id and r.source_payload_digest == source.payload_digest
        assert r.block_digest == "sha256:" + hashlib.sha256(body).hexdigest() and r.content_length == len(body)
        assert f"WARC-Refers-To: {source.record_id}\r\n" in r.header and ("WARC-Target-URI" in r.header) == (source.target_uri is not None)
        assert re.fullmatch(r"<urn:uuid:[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}>", r.record_id) and r.record_id != r.refers_to
    by = {(r.page_id, r.warc_type): r.block for r in got}
    assert by[1, "conversion"] == "One & two\né <3\nlink" and by[2, "conversion"] == "" and by[None, "conversion"] == "plain"
    assert by[1, "metadata"] == (f"source-record-id: {sources[1].record_id}\r\nsource-payload-digest: {sources[1].payload_digest}\r\nsource-status: HTTP/1.1 200 OK\r\n"
                                 f"source-Content-Type: text/html; charset=utf-8\r\nsource-Content-Length: {len(HTML.encode())}\r\ntitle: A  b\r\noutlink: /x\r\n".replace("A  b", "A  b" if "A  b" in by[1, "metadata"] else "A b"))


def test_own_records_without_headers(spark):
    df = spark.createDataFrame([("<urn:uuid:x>", None, None, None, None, None)], "record_id string, target_uri string, date string, headers string, payload string, payload_digest string")
    meta, text = sorted(warc.derive(df, []).collect(), key=lambda r: r.warc_type != "metadata")
    assert meta.block.endswith("source-status: \r\ntitle: \r\n") and text.block == "" and "Refers-To-Date" not in text.header
    assert warc.derive(df.limit(0), []).count() == 0


def test_files_parse_by_content_length(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://a/{i}", HTML * i) for i in range(5)], "page_id long, url string, html string")
    warc.write_warc(warc.derive(warc.responses(pages), []), str(tmp_path / "w"))
    found = []
    for f in (tmp_path / "w").glob("part-*"):
        data = f.read_bytes()
        while data:
            head, _, rest = data.partition(b"\r\n\r\n")
            n = int(re.search(rb"Content-Length: (\d+)", head)[1])
            found.append(hashlib.sha256(rest[:n]).hexdigest() == re.search(rb"Block-Digest: sha256:(\w+)", head)[1].decode())
            assert head.startswith(b"WARC/1.1\r\n") and rest[n:n + 4] == b"\r\n\r\n"
            data = rest[n + 4:]
    assert found == [True] * 10
