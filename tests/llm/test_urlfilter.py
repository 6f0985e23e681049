import pytest

from cohortlens.llm import urlfilter
from cohortlens.llm.urlfilter import Rule

URLS = [None, "", "no scheme", "http://a.org", "http://A.ORG/es/", "https://x.example.org/es/1", "http://example.org/en/1x", "http://notexample.org/es/", "ftp://com/de/",
        "https://www.Shop.com/fr/a?b#c", "http://spam-farm.example.net/x", "http://a.com/x?utm_source=feed", "http://h?q=://", "://org/", "http://ORG:80/", "a://b\nc.org/x",
        "http://cheap-pills.example.com/de/9", "http://example.com/free-download/x"]


def plain(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
    host, after = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]), rest[cut:]
    path = after[:min([i for i in map(after.find, "?#") if i >= 0], default=len(after))]
    fits = [(len(h + p), h + p, v) for h, p, v in (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits, default=(0, None, None))


def test_site_rules_match_a_plain_reading(spark):
    rows = [(i, u, "clash", "c") for i, u in enumerate(URLS)] + [(4, URLS[4], "clash", "c")]
    got = urlfilter.judge(spark.createDataFrame(rows, "page_id long, url string, host string, whole string"), "url", ["page_id"], urlfilter.SITES + urlfilter.PATTERNS).collect()
    assert len(got) == len(rows)
    names = {r.name for r in urlfilter.SITES}
    for r in got:
        host, path, (_, rule, verdict) = plain(URLS[r.page_id])
        assert (r.host, r.path) == (host, path)
        assert (r.rule if r.rule in names else None) == rule
        if rule:
            assert r.verdict == verdict
    verdicts = {r.page_id: (r.rule, r.verdict) for r in got}
    assert verdicts[10] == ("spam", "block") and verdicts[11] == ("feed", "allow") and verdicts[16] == ("com/de/", "block") and verdicts[0] == (None, "allow")


@pytest.mark.parametrize("pattern, tokens", [("||example.org/es/", ["es", "example", "org"]), ("||example.org/en/1", ["en", "example", "org"]), ("abc", []), ("*ads*", []),
                                             ("/ads/*", ["ads"]), ("|http", []), ("-x-y^", ["x", "y"]), ("?a=b|", ["a", "b"]), ("||com/", ["com"])])
def test_literals_are_whole_tokens(pattern, tokens):
    assert urlfilter.tokens_of(pattern) == tokens


def test_index_loses_no_rule(spark):
    """Every rule that fits a URL is found through its token, as if all rules had run."""
    import itertools
    urls = [f"http://{h}.{d}/{p}/{q}" for h, d, p, q in itertools.product(["ads", "x-ads", "track"], ["com", "net"], ["a", "banner", "ads-1"], ["", "x?id=7", "ads"])]
    rules = [Rule(p, p, "block", 1 + i) for i, p in enumerate(["||ads.", "/banner/", "?id=*", "ads", "/ads|", "||track.net^", "-ads.*^a^", "|x-ads."])]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: r.rule for r in urlfilter.judge(df, "url", ["page_id"], rules).collect()}
    each = {r.name: {x.page_id for x in df.filter(f"regexp_like(substring(url, 8), r'{urlfilter.regex_of(r.pattern)}')").collect()} for r in rules}
    for i in range(len(urls)):
        fits = [r for r in rules if i in each[r.name]]
        assert got[i] == (max(fits, key=lambda r: r.rank).name if fits else None)
    tested = urlfilter.judge(df, "url", ["page_id"], rules).agg({"n_tested": "sum"}).head()[0]
    assert tested < 0.6 * len(urls) * len(rules)  # two rules have no token and run everywhere


def test_ties_empty_tables_and_limits(spark, monkeypatch):
    df = spark.createDataFrame([(1, "http://a.b/c/")], "page_id long, url string")
    rules = [Rule("z", "/c/", "block", 5), Rule("y", "/c/", "allow", 5)]
    assert urlfilter.judge(df, "url", ["page_id"], rules).head().rule == "y"
    assert urlfilter.judge(df.limit(0), "url", ["page_id"], rules).count() == 0
    assert urlfilter.judge(df, "url", ["page_id"], []).head().verdict == "allow"
    monkeypatch.setattr(urlfilter, "RULES_LIMIT", 1)
    with pytest.raises(ValueError):
        urlfilter.judge(df, "url", ["page_id"], rules)
