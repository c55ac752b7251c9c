import re

from stackroom.llm import url_filter as U

URLS = [
    "http://a.net/x", "http://net/", "http://a.net", "https://m.example.net/en/25#top", "https://EXAMPLE.net/en/", "http://example.net/EN/", "http://notexample.net/en/x",
    "http://example.com/de/9", "http://example.com/de", "http://x.org/fr/1", "http://x.org/frx", "http://xorg/fr/", None, "no scheme/net/", "", "://net/", "ftp://b.NET?q#f",
    "http://a.com/?u=http://b.net/", "http://evil.net/en/\n", "http://a.net/x", "http://example.net:80/en/",
]


def judge(url, rules, default):
    rest = url.partition("://")[2] if url and "://" in url else ""
    m = re.match(r"(?s)([^/?#]*)([^?#]*)", rest)
    host, path = m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]
    fits = [(len(h + p), h + p, a) for a, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, default))
    return host, path, best[1], best[2]


def check(spark, rules, default="allow"):
    df = spark.createDataFrame([(i, u, i, "z") for i, u in enumerate(URLS)], "page_id long, url string, html int, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge_urls(df, "page_id", rules, default).collect()}
    assert got == {i: judge(u, rules, default) for i, u in enumerate(URLS)}


def test_rules(spark):
    check(spark, U.RULES)


def test_partial_segments_and_dots(spark):
    check(spark, [("block", "example.net", "/e"), ("allow", "m.example.net", "/en/25"), ("block", "b.net", ""), ("allow", "ample.net", "/en")], "block")


def test_no_rules_and_no_urls(spark):
    check(spark, [], "block")
    assert U.judge_urls(spark.createDataFrame([], "page_id long, url string"), "page_id").isEmpty()


def test_index_uses_the_rarest_token(spark):
    places = spark.createDataFrame([("a.net", "/")] * 5 + [("example.net", "/en/")], "host string, path string")
    index = {r.rule: r.token for r in U.rule_index(U.rule_table(spark, U.RULES), U.url_tokens(places)).collect()}
    assert index["net/"] == "h:net" and index["example.net/en/"] in ("h:example", "p:en")


def test_patterns_and_thousands_of_rules(spark):
    """Against a judgement of every url by every rule."""
    import re

    rules = [("block" if i % 3 else "allow", f"h{i}.example{i % 7}.com", f"/a{i % 5}/") for i in range(2000)]
    rules += [("block", "*.ads.net", "/"), ("allow", "img*.ads.net", "/ok/*/x/"), ("block", "org", "/*/private/"), ("allow", "org", "/")]
    urls = [f"http://h{i}.example{i % 7 if i % 2 else 3}.com/a{i % 6}/b?q" for i in range(0, 2100, 3)]
    urls += ["http://x.ads.net/", "http://img1.ads.net/ok/1/2/x/y", "http://img.ads.net/ok/x", "http://a.org/u/private/", "http://a.org/private/", "http://b.org#private", "http://ads.net/", None, "http://a.org/" + "x" * 50_000 + "/private/"]

    def judge(url):
        m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", url or "")
        host, path, best = (m[1].lower(), m[2], None) if m else ("", "", None)
        for action, h, p in rules:
            shape = r"(?s)^(?:[^/]*\.)?" + "[^/.]*".join(map(re.escape, h.split("*"))) + ".*".join(map(re.escape, p.split("*")))
            if re.match(shape, host + path):
                best = max(best or (-1,), (len((h + p).replace("*", "")), h + p, action))
        return (best[1], best[2]) if best else (None, "allow")

    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "1 AS best", "2 AS row", "3 AS pattern", "4 AS token")
    got = U.judge_urls(pages, "page_id", rules)
    assert got.columns == ["page_id", "best", "row", "pattern", "token", "host", "path", "rule", "verdict"]
    assert {r.page_id: (r.rule, r.verdict) for r in got.collect()} == {i: judge(u) for i, u in enumerate(urls)}
