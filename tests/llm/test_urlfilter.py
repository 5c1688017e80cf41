import pytest

from trackmill.llm import urlfilter

URLS = [
    "http://a.example.net/en/1?x=/fr/#t", "https://EXAMPLE.net/en", "http://example.net/en/", "http://notexample.net/en/x", "http://example.com/de/q", "http://example.com/DE/q", "http://m.example.com/de/", "http://x.org/fr/",
    "http://x.org/fr", "http://org/fr/a/b/c", "http://net/", "http://net", "http://net?/x", "http://user@b.net/p", "http://b.net:80/", "no scheme net/", "://b.net/", "a://b://c.net/", "http:///path", "", None, "http://b.net/a#b?c", "http://b.net/\n/x",
]


def brute(url, rules, default="allow"):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        end = min([i for i in map(rest.find, "/?#") if i >= 0] or [len(rest)])
        host, rest = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end]), rest[end:]
        path = rest[: min([i for i in map(rest.find, "?#") if i >= 0] or [len(rest)])]
    fit = [(len(h) + len(p), len(h), v == "block", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fit, default=None)
    return host, path, best and best[3], best[4] if best else default


@pytest.mark.parametrize("rules", [urlfilter.RULES, (), (("net", "/e", "block"), ("net", "/en/x", "allow"), ("a.b.c.net", "", "block"), ("net", "/e", "allow"), ("b.net", "/a", "allow"))])
def test_against_brute_force(spark, rules):
    rows = [(i, u, "clash") for i, u in enumerate(URLS)] + [(3, URLS[3], "again"), (3, URLS[3], "again"), (None, "http://q.net/", "x"), (7, "http://h.net/" + "d/" * 5000, "long"), (8, "http://" + "s." * 2000 + "example.com/de/z", "long")]
    df = spark.createDataFrame(rows, "page_id long, url string, host string")
    got = [tuple(r) for r in urlfilter.filter_urls(df, urlfilter.rules_table(spark, rules)).collect()]
    want = [(i, *brute(u, rules)) for i, u, _ in rows]
    assert sorted(got, key=repr) == sorted(want, key=repr)


def test_empty(spark):
    df = spark.createDataFrame([], "page_id long, url string")
    assert urlfilter.filter_urls(df, urlfilter.rules_table(spark)).count() == 0
