from veldra.llm import url_filter as U

URLS = [None, "", "no scheme", "http://", "http://example.org", "HTTP://WWW.Example.ORG/es/x?y#z", "https://a.example.org/en/12", "https://example.org/en/2", "http://notexample.org/es/",
        "http://x.com/fr/", "http://com/de/1", "http://xcom/de/", "http://shop.net/ads/1", "http://shop.net/x?sessionid=3", "http://a.net/robots.txt?login", "http://a.net/login", "http://u@example.org:80/es/",
        "x://y://z.org/", "http://é.org/", "http://a.org/es/"]


def brute(url):
    host, path = U.split_url(url)
    fits = [r for r in U.HOST_RULES if path.startswith(r.path) and (host == r.host or host.endswith("." + r.host))]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.action
    import re
    hit = [r.action for r in U.PATTERN_RULES if (host or path) and re.search(r.regex, url, re.I | re.A | re.S)]
    return host, path, None, "allow" if not hit or "allow" in hit else "block"


def test_against_every_rule(spark):
    rows = U.filter_urls(spark.createDataFrame([(i, u, "h") for i, u in enumerate(URLS)] + [(None, URLS[5], "h")], "page_id long, url string, host string")).collect()
    assert len(rows) == len(URLS) + 1
    for r in rows:
        if r["page_id"] is not None:
            assert tuple(r)[1:] == brute(URLS[r["page_id"]]), URLS[r["page_id"]]
    by = {URLS[r["page_id"]]: r for r in rows if r["page_id"] is not None}
    assert by["HTTP://WWW.Example.ORG/es/x?y#z"]["rule"] == "example.org/es/" and by["https://a.example.org/en/12"]["verdict"] == "block"
    assert by["http://shop.net/ads/1"]["verdict"] == "block" and by["http://a.net/robots.txt?login"]["verdict"] == "allow"
    assert U.filter_urls(spark.createDataFrame([], "page_id long, url string")).count() == 0
