"""URL filter: rules against a loop, reputation against hand-computed posteriors."""

import re

from scriptorium.llm import url_filter as u


def brute(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    best = None
    for verdict, h, p in u.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


URLS = ["http://A.Example.NET/en/x?q#f", "http://example.net", "http://net/", "http://xnet/en/", "https://a.example.com/de/1", "https://example.com/DE/1", "http://x.org/fr/", "http://x.org/fr?", "ftp://h#x", "no url", None, "", "://", "a://b://c/d", "http://h?/net/", "http://É.net/é/", "http://x.net/" + "p" * 50_000]


def test_rules(spark):
    df = spark.createDataFrame([(i, x, "z") for i, x in enumerate(URLS)], "page_id long, url string, host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in u.judge(df, spark.createDataFrame([], "url string, good int")).collect()}
    for i, x in enumerate(URLS):
        host, path, rule, verdict = brute(x)
        assert got[i] == (host, path, rule, verdict or "allow")
    assert u.judge(df.limit(0), df.limit(0).selectExpr("url", "1 AS good")).collect() == []


def test_reputation_shrinks_and_blocks(spark):
    def host(name, n, good):
        return [(f"http://{name}/{i}", int(i < good)) for i in range(n)]

    rows = host("bad.spam.com", 200, 5) + host("new.spam.com", 1, 1) + host("a.good.com", 150, 140) + host("b.good.com", 1, 0) + host("c.other.org", 50, 45)
    outcomes = spark.createDataFrame(rows, "url string, good int")
    known = {(r.level, r.name): r for r in u.reputation(outcomes.select(u.host_of(outcomes.url).alias("host"), "good")).collect()}
    assert known["host", "bad.spam.com"].bound < 0.5 < known["host", "b.good.com"].mean
    assert known["domain", "spam.com"].mean < known["suffix", "com"].mean < known["domain", "good.com"].mean
    pages = spark.createDataFrame([(1, "http://bad.spam.com/x"), (2, "http://unseen.good.com/x"), (3, "http://b.good.com"), (4, "http://bad.spam.com/x"), (5, "http://elsewhere.net")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in u.judge(pages, outcomes).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow"}


def test_labels_reach_pages(spark, sf):
    pages, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("pages", "labels"))
    found = u.labelled_pages(pages, labels)
    assert 0 < found.count() <= pages.count() and {r.good for r in found.collect()} <= {0, 1, None}


def test_suffixes_domains_and_addresses(spark):
    hosts = {"a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.y.com": ("com", "y.com"), "com": ("com", "com"), "1.2.3.4": ("(address)", "1.2.3.4"), "1.2.3.4:80": ("(address)", "1.2.3.4:80"), "a.com.de": ("com.de", "a.com.de"), "eco.uk": ("uk", "eco.uk"), "": ("", "")}
    df = spark.createDataFrame([(h,) for h in hosts], "h string")
    assert {r.h: (r.s, r.d) for r in df.select("h", u.suffix_of(df.h).alias("s"), u.domain_of(df.h).alias("d")).collect()} == hosts


def test_long_urls_repeats_and_clashing_names(spark):
    long = "http://" + "h" * 100_000 + ".com/" + "p" * 100_000
    df = spark.createDataFrame([(1, long, "x", 0.1)] * 2 + [(2, "http://a.example.net/en/", "x", 0.1)], "page_id long, url string, verdict string, good_bound double")
    got = u.judge(df, spark.createDataFrame([], "url string, good int")).collect()
    assert sorted((r.page_id, len(r.host), len(r.path), r.rule, r.verdict) for r in got) == [(1, 100_004, 100_001, None, "allow")] * 2 + [(2, 13, 4, "example.net/en/", "allow")]
