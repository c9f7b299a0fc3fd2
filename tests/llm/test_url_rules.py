import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from basinflow.llm import catalog, url_rules


def parts(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match("[^/?#]*", rest)[0]
    path = re.match("[^?#]*", rest[len(host) :])[0]
    return re.sub("[A-Z]", lambda m: m[0].lower(), host), path


def brute(url, rules, default="allow"):
    host, path = parts(url)
    best = None
    for v, h, p in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, v)
    return host, path, best and best[0], best[1] if best else default


URLS = [
    None, "", "no scheme", "http://", "http://ORG", "http://a.org/", "https://x.EXAMPLE.org/es/1?q#f", "http://example.org/en/123", "http://badexample.org/es/", "http://com/fr/x", "http://a.b.com/de/",
    "ftp://example.org?x/es/", "http://example.org#/es/", "http://example.org/es", "http://a..org/x", "http://.org/", "http://org./", "http://user@example.org/es/", "http://a\u0001b.org/", "http://org\u0000/x", "http://é.org/ü", "a://b://example.org/es/",
]


@pytest.mark.parametrize("ranges", ["1", "4", "13"])
def test_equals_brute_force(spark, ranges):
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        urls = [*URLS, *[f"http://h{i % 7}.example.{t}/{p}/{i}" for i in range(200) for t, p in [("org", "es"), ("com", "de")]], *["http://hot.org/"] * 300]
        pages = spark.createDataFrame([(i, u, "x", "y") for i, u in enumerate(urls)], "page_id long, url string, host string, rule string")
        got = {r.page_id: tuple(r)[1:] for r in url_rules.judge(pages, url_rules.rule_table(spark, catalog.URL_RULES)).collect()}
        assert got == {i: brute(u, catalog.URL_RULES) for i, u in enumerate(urls)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_nested_rules_and_many_ranges(spark):
    rules = [("block" if i % 2 else "allow", h, p) for i, (h, p) in enumerate((h, p) for h in ("com", "a.com", "b.a.com", "org", "z.org") for p in ("/", "/x", "/x/y", "/x/y/z", "/w"))]
    urls = [f"http://{h}/{p}" for h in ("com", "a.com", "q.a.com", "b.a.com", "c.b.a.com", "org", "zz.org", "net") for p in ("", "x", "x/y", "x/y/zz", "w", "v")]
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {r.page_id: tuple(r)[1:] for r in url_rules.judge(pages, url_rules.rule_table(spark, rules), default="none").collect()}
    lengths = {h + p for _, h, p in rules}
    assert len(lengths) == len(rules)
    for i, u in enumerate(urls):
        want = brute(u, rules, "none")
        assert got[i][:2] == want[:2] and len(got[i][2] or "") == len(want[2] or "")


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, "http://a.org/"), (1, "http://a.org/"), (1, "http://a.org/"), (2, None)], "page_id long, url string")
    rules = spark.createDataFrame([(None, "/", "block"), ("org", None, "block"), ("org", "/", None), ("org", "/", "block"), ("org", "/", "allow"), ("", "/", "block")], "host string, path string, verdict string")
    got = sorted(map(tuple, url_rules.judge(pages, rules, default="d").collect()), key=str)
    assert got == sorted([(None, "a.org", "/", "org/", "allow"), (1, "a.org", "/", "org/", "allow"), (1, "a.org", "/", "org/", "allow"), (2, "", "", None, "d")], key=str)
    assert {r.verdict for r in url_rules.judge(pages, rules.limit(0), default="d").collect()} == {"d"}
    assert url_rules.judge(pages.limit(0), rules).collect() == []


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="aB.:/?#\u0000\u0001", max_size=20), st.text(alphabet="a.b", min_size=1, max_size=4), st.text(alphabet="/a?", max_size=3))
def test_key_prefix_is_the_rule(url, host, path):
    h, p = parts("x://" + url)
    fits = (h == host or h.endswith("." + host)) and p.startswith(path)
    assert any(k.startswith(url_rules.canonical(host, path)) for k in url_rules._keys(h, p)) == fits
