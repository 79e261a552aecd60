"""URL expressions against the standard library and hand-written cases."""

import re
from urllib.parse import quote, urljoin, urlparse

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from sitesieve.functions import urls
from sitesieve.operators import hosts

PIECES = st.sampled_from(["a", "b", "/", "/", ".", "..", "?", "#", ";", "/../", "./", "x y", "é", "=1", ":"])
BASES = [
    "http://a.com", "http://a.com/", "http://a.com/b", "http://a.com/b/c/", "http://a.com/b/c/d;p?q=1",
    "https://x.a.co.uk:80/é, x/y?z", "http://a.com/x//y/z",
]


def standard_norm(url):
    text = re.sub(r"#[^#]*$", "", url)
    if not text.startswith(("http://", "https://")):
        text = "http://" + text
    try:
        return urlparse(text)
    except ValueError:
        return urlparse("")


HAND = [
    "", "/x", "x", "../x", "../../x", "../../../x", "./x", ".", "..", "./", "../", "?q", "?", "#f", "#", "?q#f", "x?y#z",
    "/x/./y/../z", "//o.com/p", "https://o.com", "http:foo", "http:/foo", "x/../..", "x/..", ";p", "x;p?q", "/a/b;c;d",
    "/..", "/../x", "/a//b", "/.hidden", "..x", "...", "/é, x.", " x", "x y", "g;x=1/./y", "g?y/./x", "g#s/../x",
]


def test_resolve_hand_cases(spark):
    rows = [(h, b) for h in HAND for b in BASES]
    out = spark.createDataFrame(rows, "h string, b string").select(
        "h", "b", urls.norm_url(urls.resolve("h", "b")).alias("r")
    )
    wrong = [
        (r.h, r.b, r.r) for r in out.collect() if not (r.h == "http:foo" and r.b.startswith("https"))
        and r.r != standard_norm(urljoin(r.b, r.h)).geturl()
    ]
    assert not wrong


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.lists(PIECES, max_size=6).map("".join), st.sampled_from(BASES)), min_size=150, max_size=150))
def test_resolve_generated(spark, rows):
    # outside of what both sides define: empty hosts, schemes, several fragments
    rows = [(h, b) for h, b in rows if "//" not in h and ":" not in h and h.count("#") < 2]
    out = spark.createDataFrame(rows, "h string, b string").select(
        "h", "b", urls.norm_url(urls.resolve("h", "b")).alias("r")
    )
    assert [(r.h, r.b) for r in out.collect() if r.r != standard_norm(urljoin(r.b, r.h)).geturl()] == []


def test_resolve_decisions(spark):
    cases = [
        ("//o.com/p", "https://a.com/x", "https://o.com/p"),
        ("HTTP://X.com/q", "http://a.com/", "http://X.com/q"),
        ("mailto:x@y.com", "http://a.com/", "mailto:x@y.com"),
        ("/new", "https://sub.a.com/old/page?x", "https://sub.a.com/new"),
    ]
    rows = spark.createDataFrame([(h, b) for h, b, _ in cases], "h string, b string")
    found = {(r.h, r.b): r.r for r in rows.select("h", "b", urls.resolve("h", "b").alias("r")).collect()}
    for h, b, expected in cases:
        out = found[h, b]
        assert (out.replace("HTTP", "http") if out.startswith("HTTP") else out) == expected


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.sampled_from(["http://a.com/x", "https://b.org", "http://c.co.uk/a;b?c=d"]), min_size=1))
def test_absolute_url_resolves_to_itself(spark, found):
    rows = spark.createDataFrame([(u,) for u in found], "u string")
    out = rows.select("u", urls.norm_url(urls.resolve("u", F.lit("http://z.net/q"))).alias("r")).collect()
    assert all(r.u == r.r for r in out)


NORM = [
    "http://a.com", "http://a.com/#x", "http://a.com/?", "http://a.com/;", "http://a.com/a;b;c?d#e#f", "HTTP.com",
    "http://[bad", "http://bad]/x", "http://[bad]/x", "http://[::1]:80/x", "http://u:p@h.com:80/x", "a.com/x?y", "",
    "http://a.com/é, x.", "http://a.com/x;p/y;q", "http:///x", "https://A.com?x/y;z", "http://a.com/a#b#", "http://a.com/a##",
]


def test_norm_and_parts(evaluate):
    for url, norm, parts in zip(NORM, evaluate(urls.norm_url("v"), NORM), evaluate(urls.url_parts("v"), NORM)):
        expected = standard_norm(url)
        assert norm == expected.geturl(), url
        if urlparse(norm).netloc:
            assert tuple(parts) == tuple(urlparse(norm)), url


def test_norm_is_idempotent(evaluate):
    once = evaluate(urls.norm_url("v"), [u for u in NORM if u.count("#") < 2])
    assert evaluate(urls.norm_url("v"), once) == [u if u else "http://" for u in once]


def test_upper_case_scheme_and_null(evaluate):
    assert evaluate(urls.norm_url("v"), ["HTTP://X", "HttpS://x/y", None]) == ["http://X", "https://x/y", "http://"]
    assert evaluate(urls.strip_fragment("v"), ["a#b#c", "a#", None]) == ["a#b", "a", ""]


def test_depth_root_host(evaluate):
    cases = ["http://a.com", "http://a.com/", "http://a.com/x/", "http://a.com/x/y?z/w", "http://a.com//x"]
    assert evaluate(urls.url_depth("v"), cases) == [0, 0, 1, 2, 2]
    assert evaluate(urls.root_url("v"), ["https://u@a.com:8/x"]) == ["https://u@a.com:8"]
    assert evaluate(urls.url_host("v"), ["https://u:p@a.com.:8/x", "http://[::1]:80/"]) == ["a.com", "[::1]"]


def test_absolute(evaluate):
    cases = ["http://a", "//a/b", "/a", "a//b", "mailto:x", "http://[bad", "", "#x", "a+b://c"]
    assert evaluate(urls.is_absolute("v"), cases) == [True, True, False, False, False, True, False, False, True]


def test_request_path(evaluate):
    paths = ["/a b", "/é/x", "/a%20b", "/a+b*c~d", "/a,b(c)'!", "/"]
    expected = [quote(p, "?=&%/") for p in paths]
    assert evaluate(urls.request_path("v"), [f"http://a.com{p}" for p in paths]) == expected


def test_link_problem(evaluate):
    root = "http://a.com/"
    cases = {
        "http://[bad": "empty", "http://": "empty",
        root + "x" * (2000 - len(root)): "ok", root + "x" * (2001 - len(root)): "too_long",
        root + "x" * (2000 - len(root)) + "#frag": "ok",
        "mailto:x@y.com": "prefix", "http://a.com/mailto:x": "prefix",
        "javascript:void(0)": "scheme", "tel:5551234": "scheme", "ftp://a.com/": "scheme",
        "a.com:8080/x": "ok", "localhost:8080": "ok", "HTTP://a.com": "ok", "a.com/x": "ok",
    }
    assert evaluate(urls.link_problem("v", ["mailto:"]), list(cases)) == list(cases.values())


HOSTS = {
    "http://www.example.com/x": ("www", "example", "com", "example.com"),
    "http://a.b.example.co.uk": ("a.b", "example", "co.uk", "example.co.uk"),
    "http://example.uk": ("", "example", "uk", "example.uk"),
    "http://co.uk/": ("", "", "co.uk", "co.uk"),
    "http://localhost:80/": ("", "localhost", "", "localhost"),
    "http://127.0.0.1/x": ("", "127.0.0.1", "", "127.0.0.1"),
    "http://[::1]/": ("", "[::1]", "", "[::1]"),
    "http://WWW.Example.COM/": ("www", "example", "com", "example.com"),
}


@pytest.mark.parametrize("by_rules", [False, True])
def test_host_parts(spark, by_rules):
    rows = spark.createDataFrame([(u,) for u in HOSTS], "url string").withColumn("norm_url", urls.norm_url("url"))
    rules = None
    if by_rules:
        rules = spark.createDataFrame(
            [("com", "normal"), ("uk", "normal"), ("co.uk", "normal")], "suffix string, kind string"
        )
    split = hosts.split_host(hosts.with_host_parts(rows, "norm_url", rules))
    found = {r.url: (r.subdomain, r["name"], r.suffix, r.site) for r in split.collect()}
    assert found == HOSTS


def test_wildcard_and_exception_rules(spark):
    rules = spark.createDataFrame(
        [("ck", "normal"), ("ck", "wildcard"), ("www.ck", "exception"), ("com", "normal")], "suffix string, kind string"
    )
    cases = {"a.b.c.ck": ("c.ck", "b.c.ck"), "x.www.ck": ("ck", "www.ck"), "c.ck": ("c.ck", "c.ck"), "q.com": ("com", "q.com")}
    rows = spark.createDataFrame([(f"http://{h}",) for h in cases], "norm_url string")
    found = {r.host: (r.suffix, r.site) for r in hosts.with_host_parts(rows, "norm_url", rules).collect()}
    assert found == cases


@pytest.mark.parametrize("in_row", [True, False])
def test_rules_of_any_length_are_one_lookup(spark, monkeypatch, in_row):
    if not in_row:
        monkeypatch.setattr(hosts, "RULES_IN_ROW", 2)
    listed = [("com", "normal"), ("co.uk", "normal"), ("a.b.c.d.e", "normal"), ("ck", "wildcard"), ("www.ck", "exception"), ("x.y.z", "wildcard"), ("uk", "normal"), ("one", "normal")]
    rules = hosts.prepared(spark.createDataFrame(listed, "suffix string, kind string"))
    assert (rules.paths is not None) == in_row and rules.longest == 5
    expected = {
        "www.shop.co.uk": ("co.uk", "shop.co.uk"), "q.w.a.b.c.d.e": ("a.b.c.d.e", "w.a.b.c.d.e"), "b.c.d.e": ("e", "d.e"), "www.ck": ("ck", "www.ck"),
        "a.www.ck": ("ck", "www.ck"), "p.q.ck": ("q.ck", "p.q.ck"), "ck": ("", "ck"), "m.n.x.y.z": ("n.x.y.z", "m.n.x.y.z"), "x.y.z": ("z", "y.z"),
        "10.0.0.1": ("", "10.0.0.1"), "one": ("one", "one"), "two": ("", "two"), "co.uk": ("co.uk", "co.uk"), "shop.UNKNOWN": ("unknown", "shop.unknown"),
    }
    rows = spark.createDataFrame([(f"http://{h}/p", "kept") for h in expected], "norm_url string, k string")
    split = hosts.with_host_parts(rows, "norm_url", rules)
    assert split.columns == ["norm_url", "k", "host", "suffix", "site"]
    plan = split._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") == (0 if in_row else 2), plan
    assert {r.host: (r.suffix, r.site) for r in split.collect()} == {h.lower(): v for h, v in expected.items()}
