"""Robots rules against the parser of the standard library."""

import random
from urllib.robotparser import RobotFileParser

import pytest

from sitesieve.operators import robots

AGENT = "SieveBot/2.0 (+http://example.com)"
FILES = [
    "User-agent: *\nDisallow: /\n",
    "User-agent: *\nDisallow:\n",
    "User-agent: sievebot\nDisallow: /a\nAllow: /a/b\n\nUser-agent: *\nDisallow: /\n",
    "User-agent: sievebot\nAllow: /a/b\nDisallow: /a\nCrawl-delay: 7\n",
    "User-agent: *\nDisallow: /x\n\nUser-agent: Sieve\nDisallow: /y\nCrawl-delay: 2\nCrawl-delay: 5\n",
    "User-agent: sievebotter\nDisallow: /\n",
    "User-agent: other\nUser-agent: sievebot\nDisallow: /a\n",
    "User-agent: other\n\nUser-agent: sievebot\n\nDisallow: /a\n",
    "Disallow: /a\nUser-agent: *\nDisallow: /b # comment\n# only comment\nAllow: /c\n \nDisallow: /d\n",
    "User-agent: *\nDisallow: *\n",
    "User-agent: *\nDisallow: /%7Ea\nDisallow: /caf%C3%A9\nDisallow: /b c\nDisallow: /p+q\n",
    "User-agent: *\nCrawl-delay: 3\n",
    "USER-AGENT: *\nDISALLOW : /a\nSitemap: http://x/y\nDisallow: /b\nnonsense\n",
    "User-agent: *\nDisallow: /a\nUser-agent: sievebot\nDisallow: /b\n",
    "", "\n\n", "# nothing\n", "User-agent: *\nDisallow: /a\n\nUser-agent: *\nDisallow: /b\n",
    "User-agent: *\r\nDisallow: /a\r\n\r\nUser-agent: sievebot\r\nCrawl-delay: abc\r\nRequest-rate: 1/5\r\n",
    "User-agent: *\nDisallow: /a?x=1\nAllow: /a\n",
]
PATHS = ["", "/", "/a", "/a/b", "/a/b/c", "/ab", "/b", "/c", "/d", "/x", "/y", "/~a", "/%7Ea", "/café", "/b c", "/p+q", "/p q", "/a?x=1", "/a?x=12"]


def parsed(text):
    parser = RobotFileParser()
    parser.parse(text.splitlines())
    return parser


def random_file(seed):
    random.seed(seed)
    lines = []
    for _ in range(random.randint(1, 14)):
        lines.append(random.choice([
            "User-agent: *", "User-agent: sievebot", "User-agent: other", "", "Disallow: /a", "Disallow:", "Allow: /a/b",
            "Disallow: /", "Crawl-delay: 4", "Crawl-delay: x", "# c", "Disallow: /b # c", "Allow: /", "Sitemap: /s", "  ",
        ]))
    return "\n".join(lines)


@pytest.fixture(scope="module")
def texts():
    return FILES + [random_file(i) for i in range(120)]


def test_allowed_and_delay(spark, texts):
    files = spark.createDataFrame([(f"h{i}.com", 200, t) for i, t in enumerate(texts)], "host string, status int, body string")
    lookup = robots.robots_lookup(files, AGENT).cache()
    urls = spark.createDataFrame(
        [(f"h{i}.com", f"http://h{i}.com{p}") for i in range(len(texts)) for p in PATHS], "host string, norm_url string"
    )
    found = {r.norm_url: r.allowed for r in robots.robots_allowed(urls, lookup).collect()}
    wrong = [
        (texts[i], p, found[f"http://h{i}.com{p}"]) for i in range(len(texts)) for p in PATHS
        if found[f"http://h{i}.com{p}"] != parsed(texts[i]).can_fetch(AGENT, f"http://h{i}.com{p}")
    ]
    assert not wrong
    delays = {r.host: r.delay for r in lookup.collect()}
    assert [delays[f"h{i}.com"] for i in range(len(texts))] == [parsed(t).crawl_delay(AGENT) for t in texts]


def test_policy_latest_file_and_missing_host(spark):
    rows = [
        ("a", 1, 200, "x"), ("a", 2, 404, ""), ("b", 1, 404, ""), ("b", 2, 500, ""), ("c", 1, 408, ""), ("d", 1, 504, ""),
        ("e", 1, 410, ""), ("f", 1, 403, ""), ("g", 1, 200, None), ("h", 1, None, None), ("i", 1, 400, ""), ("j", 1, 406, ""),
    ]
    files = spark.createDataFrame(rows, "host string, read_seq int, status int, body string")
    assert {r.host: r.policy for r in robots.robots_policy(files).collect()} == {
        "a": "allow", "b": "deny", "c": "deny", "d": "deny", "e": "allow", "f": "deny", "g": "deny", "h": "deny",
        "i": "allow", "j": "allow",
    }
    urls = spark.createDataFrame([("a", "http://a/x"), ("zz", "http://zz/x")], "host string, norm_url string")
    out = robots.robots_allowed(urls, robots.robots_lookup(files, AGENT))
    assert {r.host: r.allowed for r in out.collect()} == {"a": True, "zz": False}


def test_undecodable_file_denies(spark):
    files = spark.createDataFrame([("a", 200, b"\xff\xfe"), ("b", 200, b"User-agent: *\nDisallow: /q")], "host string, status int, body binary")
    assert {r.host: r.policy for r in robots.robots_policy(files).collect()} == {"a": "deny", "b": "rules"}
    urls = spark.createDataFrame([("b", "http://b/q"), ("b", "http://b/r")], "host string, norm_url string")
    out = robots.robots_allowed(urls, robots.robots_lookup(files, AGENT))
    assert {r.norm_url: r.allowed for r in out.collect()} == {"http://b/q": False, "http://b/r": True}


def test_site_delay(spark):
    hosts = spark.createDataFrame([("x.a", "a"), ("y.a", "a"), ("z.b", "b")], "host string, site string")
    delays = spark.createDataFrame([("x.a", 2), ("y.a", 9)], "host string, delay int")
    assert {r.site: r.delay for r in robots.site_delay(hosts, delays, 3).collect()} == {"a": 9, "b": 3}
