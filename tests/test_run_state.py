"""State of runs: retries, attempts, denied and repeated pages, sleeping URLs, sites."""

import pytest
from pyspark.sql import functions as F

from sitesieve.config import SieveConfig
from sitesieve.operators import budgets, hosts, robots
from sitesieve.plans import crawl
from sitesieve.sources.pages import as_pages

CONFIG = SieveConfig(langs_of_interest=("en",), user_agent="Bot", accepted_tlds=("com",), max_attempts=1, scout_steps=50)
MODEL = {"en": ["the"]}
PAGES = "fetch_seq bigint, url string, status int, html string, retry_after string, fetch_ts timestamp_ntz"


def table(spark, rows):
    """Pages of (number, URL, status, text); a page that asks to wait says for how long."""
    full = [(n, u, s, h, "120" if s == 428 else None) for n, u, s, h in rows]
    df = spark.createDataFrame(full, "fetch_seq bigint, url string, status int, html string, retry_after string")
    return as_pages(df.withColumn("fetch_ts", F.lit("2024-01-01").cast("timestamp_ntz")))


def test_pages_need_a_number_of_their_own(spark):
    with pytest.raises(ValueError, match="number"):
        as_pages(spark.createDataFrame([("http://a.com", "x")], "url string, html string"))
    for rows in ([(1, "http://a.com/", 200, "the"), (1, "http://a.com/b", 200, "the")], [(None, "http://a.com/", 200, "the")]):
        with pytest.raises(ValueError, match="fetch_seq"):
            crawl.run(table(spark, rows), CONFIG, MODEL)


def test_two_runs(spark):
    first = table(spark, [
        (1, "http://a.com/x", 408, ""), (2, "http://a.com/x", 200, "the"),  # answered at the second try
        (3, "http://a.com/y", 408, ""), (4, "http://a.com/y", 404, ""),  # failed for good
        (5, "http://a.com/z", 408, ""),  # to be fetched again
        (6, "http://a.com/w", 428, ""),  # asleep
        (7, "http://a.com/", 200, '<a href="/new">the</a><a href="http://b.com/seed">b</a><a href="http://c.org/no">c</a>'),
        (8, "http://A.com/denied", 200, "the"),
        (9, "http://a.com/x", 200, "the second time"),  # would not have been fetched
        (10, "http://d.com/only", 200, "the"),
    ])
    files = spark.createDataFrame(
        [("a.com", 200, "User-agent: *\nDisallow: /denied\n"), ("D.com", 404, "")], "host string, status int, body string"
    )
    done = crawl.run(first, CONFIG, MODEL, files)
    assert {r.fetch_seq for r in done.documents.collect()} == {2, 7, 10}
    outcomes = {r.fetch_seq: r.outcome for r in done.judged.collect()}
    assert outcomes[8] == "robots" and outcomes[9] == "repeated"
    state = crawl.next_state(done, CONFIG)
    pending = {r.norm_url: r for r in state["pending"].collect()}
    assert set(pending) == {"http://a.com/z", "http://a.com/w", "http://a.com/new", "http://b.com/seed"}
    assert (pending["http://a.com/z"].added, pending["http://a.com/new"].added) == (5, 7)
    assert str(pending["http://a.com/w"].wait_until) == "2024-01-01 00:02:00" and pending["http://a.com/z"].wait_until is None
    assert {r.norm_url: r.n for r in state["attempts"].collect()} == {"http://a.com/z": 1, "http://a.com/w": 1}
    visited = {r.norm_url for r in state["visited"].collect()}
    assert {"http://a.com/x", "http://a.com/y", "http://d.com/only"} <= visited and "http://a.com/z" not in visited
    sites = {r.site: (r.priority, r.stopped, r.cause) for r in state["sites"].collect()}
    assert sites == {"a.com": (0, False, "running"), "b.com": (1, False, "running"), "d.com": (2, True, "exhausted")}

    # z fails again, w is not reached, the seed of b.com leads to d.com, which has stopped
    second = table(spark, [
        (11, "http://a.com/z", 408, ""), (12, "http://b.com/seed", 200, '<a href="http://d.com/late">the</a><a href="http://e.com/">e</a>'),
        (13, "http://a.com/new", 200, "the"),
    ])
    again = crawl.run(second, CONFIG, MODEL, visited=state["visited"])
    after = crawl.next_state(again, CONFIG, state)
    assert {r.norm_url: r.n for r in after["attempts"].collect()} == {"http://a.com/z": 2, "http://a.com/w": 1}
    assert {r.norm_url for r in after["pending"].collect()} == {"http://a.com/z", "http://a.com/w", "http://e.com/"}
    sites = {r.site: (r.priority, r.cause) for r in after["sites"].collect()}
    assert sites == {"a.com": (0, "running"), "b.com": (1, "exhausted"), "d.com": (2, "exhausted"), "e.com": (3, "running")}

    # one failure more than is granted: z is given up and counts as visited
    last = crawl.next_state(crawl.run(table(spark, [(14, "http://a.com/z", 408, "")]), CONFIG, MODEL, visited=after["visited"]), CONFIG, after)
    assert {r.norm_url for r in last["attempts"].collect()} == {"http://a.com/w"}
    assert "http://a.com/z" in {r.norm_url for r in last["visited"].collect()}


def test_earlier_failures_count(spark):
    log = spark.createDataFrame([("u", 1, "retry"), ("v", 1, "fail")], "norm_url string, attempt int, action string")
    earlier = spark.createDataFrame([("u", 4), ("v", 1), ("w", 9)], "norm_url string, n bigint")
    states = {r.norm_url: (r.n_failures, r.state) for r in budgets.attempt_state(log, 3, earlier).collect()}
    assert states == {"u": (5, "given_up"), "v": (2, "failed")}


def test_size_is_that_of_the_raw_body(spark):
    body = bytearray("the é " * 20, "latin-1")
    rows = spark.createDataFrame([(1, "http://a.com/", body)], "fetch_seq bigint, url string, body binary")
    judged = crawl.judge_pages(as_pages(rows), CONFIG, MODEL).first()
    assert (judged.n_bytes, judged.encoding, judged.outcome) == (120, "iso-8859-1", "kept")


def test_hosts_have_no_case(spark):
    urls = spark.createDataFrame([("http://WWW.Example.COM/A",), ("http://x.Co.UK/",)], "norm_url string")
    parts = {r.norm_url: (r.host, r.suffix, r.site) for r in hosts.with_host_parts(urls, "norm_url").collect()}
    assert parts == {
        "http://WWW.Example.COM/A": ("www.example.com", "com", "example.com"), "http://x.Co.UK/": ("x.co.uk", "co.uk", "x.co.uk"),
    }
    files = spark.createDataFrame([("EXAMPLE.com", 200, "User-agent: *\nDisallow: /no\n")], "host string, status int, body string")
    pages = spark.createDataFrame([("http://Example.com/x",), ("http://example.com/no",)], "norm_url string")
    allowed = robots.robots_allowed(hosts.with_host_parts(pages, "norm_url"), robots.robots_lookup(files, "Bot"))
    assert {r.norm_url: r.allowed for r in allowed.collect()} == {"http://Example.com/x": True, "http://example.com/no": False}


def test_published_suffix_list(spark):
    lines = ["// a comment", "", "com", "do", "com.do  // behind the rule", "*.ck", "!www.ck", "  co.uk", "uk", "COM.do"]
    rules = hosts.suffix_rules(spark.createDataFrame([(x,) for x in lines], "value string"))
    names = ["http://foo.com.do/", "http://a.b.ck/", "http://www.ck/", "http://x.y.co.uk/", "http://com/", "http://10.0.0.1/"]
    urls = spark.createDataFrame([(x,) for x in names], "norm_url string")
    parts = {r.norm_url: (r.suffix, r.site) for r in hosts.with_host_parts(urls, "norm_url", hosts.prepared(rules)).collect()}
    assert parts == {
        "http://foo.com.do/": ("com.do", "foo.com.do"), "http://a.b.ck/": ("b.ck", "a.b.ck"), "http://www.ck/": ("ck", "www.ck"),
        "http://x.y.co.uk/": ("co.uk", "y.co.uk"), "http://com/": ("com", "com"), "http://10.0.0.1/": ("", "10.0.0.1"),
    }
