"""Admission, frontier and reachable set."""

import random
import re

import pytest
from pyspark.sql import functions as F

from sitesieve.config import SieveConfig
from sitesieve.operators import frontier, links, pages, reach
from sitesieve.sources.pages import as_pages
from sitesieve.sources.seeds import read_seeds

CONFIG = SieveConfig(
    langs_of_interest=("en",), user_agent="Bot/1", accepted_tlds=("com", "uk"), prefix_filter=("mailto:",),
    url_blacklist=("spam",), max_folder_tree_depth=3,
)
LINKS = {
    "http://a.com/x": "same_site", "http://www.a.com/x": "same_site", "http://b.com/": "other_site",
    "http://b.org/": "tld", "http://b.co.uk/": "tld", "http://b.uk/": "other_site", "http://spam.com/": "blacklist",
    "http://a.com/spam": "blacklist", "mailto:x@a.com": "prefix", "javascript:x": "scheme", "http://[x": "empty",
    "http://a.com/1/2/3": "same_site", "http://a.com/1/2/3/": "same_site", "http://a.com/1/2/3/4": "depth",
    "http://a.com/" + "x" * 2000: "too_long", "http://a.com/?mailto:": "prefix",
}


def linked(spark, found, parent="http://a.com/p", seq=1):
    rows = [(seq, parent, "a.com", u, u) for u in found]
    return links.with_link_parts(
        spark.createDataFrame(rows, "fetch_seq bigint, parent_url string, parent_site string, href string, link string")
    )


def test_admission(spark):
    out = links.admit_links(linked(spark, LINKS), CONFIG)
    assert {r.link: r.reason for r in out.collect()} == LINKS


def test_admission_is_idempotent(spark):
    once = links.admitted(links.admit_links(linked(spark, LINKS), CONFIG)).drop("reason")
    twice = links.admitted(links.admit_links(once, CONFIG)).drop("reason")
    assert sorted(r.link for r in once.collect()) == sorted(r.link for r in twice.collect())


def test_same_site_needs_no_accepted_suffix(spark):
    rows = spark.createDataFrame([("x.org", "org", "x.org"), ("y.org", "org", "x.org")], "site string, suffix string, parent_site string")
    out = {r.site: r.link_class for r in links.classify_links(rows, ["com"]).collect()}
    assert out == {"x.org": "same_site", "y.org": "rejected"}


def test_page_links_and_redirects(spark):
    rows = spark.createDataFrame(
        [
            (1, "https://a.com/d/e", '<a href="f"><a href="f"><a href="../g#t"><a href="//o.com/p"><a href="http://a.com/#">', 200, None),
            (2, "http://a.com/x", "", 301, "/y"), (3, "http://a.com/x", "", 301, None), (4, "http://a.com/x", "", 404, "/z"),
        ],
        "fetch_seq bigint, url string, html string, status int, location string",
    )
    sited = pages.with_site(as_pages(rows))
    found = [(r.fetch_seq, r.href, r.link) for r in pages.page_links(sited).collect()]
    assert sorted(found) == [
        (1, "../g#t", "https://a.com/g"), (1, "//o.com/p", "https://o.com/p"), (1, "f", "https://a.com/d/f"),
        (1, "http://a.com/#", "http://a.com/"),
    ]
    moved = links.redirect_links(sited)
    assert moved.columns == pages.page_links(sited).columns
    assert [(r.fetch_seq, r.link) for r in moved.collect()] == [(2, "http://a.com/y")]


def test_dedup_new_and_extend(spark):
    u1, u2, u3 = (f"http://u{i}.com" for i in (1, 2, 3))
    rows = [(5, "p5", u1), (2, "p2", u1), (3, "p3", u2), (4, "p4", u3)]
    found = spark.createDataFrame(rows, "fetch_seq bigint, parent_url string, norm_url string")
    visited = spark.createDataFrame([(u3,)], "norm_url string")
    new = frontier.new_links(frontier.dedup_links(found), visited)
    parents = found.select("fetch_seq", F.col("parent_url").alias("norm_url"))
    named = frontier.with_parent(new, parents)
    assert sorted((r.norm_url, r.first_seq, r.parent_url, r.n_found) for r in named.collect()) == [
        ("http://u1.com", 2, "p2", 2), ("http://u2.com", 3, "p3", 1),
    ]
    assert {r.site for r in new.collect()} == {"u1.com", "u2.com"}
    pending = spark.createDataFrame([(u2, "u2.com", 1)], "norm_url string, site string, added bigint")
    both = frontier.extend_frontier(pending, new.withColumn("added", F.col("first_seq")))
    assert sorted((r.norm_url, r.added) for r in both.collect()) == [(u1, 2), (u2, 1)]
    resumed = frontier.seeds_for_resume(new.withColumn("added", F.lit(9).cast("bigint")), pending, visited)
    assert sorted((r.norm_url, r.added) for r in resumed.collect()) == [(u1, 9), (u2, 1)]


def test_expand_sites(spark):
    sites = spark.createDataFrame([("run.com", 0, False), ("old.com", 1, True)], "site string, priority bigint, stopped boolean")
    seeds = spark.createDataFrame(
        [("run.com", "u1", 9), ("old.com", "u2", 8), ("n2.com", "u3", 7), ("n1.com", "u4", 3), ("n1.com", "u5", 99)],
        "site string, norm_url string, first_seq bigint",
    )
    out = {r.site: (r.action, r.priority, r.n_seeds) for r in frontier.expand_sites(seeds, sites, span=2).collect()}
    assert out == {
        "run.com": ("extend", 0, 1), "old.com": ("ignore", 1, 1), "n1.com": ("new", 2, 2), "n2.com": ("new", 3, 1),
    }
    first = frontier.expand_sites(seeds, sites.filter(F.lit(False)))
    assert {r.site: r.priority for r in first.collect()} == {"n1.com": 0, "n2.com": 1, "old.com": 2, "run.com": 3}
    assert sorted(r.norm_url for r in frontier.frontier_of_running(seeds, sites).collect()) == ["u1", "u3", "u4", "u5"]


def test_next_urls_skips_sleeping(spark):
    rows = [("s", "u1", 1, None), ("s", "u2", 2, "2024-01-01 00:00:10"), ("s", "u3", 3, "2024-01-01 00:00:05"), ("t", "v", 1, None)]
    pending = spark.createDataFrame(rows, "site string, norm_url string, added bigint, w string").select(
        "site", "norm_url", "added", F.col("w").cast("timestamp_ntz").alias("wait_until")
    )
    now = F.lit("2024-01-01 00:00:05").cast("timestamp_ntz")
    out = frontier.next_urls(pending, now, 2)
    assert sorted((r.site, r.place, r.norm_url) for r in out.collect()) == [("s", 1, "u3"), ("s", 2, "u1"), ("t", 1, "v")]
    sites = spark.createDataFrame([("s", 1), ("t", 0), ("q", 2)], "site string, priority int")
    assert [r.site for r in frontier.served_sites(sites, 2).collect()] == ["t", "s"]


def test_seeds(spark, tmp_path):
    (tmp_path / "seeds.txt").write_text(" http://b.com/1 \n\nhttp://a.com\nhttp://b.com/2\n")
    for seeds in (
        read_seeds(spark, path=str(tmp_path / "seeds.txt")),
        read_seeds(spark, urls=["http://b.com/1", " ", "http://a.com ", "http://b.com/2"]),
    ):
        assert [r.url for r in seeds.orderBy("seed_seq").collect()] == ["http://b.com/1", "http://a.com", "http://b.com/2"]
        first = frontier.seed_frontier(seeds)
        assert sorted((r.norm_url, r.site) for r in first.collect()) == [
            ("http://a.com", "a.com"), ("http://b.com/1", "b.com"), ("http://b.com/2", "b.com"),
        ]
        sited = pages.with_site(seeds.withColumn("fetch_seq", F.col("seed_seq")))
        out = frontier.seed_sites(sited, span=1).orderBy("priority").collect()
        assert [(r.site, r.n_seeds, r.priority) for r in out] == [("b.com", 2, 0), ("a.com", 1, 1)]
    with pytest.raises(ValueError):
        read_seeds(spark)


def test_reachable(spark):
    edges = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "d"), ("x", "y"), ("a", "c")]
    graph = spark.createDataFrame(edges, "src string, dst string")
    seeds = spark.createDataFrame([("a",), ("a",)], "norm_url string")
    hops = {r.norm_url: r.hops for r in reach.reachable(graph, seeds).collect()}
    assert hops == {"a": 0, "b": 1, "c": 1, "d": 2}
    one = reach.reachable(graph, seeds, max_rounds=1)
    assert sorted(r.norm_url for r in one.collect()) == ["a", "b", "c"]
    assert reach.reachable(graph, seeds.filter("false")).count() == 0


def test_blacklist_from_a_table(spark):
    patterns = spark.createDataFrame([("b",), ("a[0-9]",), ("b",), (None,)], "pattern string")
    rows = spark.createDataFrame([("http://a1/",), ("http://ax/",), ("http://xb/",)], "norm_url string")
    assert [r.norm_url for r in links.drop_blacklisted(rows, patterns).collect()] == ["http://ax/"]
    assert links.drop_blacklisted(rows, []).count() == 3
    assert links.drop_blacklisted(rows, patterns.filter("false")).count() == 3
    # a table of more patterns than are tested at once
    many = spark.range(links.PATTERNS_AT_ONCE + 300).selectExpr("concat('n', id, '/') AS pattern")
    rows = spark.createDataFrame([("http://n7/",), ("http://n2299/",), ("http://n2300/",)], "norm_url string")
    assert [r.norm_url for r in links.drop_blacklisted(rows, many).collect()] == ["http://n2300/"]


def test_seeds_get_only_two_checks(spark):
    found = ["mailto:x@spam.zz", "http://[bad", "http://a.com/" + "x" * 2000, "http://a.com/#1", "http://a.com/#2", "a.com"]
    first = frontier.seed_frontier(read_seeds(spark, urls=found))
    assert sorted((r.norm_url, r.added) for r in first.collect()) == [
        ("http://a.com", 5), ("http://a.com/", 3), ("http://mailto:x@spam.zz", 0),
    ]


PIECES = ("shop", "://www", "/de/", "buy-now", r"\.", ".", ".*", "[a-z]+", "[^/]*", r"\d", "x?", "ab+", "s{2}", "$", "^http", r"\\", "(?i)SHOP", "a|b", "(spam|farm)", "é", "]")


def test_blacklist_table_equals_a_plain_loop(spark):
    random.seed(11)
    patterns = ["".join(random.choices(PIECES[:16] + PIECES[19:], k=random.choice((1, 2, 3, 4)))) for _ in range(300)] + list(PIECES)
    patterns = [p for p in patterns if not re.search(r"[*+?}][*+?{]|^[*+?{]", p)]
    urls = ["http://" + "".join(random.choices(("www.", "shop", "/de/", "spam", "buy-now", "1", "ab", "ss", ".com", "é", "/", "x", "\\", "]"), k=6)) for _ in range(150)]
    urls += ["http://", "", "http://www.shop.com/de/"]
    for chosen in (patterns[:60], patterns[60:200], [p for p in patterns if len(p) > 9], ["(?i)BUY", "/de/$"]):
        rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "gram long, norm_url string, pattern string")
        table = spark.createDataFrame([(p,) for p in [*chosen, chosen[0], None]], "pattern string")
        got = {r.gram for r in links.drop_blacklisted(rows, table).collect()}
        assert got == {i for i, u in enumerate(urls) if not any(re.search(p, u) for p in chosen)}


def test_literals_of_patterns(spark):
    cases = {
        "cheap-pills": ["cheap-pills"], r"://shop\.[^/]*/de/x": ["://shop.", "/de/x"], "abcde?": ["abcd"], "abcdef+gh": ["abcde"], "a.b.c": [], "(abcd)": [],
        "abcd|efgh": [], r"\Qabcd": [], r"abcd\d{3}efgh": ["abcd", "efgh"], "[abcd]efgh": ["efgh"], "[^]x]long": ["long"], r"abcd\\.efgh": ["abcd\\", "efgh"],
        "[a[bc]]defgh": [], "abcd{2}": [], "abc": [],
    }
    rows = spark.createDataFrame([(p,) for p in cases], "pattern string")
    got = {r.pattern: r.found for r in rows.select("pattern", links.required_literals("pattern").alias("found")).collect()}
    assert got == cases


def test_blacklist_table_needs_no_driver_and_no_nested_loop(spark):
    rows = spark.createDataFrame([("http://a.com/",)], "norm_url string")
    kept = links.drop_blacklisted(rows, rows.select(F.lit("spam-farm").alias("pattern")))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan and kept.count() == 1


def test_seeds_of_several_files_arrive_in_the_order_of_their_names(spark, tmp_path):
    expected = []
    for part, n in enumerate((3, 400, 1, 50)):
        lines = [f" http://p{part}.com/{i} " if i % 7 else "" for i in range(n)]
        (tmp_path / f"part-{part:05}.txt").write_text("\n".join(lines) + "\n")
        expected += lines
    got = {r.seed_seq: r.url for r in read_seeds(spark, str(tmp_path)).collect()}
    assert got == {i: line.strip() for i, line in enumerate(expected) if line}
