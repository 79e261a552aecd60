"""HTML extraction, WARC round trip and URL reputation."""

import gzip
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sitesieve.llm import html_extract, queries, url_reputation, warc
from sitesieve.session import new_path

SCHEMA = "page_id long, url string, html string, key string, host string, chunk int, domain string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "k", "h", 7, "d", "x") for i, u, h in rows], SCHEMA).repartition(3)


ARTICLE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><article>";</script></head><body>
<header class="site-header"><h2>Site</h2></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><!-- <p>no</p> -->
<div class="cookie-notice">We use cookies.</div><div class="ad">Buy <b>now</b></div>
<article><header><h1>The &amp; title</h1></header><p><b>First</b> para&shy;graph with&nbsp;&#x1F600;\n   space<br>and more.<p>Second &lt;b&gt; x &copy; y.</p>
<div class="share-bar">Share this</div><aside>Side</aside><form>Name <input name=q></form><ul><li>one<li>two</ul>
<section class="comments"><article>Reader says hi</article></section></article><div id="sidebar">More</div><footer>&copy; 2024</footer></body></html>"""


def test_declared_main_text():
    text, removed = html_extract.main_text(html_extract.blocks_of(ARTICLE), np.zeros(1000, bool))
    assert text == "The & title\nFirst para\xadgraph with \U0001f600 space and more.\nSecond <b> x © y.\none\ntwo"
    assert removed == 0


@pytest.mark.parametrize(
    "page",
    [
        '<article><p style="overflow:hidden">Kept text.</p></article>', '<article><p aria-hidden="false">Kept text.</p></article>',
        '<article><div data-id="menu" title="a class=ad hidden">Kept text.</div></article>', '<body class="has-sidebar"><article>Kept text.</article>',
        '<body class="has-sidebar"><p>Kept text.</p>', '<article class="post comments-open"><p>Kept text.</p></article>', "<main id=search>Kept text.</main>",
        '<h1>Site</h1><div id="search-results"><div class="header"><article>Kept text.</article></div></div>',
        '<div class="related-work"><main>Kept text.</main></div><div class="sidebar"><article>Other</article></div><div hidden>No</div>',
        '<div class="post">Kept text.</div><div class="comments"><article>A reader says much more than the page does.</article></div>',
        '<article>Kept text.<div class="ad">No</div><p hidden>No</p><p HIDDEN="">No</p><p id=\'cookie-bar\'>No</p></article>',
    ],
)
def test_attributes_by_whole_name_and_articles_in_marked_elements(page):
    assert html_extract.main_text(html_extract.blocks_of(page), np.zeros(1000, bool))[0] == "Kept text."


@pytest.mark.parametrize("page", [None, "", " \n ", "<", "<p", "<!-- open", "<script>never closed", "</p></div>", "<article>", "<a href='x>y", "&#xFFFFFFFF; &bogus;"])
def test_broken_pages(page):
    html_extract.main_text(html_extract.blocks_of(page), np.zeros(1000, bool))


@pytest.mark.parametrize(
    "page, text",
    [
        ('<article><h2 id="comments">Comments</h2><h3 class="search">Search</h3>Kept.</article>', "Comments\nSearch\nKept."),
        ('<article>Kept.<article class="comment">A reader.</article></article>', "Kept."),
        ("<article>Kept.</article><script>never closed < 1 <a <b", "Kept."),
        ("<article>Kept. <!-- open <b> <i", "Kept."),
        ("<article>1 < 2", "1 < 2"),
        ("<article>" + "<a " * 10**6, ("<a " * 10**6).strip()),
    ],
)
def test_headings_readers_and_open_ends(page, text):
    assert html_extract.main_text(html_extract.blocks_of(page), np.zeros(1, bool))[0] == text


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for n in (0, 1, 1000):
        numbers = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (html_extract.unpack(html_extract.pack(numbers)) == numbers).all()


@pytest.mark.parametrize("chunk", [1, 400, 1 << 22])
def test_repeats_of_a_host_against_plain_windows(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_extract, "CHUNK", chunk)
    monkeypatch.setattr(html_extract, "RANGE", 512)
    rng = random.Random(chunk)
    long = html_extract.LONG
    phrases = [" ".join(rng.choice("abcd") for _ in range(rng.randint(3, 14))) for _ in range(25)]
    rows = []
    for i in range(60):
        body = "".join(f"<div>{rng.choice(phrases)} {rng.choice(phrases)}</div>" for _ in range(rng.randint(0, 4)))
        rows.append((i, rng.choice(["http://a.com/", "http://b.com/", None]), body))
    rows += [(100 + i, u, h) for i, u, h in rows[:10]]
    streams = {i: (u, tuple(html_extract.stream_of(html_extract.blocks_of(h)))) for i, u, h in rows}
    seen = {}
    for u, s in streams.values():
        for p in range(len(s) - long + 1):
            seen.setdefault((u, s[p : p + long]), set()).add(s)
    got = {r.page_id: r for r in html_extract.extract(frame(spark, rows)).collect()}
    assert len(got) == len(rows) and sum(r.n_repeated for r in got.values()) > 0
    for i, u, h in rows:
        s = streams[i][1]
        mask = np.zeros(len(s), bool)
        for p in range(len(s) - long + 1):
            if len(seen[u, s[p : p + long]]) > 1:
                mask[p : p + long] = True
        assert got[i].n_repeated == mask.sum()
        assert (got[i].text, got[i].n_removed) == html_extract.main_text(html_extract.blocks_of(h), mask)


def test_suffix_array_against_all_windows():
    rng = random.Random(1)
    for _ in range(150):
        streams = [[rng.choice("abc") for _ in range(rng.randint(0, 30))] for _ in range(4)]
        for i, (s, got) in enumerate(zip(streams, html_extract.repeated(streams, 5))):
            others = {tuple(o[q : q + 5]) for j, o in enumerate(streams) if j != i for q in range(len(o) - 4)}
            expected = [any(tuple(s[p : p + 5]) in others and p + 5 <= len(s) for p in range(max(0, k - 4), k + 1)) for k in range(len(s))]
            assert got.tolist() == expected
    assert html_extract.repeated([]) == []


def test_streams_of_a_piece_together_against_one_by_one():
    rng = random.Random(7)
    words = ["", "a", "b", "ab", "a\0", "é", "日本語" * 9, "x" * 64, "x" * 65, "y" * 300, "12345678", "123456789"]
    hashes = html_extract.token_hashes(pa.array(words))
    assert len(set(hashes.tolist())) == len(words)
    assert (html_extract.token_hashes(pa.array(["z", *words]).slice(1)) == hashes).all()
    assert html_extract.token_hashes(pa.array([], pa.string())).size == 0
    hosts = [rng.choice(["a", "", None]) for _ in range(60)]
    pages = [[" ".join(rng.choice(words[1:4]) for _ in range(rng.randint(1, 12))) for _ in range(rng.randint(0, 3))] for _ in hosts]
    named = [html_extract.stream_hash(" ".join(p)) for p in pages]
    streams = html_extract.Streams.read(hosts, pa.array(pages, pa.list_(pa.string())), named)
    covered, inside = streams.covered(5), streams.inside(5)
    host, coded = streams.coded()
    parts, least = html_extract.least_parts(coded, 5)
    assert len(streams.first) == len(set(zip(hosts, named))) < len(pages)
    for k, (start, end) in enumerate(zip(streams.starts, streams.ends)):
        assert streams.tokens[start:end].to_pylist() == " ".join(pages[streams.first[k]]).split()
        same = [j for j, h in enumerate(streams.hosts) if h == streams.hosts[k]]
        alone = html_extract.repeated([" ".join(pages[streams.first[j]]).split() for j in same], 5)[same.index(k)]
        assert covered[start:end].tolist() == alone.tolist()
        assert inside[start:end].tolist() == [p + 5 <= end for p in range(start, min(end, inside.size))]
        for p in range(start, end - 4):
            assert least[p] == p + parts[p : p + 2].argmin()
    assert len(set(host.tolist())) == 3


def undeclared(i, host="x.example.com"):
    rng = random.Random(i)
    own = " ".join(f"w{rng.randrange(10**6)}" for _ in range(30))
    return (
        i,
        f"http://{host}/{i}",
        f"<body><div>Welcome to our little site, please read all of the rules first</div><p>{own}</p><div>Made by people who care about pages and their readers</div></body>",
        own,
    )


@pytest.mark.parametrize("chunk", [1 << 23, 700])
def test_repeated_blocks_go_within_and_across_chunks(spark, monkeypatch, chunk):
    monkeypatch.setattr(html_extract, "CHUNK", chunk)
    pages = [undeclared(i) for i in range(30)] + [undeclared(100, "other.example.org")]
    rows = [p[:3] for p in pages] + [(0, *pages[0][1:3]), (200, None, None), (201, None, "<p>no url</p>"), (None, "http://x.example.com/n", ARTICLE)]
    got = html_extract.extract(frame(spark, rows))
    assert got.count() == len(rows)
    by = {r.page_id: r for r in got.collect()}
    for i, _, _, own in pages[:-1]:
        assert by[i].text == own and by[i].n_removed == 2 and by[i].n_chars == len(own)
    assert by[100].text.count("\n") == 2  # alone on its host
    assert by[200].text == "" and by[201].text == "no url"
    assert by[None].text.startswith("The & title\n")
    assert html_extract.extract(frame(spark, [])).collect() == []


def test_chunks_of_mixed_pages_give_what_one_chunk_gives(spark, monkeypatch):
    menu = "<div>Welcome to our little site, please read all of the rules first</div>"
    pages = [undeclared(0)[:3]]
    pages += [(i, f"http://x.example.com/{i}", f"<body>{menu}<article><p>{undeclared(i)[3]}</p></article>") for i in range(1, 30)]
    columns = ("page_id", "text", "n_repeated", "n_removed")
    monkeypatch.setattr(html_extract, "CHUNK", 1 << 23)
    whole = html_extract.extract(frame(spark, pages)).select(*columns).orderBy("page_id").collect()
    monkeypatch.setattr(html_extract, "CHUNK", 300)
    assert html_extract.extract(frame(spark, pages)).select(*columns).orderBy("page_id").collect() == whole
    assert whole[0].n_removed == 1 and menu[5:12] not in whole[0].text
    assert all(r.n_repeated == 12 for r in whole)


def warc_rows():
    big = "<p>é" + "x" * 200_000
    return [
        (5, "http://a/5", "y" * 100), (3, "http://a/3", "y" * 100), (4, None, "y" * 99), (2, "http://a/\r\n2", "y" * 99), (9, "u", None),
        (8, "u", ""), (7, "http://a/7", big), (6, "http://a/6", big), (None, "http://a/n", big), (1, "http://ü/", "a\r\n\r\nWARC/1.1\r\n\r\n" * 9),
        (3, "http://a/3b", "y" * 100),
    ]


def test_warc_round_trip(spark):
    docs = frame(spark, warc_rows())
    index, path = warc.archive(docs)
    got = warc.read(index, path).collect()
    plain = lambda h: (h or "").encode()
    expected, seen = [], set()
    for i, url, html in sorted(warc_rows(), key=lambda r: (r[0] is None, r[0] or 0, r[1] or "")):
        p = plain(html)
        d = hashlib.sha256(p).hexdigest()
        first = min((x for x, _, h in warc_rows() if plain(h) == p and x is not None), default=None)
        again = len(p) >= 100 and d in seen
        seen.add(d)
        expected.append((i, len(p), d, "revisit" if again else "response", first if again else None))
    assert sorted(map(str, expected)) == sorted(str((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in got)
    # a selection reads what it asks for, and every record is a gzip member at its place
    some = warc.read(index.filter("page_id >= 6"), path)
    assert {r.page_id for r in some.collect()} == {6, 7, 8, 9}
    for r in index.collect():
        with open(f"{path.removeprefix('file://')}/{r.file}", "rb") as f:
            f.seek(r.offset)
            said = warc.parse(gzip.decompress(f.read(r.length)))
        assert said["WARC-Payload-Digest"] == f"sha256:{r.digest}" and said["WARC-Type"] == r.record_type
        assert said["Content-Length"] == str(len(said["block"]))
    nothing, empty = warc.archive(frame(spark, []))
    assert warc.read(nothing, empty).collect() == []


def test_damaged_payload_is_found(spark):
    path = new_path(spark, "warc")
    rows = warc.roles(frame(spark, [(1, "u", "some payload")])).withColumn("digest", F.lit("0" * 64))
    index = warc.write(rows, path)
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(index, path).collect()


def test_ranges_are_joined_and_bounded():
    assert warc.ranges([0, 10, 100], [10, 10, 5], gap=50, most=1000) == [(0, 2, 0, 20), (2, 3, 100, 105)]
    assert warc.ranges([0, 10, 30], [10, 10, 5], gap=50, most=25) == [(0, 2, 0, 20), (2, 3, 30, 35)]
    assert warc.ranges([], []) == []


URLS = [
    ("http://Example.ORG/es/x", "example.org", "/es/x", "example.org/es/", "block"), ("https://a.example.org/en/12?q=/es/", "a.example.org", "/en/12", "example.org/en/1", "block"),
    ("http://b.org", "b.org", "", None, None), ("http://b.org/#x", "b.org", "/", "org/", "allow"), ("http://x.com/fr/a", "x.com", "/fr/a", "com/fr/", "allow"),
    ("http://x.com/de/?a", "x.com", "/de/", "com/de/", "block"), ("http://notcom/de/", "notcom", "/de/", None, None), (None, "", "", None, None),
    ("no scheme/at all", "", "", None, None), ("a://b://c/d", "b:", "//c/d", None, None), ("http://ÉX.com?x://y", "Éx.com", "", None, None), ("http:///es/", "", "/es/", None, None),
]


def test_rules_and_parts(spark):
    pages = frame(spark, [(i, u[0], None) for i, u in enumerate(URLS)])
    known = url_reputation.reputation(url_reputation.outcomes_by_terms(pages, queries.BAD_TERMS))
    got = url_reputation.judge(pages, known, queries.URL_RULES).orderBy("page_id").collect()
    assert [(r.url, r.host, r.path, r.rule) for r in got] == [u[:4] for u in URLS]
    assert all(r.verdict == (u[4] or "allow") and r.domain == "d" for r, u in zip(got, URLS))


def test_reputation_shrinks_and_blocks(spark):
    rng = random.Random(0)
    rows = []
    for h in range(60):
        rate = 0.95 if h % 6 == 0 else 0.02
        for i in range(rng.choice([1, 5, 40])):
            rows.append((f"http://h{h}.d{h % 20}.net/{i}", rng.random() < rate))
    rows += [("http://new.d0.net/", False)] * 3 + [(None, True), ("http://x.net/", None)]
    known = url_reputation.reputation(spark.createDataFrame(rows, "url string, bad boolean"))
    hosts = {r.name: r for r in known["host"].collect()}
    for name, r in hosts.items():
        raw = [b for u, b in rows if u and u.startswith(f"http://{name}/") and b is not None]
        parent = known["domain"].filter(F.col("name") == name.split(".", 1)[1]).first()
        low, high = sorted([sum(raw) / len(raw), parent["mean"]])
        assert low - 1e-9 <= r["mean"] <= high + 1e-9 and r.bound <= r["mean"]
    pages = spark.createDataFrame([(1, "http://h6.d6.net/a"), (2, "http://h1.d1.net/a"), (3, "http://unseen.d1.net/"), (4, "http://unseen.org/")], "page_id long, url string")
    got = {r.page_id: r.verdict for r in url_reputation.judge(pages, known).collect()}
    assert got == {1: "block", 2: "allow", 3: "allow", 4: "allow"}
    none = url_reputation.reputation(spark.createDataFrame([], "url string, bad boolean"))
    assert [r.verdict for r in url_reputation.judge(pages, none).collect()] == ["allow"] * 4
