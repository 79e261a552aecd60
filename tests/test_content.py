"""Response classification, decoding and text."""

import html as standard_html
import html.entities

import pytest
from pyspark.sql import functions as F

from sitesieve.functions import content
from sitesieve.operators import language, pages
from sitesieve.sources.pages import as_pages

ACTIONS = {
    199: "fail", 200: "process", 226: "process", 227: "fail", 300: "fail", 301: "redirect", 308: "redirect", 309: "fail",
    400: "fail", 407: "fail", 408: "retry", 409: "fail", 412: "fail", 413: "wait", 414: "fail", 427: "fail", 428: "wait",
    429: "fail", 430: "fail", 431: "fail", 500: "fail",
}


def test_status_action(evaluate):
    assert evaluate(content.status_action("v"), list(ACTIONS), "int") == list(ACTIONS.values())


def test_type_accepted(evaluate):
    cases = ["text/html", "TEXT/HTML", "application/xhtml+xml", "x; text/html; charset=utf-8", None]
    assert evaluate(content.type_accepted("v", "(text/html)"), cases) == [True, False, False, True, True]


BODIES = [
    (b"plain", None, "utf-8", "plain"),
    ("é".encode(), "text/html; charset=utf-8", "utf-8", "é"),
    ("é".encode("latin-1"), "text/html; charset=utf-8", "iso-8859-1", "é"),
    ("é".encode("latin-1"), None, "iso-8859-1", "é"),
    ("é".encode(), "text/html; charset=ISO-8859-1", "iso-8859-1", "Ã©"),
    ("“é”".encode("cp1252"), 'text/html; charset="windows-1252"', "windows-1252", "“é”"),
    (b'<meta charset="latin1">' + "ñ".encode("latin-1"), None, "iso-8859-1", '<meta charset="latin1">ñ'),
    (b"", None, "utf-8", ""),
    ("Привет".encode("cp1251"), "text/html; charset=windows-1251", "windows-1251", "Привет"),
    ("Привет".encode("koi8-r"), "text/html; charset=KOI8_R", "koi8-r", "Привет"),
    ("žluťoučký".encode("iso8859-2"), "text/html; charset=ISO-8859-2", "iso-8859-2", "žluťoučký"),
    ("žluť".encode("cp1250"), "text/html; charset=x-cp1250", "windows-1250", "žluť"),
    ("καλά".encode("iso8859-7"), "text/html; charset=greek8", "iso-8859-7", "καλά"),
    ("漢字 x".encode("utf-16le"), "text/html; charset=utf-16le", "utf-16le", "漢字 x"),
    ("漢字 x".encode("utf-16"), None, "utf-16le", "漢字 x"),
    ("\ufeffé".encode(), None, "utf-8", "é"),
    ("é".encode(), "text/html; charset=x-unknown", "utf-8", "é"),
]


def test_decode_body(spark):
    rows = spark.createDataFrame(
        [(i, f"http://a.com/{i}", b, t) for i, (b, t, _, _) in enumerate(BODIES)],
        "fetch_seq bigint, url string, body binary, content_type string",
    )
    out = pages.decode_body(as_pages(rows)).orderBy("fetch_seq").collect()
    assert [(r.encoding, r.html) for r in out] == [(e, t) for _, _, e, t in BODIES]


def test_header_map(spark):
    rows = spark.createDataFrame(
        [(1, "http://a.com", "x", {"Content-Type": "text/html", "LOCATION": "/n"})],
        "fetch_seq int, url string, html string, headers map<string,string>",
    )
    row = as_pages(rows).first()
    assert (row.content_type, row.location, row.retry_after, row.status) == ("text/html", "/n", None, 200)


def test_hrefs(evaluate):
    html = "<a href='/a'><a  href = \" /b\"><a HREF='/c'><a href=/d><link href=\"http://x.com/?a=1&amp;b\"><a href=''>"
    assert evaluate(content.hrefs("v"), [html]) == [["/a", "/b", "http://x.com/?a=1&amp;b"]]


def test_html_text(evaluate):
    page = (
        '<?xml version="1.0" encoding="utf-8"?><!DOCTYPE html><html><head><title>No</title><script>"</p>"</script></head>'
        "<body><header>Yes</header><!-- no <b> --><p>one<br>two &amp;lt; &eacute;&Ntilde; &#233;&#x20AC; &copy;&bogus x&y</p>"
        "<STYLE>no</STYLE><script>no</script>a < b <i>end"
    )
    assert evaluate(content.html_text("v"), [page, "", "<!-- open", "x<script>y"]) == [
        "Yes one two &lt; éÑ é€ ©&bogus x&y a < b end", "", "", "x",
    ]


def test_entities_are_those_of_html(evaluate):
    named = [k for k in standard_html.entities.html5 if k.endswith(";") and k != "nbsp;"]
    texts = [" ".join(f"&{name}" for name in named), "&#128512;&#x1F600;&#0000233;&#X0000e9;&#150;&Scaron;&alpha;&hellip;&NotEqualTilde;"]
    assert evaluate(content.unescape("v"), texts) == [standard_html.unescape(t) for t in texts]
    assert evaluate(content.unescape("v"), ["a&nosuch;b&#0;c&#xD800;d&#99999999;e"]) == ["a b c d e"]


def test_words_of_other_scripts(evaluate):
    texts = ["Привет, мир!", "že přes", "한국어 단어", "नमस्ते दुनिया", "漢字 kana", "x1y"]
    assert evaluate(content.words("v"), texts, "string") == [
        ["привет", "мир"], ["že", "přes"], ["한국어", "단어"], ["नमस्ते", "दुनिया"], ["漢", "字", "kana"], ["x", "y"],
    ]


def test_without_prolog(evaluate):
    assert evaluate(content.without_prolog("v"), ['<?xml version="1.0" encoding="x"?><a/>', "xml encoding>"]) == [
        "<a/>", "xml encoding>",
    ]


def test_language_labels(spark):
    labels = {"__label__eng_Latn": "en", "__label__fra": "fr", "es": "es", "__label__xyz": None, "Latn": None, "cat_Latn": "ca", "ara": "ar",
              "__label__fas_Arab": "fa", "ind": "id", "tha": "th", "ger": "de"}
    rows = spark.createDataFrame([(v,) for v in labels], "label string")
    assert {r.label: r.lang for r in language.normalise_lang(rows, "label").collect()} == labels


def test_detection_agrees_with_the_pages(spark):
    """Profiles from one half of the documents label the other half, and the pages, as they are labelled."""
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").filter("length(text) > 400")
    langs = ["de", "en", "es", "fr"]
    first, second = documents.filter("doc_id < 500"), documents.filter("doc_id >= 500")
    model = language.profile_words(language.train_profiles(first, langs), langs)
    for rows, text, truth in (
        (second, "text", F.col("lang")),
        (
            spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), "html",
            F.regexp_extract("html", 'lang="([a-z]+)"', 1),
        ),
    ):
        found = language.with_language(rows.withColumn("truth", truth).filter(F.col("truth").isin(*langs)), text, model, "found")
        total, right, wrong = found.select(
            F.count("*"), F.count_if(F.col("found") == F.col("truth")), F.count_if(F.col("found") != F.col("truth"))
        ).first()
        assert right >= 0.97 * total and wrong <= 0.02 * total


def test_both_detections_agree(spark):
    raw = as_pages(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"))
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    langs = ["de", "en", "es", "fr"]
    profiles = language.train_profiles(documents, langs, 50)
    model = language.profile_words(profiles, langs)
    assert all(len(words) <= 50 for words in model.values())
    mapped = {r.fetch_seq: r.lang for r in language.with_language(raw, "html", model).select("fetch_seq", "lang").collect()}
    joined = language.pick_language(language.score_language(language.page_words(raw), profiles, langs), language.word_counts(raw))
    assert {r.fetch_seq: r.lang for r in joined.collect()} == mapped


def test_reliability_edges(spark):
    profiles = spark.createDataFrame([("en", "the", 1), ("fr", "le", 1)], "lang string, word string, place int")
    model = {"en": ["the"], "fr": ["le"]}
    texts = {"the " + "x " * 19: "en", "the " + "x " * 20: None, "the the le": "en", "the le": None,
             "the " * 10 + "le " * 9: "en", "the " * 11 + "le " * 10: None, "": None, "x y": None}
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "fetch_seq bigint, html string")
    found = {r.html: r.lang for r in language.with_language(rows, "html", model).collect()}
    assert found == texts
    joined = language.pick_language(
        language.score_language(language.page_words(rows), profiles, ["en", "fr"]), language.word_counts(rows)
    )
    by_seq = {r.fetch_seq: r.lang for r in joined.collect()}
    assert [by_seq.get(i) for i in range(len(texts))] == list(texts.values())


@pytest.mark.parametrize(
    "label,name,codec,text",
    [
        ("GBK", "gb18030", "gbk", "汉字 中文"), ("gb2312", "gb18030", "gb2312", "汉字"), ("GB18030", "gb18030", "gb18030", "汉字 \U0001f600 é"), ("big5", "big5", "big5", "漢字 中文"),
        ("Shift_JIS", "shift-jis", "cp932", "日本語 ①"), ("x-sjis", "shift-jis", "shift_jis", "カタカナ"), ("euc-jp", "euc-jp", "euc_jp", "日本語"), ("ks_c_5601-1987", "euc-kr", "euc_kr", "한국어"),
        ("euc-kr", "euc-kr", "cp949", "뷁"),
    ],
)
def test_charsets_of_several_bytes(spark, label, name, codec, text):
    page = f"<p>{text}</p>"
    rows = spark.createDataFrame([(1, "http://a.com", page.encode(codec), f"text/html; charset={label}")], "fetch_seq bigint, url string, body binary, content_type string")
    row = pages.decode_body(as_pages(rows)).first()
    assert (row.encoding, row.html) == (name, page)


def test_broken_bytes_of_a_declared_charset_do_not_stop_a_run(spark):
    for label in ("gbk", "shift_jis", "euc-kr", "utf-16le"):
        rows = spark.createDataFrame([(1, "http://a.com", b"ab\xff\xff\x81", f"text/html; charset={label}")], "fetch_seq bigint, url string, body binary, content_type string")
        assert pages.decode_body(as_pages(rows)).first().html
