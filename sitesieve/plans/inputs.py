"""Inputs of the registered queries, derived by Spark from the given tables.

The given pages have no status, type, time or robots file; these columns follow from the page number by fixed rules, so
that every operator meets all of its cases and its input grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import SieveConfig
from ..operators import language, links, pages as page_ops, robots, frontier, scout
from ..sources.pages import as_pages

LANGS = ("de", "en", "es", "fr")
CONFIG = SieveConfig(
    langs_of_interest=("en", "fr", "es"),
    user_agent="SieveBot/1.0 (+http://bot.example.org)",
    accepted_tlds=("com", "net", "org"),
    prefix_filter=("mailto:", "^/The"),
    url_blacklist=("spam-farm", "cheap-pills", "adult-x"),
    crawl_delay=3,
    max_attempts=3,
    scout_steps=10,
    min_langs_in_site=2,
    mandatory_lang="fr",
    min_percent_mandatory_lang=20,
)
SIZE_BUDGET_MB = 0.1
TIME_BUDGET_S = 600
# A site is judged when it has so many bytes of documents, one of them of some length, and goes on with three languages, or
# two if no document holds half of it.
POLICY_BYTES = 8_000
POLICY_LONGEST = 1_500
POLICY = scout.SitePolicy(
    {
        "n_docs": scout.Measure("1"),
        "bytes": scout.Measure("n_bytes"),
        "n_langs": scout.Measure("lang", "distinct"),
        "longest": scout.Measure("n_bytes", "max"),
        "first_fetch": scout.Measure("fetch_seq", "min"),
    },
    ready=lambda state: (state["bytes"] >= POLICY_BYTES) & (state["longest"] >= POLICY_LONGEST),
    keep=lambda state: (state["n_langs"] >= 3) | ((state["n_langs"] >= 2) & (state["longest"] * 2 <= state["bytes"])),
)
START = "2024-01-01 00:00:00"
NOW = "2024-01-01 00:20:00"

# Robots files handed out to the hosts in turn: status and body.
ROBOTS_FILES = (
    (200, "User-agent: *\nDisallow: /de/\nDisallow: /en/1\nCrawl-delay: 2\n\nUser-agent: otherbot\nDisallow: /\n"),
    (200, "# named group first\nUser-agent: SieveBot # us\nAllow: /en/1\nDisallow: /en/\nCrawl-delay: 10\n\n"
          "User-agent: *\nDisallow: /\n"),
    (200, "User-agent: *\nDisallow:\n"),
    (200, "User-agent: otherbot\nUser-agent: sievebot\nDisallow: /fr\nDisallow: /e%6E/2\nAllow: /\n\nDisallow: /es\n"),
    (404, ""),
    (403, ""),
    (408, ""),
    (200, "User-agent: nobody\n\nUser-agent: *\nCrawl-delay: x\nDisallow: *\n"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _cases(remainders: list[tuple[int, int, int]], default: int, number: Column) -> Column:
    out = None
    for modulus, remainder, value in remainders:
        hit = number % modulus == remainder
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out.otherwise(default)


def fetched(spark: SparkSession, sf_dir: str, with_location: bool = False) -> DataFrame:
    """Pages with derived response columns; ``location`` of a redirect is the next page."""
    pages = table(spark, sf_dir, "pages")
    number = F.col("page_id")
    rows = pages.select(
        number.alias("fetch_seq"),
        "url",
        "html",
        _cases([(17, 3, 301), (19, 4, 404), (23, 5, 408), (29, 6, 428), (31, 7, 429)], 200, number).alias("status"),
        F.when(number % 13 == 1, "application/pdf")
        .when(number % 37 == 2, F.lit(None))
        .otherwise("text/html; charset=utf-8")
        .alias("content_type"),
        F.when(number % 2 == 0, "120").alias("retry_after"),
        (F.lit(START).cast("timestamp_ntz") + F.make_dt_interval(secs=number * 7)).alias("fetch_ts"),
    )
    if with_location:
        following = pages.select((number - 1).alias("fetch_seq"), F.col("url").alias("next_url"))
        rows = rows.join(following, "fetch_seq", "left").withColumn(
            "location", F.when(F.col("status") == 301, F.col("next_url"))
        ).drop("next_url")
    return as_pages(rows)


def sited(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_ops.with_site(fetched(spark, sf_dir))


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of every page, and the URL of the next page as one more link of each page."""
    pages = page_ops.with_site(as_pages(table(spark, sf_dir, "pages")))
    following = table(spark, sf_dir, "pages").select((F.col("page_id") - 1).alias("fetch_seq"), F.col("url").alias("href"))
    onward = pages.select(
        "fetch_seq", F.col("norm_url").alias("parent_url"), F.col("site").alias("parent_site")
    ).join(following, "fetch_seq")
    return page_ops.page_links(pages).unionByName(onward.withColumn("link", links.urls.strip_fragment("href")))


def link_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.with_link_parts(candidates(spark, sf_dir))


def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.admit_links(link_parts(spark, sf_dir), CONFIG)


def visited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of the pages that were processed."""
    done = page_ops.processed(fetched(spark, sf_dir))
    return done.select(links.urls.norm_url("url").alias("norm_url")).distinct()


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites of the pages in the order of their first page; one of them has stopped."""
    seeds = sited(spark, sf_dir).select(F.col("fetch_seq").alias("seed_seq"), "site")
    known = frontier.seed_sites(seeds)
    return known.select("site", "priority", (F.col("site") == "example.org").alias("stopped"))


def robots_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A robots file for each host of the pages, chosen by the number of its first page."""
    hosts = table(spark, sf_dir, "pages").select("page_id", links.urls.url_host("url").alias("host"))
    kind = F.col("first_page") % len(ROBOTS_FILES)
    status, body = F.when(F.lit(False), 0), F.when(F.lit(False), "")
    for i, (code, text) in enumerate(ROBOTS_FILES):
        status, body = status.when(kind == i, code), body.when(kind == i, text)
    first = hosts.groupBy("host").agg(F.min("page_id").alias("first_page"))
    return first.select("host", status.alias("status"), body.alias("body"))


# Letters of the documents and what stands for them: Cyrillic for English, Greek for French.
LATIN = "abcdefghijklmnopqrstuvwxyz"
SCRIPTS = {"en": "абцдефгхийклмнопярстувщьыз", "fr": "αβψδεφγηιξκλμνοπϙρστυϋωχζϟ"}


# Charsets of several bytes, their labels in a header, and letters of the script that they are used for.
HAN, KANA, HANGUL = "一二三四五六七八九十日月火水木金土山川田人口手目耳心", "あいうえおかきくけこさしすせそたちつてとなにぬねのは", "가나다라마바사아자차카타파하고노도로모보소오조초코토"
CHARSETS = (
    ("gb18030", "gb2312", "GBK", HAN), ("big5", "Big5", "Big5", HAN), ("shift-jis", "Shift_JIS", "Shift_JIS", KANA), ("euc-jp", "EUC-JP", "EUC-JP", KANA),
    ("euc-kr", "ks_c_5601-1987", "EUC-KR", HANGUL),
)


def other_scripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in lower case, English and French ones in other letters, those of other languages as they are."""
    text = F.lower("text")
    written = text
    for code, letters in SCRIPTS.items():
        written = F.when(F.col("lang") == code, F.translate(text, LATIN, letters)).otherwise(written)
    return table(spark, sf_dir, "documents").select("doc_id", "lang", written.alias("text"))


def model(spark: SparkSession, sf_dir: str) -> dict[str, list[str]]:
    """Word profiles of the documents; every query that needs them trains them."""
    return language.profile_words(language.train_profiles(table(spark, sf_dir, "documents"), LANGS), LANGS)


def kept(spark: SparkSession, sf_dir: str, with_html: bool = False) -> DataFrame:
    """Pages of the right status and type in a language of interest, with ``n_bytes``."""
    from .crawl import eligible

    pages = sited(spark, sf_dir).filter(eligible(CONFIG))
    found = language.with_language(pages, "html", model(spark, sf_dir))
    found = language.keep_langs(found, CONFIG.langs_of_interest)
    found = found.withColumn("n_bytes", F.octet_length("html").cast("bigint")).withColumn("encoding", F.lit("utf-8"))
    return found if with_html else found.drop("html")


def site_delays(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = page_ops.with_site(as_pages(table(spark, sf_dir, "pages"))).select("host", "site")
    delays = robots.robots_delay(robots.robots_rules(robots_files(spark, sf_dir)), CONFIG.user_agent)
    return robots.site_delay(hosts, delays, CONFIG.crawl_delay)
