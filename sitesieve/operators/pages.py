"""Operators on fetched pages."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import content, urls
from ..functions.binding import computed, let
from .hosts import with_host_parts

# Outcomes of a page, in the order in which they are tested.
# A fetch of a URL that already had its final answer is repeated.
OUTCOMES = ("repeated", "robots", "status", "content_type", "no_text", "no_language", "other_language", "kept")


def decode_body(pages: DataFrame) -> DataFrame:
    """Add ``encoding``, ``html`` and ``n_bytes`` of the raw body to pages that come as bytes in ``body``; pages with
    ``html`` pass, with its bytes. Charset and text are found once per page, whatever is filtered on them."""
    raw = "body" if "body" in pages.columns else "html"
    sized = pages.withColumn("n_bytes", F.octet_length(raw).cast("bigint"))
    if raw == "html":
        return sized if "encoding" in pages.columns else sized.withColumn("encoding", F.lit("utf-8"))
    found = computed(sized, {"encoding": content.body_encoding("body", "content_type")})
    return computed(found, {"html": content.decoded("body", "encoding")}).drop("body")


def first_answers(fetches: DataFrame) -> DataFrame:
    """URLs fetched more than once: ``norm_url`` and ``final_seq``, the fetch after which the URL is done with.

    ``fetches`` has ``norm_url``, ``fetch_seq``, ``status`` and ``outcome``. Only an answer that asks to be fetched again
    leaves a URL open; NULL when there is no other.
    """
    open_still = content.status_action("status").isin("retry", "wait") | (F.col("outcome") == "robots")
    grouped = fetches.groupBy("norm_url").agg(
        F.min(F.when(~open_still, F.col("fetch_seq"))).alias("final_seq"), F.count(F.lit(1)).alias("n")
    )
    return grouped.filter("n > 1").drop("n")


def mark_repeated(fetches: DataFrame) -> DataFrame:
    """``outcome`` of fetches behind the final answer of their URL set to ``repeated``."""
    marked = fetches.join(first_answers(fetches), "norm_url", "left")
    repeated = F.col("fetch_seq") > F.col("final_seq")
    return marked.withColumn("outcome", F.when(repeated, "repeated").otherwise(F.col("outcome"))).select(*fetches.columns)


def accept_content(pages: DataFrame, pattern: str) -> DataFrame:
    """Pages whose content type matches the pattern, or that have none."""
    return pages.filter(content.type_accepted("content_type", pattern))


def processed(pages: DataFrame) -> DataFrame:
    """Pages with a status that asks for processing."""
    return pages.filter(content.status_action("status") == "process")


def non_empty(pages: DataFrame) -> DataFrame:
    return pages.filter(F.length("html") > 0)


def with_site(pages: DataFrame, suffixes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Add ``norm_url`` and the host columns of the page itself."""
    return with_host_parts(computed(pages, {"norm_url": urls.norm_url("url")}), "norm_url", suffixes)


def extract_links(pages: DataFrame, keep: Sequence[str] = ("fetch_seq", "url"), distinct: bool = False) -> DataFrame:
    """One row per link: the kept page columns and ``href`` as found; with ``distinct``, once per page."""
    found = content.hrefs("html")
    return pages.select(*keep, F.explode(F.array_distinct(found) if distinct else found).alias("href"))


def link_arrays(pages: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Links of each page in one array, without the page text: small rows for joins that come before the explode.

    Columns ``fetch_seq``, ``norm_url``, ``site``, those of ``keep``, and ``hrefs`` (each once).
    """
    return pages.select("fetch_seq", "norm_url", "site", *keep, F.array_distinct(content.hrefs("html")).alias("hrefs"))


def explode_links(arrays: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per link: ``fetch_seq``, ``parent_url``, ``parent_site``, ``href``, ``link``.

    ``link`` is absolute and has no fragment. Links are resolved inside the array, with the parts of the page URL taken
    once per page; behind the explode they are plain columns, so filters on links never evaluate the resolution again.
    """
    resolved = let(urls.base_parts("norm_url"), lambda base: urls.resolve_in(F.col("hrefs"), base))
    return arrays.select(
        "fetch_seq", F.col("norm_url").alias("parent_url"), F.col("site").alias("parent_site"), *keep,
        F.inline(resolved),
    )


def page_links(pages: DataFrame) -> DataFrame:
    """Resolved links of each page, once per page, in the columns of ``explode_links``."""
    return explode_links(link_arrays(pages))


def outcome(
    robots_allowed: Column, status: Column, content_type: Column, html: Column, lang: Column,
    langs: Sequence[str], accepted_content: str,
) -> Column:
    """The one outcome of a page, by the first test it fails."""
    return (
        F.when(~robots_allowed, F.lit("robots"))
        .when(content.status_action(status) != "process", F.lit("status"))
        .when(~content.type_accepted(content_type, accepted_content), F.lit("content_type"))
        .when(F.coalesce(F.length(html), F.lit(0)) == 0, F.lit("no_text"))
        .when(lang.isNull(), F.lit("no_language"))
        .when(~lang.isin(*langs), F.lit("other_language"))
        .otherwise(F.lit("kept"))
    )


def page_outcomes(
    pages: DataFrame, langs: Sequence[str], accepted_content: str, robots_col: str | None = None
) -> DataFrame:
    """Add ``outcome``; ``robots_col`` names the column that says whether robots rules allow the page."""
    allowed = F.col(robots_col) if robots_col else F.lit(True)
    return pages.withColumn(
        "outcome",
        outcome(allowed, F.col("status"), F.col("content_type"), F.col("html"), F.col("lang"), langs, accepted_content),
    )
