"""The set of URLs still to fetch, as tables keyed on the normalised URL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from ..functions import urls
from ..functions.binding import computed
from .hosts import with_host_parts
from .ordered import SPAN, numbered_overall, running_before, top_per_key


def new_links(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links whose URL has not been visited."""
    return links.join(visited.select("norm_url"), "norm_url", "left_anti")


def dedup_links(links: DataFrame, suffixes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """One row per URL: ``norm_url``, ``host``, ``suffix``, ``site``, ``first_seq`` of the first page that names it, and
    ``n_found``.

    Only numbers are aggregated, so the partial aggregation before the shuffle is a hash aggregation and a URL named by
    very many pages is no hot spot; the site follows from the URL. The result stays partitioned by URL for
    ``new_links``.
    """
    grouped = links.groupBy("norm_url").agg(F.min("fetch_seq").alias("first_seq"), F.count(F.lit(1)).alias("n_found"))
    return with_host_parts(grouped, "norm_url", suffixes)


def with_parent(found: DataFrame, pages: DataFrame) -> DataFrame:
    """Add ``parent_url``, the normalised URL of the page ``first_seq``."""
    parents = pages.select(F.col("fetch_seq").alias("first_seq"), F.col("norm_url").alias("parent_url"))
    return found.join(parents, "first_seq", "left")


def extend_frontier(frontier: DataFrame, new: DataFrame) -> DataFrame:
    """Frontier with the new URLs; an URL already in it keeps its entry. Columns ``norm_url``, ``site``, ``added``."""
    columns = ["norm_url", "site", "added"]
    both = frontier.select(*columns).unionByName(new.select(*columns))
    return both.groupBy("norm_url", "site").agg(F.min("added").alias("added"))


def discovered_seeds(links: DataFrame) -> DataFrame:
    """Links to other sites as seeds of those sites: one row per ``site`` and ``norm_url`` with ``first_seq``.

    Kept as rows, not as one collection per site, because a much-linked site may have any number of them.
    """
    other = links.filter(F.col("reason") == "other_site")
    return other.groupBy("site", "norm_url").agg(F.min("fetch_seq").alias("first_seq"))


def seed_frontier(seeds: DataFrame, suffixes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Seeds as frontier: ``norm_url``, ``host``, ``suffix``, ``site``, ``added`` (the first ``seed_seq``), each URL once.

    Seeds are only checked for an empty or too long URL: no prefix filter, no blacklist, no suffix.
    """
    usable = seeds.filter(~urls.link_problem("url").isin("empty", "too_long"))
    named = computed(usable.select("seed_seq", "url"), {"norm_url": urls.norm_url("url")})
    return with_host_parts(named.groupBy("norm_url").agg(F.min("seed_seq").alias("added")), "norm_url", suffixes)


def seed_sites(seeds: DataFrame, span: int = SPAN) -> DataFrame:
    """Sites of the seeds with their priority: ``site``, ``n_seeds``, ``first_seed``, ``priority`` from 0 on.

    ``seeds`` has ``seed_seq`` and ``site``. Sites are numbered in the order of their first seed.
    """
    sites = seeds.groupBy("site").agg(F.count(F.lit(1)).alias("n_seeds"), F.min("seed_seq").alias("first_seed"))
    numbered = numbered_overall(sites, "first_seed", "priority", span, tie=["site"])
    return numbered.withColumn("priority", F.col("priority") - 1)


def expand_sites(seeds: DataFrame, sites: DataFrame, span: int = SPAN) -> DataFrame:
    """What becomes of each discovered site: ``site``, ``n_seeds``, ``action``, ``priority``.

    ``seeds`` is a result of ``discovered_seeds``; ``sites`` has ``site``, ``priority`` and ``stopped``. A stopped site is ignored, a running one is extended, a new one
    gets the next priority in the order of its first discovery.
    """
    found = seeds.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_seeds"), F.min("first_seq").alias("first_seq")
    )
    known = found.join(sites.select("site", "priority", "stopped"), "site", "left").withColumn("__all", F.lit(0))
    is_new = F.col("priority").isNull()
    counted = running_before(known, ["__all"], "first_seq", is_new.cast("int"), "new_before", span, tie=["site"])
    top = sites.agg(F.coalesce(F.max("priority"), F.lit(-1)).cast("bigint")).scalar()
    action = F.when(is_new, F.lit("new")).when(F.col("stopped"), F.lit("ignore")).otherwise(F.lit("extend"))
    priority = F.coalesce(F.col("priority").cast("bigint"), top + 1 + F.col("new_before"))
    return counted.select("site", "n_seeds", action.alias("action"), priority.alias("priority"))


def frontier_of_running(seeds: DataFrame, sites: DataFrame) -> DataFrame:
    """Discovered seeds without those of stopped sites."""
    return seeds.join(sites.filter("stopped").select("site"), "site", "left_anti")


def next_urls(frontier: DataFrame, now, k: int = 1) -> DataFrame:
    """Next URLs of each site, last added first, URLs asleep until after ``now`` left out; ``place`` from 1 to ``k``."""
    awake = frontier.filter(F.col("wait_until").isNull() | (F.col("wait_until") <= now))
    return top_per_key(awake, ["site"], [F.desc("added"), F.asc("norm_url")], k, "place")


def served_sites(sites: DataFrame, max_jobs: int) -> DataFrame:
    """The sites served first: lowest arrival priority, at most ``max_jobs`` of them."""
    return sites.orderBy("priority").limit(max_jobs)


def seeds_for_resume(seeds: DataFrame, pending: DataFrame, visited: DataFrame) -> DataFrame:
    """Pending URLs of a resumed run: saved ones and configured seeds, without those visited."""
    return new_links(extend_frontier(pending, seeds), visited)
