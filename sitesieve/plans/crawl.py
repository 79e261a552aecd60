"""The whole run over a table of fetched pages: judge pages, stop sites, keep documents, extend the frontier."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from ..config import SieveConfig
from ..functions import content, urls
from ..functions.binding import computed
from ..operators import budgets, frontier, hosts, language, links, pages as page_ops, robots, scout
from ..session import bucketed, buckets, stage
from ..sources import state

# ``first_seq`` of a pending URL that is a seed
BEFORE_ALL_PAGES = -1


@dataclass(frozen=True)
class Crawl:
    """Tables of a run.

    ``judged``: one row per page without its text (``fetch_seq``, ``norm_url``, ``host``, ``site``, ``status``,
    ``fetch_ts``, ``retry_after``, ``lang``, ``n_bytes``, ``outcome``, and ``after_stop`` for a page that lies behind the
    stop of its site). ``sites``: ``site``, ``cause``, ``stop_seq``. ``documents``: kept pages with text. ``admitted``:
    links that passed. ``pending``: their new URLs. ``seeds``: URLs of other sites.
    """

    judged: DataFrame
    sites: DataFrame
    documents: DataFrame
    admitted: DataFrame
    pending: DataFrame
    seeds: DataFrame


def eligible(config: SieveConfig):
    """Worth reading: status, type and text are all right."""
    return (
        (content.status_action("status") == "process")
        & content.type_accepted("content_type", config.accepted_content)
        & (F.coalesce(F.length("html"), F.lit(0)) > 0)
    )


def _with_language(df: DataFrame, text: str, model: Mapping[str, Sequence[str]], config: SieveConfig) -> DataFrame:
    return language.with_language(
        df, text, model, pattern=config.word_pattern, min_share=config.lang_min_share, max_rival=config.lang_max_rival
    )


# Pages of consecutive numbers that lie in one bucket: about a file of page text
PAGE_BLOCK = 1 << 14
NARROW = (
    "fetch_seq", "norm_url", "status", "content_type", "location", "retry_after", "fetch_ts", "encoding", "lang", "n_bytes", "has_text",
)


def read_texts(
    pages: DataFrame, config: SieveConfig, model: Mapping[str, Sequence[str]], policy: scout.SitePolicy | None = None
) -> DataFrame:
    """All that is ever read off the text of a page, in one pass: ``encoding``, ``n_bytes``, ``has_text``, of eligible pages ``lang`` and
    ``hrefs`` (each link once), and what a page in a language of interest gives to the state of its site under ``policy``. ``html`` is left only where it may become a document, in a language of interest."""
    decoded = page_ops.decode_body(pages)
    named = computed(decoded, {"norm_url": urls.norm_url("url")})
    parsed = named.withColumn("__text", F.when(eligible(config), F.col("html")))
    detected = _with_language(parsed.drop("lang"), "__text", model, config)
    found = detected.withColumns({
        "has_text": F.coalesce(F.length("html"), F.lit(0)) > 0,
        "hrefs": F.array_distinct(content.hrefs("__text")),
        "html": F.when(F.col("lang").isin(*config.langs_of_interest), F.col("__text")),
    })
    found = found.drop("__text")
    return found if policy is None else scout.measured(found, policy)


def judge_texts(
    read: DataFrame, config: SieveConfig, robots_files: DataFrame | None = None, suffixes: Sequence[str] | DataFrame | None = None,
    more: Sequence[str] = (),
) -> DataFrame:
    """One narrow row per page of ``read_texts`` with its site and outcome; ``more`` names columns to carry along."""
    narrow = hosts.with_host_parts(read.select(*(c for c in ("block", *NARROW, *more) if c in read.columns)), "norm_url", suffixes)
    if robots_files is not None:
        narrow = robots.robots_allowed(narrow, robots.robots_lookup(robots_files, config.user_agent))
    # the outcome only asks whether there is text
    narrow = narrow.withColumn("html", F.when(F.col("has_text"), "x"))
    judged = page_ops.page_outcomes(
        narrow, config.langs_of_interest, config.accepted_content, "allowed" if robots_files is not None else None
    )
    return judged.drop("html", "has_text", "allowed", "suffix")


def judge_pages(
    pages: DataFrame, config: SieveConfig, model: Mapping[str, Sequence[str]], robots_files: DataFrame | None = None,
    suffixes: Sequence[str] | DataFrame | None = None,
) -> DataFrame:
    """One narrow row per page with its language and outcome.

    The text of a page is dropped before the join with the robots rules; pages that are not eligible are not parsed.
    """
    return judge_texts(read_texts(pages, config, model), config, robots_files, suffixes)


def _fetched():
    """Pages that a crawler would have fetched."""
    return ~F.col("outcome").isin("robots", "repeated")


def with_blocks(pages: DataFrame, n_buckets: int) -> DataFrame:
    """Add ``block``, the same for ``PAGE_BLOCK`` consecutive numbers, or fewer where buckets would stay empty."""
    low, high = pages.agg(F.min("fetch_seq"), F.max("fetch_seq")).first()
    span = 0 if low is None else high - low + 1
    size = max(1, min(PAGE_BLOCK, span // (4 * n_buckets)))
    return pages.withColumn("block", F.expr(f"fetch_seq div {size}"))


def by_block(judged: DataFrame) -> DataFrame:
    """One row per block of pages, which is at most ``PAGE_BLOCK`` of them: their numbers in order, and beside them host, site and whether they are kept."""
    row = F.struct("fetch_seq", "host", "site", (F.col("outcome") == "kept").alias("kept"))
    packed = judged.groupBy("block").agg(F.sort_array(F.collect_list(row)).alias("of"))
    columns = {"seqs": "fetch_seq", "hosts": "host", "sites": "site", "keeps": "kept"}
    return packed.select("block", *(F.col(f"of.{field}").alias(f"__{name}") for name, field in columns.items()))


def met_by_block(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (``block``, ``fetch_seq``) of the pages that ``by_block`` lists, with ``host``, ``site`` and ``__kept``.

    The block is the only key, as it is of the buckets of both tables, so neither is shuffled; the page is looked up in the numbers of its block.
    """
    met = rows.join(blocks.hint("shuffle_hash"), "block").withColumn("__at", F.array_position("__seqs", F.col("fetch_seq")).cast("int")).filter("__at > 0")
    found = {"host": "__hosts", "site": "__sites", "__kept": "__keeps"}
    return met.select(*rows.columns, *(F.element_at(array, F.col("__at")).alias(name) for name, array in found.items()))


def numbered_once(judged: DataFrame) -> None:
    """Raise unless every page has a number of its own; later steps tell pages apart by it."""
    wrong = judged.groupBy("fetch_seq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 OR fetch_seq IS NULL").limit(1).collect()
    if wrong:
        raise ValueError(f"fetch_seq {wrong[0]['fetch_seq']} stands for {wrong[0]['n']} pages")


def site_stops(
    judged: DataFrame, config: SieveConfig, policy: scout.Policy | scout.SitePolicy = scout.languages_policy, starts: DataFrame | None = None
) -> DataFrame:
    """Why and where each site stops, by scout and budgets; ``starts`` (``site``, ``crawl_starts``) of sites begun earlier."""
    kept = judged.filter(F.col("outcome") == "kept")
    allowed = judged.filter(_fetched())
    if isinstance(policy, scout.SitePolicy):
        decisions = scout.policy_decision(kept, policy)
    else:
        decisions = scout.scout_decision(scout.scout_steps(kept, config.scout_steps), config, policy)
    size = None if config.max_size_per_site is None else budgets.size_budget(kept, config.max_size_per_site)
    time = None if config.max_time_per_site is None else budgets.time_budget(allowed, config.max_time_per_site, starts)
    sites = judged.groupBy("site").agg(F.max("fetch_seq").alias("last_seq"))
    return budgets.site_status(sites, decisions.select("site", "stop_seq"), size, time)


def run(
    pages: DataFrame, config: SieveConfig, model: Mapping[str, Sequence[str]], robots_files: DataFrame | None = None,
    suffixes: Sequence[str] | DataFrame | None = None, visited: DataFrame | None = None,
    policy: scout.Policy | scout.SitePolicy = scout.languages_policy, seeds: DataFrame | None = None, starts: DataFrame | None = None,
) -> Crawl:
    """Compose a run.

    Each page has its own ``fetch_seq``; of several fetches of a URL those behind its final answer are ``repeated`` and
    count for nothing. ``visited`` are URLs of earlier runs; ``seeds`` (``seed_seq``, ``url``) become pending unless they
    have been visited; ``starts`` (``site``, ``crawl_starts``) tells when sites were begun for the time budget. The measures of a ``SitePolicy``
    may use every column of a page, its text included.

    The text of a page is read once: that pass writes what it found in buckets by block of ``fetch_seq``, where it was read, without a shuffle.
    Judging works on the narrow columns of this table; what is to stay is written in the same buckets, a row for each block, so that documents and links get their site and
    lose the pages that are denied or behind a stop in joins of bucket with bucket, however many these are. The narrow side is the one that is hashed.
    """
    if isinstance(suffixes, DataFrame):
        suffixes = hosts.prepared(suffixes)
    spark = pages.sparkSession
    n_buckets = buckets(spark)
    own = policy if isinstance(policy, scout.SitePolicy) else None
    measures = [] if own is None else list(own.measures)
    read = bucketed(read_texts(with_blocks(pages, n_buckets), config, model, own), "read", "block", n_buckets)
    judged = stage(judge_texts(read, config, robots_files, suffixes, measures), "judged_fetches")
    numbered_once(judged)
    judged = stage(page_ops.mark_repeated(judged), "judged")
    sites = stage(site_stops(judged, config, policy, starts), "sites")
    stops = sites.filter(F.col("stop_seq").isNotNull()).select("site", "stop_seq")
    marked = judged.join(stops, "site", "left").withColumn("after_stop", F.coalesce(F.col("fetch_seq") > F.col("stop_seq"), F.lit(False))).drop("stop_seq")

    moved = marked.filter(_fetched() & ~F.col("after_stop"))
    going = bucketed(by_block(moved.repartition(n_buckets, "block")), "going", "block", n_buckets)
    documents = met_by_block(read.drop("hrefs", "has_text", *measures), going).filter("__kept").drop("block", "__kept")
    arrays = met_by_block(read.filter(F.size("hrefs") > 0).select("block", "fetch_seq", "norm_url", "hrefs"), going)
    found = page_ops.explode_links(arrays).unionByName(links.redirect_links(moved))
    admitted = links.admitted(links.admit_links(links.with_link_parts(found, suffixes), config))
    seen = judged.select("norm_url")
    if visited is not None:
        seen = seen.unionByName(visited.select("norm_url"))
    own = admitted.filter(F.col("reason") == "same_site").select("norm_url", "fetch_seq")
    if seeds is not None:
        first = frontier.seed_frontier(seeds, suffixes)
        own = own.unionByName(first.select("norm_url", F.lit(BEFORE_ALL_PAGES).alias("fetch_seq")))
    pending = frontier.new_links(frontier.dedup_links(own, suffixes), seen)
    discovered = frontier.discovered_seeds(frontier.new_links(admitted, seen))
    return Crawl(marked.drop("block"), sites, documents, admitted, pending, discovered)


def _open_urls(judged: DataFrame, config: SieveConfig, before: Mapping[str, DataFrame] | None) -> DataFrame:
    """URLs whose last fetch asked for another one that is still granted: ``site``, ``norm_url``, ``n`` failures so far,
    ``added`` and ``wait_until``."""
    fetches = judged.filter(_fetched() & ~F.col("after_stop")).withColumn("action", content.status_action("status"))
    failed = F.col("action").isin("retry", "wait")
    last = fetches.groupBy("site", "norm_url").agg(
        F.max_by(F.struct("action", budgets.wait_until("fetch_ts", "retry_after").alias("wake")), "fetch_seq").alias("last"),
        F.max("fetch_seq").alias("added"),
    )
    last = last.filter(F.col("last.action").isin("retry", "wait"))
    log = fetches.filter(failed).select("norm_url", F.col("fetch_seq").alias("attempt"), "action")
    states = budgets.attempt_state(log, config.max_attempts, before and before["attempts"]).filter(F.col("state") == "retry")
    return last.join(states, "norm_url").select(
        "site", "norm_url", F.col("n_failures").alias("n"), "added",
        F.when(F.col("last.action") == "wait", F.col("last.wake")).alias("wait_until"),
    )


def next_state(done: Crawl, config: SieveConfig, before: Mapping[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """State for the next run, ready for ``save_state``.

    ``visited`` (``site``, ``norm_url``): URLs that are done with. ``pending`` (``site``, ``norm_url``, ``added``,
    ``wait_until``): new URLs, seeds discovered for sites that have not stopped, URLs to be fetched again, and what was
    pending before and has not been fetched. ``attempts`` (``site``, ``norm_url``, ``n``): failures of URLs that are to
    be fetched again, also of those that this run did not reach. ``sites`` (``site``, ``priority``, ``stopped``,
    ``cause``): all sites in the order of their arrival; a site without a pending URL is exhausted.

    The last fetch of a URL decides: a failure that was followed by an answer is forgotten.
    """
    spark = done.judged.sparkSession
    again = stage(_open_urls(done.judged, config, before), "open_urls")
    seen = done.judged.select("site", "norm_url")
    columns = ["site", "norm_url", "added", "wait_until"]
    asleep = F.lit(None).cast("timestamp_ntz")
    pending = done.pending.select("site", "norm_url", F.col("first_seq").alias("added"), asleep.alias("wait_until"))
    pending = pending.unionByName(again.select(*columns))
    attempts = again.select("site", "norm_url", "n")
    known = spark.createDataFrame([], "site string, priority bigint, stopped boolean, cause string")
    if before is not None:
        fetched = done.judged.filter(_fetched() & ~F.col("after_stop")).select("norm_url")
        pending = pending.unionByName(before["pending"].select(*columns).join(fetched, "norm_url", "left_anti").select(*columns))
        attempts = attempts.unionByName(before["attempts"].join(fetched, "norm_url", "left_anti").select("site", "norm_url", "n"))
        known = before["sites"].select(*known.columns)
        seen = seen.unionByName(before["visited"].select("site", "norm_url"))
    visited = stage(seen.join(again.select("norm_url"), "norm_url", "left_anti").select("site", "norm_url").distinct(), "visited")

    # sites of the pages and of the discovered seeds, numbered behind those known before
    arrived = done.judged.select("site", "norm_url", F.col("fetch_seq").alias("first_seq")).unionByName(
        done.seeds.select("site", "norm_url", "first_seq")
    )
    expanded = frontier.expand_sites(arrived, known).filter(F.col("action") == "new")
    sites = known.unionByName(
        expanded.select("site", "priority", F.lit(False).alias("stopped"), F.lit("running").alias("cause"))
    )
    causes = done.sites.filter(F.col("cause") != "running").select("site", F.col("cause").alias("now"))
    cause = F.when(F.col("stopped"), F.col("cause")).otherwise(F.coalesce("now", F.col("cause")))
    sites = sites.join(causes, "site", "left").withColumn("cause", cause).withColumn("stopped", F.col("cause") != "running")
    sites = stage(sites.select(*known.columns), "known_sites")
    extended = frontier.frontier_of_running(done.seeds, sites)
    pending = pending.unionByName(extended.select("site", "norm_url", F.col("first_seq").alias("added"), asleep.alias("wait_until")))
    pending = frontier.new_links(pending, visited).groupBy("site", "norm_url").agg(
        F.min("added").alias("added"), F.max("wait_until").alias("wait_until")
    )
    pending = stage(pending, "pending")
    empty = budgets.exhausted_sites(sites.filter(~F.col("stopped")), pending).select("site", F.lit(True).alias("empty"))
    sites = sites.join(empty, "site", "left").withColumn("cause", F.when(F.col("empty"), "exhausted").otherwise(F.col("cause")))
    sites = sites.withColumn("stopped", F.col("cause") != "running").select(*known.columns)
    return {"visited": visited, "pending": pending, "attempts": attempts, "sites": sites}


def next_changes(done: Crawl, config: SieveConfig, before: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """What a run changes in the state ``before`` (as loaded), ready for ``save_changes``: the tables of ``next_state`` with the column ``gone``.

    Rows are those of this run: URLs it met, URLs it found, sites it touched. The visited URLs of earlier runs are asked through their filter,
    and of the pending ones and the sites only those that the run names are looked at beyond their key.
    """
    columns = ["site", "norm_url", "added", "wait_until"]
    asleep = F.lit(None).cast("timestamp_ntz")
    again = stage(_open_urls(done.judged, config, before), "open_urls")
    fetched = stage(done.judged.filter(_fetched() & ~F.col("after_stop")).select("norm_url").distinct(), "fetched")
    # visited: what this run met and is done with; a URL that asks to be fetched again is no longer visited
    met = done.judged.select("site", "norm_url").join(again.select("norm_url"), "norm_url", "left_anti").select("site", "norm_url").distinct()
    met = stage(met, "met")
    new = state.not_visited(met, before)
    reopened = before["visited"].join(again.select("norm_url"), "norm_url", "left_semi").select("site", "norm_url")
    visited = new.withColumn("gone", F.lit(False)).unionByName(reopened.withColumn("gone", F.lit(True)))

    failed = again.select("site", "norm_url", "n").withColumn("gone", F.lit(False))
    settled = before["attempts"].join(fetched, "norm_url", "left_semi").join(again.select("norm_url"), "norm_url", "left_anti")
    attempts = failed.unionByName(settled.select("site", "norm_url", "n").withColumn("gone", F.lit(True)))

    known = before["sites"].select("site", "priority", "stopped", "cause")
    arrived = done.judged.select("site", "norm_url", F.col("fetch_seq").alias("first_seq")).unionByName(
        done.seeds.select("site", "norm_url", "first_seq")
    )
    expanded = frontier.expand_sites(arrived, known).filter(F.col("action") == "new")
    added = expanded.select("site", "priority", F.lit(False).alias("stopped"), F.lit("running").alias("cause"))
    causes = done.sites.filter(F.col("cause") != "running").select("site", F.col("cause").alias("now"))
    touched = stage(arrived.select("site").union(done.pending.select("site")).distinct(), "touched")
    sites = known.join(touched, "site", "left_semi").unionByName(added).join(causes, "site", "left")
    cause = F.when(F.col("stopped"), F.col("cause")).otherwise(F.coalesce("now", F.col("cause")))
    sites = stage(sites.withColumn("cause", cause).withColumn("stopped", F.col("cause") != "running").drop("now"), "touched_sites")

    # pending: what arrives and is not visited, merged with what was pending and not fetched
    found = done.pending.select("site", "norm_url", F.col("first_seq").alias("added"), asleep.alias("wait_until"))
    onward = frontier.frontier_of_running(done.seeds, sites)
    found = found.unionByName(onward.select("site", "norm_url", F.col("first_seq").alias("added"), asleep.alias("wait_until")))
    found = state.not_visited(found.join(met, "norm_url", "left_anti").select(*columns), before)
    arrivals = stage(found.unionByName(again.select(*columns)), "arrivals")
    old = before["pending"].select(*columns)
    named = arrivals.select("norm_url").distinct()
    merged = arrivals.unionByName(old.join(named, "norm_url", "left_semi").join(fetched, "norm_url", "left_anti").select(*columns))
    merged = merged.groupBy("site", "norm_url").agg(F.min("added").alias("added"), F.max("wait_until").alias("wait_until"))
    merged = stage(merged, "merged")
    taken = fetched.unionByName(met.select("norm_url")).distinct().join(named, "norm_url", "left_anti")
    removed = stage(old.join(taken, "norm_url", "left_semi").select(*columns), "removed")
    pending = merged.withColumn("gone", F.lit(False)).unionByName(removed.withColumn("gone", F.lit(True)))

    # only a touched site can have lost its last pending URL
    still = old.join(touched, "site", "left_semi").join(removed.select("norm_url"), "norm_url", "left_anti").select(*columns).unionByName(merged)
    empty = budgets.exhausted_sites(sites.filter(~F.col("stopped")), still).select("site", F.lit(True).alias("empty"))
    sites = sites.join(empty, "site", "left").withColumn("cause", F.when(F.col("empty"), "exhausted").otherwise(F.col("cause")))
    sites = sites.withColumn("stopped", F.col("cause") != "running").select("site", "priority", "stopped", "cause", F.lit(False).alias("gone"))
    return {"visited": visited, "pending": pending, "attempts": attempts, "sites": sites}
