"""Budgets, failed fetches and pacing of sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import content
from .ordered import SPAN, first_over, numbered, previous

# Causes of a stop, in the order in which they count when they fall on the same page.
STOP_CAUSES = ("scout", "size", "time", "exhausted")


def size_budget(kept: DataFrame, megabytes: float, span: int = SPAN) -> DataFrame:
    """Sites over their size budget: ``site``, ``stop_seq`` of the document that crosses it. ``kept`` has ``n_bytes``."""
    return first_over(kept, ["site"], "fetch_seq", F.col("n_bytes"), round(megabytes * 1_000_000), span)


def time_budget(pages: DataFrame, seconds: int, starts: DataFrame | None = None) -> DataFrame:
    """Sites over their time budget: ``site``, ``stop_seq`` of the first page fetched too late.

    ``starts`` gives ``site`` and ``crawl_starts``; without it a site starts with its first page. Two aggregates with
    map-side combining and a join on one row per site; no ordering of the pages of a site is needed.
    """
    narrow = pages.select("site", "fetch_seq", "fetch_ts")
    if starts is None:
        starts = narrow.groupBy("site").agg(F.min("fetch_ts").alias("crawl_starts"))
    begun = narrow.join(starts.select("site", "crawl_starts"), "site")
    late = F.col("fetch_ts") > F.col("crawl_starts") + F.make_dt_interval(secs=F.lit(seconds))
    return begun.filter(late).groupBy("site").agg(F.min("fetch_seq").alias("stop_seq"))


def exhausted_sites(sites: DataFrame, frontier: DataFrame) -> DataFrame:
    """Sites without a pending URL."""
    return sites.join(frontier.select("site"), "site", "left_anti")


def site_status(
    sites: DataFrame, scout: DataFrame | None = None, size: DataFrame | None = None, time: DataFrame | None = None,
    exhausted: DataFrame | None = None,
) -> DataFrame:
    """State of each site: ``site``, ``cause`` (``running`` if none), ``stop_seq``.

    ``sites`` has ``site`` and ``last_seq``, the last page seen. The earliest stop wins, equal ones by the order of
    causes; an exhausted site stops at its last page.
    """
    causes = []
    for rank, (cause, stops) in enumerate(zip(STOP_CAUSES, (scout, size, time, exhausted))):
        if stops is None:
            continue
        if cause == "exhausted":
            stops = stops.select("site").join(sites.select("site", F.col("last_seq").alias("stop_seq")), "site")
        causes.append(
            stops.filter(F.col("stop_seq").isNotNull()).select(
                "site", "stop_seq", F.lit(rank).alias("rank"), F.lit(cause).alias("cause")
            )
        )
    state = sites.select("site")
    if not causes:
        return state.select("site", F.lit("running").alias("cause"), F.lit(None).cast("bigint").alias("stop_seq"))
    every = causes[0]
    for more in causes[1:]:
        every = every.unionByName(more)
    first = every.groupBy("site").agg(F.min(F.struct("stop_seq", "rank", "cause")).alias("first"))
    return state.join(first, "site", "left").select(
        "site", F.coalesce("first.cause", F.lit("running")).alias("cause"), F.col("first.stop_seq").alias("stop_seq")
    )


def attempt_state(log: DataFrame, max_attempts: int, earlier: DataFrame | None = None) -> DataFrame:
    """State of each URL after its failures: ``norm_url``, ``n_failures``, ``state``.

    ``log`` has ``norm_url``, ``attempt`` and ``action``; ``earlier`` (``norm_url``, ``n``) are failures of earlier runs. The first failure and ``max_attempts`` more are retried, the
    next one gives up; a failure that is not to be retried is final at once.
    """
    final = ~F.col("action").isin("retry", "wait")
    seen = log.groupBy("norm_url").agg(
        F.count(F.lit(1)).alias("n_failures"),
        F.max("attempt").alias("last"),
        F.max(F.when(final, F.col("attempt"))).alias("last_final"),
    )
    if earlier is not None:
        before = earlier.groupBy("norm_url").agg(F.sum("n").alias("n_before"))
        counted = F.col("n_failures") + F.coalesce("n_before", F.lit(0))
        seen = seen.join(before, "norm_url", "left").withColumn("n_failures", counted)
    state = (
        F.when(F.col("last_final") == F.col("last"), F.lit("failed"))
        .when(F.col("n_failures") >= max_attempts + 2, F.lit("given_up"))
        .otherwise(F.lit("retry"))
    )
    return seen.select("norm_url", "n_failures", state.alias("state"))


def wait_until(fetch_ts: Column | str, retry_after: Column | str) -> Column:
    """Time before which a URL that asked to wait must not be fetched again."""
    fetch_ts = F.col(fetch_ts) if isinstance(fetch_ts, str) else fetch_ts
    retry_after = F.col(retry_after) if isinstance(retry_after, str) else retry_after
    seconds = F.coalesce(F.trim(retry_after).try_cast("int"), F.lit(content.DEFAULT_RETRY_AFTER))
    return fetch_ts + F.make_dt_interval(secs=seconds)


def retry_wait(pages: DataFrame) -> DataFrame:
    """Pages that asked to wait, with ``wait_until``."""
    waiting = pages.filter(content.status_action("status") == "wait")
    return waiting.withColumn("wait_until", wait_until("fetch_ts", "retry_after"))


def fetch_slots(frontier: DataFrame, delays: DataFrame, start: Column, span: int = SPAN) -> DataFrame:
    """Timetable of the frontier: ``site``, ``norm_url``, ``slot``, ``fetch_at``, spaced by the delay of the site.

    ``frontier`` has ``site``, ``norm_url`` and ``added``; the last added URL comes first. ``delays`` has a row per site.
    """
    ordered = frontier.select("site", "norm_url", (-F.col("added")).alias("__order"))
    placed = numbered(ordered, ["site"], "__order", "slot", span, tie=["norm_url"])
    timed = placed.join(delays.select("site", "delay"), "site")
    seconds = ((F.col("slot") - 1) * F.col("delay")).cast("bigint")
    return timed.select(
        "site", "norm_url", "slot", (start + F.make_dt_interval(secs=seconds)).alias("fetch_at")
    )


def delay_audit(pages: DataFrame, delays: DataFrame, span: int = SPAN) -> DataFrame:
    """Fetches that came too soon after the one before on the same site: ``site``, ``fetch_seq``, ``gap``, ``delay``."""
    spaced = previous(pages.select("site", "fetch_seq", "fetch_ts"), ["site"], "fetch_seq", "fetch_ts", "before", span)
    gap = F.timestamp_diff("SECOND", F.col("before"), F.col("fetch_ts"))
    timed = spaced.filter(F.col("before").isNotNull()).withColumn("gap", gap.cast("bigint"))
    return (
        timed.join(delays.select("site", "delay"), "site")
        .filter(F.col("gap") < F.col("delay"))
        .select("site", "fetch_seq", "gap", "delay")
    )


def site_report(pages: DataFrame, outcome: str = "outcome") -> DataFrame:
    """Totals of each site: pages, kept pages, their bytes and languages (sorted, comma between)."""
    kept = F.col(outcome) == "kept"
    return pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count(F.when(kept, 1)).alias("n_kept"),
        F.coalesce(F.sum(F.when(kept, F.col("n_bytes"))), F.lit(0)).alias("kept_bytes"),
        F.array_join(F.sort_array(F.collect_set(F.when(kept, F.col("lang")))), ",").alias("langs"),
    )
