"""Links of a page stream, each URL admitted once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import SieveConfig
from ..operators import links, pages as page_ops


def stream_frontier(
    pages: DataFrame, config: SieveConfig, suffixes: Sequence[str] | None = None, event_time: str | None = None,
    delay: str = "1 day",
) -> DataFrame:
    """Admitted links of a page stream: ``norm_url``, ``site``, ``reason``, each URL once.

    State is keyed on the URL and spread over all partitions. With ``event_time`` a URL is remembered for ``delay`` only,
    which bounds the state: it may then be admitted again later.
    """
    if event_time is not None:
        pages = pages.withWatermark(event_time, delay)
    carried = [] if event_time is None else [event_time]
    arrays = page_ops.link_arrays(page_ops.with_site(pages, suffixes), carried)
    found = links.with_link_parts(page_ops.explode_links(arrays, carried), suffixes)
    kept = links.admitted(links.admit_links(found, config)).select("norm_url", "site", "reason", *carried)
    if event_time is None:
        return kept.dropDuplicates(["norm_url"])
    return kept.dropDuplicatesWithinWatermark(["norm_url"]).drop(event_time)


def write_frontier(frontier: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is available to a Parquet folder; started again with the same checkpoint it goes on from there."""
    return (
        frontier.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
