"""Which links are admitted, and where they go."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..config import SieveConfig
from ..functions import content, urls
from ..functions.binding import computed
from ..session import stage
from .hosts import with_host_parts


# Patterns without a literal part that are tested as one expression.
PATTERNS_AT_ONCE = 2_000
# Characters of the literal parts of patterns by which they are found.
GRAM = 4


def blacklisted(url: Column | str, patterns: Sequence[str]) -> Column:
    """Does any of the patterns match anywhere in the normalised URL?"""
    url = F.col(url) if isinstance(url, str) else url
    return url.rlike(urls.any_pattern(patterns)) if patterns else F.lit(False)


def required_literals(pattern: Column | str) -> Column:
    """Literal parts that every match of a pattern contains; none where that cannot be told (groups, alternatives, flags).

    What stands in brackets, escaped classes, anchors and the dot end a part; an escaped sign is itself; a character that may be missing or
    is counted does not belong to a part.
    """
    pattern = F.col(pattern) if isinstance(pattern, str) else pattern
    # escaped signs become characters of their own, below the ones that text holds, and come back in the end
    signs = r"\./-?+*^$[]{}"
    plain = pattern
    for i, sign in enumerate(signs):
        plain = F.replace(plain, F.lit("\\" + sign), F.lit(chr(1 + i)))
    back = "".join(chr(1 + i) for i in range(len(signs)))
    parts = F.regexp_replace(plain, r"\[\^?\]?[^\]]*\]", "\x1f")
    parts = F.regexp_replace(parts, r"\\.|[.^$]", "\x1f")
    parts = F.regexp_replace(parts, r"(?s).(?:[?*+]|\{[^}]*\})+", "\x1f")
    found = F.filter(F.split(F.translate(parts, back, signs), "\x1f"), lambda part: F.length(part) >= GRAM)
    unsure = pattern.rlike(r"[\x00-\x1f]") | plain.rlike(r"[(|]|&&|\[[^\]]*\[|\\[QExucpPkN0]")
    return F.when(unsure, F.array().cast("array<string>")).otherwise(found)


def _grams(text: Column) -> Column:
    """The different runs of ``GRAM`` characters of a text, hashed."""
    starts = F.sequence(F.lit(1), F.length(text) - GRAM + 1)
    hashed = F.transform(starts, lambda i: F.xxhash64(F.substring(text, i, F.lit(GRAM))))
    return F.when(F.length(text) >= GRAM, F.array_distinct(hashed)).otherwise(F.array().cast("array<bigint>"))


def pattern_index(patterns: DataFrame) -> DataFrame:
    """``gram``, ``pattern``, ``literal`` of every pattern with a literal part: the gram of its parts that the fewest patterns have."""
    literals = patterns.select("pattern", F.explode(required_literals("pattern")).alias("literal"))
    grams = literals.select("pattern", "literal", F.explode(_grams(F.col("literal"))).alias("gram"))
    shared = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
    best = grams.join(shared, "gram").groupBy("pattern").agg(F.min(F.struct("n", "gram", "literal")).alias("best"))
    return best.select("best.gram", "pattern", "best.literal")


def drop_blacklisted(links: DataFrame, patterns: Sequence[str] | DataFrame, url: str = "norm_url") -> DataFrame:
    """Links that no pattern matches. ``patterns`` is a list, or a table with a column ``pattern`` of any length.

    The patterns of a table are found through an index: a match holds the literal parts of its pattern, so the grams of the different URLs meet the one
    gram by which each pattern is listed, and only then the pattern is tried. Patterns without a literal part are tested on every URL,
    ``PATTERNS_AT_ONCE`` as one expression. No pattern passes through the driver; the index is broadcast only below the planner's threshold.
    """
    if not isinstance(patterns, DataFrame):
        return links.filter(~blacklisted(url, patterns))
    known = stage(patterns.select("pattern").filter("pattern IS NOT NULL").distinct(), "patterns")
    index = stage(pattern_index(known), "pattern_index")
    asked = links.select(F.col(url).alias("__url")).filter("__url IS NOT NULL").distinct()
    met = asked.select("__url", F.explode(_grams(F.col("__url"))).alias("gram")).join(index, "gram")
    # the literal is looked for first, which is cheaper than the pattern
    bad = met.filter(F.contains("__url", "literal")).filter(F.rlike("__url", F.col("pattern"))).select("__url").distinct()
    left = links.join(stage(bad, "blacklisted"), F.col(url) == F.col("__url"), "left_anti")
    rest = stage(known.join(index, "pattern", "left_anti"), "patterns_without_literal")
    blocks = -(-rest.count() // PATTERNS_AT_ONCE)
    for i in range(blocks):
        block = rest.filter(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == i)
        whole = block.agg(F.array_join(F.sort_array(F.collect_list(F.concat(F.lit("(?:"), "pattern", F.lit(")")))), "|").alias("any")).select(
            F.nullif("any", F.lit("")).alias("any")
        )
        left = left.filter(~F.coalesce(F.rlike(F.col(url), whole.scalar()), F.lit(False)))
    return left


def with_link_parts(links: DataFrame, suffixes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Add ``norm_url`` and the host columns of each ``link``."""
    return with_host_parts(computed(links, {"norm_url": urls.norm_url("link")}), "norm_url", suffixes)


def link_class(site: Column, suffix: Column, parent_site: Column, tlds: Sequence[str]) -> Column:
    """``same_site``, ``other_site`` under an accepted suffix, or ``rejected``; the whole suffix must be listed."""
    other = suffix.isin(*tlds) if tlds else F.lit(False)
    return F.when(site == parent_site, F.lit("same_site")).when(other, F.lit("other_site")).otherwise(F.lit("rejected"))


def classify_links(links: DataFrame, tlds: Sequence[str]) -> DataFrame:
    return links.withColumn("link_class", link_class(F.col("site"), F.col("suffix"), F.col("parent_site"), tlds))


def admit_links(links: DataFrame, config: SieveConfig) -> DataFrame:
    """Add ``reason`` to links that have ``link``, ``norm_url`` and the host columns.

    The tests run in this order: valid (``empty``, ``too_long``, ``prefix``, ``scheme``), ``depth``, ``blacklist``,
    then ``same_site``, ``other_site`` or ``tld``. Links with one of the two sites as reason are admitted.
    """
    problem = urls.problem_of(F.col("link"), F.col("norm_url"), F.col("host"), config.prefix_filter)
    where = link_class(F.col("site"), F.col("suffix"), F.col("parent_site"), config.accepted_tlds)
    later = (
        F.when(urls.depth_of("norm_url") > config.max_folder_tree_depth, F.lit("depth"))
        .when(blacklisted("norm_url", config.url_blacklist), F.lit("blacklist"))
        .when(where == "rejected", F.lit("tld"))
        .otherwise(where)
    )
    return computed(links, {"reason": F.coalesce(F.nullif(problem, F.lit("ok")), later)})


def admitted(links: DataFrame) -> DataFrame:
    return links.filter(F.col("reason").isin("same_site", "other_site"))


def redirect_links(pages: DataFrame) -> DataFrame:
    """Targets of redirects as links, in the columns of ``page_links``; a relative target starts from the page."""
    moved = pages.filter((content.status_action("status") == "redirect") & F.col("location").isNotNull())
    return moved.select(
        "fetch_seq",
        F.col("norm_url").alias("parent_url"),
        F.col("site").alias("parent_site"),
        F.col("location").alias("href"),
        urls.strip_fragment(urls.resolve("location", "norm_url")).alias("link"),
    )
