"""Robots rules over a stored table of robots files.

``files`` has ``host``, ``status``, ``body`` and, when a host was read more than once, ``read_seq``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import urls
from ..functions.binding import computed, let

# Statuses of a robots file that allow everything, and the fields that make up its groups.
ALLOW_ALL_STATUS = (400, 404, 406, 410)
KINDS = {
    "user-agent": "agent", "allow": "allow", "disallow": "disallow", "crawl-delay": "delay", "request-rate": "rate",
}


def latest_files(files: DataFrame) -> DataFrame:
    """One file per host, the last one read."""
    order = F.col("read_seq") if "read_seq" in files.columns else F.lit(0)
    newest = F.max(F.struct(order.alias("o"), F.col("status"), F.col("body"))).alias("f")
    return files.groupBy(F.lower("host").alias("host")).agg(newest).select("host", "f.status", "f.body")


def policy_of(status: Column, body: Column) -> Column:
    """``allow``, ``deny`` or ``rules``. A timeout, any other error and an unreadable body deny."""
    return (
        F.when(status.isin(*ALLOW_ALL_STATUS), F.lit("allow"))
        .when(status.between(200, 299) & F.coalesce(F.is_valid_utf8(body.cast("string")), F.lit(False)), F.lit("rules"))
        .otherwise(F.lit("deny"))
    )


def robots_policy(files: DataFrame) -> DataFrame:
    """``host`` and ``policy`` of each host, from its latest file."""
    return latest_files(files).select("host", policy_of(F.col("status"), F.col("body")).alias("policy"))


def _unquoted(c: Column) -> Column:
    """Percent escapes decoded; a text with a broken escape stays as it is."""
    return let(c, lambda t: F.coalesce(F.try_url_decode(F.replace(t, F.lit("+"), F.lit("%2B"))), t))


def robots_rules(files: DataFrame) -> DataFrame:
    """Lines of the groups of each file: ``host``, ``group_no``, ``line_no``, ``kind``, ``value``.

    Comments go, fields match in any case, a run of agent lines starts a group, an empty line ends it, and lines outside
    of groups and groups without rules are dropped. Everything after the aggregation of ``latest_files`` stays in its
    partitioning by host, so files are shuffled once.
    """
    readable = latest_files(files).filter(policy_of(F.col("status"), F.col("body")) == "rules")
    lines = readable.select("host", F.posexplode(F.split(F.col("body").cast("string"), r"\r\n|\n|\r")).alias("line_no", "raw"))
    text = F.trim(F.regexp_replace(F.translate("raw", "\t", " "), "#.*$", ""))
    field = F.lower(F.trim(F.substring_index(text, ":", 1)))
    kind = F.when(F.col("raw") == "", F.lit("blank"))
    for name, short in KINDS.items():
        kind = kind.when(text.contains(":") & (field == name), F.lit(short))
    value = F.trim(F.regexp_replace(text, r"^[^:]*:", ""))
    marked = lines.select("host", "line_no", kind.alias("kind"), value.alias("value")).filter(F.col("kind").isNotNull())
    in_order = Window.partitionBy("host").orderBy("line_no")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, 0)
    is_agent = F.col("kind") == "agent"
    starts = is_agent & (F.coalesce(F.lag("kind").over(in_order), F.lit("blank")) != "agent")
    grouped = (
        marked.withColumn("__starts", starts.cast("int"))
        .withColumn("group_no", F.sum("__starts").over(so_far))
        .withColumn("__agent_line", F.max(F.when(is_agent, F.col("line_no"))).over(so_far))
        .withColumn("__blank_line", F.max(F.when(F.col("kind") == "blank", F.col("line_no"))).over(so_far))
        .filter(
            (F.col("kind") != "blank")
            & (F.col("group_no") > 0)
            & (F.coalesce(F.col("__blank_line"), F.lit(-1)) < F.col("__agent_line"))
        )
    )
    whole_group = Window.partitionBy("host", "group_no")
    has_rules = F.max((~is_agent).cast("int")).over(whole_group) == 1
    return (
        grouped.withColumn("__has_rules", has_rules)
        .filter("__has_rules")
        .select("host", F.col("group_no").cast("int").alias("group_no"), "line_no", "kind", _unquoted(F.col("value")).alias("value"))
    )


def agent_groups(rules: DataFrame, user_agent: str) -> DataFrame:
    """The group that holds for an agent on each host: ``host``, ``group_no``, ``delay``, ``paths``.

    The first group that names the agent (its name is part of the user agent before the first slash), else the first
    group for ``*``. ``paths`` are the allow and disallow lines in order; they come from a single file.
    """
    token = user_agent.split("/")[0].lower()
    kind, value = F.col("kind"), F.col("value")
    path = F.struct(
        F.col("line_no"), ((kind == "allow") | (value == "")).alias("allow"), value.alias("path")
    )
    delay = F.when((kind == "delay") & value.rlike(r"^\d+$"), value.cast("int"))
    groups = rules.groupBy("host", "group_no").agg(
        F.bool_or((kind == "agent") & (value == "*")).alias("for_all"),
        F.bool_or((kind == "agent") & F.lit(token).contains(F.lower(value))).alias("named"),
        F.max_by(delay, F.when(delay.isNotNull(), F.col("line_no"))).alias("delay"),
        F.sort_array(F.collect_list(F.when(kind.isin("allow", "disallow"), path))).alias("paths"),
    )
    rank = F.when(F.col("for_all"), F.lit(1)).when(F.col("named"), F.lit(0))
    best = F.min(F.struct(rank.alias("rank"), F.col("group_no"), F.col("delay"), F.col("paths"))).alias("g")
    return (
        groups.filter(rank.isNotNull()).groupBy("host").agg(best).select("host", "g.group_no", "g.delay", "g.paths")
    )


def robots_lookup(files: DataFrame, user_agent: str) -> DataFrame:
    """All that a fetch decision needs, one row per host: ``host``, ``policy``, ``delay``, ``paths``."""
    chosen = agent_groups(robots_rules(files), user_agent).select("host", "delay", "paths")
    return robots_policy(files).join(chosen, "host", "left")


def robots_target(url: Column | str) -> Column:
    """The part of a normalised URL that rules are matched with."""
    return _unquoted(F.regexp_replace(urls.target_of(url), "^$", "/"))


def robots_allowed(pages: DataFrame, lookup: DataFrame, url: str = "norm_url", name: str = "allowed") -> DataFrame:
    """Add whether the rules of its host allow each URL; a host without a file is denied.

    The rules of a host travel as one array, so each URL meets one row and the first matching prefix is found inside
    the row: no join on prefixes and no aggregation per URL.
    """
    joined = pages.join(lookup.select("host", "policy", "paths"), "host", "left")
    def verdict_on(target: Column) -> Column:
        matches = F.filter("paths", lambda r: target.startswith(r["path"]))
        return F.coalesce(F.get(matches, F.lit(0))["allow"], F.lit(True))

    verdict = let(robots_target(url), verdict_on)
    allowed = F.when(F.col("policy") == "allow", True).when(F.col("policy") == "rules", verdict).otherwise(False)
    return computed(joined, {name: allowed}).drop("policy", "paths")


def robots_delay(rules: DataFrame, user_agent: str) -> DataFrame:
    """Crawl delay of each host that sets one for the agent: ``host``, ``delay``."""
    return agent_groups(rules, user_agent).filter(F.col("delay").isNotNull()).select("host", "delay")


def site_delay(hosts: DataFrame, delays: DataFrame, default: int) -> DataFrame:
    """Delay of each site, the largest of its hosts: ``site``, ``delay``; ``hosts`` has ``host`` and ``site``."""
    joined = hosts.select("host", "site").distinct().join(delays, "host", "left")
    return joined.groupBy("site").agg(F.coalesce(F.max("delay"), F.lit(default)).alias("delay"))
