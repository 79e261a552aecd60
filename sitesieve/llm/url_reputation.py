"""URL filter by an empirical-Bayes reputation of hosts.

Labelled page outcomes (bad or not) are counted by host, and hosts form registered domains, domains suffixes. At each level the rates of
the children scatter around that of their parent; how much beyond chance is estimated over the whole level by the method of
moments and gives the strength of a beta prior whose mean is the parent's own shrunk rate, from suffix to domain to host. A
host is blocked if the lower bound of its posterior rate of bad pages is above a threshold; a host without labelled pages gets the
posterior of its domain, then of its suffix, then of all pages.

Rules of the user (verdict, host, path) come first: a rule fits its host and all subdomains if the path starts with the rule's; the longest wins.

Only narrow rows (id, host, outcome) are counted, with sums before the shuffle, so a host may hold any share of the pages; the joins have one
row per host on the other side. Null URLs and URLs without ``://`` have an empty host and path and are labelled by nothing. Rows that repeat
count as often as they occur, each with a result.
"""

from __future__ import annotations

from collections.abc import Sequence
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

Z = 1.64
THRESHOLD = 0.5
LEVELS = ("suffix", "domain", "host")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + 3, F.length(url))).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), ascii_uppercase, ascii_lowercase)
    return host, F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def parents(host: Column) -> dict[str, Column]:
    """Registered domain (last two labels) and suffix (last label) of a host, its port left out."""
    name = F.regexp_replace(host, r":\d*$", "")
    return {"domain": F.substring_index(name, ".", -2), "suffix": F.substring_index(name, ".", -1)}


def located(pages: DataFrame) -> DataFrame:
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumn("host", host).withColumn("path", path)
    return rows.withColumns({f"__{name}": value for name, value in parents(F.col("host")).items()}).withColumn("__host", F.col("host"))


def _strength(children: DataFrame, by: list[str]) -> float:
    """Strength (alpha + beta) of the priors of a level from how its rates scatter around those of their parents."""
    sums = children.groupBy(*by) if by else children.groupBy()
    groups = sums.agg(
        F.sum("k").alias("k"), F.sum("n").alias("n"), F.count("*").alias("m"),
        F.sum(F.col("k") * F.col("k") / F.col("n")).alias("kk"), F.sum(F.col("n") * F.col("n")).alias("nn"),
    )
    p = F.col("k") / F.col("n")
    spread = p * (1 - p)
    row = groups.agg(
        F.sum(F.col("kk") - F.col("n") * p * p).alias("s"),
        F.sum(spread * (F.col("m") - 1)).alias("a"),
        F.sum(spread * (F.col("n") - F.col("nn") / F.col("n"))).alias("b"),
    ).first()
    s, a, b = (row[x] or 0.0 for x in "sab")
    rho = (s - a) / (b - a) if b - a > 1e-9 else 0.1
    return 1 / min(max(rho, 1e-3), 1 - 1e-3) - 1


def reputation(outcomes: DataFrame, z: float = Z) -> dict[str, DataFrame]:
    """Posterior by level for ``outcomes(url, bad)``: tables of name, n, mean and lower bound of the rate of bad pages, and ``all`` with
    one row."""
    rows = located(outcomes.select("url", "bad")).filter("host <> '' AND bad IS NOT NULL")
    rows = rows.withColumnsRenamed({"__domain": "domain", "__suffix": "suffix"})
    hosts = stage(rows.groupBy("host", "domain", "suffix").agg(F.sum(F.col("bad").cast("double")).alias("k"), F.count("*").cast("double").alias("n")), "host_counts")
    counts = {
        "host": hosts,
        "domain": hosts.groupBy("domain", "suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")),
        "suffix": hosts.groupBy("suffix").agg(F.sum("k").alias("k"), F.sum("n").alias("n")),
    }
    whole = hosts.agg(F.sum("k").alias("k"), F.sum("n").alias("n")).first()
    overall = ((whole["k"] or 0.0) + 1) / ((whole["n"] or 0.0) + 2)
    found: dict[str, DataFrame] = {}
    above: str | None = None
    for level in LEVELS:
        strength = _strength(counts[level], [above] if above else [])
        table = counts[level]
        if above:
            table = table.join(found[above].select(F.col("name").alias(above), F.col("mean").alias("prior")), above)
        else:
            table = table.withColumn("prior", F.lit(overall))
        alpha = F.col("k") + strength * F.col("prior")
        total = F.col("n") + strength
        mean = alpha / total
        bound = mean - z * F.sqrt(mean * (1 - mean) / (total + 1))
        found[level] = stage(table.select(F.col(level).alias("name"), "n", mean.alias("mean"), bound.alias("bound")), f"{level}_reputation")
        above = level
    mean = F.lit(overall)
    found["all"] = hosts.sparkSession.range(1).select(F.lit(whole["n"] or 0.0).alias("n"), mean.alias("mean"), mean.alias("bound"))
    return found


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """Text and verdict of the longest of the ``rules`` (verdict, host, path) that fits; null if none does."""
    text, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, of_host, start in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == of_host) | host.endswith("." + of_host)) & path.startswith(start)
        text, verdict = F.when(fits, of_host + start).otherwise(text), F.when(fits, said).otherwise(verdict)
    return text, verdict


def judge(pages: DataFrame, known: dict[str, DataFrame], rules: Sequence[tuple[str, str, str]] = (), threshold: float = THRESHOLD) -> DataFrame:
    """``pages`` with host, path, rule, bound (posterior bound of the host or of what is known above it) and verdict; columns of
    these names that ``pages`` has are replaced."""
    computed = ("host", "path", "rule", "bound", "verdict")
    rows = located(pages.drop(*computed))
    for level in LEVELS:
        told = known[level].select(F.col("name").alias(f"__known_{level}"), F.col("bound").alias(f"__bound_{level}"))
        rows = rows.join(told, F.col(f"__{level}") == F.col(f"__known_{level}"), "left")
    overall = known["all"].first()["bound"]
    rows = rows.withColumn("bound", F.coalesce("__bound_host", "__bound_domain", "__bound_suffix", F.lit(overall)))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule)
    judged = F.when(F.col("bound") > threshold, "block").otherwise("allow")
    kept = [c for c in pages.columns if c not in computed]
    return rows.withColumn("verdict", F.coalesce(verdict, judged)).select(*kept, *computed)


def outcomes_by_terms(pages: DataFrame, terms: Sequence[str]) -> DataFrame:
    """A weak label for every page with a URL: bad if one of the terms occurs in it, whatever the case."""
    found = F.lit(False)
    for term in terms:
        found = found | F.contains(F.lower("url"), F.lit(term))
    return pages.select("url", found.alias("bad"))
