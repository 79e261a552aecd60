"""Host, public suffix and site of a URL."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import urls
from ..functions.binding import let
from ..functions.tables import TWO_LABEL_SUFFIXES
from ..session import stage

HOST_COLUMNS = ("host", "suffix", "site")
KINDS = ("normal", "wildcard", "exception")
# Rules that are sent with the tasks as hash sets; a published list has about a fifth of them.
RULES_IN_ROW = 50_000
_ADDRESS = r"^(?:\d{1,3}(?:\.\d{1,3}){3}|\[.*\]|)$"


def _suffix_pattern(suffixes: Sequence[str]) -> str:
    """A listed suffix, or a last label that is not a number; matched from the left, so the longest one is found."""
    listed = "".join(re.escape(s) + "|" for s in suffixes)
    return rf"{listed}(?<=\.)[^.\]]*[^.\d\]][^.\]]*"


def suffix_of(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Public suffix of a host, empty for an address or a host of one label that is not a suffix."""
    return F.regexp_extract(host, rf"(?i)(?:^|\.)({_suffix_pattern(suffixes)})$", 1)


def site_of_host(host: Column, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Registered domain: suffix and the label before it; the host itself when there is none."""
    domain = F.regexp_extract(host, rf"(?i)(?:^|\.)([^.]+\.(?:{_suffix_pattern(suffixes)}))$", 1)
    return F.coalesce(F.nullif(domain, F.lit("")), host)


def site_of(url: Column | str, suffixes: Sequence[str] = TWO_LABEL_SUFFIXES) -> Column:
    """Site key of a URL."""
    return site_of_host(F.lower(urls.url_host(url)), suffixes)


def registered_name(site: Column, suffix: Column) -> Column:
    """Site without its suffix; empty for a host that is a suffix itself."""
    rest = F.greatest(F.length(site) - F.length(suffix) - 1, F.lit(0))
    return F.when(suffix == "", site).otherwise(F.left(site, rest))


def subdomain_of(host: Column, site: Column) -> Column:
    """What stands before the site in a host."""
    return F.left(host, F.greatest(F.length(host) - F.length(site) - 1, F.lit(0)))


def with_host_parts(df: DataFrame, norm: str, suffixes: Sequence[str] | DataFrame | None = None) -> DataFrame:
    """Add ``host``, ``suffix`` and ``site`` of a normalised URL; see ``split_host`` for the rest.

    ``suffixes`` is a list of suffixes of several labels (the default table when None), evaluated as an expression, or
    a DataFrame of rules (``suffix``, ``kind``: ``normal``, ``wildcard`` for the rule ``*.suffix``, ``exception`` for
    ``!suffix``), walked inside the row, or joined once where they are very many. Rules that are used several times
    are made ready once by ``prepared``.
    """
    # names of hosts have no case: what they are looked up and grouped by is in lower case
    df = df.withColumn("host", F.lower(urls.host_of(F.col(norm))))
    if isinstance(suffixes, DataFrame):
        suffixes = prepared(suffixes)
    if isinstance(suffixes, SuffixRules):
        return _with_rules(df, suffixes)
    listed = TWO_LABEL_SUFFIXES if suffixes is None else tuple(suffixes)
    host = F.col("host")
    return df.withColumns({"suffix": suffix_of(host, listed), "site": site_of_host(host, listed)})


def split_host(df: DataFrame) -> DataFrame:
    """Add ``name`` and ``subdomain`` to rows with ``host``, ``suffix`` and ``site``."""
    return df.withColumns(
        {
            "name": registered_name(F.col("site"), F.col("suffix")),
            "subdomain": subdomain_of(F.col("host"), F.col("site")),
        }
    )


def suffix_rules(lines: DataFrame) -> DataFrame:
    """Rules from the lines (``value``) of a list in the published format: one rule a line up to the first blank, ``//``
    before a comment, ``*.`` before a wildcard and ``!`` before an exception."""
    rule = F.lower(F.regexp_extract("value", r"^\s*(\S+)", 1))
    rows = lines.select(rule.alias("rule")).filter((F.col("rule") != "") & ~F.startswith("rule", F.lit("//")))
    kind = F.when(F.startswith("rule", F.lit("!")), "exception").when(F.startswith("rule", F.lit("*.")), "wildcard").otherwise("normal")
    return rows.select(F.regexp_replace("rule", r"^(?:!|\*\.)", "").alias("suffix"), kind.alias("kind")).distinct()


def read_suffix_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a public suffix list stored as text."""
    return suffix_rules(spark.read.text(path))


@dataclass(frozen=True)
class SuffixRules:
    """Rules made ready for lookups; one instance serves a whole run."""

    table: DataFrame
    #: labels of the longest rule
    longest: int
    #: rules of each kind, as paths of labels; None where there are more than ``RULES_IN_ROW``
    paths: dict[str, list[str]] | None


def prepared(rules: DataFrame) -> SuffixRules:
    """One row per suffix, staged so that the planner knows how few they are; up to ``RULES_IN_ROW`` of them are fetched."""
    kinds = (F.bool_or(F.col("kind") == kind).alias(f"__{kind}") for kind in KINDS)
    table = stage(rules.groupBy(F.lower("suffix").alias("__rule")).agg(*kinds), "suffix_rules")
    longest = table.agg(F.max(F.size(F.split("__rule", r"\.")))).first()[0] or 1
    rows = table.limit(RULES_IN_ROW + 1).collect()
    paths = None
    if len(rows) <= RULES_IN_ROW:
        paths = {kind: sorted(row["__rule"] for row in rows if row[f"__{kind}"]) for kind in KINDS}
    return SuffixRules(table, longest, paths)


def _tails(host: Column, longest: int) -> Column:
    """The last label of a host, the last two, and so on up to ``longest``: (k, tail)."""
    n = F.least(F.size(F.split(host, r"\.")), F.lit(longest))
    return F.transform(F.sequence(F.lit(1), n), lambda k: F.struct(k.alias("k"), F.call_function("substring_index", host, F.lit("."), -k).alias("tail")))


def _n_labels(normal: Column, wildcard: Column, exception: Column, labels: Column) -> Column:
    """Labels of the suffix, from the longest match of each kind (0 for none)."""
    beyond = F.when((wildcard > 0) & (labels > wildcard), wildcard + 1).otherwise(0)
    return F.when(exception > 0, exception - 1).otherwise(F.greatest(F.lit(1), normal, beyond))


def _with_rules(df: DataFrame, rules: SuffixRules) -> DataFrame:
    """Rules that are few are walked inside the row, label by label from the end, as hash sets in the expression: no join, whatever the longest
    rule. More of them meet the tails of the different hosts in one join, and hosts then their rows."""
    host = F.col("host")
    labels = F.size(F.split(host, r"\."))
    if rules.paths is not None:

        def longest(kind: str, tails: Column) -> Column:
            known = rules.paths[kind]
            if not known:
                return F.lit(0)
            # a wildcard needs one label more
            fits = (lambda t: t["tail"].isin(*known) & (t["k"] < labels)) if kind == "wildcard" else (lambda t: t["tail"].isin(*known))
            return F.coalesce(F.array_max(F.transform(F.filter(tails, fits), lambda t: t["k"])), F.lit(0))

        found = let(_tails(host, rules.longest), lambda tails: F.struct(*(longest(kind, tails).alias(kind) for kind in KINDS)))
        df = df.withColumn("__found", found)
    else:
        tails = df.select("host").filter("host IS NOT NULL").distinct().select("host", F.size(F.split("host", r"\.")).alias("n"), F.inline(_tails(host, rules.longest)))
        best = {
            "normal": F.when(F.col("__normal"), F.col("k")), "wildcard": F.when(F.col("__wildcard") & (F.col("k") < F.col("n")), F.col("k")),
            "exception": F.when(F.col("__exception"), F.col("k")),
        }
        of_host = tails.join(rules.table, F.col("tail") == F.col("__rule")).groupBy("host").agg(
            F.struct(*(F.coalesce(F.max(k), F.lit(0)).alias(kind) for kind, k in best.items())).alias("__found")
        )
        df = df.join(of_host, "host", "left").select(*df.columns, "__found")
    kinds = [F.coalesce(F.col(f"__found.{kind}"), F.lit(0)) for kind in KINDS]
    alone = (labels == 1) & (kinds[0] == 0)
    suffix = F.when(host.rlike(_ADDRESS) | alone, F.lit("")).otherwise(F.expr("substring_index(host, '.', -__n_labels)"))
    registered = F.when(F.col("suffix") == "", host).otherwise(F.expr("substring_index(host, '.', -(__n_labels + 1))"))
    named = df.withColumn("__n_labels", _n_labels(*kinds, labels)).withColumn("suffix", suffix).withColumn("site", registered)
    return named.drop("__n_labels", "__found")
