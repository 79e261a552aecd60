"""Stopping a site early: judge it by its first kept documents.

``kept`` has ``site``, ``lang``, ``fetch_seq``; documents of a site are ordered by ``fetch_seq``. The usual scout counts languages in a number of
documents; a ``SitePolicy`` folds any column of the documents into a state of the site and says when that is enough to judge.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..config import SieveConfig
from .ordered import SPAN, top_per_key

# A policy turns the columns ``n_steps``, ``n_langs`` and ``n_mandatory`` of a site into "keep crawling".
Policy = Callable[[SieveConfig], Column]


def scout_steps(kept: DataFrame, steps: int) -> DataFrame:
    """The first ``steps`` kept documents of each site, numbered in ``step``."""
    narrow = kept.select("site", "lang", "fetch_seq")
    return top_per_key(narrow, ["site"], [F.asc("fetch_seq")], steps, "step")


def lang_evidence(steps: DataFrame) -> DataFrame:
    """Documents per site and language: ``site``, ``lang``, ``n``."""
    return steps.groupBy("site", "lang").agg(F.count(F.lit(1)).alias("n"))


def mandatory_percent(config: SieveConfig) -> Column:
    """Share of the mandatory language in the configured number of steps, cut to a whole number."""
    return F.expr(f"n_mandatory * 100 div {config.scout_steps}")


def languages_policy(config: SieveConfig) -> Column:
    """Enough languages, and enough of the mandatory one if there is one."""
    enough = F.col("n_langs") >= config.min_langs_in_site
    if config.mandatory_lang is None:
        return enough
    return (
        enough
        & (F.col("n_mandatory") > 0)
        & (mandatory_percent(config) >= config.min_percent_mandatory_lang)
    )


def scout_counts(steps: DataFrame, config: SieveConfig) -> DataFrame:
    """What a policy looks at, one row per site."""
    per_lang = steps.groupBy("site", "lang").agg(F.count(F.lit(1)).alias("n"), F.max("fetch_seq").alias("last"))
    mandatory = F.lit(False) if config.mandatory_lang is None else F.col("lang") == config.mandatory_lang
    return per_lang.groupBy("site").agg(
        F.sum("n").alias("n_steps"),
        F.count(F.lit(1)).alias("n_langs"),
        F.sum(F.when(mandatory, F.col("n")).otherwise(F.lit(0))).alias("n_mandatory"),
        F.max("last").alias("last_seq"),
    )


def scout_decision(steps: DataFrame, config: SieveConfig, policy: Policy = languages_policy) -> DataFrame:
    """Verdict on each site: the counts, ``judged``, ``keep`` and ``stop_seq`` (set only for a rejected site).

    A site with fewer kept documents than steps is not judged and is kept.
    """
    judged = F.col("n_steps") >= config.scout_steps
    decided = scout_counts(steps, config).withColumn("judged", judged)
    decided = decided.withColumn("keep", ~F.col("judged") | policy(config))
    return decided.withColumn("stop_seq", F.when(~F.col("keep"), F.col("last_seq"))).drop("last_seq")


def apply_stops(rows: DataFrame, stops: DataFrame) -> DataFrame:
    """Rows of each site up to its ``stop_seq``, the deciding row included; sites without a stop are untouched.

    Works for pages and for links alike. Only stopped sites take part in the join.
    """
    cuts = stops.filter(F.col("stop_seq").isNotNull()).select(
        F.col("site").alias("__site"), F.col("stop_seq").alias("__stop")
    )
    late = (rows["site"] == cuts["__site"]) & (rows["fetch_seq"] > cuts["__stop"])
    return rows.join(cuts, late, "left_anti")


def run_scout(kept: DataFrame, config: SieveConfig, policy: Policy = languages_policy) -> DataFrame:
    """Kept documents that remain after the scout."""
    decisions = scout_decision(scout_steps(kept, config.scout_steps), config, policy)
    return apply_stops(kept, decisions)


MERGES = ("sum", "min", "max", "distinct")


@dataclass(frozen=True)
class Measure:
    """One number in the state of a site: what each document gives (an expression over its columns) and how that is merged.

    ``sum``, ``min`` and ``max`` of whole numbers, or ``distinct``: how many different values there were. Null gives nothing.
    """

    each: str
    merge: str = "sum"

    def __post_init__(self) -> None:
        if self.merge not in MERGES:
            raise ValueError(f"merge is one of {MERGES}")


# From the state, by name, to a condition: of columns in a batch, of arrays on a stream. Comparisons, + - * and & | ~ work on both.
Condition = Callable[[Mapping[str, Any]], Any]


@dataclass(frozen=True)
class SitePolicy:
    """How a site is judged: its state after each document, when that state is ``ready``, and whether it speaks for going on (``keep``).

    The first document at which the state is ready decides, and stays; later ones change nothing. ``ready`` has to stay true once it is, as
    it does where it asks sums and counts to reach a value.
    """

    measures: Mapping[str, Measure]
    ready: Condition
    keep: Condition


def language_policy(config: SieveConfig) -> SitePolicy:
    """The usual scout as a policy."""
    wanted = "false" if config.mandatory_lang is None else f"lang = '{config.mandatory_lang}'"
    measures = {"n_steps": Measure("1"), "n_langs": Measure("lang", "distinct"), "n_mandatory": Measure(f"cast({wanted} AS bigint)")}

    def keep(state: Mapping[str, Any]) -> Any:
        enough = state["n_langs"] >= config.min_langs_in_site
        if config.mandatory_lang is None:
            return enough
        # the share is cut to a whole number before it is compared
        share = state["n_mandatory"] * 100 >= config.min_percent_mandatory_lang * config.scout_steps
        return enough & (state["n_mandatory"] > 0) & share

    return SitePolicy(measures, lambda state: state["n_steps"] >= config.scout_steps, keep)


def measured(kept: DataFrame, policy: SitePolicy) -> DataFrame:
    """Add what each document gives to the state of its site, in columns named like the measures."""
    kinds = {name: "string" if m.merge == "distinct" else "bigint" for name, m in policy.measures.items()}
    return kept.withColumns({name: F.expr(m.each).cast(kinds[name]) for name, m in policy.measures.items()})


def _merge(policy: SitePolicy, name: str) -> Column:
    return {"sum": F.sum, "min": F.min, "max": F.max, "distinct": F.sum}[policy.measures[name].merge](name)


def policy_decision(rows: DataFrame, policy: SitePolicy, span: int = SPAN) -> DataFrame:
    """Verdict on each site from its documents with their measures (see ``measured``): ``site``, the state that was judged (or the last
    one), ``judged``, ``keep`` and ``stop_seq`` (set only for a rejected site).

    States are merged per site and block of ``span`` numbers first, with partial aggregation, and run over the block summaries; only the one block of a
    site in which its state becomes ready is looked at row by row. A new value of a ``distinct`` measure is a row that adds one, so no set
    of values is ever held, and a site of any size is spread.
    """
    names = list(policy.measures)
    rows = rows.select("site", "fetch_seq", *names)
    for name in names:
        if policy.measures[name].merge == "distinct":
            first = rows.filter(F.col(name).isNotNull()).groupBy("site", name).agg(F.min("fetch_seq").alias("fetch_seq"))
            new = first.groupBy("site", "fetch_seq").agg(F.count(F.lit(1)).alias("__new"))
            rows = rows.join(new, ["site", "fetch_seq"], "left").withColumn(name, F.coalesce("__new", F.lit(0))).drop("__new")
    rows = rows.withColumn("__block", F.expr(f"fetch_seq div {span}"))
    sums = [n for n in names if policy.measures[n].merge in ("sum", "distinct")]
    blocks = rows.groupBy("site", "__block").agg(*(_merge(policy, n).alias(n) for n in names), F.max("fetch_seq").alias("__last"))
    blocks = blocks.na.fill(0, sums) if sums else blocks
    upto = Window.partitionBy("site").orderBy("__block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("site").orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    run = blocks.select(
        "site", "__block", *(_merge(policy, n).over(upto).alias(n) for n in names), *(_merge(policy, n).over(before).alias(f"__{n}") for n in names),
        F.row_number().over(Window.partitionBy("site").orderBy(F.desc("__block"))).alias("__from_end"),
    )

    def ready(columns: Mapping[str, Column]) -> Column:
        return F.coalesce(policy.ready(columns), F.lit(False))

    run = run.withColumn("__ready", ready({n: F.col(n) for n in names}))
    first_ready = F.row_number().over(Window.partitionBy("site", "__ready").orderBy("__block"))
    run = run.withColumn("__nth", F.when(F.col("__ready"), first_ready))
    crossing = run.filter("__nth = 1").select("site", "__block", *(f"__{n}" for n in names))
    inside = Window.partitionBy("site").orderBy("fetch_seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)

    def so_far(name: str) -> Column:
        here, start = _merge(policy, name).over(inside), F.col(f"__{name}")
        if policy.measures[name].merge in ("min", "max"):
            # of these, one that is null does not count
            return (F.least if policy.measures[name].merge == "min" else F.greatest)(here, start)
        return F.coalesce(here, F.lit(0)) + F.coalesce(start, F.lit(0))

    near = rows.join(crossing, ["site", "__block"]).select("site", "fetch_seq", *(so_far(n).alias(n) for n in names))
    near = near.filter(ready({n: F.col(n) for n in names}))
    judged = near.groupBy("site").agg(F.min_by(F.struct("fetch_seq", *names), "fetch_seq").alias("at")).select("site", "at.*")
    keeps = F.coalesce(policy.keep({n: F.col(n) for n in names}), F.lit(False))
    judged = judged.select("site", *names, F.lit(True).alias("judged"), keeps.alias("keep"), F.when(~keeps, F.col("fetch_seq")).alias("stop_seq"))
    never = run.filter("__from_end = 1").filter(~F.col("__ready"))
    open_still = never.select("site", *names, F.lit(False).alias("judged"), F.lit(True).alias("keep"), F.lit(None).cast("bigint").alias("stop_seq"))
    return judged.unionByName(open_still)


def run_policy(kept: DataFrame, policy: SitePolicy) -> DataFrame:
    """Kept documents that remain after the scout of a policy."""
    return apply_stops(kept, policy_decision(measured(kept, policy), policy))
