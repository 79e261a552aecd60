"""Language of texts from the likelihood of their character trigrams, for short texts and scripts without blanks too.

A text is lower-cased, everything that is neither letter nor mark becomes one blank, and a blank stands at either end. Each run of three characters
falls into one of ``BINS`` bins. A language is the count of its bins in labelled text; its weights are logarithms of the smoothed shares, in thousandths
and whole, so that sums do not depend on their order. The model has the same size whatever it is trained on.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.binding import computed, let

BINS = 4093
# A language is sure when it is twenty times as likely as the second one, in thousandths of the logarithm.
MARGIN = 2996


def bins(text: Column | str) -> Column:
    """Bins of the trigrams of a text in order; none for NULL and texts without a letter. The time is linear in the text."""
    text = F.col(text) if isinstance(text, str) else text
    letters = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{M}]+", " "))
    codes = F.transform(F.split(F.concat(F.lit(" "), letters, F.lit(" ")), ""), lambda c: F.ascii(c).cast("bigint"))

    def of(codes: Column) -> Column:
        def bin_at(i: Column) -> Column:
            return ((F.get(codes, i) * 961 + F.get(codes, i + 1) * 31 + F.get(codes, i + 2)) % BINS).cast("int")

        # two blanks alone are no trigram, and a sequence cannot be empty
        return F.when(F.size(codes) < 3, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(F.size(codes) - 3, F.lit(0))), bin_at))

    return let(codes, of)


def train_grams(labelled: DataFrame, langs: Sequence[str], text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts of bins by language: ``lang``, ``bin``, ``n``. At most ``BINS`` rows a language leave a task, and counts of parts add up."""
    found = labelled.filter(F.col(lang).isin(*langs)).select(F.col(lang).alias("lang"), F.explode(bins(text)).alias("bin"))
    return found.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))


def gram_weights(counts: DataFrame, langs: Sequence[str]) -> dict[str, list[int]]:
    """Weight of each bin in each language that has counts; reads at most ``BINS`` rows a language."""
    seen: dict[str, dict[int, int]] = {}
    for row in counts.filter(F.col("lang").isin(*langs)).groupBy("lang", "bin").agg(F.sum("n").alias("n")).collect():
        seen.setdefault(row["lang"], {})[row["bin"]] = row["n"]
    out = {}
    for code, found in sorted(seen.items()):
        total = sum(found.values()) + BINS
        out[code] = [round(1000 * math.log((found.get(k, 0) + 1) / total)) for k in range(BINS)]
    return out


def with_gram_language(
    df: DataFrame, text: Column | str, model: Mapping[str, Sequence[int]], name: str = "lang", margin: int = MARGIN
) -> DataFrame:
    """Add ``name``, the most likely language (NULL when not sure), and ``<name>_best``, ``<name>_margin``, ``<name>_grams``: that language in any case,
    its lead over the second (over nothing if there is one language only: 0) and the number of trigrams.

    Equal likelihoods go by code. Without a trigram there is no language and the lead is 0. A map over the rows: weights are constants of the expression.
    """
    def score(found: Column, weights: Sequence[int]) -> Column:
        table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<int>")
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda total, k: total + F.get(table, k))

    def verdict(found: Column) -> Column:
        entries = F.array(*(F.struct((-score(found, w)).alias("cost"), F.lit(code).alias("lang")) for code, w in sorted(model.items())))

        def of(ranked: Column) -> Column:
            best, second = F.get(ranked, F.lit(0)), F.get(ranked, F.lit(1))
            lead = F.coalesce(second["cost"] - best["cost"], F.lit(0).cast("bigint"))
            empty = F.size(found) == 0
            return F.struct(
                F.when(~empty & (lead >= margin), best["lang"]).alias("sure"), F.when(~empty, best["lang"]).alias("best"),
                lead.alias("lead"), F.size(found).cast("bigint").alias("grams"),
            )

        return let(F.sort_array(entries), of)

    whole = computed(df, {"__verdict": let(bins(text), verdict)})
    v = F.col("__verdict")
    return whole.withColumns({name: v["sure"], f"{name}_best": v["best"], f"{name}_margin": v["lead"], f"{name}_grams": v["grams"]}).drop("__verdict")
