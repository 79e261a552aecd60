"""Page language from word profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import content
from ..functions.binding import computed, let
from ..functions.tables import iso_639
from .ordered import top_per_key

PROFILE_WORDS = 200
# A page is reliable when at least 1 word in 20 is a profile word of its best language and the second language has at
# most 9 hits for 10 of the best.
MIN_SHARE = (20, 1)
MAX_RIVAL = (10, 9)
# Largest profile that is sent with the tasks, in words of all its languages.
MODEL_WORDS = 200_000


def train_profiles(
    labelled: DataFrame, langs: Sequence[str], k: int = PROFILE_WORDS, text: str = "text", lang: str = "lang",
    pattern: str = content.WORD,
) -> DataFrame:
    """The ``k`` most frequent words of each of the languages: ``lang``, ``word``, ``n``, ``place``.

    Equal counts are ordered by word. The result has at most ``k * len(langs)`` rows.
    """
    counts = (
        labelled.filter(F.col(lang).isin(*langs))
        .select(F.col(lang).alias("lang"), F.explode(content.words(text, pattern)).alias("word"))
        .groupBy("lang", "word")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return top_per_key(counts, ["lang"], [F.desc("n"), F.asc("word")], k, "place")


def profile_words(profiles: DataFrame, langs: Sequence[str]) -> dict[str, list[str]]:
    """The profile as a model for ``with_language``, all its words; beyond ``MODEL_WORDS`` use ``score_language``."""
    rows = profiles.filter(F.col("lang").isin(*langs)).select("lang", "word").limit(MODEL_WORDS + 1).collect()
    if len(rows) > MODEL_WORDS:
        raise ValueError(f"the profile holds more than {MODEL_WORDS} words")
    model: dict[str, list[str]] = {code: [] for code in sorted(langs)}
    for row in rows:
        model[row["lang"]].append(row["word"])
    return {code: sorted(found) for code, found in model.items()}


def _ranking_entry(hits: Column, lang: Column) -> Column:
    """Struct whose natural order is most hits first, equal hits by code."""
    return F.struct((-hits.cast("bigint")).alias("minus_hits"), lang.alias("lang"))


def _best_two(ranked: Column) -> tuple[Column, Column, Column]:
    """Best language, its hits and the hits of the second language of a sorted array of entries."""
    second = F.coalesce(-F.get(ranked, F.lit(1))["minus_hits"], F.lit(0).cast("bigint"))
    best = F.get(ranked, F.lit(0))
    return best["lang"], -best["minus_hits"], second


def reliable(
    best: Column, second: Column, n_words: Column, min_share: tuple[int, int] = MIN_SHARE,
    max_rival: tuple[int, int] = MAX_RIVAL,
) -> Column:
    return (best > 0) & (best * min_share[0] >= n_words * min_share[1]) & (
        second * max_rival[0] <= best * max_rival[1]
    )


def _sure_best(ranked: Column, n_words: Column, min_share: tuple[int, int], max_rival: tuple[int, int]) -> Column:
    lang, hits, second = _best_two(ranked)
    return F.when(reliable(hits, second, n_words, min_share, max_rival), lang)


def with_language(
    df: DataFrame, html: str, model: Mapping[str, Sequence[str]], name: str = "lang", pattern: str = content.WORD,
    min_share: tuple[int, int] = MIN_SHARE, max_rival: tuple[int, int] = MAX_RIVAL,
) -> DataFrame:
    """Add the language of each page, NULL when unreliable.

    The model is of fixed size and sits in the expression as hash sets, so this is a map over the rows: no explode, no
    shuffle, and wide columns such as the page itself stay where they are.
    """
    def hits(code: str, words: Column) -> Column:
        known = list(model[code])
        return F.size(F.filter(words, lambda word: word.isin(*known)))

    every = sorted({word for known in model.values() for word in known})

    def verdict(words: Column) -> Column:
        def ranked_entries(found: Column) -> Column:
            return F.sort_array(F.array(*(_ranking_entry(hits(code, found), F.lit(code)) for code in sorted(model))))

        # words of no profile go first, so that each language looks only at the rest
        entries = let(F.filter(words, lambda word: word.isin(*every)), ranked_entries)
        return let(entries, lambda ranked: _sure_best(ranked, F.size(words), min_share, max_rival))

    return computed(df, {name: let(content.words(content.visible(html), pattern), verdict)})


def page_words(pages: DataFrame, key: str = "fetch_seq", html: str = "html", pattern: str = content.WORD) -> DataFrame:
    """One row per page and word occurrence, with the number of words of the page."""
    split = pages.select(key, content.words(content.visible(html), pattern).alias("__words"))
    # counted before the explode, so that the array does not travel with every word
    counted = split.withColumn("n_words", F.size("__words"))
    return counted.select(key, "n_words", F.explode("__words").alias("word"))


def score_language(
    words: DataFrame, profiles: DataFrame, langs: Sequence[str], key: str = "fetch_seq"
) -> DataFrame:
    """Hits of each page in each language: ``key``, ``n_words``, ``lang``, ``hits``; for profiles held in a table.

    All words of the profile count. It is broadcast if it has at most ``MODEL_WORDS`` rows; a larger one meets the words
    by a shuffle. In the first case the words of a page sit in one partition, so the partial aggregation leaves a row per
    page and language before anything is shuffled.
    """
    known = profiles.filter(F.col("lang").isin(*langs)).select("lang", "word")
    small = known.limit(MODEL_WORDS + 1).count() <= MODEL_WORDS
    return (
        words.join(F.broadcast(known) if small else known, "word")
        .groupBy(key, "lang")
        .agg(F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("hits"))
        .select(key, "n_words", "lang", "hits")
    )


def word_counts(
    pages: DataFrame, key: str = "fetch_seq", html: str = "html", pattern: str = content.WORD
) -> DataFrame:
    """Number of words of every page: ``key``, ``n_words``."""
    return pages.select(key, F.size(content.words(content.visible(html), pattern)).alias("n_words"))


def pick_language(scores: DataFrame, counts: DataFrame, key: str = "fetch_seq") -> DataFrame:
    """Best language, its hits and the hits of the second: ``key``, ``n_words``, ``best_lang``, ``best_hits``,
    ``second_hits``, ``lang`` (NULL when unreliable), for every page of ``counts``; without a hit there is no best
    language and no hits. A page has one score per language, so its group is small."""
    grouped = scores.groupBy(key).agg(
        F.sort_array(F.collect_list(_ranking_entry(F.col("hits"), F.col("lang")))).alias("__ranked"),
    )
    best_lang, best_hits, second_hits = _best_two(F.col("__ranked"))
    found = counts.select(key, "n_words").join(grouped, key, "left")
    none = F.lit(0).cast("bigint")
    out = found.select(
        key, "n_words", best_lang.alias("best_lang"), F.coalesce(best_hits, none).alias("best_hits"),
        second_hits.alias("second_hits"),
    )
    sure = reliable(F.col("best_hits"), F.col("second_hits"), F.col("n_words"))
    return out.withColumn("lang", F.when(sure, F.col("best_lang")))


def normalise_lang(df: DataFrame, label: str, name: str = "lang", iso: DataFrame | None = None) -> DataFrame:
    """Two-letter code of a label such as ``__label__eng_Latn``, ``fra`` or ``es``; NULL for an unknown one."""
    iso = iso_639(df.sparkSession) if iso is None else iso
    code = F.regexp_extract(F.col(label), r"^(?:__label__)?([a-z]{2,3})(?:_[A-Za-z]{4})?$", 1)
    joined = df.withColumn("__code", code).join(
        iso.select(F.col("alpha3").alias("__code"), F.col("alpha2").alias("__alpha2")), "__code", "left"
    )
    out = F.when(F.length("__code") == 2, F.col("__code")).otherwise(F.col("__alpha2"))
    return joined.withColumn(name, out).drop("__code", "__alpha2")


def keep_langs(df: DataFrame, langs: Sequence[str], lang: str = "lang") -> DataFrame:
    """Pages in one of the languages; pages without a language are dropped."""
    return df.filter(F.col(lang).isin(*langs))
