"""Line dedup by a deletion-neighbourhood join over words.

Two lines are near if one word inserted, deleted or replaced turns one into the other (edit distance at most 1 over words, white space normalised)
and both have at least ``least`` words; shorter ones match only when equal, as one word of theirs is much of what they say. The query and
``drop_repeated_lines`` ask for ``LEAST`` words.
Each line emits the hash of every variant with one word left out; a replaced word makes two lines of one length meet in the variant without
that word, and a line that is a variant of a longer one meets it as a whole. Pairs are then verified on the words. In a variant of one place all
lines are near each other, so each is linked to the earliest there only, never to all.

Variants are emitted only where they can meet another: a single edit leaves the first or the last ``ANCHOR`` words as they are, so a long line
counts only if another distinct line shares one of the two; and an edit changes one of ``PARTS`` parts of a line, so words are left out only in
parts outside of which the line equals another. Lines are compared once however often they occur.

A line goes if it, or a near line, occurs earlier: by document id (null last), then text key, then place. Blank lines are no lines and always
stay. Null text has none. Rows that repeat id and text are one document, and each gets the same result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import SPACE_CHARS, one_space, text_key, text_of

ANCHOR = 4
# lines up to here may be changed in both anchors by one edit
SHORT = 2 * ANCHOR + 1
PARTS = 4
#: headings, list items and table cells below this many words go only if an equal line occurs earlier
LEAST = 5
#: a table of at most so many rows of two hashes is broadcast; a larger one is joined by sort and merge
BROADCAST_ROWS = 500_000

LINE = ("h1", "h2")


def _words(line: Column) -> Column:
    return F.split(line, " ")


def _hashes(line: Column) -> list[Column]:
    return [F.xxhash64(line).alias("h1"), F.xxhash64(line, F.lit(1)).alias("h2")]


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, key, place, line (white space normalised), h1, h2 of every line with a word."""
    rows = docs.select("doc_id", text_key().alias("key"), F.posexplode(F.split(text_of(), "\n")).alias("place", "raw"))
    line = F.btrim(one_space(F.col("raw")), F.lit(SPACE_CHARS))
    # the generator keeps the line from being computed anew wherever it is used
    rows = rows.select("doc_id", "key", "place", F.explode(F.array(line)).alias("line")).filter("line <> ''")
    return rows.select("*", *_hashes(F.col("line")))


def _place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key", "place")


def _near(a: Column, b: Column) -> Column:
    """Whether word arrays ``a`` (not the shorter one) and ``b`` are within one edit."""
    other = F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y))
    replaced = F.size(F.filter(other, lambda t: t)) <= 1
    at = F.array_position(other, True).cast("int")  # the first difference, at most the last word of a
    removed = F.slice(a, at + 1, F.size(a)) == F.slice(b, at, F.size(b))
    return F.when(F.size(a) == F.size(b), replaced).when(F.size(a) == F.size(b) + 1, F.coalesce(removed, F.lit(False))).otherwise(False)


def _checked(small: DataFrame) -> DataFrame:
    """With a hint to broadcast if the count of its rows allows it."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def _candidates(distinct: DataFrame) -> DataFrame:
    """Lines of ``distinct(h1, h2, first, n, prefix, suffix)`` that can have a near line."""
    anchors = distinct.filter(F.col("n") > 0).select(*LINE, F.explode(F.array(F.xxhash64(F.lit(0), "prefix"), F.xxhash64(F.lit(1), "suffix"))).alias("anchor"))
    shared = anchors.groupBy("anchor").agg(F.count("*").alias("lines")).filter("lines > 1").select("anchor")
    long = anchors.join(shared, "anchor", "left_semi").select(*LINE).distinct()
    return long.union(distinct.filter(F.col("n") <= SHORT).select(*LINE)).distinct()


def _spots(texts: DataFrame) -> DataFrame:
    """(id, n, begin, end, longer, key) for each part of each line in which an edit may lie.

    The key holds what is outside the part. A line of n words meets lines of its own length in the parts of n words, and those of one word less,
    as the longer one, in the parts of n - 1 words, its own part being one word longer.
    """
    words = texts.select("id", _words(F.col("line")).alias("words")).withColumn("n", F.size("words"))
    cut = words.select("id", "words", "n", F.explode(F.array(F.col("n"), F.col("n") - 1)).alias("m")).filter("m > 0")
    cut = cut.select("*", F.explode(F.array(*(F.lit(k) for k in range(PARTS)))).alias("k"))
    begin = F.floor(F.col("m") * F.col("k") / PARTS).cast("int")
    longer = (F.col("n") > F.col("m")).cast("int")
    end = F.floor(F.col("m") * (F.col("k") + 1) / PARTS).cast("int") + longer
    cut = cut.select("id", "words", "n", "m", "k", begin.alias("begin"), end.alias("end"), longer.alias("longer")).filter("begin < end")
    outside = F.xxhash64(
        "m", "k", F.array_join(F.slice("words", F.lit(1), F.col("begin")), " "), F.array_join(F.slice("words", F.col("end") + 1, F.col("n")), " ")
    )
    return cut.select("id", "n", "begin", "end", "longer", outside.alias("key"))


def near_lines(docs: DataFrame, distinct: DataFrame, least: int = 1) -> DataFrame:
    """(h1, h2) of the lines of at least ``least`` words to which an earlier one is near."""
    distinct = distinct.filter(F.col("n") >= least)
    wanted = distinct.join(_candidates(distinct), list(LINE), "left_semi").select(*LINE, "first")
    # numbered in the order of their first place: partitions are in order, and so are the rows in each
    wanted = stage(wanted.orderBy("first").withColumn("id", F.monotonically_increasing_id()), "candidates")
    at = wanted.select(F.col("h1").alias("a1"), F.col("h2").alias("a2"), "first", "id")
    there = lines(docs).join(_checked(at), (F.col("h1") == F.col("a1")) & (F.col("h2") == F.col("a2")))
    there = there.filter(F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("key") == F.col("first.key")) & (F.col("place") == F.col("first.place")))
    # rows that repeat id and text give the same line again
    texts = stage(there.select("id", "line").dropDuplicates(["id"]), "candidate_lines")

    spots = stage(_spots(texts), "spots")
    is_longer = F.col("longer") == 1
    shared = spots.groupBy("key").agg(F.count(F.when(~is_longer, 1)).alias("whole"), F.count(F.when(is_longer, 1)).alias("longer_ones"))
    shared = shared.filter("whole > 1 OR (whole > 0 AND longer_ones > 0)")
    spots = spots.join(shared, "key").filter((~is_longer & (F.col("whole") > 1)) | (is_longer & (F.col("whole") > 0)))
    spots = spots.select("id", "n", "longer", F.explode(F.sequence(F.col("begin"), F.col("end") - 1)).alias("at"))
    words = texts.select("id", _words(F.col("line")).alias("words"))
    left = F.concat(F.slice("words", F.lit(1), F.col("at")), F.slice("words", F.col("at") + 2, F.col("n")))
    variants = spots.distinct().join(words, "id").select("id", "n", "at", "longer", F.xxhash64(F.array_join(left, " ")).alias("variant"))
    variants = stage(variants, "variants")
    # one word replaced: same length, same place, same rest; each is linked to the earliest
    spot = ["variant", "n", "at"]
    whole = variants.filter("longer = 0").select("id", *spot)
    earliest = whole.groupBy(*spot).agg(F.min("id").alias("other"), F.count("*").alias("lines")).filter("lines > 1").drop("lines")
    replaced = whole.join(earliest, spot).filter("id <> other").select("id", "other")
    # one word more or less: a variant is the other line
    own = texts.select(F.xxhash64("line").alias("variant"), F.col("id").alias("shorter"))
    removed = variants.filter("longer = 1").select("id", "variant").join(own, "variant")
    removed = removed.select(F.greatest("id", "shorter").alias("id"), F.least("id", "shorter").alias("other"))
    pairs = replaced.union(removed).distinct()

    both = pairs.join(texts, "id").join(texts.withColumnsRenamed({"id": "other", "line": "text"}), "other")
    a, b = _words(F.col("line")), _words(F.col("text"))
    verified = both.filter(F.when(F.size(a) >= F.size(b), _near(a, b)).otherwise(_near(b, a)))
    return wanted.join(verified.select("id").distinct(), "id", "left_semi").select(*LINE)


def dropped_lines(docs: DataFrame, least: int = 1) -> DataFrame:
    """For every row of ``docs``: doc_id, key, n_lines (with a word), n_dropped and dropped, the places of the lines that go.

    Lines of fewer than ``least`` words go only if an equal one occurs earlier.
    """
    every = lines(docs).select(
        "doc_id", "key", "place", *LINE,
        (F.char_length("line") - F.char_length(F.replace("line", F.lit(" "))) + 1).alias("n"),
        F.xxhash64(F.substring_index("line", " ", ANCHOR)).alias("prefix"),
        F.xxhash64(F.substring_index("line", " ", -ANCHOR)).alias("suffix"),
    )
    every = stage(every, "lines")
    distinct = every.groupBy(*LINE).agg(
        F.min(_place()).alias("first"), F.count("*").alias("times"), *(F.min(c).alias(c) for c in ("n", "prefix", "suffix"))
    )
    distinct = stage(distinct, "distinct_lines")
    near = stage(near_lines(docs, distinct, least), "near_lines").withColumn("near", F.lit(True))
    doomed = distinct.join(near, list(LINE), "left").filter("times > 1 OR near").select(*LINE, "first", F.coalesce("near", F.lit(False)).alias("near"))
    earlier = F.col("near") | (_place() != F.col("first"))
    marked = every.join(doomed, list(LINE), "left").withColumn("goes", F.coalesce(earlier, F.lit(False)))
    # rows that repeat id and text gave their lines twice
    by_doc = (
        marked.select("doc_id", "key", "place", "goes").distinct()
        .groupBy("doc_id", "key")
        .agg(
            F.count("*").alias("n_lines"),
            F.sort_array(F.collect_list(F.when(F.col("goes"), F.col("place")))).alias("dropped"),
        )
        .withColumnsRenamed({"doc_id": "id", "key": "of"})
    )
    rows = docs.select("doc_id", text_key().alias("key"))
    joined = rows.join(by_doc, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left")
    dropped = F.coalesce("dropped", F.array().cast("array<int>"))
    return joined.select(
        "doc_id", "key", F.coalesce("n_lines", F.lit(0).cast("long")).alias("n_lines"),
        F.size(dropped).cast("long").alias("n_dropped"), dropped.alias("dropped"),
    )


def drop_repeated_lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """``docs`` with the lines that go taken out of the texts; a text of which nothing goes stays as it is."""
    gone = dropped_lines(docs, least).filter("n_dropped > 0").select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("dropped").alias("__gone")).distinct()
    rows = docs.withColumn("__own", text_key())
    rows = rows.join(gone, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains("__gone", i)), "\n")
    return rows.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(kept)).select(*docs.columns)
