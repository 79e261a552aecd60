"""Benchmark decontamination as a prefix-filtered set join over item-sized windows.

An item of the benchmark is cut into windows of ``size`` consecutive words (one shorter window if it has fewer). A window occurs in a
document only if all its words do, so the necessary prefix of its words in the order of rarity is one word: the rarest one
in the corpus. Only positions of such prefix words in documents are joined. The place of the word in the window then fixes
where the window would have to start (positional bound), it must fit into the document (length bound), and the words there are
compared with the window's exactly.

Word frequencies are counted over all documents. Windows are broadcast in blocks of at most ``BLOCK`` rows, and the documents
are read once for each block, so nothing that is broadcast grows with the benchmark. Text is not shuffled; only hits are.

Words are runs of digits, letters and characters beyond ASCII, with A-Z lower-cased. Null text has no words. Rows that repeat
get a result each; rows that share an id are told apart by their text. Items that share a window are all counted.
"""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage
from .common import text_key, text_of

# ASCII characters that separate words; capital letters do not, they are lower-cased where words are compared
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 10
BLOCK = 50_000


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, BREAK), "")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the slower way only where there are other characters."""
    plain = F.octet_length(text) == F.char_length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, ascii_uppercase, ascii_lowercase))


def word_hash(word: Column) -> Column:
    """Equal for words that differ only in case; candidates are compared exactly later."""
    return F.xxhash64(F.lower(word))


def windows(items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(item_id, window, length) of every distinct window of every item."""
    words = items.select("item_id", words_of(ascii_lower(text_of())).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(size))
    return words.select(
        "item_id",
        length.alias("length"),
        "words",
        F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"),
    ).select("item_id", F.array_join(F.slice("words", F.col("at"), F.col("length")), " ").alias("window"), "length").distinct()


def _blocks(df: DataFrame, by: str, n: int) -> list[DataFrame]:
    count = -(-n // BLOCK)
    return [df.filter(F.pmod(F.xxhash64(by), F.lit(count)) == i) if count > 1 else df for i in range(count)]


def _word_rows(docs: DataFrame) -> DataFrame:
    """A row for each word of each document."""
    return docs.select("doc_id", "key", "words", F.posexplode("words").alias("pos", "word"))


def frequencies(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """How often each of ``hashes(h)`` occurs in the whole corpus."""
    counted = None
    for block in _blocks(hashes, "h", hashes.count()):
        words = docs.select(F.explode("words").alias("word")).select(word_hash(F.col("word")).alias("h"))
        part = words.join(F.broadcast(block), "h").groupBy("h").agg(F.count("*").alias("df"))
        counted = part if counted is None else counted.union(part)
    return counted


def prefixes(docs: DataFrame, tokens: DataFrame) -> DataFrame:
    """(h, offset, length, window): each window with its rarest word and that word's first place in it."""
    split = F.posexplode(F.split("window", " ")).alias("offset", "word")
    at = tokens.select("window", "length", split).select("window", "length", "offset", word_hash(F.col("word")).alias("h"))
    at = stage(at, "window_words")
    found = frequencies(docs, stage(at.select("h").distinct(), "window_hashes"))
    return (
        at.join(found, "h")
        .groupBy("window", "length")
        .agg(F.min(F.struct("df", "h", "offset")).alias("best"), F.count("*").alias("known"))
        .filter("known = length")  # a window with a word that no document has cannot occur
        .select("window", "length", "best.h", "best.offset")
    )


def hits(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, key, start, stop, item_id's window): every place of a document where a window occurs."""
    corpus = docs.select("doc_id", text_key().alias("key"), words_of(text_of()).alias("words"))
    tokens = stage(windows(items, size).select("window", "length").distinct(), "windows")
    rarest = stage(prefixes(corpus, tokens), "prefixes") if not tokens.isEmpty() else None
    found = None
    for block in _blocks(rarest, "window", rarest.count()) if rarest is not None else []:
        start = F.col("pos") - F.col("offset")
        there = ascii_lower(F.array_join(F.slice("words", start + 1, F.col("length")), " "))
        part = (
            _word_rows(corpus)
            .withColumn("h", word_hash(F.col("word")))
            .join(F.broadcast(block), "h")
            .filter((start >= 0) & (start + F.col("length") <= F.size("words")))
            .filter(there == F.col("window"))
            .select("doc_id", "key", start.alias("start"), (start + F.col("length")).alias("stop"), "window")
        )
        found = part if found is None else found.unionByName(part)
    if found is None:
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = docs.sparkSession.createDataFrame([], f"doc_id {kind}, key long, start int, stop int, window string")
    return found


def _covered(spans: Column) -> Column:
    """Number of positions covered by sorted spans."""
    zero = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n"))
    total = F.aggregate(
        spans,
        zero,
        lambda acc, s: F.struct(
            F.greatest(acc["stop"], s["stop"]).alias("stop"),
            (acc["n"] + F.greatest(s["stop"] - F.greatest(acc["stop"], s["start"]), F.lit(0))).alias("n"),
        ),
    )
    return total["n"]


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """For every row of ``docs``: doc_id, n_words, n_hit (words inside occurrences of windows), n_items and items_sha256 (of the sorted,
    comma-joined item ids with occurring windows) and contaminated."""
    found = stage(hits(docs, items, size), "hits")
    spans = (
        found.groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set(F.struct("start", "stop"))).alias("spans"))
        .select(F.col("doc_id").alias("id"), F.col("key").alias("of"), _covered(F.col("spans")).alias("n_hit"))
    )
    of_items = (
        found.select("doc_id", "key", "window").distinct()
        .join(windows(items, size).select("window", F.col("item_id").cast("string").alias("item")), "window")
        .groupBy("doc_id", "key")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
        .select(F.col("doc_id").alias("id2"), F.col("key").alias("of2"), "items")
    )
    none = F.array().cast("array<string>")
    return (
        docs.select("doc_id", text_key().alias("key"), F.size(words_of(text_of())).cast("long").alias("n_words"))
        .join(spans, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("key") == F.col("of")), "left")
        .join(of_items, F.col("doc_id").eqNullSafe(F.col("id2")) & (F.col("key") == F.col("of2")), "left")
        .withColumn("items", F.coalesce("items", none))
        .select(
            "doc_id",
            "n_words",
            F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
            F.size("items").cast("long").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        )
    )


def drop_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW) -> DataFrame:
    """The rows of ``docs`` in which no window of the benchmark occurs."""
    bad = stage(hits(docs, items, size).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct(), "bad")
    marked = docs.withColumn("__own", text_key())
    clean = marked.join(bad, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__own") == F.col("__key")), "left_anti")
    return clean.select(*docs.columns)
