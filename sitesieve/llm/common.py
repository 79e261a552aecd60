"""Helpers of the training-data operators: row keys, white space, links to components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import stage

# Runs of ASCII white space that are not yet one space; replacing only these gives the same text as replacing every run.
LOOSE_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def text_key(name: str = "text") -> Column:
    """Tells rows of one id with different texts apart; equal for rows that repeat."""
    return F.xxhash64(text_of(name))


def one_space(text: Column) -> Column:
    """Every run of ASCII white space replaced by one space."""
    return F.regexp_replace(text, LOOSE_SPACE, " ")


def word_count(text: Column) -> Column:
    """Number of runs of characters other than ASCII white space."""
    trimmed = F.btrim(text, F.lit(SPACE_CHARS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, SPACE))).cast("long")


def hex16(value: Column) -> Column:
    """A long as 16 lower-case hexadecimal digits, read as unsigned."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def _signature(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*").alias("n"), F.sum(F.shiftright(F.xxhash64("u", "v"), 24)).alias("h")
    ).first()
    return row["n"], row["h"]


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` of every node in ``edges(u, v)``, the root being the smallest node that can be reached.

    Alternates two star operations: each node first points its larger neighbours, then its smaller ones, to the smallest
    node it knows. The number of rounds grows with the logarithm of the longest path. Each round is a written table, so that
    lineage stays short and a lost executor costs one round; only two numbers per round reach the driver. The hub of a large
    star is a hot join key: its side holds the many rows, the other one row for each node, which the adaptive skew join splits.
    """
    edges = stage(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    while before != (now := _signature(edges)):
        before = now
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # what is left in each row is larger first
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
        edges = stage(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")).union(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    )
