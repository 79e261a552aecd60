"""Exact duplicates by a tree-merge of sorted digest runs.

Texts are equal when they are identical after every run of ASCII white space has become one space. Each document becomes a
row of digest, second hash, length and id. The digest space is dealt into shards; in each shard the rows of the input partitions
form leaf runs, and runs are merged ``FAN`` at a time in rounds (round r joins the runs whose numbers agree beyond their last r
digits) until one is left. A merge sorts by digest and keeps, for each text, the smallest id, how many rows carry it and the
size of the group, so a group of any size is one row for each run from the leaves on. "Verified": rows are one text only if
SHA-256, an independent 64-bit hash and the length in bytes all agree; texts never travel.

Nulls: a null text is the empty text; null ids come after all others, so a group of nothing else has a null ``keep_id``.
Rows that repeat both id and text: one of them is kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window

from ..session import stage
from .common import one_space, text_of

LEAVES = 64
FAN = 8

SAME = ("digest", "check", "n_bytes")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id and what identifies the normalised text: SHA-256, a second hash and the length in bytes."""
    plain = docs.select("doc_id", one_space(text_of()).alias("plain"))
    return plain.select(
        "doc_id",
        F.sha2("plain", 256).alias("digest"),
        F.xxhash64("plain").alias("check"),
        F.octet_length("plain").cast("long").alias("n_bytes"),
    )


def _smallest(n_of: str) -> list:
    """Smallest id of a group, the rows that carry it and all rows; a null id counts as larger than any other."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id"))
    return [best.alias("best"), F.sum(n_of).alias("n")]


def merge_tree(leaves: DataFrame, shards: int) -> DataFrame:
    """One row per text: the smallest id ``keep_id`` and ``group_size``.

    ``leaves``: digest, check, n_bytes, doc_id, n. The leaf run of a row is the number of its partition; runs of one
    shard meet in rounds.
    """
    shard = F.pmod(F.col("check"), F.lit(shards))
    runs = leaves.select(*SAME, "doc_id", "n", shard.alias("shard"), F.pmod(F.spark_partition_id(), F.lit(LEAVES)).alias("run"))
    left = LEAVES
    while True:
        # equal rows of a run are combined before they are sent, and again where the runs of the round meet
        runs = (
            runs.groupBy("shard", "run", *SAME)
            .agg(*_smallest("n"))
            .select("shard", "run", *SAME, F.col("best.doc_id").alias("doc_id"), "n")
        )
        if left == 1:
            return runs.select(*SAME, F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size"))
        left = -(-left // FAN)
        runs = (
            runs.withColumn("run", F.floor(F.col("run") / FAN).cast("int"))
            .repartition("shard", "run")
            .sortWithinPartitions("shard", "run", *SAME)
        )


def exact_groups(docs: DataFrame) -> DataFrame:
    """For every row of ``docs``: doc_id, digest (lower-case hexadecimal SHA-256 of the normalised text), check, n_bytes,
    keep_id, group_size and kept."""
    spark = docs.sparkSession
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # rows that repeat id and text are one row with a count, so that exactly one of them can be kept
    rows = stage(digests(docs).groupBy("doc_id", *SAME).agg(F.count("*").alias("n")), "digests")
    # the shards keep their rows: only groups of more than one row are looked up
    groups = merge_tree(rows, shards).filter("group_size > 1")
    return (
        rows.join(groups, list(SAME), "left")
        .withColumn("keep_id", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")))
        .withColumn("group_size", F.coalesce("group_size", F.lit(1).cast("long")))
        .select("*", F.posexplode(F.array_repeat(F.lit(0), F.col("n").cast("int"))).alias("nth", "_"))
        .select("doc_id", *SAME, "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("nth") == 0)).alias("kept"))
    )


def drop_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    The ids that go are looked up by the join, which moves only them if they are few. Rows that repeat an id go a second way in which
    each row is told apart by its text.
    """
    spark = docs.sparkSession
    marked = stage(exact_groups(docs), "exact_groups")
    # ids that stand for more than one row: their rows are told apart by digest and number
    several = stage(marked.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL").select("doc_id"), "several")
    gone = marked.filter("NOT kept").select("doc_id")
    plain = docs.join(gone, "doc_id", "left_anti")
    if several.isEmpty():
        return plain.select(*docs.columns)
    plain = plain.join(several, docs["doc_id"].eqNullSafe(several["doc_id"]), "left_anti")
    keys = marked.filter("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__digest"))
    mixed = docs.join(several.withColumnRenamed("doc_id", "__several"), F.col("doc_id").eqNullSafe(F.col("__several")), "left_semi")
    mixed = mixed.withColumn("__text", F.sha2(one_space(text_of()), 256))
    mixed = mixed.join(keys, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__text") == F.col("__digest")), "left_semi")
    first = Window.partitionBy("doc_id", "__text").orderBy("text")
    mixed = mixed.withColumn("__nth", F.row_number().over(first)).filter("__nth = 1")
    return plain.select(*docs.columns).unionByName(mixed.select(*docs.columns))
