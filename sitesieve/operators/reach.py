"""URLs reachable from seeds over a stored table of links.

Chains are shortened first: a URL that one page links to and that links to one page itself lies between two others, and doubling the way back
(each URL takes over the way of the URL it points to) brings every one of them to the head of its chain in as many rounds as the logarithm of the longest
chain. What is left are links with a length between the other URLs. These are searched in rounds from the URLs that the round before found or found a shorter way to;
links and found URLs lie in folders by hash, and a round opens only the folders in which its URLs lie.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, functions as F

from ..session import new_path, stage

PARTS = 64
_FOUND = "norm_url string, hops bigint, part int"


def _write_counted(df: DataFrame, path: str) -> int:
    """Write a table by its folders and return its number of rows, counted by the writing tasks."""
    counted = Observation()
    df.observe(counted, F.count(F.lit(1)).alias("n")).write.partitionBy("part").parquet(path)
    return counted.get["n"]


def _part(url: str) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(PARTS)).cast("int")


def _parts_of(df: DataFrame) -> list[int]:
    """The folders in which rows lie; at most ``PARTS`` numbers."""
    return [row["part"] for row in df.select("part").distinct().collect()]


def chains(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """``node``, ``head``, ``d``: every URL inside a chain with the URL from which the chain starts and its distance from there.

    ``edges`` (``src``, ``dst``) are all different. Seeds are never inside a chain. A ring without an entrance has no head and is left out: no way leads
    to it.
    """
    into = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("head")).filter("n = 1")
    onward = edges.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("src").alias("node"))
    inside = into.select(F.col("dst").alias("node"), "head").join(onward, "node")
    inside = inside.join(seeds.select(F.col("norm_url").alias("node")), "node", "left_anti")
    way = stage(inside.withColumn("d", F.lit(1).cast("bigint")), "chains")
    rounds = way.count().bit_length() + 1
    for _ in range(rounds):
        back = way.select(F.col("node").alias("head"), F.col("head").alias("before"), F.col("d").alias("more"))
        moved = way.join(back, "head", "left").select(
            "node", F.coalesce("before", "head").alias("head"), (F.col("d") + F.coalesce("more", F.lit(0))).alias("d"), F.col("before").isNotNull().alias("moved")
        )
        moved = stage(moved, "chains")
        way = moved.drop("moved")
        if moved.filter("moved").isEmpty():
            return way
    # those that still move go round in a ring
    return way.join(way.select(F.col("node").alias("head")), "head", "left_anti").select("node", "head", "d")


def reachable(links: DataFrame, seeds: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """``norm_url`` and ``hops`` from the nearest seed of every URL that seeds lead to, up to ``max_rounds`` hops.

    ``links`` has ``src`` and ``dst``, ``seeds`` has ``norm_url``. Each round is written to the shared folder, so that the plan does not grow and a lost
    executor costs no more than its tasks. Ends when a round finds nothing new.
    """
    spark = links.sparkSession
    edges = stage(links.select("src", "dst").filter("src <> dst").distinct(), "edges")
    first = stage(seeds.select("norm_url").filter("norm_url IS NOT NULL").distinct(), "seeds")
    way = stage(chains(edges, first), "ways")
    ends = edges.join(way.select(F.col("node").alias("dst")), "dst", "left_anti")
    longer = (
        ends.join(way.withColumnRenamed("node", "src"), "src", "left")
        .select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("d", F.lit(0)) + 1).alias("length"))
        .filter("src <> dst")
        .groupBy("src", "dst")
        .agg(F.min("length").alias("length"))
        .withColumn("part", _part("src"))
    )
    path = new_path(spark, "reached")
    longer.hint("rebalance", "part").sortWithinPartitions("part", "src").write.partitionBy("part").parquet(f"{path}/links")
    lengths = spark.read.schema("src string, dst string, length bigint, part int").parquet(f"{path}/links")

    def found(rounds: int) -> DataFrame:
        folders = (f"{path}/found/round={i}" for i in range(rounds + 1))
        return spark.read.schema(f"{_FOUND}, round int").option("basePath", f"{path}/found").parquet(*folders).drop("round")

    here = 0
    start = first.withColumns({"hops": F.lit(0).cast("bigint"), "part": _part("norm_url")})
    n_new = _write_counted(start, f"{path}/found/round=0")
    while n_new > 0:
        newest = spark.read.schema(_FOUND).parquet(f"{path}/found/round={here}")
        open_links = lengths.filter(F.col("part").isin(_parts_of(newest))).drop("part")
        step = open_links.join(newest.select(F.col("norm_url").alias("src"), "hops"), "src").groupBy(F.col("dst").alias("norm_url")).agg(
            F.min(F.col("hops") + F.col("length")).alias("hops")
        )
        if max_rounds is not None:
            step = step.filter(F.col("hops") <= max_rounds)
        step = stage(step.withColumn("part", _part("norm_url")), "step")
        known = found(here).filter(F.col("part").isin(_parts_of(step))).groupBy("norm_url").agg(F.min("hops").alias("__hops"))
        better = step.join(known, "norm_url", "left").filter("__hops IS NULL OR hops < __hops").select("norm_url", "hops", "part")
        here += 1
        n_new = _write_counted(better, f"{path}/found/round={here}")
    reached = stage(found(here).groupBy("norm_url").agg(F.min("hops").alias("hops")), "reached")
    inside = way.join(reached.withColumnRenamed("norm_url", "head"), "head").select(F.col("node").alias("norm_url"), (F.col("hops") + F.col("d")).alias("hops"))
    if max_rounds is not None:
        inside = inside.filter(F.col("hops") <= max_rounds)
    return reached.unionByName(inside)
