"""Seed URLs from a list or from a file with one URL per line."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.ordered import numbered_overall


def read_seeds(spark: SparkSession, path: str | None = None, urls: Sequence[str] | None = None) -> DataFrame:
    """Rows of ``seed_seq`` (arrival order, with gaps where lines are blank) and ``url``, blanks around the URL removed.

    A file takes precedence over a list, and at least one of them is needed. A folder of part files arrives in the order of their names, and lines in that
    of their file, in whatever order and pieces Spark reads them.
    """
    if path is not None:
        lines = spark.read.text(path).select(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("offset"),
            F.monotonically_increasing_id().alias("line"),
            F.trim("value").alias("url"),
        )
        numbered = numbered_overall(lines, "file", "seed_seq", tie=["offset", "line"])
        return numbered.select((F.col("seed_seq") - 1).alias("seed_seq"), "url").filter(F.length("url") > 0)
    if urls is None:
        raise ValueError("seeds need a path or a list of URLs")
    rows = [(i, u.strip()) for i, u in enumerate(urls) if u.strip()]
    return spark.createDataFrame(rows, "seed_seq bigint, url string")
