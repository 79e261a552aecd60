"""Running language evidence of each site."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_evidence(kept: DataFrame) -> DataFrame:
    """Documents per site and language so far; counted in part before the shuffle, so a large site is no hot spot."""
    return kept.groupBy("site", "lang").agg(F.count(F.lit(1)).alias("n"))


def write_evidence(evidence: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write the changed counts of each batch; a batch that is run again replaces its own folder."""

    def write(changed: DataFrame, batch_id: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    return (
        evidence.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(write)
        .trigger(availableNow=True)
        .start()
    )


def read_evidence(spark: SparkSession, path: str) -> DataFrame:
    """Current counts: those of the last batch that changed them."""
    return spark.read.parquet(path).groupBy("site", "lang").agg(F.max_by("n", "batch_id").alias("n"))
