"""Page and document streams from folders of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_parquet(
    spark: SparkSession, path: str, schema: StructType, max_files: int | None = None, glob: str | None = None
) -> DataFrame:
    """Stream of the Parquet files that are in a folder or arrive in it."""
    reader = spark.readStream.schema(schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    if glob is not None:
        reader = reader.option("pathGlobFilter", glob)
    return reader.parquet(path)


def stream_table(spark: SparkSession, folder: str, name: str, schema: StructType) -> DataFrame:
    """Stream of a Parquet table, which is a folder of files or one file next to those of other tables."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream_parquet(spark, path.toString(), schema)
    # a stream is read from folders only
    return stream_parquet(spark, folder, schema, glob=f"{name}.parquet")
