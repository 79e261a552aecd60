"""Kept documents and their metadata as files, one run after the other.

A run writes a folder ``run_id=N`` and never touches an earlier one. Its number is claimed first by a file that only one writer can create, so two
writers at once take different numbers; it counts once a marker row names it, so the number of a failed run is left out and a run without documents is a run. Rows are brought together by folder with a rebalancing
shuffle, which sizes its partitions by what it finds and splits those of a very large site. Documents lie in a fixed
number of folders by hash of the site and are sorted by site in each file, so that a reader of one site opens one folder
and skips most row groups there. One folder per site is offered as well, for runs over few sites; a path has one layout.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import claim

SITE_BUCKETS = 32
DOCUMENT_COLUMNS = ("site", "fetch_seq", "norm_url", "status", "content_type", "encoding", "lang", "headers", "html")
# hidden from readers of the documents
MARKERS = "_runs"
CLAIMS = "_claims"


def _bucket(site: Column) -> Column:
    return F.pmod(F.xxhash64(site), F.lit(SITE_BUCKETS)).cast("int")


def _clustered(documents: DataFrame, folder: str) -> DataFrame:
    order = dict.fromkeys([folder, "site", "fetch_seq"])
    return documents.hint("rebalance", folder).sortWithinPartitions(*order)


def runs(spark: SparkSession, path: str) -> DataFrame | None:
    """Finished runs: ``run_id``, ``per_site`` and the columns of the documents; None when there is none."""
    try:
        return spark.read.schema("run_id bigint, per_site boolean, columns string").parquet(f"{path}/{MARKERS}")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def next_run_id(spark: SparkSession, path: str) -> int:
    """One more than the largest finished run, 0 for a new folder. Another writer may get it too: ``claim_run`` makes sure."""
    done = runs(spark, path)
    return 0 if done is None else done.agg(F.max("run_id")).first()[0] + 1


def claim_run(spark: SparkSession, path: str) -> int:
    """A number for a new run that no other writer gets: the first unclaimed one behind the finished runs."""
    run_id = next_run_id(spark, path)
    while not claim(spark, f"{path}/{CLAIMS}/run_id={run_id}"):
        run_id += 1
    return run_id


def write_documents(documents: DataFrame, path: str, run_id: int | None = None, per_site: bool = False) -> int:
    """Append the documents as a new run and return its number; a finished run is never overwritten. A ``run_id`` is one that the caller has claimed
    with ``claim_run``, also to write a failed run again."""
    spark = documents.sparkSession
    done = runs(spark, path)
    if done is not None:
        taken, other = done.agg(
            F.bool_or(F.col("run_id") == run_id) if run_id is not None else F.lit(False), F.bool_or(F.col("per_site") != per_site)
        ).first()
        if taken:
            raise ValueError(f"run {run_id} exists")
        if other:
            raise ValueError(f"the runs in {path} are {'not ' if per_site else ''}laid out per site")
    if run_id is None:
        run_id = claim_run(spark, path)
    rows = documents.select(*(c for c in DOCUMENT_COLUMNS if c in documents.columns))
    folder = "site" if per_site else "site_bucket"
    placed = rows if per_site else rows.withColumn(folder, _bucket(F.col("site")))
    # a folder of this number without its marker is left from a failed run
    _clustered(placed, folder).write.partitionBy(folder).mode("overwrite").parquet(f"{path}/run_id={run_id}")
    columns = ", ".join(f"`{name}` {kind}" for name, kind in rows.dtypes)
    marker = spark.range(run_id, run_id + 1).select(
        F.col("id").alias("run_id"), F.lit(per_site).alias("per_site"), F.lit(columns).alias("columns")
    )
    marker.write.mode("append").parquet(f"{path}/{MARKERS}")
    return run_id


def read_documents(spark: SparkSession, path: str, site: str | None = None) -> DataFrame:
    """Documents of all finished runs, or of one site; the filter on the site prunes folders and reaches the scan."""
    done = [(r["run_id"], r["per_site"], r["columns"]) for r in runs(spark, path).orderBy("run_id").collect()]
    _, per_site, columns = done[-1]
    schema = f"{columns}, run_id int" + ("" if per_site else ", site_bucket int")
    documents = spark.read.schema(schema).parquet(path).filter(F.col("run_id").isin([r[0] for r in done]))
    if site is not None:
        documents = documents.filter(F.col("site") == site)
        if not per_site:
            documents = documents.filter(F.col("site_bucket") == _bucket(F.lit(site)))
    return documents.drop("site_bucket")


def metadata_rows(documents: DataFrame) -> DataFrame:
    """URL, encoding and language of each document."""
    return documents.select(F.col("norm_url").alias("url"), "encoding", "lang")


def write_metadata(documents: DataFrame, path: str, run_id: int, per_site: bool = False) -> None:
    """Tab-separated, gzipped lines of URL, encoding and language."""
    rows = _clustered(documents.select("site", "fetch_seq", "norm_url", "encoding", "lang"), "site")
    columns = [F.col("norm_url").alias("url"), F.col("encoding"), F.col("lang")]
    if per_site:
        columns.insert(0, F.col("site"))
    writer = rows.select(*columns).write.mode("errorifexists").options(sep="\t", compression="gzip", quote="\u0000")
    if per_site:
        writer = writer.partitionBy("site")
    writer.csv(f"{path}/run_id={run_id}")


def write_metadata_of_run(spark: SparkSession, documents: str, path: str, run_id: int, per_site: bool = False) -> None:
    """Metadata of a finished run, from the narrow columns of what it wrote: nothing is evaluated again."""
    write_metadata(read_documents(spark, documents).filter(F.col("run_id") == run_id), path, run_id, per_site)


def read_metadata(spark: SparkSession, path: str, run_id: int) -> DataFrame:
    return spark.read.options(sep="\t", quote="\u0000").schema("url string, encoding string, lang string").csv(
        f"{path}/run_id={run_id}"
    )
