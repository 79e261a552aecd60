"""Fetched pages as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import content

PAGE_COLUMNS = {
    "fetch_seq": "bigint",
    "url": "string",
    "status": "int",
    "content_type": "string",
    "location": "string",
    "retry_after": "string",
    "headers": "map<string,string>",
    "fetch_ts": "timestamp_ntz",
}
_FROM_HEADERS = {"content_type": "content-type", "location": "location", "retry_after": "retry-after"}


def as_pages(df: DataFrame) -> DataFrame:
    """Bring a table of responses to the page schema.

    ``fetch_seq``, a number of its own for each page, may be called ``page_id``; a page has ``html`` text or ``body`` bytes. A missing status is 200, and
    what the header columns lack is taken from the ``headers`` map. Only columns that a query reads are scanned.
    """
    have = set(df.columns)
    if "fetch_seq" not in have:
        if "page_id" not in have:
            raise ValueError("pages need a number, fetch_seq or page_id")
        df = df.withColumnRenamed("page_id", "fetch_seq")
        have = set(df.columns)
    out = []
    for name, kind in PAGE_COLUMNS.items():
        if name in have and name in _FROM_HEADERS and "headers" in have:
            out.append(F.coalesce(F.col(name), content.header("headers", _FROM_HEADERS[name])).cast(kind).alias(name))
        elif name in have:
            out.append(F.col(name).cast(kind).alias(name))
        elif name in _FROM_HEADERS and "headers" in have:
            out.append(content.header("headers", _FROM_HEADERS[name]).cast(kind).alias(name))
        elif name == "status":
            out.append(F.lit(200).alias(name))
        else:
            out.append(F.lit(None).cast(kind).alias(name))
    out += [F.col(name) for name in ("html", "body", "lang", "encoding") if name in have]
    return df.select(*out)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages of a Parquet file or folder."""
    return as_pages(spark.read.parquet(path))
