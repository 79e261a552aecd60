"""State of a run between runs: visited URLs, pending URLs, failed attempts and sites.

Each save is a new version; a marker row written last names it, so a reader never sees half a state and a run can read one version while it writes
the next. A version is a whole state (``save_state``) or the changes of one run (``save_changes``): rows that are new or different, and the keys of rows
that are ``gone``. Loading lays the changes over the whole state before them; after ``COMPACT_EVERY`` changes the next version is written as a
whole again. So a run writes in proportion to what it did, not to all that was ever visited.

Each version also writes a filter of its visited URLs: bits at places taken from a hash of the URL, packed in blocks. ``not_visited`` asks the filter
first; only URLs whose bit is set meet the visited URLs themselves, in the hash ranges (folders) where there are any.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import claim, stage

# tables by the column that spreads them and tells their rows apart
TABLES = {"visited": "norm_url", "pending": "norm_url", "attempts": "norm_url", "sites": "site"}
#: changes that are read one over the other before a whole state is written
COMPACT_EVERY = 8
#: hash ranges of the visited URLs, each a folder
PARTS = 64
#: bits of the filter for each URL of a whole state, at least
BITS_PER_URL = 16
_BLOCK_BITS = 1 << 15
_VERSIONS = "version bigint, delta boolean, filter_bits bigint"


def _versions(spark: SparkSession, path: str) -> list:
    try:
        rows = spark.read.schema(_VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return rows.orderBy("version").collect()


def last_version(spark: SparkSession, path: str) -> int | None:
    known = _versions(spark, path)
    return known[-1].version if known else None


def _part(url: str = "norm_url") -> Column:
    return F.shiftrightunsigned(F.xxhash64(url), 64 - (PARTS - 1).bit_length()).cast("int")


def _place(bits: int, url: str = "norm_url") -> Column:
    """Place of the bit of a URL; ``bits`` is a power of two."""
    return F.xxhash64(url).bitwiseAND(F.lit(bits - 1))


def _begin(spark: SparkSession, path: str) -> int:
    """The number of a new version, which no other writer gets."""
    known = last_version(spark, path)
    version = 0 if known is None else known + 1
    while not claim(spark, f"{path}/_claims/version={version}"):
        version += 1
    return version


def _write(spark: SparkSession, tables: Mapping[str, DataFrame], path: str, version: int, delta: bool, filter_bits: int) -> int:
    for name, key in TABLES.items():
        rows = tables[name]
        target = f"{path}/version={version}/{name}"
        if name == "visited":
            placed = rows.withColumn("part", _part())
            placed.hint("rebalance", "part").sortWithinPartitions("part", "site", key).write.partitionBy("part").mode("overwrite").parquet(target)
        else:
            rows.hint("rebalance").sortWithinPartitions("site", key).write.mode("overwrite").parquet(target)
    written = _read(spark, f"{path}/version={version}/visited", tables["visited"])
    if delta:
        written = written.filter("NOT gone")
    place = _place(filter_bits)
    bits = written.groupBy(F.expr("1").alias("__"), F.floor(place / _BLOCK_BITS).alias("block")).agg(
        F.bitmap_construct_agg(place % _BLOCK_BITS).alias("bits")
    )
    bits.select("block", "bits").write.mode("overwrite").parquet(f"{path}/version={version}/filter")
    marker = spark.range(version, version + 1).select(
        F.col("id").alias("version"), F.lit(delta).alias("delta"), F.lit(filter_bits).cast("bigint").alias("filter_bits")
    )
    marker.write.mode("append").parquet(f"{path}/versions")
    return version


def _read(spark: SparkSession, folder: str, like: DataFrame) -> DataFrame:
    """A written table; one without rows may have no files to take the columns from."""
    columns = ", ".join(f"`{name}` {kind}" for name, kind in like.dtypes if name != "part")
    return spark.read.schema(f"{columns}, part int" if folder.endswith("/visited") else columns).parquet(folder)


def save_state(tables: Mapping[str, DataFrame], path: str) -> int:
    """Save the tables as a whole state and return the version."""
    spark = tables["visited"].sparkSession
    n = tables["visited"].count()
    bits = max(_BLOCK_BITS, 1 << (BITS_PER_URL * n).bit_length())
    return _write(spark, tables, path, _begin(spark, path), False, bits)


def save_changes(changes: Mapping[str, DataFrame], path: str, compact_every: int = COMPACT_EVERY) -> int:
    """Save what a run changed (tables with the column ``gone``) over the last version and return the new one.

    Without an earlier version, and each time ``compact_every`` changes lie over a whole state, the version is a whole state.
    """
    spark = changes["visited"].sparkSession
    known = _versions(spark, path)
    since = 0
    for row in known:
        since = since + 1 if row.delta else 0
    if known and since < compact_every:
        return _write(spark, changes, path, _begin(spark, path), True, known[-1].filter_bits)
    before = load_state(spark, path)
    whole = {}
    for name, key in TABLES.items():
        fresh = changes[name].filter("NOT gone").drop("gone")
        if before is None:
            whole[name] = fresh
        else:
            kept = before[name].join(changes[name].select(key), key, "left_anti").select(*fresh.columns)
            whole[name] = stage(kept.unionByName(fresh), name)
    return save_state(whole, path)


def load_state(spark: SparkSession, path: str, version: int | None = None) -> dict[str, DataFrame] | None:
    """The tables of a version, the last one by default; None when nothing was saved. For ``not_visited``, ``ranges`` are the visited URLs with their hash
    range in ``part``, and ``filter`` the bits of all of them."""
    known = _versions(spark, path)
    version = known[-1].version if version is None and known else version
    if version is None:
        return None
    upto = [row for row in known if row.version <= version]
    base = max(row.version for row in upto if not row.delta)
    deltas = [row.version for row in upto if row.version > base]
    out = {}
    for name, key in TABLES.items():
        whole = spark.read.parquet(f"{path}/version={base}/{name}") if name != "visited" else _visited(spark, f"{path}/version={base}/visited")
        out[name] = whole
        if not deltas:
            continue
        later = None
        for number in deltas:
            folder = f"{path}/version={number}/{name}"
            like = whole.withColumn("gone", F.lit(False))
            rows = _read(spark, folder, like).select(*like.columns).withColumn("__version", F.lit(number))
            later = rows if later is None else later.unionByName(rows)
        others = [c for c in whole.columns if c != key]
        newest = later.groupBy(key).agg(F.max_by(F.struct(*others, "gone"), "__version").alias("now")).select(key, "now.*")
        out[name] = whole.join(later.select(key), key, "left_anti").select(*whole.columns).unionByName(newest.filter("NOT gone").select(*whole.columns))
    out["ranges"] = out["visited"]
    out["visited"] = out["visited"].drop("part")
    filters = [f"{path}/version={number}/filter" for number in (base, *deltas)]
    bits = next(row.filter_bits for row in known if row.version == base)
    out["filter"] = spark.read.schema("block bigint, bits binary").parquet(*filters).withColumn("filter_bits", F.lit(bits))
    return out


def _visited(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema("site string, norm_url string, part int").parquet(folder)


def not_visited(urls: DataFrame, state: Mapping[str, DataFrame]) -> DataFrame:
    """Rows of ``urls`` whose ``norm_url`` the loaded state does not hold as visited.

    A URL without its bit in the filter is new; only the others are looked up, in the hash ranges in which they lie.
    """
    bits = state["filter"].agg(F.max("filter_bits")).first()[0]
    if bits is None:
        return urls
    blocks = state["filter"].groupBy("block").agg(F.bitmap_or_agg("bits").alias("__bits"))
    place = _place(bits)
    asked = urls.withColumns({"__block": F.floor(place / _BLOCK_BITS), "__place": place % _BLOCK_BITS})
    byte = F.substring("__bits", F.floor(F.col("__place") / 8).cast("int") + 1, F.lit(1))
    known = F.conv(F.hex(byte), 16, 10).cast("int")
    is_set = F.expr("(shiftright(__byte, cast(__place % 8 AS int)) & 1) = 1")
    met = asked.join(blocks.withColumnRenamed("block", "__block"), "__block", "left").withColumn("__byte", known)
    marked = stage(met.withColumn("__maybe", F.coalesce(is_set, F.lit(False))).drop("__bits", "__byte", "__block", "__place"), "asked")
    maybe = marked.filter("__maybe")
    parts = [row[0] for row in maybe.select(_part().alias("part")).distinct().collect()]
    exact = state["ranges"].filter(F.col("part").isin(parts)) if parts else None
    found = marked.filter("NOT __maybe")
    if exact is not None:
        found = found.unionByName(maybe.join(exact.select("norm_url"), "norm_url", "left_anti").select(*marked.columns))
    return found.drop("__maybe").select(*urls.columns)
