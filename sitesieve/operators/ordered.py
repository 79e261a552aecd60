"""Ordered computations per key that stay spread over the cluster when one key holds a large share of the rows.

A plain window per key sends every row of a key to one task. The functions here first cut each key into blocks of
``span`` consecutive sequence numbers, summarise the blocks (with map-side aggregation), run the window over the small
block summaries, and only then work inside single blocks. With unique sequence numbers a block holds at most ``span``
rows, whatever the key holds, and the summaries are smaller than the rows by about that factor. Where numbers repeat and
other columns decide between equal ones, blocks are instead the parts of a range partitioning by key, number and those
columns, written out once: they are of about the same size, however many rows share a number.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import stage

SPAN = 1 << 18
SPREAD = 64
# Up to here one window cuts each key before it is shuffled (the planner's own limit for that).
WINDOW_LIMIT = 1000

_BLOCK = "__block"


def _block(seq: str, span: int) -> Column:
    return F.expr(f"`{seq}` div {span}")


def ranged_blocks(df: DataFrame, keys: Sequence[str], seq: str, tie: Sequence[str]) -> DataFrame:
    """Blocks in the order of key, ``seq`` and ``tie`` that are about equal in size."""
    ranged = df.repartitionByRange(*keys, seq, *tie)
    return stage(ranged.withColumn(_BLOCK, F.spark_partition_id()), "ranged")


def running_before(
    df: DataFrame, keys: Sequence[str], seq: str, value: Column, name: str, span: int = SPAN, tie: Sequence[str] = ()
) -> DataFrame:
    """Add the sum of ``value`` over the earlier rows of the key (0 for the first); ``value`` is a whole number.

    ``seq`` orders the rows of a key, ``tie`` the rows of equal ``seq``.
    """
    keys = list(keys)
    rows = df.withColumn("__value", value.cast("bigint"))
    if tie:
        rows = ranged_blocks(rows, keys, seq, tie)
    else:
        rows = rows.withColumn(_BLOCK, _block(seq, span))
    earlier_blocks = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        rows.groupBy(*keys, _BLOCK)
        .agg(F.sum("__value").alias("__total"))
        .select(*keys, _BLOCK, F.coalesce(F.sum("__total").over(earlier_blocks), F.lit(0)).alias("__start"))
    )
    earlier_rows = (
        Window.partitionBy(*keys, _BLOCK).orderBy(seq, *tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    return (
        rows.join(starts, [*keys, _BLOCK])
        .withColumn(name, F.col("__start") + F.coalesce(F.sum("__value").over(earlier_rows), F.lit(0)))
        .select(*df.columns, name)
    )


def numbered(
    df: DataFrame, keys: Sequence[str], seq: str, name: str, span: int = SPAN, tie: Sequence[str] = ()
) -> DataFrame:
    """Add the place of each row within its key, from 1 on, without gaps."""
    counted = running_before(df, keys, seq, F.lit(1), name, span, tie)
    return counted.withColumn(name, F.col(name) + 1)


def numbered_overall(df: DataFrame, seq: str, name: str, span: int = SPAN, tie: Sequence[str] = ()) -> DataFrame:
    """Number all rows of a table from 1 on; only the block summaries meet in one task."""
    keyed = df.withColumn("__all", F.lit(0))
    return numbered(keyed, ["__all"], seq, name, span, tie).select(*df.columns, name)


def previous(df: DataFrame, keys: Sequence[str], seq: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """Add ``value`` of the row before this one within the key; NULL for the first."""
    keys = list(keys)
    rows = df.withColumn(_BLOCK, _block(seq, span))
    blocks = Window.partitionBy(*keys).orderBy(_BLOCK)
    last_of_earlier = (
        rows.groupBy(*keys, _BLOCK)
        .agg(F.max(F.struct(F.col(seq), F.col(value))).alias("__last"))
        .select(*keys, _BLOCK, F.lag(F.col("__last")[value]).over(blocks).alias("__before"))
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(seq)
    return (
        rows.join(last_of_earlier, [*keys, _BLOCK])
        .withColumn(
            name,
            F.when(F.row_number().over(inside) == 1, F.col("__before")).otherwise(F.lag(value).over(inside)),
        )
        .select(*df.columns, name)
    )


def first_over(
    df: DataFrame, keys: Sequence[str], seq: str, value: Column, limit: Column | int, span: int = SPAN
) -> DataFrame:
    """Per key, the first ``seq`` at which the running sum of ``value`` (never negative) exceeds ``limit``.

    Only the one block per key in which the sum crosses the limit is looked at row by row. Keys that never cross it
    are absent. Columns: the keys and ``stop_seq``.
    """
    keys = list(keys)
    limit = F.lit(limit) if isinstance(limit, int) else limit
    rows = df.select(*keys, seq, _block(seq, span).alias(_BLOCK), value.cast("bigint").alias("__value"))
    earlier = Window.partitionBy(*keys).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*keys, _BLOCK).agg(F.sum("__value").alias("__total"))
    crossing = (
        totals.withColumn("__before", F.sum("__total").over(earlier))
        .withColumn("__start", F.coalesce("__before", F.lit(0)))
        .filter((F.col("__start") + F.col("__total") > limit) & (F.col("__before").isNull() | (F.col("__before") <= limit)))
        .select(*keys, _BLOCK, "__start")
    )
    inside = Window.partitionBy(*keys, _BLOCK).orderBy(seq).rowsBetween(Window.unboundedPreceding, 0)
    return (
        rows.join(crossing, [*keys, _BLOCK])
        .withColumn("__running", F.col("__start") + F.sum("__value").over(inside))
        .filter(F.col("__running") > limit)
        .groupBy(*keys)
        .agg(F.min(seq).alias("stop_seq"))
    )


def top_per_key(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, name: str, spread: int = SPREAD
) -> DataFrame:
    """The first ``k`` rows of each key in the given order, with their place in ``name``.

    Up to ``WINDOW_LIMIT`` rows, every task keeps its first ``k`` of a key before the one shuffle. Beyond it, rows of a key are first spread over ``spread`` parts by a hash of the row and cut to ``k`` per part, so one task
    never holds more of a hot key than its share, and the last step sees at most ``k * spread`` rows per key. The order
    must be total for the result to be defined.
    """
    keys = list(keys)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    if k <= WINDOW_LIMIT:
        return df.withColumn(name, place).filter(F.col(name) <= k)
    part = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(spread))
    narrowed = (
        df.withColumn("__part", part)
        .withColumn(name, F.row_number().over(Window.partitionBy(*keys, "__part").orderBy(*order)))
        .filter(F.col(name) <= k)
        .drop("__part", name)
    )
    return narrowed.withColumn(name, place).filter(F.col(name) <= k)
