"""Evaluate an expression once although it is used several times.

Spark inlines a column into the filters and projections above it, so an expensive expression that is mentioned n times
may be evaluated n times. ``let`` binds a value inside one expression; ``computed`` adds columns through a one-row
generator, below which later filters on these columns are not pushed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add columns that are evaluated once per row, whatever is filtered on them later."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))
