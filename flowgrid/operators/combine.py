"""Putting cell tables together."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compose(cells: DataFrame, features: Sequence[DataFrame], key: str = "cell") -> DataFrame:
    """cells with the columns of each feature table, one row a cell: a cell that a table lacks has nulls."""
    out = cells
    for f in features:
        out = out.join(f, key, "left")
    return out


def merge_update(old: DataFrame, new: DataFrame, key: str = "cell") -> DataFrame:
    """old with new's columns, which replace its own of the same name; cells that new lacks get nulls in them."""
    return old.drop(*[c for c in new.columns if c != key]).join(new, key, "left")


def season_value(cells: DataFrame, seasonal: DataFrame, column: str, season: str | None, key: str = "cell") -> DataFrame:
    """(key, value): the pooled column, or the season's from a long table; a cell without it has null."""
    if season is None:
        return cells.select(key, F.col(column).alias("value"))
    picked = seasonal.where(F.col("season") == season).select(key, F.col(column).alias("value"))
    return cells.select(key).join(picked, key, "left")
