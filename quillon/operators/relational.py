"""Relational helpers that need more than one built-in call."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fold_left(base: DataFrame, others: list[tuple[DataFrame, list[str]]]) -> DataFrame:
    """base left-joined with each of the others in turn."""
    return reduce(lambda acc, x: acc.join(x[0], x[1], "left"), others, base)


def keep_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row for each key, the first in the given order; other columns come along. Partial aggregation, no window."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_x")
    return df.groupBy(*keys).agg(first).select(*keys, "_x.*")
