"""Ordered folds that windows express: running sums of differences, next offsets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta_decode(df: DataFrame, keys: list[str], order: str, diff: str, to: str = "value") -> DataFrame:
    """Values stored as differences, in order, within each key."""
    return df.withColumn(to, F.sum(diff).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def next_offset(df: DataFrame, keys: list[str], offset: str, otherwise, to: str = "end") -> DataFrame:
    """Where each section ends: at the next larger offset of its key, else `otherwise`."""
    return df.withColumn(to, F.coalesce(F.lead(offset).over(Window.partitionBy(*keys).orderBy(offset)), otherwise))
