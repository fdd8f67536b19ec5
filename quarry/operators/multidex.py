"""Lookups across images: which file defines a class, type, method or string."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators import resolve
from quarry.tables import DexTables


def class_entries(t: DexTables) -> DataFrame:
    """(key, dex_id, idx) of defined classes."""
    return resolve.class_desc(t).where("descriptor IS NOT NULL").select(F.col("descriptor").alias("key"), "dex_id", F.col("class_idx").alias("idx"))


def type_entries(t: DexTables, compat: bool = False) -> DataFrame:
    """(key, dex_id, idx) of types; compat lists those of defined classes once more."""
    types = resolve.type_desc(t).where("descriptor IS NOT NULL").select(F.col("descriptor").alias("key"), "dex_id", F.col("type_idx").alias("idx"))
    if not compat:
        return types.distinct()
    return types.unionByName(types.join(t.classes.select("dex_id", F.col("type_idx").alias("idx")), ["dex_id", "idx"]).select("key", "dex_id", "idx"))


def method_entries(t: DexTables) -> DataFrame:
    """(key, dex_id, idx) of methods defined in their image, by full descriptor."""
    return resolve.method_desc(t).where("descriptor IS NOT NULL").select(F.col("descriptor").alias("key"), "dex_id", F.col("method_idx").alias("idx"))


def string_entries(t: DexTables) -> DataFrame:
    return t.strings.where("value IS NOT NULL").select(F.col("value").alias("key"), "dex_id", F.col("string_idx").alias("idx"))


def index(entries: DataFrame) -> DataFrame:
    """(key, entries): an inverted index, each key with its places in order."""
    return entries.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("dex_id", "idx"))).alias("entries"))


def find(entries: DataFrame, key: str) -> DataFrame:
    """The places of one key; a filter that goes down to the scan, without building an index."""
    return entries.where(F.col("key") == key)
