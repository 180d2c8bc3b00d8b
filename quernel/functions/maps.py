"""A keyed store as map columns and as tables: the last value written to a key wins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def upsert(store: Column, key: Column, value: Column) -> Column:
    """The map with key set to value, whether or not it had the key."""
    return F.map_concat(F.map_filter(store, lambda k, _: k != key), F.create_map(key, value))


def find(store: Column, key: Column) -> Column:
    """The value of a key, or null."""
    return F.try_element_at(store, key)


def contains(store: Column, key: Column) -> Column:
    return F.map_contains_key(store, key)


def entries(store: Column) -> Column:
    """All (key, value) pairs, by key."""
    return F.array_sort(F.map_entries(store))


def keys(store: Column) -> Column:
    return F.array_sort(F.map_keys(store))


def last_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row per key: the last in the given order. The store as a table, for any number of keys."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(*[F.desc(c) for c in order]))
    return rows.withColumn("_place", place).filter("_place = 1").drop("_place")
