"""Exactly-once effects on an at-least-once input."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _ranked(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first of each key. Rows are dealt first: left to itself, Spark sorts them before the exchange too, for a limit
    that takes nothing out where keys hardly repeat."""
    return df.repartition(*keys).withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key."""
    return _ranked(df, keys, [F.asc(c) if isinstance(c, str) else c for c in order])


def keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key: what an upsert by key leaves behind."""
    return _ranked(df, keys, [F.desc(c) for c in order])


def unprocessed(df: DataFrame, processed: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key is not in the processed set."""
    return df.join(processed.select(*keys), keys, "left_anti")


def claim(df: DataFrame, processed: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Exactly one row for each key that nobody has claimed: its first."""
    return unprocessed(keep_first(df, keys, order), processed, keys)


def merge_unique(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows and those new ones whose whole key is not there yet; repeats inside either go too."""
    marked = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    return keep_first(marked, keys, ["_new", *rest]).drop("_new")
