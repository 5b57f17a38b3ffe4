"""Dimensions around the facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(df: DataFrame, natural: str, *attributes: str) -> DataFrame:
    """One row a natural key, with a surrogate key from its hash; the attributes are those of one row, the greatest."""
    return df.groupBy(natural).agg(F.max(F.struct(*attributes)).alias("_row")).select(natural, "_row.*", F.md5(F.col(natural).cast("string")).alias("surrogate_key"))


def seen_between(df: DataFrame, natural: str, at: str) -> DataFrame:
    """One row a natural key, with when it was first and last seen and a surrogate key from its hash."""
    return df.groupBy(natural).agg(F.min(at).alias("first_seen"), F.max(at).alias("last_seen")).withColumn("surrogate_key", F.md5(F.col(natural).cast("string")))


def date_spine(df: DataFrame, at: str) -> DataFrame:
    """Every day from the first to the last."""
    ends = df.agg(F.min(F.to_date(at)).alias("a"), F.max(F.to_date(at)).alias("b")).where("a is not null")
    day = ends.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    return day.select("day", F.year("day").alias("year"), F.month("day").alias("month"), F.dayofmonth("day").alias("day_of_month"), F.quarter("day").alias("quarter"), F.weekday("day").alias("weekday"))


def scd2(history: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """Versions of ``value`` by key: valid from its change until the next one."""
    by = f"partition by {key} order by {at}"
    changed = history.withColumn("_was", F.expr(f"lag({value}) over ({by})")).withColumn("_first", F.expr(f"row_number() over ({by})")).where(f"_first = 1 or not ({value} <=> _was)")
    return changed.select(key, value, F.col(at).alias("valid_from"), F.expr(f"lead({at}) over ({by})").alias("valid_to")).withColumn("current", F.col("valid_to").isNull())


def splice(history: DataFrame, late: DataFrame, key: str, value: str, at: str) -> DataFrame:
    """What ``late`` observations change in the versions of ``history``: rows of ``scd2`` with ``action``, put or drop.

    Only keys that ``late`` has are looked at. A put replaces the version of the key that begins at the same time, or is
    new; a dropped version has been merged into the one before it. Of observations of one key and time the greatest holds.
    """
    columns = [key, value, at]
    touched = late.select(key).distinct()
    once = lambda df: df.groupBy(key, at).agg(F.max(value).alias(value)).select(*columns)
    mine = history.select(*columns).join(touched, key, "left_semi")
    old, new = scd2(once(mine), key, value, at), scd2(once(mine.unionByName(late.select(*columns))), key, value, at)
    rows = lambda df: df.select(key, "valid_from", F.struct(value, "valid_to", "current").alias("row"))
    both = rows(old).withColumnRenamed("row", "was").join(rows(new), [key, "valid_from"], "full_outer").where(~F.col("was").eqNullSafe(F.col("row")))
    kept = F.coalesce("row", "was")
    return both.select(key, kept[value].alias(value), "valid_from", kept["valid_to"].alias("valid_to"), kept["current"].alias("current"), F.when(F.col("row").isNull(), "drop").otherwise("put").alias("action"))


def spliced(versions: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Stored ``versions`` with the ``changes`` that ``splice`` gave."""
    kept = versions.join(changes.select(key, "valid_from"), [key, "valid_from"], "left_anti")
    return kept.select(*versions.columns).unionByName(changes.where("action = 'put'").select(*versions.columns))
