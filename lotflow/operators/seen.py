"""Which ids were processed before, where the processed set is far larger than what arrives.

Each day's ids have a filter, a table with one row a block of 512 bits: an id sets one bit in each of the eight words of
the one block that its hash names. A new id meets a day's filter in an equi-join on the block; only ids that a filter may
hold are looked up among that day's ids, so the outcome is exact. With 20 bits an id a filter is about a tenth of ids as
text and takes one new id in several thousand for an old one; filters are built once a day and never changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WORDS = 8


def _hash(key: str) -> Column:
    return F.xxhash64(key, F.lit("bits"))


def _bit(bits: str, word: int) -> Column:
    """One of 64 bits, chosen by six bits of a hash of its own."""
    return F.expr(f"shiftleft(1L, cast(pmod(shiftright({bits}, {7 * word}), 64L) as int))")


def filters(ids: DataFrame, key: str = "event_id", day: str = "day", bits: int = 20, rows: int | None = None) -> DataFrame:
    """(day, block, blocks, w0 .. w7): the filters of ``ids(day, key)``, at ``bits`` an id.

    ``rows`` is the most ids that a day has, counted without a look at them if it is not given; all days have the same
    number of blocks. Null ids are left out. Two hashes an id are dealt by block, and its bits are set there.
    """
    known = ids.where(F.col(key).isNotNull())
    if rows is None:
        rows = ids.groupBy(day).count().agg(F.max("count")).first()[0] or 0
    blocks = max(1, -(-rows * bits // (64 * _WORDS)))
    dealt = known.select(F.col(day).alias("day"), F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), _hash(key).alias("_bits")).repartition("day", "block")
    return dealt.groupBy("day", "block").agg(F.lit(blocks).cast("long").alias("blocks"), *[F.bit_or(_bit("_bits", w)).alias(f"w{w}") for w in range(_WORDS)])


def _pointed(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``df`` with ``_days``: the days whose filters may hold a row's id. A join a size of filter, of which there are a few."""
    sizes = [r.blocks for r in known.select("blocks").distinct().collect()]
    days = f"array<{known.schema['day'].dataType.simpleString()}>"
    out = df.withColumn("_days", F.expr(f"cast(array() as {days})"))
    holds = " and ".join(f"x.w{w} & shiftleft(1L, cast(pmod(shiftright(_bits, {7 * w}), 64L) as int)) <> 0" for w in range(_WORDS))
    for size in sizes:
        by_block = known.where(F.col("blocks") == size).groupBy(F.col("block").alias("_block")).agg(F.collect_list(F.struct("day", *[f"w{w}" for w in range(_WORDS)])).alias("_known"))
        met = out.withColumn("_block", F.when(F.col(key).isNotNull(), F.pmod(F.xxhash64(key), F.lit(size)))).join(by_block, "_block", "left").withColumn("_bits", _hash(key))
        found = F.expr(f"transform(filter(_known, x -> {holds}), x -> x.day)")
        out = met.withColumn("_days", F.concat("_days", F.coalesce(found, F.expr(f"cast(array() as {days})")))).drop("_block", "_known", "_bits")
    return out


def maybe_seen(df: DataFrame, known: DataFrame, key: str = "event_id") -> DataFrame:
    """(key, day): distinct ids of ``df`` that the filters ``known`` of a day may hold; none that it holds is missing."""
    return _pointed(df.select(key).where(F.col(key).isNotNull()).distinct(), known, key).select(key, F.explode("_days").alias("day"))


def unprocessed(df: DataFrame, processed: DataFrame, known: DataFrame, key: str = "event_id", day: str = "day") -> DataFrame:
    """Rows of ``df`` whose id is in no day of ``processed(day, key)``; ``known`` are its ``filters``.

    Of ``processed`` only ids of days that a filter points to are compared. Rows with a null id are never processed. ``df``
    is read once.
    """
    old = processed.select(F.col(key).alias("_old"), F.col(day).alias("_day"))
    return _pointed(df, known, key).join(old, F.expr(f"{key} = _old and array_contains(_days, _day)"), "left_anti").drop("_days")
