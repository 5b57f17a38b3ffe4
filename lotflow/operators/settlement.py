"""Settled and in-flight views, figures, replay windows and the hand-off from history to live."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotflow.operators import scan

#: Stage names as a buyer would say them.
STAGE_LABELS = {"PO_CREATED": "Order raised", "VENDOR_CONFIRMED": "Vendor confirmed", "APPROVED": "Approved", "IN_TRANSIT": "In transit", "RECEIVED": "Received"}


def label(stage: Column) -> Column:
    named = F.create_map(*[F.lit(x) for kv in STAGE_LABELS.items() for x in kv])
    return F.coalesce(F.element_at(named, stage), F.replace(F.lower(stage), F.lit("_"), F.lit(" ")))


def breached() -> Column:
    return F.coalesce(F.col("sla_breached"), F.lit(False)) | F.coalesce(F.col("status") == "FAILURE", F.lit(False))


def _key() -> Column:
    return F.col("sequence_engine_key").try_cast("decimal(20,0)")


def readable(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Events whose sequence key is a whole number, and the others, with ``reason``, for a dead-letter topic."""
    return events.where(_key().isNotNull()), events.where(_key().isNull()).withColumn("reason", F.lit("sequence_key"))


def split(events: DataFrame, marks: DataFrame) -> DataFrame:
    """``events`` with ``settled``: at or below the newest watermark. The watermark is one row, so it is broadcast.

    Events whose key is no whole number are neither settled nor in flight and go (see ``readable``).
    """
    newest = marks.agg(F.max(F.col("watermark").try_cast("decimal(20,0)")).alias("watermark"))
    return readable(events)[0].join(F.broadcast(newest)).withColumn("settled", F.coalesce(_key() <= F.col("watermark"), F.lit(False)))


def figures(settled: DataFrame, *by: str) -> DataFrame:
    """Settled count, value and exceptions."""
    on = F.col("settled")
    return settled.groupBy(*by).agg(F.count_if(on).alias("settled"), F.count_if(~on).alias("in_flight"), F.sum(F.when(on, F.coalesce("value", F.lit(0.0))).otherwise(0.0)).alias("settled_value"), F.count_if(on & breached()).alias("exceptions"))


def watermark_in_force(records: DataFrame, feed: str = "topic", order: str = "offset") -> DataFrame:
    """``records(.., watermark)`` with the last watermark of the feed at each record.

    A scan in segments: a feed may hold any share of the records, as no task holds a whole one.
    """
    return scan.running(records, [feed], [order], lasts={"in_force": "watermark"})


def replay(df: DataFrame, from_seq: int = 0, to_seq: int | None = None, exclusive: bool = False) -> DataFrame:
    """Rows of a sequence window; an open end is no predicate."""
    if to_seq is not None and to_seq < from_seq:
        raise ValueError(f"empty replay window: {from_seq} to {to_seq}")
    key = F.col("sequence_engine_key")
    out = df.where(key > from_seq if exclusive else key >= from_seq)
    return out if to_seq is None else out.where(key <= to_seq)


def ordered(events: DataFrame, newest_first: bool = False) -> DataFrame:
    """Events by their sequence key as a whole number, whatever its length as text; events without one go."""
    return readable(events)[0].orderBy(_key().desc() if newest_first else _key().asc())


def newest_of_each(events: DataFrame, per: str = "aggregate_id") -> DataFrame:
    """Events with their ``place`` in the newest-first order of their aggregate; events without a whole key go."""
    return readable(events)[0].withColumn("place", F.expr(f"row_number() over (partition by {per} order by try_cast(sequence_engine_key as decimal(20,0)) desc)"))


def hand_off(history: DataFrame, live: DataFrame, keys: list[str], start: int = 0, keep_late: bool = True) -> DataFrame:
    """History and what live adds to it, each event once.

    Without ``keep_late`` live rows at or below the newest key of history are lost, late ones with them.
    """
    from lotflow.operators.dedup import merge_unique

    if not keep_late:
        cursor = history.agg(F.coalesce(F.max("sequence_engine_key"), F.lit(start)).alias("_cursor"))
        live = live.join(F.broadcast(cursor)).where("sequence_engine_key > _cursor").drop("_cursor")
    return merge_unique(history, live, keys)
