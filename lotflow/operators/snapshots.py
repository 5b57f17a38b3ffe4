"""Daily snapshots, as-of lookups, totals and reconciliation over ledger facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.operators import scan
from lotflow.schemas import KEYS, ORDER

GRAINS = {"sku_day": ["sku"], "sku_location_day": ["sku", "location_id"]}


def daily(facts: DataFrame, grain: str = "sku_location_day", order: tuple[str, ...] = ORDER) -> DataFrame:
    """The last state of each day. ``sku_day`` lets locations overwrite each other, last by ``order``."""
    by = GRAINS[grain]
    rest = [c for c in facts.columns if c not in by]
    day = facts.withColumn("snapshot_date", F.to_date("occurred_at"))
    last = day.groupBy(*by, "snapshot_date").agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    flat = last.select(*by, "snapshot_date", *[F.col(f"r.{c}") for c in rest])
    return flat.withColumn("snapshot_id", F.concat_ws("_", *by, F.date_format("snapshot_date", "yyyy-MM-dd")))


def before(probes: DataFrame, facts: DataFrame, at: str = "at_sequence", segments: int | None = None) -> DataFrame:
    """For each probe the key's last fact strictly before its sequence key; nulls if there is none.

    Probes and facts are sorted together by key, probes first on ties, and the last fact is carried forward. With
    ``segments`` that is a scan in so many segments, for hot keys; it reads both sides three times.
    """
    kept = [c for c in facts.columns if c not in (*KEYS, "sequence_engine_key")]
    found = F.struct("sequence_engine_key", *kept)
    probe = [c for c in probes.columns if c not in (*KEYS, at)]
    a = probes.select(*KEYS, F.col(at).alias("_at"), F.lit(0).alias("_side"), F.struct(*probe).alias("_probe"), F.lit(None).cast(facts.select(found.alias("f")).schema["f"].dataType).alias("_fact"))
    b = facts.select(*KEYS, F.col("sequence_engine_key").alias("_at"), F.lit(1).alias("_side"), F.lit(None).cast(a.schema["_probe"].dataType).alias("_probe"), found.alias("_fact"))
    both = a.unionByName(b)
    if segments:
        filled = scan.running(both, list(KEYS), ["_at", "_side"], lasts={"_fact": "_fact"}, segments=segments)
    else:
        filled = both.withColumn("_fact", F.expr("last(_fact, true) over (partition by sku, location_id order by _at, _side rows unbounded preceding)"))
    return filled.where("_side = 0").select("_probe.*", *KEYS, F.col("_at").alias(at), "_fact.*")


def last_facts(facts: DataFrame) -> DataFrame:
    """The newest fact of each key."""
    rest = [c for c in facts.columns if c not in KEYS]
    return facts.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct(*ORDER)).alias("r")).select(*KEYS, "r.*")


def total_value(facts: DataFrame, *by: str) -> DataFrame:
    """Quantity and value now on hand, from the newest fact of each key (days must not be added up)."""
    return last_facts(facts).groupBy(*by).agg(F.count("*").alias("keys"), F.sum("qty_on_hand").alias("qty_on_hand"), F.sum("fifo_total_value").alias("fifo_total_value"))


def reconcile(facts: DataFrame, lots: DataFrame | None = None) -> DataFrame:
    """Per key: do deltas, the newest fact and the surviving lots agree?

    Without ``lots``, facts say what is left of the lot that each opened (``fifo.value(..., lots=True)``), and rows that are
    dealt by key are not shuffled again.
    """
    of_facts = [F.count("*").alias("movements"), F.sum("qty_delta").alias("sum_delta"), F.max_by(F.struct("qty_on_hand", "fifo_total_value"), F.struct(*ORDER)).alias("r")]
    of_lots = [F.sum("remaining_qty").alias("lots_on_hand"), F.sum(F.expr("cast(remaining_qty * unit_cost as decimal(38,8))")).alias("lots_value")]
    if lots is None:
        both = facts.groupBy(*KEYS).agg(*of_facts, *of_lots).select(*KEYS, "movements", "sum_delta", "r.*", "lots_on_hand", "lots_value")
    else:
        a = facts.groupBy(*KEYS).agg(*of_facts).select(*KEYS, "movements", "sum_delta", "r.*")
        both = a.join(lots.groupBy(*KEYS).agg(*of_lots), list(KEYS), "left")
    both = both.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("lots_on_hand", "lots_value")})
    return both.withColumn("balanced", F.expr("sum_delta = qty_on_hand and qty_on_hand = lots_on_hand and fifo_total_value = lots_value"))
