"""Queries of the cost ledger, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotflow.functions import ids
from lotflow.operators import contracts, dedup, fifo, restate, seen, snapshots
from lotflow.plans.sql import ARRIVALS, MOVEMENTS, with_ledger, with_movements
from lotflow.runtime import cut, table
from lotflow.schemas import KEYS
from lotflow.sources import views

#: A quotient to six places, half up with a margin, so that engines cannot differ on exact halves.
_Q = lambda name: (F.floor(F.col(name).cast("double") * 1e6 + 0.501) / 1e6).alias(name)
_D = lambda name: F.round(F.col(name).cast("double"), 6).alias(name)


def _typed(spark, sf_dir):
    """Each movement once, valid and typed, with a packed id.

    A row is checked and typed before the shuffle of the deduplication, which then carries a flag for what only the rules
    read; the flag is looked at after it, as the first arrival of an id counts and not its first good one.
    """
    checked = views.movements(spark, sf_dir).withColumn("good", contracts.holds(contracts.MOVEMENT_RULES))
    once = dedup.keep_first(contracts.typed_movements(checked).withColumn("event_id", ids.packed("event_id")), ["event_id"], ["published_at"])
    return once.where("good").drop("good")


def _named(df, *names):
    """``df`` with ids as text."""
    return df.withColumns({name: ids.unpacked(name) for name in names or ("event_id",)})


_COLUMNS = ("event_id", *KEYS, "sequence_engine_key", "movement_type", "quantity", "unit_cost")


def _accepted(spark, sf_dir, *more):
    """Accepted movements with the columns that valuation reads; each query reads them once."""
    return fifo.accept(_typed(spark, sf_dir).select(*_COLUMNS, *more)).where("rejected is null")


def _fact_columns(df):
    return _named(df).select("event_id", *KEYS, "sequence_engine_key", "movement_type", _D("qty_delta"), _D("qty_on_hand"), _Q("fifo_unit_cost"), _D("fifo_total_value"), _Q("moving_avg_cost"))


def fifo_facts(spark, sf_dir):
    return _fact_columns(fifo.value(_accepted(spark, sf_dir)))


def _allocation(df):
    return _named(df, "lot_id", "consumption_id").select(*KEYS, "lot_id", "consumption_id", _D("taken"), _D("cost"))


def fifo_allocation(spark, sf_dir):
    return _allocation(fifo.allocation(_typed(spark, sf_dir).select(*_COLUMNS)))


def fifo_allocation_sweep(spark, sf_dir):
    return _allocation(fifo.allocation(_typed(spark, sf_dir).select(*_COLUMNS)))


def lot_balance(spark, sf_dir):
    return _named(fifo.balance(_accepted(spark, sf_dir)), "lot_id").select(*KEYS, "lot_id", "sequence_engine_key", _D("remaining_qty"), _D("unit_cost"))


def on_hand_from_lots(spark, sf_dir):
    return fifo.on_hand(fifo.balance(_accepted(spark, sf_dir))).select(*KEYS, _D("qty_on_hand"), _D("fifo_total_value"), "max_sequence", "lots")


def rejected_movements(spark, sf_dir):
    return _named(fifo.accept(_typed(spark, sf_dir).select(*_COLUMNS)).where("rejected is not null")).select("event_id", *KEYS, "sequence_engine_key", F.col("rejected").alias("reason"), F.lit("inventory.movement.v1.dlq").alias("dlq_topic"))


def _snapshot(df):
    return df.select("snapshot_id", "snapshot_date", *KEYS, "mdm_vendor_id", "sequence_engine_key", _D("qty_on_hand"), _D("fifo_total_value"), _Q("moving_avg_cost"))


def _valued(spark, sf_dir, **options):
    """Facts with what a snapshot shows and is chosen by, and no other columns."""
    facts = fifo.value(_accepted(spark, sf_dir, "occurred_at", "mdm_vendor_id"), **options)
    return facts.select("event_id", "occurred_at", *KEYS, "mdm_vendor_id", "sequence_engine_key", "qty_on_hand", "fifo_total_value", "moving_avg_cost")


def sku_day_snapshot(spark, sf_dir):
    return _snapshot(snapshots.daily(_valued(spark, sf_dir, deal=("sku",)), grain="sku_day"))


def sku_location_day_snapshot(spark, sf_dir):
    return _snapshot(snapshots.daily(_valued(spark, sf_dir), grain="sku_location_day"))


def snapshot_before(spark, sf_dir):
    facts = fifo.value(_accepted(spark, sf_dir)).select(*KEYS, "sequence_engine_key", "qty_on_hand")
    o = table(spark, sf_dir, "orders")
    probes = o.select(F.col("o_orderkey").alias("probe_id"), F.expr("concat('SKU-', o_custkey)").alias("sku"), F.expr("concat('LOC-', o_orderkey % 2)").alias("location_id"), F.expr("datediff(cast(o_orderdate as date), date'1992-01-01') * 100000000000").cast("long").alias("at_sequence"))
    return snapshots.before(probes, facts).select("probe_id", *KEYS, "at_sequence", F.coalesce("sequence_engine_key", F.lit(-1)).alias("found_sequence"), F.coalesce("qty_on_hand", F.lit(-1)).alias("qty_on_hand")).select("probe_id", *KEYS, "at_sequence", "found_sequence", _D("qty_on_hand"))


def inventory_value(spark, sf_dir):
    facts = fifo.value(_accepted(spark, sf_dir, "mdm_vendor_id")).select("event_id", *KEYS, "mdm_vendor_id", "sequence_engine_key", "qty_on_hand", "fifo_total_value")
    return snapshots.total_value(facts, "mdm_vendor_id").select("mdm_vendor_id", "keys", _D("qty_on_hand"), _D("fifo_total_value"))


def ledger_reconcile(spark, sf_dir):
    return snapshots.reconcile(fifo.value(_accepted(spark, sf_dir), lots=True)).select(*KEYS, "movements", _D("sum_delta"), _D("qty_on_hand"), _D("lots_on_hand"), _D("fifo_total_value"), _D("lots_value"), "balanced")


def late_arrivals(spark, sf_dir):
    return _named(restate.flag_late(_typed(spark, sf_dir)).where("late")).select("event_id", *KEYS, "sequence_engine_key", "newest_before")


def horizon_adjustments(spark, sf_dir):
    return restate.late_policy(restate.flag_late(_typed(spark, sf_dir))).groupBy("policy", "applied_type").agg(F.count("*").alias("movements"), _sum("quantity"))


def _sum(name):
    return F.round(F.sum(name).cast("double"), 6).alias(name)


def arrival_ledger(spark, sf_dir):
    return _named(restate.arrival_ledger(_typed(spark, sf_dir))).select("event_id", *KEYS, "sequence_engine_key", "outcome", _D("qty_on_hand"), _Q("fifo_unit_cost"), _D("fifo_total_value"))


def _since_1998(spark, sf_dir):
    """Movements, those published from 1998 on as ``late``; a null time is none."""
    flagged = _typed(spark, sf_dir).withColumn("late", F.expr("published_at >= timestamp'1998-01-01'"))
    return flagged.where("late is not null").select(*_COLUMNS, "late")


def restatement_delta(spark, sf_dir):
    return _named(restate.restated_by(_since_1998(spark, sf_dir))).select("event_id", *KEYS, _Q("old_unit_cost"), _Q("new_unit_cost"), _D("old_total_value"), _D("new_total_value"))


def incremental_valuation(spark, sf_dir):
    rows = cut(restate.overtaken(_since_1998(spark, sf_dir)))  # lots are stored of the keys whose facts can change
    early, late = rows.where("not late").drop("late"), rows.where("late").drop("late")
    marks = [int(m) for m in early.agg(F.percentile_approx("sequence_engine_key", [0.25, 0.5, 0.75, 0.9]).alias("m")).first().m or []]
    stored = restate.stored_lots(fifo.accept(early).where("rejected is null"), marks)
    return _named(restate.restated_since(early, late, stored, marks)).select("event_id", *KEYS, _Q("old_unit_cost"), _Q("new_unit_cost"), _D("old_total_value"), _D("new_total_value"))


def dedup_redelivery(spark, sf_dir):
    return dedup.keep_first(views.redelivered(spark, sf_dir), ["event_id"], ["published_at"]).select("event_id", "published_at", "sku", "quantity")


def claim_once(spark, sf_dir):
    rows = views.redelivered(spark, sf_dir)
    done = views.movements(spark, sf_dir).where("location_id = 'LOC-1'").select("event_id")
    return dedup.claim(rows, done, ["event_id"], ["published_at"]).select("event_id", "published_at", "location_id")


def claim_unseen(spark, sf_dir):
    done = views.movements(spark, sf_dir).where("location_id = 'LOC-1'").select("event_id", F.date_trunc("year", "published_at").alias("day"))
    done = done.withColumn("event_id", ids.packed("event_id"))
    first = dedup.keep_first(views.redelivered(spark, sf_dir).withColumn("event_id", ids.packed("event_id")), ["event_id"], ["published_at"])
    return _named(seen.unprocessed(first.select("event_id", "published_at", "location_id"), done, cut(seen.filters(done))))


def fact_upsert(spark, sf_dir):
    return dedup.keep_last(views.redelivered(spark, sf_dir), ["event_id"], ["published_at"]).select("event_id", "published_at", "sku", "quantity")


def contract_violations(spark, sf_dir):
    bad = contracts.violations(views.faulty(spark, sf_dir), contracts.MOVEMENT_RULES)
    return bad.select(F.explode_outer("errors").alias("rule")).groupBy(F.coalesce("rule", F.lit("ok")).alias("rule")).agg(F.count("*").alias("movements"))


def signed_deltas(spark, sf_dir):
    return fifo.signed(_typed(spark, sf_dir)).groupBy("movement_type").agg(F.count("*").alias("movements"), _sum("delta"), _sum("supply"), _sum("demand"))


_FACTS = """select event_id, sku, location_id, sequence_engine_key, movement_type, round(cast(delta as double), 6) as qty_delta, round(cast(qty_on_hand as double), 6) as qty_on_hand,
 floor((case when demand > 0 then cast(cogs as double) / cast(demand as double) else 0 end) * 1e6 + 0.501) / 1e6 as fifo_unit_cost, round(cast(fifo_total_value as double), 6) as fifo_total_value,
 floor((case when qty_on_hand > 0 then cast(fifo_total_value as double) / cast(qty_on_hand as double) else 0 end) * 1e6 + 0.501) / 1e6 as moving_avg_cost from facts"""
_ALLOCATION = "select sku, location_id, lot_id, consumption_id, round(cast(taken as double), 6) as taken, round(cast(cast(taken as decimal(18,4)) * unit_cost as double), 6) as cost from allocations"
_SNAPSHOT = """select {id} as snapshot_id, cast(occurred_at as date) as snapshot_date, sku, location_id, mdm_vendor_id, sequence_engine_key, round(cast(qty_on_hand as double), 6) as qty_on_hand,
 round(cast(fifo_total_value as double), 6) as fifo_total_value, floor((case when qty_on_hand > 0 then cast(fifo_total_value as double) / cast(qty_on_hand as double) else 0 end) * 1e6 + 0.501) / 1e6 as moving_avg_cost
 from (select *, row_number() over (partition by {by}, cast(occurred_at as date) order by sequence_engine_key desc, event_id desc) as n from facts) where n = 1"""
_BALANCE = "balance as (select *, greatest(0, s_hi - greatest(s_hi - supply, gone)) as remaining from (select *, sum(demand) over (partition by sku, location_id) as gone from spans) where supply > 0)"
_LATE = "flagged as (select *, max(sequence_engine_key) over (partition by sku, location_id order by published_at, sequence_engine_key, event_id rows between unbounded preceding and 1 preceding) as newest_before from typed)"
_TYPED = "typed as (select * replace (cast(quantity as decimal(18,4)) as quantity, cast(unit_cost as decimal(18,4)) as unit_cost) from movements)"
_TWICE = "twice as (select * from movements union all select * replace (published_at + interval 1 day as published_at) from movements where redelivered)"


def _restatement_sql(day: str) -> str:
    old = with_ledger("select event_id, sku, location_id, cogs, demand, fifo_total_value from facts").replace("from lineitem)", "from lineitem where l_shipdate + to_days(cast(l_orderkey % 45 as integer)) < timestamp '" + day + "')")
    new = with_ledger("select event_id, sku, location_id, cogs, demand, fifo_total_value from facts")
    cost = lambda t: f"(case when {t}.demand > 0 then cast({t}.cogs as double) / cast({t}.demand as double) else 0 end)"
    return f"""select o.event_id, o.sku, o.location_id, floor({cost('o')} * 1e6 + 0.501) / 1e6 as old_unit_cost, floor({cost('n')} * 1e6 + 0.501) / 1e6 as new_unit_cost,
 round(cast(o.fifo_total_value as double), 6) as old_total_value, round(cast(n.fifo_total_value as double), 6) as new_total_value
 from ({old}) o join ({new}) n on o.event_id = n.event_id where o.cogs <> n.cogs or o.fifo_total_value <> n.fifo_total_value"""


ORACLE = {
    "fifo_facts": with_ledger(_FACTS),
    "fifo_allocation": with_ledger(_ALLOCATION),
    "fifo_allocation_sweep": with_ledger(_ALLOCATION),
    "lot_balance": with_ledger(f", {_BALANCE} select sku, location_id, event_id as lot_id, sequence_engine_key, round(cast(remaining as double), 6) as remaining_qty, round(cast(unit_cost as double), 6) as unit_cost from balance where remaining > 0"),
    "on_hand_from_lots": with_ledger(f", {_BALANCE} select sku, location_id, round(cast(sum(remaining) as double), 6) as qty_on_hand, round(cast(sum(cast(remaining as decimal(18,4)) * unit_cost) as double), 6) as fifo_total_value, max(sequence_engine_key) as max_sequence, count(*) as lots from balance where remaining > 0 group by all"),
    "rejected_movements": with_ledger("select s.event_id, s.sku, s.location_id, s.sequence_engine_key, 'exceeds_on_hand' as reason, 'inventory.movement.v1.dlq' as dlq_topic from signed s join walk w on s.sku = w.sku and s.location_id = w.location_id and s.rn = w.rn where not w.ok"),
    "sku_day_snapshot": with_ledger(_SNAPSHOT.format(id="sku || '_' || strftime(occurred_at, '%Y-%m-%d')", by="sku")),
    "sku_location_day_snapshot": with_ledger(_SNAPSHOT.format(id="sku || '_' || location_id || '_' || strftime(occurred_at, '%Y-%m-%d')", by="sku, location_id")),
    "snapshot_before": with_ledger(", probes as (select o_orderkey as probe_id, 'SKU-' || o_custkey as sku, 'LOC-' || (o_orderkey % 2) as location_id, cast(datediff('day', date '1992-01-01', cast(o_orderdate as date)) as bigint) * 100000000000 as at_sequence from orders) select p.probe_id, p.sku, p.location_id, p.at_sequence, coalesce(f.sequence_engine_key, -1) as found_sequence, round(cast(coalesce(f.qty_on_hand, -1) as double), 6) as qty_on_hand from probes p asof left join facts f on p.sku = f.sku and p.location_id = f.location_id and p.at_sequence > f.sequence_engine_key"),
    "inventory_value": with_ledger(", last_facts as (select *, row_number() over (partition by sku, location_id order by sequence_engine_key desc, event_id desc) as n from facts) select mdm_vendor_id, count(*) as keys, round(cast(sum(qty_on_hand) as double), 6) as qty_on_hand, round(cast(sum(fifo_total_value) as double), 6) as fifo_total_value from last_facts where n = 1 group by all"),
    "ledger_reconcile": with_ledger("select sku, location_id, count(*) as movements, round(cast(sum(delta) as double), 6) as sum_delta, round(cast(sum(delta) as double), 6) as qty_on_hand, round(cast(sum(delta) as double), 6) as lots_on_hand, round(cast(sum(supply * unit_cost) - sum(cogs) as double), 6) as fifo_total_value, round(cast(sum(supply * unit_cost) - sum(cogs) as double), 6) as lots_value, true as balanced from facts group by all"),
    "late_arrivals": with_movements(f", {_TYPED}, {_LATE} select event_id, sku, location_id, sequence_engine_key, newest_before from flagged where sequence_engine_key < newest_before"),
    "horizon_adjustments": with_movements(f", {_TYPED}, {_LATE}, policies as (select *, case when coalesce(sequence_engine_key < newest_before, false) then case when published_at - occurred_at > interval 30 day then 'adjust' else 'restate' end else 'append' end as policy from flagged) select policy, case when policy = 'adjust' then 3 else movement_type end as applied_type, count(*) as movements, round(cast(sum(quantity) as double), 6) as quantity from policies group by all"),
    "arrival_ledger": f"""with recursive {MOVEMENTS}, {ARRIVALS} select id as event_id, sku, location_id, seq as sequence_engine_key, outcome, round(cast(held as double) / 1e4, 6) as qty_on_hand,
 floor((case when need > 0 then cast(cogs as double) / 1e4 / cast(need as double) else 0 end) * 1e6 + 0.501) / 1e6 as fifo_unit_cost, round(cast(worth as double) / 1e8, 6) as fifo_total_value from last_facts""",
    "restatement_delta": _restatement_sql("1998-01-01"),
    "incremental_valuation": _restatement_sql("1998-01-01"),
    "dedup_redelivery": with_movements(f", {_TWICE} select event_id, min(published_at) as published_at, any_value(sku) as sku, any_value(quantity) as quantity from twice group by event_id"),
    "fact_upsert": with_movements(f", {_TWICE} select event_id, max(published_at) as published_at, any_value(sku) as sku, any_value(quantity) as quantity from twice group by event_id"),
    "claim_once": with_movements(f", {_TWICE} select event_id, min(published_at) as published_at, any_value(location_id) as location_id from twice where event_id not in (select event_id from movements where location_id = 'LOC-1') group by event_id"),
    "claim_unseen": with_movements(f", {_TWICE} select event_id, min(published_at) as published_at, any_value(location_id) as location_id from twice where event_id not in (select event_id from movements where location_id = 'LOC-1') group by event_id"),
    "contract_violations": with_movements("""select rule, count(*) as movements from (select case sequence_engine_key % 50 when 0 then 'event_id_uuid' when 1 then 'trace_parent_format' when 2 then 'sku_empty' when 3 then 'quantity_format'
 when 4 then 'unit_cost_format' when 5 then 'occurred_at_missing' when 6 then 'sequence_out_of_range' when 7 then 'event_id_uuid' when 8 then 'quantity_format' when 9 then 'quantity_too_fine' else 'ok' end as rule from movements) group by rule"""),
    "signed_deltas": with_movements(f", {_TYPED} select movement_type, count(*) as movements, round(cast(sum(case when movement_type = 2 then -quantity else quantity end) as double), 6) as delta, round(cast(sum(case when movement_type <> 2 and quantity > 0 then quantity else 0 end) as double), 6) as supply, round(cast(sum(case when movement_type = 2 then quantity when quantity < 0 then -quantity else 0 end) as double), 6) as demand from typed group by all"),
}

QUERIES = [
    fifo_facts, fifo_allocation, fifo_allocation_sweep, lot_balance, on_hand_from_lots, rejected_movements, sku_day_snapshot, sku_location_day_snapshot, snapshot_before, inventory_value, ledger_reconcile,
    late_arrivals, horizon_adjustments, arrival_ledger, restatement_delta, incremental_valuation, dedup_redelivery, fact_upsert, claim_once, claim_unseen, contract_violations, signed_deltas,
]
