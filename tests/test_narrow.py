"""What the ledger queries shuffle and store: no text that only the rules read, no rows before they are needed."""

import os
import re

import pytest
from pyspark.sql import functions as F

from lotflow.functions import ids
from lotflow.operators import contracts, fifo, restate, seen, snapshots
from lotflow.plans import ledger as plans
from lotflow.runtime import settings, shared_checkpoint_dir

from .helpers import DIR, same
from .test_ledger import moves


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark):
    folder = shared_checkpoint_dir(spark).removeprefix("file:")
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(folder) for f in names)


def test_packed_ids_sort_as_text_and_come_back(spark):
    base = "0f9a00ff-09af-4f00-9a9f-00000000000"
    texts = [base + c for c in "09afAF"] + [base.replace("a", a).replace("f", f, 1) + "1" for a in "aA" for f in "fF9"] + ["ffffffff-ffff-ffff-ffff-ffffffffffff", "00000000-0000-0000-0000-000000000000", "A" + base[1:] + "0"]
    df = spark.createDataFrame([(t,) for t in texts], "id string").distinct().withColumn("p", ids.packed("id"))
    assert [r.id for r in df.orderBy("p").collect()] == sorted(set(texts))
    assert df.where(ids.unpacked("p") != F.col("id")).isEmpty() and df.where("length(p) = 16").count() == sum(t == t.lower() for t in set(texts))
    odd = spark.createDataFrame([(t,) for t in ("", "x", "0" * 16, "é" * 8, "0f9a00ff09af4f009a9f000000000000", base + "0\n", None)], "id string").withColumn("p", ids.packed("id"))
    assert odd.where(~ids.unpacked("p").eqNullSafe(F.col("id"))).isEmpty() and odd.where("length(p) <= 16").isEmpty()


def test_the_first_arrival_counts_and_not_the_first_good_one(spark, monkeypatch):
    movements = plans.views.movements

    def bad_first(s, sf_dir):
        rows = movements(s, sf_dir)
        return rows.unionByName(rows.where("redelivered").withColumns({"published_at": F.expr("published_at - interval 1 day"), "trace_parent": F.lit("none")}))

    monkeypatch.setattr(plans.views, "movements", bad_first)
    assert plans._typed(spark, DIR).count() == movements(spark, DIR).where("not redelivered").count()


def test_deduplication_sorts_once_and_carries_no_text_of_the_rules(spark):
    plan = plan_of(plans.signed_deltas(spark, DIR))
    below = plan[plan.index("hashpartitioning(event_id") :]
    assert "Sort" not in below
    width = re.search(r"Exchange hashpartitioning\(event_id.*?\n.*?Project \[(.*?)\]\n", plan, re.S).group(1)
    assert "trace_parent#" not in re.sub(r"\(.*?\) AS", "AS", width) and width.count(" AS ") <= 5


@pytest.mark.parametrize("name", ["fifo_facts", "fifo_allocation", "fifo_allocation_sweep", "lot_balance", "on_hand_from_lots", "sku_day_snapshot", "sku_location_day_snapshot", "snapshot_before", "inventory_value", "ledger_reconcile"])
def test_accepted_movements_are_not_stored_and_dealt_once(spark, name):
    before = stored(spark)
    df = plans.__dict__[name](spark, DIR)
    plan = plan_of(df)
    assert stored(spark) == before
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len(dealt) <= 3 + (name in ("snapshot_before", "inventory_value"))
    assert all("delta" not in line for line in plan.splitlines() if "MapInArrow" in line)


@pytest.mark.parametrize("name", ["lot_balance", "on_hand_from_lots", "sku_day_snapshot", "sku_location_day_snapshot", "inventory_value", "rejected_movements", "late_arrivals", "arrival_ledger", "fifo_allocation"])
def test_query_matches_sql(spark, name):
    same(spark, plans, name)


def test_reconciliation_by_rows_is_that_by_lots(spark):
    accepted = fifo.accept(moves(spark, [(k, "RRC"[k % 3], 2 + k % 4, 1 + k % 5) for k in range(60)])).where("rejected is null")
    rows = lambda df: sorted(map(str, df.select(sorted(df.columns)).collect()))
    assert rows(snapshots.reconcile(fifo.value(accepted, lots=True))) == rows(snapshots.reconcile(fifo.value(accepted), fifo.balance(accepted)))


def test_only_keys_in_which_a_late_row_precedes_others_are_valued_again(spark):
    early = moves(spark, [(k * 10, "RRC"[k % 3], 2, 1 + k % 5) for k in range(30)])
    other = lambda df, sku: df.withColumn("sku", F.lit(sku)).withColumn("event_id", F.concat("event_id", F.lit(f"-{sku}")))
    late = moves(spark, [(5, "R", 1, 9)]).withColumn("event_id", F.lit("late"))
    behind = other(moves(spark, [(900, "R", 1, 9)]), "SKU-2")
    level = moves(spark, [(290, "R", 1, 9)]).withColumns({"event_id": F.lit("a"), "sku": F.lit("SKU-3")})
    flagged = early.unionByName(other(early, "SKU-2")).unionByName(other(early, "SKU-3")).withColumn("late", F.lit(False)).unionByName(late.unionByName(behind).unionByName(level).withColumn("late", F.lit(True)))
    assert {r.sku for r in restate.overtaken(flagged).select("sku").distinct().collect()} == {"SKU-1", "SKU-3"}
    assert {r.sku for r in restate.restated_by(flagged).select("sku").collect()} == {"SKU-1", "SKU-3"}


def test_lots_of_all_marks_come_from_one_exchange(spark):
    accepted = fifo.accept(moves(spark, [(k * 10, "RRC"[k % 3], 2, 1 + k % 5) for k in range(60)])).where("rejected is null")
    marks = [-1, 100, 250, 10**6]
    got = restate.stored_lots(accepted, marks)
    assert plan_of(got).count("Exchange hashpartitioning(sku") == 1
    rows = lambda df: sorted(map(str, df.collect()))
    for m in marks:
        assert rows(got.where(F.col("as_of") == m).drop("as_of")) == rows(fifo.balance(accepted.where(F.col("sequence_engine_key") <= m)))
    assert restate.stored_lots(accepted, []).isEmpty()


def test_rows_meet_filters_of_two_sizes_and_are_read_once(spark):
    old = spark.range(3000).selectExpr("concat('id-', id) as event_id", "id % 3 as day")
    known = seen.filters(old.where("day < 2")).unionByName(seen.filters(old.where("day = 2"), rows=5000)).localCheckpoint()
    new = spark.range(2000, 6000).selectExpr("concat('id-', id) as event_id", "id as x").unionByName(spark.createDataFrame([(None, -1)], "event_id string, x long"))
    got = seen.unprocessed(new, old, known)
    assert {r.x for r in got.select("x").collect()} == {-1, *range(3000, 6000)} and got.count() == 3001
    assert got.columns == ["event_id", "x"] and plan_of(got).count("Range (2000, 6000") == 1
    asked = {(r.event_id, r.day) for r in seen.maybe_seen(new, known).collect()}
    assert asked >= {(f"id-{k}", k % 3) for k in range(2000, 3000)} and len(asked) < 1100


@pytest.mark.parametrize("name", ["dedup_redelivery", "claim_once", "fact_upsert"])
def test_redeliveries_match_sql_from_one_scan(spark, name):
    same(spark, plans, name)
    assert plan_of(plans.views.redelivered(spark, DIR)).count("FileScan") == 1


@pytest.mark.parametrize("name", ["fifo_allocation", "fifo_allocation_sweep"])
def test_allocation_sorts_a_key_twice_and_by_numbers(spark, name):
    plan = plan_of(plans.__dict__[name](spark, DIR))
    sorts = re.findall(r"Sort \[(.*?)\]", plan)
    assert len(sorts) == 3 and sum(s.startswith("_hash#") for s in sorts) == 2  # by id, by sequence, by ends
    assert "sum(supply" not in plan and "decimal(28,4)" not in plan and "Generate" not in plan


@pytest.mark.parametrize("most", [9, 10**14 - 1])
def test_ends_summed_in_the_pass_give_the_allocation_of_accepted_movements(spark, most):
    df = spark.range(900).selectExpr(
        "concat('e', lpad(id, 4, '0')) as event_id", "concat('S', hash(id) % 7) as sku", "if(id % 11 = 0, null, concat('L', id % 2)) as location_id", "id div 2 as sequence_engine_key",
        "cast(if(id % 97 = 0, null, 1 + pmod(hash(id, 1), 3)) as int) as movement_type",
        f"cast(if(id % 89 = 0, null, (pmod(hash(id, 2), 4) - 1) * {most}BD / 3 + pmod(id, 5)) as decimal(18,4)) as quantity", "cast(1 + id % 13 as decimal(18,4)) as unit_cost",
    ).localCheckpoint()
    rows = lambda d: sorted(map(str, d.select(sorted(d.columns)).collect()))
    with settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="7"):
        got = rows(fifo.allocation(df))
    accepted = fifo.accept(df).where("rejected is null").localCheckpoint()
    assert got == rows(fifo.allocate(accepted)) and len(got) > 200
    known = df.where("location_id is not null")
    assert rows(fifo.allocation(known)) == rows(fifo.allocate_by_overlap(accepted.where("location_id is not null")))


def test_a_row_holds_if_it_breaks_no_rule(spark):
    odd = ["5", "5\n", "-5", "-0.5", "1.00001", "1.00010", "1.000100000", "1e3", "", ".5", "5.", "99999999999999.9999", "999999999999999", "-1.00001", "\u0665", None]
    good = plans.views.movements(spark, DIR).limit(2)
    rows = good.drop("quantity", "unit_cost").crossJoin(spark.createDataFrame([(v,) for v in odd], "quantity string")).crossJoin(spark.createDataFrame([(v,) for v in odd], "unit_cost string"))
    both = contracts.violations(rows, contracts.MOVEMENT_RULES).withColumn("good", contracts.holds(contracts.MOVEMENT_RULES))
    assert both.where("good is null or good <> (size(errors) = 0)").isEmpty() and both.where("good").count() > 40
    text = str(contracts.holds(contracts.MOVEMENT_RULES))
    assert text.count("RLIKE") == 4 or text.count("rlike") == 4
