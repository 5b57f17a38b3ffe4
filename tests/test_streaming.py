import json
import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from lotflow.operators import restate
from lotflow.plans.ledger import _typed
from lotflow.schemas import MOVEMENT
from lotflow.streaming import ledger as live
from lotflow.streaming import stateful

from .helpers import DIR


def test_ingest_splits_and_restarts(spark, tmp_path):
    t = datetime(2024, 1, 1)
    row = lambda n, qty: (f"550e8400-e29b-41d4-a716-44665544{n:04d}", "00-" + "a" * 32 + "-" + "b" * 16 + "-01", "agg", t, t, None, str(500 + n), 1, "S", "V", "L", qty, "3.00")
    put = lambda rows, name: spark.createDataFrame(rows, MOVEMENT).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
    go = lambda: live.run_ingest(spark, f"{tmp_path}/in/*", f"{tmp_path}/good", f"{tmp_path}/dead", f"{tmp_path}/ck", log=f"{tmp_path}/log").awaitTermination(120)
    put([row(1, "7"), row(2, "oops"), row(1, "7")], "a")
    assert go()
    put([row(1, "7"), row(3, "9")], "b")
    assert go()
    good = spark.read.parquet(f"{tmp_path}/good").orderBy("sequence_engine_key").collect()
    assert [(r.sequence_engine_key, r.quantity) for r in good] == [(501, 7), (503, 9)]
    assert spark.read.parquet(f"{tmp_path}/log").count() == 3  # raw rows of both batches, the bad one too
    dead = spark.read.parquet(f"{tmp_path}/dead").collect()
    assert [(r.topic, [bytes(h.value) for h in r.headers]) for r in dead] == [("inventory.movement.v1.dlq", [b"quantity_format", b"inventory.movement.v1"])]


def test_arrival_facts_over_batches_equal_the_batch_form(spark, tmp_path):
    cols = ["event_id", "sku", "location_id", "sequence_engine_key", "movement_type", "quantity", "unit_cost", "occurred_at", "published_at"]
    typed = _typed(spark, DIR).select(*cols).where("sku in ('SKU-1', 'SKU-2', 'SKU-3')").withColumns({c: F.col(c).cast("timestamp") for c in ("occurred_at", "published_at")})
    for k, (a, b) in enumerate((("1990-01-01", "1997-01-01"), ("1997-01-01", "2000-01-01"), ("2000-01-01", "2100-01-01"))):
        typed.where(f"published_at >= timestamp'{a}' and published_at < timestamp'{b}'").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert stateful.run_facts(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(180)
    pick = lambda df: sorted((r.event_id, r.qty_on_hand, r.fifo_total_value) for r in df.collect())
    assert pick(stateful.upserted(spark, f"{tmp_path}/out")) == pick(restate.arrival_ledger(typed))


def test_workflow_survives_a_restart(spark, tmp_path):
    schema = "event_id string, kind string, sequence_engine_key long, approved_by string"

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.workflow_transitions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        assert stateful.started(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True), spark).awaitTermination(120)

    go([("e1", "trigger", 1, None), ("e2", "trigger", 1, None), ("x", "approval", 5, "u"), ("y", "approval", 1, "u"), ("y", "trigger", 2, None)])
    go([("e1", "approval", 2, "u"), ("e1", "approval", 3, "v"), ("e1", "trigger", 4, None)])
    live.append_outbox(f"{tmp_path}/outbox")(spark.createDataFrame([("wf-e", "t", 1, datetime(2024, 1, 1), "NodeTransition", "{}")], "workflow_id string, trace_parent string, sequence_engine_key long, occurred_at timestamp, event_type string, payload string"), 3)
    assert [(r.aggregate_id, bytes(r.payload), r.batch) for r in spark.read.parquet(f"{tmp_path}/outbox").collect()] == [("wf-e", b"{}", 3)]
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.node_id for r in rows if r.event_id == "e1" and r.disposition == "accepted") == ["final_step", "human_approval"]
    assert sorted((r.event_id, r.disposition) for r in rows if r.disposition != "accepted") == [("e1", "created"), ("e1", "duplicate"), ("e1", "duplicate"), ("e2", "created"), ("x", "no_workflow"), ("y", "created"), ("y", "stray")]


def test_settled_figures_and_changefeed(spark, tmp_path):
    schema = "sequence_engine_key long, status string, value double, sla_breached boolean, resolved long"
    batches = [
        [(1, "SUCCESS", 2.0, False, None), (2, "FAILURE", None, None, None), (9, "SUCCESS", 5.0, None, None), (None, None, None, None, 5)],
        [(3, "SUCCESS", 1.0, None, None), (15, "SUCCESS", 4.0, True, None)],
        [(None, None, None, None, 20)],
    ]
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert live.settled_figures(spark, f"{tmp_path}/in", f"{tmp_path}/ck", f"{tmp_path}/out", f"{tmp_path}/waiting", schema).awaitTermination(120)
    got = spark.read.parquet(f"{tmp_path}/out").orderBy("batch").collect()
    assert [(r.watermark, r.settled, r.in_flight, r.settled_value, r.exceptions) for r in got] == [(5, 2, 1, 2.0, 1), (5, 3, 2, 3.0, 1), (20, 5, 0, 12.0, 2)]
    assert spark.read.schema(schema).parquet(f"{tmp_path}/waiting/batch=2").count() == 0
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in").where("resolved is null").select("sequence_engine_key", "status")
    assert live.run_changefeed(stream, "t", "sequence_engine_key", f"{tmp_path}/feed", f"{tmp_path}/ck2").awaitTermination(120)
    values = [r.value for r in spark.read.parquet(f"{tmp_path}/feed/sent").collect()]
    assert len(values) == 6 and sum('"resolved":"15"' in v for v in values) == 1


def test_dedup_within_watermark(spark, tmp_path):
    t = datetime(2024, 1, 1)
    spark.createDataFrame([("a", t), ("a", t + timedelta(minutes=1)), ("b", t)], "event_id string, at timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = live.deduplicated(spark.readStream.schema("event_id string, at timestamp").parquet(f"{tmp_path}/in"), "at", "1 hour")
    assert stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    assert sorted(r.event_id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == ["a", "b"]
    assert Decimal(1)


def test_leases_run_out_once_and_workflows_are_forgotten(spark, tmp_path):
    schema = "event_id string, kind string, sequence_engine_key long, at timestamp"
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = stateful.workflow_transitions(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "at", "1 hour", keep_days=10)
        assert stateful.started(stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True), spark).awaitTermination(120)

    go([("slow", "trigger", 1, day(0)), ("fast", "trigger", 1, day(0)), ("fast", "approval", 2, day(0))])
    go([("other", "trigger", 1, day(2))])  # the watermark passes the lease of the slow one
    go([("slow", "approval", 2, day(3)), ("fast", "approval", 3, day(3))])
    go([("other", "approval", 2, day(20))])
    go([("fast", "approval", 4, day(21)), ("other", "approval", 3, day(21))])
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    told = sorted((r.event_id, r.disposition) for r in rows if r.disposition not in ("created", "accepted"))
    assert told == [("fast", "duplicate"), ("fast", "no_workflow"), ("other", "duplicate"), ("slow", "overdue")]
    assert sorted({r.event_id for r in rows if r.disposition == "accepted"}) == ["fast", "other", "slow"]


def test_state_store_is_set_for_its_query_alone(spark, tmp_path):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    stream = stateful.workflow_transitions(spark.readStream.schema("event_id string, kind string, sequence_engine_key long").parquet(f"{tmp_path}"))
    stateful.started(stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True), spark).awaitTermination(120)
    assert spark.conf.get(name) == before


def test_watermarks_are_promises(spark, tmp_path):
    schema = "part int, updated long, v string"

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        assert live.run_changefeed(stream, "t", "updated", f"{tmp_path}/feed", f"{tmp_path}/ck", "part", 2).awaitTermination(120)

    go([(0, 10, "a"), (0, 30, "b")])  # the other source is not heard of yet
    go([(1, 5, "c"), (1, 12, "d")])  # older than what went out
    go([(0, 31, "e"), (1, 40, "f")])
    go([(1, 7, "broken"), (1, 41, "g")])  # out of its source's order, behind what was promised
    go([(1, 42, "h")])
    sent = spark.read.parquet(f"{tmp_path}/feed/sent").select("batch", "value").collect()
    marks = {r.batch: int(json.loads(r.value)["resolved"]) for r in sent if "resolved" in r.value}
    rows = [(r.batch, int(json.loads(r.value)["updated"])) for r in sent if "resolved" not in r.value]
    assert marks == {1: 12, 2: 31}
    assert sorted(u for _, u in rows) == [5, 10, 12, 30, 31, 40, 41, 42]
    assert all(u > m for b, u in rows for at, m in marks.items() if b > at)
    assert [(r.batch, r.v) for r in spark.read.parquet(f"{tmp_path}/feed/late").collect()] == [(3, "broken")]


def test_store_of_many_batches(spark, tmp_path):
    from lotflow.streaming.store import Upserts

    rng, newest, runs = random.Random(3), {}, []
    open_store = lambda: Upserts(spark, f"{tmp_path}/store", "k string, v long, at int", ["k"], ["at"], fan=4, levels=3)
    store = open_store()
    for b in range(50):
        rows = [(f"k{rng.randint(0, 40)}", rng.randint(0, 9), rng.randint(0, 5)) for _ in range(rng.randint(0, 12))]
        batch = spark.createDataFrame(list({(k, at): (k, v, at) for k, v, at in rows}.values()), "k string, v long, at int")
        if b in (7, 15, 16, 40):  # dies inside its merge, and comes again
            broken = open_store()
            broken._publish = lambda *_: 1 / 0
            with pytest.raises(ZeroDivisionError):
                broken.merge(batch, b)
        store.merge(batch, b)
        if b % 9 == 0:
            open_store().merge(spark.createDataFrame([("k0", -1, 99)], "k string, v long, at int"), b)  # this batch was merged already
        for r in sorted(batch.collect(), key=lambda r: r.at):
            newest[r.k] = (r.v, r.at)
        runs.append(len(store.runs()))
    assert {r.k: (r.v, r.at) for r in open_store().read().collect()} == newest
    assert max(runs) <= 3 + 3 + 1, "reads do not grow with the batches"
    assert open_store().read().columns == ["k", "v", "at"]
    assert Upserts(spark, f"{tmp_path}/none", "k string", ["k"], []).read().collect() == []


def test_live_rows_after_history(spark, tmp_path):
    schema = "aggregate_id string, sequence_engine_key long, status string"
    history = spark.createDataFrame([("a", 1, "h"), ("a", 5, "h"), ("b", 3, "h"), ("quiet", 9, "h")], schema)

    def go(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        live_rows = stateful.live_after(history, spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
        writer = live_rows.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True)
        assert stateful.started(writer, spark).awaitTermination(120)

    go([("a", 5, "l"), ("a", 2, "late"), ("a", 7, "l"), ("a", 7, "again"), ("new", 1, "l"), (None, 4, "l"), ("b", None, "l")])
    go([("a", 7, "l"), ("a", 8, "l"), ("a", 1, "l"), ("b", 3, "l"), ("b", 2, "late"), ("quiet", 9, "l"), ("quiet", 10, "l")])
    got = sorted((r.aggregate_id, r.sequence_engine_key) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out").collect())
    assert got == [("a", 2), ("a", 7), ("a", 8), ("b", 2), ("new", 1), ("quiet", 10)]
