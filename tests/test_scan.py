import random

import pytest
from pyspark.sql import functions as F

from lotflow.operators import fifo, scan, settlement, snapshots
from lotflow.plans import ledger as plans

from .helpers import DIR


def rows_of(n, hot, seed=3):
    rng = random.Random(seed)
    order = rng.sample(range(10 * n), n)
    return [(None if rng.random() < 0.02 else "hot" if rng.random() < hot else f"k{rng.randint(0, 30)}", k, None if rng.random() < 0.3 else rng.randint(-9, 9), rng.choice([None, f"v{k}"])) for k in order]


@pytest.mark.parametrize("hot,segments", [(0.4, 9), (1.0, 40), (0.0, 1), (0.5, 300)])
def test_running_equals_a_window(spark, hot, segments):
    df = spark.createDataFrame(rows_of(3000, hot), "k string, o long, x int, v string").repartition(7)
    over = "partition by k order by o rows unbounded preceding"
    want = df.selectExpr("k", "o", "x", f"sum(x) over ({over}) as total", f"last(v, true) over ({over}) as v")
    got = scan.running(df, ["k"], ["o"], {"total": "x"}, {"v": "v"}, segments)
    pick = lambda d: sorted(map(str, d.select("k", "o", "x", "total", "v").collect()))
    assert pick(got) == pick(want)


def test_odd_orders(spark):
    same = spark.createDataFrame([("k", 5, 1)] * 20 + [("k", None, 2), ("j", None, 3)], "k string, o long, x int")
    got = scan.running(same, ["k"], ["o"], {"total": "x"}, segments=8).collect()
    assert sorted(r.total for r in got if r.k == "k") == [*range(2, 23)] and [r.total for r in got if r.k == "j"] == [3]
    assert scan.running(same.limit(0), ["k"], ["o"], {"total": "x"}, segments=8).collect() == []
    times = spark.sql("select 'k' as k, timestamp'2024-01-01' + make_interval(0,0,0,cast(id as int)) as o, 1 as x from range(50)")
    assert sorted(r.total for r in scan.running(times, ["k"], ["o"], {"total": "x"}, segments=6).collect()) == [*range(1, 51)]


def test_no_task_holds_a_whole_feed(spark):
    n, segments = 40_000, 16
    feed = spark.range(n).selectExpr("concat('o', substring(cast(id as string), 1, 0), 'ne') as topic", "id as offset", "if(id % 50 = 0, id, null) as watermark")
    marked = feed.withColumn("_key", F.struct("topic")).withColumn("_segment", scan.segment_of("offset", scan.bounds(feed, "offset", segments)))
    sizes = [r["count"] for r in marked.groupBy("_key", "_segment").count().collect()]
    assert len(sizes) == segments and max(sizes) < 1.3 * n / segments
    got = scan.running(feed, ["topic"], ["offset"], lasts={"in_force": "watermark"}, segments=segments)
    plan = got._jdf.queryExecution().executedPlan().toString()
    big = [line for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert all("_key" in line for line in big) and sum("_segment" not in line for line in big) <= 1, "only the carries are dealt by key alone"
    assert got.where("in_force <> offset - offset % 50").isEmpty() and got.count() == n
    assert settlement.watermark_in_force(feed).where("in_force <> offset - offset % 50").isEmpty()


def test_facts_and_lookups_in_segments(spark):
    accepted = fifo.accept(plans._typed(spark, DIR)).where("rejected is null").withColumn("sku", F.lit("hot")).limit(1500)
    accepted = fifo.accept(accepted.drop("delta", "supply", "demand", "rejected")).where("rejected is null")
    rows = spark.createDataFrame(accepted.collect(), accepted.schema)
    pick = lambda d: sorted(map(str, d.select("event_id", "qty_on_hand", "fifo_total_value", "moving_avg_cost", "fifo_unit_cost").collect()))
    whole, parts = fifo.value(rows), fifo.value(rows, segments=7)
    assert pick(whole) == pick(parts)
    facts = whole.select("sku", "location_id", "sequence_engine_key", "qty_on_hand")
    probes = facts.selectExpr("monotonically_increasing_id() as id", "sku", "location_id", "sequence_engine_key + cast(sequence_engine_key % 2 as long) as at_sequence")
    probes = spark.createDataFrame(probes.collect(), probes.schema)
    pick = lambda d: sorted(map(str, d.select("id", "sequence_engine_key", "qty_on_hand").collect()))
    assert pick(snapshots.before(probes, facts)) == pick(snapshots.before(probes, facts, segments=5))
