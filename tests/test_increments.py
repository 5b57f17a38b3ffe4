import random

import pytest
from pyspark.sql import functions as F

from lotflow.operators import fifo, restate, seen
from lotflow.plans import ledger as plans

from .helpers import DIR
from .test_ledger import moves

COLUMNS = ["event_id", "old_unit_cost", "new_unit_cost", "old_total_value", "new_total_value"]


def rows_of(df):
    return sorted(map(str, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("marks", [[], [50], [50, 400, 900], [10**9]])
def test_valuation_from_stored_lots_is_the_whole_one(spark, marks):
    rng = random.Random(4)
    rows = [(k * 10, rng.choice("RRCA"), rng.randint(1, 20) if k % 3 else rng.randint(-5, 9), rng.randint(1, 9)) for k in range(120)]
    rows = [(s, k, abs(q) if k != "A" else q, c) for s, k, q, c in rows]
    early = moves(spark, rows)
    early = early.unionByName(early.withColumn("sku", F.lit("SKU-2")).withColumn("event_id", F.concat("event_id", F.lit("-2"))))
    for at in ([455, 1001], [5], [], [905]):
        late = moves(spark, [(s, "R", 7, 3) for s in at] or [(1, "R", 1, 1)]).withColumn("event_id", F.concat(F.lit("late-"), "event_id")).where(F.lit(bool(at)))
        stored = restate.stored_lots(fifo.accept(early).where("rejected is null"), marks) if marks else fifo.balance(fifo.accept(early.limit(0))).withColumn("as_of", F.lit(0).cast("long"))
        got = restate.restated_since(early, late, stored, marks)
        assert rows_of(got) == rows_of(restate.restated(early, late))


def test_older_movements_are_not_read(spark, tmp_path):
    early = moves(spark, [(k * 10, "RRC"[k % 3], 2, 1 + k % 5) for k in range(300)])
    early.repartitionByRange(10, "sequence_engine_key").sortWithinPartitions("sequence_engine_key").write.parquet(f"{tmp_path}/m")
    kept, late = spark.read.parquet(f"{tmp_path}/m"), moves(spark, [(2505, "R", 1, 9)])
    stored = restate.stored_lots(fifo.accept(early).where("rejected is null"), [1000, 2500])
    read = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def met(seq):
        read.add(1)
        return True

    watched = kept.withColumn("seen", met("sequence_engine_key")).where("seen").drop("seen")
    got = rows_of(restate.restated_since(watched, late, stored, [1000, 2500]))
    assert got == rows_of(restate.restated(early, late)) and got
    assert read.value <= 4 * 50, "movements up to the mark stay unread"


def test_queries_agree(spark):
    from .helpers import same

    for name in ("incremental_valuation", "claim_unseen"):
        same(spark, plans, name)
    assert not plans.incremental_valuation(spark, DIR).isEmpty()


def test_filters_lose_nothing_and_point_to_little_else(spark):
    old = spark.range(30_000).selectExpr("concat('id-', id) as event_id", "id % 5 as day").unionByName(spark.createDataFrame([(None, 1)], "event_id string, day long"))
    new = spark.range(29_000, 60_000).selectExpr("concat('id-', id) as event_id", "id as x")
    known = seen.filters(old)
    words = known.agg(F.count("*"), F.max("blocks")).first()
    assert words[0] <= 5 * words[1] and 512 * words[1] * 5 < 21 * 30_000 + 5 * 512, "20 bits an id"
    asked = seen.maybe_seen(new, known)
    true = asked.join(old, ["event_id", "day"], "left_semi").count()
    assert true == 1000 and asked.select("event_id").distinct().count() - 1000 < 0.02 * 30_000
    out = seen.unprocessed(new.unionByName(new.limit(0)).unionByName(spark.createDataFrame([(None, -1)], "event_id string, x long")), old, known)
    assert out.count() == 30_001 and out.where("x between 29000 and 29999").isEmpty()
    assert seen.unprocessed(new, old.limit(0), seen.filters(old.limit(0))).count() == 31_000


