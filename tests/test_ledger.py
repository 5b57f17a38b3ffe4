import random
import time
from datetime import datetime, timedelta
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pytest
from pyspark.sql import functions as F

from lotflow.operators import contracts, dedup, fifo, restate, snapshots
from lotflow.plans import ledger as plans

T0 = datetime(2024, 1, 1)
TYPED = "event_id string, sku string, location_id string, mdm_vendor_id string, sequence_engine_key long, movement_type int, quantity decimal(18,4), unit_cost decimal(18,4), occurred_at timestamp, published_at timestamp"


def moves(spark, rows):
    """rows: (seq, type, quantity, cost) in order of arrival, or with an age in days."""
    data = [(f"e{n}-{r[0]}", "SKU-1", "LOC-1", "V", r[0], "?RCA".index(r[1]), Decimal(r[2]), Decimal(r[3]), T0 + timedelta(minutes=n) - timedelta(days=r[4] if len(r) > 4 else 0), T0 + timedelta(minutes=n)) for n, r in enumerate(rows)]
    return spark.createDataFrame(data, TYPED)


def last(df):
    return df.orderBy(F.desc("sequence_engine_key")).first()


@pytest.mark.parametrize(
    "rows,on_hand,value,unit,average",
    [
        ([(100, "R", 10, 2)], 10, 20, 0, 2),
        ([(100, "R", 10, 2), (200, "R", 10, 5), (300, "R", 80, 1)], 100, 150, 0, 1.5),
        ([(100, "R", 10, 2), (200, "R", 10, 5), (300, "C", 15, 0)], 5, 25, 3, 5),
        ([(900, "R", 10, 9), (100, "R", 10, 1), (950, "C", 10, 0)], 10, 90, 1, 9),
        ([(100, "A", 7, 3)], 7, 21, 0, 3),
        ([(100, "R", 10, 4), (200, "A", -3, 0)], 7, 28, 4, 4),
        ([(100, "R", 5, 2), (200, "C", 6, 0)], 5, 10, 0, 2),
    ],
)
def test_golden_facts(spark, rows, on_hand, value, unit, average):
    r = last(fifo.facts(moves(spark, rows)))
    assert (r.qty_on_hand, r.fifo_total_value, r.fifo_unit_cost, r.moving_avg_cost) == (on_hand, value, unit, Decimal(str(average)))


def test_rejection_and_zero(spark):
    got = {r.sequence_engine_key: r.rejected for r in fifo.accept(moves(spark, [(100, "R", 5, 2), (200, "C", 6, 0), (300, "C", 5, 0), (400, "C", 0, 0), (500, "C", 1, 0), (600, "R", 1, 1)])).collect()}
    assert got == {100: None, 200: "exceeds_on_hand", 300: None, 400: "zero_quantity", 500: "exceeds_on_hand", 600: None}


def test_lots_in_order(spark):
    lots = fifo.balance(fifo.accept(moves(spark, [(300, "R", 5, 3), (100, "R", 5, 1), (200, "R", 5, 2), (400, "C", 7, 0)])).where("rejected is null"))
    assert [(r.sequence_engine_key, r.remaining_qty) for r in lots.orderBy("sequence_engine_key").collect()] == [(200, 3), (300, 5)]


def plain_fifo(rows):
    """An independent fold over (seq, type, quantity, cost)."""
    lots, out = [], {}
    for seq, kind, q, cost in sorted(rows):
        need = q if kind == "C" else -q if kind == "A" and q < 0 else 0
        if need > sum(x[0] for x in lots) or kind == "C" and q == 0:
            continue
        cogs, left = Decimal(0), Decimal(need)
        while left > 0:
            take = min(left, lots[0][0])
            cogs, left, lots[0][0] = cogs + take * lots[0][1], left - take, lots[0][0] - take
            if not lots[0][0]:
                lots.pop(0)
        if kind != "C" and q > 0:
            lots.append([Decimal(q), Decimal(cost)])
        out[seq] = (sum(x[0] for x in lots), sum((x[0] * x[1] for x in lots), Decimal(0)), cogs)
    return out


def test_facts_against_a_plain_fold(spark):
    import random

    rng = random.Random(1)
    for _ in range(4):
        rows = [(k * 10, rng.choice("RRCA"), rng.randint(-9, 20), rng.randint(1, 9)) for k in range(120)]
        rows = [(s, k, abs(q) if k != "A" else q, c) for s, k, q, c in rows]
        df = moves(spark, rng.sample(rows, len(rows)))
        got = {r.sequence_engine_key: (r.qty_on_hand, r.fifo_total_value) for r in fifo.facts(df).collect()}
        assert got == {s: v[:2] for s, v in plain_fifo(rows).items()}
        accepted = fifo.accept(df).where("rejected is null")
        pick = lambda d: sorted(tuple(r) for r in d.select("lot_id", "consumption_id", "taken", "cost").collect())
        assert pick(fifo.allocate(accepted)) == pick(fifo.allocate_by_overlap(accepted))


def test_restatement(spark):
    df = moves(spark, [(200, "R", 10, 5), (300, "C", 5, 0), (100, "R", 10, 2)])
    rows = {r.sequence_engine_key: r for r in restate.arrival_ledger(df).collect()}
    assert len(rows) == 3 and rows[300].fifo_unit_cost == 2 and rows[300].qty_on_hand == 15 and rows[300].fifo_total_value == 60 and rows[300].outcome == "restated"
    delta = restate.restated(df.where("sequence_engine_key > 100"), df.where("sequence_engine_key = 100")).collect()
    assert {(r.old_unit_cost, r.new_unit_cost) for r in delta if r.event_id == "e1-300"} == {(5, 2)}


def test_beyond_horizon_is_adjusted(spark):
    rows = restate.arrival_ledger(moves(spark, [(500, "R", 10, 5), (100, "R", 4, 1, 40)])).collect()
    assert {(r.sequence_engine_key, r.outcome) for r in rows} == {(500, "appended"), (100, "adjusted")} and max(r.qty_on_hand for r in rows) == 14
    flagged = restate.late_policy(restate.flag_late(moves(spark, [(500, "R", 10, 5), (100, "R", 4, 1, 40), (200, "R", 4, 1, 29), (300, "R", 4, 1)])))
    assert {r.sequence_engine_key: r.policy for r in flagged.collect()} == {500: "append", 100: "adjust", 200: "restate", 300: "restate"}


def test_stale_consumption_signs():
    for sign, on_hand in (("reference", 13), ("signed", 7)):
        k = restate.KeyLedger(late_sign=sign)
        k.arrive((500, "a", 1, Decimal(10), Decimal(5)), 0)
        assert k.arrive((100, "b", 2, Decimal(3), Decimal(1)), 40)[1][0][4] == on_hand
    assert k.arrive((500, "a", 1, Decimal(10), Decimal(5)), 0) == ("duplicate", [])


def test_in_order_arrival_equals_sequence_order(spark):
    rows = [(k * 10, "RRCR"[k % 4], 3 + k % 5, 1 + k % 7) for k in range(60)]
    df = moves(spark, rows)
    a = {r.event_id: (r.qty_on_hand, r.fifo_total_value) for r in restate.arrival_ledger(df).collect()}
    assert a == {r.event_id: (r.qty_on_hand, r.fifo_total_value) for r in fifo.facts(df).collect()}


def test_snapshot_before(spark):
    facts = spark.createDataFrame([("S", "L", 100, 10), ("S", "L", 200, 25), ("S", "L", 300, 40)], "sku string, location_id string, sequence_engine_key long, qty long")
    probes = spark.createDataFrame([(1, "S", "L", 300), (2, "S", "L", 1000), (3, "S", "L", 50), (4, "X", "L", 9)], "id int, sku string, location_id string, at_sequence long")
    assert {r.id: r.qty for r in snapshots.before(probes, facts).collect()} == {1: 25, 2: 40, 3: None, 4: None}


def test_contract(spark):
    good = ("550e8400-e29b-41d4-a716-446655440000", "00-" + "a" * 32 + "-" + "b" * 16 + "-01", "agg", T0, T0, None, "1784933243325766766", 1, "S", "V", "L", "7", "3.00")
    rows = [good, ("definitely-not-a-uuid", *good[1:]), (*good[:6], "9223372036854775813", *good[7:]), (*good[:11], "1e3", "-1"), (*good[:3], None, None, None, None, None, None, None, None, None, None)]
    from lotflow.schemas import MOVEMENT

    ok, bad = contracts.split_valid(spark.createDataFrame(rows, MOVEMENT), contracts.MOVEMENT_RULES)
    typed = contracts.typed_movements(ok).collect()
    assert [r.sequence_engine_key for r in typed] == [1784933243325766766] and typed[0].quantity == 7
    assert sorted(len(r.errors) for r in bad.collect()) == [1, 1, 2, 9]


def test_dedup(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1), ("c", 3)], "k string, t int")
    done = spark.createDataFrame([("b", 9)], "k string, z int")
    assert sorted(map(tuple, dedup.claim(df, done, ["k"], ["t"]).collect())) == [("a", 1), ("c", 3)]
    assert sorted(map(tuple, dedup.keep_last(df, ["k"], ["t"]).collect())) == [("a", 2), ("b", 1), ("c", 3)]


@pytest.mark.parametrize("name", ["fifo_facts", "restatement_delta", "ledger_reconcile", "snapshot_before"])
def test_query_matches_sql(spark, name):
    from .helpers import same

    same(spark, plans, name)


def plain_lots(ops):
    """On hand and value after each of (seq, id, type, quantity, cost), from nothing; None if one takes too much."""
    lots, after = {}, {}
    for seq, name, kind, quantity, cost in ops:
        change = -quantity if kind == 2 else quantity
        if kind == 1 or change > 0 and kind == 3:
            lots[seq, name] = [quantity, cost]
        elif change < 0:
            if -change > sum(q for q, _ in lots.values() if q > 0):
                return None
            for key in sorted(lots):
                take = max(0, min(-change, lots[key][0]))
                lots[key][0] -= take
                change += take
        after[name] = (sum(q for q, _ in lots.values()), sum(q * c for q, c in lots.values()))
    return lots, after


def plain_arrivals(rows):
    """id -> last (on hand, value): the whole history is folded anew at every arrival."""
    ops, log, facts = [], [], {}
    for event, age in rows:
        if event[2] == 2 and event[3] == 0:
            continue
        lots = plain_lots(ops)[0]
        late = any(q > 0 and seq > event[0] for (seq, _), (q, _) in lots.items())
        new = sorted([*log, event]) if late and age <= 30 else [*ops, (*event[:2], 3 if late else event[2], *event[3:])]
        folded = plain_lots(new)
        if folded is None:
            continue
        ops = new
        log.append(event)
        facts.update(folded[1] if late and age <= 30 else {event[1]: folded[1][event[1]]})
    return facts


def test_arrival_ledger_against_a_fold_from_nothing(spark):
    rng, data, want = random.Random(21), [], {}
    for k in range(250):
        rows = []
        for n in range(rng.randint(1, 14)):
            kind = rng.choice([1, 1, 2, 2, 3])
            event = (rng.randint(1, 40), f"{k:03d}-{n:02d}", kind, rng.randint(-4, 6) if kind == 3 else rng.randint(0 if kind == 2 else 1, 6), rng.randint(1, 9))
            rows.append((event, rng.choice([0, 1, 29, 31, 90])))
            at = T0 + timedelta(minutes=n)
            data.append((event[1], f"SKU-{k}", "L", "V", event[0], kind, Decimal(event[3]), Decimal(event[4]), at - timedelta(days=rows[-1][1]), at))
        want.update(plain_arrivals(rows))
    got = restate.arrival_ledger(spark.createDataFrame(data, TYPED)).collect()
    assert {r.event_id: (r.qty_on_hand, r.fifo_total_value) for r in got} == want and len({r.outcome for r in got}) == 3


def plain_refusals(starts, change, down, on_hand):
    out = []
    for n, (new, by, need) in enumerate(zip(starts, change, down)):
        on_hand = 0 if new and n else on_hand
        out.append(need > on_hand)
        on_hand += 0 if need > on_hand else by
    return out, on_hand


def test_refusals_against_a_loop():
    rng = np.random.default_rng(1)
    for t in range(600):
        n = int(rng.integers(1, 200))
        starts = rng.random(n) < rng.choice([0.01, 0.1, 0.5])
        starts[0] = True
        down = np.where(rng.random(n) < rng.choice([0.3, 0.5, 0.9]), rng.integers(0, 10, n), 0)
        up = np.where(down == 0, rng.integers(0, 6, n), 0)
        if t % 50 == 0:  # beyond what a 64-bit running sum holds
            up, down = up * 10**17, down * 10**17
        refused, left = fifo.refusals(starts, up - down, down, t % 20)
        assert (refused.tolist(), left) == plain_refusals(starts.tolist(), (up - down).tolist(), down.tolist(), t % 20)


def test_accept_over_many_batches_and_null_keys(spark):
    rng = random.Random(3)
    rows = [(f"e{n:05d}", rng.choice(["S", None]), rng.choice(["L", None]), "V", n, rng.choice([1, 2, 2, 3]), Decimal(rng.randint(0, 9)), Decimal(1), T0, T0) for n in range(3000)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        got = {r.event_id: r.rejected for r in fifo.accept(spark.createDataFrame(rows, TYPED)).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, held = {}, {}
    for name, sku, place, _, _, kind, q, *_ in rows:
        have = held.get((sku, place), 0)
        want[name] = "zero_quantity" if kind == 2 and not q else "exceeds_on_hand" if kind == 2 and q > have else None
        if want[name] is None:
            held[sku, place] = have + (-q if kind == 2 else q)
    assert got == want


@pytest.mark.parametrize("quantity,cost", [(1_000_000, 2_000_000), (5_000_000, 2_000_000), (10**13, 10**13), (99_999_999_999_999, 99_999_999_999_999)])
def test_values_beyond_a_million_million(spark, quantity, cost):
    df = moves(spark, [(100, "R", quantity, cost), (200, "R", 7, Decimal("0.0003")), (300, "C", quantity - 4, 0), (400, "C", 8, 0)])
    got = {r.sequence_engine_key: r for r in fifo.facts(df).collect()}
    assert got[100].fifo_total_value == quantity * cost and got[100].moving_avg_cost == cost
    assert got[300].fifo_unit_cost == cost and got[300].fifo_total_value == 4 * cost + Decimal("0.0021")
    assert got[400].fifo_unit_cost == Decimal(4 * cost + Decimal("0.0012")) / 8


def test_quotients_are_exact(spark):
    rng = random.Random(9)
    with localcontext() as exact:
        exact.prec = 90
        rows = [(Decimal(rng.randint(0, 10 ** rng.randint(1, 30))) / 10 ** rng.randint(0, 8), Decimal(rng.randint(1, 10 ** rng.randint(1, 18))) / 10 ** rng.randint(0, 4)) for _ in range(1500)]
        rows = [(t, low) for t, low in ((t.quantize(Decimal("1e-8")), low.quantize(Decimal("1e-4"))) for t, low in rows) if low and t / low < 10**18]
        got = spark.createDataFrame(rows, "t decimal(38,8), low decimal(28,4)").select("t", "low", F.expr(fifo.quotient("t", "low")).alias("q")).collect()
        assert all(r.q == (r.t / r.low).quantize(Decimal("1e-16"), rounding=ROUND_HALF_UP) for r in got) and len(got) > 1000


def test_values_beyond_their_column_are_null(spark):
    most = 99_999_999_999_999
    df = moves(spark, [(k, "R", most, most) for k in range(1, 130)] + [(500, "C", 1, 0)])
    got = {r.sequence_engine_key: r for r in fifo.facts(df).collect()}
    assert got[50].fifo_total_value == 50 * most * most and got[129].fifo_total_value is None
    assert got[500].fifo_unit_cost == most and got[500].qty_on_hand == 129 * most - 1


def test_contract_holds_to_the_end_of_a_text(spark):
    from lotflow.schemas import MOVEMENT

    good = ("550e8400-e29b-41d4-a716-446655440000", "00-" + "a" * 32 + "-" + "b" * 16 + "-01", "agg", T0, T0, None, "17", 1, "S", "V", "L", "7.50000", "3.00")
    put = lambda at, v: (*good[:at], v, *good[at + 1 :])
    rows = [good, put(0, good[0] + "\n"), put(1, good[1] + "\n"), put(11, "5\n"), put(12, "5\n"), put(11, "0.00004"), put(12, "1.123450"), put(6, "17\n")]
    got = contracts.violations(spark.createDataFrame(rows, MOVEMENT), contracts.MOVEMENT_RULES).select("errors").collect()
    assert [r.errors for r in got][:7] == [[], ["event_id_uuid"], ["trace_parent_format"], ["quantity_format"], ["unit_cost_format"], ["quantity_too_fine"], ["unit_cost_too_fine"]]


class SlowLedger:
    """The ledger's rules as they read: every late row replays the whole log."""

    def __init__(self, late_sign):
        self.lots, self.log, self.seen, self.late_sign = [], [], set(), late_sign

    @staticmethod
    def apply(lots, kind, event):
        seq, event_id, _, quantity, cost = event
        need = max(quantity, 0) if kind == 2 else max(-quantity, 0) if kind == 3 else 0
        if need > sum(x[2] for x in lots):
            return None
        cogs, left = 0, need
        for lot in lots:
            take = min(left, lot[2])
            cogs, left, lot[2] = cogs + take * lot[3], left - take, lot[2] - take
        lots[:] = sorted([x for x in lots if x[2]] + ([[seq, event_id, quantity, cost]] if kind in (1, 3) and quantity > 0 else []))
        return event_id, seq, -quantity if kind == 2 else quantity, (cogs, need), sum(x[2] for x in lots), sum(x[2] * x[3] for x in lots)

    def arrive(self, event, age):
        seq, event_id, kind, quantity, cost = event
        if event_id in self.seen or kind == 2 and quantity == 0:
            return "duplicate" if event_id in self.seen else "zero_quantity", []
        late = bool(self.lots) and seq < self.lots[-1][0]
        if late and age <= 30:
            lots = []
            facts = [self.apply(lots, e[2], e) for e in sorted([*self.log, event])]
            if None in facts:
                return "rejected", []
            self.lots, outcome = lots, "restated"
        else:
            sign = -1 if late and self.late_sign == "signed" and kind == 2 else 1
            facts = [self.apply(self.lots, 3 if late else kind, (seq, event_id, kind, sign * quantity, cost))]
            if None in facts:
                return "rejected", []
            outcome = "adjusted" if late else "appended"
        self.log.append(event)
        self.seen.add(event_id)
        return outcome, facts


@pytest.mark.parametrize("sign", ["reference", "signed"])
def test_ledger_by_sums_against_replays(sign):
    rng, told = random.Random(sign), set()
    for trial in range(250):
        slow, quick, last = SlowLedger(sign), restate.KeyLedger(sign), {}
        for k in range(rng.randint(1, 40)):
            seq = k * 10 if rng.random() < 0.6 + 0.3 * (trial % 2) else rng.randint(0, 10 * k + 9)
            kind = rng.choice([1, 1, 1, 2, 2, 3, 3, 0])
            quantity = rng.choice([-2, 0, 1, 3, 5, 9, 12]) if kind != 2 else rng.choice([0, 1, 3, 6, 9, -1])
            event, age = (seq, f"e{rng.randint(0, 60) if rng.random() < 0.1 else 100 + k}", kind, quantity, rng.randint(0, 9)), rng.choice([0, 5, 30, 31, float("nan")])
            outcome, facts = slow.arrive(event, age)
            last.update({f[0]: (outcome, f) for f in facts})
            got, changed = quick.arrive(event, age)
            assert got == outcome and {f[0]: f for f in changed}.items() <= {f[0]: f for f in facts}.items()
            assert dict(zip((e[1] for e in quick.log), zip(quick.outcomes(), quick.facts(0, len(quick))))) == last
            told.add(got)
            if rng.random() < 0.2:
                quick = restate.KeyLedger.restored(rng.sample(rows := list(quick.rows_at(range(len(quick)))), len(rows)), quick.sums(), (quick.lots or [])[quick.head :], sign)
    assert told == {"appended", "adjusted", "restated", "rejected", "duplicate", "zero_quantity"}


def test_cost_of_a_row_follows_what_it_changes():
    ledger, began = restate.KeyLedger(), time.process_time()
    for k in range(100_000):
        ledger.take((k, f"e{k}", 1, 10_000, 20_000), 0)
    assert time.process_time() - began < 4  # under a second where nothing else runs
    began = time.process_time()
    for k in range(50):
        assert ledger.take((99_900 + k, f"x{k}", 1, 10_000, 20_000), 0)[0] == "restated"
    assert time.process_time() - began < 1
    assert ledger.held[-1] == 100_050 * 10_000


def test_arrivals_of_any_size(spark):
    most = 99_999_999_999_999
    rows = restate.arrival_ledger(moves(spark, [(200, "R", most, most), (300, "C", most - 3, 0), (100, "R", 5, Decimal("0.0001"))])).collect()
    got = {r.sequence_engine_key: r for r in rows}
    with localcontext() as exact:
        exact.prec = 60
        assert got[200].fifo_total_value == most * most + Decimal("0.0005") and got[300].qty_on_hand == 8
        assert got[300].fifo_unit_cost == ((Decimal("0.0005") + (most - 8) * Decimal(most)) / (most - 3)).quantize(Decimal("1e-16"), rounding=ROUND_HALF_UP)
