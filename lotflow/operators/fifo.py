"""FIFO cost layers over movements in sequence order.

``accept`` is a fold per key (a rejected depletion leaves no trace, so later ones may pass): rows are dealt by key and
sorted, and one pass over each partition keeps a single number a key, whatever the key's length. Stretches between two
rejections are running sums over arrays. All that follows is windows and joins: supply and demand are intervals on a key's running quantities, and an allocation is an overlap.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.operators import scan
from lotflow.runtime import by_key, cut
from lotflow.schemas import KEYS, ORDER

_KEY = "partition by sku, location_id"
#: The same groups for rows that have ``_hash``; their sort tells most keys apart by that number. It is no order by the key.
_HASHED = "partition by _hash, sku, location_id"
_SEQ = f"{_KEY} order by sequence_engine_key, event_id rows unbounded preceding"


def signed(df: DataFrame) -> DataFrame:
    """``delta``: receipt +q, consumption -q, adjustment q; ``supply`` and ``demand``: what opens or depletes lots."""
    return (
        df.withColumn("delta", F.expr("case when movement_type = 2 then -quantity else quantity end").cast("decimal(18,4)"))
        .withColumn("supply", F.expr("case when movement_type in (1, 3) and quantity > 0 then quantity else 0 end").cast("decimal(18,4)"))
        .withColumn("demand", F.expr("case when movement_type = 2 and quantity > 0 then quantity when movement_type = 3 and quantity < 0 then -quantity else 0 end").cast("decimal(18,4)"))
    )


def _one_by_one(change: list[int], down: list[int], on_hand: int) -> tuple[list[bool], int]:
    refused = []
    for by, need in zip(change, down):
        refused.append(need > on_hand)
        if need <= on_hand:
            on_hand += by
    return refused, on_hand


def refusals(starts: np.ndarray, change: np.ndarray, down: np.ndarray, carried: int) -> tuple[np.ndarray, int]:
    """Which rows ask for more than is on hand, and what the last key has left.

    ``starts`` marks the first row of each key; the first key begins with ``carried``, the others with nothing. A round
    settles every key up to its next refusal; once rounds leave more than three quarters, rows are taken singly.
    """
    refused, rows = np.zeros(len(change), dtype=bool), np.arange(len(change))
    first = np.flatnonzero(starts)
    if carried + len(change) * int(max(np.abs(change).max(), down.max())) >= 1 << 62:  # sums might leave 64 bits
        left = carried
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(change)]):
            refused[a:b], left = _one_by_one(change[a:b].tolist(), down[a:b].tolist(), left if a == 0 else 0)
        return refused, left
    opening = np.zeros(len(first), dtype=np.int64)
    opening[0], last = carried, len(first) - 1
    key = np.cumsum(starts) - 1
    before_round = 2 * len(rows)
    while len(rows) <= 0.75 * before_round:
        before_round = len(rows)
        run = np.cumsum(change[rows])
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        before = run - change[rows] + np.repeat(opening[key[begins]] - (run - change[rows])[begins], np.diff(np.r_[begins, len(rows)]))
        bad = np.flatnonzero(down[rows] > before)
        bad = bad[np.r_[True, key[bad][1:] != key[bad][:-1]]] if len(bad) else bad  # the first of each key
        refused[rows[bad]] = True
        opening[key[bad]] = before[bad]
        ends = np.full(len(first), -1)
        ends[key[bad]] = bad
        done = ends[key] < 0
        if key[-1] == last and done[-1]:
            opening[last] = before[-1] + change[rows[-1]]
        more = ~done & (np.arange(len(rows)) > ends[key])
        rows, key = rows[more], key[more]
        if not len(rows):
            return refused, int(opening[last])
    begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    for a, b in zip(begins.tolist(), [*begins[1:].tolist(), len(rows)]):
        refused[rows[a:b]], opening[key[a]] = _one_by_one(change[rows[a:b]].tolist(), down[rows[a:b]].tolist(), int(opening[key[a]]))
    return refused, int(opening[last])


def _changes(column: pa.Array) -> np.ndarray:
    """Where a column differs from the row before; nulls are alike."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(pc.is_null(a), pc.is_null(b)))
    return ~same.to_numpy(zero_copy_only=False)


def _up_and_down(kind: pa.Array, quantity: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Supply and demand in ten-thousandths, and which rows are consumptions of zero; the same as ``signed``, for a fold."""
    known = pc.and_(kind.is_valid(), quantity.is_valid()).to_numpy(zero_copy_only=False)
    units = np.frombuffer(quantity.buffers()[1], dtype=np.int64)[2 * quantity.offset :][: 2 * len(quantity) : 2]  # 18 digits fit the low half
    units, kind = np.where(known, units, 0), np.where(known, pc.fill_null(kind, 0).to_numpy(zero_copy_only=False), 0)
    up = np.where((units > 0) & ((kind == 1) | (kind == 3)), units, 0)
    return up, np.where((kind == 2) & (units > 0), units, np.where((kind == 3) & (units < 0), -units, 0)), (kind == 2) & (units == 0) & known


def accept(df: DataFrame) -> DataFrame:
    """Typed movements with ``rejected``: null, ``exceeds_on_hand`` or ``zero_quantity``.

    A depletion larger than what is on hand at its place in the sequence is rejected and changes nothing. All columns go
    through the shuffle and the pass, so rows are best given with those that are needed.
    """
    rows = _dealt(df)
    names = rows.columns

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _, _, zero, refused, _, _ in _decided(batches):
            reasons = pc.if_else(pa.array(zero), "zero_quantity", pc.if_else(pa.array(refused), "exceeds_on_hand", pa.scalar(None, pa.string())))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), reasons], names=[*names, "rejected"])

    return signed(rows.mapInArrow(fold, f"{_ddl(rows)}, rejected string"))


def _dealt(df: DataFrame) -> DataFrame:
    """Rows for the fold; what follows from other columns is computed after the shuffle."""
    rows = df.drop("delta", "supply", "demand", "rejected")
    return by_key(rows.withColumn("quantity", F.col("quantity").cast("decimal(18,4)")), KEYS, *ORDER)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Each batch with its supply and demand, what is zero, what is refused, where keys start, and whether the first goes on."""
    key, on_hand = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        up, down, zero = _up_and_down(batch.column("movement_type"), batch.column("quantity"))
        head, tail = (tuple(batch.column(c)[i].as_py() for c in KEYS) for i in (0, batch.num_rows - 1))
        starts = np.r_[True, _changes(batch.column(KEYS[0])) | _changes(batch.column(KEYS[1]))]
        refused, on_hand = refusals(starts, up - down, down, on_hand if head == key else 0)
        yield batch, up, down, zero, refused, starts, head == key
        key = tail


def _running(x: np.ndarray, starts: np.ndarray, carried: int) -> np.ndarray:
    """Sums from each start on, the first on top of ``carried``; whole numbers of any size where 64 bits might not do."""
    run = np.cumsum(x.astype(object) if carried + len(x) * int(x.max()) >= 1 << 62 else x)
    first = np.flatnonzero(starts)
    base = (run - x)[first]
    base[0] -= carried
    return run - np.repeat(base, np.diff(np.r_[first, len(x)]))


#: An end of an interval is ``high`` times this and ``low``, in ten-thousandths: two numbers that sort as the sum, whatever its size.
_HIGH = 10**18


def ends(movements: DataFrame) -> DataFrame:
    """(sku, location_id, event_id, unit_cost, lot, high, low): where the interval of each accepted movement ends.

    One pass decides what is accepted, as ``accept`` does, and sums it up; ``lot`` tells supply from demand.
    """
    rows = _dealt(movements)
    kept = [*KEYS, "event_id", "unit_cost"]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        supply, demand = 0, 0
        for batch, up, down, _, refused, starts, goes_on in _decided(batches):
            s, d = (_running(np.where(refused, 0, x), starts, before if goes_on else 0) for x, before in ((up, supply), (down, demand)))
            supply, demand = int(s[-1]), int(d[-1])
            take = ~refused & (up + down > 0)
            end, of = np.where(up > 0, s, d)[take], batch.filter(pa.array(take))
            numbers = [pa.array(up[take] > 0), *(pa.array(x.astype(np.int64)) for x in (end // _HIGH, end % _HIGH))]
            yield pa.RecordBatch.from_arrays([*(of.column(c) for c in kept), *numbers], names=[*kept, "lot", "high", "low"])

    return rows.mapInArrow(fold, f"{_ddl(rows.select(*kept))}, lot boolean, high bigint, low bigint")


def intervals(accepted: DataFrame, deal: tuple[str, ...] = KEYS, key: str = _KEY) -> DataFrame:
    """Each row's interval of cumulative supply or demand, rows dealt by ``deal``: the key or a part of it.

    What follows from type and quantity is computed after the exchange.
    """
    dealt = signed(accepted.drop("delta", "supply", "demand", "rejected").repartition(*deal))
    if key == _HASHED:
        dealt = dealt.withColumn("_hash", F.xxhash64(*KEYS))
    run = f"over ({key} order by {', '.join(ORDER)} rows unbounded preceding)"
    return dealt.selectExpr("*", f"sum(supply) {run} as s_hi", f"sum(demand) {run} as d_hi")


#: Quotients up to these bounds are one decimal division; beyond them digits come in blocks of four, exactly.
_PLAIN_TOP, _PLAIN_LOW = "1e12BD", "1e14BD"


def quotient(top: str, low: str) -> str:
    """SQL of ``top / low`` to 16 places, half up, for decimals that are not negative and of any size that columns hold."""
    plain = f"round(cast(cast({top} as decimal(20,8)) / cast({low} as decimal(18,4)) as decimal(38,16)), 16)"
    digits = (
        f"aggregate(sequence(1, 4), struct(0L as f, cast({top} % {low} as decimal(32,8)) as r),"
        f" (x, k) -> struct(x.f * 10000L + cast(x.r * 10000BD as decimal(38,8)) div {low} as f, cast(cast(x.r * 10000BD as decimal(38,8)) % {low} as decimal(32,8)) as r),"
        f" x -> x.f + if(x.r * 2BD >= {low}, 1L, 0L))"
    )
    long = f"cast({top} div {low} as decimal(34,16)) + cast(cast({digits} as decimal(17,0)) / 10000000000000000BD as decimal(34,16))"
    return f"case when {top} < {_PLAIN_TOP} and {low} < {_PLAIN_LOW} then {plain} else cast({long} as decimal(38,16)) end"


_TAKEN = "cast(taken as decimal(18,4)) as taken, cast(cast(taken as decimal(18,4)) * unit_cost as decimal(38,8)) as cost"


def allocate(accepted: DataFrame) -> DataFrame:
    """(sku, location_id, lot_id, consumption_id, taken, unit_cost, cost): which lot fed which depletion, of accepted movements."""
    both = intervals(accepted, key=_HASHED).where("supply > 0 or demand > 0").withColumn("_end", F.expr("if(supply > 0, s_hi, d_hi)"))
    whole = f"{_HIGH // 10**4}BD"
    return sweep(both.selectExpr(*KEYS, "event_id", "unit_cost", "supply > 0 as lot", f"cast(_end div {whole} as bigint) as high", f"cast(_end % {whole} * 10000BD as bigint) as low"), dealt=True)


def allocation(movements: DataFrame) -> DataFrame:
    """As ``allocate``, of typed movements: the pass that accepts them sums them up too, so they are sorted twice and not three times."""
    return sweep(ends(movements))


def sweep(ends: DataFrame, dealt: bool = False) -> DataFrame:
    """The allocation from the ends of all intervals.

    A linear sweep: the ends of a key in order, each gap between two ends belonging to the next lot end and the next
    depletion end above it. One window pass, whatever the number of lots and depletions. ``dealt``: by key, already.
    """
    rows = (ends if dealt else ends.repartition(*KEYS)).withColumn("_hash", F.xxhash64(*KEYS))
    order = f"over ({_HASHED} order by high desc, low desc"
    above = f"{order} range between unbounded preceding and current row)"
    swept = rows.selectExpr(
        *KEYS, f"high - coalesce(lead(high) {order}), 0) as _high", f"low - coalesce(lead(low) {order}), 0) as _low",
        f"last(if(lot, struct(event_id as lot_id, unit_cost), null), true) {above} as lot", f"last(if(lot, null, event_id), true) {above} as consumption_id",
    )
    gaps = swept.selectExpr("*", f"_high * {_HIGH} + _low as taken").where("taken > 0 and lot is not null and consumption_id is not null")  # no more than one row's quantity
    taken = "cast(cast(taken as decimal(18,0)) * 0.0001BD as decimal(18,4)) as taken"
    return gaps.selectExpr(*KEYS, "lot.lot_id", "consumption_id", "lot.unit_cost", taken).selectExpr("*", "cast(taken * unit_cost as decimal(38,8)) as cost")


def allocate_by_overlap(accepted: DataFrame) -> DataFrame:
    """As ``allocate``, as an overlap join of lot and depletion intervals of the key; for short keys."""
    both = intervals(accepted)
    lots = both.where("supply > 0").selectExpr(*KEYS, "event_id as lot_id", "unit_cost", "s_hi - supply as s_lo", "s_hi")
    asks = both.where("demand > 0").selectExpr("sku as d_sku", "location_id as d_location", "event_id as consumption_id", "d_hi - demand as d_lo", "d_hi")
    pairs = lots.join(asks, F.expr("sku = d_sku and location_id = d_location and s_lo < d_hi and d_lo < s_hi"))
    return pairs.selectExpr(*KEYS, "lot_id", "consumption_id", "least(s_hi, d_hi) - greatest(s_lo, d_lo) as taken", "unit_cost").selectExpr(*KEYS, "lot_id", "consumption_id", "unit_cost", *_TAKEN.split(", ", 1))


#: What is left of a row's supply once ``gone`` of the key's demand was met, oldest supply first.
REMAINING = "cast(greatest(0, s_hi - greatest(s_hi - supply, gone)) as decimal(18,4))"


def value(accepted: DataFrame, segments: int | None = None, deal: tuple[str, ...] = KEYS, lots: bool = False) -> DataFrame:
    """Accepted movements with FIFO facts: qty_delta, qty_on_hand, fifo_unit_cost, fifo_total_value, moving_avg_cost.

    Every window is over the key, so rows are shuffled once. In the order of the ends of all intervals, the cost of demand
    up to an end is a running sum over the gaps between ends, each at the cost of the next lot end; a depletion costs what
    that sum grows by from the depletion before it. Values have 30 digits before the point; beyond that they are null, and
    the other facts stay. With ``segments`` the running sums are a scan in so many segments, for hot keys (values beyond
    their column then end the job). ``deal`` may be a part of the key, if what follows groups by that part. ``lots`` adds
    ``remaining_qty``: what is left in the end of the lot that a row opened.
    """
    if segments:
        return _with_quotients(_valued_in_segments(accepted, segments))
    paid = F.expr(f"try_sum(cast(supply * unit_cost as decimal(38,8))) over ({_SEQ}) as _paid")
    rows = intervals(accepted, deal).select("*", paid)
    if lots:
        rows = rows.withColumn("gone", F.expr(f"sum(demand) over ({_KEY})")).withColumn("remaining_qty", F.expr(REMAINING)).drop("gone")
    ends = rows.withColumn("_pos", F.expr("case when supply > 0 then s_hi when demand > 0 then d_hi end"))
    gap = f"_pos - coalesce(lead(_pos) over ({_KEY} order by _pos desc), 0)"
    lot = f"last(case when supply > 0 then unit_cost end, true) over ({_KEY} order by _pos desc range between unbounded preceding and current row)"
    priced = ends.selectExpr("*", f"cast(cast({gap} as decimal(18,4)) * {lot} as decimal(38,8)) as _step")
    spent = priced.selectExpr("*", f"case when demand > 0 then try_sum(_step) over ({_KEY} order by _pos range between unbounded preceding and current row) end as _spent")
    before = f"last(if(demand > 0, struct(_spent), null), true) over ({_KEY} order by sequence_engine_key, event_id rows between unbounded preceding and 1 preceding)"
    known = spent.selectExpr("*", f"{before} as _before")
    zero = "cast(0 as decimal(38,8))"
    earlier = f"if(_before is null, {zero}, _before._spent)"
    sums = known.selectExpr("*", f"cast(if(demand > 0, _spent - {earlier}, {zero}) as decimal(38,8)) as cogs", f"try_subtract(_paid, if(demand > 0, _spent, {earlier})) as _worth")
    valued = sums.withColumns({"qty_on_hand": F.expr("cast(s_hi - d_hi as decimal(28,4))"), "fifo_total_value": F.expr("cast(_worth as decimal(38,8))")})
    return _with_quotients(valued.drop("s_hi", "d_hi", "_paid", "_pos", "_step", "_spent", "_before", "_worth"))


def _valued_in_segments(accepted: DataFrame, segments: int) -> DataFrame:
    """Costs from the allocation, joined back, and running sums by segments."""
    cogs = allocate(accepted).groupBy(*KEYS, F.col("consumption_id").alias("event_id")).agg(F.sum("cost").alias("cogs"))
    rows = accepted.join(cogs, [*KEYS, "event_id"], "left").withColumn("cogs", F.coalesce("cogs", F.lit(0)).cast("decimal(38,8)"))
    worth = "cast(cast(supply * unit_cost as decimal(38,8)) - cogs as decimal(38,8))"
    summed = scan.running(cut(rows), list(KEYS), list(ORDER), {"qty_on_hand": "supply - demand", "fifo_total_value": worth}, segments=segments)
    return summed.withColumns({"qty_on_hand": F.col("qty_on_hand").cast("decimal(28,4)"), "fifo_total_value": F.col("fifo_total_value").cast("decimal(38,8)")})


def _with_quotients(rows: DataFrame) -> DataFrame:
    return (
        rows.withColumn("qty_delta", F.expr("delta"))
        .withColumn("fifo_unit_cost", F.expr(f"case when demand > 0 then {quotient('cogs', 'demand')} else cast(0 as decimal(38,16)) end"))
        .withColumn("moving_avg_cost", F.expr(f"case when qty_on_hand > 0 then {quotient('fifo_total_value', 'qty_on_hand')} else cast(0 as decimal(38,16)) end"))
        .drop("delta", "supply", "demand", "cogs", "rejected")
    )


def facts(movements: DataFrame) -> DataFrame:
    """Typed movements -> facts of the accepted ones."""
    return value(accept(movements).where("rejected is null"))


def balance(accepted: DataFrame) -> DataFrame:
    """(sku, location_id, lot_id, sequence_engine_key, remaining_qty, unit_cost): lots that are left; the oldest have the smallest keys."""
    both = intervals(accepted, key=_HASHED).withColumn("gone", F.expr(f"sum(demand) over ({_HASHED})"))
    return both.where("supply > 0").withColumn("remaining_qty", F.expr(REMAINING)).where("remaining_qty > 0").select(*KEYS, F.col("event_id").alias("lot_id"), "sequence_engine_key", "remaining_qty", "unit_cost")


def on_hand(lots: DataFrame) -> DataFrame:
    """Quantity, value and newest sequence key over surviving lots."""
    return lots.groupBy(*KEYS).agg(F.sum("remaining_qty").alias("qty_on_hand"), F.sum(F.expr("cast(remaining_qty * unit_cost as decimal(38,8))")).alias("fifo_total_value"), F.max("sequence_engine_key").alias("max_sequence"), F.count("*").alias("lots"))
