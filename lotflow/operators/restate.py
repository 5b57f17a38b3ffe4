"""Late arrivals: flags, the lateness policy, restatement, and the ledger in order of arrival."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.operators import fifo
from lotflow.runtime import by_key, cut
from lotflow.schemas import ADJUSTMENT, CONSUMPTION, KEYS, RECEIPT

ARRIVAL = ("published_at", "sequence_engine_key", "event_id")
HORIZON_DAYS = 30


def flag_late(df: DataFrame) -> DataFrame:
    """``late``: an earlier arrival of the key has a higher sequence key; ``newest_before`` is the highest of them."""
    newest = F.expr(f"max(sequence_engine_key) over (partition by sku, location_id order by {', '.join(ARRIVAL)} rows between unbounded preceding and 1 preceding)")
    return df.withColumn("newest_before", newest).withColumn("late", F.coalesce(F.col("sequence_engine_key") < F.col("newest_before"), F.lit(False)))


def late_policy(flagged: DataFrame, arrival: str = "published_at") -> DataFrame:
    """``policy``: append, restate (late within the horizon) or adjust (late beyond it, and then an adjustment)."""
    beyond = F.col(arrival) - F.col("occurred_at") > F.expr(f"interval {HORIZON_DAYS} days")
    policy = F.when(~F.col("late"), "append").when(beyond, "adjust").otherwise("restate")
    return flagged.withColumn("policy", policy).withColumn("applied_type", F.when(F.col("policy") == "adjust", ADJUSTMENT).otherwise(F.col("movement_type")))


def overtaken(movements: DataFrame, late: str = "late") -> DataFrame:
    """Movements of keys in which a row that is not ``late`` (a flag) comes after a late one in sequence, or level with it.

    A fact depends on the rows up to its own, so late rows change no fact of any other key.
    """
    key, at = "partition by sku, location_id", f"coalesce(sequence_engine_key, cast('{-(1 << 63)}' as bigint))"
    ends = movements.withColumns({"_first": F.expr(f"min(case when {late} then {at} end) over ({key})"), "_last": F.expr(f"max(case when not {late} then {at} end) over ({key})")})
    return ends.where("_last >= _first").drop("_first", "_last")


def restated(processed: DataFrame, late: DataFrame) -> DataFrame:
    """Facts that late movements change, old against new; only keys in which a late row precedes others are valued again."""
    return restated_by(processed.withColumn("_is_late", F.lit(False)).unionByName(late.withColumn("_is_late", F.lit(True))), "_is_late")


def restated_by(movements: DataFrame, late: str = "late") -> DataFrame:
    """As ``restated``, the late ones of all movements told by a flag: those are shuffled by key once."""
    rows = cut(overtaken(movements, late))
    return _changed(fifo.facts(rows.where(f"not {late}").drop(late)), fifo.facts(rows.drop(late)))


def _changed(old: DataFrame, new: DataFrame) -> DataFrame:
    pick = lambda df, tag: df.select(*KEYS, "event_id", F.col("fifo_unit_cost").alias(f"{tag}_unit_cost"), F.col("fifo_total_value").alias(f"{tag}_total_value"))
    return pick(old, "old").join(pick(new, "new"), [*KEYS, "event_id"]).where("old_unit_cost <> new_unit_cost or old_total_value <> new_total_value")


def _parts(kind: int, quantity, cost) -> tuple:
    """What a movement opens and what it depletes, the change that it states, and what it pays."""
    up = quantity if kind in (RECEIPT, ADJUSTMENT) and quantity > 0 else 0
    down = quantity if kind == CONSUMPTION and quantity > 0 else -quantity if kind == ADJUSTMENT and quantity < 0 else 0
    return up, down, -quantity if kind == CONSUMPTION else quantity, up * cost


def stored_lots(accepted: DataFrame, marks: list[int]) -> DataFrame:
    """(as_of, sku, location_id, lot_id, sequence_engine_key, remaining_qty, unit_cost): lots left at each of ``marks``.

    ``accepted`` are accepted movements; a mark is a sequence key, itself included.
    """
    spans = fifo.intervals(accepted)
    gone = {f"_gone{k}": F.expr(f"sum(if(sequence_engine_key <= {m}L, demand, 0)) over (partition by sku, location_id)") for k, m in enumerate(marks)}
    at = [F.struct(F.lit(m).cast("long").alias("as_of"), F.col(name).alias("gone")) for m, name in zip(marks, gone)]
    none = F.lit(None).cast("array<struct<as_of:bigint,gone:decimal(28,4)>>")
    lots = spans.withColumns(gone).where("supply > 0").select("*", F.inline(F.array(*at) if at else none))
    left = lots.where("sequence_engine_key <= as_of").withColumn("remaining_qty", F.expr(fifo.REMAINING)).where("remaining_qty > 0")
    return left.select("as_of", *KEYS, F.col("event_id").alias("lot_id"), "sequence_engine_key", "remaining_qty", "unit_cost")


def restated_since(processed: DataFrame, late: DataFrame, stored: DataFrame, marks: list[int]) -> DataFrame:
    """As ``restated``, valued forward from ``stored`` lots instead of from the first movement.

    A key that late rows touch starts from the newest of ``marks`` before its first late row: the lots of then are its
    opening receipts, and of ``processed`` it needs later movements alone. What is older than all starts is not read.
    Keys whose late rows come before every mark start from nothing.
    """
    start = F.array_max(F.filter(F.array(*[F.lit(m).cast("long") for m in marks]), lambda m: m < F.col("first"))) if marks else F.lit(None).cast("long")
    touched = cut(late.groupBy(*KEYS).agg(F.min("sequence_engine_key").alias("first")).select(*KEYS, start.alias("as_of")))
    oldest = touched.agg(F.min(F.coalesce("as_of", F.lit(-1)))).first()[0]
    if oldest is None:  # no late rows
        oldest = 1 << 62
    recent = processed.where(F.col("sequence_engine_key") > oldest).join(touched, list(KEYS)).where("sequence_engine_key > coalesce(as_of, -1)")
    opening = stored.join(touched, [*KEYS, "as_of"], "left_semi").select(*KEYS, "sequence_engine_key", "unit_cost", F.col("lot_id").alias("event_id"), F.lit(RECEIPT).alias("movement_type"), F.col("remaining_qty").alias("quantity"), F.lit(True).alias("_opening"))
    columns = [*KEYS, "sequence_engine_key", "unit_cost", "event_id", "movement_type", "quantity", "_opening"]
    moved = lambda df: df.withColumn("_opening", F.lit(False)).select(*columns)
    before = opening.select(*columns).unionByName(moved(recent))
    return _changed(fifo.facts(before).where("not _opening"), fifo.facts(before.unionByName(moved(late))).where("not _opening"))


class KeyLedger:
    """One key in order of arrival: the log in order of sequence, what a replay of it sums up to, and each row's last fact.

    A replay is prefix sums: supply, demand, what the supply cost, and the cost of the demand, which takes supply from its
    beginning. They hold for the first ``clean`` rows of the log. A row in sequence extends them. A late row within the
    horizon is put in its place, and only the sums and facts from there on are computed anew. A row that is applied out of
    sequence (beyond the horizon, or behind lots that are gone) changes the lots as they are; sums from its place on are
    left to the next restatement, and until then lots are a list of their own.

    ``late_sign``: 'reference' applies a stale movement's quantity as it is, so a stale consumption adds stock; 'signed'
    turns it into the change that it meant. Quantities and costs are numbers of any one kind.
    """

    #: Of each row of the log, in order of sequence.
    _ROWS = ("log", "up", "down", "paid", "gone", "delta", "need", "cogs", "held", "worth", "nth", "how")

    def __init__(self, late_sign: str = "reference"):
        for name in self._ROWS:
            setattr(self, name, [])
        self.late_sign = late_sign
        self.seen: set = set()
        self.clean, self.at, self.newest = 0, 0, None  # rows with sums; the lot in use; the newest sequence key of a supply
        self.lots: list[tuple] | None = None  # (sequence key, event id, remaining, cost), if a replay would leave others
        self.head, self.on_hand, self.value = 0, 0, 0
        self.accepted, self.restated = 0, 0  # how many rows, and how many when the last restatement ended

    def __len__(self) -> int:
        return len(self.log)

    def _newest_held(self) -> int | None:
        if self.lots is not None:
            return self.lots[-1][0] if self.head < len(self.lots) else None
        return self.newest if self.log and self.up[-1] > self.down[-1] else None

    def _deplete(self, before, after):
        """The cost of the supply between two sums of demand; the lot in use moves on."""
        cost, at = 0, self.at
        while before < after:
            while self.up[at] <= before:
                at += 1
            take = min(self.up[at], after) - before
            cost += take * self.log[at][4]
            before += take
        self.at = at
        return cost

    def _extend(self, event: tuple) -> bool:
        """Take a row that follows all others, if what it depletes is there."""
        up, down, delta, paid = _parts(*event[2:])
        supply, demand = (self.up[-1], self.down[-1]) if self.log else (0, 0)
        if down > supply - demand:
            return False
        cogs = self._deplete(demand, demand + down) if down else 0
        self.log.append(event)
        self.up.append(supply + up)
        self.down.append(demand + down)
        self.paid.append((self.paid[-1] if self.paid else 0) + paid)
        self.gone.append((self.gone[-1] if self.gone else 0) + cogs)
        for name, value in (("delta", delta), ("need", down), ("cogs", cogs), ("held", supply + up - demand - down), ("worth", self.paid[-1] - self.gone[-1])):
            getattr(self, name).append(value)
        self.clean = len(self.log)
        return True

    def _leave_sums(self) -> None:
        """From now on lots are a list of their own."""
        self.on_hand, self.value = (self.up[-1] - self.down[-1], self.paid[-1] - self.gone[-1]) if self.log else (0, 0)
        first = bisect_right(self.up, self.down[-1]) if self.log else 0
        left = [(e[0], e[1], self.up[k] - max(self.down[-1], self.up[k - 1] if k else 0), e[4]) for k, e in enumerate(self.log[first:], first) if self.up[k] > (self.up[k - 1] if k else 0)]
        self.lots, self.head = left, 0

    def _apply(self, event: tuple, kind: int, quantity) -> int | None:
        """Change the lots as they are; the row's place in the log, or None if what it depletes is not there."""
        seq, event_id, _, _, cost = event
        up, down, delta, paid = _parts(kind, quantity, cost)
        if down > (self.on_hand if self.lots is not None else self.up[-1] - self.down[-1] if self.log else 0):
            return None
        if self.lots is None:
            self._leave_sums()
        cogs, left = 0, down
        while left > 0:
            lot = self.lots[self.head]
            take = min(left, lot[2])
            cogs, left = cogs + take * lot[3], left - take
            if take == lot[2]:
                self.head += 1
            else:
                self.lots[self.head] = (*lot[:2], lot[2] - take, lot[3])
        if self.head > 64 and 2 * self.head > len(self.lots):
            del self.lots[: self.head]
            self.head = 0
        if up:
            insort(self.lots, (seq, event_id, up, cost), lo=self.head)
        self.on_hand, self.value = self.on_hand + up - down, self.value + paid - cogs
        place = bisect_left(self.log, event)
        for name, value in (("log", event), ("up", 0), ("down", 0), ("paid", 0), ("gone", 0), ("delta", delta), ("need", down), ("cogs", cogs), ("held", self.on_hand), ("worth", self.value)):
            getattr(self, name).insert(place, value)
        self.clean = min(self.clean, place)
        return place

    def _restate(self, event: tuple) -> int | None:
        """Put a late row in its place; the first place that is computed anew, or None if a depletion would lack stock."""
        place = bisect_left(self.log, event)
        p = min(place, self.clean)
        rows = self.log[p:]
        rows.insert(place - p, event)
        parts = [_parts(*e[2:]) for e in rows]
        sums = lambda column, start: list(accumulate((x[column] for x in parts), initial=start))[1:]
        before = [getattr(self, name)[p - 1] if p else 0 for name in ("up", "down", "paid", "gone")]
        up, down = sums(0, before[0]), sums(1, before[1])
        if any(x[1] and d > u for x, u, d in zip(parts, up, down)):
            return None
        self.log.insert(place, event)
        self.up[p:], self.down[p:], self.paid[p:] = up, down, sums(3, before[2])
        self.delta[p:], self.need[p:] = [x[2] for x in parts], [x[1] for x in parts]
        self.at = bisect_right(self.up, before[1])
        self.cogs[p:] = [self._deplete(d - x[1], d) if x[1] else 0 for x, d in zip(parts, down)]
        self.gone[p:] = list(accumulate(self.cogs[p:], initial=before[3]))[1:]
        self.held[p:] = [u - d for u, d in zip(up, down)]
        self.worth[p:] = [a - b for a, b in zip(self.paid[p:], self.gone[p:])]
        self.clean, self.lots = len(self.log), None
        self.nth.insert(place, 0)
        self.how.insert(place, "restated")
        return p

    def take(self, event: tuple, age_days: float) -> tuple[str, int, int]:
        """``event``: (sequence key, event id, type, quantity, unit cost). The outcome, and the places whose facts it changes."""
        seq, event_id, kind, quantity, cost = event
        if event_id in self.seen:
            return "duplicate", 0, 0
        if kind == CONSUMPTION and quantity == 0:
            return "zero_quantity", 0, 0
        newest = self._newest_held()
        late = newest is not None and seq < newest
        if late and age_days <= HORIZON_DAYS:
            first = self._restate(event)
            outcome = "restated"
        elif not late and self.lots is None and (not self.log or event > self.log[-1]):
            first = len(self.log) - 1 if self._extend(event) else None
            outcome = "appended"
        else:
            if late and self.late_sign == "signed" and kind == CONSUMPTION:
                quantity = -quantity
            first = self._apply(event, ADJUSTMENT if late else kind, quantity)
            outcome = "adjusted" if late else "appended"
        if first is None:
            return "rejected", 0, 0
        self.seen.add(event_id)
        self.accepted += 1
        if outcome == "restated":
            self.restated, end = self.accepted, len(self.log)
        else:
            self.nth.insert(first, self.accepted)
            self.how.insert(first, outcome)
            end = first + 1
        if _parts(kind, quantity, cost)[0]:
            self.newest = seq if self.newest is None else max(self.newest, seq)
        return outcome, first, end

    @classmethod
    def restored(cls, rows: list[tuple], sums: tuple, lots: list[tuple], late_sign: str = "reference") -> KeyLedger:
        """A ledger as ``rows_at`` and ``sums`` told of it, rows in any order; ``lots`` are those of a ledger that has its own."""
        ledger = cls(late_sign)
        for row in sorted(rows):
            for name, value in zip(cls._ROWS, row):
                getattr(ledger, name).append(value)
        ledger.seen = {e[1] for e in ledger.log}
        ledger.clean, ledger.newest, ledger.accepted, ledger.restated, apart = sums
        if apart:
            ledger.lots = sorted(lots)
            ledger.on_hand, ledger.value = sum(x[2] for x in lots), sum(x[2] * x[3] for x in lots)
        elif ledger.log:
            ledger.at = bisect_right(ledger.up, ledger.down[-1])
        return ledger

    def rows_at(self, places: Iterable[int]) -> Iterator[tuple]:
        columns = [getattr(self, name) for name in self._ROWS]
        for k in places:
            yield tuple(c[k] for c in columns)

    def sums(self) -> tuple:
        return self.clean, self.newest, self.accepted, self.restated, self.lots is not None

    def facts(self, first: int, end: int) -> list[tuple]:
        """(event id, sequence key, delta, (cost of what was depleted, how much), on hand, value) of some places."""
        return [(e[1], e[0], *rest) for e, *rest in zip(*(getattr(self, c)[first:end] for c in ("log", "delta")), zip(self.cogs[first:end], self.need[first:end]), self.held[first:end], self.worth[first:end])]

    def arrive(self, event: tuple, age_days: float) -> tuple[str, list[tuple]]:
        """The outcome and every fact that changes."""
        outcome, first, end = self.take(event, age_days)
        return outcome, self.facts(first, end)

    def outcomes(self) -> list[str]:
        """How each row's last fact came about: a restatement restates every row before it."""
        return ["restated" if n <= self.restated else how for n, how in zip(self.nth, self.how)]


#: A fact as the ledger gives it: quantities and costs in ten-thousandths, values in 1e-8.
RAW = "event_id string, sku string, location_id string, sequence_engine_key long, outcome string, qty_delta decimal(38,4), cogs decimal(38,8), need decimal(38,4), qty_on_hand decimal(38,4), fifo_total_value decimal(38,8)"
FIELDS = ("sequence_engine_key", "event_id", "movement_type", "quantity", "unit_cost")


def exact(numbers: list[int], places: int) -> pa.Array:
    """Whole numbers as decimals with so many of their digits behind the point; null beyond 38 digits."""
    whole = pa.array([n if abs(n) < 10**38 else None for n in numbers], pa.decimal128(38, 0))
    return pa.Array.from_buffers(pa.decimal128(38, places), len(whole), whole.buffers(), whole.null_count, whole.offset)


def raw_facts(key: tuple, outcomes: list[str], facts: list[tuple], id_type: pa.DataType = pa.string()) -> pa.RecordBatch:
    """Rows of ``RAW`` from a ledger over ten-thousandths; ids may be texts or bytes."""
    ids, seqs, delta, costs, held, worth = zip(*facts) if facts else ([],) * 6
    columns = [pa.array(ids, id_type), *(pa.array([k] * len(ids), pa.string()) for k in key), pa.array(seqs, pa.int64()), pa.array(outcomes, pa.string())]
    columns += [exact(delta, 4), exact([c for c, _ in costs], 8), exact([n for _, n in costs], 4), exact(held, 4), exact(worth, 8)]
    return pa.RecordBatch.from_arrays(columns, names=[field.split()[0] for field in RAW.split(", ")])


def priced(raw: DataFrame) -> DataFrame:
    """Facts with their unit cost, in the types of the ledger; a value beyond its column is null."""
    cost = F.expr(f"case when need > 0 then {fifo.quotient('cogs', 'cast(need as decimal(28,4))')} else cast(0 as decimal(38,16)) end")
    return raw.select(
        "event_id", *KEYS, "sequence_engine_key", "outcome", F.expr("try_cast(qty_delta as decimal(18,4)) as qty_delta"), cost.alias("fifo_unit_cost"), F.expr("try_cast(qty_on_hand as decimal(28,4)) as qty_on_hand"), "fifo_total_value"
    )


def arriving(df: DataFrame) -> DataFrame:
    """Typed movements with ``age`` in days on arrival and numbers in ten-thousandths, as the ledger takes them."""
    age = F.expr("coalesce(timestampdiff(MICROSECOND, occurred_at, published_at) / 86400e6D, double('nan'))").alias("age")
    tenth = lambda c: F.expr(f"cast({c} * 10000 as bigint) as {c}")
    return df.select(*KEYS, "sequence_engine_key", "event_id", "movement_type", tenth("quantity"), tenth("unit_cost"), age, "published_at")


def arrival_ledger(df: DataFrame, late_sign: str = "reference") -> DataFrame:
    """The last fact of every event when movements are handled in order of arrival; ``outcome`` says how it came about.

    Rows are dealt by key, sorted by arrival and streamed; one key at a time is held. A row in sequence costs the same
    whatever the key's length; a late one within the horizon costs what the rows behind its place do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, ledger = None, KeyLedger(late_sign)
        last = lambda: raw_facts(here, ledger.outcomes(), ledger.facts(0, len(ledger)), pa.binary() if packed else pa.string())
        for batch in batches:
            for *key, age, seq, event_id, kind, quantity, cost in zip(*[batch.column(c).to_pylist() for c in (*KEYS, "age", *FIELDS)]):
                if key != here:
                    if len(ledger):
                        yield last()
                    here, ledger = key, KeyLedger(late_sign)
                ledger.take((seq, event_id, kind, quantity, cost), age)
        if len(ledger):
            yield last()

    packed = df.schema["event_id"].dataType.simpleString() == "binary"
    dealt = by_key(arriving(df), KEYS, *[F.asc_nulls_last(c) for c in ARRIVAL])
    return priced(dealt.mapInArrow(run, RAW.replace("event_id string", "event_id binary") if packed else RAW))
