"""Operators with state by key, as stateful processors: state is typed rows in the state store, never one opaque value.

The state store has to be RocksDB; ``started`` sets that for the one query it starts and leaves the session as it was.
Every query takes a checkpoint folder and can be restarted.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lotflow.operators import restate, workflow
from lotflow.runtime import settings
from lotflow.schemas import KEYS

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def started(writer: DataStreamWriter, spark: SparkSession) -> StreamingQuery:
    """Start a query whose state lies in RocksDB."""
    with settings(spark, spark__sql__streaming__stateStore__providerClass=_STORE):
        return writer.start()


class ArrivalProcessor(StatefulProcessor):
    """A key's ledger in order of arrival. State: one entry a row of the log, the ledger's sums, and lots that are apart.

    A batch reads the entries of the keys that it has rows of, and writes those that it adds or changes. An event that is
    in the log is a duplicate; the log is never cut, as a late row may fall in any place of it.
    """

    _WHOLE = ("up", "down", "paid", "gone", "delta", "need", "cogs", "held", "worth")

    def __init__(self, late_sign: str):
        self.late_sign = late_sign

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = "seq bigint, event_id string"
        sums = ", ".join(f"{c} decimal(38,0)" for c in self._WHOLE)
        self.log = handle.getMapState("log", place, f"kind int, quantity bigint, unit_cost bigint, {sums}, nth bigint, how string")
        self.sums = handle.getValueState("sums", "clean bigint, newest bigint, accepted bigint, restated bigint, apart boolean")
        self.lots = handle.getMapState("lots", place, "remaining decimal(38,0), unit_cost bigint")

    def _ledger(self) -> restate.KeyLedger:
        if not self.sums.exists():
            return restate.KeyLedger(self.late_sign)
        rows = [((k[0], k[1], v[0], v[1], v[2]), *map(int, v[3:12]), v[12], v[13]) for k, v in self.log.iterator()]
        lots = [(k[0], k[1], int(v[0]), v[1]) for k, v in self.lots.iterator()]
        return restate.KeyLedger.restored(rows, tuple(self.sums.get()), lots, self.late_sign)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ledger, was_apart, changed = self._ledger(), self.lots.exists(), set()
        for event, age in _events(pd.concat(list(rows))):
            _, first, end = ledger.take(event, age)
            changed.update(e[:2] for e in ledger.log[first:end])
        places = [k for k, e in enumerate(ledger.log) if e[:2] in changed]
        for event, *sums, nth, how in ledger.rows_at(places):
            self.log.updateValue(event[:2], (*event[2:], *map(Decimal, sums), nth, how))
        self.sums.update(ledger.sums())
        if was_apart or ledger.lots is not None:
            self.lots.clear()
            for seq, event_id, left, cost in (ledger.lots or [])[ledger.head :]:
                self.lots.updateValue((seq, event_id), (Decimal(left), cost))
        outcomes = ledger.outcomes()
        facts = [f for k in places for f in ledger.facts(k, k + 1)]
        yield restate.raw_facts(key, [outcomes[k] for k in places], facts).to_pandas()

    def close(self) -> None:
        pass


def _events(rows: pd.DataFrame) -> Iterator[tuple[tuple, float]]:
    """Events of one key in order of arrival, with their age in days on arrival."""
    rows = rows.sort_values(list(restate.ARRIVAL), kind="stable")
    for seq, event_id, kind, quantity, cost, age in zip(*[rows[c].tolist() for c in (*restate.FIELDS, "age")]):
        yield (int(seq), event_id, int(kind), int(quantity), int(cost)), age


def arrival_facts(stream: DataFrame, late_sign: str = "reference") -> DataFrame:
    """Facts of typed movements in order of arrival: append, restate, adjust or reject, with state by key.

    Rows of a key are sorted inside each micro-batch by arrival. A batch gives each fact that it adds or changes once, as
    it is at its end; so the newest row of an event replaces the older ones (``upserted``). Facts before the place of a
    late row do not change and are not given again.
    """
    needed = restate.arriving(stream)
    raw = needed.groupBy(*KEYS).transformWithStateInPandas(ArrivalProcessor(late_sign), restate.RAW, "Append", "None")
    return restate.priced(raw)


def run_facts(spark: SparkSession, source: str, out: str, checkpoint: str) -> StreamingQuery:
    """Typed movements in a folder -> a log of facts, one folder a batch."""
    typed = spark.readStream.schema("event_id string, sku string, location_id string, sequence_engine_key long, movement_type int, quantity decimal(18,4), unit_cost decimal(18,4), occurred_at timestamp, published_at timestamp").parquet(source)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("emit_no", F.monotonically_increasing_id()).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return started(arrival_facts(typed).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write), spark)


def upserted(spark: SparkSession, out: str, key: str = "event_id") -> DataFrame:
    """The newest row of each key in a log that ``run_facts`` wrote."""
    from lotflow.operators.dedup import keep_last

    return keep_last(spark.read.option("basePath", out).parquet(out), [key], ["batch", "emit_no"])


TRANSITION = "workflow_id string, event_id string, node_id string, attempt int, payload string, state string, disposition string"


class WorkflowProcessor(StatefulProcessor):
    """One workflow an event id. State: where it stands, and when its lease ends; timers tell of leases that have run out."""

    _DAY = 86_400_000

    def __init__(self, timed: bool, lease_hours: int, keep_days: int):
        self.timed, self.lease, self.keep = timed, lease_hours * 3_600_000, keep_days * self._DAY

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.current = handle.getValueState("workflow", "state string, timer bigint")

    def _enter(self, state: str, at: int | None, after: int) -> None:
        """Stand in a state, with a timer ``after`` milliseconds instead of the one before."""
        before = self.current.get()[1] if self.current.exists() else None
        if before is not None:
            self.handle.deleteTimer(before)
        timer = at + after if self.timed and at is not None else None
        if timer is not None:
            self.handle.registerTimer(timer)
        self.current.update((state, timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        out, wf = [], f"wf-{key[0]}"
        rows = pd.concat(list(rows)).sort_values(["sequence_engine_key", "kind"], ascending=[True, False])
        kinds, times = rows["kind"].tolist(), [int(t.timestamp() * 1000) if self.timed and not pd.isna(t) else None for t in (rows["at"] if self.timed else [None] * len(rows))]
        state = self.current.get()[0] if self.current.exists() else ""
        for k, (kind, at) in enumerate(zip(kinds, times)):
            if kind == "trigger":
                out.append((wf, key[0], None, 0, None, state or "SUSPENDED", "duplicate" if state else "created"))
                if not state:
                    state = "SUSPENDED"
                    self._enter(state, at, self.lease)
            elif state == "SUSPENDED":
                state = "COMPLETED"
                self._enter(state, at, self.keep)
                for node, status in zip(workflow.TASKS, ("approved", "completed")):
                    out.append((wf, key[0], node, 1, f'{{"status":"{status}","node":"{node}"}}', state, "accepted"))
            else:
                out.append((wf, key[0], None, 0, None, state, "duplicate" if state else "stray" if "trigger" in kinds[k:] else "no_workflow"))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITION.split(", ")])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.current.get()[0] if self.current.exists() else ""
        out = []
        if state == "SUSPENDED":
            out.append((f"wf-{key[0]}", key[0], None, 0, None, state, "overdue"))
            self.current.update((state, None))
        elif state:
            self.current.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITION.split(", ")])

    def close(self) -> None:
        pass


def workflow_transitions(stream: DataFrame, event_time: str | None = None, delay: str = "1 hour", lease_hours: int = workflow.LEASE_HOURS, keep_days: int = 90) -> DataFrame:
    """Transitions of ``stream(event_id, kind, sequence_engine_key, approved_by)`` with durable state by event id.

    A trigger suspends its workflow; the first approval after it is accepted and completes it; anything else comes back
    with its disposition and no transition. An approval before the trigger is a ``stray`` if the same batch brings the
    trigger, else ``no_workflow``: what is yet to come is not known.

    With ``event_time``, a timestamp column, a workflow still suspended when the watermark (``delay`` behind the newest
    time) passes the end of its lease comes back once as ``overdue``; a later approval is accepted all the same. A
    completed workflow is forgotten ``keep_days`` after its approval; approvals after that are ``no_workflow``.
    """
    timed = event_time is not None
    needed = stream.select("event_id", "kind", "sequence_engine_key", *([F.col(event_time).alias("at")] if timed else []))
    if timed:
        needed = needed.withWatermark("at", delay)
    return needed.groupBy("event_id").transformWithStateInPandas(WorkflowProcessor(timed, lease_hours, keep_days), TRANSITION, "Append", "EventTime" if timed else "None")


class HandOffProcessor(StatefulProcessor):
    """Live rows of an aggregate that neither history nor an earlier live row brought. State: the sequence keys so far."""

    def __init__(self, kind: str):
        self.kind = kind

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", f"key {self.kind}", "live boolean")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for k in initialState["sequence_engine_key"].dropna().tolist():
            self.seen.updateValue((k,), (False,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(rows))
        fresh = []
        for place, k in enumerate(rows["sequence_engine_key"].tolist()):
            if not self.seen.containsKey((k,)):
                self.seen.updateValue((k,), (True,))
                fresh.append(place)
        yield rows.iloc[fresh]

    def close(self) -> None:
        pass


def live_after(history: DataFrame, stream: DataFrame) -> DataFrame:
    """Rows of ``stream`` that add to ``history``, each once, late ones with them; both have aggregate_id and sequence_engine_key.

    The first batch takes the keys of ``history`` as its state, so the stream may begin before history was read: what both
    have is history's. After a restart the checkpoint holds them, and ``history`` is not read again. Rows without a key go.
    """
    keyed = stream.where("aggregate_id is not null and sequence_engine_key is not null")
    known = history.select("aggregate_id", "sequence_engine_key").where("aggregate_id is not null").groupBy("aggregate_id")
    kind = dict(stream.dtypes)["sequence_engine_key"]
    return keyed.groupBy("aggregate_id").transformWithStateInPandas(HandOffProcessor(kind), stream.schema, "Append", "None", known)
