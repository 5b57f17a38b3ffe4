"""Approval workflows derived from triggers and approvals, and task orders of dependency graphs."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.operators.dedup import keep_first
from lotflow.runtime import by_key, cut

TASKS = ("human_approval", "final_step")
LEASE_HOURS = 24


def approvals_with_disposition(triggers: DataFrame, approvals: DataFrame) -> DataFrame:
    """Every approval as accepted, duplicate, stray (before its workflow) or no_workflow.

    The first approval after the trigger is accepted; only that one has effects.
    """
    first = keep_first(triggers, ["event_id"], ["sequence_engine_key"]).select("event_id", F.col("sequence_engine_key").alias("trigger_key"))
    seen = approvals.join(first, "event_id", "left")
    valid = "case when trigger_key is not null and sequence_engine_key > trigger_key then 0 else 1 end"
    place = F.expr(f"row_number() over (partition by event_id order by {valid}, sequence_engine_key, approved_by)")
    kind = F.expr(f"case when trigger_key is null then 'no_workflow' when {valid} = 1 then 'stray' when place = 1 then 'accepted' else 'duplicate' end")
    return seen.withColumn("place", place).withColumn("disposition", kind).drop("place", "trigger_key")


def states(triggers: DataFrame, approvals: DataFrame) -> DataFrame:
    """One workflow an event id: SUSPENDED until its approval is accepted, COMPLETED after it."""
    first = keep_first(triggers, ["event_id"], ["sequence_engine_key"])
    accepted = approvals_with_disposition(triggers, approvals).where("disposition = 'accepted'").select("event_id", "approved_by", F.col("approved_at"))
    done = F.col("approved_at").isNotNull()
    tasks = F.array(*[F.lit(t) for t in TASKS])
    index = F.when(done, len(TASKS)).otherwise(0)
    return first.join(accepted, "event_id", "left").select(
        F.concat(F.lit("wf-"), "event_id").alias("workflow_id"), "event_id", "trace_parent", "sequence_engine_key", "occurred_at", F.when(done, "COMPLETED").otherwise("SUSPENDED").alias("state"), index.alias("current_node_index"),
        tasks.alias("sorted_nodes"), F.coalesce(F.try_element_at(tasks, index + 1), F.lit("")).alias("next_node"), "approved_by", "approved_at",
        F.when(~done, F.col("occurred_at") + F.expr(f"interval {LEASE_HOURS} hours")).alias("lease_expires_at"),
    )


def transitions(workflows: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """Two transition rows a completed workflow; those whose (workflow, node, attempt) the ledger has are left out."""
    rows = workflows.where("state = 'COMPLETED'").select("workflow_id", "event_id", "trace_parent", "sequence_engine_key", F.col("approved_at").alias("occurred_at"), F.posexplode("sorted_nodes").alias("place", "node_id"))
    status = F.when(F.col("node_id") == TASKS[0], "approved").otherwise("completed")
    rows = rows.select("workflow_id", "event_id", "trace_parent", "sequence_engine_key", "occurred_at", "node_id", F.lit(1).alias("attempt"), F.lit("NodeTransition").alias("event_type"), F.to_json(F.struct(status.alias("status"), F.col("node_id").alias("node"))).alias("payload"))
    return rows if ledger is None else rows.join(ledger.select("workflow_id", "node_id", "attempt"), ["workflow_id", "node_id", "attempt"], "left_anti")


def outbox(moves: DataFrame) -> DataFrame:
    """Outbox rows of transitions: the workflow is the aggregate, the payload is bytes, and columns say what it holds."""
    return moves.select(
        F.col("workflow_id").alias("aggregate_id"), F.lit("workflow").alias("aggregate_type"), "event_type", "trace_parent", "sequence_engine_key", "occurred_at", F.encode("payload", "UTF-8").alias("payload")
    )


def outbox_of(outbox_rows: DataFrame, workflows: DataFrame, events: DataFrame) -> DataFrame:
    """Outbox rows of the workflows that ``events(event_id)`` started; their aggregate is the workflow, not the event."""
    mine = workflows.join(events.select("event_id"), "event_id", "left_semi").select(F.col("workflow_id").alias("aggregate_id"))
    return outbox_rows.join(mine, "aggregate_id", "left_semi")


def stitch(spans: DataFrame) -> DataFrame:
    """One row a trace over ``spans(trace_parent, service, at)``: how many spans, of which services, from when to when.

    Rows whose trace parent has no trace id go.
    """
    from lotflow.functions.text import trace

    named = spans.select(trace(F.col("trace_parent"))["trace_id"].alias("trace_id"), "service", "at").where("length(trace_id) > 0")
    return named.groupBy("trace_id").agg(F.count("*").alias("spans"), F.array_sort(F.collect_set("service")).alias("services"), F.min("at").alias("first_at"), F.max("at").alias("last_at"))


def overdue(workflows: DataFrame, as_of: str) -> DataFrame:
    """Workflows that still wait when their lease has run out."""
    return workflows.where((F.col("state") == "SUSPENDED") & (F.col("lease_expires_at") < F.lit(as_of).cast("timestamp")))


def order_of(needs: dict) -> dict | None:
    """node -> (position, level) over node -> the nodes that it needs; None if a cycle or an unknown need leaves one over."""
    followers: dict = {}
    for node, some in needs.items():
        for d in some:
            followers.setdefault(d, []).append(node)
    missing, level = {n: len(some) for n, some in needs.items()}, dict.fromkeys(needs, 0)
    queue = sorted(n for n, k in missing.items() if not k)
    for node in queue:  # grows meanwhile
        freed = []
        for n in followers.get(node, ()):
            missing[n] -= 1
            level[n] = max(level[n], level[node] + 1)
            if not missing[n]:
                freed.append(n)
        queue += sorted(freed)
    return {n: (k, level[n]) for k, n in enumerate(queue)} if len(queue) == len(needs) else None


def _orders_by_graph(named: DataFrame) -> DataFrame:
    """Task orders of graphs that a task can hold: rows are dealt and sorted by graph, one graph at a time is held."""
    types = dict(named.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, needs = None, {}

        def rows() -> Iterator[tuple]:
            order = order_of(needs)
            for n in needs:
                yield (here, n, *(order[n] if order else (None, None)), order is None)

        for batch in batches:
            out, kinds = [], [batch.column("graph_id").type, batch.column("node_id").type, pa.int64(), pa.int64(), pa.bool_()]
            for graph, node, need in zip(*(batch.column(c).to_pylist() for c in ("graph_id", "node_id", "dependency_id"))):
                if graph != here:
                    out += rows()
                    here, needs = graph, {}
                some = needs.setdefault(node, set())
                if need is not None:
                    some.add(need)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=_ORDER)
        if needs:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows()), kinds)], names=_ORDER)

    dealt = by_key(named.select("graph_id", "node_id", "dependency_id"), ("graph_id",))
    return dealt.mapInArrow(run, f"graph_id {types['graph_id']}, node_id {types['node_id']}, position long, level long, cyclic boolean")


_ORDER = ["graph_id", "node_id", "position", "level", "cyclic"]


def task_order(edges: DataFrame, bound: int = 200_000) -> DataFrame:
    """(graph_id, node_id, position, level, cyclic) over ``edges(graph_id, node_id, dependency_id)``.

    A node is ready once its last dependency is done; what one node makes ready follows in name order. A cycle, a self
    loop or an unknown dependency marks the whole graph; its nodes have no position. Edges without a graph or a node go.

    Graphs of at most ``bound`` edges are ordered in one pass, each by itself. Longer ones advance together, one level a
    round (``orders_by_rounds``); the answer is the same.
    """
    named = edges.where("graph_id is not null and node_id is not null")
    large = cut(named.groupBy("graph_id").count().where(F.col("count") > bound).select("graph_id"))
    if large.isEmpty():
        return _orders_by_graph(named)
    return _orders_by_graph(named.join(large, "graph_id", "left_anti")).unionByName(orders_by_rounds(named.join(large, "graph_id", "left_semi")))


def orders_by_rounds(edges: DataFrame) -> DataFrame:
    """As ``task_order``, for graphs of any size: all advance together, one level a round.

    A level's nodes follow the place of their last dependency, then their name. A round joins the newest level with the
    edges, so there are as many rounds as the longest chain has nodes.
    """
    named = edges.where("graph_id is not null and node_id is not null")
    needs = cut(named.where("dependency_id is not null").select("graph_id", "node_id", "dependency_id").distinct())
    missing = needs.groupBy("graph_id", "node_id").agg(F.count("*").alias("missing"))
    waiting = named.select("graph_id", "node_id").distinct().join(missing, ["graph_id", "node_id"], "left")
    waiting = cut(waiting.selectExpr("graph_id", "node_id", "coalesce(missing, 0L) as missing", "-1L as after", "0L as done"))
    levels: list[DataFrame] = []
    while True:
        place = "done + row_number() over (partition by graph_id order by after, node_id) - 1 as position"
        total = "done + count(*) over (partition by graph_id) as total"
        newest = cut(waiting.where("missing = 0").selectExpr("graph_id", "node_id", place, f"{len(levels)}L as level", total))
        if newest.isEmpty():
            break
        levels.append(newest)
        freed = needs.join(newest.selectExpr("graph_id", "node_id as dependency_id", "position", "total"), ["graph_id", "dependency_id"])
        freed = freed.groupBy("graph_id", "node_id").agg(F.count("*").alias("met"), F.max("position").alias("newest_after"), F.max("total").alias("newest_done"))
        left = waiting.where("missing > 0").join(freed, ["graph_id", "node_id"], "left")
        waiting = cut(left.selectExpr("graph_id", "node_id", "missing - coalesce(met, 0) as missing", "coalesce(newest_after, after) as after", "coalesce(newest_done, done) as done"))
    stuck = waiting.select("graph_id").distinct().withColumn("cyclic", F.lit(True))
    unplaced = waiting.selectExpr("graph_id", "node_id", "cast(null as long) as position", "cast(null as long) as level")
    nodes = reduce(DataFrame.unionByName, [df.drop("total") for df in levels], unplaced).join(stuck, "graph_id", "left")
    keep = lambda c: F.when(F.col("cyclic").isNull(), F.col(c)).alias(c)
    return nodes.select("graph_id", "node_id", keep("position"), keep("level"), F.col("cyclic").isNotNull().alias("cyclic"))
