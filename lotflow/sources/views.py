"""Inputs derived from the given tables by Spark, row for row the same as the SQL in ``plans.sql``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lotflow.runtime import table


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory movements, one a line item; quantity and unit_cost are text, as on the wire."""
    line = table(spark, sf_dir, "lineitem")
    # each id names the hash once: a filter on it, pushed to the scan, then hashes once as well
    h = F.md5(F.concat_ws("-", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")]))
    keyed = line.withColumn("h", h).withColumn("day", F.expr("datediff(cast(l_shipdate as date), date'1992-01-01')"))
    return keyed.select(
        F.expr("concat(substring(h, 1, 8), '-', substring(h, 9, 4), '-', substring(h, 13, 4), '-', substring(h, 17, 4), '-', substring(h, 21, 12))").alias("event_id"),
        F.expr("concat('00-', h, '-', substring(h, 1, 16), '-01')").alias("trace_parent"),
        F.expr("concat('VENDOR-', l_suppkey)").alias("aggregate_id"),
        F.col("l_shipdate").alias("occurred_at"),
        F.expr("timestampadd(DAY, cast(l_orderkey % 45 as int), l_shipdate)").alias("published_at"),
        F.expr("day * 100000000000 + l_orderkey * 10 + l_linenumber").cast("long").alias("sequence_engine_key"),
        F.expr("case when l_returnflag = 'N' then 1 when l_returnflag = 'A' then 2 else 3 end").alias("movement_type"),
        F.expr("concat('SKU-', l_partkey)").alias("sku"),
        F.expr("concat('VENDOR-', l_suppkey)").alias("mdm_vendor_id"),
        F.expr("concat('LOC-', l_suppkey % 2)").alias("location_id"),
        F.expr("cast(cast(case when l_returnflag = 'R' and l_linestatus = 'F' then -l_quantity else l_quantity end as decimal(18,4)) as string)").alias("quantity"),
        F.expr("cast(cast(l_extendedprice as decimal(18,2)) as string)").alias("unit_cost"),
        (F.col("l_linenumber") == 1).alias("redelivered"),
    )


def redelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements of an at-least-once source, read once: first lines arrive again one day later."""
    once = movements(spark, sf_dir)
    again = once.withColumn("_after", F.explode(F.when(F.col("redelivered"), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return again.withColumn("published_at", F.expr("timestampadd(DAY, _after, published_at)")).drop("_after")


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movements with faults by sequence key, everything as text, as a contract check meets them."""
    k = F.col("sequence_engine_key") % 50
    df = movements(spark, sf_dir)
    return df.select(
        F.when(k == 0, "definitely-not-a-uuid").when(k == 7, F.concat("event_id", F.lit("\n"))).otherwise(F.col("event_id")).alias("event_id"),
        F.when(k == 1, "00-xyz-01").otherwise(F.col("trace_parent")).alias("trace_parent"),
        "aggregate_id",
        F.when(k == 5, None).otherwise(F.col("occurred_at")).alias("occurred_at"),
        "published_at",
        F.when(k == 6, F.concat(F.lit("99"), F.lpad(F.col("sequence_engine_key").cast("string"), 18, "0"))).otherwise(F.col("sequence_engine_key").cast("string")).alias("sequence_engine_key"),
        "movement_type",
        F.when(k == 2, "").otherwise(F.col("sku")).alias("sku"),
        "mdm_vendor_id",
        "location_id",
        F.when(k == 3, "1e3").when(k == 8, F.concat("quantity", F.lit("\n"))).when(k == 9, F.lit("0.00004")).otherwise(F.col("quantity")).alias("quantity"),
        F.when(k == 4, F.concat(F.lit("-"), "unit_cost")).otherwise(F.col("unit_cost")).alias("unit_cost"),
    )


def changefeed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change-feed lines: row images, every 50th a watermark, every 97th a tombstone, every 101st malformed."""
    e = table(spark, sf_dir, "events")
    seq = F.col("event_id") + F.lit(1784933243325766766)
    after = F.to_json(F.struct(
        F.concat(F.lit("agg-"), F.col("user_id")).alias("aggregate_id"), F.col("event_type").alias("event_type"), seq.alias("sequence_engine_key"),
        F.concat(F.lit("tp-"), F.col("event_id")).alias("trace_parent"), F.when(F.col("event_id") % 31 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")).alias("occurred_at"), (F.col("event_id") % 1000).alias("fifo_total_value"),
    ))
    after = F.when(F.col("event_id") % 37 == 0, F.regexp_replace(after, '"aggregate_id":"agg-([0-9]+)"', '"aggregate_id":$1.50e0')).otherwise(after)
    value = (
        F.when(F.col("event_id") % 101 == 0, '{"after": ')
        .when(F.col("event_id") % 97 == 0, '{"after": null}')
        .when(F.col("event_id") % 50 == 0, F.concat(F.lit('{"resolved":"'), seq.cast("string"), F.lit('.0000000000"}')))
        .otherwise(F.concat(F.lit('{"after":'), after, F.lit(',"updated":"'), seq.cast("string"), F.lit('"}')))
    )
    topic = F.when(F.col("event_id") % 3 == 0, "fact_inventory_movement").when(F.col("event_id") % 3 == 1, "orchestrator_outbox").otherwise("unrelated")
    return e.select(F.col("event_id").alias("offset"), topic.alias("topic"), value.alias("value"))


def settlement_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projected events of the live page."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.concat(F.lit("agg-"), F.col("user_id")).alias("aggregate_id"), (F.col("event_id") + F.lit(1784933243325766766)).alias("sequence_engine_key"),
        F.when(F.col("event_type") == "error", "FAILURE").otherwise("SUCCESS").alias("status"), F.upper("event_type").alias("stage"), F.col("value"), F.lit(False).alias("sla_breached"), F.col("ts").alias("occurred_at"),
    )


def triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One workflow trigger an order, and again for every seventh."""
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("evt-"), F.col("o_orderkey")).alias("event_id"), F.concat(F.lit("tp-"), F.col("o_orderkey")).alias("trace_parent"), (F.col("o_orderkey") * 10).alias("sequence_engine_key"), F.col("o_orderdate").alias("occurred_at"), F.col("o_orderkey").alias("k"),
    )
    again = o.where("k % 7 = 0").withColumn("sequence_engine_key", F.col("sequence_engine_key") + 5)
    return o.unionByName(again).drop("k")


def approvals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals of finished orders, some twice, and some for workflows that do not exist."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_custkey")
    row = lambda df, prefix, plus: df.select(
        F.concat(F.lit(prefix), F.col("o_orderkey")).alias("event_id"), (F.col("o_orderkey") * 10 + plus).alias("sequence_engine_key"), F.concat(F.lit("user-"), F.col("o_custkey")).alias("approved_by"), F.expr(f"timestampadd(DAY, {plus}, o_orderdate)").alias("approved_at")
    )
    done = o.where("o_orderstatus = 'F'")
    return row(done, "evt-", 1).unionByName(row(done.where("o_orderkey % 5 = 0"), "evt-", 2)).unionByName(row(o.where("o_orderkey % 50 = 0"), "evt-absent-", 3))


def uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URIs to screen, with the address that a resolver would give for each host."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("uri"))
    return p


def completions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classifier outputs as text."""
    c = table(spark, sf_dir, "conversations")
    texts = F.array(*[F.lit(t) for t in ("1", "2", "3", "4", "\u00a0 2\u0085\n", "0", "5", "1.0", "The intent is 1")])
    return c.select("conv_id", "turn", F.element_at(texts, ((F.col("conv_id") * 31 + F.col("turn")) % 9 + 1).cast("int")).alias("completion"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation texts with chat-control tokens spliced in, some of them far above the cut and in wide characters."""
    c = table(spark, sf_dir, "conversations")
    token = F.element_at(F.array(*[F.lit(t) for t in ("", "<|endoftext|>", "<|im_start|>", "<|im_end|>", "<sys<system>tem>", "</system>")]), (F.col("turn") % 6 + 1).cast("int"))
    return c.select("conv_id", "turn", F.concat(F.lit("a"), token, F.col("text"), token, F.repeat(F.lit("é漢🙂x"), F.when((F.col("conv_id") + F.col("turn")) % 40 == 7, 3300 + F.col("turn")).otherwise(0).cast("int"))).alias("body"), F.col("role").alias("subject"))


def deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vendor e-mails from conversations: with faults, redeliveries (odd turns of every third), and failed effects."""
    c = table(spark, sf_dir, "conversations").withColumn("k", (F.col("conv_id") * 31 + F.col("turn")) % 20).withColumn("offset", F.col("conv_id") * 100 + F.col("turn"))
    source = F.when(F.col("conv_id") % 3 == 0, F.col("turn") - F.col("turn") % 2).otherwise(F.col("turn"))
    c = c.withColumn("h", F.md5(F.concat_ws("-", F.lit("mail"), F.col("conv_id").cast("string"), source.cast("string"))))
    at = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return c.select(
        "offset", "conv_id", F.when(F.col("k") == 1, "bad-id").otherwise(F.regexp_replace("h", "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")).alias("event_id"),
        F.regexp_replace("h", "^(.{16})(.{16})$", "00-$1$2-$1-01").alias("trace_parent"), F.concat(F.lit("CONV-"), "conv_id").alias("aggregate_id"), at.alias("occurred_at"), F.when(F.col("k") != 2, at).alias("published_at"),
        F.col("offset").cast("string").alias("sequence_engine_key"), F.lit(1).alias("visualization_stage"), F.when(F.col("k") == 3, 9).otherwise(F.col("turn") % 5).cast("int").alias("intent_classification"),
        F.when(F.col("k") == 4, "nobody").otherwise(F.concat(F.lit("desk"), "conv_id", F.lit("@vendor.example"))).alias("vendor_email"), F.concat(F.lit("VENDOR-"), F.col("conv_id") % 7).alias("mdm_vendor_id"),
        F.concat(F.lit("store://mail/"), "offset").alias("secure_subject_uri"), F.when(F.col("k") == 5, "").otherwise(F.concat(F.lit("store://body/"), "offset")).alias("secure_body_uri"),
        F.sequence(F.lit(1), F.when(F.col("k") == 6, 26).otherwise(1)).alias("attachments"), (F.col("offset") % 7).alias("attempts"),
        F.when(F.col("offset") % 11 == 3, "40001").when(F.col("offset") % 11 == 5, "23505").when(F.col("offset") % 11 == 7, "XX000").alias("sqlstate"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot messages as text, with faults by sequence key."""
    m, k = movements(spark, sf_dir), F.col("sequence_engine_key") % 50
    return m.select(
        F.when(k == 0, F.concat("sku", F.lit("_2024-01-01"))).otherwise(F.col("event_id")).alias("snapshot_id"), F.when(k == 1, "abc").otherwise(F.col("quantity")).alias("qty_on_hand"),
        F.when(k == 2, F.concat(F.lit("-"), "unit_cost")).otherwise(F.col("unit_cost")).alias("fifo_total_value"), F.when(k == 3, "").otherwise(F.col("unit_cost")).alias("moving_avg_cost"),
    )


def two_topic_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Approvals as plain messages, and as hex or base64 inside change-feed envelopes; some broken, some watermarks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("offset"), F.col("o_custkey").alias("c"))
    text = lambda who: F.concat(F.lit('{"event_id":"evt-'), "offset", F.lit(f'","approved_by":"{who}-'), "c", F.lit('"}'))
    raw = o.select("offset", F.lit("approval").alias("topic"), F.when(F.col("offset") % 101 == 0, '{"event_id": ').when(F.col("offset") % 103 == 0, "3").when(F.col("offset") % 107 == 0, "[]").otherwise(text("user")).alias("value"))
    data = F.encode(text("desk"), "UTF-8")
    payload = F.when(F.col("offset") % 97 == 0, r"\\xzz").when(F.col("offset") % 2 == 0, F.concat(F.lit(r"\\x"), F.lower(F.hex(data)))).otherwise(F.base64(data))
    value = F.when(F.col("offset") % 89 == 0, '{"resolved":"123"}').when(F.col("offset") % 83 == 0, '{"after":null}').when(F.col("offset") % 79 == 0, '{"after"').otherwise(F.concat(F.lit('{"after":{"payload":"'), payload, F.lit('"}}')))
    return raw.unionByName(o.select("offset", F.lit("outbox_feed").alias("topic"), value.alias("value")))


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of three services that share the trace of an order: its message, its approval, its movements."""
    def of(df: DataFrame, service: str, key: str, at: str) -> DataFrame:
        span = F.substring(F.md5(F.concat(F.lit(f"{service}-"), key)), 1, 16)
        return df.select(F.concat(F.lit("00-"), F.md5(F.concat(F.lit("order-"), key)), F.lit("-"), span, F.lit("-01")).alias("trace_parent"), F.lit(service).alias("service"), F.col(at).alias("at"))

    orders = table(spark, sf_dir, "orders")
    done = orders.where("o_orderstatus = 'F'").withColumn("approved_at", F.expr("timestampadd(DAY, 1, o_orderdate)"))
    return of(orders, "messages", "o_orderkey", "o_orderdate").unionByName(of(done, "workflows", "o_orderkey", "approved_at")).unionByName(of(table(spark, sf_dir, "lineitem"), "inventory", "l_orderkey", "l_shipdate"))


def task_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task graph an order: lines depend on one or two lines before; every tenth has a cycle, every 17th lacks a task."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("n")).agg(F.max("l_partkey").alias("p"))
    order = "over (partition by l_orderkey order by n)"
    lines = lines.selectExpr("*", f"lag(n) {order} as one", f"lag(n, 2) {order} as two", f"row_number() {order} = 1 as head", "max(n) over (partition by l_orderkey) as tail")
    needs = "array(if(p % 3 <> 0, one, null), if(p % 4 = 0, two, null), if(head and l_orderkey % 10 = 0, tail, null), if(head and l_orderkey % 17 = 0, 99, null))"
    return lines.select(F.expr("concat('g', l_orderkey)").alias("graph_id"), F.expr("concat('n', n)").alias("node_id"), F.explode_outer(F.expr(f"transform(array_compact({needs}), x -> concat('n', x))")).alias("dependency_id"))
