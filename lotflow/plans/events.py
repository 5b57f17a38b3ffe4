"""Queries of change feeds, settlement, workflows, vendor messages, dead letters and dimensions, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from lotflow.functions import text
from lotflow.operators import contracts, dedup, dims, dlq, settlement, vendor, workflow
from lotflow.plans.sql import MOVEMENTS, with_movements
from lotflow.runtime import table
from lotflow.sources import changefeed, views

BASE = 1784933243325766766
_D = lambda name: F.round(F.col(name).cast("double"), 6).alias(name)
_TS = lambda name: F.col(name).cast("timestamp_ntz").alias(name)


# change feeds


def changefeed_decode(spark, sf_dir):
    rows, _, _ = changefeed.decode(views.changefeed_records(spark, sf_dir))
    return changefeed.projections(rows).select("aggregate_id", "stage", "status", "sequence_engine_key", _TS("occurred_at"), "trace_parent", "value")


def changefeed_watermarks(spark, sf_dir):
    _, marks, _ = changefeed.decode(views.changefeed_records(spark, sf_dir), resolved="non_null")
    return marks.select("topic", "offset", F.col("watermark").cast("long").alias("watermark"))


def changefeed_dead_letters(spark, sf_dir):
    _, _, dead = changefeed.decode(views.changefeed_records(spark, sf_dir), on_error="dlq")
    records = dead.select("topic", F.col("offset").cast("string").alias("key"), "value", F.array().cast("array<struct<key:string,value:binary>>").alias("headers"), "reason")
    out = dlq.dead_letters(records)
    return out.select("topic", "key", "value", F.transform("headers", lambda h: F.concat(h["key"], F.lit("="), F.decode(h["value"], "UTF-8")))[0].alias("first_header"), F.size("headers").alias("n_headers"))


def changefeed_roundtrip(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    lines = changefeed.encode(rows, "fact_inventory_movement", "event_id")
    back, marks, _ = changefeed.decode(lines)
    whole = back.select(*[F.expr(f"try_variant_get(after, '$.{c}', '{t}')").alias(c) for c, t in (("event_id", "bigint"), ("user_id", "bigint"), ("event_type", "string"))])
    return whole.unionByName(marks.select(F.col("watermark").cast("long").alias("event_id"), F.lit(-1).cast("long").alias("user_id"), F.lit("resolved").alias("event_type")))


def watermark_in_force(spark, sf_dir):
    r = views.changefeed_records(spark, sf_dir)
    marked = r.withColumn("watermark", changefeed.watermark(F.get_json_object("value", "$.resolved")).cast("long"))
    return settlement.watermark_in_force(marked).groupBy("topic", F.coalesce("in_force", F.lit(0)).alias("in_force")).agg(F.count("*").alias("records"))


def two_topic_decode(spark, sf_dir):
    good, dead = changefeed.two_topics(views.two_topic_records(spark, sf_dir), "approval", "outbox_feed", "event_id string, approved_by string")
    done = good.select("topic", "offset", "message.event_id", "message.approved_by", F.lit("decoded").alias("outcome"))
    return done.unionByName(dead.select("topic", "offset", F.lit(None).cast("string").alias("event_id"), F.lit(None).cast("string").alias("approved_by"), F.col("reason").alias("outcome")))


# settlement


def _events(spark, sf_dir):
    """Events, and how many there are: windows and hand-offs lie at shares of them."""
    e = views.settlement_events(spark, sf_dir).select("aggregate_id", "sequence_engine_key", "status").withColumn("k", F.col("sequence_engine_key") - BASE)
    return e, e.count()


def newest_first(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("agg-"), F.col("user_id")).alias("aggregate_id"), F.col("event_id").cast("string").alias("sequence_engine_key"))
    return settlement.ordered(settlement.newest_of_each(e), newest_first=True)


def _marks(spark, sf_dir):
    return views.settlement_events(spark, sf_dir).agg((F.lit(BASE) + F.floor(F.count("*") * 0.8)).alias("watermark"))


def settlement_split(spark, sf_dir):
    out = settlement.split(views.settlement_events(spark, sf_dir), _marks(spark, sf_dir))
    return out.select("aggregate_id", "sequence_engine_key", "settled", settlement.label(F.col("stage")).alias("label"), settlement.breached().alias("exception"))


def settlement_figures(spark, sf_dir):
    out = settlement.split(views.settlement_events(spark, sf_dir), _marks(spark, sf_dir))
    return settlement.figures(out, "stage").select("stage", "settled", "in_flight", _D("settled_value"), "exceptions")


def projection_merge(spark, sf_dir):
    e, n = _events(spark, sf_dir)
    old, new = e.where(f"k < {n * 6 // 10}").drop("k"), e.where(f"k >= {n * 4 // 10}").drop("k").withColumn("status", F.concat("status", F.lit("_NEW")))
    return dedup.merge_unique(old, new.unionByName(new), ["aggregate_id", "sequence_engine_key"])


def live_handoff(spark, sf_dir):
    e, n = _events(spark, sf_dir)
    history = e.where(f"k < {n // 2} and k % 10 <> 0").drop("k")  # every tenth row came late and is live only
    return settlement.hand_off(history, e.where(f"k >= {n * 3 // 10} or k % 10 = 0").drop("k"), ["aggregate_id", "sequence_engine_key"])


def replay_range(spark, sf_dir):
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderkey")).first()[0] or 0
    wf = settlement.replay(_workflows(spark, sf_dir), newest, 5 * newest)  # keys are ten times the order's
    return settlement.ordered(wf.select(F.col("event_id").alias("aggregate_id"), F.col("state").alias("stage"), F.lit("SUCCESS").alias("status"), "sequence_engine_key"))


# workflows


def _workflows(spark, sf_dir):
    return workflow.states(views.triggers(spark, sf_dir), views.approvals(spark, sf_dir))


def workflow_states(spark, sf_dir):
    return _workflows(spark, sf_dir).select("workflow_id", "event_id", "sequence_engine_key", "state", "current_node_index", "next_node", "approved_by")


def workflow_transitions(spark, sf_dir):
    wf = _workflows(spark, sf_dir)
    done = workflow.transitions(wf).where("sequence_engine_key % 3 = 0")
    return workflow.transitions(wf, done).select("workflow_id", "node_id", "attempt", "event_type", "payload", _TS("occurred_at"))


def workflow_outbox(spark, sf_dir):
    out = workflow.outbox(workflow.transitions(_workflows(spark, sf_dir)))
    return out.select("aggregate_id", "aggregate_type", "event_type", "sequence_engine_key", F.decode("payload", "UTF-8").alias("payload"))


def outbox_of_repeated_approvals(spark, sf_dir):
    wf = _workflows(spark, sf_dir)
    again = workflow.approvals_with_disposition(views.triggers(spark, sf_dir), views.approvals(spark, sf_dir)).where("disposition = 'duplicate'")
    return workflow.outbox_of(workflow.outbox(workflow.transitions(wf)), wf, again).groupBy("aggregate_id").agg(F.count("*").alias("outbox_rows"))


def approval_dispositions(spark, sf_dir):
    return workflow.approvals_with_disposition(views.triggers(spark, sf_dir), views.approvals(spark, sf_dir)).select("event_id", "sequence_engine_key", "approved_by", "disposition")


def overdue_approvals(spark, sf_dir):
    return workflow.overdue(_workflows(spark, sf_dir), "1996-01-01 00:00:00").select("workflow_id", _TS("lease_expires_at"))


def task_order(spark, sf_dir):
    return workflow.task_order(views.task_edges(spark, sf_dir))


# vendor messages


def uri_screen(spark, sf_dir):
    u = views.uris(spark, sf_dir)
    hosts = u.select(F.try_parse_url("uri", F.lit("HOST")).alias("host")).where("host is not null").distinct()
    number = F.conv(F.substring(F.md5("host"), 1, 2), 16, 10).cast("int")
    allowed = hosts.where(number % 4 != 0).select("host")
    addresses = hosts.select("host", F.when(number % 15 == 0, F.concat(F.lit("::ffff:10.1.2."), number)).when(number % 5 == 0, F.concat(F.lit("10.1.2."), number)).otherwise(F.concat(F.lit("93.184.216."), number)).alias("ip"))
    return vendor.screen(u, allowed, addresses).select("page_id", "host", F.coalesce("rejected", F.lit("accepted")).alias("outcome"))


def sanitize_text(spark, sf_dir):
    return views.messages(spark, sf_dir).select("conv_id", "turn", F.md5(text.sanitize(F.col("body"))).alias("digest"), F.length(text.sanitize(F.col("body"))).alias("kept"))


def prompt_build(spark, sf_dir):
    out = vendor.requests(views.messages(spark, sf_dir))
    return out.select("conv_id", "turn", F.md5("prompt").alias("digest"), text.truncate(F.reverse("prompt"), 24).alias("shown"))


def intent_parse(spark, sf_dir):
    good, bad = vendor.classified(views.completions(spark, sf_dir))
    return good.select("conv_id", "turn", "intent", F.lit("classified").alias("outcome")).unionByName(bad.select("conv_id", "turn", F.lit(0).alias("intent"), F.col("reason").alias("outcome")))


def email_contract(spark, sf_dir):
    checked = contracts.violations(views.deliveries(spark, sf_dir), contracts.EMAIL_RULES)
    return checked.select(F.explode_outer("errors").alias("error")).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("emails"))


def email_dispositions(spark, sf_dir):
    mail = views.deliveries(spark, sf_dir)
    return vendor.received(mail, mail.where("conv_id % 10 = 9").select("event_id")).select("offset", "event_id", "reason", "disposition")


def snapshot_contract(spark, sf_dir):
    checked = contracts.violations(views.snapshots(spark, sf_dir), contracts.SNAPSHOT_RULES)
    return checked.select(F.explode_outer("errors").alias("error")).groupBy(F.coalesce("error", F.lit("ok")).alias("error")).agg(F.count("*").alias("snapshots"))


# dead letters and traces


_CODES = [*dlq.TRANSIENT, *dlq.TERMINAL, "08P01", "57014", "25000", "XX000", "57"]


def error_triage(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("event_id") % len(_CODES) + 1).cast("int")).alias("sqlstate"))
    return dlq.triage(e).groupBy("sqlstate", "error_class").agg(F.count("*").alias("errors"))


def trace_stitch(spark, sf_dir):
    out = workflow.stitch(views.spans(spark, sf_dir))
    return out.select("trace_id", "spans", F.array_join("services", ",").alias("services"), _TS("first_at"), _TS("last_at"))


def event_latency(spark, sf_dir):
    m = views.movements(spark, sf_dir)
    return m.groupBy("mdm_vendor_id").agg(F.max(text.latency_us(F.col("published_at"), F.col("occurred_at"))).alias("max_us"), F.sum(text.latency_us(F.col("published_at"), F.col("occurred_at"))).alias("sum_us"))


# dimensions


def vendor_scd2(spark, sf_dir):
    m = views.movements(spark, sf_dir).groupBy("mdm_vendor_id", "occurred_at").agg(F.max("location_id").alias("location_id"))
    return dims.scd2(m, "mdm_vendor_id", "location_id", "occurred_at").unionByName(
        dims.scd2(table(spark, sf_dir, "orders").groupBy(F.concat(F.lit("C-"), "o_custkey").alias("mdm_vendor_id"), F.col("o_orderdate").alias("occurred_at")).agg(F.max("o_orderstatus").alias("location_id")), "mdm_vendor_id", "location_id", "occurred_at")
    ).select("mdm_vendor_id", "location_id", _TS("valid_from"), _TS("valid_to"), "current")


def date_spine(spark, sf_dir):
    return dims.date_spine(table(spark, sf_dir, "orders"), "o_orderdate")


def dim_product(spark, sf_dir):
    return dims.dimension(views.movements(spark, sf_dir), "sku", "mdm_vendor_id")


def dim_location(spark, sf_dir):
    return dims.seen_between(views.movements(spark, sf_dir), "location_id", "occurred_at").select("location_id", _TS("first_seen"), _TS("last_seen"), "surrogate_key")


def filtered_resume(spark, sf_dir):
    m = views.movements(spark, sf_dir).where("mdm_vendor_id in ('VENDOR-1', 'VENDOR-7')")
    return settlement.replay(m, 200_000_000_000_000, exclusive=True).select("event_id", "mdm_vendor_id", "sku", "sequence_engine_key")


_SEQ = f"(event_id + {BASE})"
_KIND = "case when event_id % 101 = 0 then 'bad' when event_id % 97 = 0 then 'tombstone' when event_id % 50 = 0 then 'mark' else 'row' end"
_TOPIC = "case when event_id % 3 = 0 then 'fact_inventory_movement' when event_id % 3 = 1 then 'orchestrator_outbox' else 'unrelated' end"
_SETTLE = f"se as (select 'agg-' || user_id as aggregate_id, event_id + {BASE} as sequence_engine_key, case when event_type = 'error' then 'FAILURE' else 'SUCCESS' end as status, upper(event_type) as stage, value, (select {BASE} + floor(count(*) * 0.8) from events) as w from events)"
_TRIGGERS = """trig as (select 'evt-' || o_orderkey as event_id, o_orderkey * 10 as seq, o_orderdate as occurred_at from orders),
appr as (select 'evt-' || o_orderkey as event_id, o_orderkey * 10 + 1 as seq, 'user-' || o_custkey as approved_by, o_orderdate + interval 1 day as approved_at from orders where o_orderstatus = 'F'
 union all select 'evt-' || o_orderkey, o_orderkey * 10 + 2, 'user-' || o_custkey, o_orderdate + interval 2 day from orders where o_orderstatus = 'F' and o_orderkey % 5 = 0
 union all select 'evt-absent-' || o_orderkey, o_orderkey * 10 + 3, 'user-' || o_custkey, o_orderdate + interval 3 day from orders where o_orderkey % 50 = 0),
wf as (select 'wf-' || t.event_id as workflow_id, t.event_id, t.seq as sequence_engine_key, t.occurred_at, a.approved_by, a.approved_at from trig t left join (select * from appr where seq % 10 = 1) a on t.event_id = a.event_id)"""
_MESSAGE = "(select conv_id, turn, role, 'a' || tok || text || tok || repeat('é漢🙂x', case when (conv_id + turn) % 40 = 7 then cast(3300 + turn as bigint) else 0 end) as body from (select *, (['', '<|endoftext|>', '<|im_start|>', '<|im_end|>', '<sys<system>tem>', '</system>'])[1 + turn % 6] as tok from conversations))"
_CLEAN = r"regexp_replace({}, '<\|endoftext\|>|<\|im_start\|>|<\|im_end\|>|<system>|</system>', '', 'g')"


_MAIL = """mail as (select *, case k when 1 then 'bad-id' else concat_ws('-',substr(h,1,8),substr(h,9,4),substr(h,13,4),substr(h,17,4),substr(h,21,12)) end as event_id,
  case k when 1 then 'event_id_uuid' when 2 then 'published_at_missing' when 3 then 'intent_undefined' when 4 then 'vendor_email_format' when 5 then 'body_uri_format' when 6 then 'attachments_too_many' end as err,
  case off % 11 when 3 then '40001' when 5 then '23505' when 7 then 'XX000' end as code
 from (select conv_id, conv_id * 100 + turn as off, (conv_id * 31 + turn) % 20 as k, md5('mail-' || conv_id || '-' || case when conv_id % 3 = 0 then turn - turn % 2 else turn end) as h from conversations))"""


def _cut(text: str, n: int, more: str) -> str:
    """SQL of at most n bytes of a text in whole characters: the cut is made in hex, and a broken tail goes."""
    tail = "(C[0-9A-F]|D[0-9A-F]|E[0-9A-F]([89AB][0-9A-F])?|F[0-9A-F]([89AB][0-9A-F])?([89AB][0-9A-F])?)$"
    return f"case when octet_length(encode({text})) <= {n} then {text} else decode(unhex(regexp_replace(substr(hex(encode({text})), 1, {2 * n}), '{tail}', ''))) || '{more}' end"


def _codes_sql() -> str:
    quoted = lambda some: ", ".join(f"'{c}'" for c in some)
    return f"""select sqlstate, case when sqlstate in ({quoted(dlq.TRANSIENT)}) then 'transient' when sqlstate in ({quoted(dlq.TERMINAL)}) then 'terminal'
 when length(sqlstate) = 5 and substr(sqlstate, 1, 2) in ('08', '57') then 'transient' else 'unknown' end as error_class, count(*) as errors
 from (select ([{quoted(_CODES)}])[1 + event_id % {len(_CODES)}] as sqlstate from events) group by all"""


ORACLE = {
    "changefeed_decode": f"select case when event_id % 37 = 0 then user_id || '.50e0' else 'agg-' || user_id end as aggregate_id, case when event_id % 3 = 0 then 'RECEIVED' else 'PO_CREATED' end as stage, case when event_id % 3 = 0 then 'SUCCESS' else event_type end as status, cast({_SEQ} as varchar) as sequence_engine_key, case when event_id % 31 <> 0 then date_trunc('second', ts) end as occurred_at, 'tp-' || event_id as trace_parent, case when event_id % 3 = 0 then cast(event_id % 1000 as double) else 0 end as value from events where {_KIND} = 'row' and event_id % 3 < 2",
    "changefeed_watermarks": f"select {_TOPIC} as topic, event_id as offset, {_SEQ} as watermark from events where {_KIND} = 'mark'",
    "changefeed_dead_letters": f"select {_TOPIC} || '.dlq' as topic, cast(event_id as varchar) as key, '{{\"after\": ' as value, 'error_reason=malformed_json' as first_header, 2 as n_headers from events where {_KIND} = 'bad'",
    "changefeed_roundtrip": "select event_id, user_id, event_type from events union all select max(event_id), -1, 'resolved' from events",
    "watermark_in_force": f"select topic, coalesce(w, 0) as in_force, count(*) as records from (select {_TOPIC} as topic, last_value(case when {_KIND} = 'mark' then {_SEQ} end ignore nulls) over (partition by {_TOPIC} order by event_id rows unbounded preceding) as w from events) group by all",
    "settlement_split": f"with {_SETTLE} select aggregate_id, sequence_engine_key, sequence_engine_key <= w as settled, lower(replace(stage, '_', ' ')) as label, status = 'FAILURE' as exception from se",
    "settlement_figures": f"with {_SETTLE} select stage, count(*) filter (sequence_engine_key <= w) as settled, count(*) filter (sequence_engine_key > w) as in_flight, round(sum(case when sequence_engine_key <= w then coalesce(value, 0) else 0 end), 6) as settled_value, count(*) filter (sequence_engine_key <= w and status = 'FAILURE') as exceptions from se group by stage",
    "projection_merge": f"with {_SETTLE} select aggregate_id, sequence_engine_key, case when sequence_engine_key - {BASE} < (select count(*) * 6 // 10 from events) then status else status || '_NEW' end as status from se",
    "live_handoff": f"with {_SETTLE} select aggregate_id, sequence_engine_key, status from se",
    "replay_range": f"with {_TRIGGERS} select event_id as aggregate_id, case when approved_at is null then 'SUSPENDED' else 'COMPLETED' end as stage, 'SUCCESS' as status, sequence_engine_key from wf where sequence_engine_key between (select max(o_orderkey) from orders) and (select 5 * max(o_orderkey) from orders)",
    "workflow_states": f"with {_TRIGGERS} select workflow_id, event_id, sequence_engine_key, case when approved_at is null then 'SUSPENDED' else 'COMPLETED' end as state, case when approved_at is null then 0 else 2 end as current_node_index, case when approved_at is null then 'human_approval' else '' end as next_node, approved_by from wf",
    "workflow_transitions": f"""with {_TRIGGERS} select workflow_id, node as node_id, 1 as attempt, 'NodeTransition' as event_type, '{{"status":"' || case when node = 'final_step' then 'completed' else 'approved' end || '","node":"' || node || '"}}' as payload, approved_at as occurred_at from wf, unnest(['human_approval', 'final_step']) as u(node) where approved_at is not null and sequence_engine_key % 3 <> 0""",
    "approval_dispositions": f"with {_TRIGGERS} select event_id, seq as sequence_engine_key, approved_by, case seq % 10 when 1 then 'accepted' when 2 then 'duplicate' else 'no_workflow' end as disposition from appr",
    "overdue_approvals": f"with {_TRIGGERS} select workflow_id, occurred_at + interval 24 hour as lease_expires_at from wf where approved_at is null and occurred_at + interval 24 hour < timestamp '1996-01-01'",
    "uri_screen": r"""select page_id, host, case when not starts_with(url, 'https://') then 'scheme' when n % 4 = 0 then 'allowlist' when n % 5 = 0 then 'non_public' else 'accepted' end as outcome
 from (select *, cast('0x' || substr(md5(host), 1, 2) as integer) as n from (select page_id, url, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) as host from pages))""",
    "sanitize_text": f"select conv_id, turn, md5({_CLEAN.format('body')}) as digest, cast(length({_CLEAN.format('body')}) as integer) as kept from {_MESSAGE}",
    "prompt_build": f"select conv_id, turn, md5(p) as digest, {_cut('reverse(p)', 24, '…')} as shown from (select conv_id, turn, 'Subject: ' || role || chr(10) || 'Body: ' || {_CLEAN.format(_cut('body', 32768, ''))} as p from {_MESSAGE})",
    "email_contract": f"with {_MAIL} select coalesce(err, 'ok') as error, count(*) as emails from mail group by all",
    "email_dispositions": f"""with {_MAIL}, seen as (select *, row_number() over (partition by event_id, err is null order by off) as n, event_id in (select event_id from mail where conv_id % 10 = 9) as done from mail)
 select off as "offset", event_id, coalesce(err, 'sqlstate_' || code) as reason, case when err is not null then 'terminal' when done or n > 1 then 'duplicate' when code is null then 'ok' when code = '40001' and off % 7 < 5 then 'retry' when code = '40001' then 'transient_exhausted' else 'terminal' end as disposition from seen""",
    "snapshot_contract": with_movements("select case sequence_engine_key % 50 when 0 then 'snapshot_id_uuid' when 1 then 'quantity_format' when 2 then 'value_format' when 3 then 'average_format' else 'ok' end as error, count(*) as snapshots from movements group by all"),
    "two_topic_decode": """select topic, "offset", case when outcome = 'decoded' then 'evt-' || "offset" end as event_id, case when outcome = 'decoded' then who || '-' || c end as approved_by, outcome from (
 select 'approval' as topic, o_orderkey as "offset", 'user' as who, o_custkey as c, case when o_orderkey % 101 = 0 or o_orderkey % 103 = 0 or o_orderkey % 107 = 0 then 'malformed_message' else 'decoded' end as outcome from orders
 union all select 'outbox_feed', o_orderkey, 'desk', o_custkey, case when o_orderkey % 89 = 0 or o_orderkey % 83 = 0 then 'none' when o_orderkey % 79 = 0 then 'malformed_json' when o_orderkey % 97 = 0 then 'malformed_payload' else 'decoded' end from orders) where outcome <> 'none'""",
    "newest_first": "select 'agg-' || user_id as aggregate_id, cast(event_id as varchar) as sequence_engine_key, cast(row_number() over (partition by user_id order by event_id desc) as integer) as place from events",
    "workflow_outbox": f"""with {_TRIGGERS} select workflow_id as aggregate_id, 'workflow' as aggregate_type, 'NodeTransition' as event_type, sequence_engine_key, '{{"status":"' || case when node = 'final_step' then 'completed' else 'approved' end || '","node":"' || node || '"}}' as payload from wf, unnest(['human_approval', 'final_step']) as u(node) where approved_at is not null""",
    "outbox_of_repeated_approvals": "select 'wf-evt-' || o_orderkey as aggregate_id, cast(2 as bigint) as outbox_rows from orders where o_orderstatus = 'F' and o_orderkey % 5 = 0",
    "trace_stitch": """select trace_id, count(*) as spans, array_to_string(list_sort(list(distinct service)), ',') as services, min(t) as first_at, max(t) as last_at from (
 select md5('order-' || o_orderkey) as trace_id, 'messages' as service, o_orderdate as t from orders union all select md5('order-' || o_orderkey), 'workflows', o_orderdate + interval 1 day from orders where o_orderstatus = 'F'
 union all select md5('order-' || l_orderkey), 'inventory', l_shipdate from lineitem) group by trace_id""",
    "task_order": """with recursive lines as (select l_orderkey as g, l_linenumber as n, max(l_partkey) as p from lineitem group by all),
 near as (select *, lag(n) over k as one, lag(n, 2) over k as two, row_number() over k = 1 as head, max(n) over (partition by g) as tail from lines window k as (partition by g order by n)),
 tasks as (select g, 'n' || n as node, list_transform(list_distinct(list_filter([case when p % 3 <> 0 then one end, case when p % 4 = 0 then two end,
  case when head and g % 10 = 0 then tail end, case when head and g % 17 = 0 then 99 end], lambda x: x is not null)), lambda x: 'n' || x) as needs from near),
 walk(round, g, node, needs, place, level) as (select 0, g, node, needs, cast(null as bigint), cast(null as bigint) from tasks
  union all select round + 1, g, node, needs, case when ready then done + row_number() over (partition by g, ready order by after, node) - 1 else place end, case when ready then round else level end
  from (select *, place is null and len(met) = len(needs) as ready, coalesce(list_max(list_transform(met, lambda x: x.place)), -1) as after
   from (select *, list_filter(placed, lambda x: x.place is not null and list_contains(needs, x.node)) as met
    from (select *, list({'node': node, 'place': place}) over (partition by g) as placed, count(place) over (partition by g) as done from walk where round < (select max(c) from (select count(*) as c from tasks group by g))))))
 select 'g' || g as graph_id, node as node_id, case when not cyclic then place end as position, case when not cyclic then level end as level, cyclic
 from (select *, count(place) over (partition by g) < count(*) over (partition by g) as cyclic from walk where round = (select max(round) from walk))""",
    "intent_parse": "select conv_id, turn, case when k < 4 then k + 1 when k = 4 then 2 else 0 end as intent, case when k <= 4 then 'classified' when k in (5, 6) then 'out_of_range' else 'non_integer' end as outcome from (select *, (conv_id * 31 + turn) % 9 as k from conversations)",
    "error_triage": _codes_sql(),
    "event_latency": with_movements("select mdm_vendor_id, max(epoch_us(published_at) - epoch_us(occurred_at)) as max_us, cast(sum(epoch_us(published_at) - epoch_us(occurred_at)) as bigint) as sum_us from movements group by all"),
    "vendor_scd2": f"""with {MOVEMENTS}, hist as (select mdm_vendor_id, occurred_at, max(location_id) as location_id from movements group by all union all select 'C-' || o_custkey, o_orderdate, max(o_orderstatus) from orders group by all),
 lagged as (select *, lag(location_id) over k as was, row_number() over k as n from hist window k as (partition by mdm_vendor_id order by occurred_at)), kept as (select * from lagged where n = 1 or was is distinct from location_id)
 select mdm_vendor_id, location_id, occurred_at as valid_from, lead(occurred_at) over (partition by mdm_vendor_id order by occurred_at) as valid_to, lead(occurred_at) over (partition by mdm_vendor_id order by occurred_at) is null as current from kept""",
    "date_spine": "select cast(d as date) as day, year(d) as year, month(d) as month, day(d) as day_of_month, quarter(d) as quarter, isodow(d) - 1 as weekday from (select unnest(generate_series(min(cast(o_orderdate as date)), max(cast(o_orderdate as date)), interval 1 day)) as d from orders)",
    "dim_product": with_movements("select sku, max(mdm_vendor_id) as mdm_vendor_id, md5(sku) as surrogate_key from movements group by sku"),
    "dim_location": with_movements("select location_id, min(occurred_at) as first_seen, max(occurred_at) as last_seen, md5(location_id) as surrogate_key from movements group by location_id"),
    "filtered_resume": with_movements("select event_id, mdm_vendor_id, sku, sequence_engine_key from movements where mdm_vendor_id in ('VENDOR-1', 'VENDOR-7') and sequence_engine_key > 200000000000000"),
}

QUERIES = [
    changefeed_decode, changefeed_watermarks, changefeed_dead_letters, changefeed_roundtrip, two_topic_decode, watermark_in_force, newest_first, settlement_split, settlement_figures, projection_merge, live_handoff, replay_range, workflow_states, workflow_transitions,
    approval_dispositions, overdue_approvals, workflow_outbox, outbox_of_repeated_approvals, task_order, uri_screen, sanitize_text, prompt_build, intent_parse, email_contract, email_dispositions, snapshot_contract, error_triage, trace_stitch, event_latency, vendor_scd2, date_spine, dim_product, dim_location, filtered_resume,
]
