"""Change-feed envelopes: decoding rows, watermarks and tombstones, and writing them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _once(df: DataFrame, *columns: Column) -> DataFrame:
    """``df`` with further columns, each computed once a row: a filter on them is not pushed below to compute them again."""
    return df.select("*", F.inline(F.array(F.struct(*columns))))


def decode(records: DataFrame, on_error: str = "drop", resolved: str = "present") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, watermarks, dead letters) of ``records(topic, value, ...)``.

    ``rows`` has ``after`` as VARIANT, which keeps long integers exact. ``resolved``: 'present' takes any line that has
    the key for a watermark, 'non_null' only one with a value. ``on_error``: malformed lines, and those that repeat a key,
    are dropped, or with 'dlq' come back with their original value.
    """
    if on_error not in ("drop", "dlq") or resolved not in ("present", "non_null"):
        raise ValueError("on_error is drop or dlq; resolved is present or non_null")
    is_mark = F.expr("coalesce(array_contains(json_object_keys(value), 'resolved'), false)")
    if resolved == "non_null":
        is_mark = F.expr("variant_get(doc, '$.resolved') is not null and not is_variant_null(variant_get(doc, '$.resolved'))")
    parsed = _once(records, F.try_parse_json("value").alias("doc"))
    good = _once(parsed.where("doc is not null"), is_mark.alias("is_mark"), F.expr("try_variant_get(doc, '$.after', 'variant')").alias("after"))
    rows = good.where("not is_mark and after is not null and schema_of_variant(after) like 'OBJECT%'").drop("doc", "is_mark")
    marks = good.where("is_mark").withColumn("watermark", watermark(F.expr("try_variant_get(doc, '$.resolved', 'string')"))).drop("doc", "is_mark", "after")
    dead = parsed.where("doc is null").drop("doc").withColumn("reason", F.lit("malformed_json"))
    return rows, marks, dead if on_error == "dlq" else dead.limit(0)


def watermark(text: Column) -> Column:
    """The whole part of a possibly fractional clock text."""
    return F.split_part(text, F.lit("."), F.lit(1)).try_cast("decimal(20,0)")


def text_of(field: str) -> Column:
    """Strings and numbers as text, with every digit that the line has; anything else, and a missing field, as the empty text.

    Whole numbers of 64 bits are exact in the parsed row. Of any other number the row keeps a value, not how it is
    written; so its digits are those that follow the field's name in ``value`` and have that value.
    """
    written = rf"regexp_extract_all(value, r'\"\Q{field}\E\"\s*:\s*(-?[0-9]+(?:[.][0-9]+)?(?:[eE][+-]?[0-9]+)?)', 1)"
    return F.expr(
        f"transform(array(variant_get(after, '$.{field}')), v -> case when schema_of_variant(v) in ('STRING', 'BIGINT') then coalesce(try_variant_get(v, '$', 'string'), '')"
        f" when schema_of_variant(v) rlike '^(DECIMAL|DOUBLE|FLOAT)' then coalesce(get(filter({written}, t -> try_cast(t as double) = try_variant_get(v, '$', 'double')), 0), '') else '' end)[0]"
    )


def time_of(field: str) -> Column:
    """A date and time with an offset, as RFC 3339 writes them; null for anything else."""
    pattern = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}([.][0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})\z"
    return F.expr(f"transform(array(try_variant_get(after, '$.{field}', 'string')), t -> case when t rlike r'{pattern}' then try_to_timestamp(t) end)[0]")


def number_of(field: str) -> Column:
    """Numbers as double; anything else, and a missing field, as zero."""
    v = f"variant_get(after, '$.{field}')"
    return F.expr(f"case when schema_of_variant({v}) in ('BIGINT', 'DOUBLE', 'FLOAT') or schema_of_variant({v}) like 'DECIMAL%' then coalesce(try_variant_get(after, '$.{field}', 'double'), 0D) else 0D end")


def bytes_of(text: Column) -> Column:
    """Hex behind ``\\x``, else base64; null if it is neither."""
    return F.when(text.startswith("\\x"), F.try_to_binary(F.substring(text, 3, 1 << 30), F.lit("hex"))).otherwise(F.try_to_binary(text, F.lit("base64")))


def two_topics(records: DataFrame, raw_topic: str, feed_topic: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(messages, dead letters) of ``records(topic, value, ...)`` whose two topics differ in form.

    ``raw_topic`` carries the message itself; ``feed_topic`` a change-feed envelope whose ``payload`` is the message as
    hex or base64. Watermarks and tombstones go, as do other topics. What cannot be decoded, or is no JSON object, comes
    back with its reason and its original value. Messages are JSON with the columns of ``schema``.
    """
    raw = records.where(F.col("topic") == raw_topic).withColumn("_text", F.col("value"))
    rows, _, broken = decode(records.where(F.col("topic") == feed_topic), on_error="dlq", resolved="non_null")
    fed = rows.withColumn("_text", F.try_validate_utf8(bytes_of(text_of("payload")).cast("string"))).drop("after")
    both = raw.unionByName(fed).withColumn("message", F.when(F.expr("schema_of_variant(try_parse_json(_text)) like 'OBJECT%'"), F.from_json("_text", schema)))
    good = both.where("message is not null").drop("_text")
    dead = both.where("message is null").drop("_text", "message").withColumn("reason", F.when(F.col("topic") == raw_topic, "malformed_message").otherwise("malformed_payload"))
    return good, dead.unionByName(broken)


def projections(rows: DataFrame, movement_topics: tuple[str, ...] = ("fact_inventory_movement", "fact_inventory_snapshot"), workflow_topics: tuple[str, ...] = ("orchestrator_outbox",), compat: bool = False) -> DataFrame:
    """Decoded rows as events of the live page; other topics and rows without a sequence key go.

    Movement facts become RECEIVED with their value; outbox rows PO_CREATED with their type as status. Snapshot rows
    have no event id: they go too, unless ``compat`` keeps them with an empty one.
    """
    movement = F.col("topic").isin(*movement_topics)
    fields = [
        F.when(movement & text_of("aggregate_id").eqNullSafe(""), text_of("event_id")).otherwise(text_of("aggregate_id")).alias("aggregate_id"),
        F.when(movement, "RECEIVED").otherwise("PO_CREATED").alias("stage"),
        F.when(movement, F.lit("SUCCESS")).otherwise(text_of("event_type")).alias("status"),
        text_of("sequence_engine_key").alias("sequence_engine_key"),
        time_of("occurred_at").alias("occurred_at"),
        text_of("trace_parent").alias("trace_parent"),
        F.when(movement, number_of("fifo_total_value")).otherwise(0.0).alias("value"),
    ]
    out = rows.where(movement | F.col("topic").isin(*workflow_topics)).select(F.inline(F.array(F.struct(*fields))))
    out = out.where(F.length("sequence_engine_key") > 0)
    return out if compat else out.where("aggregate_id <> ''")


def encode(df: DataFrame, topic: str, updated: str, resolved: DataFrame | None = None) -> DataFrame:
    """(topic, value): one envelope a row, and one watermark: the one row of ``resolved(m)``, or the newest ``updated``.

    The newest of a whole table holds; of a batch of a stream it is no promise, and ``resolved`` has to be given.
    """
    row = F.to_json(F.struct(F.struct(*df.columns).alias("after"), F.col(updated).cast("string").alias("updated"), F.col(updated).cast("string").alias("mvcc_timestamp")))
    mark = (df.agg(F.max(updated).alias("m")) if resolved is None else resolved).where("m is not null").select(F.to_json(F.struct(F.col("m").cast("string").alias("resolved"))).alias("value"))
    return df.select(F.lit(topic).alias("topic"), row.alias("value")).unionByName(mark.select(F.lit(topic).alias("topic"), "value"))
