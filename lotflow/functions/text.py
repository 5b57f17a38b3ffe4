"""Text columns of vendor messages: screening, sanitising, prompts, classifier output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Chat-control tokens that are removed, in one pass.
CONTROL_TOKENS = ("<|endoftext|>", "<|im_start|>", "<|im_end|>", "<system>", "</system>")
BODY_BYTES = 32 * 1024


def sanitize(text: Column) -> Column:
    return F.regexp_replace(text, "|".join(t.replace("|", r"\|") for t in CONTROL_TOKENS), "")


def first_bytes(text: Column, n: int) -> Column:
    """At most ``n`` bytes of the text, in whole characters: one that the cut would split goes."""
    raw = F.encode(text, "UTF-8")
    inner = lambda k: F.substring(raw, k, 1).between(F.lit(b"\x80"), F.lit(b"\xbf"))
    kept = F.when(~inner(n + 1), n).when(~inner(n), n - 1).when(~inner(n - 1), n - 2).otherwise(n - 3)
    return F.when(F.octet_length(text) <= n, text).otherwise(F.decode(F.substring(raw, F.lit(1), kept), "UTF-8"))


def body(text: Column) -> Column:
    return first_bytes(text, BODY_BYTES)


def truncate(text: Column, n: int) -> Column:
    """At most ``n`` bytes, with an ellipsis if something was cut off."""
    return F.when(F.octet_length(text) <= n, text).otherwise(F.concat(first_bytes(text, n) if n else F.lit(""), F.lit("…")))


def prompt(subject: Column, text: Column) -> Column:
    return F.concat(F.lit("Subject: "), subject, F.lit("\nBody: "), text)


def intent(completion: Column) -> Column:
    """struct(intent, reason): a strict whole number from 1 to 4, white space of any script around it, else 0 with why not."""
    plain = F.regexp_replace(completion, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+\z", "")
    number = F.when(plain.rlike(r"^[+-]?[0-9]+\z"), plain.try_cast("int"))
    return F.struct(
        F.when(number.between(1, 4), number).otherwise(0).alias("intent"),
        F.when(number.isNull(), "non_integer").when(~number.between(1, 4), "out_of_range").alias("reason"),
    )


def trace(parent: Column) -> Column:
    """struct(version, trace_id, span_id, flags)."""
    part = lambda k: F.split_part(parent, F.lit("-"), F.lit(k))
    return F.struct(part(1).alias("version"), part(2).alias("trace_id"), part(3).alias("span_id"), part(4).alias("flags"))


def latency_us(emitted: Column, occurred: Column) -> Column:
    return F.unix_micros(emitted.cast("timestamp")) - F.unix_micros(occurred.cast("timestamp"))
