"""Dead letters: what is sent, and its triage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: SQLSTATE codes by what a retry can do about them.
TRANSIENT = ("40001", "40003", "08000", "08001", "08003", "08004", "08006", "08007", "57P01", "57P03", "55P03")
TERMINAL = ("23505", "23502", "23503", "23514", "22P02", "22003", "42804", "42P01", "42703", "42601", "0A000")


def dead_letters(records: DataFrame, reason: str = "reason", reason_header: str = "error_reason", source_header: str | None = "source_topic") -> DataFrame:
    """``records(topic, key, value, headers, reason)`` for their dead-letter topics: the original key and value, and headers with why and whence."""
    extra = [(reason_header, F.col(reason))] + ([(source_header, F.col("topic"))] if source_header else [])
    added = F.array(*[F.struct(F.lit(k).alias("key"), F.encode(v, "UTF-8").alias("value")) for k, v in extra])
    headers = F.concat(F.coalesce("headers", F.array().cast("array<struct<key:string,value:binary>>")), added)
    return records.select(F.concat("topic", F.lit(".dlq")).alias("topic"), "key", "value", headers.alias("headers"))


def triage(df: DataFrame, code: str = "sqlstate") -> DataFrame:
    """``error_class``: transient, terminal or unknown; connection and operator classes are transient as a whole."""
    c = F.col(code)
    known = F.when(c.isin(*TRANSIENT), "transient").when(c.isin(*TERMINAL), "terminal")
    return df.withColumn("error_class", F.coalesce(known, F.when((F.length(c) == 5) & F.substring(c, 1, 2).isin("08", "57"), "transient"), F.lit("unknown")))

