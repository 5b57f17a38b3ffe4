"""Vendor messages: the URI screen and the classification job."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lotflow.functions import text
from lotflow.operators import contracts, dlq


def _ipv4(ip: Column) -> Column:
    parts = F.split(ip, r"\.")
    octets = r"(25[0-5]|2[0-4]\d|1?\d?\d)"
    return F.when(ip.rlike(rf"^{octets}(\.{octets}){{3}}\z"), F.expr("0L") + sum((parts.getItem(k).cast("long") * 256 ** (3 - k) for k in range(4)), F.lit(0)))


def _inside(number: Column, base: str, bits: int) -> Column:
    a, b, c, d = map(int, base.split("."))
    low = ((a * 256 + b) * 256 + c) * 256 + d
    return number.between(low, low + 2 ** (32 - bits) - 1)


def _ipv6(ip: Column) -> Column:
    """The eight groups of an IPv6 address as numbers; null for anything else. A zone goes, a dotted tail becomes two groups."""
    plain = F.regexp_replace(F.lower(ip), "%.*$", "")
    tail = F.split(F.regexp_extract(plain, r":(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})$", 1), r"\.")
    part = lambda k: F.try_element_at(tail, F.lit(k)).try_cast("int")
    octets = F.coalesce(part(1).between(0, 255) & part(2).between(0, 255) & part(3).between(0, 255) & part(4).between(0, 255), F.lit(False))
    dotted = F.concat(F.regexp_replace(plain, r"[^:]*$", ""), F.lower(F.hex(part(1) * 256 + part(2))), F.lit(":"), F.lower(F.hex(part(3) * 256 + part(4))))
    text = F.when(octets, dotted).otherwise(plain)
    sides = F.split(text, "::")
    groups = lambda side: F.filter(F.split(F.coalesce(F.try_element_at(sides, F.lit(side)), F.lit("")), ":"), lambda g: g != "")
    missing = 8 - F.size(groups(1)) - F.size(groups(2))
    whole = F.when(F.size(sides) == 1, groups(1)).otherwise(F.concat(groups(1), F.array_repeat(F.lit("0"), missing), groups(2)))
    good = text.rlike(r"^[0-9a-f:]+\z") & ~text.rlike(r":::|^:[^:]|[^:]:\z|[0-9a-f]{5}") & (F.size(sides) <= 2) & F.when(F.size(sides) == 1, missing == 0).otherwise(missing >= 1)
    return F.when(good, F.transform(whole, lambda g: F.conv(g, 16, 10).cast("long")))


def non_public(ip: Column) -> Column:
    """Loopback, private, link-local or unspecified; also what is no address, as nothing is known of it.

    An IPv4 address mapped into IPv6 (``::ffff:``) counts as what it maps.
    """
    six = _ipv6(ip)
    group = lambda k: F.get(six, F.lit(k))
    zeros = lambda n: F.forall(F.slice(six, 1, n), lambda g: g == 0)
    n = F.coalesce(_ipv4(ip), F.when(zeros(5) & (group(5) == 0xFFFF), group(6) * 65536 + group(7)))
    v4 = _inside(n, "127.0.0.0", 8) | _inside(n, "10.0.0.0", 8) | _inside(n, "172.16.0.0", 12) | _inside(n, "192.168.0.0", 16) | _inside(n, "169.254.0.0", 16) | (n == 0)
    v6 = zeros(7) & group(7).isin(0, 1) | group(0).between(0xFC00, 0xFDFF) | group(0).between(0xFE80, 0xFEBF)
    return F.coalesce(F.when(n.isNotNull(), v4).otherwise(v6), F.lit(True))


def screen(uris: DataFrame, allowed: DataFrame, addresses: DataFrame, uri: str = "uri") -> DataFrame:
    """``uris`` with host and ``rejected``: empty, scheme, allowlist, unresolved or non_public, whichever comes first.

    ``allowed(host)`` is exact and lower case; ``addresses(host, ip)`` says what a resolver found; a host literal is its
    own address. Both are joined on the host.
    """
    host = F.lower(F.regexp_replace(F.try_parse_url(F.col(uri), F.lit("HOST")), r"^\[|\]$", ""))
    scheme = F.try_parse_url(F.col(uri), F.lit("PROTOCOL"))
    known = allowed.select(F.lower("host").alias("host"), F.lit(True).alias("_allowed")).distinct()
    found = addresses.groupBy(F.lower("host").alias("host")).agg(F.max(non_public(F.col("ip"))).alias("_inward"))
    literal = F.col("host").rlike(r"^\d{1,3}(\.\d{1,3}){3}\z|:")
    inward = F.when(literal, non_public(F.col("host"))).otherwise(F.col("_inward"))
    rejected = (
        F.when(F.coalesce(F.col(uri), F.lit("")) == "", "empty").when(~scheme.eqNullSafe("https"), "scheme").when(F.col("_allowed").isNull(), "allowlist").when(inward.isNull(), "unresolved").when(inward, "non_public")
    )
    return uris.withColumn("host", host).join(known, "host", "left").join(found, "host", "left").withColumn("rejected", rejected).drop("_allowed", "_inward")


def requests(messages: DataFrame, subject: str = "subject", body: str = "body") -> DataFrame:
    """``messages`` with the cut and sanitised body, and the prompt that a classifier gets as user text."""
    clean = text.sanitize(text.body(F.col(body)))
    return messages.withColumn("clean_body", clean).withColumn("prompt", text.prompt(text.sanitize(F.col(subject)), clean))


def classified(messages: DataFrame, completion: str = "completion") -> tuple[DataFrame, DataFrame]:
    """Rows with a valid intent, staged CLASSIFIED, and those to dead-letter with why."""
    parsed = messages.withColumn("_i", text.intent(F.col(completion)))
    good = parsed.where("_i.reason is null").withColumn("intent", F.col("_i.intent")).withColumn("visualization_stage", F.lit(2)).drop("_i")
    bad = parsed.where("_i.reason is not null").withColumn("reason", F.col("_i.reason")).withColumn("shown", text.truncate(F.trim(F.col(completion)), 64)).drop("_i")
    return good, bad



def received(emails: DataFrame, processed: DataFrame, attempts: str = "attempts", sqlstate: str = "sqlstate") -> DataFrame:
    """``emails`` with ``reason`` and ``disposition``: what becomes of each delivery of a vendor e-mail.

    A broken contract is terminal, whatever came before. A failure of the effect (``sqlstate`` not null) is
    retried while its class is transient and attempts are left. An id that ``processed(event_id)`` has, or that
    an earlier valid delivery brought, is a duplicate.
    """
    checked = contracts.violations(emails, contracts.EMAIL_RULES)
    failed = dlq.triage(checked, sqlstate).join(processed.select("event_id", F.lit(True).alias("_done")).distinct(), "event_id", "left")
    turn = F.expr("row_number() over (partition by event_id, size(errors) = 0 order by offset)")
    reason = F.when(F.size("errors") > 0, F.array_join("errors", ",")).when(F.col(sqlstate).isNotNull(), F.concat(F.lit("sqlstate_"), sqlstate))
    duplicate = (F.size("errors") == 0) & (F.coalesce("_done", F.lit(False)) | (turn > 1))
    transient = (F.size("errors") == 0) & (F.col("error_class") == "transient")
    return failed.withColumn("reason", reason).withColumn("disposition", contracts.disposition(duplicate, F.col("reason"), transient, F.col(attempts))).drop("_done", "error_class", "errors")
