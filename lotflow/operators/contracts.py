"""Contract validation: rules are column expressions, and both halves come back.

Patterns end at the very end of a text: a line break after a good value breaks the rule. A number with more decimals
than storage holds is refused rather than rounded.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns and bounds that the wire contract states.
UUID = r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z"
TRACE_PARENT = r"^00-[0-9a-f]{32}-[0-9a-f]{16}-[0-9a-f]{2}\z"
QUANTITY = r"^-?[0-9]+(\.[0-9]+)?\z"
UNIT_COST = r"^[0-9]+(\.[0-9]+)?\z"
MAX_SEQUENCE = 2**63 - 1
#: What storage holds of a quantity or cost: four decimals, and noughts after them.
EXACT = r"^-?[0-9]+(\.[0-9]{1,4}0*)?\z"


def _matches(name: str, pattern: str) -> str:
    return f"coalesce({name} rlike r'{pattern}', false)"


def _filled(name: str) -> str:
    return f"coalesce(length({name}) >= 1, false)"


def _number(name: str, pattern: str) -> str:
    return f"{_matches(name, pattern)} and try_cast({name} as decimal(18,4)) is not null"


def _exact(name: str, pattern: str) -> str:
    return f"not ({_number(name, pattern)}) or {_matches(name, EXACT)}"


def _between(name: str, low: int, high: int) -> str:
    return f"coalesce({name} between {low} and {high}, false)"


#: A 64-bit key from text: exact, and null beyond what storage takes.
SEQUENCE = f"case when try_cast(sequence_engine_key as decimal(20,0)) between 0 and {MAX_SEQUENCE} then try_cast(sequence_engine_key as bigint) end"

#: Rule name -> SQL that holds for a good row.
MOVEMENT_RULES = {
    "event_id_uuid": _matches("event_id", UUID),
    "trace_parent_format": _matches("trace_parent", TRACE_PARENT),
    "aggregate_id_empty": _filled("aggregate_id"),
    "sku_empty": _filled("sku"),
    "vendor_empty": _filled("mdm_vendor_id"),
    "location_empty": _filled("location_id"),
    "occurred_at_missing": "occurred_at is not null",
    "published_at_missing": "published_at is not null",
    "movement_type_undefined": _between("movement_type", 0, 3),
    "quantity_format": _number("quantity", QUANTITY),
    "unit_cost_format": _number("unit_cost", UNIT_COST),
    "sequence_out_of_range": f"({SEQUENCE}) is not null",
    "quantity_too_fine": _exact("quantity", QUANTITY),
    "unit_cost_too_fine": _exact("unit_cost", UNIT_COST),
}

_URI = "^[A-Za-z][A-Za-z0-9+.-]*:.+"
EMAIL_RULES = {
    **{k: MOVEMENT_RULES[k] for k in ("event_id_uuid", "trace_parent_format", "aggregate_id_empty", "vendor_empty", "occurred_at_missing", "published_at_missing", "sequence_out_of_range")},
    "vendor_email_format": _matches("vendor_email", r"^[^@\s]+@[^@\s]+\.[^@\s]+\z"),
    "subject_uri_format": _matches("secure_subject_uri", _URI),
    "body_uri_format": _matches("secure_body_uri", _URI),
    "attachments_too_many": "attachments is null or size(attachments) <= 25",
    "stage_undefined": _between("visualization_stage", 0, 3),
    "intent_undefined": _between("intent_classification", 0, 4),
}

SNAPSHOT_RULES = {
    "snapshot_id_uuid": _matches("snapshot_id", UUID),
    "quantity_format": _matches("qty_on_hand", QUANTITY),
    "value_format": _matches("fifo_total_value", UNIT_COST),
    "average_format": _matches("moving_avg_cost", UNIT_COST),
}


def violations(df: DataFrame, rules: dict[str, str]) -> DataFrame:
    """``df`` with ``errors``: the names of the broken rules, in the order of the rules."""
    return df.withColumn("errors", F.array_compact(F.array(*[F.when(~F.expr(rule), F.lit(name)) for name, rule in rules.items()])))


def holds(rules: dict[str, str]) -> Column:
    """Whether a row breaks none of the rules: one flag, for rows that are to be shuffled before bad ones may go.

    Where two rules are about one number, the second repeats the first; here each pattern is met once.
    """
    wanted = dict(rules)
    for name, pattern in (("quantity", QUANTITY), ("unit_cost", UNIT_COST)):
        if (rules.get(f"{name}_format"), rules.get(f"{name}_too_fine")) == (_number(name, pattern), _exact(name, pattern)):
            wanted[f"{name}_format"] = _number(name, EXACT if pattern == QUANTITY else EXACT.replace("-?", ""))
            del wanted[f"{name}_too_fine"]
    return F.expr(" and ".join(f"({rule})" for rule in wanted.values()))


def split_valid(df: DataFrame, rules: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with their ``errors``; a bad row is never an exception."""
    checked = violations(df, rules)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def typed_movements(df: DataFrame) -> DataFrame:
    """Validated movements with exact types."""
    return df.withColumns({"sequence_engine_key": F.expr(SEQUENCE), "quantity": F.expr("try_cast(quantity as decimal(18,4))"), "unit_cost": F.expr("try_cast(unit_cost as decimal(18,4))")})


def disposition(duplicate: Column, reason: Column, transient: Column, attempts: Column, most: int = 5) -> Column:
    """ok, duplicate, terminal, retry or exhausted; an unclassified failure is terminal."""
    return (
        F.when(duplicate, "duplicate").when(reason.isNull(), "ok").when(transient & (attempts < most), "retry").when(transient, "transient_exhausted").otherwise("terminal")
    )
