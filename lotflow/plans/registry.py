"""All registered queries of the ledger and workflow operators, with their SQL twins."""

from __future__ import annotations

from lotflow.plans import events, ledger

_FAMILIES = (ledger, events)


def queries() -> dict:
    return {f.__name__: f for family in _FAMILIES for f in family.QUERIES}


def oracle_sql() -> dict:
    return {k: v for family in _FAMILIES for k, v in family.ORACLE.items()}
