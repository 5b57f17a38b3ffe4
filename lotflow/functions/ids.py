"""Ids as few bytes, for rows that are shuffled and sorted by them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SMALL = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
_UUID = "^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$"
_NO_UUID = "repeat('0', 32)"


def packed(name: str) -> Column:
    """An id as binary: 16 bytes for a UUID in small letters, longer for all else; two ids are equal if their bytes are.

    Bytes of UUIDs sort as their texts do. Capitals come between digits and small letters, so a UUID that has some is put
    behind the last one in small letters that sorts before it, with its text after that. What is no UUID follows 16 noughts.
    """
    bare = f"replace({name}, '-', '')"
    below = f"rpad(concat(regexp_extract({bare}, '^[0-9a-f]*', 0), '9'), 32, 'f')"
    capital = f"concat(unhex({below}), encode({name}, 'UTF-8'))"
    other = f"concat(unhex({_NO_UUID}), encode(concat('.', {name}), 'UTF-8'))"
    uuid = f"length({name}) = 36 and {name} rlike '{_UUID}'"
    return F.expr(f"case when {name} rlike r'{_SMALL}' then unhex({bare}) when {uuid} then {capital} when {name} is not null then {other} end")


def unpacked(name: str) -> Column:
    """The text that ``packed`` was made of."""
    text = ", ".join(f"hex(substring({name}, {at}, {n}))" for at, n in ((1, 4), (5, 2), (7, 2), (9, 2), (11, 6)))
    rest = f"decode(substring({name}, if(substring({name}, 1, 16) = unhex({_NO_UUID}), 18, 17)), 'UTF-8')"
    return F.expr(f"if(length({name}) = 16, lower(concat_ws('-', {text})), {rest})")
