"""Bounded samples of labelled rows that stay small on the way."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANGE = 1 << 30


def class_counts(rows: DataFrame, by: str, classes: int = 10_000) -> list[tuple]:
    """(value, rows) of every value of ``by``; an error if there are more than ``classes``, as none may be left out."""
    counts = [tuple(r) for r in rows.groupBy(by).count().limit(classes + 1).collect()]
    if len(counts) > classes:
        raise ValueError(f"more than {classes} values of {by}")
    return counts


def hashed_sample(rows: DataFrame, by: str, per_class: int, keys: tuple[str, ...], salt: str, counts: list[tuple] | None = None) -> DataFrame:
    """At most ``per_class`` rows of each value of ``by``, chosen by a hash of ``keys``; ``counts`` are its ``class_counts``.

    Rows outside a hash range that holds about twice as many as are wanted go before anything is shuffled, so what the
    ranking sees does not grow with the table.
    """
    counts = class_counts(rows, by) if counts is None else counts
    if not counts:
        return rows.limit(0).withColumn("place", F.lit(0))
    share = F.create_map(*[x for value, n in counts for x in (F.lit(value), F.lit(min(_RANGE, 64 + _RANGE * (2 * per_class + 100) // n)))])
    hashed = F.xxhash64(F.lit(salt), *keys)
    near = rows.where(F.pmod(hashed, F.lit(_RANGE)) < F.element_at(share, F.col(by)))
    place = F.row_number().over(Window.partitionBy(by).orderBy(hashed, *keys))
    return near.withColumn("place", place).where(F.col("place") <= per_class)


def slice_of(text: str, chars: int) -> Column:
    """A text, or of a longer one ``chars`` characters from a place chosen by its hash."""
    return F.expr(f"case when length({text}) <= {chars} then {text} else substring({text}, 1 + cast(pmod(xxhash64({text}), length({text}) - {chars} + 1) as int), {chars}) end")
