"""Running sums and last known values over keys of any length: a scan in segments.

Bounds on the order column cut the rows into segments of like size, whatever their keys. Each (key, segment) is scanned
on its own, so no task holds a hot key. What each segment comes to is one row of a small table, whose running totals are
what the segments before carry into one; they are joined back on the key and the segment, for which the scanned rows are
dealt already. The rows are shuffled once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_FINE = 16


def _shuffle_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def bounds(df: DataFrame, order: str, segments: int) -> list:
    """At most ``segments - 1`` values of ``order`` that cut all rows into parts of like size; any bounds give right results."""
    if segments < 2:
        return []
    shares = [k / segments for k in range(1, segments)]
    return sorted(set(df.agg(F.percentile_approx(order, shares, 10_000).alias("b")).first().b or []))


def segment_of(order: str, cuts: list) -> Column:
    """How many of ``cuts`` a value reaches, looked up in two steps; a null order comes first, as it sorts."""
    coarse, x = cuts[::_FINE], F.col(order)
    at_most = lambda array: F.size(F.filter(array, lambda b: b <= x))
    if not cuts:
        return F.lit(0)
    fine = F.array(*[F.array(*[F.lit(b) for b in cuts[k + 1 : k + _FINE]] or [F.lit(None)]) for k in range(0, len(cuts), _FINE)])
    step = at_most(F.array(*[F.lit(b) for b in coarse]))
    return F.when(x.isNull() | (x < F.lit(cuts[0])), 0).otherwise((step - 1) * _FINE + 1 + at_most(F.get(fine, step - 1)))


def running(df: DataFrame, keys: list[str], order: list[str], sums: dict[str, str] | None = None, lasts: dict[str, str] | None = None, segments: int | None = None) -> DataFrame:
    """``df`` with ``sums`` (name -> expression) up to each row and ``lasts``, the last values so far that are not null.

    Rows are taken in ascending ``order`` by ``keys``; null keys are a key. Rows of one key that share all of ``order``
    come in any order, as in a window. ``segments`` is by default the number of shuffle partitions. The rows are read
    three times (for bounds, totals and the scan), so a costly input is better cut first.
    """
    sums, lasts = sums or {}, lasts or {}
    cuts = bounds(df, order[0], segments or _shuffle_partitions(df))
    marked = df.withColumn("_key", F.struct(*keys)).withColumn("_segment", segment_of(order[0], cuts))
    here = f"partition by _key, _segment order by {', '.join(order)} rows unbounded preceding"
    scanned = marked.withColumns({**{f"_s{k}": F.expr(f"sum({c}) over ({here})") for k, c in enumerate(sums.values())}, **{f"_l{k}": F.expr(f"last({c}, true) over ({here})") for k, c in enumerate(lasts.values())}})
    at = F.struct(*order)
    whole = [F.sum(F.expr(c)).alias(f"_ts{k}") for k, c in enumerate(sums.values())] + [F.max_by(F.struct(F.expr(c).alias("v")), F.when(F.expr(c).isNotNull(), at)).alias(f"_tl{k}") for k, c in enumerate(lasts.values())]
    totals = marked.groupBy("_key", "_segment").agg(*whole, F.lit(True).alias("_any"))
    before = "partition by _key order by _segment rows between unbounded preceding and 1 preceding"
    carried = totals.select("_key", "_segment", *[F.expr(f"sum(_ts{k}) over ({before}) as _cs{k}") for k in range(len(sums))], *[F.expr(f"last(_tl{k}, true) over ({before}) as _cl{k}") for k in range(len(lasts))])
    both = scanned.join(carried, ["_key", "_segment"], "left")
    out = {name: F.expr(f"coalesce(_cs{k} + _s{k}, _s{k}, _cs{k})") for k, name in enumerate(sums)} | {name: F.coalesce(f"_l{k}", F.col(f"_cl{k}.v")) for k, name in enumerate(lasts)}
    kept = [F.col(c) for c in df.columns if c not in out]
    return both.select(*kept, *[c.alias(name) for name, c in out.items()])
