"""Approximate nearest neighbours by collision counting over sorted projections.

Vectors are dealt into shards of about ``shard_rows`` by ranges of their first principal axis (of ``fit_rows`` rows
chosen by a hash of the id, which also say how far from a query along that axis its neighbours lie; every row is
dealt). A range that one value fills is dealt on by a hash. A query goes to the shards that its window along the axis
meets and to no other; how many that are depends on how much structure the vectors have.

A shard is indexed once, by ``lines`` single random projections, each a sorted array, and its queries stream past it.
A query's windows on all lines widen by the factor ``grow`` until enough vectors lie inside the windows of at least
``share`` of the lines (virtual rehashing: the same arrays serve every radius); these are verified with their exact
inner product. Enough is ``verify`` of the shard and 20 k more. The windows of a query begin where those of the query
before it ended. Places on the lines are kept to a 256th, windows are rounded outwards.

For the largest inner product, vectors of the shard are lengthened by one component to equal norm, so that the largest
inner product is the smallest distance. Every vector is indexed; none is sampled or capped.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.arrow import only
from lotflow.runtime import cut

_DEALT = "shard int, kind int, id long, width int, vector binary"
_FOUND = "query_id long, vec_id long, score double"
_OWN, _ASKING = 0, 1
_STEPS = 64


@dataclass
class Axis:
    """How vectors of one length are dealt: by ranges of a projection, with the window of a query on it."""

    direction: np.ndarray
    bounds: np.ndarray
    slope: float
    low: float
    high: float
    first: int

    @staticmethod
    def fit(sample: np.ndarray, shards: int, first: int, near: int = 3) -> Axis:
        direction = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))[1][:, -1]
        at, asking = sample @ direction, sample[:512] / np.linalg.norm(sample[:512], axis=1)[:, None]
        score = asking @ sample.T
        score[np.arange(len(asking)), np.arange(len(asking))] = -np.inf
        best = np.argsort(-score, axis=1)[:, : max(1, min(near, len(sample) - 1))]
        mine, theirs = np.repeat(asking @ direction, best.shape[1]), at[best].ravel()
        slope = float(np.polyfit(mine, theirs, 1)[0]) if len(mine) > 2 and np.ptp(mine) > 0 else 0.0
        low, high = np.quantile(theirs - slope * mine, [0.0005, 0.9995])
        room = 0.1 * (high - low) + 1e-9
        return Axis(direction, np.quantile(at, np.arange(1, shards) / shards), slope, low - room, high + room, first)

    def shards_of(self, ids: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        at = vectors @ self.direction
        left, right = np.searchsorted(self.bounds, at, "left"), np.searchsorted(self.bounds, at, "right")
        return self.first + left + (ids * 2654435761 >> 7) % (right - left + 1)

    def asked(self, vector: np.ndarray) -> range:
        at = self.slope * float(vector @ self.direction) / float(np.linalg.norm(vector))
        ends = np.searchsorted(self.bounds, at + self.low, "left"), np.searchsorted(self.bounds, at + self.high, "right")
        return range(self.first + int(ends[0]), self.first + int(ends[1]) + 1)


def _carry_save(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bits."""
    odd = x ^ y
    total = odd ^ z
    odd &= z
    odd |= x & y
    return total, odd


def _parts(plane: np.ndarray, parts: int) -> np.ndarray:
    """The rows of a plane in equal parts, with zero rows at the end where needed."""
    rows = -len(plane) % parts
    if rows:
        plane = np.concatenate([plane, np.zeros((rows, plane.shape[1]), plane.dtype)])
    return plane.reshape(parts, -1, plane.shape[1])


def _add_up(sets: np.ndarray) -> list[np.ndarray]:
    """Bit planes, lowest first, of how many of ``sets`` each bit is in: by sevens into three planes, then in pairs."""
    seven = _parts(sets, 7)
    (a, b), (c, d) = _carry_save(*seven[:3]), _carry_save(*seven[3:6])
    low, e = _carry_save(a, c, seven[6])
    planes = [low, *_carry_save(b, d, e)]
    while len(planes[0]) > 1:
        total, carry = [], None
        for x, y in (_parts(p, 2) for p in planes):
            digit, carry = (x ^ y, x & y) if carry is None else _carry_save(x, y, carry)
            total.append(digit)
        planes = [*total, carry]
    return [p[0] for p in planes]


def _at_least(planes: list[np.ndarray], need: int) -> np.ndarray:
    """The bits whose number in ``planes`` is ``need`` or more."""
    if need >> len(planes):
        return np.zeros_like(planes[0])
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], ~np.uint64(0))
    for k in reversed(range(len(planes))):
        if need >> k & 1:
            same &= planes[k]
        else:
            more |= same & planes[k]
            same &= ~planes[k]
    return more | same


class CollisionIndex:
    """Sorted projections of one shard, each cut into steps of equally many vectors.

    ``upto[line, s]`` is the set, as bits, of the vectors in the steps before ``s``: a window is the difference of two
    such sets. How many windows each vector lies in is counted for 64 vectors at a time, by adding the sets as bit planes.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, lines: int, seed: int):
        self.ids, self.vectors, self.verified = ids, vectors, 0
        n, length = len(ids), np.linalg.norm(vectors, axis=1)
        longest = float(length.max())
        flat = np.c_[vectors / longest, np.sqrt(np.maximum(0, 1 - (length / longest) ** 2))]
        self.directions = np.random.default_rng(seed).standard_normal((flat.shape[1], lines))
        places = (flat @ self.directions).T
        steps = min(_STEPS, n)
        step_of, starts = np.arange(n) * steps // n, -(-np.arange(steps) * n // steps)
        self.edges, self.last = np.empty((lines, steps)), float(places.max())
        self.upto = np.zeros((lines, steps + 1, -(-n // 64)), dtype=np.uint64)
        inside = np.empty((steps, n), dtype=bool)
        for line, at in enumerate(places):
            order = np.argsort(at, kind="stable")
            self.edges[line] = at[order[starts]]
            inside[:] = False
            inside[step_of, order] = True
            bits = np.packbits(inside, axis=1, bitorder="little")
            self.upto[line, 1:].view(np.uint8)[:, : bits.shape[1]] = np.bitwise_or.accumulate(bits, axis=0)
        self.half = 0.8

    def _inside(self, at: np.ndarray, half: float, need: int) -> np.ndarray:
        """The vectors, as bits, that lie in the windows of ``need`` lines or more; windows are rounded outwards."""
        line = np.arange(len(at))
        first = np.maximum((self.edges < (at - half)[:, None]).sum(axis=1) - 1, 0)
        end = (self.edges <= (at + half)[:, None]).sum(axis=1)
        return _at_least(_add_up(self.upto[line, end] ^ self.upto[line, first]), need)

    def _best(self, found: np.ndarray, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Exact inner products of the verified vectors; the k largest, ties to the smaller id."""
        self.verified += len(found)
        near = self.vectors[found] @ query
        if len(found) > k:
            found = found[near >= np.partition(near, -k)[-k] - 1e-9 * (1 + np.abs(near).max())]
        score = (self.vectors[found] * query).sum(axis=1)
        best = np.lexsort((self.ids[found], -score))[:k]
        return self.ids[found[best]], score[best]

    def search(self, query_id: int, query: np.ndarray, k: int, share: float, verify: float, grow: float) -> tuple[np.ndarray, np.ndarray]:
        n, own = len(self.ids), int(np.searchsorted(self.ids, query_id))
        own = own if own < n and self.ids[own] == query_id else n
        at = query / np.linalg.norm(query) @ self.directions[:-1]
        need, enough = max(1, int(np.ceil(share * len(at)))), min(n - 1, 20 * k + int(np.ceil(verify * n)))
        widest, half = float(self.last - self.edges[:, 0].min() + np.abs(at).max()), self.half
        while half <= widest:
            bits = self._inside(at, half, need)
            count = int(np.bitwise_count(bits).sum())
            if count > enough:  # the query itself may be among them
                break
            half *= grow
        if half > widest:
            found, self.half = np.arange(n), half / grow
        else:
            found = np.flatnonzero(np.unpackbits(bits.view(np.uint8), count=n, bitorder="little"))
            self.half = half / grow if count > 1.5 * enough else half
        return self._best(found[found != own], query, k)


def _floats(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), dtype=np.float64)


def nearest(
    vectors: DataFrame, k: int = 20, query_every: int = 20, shard_rows: int = 16384, fit_rows: int = 4096,
    lines: int = 161, share: float = 0.75, verify: float = 0.015, grow: float = 1.03, seed: int = 7,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` largest inner products found for each query, in double precision.

    ``vectors(vec_id, embedding)``. Queries are rows whose id is divisible by ``query_every``; candidates are all rows
    but the query's own. Rows with a null id, and vectors that are null, empty, zero or hold null or non-finite
    components, take no part. Vectors of another length than the query's are no candidates for it. Of rows that repeat
    an id, the smallest vector counts. Ties go to the smaller id. Other columns are ignored; an empty table gives an
    empty result.
    """
    good = F.expr("vec_id is not null and embedding is not null and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)")
    rows = cut(only(vectors, "vec_id", "embedding").where(good).groupBy("vec_id").agg(F.min("embedding").alias("embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    n = rows.count()
    sample: dict[int, list] = {}
    for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(fit_rows).collect():
        sample.setdefault(len(r.embedding), []).append(r.embedding)
    axes, first, seen = {}, 1, sum(map(len, sample.values()))
    for width, some in sorted(sample.items()):
        if len(some) > 1:
            shards = max(1, -(-n * len(some) // (seen * shard_rows)))
            axes[width], first = Axis.fit(np.array(some, dtype=np.float64), shards, first), first + shards

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lists = batch.column("vec_id").to_numpy(), batch.column("embedding").to_pylist()
            widths = np.array([len(v) for v in lists])
            for width in np.unique(widths).tolist():
                mine = np.flatnonzero(widths == width)
                own, data = ids[mine].astype(np.int64), np.array([lists[i] for i in mine], dtype=np.float64)
                axis = axes.get(width)  # lengths too rare for the sample share one shard
                shard = axis.shards_of(own, data).tolist() if axis else [0] * len(own)
                out = [(s, _OWN, i, v) for s, i, v in zip(shard, own.tolist(), data)]
                out += [(s, _ASKING, i, v) for i, v in zip(own.tolist(), data) if i % query_every == 0 for s in (axis.asked(v) if axis else [0])]
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64()), pa.array([width] * len(out), pa.int32()), pa.array([v.tobytes() for v in columns[3]], pa.binary())],
                    names=["shard", "kind", "id", "width", "vector"],
                )

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by shard and length, a shard's own before its queries."""
        here, ids, data, index = None, [], [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.array([batch.column(c).to_numpy() for c in ("shard", "width", "kind")]).T
            starts = np.r_[0, np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, batch.num_rows]
            for a, b in zip(starts.tolist(), starts[1:].tolist()):
                part, (shard, width, kind) = batch.slice(a, b - a), place[a].tolist()
                if here != (shard, width):
                    here, ids, data, index = (shard, width), [], [], None
                own, values = part.column("id").to_numpy(), _floats(part, "vector").reshape(-1, width)
                if kind == _OWN:
                    ids.append(own)
                    data.append(values)
                    continue
                if index is None and ids:
                    index = CollisionIndex(np.concatenate(ids), np.concatenate(data), lines, seed)
                if index is not None:
                    found = [(q, *index.search(q, v, k, share, verify, grow)) for q, v in zip(own.tolist(), values)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate([np.full(len(i), q) for q, i, _ in found]), pa.int64()), pa.array(np.concatenate([i for _, i, _ in found]), pa.int64()), pa.array(np.concatenate([s for *_, s in found]), pa.float64())],
                        names=["query_id", "vec_id", "score"],
                    )

    dealt = rows.mapInArrow(deal, _DEALT).repartition("shard", "width").sortWithinPartitions("shard", "width", "kind", "id")
    rank = F.expr("row_number() over (partition by query_id order by score desc, vec_id)")
    return dealt.mapInArrow(search, _FOUND).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
