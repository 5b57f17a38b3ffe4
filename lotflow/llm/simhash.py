"""SimHash near-duplicates by bit-sliced comparison.

1. Fingerprints: 64-bit SimHash of 3-word shingles over the whole text.
2. Candidates: fingerprints that agree on 2 of 4 sixteen-bit bands (six tables of 32-bit keys). Two fingerprints at
   distance 2 or less differ in at most two bands, so no link is lost. Equal fingerprints are folded before this.
3. Comparison: the members of a bucket are stored as 64 vertical bit planes; a shifted copy of the planes is compared
   with them, 64 distances a machine word, in carry-save counters; words whose lanes all exceed the radius are
   abandoned. Members that are already connected are not compared again.
4. Buckets above ``max_bucket`` members are never gathered: their members go to tables keyed by every value within one
   bit of the fingerprint instead. Two fingerprints at distance 2 or less share such a value, and at most 65 different
   fingerprints can meet under one, so this way is exact and has no hot keys.
5. Components: star contraction over links between group representatives.

Fingerprints of 64 bits tell copies with a word or so changed. For near copies of a given similarity of word shingles
(``similar_components``) the fingerprint has 512 bits: two texts whose shingles have Jaccard similarity J, and so cosine
2J / (1 + J), differ in a share arccos(cosine) / pi of the bits. Candidates are fingerprints that agree on all of k bits
sampled anew for each table, with k from the number of fingerprints and as many tables as find a pair at the limit with
the wanted probability; the same bit-sliced comparison decides. Similarity is what the fingerprints say: at the limit of
0.8 the radius is 1.84 standard deviations wide. A bucket above ``max_bucket`` is compared in blocks, and members that
are then apart from its largest component meet every block, so that no pair of a bucket is lost.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, MapType, StructType, VariantType

from lotflow.llm.arrow import only, small_batches
from lotflow.llm.components import connected_components
from lotflow.runtime import cut

BITS = 64
_SLICE = 1 << 20


def _shingle_hashes(data: bytes, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every word shingle, a slice of the text at a time."""
    hashed, tail, at, any_word = xxhash.xxh64_intdigest, [], 0, False
    while at < len(data):
        end = at + _SLICE
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        part = tail + data[at:end].split()
        at = end
        if len(part) >= words:
            any_word = True
            rows = zip(*[part[k:] for k in range(words)])
            yield np.array([hashed(b" ".join(r), seed) for r in rows], dtype=np.uint64)
            part = part[len(part) - words + 1 :]
        tail = part
    if not any_word and tail:
        yield np.array([hashed(b" ".join(tail), seed)], dtype=np.uint64)


def _bit_counts(rows: np.ndarray) -> np.ndarray:
    """How many rows (of 64-bit words) have each bit set: of many, three become a sum and a carry of twice the weight."""
    counts, weight = np.zeros(rows.shape[1] * 64, dtype=np.int64), 1
    while len(rows):
        carries = [rows[:0]]
        while len(rows) > 192:  # fewer are quicker to count one by one
            t = len(rows) // 3
            a, b, c = rows[:t], rows[t : 2 * t], rows[2 * t : 3 * t]
            x = a ^ b
            carries.append(a & b | x & c)
            rows = np.concatenate([x ^ c, rows[3 * t :]])
        counts += weight * np.unpackbits(np.ascontiguousarray(rows).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        rows, weight = np.concatenate(carries), 2 * weight
    return counts


#: Multipliers that give a hash further words.
_MORE = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB], dtype=np.uint64)


def wide_fingerprint(text: str | None, words: int, seed: int, width: int) -> np.ndarray:
    """SimHash of ``width`` 64-bit words: a bit is set if more than half of the shingles have it; zero without words."""
    counts, n = np.zeros(64 * width, dtype=np.int64), 0
    for h in _shingle_hashes((text or "").encode("utf-8", "replace").lower(), words, seed):
        for k in range(0, len(h), 1 << 16):
            part = h[k : k + (1 << 16), None]
            if width > 1:
                more = part * _MORE[None, : width - 1]
                more ^= more >> np.uint64(32)
                more *= np.uint64(0xBF58476D1CE4E5B9)
                part = np.c_[part, more ^ (more >> np.uint64(29))]
            counts += _bit_counts(part)
        n += len(h)
    return np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash."""
    return int(wide_fingerprint(text, words, seed, 1)[0])


@F.pandas_udf(LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series(np.array([fingerprint(t) for t in batch], dtype=np.uint64).view(np.int64))


def _planes(fp: np.ndarray) -> np.ndarray:
    """Bit planes over all lanes, as words of 64 lanes; ``fp`` has a row of 64-bit words a lane, or one word."""
    bits, planes = np.zeros((-(-len(fp) // 64) * 64, 64), dtype=np.uint8), []
    for word in fp.reshape(len(fp), -1).T:
        bits[: len(fp)] = np.unpackbits(np.ascontiguousarray(word).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        planes.append(np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view(np.uint64))
    return np.concatenate(planes)


def _over(count: list[np.ndarray], spill: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose counter exceeds the radius."""
    above, equal = spill.copy(), ~spill
    for b in reversed(range(len(count))):
        if radius >> b & 1:
            equal &= count[b]
        else:
            above |= equal & count[b]
            equal &= ~count[b]
    return above


def _near_at(planes: np.ndarray, shift: int, valid: np.ndarray, radius: int, step: int = 8) -> np.ndarray:
    """Lanes i, among the valid, whose fingerprint is within the radius of that of lane i + shift."""
    words, (skip, bit) = valid.shape[0], divmod(shift, 64)
    at = np.flatnonzero(valid)
    alive = valid[at]
    count = [np.zeros(len(at), np.uint64) for _ in range(max(1, radius.bit_length()))]
    spill = np.zeros(len(at), np.uint64)
    for first in range(0, len(planes), step):
        if not len(at):
            break
        here, there = planes[first : first + step, at], np.minimum(at + skip, words - 1)
        moved = planes[first : first + step, there] >> np.uint64(bit)
        if bit:
            moved |= planes[first : first + step, np.minimum(there + 1, words - 1)] << np.uint64(64 - bit)
        for x in here ^ moved:
            for b, c in enumerate(count):
                count[b], x = c ^ x, c & x
            spill |= x
        alive = alive & ~_over(count, spill, radius)
        keep = np.flatnonzero(alive)
        if len(keep) < len(at):  # abandon words in which every lane exceeds the radius
            at, alive, spill, count = at[keep], alive[keep], spill[keep], [c[keep] for c in count]
    found = np.zeros(words, np.uint64)
    found[at] = alive
    return np.flatnonzero(np.unpackbits(found.view(np.uint8), bitorder="little"))


def linked(fp: np.ndarray, group: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by group: the index of a row that each is connected with inside its group (itself if none)."""
    n = len(fp)
    root = np.arange(n)
    if n < 2:
        return root
    planes, lanes = _planes(fp), -(-n // 64) * 64
    step = max(8, len(planes) // 16)
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    longest = int(np.diff(np.r_[starts, n]).max())
    at = np.arange(n)
    for shift in range(1, longest):
        if shift % 64 == 0:  # groups that are connected as a whole are done
            apart = np.zeros(int(group[-1]) + 1, bool)
            apart[group[root != root[starts][np.searchsorted(starts, np.arange(n), "right") - 1]]] = True
            at = at[apart[group[at]]]
        at = at[at + shift < n]
        at = at[group[at] == group[at + shift]]
        todo = at[root[at] != root[at + shift]]
        if not len(todo):
            continue
        valid = np.zeros(lanes, np.uint8)
        valid[todo] = 1
        for i in _near_at(planes, shift, np.packbits(valid, bitorder="little").view(np.uint64), radius, step):
            a, b = int(i), int(i) + shift
            while root[a] != a:
                a = int(root[a])
            while root[b] != b:
                b = int(root[b])
            root[max(a, b)] = min(a, b)
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _matrix(prints: pa.Array) -> np.ndarray:
    """Fingerprints of equal length as rows of 64-bit words."""
    ends = np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(prints) + 1]
    return np.frombuffer(prints.buffers()[2], np.uint8)[ends[0] : ends[-1]].view(np.uint64).reshape(len(prints), -1)


def _compare(batches: Iterator[pa.RecordBatch], radius: int, least: int = 0) -> Iterator[pa.RecordBatch]:
    """Spanning links of each bucket; rows arrive sorted by bucket, and a bucket may span batches.

    Whole buckets are held until they make ``least`` rows, so that many are compared at once.
    """

    def links(rows: pa.Table) -> pa.RecordBatch:
        kind, key, rep = (rows.column(c).to_numpy() for c in ("kind", "key", "rep"))
        group = np.cumsum(np.r_[0, (kind[1:] != kind[:-1]) | (key[1:] != key[:-1])])
        if pa.types.is_binary(rows.schema.field("fp").type):
            fp = _matrix(rows.column("fp").combine_chunks())
        else:
            fp = rows.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        root = linked(fp, group, radius)
        own = np.flatnonzero(root != np.arange(len(root)))
        return pa.RecordBatch.from_arrays([pa.array(rep[own]), pa.array(rep[root[own]])], names=["a", "b"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        kind, key = batch.column("kind").to_numpy(), batch.column("key").to_numpy()
        last = np.flatnonzero((kind != kind[-1]) | (key != key[-1]))
        first = int(last[-1]) + 1 if len(last) else 0
        if sum(b.num_rows for b in held) + first < least:
            held.append(batch)
            continue
        if first:
            yield links(pa.Table.from_batches([*held, batch.slice(0, first)]))
            held = []
        elif held and (held[-1].column("kind")[-1].as_py(), held[-1].column("key")[-1].as_py()) != (kind[-1], key[-1]):
            yield links(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(first))
    if held:
        yield links(pa.Table.from_batches(held))


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def near_links(unique: DataFrame, radius: int = 2, bands: int = 4, max_bucket: int = 1024) -> DataFrame:
    """Links (a, b) that connect all fingerprints of ``unique(fp, rep)`` within the radius, none lost."""
    width = BITS // bands
    masks = [_signed(sum(((1 << width) - 1) << width * b for b in chosen)) for chosen in itertools.combinations(range(bands), bands - radius)]
    keys = unique.select("fp", "rep", F.explode(F.array(*[F.struct(F.lit(t).alias("kind"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])).alias("k")).select("k.kind", "k.key", "fp", "rep")
    hot = keys.groupBy("kind", "key").count().where(F.col("count") > max_bucket).select("kind", "key")
    ball = F.array(F.lit(0).cast("long"), *[F.lit(_signed(1 << b)).cast("long") for b in range(BITS)])
    dense = (
        keys.join(hot, ["kind", "key"], "left_semi").select("fp", "rep").distinct().select("fp", "rep", F.explode(ball).alias("flip"))
        .select(F.lit(-1).alias("kind"), F.col("fp").bitwiseXOR(F.col("flip")).alias("key"), "fp", "rep")
    )
    rows = keys.join(hot, ["kind", "key"], "left_anti").unionByName(dense)
    return rows.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp").mapInArrow(lambda it: _compare(it, radius), "a long, b long")


def simhash_components(docs: DataFrame, radius: int = 2, bands: int = 4, max_bucket: int = 1024) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs(doc_id, text)``.

    Null and word-less texts have fingerprint zero and link like any other. Rows with a null doc_id get a fingerprint
    and the component of equal fingerprints, but connect nothing and name no component. Repeated rows stay repeated.
    Other columns are ignored. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    prints = cut(only(docs, "doc_id", "text").select("doc_id", _fingerprints("text").alias("fp")))
    unique = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(near_links(unique, radius, bands, max_bucket))
    of_print = unique.join(roots, unique["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(of_print, "fp", "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def tables_for(rows: int, similarity: float, found: float, bits: int) -> tuple[int, int, int]:
    """(sampled bits a key, tables, radius) for so many fingerprints: a pair at the limit meets with probability ``found``."""
    differ = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    k = int(np.clip(np.ceil(np.log2(max(1, rows) / 64)), 8, 48))
    tables = int(np.ceil(np.log(1 - found) / np.log(1 - (1 - differ) ** k)))
    return k, tables, int(bits * differ + 1.84 * np.sqrt(bits * differ * (1 - differ)))


def similar_links(unique: DataFrame, rows: int, similarity: float = 0.8, found: float = 0.97, max_bucket: int = 4096, anchors: int = 64, width: int = 8, seed: int = 7) -> DataFrame:
    """Links (a, b) that connect the fingerprints of ``unique(fp binary, rep)`` that share a sampled table and are similar.

    Buckets above ``max_bucket`` are never gathered. They are compared in blocks, each with the bucket's ``anchors``
    smallest fingerprints, which mostly connects a bucket as a whole. Members that are still apart from the bucket's
    largest component then meet every block. So each pair of a bucket is compared, or is connected already.
    """
    k, tables, radius = tables_for(rows, similarity, found, 64 * width)
    rng = np.random.default_rng(seed)
    chosen = [rng.permutation(64 * width)[:k] for _ in range(tables)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp, rep = batch.column("fp"), batch.column("rep")
            n = batch.num_rows
            bits = np.unpackbits(np.frombuffer(b"".join(fp.to_pylist()), np.uint8).reshape(n, -1), axis=1, bitorder="little")
            for t, at in enumerate(chosen):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), pa.array(bits[:, at] @ (np.int64(1) << np.arange(k))), fp, rep], names=["kind", "key", "fp", "rep"])

    def compared(rows: DataFrame) -> DataFrame:
        """Links inside each block of each bucket of ``rows(kind, key, block, fp, rep)``."""
        keyed = rows.select("kind", F.when(F.col("block") == 0, F.col("key")).otherwise(F.xxhash64("key", "block")).alias("key"), "fp", "rep")
        return keyed.repartition("kind", "key").sortWithinPartitions("kind", "key", "fp").mapInArrow(lambda it: _compare(it, radius, 1 << 15), "a long, b long")

    keys = unique.select("fp", "rep").mapInArrow(deal, "kind int, key long, fp binary, rep long")
    hot = cut(keys.groupBy("kind", "key").count().where(F.col("count") > max_bucket).select("kind", "key", F.ceil(F.col("count") / max_bucket).alias("blocks")))
    if hot.isEmpty():
        return compared(keys.select("kind", "key", F.lit(0).cast("long").alias("block"), "fp", "rep"))
    dealt = keys.join(F.broadcast(hot) if hot.count() <= 100_000 else hot, ["kind", "key"], "left")
    dealt = dealt.withColumn("block", F.coalesce(F.pmod(F.xxhash64("fp", "kind"), "blocks"), F.lit(0)))
    members = cut(dealt.where("blocks is not null"))
    place = F.expr("row_number() over (partition by kind, key order by fp)")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block")
    first = members.withColumn("place", place).where(F.col("place") <= anchors).select("kind", "key", every, "fp", "rep")
    links = cut(compared(dealt.select("kind", "key", "block", "fp", "rep").unionByName(first)))
    roots = connected_components(links)
    grouped = members.join(roots, members["rep"] == roots["node"], "left").withColumn("root", F.coalesce("root", "rep")).drop("node")
    largest = grouped.groupBy("kind", "key", "root").count().groupBy("kind", "key").agg(F.max_by("root", F.struct("count", "root")).alias("main"))
    apart = cut(grouped.join(largest, ["kind", "key"]).where("root <> main").select("kind", "key", "blocks", "fp", "rep"))
    if apart.isEmpty():
        return links
    again = members.join(apart.select("kind", "key").distinct(), ["kind", "key"], "left_semi").select("kind", "key", "block", "fp", "rep")
    return links.unionByName(compared(again.unionByName(apart.select("kind", "key", every, "fp", "rep")).distinct()))


def similar_components(docs: DataFrame, words: int = 5, similarity: float = 0.8, width: int = 8, seed: int = 42, **params) -> DataFrame:
    """(doc_id, component_id) for every row of ``docs(doc_id, text)``: texts of that similarity of word shingles are linked.

    A text with fewer words than a shingle is one shingle; texts without words are copies of each other. Rows with a
    null doc_id get the component of equal fingerprints, but connect nothing. Repeated rows stay repeated. Other columns
    are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf(BinaryType())
    def prints_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series([wide_fingerprint(t, words, seed, width).tobytes() for t in batch], dtype=object)

    prints = cut(only(docs, "doc_id", "text").select("doc_id", prints_of("text").alias("fp")))
    unique = cut(prints.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    roots = connected_components(similar_links(unique, unique.count(), similarity, width=width, **params))
    of_print = unique.join(roots, unique["rep"] == roots["node"], "left").select("fp", F.coalesce("root", "rep").alias("component_id"))
    return prints.join(of_print, "fp", "left").select("doc_id", "component_id")


def keep_one_each(docs: DataFrame, **params) -> DataFrame:
    """``docs`` with one row left of each component of ``similar_components``: that of the smallest doc_id.

    Of rows that repeat that id, the first by text and then by the other plain columns stays. Rows with a null doc_id
    have no name to be linked by: all stay.
    """
    kept = similar_components(docs, **params).where("doc_id = component_id").select(F.col("doc_id").alias("kept_id")).distinct()
    rows = docs.select("doc_id", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    plain = [F.col("row").getField(f.name) for f in docs.schema if f.name != "text" and not isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType))]
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("row.text"), "row.text", *plain))
    first = rows.join(kept, rows["doc_id"] == kept["kept_id"], "left_semi").withColumn("place", place).where("place = 1")
    return first.select("row.*").unionByName(docs.where("doc_id is null"))
