"""Cross-entropy difference: how much better a target language model predicts a document than a background model.

Both are word bigram models over one vocabulary, all words of all documents. The target is counted over documents
labelled good, the background over all documents, and its counts are scaled to the target's total, so that both are
smoothed alike. Every word and every bigram is counted; none is dropped, capped or folded with another.

1. A task reads its documents as chunks of about ``chunk_tokens`` words. A chunk's distinct words and bigrams become
   64-bit keys (hashes; two of n keys agree with a chance below n^2 / 2^64), sorted and cut into ``buckets`` equal
   ranges of keys. Each bucket gets the chunk's keys there with their counts, packed; a key is sent once a chunk,
   however often it occurs, so that no word or bigram is a hot key. The chunk's words go along as small numbers.
2. A bucket adds up its keys over all chunks and answers each chunk with the totals, in the order of the keys.
3. A chunk puts its answers together and sums its documents' losses. Documents longer than a chunk go on in the next
   one, so memory is bounded; sums by row come last.

The rows between chunks and buckets are at most one for each key and chunk, so they grow with the input.

A word costs -log((pair + s * base[second]) / (seen[first] + s)). Every word of a text is once first and once second in a
pair, and so is its edge; the sum over a text may therefore take ``seen`` of the second word instead. ``base`` is the
word's share in the background; the target's is its share there, mixed with ``blend`` of the background's, so that a
word the target lacks has a probability too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

from lotflow.llm.arrow import only, small_batches

_EDGE = ""  # the edge of a text; no word is empty
_KEYS, _BODY = 0, 1
_SENT = "bucket long, chunk long, kind int, one binary, two binary, three binary"


def words_of(text: str | None) -> list[str]:
    """The one way a text becomes words, for counting and for scoring."""
    return (text or "").lower().split()


class _Numbers(dict):
    """A number for each different word, in order of first sight."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _packed(values: np.ndarray) -> bytes:
    """Numbers by planes of bytes, compressed; small and sorted ones shrink most."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T)
    return zstandard.compress(planes.tobytes(), 1)


def _unpacked(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack_sorted(keys: np.ndarray) -> bytes:
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _word_keys(words: list[str]) -> np.ndarray:
    """Odd 64-bit keys."""
    return np.array([xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")) | 1 for w in words], dtype=np.uint64)


def _pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Even 64-bit keys."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + second
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x & ~np.uint64(1)


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted different values, the place of each value among them, and the order that sorts them."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    new = np.empty(len(values), bool)
    new[:1] = True
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    place = np.empty(len(values), np.int64)
    place[order] = np.cumsum(new) - 1
    return ordered[new], place, order


def _keys(stream: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a stream of word numbers: all different ones sorted, and those of each word and of each adjacent pair."""
    at = words[stream]
    keys, place, _ = _distinct(np.concatenate([words, _pair_keys(at[:-1], at[1:])]))
    return keys, place[: len(words)], place[len(words) :]


def _bounds(buckets: int) -> np.ndarray:
    """The first key of every bucket but the first."""
    return np.array([k * (1 << 64) // buckets for k in range(1, buckets)], dtype=np.uint64)


class _Chunk:
    """Words of documents, one after the other with edges between; ``lengths`` counts the pairs of each document here."""

    def __init__(self, before: str = _EDGE):
        self.numbers = _Numbers()
        self.stream = [self.numbers[before]]
        self.rows, self.ids, self.lengths, self.good = [], [], [], []

    def add(self, row: int, doc, good: bool, words: list[str]) -> None:
        self.stream.extend(map(self.numbers.__getitem__, words))
        self.rows.append(row)
        self.ids.append(doc)
        self.lengths.append(len(words))
        self.good.append(good)

    def rows_for(self, number: int, buckets: int, ids: pa.DataType) -> pa.RecordBatch:
        stream, words = np.array(self.stream, np.uint32), _word_keys(list(self.numbers))
        keys, word_at, pair_at = _keys(stream, words)
        second = word_at[stream[1:]]
        good = np.repeat(np.array(self.good, bool), self.lengths)
        b = (np.bincount(pair_at, minlength=len(keys)) + np.bincount(second, minlength=len(keys))).astype(np.uint32)
        t = (np.bincount(pair_at[good], minlength=len(keys)) + np.bincount(second[good], minlength=len(keys))).astype(np.uint32)
        ends = np.r_[0, np.searchsorted(keys, _bounds(buckets)), len(keys)]
        some = np.flatnonzero(np.diff(ends))
        parts = [slice(ends[k], ends[k + 1]) for k in some]
        small = stream.astype(np.uint16) if len(words) < 1 << 16 else stream
        one = [_packed(small), *[_pack_sorted(keys[p]) for p in parts]]
        two = [words.tobytes(), *[_packed(t[p]) for p in parts]]
        three = [_packed(np.array([self.rows, self.lengths], np.int64).ravel()), *[_packed(b[p]) for p in parts]]
        n = len(one)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([self.ids] + [None] * (n - 1), pa.list_(ids)), pa.array([number % buckets, *some], pa.int64()), pa.array([number] * n, pa.int64()), pa.array([_BODY] + [_KEYS] * (n - 1), pa.int32()),
                pa.array(one, pa.binary()), pa.array(two, pa.binary()), pa.array(three, pa.binary()),
            ],
            names=["ids", "bucket", "chunk", "kind", "one", "two", "three"],
        )


def _sent(labelled: DataFrame, buckets: int, chunk_tokens: int) -> DataFrame:
    """What every chunk sends: its keys with counts to their buckets, and its own words to any one bucket."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = row = TaskContext.get().partitionId() << 33
        chunk, kind = _Chunk(), pa.null()
        for batch in batches:
            kind = batch.schema.field("doc_id").type
            for doc, text, good in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "good"))):
                words = [*words_of(text), _EDGE]
                row += 1
                while words:
                    room = chunk_tokens - len(chunk.stream)
                    chunk.add(row, doc, good, words[:room])
                    if room <= len(words):
                        yield chunk.rows_for(number, buckets, kind)
                        chunk, number = _Chunk(words[room - 1]), number + 1
                    words = words[room:]
        if chunk.rows:
            yield chunk.rows_for(number, buckets, kind)

    return labelled.select("doc_id", "text", "good").mapInArrow(send, _schema(_SENT, labelled.schema["doc_id"].dataType))


def _schema(fields: str, doc: DataType) -> StructType:
    return StructType([StructField("ids", ArrayType(doc)), *StructType.fromDDL(fields).fields])


def _answered(sent: DataFrame, doc: DataType) -> DataFrame:
    """What was sent, with the keys' totals over all chunks in place of the keys and their counts."""

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        one, two, three = (rows[c].tolist() for c in ("one", "two", "three"))
        mine = np.flatnonzero(rows["kind"] == _KEYS)
        if len(mine):
            parts = [_unpack_sorted(one[k]) for k in mine]
            _, place, order = _distinct(np.concatenate(parts))
            starts = np.flatnonzero(np.diff(place[order], prepend=-1))
            ends = np.cumsum([0, *map(len, parts)])
            for column in (two, three):
                each = np.concatenate([_unpacked(column[k], np.uint32) for k in mine]).astype(np.int64)
                total = np.add.reduceat(each[order], starts)
                for k, a, b in zip(mine, ends, ends[1:]):
                    one[k], column[k] = None, _packed(total[place[a:b]])
        return rows.assign(one=one, two=two, three=three)

    return sent.groupBy("bucket").applyInPandas(add, _schema(_SENT, doc))


def _finished(answered: DataFrame, doc: DataType, total_t: int, total_b: int, strength: float, blend: float) -> DataFrame:
    """(row, doc_id, n, lt, lb): pairs and summed losses of each document in each chunk."""

    def finish(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["kind", "bucket"])
        body, answers = rows[rows["kind"] == _BODY].iloc[0], rows[rows["kind"] == _KEYS]
        words = np.frombuffer(body["two"], np.uint64)
        stream = _unpacked(body["one"], np.uint16 if len(words) < 1 << 16 else np.uint32)
        row, lengths = _unpacked(body["three"], np.int64).reshape(2, -1)
        _, word_at, pair_at = _keys(stream, words)
        second, starts = word_at[stream[1:]], np.r_[0, np.cumsum(lengths)[:-1]]
        t, b = (np.concatenate([_unpacked(d, np.int64) for d in answers[c]]) for c in ("two", "three"))
        losses = []
        for counts, scale, mixed in ((t, 1.0, blend if total_t else 1.0), (b, total_t / total_b, 1.0)):
            seen = counts[second] * scale
            base = (1 - mixed) * seen / max(1, total_t) + mixed * b[second] / total_b
            loss = np.log(seen + strength) - np.log(counts[pair_at] * scale + strength * base)
            losses.append(np.add.reduceat(loss, starts))
        return pd.DataFrame({"doc_id": pd.Series(list(body["ids"]), dtype=object), "row": row, "n": lengths, "lt": losses[0], "lb": losses[1]})

    schema = StructType([StructField("doc_id", doc), *StructType.fromDDL("row long, n long, lt double, lb double").fields])
    return answered.groupBy("chunk").applyInPandas(finish, schema)


def _totals(labelled: DataFrame) -> tuple[int, int]:
    """Words and edges of the target and of all rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = b = 0
        for batch in batches:
            for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist()):
                n = len(words_of(text)) + 1
                t, b = t + good * n, b + n
        yield pa.RecordBatch.from_arrays([pa.array([t], pa.int64()), pa.array([b], pa.int64())], names=["t", "b"])

    return tuple(labelled.select("text", "good").mapInArrow(count, "t long, b long").agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in "tb"]).first())


def score_difference(docs: DataFrame, labels: DataFrame, strength: float = 64.0, blend: float = 0.1, chunk_tokens: int = 1 << 21, bucket_tokens: int = 1 << 21, small_labels: int = 1_000_000) -> DataFrame:
    """(doc_id, n_tokens, target_loss, background_loss, difference) for every row of ``docs(doc_id, text)``.

    Losses are means in nats over the words and the end of a text; difference = target_loss - background_loss, lower for
    text more like the target. A null text and one without words have 0 tokens and predict the end alone. The target is
    all texts with quality 1 in ``labels(doc_id, quality)`` and no other quality; without any, the difference is 0. Good ids are broadcast if there are at most ``small_labels``, else joined. Repeated rows count and
    score each; other columns are ignored; an empty table gives an empty result. There is a bucket for each
    ``bucket_tokens`` words of all texts.
    """
    small_batches(docs.sparkSession)
    good = only(labels, "doc_id", "quality").where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id", F.lit(True).alias("good"))
    if good.count() <= small_labels:
        good = F.broadcast(good)
    rows, doc = only(docs, "doc_id", "text"), docs.schema["doc_id"].dataType
    labelled = rows.join(good, "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    total_t, total_b = _totals(labelled)
    answered = _answered(_sent(labelled, 1 + total_b // bucket_tokens, chunk_tokens), doc)
    sums = _finished(answered, doc, total_t, total_b, strength, blend).groupBy("row", "doc_id").agg(*[F.sum(c).alias(c) for c in ("n", "lt", "lb")])
    target, background = F.col("lt") / F.col("n"), F.col("lb") / F.col("n")
    return sums.select("doc_id", (F.col("n") - 1).alias("n_tokens"), target.alias("target_loss"), background.alias("background_loss"), (target - background).alias("difference"))
