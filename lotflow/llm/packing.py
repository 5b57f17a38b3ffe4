"""Best-fit packing of tokenised documents by the sum-of-squares rule.

Documents longer than a sequence are cut into full pieces and a rest. Pieces are dealt by hash into groups of about
``group_pieces``; each group is packed on its own, longest piece first: a piece goes where the sum of the squared
counts of open sequences per remaining gap becomes smallest; of equal choices the smallest gap wins. A new sequence is
one of the choices until as many are open as the pieces need at least, and then only where nothing else fits. Only ids, lengths and checksums travel; token ids stay with the documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.arrow import only, small_batches
from lotflow.llm.tokens import word_bpe
from lotflow.runtime import cut

_PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1) -> DataFrame:
    """One row a piece of ``docs(doc_id, text)``: the ids of the text, then ``end_id``, cut at ``size``.

    A null or empty text is the end id alone. Repeated rows give repeated pieces; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    end = np.array([end_id], dtype="<u4").tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_bpe(vocabulary)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids_of(batch.column(1).to_pylist())):
                ids += end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k : k + 4 * size]
                    for column, value in zip(rows, (doc, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part))):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, _PIECE)


def sum_of_squares(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For lengths in the given order: the sequence of each, and its place there."""
    bin_of, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    count = np.zeros(size + 1, np.int64)  # open sequences per gap, 0 < gap < size
    stacks: list[list[int]] = [[] for _ in range(size + 1)]
    bins, least = 0, -(-int(lengths.sum()) // size)
    for k, s in enumerate(lengths.tolist()):
        gap = size
        if s < size:
            best = 2 * int(count[size - s]) + 1
            held = count[s:size]
            used = np.flatnonzero(held)
            if len(used):
                change = 2 * (count[used] - held[used]) + 2
                if used[0] == 0:
                    change[0] = 1 - 2 * int(held[0])
                at = int(change.argmin())
                if change[at] <= best or bins >= least:
                    gap = s + int(used[at])
        if gap == size:
            bin_of[k], place[k], bins = bins, 0, bins + 1
        else:
            bin_of[k], place[k] = stacks[gap].pop(), size - gap
            count[gap] -= 1
        if gap > s:
            count[gap - s] += 1
            stacks[gap - s].append(int(bin_of[k]))
    return bin_of, place


def pack(docs: DataFrame, vocabulary: str, size: int = 4096, end_id: int = 1, group_pieces: int = 16384) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) for every piece of every row of ``docs``.

    An empty table gives an empty result. Rows with a null doc_id are packed like any other.
    """
    found = cut(pieces(docs, vocabulary, size, end_id))
    groups = max(1, -(-found.count() // group_pieces))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bin_of, offset = sum_of_squares(rows["length"].to_numpy(), size)
        return rows.assign(sequence_id=rows["dealt"].to_numpy(np.int64) * (1 << 32) + bin_of, offset=offset).drop(columns="dealt")

    dealt = found.withColumn("dealt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("dealt").applyInPandas(place, f"{_PIECE}, sequence_id long, offset long")
