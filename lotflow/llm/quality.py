"""Quality classifier by compression with trained zstandard dictionaries.

One dictionary is trained on good, one on bad labelled text. A text is compressed piece by piece with either; the
difference of the two compressed sizes over their sum is the signal, the two sizes over the text's own size go beside
it (a text that both shrink to nothing repeats itself). A logistic calibration on labelled rows that neither dictionary
saw turns these into a score.

Bounds on what is fitted: ``per_class`` rows a class for the dictionaries and ``calibrate`` rows a class for the
calibration, chosen by a hash of the id; of a text longer than ``sample_chars`` characters, a slice of that length from
a hashed place. Scoring reads every whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from lotflow.llm.arrow import only, small_batches
from lotflow.llm.sampling import hashed_sample, slice_of

HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 4 = 2, false)"
_PIECE = 512


def _dictionary(texts: list[str], size: int) -> bytes:
    data = [t.encode("utf-8", "replace") for t in texts]
    parts = [d[k : k + 1024] for d in data for k in range(0, len(d), 1024)]
    try:
        return zstandard.train_dictionary(size, parts).as_bytes()
    except zstandard.ZstdError:  # too little to train on: the text itself is the dictionary
        return b"".join(parts)[-size:]


class CompressionModel:
    """Two dictionaries and a calibration; small enough to travel with a task."""

    def __init__(self, good: bytes, bad: bytes, level: int = 3):
        self.good, self.bad, self.level = good, bad, level
        self.mean, self.spread, self.weights = np.zeros(5), np.ones(5), np.zeros(6)

    def _compressors(self) -> list[zstandard.ZstdCompressor]:
        out = []
        for data in (self.good, self.bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=self.level)
            out.append(zstandard.ZstdCompressor(dict_data=d, level=self.level, write_content_size=False, write_dict_id=False))
        return out

    def features(self, texts: list[str | None]) -> np.ndarray:
        good, bad = (c.compress for c in self._compressors())
        rows = np.zeros((len(texts), 5))
        for row, text in zip(rows, texts):
            data = (text or "").encode("utf-8", "replace")
            if data:
                parts = [data[k : k + _PIECE] for k in range(0, len(data), _PIECE)]
                g, b = sum(map(len, map(good, parts))), sum(map(len, map(bad, parts)))
                row[:3] = (g - b) / (g + b), g / len(data), b / len(data)
        rows[:, 3:] = rows[:, :2] ** 2
        return rows

    def fit(self, texts: list[str], labels: list[int], ridge: float = 1e-2) -> None:
        x, y = self.features(texts), np.array(labels, dtype=float)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-9
        x, w = np.c_[(x - self.mean) / self.spread, np.ones(len(x))], np.zeros(6)
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(6), x.T @ (y - p) - ridge * w)
            w = w + np.clip(step, -5, 5)
        self.weights = w

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = (self.features(texts) - self.mean) / self.spread
        return 1 / (1 + np.exp(-np.clip(np.c_[x, np.ones(len(x))] @ self.weights, -30, 30)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = 600, calibrate: int = 1000, sample_chars: int = 20_000, dictionary_bytes: int = 65_536) -> CompressionModel | float:
    """A model from labelled rows that are not held out; the share of good rows if one class has no text at all.

    An id with several labels counts as good only if all say so; of several texts of an id the first in order is taken.
    """
    marked = only(labels, "doc_id", "quality").where("doc_id is not null and quality in (0, 1)").where(f"not {HELD_OUT}").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = hashed_sample(marked, "quality", per_class + calibrate, ("doc_id",), "quality").select("doc_id", "quality")  # at most 2 x (per_class + calibrate) rows
    texts = only(docs, "doc_id", "text").where("length(text) > 0")
    rows = [tuple(r) for r in texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "quality", slice_of("text", sample_chars).alias("text")).groupBy("doc_id", "quality").agg(F.min("text").alias("text")).collect()]
    rows.sort(key=lambda r: (r[0] * 2654435761 % (1 << 32), r[0], r[2]))
    of = {q: [r for r in rows if r[1] == q] for q in (0, 1)}
    if not of[0] or not of[1]:
        return len(of[1]) / len(rows) if rows else 0.5
    cut = {q: min(per_class, max(1, len(of[q]) // 2)) for q in of}
    model = CompressionModel(*(_dictionary([r[2] for r in of[q][: cut[q]]], dictionary_bytes) for q in (1, 0)))
    left = [r for q in of for r in (of[q][cut[q] :] or of[q])]
    share = {q: sum(r[1] == q for r in left) for q in of}
    model.fit([r[2] for r in left], [r[1] for r in left])
    true = {q: n for q, n in marked.groupBy("quality").count().collect()}
    model.weights[-1] += np.log((true[1] + 1) / (true[0] + 1)) - np.log(share[1] / share[0])  # from the balanced sample to the labels' own shares
    return model


def _scored(docs: DataFrame, labels: DataFrame, params: dict):
    """The trained score as a function of a text column."""
    small_batches(docs.sparkSession)
    model = train(docs, labels, **params)

    @F.pandas_udf(DoubleType())
    def scored(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield pd.Series(model.score(batch.tolist()) if isinstance(model, CompressionModel) else np.full(len(batch), model))

    return scored


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs(doc_id, text)``.

    A null text scores as an empty one. A row with a null id is scored and is not held out. Without labels of both
    classes every row scores the share of good ones (0.5 without any). Repeated rows score alike; other columns of
    either table are ignored. An empty table gives an empty result.
    """
    scored = _scored(docs, labels, params)
    rows = only(docs, "doc_id", "text").withColumn("score", scored("text"))
    return rows.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", F.expr(f"cast(score >= {threshold}D as int)").alias("predicted"))


def good_only(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, **params) -> DataFrame:
    """The rows of ``docs`` that score ``threshold`` or more, with all their columns, whatever their names."""
    scored = _scored(docs, labels, params)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("score", scored("row.text"))
    return rows.where(F.col("score") >= threshold).select("row.*")
