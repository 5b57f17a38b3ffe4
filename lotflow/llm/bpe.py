"""Byte-level BPE of whole texts and back, exactly as the tokenizers library does it.

Frequent words come from a transducer (``transducer``) that is compiled once, written to the shared folder, fetched by
every executor as a Spark file and mapped into its workers' memory. Only words that it lacks are merged, pair by pair in
the vocabulary's order. A text is cut at spaces that a character follows, where a word always begins; so each distinct
stretch is looked up once in a while (a bounded cache follows the text), and only those that the lexicon lacks are split
and merged. Texts with code points that Python's Unicode tables lack take the library's own path.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lotflow.llm import transducer
from lotflow.llm.arrow import only, small_batches
from lotflow.llm.tokens import _byte_of, _newer
from lotflow.runtime import cut, shared_checkpoint_dir

#: Fixed value: how byte-level BPE splits a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
_WORD_BEGINS = re.compile(r" (?=\S)")
_CUT_IN_SPACE = re.compile(r"\s (?:\s|\Z)")
#: Signs that stand alone as a word after letters.
_CLOSING = frozenset(".,!?;:)")
#: A text is worked off in windows of about so many characters, and distinct words are looked up after so many words.
_WINDOW, _HELD = 1 << 20, 1 << 17
#: Words, and bytes a word, that the lexicon holds at most; what it lacks is merged, with the same result.
WORDS, LONGEST = 1 << 16, 64


def stretches(text: str) -> Iterator[tuple[str, list[str]]]:
    """A text in windows of what comes before its first cut, and the stretches that follow a space each.

    Words of the vocabulary never reach over a cut. Heads and stretches, with a space before each of these, are the text.
    """
    at = 0
    while at < len(text):
        end = _WORD_BEGINS.search(text, at + _WINDOW) if len(text) - at > _WINDOW else None
        window = text[at : end.start()] if end else text[at:]
        at += len(window)
        head, *rest = _WORD_BEGINS.split(window) if _CUT_IN_SPACE.search(window) else window.split(" ")
        yield head, rest


class ByteBpe:
    """A vocabulary in the tokenizers library's form: byte-level, without a normaliser, split by ``PATTERN``."""

    def __init__(self, path: str, cached: int = 300_000):
        self._cached, self._cache, self._older = cached, {}, {}
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        before = stated["pre_tokenizer"]
        if stated["normalizer"] or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before.get("use_regex", True):
            raise ValueError(f"{path} is no plain byte-level vocabulary")
        vocab, byte_of = stated["model"]["vocab"], _byte_of()
        self.path = path
        self.special = {t["content"]: t["id"] for t in stated["added_tokens"]}
        ranks = {bytes(map(byte_of.__getitem__, token)): i for token, i in vocab.items() if token not in self.special}
        self.bytes_of = [b""] * (1 + max([*ranks.values(), *self.special.values()]))
        for token, i in itertools.chain(ranks.items(), ((t.encode(), i) for t, i in self.special.items())):
            self.bytes_of[i] = token
        self._engine = tiktoken.Encoding("words", pat_str=r" [^ ]+", mergeable_ranks=ranks, special_tokens={})
        self._merge = self._engine._core_bpe.encode_single_piece
        self._spaced = np.array([token[:1] == b" " for token in self.bytes_of])
        self._split = regex.compile(PATTERN).findall
        self._specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    @functools.cached_property
    def library(self) -> Tokenizer:
        """The library itself, loaded for the first text that needs it."""
        return Tokenizer.from_file(self.path)

    def merged(self, text: str) -> bytes:
        """The ids of a text without special tokens, each of its words merged from its bytes."""
        return np.array([i for w in self._split(text) for i in self._merge(w.encode())], dtype="<u4").tobytes()

    def _merged_after_space(self, words: list[str]) -> list[bytes]:
        """The ids of words of letters alone, each with a space before it; a token that begins with a space begins a word."""
        ids = self._engine.encode_to_numpy(" " + " ".join(words)) if words else np.zeros(0, np.uint32)
        begins = (np.flatnonzero(self._spaced[ids]) * 4).tolist()
        return list(map(ids.astype("<u4").tobytes().__getitem__, map(slice, begins, [*begins[1:], 4 * len(ids)])))

    def parts(self, text: str) -> list[str]:
        """A text and the special tokens in it, apart."""
        return [text] if self._specials is None or not any(s in text for s in self.special) else [p for p in self._specials.split(text) if p]

    def _learn(self, some: set[str], lexicon: transducer.Lexicon) -> None:
        """Have every stretch in the cache: from its older half, from the lexicon, or word by word."""
        if len(self._cache) + len(some) > self._cached:
            self._older, self._cache = self._cache, {}
        cache, older = self._cache, self._older
        missing = some.difference(cache)
        kept = missing.intersection(older)
        cache.update(zip(kept, map(older.__getitem__, kept)))
        closed, words = [], []
        for s in self._look_up(list(missing.difference(kept)), lexicon):
            if s.isalpha():
                words.append(s)
            elif s[-1:] in _CLOSING and s[:-1].isalpha():
                closed.append(s)
            else:
                cache[s] = self.merged(" " + s)
        words += self._look_up(list({s[:-1] for s in closed}.difference(cache, words)), lexicon)
        cache.update(zip(words, self._merged_after_space(words)))
        ends = {c: self.merged(c) for c in _CLOSING} if closed else {}
        cache.update((s, cache[s[:-1]] + ends[s[-1]]) for s in closed)

    def _look_up(self, words: list[str], lexicon: transducer.Lexicon) -> list[str]:
        """Take what the lexicon has into the cache; the words that it lacks."""
        places = lexicon.places(words)
        known = np.flatnonzero(places >= 0)
        self._cache.update(zip(map(words.__getitem__, known.tolist()), lexicon.outputs_of(places[known])))
        return list(map(words.__getitem__, np.flatnonzero(places < 0).tolist()))

    def encode(self, texts: list[str | None], lexicon: transducer.Lexicon) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers; a null text is empty."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        n = 0

        def flush() -> None:
            self._learn(set(itertools.chain.from_iterable(some for _, some in held)), lexicon)
            get = self._cache.__getitem__
            for k, some in held:
                out[k].append(b"".join(map(get, some)))
            held.clear()

        for k, text in enumerate(texts):
            if text and not text.isascii() and _newer(text):
                out[k] = [np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()]
                continue
            for part in self.parts(text or ""):
                alone = part in self.special
                for head, some in [("", [])] if alone else stretches(part):
                    if n and (n + len(some) > _HELD or held[-1][0] == k):
                        flush()
                        n = 0
                    out[k].append(np.array([self.special[part]], dtype="<u4").tobytes() if alone else self.merged(head))
                    held.append((k, some))
                    n += len(some) or 1
        flush()
        return [b"".join(x) for x in out]

    def decode(self, ids: bytes) -> bytes:
        """The text of ``ids`` in UTF-8; bytes that are none become replacement characters."""
        raw = b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
        return raw.decode("utf-8", "replace").encode("utf-8")


@functools.cache
def byte_bpe(path: str) -> ByteBpe:
    """One instance a worker process."""
    return ByteBpe(path)


@functools.cache
def _fetched(name: str) -> transducer.Lexicon:
    return transducer.Lexicon.mapped(SparkFiles.get(name))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over all of ``docs(.., text)``: what stands between spaces, at most ``LONGEST`` bytes of it."""
    words = only(docs, "text").select(F.explode(F.split("text", " ")).alias("word"))
    return words.where(F.octet_length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def compiled(docs: DataFrame, vocabulary: str, words: int = WORDS) -> bytes:
    """The transducer of the most frequent words of all of ``docs``, with the ids that they have after a space.

    A word of n occurrences is in step ``floor(16 * log2(n))``; as many of the highest steps are taken as hold at most
    ``words`` words together, so no more than ``words`` x ``LONGEST`` bytes are gathered. Words that occur once stay out.
    """
    counted = cut(word_counts(docs).where("n > 1").select("word", F.floor(F.log2("n") * 16).cast("int").alias("step")))
    room, least = words, None
    for r in counted.groupBy("step").count().orderBy(F.desc("step")).collect():  # 16 steps an octave
        room -= r["count"]
        if room < 0:
            break
        least = r.step
    top = [] if least is None else counted.where(F.col("step") >= least).select("word").collect()
    order, bpe = sorted((r.word for r in top), key=str.encode), byte_bpe(vocabulary)
    return transducer.compile_lexicon([w.encode() for w in order], [np.frombuffer(bpe.merged(" " + w), "<u4").tolist() for w in order])


def share(spark: SparkSession, lexicon: bytes) -> str:
    """Write a lexicon to the shared folder and have executors fetch it; the name that workers find it by.

    Executors that join later fetch it as well. The name follows the content, so a rerun adds nothing.
    """
    name = f"lexicon-{hashlib.sha256(lexicon).hexdigest()[:32]}"
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_checkpoint_dir(spark)}/{name}")
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        out = fs.create(path, True)
        out.write(bytearray(lexicon))
        out.close()
    spark.sparkContext.addFile(str(path))
    return name


def _encoded(docs: DataFrame, vocabulary: str, words: int, back: bool) -> DataFrame:
    spark = docs.sparkSession
    name = share(spark, compiled(docs, vocabulary, words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, lexicon = byte_bpe(vocabulary), _fetched(name)
        for batch in batches:
            ids = bpe.encode(batch.column(1).to_pylist(), lexicon)
            columns = [batch.column(0), pa.array(ids, pa.binary())] + ([pa.array(map(bpe.decode, ids), pa.binary()).cast(pa.string())] if back else [])
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

    small_batches(spark)
    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary" + ", text string" * back)


def encode(docs: DataFrame, vocabulary: str, words: int = WORDS) -> DataFrame:
    """(doc_id, ids) for every row of ``docs(doc_id, text)``: little-endian unsigned 32-bit ids, as bytes.

    Null and empty texts have no ids; special tokens in a text become their ids. Repeated rows are encoded each, other
    columns are ignored, an empty table gives an empty result. Texts may be of any length: they are worked off in
    windows, and only the distinct words of a batch are held besides.
    """
    return _encoded(docs, vocabulary, words, False)


def round_trip(docs: DataFrame, vocabulary: str, words: int = WORDS) -> DataFrame:
    """As ``encode``, with ``text`` decoded from the ids in the same task."""
    return _encoded(docs, vocabulary, words, True)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """``encoded(doc_id, ids)`` with ``text``, decoded from the ids, special tokens included; null ids are an empty text."""
    small_batches(encoded.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(vocabulary)
        for batch in batches:
            texts = [bpe.decode(ids or b"").decode("utf-8") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return only(encoded, "doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


def digests(decoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of ``decoded(doc_id, ids, text)``."""
    return decoded.select(
        "doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256")
    )
