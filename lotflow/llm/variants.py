"""Spelling variants: words that differ by one letter, and for each the commoner word that it is taken for.

Candidates come from PartEnum signatures. A word is the multiset of its letters, a binary vector with a place for every
occurrence; one inserted, deleted or replaced letter changes at most two places, of at most two letters. Letters are
dealt into groups of like weight, and a word gets one signature for every choice of two groups that it leaves out: the
letters of all other groups. Near words agree in one of these at least, so an equi-join of signatures misses none; its
condition verifies the pair, so only near words leave the join.
"""

from __future__ import annotations

import itertools
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.arrow import only, small_batches
from lotflow.runtime import cut

_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 192 else 32 for b in range(256))
_BREAK = re.compile("[^A-Za-zÀ-ÿ]")
#: A text is worked off in windows of about so many characters; counts of a task are passed on beyond so many words.
_WINDOW, _HELD = 1 << 20, 1 << 18


def runs(text: str) -> list[bytes]:
    """Maximal runs of letters up to U+00FF, A-Z in lower case, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_FOLD).split()


def _windows(text: str) -> Iterator[str]:
    at = 0
    while at < len(text):
        end = _BREAK.search(text, at + _WINDOW) if len(text) - at > _WINDOW else None
        yield text[at : end.start()] if end else text[at:]
        at = end.start() if end else len(text)


def _typos(doc: int | None, found: list[bytes]) -> Iterator[tuple[bytes, bytes]]:
    """The distinct runs of a document that lose a letter, and what is left of them."""
    start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
    for w in set(found):
        h = zlib.crc32(w if w.isascii() else w.decode("latin-1").encode(), start)
        if h % 97 == 0:
            k = h % len(w)
            yield w, w[:k] + w[k + 1 :]


def word_counts(docs: DataFrame, shortest: int = 5, least: int = 3) -> DataFrame:
    """(word, n) over all of ``docs(doc_id, text)``: words of ``shortest`` letters or more that occur ``least`` times or more.

    A run loses a letter in one of 97 documents, chosen by a checksum of the document's id and the run; a null id counts
    as empty text. Null texts have no runs; repeated rows count each.
    """
    small_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def sums() -> pa.RecordBatch:
            kept = [(w.decode("latin-1"), n) for w, n in total.items() if n and len(w) >= shortest]
            return pa.RecordBatch.from_arrays([pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                for window in _windows(text or ""):
                    found = runs(window)
                    total.update(found)
                    each = Counter(found) if len(found) > 2000 else None
                    for w, rest in _typos(doc, found):
                        n = each[w] if each else found.count(w)
                        total[w] -= n
                        total[rest] += n
                    if len(total) > _HELD:
                        yield sums()
                        total.clear()
        yield sums()

    counted = only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def letter_groups(words: DataFrame, groups: int) -> list[str]:
    """The letters of ``words`` in ``groups`` groups of like weight; there are at most as many letters as the alphabet has."""
    weights = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter <> ''").groupBy("letter").count().collect()
    dealt, load = [""] * groups, [0] * groups
    for r in sorted(weights, key=lambda r: (-r["count"], r.letter)):
        lightest = load.index(min(load))
        dealt[lightest] += r.letter
        load[lightest] += r["count"]
    return dealt


def signatures(words: DataFrame, groups: list[str]) -> DataFrame:
    """``words`` with a ``signature`` a row: for every two groups the hash of the letters of the others.

    Also a hash of all letters, ``multiset``, and of the first and the last two, which cheaply rule out most pairs.
    """
    ordered = F.array_join(F.array_sort(F.split("word", "")), "")
    two = lambda at: F.ascii(F.substring("word", at, 1)) * 256 + F.ascii(F.substring("word", at + 1, 1))
    described = words.select("word", "n", ordered.alias("letters"), two(1).alias("head"), two(-2).alias("tail"))
    some = F.array(*[F.xxhash64(F.lit(k), F.translate("letters", a + b, "")) for k, (a, b) in enumerate(itertools.combinations(groups, 2))])
    return described.select("word", "n", F.xxhash64("letters").alias("multiset"), "head", "tail", F.explode(some).alias("signature"))


def near_pairs(words: DataFrame, groups: int = 8) -> DataFrame:
    """(a, b, n_a, n_b): words of ``words(word, n)``, five letters or longer, that differ by one letter, each pair once.

    One letter changed in five or more leaves the first two or the last two as they are, and changes the multiset.
    """
    signed = signatures(words, letter_groups(words, groups))
    a, b = signed.alias("a"), signed.alias("b")
    near = "a.signature = b.signature and a.word < b.word and a.multiset <> b.multiset and (a.head = b.head or a.tail = b.tail) and levenshtein(a.word, b.word, 1) = 1"
    return a.join(b, F.expr(near)).select(F.col("a.word").alias("a"), F.col("b.word").alias("b"), F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b")).distinct()


def forms(words: DataFrame, groups: int = 8) -> DataFrame:
    """``words(word, n)`` with n_near, form and form_n.

    The form is the commonest near word, the first of equally common ones, if it is at least twice as common; else null.
    """
    both = F.expr("inline(array(struct(a as word, n_b as other_n, b as other), struct(b as word, n_a as other_n, a as other)))")
    best = near_pairs(words, groups).select(both).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("best"))
    joined = words.join(best, "word", "left")
    taken = F.expr("-best.n >= 2 * n")
    return joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(taken, F.col("best.other")).alias("form"), F.when(taken, -F.col("best.n")).alias("form_n"))


def with_roots(formed: DataFrame) -> DataFrame:
    """``formed(word, form, ..)`` with ``root``: the end of the chain of forms, the word itself if it has none.

    Counts double along a chain, so it has at most 63 links; each round halves what is left of all chains.
    """
    links = cut(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = cut(links.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        if links.where("moved").isEmpty():
            break
        links = links.drop("moved")
    return formed.join(links.select("word", "root"), "word", "left").withColumn("root", F.coalesce("root", "word"))


def group_variants(docs: DataFrame, shortest: int = 5, least: int = 3, groups: int = 8) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every word of ``docs(doc_id, text)`` (see ``word_counts``).

    Null and empty texts and empty tables give no words; other columns are ignored. ``shortest`` is at least 5.
    """
    if shortest < 5:
        raise ValueError("words need five letters at least")
    words = cut(word_counts(docs, shortest, least))
    return with_roots(cut(forms(words, groups))).select("word", "form", "root", "n", "n_near", "form_n")
