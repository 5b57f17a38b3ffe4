"""Ranked lexical search that reads documents as they are: one automaton of all query terms counts them in the text.

Each term stands between two spaces in an Aho-Corasick automaton, and a text is folded so that all that is no term is a
space; so a hit is a whole term, and what a text holds of thousands of queries is found in one pass over it. The
automaton is broadcast, with lists of the items that each term belongs to. No index of the documents is made: a first
scan counts documents and terms, a second scores and keeps each item's best of a task. Items are dealt into parts whose
terms are bounded, with two scans a part; only an item that is longer by itself makes a larger one.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.arrow import only, small_batches
from lotflow.runtime import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Fixed value: what a term is made of.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_FOLD = bytes(b if b > 127 or chr(b).isdigit() or chr(b) in _LOWER else ord(chr(b).lower()) if chr(b) in _UPPER else 32 for b in range(256))
_WINDOW = 1 << 20
#: (item, term) pairs of a part at most, unless one item alone has more.
PART = 500_000
_SALTS = 64


def folded(text: str) -> bytes:
    """A text in UTF-8 with A-Z in lower case and a space for every sign outside terms, at both ends as well."""
    return b" " + text.encode().translate(_FOLD) + b" "


def automaton(terms: list[str]) -> ahocorasick.Automaton:
    """Finds `` term `` and gives the term's number."""
    found = ahocorasick.Automaton(ahocorasick.STORE_INTS)
    for k, term in enumerate(terms):
        found.add_word(f" {term} ", k)
    found.make_automaton()
    return found


def counts(found: ahocorasick.Automaton, text: str) -> tuple[int, Counter]:
    """How many terms a text has with repeats, and how often each of the automaton's occurs in it."""
    raw = folded(text)
    n, tf, at = 0, Counter(), 0
    while at < len(raw) - 1:
        end = raw.find(b" ", at + _WINDOW) if len(raw) - at > _WINDOW else len(raw) - 1
        window = raw[at : end + 1]  # the space at a cut belongs to both sides
        n += len(window.split())
        if len(found):
            tf.update(map(itemgetter(1), found.iter(window.decode())))
        at = end
    return n, tf


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, terms): the distinct terms of ``items(item_id, text)``; rows of one id are one item, without terms it goes."""
    rows = only(items, "item_id", "text").select(F.col("item_id").cast("long"), F.explode(F.expr(f"regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), r'({TERM})', 1)")).alias("term"))
    return rows.groupBy("item_id").agg(F.collect_set("term").alias("terms"))


def _parts(terms: DataFrame, bound: int) -> tuple[DataFrame, int]:
    """``terms`` with the ``part`` of each item, so that no part of several items has more than ``bound`` terms."""
    sized = terms.withColumn("size", F.size("terms").cast("long"))
    parts = max(1, -(-2 * (sized.agg(F.sum("size")).first()[0] or 0) // bound))
    while True:
        dealt = sized.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(parts)))
        over = dealt.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("items")).where(f"size > {bound} and items > 1")
        if over.isEmpty():
            return dealt, parts
        parts *= 2


def _statistics(docs: DataFrame, found) -> dict[int, int]:
    """How many documents have each term, by number; documents with a term at -1 and all their terms at -2."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                n, tf = counts(found.value, text or "")
                sums.update(tf.keys())
                sums[-1] += n > 0
                sums[-2] += n
        yield pa.RecordBatch.from_arrays([pa.array(sums.keys(), pa.int64()), pa.array(sums.values(), pa.int64())], names=["term", "n"])

    return {r.term: r.n for r in only(docs, "text").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}


def _best(docs: DataFrame, found, shared, documents: int, length: int, k: int) -> DataFrame:
    """(item_id, doc_id, score): the ``k`` best documents of each item in each task."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, weight, starts, of_item = shared.value
        best: list[list[tuple]] = [[] for _ in ids]
        least = np.ones(len(ids), np.int64)  # what a document has to reach to be among an item's best
        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns)):
                n, tf = counts(found.value, text or "")
                if not tf:
                    continue
                terms = np.fromiter(tf.keys(), np.int64, len(tf))
                times = np.fromiter(tf.values(), np.int64, len(tf))
                m = 100 - 90 + 90 * n * documents // length
                part = weight[terms] * (1_000_000_000 * times // (1000 * times + 8 * m))
                first, many = starts[terms], starts[terms + 1] - starts[terms]
                where = np.repeat(first - np.cumsum(many) + many, many) + np.arange(many.sum())
                scores = np.zeros(len(ids), np.int64)
                np.add.at(scores, of_item[where], np.repeat(part, many))
                order = -doc if doc is not None else -math.inf  # a null id comes last
                for i in np.flatnonzero(scores >= least).tolist():
                    entry = (int(scores[i]), order)
                    if len(best[i]) < k:
                        heapq.heappush(best[i], entry)
                    else:
                        heapq.heappushpop(best[i], entry)
                    if len(best[i]) == k:
                        least[i] = best[i][0][0]
        rows = [(item, None if order == -math.inf else -order, score) for item, heap in zip(ids, best) for score, order in heap]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3, names=["item_id", "doc_id", "score"])

    return only(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "item_id long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, k: int = 10, part: int = PART) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` highest-scoring documents, equal scores by ascending doc_id.

    A document's score sums ``w * ((10**9 * tf) div (1000 * tf + 8 * m))`` over the item's distinct terms: ``w`` falls with
    the documents that have the term, ``m`` grows with the document's length against the mean. Null and empty texts have
    no terms and are never found. Repeated rows are documents of their own and take ranks of their own; documents with a
    null id come after equal ones. Rows of one item id are one item, a null id among them. Other columns are ignored;
    an empty table gives an empty result. Texts of any length are read in windows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    terms = cut(item_terms(items))
    dealt, parts = _parts(terms, part)
    found: list[DataFrame] = []
    for p in range(parts):
        rows = dealt.where(F.col("part") == p).select("item_id", "terms").collect()
        if not rows:
            continue
        words = sorted({t for r in rows for t in r.terms})
        number = {t: j for j, t in enumerate(words)}
        pairs = sorted((number[t], i) for i, r in enumerate(rows) for t in r.terms)
        shared_automaton = spark.sparkContext.broadcast(automaton(words))
        seen = _statistics(docs, shared_automaton)
        documents, length = seen.get(-1, 0), seen.get(-2, 0)
        if not length:
            break
        weight = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * seen.get(j, 0) + 1))) for j in range(len(words))], np.int64)
        starts = np.searchsorted(np.array([j for j, _ in pairs]), np.arange(len(words) + 1))
        shared = spark.sparkContext.broadcast(([r.item_id for r in rows], weight, starts, np.array([i for _, i in pairs], np.int64)))
        found.append(_best(docs, shared_automaton, shared, documents, length, k))
    if not found:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionByName(more)
    order = "order by score desc, doc_id asc nulls last"
    some = rows.withColumn("rank", F.expr(f"row_number() over (partition by item_id, pmod(xxhash64(doc_id), {_SALTS}) {order})")).where(F.col("rank") <= k)
    return some.withColumn("rank", F.expr(f"row_number() over (partition by item_id {order})")).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


#: What the query gives on the documents and benchmark tables.
ORACLE = rf"""
with words as (select row_number() over () as row_id, doc_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}') as terms from documents where text is not null),
sized as (select row_id, doc_id, len(terms) as n from words where len(terms) > 0),
whole as (select count(*)::bigint as documents, sum(n)::bigint as length from sized),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '{TERM}')) as term from benchmark where text is not null),
counted as (select row_id, term, count(*) as tf from (select row_id, unnest(terms) as term from words) where term in (select term from asked) group by all),
weighted as (select term, floor(1000 * ln((2 * any_value(documents) + 2) / cast(2 * count(*) + 1 as double)))::bigint as w from counted, whole group by term),
scored as (select a.item_id, s.doc_id, s.row_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * documents) // length)))))::bigint as score
 from counted c join asked a using (term) join weighted using (term) join sized s using (row_id), whole group by all)
select item_id, rank, doc_id, score from (select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id asc nulls last) as integer) as rank, doc_id, score
 from scored where score > 0) where rank <= 10"""
