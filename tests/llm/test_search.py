import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from lotflow.llm import registry, search

from .conftest import MEDIUM

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id long, text string, score string, term string, doc_id string"


def terms(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    read = [(doc, terms(text)) for doc, text in docs]
    read = [(doc, t) for doc, t in read if t]
    n_docs, length = len(read), sum(len(t) for _, t in read)
    asked = {}
    for item, text in items:
        asked.setdefault(item, set()).update(terms(text))
    out = []
    for item, wanted in asked.items():
        w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * sum(t in x for _, x in read) + 1))) for t in wanted}
        scored = []
        for doc, x in read:
            m = 100 - 90 + 90 * len(x) * n_docs // length
            s = sum(w[t] * (10**9 * x.count(t) // (1000 * x.count(t) + 8 * m)) for t in wanted if t in x)
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, rank, doc, -s) for rank, (s, _, _, doc) in enumerate(sorted(scored)[:k], 1)]
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.item_id, r.rank, r.doc_id, r.score)) for r in df.collect())


@pytest.fixture
def items_of(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", "y", "z") for r in rows], ITEMS)


def test_query_is_its_sql(spark):
    c = duckdb.connect()
    for name in ("documents", "benchmark"):
        c.execute(f"create view {name} as select * from '{MEDIUM}/{name}.parquet'")
    want = sorted(str((r[0], r[1], r[2], int(r[3]))) for r in c.execute(search.ORACLE).fetchall())
    assert rows_of(registry.op11_search(spark, MEDIUM)) == want and len(want) == 400


def test_brute_force_with_ties_copies_and_parts(spark, docs_of, items_of):
    rng = random.Random(2)
    words = ["the", "The", "THE", "then", "he", "éa", "Éa", "a1", "1", "b_c", "漢字", "x" * 40]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", ".", "\n", ", ", "\x00", "-", " x "]) for _ in range(n))
    docs = [(k, text(rng.randint(0, 30))) for k in range(120)]
    docs += [(200 + k, docs[7][1]) for k in range(30)] + [docs[7], docs[7], (None, docs[7][1]), (None, None), (301, None), (302, ""), (303, "  ,.")]
    items = [(k, text(rng.randint(0, 6))) for k in range(25)] + [(3, "the extra"), (None, "then he"), (90, None), (91, ""), (92, "absent"), (4, "THE the"), (4, "THE the")]
    frame = docs_of([(a, b, "en", "s") for a, b in docs]).repartition(5)
    want = brute(docs, items)
    assert rows_of(search.search(frame, items_of(items))) == want
    assert rows_of(search.search(frame, items_of(items), part=6)) == want


def test_windows_and_long_texts(spark, docs_of, items_of, monkeypatch):
    found = search.automaton(["a", "bb", "a1"])
    text = "a bb. " * 50 + "A" * 99 + " a1,bb"
    whole = search.counts(found, text)
    assert whole == (103, {0: 50, 1: 51, 2: 1})
    monkeypatch.setattr(search, "_WINDOW", 7)
    assert search.counts(found, text) == whole and search.counts(found, "") == (0, {})
    long = [(1, "needle " + "hay " * 400_000, "en", "s"), (2, "needle hay", "en", "s")]
    assert [(r.doc_id, r.rank) for r in search.search(docs_of(long), items_of([(5, "needle")])).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_empty_tables(spark, docs_of, items_of):
    docs, items = docs_of([(1, "a b", "en", "s")]), items_of([(1, "a")])
    assert search.search(docs.limit(0), items).collect() == []
    assert search.search(docs, items.limit(0)).collect() == []
    assert search.search(docs.withColumn("text", F.lit(None).cast("string")), items).collect() == []
