import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from lotflow.llm import registry, variants
from lotflow.runtime import table

from .conftest import SMALL

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    n = Counter()
    for doc, text in rows:
        for run in RUN.findall(text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                k = h % len(run)
                run = run[:k] + run[k + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 5 and c >= 3}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(rows):
    n = counted(rows)
    by = {w: [] for w in n}
    for a, b in itertools.combinations(sorted(n), 2):
        if near(a, b):
            by[a].append(b)
            by[b].append(a)
    best = {w: min(x, key=lambda o: (-n[o], o)) for w, x in by.items() if x}
    form = {w: b for w, b in best.items() if n[b] >= 2 * n[w]}
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(by[w]), n[form[w]] if w in form else None))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str((r.word, r.form, r.root, r.n, r.n_near, r.form_n)) for r in df.collect())


def test_whole_table_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").collect()]
    got = rows_of(registry.op12_variants(spark, SMALL))
    assert got == brute(rows) and len(got) > 500


@pytest.mark.parametrize("groups", [3, 8])
def test_chains_ties_and_odd_rows(spark, docs_of, groups):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcé", k=rng.randint(4, 7))) for _ in range(260)]
    rows = [(k, " ".join(rng.choices(words, k=40)).replace("a", rng.choice("aA"))) for k in range(60)]
    chain = "".join(f"{w} " * n for w, n in (("zabcde", 3), ("zabcdx", 6), ("zabcxx", 12), ("zabxxx", 24), ("zaxxxx", 48), ("zabcdz", 6)))
    rows += [(1000, chain), (1001, "É" * 3 + "ÉÉ× ÉÉÉÉÉ÷ÉÉÉÉÉ ÿÿÿÿÿ"), (None, "nothing nothing nothing"), (7, None), (8, ""), (9, "漢字 🙂 ab"), (10, "same words here same"), (10, "same words here same"), (11, "x" * 5000 + " " + "x" * 5000 + " " + "x" * 5001)]
    got = rows_of(variants.group_variants(docs_of([(a, b, "en", "s") for a, b in rows]).repartition(3), groups=groups))
    assert got == brute(rows)
    assert any(r.startswith("('zabcde', 'zabcdx', 'zaxxxx'") for r in got)


def test_windows_and_flushes_do_not_change_counts(spark, monkeypatch, docs_of):
    rng = random.Random(6)
    text = " ".join("".join(rng.choices("abcdÀ", k=rng.randint(1, 8))) for _ in range(40_000))
    assert b" ".join(runs for w in variants._windows(text) for runs in variants.runs(w)) == b" ".join(variants.runs(text))
    monkeypatch.setattr(variants, "_WINDOW", 11)
    assert "".join(variants._windows(text)) == text
    assert [r for w in variants._windows(text) for r in variants.runs(w)] == variants.runs(text)
    got = {r.word: r.n for r in variants.word_counts(docs_of([(5, text * 12, "en", "s")])).collect()}
    assert got == counted([(5, text * 12)])


def test_empty(spark, docs_of):
    docs = docs_of([(1, "short", "en", "s")])
    assert variants.group_variants(docs).collect() == [] and variants.group_variants(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        variants.group_variants(docs, shortest=4)
