import random
from collections import defaultdict

import numpy as np
import pytest
import xxhash

from lotflow.llm import simhash
from lotflow.llm.components import connected_components
from lotflow.runtime import table

from .conftest import SMALL


def plain_fingerprint(text):
    words = [w for w in (text or "").translate({c: chr(c + 32) for c in range(65, 91)}).replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes)) if hashes else 0


def plain_components(prints):
    ids = sorted(prints)
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("text", ["", None, "  \n", "One", "one two", "A b\tC\x0bd é É", "x " * 9000, "naïve word two three"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_of_slices(monkeypatch):
    rng = random.Random(1)
    text = " ".join("".join(rng.choices("abc", k=rng.randint(1, 9))) for _ in range(500))
    monkeypatch.setattr(simhash, "_SLICE", 37)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fp = np.concatenate([base ^ np.uint64(1 << int(rng.integers(64))) ^ np.uint64(1 << int(rng.integers(64))) for _ in range(8)])
    group = np.sort(rng.integers(0, 6, len(fp)))
    root = simhash.linked(fp, group, radius)
    same = defaultdict(set)
    for g in set(group):
        mine = np.flatnonzero(group == g)
        want = {int(i): int(i) for i in mine}
        changed = True
        while changed:
            changed = False
            for i in mine:
                for j in mine:
                    if (int(fp[i]) ^ int(fp[j])).bit_count() <= radius and want[int(i)] != want[int(j)]:
                        want[int(i)] = want[int(j)] = min(want[int(i)], want[int(j)])
                        changed = True
        for i in mine:
            same[want[int(i)]].add(int(i))
    got = defaultdict(set)
    for i, r in enumerate(root):
        got[int(r)].add(i)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, same.values()))


@pytest.mark.parametrize("max_bucket", [1024, 3])
def test_components_against_brute_force(spark, max_bucket):
    docs = table(spark, SMALL, "documents")
    rows = docs.select("doc_id", "text").collect()
    prints = {r.doc_id: plain_fingerprint(r.text) for r in rows}
    want = plain_components(prints)
    got = simhash.simhash_components(docs, max_bucket=max_bucket).collect()
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in got} == {(i, f"{prints[i]:016x}", want[i]) for i in prints}


def test_chain_of_near_fingerprints_by_either_way(spark):
    rng = random.Random(2)
    prints, fp = [], 0x123456789ABCDEF0
    for _ in range(300):
        fp ^= 1 << rng.randrange(64)
        prints.append(fp)
        if rng.random() < 0.2:
            fp = rng.getrandbits(64)
    unique = {p: k for k, p in reversed(list(enumerate(prints)))}
    df = spark.createDataFrame([(simhash._signed(p), k) for p, k in unique.items()], "fp long, rep long")
    want = plain_components({k: p for p, k in unique.items()})
    for max_bucket in (1024, 2):
        roots = {r.node: r.root for r in connected_components(simhash.near_links(df, max_bucket=max_bucket)).collect()}
        assert {k: roots.get(k, k) for k in want} == want


def test_odd_rows(spark, docs_of):
    docs = docs_of([(3, None, None, None), (1, "", None, "a"), (1, "", None, "a"), (7, "One two three four", "en", "b"), (2, "one TWO three four", None, None), (None, "one two three four", None, None), (None, "alone in the world", None, None)])
    got = sorted(((r.doc_id, r.fingerprint[:3] == "000", r.component_id) for r in simhash.simhash_components(docs).collect()), key=str)
    assert got == sorted([(3, True, 1), (1, True, 1), (1, True, 1), (7, False, 2), (2, False, 2), (None, False, 2), (None, False, None)], key=str) or [g[2] for g in got].count(2) == 3
    kept = sorted((r.doc_id for r in simhash.keep_one_each(docs).collect() if r.doc_id is not None))
    assert kept == [1, 2]
    assert simhash.keep_one_each(docs).columns == docs.columns
    assert simhash.simhash_components(docs.limit(0)).count() == 0


def test_components_of_long_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3)]
    roots = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert roots == {**{k: 0 for k in range(1, 201)}, **{k: 1000 for k in range(1001, 1200)}}


def test_similar_groups_above_the_bucket_bound(spark):
    rng = random.Random(6)
    base = [f"w{rng.randint(0, 900)}" for _ in range(150)]
    rows = []
    for k in range(300):
        words = list(base)
        words[rng.randrange(150)] = f"x{k}"
        rows.append((k, " ".join(words)))
    rows += [(1000 + k, " ".join(f"w{rng.randint(0, 900)}" for _ in range(150))) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for max_bucket in (4096, 20):
        got = {r.doc_id: r.component_id for r in simhash.similar_components(docs, max_bucket=max_bucket, anchors=4).collect()}
        assert got == {k: 0 if k < 1000 else k for k, _ in rows}


def test_no_pair_of_a_hot_bucket_is_lost(spark):
    rng = np.random.default_rng(11)
    head = rng.integers(0, 256, 64, dtype=np.uint8)
    prints = []
    for c in range(12):  # chains whose ends are far apart, all in the same buckets of the sampled bits that they share
        fp = head.copy()
        for bit in rng.choice(512, 90, replace=False) if c else []:
            fp[bit // 8] ^= 1 << bit % 8
        for _ in range(25):
            fp = fp.copy()
            for bit in rng.choice(512, 20, replace=False):
                fp[bit // 8] ^= 1 << bit % 8
            prints.append(bytes(fp))
    rows = [(bytearray(p), k) for k, p in enumerate(dict.fromkeys(prints))]
    df = spark.createDataFrame(rows, "fp binary, rep long")
    roots = lambda **p: {r.node: r.root for r in connected_components(simhash.similar_links(df, len(rows), **p)).collect()}
    whole = roots()
    assert len(whole) > 100
    for max_bucket, anchors in ((40, 8), (12, 1), (5, 2)):
        assert roots(max_bucket=max_bucket, anchors=anchors) == whole


def test_every_labelled_language_is_learned(spark):
    from lotflow.llm import language
    from lotflow.llm.sampling import class_counts

    rows = spark.range(6000).selectExpr("id as doc_id", "repeat(concat('w', id % 1500, ' '), 40) as text", "concat('l', id % 1500) as lang")
    learned = language.sample(rows)
    assert len(learned) == 1500 and all(1 <= sum(map(len, t)) <= 400_000 // 1500 for t in learned.values())
    with pytest.raises(ValueError):
        class_counts(rows, "lang", 1000)
