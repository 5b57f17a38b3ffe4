import numpy as np

from lotflow.llm import neighbours
from lotflow.runtime import table

from .conftest import SMALL


def brute(rows, k=20):
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=np.float64)
    out = {}
    for i in np.flatnonzero(ids % 20 == 0):
        s = (x * x[i]).sum(axis=1)
        order = [j for j in np.lexsort((ids, -s)) if j != i][:k]
        out[int(ids[i])] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    return {q: [(v, s) for _, v, s in sorted(rows)] for q, rows in out.items()}


def test_small_table_is_exact(spark):
    table_ = table(spark, SMALL, "embeddings")
    got, want = found(neighbours.nearest(table_)), brute([(r.vec_id, r.embedding) for r in table_.collect()])
    assert {q: [v for v, _ in r] for q, r in got.items()} == {q: [v for v, _ in r] for q, r in want.items()}
    assert all(abs(a[1] - b[1]) < 1e-12 for q in want for a, b in zip(got[q], want[q]))


def test_recall_over_shards(spark):
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(np.random.default_rng(1).standard_normal((6000, 48)) * np.random.default_rng(2).uniform(0.5, 2, (6000, 1)))]
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=2000))
    want = brute(rows)
    hits = [len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want]
    assert all(len(got[q]) == 20 for q in want) and sum(hits) / (20 * len(hits)) >= 0.9


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], 1), (2, [1.0, 0.0], 2), (3, [0.0, 0.0], 2), (4, None, 3), (5, [nan, 1.0], 3), (6, [inf, 1.0], 1), (7, [1.0, None], 1), (8, [], 1), (9, [1.0, 2.0, 3.0], 1), (20, [0.5, 0.5], 1), (20, [0.5, 0.5], 1), (None, [1.0, 1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")
    assert found(neighbours.nearest(df)) == {0: [(1, 1.0), (2, 1.0), (20, 0.5)], 20: [(0, 0.5), (1, 0.5), (2, 0.5)]}
    assert neighbours.nearest(df.limit(0)).count() == 0


def test_ranges_prune_structured_vectors(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((40, 32)) * np.r_[6, np.ones(31)]
    x = centres[rng.integers(0, 40, 6000)] + 0.3 * rng.standard_normal((6000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    axis = neighbours.Axis.fit(x[:2000], 12, 1)
    shards, asked = axis.shards_of(np.arange(6000), x), [axis.asked(v) for v in x[::20]]
    assert set(shards) == set(range(1, 13)) and np.mean([len(a) for a in asked]) < 6
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)]
    got, want = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=500)), brute(rows)
    assert np.mean([len({v for v, _ in got[q]} & {v for v, _ in want[q]}) / 20 for q in want]) >= 0.9


def test_one_value_fills_many_shards(spark):
    rows = [(k, [1.0, 0.0, 0.0]) for k in range(3000)] + [(k, [float(c) for c in np.random.default_rng(k).standard_normal(3)]) for k in range(3000, 4000)]
    x = np.array([v for _, v in rows])
    axis = neighbours.Axis.fit(x[::2], 10, 1)
    assert np.bincount(axis.shards_of(np.arange(4000), x)).max() < 900
    got = found(neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), shard_rows=400))
    assert all(len(r) == 20 for r in got.values()) and len(got) == 200


def test_planes_count():
    rng = np.random.default_rng(9)
    for lines in (1, 2, 6, 7, 20, 161):
        inside = rng.random((lines, 192)) < 0.6
        sets = np.packbits(inside, axis=1, bitorder="little").view(np.uint64)
        for need in (1, lines // 2 + 1, lines, lines + 1, 1000):
            got = neighbours._at_least(neighbours._add_up(sets), need)
            assert (np.unpackbits(got.view(np.uint8), bitorder="little") == (inside.sum(axis=0) >= need)).all()


def test_windows_hold_all_within():
    rng = np.random.default_rng(4)
    for n in (1, 5, 64, 1000):
        x = rng.integers(-2, 3, (n, 3)) + 0.5  # many equal places
        index = neighbours.CollisionIndex(np.arange(n), x, 8, 7)
        length = np.linalg.norm(x, axis=1)
        places = np.c_[x / length.max(), np.sqrt(np.maximum(0, 1 - (length / length.max()) ** 2))] @ index.directions
        for half in (0.01, 0.3, 2.0):
            at = places[0]
            bits = np.unpackbits(index._inside(at, half, 8).view(np.uint8), count=n, bitorder="little")
            assert bits[(np.abs(places - at) <= half).all(axis=1)].all()


def test_few_vectors_are_verified():
    for width in (64, 768):
        x = np.random.default_rng(3).standard_normal((16384, width))
        if width > 64:
            x += 0.7 * np.random.default_rng(4).standard_normal((200, width))[np.arange(16384) % 200]
        x /= np.linalg.norm(x, axis=1)[:, None]
        index, hits = neighbours.CollisionIndex(np.arange(16384), x, 161, 7), 0
        for q in range(0, 16384, 400):
            ids, _ = index.search(q, x[q], 20, 0.75, 0.015, 1.03)
            score = x @ x[q]
            score[q] = -9
            hits += len(set(ids) & set(np.argsort(-score)[:20]))
        n = len(range(0, 16384, 400))
        assert hits / (20 * n) >= 0.9 and index.verified / (n * 16384) < 0.1
