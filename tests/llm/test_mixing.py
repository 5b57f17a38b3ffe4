import duckdb
import pytest

from lotflow.llm import mixing
from lotflow.runtime import table

from .conftest import MEDIUM, SMALL


def plain_targets(totals, scale=1.5, most=2):
    order = sorted((s for s in totals if s is not None)) + ([None] if None in totals else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    goal, fixed = scale * sum(totals.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left = goal - sum(fixed.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * totals[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * totals[s] for s in over}


@pytest.mark.parametrize("sf", [SMALL, MEDIUM])
def test_targets_and_taken(spark, sf):
    rows = mixing.mix(table(spark, sf, "documents")).collect()
    totals, taken, target = {}, {}, {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
        assert 0 <= r.taken <= 2 * r.size and r.source_size >= r.size
    want = plain_targets(totals)
    for s in totals:
        assert target[s] == pytest.approx(want[s], rel=1e-12)
        assert abs(taken[s] - want[s]) <= max(64, 0.02 * want[s])


def test_reruns_and_sql_agree(spark):
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SMALL}/documents.parquet'")
    got = [sorted(tuple(r) for r in mixing.mix(table(spark, SMALL, "documents").repartition(n)).select("doc_id", "size", "source_size", "target", "taken").collect()) for n in (1, 5)]
    assert got[0] == got[1] == sorted(c.execute(mixing.ORACLE).fetchall())


@pytest.mark.parametrize("few", [0, 20_000])
def test_many_cells_of_a_hot_source(spark, docs_of, few):
    docs = docs_of([(k, "w " * (k % 90), None, "hot" if k % 3 else f"s{k % 11}") for k in range(1500)])
    rows = mixing.mix(docs, cell_words=2000, block_words=16, few_sources=few).collect()
    totals = {}
    for r in rows:
        totals[r.source] = totals.get(r.source, 0) + r.size
    want = plain_targets(totals)
    for s in totals:
        assert abs(sum(r.taken for r in rows if r.source == s) - want[s]) <= max(32, 0.03 * want[s])


def test_seats_are_the_highest_quotients(spark, docs_of):
    docs = docs_of([(k, "w " * (1 + k * 7 % 50), None, f"s{k % 7}") for k in range(400)])
    rows = mixing.mix(docs, block_words=8).collect()
    total, took = {}, {}
    for r in rows:
        total[r.source] = total.get(r.source, 0) + r.size
        took[r.source] = took.get(r.source, 0) + r.taken
    aim = plain_targets(total)
    blocks = {s: -(-total[s] // 8) for s in total}
    free = {s: int(aim[s] / total[s] * blocks[s] * 1000 + 0.5) for s in total if aim[s] < 2 * total[s]}
    seats = (sum(free.values()) + 500) // 1000
    ranked = sorted(((-w / (2 * k + 1), "s" + s, k) for s, w in free.items() for k in range(2 * blocks[s])))[:seats]
    won = {s: sum(x == "s" + s for _, x, _ in ranked) for s in free}
    for s, q in won.items():
        assert abs(took[s] - q * total[s] / blocks[s]) <= 1


def test_odd_rows(spark, docs_of):
    docs = docs_of([(1, None, None, None), (2, "", None, "a"), (3, "a b  c", None, None), (3, "a b  c", None, None), (None, "x y", None, "a"), (4, "\t\n", None, "")])
    rows = mixing.mix(docs).collect()
    assert sorted((r.size, r.source_size) for r in rows) == [(0, 0), (0, 2), (0, 6), (2, 2), (3, 6), (3, 6)]
    assert all(0 <= r.taken <= 2 * r.size for r in rows)
    assert mixing.mix(docs.limit(0)).count() == 0


def test_mixed_documents_hold_the_taken_words(spark):
    docs = table(spark, SMALL, "documents")
    want = {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken}
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    got = {}
    for r in out.collect():
        assert r.n_chars == len(r.text)
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == want
