from collections import Counter

from pyspark.sql import functions as F

import public_tokenizers

import corpus_pipeline
from lotflow.llm import language, mixing, packing, quality, simhash
from lotflow.runtime import table

from .conftest import SMALL


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def plain_shingles(text):
    words = [w.lower() for w in text.split()]
    return Counter(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def jaccard(a, b):
    return sum((a & b).values()) / max(1, sum((a | b).values()))


def test_stages_follow_their_operators(spark):
    docs = table(spark, SMALL, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    assert names == ["language", "quality", "near_duplicates", "mixing", "packing"]

    known = stage["language"](spark, docs, SMALL)
    told = {r.doc_id for r in language.identify(docs).collect() if r.lang_pred != "und" and r.score >= corpus_pipeline.LEAST_MARGIN}
    assert rows(known) == rows(docs.where(docs.doc_id.isin(list(told))))

    good = stage["quality"](spark, known, SMALL)
    kept = {r.doc_id for r in quality.score_quality(known, table(spark, SMALL, "labels")).collect() if r.predicted == 1}
    assert rows(good) == rows(known.where(known.doc_id.isin(list(kept)))) and 0 < len(kept) < known.count()

    single = stage["near_duplicates"](spark, good, SMALL)
    texts = {r.doc_id: plain_shingles(r.text) for r in good.collect()}
    component = {r.doc_id: r.component_id for r in simhash.similar_components(good).collect()}
    like = {(x, y): jaccard(texts[x], texts[y]) for x in texts for y in texts if x < y}
    assert all(component[x] == component[y] for (x, y), j in like.items() if j >= 0.82)
    assert all(any(j > 0.6 and d in pair for pair, j in like.items()) for d, c in component.items() if c != d)
    assert rows(single) == rows(good.where(good.doc_id.isin([d for d, c in component.items() if c == d])))

    mixed = stage["mixing"](spark, single, SMALL)
    taken = {r.doc_id: r.taken for r in mixing.mix(single).collect() if r.taken}
    got = {}
    for r in mixed.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(r.text.split())
    assert got == taken and mixed.columns == docs.columns

    packed = stage["packing"](spark, mixed, SMALL)
    assert sum(r.piece == 0 for r in packed.collect()) == mixed.count()


def test_run(spark):
    out = corpus_pipeline.run(spark, SMALL)
    assert out.count() > 0 and set(out.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    assert rows(out.select("doc_id", "piece", "length", "ids_crc32")) == rows(corpus_pipeline.run(spark, SMALL).select("doc_id", "piece", "length", "ids_crc32"))


def test_stages_of_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", None, "a", 0), (None, "some words here", "en", None, 5), (3, "some words here", "en", "b", 5), (3, "some words here", "en", "b", 5)], "doc_id long, text string, lang string, source string, n_chars long")
    for some in (docs, docs.limit(0)):
        for _, f in corpus_pipeline.STAGES:
            some = f(spark, some, SMALL)
            some.collect()


INNER = "size target total rate stop w key h score found place row t name shares copies fp rep kept_id lang_pred held_out predicted source_size cell cells words n k taken edits sequence_id".split()


def test_columns_with_inner_names_come_through(spark):
    docs = table(spark, SMALL, "documents").limit(60)
    wide = docs.select("*", *[F.concat(F.lit(f"{c}-"), "doc_id").alias(c) for c in INNER], F.create_map(F.lit("a"), F.col("doc_id")).alias("m"))
    plain = docs
    for name, f in corpus_pipeline.STAGES:
        wide, plain = f(spark, wide, SMALL), f(spark, plain, SMALL)
        if name == "packing":
            break
        assert wide.columns == [*docs.columns, *INNER, "m"]
        got = wide.collect()
        assert all(r[c] == f"{c}-{r.doc_id}" and r.m == {"a": r.doc_id} for r in got for c in INNER)
        assert sorted((r.doc_id, r.text) for r in got) == sorted((r.doc_id, r.text) for r in plain.collect())
    assert sorted(map(tuple, wide.collect())) == sorted(map(tuple, plain.collect()))


def test_very_long_texts(spark):
    long = " ".join(f"word{k % 1000} and then" for k in range(60_000))
    docs = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate([long, long, long + " tail", "short words of a text"])], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in simhash.keep_one_each(docs).orderBy("doc_id").collect()] == [0, 3]
    assert sum(r.taken for r in mixing.mix(docs).collect()) > 0
    assert sum(r.length for r in packing.pack(docs, public_tokenizers.path("word_bpe_49k.json")).collect()) > 180_000
