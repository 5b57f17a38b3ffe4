import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lotflow.llm import bpe, registry, transducer
from lotflow.runtime import table

from .conftest import SMALL

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def expected(text):
    ids = LIBRARY.encode(text or "", add_special_tokens=False).ids
    back = LIBRARY.decode(ids, skip_special_tokens=False).encode()
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back).hexdigest()


@pytest.fixture(scope="module")
def some():
    vocabulary = bpe.ByteBpe(PATH, cached=300)
    words = sorted({*LIBRARY.get_vocab(), "été", "漢字", "\n"}, key=str.encode)[::5]
    ids = [np.frombuffer(vocabulary.merged(" " + w), "<u4").tolist() for w in words]
    return vocabulary, words, ids, transducer.compile_lexicon([w.encode() for w in words], ids)


def test_transducer_holds_its_words_alone_and_shares_endings(some):
    _, words, ids, data = some
    lexicon = transducer.Lexicon(data)
    assert lexicon.places(words).tolist() == list(range(len(words)))
    assert [np.frombuffer(b, "<u4").tolist() for b in lexicon.outputs_of(np.arange(len(words)))] == ids
    other = ["", "zzzqqq", words[7] + "\x01", words[7][:-1] + "\x01", "x" * 500]
    assert lexicon.places(other).tolist() == [-1] * len(other)
    assert len(lexicon.final) < sum(len({w.encode()[:k] for w in words}) for k in range(40)), "fewer states than prefixes"
    arrivals = {}
    for state in range(len(lexicon.final)):
        arcs = tuple((int(k) & 255, int(t)) for k, t in zip(lexicon.keys, lexicon.targets) if k >> 8 == state) if state < 200 else (state,)
        arrivals.setdefault((int(lexicon.final[state]), arcs), []).append(state)
    assert all(len(v) == 1 for v in arrivals.values()), "no two states are alike"
    with pytest.raises(ValueError):
        transducer.compile_lexicon([b"b", b"a"], [[1], [2]])
    assert transducer.Lexicon(transducer.compile_lexicon([], [])).places(["a", ""]).tolist() == [-1, -1]


def test_ids_are_the_library_s(some):
    vocabulary, _, _, data = some
    lexicon = transducer.Lexicon(data)
    rng = random.Random(3)
    signs = "abcXYZ éÉßΣςİıǅ'’.,!?#$%&*0123456789٣Ⅷ½ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​　漢字かなハンкि👍🏽é<|>endoftext\x00﻿don't  "
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(1500)] + ["".join(rng.choices(" \n\tab.", k=rng.randint(0, 12))) for _ in range(3000)]
    texts += ["a<|endoftext|>b <|endoftext|>", "<|endoftext|><|endoftext|>", "", "x" * 3000, "a   b  ", " ", "  ", "a₏b ͸ c", None, "w. " * 400]
    for text, ids in zip(texts, vocabulary.encode(texts, lexicon)):
        want = LIBRARY.encode(text or "", add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want, repr(text)
        assert vocabulary.decode(ids).decode() == LIBRARY.decode(want, skip_special_tokens=False)


def test_every_token_is_its_own_merge(some):
    vocabulary = some[0]
    own = [i for i, raw in enumerate(vocabulary.bytes_of) if i not in vocabulary.special.values() and list(vocabulary._merge(raw)) == [i]]
    assert len(own) == len(vocabulary.bytes_of) - len(vocabulary.special)


def test_windows_do_not_change_ids(some, monkeypatch):
    vocabulary, _, _, data = some
    monkeypatch.setattr(bpe, "_WINDOW", 50)
    monkeypatch.setattr(bpe, "_HELD", 64)
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abc.\n ", k=rng.randint(0, 9))) for _ in range(600)) for _ in range(5)]
    for text, ids in zip(texts, vocabulary.encode(texts, transducer.Lexicon(data))):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_query_is_the_library_on_whole_texts(spark):
    texts = {r.doc_id: r.text for r in table(spark, SMALL, "documents").collect()}
    got = registry.op13_bpe(spark, SMALL).collect()
    assert len(got) == len(texts)
    for r in got:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == expected(texts[r.doc_id])


def test_odd_rows(spark, docs_of):
    rows = [(1, None, "en", "a"), (2, "", "en", "a"), (3, "one two", None, None), (3, "one two", None, None), (None, "one two three", "en", "b"), (5, "wide 漢字 " * 30000, "en", "a"), (6, "q" * 200_000, "en", "a")]
    docs = docs_of(rows).withColumnRenamed("found", "word").withColumnRenamed("h", "n").withColumnRenamed("fp", "ids")
    for back in (bpe.decode(bpe.encode(docs, PATH, words=3), PATH), bpe.round_trip(docs, PATH)):
        got = bpe.digests(back).collect()
        assert sorted(map(str, [(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got])) == sorted(str((r[0], *expected(r[1]))) for r in rows)
    assert bpe.encode(docs.limit(0), PATH).collect() == []
    assert bpe.decode(bpe.encode(docs, PATH).selectExpr("doc_id", "cast(null as binary) as ids").limit(1), PATH).first().text == ""


def test_lexicon_is_counted_over_all_texts(spark, docs_of):
    docs = docs_of([(k, "common rare%d common" % k, "en", "a") for k in range(50)] + [(99, "late late", "en", "a")])
    counts = {r.word: r.n for r in bpe.word_counts(docs).collect()}
    assert counts["common"] == 100 and counts["rare7"] == 1 and counts["late"] == 2
    assert transducer.Lexicon(bpe.compiled(docs, PATH, words=1)).places(["common", "late"]).tolist() == [0, -1]
