import bisect
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lotflow.llm import packing
from lotflow.llm.tokens import WordBpe
from lotflow.runtime import table

from .conftest import SMALL

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def bpe():
    return WordBpe(PATH, cached=400)


def test_ids_are_the_library_s(bpe, spark):
    rng = random.Random(3)
    signs = "abcXYZ éÉßΣσςİıǅ'’.,!?#$%&*0123456789٣Ⅷ½ \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 ​　漢字かなハンкि👍🏽é<|>endoftext\x00﻿don't"
    texts = ["".join(rng.choices(signs, k=rng.randint(0, 60))) for _ in range(1500)] + ["a<|endoftext|>b", "", "x" * 3000, "Word, word. WORD; (it's) they'll 're", "a\u208fb \u0378 c\U0001fadc d\u20c1"]
    texts += [r.text for r in table(spark, SMALL, "documents").limit(40).collect()]
    library = Tokenizer.from_file(PATH)
    for text, ids in zip(texts, bpe.ids_of(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_sum_of_squares_choice():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 30, 400)
    bins, place = packing.sum_of_squares(lengths, 30)
    used, opened, least = [], 0, -(-int(lengths.sum()) // 30)
    for s, b, p in zip(lengths.tolist(), bins.tolist(), place.tolist()):
        count = np.bincount([30 - u for u in used], minlength=31)
        options = {}
        for gap in [g for g in range(s, 30) if count[g]] + ([30] if opened < least or not any(count[s:30]) or s == 30 else []):
            c = count.copy()
            if gap < 30:
                c[gap] -= 1
            c[gap - s] += 1
            options[gap] = int((c[1:30] ** 2).sum())
        gap = 30 if p == 0 and b == len(used) else 30 - used[b]
        assert options[gap] == min(options.values())
        if b == len(used):
            used.append(0)
            opened += 1
        assert used[b] == p
        used[b] += s
    assert len(used) <= 1.15 * least


def test_pack_is_gapless_and_true(spark, docs_of):
    docs = table(spark, SMALL, "documents")
    out = packing.pack(docs, PATH, size=512).collect()
    library, texts = Tokenizer.from_file(PATH), {r.doc_id: r.text for r in docs.collect()}
    for doc, text in texts.items():
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, 1], "<u4")
        mine = sorted((r for r in out if r.doc_id == doc), key=lambda r: r.piece)
        assert [r.length for r in mine] == [min(512, len(ids) - k) for k in range(0, len(ids), 512)]
        assert [(r.piece, r.start) for r in mine] == [(k, 512 * k) for k in range(len(mine))]
        assert all(r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes()) for r in mine)
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for rows in held.values():
        at = 0
        for offset, length in sorted(rows):
            assert offset == at
            at += length
        assert at <= 512
    gaps, fit = [], 0
    for n in sorted((r.length for r in out), reverse=True):
        at = bisect.bisect_left(gaps, n)
        gap = gaps.pop(at) if at < len(gaps) else 512
        fit += gap == 512
        bisect.insort(gaps, gap - n)
    assert len(held) <= fit + 1  # best fit decreasing
    odd = packing.pack(docs_of([(1, None, None, None), (1, None, None, None), (None, "", None, None), (2, "a " * 5000, None, None)]), PATH).collect()
    assert sorted(r.length for r in odd) == [1, 1, 1, 905, 4096]
    assert packing.pack(docs.limit(0), PATH).count() == 0
