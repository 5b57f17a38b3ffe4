import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from lotflow.llm import edits, language, licences, lm, quality
from lotflow.runtime import table

from .conftest import MEDIUM, SMALL

BPE = public_tokenizers.path("byte_bpe_50k.tiktoken")


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_quality_on_held_out_rows(spark):
    docs, labels = table(spark, MEDIUM, "documents"), table(spark, MEDIUM, "labels")
    rows = quality.score_quality(docs, labels).collect()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    assert len(rows) == docs.count() and all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    mine = [(r.score, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    good, bad = [s for s, y in mine if y], [s for s, y in mine if not y]
    assert np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad]) > 0.93
    assert np.mean([s >= 0.7 for s in good]) > 0.95


def test_quality_odd_rows(spark, docs_of):
    docs = docs_of([(1, None, None, None), (2, "", None, None), (None, "a b", None, None), (3, "good words here", None, None), (3, "good words here", None, None), (4, "x " * 300_000, None, None)])
    labels = spark.createDataFrame([(3, 1, "z"), (3, 1, "z"), (None, 0, None), (9, None, None)], "doc_id long, quality int, score string")
    rows = quality.score_quality(docs, labels).collect()
    assert len(rows) == 6 and len({r.score for r in rows}) == 1
    both = labels.union(spark.createDataFrame([(4, 0, "q"), (2, 0, "q")], labels.schema))
    assert len(quality.score_quality(docs, both, sample_chars=10**6).collect()) == 6
    assert quality.score_quality(docs.limit(0), labels.limit(0)).count() == 0


def test_quality_is_the_plain_computation(spark):
    docs, labels = table(spark, SMALL, "documents"), table(spark, SMALL, "labels")
    model = quality.train(docs, labels)
    pair = [zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False) for d in (model.good, model.bad)]
    scores = {r.doc_id: r.score for r in quality.score_quality(docs, labels).collect()}
    for d in docs.collect():
        data = d.text.encode()
        g, b = (sum(len(c.compress(data[k : k + 512])) for k in range(0, len(data), 512)) for c in pair)
        x = [(g - b) / (g + b), g / len(data), b / len(data)] if data else [0, 0, 0]
        z = model.weights[5] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights, [*x, x[0] ** 2, x[1] ** 2], model.mean, model.spread))
        assert scores[d.doc_id] == pytest.approx(1 / (1 + np.exp(-np.clip(z, -30, 30))), abs=1e-9)


def test_quality_learns_from_classes_of_long_texts(spark, docs_of):
    rng = random.Random(2)
    prose = lambda words, n: " ".join(rng.choices(words.split(), k=n))
    docs = docs_of([(k, prose("calm river stone bridge walked home evening lamp" if k % 2 else "xx qq zz jj 00 11 kk ww", 6000 if k % 2 else 50), None, None) for k in range(60)])
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in quality.score_quality(docs, labels).collect())


def plain_phrases(train, text):
    n = i = 0
    while i < len(text):
        j = i
        while j < len(text) and any(text[i : j + 1] in t for t in train):
            j += 1
        strange = j < len(text) and not any(text[j] in t for t in train)  # closes the phrase and counts itself
        n, i = n + 1 + strange, j + strange
    return n


def test_automaton_counts_longest_phrases():
    rng = random.Random(4)
    for _ in range(150):
        train = [" ".join("".join(rng.choices("abc ", k=rng.randint(1, 30))).split()) or "a" for _ in range(3)]
        text = " ".join("".join(rng.choices("abc ", k=rng.randint(0, 50))).split())
        parser = language.CrossParser({"x": train, "y": [text or "b"]}, segment=10**6)
        assert parser.phrases([text])[0][0][0] == plain_phrases(train, text)
        cut = language.CrossParser({"x": train, "y": [text or "b"]}, segment=7)
        assert cut.phrases([text])[0][0][0] == sum(plain_phrases(train, text[k : k + 7]) for k in range(0, len(text), 7))


def test_language_accuracy_and_odd_rows(spark, docs_of):
    docs = table(spark, MEDIUM, "documents")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    rows = language.identify(docs).collect()
    assert np.mean([truth[r.doc_id] == r.lang_pred for r in rows if r.held_out]) > 0.98 and all(0 <= r.score <= 1 and r.held_out == held_out(r.doc_id) for r in rows)
    odd = docs_of([(1, None, "en", None), (2, "", "en", None), (3, "12 ... !", None, None), (4, "the cat", "en", None), (5, "漢字", None, None), (None, "le chat", "fr", None), (6, "le chien dort", "fr", None), (6, "le chien dort", "fr", None), (7, "a" * 200_000, None, None)])
    got = {(r.doc_id, r.lang_pred) for r in language.identify(odd).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} < got and all(p in ("en", "fr", "und") for _, p in got) and len(got) == 8
    assert {r.lang_pred for r in language.identify(odd.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify(odd.limit(0)).count() == 0


def test_language_of_long_texts_and_large_alphabets(spark, docs_of):
    rng = random.Random(8)
    english = "the cat sat on a mat and walked home with its friend over that hill".split()
    french = "le chat est assis sur un tapis et rentre avec son ami vers cette colline".split()
    signs = {"zh": range(0x4E00, 0x5600), "ko": range(0xAC00, 0xB400), "zz": range(0x5600, 0x5E00)}
    rows = [(k, " ".join(rng.choices(english, k=20)), "en", None) for k in range(100)] + [(k, " ".join(rng.choices(french, k=2000)), "fr", None) for k in range(100, 200)]
    for n, (lang, letters) in enumerate(signs.items()):
        rows += [(k, "".join(map(chr, rng.choices(letters, k=300))), lang, None) for k in range(200 + 100 * n, 300 + 100 * n)]
    got = language.identify(docs_of(rows)).collect()
    truth = {r[0]: r[2] for r in rows}
    assert all(r.lang_pred == truth[r.doc_id] for r in got if r.held_out) and {r.lang_pred for r in got} == {"en", "fr", *signs}


def test_tree_counts_as_a_new_count_does():
    bpe = edits.ByteBpe(BPE, public_tokenizers.PATTERN, cached=500)
    rng, signs = random.Random(5), "abcZé漢1 2  \n\n\t'sdt.,!?'ll ’ñ   "
    word = lambda n: "".join(rng.choices(signs, k=n))
    for _ in range(1200):
        text = word(rng.randint(0, rng.choice([5, 60, 400])))
        tree = edits.TokenTree(text, bpe, leaf=rng.choice([1, 3, 32]))
        for _ in range(rng.randint(1, 6)):
            a = rng.randint(0, len(text))
            b = rng.randint(a, min(len(text), a + rng.choice([0, 1, 5, 50])))
            new = word(rng.choice([0, 1, 3, 20]))
            tree.edit(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.text() == text and tree.total == len(bpe.engine.encode_ordinary(text)) and max(map(len, tree.leaves)) <= 8 * tree.leaf
            if rng.random() < 0.3:
                tree = edits.TokenTree.load(text, tree.dump(), bpe, tree.leaf)


def test_edits_touch_little(spark):
    docs = table(spark, SMALL, "documents")
    bpe = edits.ByteBpe(BPE, public_tokenizers.PATTERN)
    rows = {r.doc_id: r for r in edits.edited_counts(docs, BPE, public_tokenizers.PATTERN).collect()}
    for d in docs.collect():
        text = d.text
        for a, b, new in edits.cleaning_edits(text):
            text = text[:a] + new + text[b:]
        r = rows[d.doc_id]
        assert (r.n_tokens, r.n_tokens_after) == (len(bpe.engine.encode_ordinary(d.text)), len(bpe.engine.encode_ordinary(text)))
        assert r.n_recounted <= 60 * r.n_edits
    assert sum(r.n_edits for r in rows.values()) > 0


def test_kept_trees_encode_only_what_edits_touch(spark):
    docs = table(spark, SMALL, "documents").withColumn("edits", F.lit("a column of another type"))
    assert edits.edited_counts(docs.limit(3), BPE, public_tokenizers.PATTERN).count() == 3
    trees = edits.token_trees(docs, BPE, public_tokenizers.PATTERN)
    kind = "array<struct<start:int,stop:int,text:string>>"
    batch = lambda t, word: t.withColumn("edits", F.expr(f"cast(array(named_struct('start', length(text) div 3, 'stop', length(text) div 3 + 2, 'text', '{word}'), null) as {kind})"))
    bpe, pattern = edits.ByteBpe(BPE, public_tokenizers.PATTERN), public_tokenizers.PATTERN
    once = edits.edit_trees(batch(trees, "né w"), BPE, pattern)
    twice = edits.edit_trees(batch(once, " xyz "), BPE, pattern).collect()
    want = {r.doc_id: r.text for r in docs.collect()}
    for word in ("né w", " xyz "):
        want = {k: t[: len(t) // 3] + word + t[len(t) // 3 + 2 :] for k, t in want.items()}
    assert all(r.text == want[r.doc_id] and r.n_tokens == len(bpe.engine.encode_ordinary(r.text)) for r in twice)
    assert sum(r.n_recounted for r in twice) < 0.05 * sum(r.n_pretokens for r in twice)
    none = edits.edit_trees(once.withColumn("edits", F.lit(None).cast(kind)), BPE, pattern)
    assert {(r.doc_id, r.text, bytes(r.tree), r.n_recounted) for r in none.collect()} == {(r.doc_id, r.text, bytes(r.tree), 0) for r in once.collect()}


def test_given_edits_and_odd_rows(spark):
    rows = [(1, None, None), (2, "", [(0, 0, "new text")]), (3, "one two", [(4, 7, None), None, (None, None, "x ")]), (None, "one two", [(5, 900, "")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, edits array<struct<start:int,stop:int,text:string>>")
    got = {r.doc_id: (r.n_tokens, r.n_edits, r.n_tokens_after) for r in edits.edited_counts(df, BPE, public_tokenizers.PATTERN, "edits").collect()}
    assert got == {1: (0, 0, 0), 2: (0, 1, 2), 3: (2, 2, 3), None: (2, 1, 2)}
    assert edits.edited_counts(df.limit(0), BPE, public_tokenizers.PATTERN, "edits").count() == 0


def test_lm_exact_counts(spark, docs_of):
    rng = random.Random(9)
    texts = [" ".join(f"W{rng.randint(0, 20_000)}" if rng.random() < 0.9 else "the" for _ in range(150)) for _ in range(300)] + [None, "", "the the the the", "the the the the", "alpha\u00a0beta gamma", "ÉCOLE école"]
    docs = docs_of([(k, t, None, None) for k, t in enumerate(texts)] + [(0, texts[0], None, None), (None, "the end", None, None)])
    rows = [(r.doc_id, [(w, v) for ws in [["", *(r.text or "").lower().split(), ""]] for w, v in zip(ws, ws[1:])]) for r in docs.collect()]
    labels = spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int")
    pairs, words = (Counter(), Counter()), (Counter(), Counter())
    for d, found in rows:
        for m in (0, 1) if d is not None and d < 100 and d % 2 else (1,):
            pairs[m].update(found)
            words[m].update(w for w, _ in found)
    total = [sum(w.values()) for w in words]
    assert len(words[1]) > 16_384 and min(words[1].values()) == 1
    scale = [1.0, total[0] / total[1]]
    share = [lambda w: 0.9 * words[0][w] / total[0] + 0.1 * words[1][w] / total[1], lambda w: words[1][w] / total[1]]
    want = []
    for d, found in rows:
        loss = [-np.mean([np.log((pairs[m][w, v] * s + 64 * share[m](v)) / (words[m][w] * s + 64)) for w, v in found]) for m, s in enumerate(scale)]
        want.append((-1 if d is None else d, len(found) - 1, *loss, loss[0] - loss[1]))
    for sizes in ({"small_labels": 0}, {"chunk_tokens": 100, "bucket_tokens": 5_000}, {"chunk_tokens": 7}):
        got = [(-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.target_loss, r.background_loss, r.difference) for r in lm.score_difference(docs, labels, **sizes).collect()]
        assert len(got) == len(want) and np.allclose(sorted(got), sorted(want), rtol=1e-9)


def test_lm_exact_odd_rows(spark, docs_of):
    docs = docs_of([(1, None, None, None), (2, "", None, None), (None, "a b", None, None), (3, "a b", None, None), (3, "a b", None, None)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = lm.score_difference(docs, none).collect()
    assert sorted(r.n_tokens for r in rows) == [0, 0, 2, 2, 2] and all(np.isfinite(r.difference) for r in rows)
    assert lm.score_difference(docs.limit(0), none).count() == 0


def test_licences(spark, docs_of):
    plain = [(k, f"Ordinary words number {k} stand here.\nAnd another line of plain prose follows it.", None, None) for k in range(10, 60)]
    docs = docs_of(plain + [
        (1, "Text first.\nReleased under the MIT License.\nmore", None, None), (2, "This work is licensed under the GNU General Public License, version 3.", None, None),
        (3, "His driver's license was lost under the bridge.", None, None), (4, None, None, None), (5, "", None, None), (None, "Licensed under CC BY-NC 4.0.", None, None),
        (6, "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", None, None), (6, "x", None, None),
        (7, "Licensed under the Frobnicate Commercial Agreement of the moon colony, which nobody here has ever read.", None, None),
    ])
    rows = licences.scan(docs, negatives=60).collect()
    got = {r.doc_id: (r.family, r.n_notices, r.n_families) for r in rows}
    assert len(rows) == docs.count()
    assert got[1][:2] == ("mit", 1) and got[2][0] == "gpl" and got[3][0] == got[4][0] == got[5][0] == got[7][0] == "none" and got[None][0] == "cc-by-nc" and got[6][1:] == (2, 2)
    assert all(got[k][0] == "none" for k in range(10, 60))
    assert licences.scan(docs.limit(0)).count() == 0


MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
APACHE = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'


def test_licences_inside_longer_text(spark, docs_of):
    rng = random.Random(3)
    prose = lambda n: " ".join(rng.choices("harbour stone winter lamp carried slowly under green windows the and of a river where people had walked before".split(), k=n))
    docs = docs_of([(k, prose(30) + ". " + prose(70) + ".", None, None) for k in range(20, 80)] + [
        (1, MIT, None, None), (2, APACHE, None, None), (3, f"{prose(40)}. Released under the MIT License. {prose(50)}.", None, None), (4, f"{prose(60)} {MIT} {prose(60)}", None, None),
        (5, f"{prose(20)} this file is licensed under the Apache License, Version 2.0 {prose(20)}", None, None), (6, f"{prose(30)}. {APACHE} {prose(30)}. Released under the MIT License.", None, None),
        (7, f"{prose(30)}. The driver's license expired last year. {prose(60)}", None, None),
    ])
    got = {r.doc_id: (r.family, r.n_notices, r.first_line) for r in licences.scan(docs, negatives=60).collect()}
    assert {k: got[k] for k in range(1, 6)} == {1: ("mit", 1, 0), 2: ("apache-2.0", 1, 0), 3: ("mit", 1, 0), 4: ("mit", 1, 0), 5: ("apache-2.0", 1, 0)}
    assert got[6][1:] == (2, 0) and got[7][0] == "none" and all(got[k][0] == "none" for k in range(20, 80))


ISC = 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.'
BSD3 = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."


def test_licence_probes_and_plain_scores(spark, docs_of):
    probes = {
        1: (MIT, "mit"), 2: (APACHE + "\nYou may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "apache-2.0"), 3: ("word " * 300 + "Licensed under the MIT License.", "mit"), 4: (ISC, "isc"),
        5: (BSD3, "bsd"), 6: ("MIT", "mit"), 7: ("Released under the GNU Affero General Public License.", "agpl"), 8: ("Eclipse Public License 2.0", "epl"), 9: ("Sun Public License 2.0", "none"),
        10: ("Licensed under the European Union Public Licence 1.2", "none"), 11: ("MIT\nISC", "mit"), 12: ("x" * 300_000 + " MIT License.", "mit"),
    }
    plain = [(k, f"Ordinary words number {k} stand here and there.\nAnd another line of plain prose follows it.", None, None) for k in range(20, 60)]
    docs = docs_of([(k, t, None, None) for k, (t, _) in probes.items()] + plain)
    got = {r.doc_id: r.family for r in licences.scan(docs, negatives=60).collect()}
    assert {k: got[k] for k in probes if k != 11} == {k: f for k, (_, f) in probes.items() if k != 11} and got[11] in ("mit", "isc")

    rows = licences.paragraphs(docs)
    model = licences.LicenceModel(spark, rows.where("doc_id >= 20").select("paragraph").limit(60))
    table = {r.named: r for r in model.templates().collect()}
    weights, bias = model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    unknown, want = model.names.index(licences.UNKNOWN), {}
    some = licences.pieces(rows.where("doc_id < 12"))
    for r in some.collect():
        words = [w for w in regex.split(r"[^\p{L}\p{N}.+-]+|\.(?=\s|$)", r.paragraph.lower()) if w]
        pairs = list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:])))
        at = sorted({model.hash.indexOf(g) for g in words + pairs})
        raw = weights[:, at].sum(axis=1) + bias
        best = max((k for k in range(len(raw)) if k != unknown), key=lambda k: raw[k])
        z = (raw[best] - raw[unknown]) * model.calibration.coefficients[0] + model.calibration.intercept
        family, mine = model.names[best], set(pairs or words)
        near = any(len(mine & set(t)) >= min(0.5 * len(mine), 0.8 * len(t)) for t in table[family].templates)
        if z >= 0 and near and mine & set(table[family].own) and regex.search("|".join(licences.STEMS), r.paragraph.lower()):
            want[r.doc_id, r.place, r.paragraph] = (family, 1 / (1 + np.exp(-z)))
    found = {(r.doc_id, r.place, r.paragraph): (r.family, r.probability) for r in model.classify(licences.with_stem(some)).collect()}
    assert found.keys() == want.keys() and len(want) > 8
    assert all(found[k][0] == want[k][0] and found[k][1] == pytest.approx(want[k][1], abs=1e-9) for k in want)
    assert all(regex.search("|".join(licences.STEMS), w.lower()) for f, w, _ in licences._notices() if f != licences.UNKNOWN)
