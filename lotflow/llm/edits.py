"""Edit-aware token counts: a segment tree of pre-tokens for each document.

A leaf holds a run of pre-tokens; a node holds the characters and tokens below it. An edit finds its leaves by
characters, and only the pre-tokens it touches are encoded again, with boundary context: one pre-token before it that
could look into it, and those after it up to the first boundary that old and new text share. Then the sums on the paths
to the root are updated. Trees are kept as a column (``token_trees``): the lengths of the pre-tokens and the tokens of
each leaf. A later batch of edits (``edit_trees``) reads them back without splitting or encoding the text again. A leaf
that edits make eight times its size is split. The vocabulary is byte-level BPE, whose pre-tokens never look back, so the result is that of
counting the edited text anew.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
import tiktoken
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.arrow import only, small_batches


class ByteBpe:
    """Token counts of pre-tokens, kept in a bounded two-part dictionary."""

    def __init__(self, path: str, pattern: str, cached: int = 300_000):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.engine = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(pattern).findall
        self.cached, self.cache, self.older = cached, {}, {}

    def counts(self, parts: list[str]) -> list[int]:
        cache = self.cache
        try:
            return [cache[p] for p in parts]
        except KeyError:
            pass
        if len(cache) > self.cached:
            self.older, self.cache = cache, {}
            cache = self.cache
        older, encode = self.older, self.engine.encode_ordinary
        for p in parts:
            if p not in cache:
                cache[p] = older[p] if p in older else len(encode(p))
        return [cache[p] for p in parts]


class TokenTree:
    """Token count of one text under edits."""

    def __init__(self, text: str, bpe: ByteBpe, leaf: int = 64):
        self.bpe, self.leaf = bpe, leaf
        parts = bpe.split(text)
        counts = bpe.counts(parts)
        self.leaves = [parts[k : k + leaf] for k in range(0, len(parts), leaf)] or [[]]
        self.recounted = 0
        self._build([sum(counts[k * leaf : k * leaf + leaf]) for k in range(len(self.leaves))])

    @classmethod
    def load(cls, text: str, kept: bytes, bpe: ByteBpe, leaf: int = 64) -> TokenTree:
        """The tree of ``text`` as ``dump`` kept it; nothing is split or encoded."""
        self, data = cls.__new__(cls), np.frombuffer(zstandard.decompress(kept), dtype=np.uint32)
        self.bpe, self.leaf, self.recounted, n = bpe, leaf, 0, int(data[0])
        sizes, tokens, ends = data[1 : 1 + n].tolist(), data[1 + n : 1 + 2 * n].tolist(), np.cumsum(data[1 + 2 * n :], dtype=np.int64).tolist()
        parts = [text[a:b] for a, b in zip([0, *ends], ends)]
        starts = np.cumsum([0, *sizes]).tolist()
        self.leaves = [parts[a:b] for a, b in zip(starts, starts[1:])]
        self._build(tokens)
        return self

    def dump(self) -> bytes:
        """Leaves, the pre-tokens and tokens of each, and the length of every pre-token."""
        n = len(self.leaves)
        data = [n, *map(len, self.leaves), *self.tokens[self.base : self.base + n], *(len(p) for own in self.leaves for p in own)]
        return zstandard.compress(np.array(data, dtype=np.uint32).tobytes(), 1)

    def _build(self, tokens: list[int]) -> None:
        """The sums over the leaves, of which the tokens are known."""
        self.base = 1 << (len(self.leaves) - 1).bit_length()
        self.tokens, self.chars = [0] * (2 * self.base), [0] * (2 * self.base)
        for k, own in enumerate(self.leaves):
            self.tokens[self.base + k] = tokens[k]
            self.chars[self.base + k] = sum(map(len, own))
        for k in range(self.base - 1, 0, -1):
            self.tokens[k] = self.tokens[2 * k] + self.tokens[2 * k + 1]
            self.chars[k] = self.chars[2 * k] + self.chars[2 * k + 1]

    @property
    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(p for own in self.leaves for p in own)

    def _leaf_at(self, at: int) -> tuple[int, int]:
        """The leaf with this character (the last one for the end of the text), and where it starts."""
        k, start = 1, 0
        while k < self.base:
            k *= 2
            if at - start >= self.chars[k] and self.chars[k + 1]:
                start += self.chars[k]
                k += 1
        return k - self.base, start

    def _update(self, leaf: int) -> None:
        k = self.base + leaf
        self.tokens[k], self.chars[k] = sum(self.bpe.counts(self.leaves[leaf])), sum(map(len, self.leaves[leaf]))
        while k > 1:
            k //= 2
            self.tokens[k], self.chars[k] = self.tokens[2 * k] + self.tokens[2 * k + 1], self.chars[2 * k] + self.chars[2 * k + 1]

    def edit(self, start: int, stop: int, new: str) -> None:
        """Replace the characters [start, stop) of the current text; bounds outside the text are moved into it."""
        start = min(max(start, 0), self.chars[1])
        stop = min(max(stop, start), self.chars[1])
        first, at = self._leaf_at(max(0, start - 2))
        index = 0
        while index < len(self.leaves[first]) and at + len(self.leaves[first][index]) + 1 < start:
            at += len(self.leaves[first][index])
            index += 1
        old, ends, end = [], [], at  # pre-tokens from the first that may change
        leaf, k = first, index
        more = 8
        while True:
            while leaf < len(self.leaves) and (end < stop or more):
                if k == len(self.leaves[leaf]):
                    leaf, k = leaf + 1, 0
                    continue
                old.append(self.leaves[leaf][k])
                end += len(old[-1])
                ends.append(end)
                k += 1
                more -= end > stop
            whole = "".join(old)
            text = whole[: start - at] + new + whole[stop - at :]
            shift, last = len(new) - (stop - start), end >= self.chars[1]
            fresh, reach = self.bpe.split(text), at
            bounds = {e + shift: n for n, e in enumerate(ends, 1) if e >= stop}
            meet = None
            for n, part in enumerate(fresh, 1):
                reach += len(part)
                if reach in bounds and reach >= start + len(new) and (last or reach + 2 < at + len(text)):
                    meet = (n, bounds[reach])
                    break
            if meet or last:
                new_parts, gone = (fresh[: meet[0]], meet[1]) if meet else (fresh, len(old))
                break
            more = len(old)
        self.recounted += len(new_parts)
        leaf, k, left = first, index, gone
        while left:
            take = min(left, len(self.leaves[leaf]) - k)
            self.leaves[leaf][k : k + take] = []
            left -= take
            if leaf != first:
                self._update(leaf)
            if left:
                leaf, k = leaf + 1, 0
        self.leaves[first][index:index] = new_parts
        self._update(first)
        if len(self.leaves[first]) > 8 * self.leaf:
            parts, tokens = self.leaves[first], self.tokens[self.base : self.base + len(self.leaves)]
            chunks = [parts[k : k + self.leaf] for k in range(0, len(parts), self.leaf)]
            self.leaves[first : first + 1] = chunks
            self._build([*tokens[:first], *(sum(self.bpe.counts(c)) for c in chunks), *tokens[first + 1 :]])


_EMAIL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")
_NUMBER = regex.compile(r"(\b(?:\d{1,3}\.){3}\d{1,3}\b)|\+?\d[\d ()-]{7,}\d")
_TOKEN = regex.compile(r"[A-Za-z0-9_-]{24,}")


def cleaning_edits(text: str) -> list[tuple[int, int, str]]:
    """Edits that mask personal data and secrets and drop a line that repeats the one before, last edit first.

    Masked: e-mail addresses, IPv4 addresses, phone numbers, and unbroken runs of 24 or more letters and digits that
    hold a digit or capital past their first sign.
    """
    found = [(m.start(), m.end(), "<email>") for m in _EMAIL.finditer(text)] if "@" in text else []
    found += [(m.start(), m.end(), "<ip>" if m[1] else "<phone>") for m in _NUMBER.finditer(text)]
    found += [(m.start(), m.end(), "<secret>") for m in _TOKEN.finditer(text) if not m[0][1:].islower()]
    at, before = 0, None
    for line in text.splitlines(keepends=True):
        if line == before:
            found.append((at, at + len(line), ""))
        before, at = line, at + len(line)
    out, reach = [], 0
    for a, b, new in sorted(found, key=lambda e: (e[0], -e[1])):
        if a >= reach:
            out.append((a, b, new))
            reach = b
    return out[::-1]


def _whole(n) -> int:
    return 0 if n is None or n != n else int(n)


_LOADED: dict[tuple[str, str], ByteBpe] = {}


def _bpe(vocabulary: str, pattern: str) -> ByteBpe:
    """One instance a worker process."""
    if (vocabulary, pattern) not in _LOADED:
        _LOADED[vocabulary, pattern] = ByteBpe(vocabulary, pattern)
    return _LOADED[vocabulary, pattern]


def _edits(rows) -> list[tuple[int, int, str]]:
    return [(_whole(e["start"]), _whole(e["stop"]), e["text"] or "") for e in (rows if rows is not None else []) if e is not None]


def token_trees(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text, n_tokens, tree) for every row of ``docs(doc_id, text)``; a null text is kept as empty.

    Repeated rows fare alike; other columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    @F.pandas_udf("n_tokens long, tree binary")
    def built(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(vocabulary, pattern)
        for texts in batches:
            trees = [TokenTree(t, bpe) for t in texts]
            yield pd.DataFrame({"n_tokens": [t.total for t in trees], "tree": [t.dump() for t in trees]})

    rows = only(docs, "doc_id", "text").withColumn("text", F.coalesce("text", F.lit(""))).withColumn("t", built("text"))
    return rows.select("doc_id", "text", "t.n_tokens", "t.tree")


def edit_trees(trees: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """(doc_id, text, n_tokens, tree, n_pretokens, n_recounted) after the ``edits`` of each row of ``trees``.

    ``trees(doc_id, text, tree, edits)`` is what ``token_trees`` or this function gave, joined with edits (as in
    ``edited_counts``; null: none). Only pre-tokens that the edits touch are encoded: ``n_recounted`` of ``n_pretokens``.
    """
    small_batches(trees.sparkSession)

    @F.pandas_udf("text string, n_tokens long, tree binary, n_pretokens long, n_recounted long")
    def edited(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        bpe = _bpe(vocabulary, pattern)
        for texts, kept, edits in batches:
            out = []
            for text, data, todo in zip(texts, kept, edits):
                tree = TokenTree.load(text, data, bpe)
                parts, some = sum(map(len, tree.leaves)), _edits(todo)
                for e in some:
                    tree.edit(*e)
                out.append((tree.text() if some else text, tree.total, tree.dump() if some else data, parts, tree.recounted))
            yield pd.DataFrame(out, columns=["text", "n_tokens", "tree", "n_pretokens", "n_recounted"])

    return only(trees, "doc_id", "text", "tree", "edits").select("doc_id", edited("text", "tree", "edits").alias("t")).select("doc_id", "t.*")


def edited_counts(docs: DataFrame, vocabulary: str, pattern: str, edits: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_edits, n_tokens_after, n_pretokens, n_recounted) for every row of ``docs(doc_id, text)``.

    ``edits`` names a column of ``docs`` (array of struct<start int, stop int, text string>, each in the coordinates that
    the edits before it leave) whose edits are applied; without it, ``cleaning_edits`` are. A null text counts as empty; null edits are
    none, and a null inside an edit is 0 or the empty text. Repeated rows fare alike; other columns are ignored.
    """
    small_batches(docs.sparkSession)
    given = edits is not None

    def one(text: str | None, edits) -> tuple[int, ...]:
        bpe = _bpe(vocabulary, pattern)
        text = text or ""
        tree = TokenTree(text, bpe)
        before, parts = tree.total, sum(map(len, tree.leaves))
        todo = _edits(edits) if given else cleaning_edits(text)
        for e in todo:
            tree.edit(*e)
        return before, len(todo), tree.total, parts, tree.recounted

    names = ["n_tokens", "n_edits", "n_tokens_after", "n_pretokens", "n_recounted"]

    @F.pandas_udf(", ".join(f"{n} long" for n in names))
    def counted(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for columns in batches:
            texts, todo = columns[0], columns[1] if given else [None] * len(columns[0])
            yield pd.DataFrame([one(t, e) for t, e in zip(texts, todo)], columns=names)

    rows = only(docs, "doc_id", "text", *([edits] if given else []))
    kept = rows.withColumn("c", counted("text", edits) if given else counted("text", F.lit(0)))
    return kept.select("doc_id", "c.*")
