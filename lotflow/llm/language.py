"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language, over all letters of that text. A document is parsed
greedily into the longest phrases that occur in that text; a letter that the language's text lacks closes the phrase it
follows and counts as one more. The language that needs the fewest phrases wins. The parse starts anew every ``segment`` characters, alike for
all languages, so that many segments step through the automata together as arrays. Whole texts are parsed.

Transitions are kept sparsely, as a double array: about 3 x ``train_chars`` entries a language, whatever its alphabet.

Bound on what is fitted: ``train_chars`` characters a language, at most ``all_chars`` together, from at most
``sample_rows`` labelled rows a language chosen by a hash of the id; a row longer than ``sample_chars`` gives a slice of
that length from a hashed place. The thousand most frequent languages are learned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lotflow.llm.arrow import only, small_batches
from lotflow.llm.quality import HELD_OUT
from lotflow.llm.sampling import class_counts, hashed_sample, slice_of

UNKNOWN = "und"
_SPACE, _OTHER = 0, 1
_AT_ONCE = 1 << 20


def _letters() -> np.ndarray:
    """For every code point, whether it is a letter."""
    table = np.zeros(0x110000, dtype=bool)
    table[[c for c in range(0x110000) if chr(c).isalpha()]] = True
    return table


class Automaton:
    """Suffix automaton of ``codes`` as arrays; ``_OTHER`` ends a text and never continues a phrase.

    The transition of state s by code c stands at ``base[s] + c`` if ``owner`` is s there; else there is none, and a new
    phrase starts at ``start[c]``.
    """

    def __init__(self, codes: list[int], alphabet: int):
        follow = _suffix_states(codes)
        self.start = np.zeros(alphabet, dtype=np.int32)
        for c, s in follow[0].items():
            self.start[c] = s
        size = sum(map(len, follow)) + 2 * alphabet + 1
        free, hint, used = alphabet, alphabet, bytearray(size)
        self.base = np.zeros(len(follow), dtype=np.int32)
        self.owner, self.next = np.full(size, -1, dtype=np.int32), np.zeros(size, dtype=np.int32)
        for s in sorted(range(len(follow)), key=lambda s: -len(follow[s])):
            codes_of = sorted(follow[s])
            if not codes_of:
                break
            if len(codes_of) > 1:  # those with few ways out come last and fill what is left
                at = used.index(0, hint)
            else:
                at = free = used.index(0, free)
            tries = 0
            while True:
                base = at - codes_of[0]
                top = base + codes_of[-1]
                if top + 1 >= len(used):
                    used.extend(bytes(top + 2 * alphabet - len(used)))
                if not any(used[base + c] for c in codes_of):
                    break
                at, tries = used.index(0, at + 1), tries + 1
            if tries > 8:
                hint = at
            self.base[s] = base
            if len(used) > len(self.owner):
                self.owner = np.r_[self.owner, np.full(len(used) - len(self.owner), -1, np.int32)]
                self.next = np.r_[self.next, np.zeros(len(used) - len(self.next), np.int32)]
            for c in codes_of:
                used[base + c] = 1
                self.owner[base + c], self.next[base + c] = s, follow[s][c]
        room = int(self.base.max()) + alphabet + 1 - len(self.owner)
        if room > 0:
            self.owner, self.next = np.r_[self.owner, np.full(room, -1, np.int32)], np.r_[self.next, np.zeros(room, np.int32)]

    def step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the phrases that ended."""
        at = self.base.take(state)
        at += codes
        broke = self.owner.take(at) != state
        first = self.start.take(codes)
        return np.where(broke, first, self.next.take(at)), broke.astype(np.int32) + (broke & (first == 0))


def _suffix_states(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the suffix automaton."""
    follow, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        if c == _OTHER:  # texts do not run into each other
            last = 0
            continue
        if c in follow[last] and length[follow[last][c]] == length[last] + 1:
            last = follow[last][c]
            continue
        cur = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in follow[p]:
            follow[p][c] = cur
            p = link[p]
        if p != -1:
            q = follow[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return follow


class CrossParser:
    """Automata of all languages over one alphabet; built once in each worker process from the training texts."""

    def __init__(self, samples: dict[str, list[str]], segment: int = 512):
        self.languages, self.segment = sorted(samples), segment
        letters = _letters()
        points = np.unique(np.concatenate([self._points(t) for texts in samples.values() for t in texts] or [np.zeros(0, np.uint32)]))
        known = points[letters[points]]
        self.code = np.where(letters, _OTHER, _SPACE).astype(np.int32)
        self.code[known] = np.arange(2, 2 + len(known), dtype=np.int32)
        self.automata = [Automaton([int(c) for t in samples[x] for c in [*self._codes(t), _OTHER]], 2 + len(known)) for x in self.languages]

    @staticmethod
    def _points(text: str) -> np.ndarray:
        return np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)

    def _codes(self, text: str) -> np.ndarray:
        """Letters as codes, any run of other characters as one space."""
        codes = self.code[self._points(text)]
        return codes[np.r_[True, (codes[1:] != _SPACE) | (codes[:-1] != _SPACE)]] if len(codes) else codes

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each text needs (rows) in each language (columns); letters in each text."""
        coded = [self._codes(t) for t in texts]
        flat = np.concatenate([*coded, np.zeros(1, np.int32)])
        begin = np.cumsum([0, *map(len, coded)])
        lanes = [-(-len(c) // self.segment) for c in coded]
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = begin[:-1][owner] + self.segment * (np.arange(len(owner)) - np.repeat(np.cumsum([0, *lanes])[:-1], lanes))
        width = np.minimum(self.segment, begin[1:][owner] - first)
        order = np.argsort(-width, kind="stable")
        owner, first, width = owner[order], first[order], width[order]
        active = np.searchsorted(-width, -np.arange(1, self.segment + 1), "right")
        state = np.zeros((len(self.automata), len(owner)), dtype=np.int32)
        count = np.zeros((len(self.automata), len(owner)), dtype=np.int32)
        for step in range(int(width[0]) if len(width) else 0):
            n = active[step]
            at = flat[first[:n] + step]
            for s, seen, automaton in zip(state, count, self.automata):
                s[:n], ended = automaton.step(s[:n], at)
                seen[:n] += ended
        count += state != 0
        total = np.zeros((len(texts), len(self.automata)))
        for k, seen in enumerate(count):
            total[:, k] = np.bincount(owner, weights=seen, minlength=len(texts))
        return total, np.array([np.count_nonzero(c) for c in coded])

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text: the share by which the winner needs fewer phrases than the runner-up."""
        if not self.languages:
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        whole = [t or "" for t in texts]
        ends = np.cumsum([0, *map(len, whole)]) // _AT_ONCE  # so many characters at once, to bound memory
        cuts = [0, *(np.flatnonzero(np.diff(ends[:-1])) + 1), len(whole)]
        parts = [self.phrases(whole[a:b]) for a, b in zip(cuts, cuts[1:]) if a < b]
        if not parts:
            return [], np.zeros(0)
        total, letters = (np.concatenate(x) for x in zip(*parts))
        best = total.argmin(axis=1)
        ranked = np.sort(total, axis=1)
        score = 1 - ranked[:, 0] / np.maximum(ranked[:, 1], 1) if len(self.languages) > 1 else np.ones(len(texts))
        return [self.languages[b] if n else UNKNOWN for b, n in zip(best, letters)], np.where(letters > 0, score, 0.0)


_BUILT: dict[int, CrossParser] = {}


def _parser(samples: dict[str, list[str]], segment: int) -> CrossParser:
    key = hash((segment, *((k, *v) for k, v in sorted(samples.items()))))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = CrossParser(samples, segment)
    return _BUILT[key]


def sample(docs: DataFrame, train_chars: int = 20_000, all_chars: int = 400_000, sample_chars: int = 5_000, sample_rows: int = 200) -> dict[str, list[str]]:
    """Labelled training text of each language from rows that are not held out.

    What comes to the driver is ``train_chars`` characters a language, or a like share of ``all_chars`` where there are
    many, and ``sample_chars`` more at most.
    """
    rows = only(docs, "doc_id", "text", "lang").where(f"lang is not null and doc_id is not null and length(text) > 0 and not {HELD_OUT}")
    counts = class_counts(rows, "lang")
    room = max(1, min(train_chars, all_chars // max(1, len(counts))))
    chosen = hashed_sample(rows, "lang", sample_rows, ("doc_id", "text"), "lang", counts).withColumn("text", slice_of("text", sample_chars))
    before = F.coalesce(F.expr("sum(length(text)) over (partition by lang order by place rows between unbounded preceding and 1 preceding)"), F.lit(0))
    found: dict[str, list[str]] = {}
    for lang, text in chosen.withColumn("before", before).where(F.col("before") < room).orderBy("lang", "place").select("lang", "text").collect():
        found.setdefault(lang, []).append(text)
    kept = {}
    for lang, texts in found.items():
        before = np.cumsum([0, *map(len, texts)])
        kept[lang] = [t[: room - b] for t, b in zip(texts, before) if b < room]
    return kept


def _predicted(docs: DataFrame, segment: int, params: dict):
    """The trained prediction as a function of a text column."""
    small_batches(docs.sparkSession)
    samples = sample(docs, **params)

    @F.pandas_udf("lang_pred string, score double")
    def predicted(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        parser = _parser(samples, segment)
        for batch in texts:
            lang, score = parser.predict(batch.tolist())
            yield pd.DataFrame({"lang_pred": lang, "score": score})

    return predicted


def identify(docs: DataFrame, segment: int = 512, **params) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of ``docs(doc_id, text, lang)``.

    ``und`` with score 0 for a null text, a text without a letter, and every text if nothing is labelled. Ties go to the
    first language by code point, with score 0. A row with a null id is predicted and is not held out. Repeated rows
    fare alike; other columns are ignored; an empty table gives an empty result.
    """
    predicted = _predicted(docs, segment, params)
    rows = only(docs, "doc_id", "text").withColumn("found", predicted("text"))
    return rows.select("doc_id", F.expr(HELD_OUT).alias("held_out"), "found.lang_pred", "found.score")


def told(docs: DataFrame, least: float = 0.0, segment: int = 512, **params) -> DataFrame:
    """The rows of ``docs`` whose language can be told, as they are, with the language where ``lang`` was null.

    ``und`` and scores below ``least`` go: the runner-up needs hardly more phrases. All columns of ``docs`` come back,
    whatever their names; rows are odd in the ways of ``identify``.
    """
    predicted = _predicted(docs, segment, params).asNondeterministic()  # else the plan would run it for the filter and again for the result
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")).withColumn("found", predicted("row.text"))
    kept = rows.where((F.col("found.lang_pred") != UNKNOWN) & (F.col("found.score") >= least))
    return kept.withColumn("row", F.col("row").withField("lang", F.coalesce("row.lang", "found.lang_pred"))).select("row.*")
