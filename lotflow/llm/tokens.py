"""Token ids of whole texts for the public word BPE vocabulary, exactly as its own library gives them, at cache speed.

A text is split at white space, which that tokenizer drops, so every piece between is encoded on its own; pieces are
kept in a bounded dictionary. A missing piece is cut by the tokenizer's pattern and its parts are merged by a
byte-pair engine over the same vocabulary, in which a space byte stands for the end of a word. Texts that hold the
vocabulary's special tokens, or code points that Python's Unicode tables lack, take the library's own path.
"""

from __future__ import annotations

import functools
import itertools
import json
import unicodedata

import numpy as np
import regex
import tiktoken
from tokenizers import Tokenizer

#: Fixed value: the pre-token pattern that the vocabulary file states.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+"
_END = "</w>"
_LONG = 1 << 16
#: White space to str.split, but not to the tokenizer.
_SEPARATORS = "\x1c\x1d\x1e\x1f"
#: Signs that stand alone as a pre-token after a word.
_CLOSING = frozenset(".,!?;:#$%&*()-")


def _byte_of() -> dict[str, int]:
    """Byte-level BPE's printable stand-in of each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


@functools.cache
def _unassigned() -> np.ndarray:
    """For every code point, whether Python's Unicode tables lack it; the tokenizer's may know it."""
    return np.array([unicodedata.category(chr(c)) == "Cn" for c in range(0x110000)])


def _newer(text: str) -> bool:
    """Whether a text holds a code point that Python's tables lack."""
    try:
        text.encode("latin-1")
        return False
    except UnicodeEncodeError:
        return bool(_unassigned()[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)].any())


class WordBpe:
    """Ids of texts; ``path`` is the vocabulary file in the tokenizers library's form."""

    def __init__(self, path: str, cached: int = 400_000):
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        byte_of, ranks = _byte_of(), {}
        for token, rank in vocab.items():
            if token not in self.special:
                ends = token.endswith(_END) and token != _END
                ranks[bytes(byte_of[c] for c in (token[: -len(_END)] if ends else token)) + b" " * ends] = rank
        self.engine = tiktoken.Encoding("words", pat_str=r"[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.closes = np.zeros(max(ranks.values()) + 1, dtype=bool)
        self.closes[[rank for token, rank in ranks.items() if token.endswith(b" ")]] = True
        self.parts = regex.compile(PATTERN).findall
        self.cached, self.cache, self.older = cached, {}, {}

    def _learn(self, words: set[str]) -> None:
        """Have every word in the cache: from the older half, from its parts, or merged anew in one call."""
        if len(self.cache) + len(words) > self.cached:
            self.older, self.cache = self.cache, {}
        cache, older = self.cache, self.older
        missing = words.difference(cache)
        plain, mixed = [], []
        for w in missing:
            if w in older:
                cache[w] = older[w]
            elif w.isalpha():
                plain.append(w)
            elif w[-1] in _CLOSING and w[:-1].isalpha():
                mixed.append((w, (w[:-1], w[-1])))
            else:
                mixed.append((w, self.parts(w)))
        fresh = set(plain)
        for _, parts in mixed:
            fresh.update(parts)
        order = list(fresh.difference(cache))
        if order:
            ids = self.engine.encode_to_numpy(" ".join(order) + " ")
            ends = ((np.flatnonzero(self.closes[ids]) + 1) * 4).tolist()
            data = ids.astype("<u4").tobytes()
            cache.update(zip(order, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends))))
        for w, parts in mixed:
            cache[w] = b"".join([cache[p] for p in parts])

    def _words(self, text: str) -> list[str]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        if any(c in text for c in _SEPARATORS):
            return [w for w in regex.split(r"\p{White_Space}+", text.lower()) if w]
        return text.lower().split()

    def ids(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit numbers."""
        return self.ids_of([text])[0]

    def ids_of(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; what the cache lacks is learned for many texts at once."""
        out: list[bytes] = [b""] * len(texts)
        held, n = [], 0
        for k, text in enumerate(texts):
            if not text:
                continue
            if "<|" in text and any(s in text for s in self.special) or not text.isascii() and _newer(text):
                out[k] = np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
                continue
            words = self._words(text)
            held.append((k, words))
            n += len(words)
            if n >= _LONG:
                self._flush(held, out)
                held, n = [], 0
        self._flush(held, out)
        return out

    def _flush(self, held: list[tuple[int, list[str]]], out: list[bytes]) -> None:
        for k, words in held:
            if len(words) > _LONG:
                out[k] = b"".join([self._known(words[a : a + _LONG]) for a in range(0, len(words), _LONG)])
        some = [(k, words) for k, words in held if len(words) <= _LONG]
        self._learn(set(itertools.chain.from_iterable(words for _, words in some)))
        get = self.cache.__getitem__
        for k, words in some:
            out[k] = b"".join(map(get, words))

    def _known(self, words: list[str]) -> bytes:
        self._learn(set(words))
        return b"".join(map(self.cache.__getitem__, words))


_LOADED: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """One instance a worker process."""
    if path not in _LOADED:
        _LOADED[path] = WordBpe(path)
    return _LOADED[path]
