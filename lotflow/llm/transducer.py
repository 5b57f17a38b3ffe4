"""A minimal acyclic transducer from words to token ids, in arrays that are mapped from a file.

Words are added in byte order, and a state is shared with an equal one as soon as no later word can change it, so
common endings are stored once. An arc carries a number; their sum along a word's path is the word's place in byte
order, which points into the table of id sequences. Arcs lie sorted by (state, byte), so many words are walked at once,
one byte a step, by binary search.
"""

from __future__ import annotations

import mmap
from collections.abc import Sequence

import numpy as np

_ARRAYS = (("keys", np.int64), ("targets", np.int32), ("outputs", np.int32), ("final", np.uint8), ("starts", np.int32), ("ids", np.uint32))


def compile_lexicon(words: Sequence[bytes], ids: Sequence[Sequence[int]]) -> bytes:
    """The transducer of distinct ``words``, in byte order, with their ``ids``, as one block of bytes."""
    register: dict[tuple, int] = {}
    arcs: list[tuple] = []  # of registered states: ((byte, target), ...), in byte order
    final: list[bool] = []
    below: list[int] = []  # how many words can be read from a state

    def settle(node: list) -> int:
        """The number of a finished state; an equal one that exists is taken for it."""
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(arcs)
            arcs.append(key[1])
            final.append(key[0])
            below.append(key[0] + sum(below[t] for _, t in key[1]))
        return register[key]

    path: list[list] = [[False, []]]  # the open states of the last word: [final, finished arcs]
    last = b""
    for word in words:
        if word <= last and (word or last):
            raise ValueError("words have to be distinct and in byte order")
        same = next((k for k, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        for k in range(len(last), same, -1):
            done = settle(path.pop())
            path[-1][1].append((last[k - 1], done))
        path += [[False, []] for _ in range(len(word) - same)]
        path[-1][0] = True
        last = word
    for k in range(len(last), 0, -1):
        done = settle(path.pop())
        path[-1][1].append((last[k - 1], done))
    root = settle(path[0])

    states = np.repeat(np.arange(len(arcs)), [len(a) for a in arcs])
    flat = [x for a in arcs for x in a]
    outputs = []
    for a, end in zip(arcs, final):
        n = int(end)
        for _, target in a:
            outputs.append(n)
            n += below[target]
    keys = states * 256 + np.array([b for b, _ in flat], dtype=np.int64)
    blocks = [keys, [t for _, t in flat], outputs, final, np.cumsum([0, *map(len, ids)]), [i for seq in ids for i in seq]]
    blocks = [np.asarray(b, dtype=kind) for b, (_, kind) in zip(blocks, _ARRAYS)]
    head = np.array([root, *map(len, blocks)], dtype=np.int64)
    padded = [b.tobytes() + bytes(-b.nbytes % 8) for b in blocks]
    return b"".join([head.tobytes(), *padded])


class Lexicon:
    """A compiled transducer, read from a mapped file or from bytes."""

    def __init__(self, data: bytes | mmap.mmap):
        head = np.frombuffer(data, np.int64, 1 + len(_ARRAYS))
        self.root, at = int(head[0]), head.nbytes
        for (name, kind), n in zip(_ARRAYS, head[1:].tolist()):
            setattr(self, name, np.frombuffer(data, kind, n, at))
            at += -(-n * np.dtype(kind).itemsize // 8) * 8

    @classmethod
    def mapped(cls, path: str) -> Lexicon:
        with open(path, "rb") as f:
            return cls(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))

    def places(self, words: Sequence[str]) -> np.ndarray:
        """The place of each word in byte order, -1 for those that the lexicon lacks."""
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        text = np.frombuffer("".join(words).encode(), np.uint8)
        if len(words) and len(text) > ends[-1]:  # from characters to bytes
            ends = np.r_[np.flatnonzero((text & 0xC0) != 0x80), len(text)][ends]
        begins = np.r_[0, ends[:-1]]
        lengths = ends - begins
        place = np.zeros(len(words), np.int64)
        state = np.full(len(words), self.root, np.int64)
        here = np.flatnonzero(lengths > 0)
        k = 0
        while len(here):
            wanted = state[here] * 256 + text[begins[here] + k]
            arc = np.searchsorted(self.keys, wanted)
            found = arc < len(self.keys)
            found[found] = self.keys[arc[found]] == wanted[found]
            place[here[~found]] = -1
            here, arc = here[found], arc[found]
            state[here] = self.targets[arc]
            place[here] += self.outputs[arc]
            k += 1
            here = here[lengths[here] > k]
        ended = place >= 0
        place[ended] = np.where(self.final[state[ended]] > 0, place[ended], -1)
        return place

    def outputs_of(self, places: np.ndarray) -> list[bytes]:
        """The ids at each place, as little-endian unsigned 32-bit numbers."""
        data = self.ids.astype("<u4").tobytes() if not hasattr(self, "_data") else self._data
        self._data = data
        return [data[4 * a : 4 * b] for a, b in zip(self.starts[places].tolist(), self.starts[places + 1].tolist())]
