"""A minimal acyclic transducer: sorted words to their numbers, with shared suffixes, in flat arrays that can be memory-mapped."""

from __future__ import annotations

import mmap
import os
from collections.abc import Iterable
from zlib import crc32

import numpy as np


#: Spreads arcs over the slots of their table.
SPREAD = 40503
#: Bits for each word in the sieve, at least: a word that isn't in the lexicon passes it with a chance of about 1/SIEVE.
SIEVE = 32


def compile_words(words: Iterable[tuple[bytes, list[int]]]) -> bytes:
    """Compile words, none of them empty, with their id sequences.

    States are merged when their finality and arcs agree, so words share suffixes.  An
    arc's output is the number of words that sort before those behind it; the outputs
    along a path add up to the word's number, by which its ids are found.
    """
    entries = sorted(dict(words).items())
    register: dict[tuple, int] = {}
    arcs: list[dict[int, int]] = []
    final: list[bool] = []

    def state() -> int:
        arcs.append({})
        final.append(False)
        return len(arcs) - 1

    def settle(path: list[tuple[int, int, int]], keep: int) -> None:
        while len(path) > keep:
            parent, label, child = path.pop()
            arcs[parent][label] = register.setdefault((final[child], tuple(arcs[child].items())), child)

    root, before, path = state(), b"", []
    for word, _ in entries:
        same = len(os.path.commonprefix([word, before]))
        settle(path, same)
        at = path[-1][2] if path else root
        for label in word[same:]:
            path.append((at, label, at := state()))
        final[at] = True
        before = word
    settle(path, 0)

    words_below: dict[int, int] = {}
    order, seen = [], set()
    stack = [(root, False)]
    while stack:  # children before parents
        at, done = stack.pop()
        if done:
            words_below[at] = final[at] + sum(words_below[x] for x in arcs[at].values())
            order.append(at)
        elif at not in seen:
            seen.add(at)
            stack += [(at, True), *((x, False) for x in arcs[at].values() if x not in seen)]
    number = {s: k for k, s in enumerate(reversed(order))}  # the root is 0
    n_arcs = sum(len(arcs[s]) for s in order)
    slots = 1 << max(4, (2 * n_arcs).bit_length())
    table = np.zeros((4, slots), np.uint32)  # of each arc: state and label, next state, whether that is final, output
    for s in order:
        out = int(final[s])
        for label, child in sorted(arcs[s].items()):
            key = number[s] * 256 + 1 + label
            k = key * SPREAD & slots - 1
            while table[0, k]:
                k = (k + 1) & slots - 1
            table[:, k] = key, number[child] * 256 + 1, final[child], out
            out += words_below[child]
    starts = np.cumsum([0, *(len(ids) for _, ids in entries)], dtype=np.uint32)
    ids = np.array([i for _, ids in entries for i in ids], np.uint32)
    bits = 1 << (SIEVE * len(entries) + 32).bit_length()
    sieve = np.zeros(bits // 8, np.uint8)
    for word, _ in entries:
        place = crc32(word) & bits - 1
        sieve[place >> 3] |= 1 << (place & 7)
    head = np.array([slots, len(entries), len(ids), len(order), bits], np.uint32)
    return b"".join(x.tobytes() for x in (head, table, starts, ids, sieve))


class Lexicon:
    """A compiled transducer, mapped from an anonymous memory file: no local folder is used."""

    def __init__(self, compiled: bytes):
        fd = os.memfd_create("lexicon")
        try:
            os.write(fd, compiled) if len(compiled) < 1 << 30 else os.writev(fd, [compiled])
            view = memoryview(mmap.mmap(fd, len(compiled), access=mmap.ACCESS_READ)).cast("I")
        finally:
            os.close(fd)
        self.slots, self.words, n_ids, self.states, bits = view[:5]
        self.keys, self.next, self.final, self.out = (view[5 + k * self.slots :][: self.slots] for k in range(4))
        self.starts = view[5 + 4 * self.slots :][: self.words + 1]
        self.ids = view[5 + 4 * self.slots + self.words + 1 :][:n_ids]
        self.sieve, self.last = view[5 + 4 * self.slots + self.words + 1 + n_ids :].cast("B"), bits - 1

    def find(self, word: bytes) -> list[int] | None:
        """The ids of a word of the lexicon, else None; most other words don't pass the sieve, and need no walk."""
        place = crc32(word) & self.last
        if not self.sieve[place >> 3] >> (place & 7) & 1:
            return None
        keys, follow, last, at, path = self.keys, self.next, self.slots - 1, 1, []
        for label in word:
            key = at + label
            k = key * SPREAD & last
            while (found := keys[k]) != key:
                if not found:
                    return None
                k = k + 1 & last
            path.append(k)
            at = follow[k]
        if not path or not self.final[k]:
            return None
        number = sum(map(self.out.__getitem__, path))
        return self.ids[self.starts[number] : self.starts[number + 1]].tolist()
