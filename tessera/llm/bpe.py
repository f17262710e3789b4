"""Byte-pair vocabularies read from the tokenizers library's .json files, and a bounded memo."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Callable
from itertools import repeat

import public_tokenizers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


def vocabulary_path(name: str) -> str:
    """The place of a vocabulary file; an absolute path is taken as it is."""
    return name if os.path.isabs(name) else public_tokenizers.path(name)


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable Latin-1 ones
    stand for themselves, all others take the code points from 256 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


#: Longer texts aren't remembered: they seldom come again, and a memo's memory is bounded by its entries.
LONGEST = 64


class Memo(dict):
    """A memo of at most 2 * cap results in two generations: frequent keys survive, memory is bounded."""

    def __init__(self, compute: Callable, cap: int):
        self.compute, self.cap, self.old = compute, cap, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
            if type(key) is str and len(key) > LONGEST:
                return value
        if len(self) >= self.cap:
            self.old = self.copy()
            self.clear()
        self[key] = value
        return value


class Merges:
    """Vocabulary and merges of one .json file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        self.tokens = {i: t for t, i in self.ids.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        #: What every special string begins with; empty if they share nothing.
        self.marker = os.path.commonprefix(list(self.special)) if self.special else "\0no special string"
        for text, i in self.special.items():
            self.tokens[i] = text
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}  # pair -> rank, merged id
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.ranks = {pair: rank for pair, (rank, _) in self.pairs.items()}
        self.made = [0] * len(model["merges"])  # by rank
        for rank, merged in self.pairs.values():
            self.made[rank] = merged
        self.characters = byte_characters()
        self.inner = [self.ids[c] for c in self.characters]
        self.last = [self.ids[c + self.suffix] for c in self.characters]

    def symbols(self, piece: str) -> list[int]:
        """Ids of a word's bytes; the last one carries the end-of-word suffix, if the model has one."""
        spelt = piece.encode("utf-8")
        found = list(map(self.inner.__getitem__, spelt))
        found[-1] = self.last[spelt[-1]]
        return found

    def merge(self, word: list[int]) -> list[int]:
        """The exact encoding of one word: lowest rank first, leftmost first among equals."""
        return self._merge_short(word) if len(word) <= 48 else self._merge_long(word)

    def _merge_short(self, word: list[int]) -> list[int]:
        rank, made, none = self.ranks.get, self.made, len(self.made)
        ranks = list(map(rank, zip(word, word[1:], strict=False), repeat(none)))
        while ranks and (best := min(ranks)) < none:
            k = ranks.index(best)
            word[k : k + 2] = [made[best]]
            del ranks[k]
            if k:
                ranks[k - 1] = rank((word[k - 1], word[k]), none)
            if k < len(ranks):
                ranks[k] = rank((word[k], word[k + 1]), none)
        return word

    def _merge_long(self, word: list[int]) -> list[int]:
        """As above in O(n log n), for words of any length: a heap of pairs over a linked list."""
        n, find = len(word), self.pairs.get
        right, left, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def push(k: int) -> None:
            if k >= 0 and right[k] < n and (found := find((word[k], word[right[k]]))):
                heapq.heappush(heap, (found[0], k, word[k], word[right[k]]))

        for k in range(n - 1):
            push(k)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            j = right[k] if alive[k] else n
            if j >= n or word[k] != a or word[j] != b:
                continue
            word[k], alive[j], right[k] = find((a, b))[1], False, right[j]
            if right[k] < n:
                left[right[k]] = k
            push(left[k])
            push(k)
        return [x for x, live in zip(word, alive, strict=True) if live]
