"""Operator 5: exact token counts by prefix dynamic programming.

A byte-pair encoding is the one segmentation whose neighbouring tokens all stay apart
when the merges run.  So the encoding of a prefix of a piece ends in the one token that
is compatible with the last token of the shorter prefix before it, and its count is
that prefix's count plus one.  The table of a piece therefore holds the exact count at
every prefix, and a text's table is the running sum over its pieces: truncation and
budget questions need no second encoding.  An Aho-Corasick automaton of the vocabulary
names the tokens that end at each byte, so no other substring is looked up.

Cases: a null text counts as empty (0 bytes, 0 tokens); white space, very long words
and special strings count as the library counts them; repeated rows each give a row;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .bpe import Memo, Merges, vocabulary_path
from .shared import arrow_rows, lean, memos

VOCABULARY = "byte_bpe_50k.json"
LIMIT = 512

#: Fixed value: the pattern by which byte-level vocabularies cut a text into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Characters for which `regex` and the library surely agree; texts with others are cut by the library.
PLAIN = re.compile(r"[\x09-\x0D\x20-\x7E¡-ɏ‐-‧‰-⁞€]*")
#: White space within a plain text other than single spaces and single line feeds between words.
IRREGULAR = ("  ", "\n\n", " \n", "\n ", "\t", "\x0b", "\x0c", "\r")


class PrefixCounter:
    """Counts of one vocabulary; one for each Python worker."""

    def __init__(self, path: str, memo: int = 200_000):
        from tokenizers import Tokenizer

        merges = Merges(path)
        byte = {c: b for b, c in enumerate(merges.characters)}
        self.ending = ahocorasick.Automaton()
        for spelt, i in merges.ids.items():
            self.ending.add_word(bytes(map(byte.__getitem__, spelt)).decode("latin-1"), (i, len(spelt)))
        self.ending.make_automaton()
        self.pairs = {pair: rank for pair, (rank, _) in merges.pairs.items()}
        self.born = {merged: rank for rank, merged in merges.pairs.values()}
        self.parts = {merged: pair for pair, (_, merged) in merges.pairs.items()}
        self.special = re.compile("|".join(map(re.escape, sorted(merges.special, key=len, reverse=True))) or r"(?!)")
        self.marker = merges.marker
        self.cut = regex.compile(PIECES)
        self.library = Tokenizer.from_file(path).pre_tokenizer
        self.unspell = byte
        self.spines: dict[tuple[int, int], list[tuple[int, float]]] = {}
        self.apart = Memo(self._apart, memo)
        self.counts = Memo(self._count, memo)
        self.chunks = Memo(self._chunk, memo)

    def spine(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens at one end (side 0: the left one) as a token grows, each with the rank at which it's absorbed."""
        found = self.spines.get((token, side))
        if found is None:
            found, until, at = [], float("inf"), token
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.born[at], self.parts[at][side]
            found.reverse()
            self.spines[token, side] = found
        return found

    def _apart(self, key: int) -> int:
        """1 if two neighbouring tokens stay apart, else 0: runs the merges at the seam in the order of their ranks."""
        left, right = self.spine(key >> 20, 1), self.spine(key & 0xFFFFF, 0)
        i = j = 0
        while True:
            (a, gone_a), (b, gone_b) = left[i], right[j]
            rank = self.pairs.get((a, b))
            # of merges of equal rank the leftmost runs first: the left token's own, the seam's, the right token's own
            if rank is not None and rank < gone_a and rank <= gone_b:
                return 0
            if i + 1 == len(left) and j + 1 == len(right):
                return 1
            if gone_a <= gone_b:
                i += 1
            else:
                j += 1

    def table(self, piece: bytes) -> list[int]:
        """The exact token count of every prefix of a piece, from the empty one on."""
        apart, done = self.apart, 0
        last, count = [-1] * (len(piece) + 1), [0] * (len(piece) + 1)
        for at, (token, size) in self.ending.iter(piece.decode("latin-1")):
            start = at + 1 - size
            if at >= done and (start == 0 or apart[last[start] << 20 | token]):
                done = at + 1
                last[done], count[done] = token, count[start] + 1
        return count

    def _count(self, piece: str) -> int:
        return self.table(piece.encode("utf-8"))[-1]

    def _chunk(self, chunk: str) -> int:
        """Tokens of a word of a plain text, with the space before it if there is one."""
        if chunk[chunk[:1] == " " :].isalpha():  # one piece; it comes again in this form, if at all
            return self._count(chunk)
        return sum(map(self.counts.__getitem__, self.cut.findall(chunk)))

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text without special strings; of unusual ones by the library's own cutter."""
        if PLAIN.fullmatch(text):
            return self.cut.findall(text)
        return [bytes(self.unspell[c] for c in piece).decode("utf-8") for piece, _ in self.library.pre_tokenize_str(text)]

    def segments(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text between special strings, and these, in order."""
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], False
            yield m[0], True
            at = m.end()
        yield text[at:], False

    def count(self, text: str) -> int:
        if self.marker in text:
            return sum(1 if special else self._plain(part) for part, special in self.segments(text))
        return self._plain(text)

    def _plain(self, text: str) -> int:
        """Between single spaces and single line feeds the pieces of one word depend on no other word."""
        if not PLAIN.fullmatch(text) or text.startswith((" ", "\n")) or text.endswith((" ", "\n")) or any(s in text for s in IRREGULAR):
            return sum(map(self.counts.__getitem__, self.pieces(text)))
        lines = text.split("\n")
        total = (len(lines) - 1) * self.counts["\n"]
        for line in lines:
            first, *rest = line.split(" ")
            total += self.chunks[first] + sum(map(self.chunks.__getitem__, [" " + w for w in rest]))
        return total

    def prefix_counts(self, text: str) -> tuple[list[int], list[int]]:
        """Byte offsets at which pieces end and the exact counts up to them."""
        ends, counts = [0], [0]
        for part, special in self.segments(text):
            for piece in [part] if special else self.pieces(part):
                ends.append(len(piece.encode("utf-8")))
                counts.append(1 if special else self.counts[piece])
        return list(accumulate(ends)), list(accumulate(counts))

    def truncated(self, text: str, budget: int) -> int:
        """Bytes of the longest prefix of whole pieces, then of a piece's own prefix, within a budget of tokens."""
        used = at = 0
        for part, special in self.segments(text):
            for piece in [part] if special else self.pieces(part):
                spelt = piece.encode("utf-8")
                table = [0, 1] if special else self.table(spelt)
                if used + table[-1] > budget:
                    inside = 0 if special else max(k for k, n in enumerate(table) if used + n <= budget)
                    while inside and inside < len(spelt) and spelt[inside] & 0xC0 == 0x80:  # not within a character
                        inside -= 1
                    return at + inside
                used, at = used + table[-1], at + len(spelt)
        return at


def counter(path: str) -> PrefixCounter:
    counters = memos("counter")
    if path not in counters:
        counters[path] = PrefixCounter(path)
    return counters[path]


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens) of every row; no shuffle."""
    arrow_rows(docs.sparkSession)
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            tokens = pa.array(map(count, texts), pa.int64())
            sizes = pa.array([len(t.encode("utf-8")) for t in texts], pa.int64())
            over = pa.array([n > limit for n in tokens.to_pylist()], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, tokens, over], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    docs = docs.select(docs["doc_id"].cast("long"), docs["text"])
    return docs.mapInArrow(lean(run, "counter"), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def truncated_texts(docs: DataFrame, budget: int, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and the longest prefix of each text that a budget of tokens holds, by the same prefix tables."""
    arrow_rows(docs.sparkSession)
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = counter(path).truncated
        for batch in batches:
            texts = [(t or "") for t in batch.column(1).to_pylist()]
            kept = [t.encode("utf-8")[: cut(t, budget)].decode("utf-8") for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], ["doc_id", "text"])

    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lean(run, "counter"), "doc_id long, text string")
