"""Operator 7: byte-pair encoding and decoding with a minimal acyclic transducer of frequent words.

All words of the corpus are counted; the `words` most frequent ones are encoded once
and compiled into a transducer with shared suffixes (lexicon.py), which every worker
maps into memory.  A word of the lexicon is read off the transducer, any other word is
merged exactly, so the lexicon's size changes speed and never the ids.

Cases: a null text counts as empty (0 tokens, the digests of nothing); special strings
in a text give their special id; very long words are merged in O(n log n); repeated rows
each give a row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Memo, Merges, vocabulary_path
from .lexicon import Lexicon, compile_words
from .shared import arrow_rows, discard, lean, memos, spare, written

VOCABULARY = "word_bpe_49k.json"
WORDS = 32_768
#: Distinct words that a task counts before it hands them on: bounds its memory.
COUNTED = 200_000

#: Fixed value: the pattern by which this vocabulary cuts lower-cased text into words.
WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Characters for which lower-casing, composition and cutting surely agree with the library's.
PLAIN = re.compile(r"[\x09-\x0D\x20-\x7E¡-įı-ſ‐-‧‰-⁞€]*")


class Codec:
    """Encodes and decodes with one vocabulary; one for each Python worker."""

    def __init__(self, path: str, compiled: bytes | None = None, memo: int = 250_000):
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        library = Tokenizer.from_file(path)
        self.normalizer, self.cutter = library.normalizer, library.pre_tokenizer
        self.unspell = {c: b for b, c in enumerate(self.merges.characters)}
        self.special = re.compile("|".join(map(re.escape, sorted(self.merges.special, key=len, reverse=True))) or r"(?!)")
        self.lexicon = Lexicon(compiled) if compiled else None
        self.cut = regex.compile(WORD)
        self.words = Memo(self._word, memo // 4)
        self.coded = {i: int(i).to_bytes(4, "little") for i in self.merges.tokens}
        self.chunks = Memo(self._chunk, memo)

    def _word(self, word: str) -> list[int]:
        if self.lexicon and (ids := self.lexicon.find(word.encode("utf-8"))) is not None:
            return ids
        return self.merges.merge(self.merges.symbols(word))

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids, as bytes, and decoded text of what stands between white space: its words depend on nothing else."""
        if chunk.isalpha():  # one word; it comes again in this form, if at all
            ids = self._word(chunk)
        elif chunk[:-1].isalpha() and chunk[-1] in ".,;:!?":
            ids = self.words[chunk[:-1]] + self.words[chunk[-1]]
        else:
            ids = [i for word in self.cut.findall(chunk) for i in self.words[word]]
        return b"".join(map(self.coded.__getitem__, ids)), self.decode(ids)

    def split(self, text: str) -> list[str]:
        """The words of a text without special strings, as the library cuts it."""
        if PLAIN.fullmatch(text):
            return self.cut.findall(text.lower())
        return [bytes(self.unspell[c] for c in w).decode("utf-8") for w, _ in self.cutter.pre_tokenize_str(self.normalizer.normalize_str(text))]

    def decode(self, ids: list[int]) -> str:
        """The tokens joined by spaces, special ones included: the file names no decoder."""
        return " ".join(map(self.merges.tokens.__getitem__, ids))

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        at = 0
        for m in self.special.finditer(text):
            yield text[at : m.start()], None
            yield m[0], self.merges.special[m[0]]
            at = m.end()
        yield text[at:], None

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.run(text)[0], "<u4").tolist()

    def run(self, text: str) -> tuple[bytes, str]:
        """Ids, as little-endian unsigned 32-bit integers, and decoded text."""
        if self.merges.marker not in text and PLAIN.fullmatch(text):
            found = [self.chunks[c] for c in text.lower().split()]
            return b"".join([a for a, _ in found]), " ".join([b for _, b in found])
        ids: list[int] = []
        for part, special in self.segments(text):
            if special is None:
                for word in self.split(part):
                    ids += self.words[word]
            else:
                ids.append(special)
        return np.array(ids, "<u4").tobytes(), self.decode(ids)


def codec(path: str, compiled: bytes | None) -> Codec:
    key = path, hashlib.md5(compiled or b"").hexdigest()
    codecs = memos("codec")
    if key not in codecs:
        spare()
        codecs[key] = Codec(path, compiled)
    return codecs[key]


def word_counts(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """word, n: how often each word of the whole corpus occurs; counted in each task before the shuffle."""
    path = vocabulary_path(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, chunks, words = codec(path, None), Counter(), Counter()

        def handed_on() -> pa.RecordBatch:
            for chunk, n in chunks.items():
                for word in (chunk,) if chunk.isalpha() else own.cut.findall(chunk):
                    words[word] += n
            out = pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])
            chunks.clear()
            words.clear()
            return out

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                if own.merges.marker not in text and PLAIN.fullmatch(text):
                    chunks.update(text.lower().split())
                else:
                    words.update(w for part, special in own.segments(text) if special is None for w in own.split(part))
            if len(chunks) + len(words) >= COUNTED:
                yield handed_on()
        yield handed_on()

    return docs.select("text").mapInArrow(lean(run, "codec"), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_lexicon(docs: DataFrame, vocabulary: str = VOCABULARY, words: int = WORDS) -> bytes:
    """The compiled transducer of the corpus's most frequent words, at most `words` of them.

    Counts fall into bins, 16 to each doubling; the lexicon takes whole bins from the top
    as long as they fit.  So neither a task nor the driver sorts or gets more than that.
    """
    own = codec(vocabulary_path(vocabulary), None)
    counts = written(word_counts(docs, vocabulary).withColumn("bin", F.floor(F.log2("n") * 16).cast("int")), "bpe-words")
    taken, least = 0, None
    for b in sorted(counts.groupBy("bin").count().collect(), key=lambda r: -r["bin"]):
        taken += b["count"]
        if taken > words:
            break
        least = b["bin"]
    top = [] if least is None else counts.where(F.col("bin") >= least).select("word").collect()
    discard(counts)
    return compile_words((r.word.encode("utf-8"), own.merges.merge(own.merges.symbols(r.word))) for r in top)


def bpe_codes(docs: DataFrame, vocabulary: str = VOCABULARY, words: int = WORDS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens and the digests of ids and decoded text of every row; with_ids adds ids and decoded."""
    arrow_rows(docs.sparkSession)
    path = vocabulary_path(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(frequent_lexicon(docs, vocabulary, words))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, shared.value)
        for batch in batches:
            sizes, ids_digests, text_digests, ids, decoded = [], [], [], [], []
            for text in batch.column(1).to_pylist():
                coded, back = own.run(text or "")
                sizes.append(len(coded) // 4)
                ids_digests.append(hashlib.sha256(coded).hexdigest())
                text_digests.append(hashlib.sha256(back.encode("utf-8")).hexdigest())
                if with_ids:
                    ids.append(np.frombuffer(coded, "<u4").astype("i4"))
                    decoded.append(back)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(text_digests, pa.string())]
            columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())] if with_ids else []
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids
    return docs.select(docs["doc_id"].cast("long"), docs["text"]).mapInArrow(lean(run, "codec"), schema)
